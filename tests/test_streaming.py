from stemfield.operators import filters
from stemfield.streaming import stream_scans, write_filtered


def test_scans_as_a_stream(spark, tmp_path):
    points = spark.range(100).selectExpr("id pid", "double(id % 10) x", "double(floor(id / 10)) y", "double(id) z")
    points.write.parquet(str(tmp_path / "in"))
    stream = stream_scans(spark, str(tmp_path / "in"), "pid long, x double, y double, z double")
    write_filtered(stream, lambda f: filters.grid_zmin(f, 5.0), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = sorted(r.pid for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == sorted(r.pid for r in filters.grid_zmin(points, 5.0).collect()) == [0, 5, 50, 55]
