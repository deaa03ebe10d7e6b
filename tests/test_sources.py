import pytest

from stemfield.config import load_config
from stemfield.plans.pipeline import run_pipeline
from stemfield.sources import files, las


def test_las_round_trip(spark, tmp_path):
    points = spark.range(500).selectExpr("id pid", "id * 0.37 x", "-id * 0.11 y", "sin(id) z", "cast(id % 9 as int) intensity", "cast(1 as smallint) return_number", "cast(2 as smallint) number_of_returns", "id * 0.5 gps_time", "cast(id as float) height_f", "id * 3 tag")
    path = str(tmp_path / "a.las")
    files.write_pc(points, path)
    back = files.read_pc(spark, path)
    joined = points.selectExpr("pid", "x x0", "y y0", "z z0", "tag t0", "height_f h0", "intensity i0").join(back, "pid")
    row = joined.selectExpr("count(*) n", "max(abs(x - x0) + abs(y - y0) + abs(z - z0)) d", "sum(int(tag <> t0 or height_f <> h0 or intensity <> i0)) bad").first()
    assert row.n == 500 and row.d < 1e-5 and row.bad == 0
    assert back.where("x > 100").count() == points.where("x > 100").count()
    meta = files.read_pc_metadata(spark, path).first()
    assert meta.point_count == 500 and meta.point_format == 6 and meta.version == "1.4"
    assert las.read_header(path).count == 500


def test_paths(tmp_path):
    for name in ("b.las", "a.LAS", "a_S10.las", "a_S2.las", "x.txt"):
        (tmp_path / name).write_text("")
    assert [p.rsplit("/", 1)[1] for p in files.find_input_files(str(tmp_path), "a")] == ["a.LAS", "a_S10.las", "a_S2.las"]
    assert [p.rsplit("/", 1)[1] for p in files.find_scan_outputs(str(tmp_path), "", "a", "las")] == ["a_S2.las", "a_S10.las"]
    with pytest.raises(FileNotFoundError):
        files.find_input_files(str(tmp_path), "zzz")


def test_plugins_are_named(spark):
    for path in ("a.laz", "a.e57"):
        with pytest.raises(ImportError):
            files.read_pc(spark, path)
    with pytest.raises(ValueError):
        files.read_pc(spark, "a.xyz")


def test_csv(spark, tmp_path):
    df = spark.createDataFrame([(2, 1 / 3), (1, 123456.789)], "a long, b double")
    assert files.write_csv(df, str(tmp_path / "t.csv"), ["a"])
    assert (tmp_path / "t.csv").read_text() == "a,b\n1,123456.79\n2,0.33333333\n"
    assert not files.write_csv(df.limit(0), str(tmp_path / "no.csv"), ["a"]) and not (tmp_path / "no.csv").exists()


def test_config():
    cfg = load_config(text="[qsm]\nmin_node_size = 9\n[tree_segmentation]\nmin_nbs_size = 7\nmerge_threshold = 0.5\n")
    assert (cfg.tree.model.min_node_size, cfg.tree.min_nbs_size, cfg.tree.assembly.merge_threshold) == (9, 7, 0.5)
    with pytest.warns(UserWarning):
        load_config(text="[pipeline]\nno_such_key = 1\n")
    with pytest.raises(ValueError):
        load_config(text="").check()


def test_scans_of_several_files(spark, tmp_path):
    """Each file is filtered for itself and written as a numbered scan; a later run merges the scans, its missing input is an error."""
    grid = "id pid", "id % 20 * 0.3 x", "floor(id / 20) * 0.3 y", "0.01 * (id % 3) z"
    for name, shift in (("a", 0), ("b", 6)):
        files.write_pc(spark.range(400).selectExpr(*grid).selectExpr("pid", f"x + {shift} x", "y", "z"), str(tmp_path / "in" / f"{name}.las"))
    only = lambda stage, out: load_config(text=f'[pipeline]\ninput_path = "{tmp_path}/in"\ninput_format = "las"\noutput_dir = "{tmp_path}/{out}"\noutput_prefix = "p"\n' + "".join(f"enable_{s} = {str(s == stage).lower()}\n" for s in ("preprocess", "ground_segmentation", "tree_segmentation", "qsm", "subsample", "agh", "generate_report")) + "[preprocess]\nenable_statistical_filter = false\n[segment_ground]\nenable_ground_crop = false\n")
    first = run_pipeline(spark, only("preprocess", "out"))
    assert first.summary["n_points"] == 800 and first.preprocessed.select("pid").distinct().count() == 800
    assert [f.rsplit("/", 1)[1] for f in files.find_scan_outputs(str(tmp_path / "out"), "p", "_preprocessed", "parquet")] == ["p_preprocessed_S1.parquet", "p_preprocessed_S2.parquet"]
    second = run_pipeline(spark, only("ground_segmentation", "out"))
    assert second.heights.count() == 800 and second.summary["n_ground"] > 100
    with pytest.raises(ValueError, match="switched off"):
        run_pipeline(spark, only("ground_segmentation", "none"))
