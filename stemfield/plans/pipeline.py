"""The whole run: files to points, filters, ground and heights, trees, models, tables. Each stage writes Parquet, so a later run can start at any stage."""

from __future__ import annotations

import json
import logging
import time
from contextlib import contextmanager
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..operators import biometrics, filters, geometry, points, trees
from ..sources import files

log = logging.getLogger("stemfield")
NODE_CSV = ["qsm_node_id", "tree_nbs_id", "tree_id", "agh", "cross_area", "circumference", "radius_area", "radius_circ", "height", "volume", "surface_area", "completeness", "n_points", "center_x", "center_y", "center_z", "direction_x", "direction_y", "direction_z"]
TREE_CSV = ["tree_id", "volume", "surface_area", "height", "dbh_area", "dbh_circ", "n_points", "n_nodes", "x", "y"]


def elapsed(seconds: float) -> str:
    m, s = divmod(seconds, 60)
    h, m = divmod(int(m), 60)
    return f"{h}h {m}m {s:.0f}s" if h else f"{m}m {s:.0f}s" if m else f"{s:.2f}s"


@contextmanager
def timed(stage: str, summary: dict):
    began = time.monotonic()
    log.info("%s: started", stage)
    yield
    summary.setdefault("seconds", {})[stage] = round(time.monotonic() - began, 3)
    log.info("%s: done in %s", stage, elapsed(time.monotonic() - began))


@dataclass
class Result:
    summary: dict = field(default_factory=dict)
    preprocessed: DataFrame | None = None
    ground: DataFrame | None = None
    heights: DataFrame | None = None
    trees: DataFrame | None = None
    nodes: DataFrame | None = None
    tree_table: DataFrame | None = None
    surface: DataFrame | None = None


def preprocess(spark: SparkSession, cfg: Config) -> list[DataFrame]:
    """The filtered cloud of each input file."""
    p, s = cfg.pipeline, cfg.statistical_filter
    clouds = [files.read_pc(spark, f, p.coordinate_precision.lower()) for f in files.find_input_files(p.input_path, p.input_prefix, p.input_format)]
    sor = (s.k_neighbors, s.n_sigma) if cfg.preprocess.enable_statistical_filter else None
    return [filters.preprocess_filters(c, p.subsample_res if p.enable_subsample else None, sor) for c in clouds]


def ground_segmentation(cloud: DataFrame, cfg: Config) -> tuple[DataFrame, DataFrame, float]:
    """Ground points, the (cropped) cloud with AGH if enabled, and the area of the ground polygon; the input is not changed."""
    g, p, s = cfg.segment_ground, cfg.pipeline, cfg.statistical_filter
    ground = geometry.segment_ground(cloud, g.grid_size, g.cone_theta_deg, g.voxel_size, g.min_cc_size)
    area, polygon = 0.0, None
    if g.enable_ground_crop:
        cloud, polygon, area = geometry.crop_by_ground_polygon(cloud, ground, g.polygon_buffer, s.k_neighbors, s.n_sigma)
    if p.enable_agh:
        cloud = geometry.aboveground_height(cloud, ground, p.xy_resolution, p.idw_k, p.idw_power, polygon)
    return ground, cloud, area


def run_pipeline(spark: SparkSession, cfg: Config) -> Result:
    """Runs the enabled stages; the output of a stage that is switched off is read from an earlier run's folder. Several input files are
    filtered and written each as a numbered scan, and go on merged; a later run takes the single output of a stage, or else its scans."""
    cfg.check()
    p, out = cfg.pipeline, Result()
    Path(p.output_dir).mkdir(parents=True, exist_ok=True)
    path = lambda stem, scan=None: files.output_path(p.output_dir, p.output_prefix, stem, "parquet", scan)

    def stored(df: DataFrame, stem: str, scan: int | None = None) -> DataFrame:
        df.write.mode("overwrite").parquet(path(stem, scan))
        return spark.read.parquet(path(stem, scan))

    def earlier(stem: str) -> DataFrame:
        if Path(path(stem)).exists():
            return spark.read.parquet(path(stem))
        scans = files.find_scan_outputs(p.output_dir, p.output_prefix, stem, "parquet")
        if not scans:
            raise ValueError(f"neither {path(stem)} nor numbered scans of it exist, and its stage is switched off")
        return points.merge([spark.read.parquet(f) for f in scans])

    if p.enable_preprocess:
        with timed("preprocess", out.summary):
            clouds = preprocess(spark, cfg)
            scans = [stored(c, "_preprocessed", i if len(clouds) > 1 else None) for i, c in enumerate(clouds, 1)]
            out.preprocessed = points.merge(scans)
            out.summary["n_points"] = out.preprocessed.count()
    if p.enable_ground_segmentation:
        with timed("ground", out.summary):
            ground, cloud, area = ground_segmentation(out.preprocessed if out.preprocessed is not None else earlier("_preprocessed"), cfg)
            out.ground, out.heights = stored(ground, "_ground"), stored(cloud, "_agh")
            out.summary |= {"n_ground": out.ground.count(), "ground_area": area}
    if p.enable_tree_segmentation:
        with timed("trees", out.summary):
            cloud, merges, moves = trees.tree_segmentation(out.heights if out.heights is not None else earlier("_agh"), cfg)
            out.trees = stored(cloud, "_trees")
            out.summary |= {"n_trees": out.trees.where("tree_id > 0").select("tree_id").distinct().count(), "n_merges": merges.count(), "n_moves": moves.count()}
            if p.enable_debug_info:
                files.write_csv(merges, f"{p.output_dir}/{p.output_prefix}_rule_b.csv", ["donor_nbs"])
                files.write_csv(moves, f"{p.output_dir}/{p.output_prefix}_node_moves.csv", ["trial_node_id"])
    if p.enable_qsm:
        with timed("qsm", out.summary):
            nodes, cloud, surface = trees.model_trees(out.trees if out.trees is not None else earlier("_trees"), cfg)
            nodes = biometrics.node_table(nodes.withColumn("node_id", F.col("qsm_node_id")))
            out.nodes, out.surface = stored(nodes, "_nodes"), stored(surface, "_surface")
            stored(cloud, "_modelled")
            out.tree_table = stored(biometrics.tree_table(out.nodes, cfg.tree.model.breast_height), "_tree_table")
            out.summary["n_nodes"] = out.nodes.count()
            files.write_csv(out.nodes.select(*NODE_CSV), f"{p.output_dir}/{p.output_prefix}_qsm_nodes.csv", ["qsm_node_id"])
            files.write_csv(out.tree_table.select(*TREE_CSV), f"{p.output_dir}/{p.output_prefix}_qsm_trees.csv", ["tree_id"])
    if p.enable_generate_report:
        Path(files.output_path(p.output_dir, p.output_prefix, "_report", "json")).write_text(json.dumps(out.summary, indent=1), encoding="utf-8")
    return out
