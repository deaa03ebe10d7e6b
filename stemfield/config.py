"""Settings of the pipeline, from TOML. Unknown keys warn and are ignored, missing ones have the defaults below."""

from __future__ import annotations

import dataclasses
import tomllib
import warnings
from dataclasses import dataclass, field


@dataclass(frozen=True)
class StatisticalFilter:
    k_neighbors: int = 6
    n_sigma: float = 1.0


@dataclass(frozen=True)
class SegmentGround:
    voxel_size: float = 0.5
    min_cc_size: int = 50
    grid_size: float = 0.5
    cone_theta_deg: float = 60.0
    polygon_buffer: float = 0.0
    enable_ground_crop: bool = True


@dataclass(frozen=True)
class Preprocess:
    enable_statistical_filter: bool = False


@dataclass(frozen=True)
class Assembly:
    merge_threshold: float = 0.8
    occlusion_tolerance: float = 0.1


@dataclass(frozen=True)
class Refine:
    enable: bool = True
    mode: str = "apply"
    overlap_threshold: float = 0.2
    completeness_gate: float = 0.25
    min_points_gate: int = 20
    voxel_res_scalar: float = 1.0
    candidate_radius_scalar: float = 1.0


@dataclass(frozen=True)
class Model:
    nbs_linearity_threshold: float = 0.5
    slice_height_scalar: float = 3.0
    min_node_size: int = 5
    phi_bin_min: int = 36
    phi_bin_max: int = 360
    surface_res_scalar: float = 0.5
    completeness_threshold: float = 0.25
    breast_height: float = 1.3
    spl_z_smoothing: float = 0.3
    rho_percentile: float = 1.0
    min_octant_taubin: int = 3
    qc_enable: bool = True
    qc_continuity_ratio: float = 0.7


@dataclass(frozen=True)
class Tree:
    neighbor_radius: float = -1.0
    min_nbs_size: int = 5
    nearground_agh_threshold: float = 0.3
    linearity_angle_deg: float = 80.0
    nbs_neighbor_distance: int = 2
    frontier_min_cc_size: int = 3
    assembly: Assembly = field(default_factory=Assembly)
    refine: Refine = field(default_factory=Refine)
    model: Model = field(default_factory=Model)


@dataclass(frozen=True)
class Pipeline:
    input_path: str = ""
    output_dir: str = ""
    output_prefix: str = "output"
    input_prefix: str = ""
    input_format: str = "las"
    output_format: str = "parquet"
    coordinate_precision: str = "float32"
    subsample_res: float = 0.05
    xy_resolution: float = 0.05
    idw_k: int = 8
    idw_power: float = 2.0
    enable_subsample: bool = False
    enable_preprocess: bool = True
    enable_ground_segmentation: bool = True
    enable_agh: bool = True
    enable_tree_segmentation: bool = True
    enable_qsm: bool = True
    enable_generate_report: bool = True
    enable_debug_info: bool = False
    n_thread: int = 1


@dataclass(frozen=True)
class Config:
    pipeline: Pipeline = field(default_factory=Pipeline)
    preprocess: Preprocess = field(default_factory=Preprocess)
    statistical_filter: StatisticalFilter = field(default_factory=StatisticalFilter)
    segment_ground: SegmentGround = field(default_factory=SegmentGround)
    tree: Tree = field(default_factory=Tree)

    def check(self) -> None:
        p = self.pipeline
        for name in ("input_path", "output_dir", "output_prefix"):
            if not getattr(p, name):
                raise ValueError(f"pipeline.{name} is missing")
        if not (p.subsample_res > 0 and p.xy_resolution > 0 and p.idw_power > 0 and p.idw_k >= 1):
            raise ValueError("subsample_res, xy_resolution and idw_power must be positive, idw_k at least 1")


def _build(kind: type, values: dict, where: str = ""):
    fields, given = {f.name: f for f in dataclasses.fields(kind)}, {}
    for key, value in values.items():
        if key not in fields:
            warnings.warn(f"unknown setting {where}{key}", stacklevel=2)
        elif isinstance(value, dict):
            given[key] = _build(fields[key].default_factory, value, f"{where}{key}.")
        else:
            given[key] = type(fields[key].default)(value)
    return kind(**given)


def migrated(values: dict) -> dict:
    """Former sections ``tree_segmentation``, ``qsm`` and ``nbs_refine`` as parts of ``tree``, unless there is a ``tree``."""
    old = {k: values[k] for k in ("tree_segmentation", "qsm", "nbs_refine") if k in values}
    out = {k: v for k, v in values.items() if k not in old}
    if "tree" in out or not old:
        return out
    names = lambda kind: {f.name for f in dataclasses.fields(kind)}
    segment = old.get("tree_segmentation", {})
    tree = {k: v for k, v in segment.items() if k in names(Tree)} | {"assembly": {k: v for k, v in segment.items() if k in names(Assembly)}}
    tree["model"] = {k: v for k, v in old.get("qsm", {}).items() if k in names(Model)}
    tree["refine"] = {k: v for k, v in old.get("nbs_refine", {}).items() if k in names(Refine)}
    return out | {"tree": tree}


def load_config(path: str | None = None, text: str | None = None) -> Config:
    if text is None:
        with open(path, "rb") as f:
            values = tomllib.load(f)
    else:
        values = tomllib.loads(text)
    return _build(Config, migrated(values))
