"""Point files by extension, the paths of a run, and CSV tables."""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from .las import read_las, read_las_metadata, write_las


def find_input_files(path: str, prefix: str = "", fmt: str = "las") -> list[str]:
    """A file is itself; of a folder the files with the prefix and (in any case) the extension, sorted."""
    p = Path(path)
    if p.is_file():
        return [str(p)]
    found = sorted(str(f) for f in p.iterdir() if f.is_file() and f.name.startswith(prefix) and f.suffix.lower() == f".{fmt.lower()}") if p.is_dir() else []
    if not found:
        raise FileNotFoundError(f"no {fmt} file with prefix {prefix!r} in {path}")
    return found


def output_path(folder: str, prefix: str, stem: str, fmt: str, scan: int | None = None) -> str:
    return f"{folder}/{prefix}{stem}{'' if scan is None else f'_S{scan}'}.{fmt}"


def find_scan_outputs(folder: str, prefix: str, stem: str, fmt: str) -> list[str]:
    """Outputs of numbered scans, in the order of their numbers."""
    pattern = re.compile(rf"{re.escape(prefix + stem)}_S(\d+)\.{re.escape(fmt)}")
    hits = [(int(m[1]), str(f)) for f in Path(folder).iterdir() if (m := pattern.fullmatch(f.name))] if Path(folder).is_dir() else []
    return [f for _, f in sorted(hits)]


def _missing(kind: str):
    raise ImportError(f"{kind} files need a plugin that is not installed")


def read_pc(spark: SparkSession, path: str, precision: str = "float64") -> DataFrame:
    kind = Path(path).suffix.lower()
    if kind == ".las":
        return read_las(spark, path, precision)
    if kind == ".parquet":
        return spark.read.parquet(path)
    if kind in (".laz", ".e57"):
        _missing(kind)
    raise ValueError(f"no reader for {kind!r}")


def write_pc(points: DataFrame, path: str) -> None:
    kind = Path(path).suffix.lower()
    if kind == ".las":
        write_las(points, path)
    elif kind == ".parquet":
        points.write.mode("overwrite").parquet(path)
    elif kind in (".laz", ".e57"):
        _missing(kind)
    else:
        raise ValueError(f"no writer for {kind!r}")


def read_pc_metadata(spark: SparkSession, path: str) -> DataFrame:
    kind = Path(path).suffix.lower()
    if kind == ".las":
        return read_las_metadata(spark, path)
    if kind in (".laz", ".e57"):
        _missing(kind)
    raise ValueError(f"no metadata reader for {kind!r}")


def write_csv(table: DataFrame, path: str, order: list[str]) -> bool:
    """One file with a header, floats to 8 significant digits; nothing is written for an empty table. For tables of trees and nodes, not of points."""
    rows = table.orderBy(*order).toLocalIterator()
    first = next(rows, None)
    if first is None:
        return False
    text = lambda v: "" if v is None else f"{v:.8g}" if isinstance(v, float) else str(v)
    with open(path, "w", encoding="utf-8") as f:
        f.write(",".join(table.columns) + "\n" + ",".join(map(text, first)) + "\n")
        f.writelines(",".join(map(text, r)) + "\n" for r in rows)
    return True
