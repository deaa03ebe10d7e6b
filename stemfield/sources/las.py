"""LAS point files as a Python data source: header-only metadata, partitions of record ranges, Arrow batches; and a writer.

Reading: ``pid`` is the record number. Standard fields keep their names; a legacy point format gives the same columns as a new one. Extra-byte
dimensions are columns of their own; unsigned types widen to the next signed type. Comparisons of x, y, z with literals skip whole files by the header's
box and rows before they reach Spark. Writing: version 1.4, point format 6, every numeric column that is no standard field as an extra dimension.
"""

from __future__ import annotations

import math
import struct
import uuid
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

# The extra-byte types of the LAS 1.4 specification, by number.
EXTRA_TYPES = {1: "u1", 2: "i1", 3: "<u2", 4: "<i2", 5: "<u4", 6: "<i4", 7: "<u8", 8: "<i8", 9: "<f4", 10: "<f8"}
# Standard fields and the Spark types that hold them.
STANDARD = {"intensity": "int", "classification": "smallint", "return_number": "smallint", "number_of_returns": "smallint", "gps_time": "double", "scan_angle": "smallint", "user_data": "smallint", "source_id": "int"}
_WIDER = {"u1": "smallint", "i1": "tinyint", "u2": "int", "i2": "smallint", "u4": "bigint", "i4": "int", "u8": "decimal(20,0)", "i8": "bigint", "f4": "float", "f8": "double"}
_COLOUR, _NIR = [("red", "<u2"), ("green", "<u2"), ("blue", "<u2")], [("nir", "<u2")]
_XYZ = [("X", "<i4"), ("Y", "<i4"), ("Z", "<i4"), ("intensity", "<u2")]
_OLD = [*_XYZ, ("flags", "u1"), ("class", "u1"), ("angle", "i1"), ("user_data", "u1"), ("source_id", "<u2")]
_NEW = [*_XYZ, ("returns", "u1"), ("flags", "u1"), ("class", "u1"), ("user_data", "u1"), ("angle", "<i2"), ("source_id", "<u2"), ("gps_time", "<f8")]
FORMATS = {0: _OLD, 1: [*_OLD, ("gps_time", "<f8")], 2: [*_OLD, *_COLOUR], 3: [*_OLD, ("gps_time", "<f8"), *_COLOUR], 6: _NEW, 7: [*_NEW, *_COLOUR], 8: [*_NEW, *_COLOUR, *_NIR]}


def open_store(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


@dataclass
class Header:
    path: str
    version: str
    point_format: int
    record_length: int
    data_offset: int
    count: int
    scales: tuple
    offsets: tuple
    low: tuple
    high: tuple
    extras: list = field(default_factory=list)

    def dtype(self) -> np.dtype:
        if self.point_format not in FORMATS:
            raise ValueError(f"{self.path}: point format {self.point_format} isn't supported")
        fields = [*FORMATS[self.point_format], *[(f"extra:{n}", t) for n, t in self.extras]]
        size = np.dtype(fields).itemsize
        if size < self.record_length:
            fields.append(("_rest", f"V{self.record_length - size}"))
        return np.dtype(fields)

    def schema(self) -> str:
        names = dict(FORMATS[self.point_format])
        cols = [("pid", "bigint"), ("x", "double"), ("y", "double"), ("z", "double")] + [(n, t) for n, t in STANDARD.items() if n != "gps_time" or "gps_time" in names]
        cols += [(n, "int") for n in ("red", "green", "blue", "nir") if n in names] + [(n, _WIDER[np.dtype(t).str[1:]]) for n, t in self.extras]
        return ", ".join(f"`{n}` {t}" for n, t in cols)


def read_header(path: str) -> Header:
    store, inner = open_store(path)
    with store.open_input_file(inner) as f:
        raw = f.read(375)
        if raw[:4] != b"LASF":
            raise ValueError(f"{path} is no LAS file")
        major, minor = raw[24], raw[25]
        size, offset, n_vlr, fmt, length, legacy = struct.unpack_from("<HIIBHI", raw, 94)
        scales, offsets = struct.unpack_from("<3d", raw, 131), struct.unpack_from("<3d", raw, 155)
        box = struct.unpack_from("<6d", raw, 179)
        if fmt & 0x80:
            raise ImportError("compressed LAS (LAZ) needs a decoder that is not installed")
        count = struct.unpack_from("<Q", raw, 247)[0] if (major, minor) >= (1, 4) else legacy
        extras, at = [], size
        for _ in range(n_vlr):
            f.seek(at)
            user, record, n = struct.unpack("<2x16sHH32x", f.read(54))
            if user.rstrip(b"\0") == b"LASF_Spec" and record == 4:
                body = f.read(n)
                for i in range(0, n - 191, 192):
                    kind, name = body[i + 2], body[i + 4 : i + 36].split(b"\0")[0].decode("utf-8", "replace")
                    if kind in EXTRA_TYPES:
                        extras.append((name, EXTRA_TYPES[kind]))
            at += 54 + n
    return Header(path, f"{major}.{minor}", fmt, length, offset, count or legacy, scales, offsets, box[1::2], box[0::2], extras)


class Records(InputPartition):
    def __init__(self, start: int, stop: int):
        self.start, self.stop = start, stop


class LasReader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict):
        self.header, self.names = read_header(options["path"]), schema.fieldNames()
        self.step, self.limits = int(options.get("records_per_partition", 1_000_000)), []

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual) and f.attribute in (("x",), ("y",), ("z",)):
                self.limits.append(("xyz".index(f.attribute[0]), isinstance(f, GreaterThan | GreaterThanOrEqual), float(f.value)))
            yield f  # Spark tests it again: equality at the limit is left to it

    def partitions(self):
        h = self.header
        if any(h.high[i] < v if lower else h.low[i] > v for i, lower, v in self.limits):
            return [Records(0, 0)]
        return [Records(a, min(a + self.step, h.count)) for a in range(0, h.count, self.step)] or [Records(0, 0)]

    def read(self, part):
        store, inner = open_store(self.header.path)
        with store.open_input_file(inner) as f:
            for a in range(part.start, part.stop, 65_536):
                n = min(65_536, part.stop - a)
                f.seek(self.header.data_offset + a * self.header.record_length)
                rows = np.frombuffer(f.read(n * self.header.record_length), self.header.dtype())
                table = columns_of(rows, self.header, a)
                keep = np.ones(n, bool)
                for i, lower, v in self.limits:
                    keep &= table["xyz"[i]] >= v if lower else table["xyz"[i]] <= v
                yield pa.RecordBatch.from_pydict({k: table[k][keep] for k in self.names}, arrow_schema(self.header, self.names))


def arrow_schema(header: Header, names: list[str]) -> pa.Schema:
    kinds = {"bigint": pa.int64(), "double": pa.float64(), "int": pa.int32(), "smallint": pa.int16(), "tinyint": pa.int8(), "float": pa.float32(), "decimal(20,0)": pa.decimal128(20, 0)}
    types = {c.split("` ")[0][1:]: kinds[c.split("` ")[1]] for c in header.schema().split(", ")}
    return pa.schema([(n, types[n]) for n in names])


def columns_of(rows: np.ndarray, header: Header, first: int) -> dict[str, np.ndarray]:
    """Columns by name; the return numbers are packed differently in old and new formats."""
    new = header.point_format >= 6
    out = {"pid": np.arange(first, first + len(rows))}
    out |= {c: rows[c.upper()] * s + o for c, s, o in zip("xyz", header.scales, header.offsets, strict=True)}
    packed = rows["returns"] if new else rows["flags"]
    bits = 4 if new else 3
    out |= {"intensity": rows["intensity"].astype(np.int32), "classification": (rows["class"] if new else rows["class"] & 31).astype(np.int16), "return_number": (packed & (2**bits - 1)).astype(np.int16), "number_of_returns": (packed >> bits & (2**bits - 1)).astype(np.int16)}
    out |= {"scan_angle": rows["angle"].astype(np.int16), "user_data": rows["user_data"].astype(np.int16), "source_id": rows["source_id"].astype(np.int32)}
    out |= {n: rows[n] for n in ("gps_time",) if n in rows.dtype.names} | {n: rows[n].astype(np.int32) for n in ("red", "green", "blue", "nir") if n in rows.dtype.names}
    for n, t in header.extras:
        v = rows[f"extra:{n}"]
        out[n] = v if np.dtype(t).kind != "u" else v.astype({1: np.int16, 2: np.int32, 4: np.int64}[v.itemsize]) if v.itemsize < 8 else np.array([int(x) for x in v], object)
    return out


def extra_type(spark_type: T.DataType) -> str | None:
    return {"tinyint": "i1", "smallint": "<i2", "int": "<i4", "bigint": "<i8", "float": "<f4", "double": "<f8", "decimal(20,0)": "<u8"}.get(spark_type.simpleString())


class Part(WriterCommitMessage):
    def __init__(self, path: str, count: int, low: list, high: list, returns: list):
        self.path, self.count, self.low, self.high, self.returns = path, count, low, high, returns


class LasWriter(DataSourceWriter):
    def __init__(self, schema: T.StructType, options: dict):
        self.path = options["path"]
        self.scale, self.offset = ([float(v) for v in options[k].split(",")] for k in ("scales", "offsets"))
        self.names = schema.fieldNames()
        self.extras = [(f.name, extra_type(f.dataType)) for f in schema if f.name not in STANDARD and f.name not in ("pid", "x", "y", "z") and extra_type(f.dataType)]

    def write(self, iterator):
        dtype = np.dtype([*_NEW, *[(f"extra:{n}", t) for n, t in self.extras]])
        store, inner = open_store(f"{self.path}.parts/{uuid.uuid4().hex}")
        store.create_dir(inner.rpartition("/")[0], recursive=True)
        total, low, high, returns = 0, [math.inf] * 3, [-math.inf] * 3, [0] * 15
        with store.open_output_stream(inner, compression=None) as out:
            held: list = []

            def flush():
                nonlocal total
                if held:
                    rows = np.zeros(len(held), dtype)
                    get = lambda n: np.array([r[n] if r[n] is not None else 0 for r in held])
                    for i, c in enumerate("xyz"):
                        v = np.rint((get(c).astype(float) - self.offset[i]) / self.scale[i])
                        if np.abs(v).max() >= 2**31:
                            raise ValueError(f"{c} doesn't fit the scale {self.scale[i]}")
                        rows[c.upper()] = v
                        low[i], high[i] = min(low[i], v.min() * self.scale[i] + self.offset[i]), max(high[i], v.max() * self.scale[i] + self.offset[i])
                    for target, name in (("intensity", "intensity"), ("class", "classification"), ("angle", "scan_angle"), ("user_data", "user_data"), ("source_id", "source_id"), ("gps_time", "gps_time")):
                        if name in self.names:
                            rows[target] = get(name)
                    r, n = (get(c).astype(int) if c in self.names else np.zeros(len(held), int) for c in ("return_number", "number_of_returns"))
                    rows["returns"] = r & 15 | (n & 15) << 4
                    for k in range(15):
                        returns[k] += int((r == k + 1).sum())
                    for name, _ in self.extras:
                        rows[f"extra:{name}"] = get(name)
                    out.write(rows.tobytes())
                    total += len(held)
                    held.clear()

            for row in iterator:
                held.append(row)
                if len(held) >= 50_000:
                    flush()
            flush()
        return Part(inner, total, low, high, returns)

    def commit(self, messages):
        store, inner = open_store(self.path)
        parts = [m for m in messages if m]
        count = sum(m.count for m in parts)
        low = [min((m.low[i] for m in parts if m.count), default=0.0) for i in range(3)]
        high = [max((m.high[i] for m in parts if m.count), default=0.0) for i in range(3)]
        returns = [sum(m.returns[k] for m in parts) for k in range(15)]
        kinds = {t: n for n, t in EXTRA_TYPES.items()}
        body = b"".join(struct.pack("<2xBB32s4x120x32x", kinds[t], 0, n.encode()[:32]) for n, t in self.extras)
        vlr = struct.pack("<2x16sHH32x", b"LASF_Spec", 4, len(body)) + body if body else b""
        length = np.dtype([*_NEW, *[(n, t) for n, t in self.extras]]).itemsize
        head = struct.pack("<4sHH16xBB32s32sHHHIIBHI20x", b"LASF", 0, 16, 1, 4, b"", b"stemfield", 1, 2000, 375, 375 + len(vlr), int(bool(vlr)), 6, length, 0)
        head += struct.pack("<3d3d6d", *self.scale, *self.offset, *(v for i in range(3) for v in (high[i], low[i]))) + struct.pack("<QQIQ15Q", 0, 0, 0, count, *returns)
        with store.open_output_stream(inner, compression=None) as out:
            out.write(head + vlr)
            for m in parts:
                with store.open_input_stream(m.path) as f:
                    while piece := f.read(8 << 20):
                        out.write(piece)
        self.clean(parts)

    def clean(self, parts):
        store, inner = open_store(self.path)
        store.delete_dir(f"{inner}.parts")

    def abort(self, messages):
        for m in messages:
            if m:
                open_store(self.path)[0].delete_file(m.path)


class LasSource(DataSource):
    @classmethod
    def name(cls):
        return "las"

    def schema(self):
        return read_header(self.options["path"]).schema()

    def reader(self, schema):
        return LasReader(schema, self.options)

    def writer(self, schema, overwrite):
        return LasWriter(schema, self.options)


def read_las(spark: SparkSession, path: str, precision: str = "float64") -> DataFrame:
    """Points of one file. ``float32`` rounds the coordinates at the scan, as single-precision clouds do."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(LasSource)
    points = spark.read.format("las").load(path)
    return points.withColumns({c: F.col(c).cast("float").cast("double") for c in "xyz"}) if precision == "float32" else points


def write_las(points: DataFrame, path: str) -> None:
    """One LAS file. Offsets are the minima; the scale is 1e-6, or as much coarser as the extent needs."""
    if path.lower().endswith(".laz"):
        raise ImportError("compressed LAS (LAZ) needs an encoder that is not installed")
    box = points.agg(*[f(F.col(c).cast("double")).alias(f"{c}{n}") for c in "xyz" for f, n in ((F.min, "lo"), (F.max, "hi"))]).first()
    if box["xlo"] is None:
        raise ValueError("an empty point cloud can't be written")
    scales = [max(1e-6, 10 ** math.ceil(math.log10(max((box[f"{c}hi"] - box[f"{c}lo"]) / (2**31 - 2), 1e-300)))) for c in "xyz"]
    points.sparkSession.dataSource.register(LasSource)
    points.orderBy("pid").write.format("las").mode("append").option("scales", ",".join(map(repr, scales))).option("offsets", ",".join(repr(box[f"{c}lo"]) for c in "xyz")).save(path)


def read_las_metadata(spark: SparkSession, path: str) -> DataFrame:
    """One row from the header alone."""
    h = read_header(path)
    schema = "path string, format string, point_count long, bounds_min array<double>, bounds_max array<double>, scan_count int, scan_index int, version string, point_format int, scales array<double>, offsets array<double>, translation array<double>, rotation array<array<double>>, extra map<string,string>"
    return spark.createDataFrame([(path, "las", h.count, list(h.low), list(h.high), 1, None, h.version, h.point_format, list(h.scales), list(h.offsets), None, None, {n: t for n, t in h.extras})], schema)
