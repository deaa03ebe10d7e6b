"""WARC archives: a Python data source that writes and reads records, and duplicate payloads as revisits.

Reading: the driver lists the archives and plans one partition a file; record type and header predicates are
pushed down (through ``pushFilters`` or the ``where`` option), each record's headers are parsed first, and the
payload of a record that is not wanted is skipped over: it is inflated as part of the archive's stream, but neither kept, decoded nor handed on.

Nulls: a null payload is written as an empty one; a null URL writes no WARC-Target-URI and is read as null; a
null page_id is the id ``null`` and counts as smaller than all others. Of repeated rows that share payload and
largest page_id, all are responses. An empty table writes no archive and reads as no rows. Further columns of
the input are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import uuid
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, In, InputPartition, WriterCommitMessage

from ..session import new_path
from .common import salted_min, table

SCHEMA = "record_id string, warc_type string, target_uri string, warc_date string, refers_to string, payload_digest string, payload_bytes long, content_length long, payload binary"
#: Columns that are known from the headers alone.
HEADERS = ("record_id", "warc_type", "target_uri", "warc_date", "refers_to", "payload_digest", "payload_bytes", "content_length")
VERSION = b"WARC/1.1"
CRLF = b"\r\n"


def open_store(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def record_bytes(kind: str, record_id: str, uri: str | None, date: str, digest: str, length: int, payload: bytes | None, refers_to: str | None, media: str = "text/html; charset=utf-8") -> bytes:
    """One record. A revisit carries the HTTP headers alone, whose Content-Length is that of the full payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: " + media.encode() + b"\r\nContent-Length: " + str(length).encode() + b"\r\n\r\n"
    block = http + (payload or b"")
    head = [VERSION, b"WARC-Type: " + kind.encode(), b"WARC-Record-ID: <" + record_id.encode() + b">", b"WARC-Date: " + date.encode()]
    if uri is not None:
        head.append(b"WARC-Target-URI: " + quote(uri, safe="%:/?#[]@!$&'()*+,;=~").encode())
    head.append(b"WARC-Payload-Digest: sha1:" + digest.encode())
    if kind == "revisit":
        head += [b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", b"WARC-Refers-To: <" + refers_to.encode() + b">"]
    head += [b"Content-Type: application/http; msgtype=response", b"Content-Length: " + str(len(block)).encode()]
    return CRLF.join(head) + CRLF + CRLF + block + CRLF + CRLF


def read_headers(stream) -> dict[str, str] | None:
    """The header block at the stream's position; None at the end."""
    line = stream.readline()
    while line in (CRLF, b"\n"):
        line = stream.readline()
    if not line:
        return None
    if not line.startswith(b"WARC/"):
        raise ValueError(f"no WARC record here: {line[:40]!r}")
    out = {}
    while (line := stream.readline()) not in (CRLF, b"\n", b""):
        name, _, value = line.partition(b":")
        out[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8")
    return out


class _Matches:
    """Predicates on header columns: column -> allowed values."""

    def __init__(self, allowed: dict[str, list]):
        self.allowed = {k: set(v) for k, v in allowed.items()}

    def __call__(self, row: dict) -> bool:
        return all(row.get(k) in v for k, v in self.allowed.items())


class WarcFile(InputPartition):
    def __init__(self, path: str):
        self.path = path


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.allowed: dict[str, list] = json.loads(options.get("where", "{}"))
        self.payload = options.get("payload", "true") == "true"
        self.verify = options.get("verify", "false") == "true"

    def pushFilters(self, filters):
        for f in filters:
            name = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
            if name in HEADERS and isinstance(f, EqualTo | In):
                values = [f.value] if isinstance(f, EqualTo) else list(f.value)
                self.allowed[name] = [v for v in values if v in self.allowed.get(name, values)]
            else:
                yield f

    def partitions(self):
        store, path = open_store(self.path)
        found = store.get_file_info(pafs.FileSelector(path, allow_not_found=True, recursive=True)) if store.get_file_info(path).type != pafs.FileType.File else [store.get_file_info(path)]
        return [WarcFile(f.path) for f in sorted(found, key=lambda f: (-f.size, f.path)) if f.is_file and (f.path.endswith(".warc") or f.path.endswith(".warc.gz"))] or [WarcFile("")]

    def read(self, partition):
        if partition.path:
            names = [x.split()[0] for x in SCHEMA.split(", ")]
            schema = pa.schema([(n, pa.binary() if n == "payload" else pa.int64() if n in ("payload_bytes", "content_length") else pa.string()) for n in names])
            rows, size = [], 0
            for row in read_archive(self.path, partition.path, _Matches(self.allowed), self.payload, self.verify):
                rows.append(row)
                size += len(row["payload"] or b"") + 300
                if size >= 4 << 20:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)


def read_archive(root: str, path: str, wanted=lambda row: True, payload: bool = True, verify: bool = False):
    """Rows of one archive. Types and headers are tested before any of the block is read; a block that is not
    wanted is passed over in slices that are thrown away."""
    store, _ = open_store(root)
    with store.open_input_stream(path, compression="detect") as raw:
        stream = io.BufferedReader(raw, 1 << 20)
        while (head := read_headers(stream)) is not None:
            left = int(head["content-length"])
            row = {
                "record_id": head["warc-record-id"].strip("<>"), "warc_type": head["warc-type"], "target_uri": unquote(head["warc-target-uri"]) if "warc-target-uri" in head else None, "warc_date": head.get("warc-date"),
                "refers_to": head["warc-refers-to"].strip("<>") if "warc-refers-to" in head else None, "payload_digest": head.get("warc-payload-digest", "").removeprefix("sha1:") or None, "content_length": left, "payload_bytes": None, "payload": None,
            }
            if wanted(row | {"payload_bytes": None}) or "payload_bytes" in getattr(wanted, "allowed", ()):
                while left > 0 and (line := stream.readline()):
                    left -= len(line)
                    if line == CRLF:
                        break
                    if line[:15].lower() == b"content-length:":
                        row["payload_bytes"] = int(line[15:])
                if wanted(row):
                    if (payload or verify) and row["warc_type"] != "revisit":
                        body = stream.read(left)
                        left -= len(body)
                        if verify and base64.b32encode(hashlib.sha1(body).digest()).decode() != row["payload_digest"]:
                            raise ValueError(f"{row['record_id']} in {path}: the payload does not have the digest of its header")
                        row["payload"] = body if payload else None
                    yield row
            while left > 0 and (skipped := stream.read(min(left, 1 << 16))):
                left -= len(skipped)


class Written(WriterCommitMessage):
    def __init__(self, files: list[str]):
        self.files = files


class WarcWriter(DataSourceWriter):
    """Writes ``record_id, warc_type, target_uri, warc_date, refers_to, payload_digest, payload_bytes, payload``.

    A task writes archives of bounded size under names of the job and its own, each record a gzip member; the job's files of failed or
    repeated attempts are deleted at the commit, which knows the names that count. Archives of other writes stay, but in mode ``overwrite``.
    """

    def __init__(self, options: dict):
        self.path, self.most = options["path"], int(options.get("max_file_bytes", 256 << 20))
        self.job, self.fresh = uuid.uuid4().hex, options.get("fresh", "false") == "true"

    def write(self, iterator):
        import zlib

        store, path = open_store(self.path)
        store.create_dir(path, recursive=True)
        files, out, size = [], None, 0
        try:
            for row in iterator:
                if out is None or size > self.most:
                    if out is not None:
                        out.close()
                    files.append(f"{path}/part-{self.job}-{uuid.uuid4().hex}.warc.gz")
                    out, size = store.open_output_stream(files[-1], compression=None), 0
                raw = record_bytes(row.warc_type, row.record_id, row.target_uri, row.warc_date, row.payload_digest, row.payload_bytes, bytes(row.payload) if row.payload is not None else None, row.refers_to)
                packer = zlib.compressobj(1, zlib.DEFLATED, 31)
                member = packer.compress(raw) + packer.flush()
                out.write(member)
                size += len(member)
        finally:
            if out is not None:
                out.close()
        return Written(files)

    def commit(self, messages):
        store, path = open_store(self.path)
        counted = {f for m in messages if m for f in m.files}
        for f in store.get_file_info(pafs.FileSelector(path, allow_not_found=True)):
            mine = f.path.rpartition("/")[2].startswith(f"part-{self.job}-")
            if f.path not in counted and f.path.endswith(".warc.gz") and (mine or self.fresh):
                store.delete_file(f.path)

    def abort(self, messages):
        store, _ = open_store(self.path)
        for f in (f for m in messages if m for f in m.files):
            store.delete_file(f)


class WarcSource(DataSource):
    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(self.options)

    def writer(self, schema, overwrite):
        return WarcWriter(dict(self.options) | {"fresh": str(overwrite).lower()})


def read_warc(spark: SparkSession, path: str, where: dict[str, list] | None = None, payload: bool = True, verify: bool = False) -> DataFrame:
    """Records of the archives under ``path``. ``where`` maps header columns to allowed values; DataFrame filters
    on header columns reach the reader too, for which the session's ``spark.sql.python.filterPushdown.enabled`` is set."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").option("where", json.dumps(where or {})).option("payload", str(payload).lower()).option("verify", str(verify).lower()).load(path)


def page_records(pages: DataFrame, date: str = "1970-01-01T00:00:00Z", min_bytes: int = 0, key: str = "page_id", uri: str = "url", body: str = "html") -> DataFrame:
    """The records of a page table: of equal payloads of at least ``min_bytes`` bytes the row with the largest
    id is the response and the others revisit it."""
    rows = pages.select(F.col(key).cast("long").alias("id"), F.col(uri).cast("string").alias("target_uri"), F.coalesce(F.col(body), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.unhex(F.sha1("payload"))).withColumn("rank", -F.coalesce("id", F.lit(-(2**63 - 1))))
    found = salted_min(rows, "digest", "rank").withColumn("last", -F.col("_first"))
    revisit = (F.length("payload") >= min_bytes) & (F.col("rank") > F.col("_first"))
    urn = lambda c: F.concat(F.lit("urn:x-page:"), F.coalesce(c.cast("string"), F.lit("null")))
    return found.select(
        urn(F.col("id")).alias("record_id"), F.when(revisit, "revisit").otherwise("response").alias("warc_type"), "target_uri", F.lit(date).alias("warc_date"), F.when(revisit, urn(F.col("last"))).alias("refers_to"),
        base32(F.hex("digest"), 32).alias("payload_digest"), F.length("payload").cast("long").alias("payload_bytes"), F.when(~revisit, F.col("payload")).alias("payload"),
    )


def base32(hexed, chars: int):
    """Upper-case base32 of a hex string of 5 * chars / 4 digits, as a column."""
    five = lambda i: (5 * i) // 4 + 1, lambda i: (5 * i) % 4
    parts = []
    for i in range(chars):
        at, shift = five[0](i), five[1](i)
        two = F.conv(F.substring(hexed, at, 2), 16, 10).cast("int") if at < chars * 5 // 4 else F.conv(F.substring(hexed, at, 1), 16, 10).cast("int") * 16
        parts.append(F.substring(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"), F.shiftright(two, 3 - shift).bitwiseAND(31) + 1, F.lit(1)))
    return F.concat(*parts)


def write_warc(records: DataFrame, path: str, max_file_bytes: int = 256 << 20, mode: str = "append") -> None:
    """Adds archives to the folder, or replaces those that are there (mode ``overwrite``)."""
    records.sparkSession.dataSource.register(WarcSource)
    records.write.format("warc").option("max_file_bytes", max_file_bytes).mode(mode).save(path)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    write_warc(page_records(table(spark, sf_dir, "pages")), path)
    back = read_warc(spark, path, payload=False, verify=True).where(F.col("warc_type").isin("response", "revisit"))
    number = lambda c: F.substring(c, len("urn:x-page:") + 1, 30).try_cast("long")
    return back.select(number(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", F.col("warc_type").alias("record_type"), number(F.col("refers_to")).alias("refers_to"))


OP2_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, octet_length(encode(body)) AS payload_bytes, upper(sha1(body)) AS h FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS last FROM d),
b AS (SELECT *, array_to_string(list_transform(range(32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           1 + (((('0x' || substr(h || '0', ((5 * i) // 4 + 1)::INT, 2))::INT) >> (3 - (5 * i) % 4)::INT) & 31)::INT, 1)), '') AS b32 FROM m)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, b32 AS payload_digest,
       CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> last THEN last END AS refers_to FROM b
"""
