"""WARC archives with a Merkle fixity audit.

Pages become WARC records, packed into segments (one file each) in a fixed
order, so every record has a segment, an offset and a digest. A tree over an
archive hashes the records of each offset range, then ranges of ranges up to a
single root. Two replicas are compared from the root down: only children of
nodes that differ are compared, until the damaged ranges, and in them the
damaged records, are found.
"""

from __future__ import annotations

import gzip
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import col, stored
from tessera.session import shared_dir

SEGMENT_BYTES = 16 << 20
RANGE_BYTES = 64 << 10
#: Tasks that one archive is written by, at most; each sorts its segments externally.
MOST_TASKS = 100_000
FANOUT = 16
#: Fixed values of the format: record version, line end, end of a record.
VERSION, LINE, RECORD_END = "WARC/1.0", "\r\n", "\r\n\r\n"
_LENGTH = re.compile(rb"\r\nContent-Length: (\d+)\r\n")
_ID = re.compile(rb"\r\nWARC-Record-ID: <urn:page:([^>]*)>\r\n")


def _header_value(value: Column) -> Column:
    return F.regexp_replace(F.coalesce(value.cast("string"), F.lit("")), r"[\r\n]", " ")


def warc_record(page_id: Column, url: Column, html: Column) -> Column:
    """A resource record as text; null fields count as empty."""
    body = F.coalesce(html, F.lit(""))
    lines = [
        F.lit(VERSION),
        F.lit("WARC-Type: resource"),
        F.concat(F.lit("WARC-Record-ID: <urn:page:"), _header_value(page_id), F.lit(">")),
        F.concat(F.lit("WARC-Target-URI: "), _header_value(url)),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.sha2(body, 256)),
        F.lit("Content-Type: text/html; charset=utf-8"),
        F.concat(F.lit("Content-Length: "), F.octet_length(body).cast("string")),
    ]
    return F.concat(F.concat_ws(LINE, *lines), F.lit(RECORD_END), body)


def pack(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """(page_id, segment, place, length, digest, record): pages dealt to segments.

    A hash of the whole page gives the segment and the place in it; records of
    equal pages lie next to each other. Null ids, urls and texts are empty
    header fields or bodies. Other columns are ignored; an empty table gives
    no segments.
    """
    rows = pages.select(col(id_col).alias("page_id"), warc_record(col(id_col), col(url_col), col(html_col)).alias("record"))
    total = rows.agg(F.sum(F.octet_length("record") + len(RECORD_END))).first()[0] or 0
    segments = max(1, -(-total // segment_bytes))
    rows = rows.withColumns({"length": F.octet_length("record").cast("long"), "digest": F.sha2("record", 256), "place": F.xxhash64("record")})
    return rows.withColumn("segment", F.pmod("place", F.lit(segments)).cast("int")).select("page_id", "segment", "place", "length", "digest", "record")


def manifest(packed: DataFrame) -> DataFrame:
    """(page_id, segment, offset, length, digest) of every record: running sums
    over narrow rows, in the order in which ``write_archive`` writes them."""
    order = Window.partitionBy("segment").orderBy("place", "page_id", "digest").rowsBetween(Window.unboundedPreceding, 0)
    size = F.col("length") + len(RECORD_END)
    narrow = packed.drop("record").withColumn("offset", F.sum(size).over(order) - size)
    return narrow.select("page_id", "segment", "offset", "length", "digest")


def write_tasks(manifest: DataFrame) -> int:
    """Tasks for ``write_archive``: as many as segments, up to ``MOST_TASKS``, which then take several each."""
    segments = (manifest.agg(F.max("segment")).first()[0] or 0) + 1
    return max(int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(segments, MOST_TASKS))


def write_archive(packed: DataFrame, path: str | None = None, partitions: int | None = None) -> str:
    """Write each segment as one gzip-compressed WARC file; returns the folder.

    Offsets count in the uncompressed file. Records are shuffled once, into
    ``partitions`` tasks (see ``write_tasks``; default: the session's).
    """
    path = path or shared_dir(packed.sparkSession, "warc")
    rows = packed.repartition(*([] if partitions is None else [partitions]), "segment").sortWithinPartitions("segment", "place", "page_id", "digest")
    rows.select("segment", "record").write.partitionBy("segment").option("lineSep", RECORD_END).option("compression", "gzip").text(path)
    return path


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """(segment, offset, length, digest, page_id) of the records that the files hold.

    A record ends where its Content-Length says. Where no header can be read,
    the bytes up to the next record are one record without an id.
    """

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for segment, data in zip(b.column("segment").to_pylist(), b.column("content").to_pylist(), strict=True):
                data = gzip.decompress(data)
                rows = [(segment, at, stop - at, hashlib.sha256(data[at:stop]).hexdigest(), page) for at, stop, page in _records(data)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [[]] * 5, (pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)], ["segment", "offset", "length", "digest", "page_id"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    if "segment" not in files.columns:  # an empty archive has no segment folders
        files = files.withColumn("segment", F.lit(0))
    return files.select(F.col("segment").cast("int").alias("segment"), "content").mapInArrow(parse, "segment int, offset long, length long, digest string, page_id string")


def _records(data: bytes) -> Iterator[tuple[int, int, str | None]]:
    """(start, end, page id) of each record of a file."""
    head, end = VERSION.encode(), RECORD_END.encode()
    at = 0
    while at < len(data):
        close = data.find(end, at)
        header = data[at : close + 2] if close >= 0 else b""
        size, page = _LENGTH.search(header), _ID.search(header)
        stop = close + len(end) + int(size[1]) if size else -1
        if not header.startswith(head) or stop < 0 or data[stop : stop + len(end)] != end:
            following = data.find(end + head, at)
            stop, page = (following if following >= 0 else max(at, len(data) - len(end))), None
        yield at, stop, page[1].decode(errors="replace") if page else None
        at = stop + len(end)


@dataclass
class MerkleTree:
    """``levels[0]`` hashes offset ranges, each further level ``FANOUT`` nodes of the one below."""

    leaves: DataFrame
    levels: list[DataFrame]

    def root(self) -> str | None:
        row = self.levels[-1].first()
        return row["hash"] if row else None


def _node_hash(parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.sort_array(F.collect_list(parts)).getField("entry")), 256)


def height(manifests: list[DataFrame], range_bytes: int = RANGE_BYTES, fanout: int = FANOUT) -> tuple[int, int]:
    """(ranges kept for each segment, a power of the fanout; levels) that fit all replicas."""
    most, last = 0, 0
    for m in manifests:
        row = m.agg(F.max("offset").alias("o"), F.max("segment").alias("s")).first()
        most, last = max(most, row["o"] or 0), max(last, row["s"] or 0)
    per_segment, levels = 1, 1
    while per_segment * range_bytes <= most:
        per_segment *= fanout
    top = per_segment * (last + 1)
    while top > 1:
        top, levels = -(-top // fanout), levels + 1
    return per_segment, levels


def merkle_tree(manifest: DataFrame, per_segment: int, levels: int, range_bytes: int = RANGE_BYTES, fanout: int = FANOUT) -> MerkleTree:
    """The tree of a replica from its records (segment, offset, length, digest).

    A node hashes its children in order, with their places. Groups are bounded:
    a range's records, or ``fanout`` nodes. Each level is written before the
    next, so the records are read once.
    """
    leaves = manifest.select("segment", "offset", "length", "digest").withColumn("node", F.col("segment").cast("long") * per_segment + F.floor(F.col("offset") / range_bytes))
    entry = F.concat_ws(":", F.col("offset").cast("string"), F.col("length").cast("string"), "digest")
    nodes = stored(leaves.groupBy("node").agg(_node_hash(F.struct("offset", "length", entry.alias("entry"))).alias("hash")), "merkle")
    out = [nodes]
    for _ in range(levels - 1):
        entry = F.concat_ws(":", F.col("node").cast("string"), "hash")
        parent = F.floor(F.col("node") / fanout).alias("node")
        nodes = stored(nodes.groupBy(parent).agg(_node_hash(F.struct("node", entry.alias("entry"))).alias("hash")), "merkle")
        out.append(nodes)
    return MerkleTree(leaves, out)


def audit(a: MerkleTree, b: MerkleTree, fanout: int = FANOUT) -> DataFrame:
    """(segment, offset, status) of the records in which replica ``b`` differs from ``a``.

    status: ``corrupt`` (other bytes at the same offset), ``missing`` or
    ``extra``. Equal roots end the audit at once; otherwise a level's
    comparison is restricted to children of differing nodes.
    """
    spark = a.leaves.sparkSession
    if a.root() == b.root():
        return spark.createDataFrame([], "segment int, offset long, status string")
    suspects = None
    for x, y in zip(reversed(a.levels), reversed(b.levels), strict=True):
        x, y = x.withColumnRenamed("hash", "hash_a"), y.withColumnRenamed("hash", "hash_b")
        if suspects is not None:
            parents = suspects.withColumnRenamed("node", "parent")
            x = x.withColumn("parent", F.floor(F.col("node") / fanout)).join(parents, "parent", "left_semi").drop("parent")
            y = y.withColumn("parent", F.floor(F.col("node") / fanout)).join(parents, "parent", "left_semi").drop("parent")
        differ = x.join(y, "node", "full").where(~F.col("hash_a").eqNullSafe(F.col("hash_b")))
        suspects = stored(differ.select("node"), "suspects")
    side = lambda t, d: t.leaves.join(suspects, "node", "left_semi").select("segment", "offset", F.concat_ws(":", F.col("length").cast("string"), "digest").alias(d))
    records = side(a, "da").join(side(b, "db"), ["segment", "offset"], "full").where(~F.col("da").eqNullSafe(F.col("db")))
    status = F.when(F.col("db").isNull(), "missing").when(F.col("da").isNull(), "extra").otherwise("corrupt")
    return records.select(F.col("segment").cast("int").alias("segment"), "offset", status.alias("status"))


def audit_replica(manifest: DataFrame, replica: DataFrame, range_bytes: int = RANGE_BYTES, fanout: int = FANOUT) -> DataFrame:
    """Audit of a replica's records against a manifest (see ``audit``)."""
    per_segment, levels = height([manifest, replica], range_bytes, fanout)
    trees = [merkle_tree(m, per_segment, levels, range_bytes, fanout) for m in (manifest, replica)]
    return audit(*trees, fanout)
