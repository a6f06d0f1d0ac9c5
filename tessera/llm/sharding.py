"""Sharding by a two-pass external shuffle.

Pass one scatters records uniformly into buckets that fit in a task's memory,
by a seeded hash of the whole record; equal records that together are larger
than a bucket are numbered, and the number takes part in the hash. Pass two shuffles each bucket by
Fisher-Yates with a seed of its own. Bucket after bucket that is one random
order of all records, which is cut into shards of equal row counts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import col, numbered, others, stored
from tessera.session import shared_dir

BUCKET_BYTES = 8 << 20
#: Buckets whose starts one task adds up, and copies of a record that one task counts.
GROUP_BUCKETS, CHUNK_COPIES = 4096, 1_000_000


def fisher_yates(n: int, seed: list[int]) -> np.ndarray:
    """A uniform permutation of ``n`` places (numpy shuffles by Fisher-Yates)."""
    places = np.arange(n)
    np.random.default_rng(seed).shuffle(places)
    return places


def external_shuffle(docs: DataFrame, shards: int, seed: int = 11, text_col: str = "text", bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Columns of ``docs`` with ``shard`` (0 to shards - 1) and ``slot`` (gapless from 0).

    Row counts of shards are at most one apart. The order depends on the seed
    and the records' values alone, not on partitions, so a lost task repeats
    it. Nulls take part in the hash as nothing. Records equal in all columns are
    interchangeable: few share a bucket, many are spread over all of them. A
    record longer than ``bucket_bytes`` is a bucket's content alone or with few
    others. An empty table gives no rows. An input column named shard or slot is
    replaced.
    """
    if shards < 1:
        raise ValueError("at least one shard is needed")
    names = others(docs, ["shard", "slot"])
    records = docs.select(*[col(c) for c in names])
    simple = [col(f.name) for f in records.schema if not isinstance(f.dataType, T.MapType)]
    size = F.coalesce(F.octet_length(col(text_col)), F.lit(0)) + 64
    packed = records.select(F.struct(*[col(c) for c in names]).alias("row"), F.xxhash64(F.lit(seed), *simple).alias("h"), size.alias("bytes"))
    counts = stored(packed.groupBy("h").agg(F.count(F.lit(1)).alias("rows"), F.sum("bytes").alias("bytes")), "record-counts")
    total = counts.agg(F.sum("rows").alias("n"), F.sum("bytes").alias("b")).first()
    n, buckets = total["n"] or 0, max(1, -(-(total["b"] or 0) // bucket_bytes))

    plain, spread = F.pmod("h", F.lit(buckets)), F.pmod(F.xxhash64(F.lit(seed), "h", F.col("no").cast("long")), F.lit(buckets))
    many = (F.col("rows") > 1) & (F.col("bytes") > bucket_bytes)
    rows = counts.where(~many).select(plain.alias("bucket"), "rows")
    heavy = counts.where(many).select("h", "rows")
    if heavy.isEmpty():
        packed = packed.select("row", "h", plain.alias("bucket"))
    else:
        chunks = heavy.select("h", "rows", F.explode(F.sequence(F.lit(0), F.col("rows") - 1, F.lit(CHUNK_COPIES))).alias("first")).repartition("h", "first")
        copies = chunks.select("h", F.explode(F.sequence("first", F.least(F.col("first") + CHUNK_COPIES, F.col("rows")) - 1)).alias("no"))
        rows = rows.unionByName(copies.select(spread.alias("bucket"), F.lit(1).cast("long").alias("rows")))
        marked = packed.drop("bytes").withColumn("part", F.spark_partition_id()).join(heavy.select("h", F.lit(True).alias("heavy")), "h", "left")
        dealt = numbered(stored(marked.where("heavy"), "heavy-records"), "h", "no")
        packed = marked.where("heavy IS NULL").select("row", "h", plain.alias("bucket")).unionByName(dealt.select("row", "h", spread.alias("bucket")))
    sizes = stored(rows.groupBy("bucket").agg(F.sum("rows").alias("rows")).withColumn("group", F.floor(F.col("bucket") / GROUP_BUCKETS)), "bucket-sizes")
    upto, before = Window.unboundedPreceding, -1
    groups = sizes.groupBy("group").agg(F.sum("rows").alias("in_group"))
    groups = groups.select("group", F.coalesce(F.sum("in_group").over(Window.orderBy("group").rowsBetween(upto, before)), F.lit(0)).alias("group_start"))
    inside = F.coalesce(F.sum("rows").over(Window.partitionBy("group").orderBy("bucket").rowsBetween(upto, before)), F.lit(0))
    starts = sizes.withColumn("inside", inside).join(groups, "group").select("bucket", (F.col("group_start") + F.col("inside")).alias("start"))

    def second_pass(key: tuple[pa.Scalar, ...], rows: pa.Table, start: pa.Table) -> pa.Table:
        order = np.argsort(rows.column("h").to_numpy(), kind="stable")
        order = order[fisher_yates(len(order), [seed, key[0].as_py()])]
        place = start.column("start")[0].as_py() + np.arange(len(order), dtype=object)
        shard = [p * shards // n for p in place]
        slot = [p - -(-s * n // shards) for p, s in zip(place, shard, strict=True)]
        return pa.table({"row": rows.column("row").take(pa.array(order)), "shard": pa.array(shard, pa.int32()), "slot": pa.array(slot, pa.int64())})

    schema = T.StructType([T.StructField("row", packed.schema["row"].dataType), T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType())])
    out = packed.groupBy("bucket").cogroup(starts.groupBy("bucket")).applyInArrow(second_pass, schema)
    return out.select("row.*", "shard", "slot")


def write_shards(sharded: DataFrame, path: str | None = None) -> DataFrame:
    """Write a folder for each shard, rows in slot order inside each file; read them back."""
    path = path or shared_dir(sharded.sparkSession, "shards")
    sharded.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    return sharded.sparkSession.read.schema(sharded.schema).parquet(path)
