"""Exact de-duplication by a persistent digest index.

The index is a table of SHA-256 digests, bucketed by digest and sorted inside
each bucket. A batch of new rows is reduced to one row for each digest by
partial aggregation, sort-merge anti-joined with the index (the index side
needs no shuffle) and only its new digests are appended. Texts never move:
what is shuffled is a digest and a few numbers for each row.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import col, stored
from tessera.session import shared_dir

#: The letters that normalisation lower-cases.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalised(text: Column) -> Column:
    """A-Z lower-cased, all else as it is; null counts as empty."""
    t = F.coalesce(text, F.lit(""))
    plain = F.octet_length(t) == F.char_length(t)
    return F.when(plain, F.lower(t)).otherwise(F.translate(t, UPPER, LOWER))


class DigestIndex:
    """Digest index in a folder of the shared file system.

    ``path/index`` holds one row for each digest ever seen: digest and the
    row that stays (``keep``: id and row number, from the batch that brought
    the digest first). ``path/rows`` holds every row of every batch with its
    digest. ``path/done`` names the batches that are complete; it is written
    last, and whatever a broken ingest has left behind is never read.
    ``path/meta`` holds the number of buckets and the type of the ids: an index
    outlives its session, and opening it with others is refused.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None, id_type: str = "bigint"):
        self.spark = spark
        self.path = path or shared_dir(spark, "digests")
        kept = self._read("meta", "buckets int, id_type string").collect() if path else []
        if kept and (buckets not in (None, kept[0]["buckets"]) or id_type != kept[0]["id_type"]):
            raise ValueError(f"the index has {kept[0]['buckets']} buckets and ids of type {kept[0]['id_type']}, not {buckets} and {id_type}")
        self.buckets = kept[0]["buckets"] if kept else buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        if not kept:
            spark.createDataFrame([(self.buckets, id_type)], "buckets int, id_type string").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/meta")
        self.table = f"digest_index_{uuid.uuid4().hex}"
        self.rows_schema = f"id {id_type}, row_no bigint, batch string, digest binary"
        spark.sql(
            f"CREATE TABLE {self.table} (digest binary, keep struct<id: {id_type}, row_no: bigint>, batch string)"
            f" USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.path}/index'"
        )

    def close(self) -> None:
        """Forget the session's name for the index; its files stay, and frames made before go on."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")

    def _read(self, name: str, schema: str) -> DataFrame:
        """A part of the index; no rows where it hasn't been written yet."""
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def _complete(self, rows: DataFrame) -> DataFrame:
        """Those of complete batches; the list of them has a row for each call of ``ingest``."""
        return rows.join(F.broadcast(self._read("done", "batch string").distinct()), "batch", "left_semi")

    def ingest(self, batch: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> None:
        """Add a batch: record its rows, append the digests the index doesn't have.

        Inside a batch the row with the largest id stays (null ids come before
        all others, equal ids are told apart by the row number); against
        earlier batches the earlier row stays. A batch whose ingest broke at
        any point counts for nothing and is simply ingested again. One writer
        at a time.
        """
        name = uuid.uuid4().hex
        rows = batch.select(
            col(id_col).alias("id"),
            F.monotonically_increasing_id().alias("row_no"),
            F.lit(name).alias("batch"),
            F.unhex(F.sha2(F.encode(normalised(col(text_col)), "utf-8"), 256)).alias("digest"),
        )
        rows.write.parquet(f"{self.path}/rows/batch={name}")  # row numbers hold from here on
        here = self.spark.read.schema("id " + rows.schema["id"].dataType.simpleString() + ", row_no bigint, digest binary").parquet(f"{self.path}/rows/batch={name}")
        # Written before the join: else the optimizer joins all rows first and aggregates after.
        fresh = stored(here.groupBy("digest").agg(F.max(F.struct("id", "row_no")).alias("keep")), "digest-batch")
        known = self._complete(self.spark.table(self.table)).select("digest")
        self._append(fresh.join(known.hint("merge"), "digest", "left_anti").withColumn("batch", F.lit(name)))
        self.spark.createDataFrame([(name,)], "batch string").coalesce(1).write.mode("append").parquet(f"{self.path}/done")

    def _append(self, new: DataFrame) -> None:
        (
            new.repartition(self.buckets, "digest")
            .write.mode("append").format("parquet").bucketBy(self.buckets, "digest").sortBy("digest")
            .option("path", f"{self.path}/index").saveAsTable(self.table)
        )
        self.spark.catalog.refreshTable(self.table)

    def rows(self) -> DataFrame:
        return self._complete(self._read("rows", self.rows_schema)).select("id", "row_no", "batch", "digest")

    def classes(self) -> DataFrame:
        """(digest, keep, batch, group_size), one row for each digest."""
        sizes = self.rows().groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"))
        return self._complete(self.spark.table(self.table)).join(sizes, "digest")

    def report(self) -> DataFrame:
        """Every row ever ingested: id, keep_id, group_size, kept, text_sha256.

        The classes are written first, so that both sides of the join are
        shuffles and a digest that holds a large share of all rows is split
        there (adaptive skew join).
        """
        c = stored(self.classes().select("digest", "keep", F.col("batch").alias("kept_batch"), "group_size"), "classes")
        j = self.rows().join(c, "digest")
        return j.select(
            "id",
            F.col("keep.id").alias("keep_id"),
            "group_size",
            ((F.col("batch") == F.col("kept_batch")) & (F.col("row_no") == F.col("keep.row_no"))).alias("kept"),
            F.lower(F.hex("digest")).alias("text_sha256"),
        )


def exact_dedup(batches: list[DataFrame], id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """Classes of equal texts over all ``batches``, taken in turn into one index.

    One row for each row of each batch: id, keep_id (the row that stays),
    group_size, kept, text_sha256 (of the normalised text in UTF-8). Texts are
    equal when identical after lower-casing A-Z; a null text counts as empty,
    so null and empty texts are one class. Rows repeated with one id are told
    apart and one of them stays. With only null ids in a class, keep_id is
    null. Empty batches add nothing; other columns are ignored.
    """
    id_type = batches[0].select(col(id_col)).schema[0].dataType.simpleString()
    index = DigestIndex(batches[0].sparkSession, path, id_type=id_type)
    for batch in batches:
        index.ingest(batch, id_col, text_col)
    report = index.report()
    index.close()
    return report
