"""Registered queries of this package: each operator on its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, chat, decontamination, exact_dedup, langid, lexical_search, merkle, mixing, near_dedup, sharding, substring_dedup, token_counts, warc
from tessera.llm.common import stored
from tessera.sources.tables import load

SHARDS, TOKEN_LIMIT = 24, 1024


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards of equal row counts, read back from the shard files."""
    docs = load(spark, sf_dir, "documents")
    shards = sharding.write_shards(sharding.external_shuffle(docs, SHARDS))
    text = F.encode(F.coalesce("text", F.lit("")), "utf-8")
    return shards.select(
        "doc_id",
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def held_out(doc_id) -> F.Column:
    """Documents that language models never learn from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def language_model(docs: DataFrame) -> langid.LanguageId:
    return langid.fit(docs.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document; models learn from the rows not held out."""
    docs = load(spark, sf_dir, "documents")
    found = langid.identify(docs, language_model(docs))
    return found.select(F.col("id").alias("doc_id"), held_out(F.col("id")).alias("held_out"), "lang_pred", "score", "rejected")


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one that holds the template's own marks, folded from an event log."""
    turns = load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = f"{chat.END}{chat.START}assistant ok"
    probe = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.fold_events(chat.turns_to_events(turns.unionByName(probe))))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item that a document contains."""
    found = decontamination.contained_items(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))
    return found.withColumnRenamed("id", "doc_id")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document."""
    counts = token_counts.token_counts(load(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return counts.select(F.col("id").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near-duplicate documents."""
    classes = near_dedup.near_dup_classes(load(spark, sf_dir, "documents"))
    return classes.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "kept")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    d = mixing.plan_mix(load(spark, sf_dir, "documents")).decisions()
    return d.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op8_warc_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as WARC records, and which of them a damaged replica holds otherwise.

    The replica is written with one letter changed in the pages whose length
    is 7 more than a multiple of 101; the audit doesn't know which these are.
    """
    packed = warc.pack(load(spark, sf_dir, "pages"))
    manifest = stored(warc.manifest(packed), "warc-manifest")
    hit = F.col("length") % 101 == 7
    damaged = packed.withColumn("record", F.when(hit, F.regexp_replace("record", "</body>", "</bady>")).otherwise(F.col("record")))
    replica = stored(warc.read_archive(spark, warc.write_archive(damaged, partitions=warc.write_tasks(manifest))), "warc-replica")
    found = warc.audit_replica(manifest, replica)
    records = manifest.join(found, ["segment", "offset"], "left")
    return records.select("page_id", "segment", "offset", "length", "digest", F.coalesce("status", F.lit("intact")).alias("status"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of equal texts; the digest index takes the documents in two batches.

    The row with the largest id must stay and the index keeps what it has, so
    the batch with the larger ids comes first.
    """
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    ids = docs.agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).first()
    middle = ((ids["a"] or 0) + (ids["b"] or 0)) // 2
    later = F.coalesce(F.col("doc_id") > middle, F.lit(False))
    report = exact_dedup.exact_dedup([docs.where(later), docs.where(~later)])
    return report.withColumnRenamed("id", "doc_id")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that lose repeated sentence spans: what is left and who keeps the spans."""
    return substring_dedup.dedup_substrings(load(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best documents of every benchmark item."""
    top = lexical_search.top_documents(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"), k=50)
    return top.select(F.col("item").alias("item_id"), "rank", F.col("id").alias("doc_id"), "score")


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's proof in the manifest, and whether its copy in a tampered table still has the root.

    The copy has its letters A-Z lower-cased where the CRC-32 of the id is a
    multiple of 5.
    """
    docs = load(spark, sf_dir, "documents")
    fields = ["doc_id", "source", "lang", "n_chars"]
    text = F.col("text")
    lowered = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, exact_dedup.UPPER, exact_dedup.LOWER))
    touched = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    found = F.when(touched, merkle.record_digest([*map(F.col, fields), lowered]))
    records = docs.select("doc_id", "source", merkle.record_digest([*map(F.col, fields), text]).alias("leaf"), found.alias("found"))
    proved = merkle.manifest(records, "source", ["doc_id"], "leaf")
    steps = F.col("steps")
    checked = proved.select("doc_id", "leaf", "subroot", "root", F.sha2(merkle.siblings(steps), 256).alias("proof_sha256"), merkle.folded(F.coalesce("found", "leaf"), steps).alias("folded_root"))
    return checked.withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded by the tokenization automaton and decoded again."""
    path = public_tokenizers.path("word_bpe_49k.json")
    both = bpe.decode_ids(bpe.encode_texts(load(spark, sf_dir, "documents"), path), path)
    return both.select(
        F.col("id").alias("doc_id"),
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_sharding, op2_language_id, op3_chat_format, op4_decontamination, op5_token_counts, op6_near_dedup, op7_mixing, op8_warc_audit, op9_exact_dedup, op10_substring_dedup, op11_lexical_search, op12_merkle_manifest, op13_bpe)
}

def _merkle_level(name: str, below: str, tree: str) -> str:
    """A level of the manifest in SQL: ``r`` place, ``d`` digest, ``c`` nodes of the tree, siblings ``a`` and ``b``."""
    around = f"PARTITION BY {tree}, r // 16 ORDER BY r ROWS BETWEEN"
    return f"""{name} AS (
  SELECT *, coalesce(string_agg(d, '') OVER ({around} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS a,
         coalesce(string_agg(d, '') OVER ({around} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS b
  FROM ({below})
)"""


def _merkle_sql(levels: int = 6, crowns: int = 4) -> str:
    """Trees of up to 16 ** levels documents a source and 16 ** crowns sources; done trees go through unchanged."""
    record = "concat({})".format(", ".join(f"coalesce(strlen(CAST({{t}} AS VARCHAR)) || ':' || CAST({{t}} AS VARCHAR), '-')".format(t=t) for t in ("doc_id", "source", "lang", "n_chars", "{text}")))
    lower = f"translate(text, '{exact_dedup.UPPER}', '{exact_dedup.LOWER}')"
    byte = "list_reduce(list_prepend(xor(crc, x), [0, 0, 0, 0, 0, 0, 0, 0]), lambda y, i: CASE WHEN y & 1 = 1 THEN xor(y >> 1, 3988292384) ELSE y >> 1 END)"
    crc = f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda z: CAST(ascii(z) AS BIGINT))), lambda crc, x: {byte}), 4294967295)"
    ctes = [
        f"""leaves AS (
  SELECT doc_id, source, sha256({record.format(text="text")}) AS leaf,
         CASE WHEN {crc} % 5 = 0 THEN sha256({record.format(text=lower)}) END AS found,
         row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS r
  FROM documents
)""",
        _merkle_level("n0", "SELECT source, r, leaf AS d, count(*) OVER (PARTITION BY source) AS c FROM leaves", "source"),
    ]
    step = "SELECT {tree}, r // 16 AS r, CASE WHEN max(c) = 1 THEN min(d) ELSE sha256(string_agg(d, '' ORDER BY r)) END AS d, (max(c) + 15) // 16 AS c FROM {below} GROUP BY {tree}, r // 16"
    ctes += [_merkle_level(f"n{k}", step.format(tree="source", below=f"n{k - 1}"), "source") for k in range(1, levels + 1)]
    ctes.append(_merkle_level("m0", f"SELECT 1 AS one, source, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS r, d, count(*) OVER () AS c FROM n{levels}", "one"))
    ctes += [_merkle_level(f"m{k}", step.format(tree="one", below=f"m{k - 1}"), "one") for k in range(1, crowns + 1)]
    joins = [f"JOIN n{k} ON n{k}.source IS NOT DISTINCT FROM leaves.source AND n{k}.r = leaves.r // {16**k}" for k in range(levels)]
    joins.append("JOIN m0 ON m0.source IS NOT DISTINCT FROM leaves.source")
    joins += [f"JOIN m{k} ON m{k}.r = m0.r // {16**k}" for k in range(1, crowns)]
    nodes = [f"n{k}" for k in range(levels)] + [f"m{k}" for k in range(crowns)]
    folds = ["f0 AS (SELECT leaves.*, m0.d AS subroot, (SELECT d FROM m{}) AS root, coalesce(found, leaf) AS f, concat({}) AS proof, {} FROM leaves {})".format(
        crowns, ", ".join(f"{n}.a, {n}.b" for n in nodes), ", ".join(f"{n}.{x} AS {x}{i}" for i, n in enumerate(nodes) for x in "abc"), " ".join(joins))]
    folds += [f"f{i + 1} AS (SELECT * REPLACE (CASE WHEN c{i} = 1 THEN f ELSE sha256(a{i} || f || b{i}) END AS f) FROM f{i})" for i in range(len(nodes))]
    return "WITH " + ",\n".join(ctes + folds) + f"\nSELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, f AS folded_root, f = root AS verified FROM f{len(nodes)}"


#: DuckDB twins. The others have none: hashing with a seed, models, tokenizers,
#: folds and component search are tested against brute force in tests/llm.
ORACLE: dict[str, str] = {
    "op9_exact_dedup": """
WITH n AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents
), g AS (
  SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY text_sha256
)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, n.text_sha256
FROM n JOIN g USING (text_sha256)
""",
    "op11_lexical_search": r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents
), q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark
), size AS (
  SELECT doc_id, CAST(len(terms) AS BIGINT) AS n FROM d WHERE len(terms) > 0
), total AS (
  SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS words FROM size
), found AS (
  SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(terms) AS term FROM d) GROUP BY ALL
), weight AS (
  SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM found, total GROUP BY term, docs
), score AS (
  SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // words)))) AS BIGINT) AS score
  FROM q JOIN found USING (term) JOIN weight USING (term) JOIN size USING (doc_id), total GROUP BY item_id, doc_id
), ranked AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM score WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50
""",
    "op12_merkle_manifest": _merkle_sql(),
}
