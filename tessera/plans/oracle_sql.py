"""Reusable DuckDB SQL fragments for the oracle side.

These are written independently of the Spark code path: lines are really
split and tokens really exploded here, while the Spark side counts without
materialising them.
"""

# Lines of every document, text-file semantics (a final terminator does not
# open an empty line; an empty text has no line).
DOC_LINES = r"""
SELECT doc_id, unnest(string_split_regex(regexp_replace(text, '(\r\n|\r|\n)$', ''), '\r\n|\r|\n')) AS line
FROM documents WHERE text <> ''
"""


def unit_hash_sql(*parts: str, seed: int = 0) -> str:
    """DuckDB twin of ``tessera.functions.exprs.unit_hash``."""
    cat = " || '|' || ".join(f"CAST({p} AS VARCHAR)" for p in parts)
    return f"(('0x' || substr(md5({cat} || '|{seed}'), 1, 13))::BIGINT / 4503599627370496.0)"


def chunks_sql(table: str, k: str, v: str, chunk_rows: int, side: str | None = None) -> str:
    """CTEs ending in ``r``: the rows of ``table`` with their ``chunk`` (twin of ``chunked_groups``)."""
    by, r = f", {side}" if side else "", chunk_rows
    u = unit_hash_sql(f"coalesce(CAST({v} AS VARCHAR), '')", seed=29)
    return f"""j0 AS (SELECT *, row_number() OVER (PARTITION BY {k}{by}, {v}) - 1 AS j, count(*) OVER (PARTITION BY {k}{by}, {v}) AS m FROM {table}),
j1 AS (SELECT *, m - ((m - 1) // {r}) * {r} AS rest FROM j0),
n0 AS (SELECT {k}{by}, count(*) AS n FROM j1 WHERE j < rest GROUP BY {k}{by}),
n1 AS (SELECT {k} AS nk, CAST(ceil(max(n) / {r}.0) AS BIGINT) AS slices FROM n0 GROUP BY {k}),
s AS (SELECT j1.*, slices, CASE WHEN slices > 1 THEN CAST(floor({u} * slices) AS BIGINT) ELSE 0 END AS slice
      FROM j1 JOIN n1 ON {k} IS NOT DISTINCT FROM nk WHERE j < rest),
r AS (SELECT * EXCLUDE (slices, slice), slice + slices * ((row_number() OVER (PARTITION BY {k}, slice{by} ORDER BY {v} NULLS FIRST) - 1) // {r}) AS chunk FROM s
      UNION ALL SELECT *, -1 - (row_number() OVER (PARTITION BY {k} ORDER BY {(side + ", ") if side else ""}{v} NULLS FIRST, j) - 1) // {r} FROM j1 WHERE j >= rest)"""
