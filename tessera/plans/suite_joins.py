"""Registered queries: joins, co-grouping and set operations (§2.6)."""

from __future__ import annotations

from pyspark.sql import functions as F

import uuid

from tessera.operators import joins, layout, sets
from tessera.plans.oracle_sql import chunks_sql
from tessera.plans.registry import register
from tessera.sources.tables import load

#: Values of one row on each side: small enough that keys are split.
PER_CUSTOMER, PER_NATION = 4, 40


def _text(arr):
    """Sorted array → comma text (numbers sort numerically before joining)."""
    return F.array_join(F.transform(F.array_sort(arr), lambda x: x.cast("string")), ",")


@register("join_inner", oracle="""
SELECT o_orderkey, o_custkey, c_name, c_nationkey
FROM orders JOIN customer ON o_custkey IS NOT DISTINCT FROM c_custkey
""")
def join_inner(spark, sf_dir):
    o = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    c = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name", "c_nationkey")
    return joins.join(o, c, "o_custkey")


@register("join_bucketed", oracle="""
SELECT o_orderkey, o_custkey, c_name, c_nationkey
FROM orders JOIN customer ON o_custkey = c_custkey
""")
def join_bucketed(spark, sf_dir):
    # both sides written bucketed on the join key: the join itself needs no shuffle
    tag = uuid.uuid4().hex[:8]
    o = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    c = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name", "c_nationkey")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ob = layout.write_bucketed(o, f"orders_by_cust_{tag}", n, "o_custkey")
    cb = layout.write_bucketed(c, f"customer_by_key_{tag}", n, "o_custkey")
    return joins.join(ob, cb, "o_custkey", null_safe=False)


_NULL_KEYS = """
WITH a AS (SELECT o_orderkey, nullif(o_orderpriority, '5-LOW') AS k FROM orders),
     b AS (SELECT nullif(o_orderpriority, '5-LOW') AS k, count(*) AS n_orders FROM orders GROUP BY 1)
"""


@register("join_inner_null_keys", oracle=_NULL_KEYS + """
SELECT a.o_orderkey, a.k, b.n_orders FROM a JOIN b ON a.k IS NOT DISTINCT FROM b.k
""")
def join_inner_null_keys(spark, sf_dir):
    o = load(spark, sf_dir, "orders")
    k = F.nullif(F.col("o_orderpriority"), F.lit("5-LOW"))
    a = o.select("o_orderkey", k.alias("k"))
    b = o.groupBy(k.alias("k")).agg(F.count(F.lit(1)).alias("n_orders"))
    return joins.join(a, b, "k")


@register("join_left", oracle="""
SELECT d.doc_id, d.lang, l.quality, l.toxic
FROM documents d LEFT JOIN labels l ON d.doc_id IS NOT DISTINCT FROM l.doc_id
""")
def join_left(spark, sf_dir):
    d = load(spark, sf_dir, "documents").select("doc_id", "lang")
    lab = load(spark, sf_dir, "labels")
    return joins.join(d, lab, "doc_id", "left")


@register("join_right", oracle="""
SELECT d.doc_id, l.quality, d.lang
FROM labels l RIGHT JOIN documents d ON l.doc_id IS NOT DISTINCT FROM d.doc_id
""")
def join_right(spark, sf_dir):
    lab = load(spark, sf_dir, "labels").select("doc_id", "quality")
    d = load(spark, sf_dir, "documents").select("doc_id", "lang")
    return joins.join(lab, d, "doc_id", "right")


@register("join_full", oracle="""
SELECT coalesce(e.user_id, c.c_custkey) AS user_id, e.n, c.c_name
FROM (SELECT user_id, count(*) AS n FROM events GROUP BY user_id) e
FULL OUTER JOIN customer c ON e.user_id IS NOT DISTINCT FROM c.c_custkey
""")
def join_full(spark, sf_dir):
    e = load(spark, sf_dir, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    c = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), "c_name")
    return joins.join(e, c, "user_id", "full")


@register("join_cross", oracle="""
SELECT s_suppkey, r_regionkey, r_name FROM supplier CROSS JOIN region
""")
def join_cross(spark, sf_dir):
    s = load(spark, sf_dir, "supplier").select("s_suppkey")
    r = load(spark, sf_dir, "region")
    return joins.cartesian(s, r)


@register("join_cogroup", oracle=f"""
WITH t AS (
  SELECT o_custkey AS k, 0 AS tag, o_orderkey AS v FROM orders
  UNION ALL SELECT c_custkey, 1, CAST(c_nationkey AS BIGINT) FROM customer),
{chunks_sql('t', 'k', 'v', PER_CUSTOMER, 'tag')}
SELECT k, CAST(chunk AS BIGINT) AS chunk,
       count(*) FILTER (WHERE tag = 0) AS n_orders,
       count(*) FILTER (WHERE tag = 1) AS n_customers,
       coalesce(array_to_string(list_sort(list(v) FILTER (WHERE tag = 0)), ','), '') AS orders_text,
       coalesce(array_to_string(list_sort(list(v) FILTER (WHERE tag = 1)), ','), '') AS customers_text
FROM r GROUP BY k, chunk
""")
def join_cogroup(spark, sf_dir):
    o = load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("v"))
    c = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").cast("long").alias("v"))
    g = joins.cogroup([o, c], chunk_rows=PER_CUSTOMER)
    return g.select("k", F.col("chunk").cast("long").alias("chunk"),
                    F.size("values_0").cast("long").alias("n_orders"),
                    F.size("values_1").cast("long").alias("n_customers"),
                    _text("values_0").alias("orders_text"), _text("values_1").alias("customers_text"))


@register("join_cogroup_n", oracle=f"""
WITH t AS (
  SELECT CAST(c_nationkey AS BIGINT) AS k, 0 AS tag, c_custkey AS v FROM customer
  UNION ALL SELECT CAST(s_nationkey AS BIGINT), 1, s_suppkey FROM supplier
  UNION ALL SELECT CAST(n_nationkey AS BIGINT), 2, CAST(n_regionkey AS BIGINT) FROM nation
  UNION ALL SELECT CAST(r_regionkey AS BIGINT), 3, CAST(length(r_name) AS BIGINT) FROM region),
{chunks_sql('t', 'k', 'v', PER_NATION, 'tag')}
SELECT k, CAST(chunk AS BIGINT) AS chunk,
       count(*) FILTER (WHERE tag = 0) AS n0, count(*) FILTER (WHERE tag = 1) AS n1,
       count(*) FILTER (WHERE tag = 2) AS n2, count(*) FILTER (WHERE tag = 3) AS n3,
       CAST(coalesce(sum(v) FILTER (WHERE tag = 0), 0) AS BIGINT) AS s0,
       CAST(coalesce(sum(v) FILTER (WHERE tag = 1), 0) AS BIGINT) AS s1,
       coalesce(array_to_string(list_sort(list(v) FILTER (WHERE tag = 2)), ','), '') AS t2,
       coalesce(array_to_string(list_sort(list(v) FILTER (WHERE tag = 3)), ','), '') AS t3
FROM r GROUP BY k, chunk
""")
def join_cogroup_n(spark, sf_dir):
    def kv(t, k, v):
        return load(spark, sf_dir, t).select(F.col(k).cast("long").alias("k"), F.col(v).cast("long").alias("v"))

    r = load(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("k"),
                                             F.length("r_name").cast("long").alias("v"))
    g = joins.cogroup([kv("customer", "c_nationkey", "c_custkey"), kv("supplier", "s_nationkey", "s_suppkey"),
                       kv("nation", "n_nationkey", "n_regionkey"), r], chunk_rows=PER_NATION)

    def total(c):
        return F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)

    return g.select("k", F.col("chunk").cast("long").alias("chunk"),
                    *[F.size(f"values_{i}").cast("long").alias(f"n{i}") for i in range(4)],
                    total("values_0").alias("s0"), total("values_1").alias("s1"),
                    _text("values_2").alias("t2"), _text("values_3").alias("t3"))


@register("join_anti", oracle="""
SELECT doc_id, lang FROM documents d
WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id IS NOT DISTINCT FROM d.doc_id)
""")
def join_anti(spark, sf_dir):
    d = load(spark, sf_dir, "documents").select("doc_id", "lang")
    return joins.subtract_by_key(d, load(spark, sf_dir, "labels").select("doc_id"), "doc_id")


# ---------------------------------------------------------------- sets

@register("set_union_all", oracle="""
SELECT s_nationkey AS nationkey FROM supplier UNION ALL SELECT c_nationkey FROM customer
""")
def set_union_all(spark, sf_dir):
    s = load(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nationkey"))
    c = load(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nationkey"))
    return sets.union_all(s, c)


@register("set_intersect", oracle="""
SELECT user_id AS k FROM events INTERSECT SELECT o_custkey FROM orders
""")
def set_intersect(spark, sf_dir):
    a = load(spark, sf_dir, "events").select(F.col("user_id").alias("k"))
    b = load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"))
    return sets.intersection(a, b)


@register("set_subtract_bag", oracle="""
SELECT user_id AS k FROM events e
WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey IS NOT DISTINCT FROM e.user_id)
""")
def set_subtract_bag(spark, sf_dir):
    a = load(spark, sf_dir, "events").select(F.col("user_id").alias("k"))
    b = load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"))
    return sets.subtract(a, b)


@register("set_distinct", oracle="""
SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem
""")
def set_distinct(spark, sf_dir):
    li = load(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", "l_linenumber")
    return sets.distinct(li)
