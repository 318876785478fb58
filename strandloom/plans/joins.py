"""Joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandloom.functions import seq
from strandloom.operators import diagnostics
from strandloom.operators import relational as rel
from strandloom.plans.registry import query
from strandloom.session import table

EPOCH = "floor(epoch(ts))::BIGINT"


@query(
    "q_interval_join",
    """
    WITH w AS (SELECT o_orderkey AS id, o_orderkey AS s, o_orderkey + (o_custkey % 40) AS e FROM orders)
    SELECT w.id, count(*)::BIGINT AS n, min(l_orderkey) AS lo, max(l_orderkey) AS hi FROM w JOIN lineitem ON l_orderkey BETWEEN s AND e GROUP BY w.id""",
)
def interval_join(spark, sf_dir):
    w = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("s"), (F.col("o_orderkey") + F.col("o_custkey") % 40).alias("e"), F.lit(0).alias("chrom"))
    l = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("p"), F.lit(0).alias("chrom"))
    l = l.groupBy("chrom", "p").agg(F.count("*").alias("c")).withColumn("q", F.col("p"))
    return rel.interval_join(w, l, ["chrom"], ("s", "e"), ("p", "q")).groupBy("id").agg(F.sum("c").alias("n"), F.min("p").alias("lo"), F.max("p").alias("hi"))


TEXTS = "t AS (SELECT p_name AS s, min(p_partkey) AS rep, count(*)::BIGINT AS copies FROM part WHERE p_name IS NOT NULL GROUP BY p_name)"


@query(
    "q_near_duplicates",
    """
    SELECT a.p_partkey AS a, b.p_partkey AS b, hamming(a.p_name, b.p_name)::INTEGER AS mismatches
    FROM part a JOIN part b ON length(a.p_name) = length(b.p_name) AND a.p_partkey < b.p_partkey AND hamming(a.p_name, CASE WHEN length(a.p_name) = length(b.p_name) THEN b.p_name ELSE a.p_name END) <= 2""",
)
def near_duplicates(spark, sf_dir):
    """Pairs of all parts with names that differ in two places at most, equal names included."""
    return rel.rows_within_mismatches(table(spark, sf_dir, "part"), "p_partkey", "p_name", 2)


@query("q_name_members", f"WITH {TEXTS} SELECT p_partkey, rep, copies FROM part JOIN t ON p_name = s")
def name_members(spark, sf_dir):
    """Every row with the representative of its name, and how many rows have that name."""
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", F.col("p_name").alias("s")).join(rel.distinct_texts(p, "p_partkey", "p_name"), "s").select("p_partkey", "rep", "copies")


# A long interval for each nation beside the short ones of orders.
SPANS_OF_ALL = """
    SELECT o_custkey % 5 AS chrom, o_orderkey AS id, o_orderkey * 3 AS s, o_orderkey * 3 + o_custkey % 90 AS e FROM orders
    UNION ALL SELECT n_nationkey % 5, -1 - n_nationkey, n_nationkey * 1000, n_nationkey * 1000 + 100000000 FROM nation"""


@query(
    "q_interval_levels",
    f"""
    WITH w AS ({SPANS_OF_ALL}), v AS (SELECT l_partkey % 5 AS chrom, l_orderkey * 3 - l_linenumber AS p, l_orderkey * 3 + l_suppkey % 300 AS q, count(*) AS c FROM lineitem GROUP BY ALL)
    SELECT w.id, sum(c)::BIGINT AS n, min(p) AS lo, max(q) AS hi FROM w JOIN v ON w.chrom = v.chrom AND s <= q AND p <= e GROUP BY w.id""",
)
def interval_levels(spark, sf_dir):
    """Short and very long intervals in one join, whose pairs are counted, not made."""
    for t in ("orders", "nation"):
        table(spark, sf_dir, t).createOrReplaceTempView(f"levels_{t}")
    w = spark.sql(SPANS_OF_ALL.replace("FROM orders", "FROM levels_orders").replace("FROM nation", "FROM levels_nation"))
    v = table(spark, sf_dir, "lineitem").selectExpr("l_partkey % 5 AS chrom", "l_orderkey * 3 - l_linenumber AS p", "l_orderkey * 3 + l_suppkey % 300 AS q")
    return rel.overlap_totals(w, v, ["chrom"], ("s", "e"), ("p", "q"), "id")


# Alleles by a number: SNV, INS, DEL, MNP, CPX, and an MNP that holds the SNV in its middle.
ALLELES = [
    "CASE {0} WHEN 0 THEN 'C' WHEN 1 THEN 'A' WHEN 2 THEN concat('A', repeat('C', {1})) WHEN 3 THEN 'CT' WHEN 4 THEN 'ACC' ELSE 'TCT' END AS ref",
    "CASE {0} WHEN 0 THEN 'G' WHEN 1 THEN concat('A', repeat('G', {1})) WHEN 2 THEN 'A' WHEN 3 THEN 'GA' WHEN 4 THEN 'GTGTT' ELSE 'AGA' END AS alt",
]
KINDS = """CASE {0} WHEN 0 THEN 'SNV' WHEN 1 THEN 'INS' WHEN 2 THEN 'DEL' WHEN 4 THEN 'CPX' ELSE 'MNP' END AS kind,
    CASE {0} WHEN 0 THEN 1 WHEN 1 THEN {1} WHEN 2 THEN -{1} WHEN 3 THEN 2 WHEN 4 THEN 2 ELSE 3 END AS size"""
OF_PART, OF_LINE = ("p_partkey % 5", "CAST(1 + p_size % 6 AS INT)"), ("(l_suppkey + l_linenumber) % 6", "CAST(l_linenumber AS INT)")
TRUTH = ["p_partkey AS truth_id", "p_size % 5 AS chrom", "p_partkey * 40 AS pos", *(x.format(*OF_PART) for x in ALLELES)]
CALLS = ["l_orderkey * 10 + l_linenumber AS call_id", "l_linenumber % 5 AS chrom", "l_partkey * 40 + (l_suppkey % 11 - 5) * (l_linenumber - 1) AS pos", *(x.format(*OF_LINE) for x in ALLELES)]


@query(
    "q_tiered_match",
    f"""
    WITH t AS (SELECT {', '.join(TRUTH)}, {KINDS.format(*OF_PART)} FROM part), c AS (SELECT {', '.join(CALLS)}, {KINDS.format(*OF_LINE)} FROM lineitem),
    j AS (SELECT t.truth_id, c.call_id, c.pos AS cpos, CASE
        WHEN t.pos = c.pos AND t.ref = c.ref AND t.alt = c.alt THEN 0
        WHEN t.kind = 'SNV' AND c.kind = 'MNP' AND t.pos - c.pos BETWEEN 0 AND length(c.ref) - 1 AND substr(c.ref, (t.pos - c.pos + 1)::INT, 1) = t.ref AND substr(c.alt, (t.pos - c.pos + 1)::INT, 1) = t.alt THEN 1
        WHEN t.kind IN ('SNV', 'MNP') THEN NULL
        WHEN t.kind = c.kind AND t.pos = c.pos AND abs(abs(c.size) - abs(t.size)) <= least(100, greatest(3, floor(abs(t.size) * 0.2))) THEN 2
        WHEN t.kind = c.kind AND abs(t.pos - c.pos) <= 5 AND abs(abs(c.size) - abs(t.size)) <= least(100, greatest(3, floor(abs(t.size) * 0.5))) THEN 3
        WHEN t.kind = c.kind AND abs(abs(c.size) - abs(t.size)) <= least(100, greatest(3, floor(abs(t.size) * 0.5))) THEN 4 END AS lv
        FROM t JOIN c ON t.chrom = c.chrom AND abs(t.pos - c.pos) <= 50),
    b AS (SELECT truth_id, lv, call_id, row_number() OVER (PARTITION BY truth_id ORDER BY lv, cpos, call_id) AS r FROM j WHERE lv IS NOT NULL)
    SELECT t.truth_id, CASE b.lv WHEN 0 THEN 'L0' WHEN 1 THEN 'LD' WHEN 2 THEN 'L1' WHEN 3 THEN 'L2' WHEN 4 THEN 'L3' ELSE 'MISS' END AS level, b.call_id
    FROM t LEFT JOIN b ON t.truth_id = b.truth_id AND r = 1""",
)
def tiered_match(spark, sf_dir):
    typed = lambda d: d.withColumn("kind", seq.classify(F.col("ref"), F.col("alt"))).withColumn("size", seq.variant_length(F.col("ref"), F.col("alt")))
    t = table(spark, sf_dir, "part").selectExpr(*TRUTH)
    c = table(spark, sf_dir, "lineitem").selectExpr(*CALLS)
    return rel.tiered_match(typed(t), typed(c))


@query("q_unmatched", "SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity >= 45)")
def unmatched(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").filter("l_quantity >= 45").select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, sf_dir, "part").select("p_partkey").join(l, "p_partkey", "left_anti")


@query(
    "q_full_outer_delta",
    """
    WITH a AS (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_orderdate < DATE '1998-01-01' GROUP BY 1), b AS (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_orderdate >= DATE '1998-01-01' GROUP BY 1)
    SELECT coalesce(a.k, b.k) AS k, coalesce(a.n, 0)::BIGINT AS base, coalesce(b.n, 0)::BIGINT AS new, (coalesce(b.n, 0) - coalesce(a.n, 0))::BIGINT AS delta,
        CASE WHEN a.k IS NULL THEN 'NEW' WHEN b.k IS NULL THEN 'GONE' WHEN b.n > a.n THEN 'UP' WHEN b.n < a.n THEN 'DOWN' ELSE 'SAME' END AS status
    FROM a FULL JOIN b ON a.k = b.k""",
)
def full_outer_delta(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), "o_orderdate")
    side = lambda c, n: o.filter(c).groupBy("k").agg(F.count("*").alias(n))
    j = side("o_orderdate < '1998-01-01'", "a").join(side("o_orderdate >= '1998-01-01'", "b"), "k", "full_outer")
    z = lambda c: F.coalesce(c, F.lit(0))
    status = F.when(F.col("a").isNull(), "NEW").when(F.col("b").isNull(), "GONE").when(F.col("b") > F.col("a"), "UP").when(F.col("b") < F.col("a"), "DOWN").otherwise("SAME")
    return j.select("k", z("a").alias("base"), z("b").alias("new"), (z("b") - z("a")).alias("delta"), status.alias("status"))


SPANS = f"SELECT user_id, event_id AS id, {EPOCH} AS s, {EPOCH} + 40000 AS e FROM events WHERE event_type = 'click'"


@query(
    "q_asof_containment",
    f"""
    WITH s AS ({SPANS}), p AS (SELECT user_id, event_id, {EPOCH} AS t FROM events WHERE event_type <> 'click'),
    j AS (SELECT p.event_id, p.t, arg_max({{'id': s.id, 'e': s.e}}, {{'s': s.s, 'id': s.id}}) AS m FROM p LEFT JOIN s ON p.user_id = s.user_id AND s.s <= p.t GROUP BY ALL)
    SELECT event_id, CASE WHEN m.e >= t THEN m.id END AS span_id FROM j""",
)
def asof_containment(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("t", F.unix_timestamp("ts"))
    spans = e.filter("event_type = 'click'").select("user_id", F.col("event_id").alias("id"), F.col("t").alias("s"), (F.col("t") + 40000).alias("e"))
    points = e.filter("event_type <> 'click'").select("user_id", "event_id", "t")
    return rel.asof_containment(points, "t", spans, ["user_id"], "s", "e", "id").select("event_id", "span_id")


STATUSES = list(diagnostics.WINDOW_STAGES)


@query(
    "q_top1_window",
    f"""
    WITH e AS (SELECT event_id, user_id % 7 AS chrom, {EPOCH} AS s FROM events), h AS (SELECT *, unnest(range(((s - 1000 + 799) // 800)::BIGINT, (s // 800 + 1)::BIGINT)) AS w FROM e),
    k AS (SELECT event_id, ((w * 37 + chrom) % 6)::INT AS p, least(s - w * 800, w * 800 + 1000 - s) AS c FROM h),
    r AS (SELECT event_id, {STATUSES!r}[p + 1] AS status, row_number() OVER (PARTITION BY event_id ORDER BY p DESC, c DESC) AS r FROM k)
    SELECT event_id, status AS win_status FROM r WHERE r = 1""",
)
def top1_window(spark, sf_dir):
    """Of the windows that hold a point the one of the most telling status, then the one that centres it best."""
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("probe_id"), F.expr("user_id % 7").alias("chrom"), F.unix_timestamp("ts").alias("pos"))
    w = rel.point_in_window(e, "pos", 1000, 800).select("chrom", "window_id").distinct()
    status = F.element_at(F.array(*map(F.lit, STATUSES)), F.expr("int((window_id * 37 + chrom) % 6) + 1"))
    w = w.select("chrom", (F.col("window_id") * 800).alias("win_start"), (F.col("window_id") * 800 + 1000).alias("win_end"), status.alias("win_status"))
    return diagnostics.windows_of(e, w).select(F.col("probe_id").alias("event_id"), "win_status")


@query(
    "q_keep_max",
    """
    SELECT o_custkey, o_orderstatus, arg_max(o_orderkey, {'p': o_totalprice, 'k': o_orderkey}) AS o_orderkey, max(o_totalprice) AS o_totalprice FROM orders GROUP BY ALL""",
)
def keep_max(spark, sf_dir):
    return rel.keep_max(table(spark, sf_dir, "orders"), ["o_custkey", "o_orderstatus"], ["o_totalprice", "o_orderkey"], ["o_orderkey", "o_totalprice"])


@query(
    "q_attribution_join",
    """
    WITH a AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 40 THEN 'not_processed' WHEN l_quantity > 20 THEN 'no_path' ELSE 'survived' END AS stage FROM lineitem),
    r AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'not_processed:low_coverage' WHEN 'O' THEN 'not_processed:inactive' END AS sub FROM orders)
    SELECT CASE WHEN stage = 'not_processed' THEN coalesce(sub, stage) ELSE stage END AS stage, count(*)::BIGINT AS n FROM a LEFT JOIN r ON l_orderkey = o_orderkey GROUP BY 1""",
)
def attribution_join(spark, sf_dir):
    stage = F.when(F.col("l_quantity") > 40, "not_processed").when(F.col("l_quantity") > 20, "no_path").otherwise("survived").alias("lost_at_stage")
    best = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("probe_id"), stage)
    status = F.when(F.col("o_orderstatus") == "F", "SKIPPED_ANCHOR_COVERAGE").when(F.col("o_orderstatus") == "O", "SKIPPED_INACTIVE_REGION").otherwise("OTHER").alias("win_status")
    statuses = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("probe_id"), status)
    return diagnostics.reclassified(best, statuses).groupBy(F.col("lost_at_stage").alias("stage")).agg(F.count("*").alias("n"))


@query(
    "q_prefix_module",
    """
    WITH m AS (SELECT * FROM (VALUES (1, 'a'), (2, 'an'), (3, 'b'), (4, 'bl'), (5, '')) t(ord, prefix)),
    j AS (SELECT p_partkey, m.ord, row_number() OVER (PARTITION BY p_partkey ORDER BY length(prefix) DESC, ord) AS r FROM part JOIN m ON starts_with(p_name, prefix))
    SELECT p_partkey, ord FROM j WHERE r = 1""",
)
def prefix_module(spark, sf_dir):
    """Longest prefix first; a fixed list of prefixes is a CASE, not a join."""
    ranked = sorted(((1, "a"), (2, "an"), (3, "b"), (4, "bl"), (5, "")), key=lambda x: (-len(x[1]), x[0]))
    ord_ = F.coalesce(*(F.when(F.col("p_name").startswith(p), F.lit(o)) for o, p in ranked))
    return table(spark, sf_dir, "part").select("p_partkey", ord_.alias("ord"))


@query(
    "q_scale_cross",
    """
    WITH s AS (SELECT unnest([7, 20, 50]) AS scale)
    SELECT scale, p_brand, count(*)::BIGINT AS n, round(avg(p_retailprice / scale), 6) AS score FROM part CROSS JOIN s WHERE p_size >= scale GROUP BY ALL""",
)
def scale_cross(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_brand", "p_size", "p_retailprice", F.explode(F.array(*map(F.lit, (7, 20, 50)))).alias("scale"))
    return p.filter("p_size >= scale").groupBy("scale", "p_brand").agg(F.count("*").alias("n"), F.round(F.avg(F.col("p_retailprice") / F.col("scale")), 6).alias("score"))
