"""Evidence aggregation, genotype likelihoods, reports."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandloom.functions import seq, stats
from strandloom.operators import diagnostics, quantiles
from strandloom.operators import evidence as ev
from strandloom.operators import reports
from strandloom.plans.registry import query
from strandloom.session import table

def is_alt():
    return F.col("l_returnflag") == "R"


def is_reverse():
    return F.col("l_linestatus") == "O"


def lines(spark, sf_dir):
    return table(spark, sf_dir, "lineitem")


@query(
    "q_strand_bias",
    """
    SELECT l_suppkey, round(ln(((count(*) FILTER (l_returnflag <> 'R' AND l_linestatus <> 'O')) + 1.0) * ((count(*) FILTER (l_returnflag = 'R' AND l_linestatus = 'O')) + 1)
        / (((count(*) FILTER (l_returnflag <> 'R' AND l_linestatus = 'O')) + 1.0) * ((count(*) FILTER (l_returnflag = 'R' AND l_linestatus <> 'O')) + 1))), 6) AS log_odds
    FROM lineitem GROUP BY l_suppkey""",
)
def strand_bias(spark, sf_dir):
    return lines(spark, sf_dir).groupBy("l_suppkey").agg(F.round(stats.strand_bias(is_alt(), is_reverse()), 6).alias("log_odds"))


@query(
    "q_rank_effect",
    """
    WITH p AS (SELECT l_suppkey, l_quantity AS v, l_returnflag = 'R' AS alt FROM lineitem WHERE l_returnflag IN ('N', 'R')),
    r AS (SELECT *, rank() OVER (PARTITION BY l_suppkey ORDER BY v) + (count(*) OVER (PARTITION BY l_suppkey, v) - 1) / 2.0 AS mid FROM p),
    t AS (SELECT l_suppkey, sum(c * c * c - c) AS ties FROM (SELECT l_suppkey, v, count(*)::DOUBLE AS c FROM p GROUP BY ALL) GROUP BY l_suppkey),
    s AS (SELECT l_suppkey, count(*) FILTER (alt)::DOUBLE AS na, count(*) FILTER (NOT alt)::DOUBLE AS nr, coalesce(sum(mid) FILTER (alt), 0) AS ranks FROM r GROUP BY l_suppkey),
    v AS (SELECT s.*, na + nr AS n, na * nr / 12 * ((na + nr + 1) - ties / ((na + nr) * (na + nr - 1))) AS spread FROM s JOIN t USING (l_suppkey))
    SELECT l_suppkey, na::BIGINT AS na, nr::BIGINT AS nr, round(CASE WHEN na = 0 OR nr = 0 THEN NULL WHEN spread <= 0 THEN 0 ELSE (ranks - na * (na + 1) / 2 - na * nr / 2) / sqrt(spread) / sqrt(n) END, 6) AS effect FROM v""",
)
def rank_effect(spark, sf_dir):
    l = lines(spark, sf_dir).filter("l_returnflag IN ('N', 'R')")
    return stats.rank_effect(l, ["l_suppkey"], "l_quantity", is_alt()).withColumn("effect", F.round("effect", 6))


@query(
    "q_entropy",
    """
    WITH b AS (SELECT user_id, floor(value / 3) AS bin, count(*) AS c FROM events GROUP BY ALL), k AS (SELECT user_id, sum(c) AS n, sum(c * log2(c)) AS s FROM b GROUP BY user_id)
    SELECT user_id, n::BIGINT AS n, round(CASE WHEN n >= 3 THEN (log2(n) - s / n) / log2(least(n, 20)) END, 6) AS entropy FROM k""",
)
def entropy(spark, sf_dir):
    e = stats.binned_entropy(table(spark, sf_dir, "events"), ["user_id"], F.floor(F.col("value") / 3), 20)
    return e.withColumn("entropy", F.round("entropy", 6))


def _pl_sql(counts: list[str]) -> str:
    k = len(counts)
    total = " + ".join(counts)
    logs = []
    for a, b in stats.genotypes(k):
        al = stats.genotype_alphas(k, a, b)
        each = " + ".join(f"lgamma({c} + {x!r}) - lgamma({x!r})" for c, x in zip(counts, al))
        logs.append(f"{each} + lgamma({sum(al)!r}) - lgamma({total} + {sum(al)!r})")
    return "[" + ", ".join(logs) + "]"


PL_SQL = f"""
    WITH c AS (SELECT l_orderkey, count(*) FILTER (l_returnflag = 'N') AS r, count(*) FILTER (l_returnflag = 'R') AS a, count(*) FILTER (l_returnflag = 'A') AS b FROM lineitem GROUP BY l_orderkey),
    g AS (SELECT l_orderkey, {_pl_sql(['r', 'a', 'b'])} AS x FROM c),
    p AS (SELECT l_orderkey, list_transform(x, lambda v: round(-10 * (v - list_max(x)) / ln(10))::BIGINT) AS pl FROM g)"""


def pls(spark, sf_dir):
    """Likelihoods of the six genotypes of a reference allele and two others."""
    n = [F.count_if(F.col("l_returnflag") == x) for x in "NRA"]
    c = lines(spark, sf_dir).groupBy("l_orderkey").agg(F.array(*n).alias("n"))
    return c.select("l_orderkey", stats.genotype_pls_of(F.col("n")).alias("pl"))


@query("q_dm_pl", PL_SQL + " SELECT l_orderkey, " + ", ".join(f"pl[{k + 1}] AS pl{k}" for k in range(6)) + " FROM p")
def dm_pl(spark, sf_dir):
    return pls(spark, sf_dir).select("l_orderkey", *(F.col("pl")[k].alias(f"pl{k}") for k in range(6)))


@query(
    "q_gt_gq",
    PL_SQL + " SELECT l_orderkey, ['0/0', '0/1', '1/1', '0/2', '1/2', '2/2'][list_position(pl, list_min(pl))] AS gt, least(99, list_sort(pl)[2])::BIGINT AS gq FROM p",
)
def gt_gq(spark, sf_dir):
    return pls(spark, sf_dir).select("l_orderkey", stats.genotype_text(F.col("pl")).alias("gt"), stats.genotype_quality(F.col("pl")).cast("long").alias("gq"))


@query(
    "q_cmlod",
    """
    WITH q AS (SELECT l_suppkey, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS al, pow(10, -l_quantity / 10) AS e FROM lineitem),
    n AS (SELECT l_suppkey, al, count(*)::DOUBLE AS c FROM q GROUP BY ALL), d AS (SELECT l_suppkey, sum(c) AS d FROM n GROUP BY l_suppkey),
    f AS (SELECT n.l_suppkey, al, c / d AS f FROM n JOIN d USING (l_suppkey)),
    t AS (SELECT l_suppkey, al AS alt, f AS fa FROM f WHERE al > 0),
    r AS (SELECT q.l_suppkey, q.al, q.e, f.f, q.e / 2 AS miss FROM q JOIN f USING (l_suppkey, al)),
    s AS (SELECT r.l_suppkey, t.alt, sum(log10(greatest(1e-15, miss + f * (1 - e - miss)))) - sum(log10(greatest(1e-15, miss + (CASE WHEN fa >= 1 THEN CASE WHEN al = 0 THEN 1 ELSE 0 END WHEN al = t.alt THEN 0 ELSE f / (1 - fa) END) * (1 - e - miss)))) AS lod
        FROM r JOIN t USING (l_suppkey) GROUP BY ALL),
    k AS (SELECT DISTINCT l_suppkey, unnest([1, 2]) AS alt FROM lineitem)
    SELECT l_suppkey, alt, round(greatest(0.0, coalesce(lod, 0.0)), 4) AS lod FROM k LEFT JOIN s USING (l_suppkey, alt)""",
)
def cmlod(spark, sf_dir):
    allele = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    by = lines(spark, sf_dir).groupBy("l_suppkey", allele.alias("allele"), F.col("l_quantity").alias("quality")).agg(F.count("*").cast("int").alias("w"))
    n = [F.coalesce(F.sum(F.when(F.col("allele") == k, F.col("w"))), F.lit(0)).cast("int") for k in range(3)]
    cells = by.groupBy("l_suppkey").agg(F.array(*n).alias("n"), F.collect_list(F.struct("allele", "quality", "w")).alias("cells"))  # a cell a quality
    lods = cells.select("l_suppkey", F.posexplode(stats.mixture_lods_of(F.col("n"), F.col("cells"))).alias("k", "lod"))
    return lods.select("l_suppkey", (F.col("k") + 1).alias("alt"), F.round("lod", 4).alias("lod"))


@query(
    "q_posterior_bq",
    """
    WITH s AS (SELECT l_orderkey, count(*) AS n, sum(log10(greatest(pow(10, -l_quantity / 10), 1e-300))) AS bad, sum(log10(greatest(1 - pow(10, -l_quantity / 10), 1e-300))) AS good FROM lineitem GROUP BY l_orderkey),
    p AS (SELECT l_orderkey, n, -10 * (bad - (greatest(bad, good) + log10(1 + pow(10, least(bad, good) - greatest(bad, good))))) AS pbq FROM s)
    SELECT l_orderkey, round(pbq, 5) AS pbq, round(pbq / n, 5) AS npbq FROM p""",
)
def posterior_bq(spark, sf_dir):
    q = stats.posterior_quality(F.col("l_quantity"))
    return lines(spark, sf_dir).groupBy("l_orderkey").agg(F.round(q, 5).alias("pbq"), F.round(q / F.count("*"), 5).alias("npbq"))


@query(
    "q_rms_mean_delta",
    """
    SELECT l_partkey, round(sqrt(avg(l_quantity * l_quantity)), 6) AS rms, round(avg(l_extendedprice) FILTER (l_returnflag = 'R') - avg(l_extendedprice) FILTER (l_returnflag <> 'R'), 5) AS fld,
        round(avg(l_tax) FILTER (l_returnflag = 'R') - 2 - avg(l_tax) FILTER (l_returnflag <> 'R'), 6) AS asmd,
        round(coalesce(avg((l_discount > 0.05)::INT) FILTER (l_returnflag = 'R'), 0) - coalesce(avg((l_discount > 0.05)::INT) FILTER (l_returnflag <> 'R'), 0), 6) AS sca
    FROM lineitem GROUP BY l_partkey""",
)
def rms_mean_delta(spark, sf_dir):
    r = lambda c, n=6: F.round(c, n)
    return lines(spark, sf_dir).groupBy("l_partkey").agg(
        r(stats.rms(F.col("l_quantity"))).alias("rms"), r(stats.mean_delta(F.col("l_extendedprice"), is_alt()), 5).alias("fld"),
        r(stats.mean_delta(F.col("l_tax"), is_alt(), 2)).alias("asmd"), r(stats.share_delta((F.col("l_discount") > 0.05).cast("int"), is_alt())).alias("sca"),
    )


@query(
    "q_solor_state",
    """
    WITH s AS (SELECT l_partkey, l_suppkey, l_suppkey % 2 = 0 AS is_case, count(*) FILTER (l_returnflag = 'R')::DOUBLE AS a, count(*) FILTER (l_returnflag <> 'R')::DOUBLE AS r FROM lineitem GROUP BY ALL),
    c AS (SELECT l_partkey, coalesce(sum(a) FILTER (NOT is_case), 0) AS ca, coalesce(sum(r) FILTER (NOT is_case), 0) AS cr, count(*) FILTER (NOT is_case) AS n,
        coalesce(bool_or(a > 0) FILTER (NOT is_case), false) AS in_ctrl, coalesce(bool_or(a > 0) FILTER (is_case), false) AS in_case FROM s GROUP BY l_partkey),
    o AS (SELECT s.l_partkey, max(CASE WHEN is_case THEN ln((a + 1) * (cr / greatest(n, 1) + 1) / ((r + 1) * (ca / greatest(n, 1) + 1))) ELSE 0 END) AS m FROM s JOIN c USING (l_partkey) GROUP BY s.l_partkey)
    SELECT l_partkey, round(greatest(0.0, m), 6) AS qual, CASE WHEN in_ctrl AND in_case THEN 'SHARED' WHEN in_ctrl THEN 'CTRL' WHEN in_case THEN 'CASE' ELSE 'NONE' END AS state FROM c JOIN o USING (l_partkey)""",
)
def solor_state(spark, sf_dir):
    s = lines(spark, sf_dir).groupBy("l_partkey", "l_suppkey").agg(F.count_if(is_alt()).alias("a"), F.count_if(~is_alt()).alias("r"))
    case = F.col("l_suppkey") % 2 == 0
    item = F.struct(case.alias("is_case"), "a", "r")
    ctrl = lambda c: F.coalesce(F.sum(F.when(~case, F.col(c))), F.lit(0))
    g = s.groupBy("l_partkey").agg(
        ctrl("a").alias("ca"), ctrl("r").alias("cr"), F.count_if(~case).alias("n"), F.bool_or(~case & (F.col("a") > 0)).alias("in_ctrl"),
        F.bool_or(case & (F.col("a") > 0)).alias("in_case"), F.collect_set(F.when(case, item)).alias("cases"),
    )
    odds = F.transform("cases", lambda x: stats.somatic_odds(x["a"], x["r"], F.col("ca"), F.col("cr"), F.col("n")))
    return g.select("l_partkey", F.round(F.greatest(F.lit(0.0), F.array_max(odds)), 6).alias("qual"), stats.state(F.col("in_ctrl"), F.col("in_case")).alias("state"))


@query(
    "q_depth_fold",
    """
    WITH c AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) SELECT l_orderkey, round(n / (SELECT avg(n) FROM c), 6) AS fold FROM c""",
)
def depth_fold(spark, sf_dir):
    c = lines(spark, sf_dir).groupBy("l_orderkey").agg(F.count("*").alias("n"))
    mean = c.agg(F.avg("n").alias("m"))  # one row
    return c.crossJoin(F.broadcast(mean)).select("l_orderkey", F.round(F.try_divide("n", "m"), 6).alias("fold"))


@query(
    "q_median_funnel",
    """
    WITH u AS (UNPIVOT (SELECT l_quantity, l_discount, l_tax FROM lineitem) ON l_quantity, l_discount, l_tax INTO NAME stage VALUE v)
    SELECT stage, round(quantile_cont(v, 0.5), 6) AS median, round(avg(v), 6) AS mean, min(v) AS lo, max(v) AS hi, count(*) FILTER (v = 0)::BIGINT AS zeros, list_sort(list(v))[len(list(v)) // 2 + 1] AS upper_median FROM u GROUP BY stage""",
)
def median_funnel(spark, sf_dir):
    names = ["l_quantity", "l_discount", "l_tax"]
    u = lines(spark, sf_dir).unpivot([], names, "stage", "v")
    g = u.groupBy("stage").agg(F.round(F.avg("v"), 6).alias("mean"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.count_if(F.col("v") == 0).alias("zeros"))
    medians = quantiles.quantiles(u, ["stage"], "v", median=0.5).join(quantiles.upper_median(u, ["stage"], "v", "upper_median"), "stage")
    return g.join(medians, "stage").select("stage", F.round("median", 6).alias("median"), "mean", "lo", "hi", "zeros", "upper_median")


@query(
    "q_grouping_sets",
    """
    SELECT o_orderstatus, o_orderpriority, count(*)::BIGINT AS n, round(avg(o_totalprice), 4) AS mean, max(o_totalprice) AS top, count(*) FILTER (o_totalprice > 200000)::BIGINT AS above
    FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderstatus, o_orderpriority), ())""",
)
def grouping_sets(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.groupingSets([["o_orderstatus"], ["o_orderstatus", "o_orderpriority"], []], "o_orderstatus", "o_orderpriority").agg(
        F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 4).alias("mean"), F.max("o_totalprice").alias("top"), F.count_if(F.col("o_totalprice") > 200_000).alias("above")
    )


@query(
    "q_status_breakdown",
    """
    WITH d AS (SELECT unnest(['F', 'O', 'P', 'X']) AS status), c AS (SELECT d.status, count(o_orderkey)::BIGINT AS n FROM d LEFT JOIN orders ON o_orderstatus = d.status GROUP BY d.status)
    SELECT status, n, round(100.0 * n / sum(n) OVER (), 6) AS pct FROM c""",
)
def status_breakdown(spark, sf_dir):
    c = table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"))
    every = F.sum("n").over(W.partitionBy())  # four rows
    d = spark.range(1).select(F.explode(F.array(*map(F.lit, "FOPX"))).alias("status")).join(c, "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n"))
    return d.select("status", "n", F.round(100.0 * F.col("n") / every, 6).alias("pct"))


# Columns of a probe record, made from a line.
RECORD = {
    "is_geno_has_alt_support": "l_quantity > 45", "is_msa_exact_match": "l_returnflag = 'R'", "is_geno_no_overlap": "l_discount = 0.0", "n_geno_reassigned_to_ref": "l_tax > 0.06", "n_geno_reassigned_to_wrong_alt": "l_tax = 0.0",
    "is_msa_shifted": "l_tax > 0.04", "is_msa_subsumed": "l_tax < 0.02", "is_traversal_limited": "l_suppkey % 2 = 0", "n_expected_alt_kmers": "l_linenumber > 1", "is_graph_cycle": "l_suppkey % 5 = 0",
    "is_graph_complex": "l_suppkey % 5 = 1", "is_no_anchor": "l_suppkey % 5 = 2", "is_short_anchor": "l_suppkey % 5 = 3", "is_variant_in_anchor": "l_linenumber % 2 = 0",
} | {f"n_surviving_{s}": f"l_partkey % 8 > {k + 1}" for k, s in enumerate(diagnostics.SURVIVAL)}


@query(
    "q_cascade",
    f"""
    WITH x AS (SELECT l_orderkey, l_linenumber, l_linestatus = 'F' AS found, {', '.join(f'({v})::INT AS {k}' for k, v in RECORD.items())} FROM lineitem),
    c AS (SELECT l_orderkey, l_linenumber, CASE WHEN is_geno_has_alt_support = 1 THEN 'survived' WHEN is_msa_exact_match = 1 THEN CASE WHEN is_geno_no_overlap = 1 THEN 'geno_no_overlap'
            WHEN n_geno_reassigned_to_ref + n_geno_reassigned_to_wrong_alt > 0 THEN 'geno_reads_reassigned' ELSE 'geno_zero_alt_reads' END
        WHEN found THEN CASE WHEN is_msa_shifted = 1 THEN 'msa_shifted' WHEN is_msa_subsumed = 1 THEN 'msa_subsumed' ELSE 'msa_not_extracted' END
        WHEN n_surviving_tips > 0 THEN CASE WHEN is_traversal_limited = 1 THEN 'bfs_exhausted' ELSE 'no_path' END
        WHEN n_surviving_compress2 > 0 THEN 'pruned_at_tips' WHEN n_surviving_lowcov2 > 0 THEN 'pruned_at_compress2' WHEN n_surviving_compress1 > 0 THEN 'pruned_at_lowcov2' WHEN n_surviving_lowcov1 > 0 THEN 'pruned_at_compress1'
        WHEN n_surviving_build > 0 THEN 'pruned_at_lowcov1' WHEN n_expected_alt_kmers > 0 THEN 'pruned_at_build' WHEN is_graph_cycle = 1 THEN 'graph_has_cycle' WHEN is_graph_complex = 1 THEN 'graph_too_complex'
        WHEN is_no_anchor = 1 THEN 'no_anchor' WHEN is_short_anchor = 1 THEN 'short_anchor' WHEN is_variant_in_anchor = 1 THEN 'variant_in_anchor' ELSE 'not_processed' END AS stage FROM x),
    b AS (SELECT l_orderkey, stage, row_number() OVER (PARTITION BY l_orderkey ORDER BY list_position({diagnostics.STAGES!r}, stage) DESC, l_linenumber DESC) AS r FROM c)
    SELECT stage, count(*)::BIGINT AS n FROM b WHERE r = 1 GROUP BY stage""",
)
def cascade(spark, sf_dir):
    """Of each order's records the one that came deepest, by stage."""
    columns = [F.expr(f"int({v})").alias(k) for k, v in RECORD.items()]
    d = lines(spark, sf_dir).select(F.col("l_orderkey").alias("probe_id"), F.col("l_linenumber").alias("kmer_size"), F.when(F.col("l_linestatus") == "F", "1").otherwise(".").alias("hap_indices"), *columns)
    return diagnostics.best_attempts(d).groupBy(F.col("lost_at_stage").alias("stage")).agg(F.count("*").alias("n"))


@query(
    "q_survival",
    "WITH x AS (SELECT " + ", ".join(f"(l_partkey * {k + 3} % (l_suppkey + 1)) AS n_surviving_{s}" for k, s in enumerate(diagnostics.SURVIVAL)) + """ FROM lineitem),
    u AS (UNPIVOT x ON COLUMNS(*) INTO NAME stage VALUE n), g AS (SELECT stage, quantile_cont(n, 0.5) AS median, avg(n) AS mean, min(n) AS least, max(n) AS most, count(*) FILTER (n = 0) AS zeros FROM u GROUP BY stage),
    o AS (SELECT *, list_position("""
    + repr([f"n_surviving_{s}" for s in diagnostics.SURVIVAL])
    + """, stage) AS ord FROM g)
    SELECT stage, median, round(mean, 6) AS mean, least, most, zeros::BIGINT AS zeros, (zeros - coalesce(lag(zeros) OVER (ORDER BY ord), 0))::BIGINT AS more_zeros FROM o""",
)
def survival(spark, sf_dir):
    d = lines(spark, sf_dir).select(*(F.expr(f"l_partkey * {k + 3} % (l_suppkey + 1)").alias(f"n_surviving_{s}") for k, s in enumerate(diagnostics.SURVIVAL)))
    return diagnostics.survival(d).select("stage", "median", F.round("mean", 6).alias("mean"), "least", "most", "zeros", "more_zeros")


@query(
    "q_cross_tab",
    """
    SELECT CASE WHEN p_size < 5 THEN '1-4' WHEN p_size < 10 THEN '5-9' WHEN p_size < 20 THEN '10-19' WHEN p_size < 30 THEN '20-29' WHEN p_size < 40 THEN '30-39' ELSE '40+' END AS tier,
        count(*) FILTER (l_returnflag = 'A')::BIGINT AS a, count(*) FILTER (l_returnflag = 'N')::BIGINT AS n, count(*) FILTER (l_returnflag = 'R')::BIGINT AS r
    FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1""",
)
def cross_tab(spark, sf_dir):
    tier = F.expr("CASE WHEN p_size < 5 THEN '1-4' WHEN p_size < 10 THEN '5-9' WHEN p_size < 20 THEN '10-19' WHEN p_size < 30 THEN '20-29' WHEN p_size < 40 THEN '30-39' ELSE '40+' END")
    counts = lines(spark, sf_dir).groupBy(F.col("l_partkey").alias("p_partkey"), "l_returnflag").agg(F.count("*").alias("c"))  # before the join
    j = counts.join(table(spark, sf_dir, "part").select("p_partkey", tier.alias("tier")), "p_partkey")
    p = j.groupBy("tier").pivot("l_returnflag", ["A", "N", "R"]).agg(F.sum("c"))
    return p.select("tier", *(F.coalesce(k, F.lit(0)).alias(k.lower()) for k in "ANR"))


@query(
    "q_filter_counts",
    """
    WITH r AS (SELECT l_suppkey, l_returnflag = 'R' AS alt, CASE WHEN l_orderkey & 512 <> 0 THEN 'qcfail' WHEN l_orderkey & 1024 <> 0 THEN 'duplicate' WHEN l_quantity < 20 THEN 'mapq' ELSE 'passing' END AS f FROM lineitem)
    SELECT l_suppkey, count(*)::BIGINT AS raw_total, count(*) FILTER (alt)::BIGINT AS raw_alt, count(*) FILTER (f = 'passing')::BIGINT AS passing_total, count(*) FILTER (alt AND f = 'passing')::BIGINT AS passing_alt,
        count(*) FILTER (alt AND f = 'qcfail')::BIGINT AS alt_qcfail, count(*) FILTER (alt AND f = 'duplicate')::BIGINT AS alt_duplicate, count(*) FILTER (alt AND f = 'mapq')::BIGINT AS alt_mapq FROM r GROUP BY l_suppkey""",
)
def filter_counts(spark, sf_dir):
    r = lines(spark, sf_dir).select("l_suppkey", F.col("l_orderkey").alias("flag"), F.col("l_quantity").alias("mapq"), is_alt().alias("carries"))
    return diagnostics.filtered_reads(r, ["l_suppkey"])


@query(
    "q_allele_depths",
    """
    WITH d AS (SELECT l_suppkey, l_orderkey, l_returnflag, l_linestatus, row_number() OVER (PARTITION BY l_suppkey, l_orderkey, l_returnflag ORDER BY l_linenumber, CASE l_linestatus WHEN 'F' THEN 'FWD' ELSE 'REV' END, l_quantity DESC) AS r FROM lineitem),
    f AS (SELECT * FROM d WHERE r = 1)
    SELECT l_suppkey, count(*)::BIGINT AS dp, count(*) FILTER (l_returnflag = 'N')::BIGINT AS ref_ad, count(*) FILTER (l_returnflag <> 'N')::BIGINT AS alt_ad,
        count(*) FILTER (l_returnflag <> 'N' AND l_linestatus = 'F')::BIGINT AS alt_fwd, count(*) FILTER (l_returnflag <> 'N' AND l_linestatus <> 'F')::BIGINT AS alt_rev FROM f GROUP BY l_suppkey""",
)
def allele_depths(spark, sf_dir):
    """First-seen read of a name by allele counts once."""
    allele = F.when(F.col("l_returnflag") == "N", 0).when(F.col("l_returnflag") == "A", 1).otherwise(2)
    rows = lines(spark, sf_dir).select(
        F.lit(0).alias("window_id"), F.lit("c").alias("chrom"), F.col("l_suppkey").alias("pos"), F.lit("A").alias("ref"), F.array(F.lit("C"), F.lit("G")).alias("alts"), F.lit("s").alias("sample"), allele.alias("allele"), F.col("l_orderkey").alias("qname"),
        F.when(F.col("l_linestatus") == "F", "FWD").otherwise("REV").alias("strand"), F.col("l_linenumber").alias("aln_start"), F.col("l_quantity").alias("aln_score"),
    )
    ref, fwd = F.col("allele") == 0, F.col("strand") == "FWD"
    g = ev.first_seen(rows).groupBy(F.col("pos").alias("l_suppkey"))
    return g.agg(F.count("*").alias("dp"), F.count_if(ref).alias("ref_ad"), F.count_if(~ref).alias("alt_ad"), F.count_if(~ref & fwd).alias("alt_fwd"), F.count_if(~ref & ~fwd).alias("alt_rev"))


@query(
    "q_online_stats",
    """
    SELECT l_suppkey, count(*)::BIGINT AS n, round(avg(l_quantity), 6) AS mean, round(coalesce(var_samp(l_quantity), 0), 5) AS variance, round(coalesce(stddev_samp(l_quantity), 0) / avg(l_quantity), 6) AS cv FROM lineitem GROUP BY l_suppkey""",
)
def online_stats(spark, sf_dir):
    z = lambda c: F.coalesce(c, F.lit(0.0))
    return lines(spark, sf_dir).groupBy("l_suppkey").agg(F.count("*").alias("n"), F.round(F.avg("l_quantity"), 6).alias("mean"), F.round(z(F.var_samp("l_quantity")), 5).alias("variance"), F.round(z(F.stddev_samp("l_quantity")) / F.avg("l_quantity"), 6).alias("cv"))


@query(
    "q_argmax_member",
    """
    WITH g AS (SELECT l_suppkey, l_partkey, sum(l_quantity) AS q FROM lineitem GROUP BY ALL)
    SELECT l_suppkey, round(sum(q), 4) AS total, arg_max(l_partkey, {'q': q, 'k': -l_partkey}) AS top_part FROM g GROUP BY l_suppkey""",
)
def argmax_member(spark, sf_dir):
    g = lines(spark, sf_dir).groupBy("l_suppkey", "l_partkey").agg(F.sum("l_quantity").alias("q"))
    return g.groupBy("l_suppkey").agg(F.round(F.sum("q"), 4).alias("total"), (-F.max(F.struct("q", (-F.col("l_partkey")).alias("k")))["k"]).alias("top_part"))


@query(
    "q_attempts",
    """
    SELECT l_partkey, count(*)::BIGINT AS n, count(DISTINCT l_orderkey)::BIGINT AS windows, count(DISTINCT l_suppkey)::BIGINT AS comps, max(l_linenumber) AS deepest, min(l_linenumber) AS shallowest,
        round(count(*) FILTER (l_returnflag = 'R') / count(*), 6) AS ratio FROM lineitem GROUP BY l_partkey""",
)
def attempts(spark, sf_dir):
    return lines(spark, sf_dir).groupBy("l_partkey").agg(
        F.count("*").alias("n"), F.countDistinct("l_orderkey").alias("windows"), F.countDistinct("l_suppkey").alias("comps"), F.max("l_linenumber").alias("deepest"),
        F.min("l_linenumber").alias("shallowest"), F.round(F.count_if(is_alt()) / F.count("*"), 6).alias("ratio"),
    )


# The eleven features, made from a line.
MADE = dict(zip(reports.FEATURES, ("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber - 4", "l_tax - l_discount", "l_quantity - 25", "1 / (1 + l_linenumber)", "1 - l_discount", "l_suppkey % 7", "l_suppkey % 2"), strict=True))


@query("q_complexity_merge", f"SELECT l_partkey, {', '.join(f'max(({v})::DOUBLE) AS {k}' for k, v in MADE.items())} FROM lineitem GROUP BY l_partkey")
def complexity_merge(spark, sf_dir):
    d = lines(spark, sf_dir).select("l_partkey", *(F.expr(f"double({v})").alias(k) for k, v in MADE.items()))
    return reports.merged_features(d, ["l_partkey"])


@query(
    "q_window_status",
    """
    WITH b AS (SELECT l_orderkey, bool_or(l_returnflag = 'R') AS ctrl, bool_or(l_linestatus = 'O') AS kase, sum(l_quantity) AS cov FROM lineitem GROUP BY l_orderkey)
    SELECT CASE WHEN cov / 10 < 5 THEN 'LOW_COVERAGE' WHEN NOT ctrl AND NOT kase THEN 'INACTIVE' WHEN NOT ctrl THEN 'NO_ASM' ELSE 'FOUND' END AS status, count(*)::BIGINT AS n FROM b GROUP BY 1""",
)
def window_status(spark, sf_dir):
    b = lines(spark, sf_dir).groupBy("l_orderkey").agg(F.bool_or(is_alt()).alias("ctrl"), F.bool_or(is_reverse()).alias("kase"), F.sum("l_quantity").alias("cov"))
    s = F.when(F.col("cov") / 10 < 5, "LOW_COVERAGE").when(~F.col("ctrl") & ~F.col("kase"), "INACTIVE").when(~F.col("ctrl"), "NO_ASM").otherwise("FOUND")
    return b.groupBy(s.alias("status")).agg(F.count("*").alias("n"))


def _polar(name: str) -> str:
    y, x = "(p_size + 1e-10)", "(p_retailprice / 100)"
    r = f"(({x} - {y}) / ({y} + {x}))"
    return f"round(pi() / 4 + (0.1963 * {r} * {r} - 0.9817) * {r}, 6) AS {name}"


@query("q_polar", f"SELECT p_partkey, round(log10(1 + sqrt(p_size * p_size + (p_retailprice / 100) * (p_retailprice / 100))), 6) AS radius, {_polar('angle')} FROM part")
def polar(spark, sf_dir):
    r, a = F.col("p_retailprice") / 100, F.col("p_size")
    return table(spark, sf_dir, "part").select("p_partkey", F.round(seq.polar_radius(r, a), 6).alias("radius"), F.round(seq.polar_angle(r, a), 6).alias("angle"))
