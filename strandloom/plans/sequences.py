"""Sequence functions, k-mers and graphs over texts read as DNA."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandloom.functions import kmers, seq, sql
from strandloom.operators import kgraph, seeds, tablegraph
from strandloom.operators import relational as rel
from strandloom.plans.registry import query
from strandloom.session import ship, table
from strandloom.sources.storage import checkpointed

DNA = "regexp_replace(upper(text), '[^ACGT]', '', 'g')"
RC = "reverse(translate({0}, 'ACGT', 'TGCA'))"


def dna(spark, sf_dir):
    """doc_id, s. A generator of one row gives the bases, for else the optimizer puts their expression into whatever reads
    them, and each place that does, even a lambda's turn, makes them anew."""
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array(seq.dna(F.col("text")))).alias("s"))


@query(
    "q_kmer_counts",
    f"""
    WITH d AS (SELECT {DNA} AS s FROM documents), k AS (SELECT unnest(list_transform(range(1, length(s) - 9), lambda i: substr(s, i, 11))) AS w FROM d WHERE length(s) >= 11)
    SELECT least(w, {RC.format('w')}) AS kmer, count(*)::BIGINT AS n FROM k GROUP BY 1 HAVING count(*) >= 20""",
)
def kmer_counts(spark, sf_dir):
    ship(spark)
    return kmers.canonical_counts(dna(spark, sf_dir), "s", 11).filter("n >= 20").select(kmers.letters(F.col("kmer"), 11).alias("kmer"), "n")


@query(
    "q_homopolymer",
    f"""
    WITH d AS (SELECT doc_id, {DNA} AS s FROM documents)
    SELECT doc_id, coalesce(list_max(list_transform(regexp_extract_all(s, 'A+|C+|G+|T+'), lambda x: length(x))), 0)::INTEGER AS run FROM d""",
)
def homopolymer(spark, sf_dir):
    return dna(spark, sf_dir).select("doc_id", seq.max_homopolymer(F.col("s")).alias("run"))


def _entropy_sql() -> str:
    n = {b: f"(length(s) - length(replace(s, '{b}', '')))" for b in "ACGT"}
    total = "length(s)"
    return " + ".join(f"CASE WHEN {c} > 0 THEN -({c} / {total}) * log2({c} / {total}) ELSE 0 END" for c in n.values())


@query("q_base_entropy", f"WITH d AS (SELECT doc_id, {DNA} AS s FROM documents) SELECT doc_id, round(CASE WHEN length(s) > 0 THEN {_entropy_sql()} ELSE 0 END, 6) AS entropy FROM d")
def base_entropy(spark, sf_dir):
    return dna(spark, sf_dir).select("doc_id", F.round(seq.base_entropy(F.col("s")), 6).alias("entropy"))


@query(
    "q_canonical",
    f"""
    WITH d AS (SELECT doc_id, {DNA} AS s FROM documents)
    SELECT doc_id, {RC.format('s')} AS rc, least(s, {RC.format('s')}) AS canon, s <= {RC.format('s')} AS plus FROM d""",
)
def canonical(spark, sf_dir):
    s = F.col("s")
    return dna(spark, sf_dir).select("doc_id", seq.reverse_complement(s).alias("rc"), seq.canonical(s).alias("canon"), seq.plus_sign(s).alias("plus"))


@query(
    "q_longdust",
    f"""
    WITH d AS (SELECT doc_id, {DNA} AS s FROM documents), k AS (SELECT doc_id, unnest(list_transform(range(1, length(s) - 2), lambda i: substr(s, i, 4))) AS w FROM d WHERE length(s) >= 4),
    c AS (SELECT doc_id, w, count(*) AS c FROM k GROUP BY ALL)
    SELECT doc_id, sum(c)::BIGINT AS kmers, round(sum(lgamma(c + 1)), 4) AS score FROM c GROUP BY doc_id""",
)
def longdust(spark, sf_dir):
    """Sum of ln c! over a text's 4-mers; texts without any have no row."""
    ship(spark)
    c = kmers.word_counts(dna(spark, sf_dir), "doc_id", "s", 4).filter("c > 0")
    return c.groupBy("doc_id").agg(F.sum("c").alias("kmers"), F.round(F.sum(seq.log_factorial(F.col("c"))), 4).alias("score"))


@query(
    "q_longdust_score",
    f"""
    WITH d AS (SELECT doc_id, {DNA} AS s FROM documents), k AS (SELECT doc_id, unnest(list_transform(range(1, length(s) - 2), lambda i: substr(s, i, 4))) AS w FROM d WHERE length(s) >= 4),
    c AS (SELECT doc_id, w, count(*) AS c FROM k GROUP BY ALL), g AS (SELECT doc_id, sum(c)::BIGINT AS n, sum(lgamma(c + 1)) AS s FROM c GROUP BY doc_id),
    f AS (SELECT n, 256 * list_sum(list_transform(range(0, (n / 256 + 15 * sqrt(n / 256.0))::BIGINT + 40), lambda x: exp(x * ln(n / 256.0) - n / 256.0 - lgamma(x + 1)) * lgamma(x + 1))) AS f FROM (SELECT DISTINCT n FROM g))
    SELECT d.doc_id, round(coalesce(greatest(0.0, (s - f) / n), 0.0), 6) AS score FROM (SELECT doc_id FROM documents) d LEFT JOIN (g JOIN f USING (n)) USING (doc_id)""",
)
def longdust_score(spark, sf_dir):
    """Low-complexity score of both strands against what random sequence of that length gives."""
    ship(spark)
    return kgraph.longdust(dna(spark, sf_dir), "doc_id", "s", 4).withColumn("score", F.round("score", 6))


PAIRS = "SELECT a.p_partkey AS id, a.p_name AS x, b.p_name AS y FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1"
PREFIX = "(length(list_filter(range(1, least(length({0}), length({1})) + 1), lambda i: substr({0}, 1, i) = substr({1}, 1, i))))"


def pairs(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    return p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("x")).join(p.select((F.col("p_partkey") - 1).alias("id"), F.col("p_name").alias("y")), "id")


@query(
    "q_classify_alleles",
    f"""
    WITH p AS ({PAIRS}), a AS (SELECT *, {PREFIX.format('x', 'y')} AS st FROM p),
    b AS (SELECT *, reverse(substr(x, st + 1)) AS rx, reverse(substr(y, st + 1)) AS ry FROM a), c AS (SELECT *, {PREFIX.format('rx', 'ry')} AS en FROM b),
    k AS (SELECT *, length(x) - st - en AS r, length(y) - st - en AS t FROM c),
    z AS (SELECT *, CASE WHEN r = 0 AND t = 0 THEN 'REF' WHEN r = 0 THEN 'INS' WHEN t = 0 THEN 'DEL' WHEN r <> t THEN 'CPX' WHEN r = 1 THEN 'SNV' ELSE 'MNP' END AS kind FROM k)
    SELECT id, st::INTEGER AS start, kind, (CASE WHEN kind = 'SNV' THEN 1 WHEN kind IN ('INS', 'DEL', 'CPX') THEN length(y) - length(x) ELSE t END)::INTEGER AS size FROM z""",
)
def classify_alleles(spark, sf_dir):
    x, y = F.col("x"), F.col("y")
    return pairs(spark, sf_dir).select("id", seq.core(x, y)["start"].alias("start"), seq.classify(x, y).alias("kind"), seq.variant_length(x, y).alias("size"))


@query("q_levenshtein", f"WITH p AS ({PAIRS}) SELECT id, levenshtein(x, y)::INTEGER AS d, (CASE WHEN length(x) = length(y) THEN hamming(CASE WHEN length(x) = length(y) THEN x ELSE y END, y) END)::INTEGER AS h FROM p")
def levenshtein(spark, sf_dir):
    return pairs(spark, sf_dir).select("id", F.levenshtein("x", "y").alias("d"), seq.hamming(F.col("x"), F.col("y")).alias("h"))


CIGAR = "(p_size % 5 + 1)::VARCHAR || 'S' || (p_size + 10)::VARCHAR || 'M' || (p_size % 3 + 1)::VARCHAR || 'I' || (p_size % 7 + 1)::VARCHAR || 'D' || (p_size + 3)::VARCHAR || 'M'"


@query(
    "q_cigar",
    """
    SELECT p_partkey, (2 * p_size + 13 + p_size % 7 + 1)::INTEGER AS ref_span, (p_size % 5 + 1 + 2 * p_size + 13 + p_size % 3 + 1)::INTEGER AS query_span, (4 * (p_size % 5 + 1))::INTEGER AS clip_penalty,
        (p_size % 5 + 1 + p_size + 10 + p_size % 3 + 1)::INTEGER AS q_at, (p_size % 5 + 1) / (p_size % 5 + 1 + 2 * p_size + 13 + p_size % 3 + 1) >= 0.06 AS clipped FROM part""",
)
def cigar(spark, sf_dir):
    c = F.expr("concat(p_size % 5 + 1, 'S', p_size + 10, 'M', p_size % 3 + 1, 'I', p_size % 7 + 1, 'D', p_size + 3, 'M')")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_size", seq.cigar_units(c).alias("u"))
    u = F.col("u")
    return p.select("p_partkey", seq.reference_span(u).alias("ref_span"), seq.query_span(u).alias("query_span"), seq.soft_clip_penalty(u).alias("clip_penalty"), seq.query_position(u, F.col("p_size") + 10).alias("q_at"), seq.soft_clipped(u, seq.query_span(u)).alias("clipped"))


@query(
    "q_flags",
    """
    SELECT o_orderkey, (o_orderkey & 16) <> 0 AS reverse, (o_orderkey & 2304) <> 0 AS not_primary, (o_orderkey & 1540) = 0 AND o_custkey % 60 >= 20 AS passes FROM orders""",
)
def flags(spark, sf_dir):
    f = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", seq.has_flag(f, "reverse").alias("reverse"), seq.has_flag(f, "secondary", "supplementary").alias("not_primary"), seq.read_passes(f, F.col("o_custkey") % 60).alias("passes"))


@query(
    "q_regions",
    """
    SELECT n_nationkey, '{HLA:' || n_name || '}' AS chrom_text, 'HLA:' || n_name AS chrom, n_nationkey * 10 + 1 AS start1, n_nationkey * 20 + 5 AS end1 FROM nation""",
)
def regions(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    text = seq.region_text(F.concat(F.lit("HLA:"), "n_name"), F.col("n_nationkey") * 10 + 1, F.col("n_nationkey") * 20 + 5)
    p = n.select("n_nationkey", F.regexp_extract(text, r"^\{.*\}", 0).alias("chrom_text"), seq.region(text).alias("r"))
    return p.select("n_nationkey", "chrom_text", "r.chrom", F.col("r.start1").cast("int").alias("start1"), F.col("r.end1").cast("int").alias("end1"))


@query("q_contigs", "SELECT n_nationkey, regexp_full_match(CASE WHEN n_nationkey % 3 = 0 THEN 'GL' || n_name WHEN n_nationkey % 3 = 1 THEN n_name || '_alt' ELSE n_name END, 'MT|chrM|GL.*|chrUn.*|chrEBV.*|HLA-.*|.*_random|.*_alt|.*_decoy') AS excluded FROM nation")
def contigs(spark, sf_dir):
    name = F.expr("CASE n_nationkey % 3 WHEN 0 THEN concat('GL', n_name) WHEN 1 THEN concat(n_name, '_alt') ELSE n_name END")
    return table(spark, sf_dir, "nation").select("n_nationkey", seq.excluded_contig(name).alias("excluded"))


@query(
    "q_phred",
    "SELECT l_orderkey, l_linenumber, round(pow(10, -l_quantity / 10), 10) AS prob, round(CASE WHEN l_discount = 0 THEN 255 ELSE -10 * log10(l_discount) END, 6) AS phred, regexp_replace(printf('%.3f', l_tax), '\\.?0+$', '') AS shown, least(l_discount * 10, 1 - l_discount * 10) AS folded FROM lineitem",
)
def phred(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")
    return l.select("l_orderkey", "l_linenumber", F.round(seq.phred_to_prob(F.col("l_quantity")), 10).alias("prob"), F.round(seq.prob_to_phred(F.col("l_discount")), 6).alias("phred"), seq.trimmed_number(F.col("l_tax")).alias("shown"), seq.folded(F.col("l_discount") * 10).alias("folded"))


@query(
    "q_kmer_quality",
    """
    WITH g AS (SELECT l_orderkey, list(l_quantity ORDER BY l_linenumber, l_partkey) AS q FROM lineitem GROUP BY l_orderkey)
    SELECT l_orderkey, len(list_filter(range(1, greatest(len(q) - 1, 1)), lambda i: floor(round(list_sum(list_transform(list_slice(q, i, i + 2), lambda x: pow(10, -x / 10))), 9)) = 0))::INTEGER AS ok FROM g""",
)
def kmer_quality(spark, sf_dir):
    g = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_quantity"))).alias("x"))
    q = F.transform("x", lambda v: v["l_quantity"])
    return g.select("l_orderkey", F.size(F.filter(seq.kmer_supported(q, 3), lambda v: v)).alias("ok"))


GRAPH = f"""
    WITH d AS (SELECT doc_id, {DNA} AS s FROM documents), e AS (SELECT doc_id, unnest(list_transform(range(1, length(s) - 10), lambda i: substr(s, i, 12))) AS w FROM d WHERE length(s) >= 12),
    x AS (SELECT doc_id, substr(w, 1, 11) AS a, substr(w, 2, 11) AS b FROM e),
    y AS (SELECT doc_id, least(a, {RC.format('a')}) AS src, least(b, {RC.format('b')}) AS dst, a <= {RC.format('a')} AS sp, b <= {RC.format('b')} AS dp FROM x),
    m AS (SELECT DISTINCT * FROM (SELECT * FROM y UNION ALL SELECT doc_id, dst, src, NOT dp, NOT sp FROM y))"""


@query(
    "q_graph_metrics",
    GRAPH
    + """,
    n AS (SELECT doc_id, src AS node, count(*) FILTER (sp) AS f, count(*) FILTER (NOT sp) AS r FROM m GROUP BY ALL)
    SELECT doc_id, count(*)::BIGINT AS nodes, (sum(f + r) // 2)::BIGINT AS edges, greatest(sum(f + r) // 2 - count(*) + 1, 0)::BIGINT AS cc, count(*) FILTER (f >= 2 OR r >= 2)::BIGINT AS bp,
        round(count(*) FILTER (f = 1 AND r = 1) / count(*), 6) AS unitig_ratio, max(greatest(f, r))::BIGINT AS max_degree FROM n GROUP BY doc_id""",
)
def graph_metrics(spark, sf_dir):
    return kgraph.metrics(kgraph.coded_edges(oriented(spark, sf_dir, 11), "doc_id"), ["doc_id"]).select("doc_id", "nodes", "edges", "cc", "bp", F.round("unitig_ratio", 6).alias("unitig_ratio"), "max_degree")


def oriented(spark, sf_dir, k):
    """Oriented edges of every document's graph."""
    ship(spark)
    return tablegraph.oriented_edges(kmers.canonical_words(dna(spark, sf_dir), "doc_id", "s", k + 1), "doc_id", k)


def _unitigs_sql(rounds: int = 16) -> str:
    hops = "".join(f"""
    r{j + 1} AS MATERIALIZED (SELECT a.doc_id, a.s, b.t, a.d + b.d AS d FROM r{j} a JOIN r{j} b ON a.doc_id = b.doc_id AND a.t = b.s),""" for j in range(rounds))
    return f"""
    WITH d AS (SELECT doc_id, {DNA} AS s FROM documents), w AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, length(s) - 10), lambda i: substr(s, i, 12))) AS w FROM d WHERE length(s) >= 12),
    e AS MATERIALIZED (SELECT doc_id, substr(w, 1, 11) AS u, substr(w, 2, 11) AS v FROM (SELECT doc_id, w FROM w UNION SELECT doc_id, {RC.format('w')} FROM w)),
    o AS (SELECT doc_id, u, any_value(v) AS v FROM e GROUP BY doc_id, u HAVING count(*) = 1), i AS (SELECT doc_id, v FROM e GROUP BY doc_id, v HAVING count(*) = 1),
    l AS MATERIALIZED (SELECT o.doc_id, u, o.v FROM o JOIN i ON o.doc_id = i.doc_id AND o.v = i.v WHERE o.v <> u AND o.v <> {RC.format('u')}),
    st AS (SELECT doc_id, u AS s FROM e UNION SELECT doc_id, v FROM e),
    r0 AS MATERIALIZED (SELECT st.doc_id, s, coalesce(l.v, s) AS t, (l.v IS NOT NULL)::INT AS d FROM st LEFT JOIN l ON st.doc_id = l.doc_id AND st.s = l.u),{hops}
    c AS (SELECT doc_id, count(*) AS n, arg_max(s, d) || substr(string_agg(substr(s, 11, 1), '' ORDER BY d DESC), 2) AS seq FROM r{rounds} r WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.doc_id = r.doc_id AND l.u = r.t) GROUP BY doc_id, t)
    SELECT doc_id, count(*)::BIGINT AS unitigs, max(n)::BIGINT AS longest, md5(string_agg(seq, ',' ORDER BY seq)) AS digest
    FROM (SELECT DISTINCT doc_id, n, least(seq, {RC.format('seq')}) AS seq FROM c) GROUP BY doc_id"""


@query("q_unitigs", _unitigs_sql())
def unitigs(spark, sf_dir):
    """Chains without branches of every document's graph; cycles, which are none, are told by q_graph_cycles."""
    ship(spark)
    units, _ = tablegraph.text_graphs(dna(spark, sf_dir), "doc_id", "s", 11)
    g = units.filter("own AND NOT ring").groupBy("doc_id").agg(F.count("*").alias("unitigs"), F.max("nodes").alias("longest"), F.sort_array(F.collect_list(tablegraph.canonical_seq(F.col("seq")))).alias("x"))
    return g.select("doc_id", "unitigs", "longest", F.md5(F.array_join("x", ",").cast("binary")).alias("digest"))


def ends(spark, sf_dir, k):
    return kmers.end_words(dna(spark, sf_dir), "doc_id", "s", k)


@query("q_tips")
def tips(spark, sf_dir):
    """Edges that stay when tips go, the ends of each text being anchors."""
    ship(spark)
    return tablegraph.texts_without_tips(dna(spark, sf_dir), "doc_id", "s", 11)


@query("q_graph_cycles")
def graph_cycles(spark, sf_dir):
    """Edges between chains that lie on cycles or between them, by document."""
    ship(spark)
    _, e = tablegraph.text_graphs(dna(spark, sf_dir), "doc_id", "s", 11, peel=True)
    left, _ = tablegraph.peeled(e, "doc_id")
    return left.groupBy("doc_id").agg(F.count("*").alias("edges"))


@query("q_walks")
def walks(spark, sf_dir):
    """Walks from the chain of each text's first k-mer to that of its last, and their bases."""
    k = 29
    ship(spark)
    units, e = tablegraph.text_graphs(dna(spark, sf_dir), "doc_id", "s", k)
    at = lambda c, name: units.join(words, "doc_id").filter(F.contains("seq", c)).select("doc_id", c, F.col("tail").alias(name)).distinct()  # noqa: E731  one chain holds a k-mer
    words = ends(spark, sf_dir, k).select("doc_id", *(kmers.letters(F.col(c), k).alias(c) for c in ("first", "last"))).distinct()
    own = words.join(at("first", "source"), ["doc_id", "first"]).join(at("last", "sink"), ["doc_id", "last"])
    found, _ = tablegraph.walks(e, checkpointed(own.select("doc_id", "source", "sink"), "ends"), "doc_id")
    found = checkpointed(found, "walks")
    bases = tablegraph.haplotypes(found, units, "doc_id", k).select("doc_id", "place", F.length("seq").alias("bases"), F.md5(F.col("seq").cast("binary")).alias("digest"))
    return found.select("doc_id", "place", F.size("path").alias("chains"), "limited").join(bases, ["doc_id", "place"])


@query(
    "q_tandem_repeats",
    f"""
    WITH d AS (SELECT doc_id, {DNA} AS s FROM documents),
    e AS (SELECT doc_id, p, unnest([i for i in range(1, length(s) - p + 1) if s[i] = s[i + p]]) AS i FROM d CROSS JOIN range(1, 7) AS t(p) WHERE length(s) > p),
    g AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, p ORDER BY i) AS run FROM e),
    r AS (SELECT doc_id, p, min(i) AS start, count(*) + p AS length FROM g GROUP BY doc_id, p, run HAVING count(*) + p >= 2.5 * p),
    m AS (SELECT r.*, substr(s, start, p) AS motif FROM r JOIN d USING (doc_id))
    SELECT doc_id, p::INT AS period, count(*)::BIGINT AS repeats, sum(length)::BIGINT AS bases, max(length)::INT AS longest, min(start - 1)::INT AS first
    FROM m WHERE NOT contains(substr(motif || motif, 2, (2 * p - 2)::BIGINT), motif) GROUP BY doc_id, p""",
)
def tandem_repeats(spark, sf_dir):
    """Runs of repeats by a table function in SQL."""
    ship(spark)
    sql.register(spark)
    return spark.sql(
        """
        SELECT doc_id, length(motif) AS period, count(*) AS repeats, sum(r.length) AS bases, max(r.length) AS longest, min(r.start) AS first
        FROM {dna}, LATERAL tandem_repeats(s, false) AS r GROUP BY doc_id, length(motif)""",
        dna=dna(spark, sf_dir),
    )


@query(
    "q_sql_functions",
    f"""
    WITH d AS (SELECT doc_id, {DNA} AS s FROM documents)
    SELECT doc_id, md5({RC.format('s')}) AS rc, md5(least(s, {RC.format('s')})) AS canon, round((length(replace(replace(s, 'A', ''), 'T', ''))) / nullif(length(s), 0), 6) AS gc,
        (length(s) % 7 + length(s) % 5)::INT AS clipped, (length(s) % 7 + 3)::INT AS matches, round(pow(10, -(length(s) % 40) / 10), 8) AS error FROM d""",
)
def sql_functions(spark, sf_dir):
    """The library's SQL functions, called in SQL."""
    sql.register(spark)
    return spark.sql(
        """
        SELECT doc_id, md5(CAST(reverse_complement(s) AS BINARY)) AS rc, md5(CAST(canonical_sequence(s) AS BINARY)) AS canon, round(gc_content(s), 6) AS gc,
            soft_clipped_bases(concat(length(s) % 7, 'S20M1I3D', length(s) % 5, 'S')) AS clipped, md_matches(concat(length(s) % 7, 'A2^CG1')) AS matches,
            round(phred_to_error(CAST(length(s) % 40 AS DOUBLE)), 8) AS error FROM {dna}""",
        dna=dna(spark, sf_dir),
    )


@query(
    "q_components",
    """
    WITH RECURSIVE e AS (SELECT DISTINCT o_custkey AS a, 100000000 + o_orderkey AS b FROM orders UNION SELECT s_nationkey - 100, s_suppkey + 50000000 FROM supplier), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
    r AS (SELECT a AS node, a AS reach FROM u UNION SELECT r.node, u.b FROM r JOIN u ON r.reach = u.a)
    SELECT node, min(reach) AS label FROM r GROUP BY node""",
)
def components(spark, sf_dir):
    """Stars of all sizes: orders by customer, suppliers by nation."""
    e = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("a"), (F.lit(100_000_000) + F.col("o_orderkey")).alias("b"))
    e = e.union(table(spark, sf_dir, "supplier").select(F.col("s_nationkey") - 100, F.lit(50_000_000) + F.col("s_suppkey"))).distinct()
    return rel.components(e, lambda df: checkpointed(df, "components"))


@query(
    "q_repeats",
    f"""
    WITH d AS (SELECT doc_id, {DNA} AS s FROM documents), k AS (SELECT doc_id, list_transform(range(1, length(s) - 11), lambda i: substr(s, i, 13)) AS w FROM d WHERE length(s) >= 13)
    SELECT doc_id, len(w) <> len(list_distinct(w)) AS has_repeat FROM k""",
)
def repeats(spark, sf_dir):
    ship(spark)
    return dna(spark, sf_dir).filter(F.length("s") >= 13).select("doc_id", kmers.repeated_udf(13)("s").alias("has_repeat"))


@query(
    "q_alt_kmers",
    """
    WITH p AS (SELECT a.p_partkey AS id, regexp_replace(a.p_name, '[^a-z]', '', 'g') AS x, regexp_replace(b.p_name, '[^a-z]', '', 'g') AS y FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1),
    k AS (SELECT id, list_transform(range(1, length(x) - 1), lambda i: substr(x, i, 3)) AS kx, list_transform(range(1, length(y) - 1), lambda i: substr(y, i, 3)) AS ky FROM p)
    SELECT id, len(list_filter(list_distinct(ky), lambda w: NOT list_contains(kx, w)))::INTEGER AS n_new FROM k""",
)
def alt_kmers(spark, sf_dir):
    clean = lambda c: F.regexp_replace(c, "[^a-z]", "")
    k = pairs(spark, sf_dir).select("id", seq.kmers(clean("x"), 3).alias("kx"), seq.kmers(clean("y"), 3).alias("ky"))
    return k.select("id", F.size(F.array_except("ky", "kx")).alias("n_new"))


@query(
    "q_parsimony",
    """
    SELECT p_partkey, 100 + p_size % 4 + (p_size % 3 > 0)::INT AS start, CASE WHEN p_size % 3 > 0 THEN repeat('C', p_size % 3) ELSE 'A' END AS ref,
        CASE WHEN p_size % 3 > 0 THEN '' ELSE 'A' END || repeat('G', p_size % 5) || 'T' AS alt FROM part""",
)
def parsimony(spark, sf_dir):
    """Alleles with common ends, trimmed to the least form: the SQL states that form."""
    p = table(spark, sf_dir, "part")
    lead, tail = "repeat('T', p_size % 4)", "'GGA'"
    ref = F.expr(f"concat({lead}, 'A', repeat('C', p_size % 3), {tail})")
    alt = F.expr(f"concat({lead}, 'A', repeat('G', p_size % 5), 'T', {tail})")
    t = p.select("p_partkey", seq.parsimony(ref, F.array(alt), F.lit(100)).alias("t"))
    return t.select("p_partkey", F.col("t.start").alias("start"), F.col("t.ref").alias("ref"), F.col("t.alts")[0].alias("alt"))


@query(
    "q_parsimony_multi",
    """
    SELECT p_partkey, (100 + p_size % 4)::INT AS start, 'A' || repeat('C', p_size % 3 + 1) AS ref, ['A' || repeat('G', p_size % 5) || 'T', 'A', 'AC' || repeat('C', p_size % 3 + 1)] AS alts FROM part""",
)
def parsimony_multi(spark, sf_dir):
    """Three ALTs of one site, an insertion, a deletion and a substitution: only what all share is trimmed."""
    p = table(spark, sf_dir, "part")
    ends = "concat(repeat('T', p_size % 4), {0}, 'GGA')"
    made = lambda x: F.expr(ends.format(x))
    alts = F.array(made("concat('A', repeat('G', p_size % 5), 'T')"), made("'A'"), made("concat('AC', repeat('C', p_size % 3 + 1))"))
    t = p.select("p_partkey", seq.parsimony(made("concat('A', repeat('C', p_size % 3 + 1))"), alts, F.lit(100)).alias("t"))
    return t.select("p_partkey", F.col("t.start").alias("start"), F.col("t.ref").alias("ref"), F.col("t.alts").alias("alts"))


@query("q_best_haplotypes")
def best_haplotypes(spark, sf_dir):
    """Reads of 80 bases from each text with one base changed, and whether the text (0) or the changed one (1) fits each best."""
    ship(spark)
    d = dna(spark, sf_dir).filter("length(s) >= 200").withColumn("t", F.expr("concat(substr(s, 1, 100), translate(substr(s, 101, 1), 'ACGT', 'CGTA'), substr(s, 102))"))
    haps = d.select("doc_id", F.posexplode(F.array("s", "t")).alias("hap", "seq"))
    # A lambda would take in the text's expression, and so make the text anew for each read.
    reads = d.select("doc_id", "t", F.explode(F.expr("sequence(0, int((length(s) - 80) / 50))")).alias("read")).select("doc_id", "read", F.expr("substr(t, 50 * read + 1, 80)").alias("seq"))
    return seeds.best_haplotypes(reads, haps, "doc_id").groupBy("doc_id").agg(F.count("*").alias("reads"), F.count_if(F.col("hap") == 1).alias("changed"))
