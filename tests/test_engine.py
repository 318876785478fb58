import datetime as dt
import math
import os
import random
import tarfile

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from strandloom.functions import repeats, seq, stats
from strandloom.operators import assembler, calling, diagnostics, evidence, kgraph, probes
from strandloom.operators import relational as rel
from strandloom.plans import catalog
from strandloom.sources import alignments, sinks, text
from strandloom.streaming import store

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def norm(v):
    if isinstance(v, float):
        return round(v, 4) + 0.0
    return [norm(x) for x in v] if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    cursor = con.execute(catalog.ORACLES[name])
    names = [d[0] for d in cursor.description]
    got = catalog.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(names)
    assert sorted(repr(norm([r[n] for n in names])) for r in got.collect()) == sorted(repr(norm(list(r))) for r in cursor.fetchall())


def test_interval_join_equals_brute_force(spark):
    random.seed(1)
    a = [(i, "c", s := random.randrange(5000), s + random.randrange(900)) for i in range(150)]
    b = [(i, "c", s := random.randrange(5000), s + random.randrange(900)) for i in range(150)]
    left = spark.createDataFrame(a, "i long, chrom string, s long, e long")
    right = spark.createDataFrame(b, "j long, chrom string, p long, q long")
    want = sorted((x[0], y[0]) for x in a for y in b if x[2] <= y[3] and y[2] <= x[3])
    got = rel.interval_join(left, right, ["chrom"], ("s", "e"), ("p", "q"))
    assert sorted((r.i, r.j) for r in got.collect()) == want
    semi = rel.interval_join(left, right, ["chrom"], ("s", "e"), ("p", "q"), "left_semi")
    assert sorted(r.i for r in semi.collect()) == sorted({i for i, _ in want})


@pytest.mark.parametrize(
    "haps, want",
    [
        (["ATCG", "AGCG"], [(101, "T", {"G": [1]})]),
        (["ATCG", "AG"], [(100, "ATC", {"A": [1]})]),
        (["ATGTGC", "ACGTGC", "AGC", "ATGTAC"], [(101, "TGTG", {"CGTG": [1], "G": [2], "TGTA": [3]})]),
        (["ATCG", "ATAACG"], [(101, "T", {"TAA": [1]})]),
        (["ATCG", "AAAG"], [(101, "TC", {"AA": [1]})]),
        (["ATCG", "AGCG", "AACG", "ACG"], [(100, "AT", {"A": [3], "AA": [2], "AG": [1]})]),
    ],
)
def test_extraction(haps, want):
    assert [(v.pos, v.ref, v.alts) for v in calling.extract(haps, 100)] == want


def test_assembly_and_genotyping_of_three_variants():
    random.seed(3)
    ref = "".join(random.choice("ACGT") for _ in range(1001))
    one = ref[:400] + ("A" if ref[400] != "A" else "C") + ref[401:]
    both, long = one[:600] + one[603:], ref[:500] + "GATTACAGATCC" + ref[500:]
    reads = []
    for s, haps in (("ctrl", [ref, both]), ("case", [ref, both, long])):
        for k in range(330):
            h = random.choice(haps)
            p = random.randrange(len(h) - 100)
            r = "".join(random.choice("ACGT") if random.random() < 0.002 else x for x in h[p : p + 100])
            reads.append({"seq": r, "quals": [35] * 100, "qname": f"{s}{k}", "sample": s, "role": s, "pos": p})
    found = assembler.assemble(ref, reads, range(25, 102, 6))
    records = [v for w in found for v in calling.extract(w.haplotypes, 1 + w.offset)]
    kinds = {calling.core_kind(v.ref, a) for v in records for a in v.alts}
    assert kinds == {"SNV", "DEL", "INS"} and len(records) == 3
    rows = calling.genotype(found[0].haplotypes, calling.extract(found[0].haplotypes, 1 + found[0].offset), reads)
    alt = {(records[r["record"]].ref, r["sample"]) for r in rows if r["allele"]}
    insertion = next(v.ref for v in records if any(calling.core_kind(v.ref, a) == "INS" for a in v.alts))
    assert (insertion, "case") in alt and (insertion, "ctrl") not in alt


def test_cycles_and_repeats_are_refused():
    assert assembler.has_near_repeat("ACGTTGCATCACGTTGCATC", 10, 2) and not assembler.has_near_repeat("ACGTTGCATCAGGA", 11, 0)
    g = assembler.Graph(5, "ACGTACGTACGTAC", [])
    assert g.cyclic("ACGTA")


EVIDENCE = "window_id long, chrom string, pos long, ref string, alts array<string>, sample string, allele int, qname string, strand string, base_qual int, map_qual int, aln_score double, folded_pos double, insert_size long, aln_start long, ref_nm int, own_hap_nm int, hap_id int, soft_clipped boolean, proper_pair boolean, n_haps int, path_cv double"


def test_calls_and_records(spark):
    rows = []
    for s, n_alt in (("ctrl", 0), ("case", 10)):
        for i in range(30):
            alt = i < n_alt
            rows.append((0, "chr1", 101, "A", ["T"], s, int(alt), f"{s}{i}", "FWD" if i % 2 else "REV", 30, 60, 100.0, 0.25, 300, 1000 + 7 * i, int(alt) + 4, 2 * int(alt) + 1, (1 + i % 2) * int(alt), False, True, 3, 0.25))
    rows.append(rows[0])  # a repeated name counts once
    ev = spark.createDataFrame(rows, EVIDENCE)
    samples = spark.createDataFrame([("ctrl", "CTRL", 0), ("case", "CASE", 1)], "sample string, role string, idx int")
    coverage = samples.select(F.lit(0).alias("window_id"), "sample", F.lit(15.0).alias("window_cov"))
    calls = evidence.sample_calls(ev, coverage)
    case = calls.filter("sample = 'case'").first()
    assert (case.ad, case.dp, case.gt, case.sdfc) == ([20, 10], 30, "0/1", 2.0) and case.asmd == 1.0 and case.cmlod[0] > 10
    # Both sides by their own haplotype; two equally frequent haplotypes of three.
    assert case.ahdd == 2.0 and abs(case.hse - 1 / math.log2(3)) < 1e-9
    sites = evidence.best_by_site(evidence.site_calls(calls, samples))
    line = sites.select(evidence.record_text()).first()[0].split("\t")
    assert line[:5] == ["chr1", "101", ".", "A", "T"] and line[7].startswith("CASE;TYPE=SNV;LENGTH=1") and line[8] == evidence.FORMAT
    fields = dict(zip(line[8].split(":"), line[10].split(":")))
    assert fields["AD"] == "20,10" and fields["RMQ"] == "60.0,60.0" and fields["FLD"] == "0.0" and fields["PDCV"] == "0.2500"


def test_expressions(spark):
    one = spark.range(1)
    get = lambda *c: one.select(*c).first()
    u = seq.cigar_units(F.lit("3S4M2I3M2D2M"))
    assert list(get(seq.reference_span(u), seq.query_span(u), seq.soft_clip_penalty(u))) == [11, 14, 12]
    assert [get(seq.query_position(seq.cigar_units(F.lit("3M2D3M")), F.lit(i)))[0] for i in (2, 3, 4, 5, 6)] == [2, 3, 3, 3, 4]
    assert get(seq.edit_distance(seq.cigar_units(F.lit("2M2I3M")), F.lit("ACGGTAT"), F.lit("ACTAA")))[0] == 3
    assert get(seq.md_mismatches(F.lit("3A2^CC1T"), F.lit(100)))[0] == [103, 109]
    assert [tuple(c) for c in get(seq.soft_clips(seq.cigar_units(F.lit("2S5M3S")), F.lit(10)))[0]] == [(2, 0, 10), (3, 7, 15)]
    r = [tuple(get(seq.region(F.lit(t)))[0]) for t in ("chr1", "chr1:5-9", "chr1:5-", "chr1:-9", "chr1:7", "{HLA:a:1}:3-4")]
    assert r == [("chr1", None, None), ("chr1", 5, 9), ("chr1", 5, None), ("chr1", None, 9), ("chr1", 7, 7), ("HLA:a:1", 3, 4)]
    p = get(seq.parsimony(F.lit("CATG"), F.array(F.lit("CTTG"), F.lit("CG")), F.lit(10)))[0]
    assert (p.start, p.ref, p.alts) == (10, "CAT", ["CTT", "C"])
    assert get(seq.kmers(F.lit("ACG"), 5))[0] == [] and get(seq.max_homopolymer(F.lit("AACCCGTTT")))[0] == 3


def test_repeats():
    r = list(repeats.tandem_repeats("ACACACACAC"))
    assert r == [{"motif": "AC", "start": 0, "length": 10, "substitutions": 0}]
    assert repeats.low_complexity("A" * 60) > 1 and repeats.low_complexity("ACGTTGCATCAGGATTC") < 0.1
    assert repeats.complexity("ACGT" * 30, "ACGT" * 14 + "ACAGT" + "ACGT" * 15, 58, 58, 1, 2)["tr_period"] > 0


def test_graph_metrics_of_a_bubble(spark):
    d = spark.createDataFrame([(1, "ACGTTGCATCAGGATTCAGCA"), (1, "ACGTTGCATCTGGATTCAGCA")], "id long, s string")
    m = kgraph.metrics(kgraph.edges(d, "id", "s", 5), ["id"]).first()
    assert (m.cc, m.bp) == (1, 2)


def test_sources_and_sinks(spark, tmp_path):
    rows = [("r1", 99, "chr1", 11, 60, "4M", "chr1", 31, 24, "ACGT", [30, 31, 32, 33], {"MD": "4"}), ("r2", 4, "*", 0, 0, "*", "*", 0, 0, "AC", None, {})]
    alignments.write_bam(str(tmp_path / "x.bam"), [("chr1", 1000)], rows)
    spark.dataSource.register(alignments.BamDataSource)
    got = spark.read.format("bam").load(str(tmp_path / "x.bam"))
    assert [tuple(r) for r in got.collect()] == rows
    lines = [r[0] for r in got.select(sinks.sam_line()).collect()]
    assert lines[0] == "r1\t99\tchr1\t11\t60\t4M\t=\t31\t24\tACGT\t?@AB\tMD:Z:4"
    (tmp_path / "x.sam").write_text("@SQ\tSN:chr1\tLN:1000\n@RG\tID:a\tSM:s1\n" + "\n".join(lines) + "\n")
    back = alignments.sam(spark, str(tmp_path / "x.sam"))
    assert [tuple(r)[:-1] for r in back.collect()] == rows and back.first().end == 14
    assert alignments.sample_name(spark, str(tmp_path / "x.sam")).first().sm == "s1" and alignments.has_md(back)
    (tmp_path / "x.bed").write_text("# c\nchr1\t5\t9\n\nchr2\t1\t2\n")
    assert [tuple(r) for r in text.bed(spark, str(tmp_path / "x.bed")).collect()] == [("chr1", 5, 9), ("chr2", 1, 2)]
    (tmp_path / "bad.bed").write_text("chr1\t5\n")
    with pytest.raises(Exception, match="not three columns"):
        text.bed(spark, str(tmp_path / "bad.bed")).collect()
    (tmp_path / "x.fa").write_text(">chr1 d\nACGTn\nacgtR\n>chr2\nGGG\n")
    chunks = text.fasta(spark, str(tmp_path / "x.fa"))
    regions = spark.createDataFrame([("chr1", 3, 8), ("chr2", 1, 3)], "chrom string, start1 long, end1 long")
    assert {r.chrom: r.ref_seq for r in text.fetch(chunks, regions).collect()} == {"chr1": "GTNACG", "chr2": "GGG"}
    (tmp_path / "x.vcf").write_text("##x\n#CHROM\nchr1\t10\t.\tACA\tACT,A\t50\tPASS\tDP=9\tGT:AD:DP\t0/1:5,3,1:9\nchr1\t20\t.\tA\t<DEL>\t.\tPASS\tSVTYPE=DEL;SVLEN=-60\n")
    v = text.vcf(spark, str(tmp_path / "x.vcf"))
    assert [(r.pos, r.ref, r.alt, r.kind, r["size"]) for r in text.small_truth(v).collect()] == [(12, "A", "T", "SNV", 1), (10, "ACA", "A", "DEL", -2)]
    assert [(r.alt, r["size"]) for r in text.large_truth(v.filter("alt = '<DEL>'")).collect()] == [("<DEL>", -60)]
    assert [(r.ad, r.dp) for r in text.allele_depths(v).collect()] == [(3, 9), (1, 9)]
    (tmp_path / "x.log").write_text("noise\nINFO chr1:5-9 done with MISSING\n")
    assert tuple(text.window_statuses(spark, str(tmp_path / "x.log")).first()) == ("chr1", 5, 9, "MISSING")
    specs = spark.createDataFrame([("a/b.bam:case",), ("s3://x/y.bam",)], "s string").select(text.input_spec(F.col("s")).alias("x")).collect()
    assert [tuple(r.x) for r in specs] == [("a/b.bam", "case"), ("s3://x/y.bam", "control")]
    header = sinks.vcf_header([("chr1", 1000)], ["s1"], False)
    assert header[0] == "##fileformat=VCFv4.5" and not any("ID=SHARED" in h for h in header) and header[-1].endswith("FORMAT\ts1")


def test_bam_parts_regions_and_columns(spark, tmp_path):
    random.seed(21)
    rows, pos = [], 1
    for i in range(3000):
        n, pos = random.randrange(1, 300), pos + random.randrange(50)
        chrom = ("chr1", pos) if pos < 40_000 else ("chr2", pos - 39_999)
        rows.append((f"read{i}", 1024 * (i % 7 == 0), *chrom, random.randrange(60), f"{n}M", "chr1", 31, 24, "".join(random.choice("ACGT") for _ in range(n)), [random.randrange(40) for _ in range(n)], {"MD": str(n)}))
    path = str(tmp_path / "x.bam")
    alignments.write_bam(path, [("chr1", 100_000), ("chr2", 100_000)], rows, "@HD\tVN:1.6\tSO:coordinate\n", block=5000)
    for split in (10_007, 1 << 20):
        got = alignments.bam(spark, path, split=split).collect()
        assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, rows))
    some = alignments.bam(spark, path, ("pos", "qname"), [("chr2", 100, 2000), ("chr9", 1, 5)], 20, 0x400, split=30_000)
    assert some.columns == ["qname", "pos"]
    want = sorted((r[0], r[3]) for r in rows if r[2] == "chr2" and r[3] <= 2000 and r[3] + len(r[9]) > 100 and r[4] >= 20 and not r[1])
    assert sorted(map(tuple, some.collect())) == want and want
    spark.dataSource.register(alignments.BamDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    found = spark.read.format("bam").option("pushdown", "true").load(path).filter("mapq >= 30 AND chrom = 'chr2' AND pos > 50")
    assert found.count() == sum(r[4] >= 30 and r[2] == "chr2" and r[3] > 50 for r in rows)
    data = (tmp_path / "x.bam").read_bytes()
    (tmp_path / "cut.bam").write_bytes(data[:-40])
    with pytest.raises(ValueError, match="does not end"):
        alignments.Bam(str(tmp_path / "cut.bam"))
    (tmp_path / "no.bam").write_bytes(b"text")
    with pytest.raises(ValueError):
        alignments.Bam(str(tmp_path / "no.bam"))


def test_diagnostics(spark):
    base = dict.fromkeys([*(f"n_surviving_{s}" for s in diagnostics.SURVIVAL), *diagnostics.FLAGS, "is_geno_has_alt_support", "is_geno_no_overlap", "is_msa_exact_match", "is_msa_shifted", "is_msa_subsumed", "is_traversal_limited", "n_geno_reassigned_to_ref", "n_geno_reassigned_to_wrong_alt", "n_expected_alt_kmers"], 0)
    cases = {"survived": {"is_geno_has_alt_support": 1}, "geno_zero_alt_reads": {"is_msa_exact_match": 1}, "msa_not_extracted": {"hap_indices": "1"}, "no_path": {"n_surviving_tips": 3}, "pruned_at_tips": {"n_surviving_compress2": 2}, "pruned_at_lowcov1": {"n_surviving_build": 2}, "pruned_at_build": {"n_expected_alt_kmers": 4}, "graph_has_cycle": {"is_graph_cycle": 1}, "not_processed": {}}
    rows = [{"probe_id": i // 2, "kmer_size": 25 + i, "hap_indices": ".", **base, **c} for i, c in enumerate(cases.values())]
    df = spark.createDataFrame(rows)
    assert [r[0] for r in df.orderBy("kmer_size").select(diagnostics.lost_at()).collect()] == list(cases)
    best = {r.probe_id: r.lost_at_stage for r in diagnostics.best_attempts(df).collect()}
    assert best == {0: "survived", 1: "msa_not_extracted", 2: "pruned_at_tips", 3: "pruned_at_build", 4: "not_processed"}
    probes = spark.createDataFrame([(4, "chr1", 700)], "probe_id long, chrom string, pos long")
    windows = spark.createDataFrame([("chr1", 1, 1001, "SKIPPED_INACTIVE_REGION"), ("chr1", 601, 1601, "SKIPPED_NONLY_REF_BASES")], "chrom string, win_start long, win_end long, win_status string")
    status = diagnostics.windows_of(probes, windows)
    assert status.first().win_status == "SKIPPED_INACTIVE_REGION"
    assert {r.lost_at_stage for r in diagnostics.reclassified(diagnostics.best_attempts(df), status).collect()} >= {"not_processed:inactive"}


HOUR = dt.timedelta(hours=1)


def test_streams_give_out_what_the_watermark_has_passed(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    rows = [(i, start + dt.timedelta(minutes=7 * i), i % 3, float(i * 37 % 11)) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, ts timestamp, k long, v double")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    passed = rows[-1][1] - dt.timedelta(minutes=1)
    best = store.keep_best(stream, "ts", ["k"], "v", ["id"], "2 hours", "1 minute")
    want = {tuple(r) for r in store.keep_best(df, "ts", ["k"], "v", ["id"], "2 hours", "1 minute").collect() if r.start + 2 * HOUR <= passed}
    seen: list = []
    assert {tuple(r) for r in store.run_available(best, "a", listener=seen).collect()} == want and len(want) > 20
    assert sum(b["rows"] for b in seen) == 200 and all(b["late"] == 0 for b in seen)
    for name, f in {"b": lambda d: store.sliding_counts(d, "ts", ["k"], "2 hours", "1 hour", "1 minute"), "c": lambda d: store.sessions(d, "ts", ["k"], "15 minutes", "1 minute")}.items():
        want = {tuple(r) for r in f(df).collect() if r.end <= passed}
        assert {tuple(r) for r in store.run_available(f(stream), name).collect()} == want and want
        assert {tuple(r) for r in store.run_available(f(stream), name, "complete").collect()} == {tuple(r) for r in f(df).collect()}


def test_state_with_timers_goes_on_after_a_stop(spark, tmp_path):
    """Rows come in three files; the query stops after each and goes on: every bucket is given out once."""
    start = dt.datetime(2024, 1, 1)
    schema = "id long, ts timestamp, k long, v double"
    rows = [(i, start + dt.timedelta(minutes=7 * i), i % 3, None if i % 10 == 3 else float(i * 37 % 11)) for i in range(240)]
    given, folder = [], f"file://{tmp_path}/state"
    for n in range(3):
        spark.createDataFrame(rows[80 * n : 80 * n + 80], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        best = store.keep_best_with_timers(stream, "ts", ["k"], "v", ["id"], "2 hours", "1 minute")
        given.append([tuple(r) for r in store.run_available(best, "timers", folder=folder).collect()])
    passed = rows[-1][1] - dt.timedelta(minutes=1)
    df = spark.createDataFrame(rows, schema)
    want = {tuple(r) for r in store.keep_best(df, "ts", ["k"], "v", ["id"], "2 hours", "1 minute").collect() if r.start + 2 * HOUR <= passed}
    assert len(given[2]) == len(set(given[2])) and set(given[2]) == want
    assert set(given[0]) < set(given[1]) < set(given[2]) and given[0]


def test_state_is_read_and_written_once_for_many_keys(spark, tmp_path):
    """Keys share states, so there are fewer than keys; nulls, numbers beyond a double's and values that are none stay exact."""
    start, big = dt.datetime(2024, 1, 1), 2**53
    schema = "id long, ts timestamp, k long, v double"
    values = [None, float("nan"), 1.0, 2.0]
    rows = [(None if i % 50 == 7 else big + i, start + dt.timedelta(seconds=i), None if i % 31 == 0 else big + i % 90, values[i * 7 % 4] if i % 3 else 2.0) for i in range(900)]
    df = spark.createDataFrame([*rows, (0, start + 9 * HOUR, 0, 0.0)], schema)
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    seen: list = []
    got = store.run_available(store.keep_best_with_timers(stream, "ts", ["k"], "v", ["id"], "2 hours", "1 minute", parts=4), "parts", listener=seen)
    want = store.keep_best(df, "ts", ["k"], "v", ["id"], "2 hours", "1 minute").filter(F.col("start") == F.lit(start))
    text = lambda d: sorted(str(tuple(r)) for r in d.select("start", "k", "v", "id").collect())
    assert text(got) == text(want) and len(text(got)) == 91
    assert max(b["held"] for b in seen) < 91


def test_late_rows_are_dropped_and_counted(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    schema = "id long, ts timestamp, k long, v double"
    batches = [[(1, start, 0, 1.0)], [(2, start + 10 * HOUR, 0, 2.0)], [(6, start + 10.2 * HOUR, 0, 0.5)], [(3, start, 0, 9.0), (4, start + 10 * HOUR, 0, 5.0)], [(5, start + 30 * HOUR, 0, 1.0)]]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "tmp" / str(k)))
        (tmp_path / "in").mkdir(exist_ok=True)
        part = next((tmp_path / "tmp" / str(k)).glob("*.parquet"))
        part.rename(tmp_path / "in" / f"{k}.parquet")
        os.utime(tmp_path / "in" / f"{k}.parquet", (1_700_000_000 + k, 1_700_000_000 + k))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    seen: list = []
    out = store.run_available(store.keep_best(stream, "ts", ["k"], "v", ["id"], "1 hour", "1 hour"), "late", listener=seen)
    assert sorted((r.id, r.v) for r in out.collect()) == [(1, 1.0), (4, 5.0)]
    assert sum(b["late"] for b in seen) == 1 and max(b["batch"] for b in seen) >= 3


def test_changes_of_reads(spark):
    schema = "window_id long, sample string, pos long, units array<struct<len:int,op:string>>, md string, quals array<int>"
    u = lambda *x: [{"len": n, "op": o} for n, o in x]
    q = [30] * 30
    rows = [
        (1, "a", 100, u((10, "M")), "3A6", q), (1, "a", 100, u((10, "M")), "3A6", [30, 30, 30, 5] + q), (1, "a", 90, u((4, "S"), (5, "M"), (2, "I"), (5, "M")), "10", q),
        (1, "a", 100, u((3, "M"), (2, "D"), (4, "M"), (3, "S")), "3^AC4", q), (1, "a", 101, u((1, "X"), (4, "=")), None, q),
    ]
    got = sorted((r.kind, r.pos) for r in rel.read_changes(spark.createDataFrame(rows, schema)).collect())
    assert got == [("deletion", 105), ("insertion", 95), ("mismatch", 102), ("mismatch", 103), ("softclip", 90), ("softclip", 109)]
    twice = spark.createDataFrame([rows[0], rows[0]], schema)
    w = spark.createDataFrame([(1,), (2,)], "window_id long")
    assert [r.window_id for r in rel.active_windows(w, rel.read_changes(twice)).collect()] == [1]
    # Two reads that show different kinds at one place are no evidence.
    mixed = spark.createDataFrame([(1, "a", 100, u((3, "S"), (5, "M")), "5", q), (1, "a", 98, u((2, "M"), (1, "I"), (3, "M")), "5", q)], schema)
    assert rel.active_windows(w, rel.read_changes(mixed)).count() == 0


def test_stages_in_order_of_depth(spark):
    rank = {s: i for i, s in enumerate(diagnostics.STAGES)}
    assert rank["not_processed"] == 0 < rank["not_processed:inactive"] < rank["variant_in_anchor"] < rank["no_anchor"] < rank["short_anchor"] < rank["graph_has_cycle"] < rank["graph_too_complex"]
    assert rank["bfs_exhausted"] < rank["no_path"] and rank["geno_no_overlap"] < rank["geno_zero_alt_reads"] < rank["geno_reads_reassigned"] < rank["survived"]
    got = spark.createDataFrame([(s,) for s in [*diagnostics.STAGES, "else"]], "s string").select(diagnostics.depth(F.col("s"))).collect()
    assert [r[0] for r in got] == [*range(len(rank)), 0]


def test_expected_log_factorials_equal_sums():
    for rate in (0.0, 1e-12, 0.01, 0.7, 5.0, 29.9, 30.1, 250.0, 399.0, 401.0, 2000.0):
        c = np.arange(1, 6000)
        log_fact = np.cumsum(np.log(c))
        want = float((np.exp(c * math.log(rate) - rate - log_fact) * log_fact).sum()) if rate else 0.0
        assert abs(stats.expected_log_factorial(rate) - want) < 1e-6 * max(1.0, want)
    assert stats.expected_score(100, 4) == pytest.approx(256 * stats.expected_log_factorial(100 / 256))
    assert stats.expected_score(100, 4, 0.4) > stats.expected_score(100, 4)


def test_low_complexity_scores_of_both_forms_agree(spark):
    texts = ["A" * 50, "ACGT" * 12, "ACGTTGCATCAGGATTC", "ACNNGT", "", "AC"]
    d = spark.createDataFrame(list(enumerate(texts)), "id long, s string")
    got = {r.id: r.score for r in kgraph.longdust(d, "id", "s", 4).collect()}
    assert got == {i: pytest.approx(repeats.low_complexity(t, 4), abs=1e-9) for i, t in enumerate(texts)}


def test_scores_of_a_model(spark):
    rows = [(1, "A", ["T"], True, [0.05, 0.95]), (2, "A", ["T"], False, [0.95, 0.05]), (3, "A", ["T"], True, [0.2, 0.8]), (4, "A", ["AT"], True, [0.08, 0.92]), (5, "A", ["AT"], True, [0.04, 0.96])]
    d = spark.createDataFrame(rows, "id long, ref string, alts array<string>, passing boolean, p array<double>").withColumn("filter", F.lit("."))
    got = {r.id: (r.filter, round(r.qual, 2)) for r in sinks.scored(d, F.col("passing"), F.col("p")).collect()}
    assert got == {1: ("PASS", 13.01), 2: (".", 13.01), 3: (".", 6.99), 4: (".", 10.97), 5: ("PASS", 13.98)}


def test_graph_texts_and_reports(spark, tmp_path):
    nodes = spark.createDataFrame([(1, "n1", "ACG", "REF", 9.0), (1, "n2", "CGT", "CASE", 2.0)], "g long, node string, seq string, label string, cov double")
    edges = spark.createDataFrame([(1, "n1", "n2", True, False)], "g long, src string, dst string, src_plus boolean, dst_plus boolean")
    dot = sinks.dot_graph(nodes, edges, "g").first().dot
    assert dot.splitlines()[0] == "strict digraph G {" and '"n1" -> "n2" [taillabel="+" headlabel="-"];' in dot and dot.index("n2\" [fill") < dot.index("->")
    walks = spark.createDataFrame([(1, 0, 0, "n1"), (1, 0, 1, "n2"), (1, 65, 0, "n2"), (1, 65, 1, "n1")], "g long, walk int, step int, node string")
    layered = sinks.dot_graph(nodes, edges, "g", walks).first().dot.splitlines()
    assert layered[-3:] == ['"n1" -> "n2" [color="black" penwidth=2];', '"n2" -> "n1" [color="0.0156 0.9 0.8" penwidth=2];', "}"]
    texts = spark.createDataFrame([(f"g{i}.dot", f"text {i}") for i in range(7)] + [("none.dot", None)], "name string, text string").repartition(3)
    shards = sinks.write_archive(texts, str(tmp_path / "shards")).collect()
    found = {}
    for r in shards:
        with tarfile.open(r.path) as tar:
            found |= {m.name: tar.extractfile(m).read().decode() for m in tar.getmembers()}
    assert found == {r.name: r.text or "" for r in texts.collect()} and sum(r.n for r in shards) == 8
    paths = spark.createDataFrame([(1, "p", ["n1+", "n2-"])], "g long, name string, steps array<string>")
    assert sinks.gfa(nodes, edges, paths, "g", 3).first().gfa.splitlines() == ["H\tVN:Z:1.0", "S\tn1\tACG", "S\tn2\tCGT", "L\tn1\t+\tn2\t-\t2M", "P\tp\tn1+,n2-\t*"]
    rows = spark.createDataFrame([(1, 2, "b", "AC-"), (1, 1, "a", "ACG")], "g long, ord int, name string, seq string")
    assert sinks.fasta_text(rows, "g").first().fasta == ">a\nACG\n>b\nAC-"
    probes_ = spark.createDataFrame([(1,), (2,)], "probe_id long")
    sinks.write_tsv(sinks.probe_records(probes_, spark.createDataFrame([(1, 5)], "probe_id long, n int")).orderBy("probe_id").coalesce(1), str(tmp_path / "t"))
    assert "".join(p.read_text() for p in (tmp_path / "t").glob("part*")) == "probe_id\tn\n1\t5\n2\t.\n"
    sites = spark.createDataFrame([("chr2", 5, "A", ["T"]), ("chr10", 3, "C", ["G"]), ("chr2", 1, "G", ["C"])], "chrom string, pos long, ref string, alts array<string>")
    full = sites.select("*", F.lit(True).alias("cc"), F.lit("CASE").alias("state"), F.array(F.lit("SNV")).alias("kinds"), F.array(F.lit(1)).alias("sizes"), F.lit(3.0).alias("qual"), F.array(F.lit("0/1")).alias("columns"))
    sinks.write_vcf(full, sinks.vcf_header([("chr2", 9), ("chr10", 9)], ["s"], True, day=dt.date(2024, 1, 2)), ["chr2", "chr10"], str(tmp_path / "v"))
    text_ = "".join(p.read_text() for p in sorted((tmp_path / "v").glob("part*")))
    assert [x.split("\t")[:2] for x in text_.splitlines() if x[0] != "#"] == [["chr2", "1"], ["chr2", "5"], ["chr10", "3"]] and text_.startswith("##fileformat")


def test_loaders_of_reports(spark, tmp_path):
    write = lambda name, body: ((tmp_path / name).write_text(body), str(tmp_path / name))[1]
    log = write("a.log", "Assembled 900bp path sequence for chr1:1-1001 comp=0 with k=25\nAssembled 90bp path sequence for chr1:1-1001 comp=2 with k=31\nAssembled 9bp path sequence for chr2:1-9 comp=0 with k=13\nGenotyped 3 variant(s) for window chr1:1-1001\n")
    assert [(r.chrom, r.win_end, r.k, r.comps) for r in text.genotyped_windows(spark, log).collect()] == [("chr1", 1001, 31, [0, 2])]
    dot = write("g.dot", 'strict digraph G {\n"n1" [fillcolor="steelblue" style="filled" label="ACG" coverage=9];\n"n1" -> "n2" [taillabel="+"];\n}')
    assert [(r.node, r.colour, r.coverage) for r in text.dot_nodes(spark, dot).collect()] == [("n1", "steelblue", 9)]
    msa = write("m.fa", ">ref\nACG-T\n>h1\n--GAT\n>h2\nACG--\n")
    r = text.msa(spark, msa).first()
    assert (r.n_haps, r.ref_length, r.lead_gap, r.tail_gap) == (3, 4, 2, 2)
    beds = [write("low.bed", "#x\nchr1\t5\t9\tL1\nchr3\t1\t2\n"), write("b.txt", "track t\nchr1\t7\t3\nchr1\t1\t4\tskip\n")]
    got = text.annotations(spark, beds, ["chr1"], ("skip",)).collect()
    assert [(r.source, r.chrom, r.start, r.end, r.name) for r in got] == [("low", "chr1", 5, 9, "L1")]
    table = text.commented_tsv(spark, write("t.tsv", "#a\tb\n1\tx\n#2\ty\n3\n"))
    assert table.columns == ["a", "b"] and sorted(map(tuple, table.collect())) == [("#2", "y"), ("1", "x"), ("3", None)]
    calls = text.vcf(spark, write("d.vcf", "##x\n#CHROM\nc\t5\t.\tA\tC,G\t9\tPASS\tDP=1;X;DP=2\n")).collect()
    assert [(r.alt, r.info) for r in calls] == [("C", {"DP": "1", "X": ""}), ("G", {"DP": "1", "X": ""})]
    probes_ = text.probes(spark, write("p.tsv", "#h\nchr1\tstart\t.\tA\tC\t.\t.\t.\t.\nchr1\t9\t.\tA\tC\t.\t.\t.\t.\nchr2\t4\t.\tG\tT\t.\t.\t.\t.\n"))
    assert [tuple(r) for r in probes_.orderBy("probe_id").collect()] == [(0, "chr1", 10, "A", "C"), (1, "chr2", 5, "G", "T")]
    contigs = spark.createDataFrame([("chr1", 10), ("chr2", 20)], "chrom string, length long")
    assert [tuple(r) for r in text.contigs_agree(spark.createDataFrame([("chr1", 10), ("chr2", 21), ("x", 1)], "chrom string, length long"), contigs).orderBy("chrom").collect()] == [("chr2", 21, 20), ("x", 1, None)]
    assert text.known_contigs(spark.createDataFrame([("chr1", 1)], "chrom string, s long"), contigs).count() == 1
    with pytest.raises(Exception, match="unknown chromosome"):
        text.known_contigs(spark.createDataFrame([("chr9", 1)], "chrom string, s long"), contigs).collect()
    assert [r[0] for r in spark.createDataFrame([("gs://a",), ("/a",)], "p string").select(text.cloud_uri(F.col("p"))).collect()] == [True, False]


def test_fasta_in_many_blocks(spark, tmp_path):
    random.seed(8)
    seqs = {f"c{i}": "".join(random.choice("ACGT") for _ in range(random.randrange(1, 4000))) for i in range(6)}
    (tmp_path / "x.fa").write_text("".join(f">{n} about\n" + "".join(s[i : i + 60] + "\n" for i in range(0, len(s), 60)) for n, s in seqs.items()))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        chunks = text.fasta(spark, str(tmp_path / "x.fa"))
        assert chunks.rdd.getNumPartitions() >= 1 and {r.chrom: r.seq for r in chunks.collect()} == seqs
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_realigned_reads_and_repeats(spark):
    random.seed(11)
    ref = "".join(random.choice("ACGT") for _ in range(300))
    alt = ref[:150] + "GATTACAGATT" + ref[150:]
    rows = [(1, alt[100:200], ref, alt), (1, alt[120:220], ref, alt), (1, ref[100:200], ref, alt), (2, ref[0:80], ref, alt), (3, None, ref, alt)]
    got = {r.probe_id: r.n_alt for r in probes.realigned(spark.createDataFrame(rows, "probe_id long, seq string, ref_hap string, alt_hap string")).collect()}
    assert got == {1: 2, 2: 0, 3: 0}
    found = spark.createDataFrame([("ACACACACAC",), (None,)], "s string").select(repeats.repeats_udf()(F.col("s")).alias("r")).collect()
    assert [x.asDict() for x in found[0].r] == [{"motif": "AC", "start": 0, "length": 10, "substitutions": 0}] and not found[1].r


def test_path_depths_of_both_forms_agree(spark):
    for a in ([], [4.0], [1.0, 3.0], [5.0, 1.0, 2.0, 8.0, 4.0]):
        r = spark.createDataFrame([(a,)], "a array<double>").select(kgraph.path_stats(F.col("a")).alias("p")).first().p
        want = assembler.depth_stats(a)
        assert r is None if not a else {k: None if v is None else round(v, 9) for k, v in r.asDict().items()} == {k: None if v is None else round(v, 9) for k, v in want.items()}


def test_calls_from_alignments(spark):
    """The places that were changed are called, in the case sample only; texts that repeat themselves may blur a few."""
    calls = catalog.QUERIES["q_call_pipeline"](spark, SF).collect()
    dna_ = {f"d{r.doc_id}": r.s for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", seq.dna(F.col("text")).alias("s")).collect()}
    fields = [(r, r.line.split("\t")) for r in calls]
    good = [r for r, f in fields if f[7] == "CASE;TYPE=SNV;LENGTH=1" and r.pos % 97 == 0 and f[3] == dna_[r.chrom][r.pos - 1] and f[4] == "T"]
    assert len(good) > 100 and len(good) >= 0.95 * len(calls)
    assert all(f[3] == dna_[r.chrom][r.pos - 1 : r.pos - 1 + len(f[3])] for r, f in fields)


def test_probes_are_tracked_to_their_calls(spark):
    """What survives is called; what is not processed lies in a window that says why."""
    stages = {r.probe_id: r.lost_at_stage for r in catalog.QUERIES["q_probe_tracking"](spark, SF).collect()}
    called = {int(r.chrom[1:]) * 1_000_000 + r.pos for r in catalog.QUERIES["q_call_pipeline"](spark, SF).collect()}
    survived = {p for p, s in stages.items() if s == "survived"}
    assert set(stages.values()) <= set(diagnostics.STAGES) and len(survived) > 100
    assert len(survived - called) <= 0.05 * len(survived)
    assert {s for p, s in stages.items() if p in called} <= {"survived", "geno_zero_alt_reads", "msa_shifted", "msa_not_extracted"} | {s for s in stages.values() if s.startswith(("not_processed", "pruned", "no_path"))}
