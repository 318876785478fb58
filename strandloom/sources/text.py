"""Text sources: regions, references, variants, tables and logs, read by Spark's own readers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandloom.functions import seq

CHUNK = 1 << 16


def bed(spark: SparkSession, path: str) -> DataFrame:
    """chrom, start1, end1 of a file of exactly three columns; comments and empty lines are skipped. Starts
    are taken as they stand. A line with another number of columns raises."""
    rows = spark.read.text(path).filter("trim(value) <> '' AND NOT startswith(value, '#')").select(F.split("value", "\t").alias("f"))
    checked = F.when(F.size("f") == 3, F.col("f")).otherwise(F.raise_error(F.concat(F.lit("not three columns: "), F.array_join("f", "\\t"))).cast("array<string>"))
    rows = rows.select(checked.alias("f"))
    return rows.select(F.col("f")[0].alias("chrom"), F.col("f")[1].cast("long").alias("start1"), F.col("f")[2].cast("long").alias("end1"))


def known_contigs(regions: DataFrame, contigs: DataFrame) -> DataFrame:
    """regions, raising on a chromosome that contigs(chrom, length) does not have."""
    j = regions.join(contigs.select("chrom", F.col("length").alias("__n")), "chrom", "left")
    ok = F.when(F.col("__n").isNull(), F.raise_error(F.concat(F.lit("unknown chromosome "), F.col("chrom"))).cast("string")).otherwise(F.col("chrom"))
    return j.withColumn("chrom", ok).drop("__n")


def contigs_agree(header: DataFrame, reference: DataFrame) -> DataFrame:
    """Contigs (chrom, length) of an alignment header that the reference lacks or has at another length."""
    r = reference.select("chrom", F.col("length").alias("expected"))
    return header.join(r, "chrom", "left").filter("expected IS NULL OR expected <> length")


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """file, block, n, value: lines, ordered by n in a block, and blocks by their offset in the file."""
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"), "value")


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """chrom, chunk, seq: sequences in chunks of CHUNK bases, in upper case, other letters as N.

    Places are counted within a block of a file; only a row for each block and sequence meets in one order.
    """
    lines = _lines(spark, path)
    head, order = F.col("value").startswith(">"), W.partitionBy("file", "block").orderBy("n")
    lines = lines.withColumn("name", F.when(head, F.regexp_extract("value", r"^>(\S+)", 1))).withColumn("part", F.count("name").over(order))
    body = lines.withColumn("s", F.when(head, "").otherwise(F.regexp_replace(F.upper(F.trim("value")), "[^ACGT]", "N")))
    parts = body.groupBy("file", "block", "part").agg(F.max("name").alias("name"), F.sum(F.length("s")).alias("size"))
    # Part 0 of a block goes on with the sequence of the block before.
    by_file = W.partitionBy("file").orderBy("block", "part")
    parts = parts.withColumn("no", F.count("name").over(by_file)).withColumn("chrom", F.last("name", ignorenulls=True).over(by_file))
    before = F.coalesce(F.sum("size").over(W.partitionBy("file", "no").orderBy("block", "part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = parts.withColumn("base", before).select("file", "block", "part", "chrom", "base")
    inside = F.sum(F.length("s")).over(W.partitionBy("file", "block", "part").orderBy("n"))
    body = body.withColumn("inside", inside - F.length("s")).filter(F.length("s") > 0).join(parts, ["file", "block", "part"]).withColumn("at", F.col("base") + F.col("inside"))
    cut = body.select("chrom", "at", "s", F.explode(F.expr(f"sequence(at div {CHUNK}, (at + length(s) - 1) div {CHUNK})")).alias("chunk"))
    lo = F.greatest(F.col("chunk") * CHUNK - F.col("at"), F.lit(0))
    hi = F.least((F.col("chunk") + 1) * CHUNK - F.col("at"), F.length("s"))
    cut = cut.select("chrom", "chunk", (F.col("at") + lo).alias("at"), F.substring("s", lo.cast("int") + 1, (hi - lo).cast("int")).alias("s"))
    return cut.groupBy("chrom", "chunk").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "s"))), lambda x: x["s"]), "").alias("seq"))


def fetch(chunks: DataFrame, regions: DataFrame) -> DataFrame:
    """regions(chrom, start1, end1) with ref_seq, put together from the chunks that they touch."""
    r = regions.withColumn("chunk", F.explode(F.expr(f"sequence((start1 - 1) div {CHUNK}, (end1 - 1) div {CHUNK})"))).join(chunks, ["chrom", "chunk"])
    lo = F.greatest(F.col("start1") - 1 - F.col("chunk") * CHUNK, F.lit(0)).cast("int")
    hi = F.least(F.col("end1") - F.col("chunk") * CHUNK, F.lit(CHUNK)).cast("int")
    r = r.withColumn("part", F.substring("seq", lo + 1, hi - lo))
    return r.groupBy(*regions.columns).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("chunk", "part"))), lambda x: x["part"]), "").alias("ref_seq"))


def vcf(spark: SparkSession, path: str) -> DataFrame:
    """A row for each ALT: chrom, pos, ref, alt, alt_no, qual, filter, info (map), format, samples (array)."""
    f = spark.read.text(path).filter("value <> '' AND NOT startswith(value, '#')").select(F.split("value", "\t").alias("f"))
    entries = F.transform(F.split(F.col("f")[7], ";"), lambda x: F.named_struct(F.lit("k"), F.substring_index(x, "=", 1), F.lit("v"), F.when(F.contains(x, F.lit("=")), F.regexp_replace(x, "^[^=]*=", "")).otherwise("")))
    names = F.transform(entries, lambda x: x["k"])
    info = F.map_from_entries(F.filter(entries, lambda x, i: F.array_position(names, x["k"]) == i + 1))  # of a repeated key the first
    rows = f.select(
        F.col("f")[0].alias("chrom"), F.col("f")[1].cast("long").alias("pos"), F.col("f")[3].alias("ref"), F.posexplode(F.split(F.col("f")[4], ",")).alias("alt_no", "alt"),
        F.col("f")[5].try_cast("double").alias("qual"), F.col("f")[6].alias("filter"), info.alias("info"), F.get("f", F.lit(8)).alias("format"), F.slice("f", 10, F.greatest(F.size("f") - 9, F.lit(0))).alias("samples"),
    )
    return rows


def small_truth(rows: DataFrame) -> DataFrame:
    """Passing, non-symbolic variants, reduced to their cores: chrom, pos, ref, alt, kind, size."""
    ok = rows.filter("filter IN ('PASS', '.') AND NOT alt LIKE '<%' AND alt <> '*' AND NOT alt RLIKE '[\\\\[\\\\]]'")
    r, a = F.col("ref"), F.col("alt")
    c = ok.withColumn("core", seq.core(r, a)).withColumn("kind", seq.classify(r, a)).withColumn("size", seq.variant_length(r, a))
    point = F.col("kind").isin("SNV", "MNP")
    pick = lambda own, other: F.when(point, F.col(own)).otherwise(F.col(other))
    c = c.withColumn("at", F.when(point, F.col("pos") + F.col("core.start")).otherwise(F.col("pos")))
    c = c.withColumn("r", pick("core.ref_core", "ref")).withColumn("a", pick("core.alt_core", "alt"))
    return c.select("chrom", F.col("at").alias("pos"), F.col("r").alias("ref"), F.col("a").alias("alt"), "kind", "size")


def large_truth(rows: DataFrame) -> DataFrame:
    """Passing structural variants but duplications and breakends; symbolic ones take SVLEN as size."""
    kind = F.coalesce(F.try_element_at("info", F.lit("SVTYPE")), seq.classify(F.col("ref"), F.col("alt")))
    size = F.when(F.col("alt").startswith("<"), F.abs(F.try_element_at("info", F.lit("SVLEN")).try_cast("int"))).otherwise(F.abs(seq.variant_length(F.col("ref"), F.col("alt"))))
    return rows.filter("filter IN ('PASS', '.')").withColumn("kind", kind).filter("kind NOT IN ('DUP', 'BND')").select("chrom", "pos", "ref", "alt", "kind", F.when(F.col("kind") == "DEL", -size).otherwise(size).alias("size"))


def allele_depths(rows: DataFrame) -> DataFrame:
    """Of vcf() rows a row for each sample: sample_no, ad (of the ALT), dp, vaf."""
    s = rows.select("chrom", "pos", "ref", "alt", "alt_no", "format", F.posexplode("samples").alias("sample_no", "text"))
    field = lambda name: F.get(F.split("text", ":"), F.array_position(F.split("format", ":"), name).cast("int") - 1)
    has = lambda name: F.array_contains(F.split("format", ":"), name)
    ad = F.when(has("AD"), F.get(F.split(field("AD"), ","), F.col("alt_no") + 1).try_cast("int"))
    dp = F.when(has("DP"), field("DP").try_cast("int"))
    return s.select("chrom", "pos", "ref", "alt", "sample_no", ad.alias("ad"), dp.alias("dp"), F.try_divide(ad.cast("double"), dp).alias("vaf"))


def commented_tsv(spark: SparkSession, path: str) -> DataFrame:
    """A table whose header is the first line that begins with #; columns are strings. Other lines are data, also those that
    begin with #; files of one pattern may each have the header."""
    head = spark.read.text(path).filter(F.col("value").startswith("#")).head()
    names = head["value"].lstrip("#").strip().split("\t")
    fields = F.split("value", "\t")
    rows = spark.read.text(path).filter((F.col("value") != head["value"]) & (F.col("value") != ""))
    return rows.select(*(F.get(fields, F.lit(i)).alias(n.strip()) for i, n in enumerate(names)))


def probes(spark: SparkSession, path: str) -> DataFrame:
    """probe_id (place in the file), chrom, pos (1-based), ref, alt of a table with at least nine columns;
    rows whose start is no number are skipped."""
    f = _lines(spark, path).filter("value <> '' AND NOT startswith(value, '#')").withColumn("f", F.split("value", "\t"))
    ok = f.filter((F.size("f") >= 9) & F.get("f", F.lit(1)).try_cast("long").isNotNull())
    blocks = ok.groupBy("file", "block").agg(F.count("*").alias("rows"))
    base = F.coalesce(F.sum("rows").over(W.orderBy("file", "block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # a row a block
    rank = F.row_number().over(W.partitionBy("file", "block").orderBy("n")) - 1
    placed = ok.withColumn("rank", rank).join(blocks.select("file", "block", base.alias("base")), ["file", "block"])
    return placed.select((F.col("base") + F.col("rank")).alias("probe_id"), F.col("f")[0].alias("chrom"), (F.col("f")[1].cast("long") + 1).alias("pos"), F.col("f")[3].alias("ref"), F.col("f")[4].alias("alt"))


def window_statuses(spark: SparkSession, path: str) -> DataFrame:
    """chrom, win_start, win_end, win_status of log lines ``chrN:a-b done with STATUS``."""
    p = r"(chr\w+):(\d+)-(\d+) done with (\w+)"
    g = lambda k: F.regexp_extract("value", p, k)
    return spark.read.text(path).filter(F.col("value").rlike(p)).select(g(1).alias("chrom"), g(2).cast("long").alias("win_start"), g(3).cast("long").alias("win_end"), g(4).alias("win_status"))


def genotyped_windows(spark: SparkSession, path: str) -> DataFrame:
    """chrom, win_start, win_end, k (the largest), comps of the windows that a log tells were assembled and genotyped."""
    lines = spark.read.text(path)
    place = r"(chr\w+):(\d+)-(\d+)"
    g = lambda p, k: F.regexp_extract("value", p, k)

    def windows(p: str, first: int) -> list[Column]:
        return [g(p, first).alias("chrom"), g(p, first + 1).cast("long").alias("win_start"), g(p, first + 2).cast("long").alias("win_end")]

    made, called = rf"Assembled (\d+)bp path sequence for {place} comp=(\d+) with k=(\d+)", rf"Genotyped (\d+) variant\(s\) for window {place}"
    a = lines.filter(F.col("value").rlike(made)).select(*windows(made, 2), g(made, 5).cast("int").alias("comp"), g(made, 6).cast("int").alias("k"))
    b = lines.filter(F.col("value").rlike(called)).select(*windows(called, 2)).distinct()
    keys = ["chrom", "win_start", "win_end"]
    return a.join(b, keys, "left_semi").groupBy(*keys).agg(F.max("k").alias("k"), F.array_sort(F.collect_set("comp")).alias("comps"))


def dot_nodes(spark: SparkSession, path: str) -> DataFrame:
    """file, node, colour, coverage of the node lines of DOT files; quoted values or not."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value")
    name = F.regexp_extract("value", r'^\s*"?([^"\s\[]+)"?\s*\[', 1)
    colour = F.regexp_extract("value", r'(?:fill)?color\s*=\s*"?(\w+)"?', 1)
    cov = F.regexp_extract("value", r"cov(?:erage)?\s*[:=]\s*(\d+)", 1)
    return lines.filter(F.col("value").rlike(r"\[.*color") & ~F.col("value").rlike("--|->")).select("file", name.alias("node"), colour.alias("colour"), cov.try_cast("int").alias("coverage"))


def msa(spark: SparkSession, path: str) -> DataFrame:
    """file, n_haps, ref_length, lead_gap, tail_gap (most over rows) of aligned FASTA files, the reference first."""
    return msa_texts(spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value"))


def msa_texts(texts: DataFrame) -> DataFrame:
    """As msa(), of texts (file, value)."""
    whole = texts.select("file", F.split("value", ">").alias("r"))
    rows = F.transform(F.filter("r", lambda x: F.trim(x) != ""), lambda x: F.replace(F.regexp_replace(x, "^[^\n]*\n", ""), F.lit("\n"), F.lit("")))
    s = whole.select("file", rows.alias("s"))
    gap = lambda f: F.array_max(F.transform("s", f))
    return s.select(
        "file", F.size("s").alias("n_haps"), F.length(F.replace(F.col("s")[0], F.lit("-"), F.lit(""))).alias("ref_length"), gap(lambda x: F.length(F.regexp_extract(x, "^-*", 0))).alias("lead_gap"),
        gap(lambda x: F.length(F.regexp_extract(x, "-*$", 0))).alias("tail_gap"),
    )


def annotations(spark: SparkSession, paths: list[str], chroms: list[str] | None = None, skip: tuple[str, ...] = ()) -> DataFrame:
    """source (file name), chrom, start, end, name of interval files, compressed or not."""
    f = spark.read.text(paths).select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+?)(\.bed)?(\.gz)?$", 1).alias("source"), "value")
    f = f.filter("value <> '' AND NOT value RLIKE '^(#|track|browser)'").select("source", F.split("value", "\t").alias("f"))
    out = f.select("source", F.col("f")[0].alias("chrom"), F.col("f")[1].try_cast("long").alias("start"), F.col("f")[2].try_cast("long").alias("end"), F.coalesce(F.get("f", F.lit(3)), F.lit("")).alias("name"))
    out = out.filter("start IS NOT NULL AND end > start").filter(~F.col("name").isin(*skip) if skip else F.lit(True))
    return out.filter(F.col("chrom").isin(*chroms)) if chroms else out


def input_spec(spec: Column) -> Column:
    """struct(path, role) of ``path:role``; what stands behind the last colon, if it is a role, else control."""
    last = F.lower(F.substring_index(spec, ":", -1))
    known = last.isin("control", "case") & F.contains(spec, F.lit(":"))
    return F.struct(F.when(known, F.regexp_replace(spec, ":[^:]*$", "")).otherwise(spec).alias("path"), F.when(known, last).otherwise("control").alias("role"))


def cloud_uri(path: Column) -> Column:
    return path.rlike("^(gs|s3|https?|ftps?)://")


def reachable(spark: SparkSession, paths: list[str]) -> list[str]:
    """The paths (or patterns), any store's that Spark knows; raises before a job starts if one holds nothing."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        pattern = jvm.org.apache.hadoop.fs.Path(p)
        if not pattern.getFileSystem(conf).globStatus(pattern):
            raise FileNotFoundError(p)
    return paths


def profile(spark: SparkSession, path: str) -> DataFrame:
    """flat_sec, flat_pct, sum_pct, cum_sec, cum_pct, name of a profiler's text output."""
    p = r"^\s*([\d.]+)s\s+([\d.]+)%\s+([\d.]+)%\s+([\d.]+)s\s+([\d.]+)%\s+(.+?)\s*$"
    names = ["flat_sec", "flat_pct", "sum_pct", "cum_sec", "cum_pct"]
    numbers = [F.regexp_extract("value", p, k + 1).cast("double").alias(n) for k, n in enumerate(names)]
    return spark.read.text(path).filter(F.col("value").rlike(p)).select(*numbers, F.regexp_extract("value", p, 6).alias("name"))


def profile_history(spark: SparkSession, path: str) -> DataFrame:
    """label, day, entries (name, flat_sec) of a history with a JSON object a line; lines that are none are passed over."""
    rows = spark.read.schema("label string, day string, entries array<struct<name: string, flat_sec: double>>, broken string").option("columnNameOfCorruptRecord", "broken").json(path)
    return rows.filter("broken IS NULL").drop("broken")
