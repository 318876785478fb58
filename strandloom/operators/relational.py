"""Joins, grouping and sampling that the assembly dataflow is made of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandloom.functions import seq
from strandloom.operators import scans
from strandloom.sources.storage import checkpointed


#: Bits of the bins' widths, level by level, the finest first (three bits more each).
LEVELS = tuple(range(7, 64, 3))
#: Rows of a text that meet those of another at once, and pairs of a task.
COPIES, PAIRS = 1 << 10, 1 << 22


def interval_level(lo: Column, hi: Column) -> Column:
    """Bits of the finest level whose bins are longer than the closed interval, which so touches two of them at most."""
    return F.coalesce(*(F.when(hi - lo < F.lit(1 << s), F.lit(s)) for s in LEVELS[:-1]), F.lit(LEVELS[-1]))


def interval_join(left: DataFrame, right: DataFrame, keys: list[str], lo: tuple[str, str], hi: tuple[str, str], how: str = "inner") -> DataFrame:
    """Rows whose closed intervals overlap: lo = (start, end) of left, hi = those of right; rows with an end before the
    start overlap nothing.

    Bins stand at several levels, each eight times as wide as the one below, and an interval belongs to the level that fits
    its length. Of two intervals the shorter is also put into its (at most two) bins of the longer one's level, so an
    interval gives at most two rows a level, however long it is, and only levels that the other side has count: which
    these are is looked up first. A pair is taken in the bin in which the overlap begins, so it comes once.
    """
    (a, b), (c, d) = lo, hi
    if how not in ("inner", "left_semi"):
        raise ValueError(how)

    def levelled(df: DataFrame, x: str, y: str) -> tuple[DataFrame, list[int]]:
        df = df.filter(F.col(x) <= F.col(y)).withColumn("__level", interval_level(F.col(x), F.col(y)))
        return df, sorted(r[0] for r in df.select("__level").distinct().collect())  # a row a level

    def binned(df: DataFrame, x: str, y: str, levels: list[int], own: bool) -> DataFrame:
        """df in its bins: those of its own level, or of the given levels above it."""
        at = lambda s: F.transform(F.sequence(F.shiftright(F.col(x).cast("long"), s), F.shiftright(F.col(y).cast("long"), s)), lambda n: F.struct(F.lit(s).alias("s"), n.alias("n")))
        none = F.array().cast("array<struct<s:int,n:bigint>>")
        bins = F.concat(none, *(F.when(F.col("__level") == s if own else F.col("__level") < s, at(s)).otherwise(none) for s in levels))
        return df.withColumn("__bin", F.explode(bins)).drop("__level")

    (l, of_left), (r, of_right) = levelled(left, a, b), levelled(right, c, d)
    begins = F.col("__bin.n") == F.expr(f"shiftright(greatest(CAST(`{a}` AS BIGINT), CAST(`{c}` AS BIGINT)), __bin.s)")

    def met(x: DataFrame, y: DataFrame) -> DataFrame:
        return x.join(y, [*keys, "__bin"]).filter((F.col(a) <= F.col(d)) & (F.col(c) <= F.col(b)) & begins).drop("__bin")

    both = sorted(set(of_left) & set(of_right))
    out = met(binned(l, a, b, both, True), binned(r, c, d, both, True))
    out = out.unionByName(met(binned(l, a, b, of_left, True), binned(r, c, d, of_left, False))) if of_left and of_right and of_right[0] < of_left[-1] else out
    out = out.unionByName(met(binned(l, a, b, of_right, False), binned(r, c, d, of_right, True))) if of_left and of_right and of_left[0] < of_right[-1] else out
    return out if how == "inner" else left.join(out.select(*left.columns).distinct(), left.columns, "left_semi")


def overlap_totals(spans: DataFrame, others: DataFrame, keys: list[str], lo: tuple[str, str], hi: tuple[str, str], id_: str, bits: int = 14) -> DataFrame:
    """id_, n, lo, hi: of each span's id the number of others that its closed intervals overlap, their least start and largest
    end; ids that overlap nothing are not given. lo = (start, end) of spans, hi = those of others, as in interval_join().

    No pairs are made, for an interval may overlap a large part of the table. Those that overlap are the ones that begin by
    its end and the ones that end from its start on, added up, less all; of these the largest end, and the least start, are
    those of overlapping ones unless there are none. So both orders are run through once (the second backwards, its places
    negated), in bins of 2^bits places, each of which begins with what the bins before it give.
    """
    (a, b), (c, d) = lo, hi
    long = lambda x, sign=1: F.col(x).cast("long") * sign
    none = F.lit(None).cast("long")

    def event(side: int, at: Column, kind: int, count: Column, value: Column, s: Column, e: Column, id_: Column) -> Column:
        parts = (F.lit(side).alias("side"), F.shiftright(at, bits).alias("bin"), at.alias("at"), F.lit(kind).alias("kind"), count.alias("count"), value.alias("value"), s.alias("s"), e.alias("e"), id_.alias("id"))
        return F.struct(*parts)

    def events(df: DataFrame, x: str, y: str, *two: Column) -> DataFrame:
        ok = F.col(x) <= F.col(y)
        for k in keys:
            ok = ok & F.col(k).isNotNull()
        return df.filter(ok).select(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)), F.inline(F.array(*two)))

    key, of = [f"__k{i}" for i in range(len(keys))], spans.schema[id_].dataType
    one, nobody = F.lit(1).cast("long"), F.lit(None).cast(of)
    theirs = events(others, c, d, event(0, long(c), 1, one, long(d), none, none, nobody), event(1, long(d, -1), 1, one, long(c, -1), none, none, nobody))
    own = events(spans, a, b, event(0, long(b), 2, none, none, long(a), long(b), F.col(id_)), event(1, long(a, -1), 2, none, none, long(a), long(b), F.col(id_)))
    every = theirs.unionByName(own)
    whole = W.partitionBy(*key, "side")
    before = whole.orderBy("bin").rowsBetween(W.unboundedPreceding, -1)
    bins = every.groupBy(*key, "side", "bin").agg(F.sum("count").alias("count"), F.max("value").alias("value"))
    carry = bins.select(*key, "side", "bin", F.shiftleft("bin", bits).alias("at"), F.lit(0).alias("kind"), F.sum("count").over(before).alias("count"), F.max("value").over(before).alias("value"), F.sum("count").over(whole).alias("every"))
    order = W.partitionBy(*key, "side", "bin").orderBy("at", "kind").rowsBetween(W.unboundedPreceding, 0)
    run = every.unionByName(carry, allowMissingColumns=True).select("*", F.sum("count").over(order).alias("seen"), F.max("value").over(order).alias("top"), F.max("every").over(order).alias("all")).filter("kind = 2")
    found = run.filter(F.when(F.col("side") == 0, F.col("top") >= F.col("s")).otherwise(-F.col("top") <= F.col("e")))
    g = found.groupBy(F.col("id").alias(id_))
    back = F.col("side") == 1
    return g.agg(F.sum(F.col("seen") - F.when(back, F.col("all")).otherwise(0)).alias("n"), F.min(F.when(back, -F.col("top"))).alias("lo"), F.max(F.when(~back, F.col("top"))).alias("hi"))


def point_in_window(points: DataFrame, at: str, length: int, step: int) -> DataFrame:
    """points with window_id: of windows [id*step, id*step + length] each that covers the point."""
    p = F.col(at)
    return points.withColumn("window_id", F.explode(F.sequence(F.greatest(F.lit(0), F.ceil((p - length) / step)), F.floor(p / step))))


def distinct_texts(df: DataFrame, id_: str, text: str) -> DataFrame:
    """rep (smallest id), s, copies of each distinct text that is not null."""
    return df.filter(F.col(text).isNotNull()).groupBy(F.col(text).alias("s")).agg(F.min(id_).alias("rep"), F.count("*").alias("copies"))


def within_mismatches(texts: DataFrame, most: int) -> DataFrame:
    """Pairs (a, b, mismatches, copies_a, copies_b), a < b, of distinct equally long texts (rep, s, copies) with at most so many mismatches.

    Texts are cut into most + 2 blocks, of which two at least agree; they are joined on the length and the places and
    contents of two blocks, which is far more selective than one. Texts with no more letters than blocks are joined on
    their length alone. Copies are no pairs: they belong to one text.
    """
    n, k = F.length("s"), most + 2
    edge = lambda i: F.floor(n * i / k).cast("int")
    block = lambda i: F.substring("s", edge(i) + 1, edge(i + 1) - edge(i))
    two = [F.struct(F.lit(i * k + j).alias("at"), F.concat_ws("\0", block(i), block(j)).alias("part")) for i in range(k) for j in range(i + 1, k)]
    short = F.array(F.struct(F.lit(-1).alias("at"), F.lit("").alias("part")))
    rows = texts.select("rep", "s", "copies", n.alias("n"), F.explode(F.when(n < k, short).otherwise(F.array(*two))).alias("key"))
    l, r = rows.alias("l"), rows.alias("r")
    pairs = l.join(r, (F.col("l.n") == F.col("r.n")) & (F.col("l.key") == F.col("r.key")) & (F.col("l.rep") < F.col("r.rep")))
    found = pairs.select(F.col("l.rep").alias("a"), F.col("r.rep").alias("b"), seq.hamming(F.col("l.s"), F.col("r.s")).alias("mismatches"), F.col("l.copies").alias("copies_a"), F.col("r.copies").alias("copies_b"))
    return found.filter(F.col("mismatches") <= most).distinct()


def rows_within_mismatches(df: DataFrame, id_: str, text: str, most: int) -> DataFrame:
    """Pairs (a, b, mismatches), a < b, of the ids of all rows whose texts are equally long and differ in at most so many places.

    Distinct texts are compared once; then the rows of near and of equal texts meet. There are as many such pairs as copies
    times copies, so the rows of a text are dealt to blocks of about COPIES, and two blocks at a time meet in a task.
    """
    rows = df.filter(F.col(text).isNotNull()).select(F.col(id_).alias("id"), F.col(text).alias("s"))
    t = rows.groupBy("s").agg(F.count("*").alias("copies"))
    near = within_mismatches(t.withColumn("rep", F.col("s")), most)
    near = near.unionByName(t.select(F.col("s").alias("a"), F.col("s").alias("b"), F.lit(0).alias("mismatches"), F.col("copies").alias("copies_a"), F.col("copies").alias("copies_b")))
    blocks = lambda n: F.ceil(F.col(n) / COPIES)
    near = checkpointed(near.select("a", "b", "mismatches", blocks("copies_a").alias("n_a"), blocks("copies_b").alias("n_b"), (F.col("copies_a") * F.col("copies_b")).alias("pairs")), "near-texts")
    tasks = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), (near.agg(F.sum("pairs")).head()[0] or 0) // PAIRS)
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n))
    key = ["a", "b", "i", "j", "mismatches"]
    l = rows.join(near.withColumnRenamed("a", "s"), "s").select(F.col("s").alias("a"), "b", own("n_a").alias("i"), every("n_b").alias("j"), "mismatches", F.col("id").alias("x"))
    r = rows.join(near.withColumnRenamed("b", "s"), "s").select("a", F.col("s").alias("b"), every("n_a").alias("i"), own("n_b").alias("j"), "mismatches", F.col("id").alias("y"))
    met = l.repartition(tasks, *key).join(r.repartition(tasks, *key), key)
    met = met.filter((F.col("x") < F.col("y")) | ((F.col("a") != F.col("b")) & (F.col("x") > F.col("y"))))
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "mismatches")


def tiered_match(truth: DataFrame, calls: DataFrame, near: int = 5, far: int = 50) -> DataFrame:
    """truth(truth_id, chrom, pos, ref, alt, kind, size) by its best call(call_id, same columns).

    Levels: L0 same place and alleles; for SNV and MNP only LD follows, an SNV inside an MNP call; for
    others L1 same place, kind and size within 20 %, L2 within near bases and L3 within far bases with the
    size within 50 %. The first call by level, place and id wins; MISS if there is none.
    """
    width = far + 1
    t = truth.withColumn("__bin", F.explode(F.array(*(F.floor(F.col("pos") / width) + d for d in (-1, 0, 1)))))
    c = calls.select("chrom", *(F.col(x).alias("c_" + x) for x in ("pos", "ref", "alt", "kind", "size")), "call_id", F.floor(F.col("pos") / width).alias("__bin"))
    pair = t.join(c, ["chrom", "__bin"]).withColumn("d", F.abs(F.col("pos") - F.col("c_pos"))).filter(F.col("d") <= far)
    size, gap = F.abs("size"), F.abs(F.abs("c_size") - F.abs("size"))
    same, small = F.col("kind") == F.col("c_kind"), F.col("kind").isin("SNV", "MNP")
    at = F.col("pos") - F.col("c_pos")
    inside = (F.col("kind") == "SNV") & (F.col("c_kind") == "MNP") & (at >= 0) & (at < F.length("c_ref"))
    carried = (F.substring("c_ref", at + 1, F.lit(1)) == F.col("ref")) & (F.substring("c_alt", at + 1, F.lit(1)) == F.col("alt"))
    level = (
        F.when((F.col("d") == 0) & (F.col("ref") == F.col("c_ref")) & (F.col("alt") == F.col("c_alt")), 0)
        .when(inside & carried, 1)
        .when(small, None)
        .when(same & (F.col("d") == 0) & (gap <= seq.size_tolerance(size, 0.2)), 2)
        .when(same & (F.col("d") <= near) & (gap <= seq.size_tolerance(size, 0.5)), 3)
        .when(same & (gap <= seq.size_tolerance(size, 0.5)), 4)
    )
    best = pair.withColumn("lv", level).filter("lv IS NOT NULL").groupBy("truth_id").agg(F.min(F.struct("lv", "c_pos", "call_id")).alias("m"))
    name = F.when(F.col("m").isNull(), "MISS").otherwise(F.element_at(F.array(*map(F.lit, ("L0", "LD", "L1", "L2", "L3"))), F.col("m.lv") + 1))
    return truth.join(best, "truth_id", "left").select("truth_id", name.alias("level"), F.col("m.call_id").alias("call_id"))


def asof_containment(points: DataFrame, at: str, spans: DataFrame, keys: list[str], start: str, end: str, id_: str, keep: scans.Keep = scans.written) -> DataFrame:
    """points with the id of the latest-starting span at or before each, null if it has ended by then.

    Both sides are put in one order by key and place; the last span seen so far is carried along, so a
    point meets one span, not all before it. keep: see scans.
    """
    s = spans.select(*keys, F.col(start).alias("__at"), F.lit(0).alias("__kind"), F.struct(F.col(start), F.col(id_), F.col(end)).alias("__span"))
    p = points.select("*", F.col(at).alias("__at"), F.lit(1).alias("__kind"))
    every = p.unionByName(s, allowMissingColumns=True)
    seen = scans.last_largest(every, keys, ["__at", "__kind", "__span"], "__span", "__last", keep).filter("__kind = 1")
    inside = F.col(f"__last.{end}") >= F.col(at)
    return seen.select(*points.columns, F.when(inside, F.col(f"__last.{id_}")).alias("span_id"))


def keep_max(df: DataFrame, keys: list[str], by: list[str], payload: list[str]) -> DataFrame:
    """The row of each key that is largest in by, then in payload; combined before the shuffle."""
    rest = [c for c in payload if c not in by]
    m = F.max(F.struct(*by, *rest)).alias("__m")
    return df.groupBy(*keys).agg(m).select(*keys, *(F.col(f"__m.{c}").alias(c) for c in payload))


def downsample(df: DataFrame, keys: list[str], name: str, cap: Column, keep: scans.Keep = scans.written, seed: str = "0") -> DataFrame:
    """The cap names of each key that are first by hash; all rows of a kept name stay, so mates stay together. keep: see scans."""
    names = df.select(*keys, name, cap.alias("__cap")).groupBy(*keys, name).agg(F.max("__cap").alias("__cap"))
    names = names.withColumn("__hash", F.md5(F.concat(F.col(name).cast("string"), F.lit(seed)).cast("binary")))
    kept = scans.ranked(names, keys, ["__hash", name], "__r", keep).filter("__r < __cap").select(*keys, name)
    return df.join(kept, [*keys, name], "left_semi")


def evenly_spaced(df: DataFrame, keys: list[str], order: list[str], take: int, keep: scans.Keep = scans.written) -> DataFrame:
    """Of each key's n ordered rows those at k*n/t, t = min(n, take). keep: see scans."""
    sizes = df.groupBy(*keys).agg(F.count("*").alias("__n"))
    rows = scans.ranked(df, keys, order, "__r", keep).join(sizes, keys)
    t = F.least("__n", F.lit(take))
    # A row r is k*n div t for some k exactly if ceil(r*t/n)*n div t is r.
    k = F.ceil(F.col("__r") * t / F.col("__n"))
    return rows.filter(F.floor(k * F.col("__n") / t) == F.col("__r")).drop("__r", "__n")


def components(edges: DataFrame, checkpoint) -> DataFrame:
    """node, label (the smallest node of its component) of edges (a, b); checkpoint cuts lineage.

    Each round hooks every node to its smallest neighbour, jumps pointers until all point to a root, and
    contracts the edges to roots. A node that is not smaller than all its neighbours is gone after its
    round, so a component of n nodes takes at most log2(n) rounds, of at most log2(n) jumps each.
    checkpoint(df) must write to storage that outlives an executor.
    """
    labels = None
    while True:
        both = edges.select("a", "b").union(edges.select("b", "a"))
        parent = checkpoint(both.groupBy("a").agg(F.least("a", F.min("b")).alias("p")).withColumnRenamed("a", "node"))
        if not parent.head():
            return labels if labels is not None else parent.withColumnRenamed("p", "label")
        parent = pointer_jumped(parent, checkpoint)
        if labels is None:
            labels = parent.withColumnRenamed("p", "label")
        else:
            labels = labels.join(parent.withColumnRenamed("node", "label"), "label", "left").select("node", F.coalesce("p", "label").alias("label"))
            labels = checkpoint(labels)
        of = lambda c: parent.select(F.col("node").alias(c), F.col("p").alias(f"{c}_p"))
        moved = edges.join(of("a"), "a").join(of("b"), "b").select(F.col("a_p").alias("a"), F.col("b_p").alias("b"))
        edges = checkpoint(moved.filter("a <> b").distinct())


def pointer_jumped(parent: DataFrame, checkpoint) -> DataFrame:
    """node, p of a forest, p made the root of each node: a turn halves the depth."""
    while True:
        up = parent.select(F.col("node").alias("p"), F.col("p").alias("top"))
        parent = checkpoint(parent.join(up, "p").select("node", F.col("top").alias("p"), (F.col("top") != F.col("p")).alias("moved")))
        if not parent.filter("moved").head():
            return parent.select("node", "p")


def windows(regions: DataFrame, length: int, overlap: int, tail: bool = False) -> DataFrame:
    """Windows [s, s+length] of regions (chrom_idx, chrom, start1, end1), every step, as long as they fit.

    With tail, the bases behind the last one get a window that ends with the region, and a region shorter than
    a window is one. window_id counts from 0 in order of (chrom_idx, start1, end1).
    """
    step = -(-(100 - overlap) * length // 100 // 100) * 100
    last = F.floor((F.col("end1") - F.col("start1") - length) / step)
    starts = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<bigint>"))
    w = regions.dropDuplicates(["chrom", "start1", "end1"]).select("chrom_idx", "chrom", "start1", F.explode(starts).alias("__k"))
    w = w.select("chrom_idx", "chrom", (F.col("start1") + F.col("__k") * step).alias("start1")).withColumn("end1", F.col("start1") + length)
    if tail:
        left = (last < 0) | (F.col("start1") + last * step + length < F.col("end1"))
        ends = regions.filter(left).select("chrom_idx", "chrom", F.greatest(F.col("start1"), F.col("end1") - length).alias("start1"), "end1")
        w = w.unionByName(ends).distinct()
    # Numbers by counts of chromosomes before and rank within, so no single task orders all windows.
    per = w.groupBy("chrom_idx").agg(F.count("*").alias("__n"))
    base = F.coalesce(F.sum("__n").over(W.orderBy("chrom_idx").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rank = F.row_number().over(W.partitionBy("chrom_idx").orderBy("start1", "end1")) - 1
    return w.withColumn("__r", rank).join(per.select("chrom_idx", base.alias("__b")), "chrom_idx").select((F.col("__b") + F.col("__r")).alias("window_id"), "chrom_idx", "chrom", "start1", "end1")


def pad_region(start1: Column, end1: Column, pad: int, length: Column, least: int) -> tuple[Column, Column]:
    """Padded on both sides, clamped to the chromosome, and grown to least+1 bases if shorter."""
    a, b = F.greatest(start1 - pad, F.lit(1)), F.least(end1 + pad, length)
    short = F.greatest(F.lit(least + 1) - (b - a + 1), F.lit(0))
    lo = F.greatest(a - F.floor(short / 2), F.lit(1))
    return lo, F.least(F.greatest(b + F.ceil(short / 2), lo + least), length)


def active_windows(windows_: DataFrame, changes: DataFrame) -> DataFrame:
    """Windows with some (sample, kind, pos) that two reads or more show."""
    hit = changes.groupBy("window_id", "sample", "kind", "pos").agg(F.count("*").alias("n")).filter("n >= 2")
    return windows_.join(hit.select("window_id").distinct(), "window_id", "left_semi")


def read_changes(reads: DataFrame, least_quality: int = 20) -> DataFrame:
    """Explode reads (window_id, sample, pos, units, md, quals) into their changes: kind and position.

    Kinds are mismatch (MD, at bases of at least that quality, and X units), insertion, deletion and softclip. A unit
    stands where the reference is after it, so deletions with the same end agree.
    """
    units = F.col("units")

    def walk(op: str) -> Column:
        state = F.struct(F.col("pos").cast("long").alias("at"), F.array().cast("array<bigint>").alias("out"))

        def step(s: Column, u: Column) -> Column:
            at = s["at"] + F.when(u["op"].isin(*"MDN=X"), u["len"]).otherwise(0)
            return F.struct(at.alias("at"), F.when(u["op"] == op, F.concat(s["out"], F.array(at))).otherwise(s["out"]).alias("out"))

        return F.aggregate(units, state, step, lambda s: s["out"])

    def good(at: Column) -> Column:
        return F.get("quals", seq.query_position(units, (at - F.col("pos")).cast("int"))) >= least_quality

    told = F.coalesce(seq.md_mismatches(F.col("md"), F.col("pos")), F.array().cast("array<bigint>"))
    kinds = [("mismatch", F.concat(F.filter(told, good), walk("X"))), ("insertion", walk("I")), ("deletion", walk("D")), ("softclip", walk("S"))]

    def named(kind: str, places: Column) -> Column:
        return F.transform(places, lambda p: F.struct(F.lit(kind).alias("kind"), p.alias("pos")))

    return reads.select("window_id", "sample", F.inline(F.concat(*(named(*x) for x in kinds))))


def recaptured_mates(kept: DataFrame, alignments: DataFrame) -> DataFrame:
    """Mates (qname, pos = mate_pos) of kept reads that the region did not hold; the first alignment wins."""
    want = kept.select("sample", "qname", F.col("mate_pos").alias("pos")).distinct()
    missing = want.join(kept.select("sample", "qname", "pos"), ["sample", "qname", "pos"], "left_anti")
    found = alignments.join(missing, ["sample", "qname", "pos"])
    order = W.partitionBy("sample", "qname", "pos").orderBy("flag", "mapq", "seq")
    return found.withColumn("__r", F.row_number().over(order)).filter("__r = 1").drop("__r")
