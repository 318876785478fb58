"""Sequence, allele and scoring expressions. All are Column functions, evaluated in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ACGT = ("A", "C", "G", "T")


def let(value: Column, body) -> Column:
    """body(value), with value computed once however often body refers to it."""
    return F.transform(F.array(value), body)[0]


def dna(text: Column) -> Column:
    """The A, C, G and T of a text, in upper case."""
    return F.regexp_replace(F.upper(text), "[^ACGT]+", "")


def reverse_complement(s: Column) -> Column:
    """Case is kept; what is no base becomes N."""
    return F.reverse(F.translate(F.regexp_replace(s, "[^ACGTNacgtn]", "N"), "ACGTacgt", "TGCAtgca"))


def canonical(s: Column) -> Column:
    return F.least(s, reverse_complement(s))


def plus_sign(s: Column) -> Column:
    """Is the sequence its own canonical form?"""
    return s <= reverse_complement(s)


def kmers(s: Column, k: int) -> Column:
    """All windows of k characters; none if the sequence is shorter."""
    n = F.length(s)
    return F.when(n >= k, F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.substring(s, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))


def stranded_kmers(s: Column, k: int) -> Column:
    """All windows of k characters as struct(plus, minus): the window, and its reverse complement, which is a window
    of the whole sequence's, so that is made once."""
    n = F.length(s)

    def pairs(other: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.struct(F.substring(s, i, F.lit(k)).alias("plus"), F.substring(other, n - k + 2 - i, F.lit(k)).alias("minus")))

    return F.when(n >= k, let(reverse_complement(s), pairs)).otherwise(F.array().cast("array<struct<plus:string,minus:string>>"))


def canonical_kmers(s: Column, k: int) -> Column:
    """The canonical form of every window of k characters."""
    return F.transform(stranded_kmers(s, k), lambda w: F.least(w["plus"], w["minus"]))


def hamming(a: Column, b: Column) -> Column:
    """Mismatches of two strings of equal length; null if the lengths differ."""
    pairs = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.when(x == y, 0).otherwise(1))
    return F.when(F.length(a) == F.length(b), F.aggregate(pairs, F.lit(0), lambda t, x: t + x))


def max_homopolymer(s: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(F.regexp_extract_all(s, F.lit(r"((.)\2*)"), 1), F.length)), F.lit(0))


def base_count(s: Column, base: str) -> Column:
    return F.length(s) - F.length(F.replace(s, F.lit(base), F.lit("")))


def shannon(counts: list[Column]) -> Column:
    """Entropy in bits of non-negative counts; 0 without any."""
    total = sum(counts[1:], counts[0])
    term = lambda c: F.when(c > 0, -(c / total) * F.log2(c / total)).otherwise(F.lit(0.0))
    return F.when(total > 0, sum(map(term, counts[1:]), term(counts[0]))).otherwise(F.lit(0.0))


def base_entropy(s: Column) -> Column:
    return let(F.array(*(base_count(s, b) for b in ACGT)), lambda c: shannon([c[i] for i in range(len(ACGT))]))


def primitive(motif: Column) -> Column:
    """Is it no repetition of a shorter motif?"""
    return ~motif.rlike(r"^(.+?)\1+$")


def flank(s: Column, at: Column, size: int) -> Column:
    """size characters on both sides of a 0-based position, clamped."""
    low = F.greatest(at - size, F.lit(0))
    return F.substring(s, low + 1, F.least(at + size + 1, F.length(s)) - low)


def trimmed_number(x: Column, digits: int = 3) -> Column:
    return F.regexp_replace(F.format_string(f"%.{digits}f", x), r"\.?0+$", "")


def log_factorial(n: Column) -> Column:
    """ln n!, from a running sum, for Spark has no lgamma."""
    return F.aggregate(F.when(n >= 2, F.sequence(F.lit(2), n.cast("int"))).otherwise(F.array().cast("array<int>")), F.lit(0.0), lambda a, i: a + F.log(i))


def phred_to_prob(q: Column) -> Column:
    return F.pow(F.lit(10.0), -F.least(q, F.lit(255)) / 10.0)


def prob_to_phred(p: Column) -> Column:
    return F.when(p == 1, F.lit(0.0)).when(p == 0, F.lit(255.0)).otherwise(-10.0 * F.log10(p))


def polar_radius(ref: Column, alt: Column) -> Column:
    return F.log10(1 + F.sqrt(ref * ref + alt * alt))


def polar_angle(ref: Column, alt: Column) -> Column:
    """Angle of (ref, alt), by a cubic in the ratio of their difference and sum; ref and alt are not negative."""
    y = alt + F.lit(1e-10)
    ratio = (ref - y) / (y + ref)
    return F.lit(3.141592653589793 / 4) + (0.1963 * ratio * ratio - 0.9817) * ratio


def step_size(window: Column, overlap: Column) -> Column:
    """Distance of windows that overlap by so many per cent, a multiple of 100."""
    return (F.ceil((100 - overlap) / 100 * window / 100) * 100).cast("long")


def folded(p: Column) -> Column:
    return F.least(F.coalesce(p, F.lit(0.5)), 1 - F.coalesce(p, F.lit(0.5)))


def size_tolerance(size: Column, share: float) -> Column:
    return F.least(F.lit(100), F.greatest(F.lit(3), F.floor(size * share))).cast("int")


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the longest common prefix."""
    n = F.least(F.length(a), F.length(b))
    differs = F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(a, i, F.lit(1)) != F.substring(b, i, F.lit(1)))
    return F.when(n == 0, F.lit(0)).otherwise(let(F.array_position(differs, True), lambda p: F.when(p == 0, n).otherwise((p - 1).cast("int"))))


def core(ref: Column, alt: Column) -> Column:
    """struct(start, ref_core, alt_core): alleles without common prefix, then without common suffix."""

    def cut(start: Column) -> Column:
        r, a = F.substring(ref, start + 1, F.length(ref)), F.substring(alt, start + 1, F.length(alt))
        tail = common_prefix(F.reverse(r), F.reverse(a))
        return let(tail, lambda t: F.struct(start.alias("start"), F.substring(r, F.lit(1), F.length(r) - t).alias("ref_core"), F.substring(a, F.lit(1), F.length(a) - t).alias("alt_core")))

    return let(common_prefix(ref, alt), cut)


def _apart(ref: Column, alt: Column) -> Column:
    """Alleles differ in their first and in their last base, so nothing of them is trimmed."""
    return (F.substring(ref, 1, 1) != F.substring(alt, 1, 1)) & (F.substring(ref, -1, 1) != F.substring(alt, -1, 1))


def classify(ref: Column, alt: Column) -> Column:
    """SNV, INS, DEL, MNP, CPX or REF, by the alleles' cores; cores are cut only where both alleles share one end and neither
    is all of it."""

    def kind(c: Column) -> Column:
        r, a = F.length(c["ref_core"]), F.length(c["alt_core"])
        return (
            F.when((r == 0) & (a == 0), "REF").when(r == 0, "INS").when(a == 0, "DEL").when(r != a, "CPX").when(r == 1, "SNV").otherwise("MNP")
        )

    within = lambda x, y: F.startswith(y, x) | F.endswith(y, x)
    apart, n, m = _apart(ref, alt), F.length(ref), F.length(alt)
    plain = F.when(ref == alt, "REF").when(within(ref, alt), "INS").when(within(alt, ref), "DEL").when(apart & (n != m), "CPX").when(apart, F.when(n == 1, "SNV").otherwise("MNP"))
    return plain.otherwise(let(core(ref, alt), kind))


def variant_length(ref: Column, alt: Column) -> Column:
    """Signed: a deletion's is negative; an MNP's is its core's, an SNV's is 1."""
    n, m = F.length(ref), F.length(alt)
    return F.when(F.isnull(ref) | F.isnull(alt), None).when(n != m, m - n).when(ref == alt, 0).when(_apart(ref, alt), m).otherwise(F.length(core(ref, alt)["alt_core"])).cast("int")


def parsimony(ref: Column, alts: Column, start: Column) -> Column:
    """struct(start, ref, alts): all alleles trimmed together, right then left, each keeping one base."""
    every = lambda arr, edge: F.array_min(F.transform(arr, edge))

    def right(n: Column) -> tuple[Column, Column]:
        return F.substring(ref, F.lit(1), F.length(ref) - n), F.transform(alts, lambda a: F.substring(a, F.lit(1), F.length(a) - n))

    def trimmed(n: Column) -> Column:
        r, a = right(n)
        lead = F.least(every(a, lambda x: F.least(common_prefix(r, x), F.length(x) - 1)), F.length(r) - 1)
        return let(F.greatest(lead, F.lit(0)), lambda k: F.struct((start + k).alias("start"), F.substring(r, k + 1, F.length(r)).alias("ref"), F.transform(a, lambda x: F.substring(x, k + 1, F.length(x))).alias("alts")))

    shared = every(alts, lambda a: F.least(common_prefix(F.reverse(ref), F.reverse(a)), F.length(a) - 1))
    return let(F.greatest(F.least(shared, F.length(ref) - 1), F.lit(0)), trimmed)


def cigar_units(cigar: Column) -> Column:
    """array<struct<len, op>> of a CIGAR string."""
    return F.transform(
        F.regexp_extract_all(cigar, F.lit(r"(\d+[MIDNSHP=X])"), 1),
        lambda u: F.struct(F.regexp_extract(u, r"\d+", 0).cast("int").alias("len"), F.right(u, F.lit(1)).alias("op")),
    )


def cigar_span(units: Column, ops: str) -> Column:
    """Summed lengths of the units whose operation is one of ops."""
    return F.aggregate(units, F.lit(0), lambda t, u: t + F.when(u["op"].isin(*ops), u["len"]).otherwise(0))


def reference_span(units: Column) -> Column:
    return cigar_span(units, "MDN=X")


def query_span(units: Column) -> Column:
    return cigar_span(units, "MIS=X")


def soft_clip_penalty(units: Column) -> Column:
    """Four points for each base clipped at either end."""
    first = F.when(units[0]["op"] == "S", units[0]["len"]).otherwise(0)
    last = F.when((F.size(units) > 1) & (F.element_at(units, -1)["op"] == "S"), F.element_at(units, -1)["len"]).otherwise(0)
    return F.when(F.size(units) > 0, (first + last) * 4).otherwise(0)


def query_position(units: Column, at: Column) -> Column:
    """Query offset of a reference offset; inside a deletion that of the base after it."""
    state = F.struct(F.lit(0).alias("r"), F.lit(0).alias("q"), F.lit(None).cast("int").alias("hit"))

    def step(s: Column, u: Column) -> Column:
        takes_r, takes_q = u["op"].isin(*"MDN=X"), u["op"].isin(*"MIS=X")
        inside = s["hit"].isNull() & takes_r & (at < s["r"] + u["len"])
        hit = F.when(inside, s["q"] + F.when(takes_q, at - s["r"]).otherwise(0)).otherwise(s["hit"])
        grown = lambda name, on: (s[name] + F.when(on, u["len"]).otherwise(0)).alias(name)
        return F.struct(grown("r", takes_r), grown("q", takes_q), hit.cast("int").alias("hit"))

    return F.aggregate(units, state, step, lambda s: F.coalesce(s["hit"], s["q"]))


def edit_distance(units: Column, query: Column, target: Column) -> Column:
    """Mismatches under M, plus lengths of X, I and D; clips don't count."""
    state = F.struct(F.lit(0).alias("r"), F.lit(0).alias("q"), F.lit(0).alias("nm"))

    def step(s: Column, u: Column) -> Column:
        takes_r, takes_q = u["op"].isin(*"MDN=X"), u["op"].isin(*"MIS=X")
        a, b = F.substring(query, s["q"] + 1, u["len"]), F.substring(target, s["r"] + 1, u["len"])
        cost = F.when(u["op"] == "M", hamming(a, b)).when(u["op"].isin("X", "I", "D"), u["len"]).otherwise(0)
        grown = lambda name, on: (s[name] + F.when(on, u["len"]).otherwise(0)).alias(name)
        return F.struct(grown("r", takes_r), grown("q", takes_q), (s["nm"] + F.coalesce(cost, F.lit(0))).alias("nm"))

    return F.aggregate(units, state, step, lambda s: s["nm"])


def soft_clips(units: Column, pos: Column) -> Column:
    """array<struct<size, read_pos, genome_pos>> of the soft clips; deletions move the read position too."""
    state = F.struct(F.lit(0).alias("read"), pos.cast("int").alias("genome"), F.array().cast("array<struct<size:int,read_pos:int,genome_pos:int>>").alias("out"))

    def step(s: Column, u: Column) -> Column:
        clip = u["op"] == "S"
        item = F.array(F.struct(u["len"].alias("size"), s["read"].alias("read_pos"), s["genome"].alias("genome_pos")))
        return F.struct(
            (s["read"] + F.when(u["op"].isin(*"MISD=X"), u["len"]).otherwise(0)).alias("read"),
            (s["genome"] + F.when(u["op"].isin(*"MDN=X"), u["len"]).otherwise(0)).alias("genome"),
            F.when(clip, F.concat(s["out"], item)).otherwise(s["out"]).alias("out"),
        )

    return F.aggregate(units, state, step, lambda s: s["out"])


def md_mismatches(md: Column, pos: Column) -> Column:
    """Reference positions of the mismatches that an MD tag tells of; deleted bases are passed over."""
    parts = F.regexp_extract_all(md, F.lit(r"(\d+|\^[A-Za-z]+|[A-Za-z])"), 1)
    state = F.struct(pos.cast("long").alias("at"), F.array().cast("array<bigint>").alias("out"))

    def step(s: Column, p: Column) -> Column:
        skip = F.when(p.rlike(r"^\d"), p.try_cast("long")).when(p.startswith("^"), F.length(p) - 1).otherwise(1)
        out = F.when(p.rlike("^[A-Za-z]"), F.concat(s["out"], F.array(s["at"]))).otherwise(s["out"])
        return F.struct((s["at"] + skip).cast("long").alias("at"), out.alias("out"))

    return F.aggregate(parts, state, step, lambda s: s["out"])


def region(text: Column) -> Column:
    """struct(chrom, start1, end1) of ``chr``, ``chr:from-to``, ``chr:from-``, ``chr:-to``, ``chr:at`` or ``{name:with:colon}:...``."""
    inner, plain = r"^\{(.+)\}(?::(\d*)(-?)(\d*))?$", r"^([^:{}]+)(?::(\d*)(-?)(\d*))?$"

    def part(g: int) -> Column:
        return F.when(text.startswith("{"), F.regexp_extract(text, inner, g)).otherwise(F.regexp_extract(text, plain, g))

    number = lambda g: F.when(part(g) != "", F.replace(part(g), F.lit(","), F.lit("")).cast("long"))
    end = F.coalesce(number(4), F.when((part(3) == "") & (part(2) != ""), number(2)))
    return F.struct(part(1).alias("chrom"), number(2).alias("start1"), end.alias("end1"))


def region_text(chrom: Column, start1: Column, end1: Column) -> Column:
    name = F.when(F.contains(chrom, F.lit(":")), F.concat(F.lit("{"), chrom, F.lit("}"))).otherwise(chrom)
    return F.concat(name, F.lit(":"), start1.cast("string"), F.lit("-"), end1.cast("string"))


def alt_haplotype(ref_seq: Column, offset: Column, ref: Column, alt: Column) -> Column:
    """The reference with alt in place of ref at a 0-based offset."""
    return F.concat(F.substring(ref_seq, F.lit(1), offset), alt, F.substring(ref_seq, offset + F.length(ref) + 1, F.length(ref_seq)))


def allele_context(ref_seq: Column, offset: Column, ref: Column, alt: Column, k: int) -> Column:
    """alt with k-1 reference bases on both sides."""
    low = F.greatest(offset - (k - 1), F.lit(0))
    return F.concat(F.substring(ref_seq, low + 1, offset - low), alt, F.substring(ref_seq, offset + F.length(ref) + 1, F.lit(k - 1)))


def read_carries(kind: Column, read: Column, at: Column, ref: Column, alt: Column, units: Column) -> Column:
    """Does a read show the allele at the 0-based query offset at?"""
    snv = F.substring(read, at + 1, F.length(alt)) == alt
    size = F.abs(F.length(alt) - F.length(ref))
    gap = lambda op: F.exists(units, lambda u: (u["op"] == op) & (u["len"] == size))
    return F.when(kind.isin("SNV", "MNP"), snv).when(kind == "INS", gap("I") & snv).when(kind == "DEL", gap("D")).otherwise(snv)


# Bits of the SAM flag (fixed values of the SAM specification).
FLAGS = {
    "paired": 0x1, "proper_pair": 0x2, "unmapped": 0x4, "mate_unmapped": 0x8, "reverse": 0x10, "mate_reverse": 0x20,
    "read1": 0x40, "read2": 0x80, "secondary": 0x100, "qc_fail": 0x200, "duplicate": 0x400, "supplementary": 0x800,
}


def has_flag(flag: Column, *names: str) -> Column:
    """Is any of these bits set?"""
    return flag.bitwiseAND(sum(FLAGS[n] for n in names)) != 0


def read_passes(flag: Column, mapq: Column) -> Column:
    return ~has_flag(flag, "qc_fail", "duplicate", "unmapped") & (mapq >= 20)


def scan_passes(flag: Column, mapq: Column) -> Column:
    return ~has_flag(flag, "qc_fail", "duplicate", "unmapped") & (mapq != 0)


def starts_in(chrom: Column, pos: Column, region_chrom: Column, start1: Column, end1: Column) -> Column:
    """Does an alignment, or its mate, begin in a region? Where it ends does not matter."""
    return (chrom == region_chrom) & pos.between(start1, end1)


def soft_clipped(units: Column, read_length: Column) -> Column:
    return cigar_span(units, "S") / read_length >= 0.06


def excluded_contig(chrom: Column) -> Column:
    return chrom.rlike(r"^(MT|chrM|GL.*|chrUn.*|chrEBV.*|HLA-.*|.*_random|.*_alt|.*_decoy)$")


def kmer_supported(quals: Column, k: int) -> Column:
    """For each k-window: do its error probabilities sum to less than one? By prefix sums, in one pass."""
    probs = F.transform(quals, lambda q: phred_to_prob(q))
    sums = F.aggregate(probs, F.array(F.lit(0.0)), lambda a, p: F.concat(a, F.array(F.element_at(a, -1) + p)))
    return let(sums, lambda s: F.when(F.size(s) > k, F.transform(F.sequence(F.lit(0), F.size(s) - k - 1), lambda i: F.floor(F.get(s, i + k) - F.get(s, i)) == 0)).otherwise(F.array().cast("array<boolean>")))
