r"""Quality rules: base counts, and divergence from language references, in DataFrame functions only.

A document's histograms of character classes and of common words are compared with those of each
language (built from all documents) by Jensen-Shannon divergence, base 2. A language fits if both
divergences are within their limits; a document is kept if some language fits. Short documents have
noisy histograms: below MIN_CHARS characters the classes, below MIN_WORDS letter words the common words
are not held against a document.

Common words are the COMMON most frequent letter runs of at most WORD_CHARS letters of each language; a
language without any is judged on character classes alone. References of all languages count: those of the
LANGUAGES languages with the most documents stand in the plan, the others in a table of one row beside it.
A language weighs a few hundred bytes there, and a corpus has some thousands of languages at most.

Defined cases: a null text is empty; a document without words has zero counts and fails the base rules;
a null lang is in no reference but is judged as any other; a null doc_id is judged as any other; repeated
rows are judged one by one; very long texts count in full; an empty table gives no rows; other columns are
carried along by judged(), which names its own columns so that none clashes.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandloom.llm.common import free_names

BLANK = r"[ \t\n\x0B\f\r]"
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 5
COMMON, WORD_CHARS, LANGUAGES = 16, 5, 32
MIN_CHARS, MIN_WORDS = 200, 50
#: Largest divergences of a document that fits, of character classes and of common words. A histogram
#: of n draws diverges from its own source by a share of 1/n, which the limits allow for.
CLASS_LIMIT, CLASS_NOISE = 0.05, 10.0
WORD_LIMIT, WORD_NOISE = 0.045, 3.5
CLASSES = ("lower", "upper", "digit", "blank", "symbol", "other")


@dataclass
class Reference:
    """Shares of a language: by class, and by common word with all other words at the end."""

    classes: list[float]
    words: list[str]
    shares: list[float]


def without(text: Column, pattern: str) -> Column:
    """Characters left when all that matches is taken out."""
    return F.length(F.regexp_replace(text, pattern + "+", ""))


def class_counts(text: Column, base: Column | None = None) -> Column:
    """Characters by class, in the order of CLASSES; base counts tell of blanks and symbols already."""
    n = F.length(text)
    parts = [n - without(text, p) for p in (r"\p{Ll}", r"\p{Lu}", "[0-9]")]
    parts += [n - without(text, BLANK), n - without(text, SYMBOLS)] if base is None else [(n - base["word_chars"]).cast("int"), base["n_symbols"].cast("int")]
    return F.array(*parts, n - sum(parts[1:], parts[0]))


def letter_words(text: Column) -> Column:
    """Runs of letters, in lower case."""
    return F.array_remove(F.split(F.lower(F.regexp_replace(text, r"[^\p{L}]+", " ")), " "), "")


def _let(value: Column, body) -> Column:
    """body(value), with value computed once however often body refers to it."""
    return F.transform(F.array(value), body)[0]


def repeat_words(words: Column) -> Column:
    """Words in windows of five that occur twice or more; windows are held equal by 64-bit hash."""

    def marked(s: Column) -> Column:
        same = lambda x, i: F.coalesce((F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"]), F.get(s, i - 1)["h"] == x["h"], F.get(s, i + 1)["h"] == x["h"], F.lit(False))
        return F.array_sort(F.transform(F.filter(s, same), lambda x: x["i"]))

    def covered(at: Column) -> Column:
        reach = F.transform(at, lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(at, k + 1), p + WINDOW) - p))
        return F.aggregate(reach, F.lit(0), lambda a, x: a + x)

    def counted(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        twice = _let(pairs, lambda s: _let(marked(s), covered))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(twice)

    def windows(hashes: Column) -> Column:
        """Each window's hash, of its words' hashes."""
        return F.transform(F.sequence(F.lit(0), F.size(hashes) - WINDOW), lambda i: F.xxhash64(*(F.get(hashes, i + k) for k in range(WINDOW))))

    hashes = F.transform(words, lambda x: F.xxhash64(x))
    return F.when(F.size(words) <= WINDOW, F.lit(0)).otherwise(_let(hashes, lambda x: _let(windows(x), counted)))


def dup_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^ \t\n\x0B\f\r]"))
    return _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))


def base_counts(text: Column) -> Column:
    """Struct of n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) of a text without nulls."""
    words = F.array_remove(F.split(text, BLANK + "+"), "")
    counts = lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"),
        without(text, BLANK).cast("long").alias("word_chars"),
        (F.length(text) - without(text, SYMBOLS)).cast("long").alias("n_symbols"),
        dup_lines(text).cast("long").alias("n_dup_lines"),
        repeat_words(w).cast("long").alias("n_repeat_words"),
    )
    return _let(words, counts)


def base_failed(base: Column) -> Column:
    return (base["n_words"] < 10) | (100 * base["n_repeat_words"] > 20 * base["n_words"])


def references(docs: DataFrame) -> list[Reference]:
    """Shares by language over all documents, most documents first; a row a language and its common words come
    to the driver."""
    rows = docs.select("lang", F.coalesce("text", F.lit("")).alias("text")).filter("lang IS NOT NULL")
    sums = (
        rows.select("lang", class_counts(F.col("text")).alias("c"), F.regexp_count("text", F.lit(r"\p{L}+")).alias("n"))
        .groupBy("lang")
        .agg(F.count("*").alias("docs"), F.sum("n").alias("n"), *(F.sum(F.col("c")[k]).alias(x) for k, x in enumerate(CLASSES)))
        .orderBy(F.desc("docs"), "lang")
        .collect()
    )
    counted = (
        rows.select("lang", F.explode(letter_words(F.col("text"))).alias("word"))
        .filter(F.length("word") <= WORD_CHARS)
        .groupBy("lang", "word")
        .agg(F.count("*").alias("n"))
    )
    order = W.partitionBy("lang").orderBy(F.desc("n"), "word")
    top = counted.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= COMMON)
    words: dict[str, list] = {}
    for r in sorted(top.collect(), key=lambda r: r["k"]):
        words.setdefault(r["lang"], []).append((r["word"], r["n"]))
    out = []
    for r in sums:
        own, chars = words.get(r["lang"], []), sum(r[x] for x in CLASSES)
        if chars:
            shares = [n / r["n"] for _, n in own]
            out.append(Reference([r[x] / chars for x in CLASSES], [w for w, _ in own], [*shares, 1.0 - sum(shares)]))
    return out


def divergence(shares: Column, reference: list[float] | Column) -> Column:
    """Jensen-Shannon, base 2: 0 for equal distributions, 1 for disjoint ones."""

    def term(p: Column, q: Column) -> Column:
        part = lambda x: F.when(x > 0, x * F.log2(2 * x / (p + q))).otherwise(F.lit(0.0))
        return (part(p) + part(q)) / 2

    other = reference if isinstance(reference, Column) else F.array(*map(F.lit, reference))
    return F.aggregate(F.zip_with(shares, other, term), F.lit(0.0), lambda a, x: a + x)


def fits(text: Column, base: Column, refs: list[Reference], others: Column | None = None) -> Column:
    """Does some language fit, of refs or of others (an array of such structs)? Without references nothing is
    held against a document."""
    if not refs:
        return F.lit(True)
    known = sorted({w for r in refs for w in r.words})

    def judge(v: Column) -> Column:
        chars, n, common = F.length(text), v["n"], v["common"]
        classes = F.transform(v["classes"], lambda x: x / chars)

        def by_word(r: Reference) -> Column:
            counts = [F.size(common) - F.size(F.array_remove(common, w)) for w in r.words]
            every = F.array(*counts, n - sum(counts[1:], counts[0]))
            return divergence(F.transform(every, lambda x: x / n), r.shares) <= WORD_LIMIT + WORD_NOISE / n

        def fits_other(r: Column) -> Column:
            counts = F.transform(r["words"], lambda w: F.size(v["short"]) - F.size(F.array_remove(v["short"], w)))
            every = F.concat(counts, F.array(n - F.aggregate(counts, F.lit(0), lambda a, x: a + x)))
            words = (n < MIN_WORDS) | (divergence(F.transform(every, lambda x: x / n), r["shares"]) <= WORD_LIMIT + WORD_NOISE / n)
            return ((chars < MIN_CHARS) | (divergence(classes, r["classes"]) <= CLASS_LIMIT + CLASS_NOISE / chars)) & words

        tests = [((chars < MIN_CHARS) | (divergence(classes, r.classes) <= CLASS_LIMIT + CLASS_NOISE / chars)) & ((n < MIN_WORDS) | by_word(r)) for r in refs]
        out = tests[0]
        for t in tests[1:]:
            out = out | t
        return out if others is None else out | F.exists(others, fits_other)

    def counted(w: Column) -> Column:
        parts = [class_counts(text, base).alias("classes"), F.size(w).alias("n"), F.filter(w, lambda x: x.isin(known)).alias("common")]
        return F.struct(*parts, *([] if others is None else [F.filter(w, lambda x: F.length(x) <= WORD_CHARS).alias("short")]))

    return _let(letter_words(text), lambda w: _let(counted(w), judge))


@dataclass
class Judged:
    """docs with three more columns, whose names no column of docs had."""

    rows: DataFrame
    base: str
    failed: str
    kept: str


def judged(docs: DataFrame, refs: list[Reference] | None = None) -> Judged:
    """docs with the struct of base counts, whether they fail the base rules, and whether the document is kept."""
    refs = references(docs) if refs is None else refs
    base, failed, kept, others = free_names(docs, "base", "failed", "kept", "others")
    text = F.coalesce(F.col("text"), F.lit(""))
    out = docs.withColumn(base, base_counts(text))
    out = out.withColumn(failed, base_failed(F.col(base)))
    # One reference to the counts: a filter on the verdict that moves below them computes them once.
    verdict = lambda *more: _let(F.col(base), lambda b: F.when(base_failed(b), F.lit(False)).otherwise(fits(text, b, refs[:LANGUAGES], *more)))
    if len(refs) <= LANGUAGES:
        return Judged(out.withColumn(kept, verdict()), base, failed, kept)
    rest = [(r.classes, r.words, r.shares) for r in refs[LANGUAGES:]]
    beside = docs.sparkSession.createDataFrame([(rest,)], f"{others} array<struct<classes: array<double>, words: array<string>, shares: array<double>>>")
    return Judged(out.crossJoin(F.broadcast(beside)).withColumn(kept, verdict(F.col(others))).drop(others), base, failed, kept)


def oracle_sql() -> str:
    """The rules over all documents as DuckDB SQL."""
    order = ", ".join(f"c{k}" for k in range(len(CLASSES)))
    sums = ", ".join(f"sum(c{k}) AS c{k}" for k in range(len(CLASSES)))
    blank = r"[\x20\x09-\x0D]"
    term = "CASE WHEN {0} > 0 THEN {0} * log2(2 * {0} / ({0} + {1})) ELSE 0 END"
    js = lambda p, q: f"sum(({term.format(p, q)} + {term.format(q, p)}) / 2)"
    return rf"""
    WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS text, row_number() OVER (ORDER BY doc_id, text) AS r FROM documents),
    f AS (
        SELECT *, length(text) AS chars, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
            regexp_extract_all(lower(text), '\p{{L}}+') AS runs,
            length(text) - length(regexp_replace(text, '\p{{Ll}}+', '', 'g')) AS c0,
            length(text) - length(regexp_replace(text, '\p{{Lu}}+', '', 'g')) AS c1,
            length(text) - length(regexp_replace(text, '[0-9]+', '', 'g')) AS c2,
            length(text) - length(regexp_replace(text, '{blank}+', '', 'g')) AS c3,
            length(text) - length(regexp_replace(text, '{SYMBOLS}+', '', 'g')) AS c4,
            list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
        FROM d),
    g AS (SELECT *, chars - c0 - c1 - c2 - c3 - c4 AS c5 FROM f),
    win AS (
        SELECT r, i, list_slice(words, i, i + {WINDOW - 1}) AS w
        FROM (SELECT r, words, unnest(range(1, len(words) - {WINDOW - 2})) AS i FROM g WHERE len(words) >= {WINDOW})),
    twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, w) AS n FROM win) WHERE n > 1),
    rep AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest(range(i, i + {WINDOW})) AS j FROM twice) GROUP BY r),
    base AS (
        SELECT g.*, len(words)::BIGINT AS n_words, (chars - c3)::BIGINT AS word_chars, c4::BIGINT AS n_symbols,
            (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words
        FROM g LEFT JOIN rep USING (r)),
    ls AS (SELECT lang, sum(chars) AS chars, sum(len(runs)) AS n, {sums} FROM g WHERE lang IS NOT NULL GROUP BY lang),
    counted AS (
        SELECT lang, word, count(*) AS n FROM (SELECT lang, unnest(runs) AS word FROM g WHERE lang IS NOT NULL)
        WHERE length(word) <= {WORD_CHARS} GROUP BY lang, word),
    top AS (
        SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) AS k FROM counted QUALIFY k <= {COMMON}),
    refs AS (SELECT * FROM ls WHERE chars > 0),
    shares AS (
        SELECT top.lang, k, word, top.n / refs.n AS q FROM top JOIN refs USING (lang)
        UNION ALL SELECT lang, {COMMON + 1}, NULL, 1 - coalesce(sum(top.n / refs.n), 0) FROM refs LEFT JOIN top USING (lang) GROUP BY lang),
    dw AS (SELECT r, word, count(*) AS n FROM (SELECT r, unnest(runs) AS word FROM g) GROUP BY r, word),
    hits AS (SELECT dw.r, top.lang, top.k, dw.n FROM dw JOIN top USING (word)),
    own AS (
        SELECT base.r, s.lang, s.k, s.q, len(base.runs) AS total,
            CASE WHEN s.word IS NULL THEN len(base.runs) - coalesce(sum(h.n) OVER (PARTITION BY base.r, s.lang), 0) ELSE coalesce(h.n, 0) END AS n
        FROM base CROSS JOIN shares s LEFT JOIN hits h ON h.r = base.r AND h.lang = s.lang AND h.k = s.k),
    wd AS (SELECT r, lang, {js('p', 'q')} AS dist FROM (SELECT r, lang, q, n / total AS p FROM own WHERE total >= {MIN_WORDS}) GROUP BY r, lang),
    cd AS (
        SELECT r, lang, {js('p', 'q')} AS dist
        FROM (SELECT base.r, refs.lang, unnest([{', '.join(f'base.c{k} / base.chars' for k in range(len(CLASSES)))}]) AS p,
                unnest([{', '.join(f'refs.c{k} / refs.chars' for k in range(len(CLASSES)))}]) AS q
            FROM base CROSS JOIN refs WHERE base.chars >= {MIN_CHARS})
        GROUP BY r, lang),
    fit AS (
        SELECT base.r, bool_or((base.chars < {MIN_CHARS} OR cd.dist <= {CLASS_LIMIT} + {CLASS_NOISE} / base.chars) AND (len(base.runs) < {MIN_WORDS} OR wd.dist <= {WORD_LIMIT} + {WORD_NOISE} / len(base.runs))) AS fits
        FROM base CROSS JOIN refs LEFT JOIN cd ON cd.r = base.r AND cd.lang = refs.lang LEFT JOIN wd ON wd.r = base.r AND wd.lang = refs.lang
        GROUP BY base.r)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
        n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
        NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND coalesce(fits, true) AS kept
    FROM base LEFT JOIN fit USING (r)"""
