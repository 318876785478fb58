"""Source divergence audit: how the words of each source differ from those of the others and of its language.

A byte-level tokenizer finds words on the concatenated UTF-8 buffers of Arrow batches by a lookup table; equal
words are grouped by xxhash, and every word is then compared byte by byte with the first of its group, words that
only share the hash being told apart. Tasks send counts by (lang, source, word), which are summed before and after
the shuffle. A language keeps the words of at least LEAST of its documents; they are dealt by hash into slices of
about SLICE counts, so that neither a frequent word nor a large language meets in one task. A slice is a CSR
matrix of words by sources; numpy's reduceat adds its divergences source by source, and the sums of the slices are
added up.

A word's share of a source is p = 1 + floor(SCALE * (count + 1) / (N + V)), N the source's count of kept words and V
their number; the divergence of shares p from q is the sum of floor((p - q)^2 / q). All is integer arithmetic: counts
may go to 2 * 10^14, above which a step would leave 64 bits.

Defined cases: null texts, languages and sources are empty strings; a row is a document, repeated rows too; a source
without kept words, or of a language without any, has rows of `pair` (of value 0 if the language keeps no word) and
none of `term`; a source that is alone in its language has no row; ties go to the item that is smaller in UTF-8; a
very long text is one chunk of its own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandloom.llm.bytewords import chunks, flat, spans, texts_of, word_table
from strandloom.llm.common import Scratch, stored

#: Letters of ASCII and all other characters make words.
LETTERS = ((0x00, 0x40), (0x5B, 0x60), (0x7B, 0x7F))
SCALE, LEAST, TOP = 1_000_000_000, 3, 200
#: Counts of a slice; counts that a task holds before it sends them.
SLICE, HELD = 1 << 18, 1 << 20


def grouped(low: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of each word's group, and the word that stands for each group: groups hold equal bytes."""
    text, digest = low.tobytes(), xxhash.xxh3_64_intdigest
    hashes = np.fromiter((digest(text[a:b]) for a, b in zip(start.tolist(), end.tolist())), np.uint64, len(start))
    _, first, group = np.unique(hashes, return_index=True, return_inverse=True)
    length = end - start
    other = length != length[first][group]
    same = np.flatnonzero(~other)
    if len(same):
        mine, theirs = flat(start[same], length[same]), flat(start[first][group[same]], length[same])
        wrong = np.flatnonzero(low[mine] != low[theirs])
        other[same[np.searchsorted(np.cumsum(length[same]), wrong, side="right")]] = True
    if other.any():  # a hash of two words: the others get groups by their bytes
        found: dict[tuple[int, bytes], int] = {}
        firsts = first.tolist()
        for i in np.flatnonzero(other).tolist():
            key = (int(group[i]), text[start[i] : end[i]])
            if key not in found:
                found[key] = len(firsts)
                firsts.append(i)
            group[i] = found[key]
        first = np.array(firsts)
    return group, first


def counted(data: np.ndarray, offsets: np.ndarray, owner: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """owner, word, occurrences and documents: of each word of each owner (an integer by text)."""
    low, start, end, text = spans(data, offsets, table)
    if not len(start):
        return np.zeros(0, np.int64), pa.array([], pa.string()), np.zeros(0, np.int64), np.zeros(0, np.int64)
    group, first = grouped(low, start, end)
    k = len(first)
    in_text, n = np.unique(text * k + group, return_counts=True)
    key, back = np.unique(owner[in_text // k] * k + in_text % k, return_inverse=True)
    count, docs = np.bincount(back, n).astype(np.int64), np.bincount(back)
    length = (end - start)[first]
    ends = np.concatenate([[0], np.cumsum(length)])
    word = pa.LargeStringArray.from_buffers(k, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(low[flat(start[first], length)]))
    return key // k, word.take(pa.array(key % k)).cast(pa.string()), count, docs


def word_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n, df: sums by task. Every (lang, source) also has a row of the empty term."""
    rows = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    table = word_table(*LETTERS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code: dict[tuple[str, str], int] = {}
        held: list[pa.Table] = []

        def combined() -> pa.Table:
            t = pa.concat_tables(held).group_by(["owner", "term"], use_threads=False).aggregate([("n", "sum"), ("df", "sum")])
            return t.select(["owner", "term", "n_sum", "df_sum"]).rename_columns(["owner", "term", "n", "df"])

        def sent(t: pa.Table) -> Iterator[pa.RecordBatch]:
            owners, at = list(code), t.column("owner").combine_chunks()
            lang, source = (pa.array([o[j] for o in owners], pa.string()).take(at) for j in (0, 1))
            yield from pa.table({"lang": lang, "source": source, "term": t.column("term"), "n": t.column("n"), "df": t.column("df")}).to_batches(1 << 16)

        size = 0
        for b in batches:
            if not b.num_rows:
                continue
            owner = np.array([code.setdefault(o, len(code)) for o in zip(b.column("lang").to_pylist(), b.column("source").to_pylist())], np.int64)
            data, offsets = texts_of(b.column("text"))
            for i, j in chunks(offsets):
                at = offsets[i : j + 1]
                who, term, n, df = counted(data[at[0] : at[-1]], at - at[0], owner[i:j], table)
                held.append(pa.table({"owner": pa.array(who, pa.int64()), "term": term, "n": pa.array(n, pa.int64()), "df": pa.array(df, pa.int64())}))
                size += len(who)
                if size >= HELD:
                    whole = combined()
                    held, size = [whole], whole.num_rows
                    if size >= HELD // 2:
                        yield from sent(whole)
                        held, size = [], 0
        if code:
            none = pa.array(np.zeros(len(code), np.int64))
            held.append(pa.table({"owner": pa.array(range(len(code)), pa.int64()), "term": pa.array([""] * len(code)), "n": none, "df": none}))
            yield from sent(combined())

    return rows.mapInArrow(count, "lang string, source string, term string, n long, df long")


def share(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * (count + 1) / total), SCALE in two factors so that no product leaves 64 bits."""
    a, b = 31_250, SCALE // 31_250
    whole, left = np.divmod((count + 1) * a, total)
    return 1 + whole * b + left * b // total


def excess(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = p - q
    return d * d // q


def slice_divergence(counts: np.ndarray, column: np.ndarray, indptr: np.ndarray, totals: np.ndarray, kinds: int, whole: int):
    """Of a slice of words by sources (CSR by word, with no empty word): yields for each source b the sums over the slice's
    words of every source's divergence from b; then, once, the rows with the share above the language's and the excess there.

    totals: N of each source; kinds: V; whole: N of the language.
    """
    words, s = len(indptr) - 1, len(totals)
    term = np.repeat(np.arange(words), np.diff(indptr))
    by_source = np.argsort(column, kind="stable")
    row, col, n = column[by_source], term[by_source], counts[by_source]
    ptr = np.searchsorted(row, np.arange(s + 1))
    used = np.flatnonzero(ptr[1:] > ptr[:-1])  # reduceat wants rows that are not empty

    def sums(values: np.ndarray) -> np.ndarray:
        out = np.zeros(s, np.int64)
        if len(values):
            out[used] = np.add.reduceat(values, ptr[used])
        return out

    total = totals + kinds
    p, none = share(n, total[row]), share(np.zeros(s, np.int64), total)
    missing = words - (ptr[1:] - ptr[:-1])
    # base[a, b]: as if a had no word of the slice; put right below where it has.
    for b in range(s):
        q = np.full(words, none[b])
        mine = slice(ptr[b], ptr[b + 1])
        q[col[mine]] = p[mine]
        at = q[col]
        base = np.array([excess(none[a], p[mine]).sum() for a in range(s)], np.int64) if ptr[b + 1] > ptr[b] else np.zeros(s, np.int64)
        yield base + missing[b] * excess(none, none[b]) + sums(excess(p, at) - excess(none[row], at))
    if words:
        q = share(np.add.reduceat(counts, indptr[:-1]), np.int64(whole + kinds))[col]
        over = np.flatnonzero(p > q)
        yield row[over], col[over], excess(p[over], q[over])


def divergences(kept: DataFrame, sources: DataFrame, slices: int) -> DataFrame:
    """lang, source, part, item, value of every slice of kept (lang, term, sources, counts), given sources
    (lang, source, n, kinds, whole); items of `term` are those that can be among the TOP of the source."""

    def judge(cells: pa.Table, own: pa.Table) -> pa.Table:
        own = own.sort_by("source")
        names, totals = own.column("source").combine_chunks(), own.column("n").to_numpy()
        s, lang = len(names), own.column("lang")[0].as_py()
        lists, n = cells.column("sources").combine_chunks(), cells.column("counts").combine_chunks()
        indptr = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]).astype(np.int64)
        column = pc.index_in(lists.flatten(), value_set=names).to_numpy(zero_copy_only=False).astype(np.int64)
        counts = n.flatten().to_numpy(zero_copy_only=False)
        out = []
        for b, found in enumerate(slice_divergence(counts, column, indptr, totals, own.column("kinds")[0].as_py(), own.column("whole")[0].as_py())):
            if b < s:
                others = np.flatnonzero(np.arange(s) != b)
                item, value = pa.array([names[b].as_py()] * len(others), pa.string()), found[others]
                part, source = "pair", names.take(pa.array(others))
            else:
                row, col, value = found
                term = cells.column("term").combine_chunks().take(pa.array(col))
                rank = pc.rank(term, sort_keys="ascending", tiebreaker="dense").to_numpy() if len(term) else np.zeros(0, np.int64)
                order = np.lexsort((rank, -value, row))
                first = np.searchsorted(row[order], row[order], side="left")
                order = order[np.arange(len(order)) - first < TOP]
                item, value, part, source = term.take(pa.array(order)), value[order], "term", names.take(pa.array(row[order]))
            out.append(pa.table({"lang": pa.array([lang] * len(source), pa.string()), "source": source, "part": pa.array([part] * len(source), pa.string()), "item": item.cast(pa.string()), "value": pa.array(value, pa.int64())}))
        return pa.concat_tables(out)

    dealt = kept.withColumn("slice", F.pmod(F.xxhash64("term"), F.lit(slices)))
    spread = sources.withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slices - 1).cast("long"))))
    pairs = dealt.groupBy("lang", "slice").cogroup(spread.groupBy("lang", "slice"))
    return pairs.applyInArrow(judge, "lang string, source string, part string, item string, value long")


def audit(docs: DataFrame) -> DataFrame:
    """lang, source, part, item, value, rank: `pair` has every other source of the language, `term` the TOP words that the
    source has more of than its language."""
    with Scratch(docs.sparkSession, "divergence") as scratch:
        sums = word_counts(docs).groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))
        cell = F.struct("source", "n")
        terms = sums.groupBy("lang", "term").agg(F.sum("df").alias("df"), F.collect_list(cell).alias("cells"))
        terms = scratch.stored(terms.filter((F.col("df") >= LEAST) | (F.col("term") == "")), "terms")
        kept = terms.filter("term <> ''").select("lang", "term", F.col("cells.source").alias("sources"), F.col("cells.n").alias("counts"))
        totals = kept.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("x")).groupBy("lang", F.col("x.sources").alias("source")).agg(F.sum("x.counts").alias("n"), F.count("*").alias("cells"))
        totals = scratch.stored(totals, "totals")
        kinds = kept.groupBy("lang").agg(F.count("*").alias("kinds"))
        groups = terms.filter("term = ''").select("lang", F.explode("cells.source").alias("source"))
        sources = groups.join(totals, ["lang", "source"], "left").join(kinds, "lang", "left")
        whole = F.sum("n").over(W.partitionBy("lang"))
        sources = sources.select("lang", "source", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("kinds", F.lit(0)).alias("kinds")).withColumn("whole", whole)
        size = totals.agg(F.sum("cells")).head()[0] or 0
        found = scratch.stored(divergences(kept, scratch.stored(sources, "sources"), max(1, -(-size // SLICE))), "found")
        order = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
        pair = found.filter("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value")).withColumn("rank", F.row_number().over(order))
        term = found.filter("part = 'term'").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= TOP)
        return stored(pair.unionByName(term), "divergence-result")


def oracle_sql() -> str:
    """DuckDB SQL of the audit."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    p = lambda n, total: f"1 + ({SCALE}::HUGEINT * ({n} + 1)) // ({total})"
    return rf"""
    WITH d AS (
        SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
            regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
        FROM documents),
    t AS (SELECT row, lang, source, unnest(terms) AS term FROM d),
    kept AS (SELECT lang, term FROM t GROUP BY ALL HAVING count(DISTINCT row) >= {LEAST}),
    c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN kept USING (lang, term) GROUP BY ALL),
    g AS (SELECT DISTINCT lang, source FROM d),
    v AS (SELECT lang, count(*) AS v FROM kept GROUP BY ALL),
    ns AS (SELECT lang, source, sum(n)::BIGINT AS total FROM c GROUP BY ALL),
    nl AS (SELECT lang, sum(n)::BIGINT AS whole FROM c GROUP BY ALL),
    cell AS MATERIALIZED (
        SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, {p("coalesce(c.n, 0)", "coalesce(ns.total, 0) + v.v")} AS p
        FROM g JOIN kept k USING (lang) JOIN v USING (lang) LEFT JOIN c USING (lang, source, term) LEFT JOIN ns USING (lang, source)),
    whole AS (SELECT lang, term, {p("sum(n)", "any_value(nl.whole) + any_value(v.v)")} AS q FROM c JOIN nl USING (lang) JOIN v USING (lang) GROUP BY lang, term),
    pairs AS (
        SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
        FROM cell a JOIN cell b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
    found AS (
        SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(pairs.value, 0) AS value
        FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
        LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source
        UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM cell JOIN whole USING (lang, term) WHERE n > 0 AND p > q)
    SELECT lang, source, part, item, value::BIGINT AS value,
        (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank
    FROM found QUALIFY part = 'pair' OR rank <= {TOP}"""
