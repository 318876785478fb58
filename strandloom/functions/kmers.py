"""K-mers of up to 31 bases as 64-bit numbers of two bits a base, made on arrays; their order is that of the strings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CODE = np.full(256, 4, np.uint8)
CODE[np.frombuffer(b"ACGT", np.uint8)] = range(4)


def codes(bases: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of all windows of k bases (0 to 3), and of their reverse complements.

    Windows of length a and b that stand side by side give those of a + b, so log2(k) steps make all.
    """
    n = len(bases) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    one = bases.astype(np.int64)
    part = (one, 3 - one)  # windows of `width`, forwards and backwards
    width, whole, have = 1, None, 0
    while width <= k:
        if k & width:
            if whole is None:
                whole = part
            else:
                m = len(bases) - have - width + 1
                whole = tuple(w[:m] for w in whole), tuple(p[have : have + m] for p in part)
                (f, r), (g, s) = whole
                whole = (f << 2 * width) + g, r + (s << 2 * have)
            have += width
        m = len(part[0]) - width
        if 2 * width > k:
            break
        f, r = part
        part = (f[:m] << 2 * width) + f[width : width + m], r[:m] + (r[width : width + m] << 2 * width)
        width *= 2
    return whole[0][:n], whole[1][:n]


def text_places(text: str, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the windows that hold A, C, G and T only, and their codes()."""
    bases = CODE[np.frombuffer(text.encode(), np.uint8)]
    if len(bases) < k:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    bad = np.concatenate([[0], np.cumsum(bases > 3)])
    fine = np.flatnonzero(bad[k:] == bad[:-k])
    f, r = codes(np.minimum(bases, 3), k)
    return fine, f[fine], r[fine]


def text_codes(text: str, k: int) -> tuple[np.ndarray, np.ndarray]:
    """As codes(), without the windows that hold anything but A, C, G and T."""
    return text_places(text, k)[1:]


def text_minimizers(text: str, k: int, w: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place, number and own strand of the canonical k-mers that have the least hash of some w k-mers in a row (the first at
    a tie): two texts that share w + k - 1 bases share one of these."""
    place, f, r = text_places(text, k)
    number = np.minimum(f, r)
    h = number.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    if not len(h):
        return place, number, f <= r
    seen = np.lib.stride_tricks.sliding_window_view(h, min(w, len(h)))
    at = np.unique(seen.argmin(axis=1) + np.arange(len(seen)))
    return place[at], number[at], (f <= r)[at]


def canonical_counts(texts: DataFrame, text: str, k: int) -> DataFrame:
    """kmer (number of the canonical form), n of all texts; counted in each batch, then across them."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [np.minimum(*text_codes(t, k)) for t in b.column(0).to_pylist() if t]
            kmer, n = np.unique(np.concatenate([np.zeros(0, np.int64), *own]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(kmer), pa.array(n, pa.int64())], names=["kmer", "n"])

    return texts.select(text).mapInArrow(count, "kmer long, n long").groupBy("kmer").agg(F.sum("n").alias("n"))


def word_counts(df: DataFrame, key: str, text: str, k: int) -> DataFrame:
    """key, word, c: how often each window of k bases stands in each key's texts; of a text without any a row of no word."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [np.unique(text_codes(t or "", k)[0], return_counts=True) for t in b.column(1).to_pylist()]
            found = [x if len(x[0]) else (np.array([-1]), np.array([0])) for x in found]
            of = np.repeat(np.arange(len(found)), [len(w) for w, _ in found])
            word, c = (np.concatenate([np.zeros(0, np.int64), *(x[j] for x in found)]) for j in (0, 1))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(of)), pa.array(word), pa.array(c)], names=[key, "word", "c"])

    rows = df.select(key, text)
    # Dealt by key, so what is grouped by the key and more is grouped without another shuffle.
    made = rows.mapInArrow(count, f"`{key}` {rows.dtypes[0][1]}, word long, c long").repartition(key)
    return made.groupBy(key, "word").agg(F.sum("c").alias("c"))


def has_repeat(s: str, k: int) -> bool:
    """Does a window of k characters stand in a text twice?"""
    n = len(s) - k + 1
    return n > 1 and len({s[i : i + k] for i in range(n)}) < n


def repeated_udf(k: int):
    """A pandas UDF that tells of texts whether they have a window of k characters twice; of null, that they don't."""

    @F.pandas_udf("boolean")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: x is not None and has_repeat(x, k)).astype(bool)

    return run


def canonical_words(df: DataFrame, key: str, text: str, k: int, as_read: bool = False, parts: int | None = None) -> DataFrame:
    """key, word, back: the distinct windows of k bases of each key's texts, as the smaller of the window and its reverse
    complement (as_read: as they stand in the texts), and the other of the two; dealt to so many parts, if given."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words, of = [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                f, r = text_codes(t or "", k)
                word, at = np.unique(f if as_read else np.minimum(f, r), return_index=True)
                words.append((word, (r if as_read else np.maximum(f, r))[at]))
                of.append(np.full(len(word), i))
            word, back = (np.concatenate([np.zeros(0, np.int64), *(w[j] for w in words)]) for j in (0, 1))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(np.concatenate([np.zeros(0, np.int64), *of]))), pa.array(word), pa.array(back)], names=[key, "word", "back"])

    rows = df.select(key, text)
    # Dealt by key, words are told apart, and what is grouped by the key and more is grouped, without another shuffle.
    return rows.mapInArrow(make, f"`{key}` {rows.dtypes[0][1]}, word long, back long").repartition(*[parts] * bool(parts), key).distinct()


def number(s: Column) -> Column:
    """The number of a string of bases."""
    return F.conv(F.translate(s, "ACGT", "0123"), 4, 10).cast("long")


def end_words(df: DataFrame, key: str, text: str, k: int) -> DataFrame:
    """key, first, rfirst, last, rlast: the k bases at both ends of each text that has them, as numbers, and their reverse
    complements."""
    back = lambda c: number(F.reverse(F.translate(c, "ACGT", "TGCA")))
    first, last = F.substring(text, 1, k), F.substring(text, -k, k)
    rows = df.filter(F.length(text) > k)
    return rows.select(key, number(first).alias("first"), back(first).alias("rfirst"), number(last).alias("last"), back(last).alias("rlast"))


def letters(kmer: Column, k: int) -> Column:
    """The bases of a number."""
    return F.translate(F.lpad(F.conv(kmer.cast("string"), 10, 4), k, "0"), "0123", "ACGT")


def last_base(kmer: Column) -> Column:
    return F.substring(F.lit("ACGT"), kmer.bitwiseAND(3).cast("int") + 1, F.lit(1))


def letter_array(numbers: np.ndarray, k: int) -> pa.Array:
    """The bases of an array of numbers, as strings."""
    at = numbers[:, None] >> np.arange(2 * (k - 1), -1, -2, dtype=np.int64)
    bases = np.frombuffer(b"ACGT", np.uint8)[at & 3]
    ends = np.arange(0, k * len(numbers) + 1, k, dtype=np.int32)
    return pa.StringArray.from_buffers(len(numbers), pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(bases)))


def supported(text: str, quals: list[int] | None, k: int) -> np.ndarray:
    """Distinct canonical k-mers of a read, those whose error probabilities sum to less than one; none without qualities."""
    if quals is None or not text:
        return np.zeros(0, np.int64)
    place, f, r = text_places(text, k)
    errors = np.concatenate([[0.0], np.cumsum(10.0 ** (-np.minimum(np.array(quals, np.float64), 255) / 10))])  # a null is no number, so its windows fail
    inside = place + k < len(errors)
    place, number = place[inside], np.minimum(f, r)[inside]
    return np.unique(number[np.floor(errors[place + k] - errors[place]) == 0])


def text_chains(text: str, k: int) -> tuple[np.ndarray, ...]:
    """The chains without branches of a text's graph of oriented k-mers, each reading a row: s and rs, oriented k-mers and their
    reverse complements, those of a chain side by side; at which each chain begins, and whether it is a ring, cut before its
    least node; and the edges between chains, as numbers of chains.

    A link is the only edge out of its one end and the only one into the other, so chains are the paths that the links leave,
    and pointer doubling over the k-mers of the one text orders them.
    """
    f, r = text_codes(text, k + 1)
    mask = (1 << 2 * k) - 1
    word = np.unique(np.concatenate([f, r]))
    u, v = word >> 2, word & mask
    s, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    n = len(s)
    rs = np.zeros(n, np.int64)  # the reverse complements
    for i in range(k):
        rs |= (3 - (s >> 2 * i & 3)) << 2 * (k - 1 - i)
    back = np.searchsorted(s, rs)
    only = (np.bincount(a, minlength=n)[a] == 1) & (np.bincount(b, minlength=n)[b] == 1) & (a != b) & (b != back[a])
    to = np.arange(n)
    to[a[only]] = b[only]
    number = np.minimum(s, rs) * 2 + (s > rs)
    low, jump = number.copy(), to.copy()
    for _ in range(max(1, int(n).bit_length()) + 1):
        low = np.minimum(low, low[jump])
        jump = jump[jump]
    ring = to[jump] != jump  # what never comes to an end
    cut = ring & (number[to] == low)
    to[cut] = np.flatnonzero(cut)
    dist, last = (to != np.arange(n)).astype(np.int64), to.copy()
    for _ in range(max(1, int(n).bit_length())):
        dist += dist[last]
        last = last[last]
    order = np.lexsort((-dist, last))
    first = np.flatnonzero(np.diff(last[order], prepend=-1))
    chain = np.empty(n, np.int64)
    chain[order] = np.cumsum(np.diff(last[order], prepend=-1) != 0) - 1
    between = (to[a] != b) | (a == b)
    return s[order], rs[order], first, ring[order][first], chain[a[between]], chain[b[between]]
