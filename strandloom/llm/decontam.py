"""Benchmark decontamination: an FM-index of each training shard is searched for every window of every item.

Words are found on the UTF-8 bytes of a shard (about SHARD_BYTES of text, or one longer document). The shard's alphabet
is the words of the items: a word that no item has breaks the text, and stretches that are shorter than the shortest
window are left out of the index, since neither can hold an occurrence. Words are looked up by hash and compared byte
by byte, so no other word passes. The suffixes of the stretches are sorted by prefix doubling; the index keeps their
Burrows-Wheeler transform as a wavelet matrix with ranks by level, and every SAMPLE-th suffix position. All windows are
searched backwards at once, those that die on the way are dropped, and the rows that are left are walked to the next
sampled position. Overlapping occurrences are merged into the spans that a removal cuts out.

Windows are made once for all tasks: the items are dealt into blocks of about BLOCK_BYTES, each compiled by a task into
a file of the shared folder, and every shard is searched for the windows of one block after the other. So neither the
driver nor a task holds more of the benchmark than one block (or one longer item), whatever its size.

Defined cases: null texts have no words; an item without words has no window, one of fewer words than a window is one
window; repeated items count once by their id; an item without an id marks words, but is not listed; repeated documents
are judged alike, row by row; a very long document is a shard of its own; without documents there are no rows, without
items no document is hit; other columns are carried along, and result columns get other names where theirs are taken.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm.bytewords import chunks, flat, spans, texts_of, word_table
from strandloom.llm.common import Scratch, free_names, stored
from strandloom.sources.files import open_file, write_file

WINDOW = 10
#: Digits and letters of ASCII and all other characters make words.
LETTERS = ((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))
SHARD_BYTES, BLOCK_BYTES = 1 << 23, 1 << 23
#: Bytes whose words are hashed at once.
PIECE_BYTES = 1 << 18
#: Every so many positions of an index keep their place in the text.
SAMPLE = 8
RESULT = ("n_words", "n_hit", "items", "spans")


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Suffixes of text in order, each 0 being smaller than all words and than the zeros behind it.

    So a suffix is compared up to its first 0 only; text must end with one.
    """
    n, zero = len(text), text == 0
    zeros = int(zero.sum())
    symbol = np.where(zero, np.cumsum(zero) - 1, text.astype(np.int64) + zeros - 1)
    bits = max(1, int(symbol.max()).bit_length())
    step = max(1, min(62 // bits, n))
    key = np.zeros(n, np.int64)
    for j in range(step):
        key <<= bits
        key[: n - j] |= symbol[j:]
    order = np.argsort(key, kind="stable")
    new = np.concatenate([[True], key[order[1:]] != key[order[:-1]]])
    rank = np.empty(n, np.int64)
    rank[order] = np.flatnonzero(new)[np.cumsum(new) - 1]  # the first place of the group
    while True:
        at = np.flatnonzero(~(new & np.append(new[1:], True)))  # places of groups of several suffixes
        if not len(at):
            return order
        mine = order[at]
        behind = rank[np.minimum(mine + step, n - 1)]  # only suffixes without a 0 so far are in groups, so none ends
        by = np.lexsort((behind, rank[mine]))
        order[at] = mine[by]
        group, behind = rank[mine[by]], behind[by]
        new[at[1:]] |= (group[1:] == group[:-1]) & (behind[1:] != behind[:-1])
        place = np.maximum.accumulate(np.where(new[at], at, 0))
        rank[order[at]] = place
        step *= 2


class FMIndex:
    """Counts and places of word sequences in a text of word numbers, 0 being a break; the text ends with one."""

    def __init__(self, text: np.ndarray, words: int):
        order = suffix_order(text)
        self.bwt = text[order - 1]
        self.below = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=words + 1))])
        self.levels: list[tuple[int, np.ndarray, int]] = []
        row = self.bwt
        for shift in reversed(range(max(1, words.bit_length()))):
            one = (row >> shift) & 1 == 1
            zeros = np.concatenate([[0], np.cumsum(~one)])
            self.levels.append((shift, zeros, int(zeros[-1])))
            row = np.concatenate([row[~one], row[one]])
        # A walk to the left ends at a sampled place, at the latest behind a break.
        kept = (order % SAMPLE == 0) | (text[order - 1] == 0)
        self.kept, self.before, self.places = kept, np.cumsum(kept) - kept, order[kept]

    def step(self, word: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Row of word before each row's suffix: words below, and rank of word among the rows before."""
        first = np.zeros_like(row)
        for shift, zeros, all_zeros in self.levels:
            one = (word >> shift) & 1 == 1
            a, b = zeros[first], zeros[row]
            first, row = np.where(one, all_zeros + first - a, a), np.where(one, all_zeros + row - b, b)
        return self.below[word] + row - first

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number of each phrase (a row of words) that occurs, and its rows low .. high - 1."""
        alive, last = np.arange(len(phrases)), phrases[:, -1]
        low, high = self.below[last], self.below[last + 1]
        for j in reversed(range(-1, phrases.shape[1] - 1)):
            some = high > low
            alive, low, high = alive[some], low[some], high[some]
            if j < 0 or not len(alive):
                break
            word = phrases[alive, j]
            low, high = self.step(word, low), self.step(word, high)
        return alive, low, high

    def locate(self, row: np.ndarray) -> np.ndarray:
        """Places in the text of rows."""
        place, todo, row, back = np.zeros(len(row), np.int64), np.arange(len(row)), row.copy(), 0
        while len(todo):
            done = self.kept[row]
            place[todo[done]] = self.places[self.before[row[done]]] + back
            todo, row = todo[~done], row[~done]
            if len(todo):
                row, back = self.step(self.bwt[row], row), back + 1
        return place


def hashes(low: np.ndarray, start: np.ndarray, seed: int) -> np.ndarray:
    """64 bits of each word; low is 0 outside words. Multipliers repeat after 64 bytes."""
    if not len(start):
        return np.zeros(0, np.uint64)
    times = np.random.default_rng(seed).integers(0, 1 << 63, size=64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    out, ends, i = np.empty(len(start), np.uint64), np.append(start[1:], len(low)), 0
    while i < len(start):  # a piece of the bytes at a time
        j = max(i + 1, int(np.searchsorted(ends, start[i] + PIECE_BYTES, side="right")))
        own, at = low[start[i] : ends[j - 1]], start[i:j] - start[i]
        place = np.arange(len(own)) - np.repeat(at, ends[i:j] - start[i:j])
        out[i:j] = np.add.reduceat(own * times[place & 63], at)
        i = j
    return (out ^ (out >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)


class Windows:
    """The windows of a block of items: words by hash and bytes, distinct phrases by length, items by phrase."""

    def __init__(self, texts: pa.Array, items: list[str | None], window: int):
        low, start, end, item = spans(*texts_of(texts), word_table(*LETTERS))
        text = low.tobytes()
        words = sorted({text[a:b] for a, b in zip(start.tolist(), end.tolist())})
        number = {w: i for i, w in enumerate(words)}
        self.bytes, self.ends = np.frombuffer(b"".join(words), np.uint8), np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)
        joined, first = np.frombuffer(b"\0".join(words) + b"\0", np.uint8), self.ends[:-1] + np.arange(len(words))
        for self.seed in range(99):  # until no two words share a hash
            h = hashes(joined, first, self.seed)
            if len(np.unique(h)) == len(h):
                break
        by = np.argsort(h)
        self.hash, self.word = h[by], by.astype(np.int32)
        ids = np.array([number[text[a:b]] for a, b in zip(start.tolist(), end.tolist())], np.int32) + 1
        n = np.bincount(item, minlength=len(items))
        first = np.cumsum(n) - n
        self.phrases: list[np.ndarray] = []
        self.items: list[tuple[np.ndarray, np.ndarray]] = []  # by length: item numbers of phrase k at ptr[k] .. ptr[k + 1]
        self.names = [x or "" for x in items]
        self.named = np.array([x is not None for x in items], bool)
        width = np.minimum(n, window)
        for w in np.unique(width[width > 0]).tolist():
            own = np.flatnonzero(width == w)
            times = n[own] - w + 1
            at, of = flat(first[own], times), np.repeat(own, times)
            phrase, k = np.unique(ids[at[:, None] + np.arange(w)], axis=0, return_inverse=True)
            both = np.unique(np.stack([k.ravel(), of], axis=1), axis=0)
            self.phrases.append(phrase)
            self.items.append((both[:, 1], np.searchsorted(both[:, 0], np.arange(len(phrase) + 1))))

    def numbered(self, low: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Number of each word from 1, 0 for words of no item: found by hash, then compared byte by byte."""
        out = np.zeros(len(start), np.int32)
        if not len(self.hash) or not len(start):
            return out
        h = hashes(low, start, self.seed)
        at = np.minimum(np.searchsorted(self.hash, h), len(self.hash) - 1)
        found = np.flatnonzero(self.hash[at] == h)
        word, length = self.word[at[found]], (end - start)[found]
        same = length == (self.ends[1:] - self.ends[:-1])[word]
        found, word, length = found[same], word[same], length[same]
        wrong = np.flatnonzero(low[flat(start[found], length)] != self.bytes[flat(self.ends[word], length)])
        out[found] = word + 1
        out[found[np.searchsorted(np.cumsum(length), wrong, side="right")]] = 0
        return out


def occurrences(windows: Windows, low: np.ndarray, start: np.ndarray, end: np.ndarray, text: np.ndarray) -> Iterator[tuple[np.ndarray, int, np.ndarray, int]]:
    """By length of window: first word of each occurrence, the length, number of the phrase, and which length it is."""
    if not windows.phrases:
        return
    ids = windows.numbered(low, start, end)
    known = np.concatenate([[False], ids > 0, [False]])
    goes_on = np.concatenate([[False], text[1:] == text[:-1], [False]]) & known[:-1] & known[1:]  # before each word
    begins, ends = np.flatnonzero(known[1:-1] & ~goes_on[:-1]), np.flatnonzero(known[1:-1] & ~goes_on[1:]) + 1
    long = ends - begins >= min(p.shape[1] for p in windows.phrases)
    begins, length = begins[long], (ends - begins)[long]
    if not len(begins):
        return
    # Each stretch and a break behind it; where[] is the word of each place.
    where = flat(begins, length + 1)
    indexed = np.append(ids, 0)[where]
    indexed[np.cumsum(length + 1) - 1] = 0
    index = FMIndex(indexed, len(windows.hash))
    for which, phrases in enumerate(windows.phrases):
        phrase, first, last = index.search(phrases)
        yield where[index.locate(flat(first, last - first))], phrases.shape[1], np.repeat(phrase, last - first), which


@lru_cache(maxsize=1)
def _block(path: str) -> Windows:
    import pickle

    with open_file(path) as f:
        return pickle.loads(f.read())


def compiled(items: DataFrame, window: int, folder: str) -> list[str]:
    """Files of the compiled blocks of items (item_id, text)."""
    rows = items.select(F.col("item_id").cast("string").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    blocks = max(1, -(-size // BLOCK_BYTES))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pickle

        from pyspark import TaskContext

        own = pa.Table.from_batches([b for b in batches if b.num_rows] or [pa.RecordBatch.from_pydict({"item_id": pa.array([], pa.string()), "text": pa.array([], pa.string())})])
        texts = own.column("text").cast(pa.large_string()).combine_chunks()
        path = f"{folder}/block-{TaskContext.get().partitionId():06d}"
        write_file(path, [pickle.dumps(Windows(texts, own.column("item_id").to_pylist(), window), protocol=5)])
        yield pa.RecordBatch.from_pydict({"path": pa.array([path])})

    return sorted(r[0] for r in rows.repartition(blocks).mapInArrow(write, "path string").collect())  # one row a block


def scan(docs: DataFrame, paths: list[str], carry: list[str], clean: bool = False) -> DataFrame:
    """The columns carry of docs, and n_words, n_hit, items (array of ids), spans (array of start, end in bytes).

    With clean, the text has lost its spans.
    """
    names = free_names(docs.select(*carry), *RESULT)
    inner, *_ = free_names(docs.select(*carry), "whole")
    rows = docs.select(*carry, F.coalesce(F.col("text").cast("string"), F.lit("")).alias(inner))
    kinds = ("bigint", "bigint", "array<string>", "array<struct<start:bigint,end:bigint>>")
    schema = ", ".join(f"`{name.replace('`', '``')}` {kind}" for name, kind in [*docs.select(*carry).dtypes, *zip(names, kinds)])
    at_text = carry.index("text") if clean else None
    table = word_table(*LETTERS)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = texts_of(b.column(b.num_columns - 1))
            for i, j in chunks(offsets, SHARD_BYTES):
                at = offsets[i : j + 1] - offsets[i]
                n, hit, items, cuts = judged(data[offsets[i] : offsets[j]], at, [_block(p) for p in paths] if len(paths) == 1 else map(_block, paths), table)
                own = [c.slice(i, j - i) for c in b.columns[:-1]]
                if clean:
                    whole = b.columns[-1].slice(i, j - i).to_pylist()
                    own[at_text] = pa.array([without(t, c) if c else old for t, c, old in zip(whole, cuts, own[at_text].to_pylist())], own[at_text].type)
                found = [pa.array(n, pa.int64()), pa.array(hit, pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array([[{"start": x, "end": y} for x, y in c] for c in cuts], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]
                yield pa.RecordBatch.from_arrays([*own, *found], names=[*carry, *names])

    return rows.mapInArrow(find, schema)


def without(text: str, cuts: list[tuple[int, int]]) -> str:
    data, at, out = text.encode("utf-8", "surrogatepass"), 0, []
    for a, b in cuts:
        out.append(data[at:a])
        at = b
    return b"".join([*out, data[at:]]).decode("utf-8", "surrogatepass")


def judged(data: np.ndarray, offsets: np.ndarray, blocks, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[list[str]], list[list[tuple[int, int]]]]:
    """Words, hit words, item ids in order and removal spans of each text of a shard."""
    low, start, end, text = spans(data, offsets, table)
    n = len(offsets) - 1
    edge, listed = np.zeros(len(start) + 1, np.int64), [set() for _ in range(n)]
    for windows in blocks:
        for first, width, phrase, which in occurrences(windows, low, start, end, text):
            np.add.at(edge, first, 1)
            np.add.at(edge, first + width, -1)
            item, ptr = windows.items[which]
            key = np.unique(text[first] * len(ptr) + phrase)  # each phrase of a text once
            for t, k in zip((key // len(ptr)).tolist(), (key % len(ptr)).tolist()):
                listed[t].update(windows.names[x] for x in item[ptr[k] : ptr[k + 1]].tolist() if windows.named[x])
    covered = np.cumsum(edge[:-1]) > 0
    hit = np.bincount(text[covered], minlength=n)
    cuts: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    if covered.any():
        # Words of occurrences that overlap or touch are one span.
        joined = np.concatenate([[False], covered[1:] & covered[:-1] & (text[1:] == text[:-1]), [False]])
        begins, ends = np.flatnonzero(covered & ~joined[:-1]), np.flatnonzero(covered & ~joined[1:])
        base = offsets[text[begins]]
        for t, a, b in zip(text[begins].tolist(), (start[begins] - base).tolist(), (end[ends] - base).tolist()):
            cuts[t].append((a, b))
    return np.bincount(text, minlength=n), hit, [sorted(x, key=lambda s: s.encode()) for x in listed], cuts


def contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW, carry: list[str] | None = None) -> DataFrame:
    """The columns carry (all, if not given) of docs, with n_words, n_hit, items and spans of every row."""
    with Scratch(docs.sparkSession, "benchmark") as scratch:
        return stored(scan(docs, compiled(items, window, scratch.path), docs.columns if carry is None else carry), "contaminated")


def cleaned(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs with their texts cut free of every span that an item's windows cover."""
    with Scratch(docs.sparkSession, "benchmark") as scratch:
        return stored(scan(docs, compiled(items, window, scratch.path), docs.columns, clean=True).select(*docs.columns), "cleaned")


def oracle_sql() -> str:
    """DuckDB SQL of the query."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    words = rf"regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    text_of = "array_to_string(list_slice(words, i, i + w - 1), ' ')"
    return rf"""
    WITH d AS MATERIALIZED (SELECT row_number() OVER () AS row, doc_id, {words} AS words FROM documents),
    b AS (SELECT item_id::VARCHAR AS item, {words} AS words FROM benchmark),
    bw AS (SELECT item, words, least(len(words), {WINDOW}) AS w FROM b WHERE len(words) > 0),
    phrase AS MATERIALIZED (SELECT DISTINCT item, w, {text_of} AS phrase FROM (SELECT *, unnest(range(1, len(words) - w + 2)) AS i FROM bw)),
    places AS (SELECT row, words, w, unnest(range(1, len(words) - w + 2)) AS i FROM d CROSS JOIN (SELECT DISTINCT w FROM phrase) WHERE len(words) >= w),
    found AS MATERIALIZED (SELECT p.row, p.i, p.w, phrase.item FROM (SELECT row, i, w, {text_of} AS phrase FROM places) p JOIN phrase USING (w, phrase)),
    hit AS (SELECT row, count(DISTINCT j) AS n_hit FROM (SELECT row, unnest(range(i, i + w)) AS j FROM (SELECT DISTINCT row, i, w FROM found)) GROUP BY row),
    own AS (SELECT row, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT row, item FROM found WHERE item IS NOT NULL) GROUP BY row)
    SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
        sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN hit USING (row) LEFT JOIN own USING (row)"""
