"""Byte-level BPE by dynamic programming over prefixes.

Of the BPE encoding of each byte prefix of a piece, the last token is stored. It is the one token that
ends there and may stand after the last token of the prefix before it; two tokens may stand side by side
if BPE of their joined bytes gives the two again, and an encoding is BPE's if all its neighbours may. So
appending bytes extends the table, the encoding of any prefix can be read off, and after an edit the
table is computed anew only until it falls in with the old one.

Defined cases: a null text is empty; an empty text has no ids; repeated rows are separate rows; an empty
table gives no rows; other columns are ignored. Texts may be as long as memory for one row allows.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm.tokens import CACHE, KEPT_CHARS, SPANNING

#: Entries of a task's cache of token pairs.
PAIRS = 1_000_000


class Vocabulary:
    """Ranked byte tokens, their automaton, and which tokens may stand side by side."""

    def __init__(self, path: str):
        import ahocorasick

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bytes_of = {n: t for t, n in self.ranks.items()}
        self.longest = max(map(len, self.ranks))
        self.automaton = ahocorasick.Automaton()
        for token, n in self.ranks.items():
            self.automaton.add_word(token.decode("latin-1"), (n, len(token)))
        self.automaton.make_automaton()
        self.pairs: dict[int, bool] = {}

    def merged(self, data: bytes) -> list[bytes]:
        """BPE as defined: the pair of lowest rank is joined, again and again."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            ranks = [self.ranks.get(a + b, 1 << 60) for a, b in zip(parts, parts[1:])]
            best = min(ranks)
            if best == 1 << 60:
                break
            i = ranks.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def may_follow(self, a: int, b: int) -> bool:
        key = a << 32 | b
        ok = self.pairs.get(key)
        if ok is None:
            x, y = self.bytes_of[a], self.bytes_of[b]
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            ok = self.pairs[key] = self.merged(x + y) == [x, y]
        return ok


class Prefixes:
    """Last tokens of all byte prefixes of a piece that grows and changes."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.v, self.data, self.last = vocabulary, b"", [(-1, 0)]
        self.append(data)

    def append(self, data: bytes) -> None:
        """Extend the piece; entries of the prefixes so far stay as they are."""
        at = len(self.data)
        self.data += data
        self._extend(at, None)

    def edit(self, start: int, stop: int, data: bytes) -> int:
        """Replace bytes start to stop; returns how many entries were computed anew."""
        old, tail = self.last, self.data[stop:]
        self.data = self.data[:start] + data + tail
        self.last = old[: start + 1]
        return self._extend(start, (old, stop - start - len(data), start + len(data)))

    def _extend(self, at: int, old) -> int:
        v, last, data = self.v, self.last, self.data
        from_ = max(0, at - v.longest + 1)
        same, done, end = 0, 0, -1
        found: tuple[int, int] | None = None
        for stop, (token, n) in v.automaton.iter(data[from_:].decode("latin-1")):
            stop += from_ + 1
            if stop <= at:
                continue
            if stop != end:
                if end > 0:
                    last.append(found)
                    done += 1
                    if old is not None:  # in the unchanged tail: do as many entries as the longest token has agree?
                        there = end + old[1]
                        same = same + 1 if end > old[2] and old[0][there] == found else 0
                        if same >= v.longest:
                            last.extend(old[0][there + 1 :])
                            return done
                end, found = stop, None
            if found is None and n <= stop:
                before = last[stop - n][0]
                if before < 0 or v.may_follow(before, token):
                    found = (token, n)
        if end > 0:
            last.append(found)
            done += 1
        return done

    def ids(self, stop: int | None = None) -> list[int]:
        """The encoding of the first stop bytes."""
        at, out = len(self.data) if stop is None else stop, []
        while at:
            token, n = self.last[at]
            out.append(token)
            at -= n
        return out[::-1]


class _Cached(dict):
    def __init__(self, make):
        self.make = make

    def __missing__(self, key: str) -> bytes:
        ids = self.make(key)
        if len(key) <= KEPT_CHARS:
            if len(self) >= CACHE:
                self.clear()
            self[key] = ids
        return ids


class Codec:
    """Ids of whole texts as little-endian 32-bit bytes, and their bytes again."""

    def __init__(self, path: str, pattern: str):
        import regex

        self.v, self.split = Vocabulary(path), regex.compile(pattern).findall
        self.rest = _Cached(lambda unit: self.whole(" " + unit))
        self.pieces = _Cached(self.piece)

    def piece(self, match: str) -> bytes:
        return np.array(Prefixes(self.v, match.encode()).ids(), "<u4").tobytes()

    def whole(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, self.split(text)))

    def encode(self, text: str) -> bytes:
        """Cut at single spaces, across which no match reaches; units that came before are looked up."""
        if SPANNING.search(text):
            return self.whole(text)
        head, *tail = text.split(" ")
        return self.whole(head) + b"".join(map(self.rest.__getitem__, tail))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.v.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=2)
def codec_for(path: str, pattern: str) -> Codec:
    """One codec a worker process, so that its caches last from task to task."""
    return Codec(path, pattern)


def encode_documents(docs: DataFrame, path: str, pattern: str, keep: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256; with keep also ids and decoded (binary)."""
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary, decoded binary" * keep

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_for(path, pattern)
        for b in batches:
            rows = []
            for text in b.column("text").to_pylist():
                ids = codec.encode(text)
                raw = codec.decode(ids)
                rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(raw).hexdigest(), *((ids, raw) if keep else ())))
            if rows:
                columns = [pa.array(x) for x in zip(*rows)]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), *columns], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *(["ids", "decoded"] * keep)])

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, schema)
