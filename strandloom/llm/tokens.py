"""Token ids of whole texts by the tokenizers library, each distinct unit encoded once.

The vocabulary's pattern never joins what stands before a single space to what stands after it, so a
text is cut at spaces into units (a space and what follows it) and the library encodes each distinct
unit once; a bounded cache keeps the ids. Where a run of white space spans two units, which `\\s \\s`
finds, the library encodes the whole text.
"""

from __future__ import annotations

import re
import sys
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPANNING = re.compile(r"\s \s")
#: Entries of a task's unit cache, and the longest unit that it keeps.
CACHE, KEPT_CHARS = 1_000_000, 80
#: Letters, then marks other than an apostrophe, which may begin a contraction.
TWO_LINES = re.compile(r"(\S+)\n(\S(?:.*\S)?)", re.DOTALL).fullmatch
WORD_AND_MARKS = re.compile(r"([^\W\d_]+)([^\w\s']+)").fullmatch
#: Texts of a batch are encoded in slices, so that a batch's ids never stand in memory at once.
SLICE = 256


class _Units(dict):
    """Ids of units by what follows the space. A word with marks behind it is the word's ids and the
    marks', for the pattern parts letters from other characters."""

    def __init__(self, encoder: Encoder, lead: str):
        self.encoder, self.lead = encoder, lead

    def __missing__(self, unit: str) -> bytes:
        if unit.isalpha():
            ids = self.encoder.word(self.lead + unit)
        elif (m := WORD_AND_MARKS(unit)) is not None:
            ids = self[m[1]] + self.encoder.marks[m[2]]
        elif (m := TWO_LINES(unit)) is not None:  # a line end between two others is a match of its own
            return self[m[1]] + self.encoder.marks["\n"] + self.encoder.first[m[2]]
        else:
            ids = self.encoder.whole(self.lead + unit)
        if len(unit) <= KEPT_CHARS:
            if len(self) >= CACHE:
                self.clear()
            self[unit] = ids
        return ids


class _Marks(dict):
    """Ids of runs of characters that are no letters, numbers or blanks."""

    def __init__(self, encoder: Encoder):
        self.encoder = encoder

    def __missing__(self, run: str) -> bytes:
        if len(self) >= CACHE:
            self.clear()
        ids = self[run] = self.encoder.whole(run)
        return ids


def shown_bytes() -> dict[int, str]:
    """How the byte-level vocabulary writes each byte of UTF-8, as the library itself shows it."""
    from tokenizers import pre_tokenizers

    show = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
    table: dict[int, str] = {}
    for c in [*range(0x800), *range(0x800, 0xD800, 0x40), *range(0xE000, 0x110000, 0x1000)]:
        table.update(zip(chr(c).encode(), show(chr(c))[0][0]))
    return table


class Encoder:
    """Ids of a text as little-endian bytes: 16 bits an id if the vocabulary allows it, else 32."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True  # their strings in a text are ordinary text
        self.dtype = id_dtype(self.library.get_vocab_size())
        self.code = {"<u2": "H", "<u4": "I"}[self.dtype]
        self.shown, self.tokenize = shown_bytes(), self.library.model.tokenize
        self.space = self.shown[ord(" ")]
        self.marks = _Marks(self)
        self.first, self.rest = _Units(self, ""), _Units(self, " ")

    def packed(self, ids: list[int]) -> bytes:
        out = array(self.code, ids)
        if sys.byteorder == "big":
            out.byteswap()
        return out.tobytes()

    def word(self, word: str) -> bytes:
        """A single match of the pattern goes to the library's BPE model directly."""
        if word.isascii():
            shown = self.space + word[1:] if word[0] == " " else word
        else:
            shown = word.encode().decode("latin-1").translate(self.shown)
        return self.packed([t.id for t in self.tokenize(shown)])

    def whole(self, text: str) -> bytes:
        return self.packed(self.library.encode(text, add_special_tokens=False).ids)

    def __call__(self, text: str) -> bytes:
        if SPANNING.search(text):
            return self.whole(text)
        head, *tail = text.split(" ")
        return self.first[head] + b"".join(map(self.rest.__getitem__, tail))


@lru_cache(maxsize=2)
def encoder_for(path: str) -> Encoder:
    """One encoder a worker process, so that its cache lasts from task to task."""
    return Encoder(path)


def id_dtype(vocabulary: int) -> str:
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


def vocabulary_size(path: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).get_vocab_size()


def token_table(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """task, seq (row's place in its task), doc_id, source, ids (bytes), n_tokens (with the end id).

    pos is the row's first token in its source's queue within the task; a null text is empty.
    """
    source = F.coalesce(F.col("source").cast("string"), F.lit("")) if "source" in docs.columns else F.lit("")
    rows = docs.select("doc_id", source.alias("source"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("task", F.spark_partition_id())

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_for(path)
        end, width = np.array([end_id], dtype=encoder.dtype).tobytes(), np.dtype(encoder.dtype).itemsize
        at: dict[str, int] = {}
        for whole in batches:
            for k in range(0, whole.num_rows, SLICE):
                b = whole.slice(k, SLICE)
                ids = [encoder(t) + end for t in b.column("text").to_pylist()]
                n, pos = [len(x) // width for x in ids], []
                for s, m in zip(b.column("source").to_pylist(), n):
                    pos.append(at.get(s, 0))
                    at[s] = pos[-1] + m
                yield pa.RecordBatch.from_arrays(
                    [b.column("task"), pa.array(pos, pa.int64()), b.column("doc_id"), b.column("source"), pa.array(ids, pa.binary()), pa.array(n, pa.int64())],
                    names=["task", "pos", "doc_id", "source", "ids", "n_tokens"],
                )

    return rows.mapInArrow(encode, "task int, pos long, doc_id long, source string, ids binary, n_tokens long")
