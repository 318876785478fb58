"""Language identification: scripts narrow the candidates, Viterbi labels the spans of mixed texts.

A word's scores are naive-Bayes log-likelihoods of its letter trigrams in each language, in hashed tables
of fixed size; languages that never use the word's script are out. The best path through the words pays
PENALTY for each change of language. A text goes to the language of most words on the path; its score is
the share of that language's words among all, where words in a script that no language uses are nobody's.

Words are pieces of whitespace-separated units: a unit is cut where its script changes, and then, so that
every letter counts, into at most LETTERS letters, or into PIECE where the script has no spaces between words.

Most texts have one language, and a vectorised test tells so exactly: if no stretch of words gains more
than PENALTY by leaving the best single language, the constant path is the best path.

The model is fitted on a sample (chosen by hash, whole texts) that deals about TRAIN_DOCS documents evenly to the
languages, LANG_DOCS or all of a language at least, so a language that few documents have is learnt like the others.

Defined cases: a null text, or one without letters, is ``und`` with score 0; a text wholly in scripts that
were never learnt gets the first language with score 0; a null lang or doc_id is not learnt from, and
in_training() is false for a null doc_id; without any training document every text with letters is ``und``;
ties go to the alphabetically first language; very long texts count in full, and a task holds one text's
words at a time; repeated rows are labelled one by one; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Documents of the sample, dealt evenly to the languages, but so many to each at least.
TRAIN_DOCS, LANG_DOCS = 20_000, 64
BUCKETS = 1 << 16
PENALTY = 12.0
#: A word's log-likelihoods differ by at most so much; letters of a piece, and of one in a script without spaces.
SPREAD, LETTERS, PIECE = 6.0, 64, 6
UNSPACED = {"Han", "Kana", "Thai", "Lao", "Khmer", "Myanmar", "Tibetan"}
#: A script is a language's own if so large a share of its training letters is in it.
OWN_SCRIPT = 0.005
#: Words whose scores a worker keeps, and scores: words times languages.
CACHE, CELLS = 300_000, 1 << 23
# First code points of script ranges (fixed values of the Unicode standard), each up to the next.
RANGES = [
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"),
    (0x0700, "Syriac"), (0x0750, "Arabic"), (0x0780, "Thaana"), (0x07C0, "Other"), (0x08A0, "Arabic"), (0x0900, "Devanagari"),
    (0x0980, "Bengali"), (0x0A00, "Gurmukhi"), (0x0A80, "Gujarati"), (0x0B00, "Oriya"), (0x0B80, "Tamil"), (0x0C00, "Telugu"),
    (0x0C80, "Kannada"), (0x0D00, "Malayalam"), (0x0D80, "Sinhala"), (0x0E00, "Thai"), (0x0E80, "Lao"), (0x0F00, "Tibetan"),
    (0x1000, "Myanmar"), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x13A0, "Other"), (0x1780, "Khmer"),
    (0x1800, "Mongolian"), (0x18B0, "Other"), (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, "Other"), (0x3040, "Kana"),
    (0x3100, "Other"), (0x3130, "Hangul"), (0x3190, "Other"), (0x3400, "Han"), (0xA000, "Other"), (0xAC00, "Hangul"),
    (0xD7B0, "Other"), (0xF900, "Han"), (0xFB00, "Latin"), (0xFB10, "Other"), (0x20000, "Han"), (0x32000, "Other"),
]
STARTS, NAMES = [a for a, _ in RANGES], [n for _, n in RANGES]


class _Scripts(dict):
    def __missing__(self, c: str) -> str:
        out = self[c] = NAMES[bisect_right(STARTS, ord(c)) - 1]
        return out


class _Trigrams(dict):
    """Table rows of letter trigrams, by a fixed hash that is equal on all machines."""

    def __missing__(self, t: str) -> int:
        h = (ord(t[0]) * 0x9E3779B1 ^ ord(t[1]) * 0x85EBCA6B ^ ord(t[2]) * 0xC2B2AE35) & 0xFFFFFFFF
        if len(self) >= CACHE:
            self.clear()
        out = self[t] = (h ^ h >> 15) * 0x2C1B3C6D >> 13 & BUCKETS - 1
        return out


SCRIPTS, TRIGRAMS = _Scripts(), _Trigrams()


def script(word: str) -> str:
    """Script of most letters of a word; the alphabetically first at a tie."""
    if word.isascii():
        return "Latin"
    names = [SCRIPTS[c] for c in word]
    return names[0] if names.count(names[0]) == len(names) else min(set(names), key=lambda n: (-names.count(n), n))


def letters(unit: str) -> str:
    return unit if unit.isalpha() else "".join(filter(str.isalpha, unit))


def pieces(unit: str) -> list[str]:
    """A unit's letters, all of them, in words of one script each."""
    w = letters(unit)
    if w.isascii():
        return [w[i : i + LETTERS] for i in range(0, len(w), LETTERS)]
    out = []
    for name, run in groupby(w, SCRIPTS.__getitem__):
        r, n = "".join(run), PIECE if name in UNSPACED else LETTERS
        out += [r[i : i + n] for i in range(0, len(r), n)]
    return out


def buckets(word: str) -> list[int]:
    """Table rows of a word's letter trigrams, its ends marked."""
    w = f"\x02{word}\x03"
    return [TRIGRAMS[w[i : i + 3]] for i in range(len(w) - 2)]


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # buckets x languages, log-likelihoods
    own: dict[str, np.ndarray]  # by script, which languages use it

    def scores(self, words: list[str]) -> np.ndarray:
        """A row for each word: log-likelihoods below the best language's, which has 0. Languages that do
        not use the word's script are as far below as can be; a script of none has NaN in all."""
        own = [buckets(w) for w in words]
        starts = np.cumsum([0, *map(len, own[:-1])])
        s = np.add.reduceat(self.table[np.fromiter(chain.from_iterable(own), np.int32)], starts, axis=0)
        none = np.zeros(len(self.langs), bool)
        allowed = np.stack([self.own.get(script(w), none) for w in words])
        s = np.where(allowed, s, -np.inf)
        top = s.max(axis=1, keepdims=True)
        known = np.isfinite(top)
        return np.where(known, np.maximum(s - np.where(known, top, 0), -SPREAD), np.nan).astype(np.float32)


def in_training(remainder: int = 0, parts: int = 5):
    """Rows to learn from: those whose crc32 of doc_id as text leaves another remainder; never null."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % parts != remainder, F.lit(False))


def train(docs: DataFrame, condition) -> Model:
    rows = docs.filter("lang IS NOT NULL AND text IS NOT NULL").filter(condition)
    sizes = rows.groupBy("lang").count().collect()  # a row a language, each of which is a column of the model
    quota = max(LANG_DOCS, TRAIN_DOCS // max(1, len(sizes)))
    shares = docs.sparkSession.createDataFrame([(r["lang"], int((1 << 30) * min(1, quota / r["count"]))) for r in sizes], "lang string, share long")
    rows = rows.select("doc_id", "lang", "text").join(F.broadcast(shares), "lang").filter(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 30)) < F.col("share"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, Counter] = {}
        for b in batches:
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist()):
                seen.setdefault(lang, Counter()).update(text.lower().split())
        for lang, units in seen.items():
            table, scripts = Counter(), Counter()
            for unit, n in units.items():
                for w in pieces(unit):
                    for k in buckets(w):
                        table[k] += n
                    scripts[script(w)] += n * len(w)
            found = list(table)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * (len(found) + len(scripts))), pa.array([*found, *([-1] * len(scripts))], pa.int32()), pa.array([None] * len(found) + list(scripts), pa.string()), pa.array([*table.values(), *scripts.values()], pa.int64())],
                names=["lang", "bucket", "script", "n"],
            )

    counted = rows.select("lang", "text").mapInArrow(count, "lang string, bucket int, script string, n long")
    sums = counted.groupBy("lang", "bucket", "script").agg(F.sum("n").alias("n")).toPandas()  # BUCKETS rows a language at most
    langs = sorted(sums["lang"].unique())
    at = {x: k for k, x in enumerate(langs)}
    table, own = np.zeros((BUCKETS, len(langs))), {}
    for lang, bucket, name, n in sums.itertuples(index=False):
        if bucket >= 0:
            table[bucket, at[lang]] = n
        else:
            own.setdefault(name, np.zeros(len(langs)))[at[lang]] = n
    every = sum(own.values(), np.zeros(len(langs)))
    own = {k: v >= OWN_SCRIPT * every for k, v in own.items()}
    smooth = np.log(table + 0.1) - np.log(table.sum(axis=0, keepdims=True) + 0.1 * BUCKETS)
    return Model(langs, smooth.astype(np.float32), own)


def best_path(s: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """Viterbi: for each row (word) the column (language) of the best path."""
    n, m = s.shape
    best = int(s.sum(axis=0).argmax())
    if m > 1:
        others = np.delete(s, best, axis=1).max(axis=1) - s[:, best]
        run = np.cumsum(others, dtype=np.float64)
        if (run - np.minimum.accumulate(np.concatenate([[0.0], run[:-1]]))).max() > penalty:
            back, v = np.empty((n, m), np.int32), s[0].astype(np.float64)
            stay = np.arange(m)
            for i in range(1, n):
                top = int(v.argmax())
                switch = v[top] - penalty > v
                back[i] = np.where(switch, top, stay)
                v = np.where(switch, v[top] - penalty, v) + s[i]
            path = np.empty(n, np.int32)
            path[-1] = v.argmax()
            for i in range(n - 1, 0, -1):
                path[i - 1] = back[i, path[i]]
            return path
    return np.full(n, best, np.int32)


class _Places(dict):
    """Row of each unit in the table of scores: that of its letters, 0 without any; of several pieces,
    -1 - k where many[k] has their rows and the letters before each."""

    def __init__(self):
        self.new: list[str] = []
        self.many: list[tuple[np.ndarray, np.ndarray]] = []
        self.size, self.held = 1, 0

    def __missing__(self, unit: str) -> int:
        parts = pieces(unit)
        if parts == [unit]:
            out, self.size = self.size, self.size + 1
            self.new.append(unit)
        elif len(parts) > 1:
            rows, before = [self[x] for x in parts], np.cumsum([0, *map(len, parts[:-1])])
            self.many.append((np.array(rows, np.int32), before.astype(np.int32)))
            out, self.held = -len(self.many), self.held + len(parts)
        else:
            out = self[parts[0]] if parts else 0
        self[unit] = out
        return out


class Labeller:
    """Scores words of texts, each distinct word once while a bounded cache lasts."""

    def __init__(self, model: Model):
        columns = max(1, len(model.langs))
        self.most = min(CACHE, max(1024, CELLS // columns))
        self.model, self.rows, self.at = model, np.zeros((self.most, columns), np.float32), _Places()

    def units(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each piece with letters: its row, its unit, and the letters before it in the unit."""
        units = text.lower().split()
        if len(self.at) + len(units) > 2 * self.most or self.at.size + len(units) > len(self.rows) or self.at.held > self.most:
            self.at, self.rows = _Places(), self.rows[: self.most]
        out = np.fromiter(map(self.at.__getitem__, units), np.int32, len(units))
        if self.at.size > len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros((self.at.size - len(self.rows), self.rows.shape[1]), np.float32)])
        if new := self.at.new:
            self.rows[self.at.size - len(new) : self.at.size] = self.model.scores(new)
            self.at.new = []
        where = np.flatnonzero(out)
        out = out[where]
        if not len(out) or out.min() > 0:
            return out, where, np.zeros(len(out), np.int32)
        cut = np.flatnonzero(out < 0)
        many = [self.at.many[-1 - k] for k in out[cut].tolist()]
        size = np.ones(len(out), np.int64)
        size[cut] = [len(rows) for rows, _ in many]
        rows, before = np.repeat(out, size), np.zeros(size.sum(), np.int32)
        for start, (own, letters_before) in zip((np.cumsum(size) - size)[cut].tolist(), many):
            rows[start : start + len(own)], before[start : start + len(own)] = own, letters_before
        return rows, np.repeat(where, size), before

    def __call__(self, text: str | None) -> tuple[str, float, list]:
        """Language, share of its words, and spans: first unit, unit behind the last, language; where it changes
        inside a unit, both spans have the unit, and letter is how many of the first unit's letters come before."""
        if not text or not self.model.langs:
            return "und", 0.0, []
        rows, where, before = self.units(text)
        if not len(rows):
            return "und", 0.0, []
        scores = self.rows[rows]
        foreign = np.isnan(scores[:, 0])
        path = best_path(np.where(foreign[:, None], 0, scores) if foreign.any() else scores)
        counts = np.bincount(path[~foreign], minlength=len(self.model.langs))
        best = int(counts.argmax())
        cuts = np.flatnonzero(np.diff(path)) + 1
        begins, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(path)]])
        spans = [{"begin": int(where[a]), "end": int(where[b - 1]) + 1, "lang": self.model.langs[path[a]], "letter": int(before[a])} for a, b in zip(begins, ends)]
        return self.model.langs[best], float(counts[best] / len(path)), spans


SPANS = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("lang", pa.string()), ("letter", pa.int32())]))


def label(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score, spans of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(model)
        for b in batches:
            got = [labeller(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), pa.array([g[2] for g in got], SPANS)],
                names=["doc_id", "lang_pred", "score", "spans"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double, spans array<struct<begin: int, end: int, lang: string, letter: int>>")
