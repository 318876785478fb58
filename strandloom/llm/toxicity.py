"""Toxic passages by maximum-scoring segment search.

Features are words and their beginnings of three to six letters. A feature's score is its log-odds
between toxic and clean training documents under Dirichlet priors (the background counts, PRIOR in all),
if it stands out by more than SIGNIFICANT standard errors, less DRIFT; a token has the score of its best
feature, or -DRIFT; so scores are negative on the whole. One linear scan finds all maximal segments (Ruzzo and
Tompa). By extreme-value statistics a clean text of n tokens has K n exp(-lambda S) segments of score S or
more: lambda solves sum p exp(lambda s) = 1 over the clean documents' tokens, and K is the maximum-likelihood
estimate from the best segments of the clean training documents (those without a segment count as 0).
A document's evidence is the sum of ln(1 / expectation) over its significant segments, or that of its best
one, and a logistic curve fitted on the training documents makes it a probability.

The model is fitted on about TRAIN_DOCS labelled documents at most: of either label up to a half of that, chosen by
hash among the labels whose document exists, so rare labels are all learnt from; the curve is set right for
their true shares. Scores cover every whole text.

Defined cases: null and empty texts have no segments and get the probability of the least evidence; rows
with a null label or id are not learnt from, and in_training() is false for a null id, which is scored as any
other; labels repeated for a document count once, the larger; rows that repeat an id are learnt from one by
one; if one of the labels never occurs, every score is that label's (clean if neither does); repeated rows
are scored one by one; very long texts are scored whole, a task holds one text's tokens at a time; an empty
table gives no rows; other columns, whatever their names, are carried along by reject() and ignored elsewhere.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm.common import Scratch

TRAIN_DOCS = 20_000
PRIOR, SIGNIFICANT, DRIFT = 10_000.0, 2.5, 0.7
#: Entries of a task's cache of token scores.
CACHE = 500_000
THRESHOLD = 0.3
WORD = re.compile(r"\w+")


def tokens(text: str) -> list[str]:
    return WORD.findall(text.lower())


def features(word: str) -> list[str]:
    """A word, and its beginnings; the mark ^ parts them from words."""
    return [word, *("^" + word[:n] for n in range(3, 7) if n < len(word))]


class TokenScores(dict):
    """Scores of tokens above -DRIFT, 0 for all others."""

    def __init__(self, scores: dict[str, float]):
        self.scores = scores

    def __missing__(self, word: str) -> float:
        s = max((self.scores.get(f, 0.0) for f in features(word)), default=0.0)
        if len(self) >= CACHE:
            self.clear()
        self[word] = s
        return s


def maximal_segments(scores: list[tuple[int, int, float]]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments of runs (begin, end, score), in linear time.

    Open candidates keep the sums before and behind them, and a link to the nearest one before that
    starts lower, so that a search never passes a candidate twice.
    """
    total, open_ = 0.0, []  # begin, end, sum before, sum behind
    for begin, end, s in scores:
        before, total = total, total + s
        if s <= 0:
            continue
        here = [begin, end, before, total]
        while True:
            j = len(open_) - 1
            while j >= 0 and open_[j][2] >= here[2]:
                j = open_[j][4]
            if j < 0 or open_[j][3] >= here[3]:
                break
            here[0], here[2] = open_[j][0], open_[j][2]
            del open_[j:]
        open_.append([*here, j])
    return [(o[0], o[1], o[3] - o[2]) for o in open_]


@dataclass
class Model:
    scores: dict[str, float]
    rate: float = 1.0  # lambda
    k: float = 0.1
    intercept: float = 0.0
    slope: float = 1.0

    def __post_init__(self):
        self.tokens = TokenScores(self.scores)

    def segments(self, words: list[str]) -> list[tuple[int, int, float]]:
        """Maximal segments: first token, token behind the last, score."""
        scores = list(map(self.tokens.__getitem__, words))
        if not any(scores):
            return []
        runs, last = [], 0
        for i, s in enumerate(scores):
            if s:
                if i > last:
                    runs.append((last, i, -DRIFT * (i - last)))
                runs.append((i, i + 1, s))
                last = i + 1
        return maximal_segments(runs)

    def chance(self, score: float, n: int) -> float:
        """ln of how many segments of that score a clean text of n tokens has."""
        return math.log(self.k * max(n, 1)) - self.rate * score

    def evidence(self, n: int, segments: list[tuple[int, int, float]]) -> float:
        each = [-self.chance(s, n) for _, _, s in segments]
        return sum(x for x in each if x > 0) or max(each, default=-self.chance(0.0, n))

    def probability(self, evidence: float) -> float:
        z = self.intercept + self.slope * max(-50.0, min(50.0, evidence))
        return 1 / (1 + math.exp(-max(-700.0, min(700.0, z))))


def sampled_labels(docs: DataFrame, labels: DataFrame, condition, scratch: Scratch) -> tuple[DataFrame, dict[int, int]]:
    """doc_id, toxic (0 or 1) of about TRAIN_DOCS / 2 documents of either label at most, and how many there are."""
    rows = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").filter(condition).groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    rows = scratch.stored(rows.join(docs.select("doc_id"), "doc_id", "left_semi"), "labels")
    there = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    share = F.when(F.col("toxic") == 1, min(1.0, TRAIN_DOCS / 2 / max(1, there.get(1, 0)))).otherwise(min(1.0, TRAIN_DOCS / 2 / max(1, there.get(0, 0))))
    return rows.filter(F.pmod(F.xxhash64("doc_id", F.lit(6)), F.lit(1 << 30)) < share * (1 << 30)), there


def train(docs: DataFrame, labels: DataFrame, condition) -> Model:
    """Fit on the labelled documents for which condition (on doc_id) holds."""
    with Scratch(docs.sparkSession, "toxicity") as scratch:
        picked, there = sampled_labels(docs.select("doc_id"), labels, condition, scratch)
        rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(picked), "doc_id").select("text", "toxic")  # about TRAIN_DOCS rows of two numbers
        return _fitted(scratch.stored(rows, "texts"), there)


def _fitted(rows: DataFrame, there: dict[int, int]) -> Model:
    """The model of rows (text, toxic), drawn from there[0] clean and there[1] toxic documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())
        docs_ = [0, 0]
        for b in batches:
            for text, toxic in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist()):
                docs_[toxic] += 1
                seen[toxic].update({f for w in set(tokens(text)) for f in features(w)})
        words = list(seen[0].keys() | seen[1].keys())
        yield pa.RecordBatch.from_arrays(
            [pa.array([None, *words], pa.string()), *(pa.array([docs_[k], *(seen[k][w] for w in words)], pa.int64()) for k in (0, 1))],
            names=["token", "clean", "toxic"],
        )

    counts = rows.mapInArrow(count, "token string, clean long, toxic long").groupBy("token").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    sums = {r["whole"]: r for r in counts.groupBy(F.col("token").isNull().alias("whole")).agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).collect()}
    n_clean, n_toxic = (sums[True]["clean"], sums[True]["toxic"]) if True in sums else (0, 0)
    if not n_clean or not n_toxic or False not in sums:
        return Model({}, intercept=-20.0 if not n_toxic else 20.0, slope=0.0)
    c, t = sums[False]["clean"], sums[False]["toxic"]
    prior = F.lit(PRIOR) * (F.col("clean") + F.col("toxic")) / (c + t)
    odds = lambda n, total: F.log((n + prior) / (total + PRIOR - n - prior))
    delta = odds(F.col("toxic"), t) - odds(F.col("clean"), c)
    z = delta / F.sqrt(1 / (F.col("toxic") + prior) + 1 / (F.col("clean") + prior))
    strong = counts.filter("token IS NOT NULL").select("token", delta.alias("s"), z.alias("z"), ((F.col("clean") + prior) / (c + PRIOR)).alias("p"))
    # Features of the sample that stand out: the sample bounds them.
    kept = strong.filter((F.col("z") >= SIGNIFICANT) & (F.col("s") > DRIFT)).select("token", "s", "p").orderBy("token").collect()
    model = Model({r["token"]: r["s"] - DRIFT for r in kept})
    model.rate = decay([r["s"] - DRIFT for r in kept], [r["p"] for r in kept])

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(len(w), max((s for _, _, s in model.segments(w)), default=0.0)) for w in map(tokens, b.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.float64())], names=["n", "top"])

    clean = rows.filter("toxic = 0").mapInArrow(best, "n long, top double").toArrow()  # a row a document of the sample
    model.k = constant(clean.column("n").to_numpy(), clean.column("top").to_numpy(), model.rate)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [model.evidence(len(w), model.segments(w)) for w in map(tokens, b.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.float64()), b.column("toxic").cast(pa.int32())], names=["x", "y"])

    pairs = rows.mapInArrow(weigh, "x double, y int").toPandas()  # a row a document of the sample
    model.intercept, model.slope = logistic(pairs["x"].to_numpy(), pairs["y"].to_numpy())
    model.intercept += math.log(max(1, there.get(1, 0)) / n_toxic) - math.log(max(1, there.get(0, 0)) / n_clean)
    return model


def decay(scores: list[float], shares: list[float]) -> float:
    """lambda of clean texts: tokens of these scores in these shares, all others -DRIFT."""
    if not scores:
        return 1.0
    s, p = np.array([*scores, -DRIFT]), np.array([*shares, max(1e-9, 1 - sum(shares))])
    p /= p.sum()
    if (s * p).sum() >= 0:  # no positive root
        return 0.05
    low, high = 1e-6, 1.0
    grow = lambda r: float(np.logaddexp.reduce(np.log(p) + r * s))
    while grow(high) < 0 and high < 100:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if grow(mid) < 0 else (low, mid)
    return low


def constant(n: np.ndarray, top: np.ndarray, rate: float) -> float:
    """K by maximum likelihood: P(best segment of n tokens < S) = exp(-K n exp(-rate S)); a top of 0 tells that
    there is no segment at all."""
    return float((top > 0).sum() + 0.5) / max(1.0, float((n * np.exp(-rate * top)).sum()))


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Intercept and slope by Newton's method, with a small ridge so that separable data converge."""
    a, w = np.column_stack([np.ones(len(x)), np.clip(x, -50, 50)]), np.zeros(2)
    ridge = np.diag([1e-3, 1e-3])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -500, 500)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + ridge, a.T @ (y - p) - ridge @ w)
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, passages (begin, end in tokens, score, expected) that are significant."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, passages = [], []
            for words in map(tokens, b.column("text").to_pylist()):
                found = model.segments(words)
                out.append(model.probability(model.evidence(len(words), found)))
                chances = [(x, model.chance(x[2], len(words))) for x in found]
                passages.append([{"begin": x[0], "end": x[1], "score": x[2], "expected": math.exp(e)} for x, e in chances if e < 0])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, pa.float64()), pa.array(passages, PASSAGES)], names=["doc_id", "score", "passages"])

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double, passages array<struct<begin: int, end: int, score: double, expected: double>>")


PASSAGES = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("expected", pa.float64())]))


def reject(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """docs without the toxic ones, whole rows; nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = map(tokens, (t or "" for t in b.column("text").to_pylist()))
            yield b.filter(pa.array([model.probability(model.evidence(len(w), model.segments(w))) < threshold for w in words], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def in_training(remainder: int = 2, parts: int = 4) -> Callable:
    """Rows to learn from: those whose crc32 of doc_id as text leaves another remainder; never null."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % parts != remainder, F.lit(False))
