"""Graphs of k-mers (numbers, see functions.kmers) as tables: chains by pointer doubling, tips and cycles by peeling, walks
by frontier joins. All graphs (one a key) are worked on in the same jobs.

An oriented edge (u, v) goes from a k-mer as read to the next; ru and rv are their reverse complements, so (rv, ru) is the
same edge read backwards, and every edge is there in both readings. keep(df) writes df and reads it again: it cuts lineage
after each round.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandloom.functions import kmers
from strandloom.functions.seq import reverse_complement
from strandloom.operators.scans import Keep, written


def oriented_edges(words: DataFrame, key: str, k: int) -> DataFrame:
    """key, u, v, ru, rv of the distinct windows of k + 1 bases (key, word, back): kmers.canonical_words()."""
    mask = (1 << 2 * k) - 1
    head, tail = lambda c: F.shiftright(c, 2), lambda c: F.col(c).bitwiseAND(mask)
    one = lambda a, b: F.struct(head(a).alias("u"), tail(a).alias("v"), tail(b).alias("ru"), head(b).alias("rv"))
    both = F.when(F.col("word") == F.col("back"), F.array(one("word", "back"))).otherwise(F.array(one("word", "back"), one("back", "word")))
    return words.select(key, F.inline(both))  # no union, which would lose how the rows are dealt


def order(word: Column, back: Column) -> Column:
    """Number of an oriented k-mer that sorts by its node, its own strand first."""
    return F.shiftleft(F.least(word, back), 1) + (word > back).cast("long")


def links(edges: DataFrame, key: str) -> DataFrame:
    """key, u, v, rv: edges that are the only one out of u and the only one into v, of two different nodes."""
    only_out = edges.groupBy(key, "u").agg(F.count("*").alias("n"), F.first("v").alias("v"), F.first("ru").alias("ru"), F.first("rv").alias("rv")).filter("n = 1")
    only_in = edges.groupBy(key, "v").agg(F.count("*").alias("m")).filter("m = 1").select(key, "v")
    return only_out.filter("v <> u AND v <> ru").select(key, "u", "v", "rv").join(only_in, [key, "v"])


def list_ranks(lists: DataFrame, key: str, keep: Keep) -> tuple[DataFrame, int]:
    """key, s, rs, no, to, rto, dist, low, done of list cells (key, s, rs, no, to, rto): the last cell of each list
    and how far it is, by jumps that double; and the number of rounds. A cell that is its own successor ends a list.

    Cells of cycles are never done; low is the least number of their cycle. A round in which no cell gets done and no
    low falls is the last, so there are about log2 of the longest list.
    """
    state = lists.withColumn("dist", (F.col("to") != F.col("s")).cast("long")).withColumn("low", F.col("no")).withColumn("done", F.col("to") == F.col("s"))
    state, rounds = keep(state), 0
    while state.filter("NOT done").head():
        rounds += 1
        at = state.select(key, F.col("s").alias("to"), F.col("to").alias("to2"), F.col("rto").alias("rto2"), F.col("dist").alias("dist2"), F.col("low").alias("low2"), F.col("done").alias("done2"))
        hop = state.filter("NOT done").join(at, [key, "to"])
        hop = hop.select(key, "s", "rs", "no", F.col("to2").alias("to"), F.col("rto2").alias("rto"), (F.col("dist") + F.col("dist2")).alias("dist"), F.least("low", "low2").alias("low"), F.col("done2").alias("done"), (F.col("done2") | (F.col("low2") < F.col("low"))).alias("moved"))
        new = keep(state.filter("done").withColumn("moved", F.lit(False)).unionByName(hop))
        state = new.drop("moved")
        if not new.filter("moved").head():
            break
    return state, rounds


def chains(edges: DataFrame, key: str, keep: Keep = written) -> tuple[DataFrame, int]:
    """key, s, rs, to, rto, dist, ring of all oriented k-mers: the last of the chain without branches that each is on, and the
    steps to it (ring: of a cycle, cut before its least node); and the rounds of jumps."""
    cells = edges.select(key, F.col("u").alias("s"), F.col("ru").alias("rs")).union(edges.select(key, "v", "rv")).distinct()
    next_ = links(edges, key).select(key, F.col("u").alias("s"), F.col("v").alias("to"), F.col("rv").alias("rto"))
    lists = cells.join(next_, [key, "s"], "left").select(key, "s", "rs", order(F.col("s"), F.col("rs")).alias("no"), F.coalesce("to", "s").alias("to"), F.coalesce("rto", "rs").alias("rto"))
    lists = keep(lists)
    ranked, rounds = list_ranks(lists, key, keep)
    rings = ranked.filter("NOT done").select(key, "s", "low")
    if rings.head():
        own = lists.join(rings, [key, "s"])
        end = order(F.col("to"), F.col("rto")) == F.col("low")  # the cell before the least one
        cut = own.select(key, "s", "rs", "no", F.when(end, F.col("s")).otherwise(F.col("to")).alias("to"), F.when(end, F.col("rs")).otherwise(F.col("rto")).alias("rto"))
        again, more = list_ranks(cut, key, keep)
        out = ranked.filter("done").withColumn("ring", F.lit(False)).unionByName(again.withColumn("ring", F.lit(True)))
        return keep(out.select(key, "s", "rs", "to", "rto", "dist", "ring")), rounds + more
    return ranked.withColumn("ring", F.lit(False)).select(key, "s", "rs", "to", "rto", "dist", "ring"), rounds


def unitigs(edges: DataFrame, key: str, k: int, keep: Keep = written) -> tuple[DataFrame, int]:
    """chain_rows() of the chains of edges, and the rounds."""
    ranked, rounds = chains(edges, key, keep)
    return chain_rows(ranked, key, k, keep), rounds


def chain_rows(ranked: DataFrame, key: str, k: int, keep: Keep = written) -> DataFrame:
    """key, head, rhead, tail, rtail, nodes, seq, ring, own of chains(), read both ways: their first and last oriented
    k-mers, their number, the bases in order, and whether this is the reading that stands for the chain."""
    first = F.struct("dist", "s", "rs")
    g = ranked.groupBy(key, "to").agg(
        F.max(first).alias("a"), F.first("rto").alias("rtail"), F.count("*").alias("nodes"), F.bool_or("ring").alias("ring"),
        F.sort_array(F.collect_list(F.struct((-F.col("dist")).alias("d"), kmers.last_base(F.col("s")).alias("b")))).alias("bases"),  # a chain's bases are one string anyway
    )
    rest = F.array_join(F.transform(F.slice("bases", 2, F.greatest(F.size("bases") - 1, F.lit(1))), lambda x: x["b"]), "")
    seq = F.concat(kmers.letters(F.col("a.s"), k), F.when(F.size("bases") > 1, rest).otherwise(""))
    head_plus, tail_plus = F.col("a.s") <= F.col("a.rs"), F.col("to") <= F.col("rtail")
    # Read backwards the chain begins with the other strand of its end.
    mine = F.struct(F.least("a.s", "a.rs"), ~head_plus) <= F.struct(F.least("to", "rtail"), tail_plus)
    own = F.when(F.col("ring"), head_plus).otherwise(mine)
    return keep(g.select(key, F.col("a.s").alias("head"), F.col("a.rs").alias("rhead"), F.col("to").alias("tail"), "rtail", "nodes", seq.alias("seq"), "ring", own.alias("own")))


def chain_edges(edges: DataFrame, units: DataFrame, key: str) -> DataFrame:
    """key, a, b: edges between chains, by the last oriented k-mers of both."""
    e = edges.select(key, F.col("u").alias("a"), F.col("v").alias("head")).join(units.select(key, F.col("tail").alias("a")), [key, "a"])
    return e.join(units.select(key, "head", F.col("tail").alias("b")), [key, "head"]).select(key, "a", "b").distinct()


def text_graphs(df: DataFrame, key: str, text: str, k: int, keep: Keep = written, peel: bool = False) -> tuple[DataFrame, DataFrame]:
    """units and chain_edges() of the graphs of each key's texts; units with both ends of both readings as chain_rows() has them.
    With peel, edges that peeled() takes away may have gone already.

    The chains of a key with one text are found beside the text, in its row; so only chains, not k-mers, are shuffled. Keys with
    several texts, whose graphs are unions, take chains() over tables.
    """
    rows = df.select(key, text)
    schema = f"`{key}` {rows.dtypes[0][1]}, head long, rhead long, tail long, rtail long, nodes long, seq string, ring boolean, own boolean, nexts array<long>"
    one = keep(rows.mapInArrow(_text_units(k, peel), schema)) if rows.groupBy(key).count().filter("count > 1").isEmpty() else None
    if one is None:
        several = keep(rows.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1").select(key))
        same = lambda how: rows.alias("r").join(several.alias("m"), F.col(f"r.{key}").eqNullSafe(F.col(f"m.{key}")), how)
        one = keep(same("left_anti").mapInArrow(_text_units(k, peel), schema))
        e = keep(oriented_edges(kmers.canonical_words(same("left_semi"), key, text, k + 1), key, k))
        units, _ = unitigs(e, key, k, keep)
        return one.drop("nexts").unionByName(units), _nexts(one, key).unionByName(chain_edges(e, units, key))
    return one.drop("nexts"), _nexts(one, key)


def _nexts(units: DataFrame, key: str) -> DataFrame:
    return units.select(key, F.col("tail").alias("a"), F.explode("nexts").alias("b"))


def _text_units(k: int, peel: bool):
    """Rows of kmers.text_chains(), each with the last k-mers of the chains that follow it."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, t in enumerate(b.column(1).to_pylist()):
                s, rs, first, ring, a, z = kmers.text_chains(t or "", k)
                if not len(s):
                    continue
                stay = peel
                while np.any(stay):
                    stay = np.isin(a, z) & np.isin(z, a)
                    if stay.all():
                        break
                    a, z = a[stay], z[stay]
                n = np.diff(np.append(first, len(s)))
                last = first + n - 1
                head, rhead, tail, rtail = s[first], rs[first], s[last], rs[last]
                bases = np.frombuffer(b"ACGT", np.uint8)[s & 3].tobytes().decode()
                starts = kmers.letter_array(head, k).to_pylist()
                seqs = [x + bases[f + 1 : f + m] for x, f, m in zip(starts, first.tolist(), n.tolist())]
                plus, end = head <= rhead, tail <= rtail
                low, other = np.minimum(head, rhead), np.minimum(tail, rtail)
                own = np.where(ring, plus, (low < other) | ((low == other) & (~plus <= end)))
                order = np.argsort(a, kind="stable")
                offsets = np.searchsorted(a[order], np.arange(len(first) + 1))
                nexts = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(tail[z[order]]))
                of = b.column(0).take(pa.array(np.full(len(first), i)))
                columns = [of, *map(pa.array, (head, rhead, tail, rtail, n)), pa.array(seqs, pa.string()), pa.array(ring), pa.array(own), nexts]
                yield pa.RecordBatch.from_arrays(columns, names=[b.schema.names[0], "head", "rhead", "tail", "rtail", "nodes", "seq", "ring", "own", "nexts"])

    return make


def without_tips(edges: DataFrame, key: str, k: int, anchors: DataFrame, keep: Keep = written, weights: DataFrame | None = None, removed: list[DataFrame] | None = None) -> tuple[DataFrame, int]:
    """edges without tips: chains of fewer than k nodes with one neighbour at most, anchors (key, node) excepted, go until
    there are none; and the rounds. A round works on the graphs only that lost a tip in the round before. Nodes count as
    weights (key, node, nodes) has them, else as one; those that go, a table (key, node) a round, are added to removed."""
    done, live, rounds = None, edges, 0
    while True:
        ranked, _ = chains(live, key, keep)
        node = F.least("s", "rs").alias("node")
        members = ranked.select(key, "to", node).distinct()
        weighed = ranked.withColumn("node", node).join(weights, [key, "node"]) if weights is not None else ranked.withColumn("nodes", F.lit(1))
        size = weighed.groupBy(key, "to").agg(F.sum("nodes").alias("nodes"), F.max(F.struct("dist", "rs"))["rs"].alias("rhead"))
        out = live.groupBy(key, "u").agg(F.count("*").alias("n"))
        degree = lambda end: size.join(out.select(key, F.col("u").alias(end), "n"), [key, end], "left").select(key, "to", F.coalesce("n", F.lit(0)).alias(f"n_{end}"))
        size = size.join(degree("to"), [key, "to"]).join(degree("rhead"), [key, "to"])
        held = members.join(anchors.select(key, "node").distinct(), [key, "node"], "left_semi").select(key, "to").distinct()
        short = size.filter((F.col("nodes") < k) & (F.col("n_to") + F.col("n_rhead") <= 1)).join(held, [key, "to"], "left_anti")
        gone = keep(members.join(short.select(key, "to"), [key, "to"], "left_semi").select(key, "node").distinct())
        if not gone.head():
            return (live if done is None else done.unionByName(live)), rounds
        rounds += 1
        if removed is not None:
            removed.append(gone)
        hit = gone.select(key).distinct()
        same = live.join(hit, key, "left_anti")
        done = keep(same if done is None else done.unionByName(same))
        left = live.join(hit, key, "left_semi")
        for a, b in (("u", "ru"), ("v", "rv")):
            left = left.withColumn("node", F.least(a, b)).join(gone, [key, "node"], "left_anti").drop("node")
        live = keep(left)


def texts_without_tips(df: DataFrame, key: str, text: str, k: int, keep: Keep = written) -> DataFrame:
    """key, edges: how many oriented edges without_tips() leaves of each key's graph, the first and the last k bases of its texts
    being anchors. Keys with one text are done in its row, so nothing of them is shuffled; others as tables."""
    rows = df.select(key, text)
    schema = f"`{key}` {rows.dtypes[0][1]}, edges long"
    several = rows.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1").select(key)
    if several.isEmpty():
        return rows.mapInArrow(_text_without_tips(k), schema)
    several = keep(several)
    same = lambda how: rows.alias("r").join(several.alias("m"), F.col(f"r.{key}").eqNullSafe(F.col(f"m.{key}")), how)
    shared = keep(same("left_semi"))
    units, e = text_graphs(shared, key, text, k, keep)
    of = kmers.end_words(shared, key, text, k).select(key, F.array(*(kmers.letters(F.col(c), k) for c in ("first", "last"))).alias("ends"))
    held = units.join(of, key).filter(F.exists("ends", lambda w: F.contains(F.col("seq"), w))).select(key, "tail")
    return same("left_anti").mapInArrow(_text_without_tips(k), schema).unionByName(units_without_tips(units, e, key, k, held, keep)[0])


def _text_without_tips(k: int):
    """Rows of edges_without_tips(), where it leaves any."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            left = np.array([edges_without_tips(t or "", k) for t in b.column(1).to_pylist()], np.int64)
            at = np.flatnonzero(left)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), pa.array(left[at])], names=[b.schema.names[0], "edges"])

    return make


def edges_without_tips(text: str, k: int) -> int:
    """What units_without_tips() counts, of one text's graph with the text's ends as anchors."""
    s, rs, first, ring, a, z = kmers.text_chains(text, k)
    if not len(s):
        return 0
    nodes = np.diff(np.append(first, len(s)))
    tail = s[first + nodes - 1]
    order = np.argsort(tail)
    other = order[np.minimum(np.searchsorted(tail[order], rs[first]), len(first) - 1)]  # a chain's other reading; of no use for rings
    words = [c[0] for c in (kmers.text_codes(x, k)[0] for x in (text[:k], text[-k:])) if len(text) > k and len(c)]
    holds = np.searchsorted(first, np.flatnonzero(np.isin(s, words)), "right") - 1
    back, size, anchors = other.tolist(), nodes.tolist(), {*holds.tolist(), *other[holds].tolist()}
    follow: dict[int, set[int]] = {}
    open_ = ~ring[a]  # a ring's only neighbour is itself, where it is cut
    for x, y in zip(a[open_].tolist(), z[open_].tolist()):
        follow.setdefault(x, set()).add(y)
        follow.setdefault(y, set())
    removed: set[int] = set()
    while gone := {n for x, y in follow.items() if not y for n in _tip(back[x], follow, back, size, anchors, k)}:
        gone |= {back[n] for n in gone}
        removed |= gone
        follow = {x: y - gone for x, y in follow.items() if x not in gone}
        met = {x for x, y in follow.items() if y}.union(*follow.values())
        follow = {x: y for x, y in follow.items() if x in met}
    stay = [i for i in np.flatnonzero(~ring).tolist() if i not in removed and (size[i] >= k or i in follow or i in anchors)]
    return sum(size[i] - 1 for i in stay) + int(nodes[ring].sum()) + sum(map(len, follow.values()))


def _tip(w: int, follow: dict[int, set[int]], back: list[int], size: list[int], anchors: set[int], k: int) -> list[int]:
    """The path without branches from w, before which nothing is, if it is a tip."""
    path, total = [w], size[w]
    while len(follow[w]) == 1:
        (v,) = follow[w]
        if len(follow[back[v]]) != 1 or v in (w, back[w]):
            break
        w = v
        path.append(w)
        total += size[w]
    return path if total < k and len(follow[w]) <= 1 and anchors.isdisjoint(path) else []


def units_without_tips(units: DataFrame, edges: DataFrame, key: str, k: int, held: DataFrame, keep: Keep = written) -> tuple[DataFrame, int]:
    """key, edges: how many oriented edges of k-mers without_tips() leaves, from chains (units of text_graphs(), edges between them
    as chain_edges()), those with a tail in held (key, tail) being anchors; and the rounds. A chain is one node, by the last
    k-mers of its two readings, that counts as its k-mers. Rings have no neighbours and stay; their readings are cut at
    different places, so they are no such nodes."""
    rings = units.filter("ring").select(key, F.col("nodes").alias("n"))
    units = units.filter("NOT ring")
    node = F.least("tail", "rhead").alias("node")
    ids = units.select(key, "tail", "rhead")
    e = edges.join(ids.select(key, F.col("tail").alias("a"), F.col("rhead").alias("ru")), [key, "a"]).join(ids.select(key, F.col("tail").alias("b"), F.col("rhead").alias("rv")), [key, "b"])
    weights = units.filter("own").select(key, node, "nodes")
    anchors = keep(units.join(held.select(key, "tail").distinct(), [key, "tail"], "left_semi").select(key, node).distinct())
    removed: list[DataFrame] = []
    left, rounds = without_tips(keep(e.select(key, F.col("a").alias("u"), F.col("b").alias("v"), "ru", "rv")), key, k, anchors, keep, weights, removed)
    for gone in removed:
        weights = weights.join(gone, [key, "node"], "left_anti")
    # A chain that has no neighbour left is no node of the edges any more.
    met = left.select(key, F.least("u", "ru").alias("node")).union(left.select(key, F.least("v", "rv"))).distinct()
    alone = weights.filter(F.col("nodes") < k).join(met, [key, "node"], "left_anti").join(anchors, [key, "node"], "left_anti")
    inner = weights.join(alone.select(key, "node"), [key, "node"], "left_anti").select(key, (2 * (F.col("nodes") - 1)).alias("n"))
    return inner.unionByName(rings).unionByName(left.select(key, F.lit(1).alias("n"))).groupBy(key).agg(F.sum("n").alias("edges")).filter("edges > 0"), rounds


def peeled(edges: DataFrame, key: str, keep: Keep = written) -> tuple[DataFrame, int]:
    """The edges (key, a, b) that lie on cycles or between them: those from a start or to an end go, round by round, and
    each round looks only at what the round before laid bare."""
    live, rounds = keep(edges.select(key, "a", "b").distinct()), 0
    while True:
        ins, outs = live.select(key, F.col("b").alias("a")).distinct(), live.select(key, F.col("a").alias("b")).distinct()
        stay = keep(live.join(ins, [key, "a"], "left_semi").join(outs, [key, "b"], "left_semi"))
        before, after = live.count(), stay.count()
        live, rounds = stay, rounds + 1
        if before == after:
            return live, rounds


def reached(edges: DataFrame, starts: DataFrame, key: str, keep: Keep = written) -> DataFrame:
    """key, a: what edges (key, a, b) lead to from starts (key, a), these included."""
    seen = front = keep(starts.select(key, "a").distinct())
    while front.head():
        new = front.join(edges, [key, "a"]).select(key, F.col("b").alias("a")).distinct().join(seen, [key, "a"], "left_anti")
        front = keep(new)
        seen = seen.unionByName(front)
    return seen


def walks(edges: DataFrame, ends: DataFrame, key: str, visits: int = 1 << 20, keep: Keep = written) -> tuple[DataFrame, int]:
    """key, place, path, limited: walks over edges (key, a, b) from source to sink of ends (key, source, sink), none through a
    state twice, shortest first and then by their states; only walks with an edge that no walk before has, and the walk of a
    source that is the sink. And the rounds.

    A frontier holds the walks so far of all graphs; each round joins it with the edges. A graph stops at so many visits
    (frontier rows), the rows of a round counting in order; limited tells that it did.
    """
    rank = F.row_number().over(W.partitionBy(key).orderBy("path"))
    front = keep(ends.select(key, "sink", F.array("source").alias("path"), F.lit(1).cast("long").alias("used")))
    whole, cut, rounds = [front.filter(F.col("sink") == F.col("path")[0]).select(key, "path")], [], 0
    none = front.filter("false").select(key, "path")
    while front.filter(F.element_at("path", -1) != F.col("sink")).head():
        rounds += 1
        step = front.withColumn("a", F.element_at("path", -1)).filter(F.col("a") != F.col("sink")).join(edges.select(key, "a", "b"), [key, "a"])
        step = step.filter(~F.array_contains("path", F.col("b"))).select(key, "sink", F.concat("path", F.array("b")).alias("path"), "used")
        step = keep(step.withColumn("no", rank).withColumn("all", F.count("*").over(W.partitionBy(key))))
        cut.append(step.filter(F.col("used") + F.col("all") > visits).select(key).distinct())
        front = step.filter(F.col("used") + F.col("no") <= visits).select(key, "sink", "path", (F.col("used") + F.least("all", F.lit(visits) - F.col("used"))).alias("used"))
        whole.append(front.filter(F.element_at("path", -1) == F.col("sink")).select(key, "path"))
    found, limited = none, none.select(key)
    for w in whole:
        found = found.unionByName(w)
    for c in cut:
        limited = limited.unionByName(c)
    place = F.row_number().over(W.partitionBy(key).orderBy(F.size("path"), "path"))
    found = keep(found.withColumn("place", place))
    steps = found.filter(F.size("path") > 1).select(key, "place", F.explode(F.zip_with(F.slice("path", 1, F.size("path") - 1), F.slice("path", 2, F.size("path")), lambda a, b: F.struct(a.alias("a"), b.alias("b")))).alias("edge"))
    new = steps.groupBy(key, "edge").agg(F.min("place").alias("place")).select(key, "place").distinct()
    new = new.unionByName(found.filter(F.size("path") == 1).select(key, "place")).distinct()
    out = found.join(new, [key, "place"], "left_semi").join(limited.distinct().withColumn("limited", F.lit(True)), key, "left")
    return out.select(key, "place", "path", F.coalesce("limited", F.lit(False)).alias("limited")), rounds


def haplotypes(found: DataFrame, units: DataFrame, key: str, k: int) -> DataFrame:
    """key, place, seq: the bases of walks (key, place, path of chains): chains overlap by k - 1 bases."""
    steps = found.select(key, "place", F.posexplode("path").alias("at", "tail")).join(units.select(key, "tail", "seq"), [key, "tail"])
    own = F.when(F.col("at") == 0, F.col("seq")).otherwise(F.substring("seq", F.lit(k), F.length("seq")))
    g = steps.groupBy(key, "place").agg(F.sort_array(F.collect_list(F.struct("at", own.alias("s")))).alias("x"))
    return g.select(key, "place", F.array_join(F.transform("x", lambda x: x["s"]), "").alias("seq"))


def canonical_seq(seq: Column) -> Column:
    return F.least(seq, reverse_complement(seq))
