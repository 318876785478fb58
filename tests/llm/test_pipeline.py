import math
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from test_text_models import plain_toxicity

import __spark_entry__ as entry
import corpus_pipeline
from strandloom.llm import queries

SF = "/root/testdata/sf0.001"


def test_stages_and_registration():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "toxicity", "near_duplicates", "packing"]
    names = entry.queries()
    assert "pipeline" in names and sum(n.startswith("op") for n in names) == 13


def test_each_stage_returns_documents_and_the_last_packs_all(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        before, after = docs.count(), out.count()
        assert 0 < after <= before
        docs = out
    pieces = corpus_pipeline.run(spark, SF)
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == {r.doc_id for r in docs.select("doc_id").collect()}


def plain_classes(texts, threshold):
    """The smallest id of each class of near-duplicates: exact weights, all pairs that share a shingle."""
    sets = {}
    for d, t in texts.items():
        w = re.findall(r"\w+", t.lower())
        sets[d] = Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()
    df = Counter(s for x in sets.values() for s in x)
    n = len(texts)
    idf = {s: 1 + min(1, max(0, math.log((1 + n) / (1 + k)) / math.log(2 + n))) for s, k in df.items()}
    weight = {d: {s: c * idf[s] for s, c in x.items()} for d, x in sets.items()}
    having, top = defaultdict(list), {d: d for d in texts}

    def find(d):
        while top[d] != d:
            d = top[d]
        return d

    for d in sorted(texts):
        for other in {o for s in sets[d] for o in having[s]}:
            a, b = weight[d], weight[other]
            both = sum(min(v, b[s]) for s, v in a.items() if s in b)
            alike = both / (sum(a.values()) + sum(b.values()) - both)
            if alike >= threshold:
                x, y = sorted((find(d), find(other)))
                top[y] = x
        for s in sets[d]:
            having[s].append(d)
    plain = defaultdict(list)  # texts without words are alike if equal
    for d, t in texts.items():
        if not sets[d]:
            plain[t].append(d)
    return {min(x) for x in plain.values()} | {find(d) for d in texts if sets[d]}


def test_the_pipeline_equals_plain_stages(spark):
    rows = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    good = {r[0] for r in con.execute(f"SELECT doc_id FROM ({queries.OP5_SQL}) WHERE kept").fetchall()}
    odds = plain_toxicity({d: rows[d].text or "" for d in good}, spark.read.parquet(f"{SF}/labels.parquet").collect())
    assert all(abs(p - 0.3) > 1e-3 for p in odds.values())
    clean = {d for d, p in odds.items() if p < 0.3}
    # Weights have 256 levels, so a pair closer to the threshold than these may be judged either way.
    least, kept, most = (plain_classes({d: rows[d].text or "" for d in clean}, x) for x in (0.793, 0.8, 0.807))
    assert least <= kept <= most and len(most) - len(least) <= 2 and len(most) < len(clean) <= len(good) < len(rows)
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    library.encode_special_tokens = True
    pieces = defaultdict(list)
    used = Counter()
    for r in corpus_pipeline.run(spark, SF).collect():
        pieces[r.doc_id].append(r)
        used[r.sequence_id] += r.length
        assert 0 <= r.offset and r.offset + r.length <= 1024
    assert least <= set(pieces) <= most and max(used.values()) <= 1024
    assert sum(used.values()) > 0.98 * 1024 * (len(used) - 1)
    for d, own in pieces.items():
        ids = np.array([*library.encode(rows[d].text or "", add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for r in sorted(own, key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + r.length].tobytes()))
            at += r.length
        assert at == len(ids)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations", "embeddings", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    cursor = con.execute(queries.ORACLES[name])
    names = [d[0] for d in cursor.description]
    got = queries.QUERIES[name](spark, SF)
    assert sorted(map(repr, (tuple(r[n] for n in names) for r in got.collect()))) == sorted(map(repr, cursor.fetchall()))
