import hashlib
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strandloom.llm import bpe, packing, tokenbin
from strandloom.llm.tokens import Encoder

JSON, RANKS = P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken")
TEXTS = st.text(st.sampled_from("ab étZ01²\n\t '.,!%_s　ß½’<|>x🙂́"), max_size=40)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(JSON)
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(RANKS, P.PATTERN)


ENCODER = Encoder(JSON)


@settings(max_examples=300, deadline=None)
@given(TEXTS)
def test_units_and_prefixes_equal_the_libraries(library, codec, text):
    want = library(text)
    assert np.frombuffer(ENCODER(text), ENCODER.dtype).tolist() == want
    got = codec.encode(text)
    assert np.frombuffer(got, "<u4").tolist() == want
    assert codec.decode(got) == text.encode()


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=40), st.integers(0, 40), st.integers(0, 40), st.binary(max_size=6))
def test_appends_and_edits_equal_fresh_encodings(codec, data, a, b, new):
    data = bytes(97 + x % 6 for x in data) * 20
    a, b = sorted((a % (len(data) + 1), b % (len(data) + 1)))
    whole = bpe.Prefixes(codec.v, data)
    grown = bpe.Prefixes(codec.v, data[:a])
    grown.append(data[a:])
    assert grown.last == whole.last
    whole.edit(a, b, new)
    assert whole.last == bpe.Prefixes(codec.v, data[:a] + new + data[b:]).last
    assert whole.ids(a) == bpe.Prefixes(codec.v, data[:a]).ids()


def test_an_edit_computes_little_anew(codec):
    p = bpe.Prefixes(codec.v, b" the cat sat on a mat" * 500)
    assert p.edit(100, 101, b"x") < 400


def test_encode_documents(docs, no_docs, library):
    rows = bpe.encode_documents(docs, RANKS, P.PATTERN).collect()
    texts = [r.text or "" for r in docs.collect()]
    assert len(rows) == len(texts)
    assert sorted(r.ids_sha256 for r in rows) == sorted(hashlib.sha256(np.array(library(t), "<u4").tobytes()).hexdigest() for t in texts)
    assert sorted(r.decoded_sha256 for r in rows) == sorted(hashlib.sha256(t.encode()).hexdigest() for t in texts)
    assert bpe.encode_documents(no_docs, RANKS, P.PATTERN).count() == 0


@given(st.lists(st.integers(0, 2**32 - 1), min_size=1, max_size=300))
def test_rank_codes_round_trip(ranks):
    control, data = tokenbin.encode_ranks(np.array(ranks, np.uint32))
    assert tokenbin.decode_ranks(control, data, len(ranks)).tolist() == ranks
    assert len(control) == -(-len(ranks) // 4)


def test_token_files(docs, no_docs, library, monkeypatch):
    monkeypatch.setattr(tokenbin, "BLOCK", 1000)
    rows = tokenbin.read_files(tokenbin.token_files(docs, JSON)).collect()
    want = sorted(((r.doc_id is not None, r.doc_id or 0, len(i), zlib.crc32(np.array(i, "<u4").tobytes())) for r in docs.collect() for i in [[*library(r.text or ""), 0]]))
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.n_tokens, r.ids_crc32) for r in rows)
    assert got == want
    at = 0
    for r in sorted(rows, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    assert [r.doc_id for r in sorted(rows, key=lambda r: r.start)] == sorted([r.doc_id for r in docs.collect()], key=lambda x: (x is not None, x))
    assert tokenbin.read_files(tokenbin.token_files(no_docs, JSON)).count() == 0


@pytest.mark.parametrize("targets", [None, {"a": 1.0, "b": 3.0}])
def test_packing(docs, library, targets):
    rows = packing.pack(docs, JSON, targets, bin_tokens=5000).collect()
    ids = defaultdict(list)
    for d in docs.collect():
        ids[d.doc_id].append([*library(d.text or ""), 0])
    pieces, windows = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        windows[r.sequence_id].append(r)
    for doc_id, want in ids.items():
        if len(want) == 1:
            at = 0
            for r in sorted(pieces[doc_id], key=lambda r: r.start):
                assert r.start == at and r.doc_tokens == len(want[0])
                assert r.ids_crc32 == zlib.crc32(np.array(want[0][at : at + r.length], "<u4").tobytes())
                at += r.length
            assert at == len(want[0])
        assert sum(r.length for r in pieces[doc_id]) == sum(map(len, want))
    for own in windows.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
    total = sum(len(i) for want in ids.values() for i in want)
    assert len(windows) <= total / 1024 + 3 + total / 5000


def test_packing_of_nothing(no_docs):
    assert packing.pack(no_docs, JSON).count() == 0


def test_quotas_keep_proportions_and_carry_deficits():
    counts = np.array([6000, 3000, 1240])
    w, column, n = packing.quotas(counts, np.array([0.4, 0.3, 0.3]), 1024)
    give = np.zeros((10, 3), np.int64)
    give[w, column] = n
    assert n.min() > 0
    assert give.sum(axis=0).tolist() == counts.tolist() and (give.sum(axis=1) == 1024).all()
    assert np.abs(give[:-1] - 1024 * counts / counts.sum()).max() <= 2
    assert np.abs(np.cumsum(give, axis=0) - np.arange(1, 11)[:, None] * 1024 * counts / counts.sum()).max() < 3


def test_packing_of_many_sources(spark, library):
    """Every source counts, and the plan stays a table."""
    rows = [(i, f"text {i} " * (i % 9), f"host{i % 700}") for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = packing.pack(docs, JSON, {"host3": 2.0, "none": 1.0}, bin_tokens=4000).collect()
    lengths, windows = defaultdict(int), defaultdict(int)
    for r in got:
        lengths[r.doc_id] += r.length
        windows[r.sequence_id] += r.length
    assert lengths == {i: len(library(t)) + 1 for i, t, _ in rows}
    assert max(windows.values()) <= 1024 and len(windows) <= sum(windows.values()) / 1024 + 3 + sum(windows.values()) / 4000
    first = min(windows)
    assert {r.source for r in got if r.sequence_id == first} == {"host3"}


def test_phases_follow_targets_until_a_source_is_dry():
    plan = packing.phases({"a": 100, "b": 1000, "c": 50}, {"a": 1, "b": 1}, 10_000)
    assert plan[:2] == [("a", 0, 100, 0, 1), ("b", 0, 100, 0, 1)]
    assert {(s, sum(x[2] for x in plan if x[0] == s)) for s in "abc"} == {("a", 100), ("b", 1000), ("c", 50)}
