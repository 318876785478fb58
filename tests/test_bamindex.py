"""The index of a BAM file: its ranges hold all records of a region, and little else is read."""

import random
import zlib

import pytest

from strandloom.sources import alignments, bamindex

HEADER = "@HD\tVN:1.6\tSO:coordinate\n"


def reads(n=6000):
    g = random.Random(3)
    out = []
    for i in range(n):
        chrom = "ab"[g.random() < 0.3]
        pos = g.randrange(1, 3_000_000)
        cigar = g.choice(["100M", "100M", "10S90M", "50M200000N50M", "50M7D50M"])
        out.append((f"r{i}", 0, chrom, pos, g.randrange(60), cigar, "*", 0, 0, "ACGTTGCATC" * 10, [30] * 100, {"MD": "100"}))
    out.sort(key=lambda r: (r[2], r[3]))
    return [*out, ("none", 4, "*", 0, 0, "*", "*", 0, 0, "ACGT", [9] * 4, {})]


def test_index_opens_a_share_of_the_blocks(tmp_path, monkeypatch):
    path = str(tmp_path / "x.bam")
    rows = reads()
    alignments.write_bam(path, [("a", 1 << 28), ("b", 1 << 28)], rows, HEADER, block=4000)
    index = bamindex.index_of(path)
    with open(f"{path}.bai", "wb") as f:
        f.write(index.to_bytes())
    assert bamindex.Index.from_bytes(index.to_bytes()).tiles == index.tiles
    opened, real = [], zlib.decompress
    monkeypatch.setattr(alignments.zlib, "decompress", lambda *a: (opened.append(1), real(*a))[1])
    for regions in ([("a", 1_000_000, 1_010_000)], [("b", 2_900_000, 2_900_001)], [("a", 5, 6), ("b", 1_500_000, 1_600_000)], [("a", 1, 1 << 28)], [("b", 9_000_000, 9_000_100)], [("nowhere", 1, 9)]):
        opened.clear()
        whole = list(alignments.read_bam(path, regions=regions, columns=("qname", "pos")))
        every = len(opened)
        opened.clear()
        ranges = bamindex.plan(path, regions, 1 << 14, gap=0)
        got = list(alignments.read_bam(path, regions=regions, columns=("qname", "pos"), ranges=ranges))
        assert sorted(got) == sorted(whole)
        if regions[0][2] - regions[0][1] < 1 << 20 and regions[0][0] != "nowhere":
            assert len(opened) < every / 2, (regions, len(opened), every)
    long = bamindex.plan(path, [("a", 1, 1 << 28)], 1 << 14)
    assert len(long) > 3 and all(a < b for a, b in long) and long == sorted(long)


def test_bins():
    assert bamindex.bin_of(0, 1) == 4681 and bamindex.bin_of(16383, 16385) == 585 and bamindex.bin_of(0, 1 << 29) == 0
    assert set(bamindex.bins_over(0, 1)) == {0, 1, 9, 73, 585, 4681}


def test_files_out_of_order_have_no_index(tmp_path):
    path = str(tmp_path / "y.bam")
    alignments.write_bam(path, [("a", 1000)], [(f"r{p}", 0, "a", p, 9, "4M", "*", 0, 0, "ACGT", [9] * 4, {}) for p in (9, 3)])
    with pytest.raises(ValueError, match="order"):
        bamindex.index_of(path)
    none = str(tmp_path / "z.bam")
    alignments.write_bam(none, [("a", 1000)], [], HEADER)
    assert bamindex.index_of(none).ranges(0, 0, 1000) == []


def test_records_larger_than_blocks(tmp_path):
    """A record over many blocks is put together once, not byte by byte."""
    path = str(tmp_path / "l.bam")
    rows = [(f"r{i}", 0, "a", i + 1, 9, "200000M", "*", 0, 0, "ACGT" * 50_000, [9] * 200_000, {}) for i in range(3)]
    alignments.write_bam(path, [("a", 1 << 20)], rows, HEADER, block=5000)
    assert [(r[0], len(r[9])) for r in alignments.read_bam(path)] == [(f"r{i}", 200_000) for i in range(3)]
    assert [r[0] for at in range(0, 400_000, 50_000) for r in alignments.read_bam(path, at, at + 50_000, columns=("qname",))][:3] == ["r0", "r1", "r2"]
