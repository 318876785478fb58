"""Files of alignments and of haplotypes: what is made a record, a part or a group."""

import pytest

from strandloom.plans import files
from strandloom.sources import alignments, sinks, text

CONTIGS = [("c", 1000)]
ROWS = [
    ("a", 0, "c", 5, 30, "2S3M", "*", 0, 0, "ACGTN", [0, 1, 93, 254, 7], {"MD": "3", "RG": "x"}),
    ("b", 16, "c", 6, 0, "4M", "c", 9, -3, "ACGT", None, {}),
    ("d", 4, "*", 0, 0, "*", "*", 0, 0, "A", [9], {"XX": ""}),
]


def test_records_of_flat_columns(spark, tmp_path):
    """Qualities (also none) and tags (also none) survive; several parts go to a task."""
    rows = spark.createDataFrame(ROWS, alignments.SCHEMA).coalesce(1)
    alignments.write_bams(rows, str(tmp_path), CONTIGS).collect()
    got = alignments.bam(spark, f"{tmp_path}/*.bam")
    assert [tuple(r) for r in got.collect()] == ROWS
    assert [tuple(r) for r in got.select("qname", "quals").collect()] == [(r[0], r[10]) for r in ROWS]


def test_small_parts_share_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(alignments, "TASKS", 3)
    path = str(tmp_path / "x.bam")
    many = [(f"r{i}", 0, "c", 1 + i // 10, 30, "4M", "*", 0, 0, "ACGT", [i % 60] * 4, {}) for i in range(5000)]
    alignments.write_bam(path, CONTIGS, many, block=500)
    got = alignments.bam(spark, path, ("qname",), split=1000)
    assert got.rdd.getNumPartitions() <= 3
    assert sorted(r[0] for r in got.collect()) == sorted(r[0] for r in many)


@pytest.mark.parametrize("seq", ["acgt", "0E", "AC T"])
def test_what_is_no_base_is_refused(tmp_path, seq):
    with pytest.raises(ValueError):
        alignments.write_bam(str(tmp_path / "x.bam"), CONTIGS, [("a", 0, "c", 5, 30, "2M", "*", 0, 0, seq, None, {})])


def test_lines_are_ordered_before_they_grow(spark):
    plan = files.line_reads(spark, "/root/testdata/sf0.001", by_place=True)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("qname") < plan.index("RepartitionByExpression")  # the columns are made above the exchange


def test_haplotypes_in_archives(spark, tmp_path):
    groups = [(f"g{i}.fa", ">r\nAC-\n>h\n-CG") for i in range(3000)]
    shards = sinks.write_archive(spark.createDataFrame(groups, "name string, text string").coalesce(1), str(tmp_path))
    read = sinks.read_archives(shards)
    assert sorted(map(tuple, read.collect())) == sorted(groups)
    found = text.msa_texts(read.selectExpr("name AS file", "text AS value"))
    assert {tuple(r)[1:] for r in found.collect()} == {(2, 2, 1, 1)} and found.count() == 3000
    assert len(list(tmp_path.iterdir())) == 1
