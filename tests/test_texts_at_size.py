"""Queries over texts: what each text costs."""

from strandloom.functions import kmers, repeats
from strandloom.operators import kgraph
from strandloom.operators import local_assembly as la
from strandloom.plans import sequences


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def texts(spark, tmp_path, rows):
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def test_bases_of_a_text_are_made_once(spark, tmp_path):
    d = texts(spark, tmp_path, [(1, "a cat"), (2, None), (3, "")])
    assert [tuple(r) for r in sequences.dna(spark, d).orderBy("doc_id").collect()] == [(1, "ACAT"), (2, None), (3, "")]
    assert plan(sequences.base_entropy(spark, d)).count("regexp_replace") == 1  # in Generate, not once a base


def test_repeats_of_outcomes_are_found_beside_the_text(spark):
    assert [kmers.has_repeat(s, 3) for s in ("", "ACG", "ACGT", "ACGACG", "AAAA", "ÄÖÜÄÖÜ")] == [False, False, False, True, True, True]
    w = spark.createDataFrame([(1, "ACGTTACGTA"), (2, "acgttgca"), (3, None), (4, "NNNN")], "window_id long, ref_seq string")
    none = w.limit(0).select("window_id")
    found = la.outcomes(w, none, none.selectExpr("window_id", "1D AS window_cov"), none, 4)
    assert dict(found.collect()) == {1: "SKIPPED_REF_REPEAT_SEEN", 2: "SKIPPED_INACTIVE_REGION", 3: "SKIPPED_INACTIVE_REGION", 4: "SKIPPED_NONLY_REF_BASES"}
    assert "array_distinct" not in plan(found)


def test_words_are_counted_by_key_in_one_shuffle(spark):
    d = spark.createDataFrame([(1, "ACACA"), (1, "ACGNAC"), (2, "A"), (3, None)], "id long, s string")
    c = kmers.word_counts(d, "id", "s", 2)
    assert {tuple(r) for r in c.collect()} == {(1, 1, 4), (1, 4, 2), (1, 6, 1), (2, -1, 0), (3, -1, 0)}
    assert plan(c.groupBy("id").sum("c")).count("Exchange") == 1
    assert {r.id: r.score for r in kgraph.longdust(d, "id", "s", 2).collect()}.keys() == {1, 2, 3}


def test_runs_without_near_runs():
    s = "ACACACACAC" + "GATTGATTGACTGATT" + "TTTTT"
    every = list(repeats.tandem_repeats(s))
    assert any(r["substitutions"] for r in every)
    assert list(repeats.tandem_repeats(s, near=False)) == [r for r in every if not r["substitutions"]]
