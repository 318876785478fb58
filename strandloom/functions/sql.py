"""The library's functions for Spark SQL: SQL functions that the optimizer sees through, and table functions in Python."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from strandloom.functions import kmers, repeats

#: Name, arguments, result and body of each SQL function.
FUNCTIONS = (
    ("reverse_complement", "s STRING", "STRING", "reverse(translate(regexp_replace(s, '[^ACGTNacgtn]', 'N'), 'ACGTacgt', 'TGCAtgca'))"),
    ("canonical_sequence", "s STRING", "STRING", "least(s, reverse_complement(s))"),
    ("count_base", "s STRING, b STRING", "INT", "length(s) - length(replace(s, b, ''))"),
    ("gc_content", "s STRING", "DOUBLE", "try_divide(count_base(s, 'G') + count_base(s, 'C'), length(s))"),
    ("hamming_distance", "a STRING, b STRING", "INT", "CASE WHEN length(a) = length(b) THEN aggregate(zip_with(split(a, ''), split(b, ''), (x, y) -> CASE WHEN x = y THEN 0 ELSE 1 END), 0, (t, x) -> t + x) END"),
    ("soft_clipped_bases", "cigar STRING", "INT", "aggregate(transform(regexp_extract_all(cigar, '([0-9]+)S', 1), x -> CAST(x AS INT)), 0, (t, x) -> t + x)"),
    ("md_matches", "md STRING", "INT", "aggregate(transform(regexp_extract_all(md, '([0-9]+)', 1), x -> CAST(x AS INT)), 0, (t, x) -> t + x)"),
    ("phred_to_error", "q DOUBLE", "DOUBLE", "power(10, -q / 10)"),
)


class TandemRepeats:
    """motif, start, length, substitutions of the repeats of a sequence, with near runs unless near is false; none of null."""

    def eval(self, s: str, near: bool = True) -> Iterator[tuple]:
        for r in repeats.tandem_repeats(s, near) if s else ():
            yield r["motif"], r["start"], r["length"], r["substitutions"]


class Kmers:
    """place, kmer, back of the windows of k bases (31 at most): the numbers of the window and of its reverse complement."""

    def eval(self, s: str, k: int) -> Iterator[tuple]:
        forwards, backwards = kmers.text_codes(s or "", k)
        yield from enumerate_pairs(forwards.tolist(), backwards.tolist())


def enumerate_pairs(a: list[int], b: list[int]) -> Iterator[tuple]:
    return ((i, x, y) for i, (x, y) in enumerate(zip(a, b)))


TABLES = (
    ("tandem_repeats", TandemRepeats, "motif: string, start: int, length: int, substitutions: int"),
    ("kmers_of", Kmers, "place: int, kmer: long, back: long"),
)


def register(spark: SparkSession) -> None:
    """Make all functions known to a session's SQL."""
    for name, arguments, result, body in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {result} RETURN {body}")
    for name, table, schema in TABLES:
        spark.udtf.register(name, F.udtf(table, returnType=schema, useArrow=True))
    spark.udf.register("repeat_list", repeats.repeats_udf())
