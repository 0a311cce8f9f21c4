"""Search by trigrams against the search of all rows."""

import random

import pytest
from pyspark.sql import functions as F

from cartulary.operators import trigrams, views

SCHEMA = "id long, a string, b string"
QUERIES = ["abc", "AB", "", None, "a_c%ab", "%", "cab%_", "ñÑa", "𝄞ab", "a\\_b", "100%", "bca b", "zzz", "\\\\ab", "abcabcab"]


def rows(n):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcABC ñÑ_%\\𝄞") for _ in range(rng.randint(0, 12)))
    return [(i // 2 if i % 7 else None, rng.choice([word(), word(), None]), word()) for i in range(n)]


@pytest.fixture(scope="module")
def indexed(spark, tmp_path_factory):
    df = spark.createDataFrame(rows(400), SCHEMA).withColumn("key", F.lit(1))
    path = f"{tmp_path_factory.mktemp('grams')}/index"
    trigrams.write_index(df, "id", ["a", "b"], path)
    return df, path


@pytest.mark.parametrize("query", QUERIES)
@pytest.mark.parametrize("escaped", [False, True])
def test_equals_the_search_of_all_rows(spark, indexed, query, escaped):
    df, path = indexed
    got = trigrams.search(df, "id", ["a", "b"], path, query, escaped)
    assert sorted(map(str, got.collect())) == sorted(map(str, views.search(df, query, ["a", "b"], escaped).collect()))


def test_grams_of_texts(spark):
    got = spark.createDataFrame([("aBcab",), ("ab",), ("",), (None,), ("𝄞a𝄞",), ("a\nb",)], "t string").select(trigrams.grams(F.col("t")).alias("g")).collect()
    assert [r.g for r in got] == [["abc", "bca", "cab"], [], [], [], ["𝄞a𝄞"], ["a\nb"]]
    assert trigrams.pattern_grams(spark, "ABCD%ef_ghi\\%") == ["abc", "bcd", "ghi", "hi%"]
    long = spark.range(1).select(F.size(trigrams.grams(F.repeat(F.lit("abcde"), 200_000))).alias("n"))
    assert long.first().n == 5


def test_reads_only_its_own_postings(spark, indexed):
    _, path = indexed
    plan = trigrams.candidates(spark, path, "abc")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "EqualTo(gram,abc)" in plan
