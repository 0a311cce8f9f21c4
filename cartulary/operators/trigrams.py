"""Search by an index of trigrams: their postings name the rows that can match, and only these are compared.

A pattern's runs between wildcards must stand in a matching text, so all trigrams of all runs must. The index is a table
in buckets of trigrams; a search reads the buckets of its own trigrams and, within them, the row groups that hold these.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cartulary.operators import views

#: Characters of a gram.
GRAM = 3
#: Folders of an index, by the hash of a gram.
BUCKETS = 64


def _bucket(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(BUCKETS)).cast("int")


def grams(text: Column) -> Column:
    """The different trigrams of a text in lower case, by code points; none for null and texts of fewer characters."""
    chars = F.regexp_extract_all(F.lower(text), F.lit("(?s)."), F.lit(0))
    joined = F.transform(F.sequence(F.lit(0), F.size(chars) - GRAM), lambda i: F.concat(*[F.get(chars, i + k) for k in range(GRAM)]))
    return F.when(F.length(text) >= GRAM, F.array_distinct(joined)).otherwise(F.array().cast("array<string>"))


def write_index(df: DataFrame, key: str, columns: Sequence[str], path: str) -> None:
    """The postings (bucket, gram, field, key) of the columns, a folder a bucket, sorted by gram in each file.

    A frequent gram is dealt to several files by the hash of its rows' keys; nothing gathers a gram's rows.
    """
    # each text by itself, so that a row's columns aren't held side by side
    fields = F.explode(F.array(*[F.struct(F.lit(i).alias("field"), F.col(f"`{c}`").cast("string").alias("text")) for i, c in enumerate(columns)]))
    rows = df.select(F.col(f"`{key}`").alias("key"), fields.alias("f")).select("key", "f.field", F.explode(grams(F.col("f.text"))).alias("gram"))
    dealt = rows.withColumn("bucket", _bucket(F.col("gram"))).repartition("bucket", F.pmod(F.xxhash64("key"), F.lit(4)))
    dealt.sortWithinPartitions("bucket", "gram").write.mode("errorifexists").partitionBy("bucket").parquet(path)


def pattern_grams(spark: SparkSession, query: str) -> list[str]:
    """Trigrams that any text containing the pattern has: those of its runs between wildcards, in lower case."""
    lowered = spark.sql("SELECT lower(:q)", args={"q": query}).first()[0]
    runs, at = [""], 0
    while at < len(lowered):
        if lowered[at] == "\\" and at + 1 < len(lowered):  # an escaped wildcard is a character of its own
            at += 1
            runs[-1] += lowered[at]
        elif lowered[at] in "%_":
            runs.append("")
        else:
            runs[-1] += lowered[at]
        at += 1
    return sorted({run[i : i + GRAM] for run in runs for i in range(len(run) - GRAM + 1)})


def candidates(spark: SparkSession, path: str, query: str) -> DataFrame | None:
    """(key): rows of which one column has all trigrams of the pattern, each once; None, if the pattern has none."""
    wanted = pattern_grams(spark, query)
    if not wanted:
        return None
    buckets = [r[0] for r in spark.createDataFrame([(g,) for g in wanted], "gram string").select(_bucket(F.col("gram"))).distinct().collect()]
    found = spark.read.parquet(path).where(F.col("bucket").isin(buckets) & F.col("gram").isin(wanted))
    # a key that several rows bear has a gram several times: different ones count
    return found.groupBy("key", "field").agg(F.count_distinct("gram").alias("n")).where(F.col("n") == len(wanted)).select("key").distinct()


def search(df: DataFrame, key: str, columns: Sequence[str], path: str, query: str | None, escaped: bool = False) -> DataFrame:
    """What views.search() finds, by the index of df at path: candidates first, then the pattern itself.

    A pattern without a run of three characters is searched for in all rows, as is no pattern at all. Rows with a null
    key aren't in the index: they are compared as they are.
    """
    text = views.escaped_pattern(query) if query and escaped else query
    found = candidates(df.sparkSession, path, text) if text else None
    if found is None:
        return views.search(df, query, columns, escaped)
    # Spark broadcasts the candidates only where they are few
    known = df.join(found.withColumnRenamed("key", "__key"), F.col(f"`{key}`") == F.col("__key"), "left_semi")
    return views.search(known.unionByName(df.where(F.col(f"`{key}`").isNull())), query, columns, escaped)
