from collections import Counter, defaultdict

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cartulary.llm import ngram_join
from tests.llm.support import documents, frame


def brute(rows):
    sets = defaultdict(set)
    for i, t, *_ in rows:
        w = (t or "").encode().lower().split()
        mine = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
        sets[i] = mine
    parent = {i: i for i in sets}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    ids = sorted(i for i in sets if i is not None)
    for x in ids:
        for y in ids:
            if x < y and sets[x] and 100 * len(sets[x] & sets[y]) >= 80 * len(sets[x] | sets[y]):
                a, b = find(x), find(y)
                parent[max(a, b)] = min(a, b)
    return Counter((i, len(sets[i]), None if i is None else find(i)) for i, *_ in rows)


def got(df):
    return Counter(map(tuple, df.select("doc_id", "n_shingles", "component_id").collect()))


def test_against_all_pairs(spark):
    rows = documents()
    assert got(ngram_join.join(frame(spark, rows))) == brute(rows)


def test_stars_of_near_copies(spark):
    """Chains: neighbours are linked, ends are not; hubs aren't linked to all members."""
    base = [f"b{i}" for i in range(60)]
    rows = []
    for k in range(25):
        text = list(base)
        for j in range(k):
            text[(7 * j) % 60] = f"z{(7 * j) % 60}"
        rows.append((100 - k, " ".join(text)))
    rows += [(200 + k, " ".join(base[:50] + [f"q{k}{j}" for j in range(10)])) for k in range(20)]
    assert got(ngram_join.join(frame(spark, rows, "doc_id long, text string"))) == brute(rows)


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(st.sampled_from("abcdefg"), max_size=14).map(" ".join), min_size=1, max_size=25))
def test_random_texts(spark, texts):
    rows = list(enumerate(texts))
    assert got(ngram_join.join(frame(spark, rows, "doc_id long, text string"))) == brute(rows)


def test_empty_table_and_clashing_columns(spark):
    assert ngram_join.join(frame(spark, [])).count() == 0
    rows = documents(30)
    df = frame(spark, rows)
    clash = df.withColumns({c: F.lit("x") for c in ("component_id", "n_shingles", "node", "batch", "fragment", "kind", "data", "gone")})
    assert got(ngram_join.join(clash)) == brute(rows)
    kept = ngram_join.keep_first(clash)
    assert kept.columns == clash.columns
    first = {i for i, _, c in brute(rows) if i is not None and i == c}
    assert {r.doc_id for r in kept.where("doc_id IS NOT NULL").collect()} == first


def test_template_family_makes_no_pairs(spark):
    """3,000 texts of one template, each pair at 0.745: no bucket holds them, so no pair of them is counted."""
    base = [f"b{i}" for i in range(86)]
    rows = [(k, " ".join([*base, *(f"q{k}x{j}" for j in range(14))])) for k in range(3000)]
    rows += [(5000 + k, text.replace("b80 ", "other ")) for k, text in rows[:2]]
    df = frame(spark, rows, "doc_id long, text string")
    grams = {k: [hash(tuple(t.split()[i : i + 5])) for i in range(96)] for k, t in rows}
    freq = Counter(g for x in grams.values() for g in x)
    sets = spark.createDataFrame([(k, str(k).encode(), 96, *[list(c) for c in zip(*sorted((freq[g], g) for g in x if freq[g] > 1), strict=True)][::-1]) for k, x in grams.items()], ngram_join.SET_SCHEMA)
    assert ngram_join.stars(sets).count() < 20
    linked = ngram_join.join(df).where("component_id < doc_id")
    assert sorted(map(tuple, linked.select("doc_id", "component_id").collect())) == [(5000, 0), (5001, 1)]


def test_components(spark):
    edges = spark.createDataFrame([(9, 8), (8, 7), (7, 1), (5, 4), (4, 5), (3, 3)], "u long, v long")
    assert {tuple(r) for r in ngram_join.components(edges).collect()} == {(9, 1), (8, 1), (7, 1), (5, 4)}


def test_missing_text_column(spark):
    with pytest.raises(Exception, match="text"):
        ngram_join.join(spark.range(2).withColumnRenamed("id", "doc_id")).count()


def test_very_long_texts(spark):
    words = [f"w{i % 70_001}x{i % 13}" for i in range(150_000)]
    near = [f"edit{i}" if i % 400 == 7 else w for i, w in enumerate(words)]
    rows = [(9001, " ".join(words), None, None, None), (9002, " ".join(near), None, None, None), (9003, "y" * 2_000_000, None, None, None), (9004, "y" * 2_000_000, None, None, None), (9005, "short", None, None, None)]
    assert got(ngram_join.join(frame(spark, rows))) == brute(rows)


def test_a_batch_that_came_in_another_order_raises():
    import pandas as pd

    def rows(texts):
        sent = ngram_join._texts_batch(1, list(range(len(texts))), texts, ngram_join._WordHashes(), 2).to_pandas()
        return sent[sent["kind"] == ngram_join.DOCS], sent[sent["kind"] == ngram_join.REQUEST]

    texts = ["a b c d e f g", "one two three four five six", "a b c d e f g"]
    mine, asked = rows(texts)
    answers = pd.concat([ngram_join._count(g) for _, g in asked.groupby("fragment")])
    assert sorted(ngram_join._collect(pd.concat([mine, answers]))["doc_id"]) == [0, 2]
    with pytest.raises(ValueError, match="another order"):
        ngram_join._collect(pd.concat([rows(texts[::-1][1:] + texts[:1])[0], answers]))
