"""Line dedup against a plain version, its plan, and awkward documents."""

import hashlib
from collections import defaultdict

from pyspark.sql import functions as F

from cartulary.llm import line_dedup
from tests.llm.support import documents, frame

SPACE = " \t\n\x0b\f\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def key(line):
    return line.strip(SPACE).translate(LOWER)


def plain(rows, min_docs, min_chars=1):
    holders = defaultdict(set)
    for r in rows:
        who = r[0] if r[0] is not None else ("content", *r[1:4])
        for line in (r[1] or "").split("\n"):
            if len(key(line)) >= min_chars:
                holders[key(line)].add(who)
    out = []
    for r in rows:
        lines = (r[1] or "").split("\n")
        kept = [x for x in lines if len(key(x)) < min_chars or len(holders[key(x)]) < min_docs]
        out.append((r[0], len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


def result(df):
    rows = df.select("doc_id", "n_lines", "n_dropped", "text").collect()
    return sorted(((r[0], r[1], r[2], hashlib.sha256(r[3].encode()).hexdigest()) for r in rows), key=repr)


def awkward():
    rows = documents()
    shared = ["Read More", "  read more\t", "READ MORE\r", "ÉCOLE", "école", "ﬁn", "", "\x85", " "]
    for i in range(40):
        rows.append((5000 + i, "\n".join([f"own line {i}", shared[i % 9], "", shared[(i + 4) % 9], "hot", f"tail {i % 11}"]), "en", "s", 1))
    rows += [(6000, "hot\nhot\nHOT ", None, None, None), (6001, "\n\n\n", None, None, None), (6002, "hot", "en", "s", 1), (6002, "hot\nagain", "en", "s", 1)]
    rows += [(None, "hot\nnone", "en", "s", 1)] * 3 + [(None, "tail 3", "de", "s", 1)]
    rows.append((6003, "\n".join(["hot", "x"] * 20_000 + [f"line {i}" for i in range(60_000)]), "en", "s", 1))
    rows.append((6004, "hot\n" + "y" * 3_000_000 + "\nhot", "en", "s", 1))
    return rows


def test_drops_frequent_lines(spark):
    rows = awkward()
    docs = frame(spark, rows)
    for min_docs, min_chars in ((10, 1), (2, 1), (3, 5)):
        assert result(line_dedup.drop_lines(docs, min_docs, min_chars)) == plain(rows, min_docs, min_chars)


def test_bitmaps_give_the_same_lines(spark):
    rows = awkward()
    docs = frame(spark, rows).where("doc_id is not null and doc_id <> 6002")
    want = {r[0]: r[1:] for r in result(line_dedup.drop_lines(docs, 4))}
    texts = {r[0]: r[1] or "" for r in rows}
    got = line_dedup.keep_bitmaps(docs, 4).collect()
    assert len(got) == docs.count()
    for r in got:
        lines, edges = texts[r.doc_id].split("\n"), [0, *r.flips, r.n_lines]
        kept = [x for s, e in zip(edges[::2], edges[1::2], strict=True) for x in lines[s:e]]
        assert (r.n_lines, r.n_dropped, hashlib.sha256("\n".join(kept).encode()).hexdigest()) == want[r.doc_id]
        assert list(r.flips) == sorted(set(r.flips))
    # one run of drops is two numbers, whatever its length
    run = frame(spark, [(i, "\n".join(["own%d" % i, *["same"] * 5000]), None, None, None) for i in range(4)])
    assert {tuple(r.flips) for r in line_dedup.keep_bitmaps(run, 3).collect()} == {(1, 5001)}


def test_first_occurrences_stream_from_the_ranges(spark):
    places = line_dedup.line_places(frame(spark, documents()))
    plan = line_dedup.first_occurrences(places)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "rangepartitioning" in plan
    # a line of half of all rows fills several ranges
    hot = frame(spark, [(i, "same" if i % 2 else f"own {i}", None, None, None) for i in range(4000)])
    ranged = line_dedup.line_places(hot).repartitionByRange(8, "line", "doc_id", "content")
    sizes = [r[0] for r in ranged.groupBy(F.spark_partition_id()).count().select("count").collect()]
    assert max(sizes) < 1000


def test_empty_and_clashing(spark):
    assert line_dedup.drop_lines(frame(spark, [])).collect() == []
    assert line_dedup.keep_bitmaps(frame(spark, [])).collect() == []
    docs = frame(spark, [(i, "a\nb", "en", "s", 1) for i in range(3)]).selectExpr("*", "7 AS n_dropped", "8 AS rh", "9 AS `of.doc`", "1 AS lost_at", "2 AS content")
    out = line_dedup.drop_lines(docs, 3)
    assert out.columns == [*[c for c in docs.columns if c != "n_dropped"], "n_lines", "n_dropped"]
    assert {(r.text, r.n_lines, r.n_dropped, r.rh, r["of.doc"], r.lost_at) for r in out.collect()} == {("", 2, 2, 8, 9, 1)}
    named = docs.selectExpr("text AS body", "doc_id AS key", "lang")
    assert {r.body for r in line_dedup.drop_lines(named, 4, text="body", doc_id="key").collect()} == {"a\nb"}
