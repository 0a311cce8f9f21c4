import random

from pyspark.sql import functions as F

from cartulary.llm import warc_revisits

SCHEMA = "record_id string, url string, captured long, kind string, status int, etag string, last_modified string, payload_digest string, headers map<string,string>"


def plain(rows, keys):
    out = []
    for rid, url, at, kind, _, etag, modified, _, headers in rows:
        if kind != "revisit":
            continue
        best = max(
            (x for x in rows if x[3] == "response" and x[4] == 200 and keys.get(x[1]) and x[2] is not None and at is not None and keys.get(x[1]) == keys.get(url) and x[2] < at),
            key=lambda x: (x[2], x[0]),
            default=None,
        )
        weak = lambda e: None if e is None else e.removeprefix("W/")
        if best is None:
            verdict = "no_response"
        elif etag is not None:
            verdict = "resolved" if weak(etag) == weak(best[5]) else "validator_mismatch"
        elif modified is not None:
            verdict = "resolved" if modified == best[6] else "validator_mismatch"
        else:
            verdict = "unvalidated"
        ok = verdict == "resolved"
        merged = dict(best[8] or {}) | {k: v for k, v in (headers or {}).items() if k in warc_revisits.PERMITTED} if ok else None
        out.append((rid, verdict, best[0] if ok else None, best[7] if ok else None, merged))
    return sorted(out, key=str)


def test_against_every_earlier_response(spark):
    rng = random.Random(2)
    urls = ["http://A.example/x#f", "https://a.example/x?utm_source=q", "https://www.a.example:443/x", "https://a.example/x?b=2&a=1", "https://a.example/x?a=1&b=2&ref=z", "http://b.example", None]
    rows = []
    for k in range(300):
        kind = rng.choice(["response", "revisit"])
        e = rng.choice([None, '"1"', '"2"', 'W/"1"'])
        rows.append((f"r{k:03d}", rng.choice(urls), rng.choice([None, *range(40)]), kind, rng.choice([200, 200, 404]) if kind == "response" else 304, e, rng.choice([None, "d1", "d2"]), f"p{k}", {"etag": e or "-", "x-own": kind, "date": str(k), "content-length": str(k)} if k % 7 else None))
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"key": F.lit("x"), "found": F.lit("y"), "part": F.lit(1), "entries": F.lit(2)})
    pairs = spark.createDataFrame([(u,) for u in urls if u], "url string").select("url", warc_revisits.canonical(F.col("url"))).collect()
    keys = {r[0]: r[1] for r in pairs}
    assert keys[urls[0]] == keys[urls[1]] == keys[urls[2]] == "a.example/x" and keys[urls[3]] == keys[urls[4]] == "a.example/x?a=1&b=2" and keys[urls[5]] == "b.example/"
    found = [(r.record_id, r.verdict, r.refers_to, r.payload_digest, r.headers) for r in warc_revisits.resolve(df).collect()]
    assert sorted(found, key=str) == plain(rows, keys)
    full = warc_revisits.completed(warc_revisits.resolve(df), spark.createDataFrame([(r[0], "BODY") for r in rows], "record_id string, payload string"))
    assert full.count() == sum(r[1] == "resolved" for r in found) and all("BODY" in r.warc and r.warc.startswith("WARC/1.1") for r in full.collect())


def test_empty_table(spark):
    assert warc_revisits.resolve(spark.createDataFrame([], SCHEMA)).count() == 0
