import random
from collections import defaultdict

from pyspark.sql import functions as F

from cartulary.llm import chat_format

SCHEMA = "conv_id long, turn long, role string, text string"


def plain(rows):
    by = defaultdict(set)
    for c, *rest in rows:
        if c is not None:
            by[c].add(tuple(rest))
    low = lambda x: (x is not None, x if x is not None else 0)
    seq = {c: [t[1:] for t in sorted(ts, key=lambda t: (low(t[0]), (t[1] is not None, t[1] or ""), (t[2] is not None, t[2] or "")))] for c, ts in by.items()}
    out = {}
    for c, s in seq.items():
        longer = any(len(o) > len(s) and o[: len(s)] == s for o in seq.values())
        twin = any(o == s and d < c for d, o in seq.items())
        if not longer and not twin:
            out[c] = (len(s), "".join(f"<|{r or ''}|>\n{t or ''}\n" for r, t in s))
    return out


def got(df):
    return {r.conv_id: (r.n_turns, r.text) for r in chat_format.format_chats(df).collect()}


def test_snapshots_collapse(spark):
    rng = random.Random(5)
    rows = []
    for c in range(60):
        full = [("user" if k % 2 == 0 else "assistant", f"t{rng.randrange(2)}") for k in range(rng.randint(1, 7))]
        rows += [(c, k, r, t) for k, (r, t) in enumerate(full)]
    rows += [(100, k * 3 - 400, "user", f"long {k}") for k in range(700)]
    rows += [(101, k * 3 - 400, "user", f"long {k}") for k in range(699)]
    rows += [(102, 0, None, None), (103, 0, "", ""), (None, 0, "user", "x"), (104, None, "user", "a"), (104, 0, "user", "b"), rows[0], (105, 1, "b", "2"), (105, 1, "a", "1"), (106, 1, "b", "2"), (106, 1, "a", "1"), (106, 2, "a", "3")]
    # ties of number and role go by text, nulls first; a null text is no text of one null character
    rows += [(107, 0, "user", "gamma"), (107, 0, "user", "delta"), (108, 0, "user", "delta"), (108, 1, "user", "gamma"), (109, None, "user", "z"), (109, None, "user", "a"), (109, 0, "user", None), (109, 0, "user", "\u0000"), (109, 0, "user", "")]
    rows += [(110, 0, None, "a\t"), (110, 0, None, "a"), (110, 0, "\u0000", "a"), (111, 5, "user", "n" * 1_200_000)] + [(112, 7, "user", f"same number {k}") for k in range(600)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"block": F.lit(1), "place": F.lit(2), "k": F.lit(3)})
    assert got(df) == plain(rows)


def test_agrees_with_its_sql(spark):
    import duckdb
    import pandas as pd

    from cartulary.llm.queries import OP2

    rows = [(3, None, "user", "x"), (3, 0, "user", "y"), (4, 0, "user", "gamma"), (4, 0, "user", "delta"), (5, 0, "user", "gamma"), (6, 0, None, "b"), (6, 0, "a", None), (6, 0, "a", "")]
    con = duckdb.connect()
    con.register("conversations", pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]).astype({"turn": "Int64"}))
    want = {r[0]: (r[1], r[2]) for r in con.execute(OP2).fetchall()}
    assert got(spark.createDataFrame(rows, SCHEMA)) == want


def test_empty_table(spark):
    assert got(spark.createDataFrame([], SCHEMA)) == {}


def test_native(spark):
    plan = chat_format.format_chats(spark.createDataFrame([(1, 0, "user", "x")], SCHEMA))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
