import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cartulary.llm import katz_lm
from tests.llm.support import documents, frame

END = "</s>\x20"


def tokens(text):
    return [w.decode() for w in (text or "").encode().lower().split()] + [END]


class Plain:
    """The model by its formulas, in plain dictionaries."""

    def __init__(self, texts):
        self.uni, self.bi = Counter(), Counter()
        for t in texts:
            before = "<s>\x20"
            for w in tokens(t):
                self.uni[w] += 1
                self.bi[before, w] += 1
                before = w
        self.n, self.types = sum(self.uni.values()), len(self.uni)
        of = lambda c: np.array([sum(v == r for v in c.values()) for r in range(1, katz_lm.K + 2)])
        self.du, self.db = katz_lm.discounts(of(self.uni)), katz_lm.discounts(of(self.bi), 2)
        mass = sum(self.part(c, self.du) for c in self.uni.values())
        self.total = self.n + (1 if self.n - mass <= 0 else 0)
        self.unknown = (self.total - mass) / self.total
        self.after = defaultdict(dict)
        for (v, w), c in self.bi.items():
            if c >= 2:
                self.after[v][w] = c

    @staticmethod
    def part(c, d):
        return d[c] * c if c <= katz_lm.K else c

    def p1(self, w):
        return self.part(self.uni[w], self.du) / self.total if w in self.uni else self.unknown

    def p(self, v, w):
        count = self.uni[END] if v == "<s>\x20" else self.uni[v]
        seen = self.after.get(v, {})
        mass = sum(self.part(c, self.db) for c in seen.values())
        base = count + (1 if count - mass < 1e-9 else 0)
        if w in seen:
            return self.part(seen[w], self.db) / base
        alpha = (1 - mass / base) / (1 - sum(map(self.p1, seen))) if seen else 1.0
        return alpha * self.p1(w)

    def log10(self, text):
        total, before = 0.0, "<s>\x20"
        for w in tokens(text):
            total += math.log10(self.p(before, w))
            before = w
        return total


def test_against_the_formulas(spark):
    rows = documents(150)
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 10 == 0
    model = Plain([t for i, t, *_ in rows if not held(i)])
    out = katz_lm.score(min_count=2, docs=frame(spark, rows).withColumns({"training": F.lit("x"), "kind": F.lit(1), "data": F.lit(2)})).collect()
    assert len(out) == len(rows)
    by = defaultdict(list)
    for r in out:
        by[r.doc_id].append(r)
    for i, t, *_ in rows:
        r = by[i][0]
        ws = tokens(t)
        plain = sum(math.log10((model.uni[w] + 0.1) / (model.n + 0.1 * (model.types + 1))) for w in ws)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(i), len(ws), sum(w in model.uni for w in ws), model.n)
        assert r.base_score == pytest.approx(plain, rel=1e-9) and r.score == pytest.approx(model.log10(t), rel=1e-9)
    for v in ["the", "haus", "<s>\x20", "neverseen", *list(model.uni)[:20]]:
        assert sum(model.p(v, w) for w in model.uni) + model.p(v, "unknown word") == pytest.approx(1, abs=1e-9)
    apart = [r for r in out if r.held_out]
    assert sum(r.score for r in apart) > sum(r.base_score for r in apart)


def test_query_uses_pairs_seen_once(spark, tmp_path):
    """op8 keeps every pair: one seen once has its discounted count, not the backoff."""
    from cartulary.llm import queries

    rows = documents(150)
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    uni, bi = Counter(), Counter()
    for i, t, *_ in rows:
        if zlib.crc32(b"" if i is None else str(i).encode()) % 10:
            ws = tokens(t)
            uni.update(ws)
            bi.update(zip(["<s>\x20", *ws], ws))
    of = lambda c: np.array([sum(v == r for v in c.values()) for r in range(1, katz_lm.K + 2)])
    du, db = katz_lm.discounts(of(uni)), katz_lm.discounts(of(bi), 1)
    n = sum(uni.values())
    assert min(bi.values()) == 1 and db[1] > 0
    mass = sum(Plain.part(c, du) for c in uni.values())
    total = n + (1 if n - mass <= 0 else 0)
    p1 = lambda w: Plain.part(uni[w], du) / total if w in uni else (total - mass) / total
    after = defaultdict(dict)
    for (v, w), c in bi.items():
        after[v][w] = c

    def p(v, w):
        seen = after.get(v, {})
        count = uni[END] if v == "<s>\x20" else uni[v]
        kept = sum(Plain.part(c, db) for c in seen.values())
        base = count + (1 if count - kept < 1e-9 else 0)
        if w in seen:
            return Plain.part(seen[w], db) / base
        return ((1 - kept / base) / (1 - sum(map(p1, seen))) if seen else 1.0) * p1(w)

    known = {}
    for r in queries.op8_lm_katz(spark, str(tmp_path)).collect():
        known.setdefault(r.doc_id, r.score)
    for i, t, *_ in rows:
        ws = tokens(t)
        assert known[i] == pytest.approx(sum(math.log10(p(v, w)) for v, w in zip(["<s>\x20", *ws], ws)), rel=1e-9)


def test_without_training_rows_or_any(spark):
    assert katz_lm.score(frame(spark, [])).count() == 0
    only = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    r = katz_lm.score(frame(spark, [(only, "a b", None, None, None)])).first()
    assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) == (True, 3, 0, 0, 0.0, 0.0)


def test_discounts_are_good_turing():
    """Against Katz's formula by whole fractions, from the counts themselves."""
    from fractions import Fraction

    counts = Counter({f"w{c}.{i}": c for c, n in enumerate((5000, 1800, 850, 500, 330, 240, 100), 1) for i in range(n)})
    n = {r: sum(1 for c in counts.values() if c == r) for r in range(1, 7)}
    d = katz_lm.discounts(np.array([n[r] for r in range(1, 7)]))
    k = 5
    for r in range(1, k + 1):
        adjusted = Fraction((r + 1) * n[r + 1], n[r])
        common = Fraction((k + 1) * n[k + 1], n[1])
        assert d[r] == pytest.approx(float((adjusted / r - common) / (1 - common)), rel=1e-12) and 0 < d[r] < 1
    # what is taken from counts up to k is what Good and Turing give to unseen events: n1
    assert sum(n[r] * r * (1 - d[r]) for r in range(1, k + 1)) == pytest.approx(n[1], rel=1e-9)
    # without counts of 1 to 6 half an occurrence goes
    assert katz_lm.discounts(np.array([3, 0, 2, 0, 0, 0])).tolist() == [0, 0.5, 0.75, 2.5 / 3, 3.5 / 4, 4.5 / 5]


def test_discounts():
    d = katz_lm.discounts(np.array([1000, 400, 200, 120, 80, 60]))
    assert d[0] == 0 and all(0 < x < 1 for x in d[1:])
    assert katz_lm.discounts(np.zeros(6, dtype=int), 2)[1] == 0
