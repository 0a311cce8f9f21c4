from collections import defaultdict

from pyspark.sql import functions as F

from cartulary.llm import quality_rules
from tests.llm.support import WORD, documents, frame


def base(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = defaultdict(list)
    for k in range(len(words) - 7):
        windows[tuple(words[k : k + 8])].append(k)
    covered = {p + q for v in windows.values() if len(v) > 1 for p in v for q in range(8)}
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed


def normal(text):
    return [x for x in (" ".join(WORD.findall(line)) for line in (text or "").lower().split("\n")) if x]


def verdicts(rows, max_docs, min_words=20, min_share=0.3):
    held = defaultdict(set)
    for i, t, lang, s, _ in rows:
        for line in normal(t):
            held[s, line].add(i if i is not None else (t, lang))
    out = []
    for i, t, _, s, _ in rows:
        gone = 0
        for line in normal(t):
            docs = held[s, line]
            if len(docs) > max_docs and i != min((d for d in docs if isinstance(d, int)), default=None) or len(docs) > max_docs and i is None:
                gone += len(line.split(" "))
        n, *_, failed = base(t)
        depleted = gone > 0 and (n - gone < min_words or n - gone < min_share * n)
        out.append((i, *base(t)[:5], failed, gone, not failed and not depleted))
    return out


def test_against_plain_rules(spark):
    rows = documents()
    shared = "This passage stands in many documents of one host and says nothing at all"
    other = "and another one that every page of the host repeats below the first"
    for k in range(12):
        own = " ".join(f"own{k}x{j}" for j in range(25 if k % 2 else 4))
        rows.append((2000 + k, f"{shared}\n{shared.upper()} {other}\n{own}\n# done <b> 100%", "en", "s1", None))
    df = frame(spark, rows).withColumns({c: F.lit("x") for c in ("rh", "line", "n", "counted", "kept")})
    out = quality_rules.judge(df, max_docs=5)
    found = [tuple(r) for r in out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "removed_words", "kept").collect()]
    want = verdicts(rows, 5)
    key = lambda x: (x[0] is None, x)
    assert sorted(found, key=key) == sorted(want, key=key)
    assert any(v[7] and not v[8] and not v[6] for v in want) and any(v[7] and v[8] for v in want)
    kept = quality_rules.keep(df, max_docs=5)
    assert kept.columns == df.columns
    assert sorted((r.doc_id is None, r.doc_id) for r in kept.collect()) == sorted((v[0] is None, v[0]) for v in want if v[8])


def test_documents_without_ids_count(spark):
    shared = "a line that five pages of the host hold and nobody else"
    rows = [(None, f"{shared}\nown words {k} " * 3, "en", "s1", None) for k in range(5)] + [(None, f"{shared}\nown words 0 " * 3, "en", "s1", None)]
    for extra in ([], [(7, f"{shared}\n" + "own text here " * 9, "en", "s1", None)]):
        some = rows + extra
        found = [tuple(r) for r in quality_rules.judge(frame(spark, some), max_docs=4).select("doc_id", "removed_words", "kept").collect()]
        want = [(v[0], v[7], v[8]) for v in verdicts(some, 4)]
        assert sorted(found, key=str) == sorted(want, key=str) and any(n for _, n, _ in found)


def test_one_text_of_many_lines(spark):
    """100,000 lines, half of them repeated: their words are added up by line, in linear time."""
    text = "\n".join(f"line number {k % 50_000} of this text" for k in range(100_000))
    lines = quality_rules.host_lines(frame(spark, [(1, text, None, "s", None)]))
    assert [tuple(r) for r in lines.groupBy("n").count().collect()] == [(12, 50_000)]


def test_empty_table(spark):
    assert quality_rules.judge(frame(spark, [])).count() == 0
    assert quality_rules.keep(frame(spark, [])).count() == 0


def test_native(spark):
    plan = quality_rules.judge(frame(spark, documents(10)))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
