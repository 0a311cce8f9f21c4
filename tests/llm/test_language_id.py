import zlib
from collections import Counter
from functools import cache

import numpy as np
import pytest
from pyspark.sql import functions as F

from cartulary.llm import language_id
from cartulary.llm.queries import language_pieces
from tests.llm.support import documents, frame


def piece_at(model):
    index = {p: i for i, p in enumerate(model.pieces, 1)}
    return lambda piece: index.get(piece, 0 if len(piece) == 1 else None)


def segmentations(word, at):
    """All segmentations of a word into pieces, one by one."""
    if not word:
        yield []
    for k in range(1, len(word) + 1):
        if (i := at(word[:k])) is not None:
            yield from ([i, *rest] for rest in segmentations(word[k:], at))


def log_sum(word, model):
    """log of the sum over all segmentations, place by place in logarithms."""
    at, longest = piece_at(model), max(map(len, model.pieces))
    logs = np.log(model.probs)
    out = [np.zeros(len(model.langs))]
    for j in range(1, len(word) + 1):
        now = np.full(len(model.langs), -np.inf)
        hits = [out[i] + logs[k] for i in range(max(0, j - longest), j) if (k := at(word[i:j])) is not None]
        out.append(np.logaddexp.reduce(hits, axis=0) if hits else now)
    return out[-1]


@pytest.fixture(scope="module")
def model(spark):
    return language_id.train(frame(spark, documents()), language_pieces(), rounds=2)


def test_forward_sums_all_segmentations(model):
    words = ["haus", "the", "größe", "漢字", "w1x", "ஃ", "walkingwater"]
    at = piece_at(model)
    for w, row in zip(words, model.log_probs(words), strict=True):
        form = language_id.marked(w)
        want = np.log(sum(np.prod(model.probs[s], axis=0) for s in segmentations(form, at))) if form else 0
        assert np.allclose(row[:-1], want) and row[-1] == max(len(form) - 1, 0)


def test_words_of_any_length_are_summed_whole(model):
    rng = np.random.default_rng(1)
    words = ["x" * 5000, "".join(rng.choice(list("theandwaliguß"), 5000)), "漢" * 500, "ᚠᚢᚦ" * 50, "hausbaum" * 8, "the" * 21 + "x", "".join(rng.choice(list("thelight"), 10_100))]
    for w, row in zip(words, model.log_probs(words), strict=True):
        assert np.allclose(row[:-1], log_sum(language_id.marked(w), model), rtol=1e-9) and row[-1] == len(w)


def test_probabilities_sum_to_one(model):
    assert np.allclose(model.probs.sum(0), 1) and model.langs == ["de", "en"]


def test_expected_counts_are_those_of_the_segmentations(model):
    """Each word's expected pieces cover its letters exactly once."""
    counts = np.ones((2, 2))
    used = model.expected(["haus", "walking"], counts)
    length = np.array([1, *map(len, model.pieces)])
    assert np.allclose((used * length[:, None]).sum(0), len("▁haus") + len("▁walking"))


def short_words(rows):
    """Rows whose segmentations can be listed one by one."""
    return [r for r in rows if r[1] is None or max(map(len, language_id.words_of(r[1])), default=0) < 12]


def fold(i):
    return zlib.crc32(b"" if i is None else str(i).encode()) % 5


def plain_identify(rows):
    """(lang_pred, score, in_language) of each row, by enumerating segmentations, with true counts of all words of every labelled text."""
    pieces = language_pieces()
    learned = [(t, lang) for i, t, lang, *_ in rows if fold(i) and t is not None and lang is not None]
    langs = sorted({x for _, x in learned})
    counts = {x: Counter(w for t, lang in learned if lang == x for w in language_id.words_of(t)) for x in langs}
    plain = language_id.Model(pieces, langs, np.full((1 + len(pieces), len(langs)), 1.0 / (1 + len(pieces))))
    at = piece_at(plain)
    ways = {w: list(segmentations(language_id.marked(w), at)) for c in counts.values() for w in c}
    for _ in range(3):
        total = np.zeros_like(plain.probs)
        for k, x in enumerate(langs):
            for w, n in counts[x].items():
                each = np.array([np.prod(plain.probs[s, k]) for s in ways[w]])
                for s, p in zip(ways[w], each / each.sum(), strict=True):
                    np.add.at(total[:, k], s, n * p)
        pooled = (total.sum(1, keepdims=True) + 0.01) / (total.sum() + 0.01 * len(total))
        plain.probs = (total + 50 * pooled) / (total.sum(0, keepdims=True) + 50)
    each_word = cache(lambda w: log_sum(language_id.marked(w), plain))
    logs = lambda t: sum((n * each_word(w) for w, n in Counter(language_id.words_of(t)).items()), np.zeros(len(langs)))
    letters = lambda t: sum(len(language_id.marked(w)) - 1 for w in language_id.words_of(t))
    floor = [1.5 * min(logs(t)[k] / letters(t) for t, lang in learned if lang == x and letters(t)) for k, x in enumerate(langs)]
    out = []
    for _, t, *_ in rows:
        if not any(c.isalpha() for c in t or ""):
            out.append(("und", 0.0, False))
            continue
        each = logs(t)
        top = int(each.argmax())
        out.append((langs[top], 1 / np.exp(each - each.max()).sum(), bool(each.max() >= floor[top] * letters(t))))
    return out


def test_identify_equals_a_brute_force_version(spark):
    rows = short_words(documents(60))
    found = {(r.doc_id, r.text): r for r in language_id.identify(frame(spark, rows), language_pieces()).collect()}
    for (i, t, *_), (lang, score, fit) in zip(rows, plain_identify(rows), strict=True):
        r = found[i, t]
        assert r.held_out == (fold(i) == 0)
        assert (r.lang_pred, r.in_language) == (lang, fit) and r.score == pytest.approx(score, rel=1e-6)


def test_held_out_accuracy_and_odd_texts(spark):
    rows = documents(300, seed=9)
    out = {r.doc_id: r for r in language_id.identify(frame(spark, rows).withColumns({"lang_pred": F.lit(1), "best": F.lit(2)}), language_pieces()).collect()}
    held = [(i, t, lang) for i, t, lang, *_ in rows if i is not None and lang and i < 300 and i % 3 == 0 and zlib.crc32(str(i).encode()) % 5 == 0 and len((t or "").split()) > 5]
    assert len(held) > 10 and np.mean([out[i].lang_pred == lang for i, _, lang in held]) > 0.85
    for i, t, *_ in rows:
        r = out[i]
        assert 0 <= r.score <= 1 and r.held_out == (zlib.crc32(b"" if i is None else str(i).encode()) % 5 == 0)
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in t or ""))


def test_sample_is_bounded(spark):
    few = language_id.train(frame(spark, documents()), language_pieces(), sample_docs=3, rounds=1)
    assert few.langs == ["de", "en"]


def test_without_labels_or_rows(spark):
    none = frame(spark, [(1, "text here", None, None, None)])
    assert [(r.lang_pred, r.score) for r in language_id.identify(none, language_pieces()).collect()] == [("und", 0.0)]
    assert language_id.identify(frame(spark, []), language_pieces()).count() == 0


def test_too_many_languages_raise(spark):
    with pytest.raises(ValueError, match="languages"):
        language_id.train(frame(spark, documents()), language_pieces(), max_langs=1)


def test_other_scripts_are_no_language(spark):
    rows = [*documents(150), (5000, "ᚠᚢᚦᚨ ᚱᚲᚷᚹ ᚺᚾᛁᛃ " * 20, None, "s1", None), (5001, "the house and the tree " * 9, None, "s1", None)]
    out = {r.doc_id: r for r in language_id.identify(frame(spark, rows), language_pieces()).collect()}
    assert not out[5000].in_language and out[5001].in_language
