import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as pipeline
from tests.llm.support import WORD, documents, frame
from tests.llm.test_language_id import plain_identify, short_words
from tests.llm.test_mixing import plain_targets
from tests.llm.test_ngram_join import brute
from tests.llm.test_quality_rules import verdicts


def test_stages_take_effect_and_keep_columns(spark, tmp_path):
    rows = documents(150)
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = docs.columns
    sets = [{r.doc_id for r in docs.collect()}]
    for k, (_, stage) in enumerate(pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        if k < len(pipeline.STAGES) - 1:
            assert docs.columns == columns
            sets.append({r.doc_id for r in docs.collect()})
            assert sets[-1] <= sets[-2]
    assert all(len(a) > len(b) for a, b in zip(sets[:3], sets[1:4], strict=True))
    last = docs
    again = pipeline.run(spark, str(tmp_path))
    assert Counter(map(tuple, last.collect())) == Counter(map(tuple, again.collect()))
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{tmp_path}/3").where(F.col("doc_id").isNotNull()).collect()}
    for r in last.where(F.col("doc_id").isNotNull()).collect():
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    assert [n for n, _ in pipeline.STAGES] == ["language_id", "quality_rules", "ngram_jaccard_join", "mixing", "bpe_codec"]


def test_run_equals_a_plain_chain(spark, tmp_path):
    """run() against plain versions, one after another: which documents stay, what each source gives, and every row's tokens."""
    rows = short_words(documents(150))
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    named = [r for r, (lang, score, fit) in zip(rows, plain_identify(rows), strict=True) if lang != "und" and score >= pipeline.MIN_LANGUAGE_SCORE and fit]
    good = [r for r, v in zip(named, verdicts(named, 50), strict=True) if v[-1]]
    component = {i: c for i, _, c in brute(good)}
    first = [r for r in good if r[0] is None or component[r[0]] == r[0]]
    assert len(rows) > len(named) > len(good) > len(first) > 20

    got = pipeline.run(spark, str(tmp_path)).collect()
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    digests = defaultdict(list)
    for i, t, *_ in first:
        ids = library.encode(t, add_special_tokens=False).ids
        digests[i].append((len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    rows_of = Counter(r.doc_id for r in got)
    assert set(rows_of) <= set(digests)
    for r in got:
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) in digests[r.doc_id]
    size, total = defaultdict(int), defaultdict(int)
    for i, t, _, source, _ in first:
        n = len(WORD.findall(t))
        assert rows_of[i] <= 2 * len(digests[i])
        size[source] += n
        total[source] += rows_of[i] / len(digests[i]) * n
    for source, target in plain_targets(size).items():
        assert total[source] == pytest.approx(target, rel=0.002, abs=25)
