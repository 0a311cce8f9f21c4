import hashlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cartulary.llm import bpe, bpe_codec, token_counts
from cartulary.llm.queries import tokenizer_json
from tests.llm.support import documents, frame


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.no_truncation()
    t.no_padding()
    return t


def test_counts_equal_the_library(spark, library):
    rows = documents()
    out = token_counts.token_counts(frame(spark, rows).withColumns({"n_tokens": F.lit("x"), "tokens": F.lit(1)}), tokenizer_json())
    found = [(r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in out.collect()]
    want = []
    for i, t, *_ in rows:
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        want.append((i, len((t or "").encode()), n, n > 512))
    key = lambda x: (x[0] is None, x)
    assert sorted(found, key=key) == sorted(want, key=key)


def test_codec_equals_the_library(spark, library):
    rows = documents()
    df = frame(spark, rows)
    digests = bpe_codec.round_trip(df, tokenizer_json()).collect()
    real = bpe_codec.decode(bpe_codec.encode(df, tokenizer_json()), tokenizer_json()).collect()
    for r, e in zip(digests, real, strict=True):
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert (e.ids, e.decoded) == (ids, text)


def test_empty_tables(spark):
    assert token_counts.token_counts(frame(spark, []), tokenizer_json()).count() == 0
    assert bpe_codec.round_trip(frame(spark, []), tokenizer_json()).count() == 0


def test_pool_is_bounded_and_agrees_after_clearing():
    t = bpe.load(tokenizer_json())
    pool = bpe.Pool(t, keep_ids=True)
    first = pool.gather(pool.codes(["hello", " world", "aaaaaaa", "<|endoftext|>"]))
    pool.clear()
    again = pool.gather(pool.codes(["hello", " world", "aaaaaaa", "<|endoftext|>"]))
    assert first[0].tolist() == again[0].tolist() and again[0][-1] == 50256


def test_bytes_that_are_no_text():
    t = bpe.load(tokenizer_json())
    broken = t.byte_ids[[0xE6, 0xBC]]
    assert b"".join(t.token_bytes[i] for i in broken).decode("utf-8", "replace") == "�"


def test_long_pretokens_equal_the_library(library):
    import random
    import time

    t, rng = bpe.load(tokenizer_json()), random.Random(4)
    letters = "".join(rng.choice("etaoinshrdlucmfw") for _ in range(1_000_000))
    for word in (letters, "a" * 5001, "ab" * 3000 + "a", "漢字" * 900, "-=" * 700 + "é", "x" * 1024):
        began = time.perf_counter()
        ids, counts = t.merge(["hi", word, " there"])
        assert time.perf_counter() - began < 60
        assert ids.tolist() == [i for p in ("hi", word, " there") for i in library.encode(p, add_special_tokens=False).ids]
        assert counts.sum() == len(ids) and len(counts) == 3
    # either way of merging gives the same
    for word in ("".join(rng.choice("abc <>") for _ in range(3000)), letters[:4000]):
        assert t._merge_long(word.encode()).tolist() == t._merge([word.encode()])[0].tolist()


def test_unknown_settings_raise():
    import json

    spec = json.loads(tokenizer_json())
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True}}, {"model": {**spec["model"], "ignore_merges": True}}, {"added_tokens": [{"content": "<x>", "id": 1, "lstrip": True}]}):
        with pytest.raises(ValueError, match="not implemented"):
            bpe.Tokenizer({**spec, **change})
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f, pytest.raises(ValueError, match="not implemented"):
        bpe.load(f.read())
