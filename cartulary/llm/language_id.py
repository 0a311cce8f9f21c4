"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. The probability of a word of any
length is the sum over all its segmentations into pieces, by the forward algorithm with rescaled mass; that of a
text, the product over its words. The probabilities are learned by expectation-maximisation over all segmentations.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from cartulary.llm.common import crc_mod, free_memory, fresh, materialize, small_or_shuffled, without

#: Marks a word's start in the vocabulary.
START = "▁"
#: Places between two rescalings of the forward mass; the least piece probability to twice this power is a double.
STRIDE = 8
#: Words up to this long are scored many at a time, longer ones one by one with a rolling window.
TOGETHER = 64
#: Places of words that are scored together at most, so that a task's memory is bounded.
CHUNK = 200_000
LETTERS = re.compile(r"[^\W\d_]+")
UNDETERMINED = "und"


def pieces_of(model_file: str) -> list[str]:
    """The letter pieces of a sentencepiece vocabulary, lower-cased, each once, in the file's order."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
    out: dict[str, None] = {}
    for i in range(sp.get_piece_size()):
        piece = sp.id_to_piece(i).lower()
        body = piece.removeprefix(START)
        if (body.isalpha() or piece == START) and not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)):
            out[piece] = None
    return list(out)


def words_of(text: str) -> list[str]:
    return LETTERS.findall(text.lower())


def marked(word: str) -> str:
    """What a word is scored as: its letters after a start mark; empty without letters."""
    letters = "".join(c for c in word if c.isalpha())
    return START + letters if letters else ""


def _codes(words: list[str]) -> np.ndarray:
    """Code points of words of one length: (word, place)."""
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype="<u4").reshape(len(words), -1).astype(np.uint64)


def _longer(h: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """The hashes of spans that go on by one letter."""
    with np.errstate(over="ignore"):
        h = (h + codes + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        return h ^ (h >> np.uint64(29))


@dataclass
class Model:
    """Piece probabilities by language; row 0 is for a letter that no piece covers.

    floors: by language, the least log-probability a letter that a text of it may have to count as that language.
    """

    pieces: list[str]
    langs: list[str]
    probs: np.ndarray  # (1 + pieces, langs)
    floors: np.ndarray | None = None
    tables: dict[int, tuple[np.ndarray, np.ndarray]] = field(init=False)

    def __post_init__(self):
        by_length: dict[int, list[tuple[int, str]]] = defaultdict(list)
        for i, p in enumerate(self.pieces, 1):
            by_length[len(p)].append((i, p))
        self.tables = {}
        for n, found in by_length.items():
            codes = _codes([p for _, p in found])
            h = np.zeros(len(found), dtype=np.uint64)
            for k in range(n):
                h = _longer(h, codes[:, k])
            order = np.argsort(h)
            if len(np.unique(h)) < len(h):
                raise ValueError("two pieces share a hash")
            self.tables[n] = h[order], np.array([i for i, _ in found])[order]

    def spans(self, words: list[str]) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
        """(start, end, words, pieces) of all spans that a piece covers, in words of one length, by end.

        All spans of one length are looked up at once, by hashes that grow letter by letter.
        """
        codes = _codes(words)
        n, h, out = codes.shape[1], np.zeros(codes.shape, dtype=np.uint64), []
        for size in range(1, min(n, max(self.tables, default=1)) + 1):
            h = _longer(h[:, : n - size + 1], codes[:, size - 1 :])
            keys, ids = self.tables.get(size, (np.empty(0, np.uint64), np.empty(0, np.int64)))
            if len(keys):
                at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                piece = np.where(keys[at] == h, ids[at], -1)
            else:
                piece = np.full(h.shape, -1)
            if size == 1:
                piece = np.maximum(piece, 0)
            columns = piece.T
            for i in np.flatnonzero((columns >= 0).any(axis=1)):
                rows = np.flatnonzero(columns[i] >= 0)
                out.append((int(i), int(i) + size, rows, columns[i][rows]))
        return sorted(out, key=lambda x: x[1])

    def sweep(self, spans: list, n: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
        """Mass of all segmentations up to each place, (place, word, language), and the logarithm of its scale."""
        mass, level = np.zeros((2, n + 1, rows, len(self.langs)))
        mass[0], block, k = 1, 0, 0
        for j in range(1, n + 1):
            level[j] = level[j - 1]
            while k < len(spans) and spans[k][1] == j:
                i, _, row, piece = spans[k]
                add = mass[i][row] * self.probs[piece]
                mass[j][row] += add * np.exp(level[i][row] - level[j][row]) if i < block else add
                k += 1
            if j % STRIDE == 0 and j < n:
                level[j] += np.log(mass[j])
                mass[j], block = 1, j
        return mass, level

    def groups(self, words: list[str]) -> Iterator[tuple[np.ndarray, list[str]]]:
        """Places and marked forms of words of one length, as many at once as memory allows."""
        by_length: dict[int, list[int]] = defaultdict(list)
        forms = [marked(w) for w in words]
        for k, f in enumerate(forms):
            if f:
                by_length[len(f)].append(k)
        for n, places in by_length.items():
            step = max(1, CHUNK // n)
            for s in range(0, len(places), step):
                yield np.array(places[s : s + step]), [forms[k] for k in places[s : s + step]]

    def long_word(self, word: str) -> np.ndarray:
        """log P of one marked word, with a window of the last places only; the word is searched in pieces."""
        reach, langs = max(self.tables, default=1), range(len(self.langs))
        window, total, size = [[1.0] * len(self.langs)], [0.0] * len(self.langs), 10_000
        probs = self.probs.tolist()
        for s in range(0, len(word), size):
            first = max(0, s - reach + 1)
            ends: dict[int, list[tuple[int, int]]] = defaultdict(list)
            for i, j, _, piece in self.spans([word[first : s + size]]):
                if first + j > s:
                    ends[first + j].append((j - i, int(piece[0])))
            for j in range(s + 1, min(len(word), s + size) + 1):
                now = [0.0] * len(self.langs)
                for back, piece in ends[j]:
                    before, p = window[-back], probs[piece]
                    for k in langs:
                        now[k] += before[k] * p[k]
                window.append(now)
                if j % STRIDE == 0:
                    window = [[w[k] / now[k] for k in langs] for w in window[-reach:]]
                    total = [t + math.log(x) for t, x in zip(total, now, strict=True)]
        return np.array(total) + np.log(window[-1])

    def log_probs(self, words: list[str]) -> np.ndarray:
        """log P(word) for each word and language; the last column is the number of its letters."""
        out = np.zeros((len(words), len(self.langs) + 1))
        for places, forms in self.groups(words):
            n = len(forms[0])
            if n > TOGETHER:
                out[places, :-1] = [self.long_word(f) for f in forms]
            else:
                mass, level = self.sweep(self.spans(forms), n, len(forms))
                out[places, :-1] = np.log(mass[n]) + level[n]
            out[places, -1] = n - 1
        return out

    def expected(self, words: list[str], counts: np.ndarray) -> np.ndarray:
        """Expected uses of each piece in words, which each language counts so often: (1 + pieces, langs)."""
        out = np.zeros_like(self.probs)
        for places, forms in self.groups(words):
            n = len(forms[0])
            spans = self.spans(forms)
            ahead, up = self.sweep(spans, n, len(forms))
            # the mass after each place is that of the reversed words
            back, down = (x[::-1] for x in self.sweep(sorted(((n - j, n - i, r, p) for i, j, r, p in spans), key=lambda x: x[1]), n, len(forms)))
            for i, j, row, piece in spans:
                scale = np.exp(up[i][row] + down[j][row] - up[n][row])
                np.add.at(out, piece, counts[places][row] * ahead[i][row] * self.probs[piece] * back[j][row] * scale / ahead[n][row])
        return out


def _text_scores(texts: pd.Series, m: Model, index: dict[str, int], table: np.ndarray) -> tuple[np.ndarray, dict[str, int], np.ndarray]:
    """Sums of log_probs() over the words of each text; index and table hold what earlier texts' words had."""
    width = len(m.langs) + 1
    rows: list[np.ndarray] = []
    todo = list(texts)[::-1]
    while todo:
        found, sizes = [], []
        while todo and len(found) < 200_000:
            sizes.append(len(ws := words_of(todo.pop() or "")))
            found += ws
        new = [w for w in dict.fromkeys(found) if w not in index]
        if new:
            index.update(zip(new, range(len(index), len(index) + len(new)), strict=True))
            table = np.vstack([table, m.log_probs(new)])
        codes = np.fromiter(map(index.__getitem__, found), dtype=np.int64, count=len(found))
        ends = np.cumsum(sizes)
        # sums by text: the words of each are added up in order
        total = np.zeros((len(sizes), width))
        filled = np.flatnonzero(np.array(sizes) > 0)
        if len(filled):
            total[filled] = np.add.reduceat(table[codes], (ends - sizes)[filled])
        rows.append(total)
        if len(index) > 150_000:
            index, table = {}, np.empty((0, width))
    return (np.vstack(rows) if rows else np.empty((0, width))), index, table


def train(
    docs: DataFrame,
    pieces: list[str],
    text: str = "text",
    lang: str = "lang",
    doc_id: str = "doc_id",
    sample_docs: int = 400,
    rounds: int = 3,
    smoothing: float = 50.0,
    max_langs: int = 1000,
) -> Model:
    """Learn piece probabilities from a bounded sample of labelled documents.

    The sample is, of each language, the `sample_docs` documents (with text and language) whose ids hash
    lowest; all their words count, as often as they occur. Its size does not grow with the corpus.
    Expected piece counts are made on the executors; the driver holds one number for each piece and language,
    and raises if there are more than `max_langs` languages. A language's floor is half as much again as the
    worst log-probability a letter of its sampled texts. Without labelled documents the model has no language.
    """
    labelled = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(F.col(doc_id).cast("string")).alias("h")
    )
    sizes = materialize(labelled.groupBy("lang").count(), "languages")
    langs = [r.lang for r in sizes.select("lang").orderBy("lang").limit(max_langs + 1).collect()]
    if len(langs) > max_langs:
        raise ValueError(f"more than {max_langs} languages; is the column of labels the right one?")
    langs = sorted(langs)
    model = Model(pieces, langs, np.full((1 + len(pieces), len(langs)), 1.0 / (1 + len(pieces))), np.full(len(langs), -np.inf))
    if not langs:
        return model
    # a hash threshold first: the window below then ranks a bounded number of rows of each language
    share = F.least(F.lit(1.0), F.lit(2.0 * sample_docs + 100) / F.col("count"))
    drawn = labelled.join(small_or_shuffled(sizes, 64), "lang").where((F.pmod("h", F.lit(1 << 30)) / F.lit(float(1 << 30))) < share)
    first = W.Window.partitionBy("lang").orderBy("h", F.xxhash64("text"))
    sample = materialize(drawn.withColumn("k", F.row_number().over(first)).where(F.col("k") <= sample_docs).select("lang", "text"), "language-sample")

    @F.pandas_udf("array<struct<word:string,n:long>>")
    def words(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([[{"word": w, "n": n} for w, n in Counter(words_of(t)).items()] for t in texts], dtype=object)

    listed = sample.select("lang", F.inline(words("text"))).groupBy("word", "lang").agg(F.sum("n").alias("n"))
    counted = materialize(listed.groupBy("word").agg(F.collect_list("lang").alias("langs"), F.collect_list("n").alias("n")), "language-words")
    for _ in range(rounds):
        now = docs.sparkSession.sparkContext.broadcast(model)

        def uses(batches: Iterator[pd.DataFrame], now=now) -> Iterator[pd.DataFrame]:
            m = now.value
            column = {x: i for i, x in enumerate(m.langs)}
            total = np.zeros_like(m.probs)
            for b in batches:
                counts = np.zeros((len(b), len(m.langs)))
                for row, (ls, ns) in enumerate(zip(b["langs"], b["n"], strict=True)):
                    counts[row, [column[x] for x in ls]] = ns
                total += m.expected(b["word"].tolist(), counts)
            piece, lang_at = np.nonzero(total > 1e-9)
            yield pd.DataFrame({"piece": piece.astype(np.int64), "lang": lang_at.astype(np.int64), "n": total[piece, lang_at]})
            del total
            free_memory()

        found = counted.mapInPandas(uses, "piece long, lang long, n double").groupBy("piece", "lang").agg(F.sum("n").alias("n")).toPandas()
        counts = np.zeros_like(model.probs)
        counts[found["piece"], found["lang"]] = np.round(found["n"], 6)
        pooled = (counts.sum(1, keepdims=True) + 0.01) / (counts.sum() + 0.01 * len(counts))
        model = Model(pieces, langs, (counts + smoothing * pooled) / (counts.sum(0, keepdims=True) + smoothing))
        now.unpersist()
    last = docs.sparkSession.sparkContext.broadcast(model)

    def typical(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = last.value
        column = {x: i for i, x in enumerate(m.langs)}
        index, table = {}, np.empty((0, len(m.langs) + 1))
        for b in batches:
            total, index, table = _text_scores(b["text"], m, index, table)
            own = total[np.arange(len(b)), [column[x] for x in b["lang"]]]
            some = total[:, -1] > 0
            yield pd.DataFrame({"lang": b["lang"][some], "mean": own[some] / total[some, -1]})

    worst = {r["lang"]: r["mean"] for r in sample.mapInPandas(typical, "lang string, mean double").groupBy("lang").agg(F.min("mean").alias("mean")).collect()}
    model.floors = np.array([1.5 * worst.get(x, -np.inf) for x in langs])
    return model


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with lang_pred, score and in_language: the most probable language of each whole text, its posterior, and
    whether the text's log-probability a letter reaches that language's floor.

    All languages are equally likely before reading. Ties go to the first language by code point. A text that
    is null or has no letter, or a model without languages, gives `und` with score 0, not in a language. Every row
    stays, repeated ones too; columns of these three names are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, in_language boolean")
    def best(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = shared.value
        names, index, table = np.array(m.langs, dtype=object), {}, np.empty((0, len(m.langs) + 1))
        for texts in batches:
            if not m.langs:
                yield pd.DataFrame({"lang_pred": [UNDETERMINED] * len(texts), "score": [0.0] * len(texts), "in_language": [False] * len(texts)})
                continue
            total, index, table = _text_scores(texts, m, index, table)
            letters, total = total[:, -1], total[:, :-1]
            top = total.argmax(1)
            score = 1 / np.exp(total - total.max(1, keepdims=True)).sum(1)
            fit = total.max(1) >= (m.floors[top] if m.floors is not None else -np.inf) * np.maximum(letters, 1)
            some = letters > 0
            yield pd.DataFrame({"lang_pred": np.where(some, names[top], UNDETERMINED), "score": np.where(some, score, 0.0), "in_language": some & fit})
        index, table = {}, None
        free_memory()

    out = without(docs, "lang_pred", "score", "in_language")
    (both,) = fresh(out, "best")
    kept = [F.col(f"`{c}`") for c in out.columns]
    return out.withColumn(both, best(F.col(f"`{text}`"))).select(*kept, f"{both}.*")


def identify(docs: DataFrame, pieces: list[str], folds: int = 5) -> DataFrame:
    """docs with held_out, lang_pred, score and in_language; learned from rows whose crc32(doc_id as text) mod folds is not 0.

    An empty table gives an empty result. A null doc_id counts as empty text for the fold.
    """
    held = crc_mod("doc_id", folds) == 0
    model = train(docs.where(~held), pieces)
    return predict(without(docs, "held_out").withColumn("held_out", held), model)
