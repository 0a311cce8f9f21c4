"""Byte-level BPE with numpy: the symbols of many pre-tokens are merged together, round by round.

Each round looks up every adjacent pair's rank by binary search over the sorted pair keys, finds each
pre-token's lowest rank, and merges all its occurrences at once. That equals merging one at a time:
a pair that holds a new symbol was learned after the pair that made the symbol, so its rank is higher.

Long pre-tokens (a line of megabytes without a space is one) take as many rounds as they use ranks, so their rounds
touch only the places of the round's rank: symbols are linked, and places wait in lists by rank.
"""

from __future__ import annotations

import heapq
import json
from collections import defaultdict
from functools import lru_cache

import numpy as np
import regex

#: The pre-token pattern of the byte-level tokenizers.
PRETOKEN = regex.compile(
    r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"""
)
NEVER = np.int64(1 << 40)
#: Bytes from which a pre-token is merged by lists of places.
LONG = 1024


def byte_chars() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    table = {b: chr(b) for b in shown}
    return [table.get(b) or chr(next(spare)) for b in range(256)]


def _unsupported(spec: dict) -> list[str]:
    """The settings of a vocabulary file that would change its ids and that are not implemented here."""
    model, before, out = spec["model"], spec.get("pre_tokenizer") or {}, []
    if model.get("type", "BPE") != "BPE":
        out.append(f"model {model['type']}")
    if spec.get("normalizer"):
        out.append("normalizer")
    if before.get("type") != "ByteLevel":
        out.append(f"pre_tokenizer {before.get('type')}")
    out += [f"pre_tokenizer {k}" for k, usual in (("add_prefix_space", False), ("use_regex", True)) if bool(before.get(k, usual)) != usual]
    out += [f"model {k}" for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges") if model.get(k)]
    if (spec.get("decoder") or {}).get("type") != "ByteLevel":
        out.append("decoder")
    # surrounding space that a special string takes with it, and others than special ones
    return out + [f"added token {t['content']!r}: {k}" for t in spec.get("added_tokens", []) for k in ("lstrip", "rstrip", "single_word") if t.get(k)]


class Tokenizer:
    """A byte-level BPE vocabulary file of the tokenizers library, as sorted numpy tables.

    Settings that it does not implement raise a ValueError, as ids would be others than the library's.
    """

    def __init__(self, spec: dict):
        if unknown := _unsupported(spec):
            raise ValueError(f"not implemented: {', '.join(unknown)}")
        vocab = spec["model"]["vocab"]
        chars = byte_chars()
        back = {c: b for b, c in enumerate(chars)}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.byte_ids = np.array([vocab[c] for c in chars], dtype=np.int64)
        self.token_bytes = [b""] * (1 + max([*vocab.values(), *self.special.values()]))
        for token, i in vocab.items():
            self.token_bytes[i] = bytes(back[c] for c in token)
        for token, i in self.special.items():
            self.token_bytes[i] = token.encode()
        merges = [m if isinstance(m, list) else m.split(" ", 1) for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in merges], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys = keys[order]
        self.ranks = order.astype(np.int64)
        self.results = np.array([vocab[a + b] for a, b in merges], dtype=np.int64)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def pretokens(self, text: str) -> list[str]:
        """The text's pre-tokens in order; special strings stand alone."""
        if self.cut is None or not any(s in text for s in self.special):
            return PRETOKEN.findall(text)
        out: list[str] = []
        for part in self.cut.split(text):
            if part in self.special:
                out.append(part)
            else:
                out += PRETOKEN.findall(part)
        return out

    def pair_ranks(self, keys: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.ranks[at], NEVER)

    def merge(self, pretokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all pre-tokens in one flat array, and how many each has."""
        coded = [p.encode("utf-8", "surrogatepass") for p in pretokens]
        if any(len(c) >= LONG for c in coded):
            return self._with_long(coded)
        return self._merge(coded)

    def _with_long(self, coded: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        short_ids, short_counts = self._merge([c for c in coded if len(c) < LONG])
        parts = iter(np.split(short_ids, np.cumsum(short_counts)[:-1])) if len(short_counts) else iter(())
        each = [self._merge_long(c) if len(c) >= LONG else next(parts) for c in coded]
        return np.concatenate(each), np.array([len(x) for x in each], dtype=np.int64)

    def _merge_long(self, coded: bytes) -> np.ndarray:
        """Token ids of one pre-token; each round merges all places of the lowest rank left."""
        ids = self.byte_ids[np.frombuffer(coded, dtype=np.uint8)].copy()
        n = len(ids)
        after, before, alive = np.append(np.arange(1, n), -1), np.arange(-1, n - 1), np.ones(n, dtype=bool)
        waiting: dict[int, list[np.ndarray]] = defaultdict(list)
        ranks: list[int] = []

        def wait(places: np.ndarray) -> None:
            """List places under the ranks of the pairs that start there."""
            rank = self.pair_ranks(ids[places] << 32 | ids[after[places]])
            order = np.argsort(rank, kind="stable")
            rank, places = rank[order], places[order]
            last = int(np.searchsorted(rank, NEVER))
            if not last:
                return
            starts = np.flatnonzero(np.append(True, rank[1:last] != rank[: last - 1]))
            for r, s, e in zip(rank[starts].tolist(), starts.tolist(), [*starts[1:].tolist(), last], strict=True):
                if r not in waiting:
                    heapq.heappush(ranks, r)
                waiting[r].append(places[s:e])

        wait(np.arange(n - 1))
        while ranks:
            r = heapq.heappop(ranks)
            places = np.unique(np.concatenate(waiting.pop(r)))
            places = places[alive[places] & (after[places] >= 0)]
            places = places[self.pair_ranks(ids[places] << 32 | ids[after[places]]) == r]  # others have changed since
            if not len(places):
                continue
            # of a run of overlapping places every second one counts, from the left
            fresh = np.append(True, places[1:] != after[places[:-1]])
            run_at = np.maximum.accumulate(np.where(fresh, np.arange(len(places)), 0))
            places = places[(np.arange(len(places)) - run_at) % 2 == 0]
            gone = after[places]
            follows = after[gone]
            ids[places] = self.results[r]
            alive[gone] = False
            after[places] = follows
            before[follows[follows >= 0]] = places[follows >= 0]
            changed = np.union1d(places, before[places])
            wait(changed[(changed >= 0) & (after[changed] >= 0)])
        return ids[alive]

    def _merge(self, coded: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        lengths = np.fromiter(map(len, coded), dtype=np.int64, count=len(coded))
        flat = self.byte_ids[np.frombuffer(b"".join(coded), dtype=np.uint8)]
        owner = np.repeat(np.arange(len(coded)), lengths)
        done_ids, done_owner, done_pos = [], [], []
        pos = np.arange(len(flat))
        while len(flat):
            inner = owner[1:] == owner[:-1]
            rank = np.full(len(inner), NEVER)
            where = np.flatnonzero(inner)
            rank[where] = self.pair_ranks(flat[where] << 32 | flat[where + 1])
            rank = np.append(rank, NEVER)
            starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            best = np.minimum.reduceat(rank, starts)
            counts = np.diff(np.append(starts, len(flat)))
            low = np.repeat(best, counts)
            over = low == NEVER
            if over.any():
                done_ids.append(flat[over])
                done_owner.append(owner[over])
                done_pos.append(pos[over])
                live = ~over
                flat, owner, pos, rank, low = flat[live], owner[live], pos[live], rank[live], low[live]
                if not len(flat):
                    break
            hit = rank == low
            # of a run of overlapping hits (as in "aaa") every second one counts, from the left
            joined = np.flatnonzero(hit)
            fresh = np.append(True, np.diff(joined) != 1)
            run_at = np.maximum.accumulate(np.where(fresh, np.arange(len(joined)), 0))
            joined = joined[(np.arange(len(joined)) - run_at) % 2 == 0]
            flat = flat.copy()
            flat[joined] = self.results[rank[joined]]
            keep = np.ones(len(flat), dtype=bool)
            keep[joined + 1] = False
            flat, owner, pos = flat[keep], owner[keep], pos[keep]
        if not done_ids:
            return np.empty(0, np.int64), np.zeros(len(coded), np.int64)
        order = np.argsort(np.concatenate(done_pos), kind="stable")
        return np.concatenate(done_ids)[order], np.bincount(np.concatenate(done_owner), minlength=len(coded))


@lru_cache(maxsize=4)
def _parsed(spec: str) -> Tokenizer:
    return Tokenizer(json.loads(spec))


def load(spec: str) -> Tokenizer:
    """A tokenizer from the text of its vocabulary file; parsed once in each Python worker."""
    return _parsed(spec)


class Pool:
    """Token ids of the pre-tokens met so far in this worker, up to a fixed number of them."""

    LIMIT = 200_000

    def __init__(self, tokenizer: Tokenizer, keep_ids: bool):
        self.tokenizer, self.keep_ids = tokenizer, keep_ids
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.counts = np.empty(0, np.int64)
        self.starts = np.empty(0, np.int64)
        self.ids = np.empty(0, np.int32)

    def codes(self, pieces: list[str]) -> np.ndarray:
        """The place of each pre-token in the pool; new ones are merged together."""
        index = self.index
        new = [p for p in dict.fromkeys(pieces) if p not in index]
        if new:
            ids, counts = self._merged(new)
            index.update(zip(new, range(len(index), len(index) + len(new)), strict=True))
            first = len(self.ids) if self.keep_ids else 0
            self.counts = np.concatenate([self.counts, counts])
            if self.keep_ids:
                self.starts = np.concatenate([self.starts, first + np.cumsum(counts) - counts])
                self.ids = np.concatenate([self.ids, ids.astype(np.int32)])
        return np.fromiter(map(index.__getitem__, pieces), dtype=np.int64, count=len(pieces))

    def _merged(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        special = self.tokenizer.special
        marks = [(i, special[p]) for i, p in enumerate(new) if p in special]
        if not marks:
            return self.tokenizer.merge(new)
        ids, counts = self.tokenizer.merge([p for p in new if p not in special])
        at = np.array([i for i, _ in marks])
        rank = at - np.arange(len(at))  # how many ordinary pre-tokens come before
        ends = np.append(0, np.cumsum(counts))
        return np.insert(ids, ends[rank], [x for _, x in marks]), np.insert(counts, rank, 1)

    def gather(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a sequence of pooled pre-tokens, and the number of ids of each."""
        counts = self.counts[codes]
        ends = np.cumsum(counts)
        total = int(ends[-1]) if len(ends) else 0
        at = np.arange(total) + np.repeat(self.starts[codes] - (ends - counts), counts)
        return self.ids[at], counts
