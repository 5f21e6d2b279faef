"""Token ids of whole texts from a public vocabulary file, a word at a time.

The vocabularies that drop white space never build a token across it, nor
between an ASCII digit and its neighbours, nor between an ASCII letter and
ASCII punctuation but the apostrophe of contractions.  So a batch of texts is
cut into short words with array operations, and a table from the words' 64-bit
hashes gives the ids of those that were seen before.  New words of lower-case
Latin letters are merged here, all at once; the tokenizers library encodes the
others, and judges at the start whether the merging here agrees with its own.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np
import pyarrow as pa

from tidewater.llm.common import LOWER

#: Words whose ids a worker process remembers (about 50 MB); beyond it the table starts anew.
REMEMBER = 1_000_000
#: Bytes of words that are looked up at once; words beyond LONG bytes are encoded each time.
AT_ONCE, LONG = 1 << 21, 64
_SPACE, _LETTER, _DIGIT, _SIGN, _OTHER = range(5)
#: Letters whose words are one unit of every such vocabulary, and which normal forms leave alone.
_LATIN = re.compile("[a-zß-öø-ÿ]+")
_NONE = np.int64(1) << 31


def _classes() -> np.ndarray:
    kinds = np.full(256, _OTHER, np.uint8)  # control characters, the apostrophe and every byte beyond ASCII
    for c in range(33, 127):
        kinds[c] = _LETTER if chr(c).isalpha() else _DIGIT if chr(c).isdigit() else _SIGN
    kinds[ord("'")] = _OTHER
    kinds[[9, 10, 11, 12, 13, 32]] = _SPACE
    return kinds


def _word_starts() -> np.ndarray:
    """Whether a word starts at a byte, by eight times the class of the byte before and its own."""
    starts = np.zeros(64, bool)
    for a in range(5):
        for b in range(1, 5):
            starts[8 * a + b] = a == _SPACE or _DIGIT in (a, b) or {a, b} == {_LETTER, _SIGN}
    return starts


_CLASS, _START = _classes(), _word_starts()
_RANDOM = np.random.default_rng(17).integers(1, 1 << 64, LONG * 256, np.uint64, endpoint=False)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def cut_words(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words' bytes, one after another, where each word ends, and how many words stand before each text.

    The vocabulary lower-cases.  A text that may spell a special token keeps its case and is cut at white space only.
    """
    own = [t if b"<|" in t else t.translate(LOWER) for t in (t or b"" for t in texts)]
    begin = np.cumsum([0] + [len(t) + 1 for t in own])
    x = np.frombuffer(b"\n".join(own) + b"\n", np.uint8)[: begin[-1]]
    kind = _CLASS[x]
    pair = kind.copy()
    pair[1:] += kind[:-1] << 3
    start = _START[pair]
    for k, t in enumerate(own):
        if b"<|" in t:
            a, b = begin[k], begin[k + 1]
            start[a:b] = (kind[a:b] != _SPACE) & (pair[a:b] >> 3 == _SPACE)
    solid = kind != _SPACE
    data = x[solid]
    return data, np.append(np.flatnonzero(start[solid])[1:], len(data)) if len(data) else np.zeros(0, np.int64), np.searchsorted(np.flatnonzero(start), begin)


def _ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers first, first + 1, ... of each range, one range after another."""
    ends = np.cumsum(size)
    return np.repeat(first - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)


class Merges:
    """Byte-pair merging of many words at once: in each round every word merges its leftmost pair of the lowest rank."""

    def __init__(self, model: dict):
        ids, suffix = model["vocab"], model["end_of_word_suffix"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.size = len(ids)
        keys = np.array([ids[a] * self.size + ids[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = np.append(keys[order], np.int64(1) << 62), np.append(order, 0)
        self.merged = np.array([ids[a + b] for a, b in pairs], np.int64)
        signs = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves; the others follow beyond 255
        names = {b: chr(b) for b in signs} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in signs)}
        self.inner, self.last = (np.array([ids[names[b] + s] for b in range(256)], np.int64) for s in ("", suffix))

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * self.size + b
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.ranks[at], _NONE)

    def encode(self, data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words and how many each has."""
        word = np.repeat(np.arange(len(sizes)), sizes)
        now, ends = self.inner[data], np.cumsum(sizes) - 1
        now[ends] = self.last[data[ends]]
        rank = np.append(self._rank(now[:-1], now[1:]), _NONE)
        rank[ends] = _NONE
        done_ids, done_words = [], []
        while len(now):
            new = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            best = np.minimum.reduceat((rank << 31) + np.arange(len(now)), new)
            over = best >= _NONE << 31
            ended = np.repeat(over, np.diff(np.append(new, len(now))))
            done_ids.append(now[ended])
            done_words.append(word[ended])
            at, used = best[~over] & (_NONE - 1), best[~over] >> 31
            now[at] = self.merged[used]
            keep = ~ended
            keep[at + 1] = False
            at = (np.cumsum(keep) - 1)[at]
            now, word, rank = now[keep], word[keep], rank[keep]
            for p in (at, at[at > 0] - 1):
                follows = p + 1 < len(now)
                q = p[follows]
                rank[p] = _NONE
                same = word[q] == word[q + 1]
                rank[q[same]] = self._rank(now[q[same]], now[q[same] + 1])
        ids, words = np.concatenate(done_ids or [now]), np.concatenate(done_words or [word])
        return ids[np.argsort(words, kind="stable")], np.bincount(words, minlength=len(sizes))


_KEPT: dict[str, WordTokenizer] = {}


def word_tokenizer(path: str) -> WordTokenizer:
    """One for each worker process, so that tasks share what was learnt."""
    if path not in _KEPT:
        _KEPT[path] = WordTokenizer(path)
    return _KEPT[path]


class WordTokenizer:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size()
        self.kind = np.uint16 if self.size <= 1 << 16 else np.uint32
        self.merges = self._checked(path)
        self._clear()

    def _checked(self, path: str) -> Merges | None:
        """The merging of this module, if the library gives the same ids for words built from the vocabulary."""
        with open(path, encoding="utf-8") as source:
            model = json.load(source)["model"]
        if model.get("type") != "BPE" or not model.get("end_of_word_suffix") or model.get("dropout") or model.get("ignore_merges"):
            return None
        made = Merges(model)
        own = [t.removesuffix(model["end_of_word_suffix"]) for t in list(model["vocab"])[:: max(1, self.size // 1000)]]
        own = [w for w in own if w.isascii() and _LATIN.fullmatch(w)]
        probe = [a + b for a, b in zip(own, reversed(own))] + ["é" + w + "ß" for w in own[:50]]
        data = [w.encode() for w in probe]
        ids, counts = made.encode(np.frombuffer(b"".join(data), np.uint8), np.array([len(w) for w in data]))
        want = self._library(data)
        return made if ids.tolist() == want[0].tolist() and counts.tolist() == want[1].tolist() else None

    def _clear(self) -> None:
        slots = 1 << (2 * REMEMBER).bit_length()
        self.known, self.hashes, self.places = 0, np.zeros(slots, np.uint64), np.zeros(slots, np.int32)
        self.begin, self.count, self.pool, self.filled = np.zeros(1024, np.int32), np.zeros(1024, np.int32), np.zeros(4096, self.kind), 0

    def _library(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        made = [e.ids for e in self.tokenizer.encode_batch([w.decode("utf-8") for w in words], add_special_tokens=False)]
        return np.array([i for ids in made for i in ids], np.int64), np.array([len(ids) for ids in made], np.int64)

    def _learn(self, data: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The places of words that are new, given where they stand in the data."""
        flat = data[_ranges(first, size)]
        words = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(np.concatenate(([0], np.cumsum(size))).astype(np.int32)), pa.py_buffer(flat)])
        latin = np.logical_and.reduceat((flat >= 97) & (flat <= 122), np.cumsum(size) - size)
        rest = np.flatnonzero(~latin)
        texts = words.take(pa.array(rest)).to_pylist()
        latin[rest] = [len(t) > 1 and _LATIN.fullmatch(t.decode("utf-8")) is not None for t in texts]
        if self.merges is None:
            latin[:] = False
        rest = np.flatnonzero(~latin)
        own = np.flatnonzero(latin)
        counts = np.zeros(len(size), np.int64)
        one = self.merges.encode(flat[np.repeat(latin, size)], size[own]) if len(own) else (np.zeros(0, np.int64),) * 2
        two = self._library(words.take(pa.array(rest)).to_pylist()) if len(rest) else (np.zeros(0, np.int64),) * 2
        counts[own], counts[rest] = one[1], two[1]
        begin = np.zeros(len(size), np.int64)
        begin[own] = self.filled + np.cumsum(one[1]) - one[1]
        begin[rest] = self.filled + len(one[0]) + np.cumsum(two[1]) - two[1]
        self.pool = _grown(self.pool, self.filled + len(one[0]) + len(two[0]))
        self.pool[self.filled : self.filled + len(one[0])] = one[0]
        self.pool[self.filled + len(one[0]) : self.filled + len(one[0]) + len(two[0])] = two[0]
        self.filled += len(one[0]) + len(two[0])
        self.begin, self.count = _grown(self.begin, self.known + len(size)), _grown(self.count, self.known + len(size))
        places = np.arange(self.known, self.known + len(size))
        self.begin[places], self.count[places] = begin, counts
        self.known += len(size)
        return places

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """The places of words by their hashes; -1 where they are new."""
        out, todo, mask = np.full(len(hashes), -1, np.int64), np.arange(len(hashes)), len(self.hashes) - 1
        slot = (hashes & np.uint64(mask)).astype(np.int64)
        while len(todo):
            there = self.hashes[slot]
            same = there == hashes[todo]
            out[todo[same]] = self.places[slot[same]]
            go = ~same & (there != 0)
            todo, slot = todo[go], (slot[go] + 1) & mask
        return out

    def _keep(self, hashes: np.ndarray, places: np.ndarray) -> None:
        mask = len(self.hashes) - 1
        slot = (hashes & np.uint64(mask)).astype(np.int64)
        while len(hashes):
            free = self.hashes[slot] == 0
            self.hashes[slot[free]] = hashes[free]
            mine = free & (self.hashes[slot] == hashes)
            self.places[slot[mine]] = places[mine]
            hashes, places, slot = hashes[~mine], places[~mine], (slot[~mine] + 1) & mask

    def _look_up(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of some words and how many each has."""
        if self.known > REMEMBER:
            self._clear()
        first = np.concatenate(([0], ends[:-1]))
        size = ends - first
        at = np.arange(len(data)) - np.repeat(first, size)
        long = np.flatnonzero(size > LONG)
        if len(long):
            np.minimum(at, LONG - 1, out=at)
        hashes = np.add.reduceat(_RANDOM[at * 256 + data], first)
        hashes[hashes == 0] = 1
        places = self._find(hashes)
        new = np.flatnonzero(places < 0)
        if len(long):
            new = new[size[new] <= LONG]
        if len(new):
            distinct, one, which = np.unique(hashes[new], return_index=True, return_inverse=True)
            made = self._learn(data, first[new[one]], size[new[one]])
            self._keep(distinct, made)
            places[new] = made[which]
        if len(long):
            places[long] = self._learn(data, first[long], size[long])
        counts = self.count[places].astype(np.int64)
        return self.pool[_ranges(self.begin[places], counts)], counts

    def encode(self, texts: list[bytes | None], end: int | None = 0) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another and each followed by `end`, and where each text begins."""
        data, ends, bounds = cut_words(texts)
        ids, counts, a = [np.zeros(0, self.kind)], [np.zeros(0, np.int64)], 0
        while a < len(ends):
            start = ends[a - 1] if a else 0
            b = max(a + 1, int(np.searchsorted(ends, start + AT_ONCE, "right")))
            one, own = self._look_up(data[start : ends[b - 1]], ends[a:b] - start)
            ids.append(one)
            counts.append(own)
            a = b
        whole = np.concatenate(ids)
        bounds = np.concatenate(([0], np.cumsum(np.concatenate(counts))))[bounds]
        if end is None:
            return whole, bounds
        return np.insert(whole, bounds[1:], end), bounds + np.arange(len(bounds))


def _grown(x: np.ndarray, size: int) -> np.ndarray:
    if size <= len(x):
        return x
    out = np.zeros(max(size, 2 * len(x)), x.dtype)
    out[: len(x)] = x
    return out
