"""Ids of a word-level BPE tokenizer file, for many texts at once.

The tokenizer lower-cases, drops white space, and merges inside matches only:
runs of letters, single digits, runs of other marks. So a text's ids are those
of its pieces. Pieces are cut out of the bytes in numpy, the distinct ones of
a batch are merged together, and their ids dealt back. Words that need the
tokenizer's own reading (apostrophes, or bytes beyond ASCII that are not
plain letters) are encoded by the tokenizers library.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np

from .common import byte_factors, powers, slices

#: Bytes that are read at once, and of a piece that is merged in numpy.
PART_BYTES, FAST_BYTES = 1 << 20, 48
#: Characters of texts that are encoded together.
AT_ONCE = 4 << 20
NONE = np.int32(2**31 - 1)
SPACE, LETTER, DIGIT, MARK, OTHER_SPACE = range(5)


def _classes() -> np.ndarray:
    out = np.full(256, MARK, dtype=np.uint8)
    out[128:] = LETTER
    for c in range(128):
        if chr(c).isalpha():
            out[c] = LETTER
        elif chr(c).isdigit():
            out[c] = DIGIT
        elif chr(c) in " \t\n\r":
            out[c] = SPACE
    out[[11, 12, 28, 29, 30, 31, 39]] = OTHER_SPACE  # control characters and the apostrophe: left to the library
    return out


CLASS = _classes()


class _Pairs:
    """Rank and result of a pair of symbols: a table by hash, one for the pairs that collide in it, and the rest."""

    def __init__(self, left: np.ndarray, right: np.ndarray, made: np.ndarray):
        key = self._key(left, right)
        rank = np.arange(key.size, dtype=np.int32)
        self.tables = []
        for bits in (20, 16):
            slot = self._slot(key, bits)
            _, first = np.unique(slot, return_index=True)
            keys, ranks = np.full(1 << bits, -1, dtype=np.int64), np.full(1 << bits, NONE, dtype=np.int32)
            keys[slot[first]], ranks[slot[first]] = key[first], rank[first]
            self.tables.append((bits, keys, ranks))
            rest = np.setdiff1d(np.arange(key.size), first)
            key, rank = key[rest], rank[rest]
        order = np.argsort(key)
        self.rest, self.rest_rank = np.r_[key[order], np.int64(2**62)], np.r_[rank[order], NONE]
        self.made = np.r_[made, -1].astype(np.int32)

    @staticmethod
    def _key(left, right) -> np.ndarray:
        return (left.astype(np.int64) << 20) | right.astype(np.int64)

    @staticmethod
    def _slot(key: np.ndarray, bits: int) -> np.ndarray:
        return (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15 + 2 * bits) >> np.uint64(64 - bits)).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = self._key(left, right)
        key[(left < 0) | (right < 0)] = -2
        bits, keys, ranks = self.tables[0]
        slot = self._slot(key, bits)
        out = np.where(keys[slot] == key, ranks[slot], NONE)
        unmet = np.flatnonzero((out == NONE).ravel() & (keys[slot] >= 0).ravel())
        if unmet.size:
            flat, left_key = out.ravel(), key.ravel()[unmet]
            bits, keys, ranks = self.tables[1]
            slot = self._slot(left_key, bits)
            at = np.searchsorted(self.rest, left_key)
            flat[unmet] = np.where(keys[slot] == left_key, ranks[slot], np.where(self.rest[at] == left_key, self.rest_rank[at], NONE))
            out = flat.reshape(key.shape)
        return out


class WordTokenizer:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        self.model = Tokenizer.from_file(path)
        # Added tokens are cut out before; the library sees texts without them.
        self.added = {t.content: np.array([i], dtype="<u4") for i, t in self.model.get_added_tokens_decoder().items()}
        self.at_added = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) or r"(?!)")
        vocab = self.model.get_vocab()
        self.sentence_end = np.zeros(max(vocab.values()) + 1, dtype=bool)
        for token, i in vocab.items():
            self.sentence_end[i] = re.fullmatch(r".*[.!?]+(</w>)?", token) is not None
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        end = model["end_of_word_suffix"]
        self.pairs = _Pairs(*(np.array([vocab[x] for x in c]) for c in (*zip(*merges), [a + b for a, b in merges])))
        chars = _byte_chars()
        self.inner = np.array([vocab[c] for c in chars], dtype=np.int32)
        self.final = np.array([vocab[c + end] for c in chars], dtype=np.int32)

    def merge(self, raw: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, count) of pieces of bytes: the pair of least rank, the leftmost of equals, is merged until none is left."""
        width = int(size.max())
        place = np.arange(width)
        at = np.minimum(begin[:, None] + place, raw.size - 1)
        ids = np.where(place < (size - 1)[:, None], self.inner[raw[at]], np.where(place == (size - 1)[:, None], self.final[raw[at]], np.int32(-1)))
        ids = np.c_[ids, np.full(size.size, -1, np.int32)].astype(np.int32)
        rank = self.pairs.ranks(ids[:, :-1], ids[:, 1:])
        live = np.arange(size.size)
        now, now_rank = ids.copy(), rank
        while live.size:
            at = now_rank.argmin(axis=1)
            row = np.arange(live.size)
            least = now_rank[row, at]
            done = least == NONE
            if done.any():
                ids[live[done], : now.shape[1]] = now[done]
                ids[live[done], now.shape[1] :] = -1
                going = ~done
                live, now, now_rank, at, least = live[going], now[going], now_rank[going], at[going], least[going]
                row = np.arange(live.size)
                if not live.size:
                    break
            # Drop the right symbol, then rank the pairs on both sides of the merged one.
            wide = now.shape[1] - 1
            take = np.arange(wide) + (np.arange(wide) > at[:, None])
            now = np.take_along_axis(now, take, axis=1)
            now[row, at] = self.pairs.made[least]
            now = np.c_[now, np.full(live.size, -1, np.int32)]
            now_rank = np.c_[np.take_along_axis(now_rank, np.minimum(take, wide - 1), axis=1)[:, : wide - 1], np.full(live.size, NONE, np.int32)]
            now_rank[row, at] = self.pairs.ranks(now[row, at], now[row, at + 1])
            left = at > 0
            now_rank[row[left], at[left] - 1] = self.pairs.ranks(now[row[left], at[left] - 1], now[row[left], at[left]])
        used = ids >= 0
        return ids[used], used.sum(axis=1)

    def _library(self, words: list[str]) -> list[np.ndarray]:
        return [np.asarray(x.ids, dtype=np.int32) for x in self.model.encode_batch(words, add_special_tokens=False)]

    def _pieces(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(begin, end, hash) of the pieces of bytes that end with a space."""
        kind = CLASS[raw]
        turn = np.flatnonzero((kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)) + 1
        begin = np.r_[0, turn]
        end = np.r_[turn, raw.size]
        solid = kind[begin] != SPACE
        begin, end = begin[solid], end[solid]
        up, down = powers(raw.size + 1)
        upto = np.zeros(raw.size + 1, dtype=np.uint64)
        np.cumsum(byte_factors()[raw] * up[: raw.size], out=upto[1:])
        return begin, end, (upto[end] - upto[begin]) * down[begin] * np.uint64(0xD6E8FEB86659FD93)

    def __call__(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text. Long texts are cut at spaces, which no piece crosses."""
        held: list[tuple[str, int, np.ndarray | None]] = []  # part, its text, the added token behind it
        n, ready = 0, {}
        for i, text in enumerate(texts):
            for part, added in self._parts(text):
                held.append((part, i, added))
                n += len(part)
                if n >= AT_ONCE:
                    yield from self._done(held, ready, i)
                    held, n = [], 0
        yield from self._done(held, ready, len(texts))

    def _parts(self, text: str) -> Iterator[tuple[str, np.ndarray | None]]:
        """Parts of a text and the id of the added token behind each, if any."""
        begin = 0
        for m in self.at_added.finditer(text):
            *before, last = _cut(text[begin : m.start()], AT_ONCE)
            yield from ((part, None) for part in before)
            yield last, self.added[m.group()]
            begin = m.end()
        yield from ((part, None) for part in _cut(text[begin:], AT_ONCE))

    def _done(self, held: list[tuple[str, int, np.ndarray | None]], ready: dict[int, list[np.ndarray]], upto: int) -> Iterator[np.ndarray]:
        """Encode the parts; give the texts before number ``upto``, of which no part is to come."""
        ids, count = self.encode([part for part, _, _ in held])
        ends = np.cumsum(count).tolist()
        for (_, i, added), a, b in zip(held, [0, *ends], ends):
            ready.setdefault(i, []).append(ids[a:b])
            if added is not None:
                ready[i].append(added)
        for i in sorted(k for k in ready if k < upto):
            parts = ready.pop(i)
            yield parts[0] if len(parts) == 1 else np.concatenate(parts)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, count): the ids of the texts in one row, and how many each text has."""
        if not texts:
            return np.empty(0, "<u4"), np.empty(0, np.int64)
        coded = [t.encode().lower() + b" " for t in texts]
        stops = np.cumsum([len(c) for c in coded])
        raw = np.frombuffer(b"".join(coded), np.uint8)
        found, a = [], 0
        while a < raw.size:  # whole texts, of about a part's bytes
            b = int(stops[min(np.searchsorted(stops, a + PART_BYTES), stops.size - 1)])
            begin, end, h = self._pieces(raw[a:b])
            found.append((begin + a, end + a, h))
            a = b
        begin, end, h = (np.concatenate(x) for x in zip(*found))
        if not begin.size:
            return np.empty(0, "<u4"), np.zeros(len(texts), np.int64)
        _, first, which = np.unique(h, return_index=True, return_inverse=True)
        flat, offset, count, odd = self._distinct(raw, begin[first], end[first])
        size = count[which]
        if odd.any():
            # Whole words around such a piece go to the library: their other pieces give nothing, the first one the ids.
            gap = np.r_[True, CLASS[raw[begin[1:] - 1]] == SPACE]
            word = np.cumsum(gap) - 1
            bad = np.unique(word[odd[which]])
            mine = np.isin(word, bad)
            size[mine] = 0
            heads = np.flatnonzero(gap & mine)
            tails = np.r_[np.flatnonzero(gap)[1:], begin.size][bad] - 1
            decoded = [self._source(raw, texts, stops, begin[x], end[y]) for x, y in zip(heads, tails)]
            distinct = list(dict.fromkeys(decoded))
            ids = dict(zip(distinct, self._library(distinct)))
            extra = [ids[w] for w in decoded]
            begins = flat.size + np.cumsum([0, *(x.size for x in extra)])
            flat = np.concatenate([flat, *extra])
            start = offset[which]
            start[heads], size[heads] = begins[:-1], np.diff(begins)
        else:
            start = offset[which]
        total = np.cumsum(size)
        at = np.repeat(start - (total - size), size) + np.arange(total[-1])
        upto = np.r_[0, total][np.searchsorted(begin, np.r_[0, stops])]
        return flat[at].astype("<u4"), np.diff(upto)

    @staticmethod
    def _source(raw: np.ndarray, texts: list[str], stops: np.ndarray, a: int, b: int) -> str:
        """The word as it stands in its text: the bytes were lower-cased in ASCII only, which the tokenizer does too."""
        return raw[a:b].tobytes().decode()

    def _distinct(self, raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids, offset, count, odd) of distinct pieces; odd ones have no ids yet."""
        size = end - begin
        beyond = np.r_[0, np.cumsum(raw >= 128)]
        odd = (CLASS[raw[begin]] == OTHER_SPACE) | (size > FAST_BYTES)
        changed: dict[int, bytes] = {}
        for i in np.flatnonzero((beyond[end] > beyond[begin]) & ~odd).tolist():
            word = raw[begin[i] : end[i]].tobytes().decode()
            lower = word.lower()
            if not word.isalpha() or "Σ" in word or not unicodedata.is_normalized("NFC", word) or lower != word and not lower.isalpha():
                odd[i] = True
            elif lower != word:
                changed[i] = lower.encode()
        if changed:
            # Their lower case follows the bytes of the texts.
            places = np.array(list(changed))
            sizes = np.array([len(x) for x in changed.values()])
            begin, size = begin.copy(), size.copy()
            begin[places], size[places] = raw.size + np.cumsum(sizes) - sizes, sizes
            raw = np.r_[raw, np.frombuffer(b"".join(changed.values()), np.uint8)]
        count = np.zeros(begin.size, dtype=np.int64)
        order = np.flatnonzero(~odd)
        order = order[np.argsort(size[order], kind="stable")]
        parts = []
        for a, b in slices(order.size, 8192):
            rows = order[a:b]
            ids, count[rows] = self.merge(raw, begin[rows], size[rows])
            parts.append(ids)
        flat = np.concatenate(parts) if parts else np.empty(0, np.int32)
        offset = np.zeros(begin.size, dtype=np.int64)
        offset[order] = np.cumsum(count[order]) - count[order]
        return flat, offset, count, odd


def _cut(text: str, size: int) -> list[str]:
    """Parts of at least ``size`` characters, cut at spaces."""
    out, a = [], 0
    while len(text) - a > size:
        b = text.find(" ", a + size)
        if b < 0:
            break
        out.append(text[a:b])
        a = b + 1
    return [*out, text[a:]]


def _byte_chars() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


@lru_cache(maxsize=2)
def tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)
