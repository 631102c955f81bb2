"""Token ids of whole texts with a public tokenizer file, encoding each distinct word once per worker."""

from __future__ import annotations

import os
import re
from itertools import chain, repeat

import numpy as np
import pyarrow as pa

from .common import mix

#: White space besides the blank; the first nine are ASCII.
BLANKS = [chr(i) for i in range(1, 0x3001) if chr(i).isspace() and i != 32]
#: A full stop or comma between a letter and a blank or the end: pre-tokenizers always cut before it, but for the one letter
#: whose lower case ends in a mark, which would join the stop.
MARK = re.compile(r"([.,])(?<=[^\W\d_\u0130][.,])(?= |\Z)")
#: The visible character that byte-level tokenizers use for each byte.
_seen = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
VISIBLE = {b: chr(b) if b in _seen else chr(256 + b - sum(x < b for x in _seen)) for b in range(256)}
#: Texts and words that a tokenizer file is tried out on before words are encoded one by one.
TRIED_TEXTS = ["One two, three.", "Don't stop. It's 42,000 or 4.5 (or x=1)!", "l'été où ñandú; straße", "A\nB\nnext line.\nEnd,", "q.\n42\n's", "x ,y .z 's n't", "a_b c-d e&&& f,!! g.h@i4.j 's. k_'s l'(m) n't- o-'re ... ?! I'LL", "日本 語, кот. €5"]
TRIED_WORDS = ["Then", "then", "Éét", "ñandú", "the", "WORD", "straße", "Übung", "ça"]
#: Words of at most so many bytes are looked up by their bytes, all at once.
SHORT = 15

_letters = np.zeros(256, bool)
_letters[65:91] = _letters[97:123] = True
_signs = np.zeros(256, bool)
_signs[33:48] = _signs[58:65] = _signs[91:97] = _signs[123:127] = True
_signs[ord("'")] = False
_odd_bytes = np.zeros(256, bool)
_odd_bytes[:32] = True
_odd_bytes[10] = False
_masks = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1] * 8, np.uint64)


class _ShortWords:
    """Numbers of words of at most SHORT bytes by their bytes: an open hash table of two 64-bit halves."""

    def __init__(self, bits: int = 17):
        self.size, self.used = 1 << bits, 0
        self.low, self.high = np.zeros(self.size, np.uint64), np.zeros(self.size, np.uint64)
        self.number = np.full(self.size, -1, np.int32)

    def _slots(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return (mix(low ^ mix(high)) & np.uint64(self.size - 1)).astype(np.int64)

    def find(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Each word's number; -1 if it is new."""
        out, at, slot = np.full(len(low), -1, np.int64), np.arange(len(low)), self._slots(low, high)
        while len(at):
            number = self.number[slot]
            hit = (self.low[slot] == low) & (self.high[slot] == high) & (number >= 0)
            out[at[hit]] = number[hit]
            on = (number >= 0) & ~hit
            at, low, high, slot = at[on], low[on], high[on], (slot[on] + 1) & (self.size - 1)
        return out

    def add(self, low: np.ndarray, high: np.ndarray, number: np.ndarray) -> None:
        """Take in distinct new words."""
        if 2 * (self.used + len(low)) > self.size:
            old, full = self, self.number >= 0
            kept = old.low[full], old.high[full], old.number[full]
            self.__init__(int(2 * (self.used + len(low))).bit_length())
            self.add(*kept)
        self.used += len(low)
        slot = self._slots(low, high)
        while len(low):
            free = np.flatnonzero(self.number[slot] < 0)
            won = free[np.unique(slot[free], return_index=True)[1]]
            self.low[slot[won]], self.high[slot[won]], self.number[slot[won]] = low[won], high[won], number[won]
            on = np.ones(len(low), bool)
            on[won] = False
            low, high, number, slot = low[on], high[on], number[on], (slot[on] + 1) & (self.size - 1)


class WordwiseTokenizer:
    """Ids as ``Tokenizer.encode(text, add_special_tokens=False)`` gives them.

    A text may be cut before a blank that stands between two other characters, around a single line end, and between a
    letter and a sign other than an apostrophe: the pre-tokenizers of the files used here never let a piece reach over
    such a place. Words are encoded by the library once and then looked up. A tokenizer
    file that does not pass a try-out of this encodes whole texts, and so are texts that spell one of its added tokens.
    The memory is bounded: at ``most`` words, or 32 MB of them (some 200 MB with their ids), it starts anew.
    """

    def __init__(self, path: str, most: int = 1_500_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.most = most
        # A word of letters alone is one piece for the pre-tokenizers: the model can take it directly. Tried out first.
        self.model = self.tokenizer.model
        self.lower = self.tokenizer.normalizer is not None
        self.blank = "" if self.lower else VISIBLE[32]
        self.direct = [self._ids(w, m) for m in (True, False) for w in TRIED_WORDS] == [e.ids for e in self._encode([m + w for m in ("\0", "") for w in TRIED_WORDS])]
        self.whole = False
        self._reset()
        ids, counts = self.encode(pa.array(TRIED_TEXTS))
        self.whole = [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] != [self.tokenizer.encode(t, add_special_tokens=False).ids for t in TRIED_TEXTS]
        self._reset()

    def _reset(self) -> None:
        self.known: dict[str, int] = {}
        self.short = _ShortWords()
        self.ids = np.empty(1 << 16, np.uint32)
        self.words = self.used = self.chars = 0
        self.offset, self.count = np.empty(1 << 14, np.int64), np.empty(1 << 14, np.int64)

    def _encode(self, words: list[str]) -> list:
        return self.tokenizer.encode_batch_fast([w[1:] if w[0] == "\0" else " " + w for w in words], add_special_tokens=False)

    def _ids(self, bare: str, alone: bool) -> list[int]:
        """Ids of a word of Latin-1 letters, without a blank before it or with one, from the model."""
        if self.lower:
            bare = bare.lower()
        if not bare.isascii():
            bare = bare.encode().decode("latin-1").translate(VISIBLE)
        return [t.id for t in self.model.tokenize(bare if alone else self.blank + bare)]

    def _learn(self, words: list[str]) -> np.ndarray:
        """Encode new words; their numbers. A word stands as it follows a blank; a NUL before it stands for no blank."""
        ids: list[list[int]] = []
        rest: list[str] = []
        for w in words:
            bare = w[1:] if w[0] == "\0" else w
            if self.direct and bare.isalpha() and (bare.isascii() or max(bare) < "Ā"):
                ids.append(self._ids(bare, bare is not w))
            else:
                ids.append([])
                rest.append(w)
        if rest:
            other = iter(self._encode(rest))
            ids = [x or next(other).ids for x in ids]
        return self._take_in(ids, sum(map(len, words)))

    def _take_in(self, ids: list[list[int]], chars: int) -> np.ndarray:
        counts = np.fromiter(map(len, ids), np.int64, len(ids))
        k, n, total = self.words, len(ids), int(counts.sum())
        while self.used + total > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty_like(self.ids)])
        while k + n > len(self.offset):
            self.offset, self.count = (np.concatenate([x, np.empty_like(x)]) for x in (self.offset, self.count))
        self.ids[self.used : self.used + total] = np.fromiter(chain.from_iterable(ids), np.uint32, total)
        self.offset[k : k + n], self.count[k : k + n] = self.used + np.cumsum(counts) - counts, counts
        self.used += total
        self.words += n
        self.chars += chars
        return np.arange(k, k + n)

    @staticmethod
    def _cut(text: str) -> list[str]:
        """Words between single blanks, a word without a blank before it marked by NUL; other blanks stay inside a word."""
        if not text:
            return []
        if "\0" in text:
            return ["\0" + text]
        if text[0] == " " or text[-1] == " " or "  " in text or any(c in text and (f" {c}" in text or f"{c} " in text) for c in (BLANKS[:9] if text.isascii() else BLANKS)):
            words = text.split(" ")
            joined = [words[0]]
            for w in words[1:]:
                last = joined[-1]
                if last and w and not last[-1].isspace() and not w[0].isspace():
                    joined.append(w)
                else:
                    joined[-1] = f"{last} {w}"
            joined[0] = "\0" + joined[0]
            return joined
        return ("\0" + MARK.sub(r" \0\1", text)).split(" ")

    def _numbers_of(self, words: list[str]) -> np.ndarray:
        at = np.fromiter(map(self.known.get, words, repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(at < 0).tolist()
        for lo in range(0, len(new), 50_000):
            fresh = [w for w in dict.fromkeys(words[i] for i in new[lo : lo + 50_000]) if w not in self.known]
            self.known.update(zip(fresh, self._learn(fresh).tolist(), strict=True))
        at[new] = np.fromiter((self.known[words[i]] for i in new), np.int64, len(new))
        return at

    def _odd_texts(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Texts with blanks of other kinds than single ones and line ends between words, or with an added token's text."""
        blank = (data == 32) | (data == 10)
        bad = _odd_bytes[data]
        bad[:-1] |= blank[:-1] & blank[1:]
        at = np.flatnonzero((data == 0xC2) | (data >= 0xE1) & (data <= 0xE3))
        at = at[at + 2 < len(data)]
        one, two, three = data[at], data[at + 1], data[at + 2]
        spaces = (one == 0xC2) & ((two == 0x85) | (two == 0xA0)) | (one == 0xE1) & (two == 0x9A) & (three == 0x80) | (one == 0xE3) & (two == 0x80) & (three == 0x80)
        spaces |= (one == 0xE2) & ((two == 0x80) & ((three <= 0x8A) | (three == 0xA8) | (three == 0xA9) | (three == 0xAF)) | (two == 0x81) & (three == 0x9F))
        bad[at[spaces]] = True
        filled = np.flatnonzero(bounds[1:] > bounds[:-1])
        bad[bounds[filled]] |= blank[bounds[filled]]
        bad[bounds[filled + 1] - 1] |= blank[bounds[filled + 1] - 1]
        if len(data) > 1:
            bad[-2:] |= data[-2] == 0xC2  # too near the end to have been looked at
        raw = data.tobytes()
        for token in self.added:
            content = token.encode()
            at = raw.find(content)
            while at >= 0:
                bad[at] = True
                at = raw.find(content, at + 1)
        return np.unique(np.searchsorted(bounds, np.flatnonzero(bad), "right") - 1)

    def _short_numbers(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, blank: np.ndarray) -> np.ndarray:
        """Numbers of the words data[start:end]; ``blank``: one stands before it."""
        sizes = ends - starts
        out = np.empty(len(starts), np.int64)
        windows = np.ndarray((len(data) - 15,), "<u8", data, strides=(1,))  # data ends with 16 spare bytes
        short = np.flatnonzero(sizes <= SHORT)
        a, n = starts[short], sizes[short]
        low = windows[a] & _masks[np.minimum(n, 8)]
        high = windows[np.minimum(a + 8, len(windows) - 1)] & np.where(n > 8, _masks[np.maximum(n - 8, 0)], np.uint64(0))
        high |= (n * 2 + blank[short]).astype(np.uint64) << np.uint64(56)
        found = self.short.find(low, high)
        new = np.flatnonzero(found < 0)
        raw = data.tobytes()

        def words(at: np.ndarray) -> list[str]:
            return [raw[i:j].decode() if b else "\0" + raw[i:j].decode() for i, j, b in zip(starts[at].tolist(), ends[at].tolist(), blank[at].tolist(), strict=True)]

        if len(new):
            by = new[np.lexsort((low[new], high[new]))]
            distinct = np.concatenate([[True], (low[by[1:]] != low[by[:-1]]) | (high[by[1:]] != high[by[:-1]])])
            first = by[distinct]
            numbers = np.concatenate([self._learn(words(short[first[k : k + 50_000]])) for k in range(0, len(first), 50_000)])
            self.short.add(low[first], high[first], numbers)
            found[by] = numbers[np.cumsum(distinct) - 1]
        out[short] = found
        long = np.flatnonzero(sizes > SHORT)
        if len(long):
            out[long] = self._numbers_of(words(long))
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other (uint32), and each text's number of ids; a null text has none."""
        column = texts.fill_null("").cast(pa.large_binary())
        if self.words > self.most or self.chars > 32 << 20:
            self._reset()
        bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        buffer = column.buffers()[2]
        data = np.frombuffer(buffer, np.uint8)[bounds[0] : bounds[-1]] if buffer is not None and len(column) else np.empty(0, np.uint8)
        bounds = bounds - bounds[0]
        odd = np.flatnonzero(np.diff(bounds)) if self.whole else self._odd_texts(data, bounds) if len(data) else np.empty(0, np.int64)
        # A word starts at a text's start, behind a blank, at and behind a line end, and at a sign behind a letter.
        begins = np.zeros(len(data) + 1, bool)
        begins[1:] = (data == 32) | (data == 10)
        begins[:-1] |= data == 10
        begins[1:-1] |= _signs[data[1:]] & _letters[data[:-1]]
        begins[bounds[:-1]] = True
        starts = np.flatnonzero(begins[: len(data)])
        firsts = np.zeros(len(data) + 1, bool)
        firsts[bounds[:-1]] = True
        blank = (starts > 0) & (data[np.maximum(starts - 1, 0)] == 32) & ~firsts[starts]
        ends = np.append(starts[1:] - blank[1:], len(data)) if len(starts) else starts
        owner = np.searchsorted(bounds, starts, "right") - 1
        if len(odd):
            usual = ~np.isin(owner, odd)
            starts, ends, blank, owner = starts[usual], ends[usual], blank[usual], owner[usual]
        at = self._short_numbers(np.concatenate([data, np.zeros(16, np.uint8)]), starts, ends, blank) if len(starts) else np.empty(0, np.int64)
        if len(odd):
            parts, owners = [at], [owner]
            for k in odd.tolist():
                text = data[bounds[k] : bounds[k + 1]].tobytes().decode()
                if self.whole or any(t in text for t in self.added):
                    parts.append(self._take_in([self.tokenizer.encode(text, add_special_tokens=False).ids], len(text)))
                else:
                    parts.append(self._numbers_of(self._cut(text)))
                owners.append(np.full(len(parts[-1]), k))
            at, owner = np.concatenate(parts), np.concatenate(owners)
            order = np.argsort(owner, kind="stable")
            at, owner = at[order], owner[order]
        lengths = self.count[at]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        flat = self.ids[np.repeat(self.offset[at] - (ends - lengths), lengths) + np.arange(total)]
        return flat, np.bincount(owner, weights=lengths, minlength=len(column)).astype(np.int64)


_loaded: dict[str, WordwiseTokenizer] = {}


def tokenizer(path: str, most: int = 1_500_000) -> WordwiseTokenizer:
    """One per worker and file."""
    if path not in _loaded:
        _loaded.clear()
        _loaded[path] = WordwiseTokenizer(path, most)
    _loaded[path].most = most
    return _loaded[path]


def forget() -> None:
    """Let go of the tokenizer and its words: other stages share the worker."""
    _loaded.clear()


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
