"""Pre-split words of whole slices of text, for vocabularies that lower-case, drop blanks and mark a word's end.

The pieces that such a vocabulary makes of a text (letters, single digits, runs of other characters, English contractions) are found for
all texts of a slice at once, on their UTF-8 bytes. That holds for ASCII and the letters of Latin-1, which no normal form changes; a
chunk between blanks with anything else, or with the beginning of a special string, is one odd piece and is split by its owner.

A Lexicon keeps what a worker has learnt of pieces: they are looked up by 64-bit hashes in an open-addressed table, for a slice at once.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np

from ._shared import _BYTES, ASCII_LOWER, NOT_BLANK, _range_hashes, word_spans

#: English contractions that are pieces of their own.
CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"
_ONE = np.isin(np.arange(256), [ord(x[1]) for x in CONTRACTIONS.split("|") if len(x) == 2])
_TWO = np.array(sorted(ord(x[1]) * 256 + ord(x[2]) for x in CONTRACTIONS.split("|") if len(x) == 3))
BLANK, LETTER, DIGIT, OTHER, STRANGE, ODD = range(6)
_KIND = np.full(256, STRANGE, np.uint8)
_KIND[33:127] = OTHER
_KIND[48:58] = DIGIT
_KIND[65:91] = _KIND[97:123] = _KIND[0x80:0xC0] = _KIND[0xC3] = LETTER
_KIND[~NOT_BLANK] = BLANK
#: Bytes of a piece that is looked up by its hash; longer ones are looked up as they are.
PIECE_BYTES = 64
#: Pieces that a lexicon holds, and ids of all of them, before it starts anew.
MOST_PIECES, MOST_IDS = 250_000, 4_000_000
#: Code points of a part of a long text.
PART = 1 << 20
_BLANK = re.compile("[ \t-\r]")


def check_vocabulary(spec: dict) -> None:
    """Raise for a vocabulary (its JSON) whose words pieces() does not find."""
    splits = [p.get("pattern", {}).get("Regex") for p in (spec["pre_tokenizer"] or {}).get("pretokenizers", [])]
    if not spec["model"].get("end_of_word_suffix") or splits[:1] != [CONTRACTIONS + r"|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"]:
        raise ValueError("only for vocabularies that lower-case, drop blanks and mark a word's end")


def segments(text: str, most: int = PART) -> Iterator[str]:
    """Parts of a long text, cut at blanks, of `most` code points or up to the next blank."""
    at = 0
    while len(text) - at > most:
        m = _BLANK.search(text, at + most)
        if not m:
            break
        yield text[at : m.start()]
        at = m.start()
    yield text[at:] if at else text


def pieces(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes in lower case, starts and ends of all pieces, which of them are odd, and the number of pieces before each text."""
    low, kind, n = ASCII_LOWER[data], _KIND[data], len(data)
    lead = np.flatnonzero(data == 0xC3)
    after = data[lead + 1]
    low[lead[(after < 0x9F) & (after != 0x97)] + 1] += 32
    kind[lead[(after == 0x97) | (after == 0xB7)]] = STRANGE
    at = np.flatnonzero(data[:-1] == ord("<"))
    kind[at[data[at + 1] == ord("|")]] = STRANGE
    strange = np.flatnonzero(kind == STRANGE)
    if len(strange):
        begins, ends, _ = word_spans(data, offs, NOT_BLANK)
        chunk = np.unique(np.searchsorted(begins, strange, side="right") - 1)
        size = ends[chunk] - begins[chunk]
        kind[np.repeat(begins[chunk] - np.cumsum(size) + size, size) + np.arange(size.sum())] = ODD
    shown = kind != BLANK
    first = shown.copy()
    first[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
    rows = offs[:-1][offs[:-1] < n]
    first[rows] = shown[rows]
    mark = np.flatnonzero((data == ord("'")) & first & (kind == OTHER))
    if len(mark):
        left = offs[np.searchsorted(offs, mark, side="right")] - mark  # bytes of the text from the mark on
        a, b = low[np.minimum(mark + 1, n - 1)], low[np.minimum(mark + 2, n - 1)]
        one = _ONE[a] & (left > 1)
        two = np.isin(a.astype(np.int64) * 256 + b, _TWO) & (left > 2)
        size = np.where(one, 2, np.where(two, 3, 0))
        mark, size, left = mark[size > 0], size[size > 0], left[size > 0]
        first[mark + 1] = False
        rest = (mark + size)[size < left]
        first[rest[kind[rest] == LETTER]] = True
    last = shown
    last[:-1] &= first[1:] | (kind[1:] == BLANK)
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return low, starts, ends, kind[starts] == ODD, np.searchsorted(starts, offs)


class Lexicon:
    """The ids of pieces met before. learn(words) gives the ids of distinct plain pieces in a row and their numbers, odd(chunk) the ids of an odd one."""

    def __init__(self, learn: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], odd: Callable[[str], np.ndarray], most: int = MOST_PIECES):
        self.learn, self.odd, self.most = learn, odd, most
        self.mask, self.age = (1 << max(4, (4 * most).bit_length())) - 1, 0
        self.clear()

    def clear(self) -> None:
        self.age += 1
        self.keys, self.place = np.zeros(self.mask + 1, np.uint64), np.zeros(self.mask + 1, np.int32)
        self.others: dict[bytes, int] = {}
        self.n = self.held = 0
        self.count, self.start = np.zeros(1024, np.int32), np.zeros(1024, np.int64)
        self.flat = np.zeros(4096, np.int32)

    def _find(self, h: np.ndarray) -> np.ndarray:
        out, todo, at = np.full(len(h), -1, np.int32), np.arange(len(h)), (h & np.uint64(self.mask)).astype(np.int64)
        while len(todo):
            key = self.keys[at]
            hit = key == h[todo]
            out[todo[hit]] = self.place[at[hit]]
            on = ~hit & (key != 0)
            todo, at = todo[on], (at[on] + 1) & self.mask
        return out

    def _put(self, h: np.ndarray, slots: np.ndarray) -> None:
        at = (h & np.uint64(self.mask)).astype(np.int64)
        while len(h):
            free = self.keys[at] == 0
            self.keys[at[free]] = h[free]
            mine = self.keys[at] == h  # of several for one cell the last stays
            self.place[at[mine]] = slots[mine]
            h, slots, at = h[~mine], slots[~mine], (at[~mine] + 1) & self.mask

    def _store(self, flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """New slots for ids in a row."""
        a, b = self.n, self.n + len(sizes)
        while len(self.count) < b:
            self.count, self.start = np.resize(self.count, 2 * len(self.count)), np.resize(self.start, 2 * len(self.start))
        while len(self.flat) < self.held + len(flat):
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        self.count[a:b], self.start[a:b] = sizes, self.held + np.cumsum(sizes) - sizes
        self.flat[self.held : self.held + len(flat)] = flat
        self.n, self.held = b, self.held + len(flat)
        return np.arange(a, b, dtype=np.int32)

    def slots(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The slot of every piece of the texts, and the number of pieces before each text. Slots hold until the next call."""
        if self.n > self.most or self.held > MOST_IDS:
            self.clear()
        low, starts, ends, odd, bounds = pieces(data, offs)
        h = _range_hashes(_BYTES[low], starts, ends)
        h[h == 0] = 1
        alone = odd | (ends - starts > PIECE_BYTES)
        slot = self._find(h)
        slot[alone] = -1
        for k in np.flatnonzero(alone).tolist():
            raw = data[starts[k] : ends[k]].tobytes()
            known = self.others.get(raw)
            if known is None:
                flat, sizes = (self.odd(raw.decode()), None) if odd[k] else self.learn([low[starts[k] : ends[k]].tobytes()])
                known = self.others[raw] = int(self._store(flat, np.array([len(flat)]) if sizes is None else sizes)[0])
            slot[k] = known
        new = np.flatnonzero(slot < 0)
        whole = low.tobytes() if len(new) else b""
        for k in range(0, len(new), 1 << 16):
            some = new[k : k + (1 << 16)]
            some = some[self._find(h[some]) < 0]
            kinds, at = np.unique(h[some], return_index=True)
            if len(at):
                words = [whole[a:b] for a, b in zip(starts[some[at]].tolist(), ends[some[at]].tolist(), strict=True)]
                self._put(kinds, self._store(*self.learn(words)))
        if len(new):
            slot[new] = self._find(h[new])
        return slot, bounds

    def ids(self, slot: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and the number of ids before each text."""
        size = self.count[slot].astype(np.int64)
        upto = np.concatenate([[0], np.cumsum(size)])
        return self.flat[np.repeat(self.start[slot] - upto[:-1], size) + np.arange(upto[-1])], upto[bounds]
