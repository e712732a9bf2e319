"""BPE encoding and decoding by a tokenization automaton.

The merges are compiled, in order, into a deterministic automaton over tokens that accepts exactly the canonical token
sequences. It begins as one state with a loop for each symbol. The gadget of a merge (u, v) -> w splits the target of arc v off as the
target of a new arc w (a copy, with all arcs it has by then), gives arc w to every state from which u and then v could be followed, and
takes arc v from the target of u. After all gadgets the target of an arc depends on its token alone, so a state is named by a token.

The table. Which states get arc w is which have arc u by then, so w's column is a copy of u's, and later gadgets that take u away leave w.
Tokens are numbered in pre-order of the tree "u is the first part of w", later born ones first: the columns that a gadget takes
from a state are then one range, and the successive gadgets are a row copy and a range of bits each. States with equal rows are one, and
neighbours with equal columns.

Encoding walks a trie of the arcs' labels over the symbols of all words at once: position by position, the arc that ends
there is the one whose start was reached by a token that it may follow (a bit of the table). Exactly one path spells
the whole word. Decoding emits the labels of the arcs taken.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._shared import bound_arrow, give_back, text_slices, utf8
from .words import Lexicon, check_vocabulary, segments

#: Words that are walked at once, and symbols from which on a word is walked alone.
WALK_WORDS, LONG_WORD = 8192, 48
#: Byte-level vocabularies write bytes as printable characters: bytes without one of their own get 256 and up, in order.
BYTE_SYMBOLS = {b: 256 + k for k, b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174))}


class Automaton:
    """The compiled automaton of a merge list: arrays only, once built."""

    def __init__(self, vocab: dict[str, int], merges: list, word_end: str = ""):
        cut = len(word_end)
        body = {i: t[: len(t) - cut] if cut and t.endswith(word_end) else t for t, i in vocab.items()}
        ends = {i for t, i in vocab.items() if cut and t.endswith(word_end)}
        self.label = {i: t for t, i in vocab.items()}
        self.word_end = word_end
        symbols = sorted({t for i, t in body.items() if len(t) == 1})
        self.symbol = {c: k for k, c in enumerate(symbols)}
        steps: dict[tuple[int, int], int] = {}
        for m in merges:
            a, b = m.split(" ") if isinstance(m, str) else m
            steps.setdefault((vocab[a], vocab[b]), vocab[a + b])
        if len(set(steps.values())) < len(steps):
            raise ValueError("a token that two merges make has no state of its own")
        dead = self._compile(steps, max(vocab.values()) + 1, {i for i in body if i not in ends})
        self._trie({i: t for i, t in body.items() if i not in dead}, ends)
        self.size = np.array([len(body.get(i, "")) for i in range(max(vocab.values()) + 1)], np.int32)

    def _compile(self, steps: dict[tuple[int, int], int], n: int, open_: set[int]) -> set[int]:
        """The table's bits, by the gadgets in order; the tokens that no path can take."""
        born = {w: k for k, w in enumerate(steps.values())}
        heirs: dict[int, list[int]] = {}
        for (u, _), w in steps.items():
            heirs.setdefault(u, []).append(w)  # in order of birth
        size, column = np.ones(n, np.int64), np.zeros(n, np.int64)
        for (u, _), w in reversed(steps.items()):
            size[u] += size[w]
        at = 0
        for i in range(n):  # roots one after another, below each its heirs, the latest born first
            if i not in born:
                column[i], at = at, at + size[i]
        for (u, _), _w in steps.items():
            if u in heirs:
                place = column[u] + 1
                for w in reversed(heirs.pop(u)):
                    column[w] = place
                    place += size[w]
        later = np.zeros(n, np.int64)  # sizes of the heirs that are still to be born
        for (u, _), w in steps.items():
            later[u] += size[w]
        takes = []
        for (u, v), w in steps.items():
            takes.append((int(column[v]), int(column[v] + 1 + later[v])))
            later[u] -= size[w]
        edges = np.unique(np.array([(0, n), *takes]))
        takes = np.searchsorted(edges, np.array(takes).reshape(-1, 2)).tolist()  # columns between two edges are equal: one column
        self.column = (np.searchsorted(edges, column, side="right") - 1).astype(np.int32)
        place_of = self.column.tolist()
        self.width = (len(edges) + 7) // 8
        row = {i: k for k, i in enumerate(sorted(open_))}
        bits = np.zeros((len(row) + 1, self.width), np.uint8)  # missing arcs; the last row is that of the start
        dead: set[int] = set()
        for ((u, v), w), (a, b) in zip(steps.items(), takes, strict=True):
            at = place_of[v]
            if u not in row or u in dead or v in dead or bits[row[u], at >> 3] >> (7 - (at & 7)) & 1:
                dead.add(w)
            if w in row:
                bits[row[w]] = bits[row[v]]
            if u in row:
                _fill(bits[row[u]], a, b)
        known: dict[bytes, int] = {}
        first = []
        self.state = np.full(n + 1, -1, np.int32)  # the row of each token, that of the start at -1
        for i, k in [*row.items(), (n, len(row))]:
            self.state[i] = known.setdefault(hashlib.blake2b(bits[k], digest_size=16).digest(), len(known))
            if len(known) > len(first):
                first.append(k)
        self.missing = bits[first].ravel()
        return dead

    def _trie(self, body: dict[int, str], ends: set[int]) -> None:
        """Nodes of the labels' trie; inner, the token that ends at a node inside a word; final, at the word's end.

        A node with one child holds its symbol and place; the others have rows of a table.
        """
        child: dict[tuple[int, int], int] = {}
        inner, final = [-1], [-1]
        for i, t in body.items():
            node = 0
            for c in t:
                if c not in self.symbol:
                    node = -1
                    break
                key = (node, self.symbol[c])
                node = child.setdefault(key, len(inner))
                if node == len(inner):
                    inner.append(-1)
                    final.append(-1)
            if node > 0:
                (final if i in ends else inner)[node] = i
        keys = np.array(list(child), np.int64).reshape(-1, 2)
        to = np.fromiter(child.values(), np.int32, len(child))
        many = np.bincount(keys[:, 0], minlength=len(inner))
        one = many[keys[:, 0]] == 1
        self.only, self.next = np.full(len(inner), -1, np.int32), np.full(len(inner), -1, np.int32)
        self.only[keys[one, 0]], self.next[keys[one, 0]] = keys[one, 1], to[one]
        self.row = np.where(many > 1, np.cumsum(many > 1) - 1, -1).astype(np.int32)
        self.rows = np.full((int((many > 1).sum()) + 1, max(1, len(self.symbol))), -1, np.int32)
        self.rows[self.row[keys[~one, 0]], keys[~one, 1]] = to[~one]
        self.inner = np.array(inner, np.int32)
        self.final = np.array(final, np.int32) if self.word_end else self.inner

    def child(self, node: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """The nodes below, -1 where there is none."""
        return np.where(self.only[node] == symbol, self.next[node], self.rows[self.row[node], symbol])

    def follows(self, last: np.ndarray, token: np.ndarray) -> np.ndarray:
        """The table: whether the state of each last token (-1: the start) has an arc for the token."""
        at = self.column[token]
        return self.missing[self.state[last].astype(np.int64) * self.width + (at >> 3)] >> (7 - (at & 7)).astype(np.uint8) & 1 == 0

    def walk(self, symbols: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of words (symbols[start : start + size]) in a row, and how many each has. Words go by in step, the longest first."""
        order = np.argsort(-sizes, kind="stable")
        first, n = starts[order], sizes[order]
        most = int(n[0]) if len(n) else 0
        last = np.full((len(n), most + 1), -1, np.int32)
        for j in range(most):
            some = np.arange(np.searchsorted(-n, -j))  # words longer than j
            if j:
                some = some[last[some, j] >= 0]
            node, pos = np.zeros(len(some), np.int32), j
            while len(some):
                node = self.child(node, symbols[first[some] + pos])
                on = node >= 0
                some, node, pos = some[on], node[on], pos + 1
                whole = n[some] == pos
                token = np.where(whole, self.final[node], self.inner[node])
                at = np.flatnonzero(token >= 0)
                at = at[self.follows(last[some[at], j], token[at])]
                last[some[at], pos] = token[at]
                some, node = some[~whole], node[~whole]
        back, where, steps = np.arange(len(n)), n.astype(np.int64), []
        counts = np.zeros(len(n), np.int64)
        while len(back):
            token = last[back, where[back]]
            if (token < 0).any():
                raise ValueError("the vocabulary lacks a symbol of a word")
            steps.append((back, token))
            counts[back] += 1
            where[back] -= self.size[token]
            back = back[where[back] > 0]
        in_order = np.empty_like(counts)
        in_order[order] = counts
        ends = np.cumsum(in_order)[order]
        flat = np.empty(counts.sum(), np.int32)
        for k, (rows, token) in enumerate(steps):
            flat[ends[rows] - 1 - k] = token
        return flat, in_order

    def walk_alone(self, symbols: list[int]) -> list[int]:
        """The tokens of one word, by the same tables: for words so long that others would wait for them."""
        n, last, token_of = len(symbols), [-1] * (len(symbols) + 1), (self.inner, self.final)
        for j in range(n):
            if j and last[j] < 0:
                continue
            node, pos, row = 0, j, int(self.state[last[j]]) * self.width
            while pos < n:
                node = int(self.next[node] if self.only[node] == symbols[pos] else self.rows[self.row[node], symbols[pos]])
                if node < 0:
                    break
                pos += 1
                token = int(token_of[pos == n][node])
                if token >= 0:
                    at = int(self.column[token])
                    if not self.missing[row + (at >> 3)] >> (7 - (at & 7)) & 1:
                        last[pos] = token
        out, pos = [], n
        while pos:
            if last[pos] < 0:
                raise ValueError("the vocabulary lacks a symbol of a word")
            out.append(last[pos])
            pos -= int(self.size[out[-1]])
        return out[::-1]

    def encode(self, word: str) -> list[int]:
        """The token ids on the path that spells a pre-split word (its byte symbols, without the word end)."""
        try:
            symbols = [self.symbol[c] for c in word]
        except KeyError as e:
            raise ValueError(f"the vocabulary lacks a symbol of {word!r}") from e
        if len(word) >= LONG_WORD:
            return self.walk_alone(symbols)
        return self.walk(np.array(symbols, np.int64), np.zeros(1, np.int64), np.array([len(word)]))[0].tolist() if word else []

    def decode(self, ids: list[int]) -> list[str]:
        """The labels of the arcs taken."""
        return [self.label[i] for i in ids]


def _fill(bits: np.ndarray, a: int, b: int) -> None:
    """Set the bits from a to b."""
    i, j = a >> 3, (b - 1) >> 3
    left, right = 0xFF >> (a & 7), 0xFF << (7 - ((b - 1) & 7)) & 0xFF
    if i == j:
        bits[i] |= left & right
        return
    bits[i] |= left
    bits[i + 1 : j] = 0xFF
    bits[j] |= right


class TextCoder:
    """Whole texts: splits them as the vocabulary asks, encodes their words by the automaton. Words met before are looked up by hash."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        check_vocabulary(spec)
        self.automaton = Automaton(model["vocab"], model["merges"], model["end_of_word_suffix"])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.automaton.label.update({i: t for t, i in self.special.items()})
        names = sorted(map(re.escape, self.special), key=len, reverse=True)
        self._cut = re.compile(f"({'|'.join(names)})") if names else None
        bare = spec | {"model": {"type": "BPE", "vocab": {}, "merges": []}, "added_tokens": []}
        splitter = Tokenizer.from_str(json.dumps(bare))  # its normaliser and pre-splitter, for odd chunks
        self._normal, self._split = splitter.normalizer, splitter.pre_tokenizer
        self._symbol = np.array([self.automaton.symbol.get(chr(BYTE_SYMBOLS.get(b, b)), 0) for b in range(256)])
        self.words = Lexicon(self._learn, self._odd)
        n = max(self.automaton.label) + 1
        self._id_text = pa.array([f" {i}".encode() for i in range(n)], pa.large_binary())
        self._label_text = pa.array([f" {self.automaton.label.get(i, '')}".encode() for i in range(n)], pa.large_binary())

    def _learn(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words (raw bytes) in a row, and their numbers."""
        sizes = np.array(list(map(len, words)), np.int64)
        symbols, starts = self._symbol[np.frombuffer(b"".join(words), np.uint8)], np.cumsum(sizes) - sizes
        if len(words) == 1 and sizes[0] >= LONG_WORD:
            ids = self.automaton.walk_alone(symbols.tolist())
            return np.array(ids, np.int32), np.array([len(ids)])
        got = [self.automaton.walk(symbols, starts[k : k + WALK_WORDS], sizes[k : k + WALK_WORDS]) for k in range(0, len(words), WALK_WORDS)]
        return np.concatenate([x for x, _ in got]), np.concatenate([n for _, n in got])

    def _odd(self, chunk: str) -> np.ndarray:
        """Ids of a chunk that the normaliser or the special tokens may change."""
        out: list[int] = []
        for part in self._cut.split(chunk) if self._cut else [chunk]:
            if part in self.special:
                out.append(self.special[part])
            elif part:
                for w, _ in self._split.pre_tokenize_str(self._normal.normalize_str(part)):
                    out += self.automaton.encode(w)
        return np.array(out, np.int32)

    def encode(self, text: str) -> list[int]:
        out = []
        for part in segments(text):
            slot, bounds = self.words.slots(*utf8(pa.array([part])))
            out += self.words.ids(slot, bounds)[0].tolist()
        return out

    def decode(self, ids: list[int]) -> str:
        return " ".join(self.automaton.decode(ids))

    def digests(self, column: pa.Array) -> list[tuple[int, str, str]]:
        """For each text: number of ids, SHA-256 of the ids in decimal (one space between), SHA-256 of the decoded text."""
        if len(column) == 1:  # perhaps a long one, which goes by in parts
            n, of_ids, of_labels = 0, hashlib.sha256(), hashlib.sha256()
            for part in segments(column[0].as_py() or ""):
                ids, _ = self.words.ids(*self.words.slots(*utf8(pa.array([part]))))
                of_ids.update(_written(self._id_text, ids)[0][0 if n else 1 :])  # no space before the first
                of_labels.update(_written(self._label_text, ids)[0][0 if n else 1 :])
                n += len(ids)
            return [(n, of_ids.hexdigest(), of_labels.hexdigest())]
        ids, bounds = self.words.ids(*self.words.slots(*utf8(column)))
        hexes = []
        for texts in (self._id_text, self._label_text):
            data, offs = _written(texts, ids)
            cuts = offs[bounds].tolist()
            hexes.append([hashlib.sha256(data[a + 1 : b]).hexdigest() for a, b in zip(cuts[:-1], cuts[1:], strict=True)])
        return list(zip(np.diff(bounds).tolist(), *hexes, strict=True))


def _written(texts: pa.Array, ids: np.ndarray) -> tuple[memoryview, np.ndarray]:
    """The texts of the ids in a row, and the place of each."""
    got = texts.take(pa.array(ids))
    return memoryview(got.buffers()[2] or b""), np.frombuffer(got.buffers()[1], np.int64)


_CODERS: dict[str, TextCoder] = {}


def coder(path: str) -> TextCoder:
    """One coder for each vocabulary in a worker."""
    if path not in _CODERS:
        _CODERS[path] = TextCoder(path)
        give_back()  # what compiling took
    return _CODERS[path]


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (array<int>), decoded of every row of docs: the automaton's ids of the whole text and the text they spell.

    Null and empty texts have no ids. Rows and ids may repeat; other columns are left out. An empty table gives no rows. A long text
    goes by in parts cut at blanks, so beside its ids a worker holds some tens of bytes for each byte of a part.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(path)
        for batch in batches:
            for part in text_slices(batch):
                ids = [own.encode(x.as_py() or "") for x in part.column("text")]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, pa.list_(pa.int32())), pa.array([own.decode(x) for x in ids])], ["doc_id", "ids", "decoded"])

    bound_arrow(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def encode_digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row: what encode() gives, as lengths and digests only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(path)
        for batch in batches:
            for part in text_slices(batch):
                got = own.digests(part.column("text"))
                cols = [pa.array([g[k] for g in got], kind) for k, kind in enumerate((pa.int64(), pa.string(), pa.string()))]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *cols], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        give_back()

    bound_arrow(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
