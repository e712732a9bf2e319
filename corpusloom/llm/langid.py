"""Language identification by error-correcting output codes.

Each language has a codeword; each bit of it is predicted by a binary logistic classifier over hashed character 1- to 3-grams
(frequencies, lower case, other characters than letters as one blank). Decoding adds up, for each codeword, the
logistic losses of its bits, each weighted by how well that classifier did on rows kept back from its fit, and chooses
the least; the score is the softmax of the negated losses, and a small lead over the second flags the text as ambiguous.

The classifiers learn from at most SAMPLE ids a language (the smallest hashes of doc_id) and ROWS in all, of the LANGS largest languages:
bounds for the driver's memory. The executors make their n-gram counts. Whole texts are scored, by table look-ups for all n-grams in numpy;
a text goes by whole, so a worker needs about 100 bytes for each byte of the longest one.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import Workspace, add_columns, least_hashed, mixed

BITS = 13
#: Rows that are learnt from at most: of a language, and in all (16 KB each on the driver); languages that are learnt at most.
SAMPLE, ROWS, LANGS = 400, 6000, 500
#: Lead of the best codeword in mean loss a bit below which a text is ambiguous.
LEAD = 0.15
UNKNOWN = "und"
GRAMS = 3


def codewords(n: int, seed: int = 11) -> np.ndarray:
    """n codewords of -1 and +1: all splits of few languages, else random bits chosen for the largest least distance."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= 5:  # exhaustive code: every split of the languages in two, once
        return np.array([[1.0 if k == 0 or not (m >> (k - 1)) & 1 else -1.0 for m in range(1, 1 << (n - 1))] for k in range(n)])
    rng, best, apart = np.random.default_rng(seed), None, -1.0
    size = int(np.ceil(10 * np.log2(n)))
    for _ in range(200):
        code = np.where(rng.random((n, size)) < 0.5, -1.0, 1.0)
        code = code[:, np.abs(code.sum(axis=0)) < n]
        near = (code.shape[1] - (code @ code.T - np.eye(n) * 2 * code.shape[1]).max()) / 2
        if near > apart:
            best, apart = code, near
    return best


def grams(text: str, bits: int = BITS) -> np.ndarray:
    """The cell of every 1- to GRAMS-gram of the letters of a text, words parted by one blank."""
    text = "".join([c if c.isalpha() else " " for c in text.lower()]) if not text.isascii() else text.lower().translate(_ASCII)
    x = np.frombuffer((" " + " ".join(text.split()) + " ").encode("utf-32-le"), np.uint32).astype(np.uint64)
    out, h = [], np.zeros(len(x), np.uint64)
    for n in range(1, GRAMS + 1):
        h = h[: len(x) - n + 1] * np.uint64(0x100000001B3) + x[n - 1 :] + np.uint64(n)
        out.append(mixed(h) >> np.uint64(64 - bits))
    return np.concatenate(out).astype(np.int64)


_ASCII = {c: " " for c in range(128) if not chr(c).isalpha()}


def has_letter(text: str | None) -> bool:
    return any(map(str.isalpha, text or ""))


class Codes:
    """The codewords, a linear classifier for each bit over gram frequencies, and the bits' weights."""

    def __init__(self, langs: list[str], code: np.ndarray, w: np.ndarray, bias: np.ndarray, trust: np.ndarray):
        self.langs, self.code, self.w, self.bias, self.trust = langs, code, w, bias, trust

    def margins(self, text: str) -> np.ndarray:
        cells = grams(text)
        return np.sqrt(np.bincount(cells, minlength=len(self.w)) / len(cells)) @ self.w + self.bias

    def decode(self, text: str | None) -> tuple[str, float, bool]:
        """The language, its score, and whether it is ambiguous; `und` with score 0 if there is no letter or nothing was learnt."""
        if not self.langs or not has_letter(text):
            return UNKNOWN, 0.0, True
        loss = np.logaddexp(0, -self.code * self.margins(text)) @ self.trust
        p = np.exp(-(loss - loss.min()) * len(self.trust))
        order = np.argsort(loss, kind="stable")
        lead = loss[order[1]] - loss[order[0]] if len(order) > 1 else np.inf
        return self.langs[order[0]], float(p[order[0]] / p.sum()), bool(lead < LEAD)


def held_back(langs: list[str]) -> np.ndarray:
    """Every fifth row of each language, however the rows are ordered."""
    seen: dict[str, int] = {}
    nth = np.zeros(len(langs), np.int64)
    for i, lang in enumerate(langs):
        nth[i] = seen.get(lang, 0)
        seen[lang] = nth[i] + 1
    return nth % 5 == 4  # the fifth, not the first: a language of few rows is learnt from all


def fit(rows: np.ndarray, langs: list[str], steps: int = 300) -> Codes:
    """Learn from gram frequencies (square roots, a row for each text) and their languages."""
    names = sorted(set(langs))
    code = codewords(len(names))
    if len(names) < 2:
        return Codes(names, code, np.zeros((1 << BITS, code.shape[1])), np.full(code.shape[1], 5.0), np.ones(code.shape[1]))
    y = code[np.searchsorted(names, langs)]
    back = held_back(langs)
    w, bias = np.zeros((rows.shape[1], code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    x, t = rows[~back].astype(np.float32), y[~back].astype(np.float32)
    if not len(x):
        x, t = rows.astype(np.float32), y.astype(np.float32)
    rate, gw, gb = np.float32(8.0), np.zeros_like(w), np.zeros_like(bias)
    for _ in range(steps):  # gradient descent with momentum, all bits at once
        g = -t / (1 + np.exp(t * (x @ w + bias))) / len(x)
        gw, gb = 0.9 * gw + x.T @ g + 1e-5 * w, 0.9 * gb + g.sum(axis=0)
        w, bias = w - rate * gw, bias - rate * gb
    held = rows[back] if back.any() else rows
    right = ((held @ w + bias) * y[back if back.any() else slice(None)] > 0).mean(axis=0)
    trust = np.maximum(2 * right - 1, 0.01)
    return Codes(names, code, w, bias, trust / trust.sum())


def learn(docs: DataFrame, allowed: Column | None = None, sample: int = SAMPLE) -> Codes:
    """Codes learnt from the rows of docs with text, lang and doc_id that are allowed.

    An id counts once in a language, whatever its repeats: with its text of least hash. More than LANGS languages: the largest. An
    empty table, or one without languages, gives codes that call every text `und`.
    """
    space = Workspace(docs.sparkSession, "langid")
    known = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("doc_id").isNotNull())
    known = (known.where(allowed) if allowed is not None else known).select(F.col("lang").cast("string").alias("lang"), "doc_id", "text")
    chosen = space.keep(least_hashed(known, "lang", sample, LANGS, space), "chosen")
    langs = chosen.select("lang").distinct().count()
    chosen = chosen.where(F.col("k") <= max(1, ROWS // max(1, langs)))
    texts = known.join(F.broadcast(chosen), ["lang", "doc_id"])  # ROWS at most
    texts = texts.groupBy("lang", "doc_id", "k").agg(F.min_by("text", F.xxhash64("text")).alias("text"))

    def make():
        def work(part: pa.RecordBatch) -> list:
            out = []
            for x in part.column("text"):
                cells = grams(x.as_py()) if has_letter(x.as_py()) else np.zeros(0, np.int64)
                out.append((np.bincount(cells, minlength=1 << BITS) / max(1, len(cells))).astype(np.float16).tobytes() if len(cells) else None)
            return [out]

        return work

    made = add_columns(texts, make, "cells binary").where("cells is not null").select("lang", "doc_id", "k", "cells")
    rows = made.collect()  # ROWS at most
    rows.sort(key=lambda r: (r.k, r.lang, r.doc_id))
    space.drop()
    x = np.sqrt(np.array([np.frombuffer(r.cells, np.float16) for r in rows], np.float32).reshape(len(rows), 1 << BITS))
    return fit(x, [r.lang for r in rows])


_CODES: dict[str, Codes] = {}


def identify(docs: DataFrame, codes: Codes) -> DataFrame:
    """docs with lang_pred, score (0 to 1) and ambiguous for every row (in place of columns of these names).

    A text that is null, or has no letter, is `und` with score 0. Rows may repeat; other columns pass. Only text is read.
    """
    name = uuid.uuid4().hex
    shared = docs.sparkSession.sparkContext.broadcast((codes.langs, codes.code, codes.w, codes.bias, codes.trust))

    def make():
        if name not in _CODES:
            _CODES.clear()
            _CODES[name] = Codes(*shared.value)

        def work(part: pa.RecordBatch) -> list:
            got = [_CODES[name].decode(x.as_py()) for x in part.column("text")]
            return [[g[k] for g in got] for k in range(3)]

        return work

    return add_columns(docs, make, "lang_pred string, score double, ambiguous boolean")


