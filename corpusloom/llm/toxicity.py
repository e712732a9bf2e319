"""Toxicity by a factorization machine over hashed terms.

Terms are words and word beginnings, present or not, hashed into 2^BITS cells. A text's score is

    sigmoid(bias + sum w[i] + 1/2 sum_f ((sum v[i,f])^2 - sum v[i,f]^2))

over its terms i: beside each term's weight, every pair of terms adds the product of their factors, so a word can
count only next to another one, or against it. Learnt are terms whose presence goes with the label beyond chance, so that long
texts gather no noise, and terms that do so only in pairs: of the most frequent ones every pair is tested for what both together tell
beside what each tells alone. Weights come from FTRL-proximal, factors from AdaGrad; a term of a pair has factors without a weight, too.

Labels come from a sample of at most SAMPLE ids (the smallest hashes of doc_id, a bound for the driver's memory);
their terms are hashed on the executors. Scoring reads whole texts in numpy, only terms with a weight or factors are counted; a worker
needs about 100 bytes for each byte of the longest text.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import ALNUM, Workspace, add_columns, least_hashed, mixed, text_slices, utf8, word_hashes, word_spans

BITS = 20
FACTORS = 8
#: Labelled ids that are learnt from at most.
SAMPLE = 12_000
#: Terms whose pairs are tested (those whose presence varies most), and the chi squared that tells a pair (chance alone: one in 20 million).
PAIR_TERMS, PAIR_EVIDENCE = 800, 30.0
#: Word beginnings, in bytes, that are terms of their own.
STEMS = (4, 5, 6, 7, 8)
EPOCHS = 8
#: Terms that are learnt at most (the strongest; chance leaves far fewer), and tasks that the sample is dealt to.
MOST_TERMS, SPREAD = 20_000, 24
#: G squared that a term's association with the label must exceed to be learnt (chance alone: one term in 200,000).
EVIDENCE = 21.0


def terms(column: pa.Array, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Row and cell of every term of every text, in no order, with repeats."""
    data, offs = utf8(column)
    starts, ends, bounds = word_spans(data, offs, ALNUM)
    row = np.repeat(np.arange(len(column)), np.diff(bounds))
    parts = [(row, word_hashes(data, starts, ends))]
    for k in STEMS:
        longer = ends - starts > k
        parts.append((row[longer], word_hashes(data, starts[longer], starts[longer] + k) + np.uint64(k)))
    cell = np.concatenate([mixed(h) >> np.uint64(64 - bits) for _, h in parts]).astype(np.int64)
    return np.concatenate([r for r, _ in parts]), cell


class Machine:
    """The weights: cells (sorted) with a weight, or with factors."""

    def __init__(self, bias: float, cells: np.ndarray, w: np.ndarray, v: np.ndarray, bits: int = BITS):
        self.bias, self.w, self.v, self.bits = bias, w, v, bits
        self.slot = np.full(1 << bits, -1, np.int32)
        self.slot[cells] = np.arange(len(cells), dtype=np.int32)

    def score(self, column: pa.Array) -> np.ndarray:
        row, cell = terms(column, self.bits)
        slot = self.slot[cell]
        live = slot >= 0
        pair = np.unique(row[live] * np.int64(max(1, len(self.w))) + slot[live])
        row, slot = np.divmod(pair, max(1, len(self.w)))
        n = len(column)
        linear = np.bincount(row, self.w[slot], n) if len(row) else np.zeros(n)
        cross = np.zeros(n)
        for f in range(self.v.shape[1]):
            x = self.v[slot, f]
            cross += np.bincount(row, x, n) ** 2 - np.bincount(row, x * x, n)
        return 1 / (1 + np.exp(-np.clip(self.bias + linear + 0.5 * cross, -30, 30)))


def evidence(df: Column, pos: Column, n: int, positives: int) -> Column:
    """G squared of a term's presence (in df of n documents, pos of them positive) and the label."""
    part = lambda seen, expected: F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)
    p = positives / n
    rest, rest_pos = n - df, positives - pos
    return 2 * (part(pos, df * p) + part(df - pos, df * (1 - p)) + part(rest_pos, rest * p) + part(rest - rest_pos, rest * (1 - p)))


def interactions(rows: list[np.ndarray], labels: np.ndarray, cells: np.ndarray, evidence: float = PAIR_EVIDENCE) -> np.ndarray:
    """Those of the cells (sorted) that are in a pair whose joint presence goes with the label, beside the presence of each.

    For cells with presences a, b: (sum (y - p) (a - mean a) (b - mean b))^2 over its variance p (1 - p) sum (a - mean a)^2 (b - mean b)^2.
    """
    y, n, m = np.asarray(labels, np.float32), len(rows), len(cells)
    at = [np.searchsorted(cells, r[np.isin(r, cells)]) for r in rows]
    mean = np.bincount(np.concatenate([*at, np.zeros(0, np.int64)]), minlength=m).astype(np.float32) / max(1, n)
    joint, spread = np.zeros((m, m), np.float32), np.zeros((m, m), np.float32)
    for k in range(0, n, 2048):  # rows that fit the memory
        x = np.zeros((len(at[k : k + 2048]), m), np.float32)
        for i, r in enumerate(at[k : k + 2048]):
            x[i, r] = 1
        x -= mean
        joint += x.T @ (x * (y[k : k + 2048] - y.mean())[:, None])
        x *= x
        spread += x.T @ x
    told = joint**2 > evidence * y.mean() * (1 - y.mean()) * spread
    np.fill_diagonal(told, False)
    return cells[told.any(axis=1)]


def fit(rows: list[np.ndarray], labels: np.ndarray, bits: int = BITS, factors: int = FACTORS, epochs: int = EPOCHS, seed: int = 7, paired: np.ndarray | None = None) -> Machine:
    """Learn from rows of distinct cells that are worth it; those of `paired` have factors even without a weight. Without both labels the machine gives their mean (or 0) for all texts."""
    y = np.asarray(labels, float)
    if not len(y) or y.min() == y.max():
        p = np.clip(y.mean() if len(y) else 0.0, 1e-3, 1 - 1e-3)
        return Machine(float(np.log(p / (1 - p))), np.zeros(0, np.int64), np.zeros(0), np.zeros((0, factors)), bits)
    rng = np.random.default_rng(seed)
    cells, flat = np.unique(np.concatenate([*rows, np.zeros(0, np.int64)]), return_inverse=True)
    bounds = np.cumsum([0, *map(len, rows)])
    rows = [flat[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    always = np.isin(cells, paired) if paired is not None else np.zeros(len(cells), bool)
    alpha, beta, l1, l2 = 0.5, 1.0, 0.1, 0.1
    z, n = np.zeros(len(cells)), np.zeros(len(cells))
    v, g2 = rng.normal(0, 0.01, (len(cells), factors)), np.full((len(cells), factors), 1e-3)
    bias, bias_n = float(np.log(y.mean() / (1 - y.mean()))), 1.0
    for epoch in range(epochs):
        for k in rng.permutation(len(y)):
            x = rows[k]
            zk, nk = z[x], n[x]
            w = np.where(np.abs(zk) <= l1, 0.0, -(zk - np.sign(zk) * l1) / ((beta + np.sqrt(nk)) / alpha + l2))
            live = x[(w != 0) | always[x]]
            vl = v[live] if epoch else v[live[:0]]
            total = vl.sum(axis=0)
            s = bias + w.sum() + 0.5 * ((total**2).sum() - (vl**2).sum())
            err = 1 / (1 + np.exp(-np.clip(s, -30, 30))) - y[k]
            bias_n += err * err
            bias -= 0.1 * err / np.sqrt(bias_n)
            z[x] += err - (np.sqrt(nk + err * err) - np.sqrt(nk)) / alpha * w
            n[x] += err * err
            if epoch and len(live) > 1:
                g = err * (total - vl) + 0.02 * vl
                g2[live] += g * g
                v[live] -= 0.05 * g / np.sqrt(g2[live])
    w = np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))
    live = (w != 0) | always
    return Machine(bias, cells[live], w[live], v[live], bits)


def learn(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = SAMPLE, allowed: Column | None = None) -> Machine:
    """A machine from the labels (doc_id, label) of docs.

    Rows without text, label or id are left out; an id with several labels has the largest, one with several texts that of
    least hash, so `sample` ids are `sample` rows. Empty tables, or labels of one kind, give a machine without terms.
    """
    space = Workspace(docs.sparkSession, "toxicity")
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("y"))
    known = known.where(allowed) if allowed is not None else known
    own = docs.where("text is not null and doc_id is not null").select("doc_id", "text")
    known = space.keep(known.join(own.select("doc_id"), "doc_id", "left_semi"), "known")
    chosen = least_hashed(known.withColumn("of", F.lit("all")), "of", sample, 1, space)
    chosen = known.join(F.broadcast(chosen.select("doc_id")), "doc_id")  # `sample` ids at most
    texts = own.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    texts = space.keep(texts.repartition(SPREAD), "sample")  # of bounded size, so all of it can be dealt out
    total = texts.agg(F.count("*").alias("n"), F.sum("y").alias("p")).first()
    if not total.n or total.p in (0, total.n):
        return fit([np.zeros(0, np.int64)] * total.n, np.full(total.n, int(bool(total.p))))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, pos = np.zeros(1 << BITS, np.int64), np.zeros(1 << BITS, np.int64)
        for batch in batches:
            for part in text_slices(batch):
                row, cell = _distinct(part)
                df += np.bincount(cell, minlength=1 << BITS)
                pos += np.bincount(cell[np.asarray(part.column("y"))[row] > 0], minlength=1 << BITS)
        at = np.flatnonzero(df)
        for k in range(0, len(at), 10_000):
            some = at[k : k + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(df[some]), pa.array(pos[some])], ["cell", "df", "pos"])

    counts = texts.mapInArrow(count, "cell long, df long, pos long").groupBy("cell").agg(F.sum("df").alias("df"), F.sum("pos").alias("pos"))
    counts = space.keep(counts, "counts")  # a row for each cell: 2^BITS at most
    strong = counts.withColumn("g", evidence(F.col("df"), F.col("pos"), total.n, total.p)).where(F.col("g") > EVIDENCE)
    varied = F.least("df", total.n - F.col("df"))
    often = counts.where(varied >= 20).orderBy(varied.desc(), "cell").limit(PAIR_TERMS).select("cell").collect()
    often = np.sort(np.array([r.cell for r in often], np.int64))
    told = np.zeros(1 << BITS, bool)
    told[[r.cell for r in strong.orderBy(F.col("g").desc(), "cell").limit(MOST_TERMS).select("cell").collect()]] = True
    alone = told.copy()
    told[often] = True
    told_cells = np.flatnonzero(told)

    def make():
        told = np.zeros(1 << BITS, bool)
        told[told_cells] = True

        def work(part: pa.RecordBatch) -> list:
            row, cell = _distinct(part)
            live = told[cell]
            row, cell = row[live], cell[live].astype(np.int32)
            at = np.searchsorted(row, np.arange(part.num_rows + 1))
            return [[cell[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]]

        return work

    rows = add_columns(texts, make, "cells binary").select("doc_id", "y", "cells").collect()  # `sample` rows at most, MOST_TERMS + PAIR_TERMS terms at most
    space.drop()
    rows.sort(key=lambda r: (r.doc_id, r.cells))
    cells, y = [np.frombuffer(r.cells, np.int32).astype(np.int64) for r in rows], np.array([r.y for r in rows])
    paired = interactions(cells, y, often)
    alone[paired] = True
    return fit([c[alone[c]] for c in cells], y, paired=paired)


def _distinct(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Row and cell of each distinct term of each text, in order."""
    row, cell = terms(part.column("text"))
    return np.divmod(np.unique((row << BITS) + cell), 1 << BITS)


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """docs with score (0 to 1) and predicted (1 if score >= 0.5) for every row (in place of columns of these names).

    A null or empty text has no terms: its score is the machine's bias. Rows may repeat; other columns pass.
    """
    name = uuid.uuid4().hex
    shared = docs.sparkSession.sparkContext.broadcast((machine.bias, np.flatnonzero(machine.slot >= 0), machine.w, machine.v, machine.bits))

    def make():
        if name not in _MACHINES:
            _MACHINES.clear()
            bias, cells, w, v, bits = shared.value
            _MACHINES[name] = Machine(bias, cells, w, v, bits)
        return lambda part: [_MACHINES[name].score(part.column("text"))]

    return add_columns(docs.drop("predicted"), make, "score double").withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


_MACHINES: dict[str, Machine] = {}


def held_out(doc_id: str = "doc_id", parts: int = 5, part: int = 0) -> Column:
    """Whether crc32 of the id as text leaves this remainder; a null id is held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(parts)) == part, F.lit(True))
