"""Document fingerprints: MinHash over word shingles, in vectorised numpy; signature bands joined in Spark, Jaccard verified.

PERMS universal hashes (multiply, add, keep the high 32 of 64 bits) run over a text's 5-word shingles; a fingerprint is the
least value of each. The share of equal values estimates the shingle sets' Jaccard similarity (standard error at most
0.5 / sqrt(PERMS)).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import NOT_BLANK, Workspace, add_columns, bound_arrow, shingles, text_slices, utf8, word_hashes, word_spans
from .buckets import link_buckets

PERMS = 256
SHINGLE = 5
#: Bands of ROWS values: texts of similarity 0.8 meet in one of 32 bands of 8 with probability 0.997.
BANDS, ROWS = 32, 8
SIMILAR = 0.8
#: Ranges of ids for each shuffle partition.
RANGES = 3

_RNG = np.random.default_rng(1729)
_A = _RNG.integers(0, 1 << 63, PERMS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 1 << 63, PERMS, dtype=np.uint64)
_STEP = 1 << 15


def shingle_sets(column: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all texts' shingles (words are runs without ASCII blanks, A-Z in lower case), and the texts' bounds."""
    data, offs = utf8(column)
    starts, ends, bounds = word_spans(data, offs, NOT_BLANK)
    return shingles(word_hashes(data, starts, ends), bounds, size)


def signatures(column: pa.Array) -> np.ndarray:
    """A row of PERMS 32-bit values for each text; a text without words has the largest value throughout."""
    hashes, bounds = shingle_sets(column)
    x = hashes >> np.uint64(32)
    out = np.full((len(column), PERMS), np.iinfo(np.uint64).max)
    row = np.searchsorted(bounds, np.arange(0, len(x), _STEP), side="right") - 1
    for at, first in zip(range(0, len(x), _STEP), row, strict=True):  # parts that fit the cache
        part = x[at : at + _STEP]
        cut = bounds[(bounds > at) & (bounds < at + len(part))]
        cut = np.unique(np.concatenate([[0], cut - at]))
        rows = np.searchsorted(bounds, cut + at, side="right") - 1
        for k in range(PERMS):
            h = part * _A[k]
            h += _B[k]
            out[rows, k] = np.minimum(out[rows, k], np.minimum.reduceat(h, cut))
    return (out >> np.uint64(32)).astype(np.uint32)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a == b).mean(axis=-1)


def _hex(sig: np.ndarray) -> list[str]:
    return [s.tobytes().hex() for s in sig.astype(">u2")]


def fingerprints(docs: DataFrame) -> DataFrame:
    """docs with signature (array<long> of PERMS values) for every row; a null text is empty. Other columns pass."""
    return add_columns(docs, lambda: lambda part: [list(signatures(part.column("text")).astype(np.int64))], "signature array<bigint>")


def _jaccard(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array([len(np.intersect1d(x, y, True)) / max(1, len(np.union1d(x, y))) for x, y in ((np.frombuffer(p.as_py(), np.uint64), np.frombuffer(q.as_py(), np.uint64)) for p, q in zip(a, b, strict=True))], pa.float64())


def near_duplicates(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """doc_id, component_id (the smallest doc_id reachable) for every row of docs.

    Texts meet where a band of their signatures is equal and are linked if the Jaccard similarity of their 5-word shingle
    sets is `similar` or more. Texts with equal shingle sets are one node, those without words too. Repeated rows are
    kept; other columns are left out; an empty table gives no rows.
    """
    space = Workspace(docs.sparkSession, "minhash")

    def make():
        def work(part: pa.RecordBatch) -> list:
            hashes, bounds = shingle_sets(part.column("text"))
            sets = [np.unique(hashes[a:b]).tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            sig = signatures(part.column("text"))
            keys = [[int.from_bytes(hashlib.blake2b(band.tobytes(), digest_size=8).digest(), "big", signed=True) for band in s.reshape(BANDS, ROWS)] for s in sig]
            return [[int.from_bytes(hashlib.blake2b(x, digest_size=8).digest(), "big", signed=True) for x in sets], sets, keys]

        return work

    rows = space.keep(add_columns(docs.select("doc_id", "text"), make, "node bigint, cells binary, bands array<bigint>").drop("text"), "rows")
    nodes = space.keep(rows.groupBy("node").agg(F.count("*").alias("weight"), F.min("doc_id").alias("least"), F.any_value("cells").alias("cells"), F.any_value("bands").alias("bands")), "nodes")
    sets = nodes.select("node", "cells")
    alike = F.arrow_udf(_jaccard, "double")

    def verify(pairs: DataFrame) -> DataFrame:
        both = pairs.join(sets.select(F.col("node").alias("a"), F.col("cells").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("cells").alias("y")), "b")
        return both.withColumn("s", alike("x", "y")).where(F.col("s") >= similar).select("a", "b")

    comps = link_buckets(nodes.select("node", "weight", F.posexplode("bands").alias("t", "key")), verify, space)
    named = nodes.select("node", "least").join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    names = space.keep(named.join(named.groupBy("comp").agg(F.min("least").alias("component_id")), "comp").select("node", "component_id"), "names")
    return rows.select("doc_id", "node").join(names, "node").select("doc_id", "component_id")


def edit(text: str, following: str) -> str:
    """The text with its last floor(n / 2) code points replaced by the first as many, or all, of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def edited_pairs(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every row of docs.

    The following text is that of the next row in ascending doc_id, after the last that of the first. A fingerprint is written as the low
    16 bits of its values in hex; likenesses compare all 32.

    Ids are cut into ranges at approximate percentiles; a range's rows are sorted together and go by once. The first id of a
    range is also sent to the range before it (that of the first range to the last), so no row needs a second look. Null
    texts are empty. Rows of one id stand in the order of their texts; rows without an id come first. Other columns are
    left out; an empty table gives no rows.
    """
    spark = docs.sparkSession
    bound_arrow(spark)
    least = F.lit(int(np.iinfo(np.int64).min))
    rows = docs.select("doc_id", F.coalesce("doc_id", least).alias("at"), F.coalesce("text", F.lit("")).alias("text"))
    n = RANGES * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = rows.agg(F.percentile_approx("at", [k / n for k in range(1, n)] or [0.5], max(10_000, 10 * n)).alias("c")).first().c
    cuts = np.unique(np.array(cuts or [], np.int64))
    in_range = F.arrow_udf(lambda at: pa.array(np.searchsorted(cuts, at.to_numpy(zero_copy_only=False), side="right").astype(np.int32)), "int")
    heads = rows.select("at", in_range("at").alias("r")).groupBy("r").agg(F.min("at").alias("head")).orderBy("r").collect()
    head = np.array([h["head"] for h in heads], np.int64)
    used = np.array([h.r for h in heads], np.int32)

    def targets(at: pa.Array) -> pa.Array:
        """The range of each id, and for the first id of a range also the range before."""
        ids = at.to_numpy(zero_copy_only=False)
        k = np.searchsorted(head, ids, side="right") - 1
        first = head[k] == ids
        offs = np.concatenate([[0], np.cumsum(1 + first)])
        out = np.empty(offs[-1], np.int32)
        out[offs[:-1]] = used[k]
        out[offs[1:][first] - 1] = used[k[first] - 1]
        return pa.ListArray.from_arrays(pa.array(offs.astype(np.int32)), pa.array(out))

    dealt = rows.select("doc_id", "at", "text", F.posexplode(F.arrow_udf(targets, "array<int>")("at")).alias("guest", "r"))
    dealt = dealt.repartition("r").sortWithinPartitions("r", "guest", "at", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last row so far, whose follower is still to come
        for batch in batches:
            for part in text_slices(batch):
                texts, ids, r, guest = (part.column(c).to_pylist() for c in ("text", "doc_id", "r", "guest"))
                sig = signatures(part.column("text"))
                if held:
                    texts, ids, r, guest = ([x, *y] for x, y in zip(held[:4], (texts, ids, r, guest), strict=True))
                    sig = np.concatenate([held[4], sig])
                held = (texts[-1], ids[-1], r[-1], guest[-1], sig[-1:])
                at = np.array([k for k in range(len(ids) - 1) if not guest[k] and r[k] == r[k + 1]], np.int64)
                if not len(at):
                    continue
                edited = [edit(texts[k], texts[k + 1]) for k in at]
                edited_sig = signatures(pa.array(edited))
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": pa.array([ids[k] for k in at], pa.int64()),
                        "n_chars": pa.array([len(texts[k]) for k in at], pa.int64()),
                        "edited_sha256": [hashlib.sha256(x.encode()).hexdigest() for x in edited],
                        "fingerprint": _hex(sig[at]),
                        "edited_fingerprint": _hex(edited_sig),
                        "near_edited": likeness(sig[at], edited_sig),
                        "near_next": likeness(sig[at], sig[at + 1]),
                    }
                )

    return dealt.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
