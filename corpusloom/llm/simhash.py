"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked within a few differing bits.

Pigeonhole blocks: a fingerprint is cut into BLOCKS blocks; two that differ in at most `most` bits agree in at least
BLOCKS - most whole blocks, so they meet under one of the keys made of that many blocks. Equal fingerprints are one node.

How buckets become components, hot ones too, is told in buckets.py.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import LOWER_TABLE, Workspace, add_columns, bound_arrow, give_back, text_slices
from .buckets import link_buckets

SHINGLE = 3
MOST_BITS = 3
BLOCKS = 6
SEED = 42


def fingerprint_of(text: str | None, size: int = SHINGLE) -> int:
    """The fingerprint of one text: words are runs without ASCII blanks, A-Z in lower case; no word gives zero."""
    words = (text or "").encode().translate(LOWER_TABLE).split()
    if not words:
        return 0
    total, n = np.zeros(64, np.int64), 0
    for i in range(0, max(1, len(words) - size + 1), 1 << 16):  # very long texts go by in parts
        part = words[i : i + (1 << 16) + size - 1]
        runs = map(b" ".join, zip(*(part[k:] for k in range(size)), strict=False)) if len(words) >= size else [b" ".join(words)]
        h = np.fromiter((xxhash.xxh64_intdigest(x, SEED) for x in runs), dtype=">u8")
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        n += len(h)
    return int.from_bytes(np.packbits(2 * total > n).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in text_slices(batch):
            fp = np.array([fingerprint_of(x.as_py()) for x in part.column("text")], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(fp.view(np.int64))], ["doc_id", "fp"])
    give_back()


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long) of every row; a null text has no words."""
    bound_arrow(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(_fingerprints, "doc_id long, fp long")


def block_masks(blocks: int = BLOCKS, most: int = MOST_BITS) -> list[int]:
    """Bit masks, one for each choice of blocks - most blocks, as signed longs."""
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    whole = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    return [signed(sum(c)) for c in combinations(whole, blocks - most)]


def finer_masks(blocks: int = BLOCKS, most: int = MOST_BITS) -> list[list[int]]:
    """For each of block_masks(), masks over the rest: two fingerprints of one key that differ in at most `most` bits agree under one of them.

    The rest is `most` blocks, cut in halves; `most` of these 2 * most halves are equal at least.
    """
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    span = lambda a, b: ((1 << (b - a)) - 1) << a
    out = []
    for kept in combinations(range(blocks), blocks - most):
        halves = [span(*h) for k in range(blocks) if k not in kept for h in ((edges[k], (edges[k] + edges[k + 1]) // 2), ((edges[k] + edges[k + 1]) // 2, edges[k + 1]))]
        out.append([signed(sum(c)) for c in combinations(halves, most)])
    return out


def linked(prints: DataFrame, space: Workspace, most: int = MOST_BITS, blocks: int = BLOCKS) -> DataFrame:
    """node, comp for every fingerprint of prints (fp, weight; each fingerprint once) that has a link to another one."""
    keys = F.array(*(F.col("fp").bitwiseAND(F.lit(m)) for m in block_masks(blocks, most)))
    entries = prints.select(F.col("fp").alias("node"), "weight", F.posexplode(keys).alias("t", "key"))
    finer = F.array(*(F.array(*map(F.lit, ms)) for ms in finer_masks(blocks, most)))
    within = lambda node, t: F.transform(F.element_at(finer, t + 1), lambda m: node.bitwiseAND(m))
    return link_buckets(entries, lambda pairs: pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= most), space, within)


def _prints(rows: DataFrame, *more) -> DataFrame:
    """fp, weight, least (smallest doc_id) and more aggregates of each fingerprint, dealt evenly: each row becomes as many as there are keys."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.groupBy("fp").agg(F.count("*").alias("weight"), F.min("doc_id").alias("least"), *more).repartition(n, "fp")


def near_duplicates(docs: DataFrame, most: int = MOST_BITS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable by links) for every row of docs.

    Texts without words have fingerprint zero and link like any other. A null doc_id never names a component unless it
    is alone in it; repeated ids and rows are kept. Other columns are ignored; an empty table gives no rows.
    """
    space = Workspace(docs.sparkSession, "simhash")
    rows = space.keep(fingerprints(docs), "rows")
    prints = space.keep(_prints(rows), "prints")
    comps = linked(prints.select("fp", "weight"), space, most)
    named = prints.join(comps.select(F.col("node").alias("fp"), "comp"), "fp", "left").withColumn("comp", F.coalesce("comp", "fp"))
    least = named.groupBy("comp").agg(F.min("least").alias("component_id"))
    names = space.keep(named.join(least, "comp").select("fp", "component_id"), "names")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return rows.join(names, "fp").select("doc_id", hexed.alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, most: int = MOST_BITS) -> DataFrame:
    """docs without near copies, with their columns: of each component one row of the smallest doc_id stays (of several, the first one read).

    Rows without a doc_id stay. Null and empty texts have fingerprint zero and are copies of each other. Column names cannot clash; an
    empty table gives no rows.
    """
    space = Workspace(docs.sparkSession, "near-copies")
    rest = [c for c in docs.columns if c != "text"]
    packed = docs.select("doc_id", "text", F.struct(*(F.col(f"`{c}`") for c in rest)).alias("row"), F.monotonically_increasing_id().alias("at"))

    def make():
        return lambda part: [np.array([fingerprint_of(x.as_py()) for x in part.column("text")], dtype=np.uint64).view(np.int64)]

    rows = space.keep(add_columns(packed, make, "fp bigint"), "rows")  # from here on a row has its number
    first = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "at"))).alias("first")
    prints = space.keep(_prints(rows.select("doc_id", "at", "fp"), first), "prints")
    comps = linked(prints.select("fp", "weight"), space, most)
    named = prints.join(comps.select(F.col("node").alias("fp"), "comp"), "fp", "left").withColumn("comp", F.coalesce("comp", "fp"))
    stays = named.groupBy("comp").agg(F.min("first").alias("stays"))
    names = space.keep(named.join(stays, "comp").select("fp", F.col("stays.at").alias("stays")), "names")
    gone = rows.where("doc_id is not null").select("at", "fp").join(names, "fp").where("at <> stays").select("at")
    left = rows.join(space.keep(gone, "gone"), "at", "left_anti")
    return left.select(*(F.col("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns))
