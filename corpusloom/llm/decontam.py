"""Benchmark decontamination by a broadcast hash set of the benchmark's n-grams.

Words are runs of ASCII letters, digits and anything beyond ASCII, A-Z in lower case. A window is 13 consecutive words of
an item, or a shorter item whole. Documents are scanned once: hashes of all their windows, by prefix sums over the
UTF-8 bytes, are looked up in a bitmap and a sorted array; each hit is verified word by word. A benchmark of more than
BLOCK_WINDOWS windows goes by in blocks, so what a worker holds stays bounded whatever the benchmark's size.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import ALNUM, LOWER_TABLE, Workspace, add_columns, utf8, window_hashes, word_hashes, word_spans

WINDOW = 13
#: A document is contaminated if at least this share of its words is hit: 1 of 20.
SHARE = 20
#: Benchmark windows that are broadcast at once (about 200 bytes each).
BLOCK_WINDOWS = 1_000_000

_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text: str | None) -> list[bytes]:
    return _WORD.findall((text or "").encode().translate(LOWER_TABLE))


def windows_of(text: str | None, size: int = WINDOW) -> list[bytes]:
    words = words_of(text)
    return [b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []


def _items(benchmark: DataFrame, size: int) -> DataFrame:
    """window (words, one space between), items: each distinct window with the items that have it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column("item_id"), batch.column("text"), strict=True):
                found = list(dict.fromkeys(windows_of(text.as_py(), size)))
                yield pa.RecordBatch.from_arrays([pa.array([item.as_py()] * len(found), pa.string()), pa.array([x.decode() for x in found], pa.string())], ["item", "window"])

    named = benchmark.where("item_id is not null").select(F.col("item_id").cast("string").alias("item_id"), "text")
    return named.mapInArrow(run, "item string, window string").groupBy("window").agg(F.collect_set("item").alias("items"))


class Windows:
    """A block of windows as a bitmap and sorted hashes for each length in words."""

    def __init__(self, rows: list[tuple[str, list[str]]]):
        self.exact: dict[bytes, list[str]] = {w.encode(): items for w, items in rows}
        by_size: dict[int, list[np.ndarray]] = {}
        data, offs = utf8(pa.array([w for w, _ in rows], pa.string()))
        starts, ends, bounds = word_spans(data, offs, ALNUM)
        words = word_hashes(data, starts, ends)
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            by_size.setdefault(int(b - a), []).append(window_hashes(words[a:b], int(b - a)))
        self.sets = {}
        for n, parts in by_size.items():
            hashes = np.unique(np.concatenate(parts))
            bits = np.zeros(1 << 20, bool)
            bits[hashes & np.uint64((1 << 20) - 1)] = True
            self.sets[n] = (bits, hashes)

    def scan(self, column: pa.Array) -> Iterator[tuple[int, list[tuple[int, int]], set[str], bytes, np.ndarray]]:
        """For each text: its number of words, the word ranges that are hit, their items, its bytes, its words' byte spans."""
        data, offs = utf8(column)
        starts, ends, bounds = word_spans(data, offs, ALNUM)
        words = word_hashes(data, starts, ends)
        found: dict[int, list[tuple[int, int]]] = {}
        for n, (bits, hashes) in self.sets.items():
            h = window_hashes(words, n)
            at = np.flatnonzero(bits[h & np.uint64((1 << 20) - 1)])
            near = np.minimum(np.searchsorted(hashes, h[at]), len(hashes) - 1)
            at = at[hashes[near] == h[at]]
            row = np.searchsorted(bounds, at, side="right") - 1
            for a, r in zip(at[at + n <= bounds[row + 1]].tolist(), row[at + n <= bounds[row + 1]].tolist(), strict=True):
                found.setdefault(r, []).append((a - int(bounds[r]), n))
        for r in range(len(column)):
            a, b = int(bounds[r]), int(bounds[r + 1])
            items: set[str] = set()
            hits: list[tuple[int, int]] = []
            raw = data[offs[r] : offs[r + 1]].tobytes() if r in found else b""
            spans = np.stack([starts[a:b], ends[a:b]]) - offs[r]
            low = raw.translate(LOWER_TABLE)
            for i, n in sorted(found.get(r, ())):
                window = b" ".join([low[s:e] for s, e in spans[:, i : i + n].T.tolist()])
                if window in self.exact:
                    items.update(self.exact[window])
                    hits.append((i, i + n))
            yield b - a, hits, items, raw, spans


def _merged(hits: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(hits):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _blocks(benchmark: DataFrame, size: int, most: int) -> list[tuple[str, object]]:
    """Names and broadcast variables, each of `most` windows at most. The benchmark's windows are kept in the shared folder and read back block by block."""
    spark = benchmark.sparkSession
    space = Workspace(spark, "decontam")
    windows = space.keep(_items(benchmark, size), "windows")
    n = max(1, -(-windows.count() // most))
    out = []
    for k in range(n):
        part = windows if n == 1 else windows.where(F.pmod(F.xxhash64("window"), F.lit(n)) == k)
        out.append((f"{space.root}/{k}", spark.sparkContext.broadcast([(r.window, sorted(r["items"])) for r in part.collect()])))
    space.drop()
    return out


_SETS: dict[str, Windows] = {}


def _scanner(name: str, block, again: bool) -> Callable:
    """For add_columns: what one block hits; `again`: together with what the blocks before have hit."""

    def make():
        if name not in _SETS:
            _SETS.clear()
            _SETS[name] = Windows(block.value)

        def work(part: pa.RecordBatch) -> list:
            seen = list(_SETS[name].scan(part.column("text")))
            before = zip(part.column("ranges").to_pylist(), part.column("items").to_pylist(), strict=True) if again else [((), ())] * len(seen)
            n_words, items, ranges, n_hit, clean = [], [], [], [], []
            for (n, found, own, raw, spans), (old, old_items), text in zip(seen, before, part.column("text"), strict=True):
                hit = _merged([*found, *zip(old[::2], old[1::2], strict=True)])
                n_words.append(n)
                items.append(sorted(own.union(old_items)))
                ranges.append([x for ab in hit for x in ab])
                n_hit.append(sum(b - a for a, b in hit))
                clean.append(_without(text.as_py().encode(), [(int(spans[0, a]), int(spans[1, b - 1])) for a, b in hit]) if hit else text.as_py())
            return [n_words, items, ranges, n_hit, clean]

        return work

    return make


def hits(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, most: int = BLOCK_WINDOWS) -> DataFrame:
    """docs with n_words, n_hit, items (sorted strings), clean_text, contaminated for every row (in place of columns of these names).

    A word inside any occurrence of a window is hit. contaminated: n_hit > 0 and 20 * n_hit >= n_words. clean_text is the
    text without the words hit. Null and empty texts have no words, items without words or id no windows; equal
    items under several ids all count. Rows may repeat; other columns pass. An empty benchmark hits nothing.
    """
    blocks = _blocks(benchmark, size, most)
    out = docs.drop("n_words", "n_hit", "items", "clean_text", "contaminated", "ranges")
    for k, (name, block) in enumerate(blocks):
        out = add_columns(out, _scanner(name, block, k > 0), "n_words long, items array<string>, ranges array<int>, n_hit long, clean_text string")
    return out.drop("ranges").withColumn("contaminated", (F.col("n_hit") > 0) & (SHARE * F.col("n_hit") >= F.col("n_words")))


def _without(raw: bytes, spans: list[tuple[int, int]]) -> str:
    """The text without the byte ranges, each replaced by nothing together with the blanks before it."""
    out, at = [], 0
    for a, b in spans:
        out.append(raw[at:a].rstrip(b" "))
        at = b
    return b"".join([*out, raw[at:]]).decode()


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """hits() with items as their number and the SHA-256 of the ids joined by commas."""
    ids = F.sha2(F.array_join("items", ","), 256)
    return hits(docs.select("doc_id", "text"), benchmark).select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), ids.alias("items_sha256"), "contaminated")
