"""Shared pieces of the training-data operators: shared storage, Arrow slices, byte-level word hashing."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from itertools import filterfalse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows that the JVM puts into one Arrow batch; with it a batch of very long texts still fits a worker.
ARROW_ROWS = 1000
#: Bytes of text that a worker handles at once (a single longer text is a slice of its own).
SLICE_BYTES = 1 << 19

_OWN_DIR: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_arrow(spark: SparkSession) -> None:
    """Lower the rows of an Arrow batch, unless the session already asks for fewer."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where it is unset (local tests)."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _OWN_DIR:
        _OWN_DIR.append("file://" + tempfile.mkdtemp(prefix="corpusloom-"))
    return _OWN_DIR[0]


class Workspace:
    """Tables written once to the shared folder and read again: they cut lineage and survive lost executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        at = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(at)
        return self.spark.read.schema(df.schema).parquet(at)

    def drop(self, name: str = "") -> None:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}".rstrip("/"))
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


class Recent(dict):
    """Results by key, made on demand; the recently used ones are kept, `most` to twice `most` of them."""

    def __init__(self, make: Callable, most: int):
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key):
        value = self.old.pop(key, None)
        if value is None:
            value = self.make(key)
        self.put(key, value)
        return value

    def put(self, key, value) -> None:
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = value

    def unknown(self, keys) -> list:
        return list(filterfalse(self.old.__contains__, filterfalse(self.__contains__, keys)))


def least_hashed(rows: DataFrame, group: str, most: int, groups: int, space: Workspace) -> DataFrame:
    """group, doc_id, k: the `most` ids of least hash in each group of rows (group, doc_id), k from 1 in their order; of more groups than `groups` the largest.

    No group is ranked whole: ids under a share of the hashes are kept, which is raised for a group until enough are under it; the few that are
    left are ranked. An id counts once, however often it is repeated.
    """
    spark, top = rows.sparkSession, (1 << 63) - 1
    rows = rows.select(F.col(group).alias("g"), "doc_id", F.shiftrightunsigned(F.xxhash64("doc_id"), 1).alias("h"))
    sizes = rows.groupBy("g").agg(F.approx_count_distinct("doc_id").alias("n")).orderBy(F.col("n").desc(), "g").limit(groups).collect()
    share = {r.g: min(1.0, 2.0 * most / max(1, r.n)) for r in sizes}
    parts, k = [], 0
    todo = dict(share)
    while todo:
        cuts = spark.createDataFrame([(g, min(top, int(x * top))) for g, x in todo.items()], rows.select("g", F.col("h").alias("cut")).schema)
        some = rows.join(F.broadcast(cuts), "g").where("h <= cut").select("g", "doc_id", "h").distinct()  # a row of cuts for each group
        some = space.keep(some, f"few-{k}")
        found = {r.g: r["count"] for r in some.groupBy("g").count().collect()}
        short = [g for g, x in todo.items() if found.get(g, 0) < most and x < 1]
        parts.append(some.join(F.broadcast(spark.createDataFrame([(g,) for g in short], some.select("g").schema)), "g", "left_anti") if short else some)
        todo, k = {g: min(1.0, 8 * todo[g]) for g in short}, k + 1
    if not parts:
        return rows.select(F.col("g").alias(group), "doc_id", F.lit(1).alias("k")).limit(0)
    few = parts[0]
    for p in parts[1:]:
        few = few.union(p)
    ranked = few.groupBy("g").agg(F.slice(F.array_sort(F.collect_list(F.struct("h", "doc_id"))), 1, most).alias("x"))
    return ranked.select(F.col("g").alias(group), F.posexplode("x").alias("k", "x")).select(group, "x.doc_id", (F.col("k") + 1).alias("k"))


def text_slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of a batch, of about equal bytes of the column: `most` at most, or one row."""
    size = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
    upto = np.cumsum(size)
    i, n, done = 0, batch.num_rows, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(upto, done + most, side="right")))
        yield batch.slice(i, j - i)
        done, i = int(upto[j - 1]), j


def give_back() -> None:
    """Return memory that is free to the system: a worker lives on after its task, and the next one may need other tables."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only where the C library has it
    if trim:
        trim(0)


def add_columns(docs: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], list]], fields: str) -> DataFrame:
    """docs with the columns of `fields` (in place of columns of these names), made from slices of rows.

    make() runs once in each task and gives a function from a slice to the values of the new columns.
    """
    new = StructType.fromDDL(fields)
    taken = {f.name.lower() for f in new}
    left = [f for f in docs.schema if f.name.lower() not in taken]
    kinds = to_arrow_schema(new).types

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for part in text_slices(batch):
                made = [pa.array(v, k) for v, k in zip(work(part), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in left), *made], [*(f.name for f in left), *new.names])
        give_back()

    bound_arrow(docs.sparkSession)
    return docs.mapInArrow(run, StructType([*left, *new]))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its row offsets; null is the empty text."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    offs = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)[offs[0] : offs[-1]] if len(column) else np.zeros(0, np.uint8)
    return data, offs - offs[0] if len(column) else np.zeros(1, np.int64)


#: Byte classes. ASCII_LOWER maps A-Z; BLANK is 0x20 and 0x09-0x0D; ALNUM is 0-9, A-Z, a-z and every byte from 0x80.
ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[65:91] += 32
LOWER_TABLE = ASCII_LOWER.tobytes()
NOT_BLANK = np.ones(256, dtype=bool)
NOT_BLANK[[32, 9, 10, 11, 12, 13]] = False
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True

_ODD = np.uint64(0x9E3779B97F4A7C15)
_ODD_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTES = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS["up"]) < n:
        for k, x in (("up", _ODD), ("down", _ODD_INVERSE)):
            p = np.full(n, x, np.uint64)
            p[0] = 1
            _POWERS[k] = np.cumprod(p, dtype=np.uint64)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit values."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _range_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Polynomial hashes (mod 2^64) of values[start:end], for all ranges at once by prefix sums."""
    up, down = _powers(len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[:-1], out=total[1:])
    return mixed((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def word_spans(data: np.ndarray, offs: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (bytes) of all words, and the number of words before each row."""
    inside = is_word[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    n = len(data)
    at = offs[:-1][offs[:-1] < n]
    first[at] = inside[at]
    at = offs[1:][offs[1:] > 0] - 1
    last[at] = inside[at]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offs)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of words, A-Z in lower case."""
    return _range_hashes(_BYTES[ASCII_LOWER[data]], starts, ends)


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of `size` consecutive words (across rows, too: callers skip those)."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    at = np.arange(n)
    return _range_hashes(words, at, at + size)


def shingles(words: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's runs of `size` words (fewer words: the whole row, none: nothing), and the bounds of the rows."""
    count = np.diff(bounds)
    many = np.where(count >= size, count - size + 1, (count > 0).astype(np.int64))
    out_bounds = np.concatenate([[0], np.cumsum(many)])
    row = np.repeat(np.arange(len(count)), many)
    starts = bounds[:-1][row] + np.arange(len(row)) - out_bounds[:-1][row]
    return _range_hashes(words, starts, starts + np.minimum(size, count[row])), out_bounds
