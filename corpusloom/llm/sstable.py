"""Token ids in sorted-string-table shards.

A shard holds documents in ascending key order: blocks of prefix-compressed keys with their ids, a sparse index (the first key and
place of each block), a Bloom filter of all keys, and a footer with the places of both. A look-up asks the filter, finds
the block by binary search and reads that block alone.

    shard  := block* index filter footer
    block  := zlib(entry*)
    entry  := shared u16 | own u16 | own key bytes | ids u32 count | ids, little-endian u16 (u32 if the vocabulary is larger)
    index  := count u32 | (key length u16 | key | offset u64 | bytes u32 | first document u64)*
    filter := bits u64 | hashes u8 | bytes
    footer := index offset u64 | filter offset u64 | documents u64 | ids u64 | width u8 | magic 8 bytes

A key is the id as 8 big-endian bytes with the sign bit flipped, so bytes sort as ids do; a null id is the empty key, first of all.
Shards go to the shared folder under names that no other attempt uses; only those that a finished task
reports count, so lost executors and repeated tasks leave at most files that nobody reads.
"""

from __future__ import annotations

import bisect
import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ._shared import Workspace, bound_arrow, text_slices, utf8
from .words import Lexicon, check_vocabulary, segments

MAGIC = b"CLOOMST1"
#: Bytes of entries that make a block full, and of a shard's file that make it full.
BLOCK_BYTES = 1 << 18
SHARD_BYTES = 1 << 27
FILTER_BITS, FILTER_HASHES = 10, 7
_FOOTER = struct.Struct("<QQQQB8s")


def key_of(doc_id: int | None) -> bytes:
    return b"" if doc_id is None else struct.pack(">Q", (doc_id + (1 << 63)) & ((1 << 64) - 1))


def id_of(key: bytes) -> int | None:
    return struct.unpack(">Q", key)[0] - (1 << 63) if key else None


def _filter_places(key: bytes, bits: int, hashes: int) -> list[int]:
    h = xxhash.xxh3_128_intdigest(key)
    a, b = h & ((1 << 64) - 1), (h >> 64) | 1
    return [(a + k * b) % bits for k in range(hashes)]


class Writer:
    """Writes one shard; keys must come in ascending order (equal ones are kept, in order)."""

    def __init__(self, out, width: int = 2):
        self.out, self.width = out, width
        self.place = self.docs = self.ids = 0
        self.block, self.held, self.last, self.first = [], 0, b"", 0
        self.index: list[tuple[bytes, int, int, int]] = []
        self.keys: list[bytes] = []
        self.head = b""

    def add(self, key: bytes, ids: bytes) -> None:
        """ids: little-endian, `width` bytes each."""
        if self.keys and key < self.keys[-1]:
            raise ValueError("keys must ascend")
        if not self.block:
            self.head, self.last, self.first = key, b"", self.docs
        shared = next((k for k, (x, y) in enumerate(zip(key, self.last, strict=False)) if x != y), min(len(key), len(self.last)))
        self.block += [struct.pack("<HH", shared, len(key) - shared), key[shared:], struct.pack("<I", len(ids) // self.width), ids]
        self.held += 8 + len(key) + len(ids)
        self.last = key
        self.keys.append(key)
        self.docs += 1
        self.ids += len(ids) // self.width
        if self.held >= BLOCK_BYTES:
            self._flush()

    def _flush(self) -> None:
        if self.block:
            data = zlib.compress(b"".join(self.block), 1)
            self.out.write(data)
            self.index.append((self.head, self.place, len(data), self.first))
            self.place += len(data)
            self.block, self.held = [], 0

    def close(self) -> None:
        self._flush()
        index = b"".join([struct.pack("<I", len(self.index)), *(struct.pack("<H", len(k)) + k + struct.pack("<QIQ", at, n, first) for k, at, n, first in self.index)])
        bits = max(64, FILTER_BITS * len(self.keys))
        table = np.zeros(bits, np.uint8)
        for k in self.keys:
            table[_filter_places(k, bits, FILTER_HASHES)] = 1
        self.out.write(index)
        self.out.write(struct.pack("<QB", bits, FILTER_HASHES) + np.packbits(table).tobytes())
        self.out.write(_FOOTER.pack(self.place, self.place + len(index), self.docs, self.ids, self.width, MAGIC))
        self.out.close()


class Reader:
    """Reads one shard from a seekable file."""

    def __init__(self, source):
        self.source = source
        source.seek(0, 2)
        end = source.tell()
        source.seek(end - _FOOTER.size)
        index, bloom, self.docs, self.ids, self.width, magic = _FOOTER.unpack(source.read(_FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a shard, or cut off")
        source.seek(index)
        raw = source.read(bloom - index)
        self.index, at = [], 4
        for _ in range(struct.unpack_from("<I", raw)[0]):
            (n,) = struct.unpack_from("<H", raw, at)
            self.index.append((raw[at + 2 : at + 2 + n], *struct.unpack_from("<QIQ", raw, at + 2 + n)))
            at += 2 + n + 20
        source.seek(bloom)
        raw = source.read(end - _FOOTER.size - bloom)
        self.bits, self.hashes = struct.unpack_from("<QB", raw)
        self.table = np.unpackbits(np.frombuffer(raw, np.uint8, offset=9))[: self.bits]

    def _block(self, k: int) -> Iterator[tuple[bytes, bytes]]:
        _, at, size, _ = self.index[k]
        self.source.seek(at)
        raw, at, key = zlib.decompress(self.source.read(size)), 0, b""
        while at < len(raw):
            shared, own = struct.unpack_from("<HH", raw, at)
            key = key[:shared] + raw[at + 4 : at + 4 + own]
            (n,) = struct.unpack_from("<I", raw, at + 4 + own)
            at += 8 + own
            yield key, raw[at : at + n * self.width]
            at += n * self.width

    def __iter__(self) -> Iterator[tuple[bytes, bytes]]:
        for k in range(len(self.index)):
            yield from self._block(k)

    def get(self, key: bytes) -> list[bytes]:
        """The ids of every document of the key."""
        if not self.table[_filter_places(key, self.bits, self.hashes)].all():
            return []
        out = []
        for k in range(max(0, bisect.bisect_left(self.index, (key,)) - 1), len(self.index)):
            if self.index[k][0] > key:
                break
            out += [ids for found, ids in self._block(k) if found == key]
        return out


class _Encoder:
    """Whole texts to ids by the tokenizers library; words that a worker has met before are not encoded again.

    Only for vocabularies whose tokens never reach over blanks and which mark the end of a word (word_bpe_49k). New words go to the
    library many at a time, one blank between them; its ids are cut after each token that ends a word.
    """

    def __init__(self, path: str, end: int):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        check_vocabulary(spec)
        mark = spec["model"]["end_of_word_suffix"]
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        vocab = self.library.get_vocab()
        self.width = 2 if max(*vocab.values(), end) < 1 << 16 else 4
        self.kind = f"<u{self.width}"
        self.end = np.array([end], self.kind).tobytes()
        self.ends_word = np.zeros(max(vocab.values()) + 1, bool)
        self.ends_word[[i for t, i in vocab.items() if t.endswith(mark)]] = True
        self.words = Lexicon(self._learn, self._ids)

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.int32)

    def _learn(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        got, sizes = [], []
        for k in range(0, len(words), 4096):
            some = words[k : k + 4096]
            ids = self._ids(b" ".join(some).decode())
            cuts = np.flatnonzero(self.ends_word[ids]) + 1
            if len(cuts) == len(some):
                got.append(ids)
                sizes.append(np.diff(cuts, prepend=0))
            else:  # not as plain as they looked: they go one by one
                one = [self._ids(w.decode()) for w in some]
                got += one
                sizes.append(np.array(list(map(len, one))))
        return np.concatenate(got), np.concatenate(sizes)

    def encode(self, column: pa.Array) -> list[bytes]:
        """The ids of each text, the end id last; a long text goes by in parts."""
        if len(column) == 1:
            parts = [self.words.ids(*self.words.slots(*utf8(pa.array([x]))))[0].astype(self.kind).tobytes() for x in segments(column[0].as_py() or "")]
            return [b"".join([*parts, self.end])]
        ids, bounds = self.words.ids(*self.words.slots(*utf8(column)))
        raw, cuts = ids.astype(self.kind).tobytes(), (bounds * self.width).tolist()
        return [raw[a:b] + self.end for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


_ENCODERS: dict[tuple[str, int], _Encoder] = {}
_MANIFEST = "part int, nth int, path string, docs long, ids long"
#: Code points of a text by which rows of one id are dealt to tasks.
TIE_CHARS = 64


def write(docs: DataFrame, path: str, folder: str, end: int = 1) -> DataFrame:
    """Encode docs and write shards of them, in ascending doc_id, under folder; path, start (ids of all shards before), docs and ids of each shard.

    Rows of one id stand in the order of their texts and may fill several tasks, where the texts' beginnings differ; rows without an id
    come first. Null and empty texts are a document of the end id alone. Other columns are left out; an empty table has no shards.
    The manifest, a row for each shard of about SHARD_BYTES, is written to the folder and summed up there, not on the driver.
    """
    spark = docs.sparkSession
    bound_arrow(spark)
    kinds = to_arrow_schema(StructType.fromDDL(_MANIFEST))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (path, end) not in _ENCODERS:
            _ENCODERS[path, end] = _Encoder(path, end)
        own = _ENCODERS[path, end]
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        now: Writer | None = None
        name, made, task = "", 0, TaskContext.get().partitionId()

        def done() -> pa.RecordBatch:
            now.close()
            row = {"part": [task], "nth": [made], "path": [name], "docs": [now.docs], "ids": [now.ids]}
            return pa.RecordBatch.from_pydict(row, schema=kinds)

        for batch in batches:
            for part in text_slices(batch):
                for doc_id, ids in zip(part.column("doc_id").to_pylist(), own.encode(part.column("text")), strict=True):
                    if now is None:
                        name, made = f"{root}/{made:06d}-{uuid.uuid4().hex}.sst", made + 1  # one key may fill several shards of a task
                        now = Writer(store.open_output_stream(name), own.width)
                    now.add(key_of(doc_id), ids)
                if now and now.place >= SHARD_BYTES:
                    yield done()
                    now = None
        if now:
            yield done()

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = docs.select("doc_id", "text").repartitionByRange(n, "doc_id", F.substring("text", 1, TIE_CHARS)).sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(run, _MANIFEST).write.parquet(f"{folder}/manifest")
    before = Window.orderBy("part", "nth").rowsBetween(Window.unboundedPreceding, -1)  # a row for each shard: small
    shards = spark.read.schema(_MANIFEST).parquet(f"{folder}/manifest")
    return shards.select("path", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("start"), "docs", "ids")


def read(manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (of all ids as little-endian u32) of every document of the shards.

    manifest: path and start of each shard, as write() gives them. Each shard is read in one pass, block by block; no shards give no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True):
                with store.open_input_file(name) as f:
                    shard = Reader(f)
                    rows: list[tuple] = []
                    for key, raw in shard:
                        ids = np.frombuffer(raw, f"<u{shard.width}")
                        rows.append((id_of(key), start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        start += len(ids)
                        if len(rows) == 4096:
                            yield _table(rows)
                            rows = []
                    yield _table(rows)

    n = max(1, manifest.count())
    return manifest.repartition(n, "path").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _table(rows: list[tuple]) -> pa.RecordBatch:
    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(4)], names)


def written_and_read(docs: DataFrame, path: str, end: int = 1) -> DataFrame:
    """write() to the shared folder, then read(): a row for every row of docs, with the cases as told there."""
    space = Workspace(docs.sparkSession, "sstable")
    return read(write(docs, path, space.root, end), space.root)


