"""Token counts: batch encoding in Arrow functions that return lengths only.

Long texts are split where no token can reach over (a letter, one space, a letter), chunks that a worker has met before
are not encoded again, and the rest goes to the library in batches of about equal bytes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import Recent, bound_arrow, text_slices

#: Code points of a part of a long text.
PART = 1 << 16
#: Bytes that one call of the library gets.
BATCH_BYTES = 1 << 18
#: Chunks whose count a worker remembers, up to twice as many.
CACHE_CHUNKS = 200_000

_SAFE = re.compile(r"(?<=[A-Za-z]) (?=[A-Za-z])")
_CHUNK = re.compile(r"\s*\S+|\s+\Z")
_PLAIN = re.compile("(?!.*<\\|) [A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff][!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]*")
_ODD_BLANKS = re.compile("[\x1c-\x1f]")


def safe_parts(text: str, most: int = PART) -> Iterator[str]:
    """Parts of a text, each of `most` code points or longer, whose tokens are together the tokens of the text."""
    at = 0
    while len(text) - at > most:
        m = _SAFE.search(text, at + most)
        if not m:
            break
        yield text[at : m.start()]
        at = m.start()
    yield text[at:] if at else text


class Counter:
    """Counts by chunk: blanks and then what is not blank. A byte-level vocabulary's tokens never reach over a chunk's end."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.known = Recent(lambda chunk: self._lengths([chunk])[0], CACHE_CHUNKS)
        self.begins = np.zeros(max(self.library.get_vocab().values()) + 1, bool)
        self.begins[[i for t, i in self.library.get_vocab().items() if t[0] == "\u0120"]] = True  # how byte-level vocabularies write a space
        pre = self.library.pre_tokenizer
        #: Other kinds of vocabulary are counted part by part without chunks.
        self.by_chunk = type(pre).__name__ == "ByteLevel" and pre.use_regex and not pre.add_prefix_space and self.library.normalizer is None

    def _lengths(self, texts: list[str]) -> list[int]:
        out: list[int] = []
        batch: list[str] = []
        held = 0
        for x in [*texts, None]:
            if batch and (x is None or held + len(x) > BATCH_BYTES):
                out += [len(e.ids) for e in self.library.encode_batch_fast(batch, add_special_tokens=False)]
                batch, held = [], 0
            if x is not None:
                batch.append(x)
                held += len(x)
        return out

    def _learn(self, chunks: list[str]) -> None:
        """Count new chunks: plain ones (a space, a letter, no blanks) go to the library in a row and are cut where a token begins with the space."""
        rest = []
        plain = [c for c in chunks if _PLAIN.fullmatch(c) or rest.append(c)]
        for k in range(0, len(plain), 4096):
            some = plain[k : k + 4096]
            ids = np.array(self.library.encode("".join(some), add_special_tokens=False).ids)
            at = np.flatnonzero(self.begins[ids])
            if len(at) == len(some) and (not some or at[0] == 0):
                for c, n in zip(some, np.diff(at, append=len(ids)).tolist(), strict=True):
                    self.known.put(c, n)
            else:
                rest += some
        for c, n in zip(rest, self._lengths(rest), strict=True):
            self.known.put(c, n)

    def counts(self, texts: list[str]) -> np.ndarray:
        """The number of tokens of each whole text."""
        out = np.zeros(len(texts), np.int64)
        whole: list[tuple[int, str]] = []
        parts: list[tuple[int, list[str]]] = []
        for k, text in enumerate(texts):
            if not self.by_chunk or _ODD_BLANKS.search(text):
                whole.append((k, text))
                continue
            parts += [(k, _CHUNK.findall(p)) for p in safe_parts(text)]
        self._learn(self.known.unknown(set().union(*(cs for _, cs in parts))))
        for k, cs in parts:
            out[k] += sum(map(self.known.__getitem__, cs))
        for (k, _), n in zip(whole, self._lengths([t for _, t in whole]), strict=True):
            out[k] += n
        return out


_COUNTERS: dict[str, Counter] = {}


def token_counts(docs: DataFrame, path: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit) for every row of docs.

    As the library counts: without begin, end or added special tokens, special strings inside texts as its
    default, no truncation. A null text counts as empty: 0 bytes, 0 tokens. Repeated rows are counted each; other
    columns are left out; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _COUNTERS:
            _COUNTERS[path] = Counter(path)
        for batch in batches:
            for part in text_slices(batch):
                texts = [x or "" for x in part.column("text").to_pylist()]
                n = _COUNTERS[path].counts(texts)
                size = pa.array([len(x.encode()) for x in texts], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), size, pa.array(n)], ["doc_id", "n_bytes", "n_tokens"])

    bound_arrow(docs.sparkSession)
    out = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
