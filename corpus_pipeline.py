"""A corpus pipeline of the training-data operators: toxicity, line dedup, SimHash near-dedup, decontamination, BPE encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next one's docs.
All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import bpe, decontam, linededup, simhash, toxicity
from corpusloom.llm._shared import Workspace, table


def packed(docs: DataFrame, *keys: str) -> DataFrame:
    """text, the keys, and all other columns in one, so that no operator's column can clash with them."""
    rest = [c for c in docs.columns if c != "text"]
    return docs.select("text", *keys, F.struct(*(F.col(f"`{c}`") for c in rest)).alias("document"))


def unpacked(df: DataFrame, docs: DataFrame, text: Column | None = None, changed: Column | None = None) -> DataFrame:
    """The columns of docs again; where `changed` holds, with a new text and its length as n_chars."""
    text = F.col("text") if text is None else F.when(changed, text).otherwise(F.col("text"))
    out = {c: F.col(f"document.`{c}`") for c in docs.columns if c != "text"} | {"text": text}
    if changed is not None and "n_chars" in docs.columns:
        out["n_chars"] = F.when(changed, F.length(text).cast("long")).otherwise(out["n_chars"])
    return df.select(*(out[c].alias(c) for c in docs.columns))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine scores under 0.5. It learns from the labels outside the held-out fifth, and the texts given."""
    machine = toxicity.learn(docs, table(spark, sf_dir, "labels"), allowed=~toxicity.held_out())
    return unpacked(toxicity.score(packed(docs), machine).where("predicted = 0"), docs)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that are boilerplate of their source; n_chars is that of what is left."""
    out = linededup.drop_boilerplate(packed(docs, "source"))
    return unpacked(out, docs, F.col("text"), F.col("n_dropped") > 0)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies: one of the smallest doc_id. Documents without an id stay."""
    return simhash.one_of_each(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated; those with a smaller share of benchmark words lose these words."""
    out = decontam.hits(packed(docs), table(spark, sf_dir, "benchmark")).where("not contaminated")
    return unpacked(out, docs, F.col("clean_text"), F.col("n_hit") > 0)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document, by the tokenization automaton."""
    return bpe.encode_digests(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_lines), ("simhash_near_dedup", drop_near_copies), ("decontamination", drop_benchmark), ("bpe", encode)]

#: A factorization machine and SimHash have no SQL; tests/llm holds the pipeline against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    space = Workspace(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = space.keep(stage(spark, docs, sf_dir), name)
        if k:
            space.drop(STAGES[k - 1][0])
    return docs
