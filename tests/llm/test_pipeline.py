"""The pipeline's stages, each with nulls, repeated rows and empty tables, and the whole against a plain version."""

import hashlib
import re
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).parents[2]))
import corpus_pipeline  # noqa: E402
import public_tokenizers  # noqa: E402
from test_llm_operators import SCHEMA, plain_components, plain_fingerprint, plain_hits, prose  # noqa: E402


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A small set of the tables that the stages read."""
    at = tmp_path_factory.mktemp("sf")
    passage = prose(30, 500)
    rows = [(k, prose(60, k) + (" vilewordx" if k % 5 == 0 else "") + "\nBoiler line\n" + prose(30, k + 300), "en", f"s{k % 2}", 1) for k in range(120)]
    rows += [(200, prose(90, 3), "en", "s0", 1), (201, prose(90, 3), "en", "s1", 1), (202, passage, "en", "s1", 1), (203, prose(900, 9) + " " + " ".join(passage.split()[:14]) + " " + prose(9, 1), "en", "s1", 1)]
    rows += [(300, None, None, None, None), (301, "", "en", "s0", 0), (None, prose(20, 8), "en", "s0", 1), (1, rows[1][1], "en", "s1", 1)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(k, 1, int(k % 5 == 0)) for k in range(120)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at)


def plain_pipeline(docs, items):
    docs = [d for d in docs if "vilewordx" not in (d[1] or "")]
    by_host = {}
    for d in docs:
        host = by_host.setdefault(d[3] or "", [0, {}])
        host[0] += 1
        for line in {x.strip(" ") for x in (d[1] or "").split("\n")} - {""}:
            host[1][line] = host[1].get(line, 0) + 1
    cut = {h: {x for x, n in c.items() if n >= 3 and n > 0.1 * total} for h, (total, c) in by_host.items()}
    docs = [(d[0], d[1] if d[1] is None else "\n".join(x for x in d[1].split("\n") if x.strip(" ") not in cut[d[3] or ""])) for d in docs]
    comp = plain_components(sorted({plain_fingerprint(t) for _, t in docs}), lambda a, b: (a ^ b).bit_count() <= 3)
    least = {}
    for i, t in docs:
        if i is not None:
            c = comp[plain_fingerprint(t)]
            least[c] = min(least.get(c, i), i)
    docs, seen = [(i, t) for i, t in docs if i is None or least[comp[plain_fingerprint(t)]] == i], set()
    docs = [(i, t) for i, t in docs if i is None or not (i in seen or seen.add(i))]  # rows that repeat an id and a group are copies, too
    lib, out = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), []
    for i, t in docs:
        n, hit, _ = plain_hits(t, items)
        if hit and 20 * hit >= n:
            continue
        if hit:
            t = re.sub(r" *\b" + r"\W+".join(items[0][1].split()[:14]) + r"\b", "", t)
        ids = lib.encode(t or "", add_special_tokens=False).ids
        out.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()))
    return sorted(out, key=str)


def test_whole(spark, folder):
    docs = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    got = sorted((tuple(r)[:3] for r in corpus_pipeline.run(spark, folder).collect()), key=str)
    assert got == plain_pipeline(docs, items)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_any_rows(spark, folder, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    docs = spark.read.parquet(f"{folder}/documents.parquet").withColumn("score", F.lit("mine")).withColumn("host", F.lit(1))
    out = stage(spark, docs, folder)
    if name != "bpe":
        assert out.columns == docs.columns
    assert out.count() > 0
    assert stage(spark, docs.limit(0), folder).count() == 0


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES if n != "bpe"])
def test_stages_keep_columns_of_any_name(spark, folder, name):
    """Columns that operators add elsewhere hold the documents' own values."""
    names = ["score", "predicted", "host", "n_lines", "n_dropped", "frequent", "kept", "row", "items", "n_hit", "n_words", "ranges", "clean_text", "contaminated", "document", "at", "fp", "g", "stays"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for n in names:
        docs = docs.withColumn(n, F.concat(F.lit(f"{n} of "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))))
    out = dict(corpus_pipeline.STAGES)[name](spark, docs, folder)
    rows = out.collect()
    assert out.columns == docs.columns and len(rows) > 50
    assert all(r[n] == f"{n} of {'none' if r.doc_id is None else r.doc_id}" for r in rows for n in names)


def test_near_copies_go_by_row(spark, folder):
    """Of one id with two texts both stay if they are no copies; repeated rows of it collapse; nothing unique is lost."""
    a, b, c = prose(80, 901), prose(80, 902), prose(80, 903)
    rows = [(1, a, "en", "s", 1), (2, a, "en", "s", 2), (2, b, "en", "s", 3), (3, c, "en", "s", 4), (3, c, "en", "s", 5), (None, a, "en", "s", 6), (None, c, "en", "s", 7)]
    out = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, SCHEMA).coalesce(1), folder)
    assert sorted((tuple(r)[:2] for r in out.collect()), key=str) == sorted([(1, a), (2, b), (3, c), (None, a), (None, c)], key=str)


def test_stage_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "simhash_near_dedup", "decontamination", "bpe"]
