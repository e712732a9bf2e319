"""Training-data operators against plain versions, on small tables with nulls, empty and long texts, ties and repeated rows."""

import base64
import hashlib
import io
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corpusloom.llm import bpe, decontam, langid, linededup, minhash, simhash, sstable, tokencount, toxicity, warc

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
RNG = random.Random(5)
WORDS = ["".join(RNG.choice("abcdefghijklmnop") for _ in range(RNG.randint(2, 7))) for _ in range(60)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


def texts():
    long = prose(6000, 1)
    base = prose(60, 2)
    near = base.replace(base.split()[30], "changed", 1)
    special = "a  <|endoftext|> b\n\n\tΣΑΣ é ́x !! don't <|ENDOFTEXT|> 12 ½\x1cz日本 "
    return [None, "", "   \n", long, base, base, near, special, "one", "one two", "ONE two", prose(30, 3), "\n".join([prose(8, 4), prose(8, 5), "Boiler line", ""]), "12 34 !!", prose(20, 9) + "\nBoiler line"]


def table(spark, rows=None, more=True):
    rows = [(k * 7 - 10, t, ["en", "de", None][k % 3], ["a", "a", "b", None][k % 4], len(t or "")) for k, t in enumerate(texts() if rows is None else rows)]
    rows += [rows[4], (None, "no id", None, None, 5)] if more else []
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def clashing(df):
    """With columns of the names that operators add."""
    for c in ("score", "predicted", "n_words", "items", "n_hit", "ranges", "host", "row", "kept", "frequent", "n_lines", "lang_pred", "at", "r", "guest", "fp", "node"):
        df = df.withColumn(c, F.lit("x"))
    return df


def by_id(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: (r[0] is not None, r[0] or 0, str(r)))


# fingerprints


def plain_shingles(text, size=5):
    words = (text or "").encode().translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))).split()
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def test_minhash_estimates_jaccard():
    pairs = [(prose(200, k), prose(200, k)[: 40 * k + 200] + " " + prose(40, k + 50)) for k in range(12)]
    for a, b in pairs:
        x, y = plain_shingles(a), plain_shingles(b)
        s = minhash.signatures(pa.array([a, b]))
        assert minhash.likeness(s[0], s[1]) == pytest.approx(len(x & y) / len(x | y), abs=0.13)


def test_signatures_do_not_depend_on_slices():
    many = [t for t in texts()] * 3
    whole = minhash.signatures(pa.array(many))
    for k, t in enumerate(many):
        assert (whole[k] == minhash.signatures(pa.array([t], pa.string()))[0]).all()
    big = prose(40_000, 8)
    assert (minhash.signatures(pa.array([big, "x"]))[0] == minhash.signatures(pa.array(["y z", big]))[1]).all()


def test_edited_pairs(spark):
    df = table(spark)
    rows = sorted(((r.doc_id, r.text or "") for r in df.collect()), key=lambda r: (r[0] if r[0] is not None else -(1 << 63), r[1]))
    want = []
    for k, (i, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        e = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        s = minhash.signatures(pa.array([t, e, after]))
        want.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), minhash._hex(s[:1])[0], minhash._hex(s[1:2])[0], float((s[0] == s[1]).mean()), float((s[0] == s[2]).mean())))
    got = by_id(minhash.edited_pairs(clashing(df)))
    assert got == sorted(want, key=lambda r: (r[0] is not None, r[0] or 0, str(r)))
    assert minhash.edited_pairs(empty(spark)).count() == 0
    assert len(minhash.edited_pairs(table(spark, ["solo words"], False)).collect()) == 1


def test_minhash_near_duplicates(spark):
    base = prose(300, 11)
    rows = [base, base + " end", prose(300, 12), base.replace(base.split()[150], "zz", 1), None, "", prose(300, 12)]
    got = dict(by_id(minhash.near_duplicates(table(spark, rows, False))))
    assert [got[k * 7 - 10] for k in range(7)] == [-10, -10, 4, -10, 18, 18, 4]


# token counts


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_token_counts(spark, path):
    lib = Tokenizer.from_file(path)
    df = table(spark)
    want = sorted(((r.doc_id, len((r.text or "").encode()), n := len(lib.encode(r.text or "", add_special_tokens=False).ids), n > 512) for r in df.collect()), key=lambda r: (r[0] is not None, r[0] or 0, str(r)))
    assert by_id(tokencount.token_counts(clashing(df), path)) == want
    assert tokencount.token_counts(empty(spark), path).count() == 0


def test_counts_with_a_tiny_cache(monkeypatch):
    monkeypatch.setattr(tokencount, "CACHE_CHUNKS", 50)
    lib, own = Tokenizer.from_file(BYTE), tokencount.Counter(BYTE)
    many = [prose(400, k) + f"\n\n  {k} it's <|endoftext|>" for k in range(8)]
    assert own.counts(many).tolist() == [len(lib.encode(t, add_special_tokens=False).ids) for t in many]


def test_safe_parts():
    text = prose(5000, 3)
    parts = list(tokencount.safe_parts(text, 1000))
    assert len(parts) > 5 and "".join(parts) == text


# language


def test_language(spark):
    rows = [(k, prose(30, k) if k % 2 else prose(30, k).translate(str.maketrans("abcdefghijklmnop", "qrstuvwxyzéèüöäß")), "en" if k % 2 else "xx", "s", 1) for k in range(120)]
    rows += [(900, None, "en", "s", 0), (901, "12 !!", "en", "s", 0), (902, prose(30, 902), None, "s", 0), (None, prose(5, 1), "en", "s", 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    held = toxicity.held_out(parts=3, part=1)
    codes = langid.learn(df, ~held)
    got = {r.doc_id: r for r in langid.identify(clashing(df), codes).select("doc_id", "lang_pred", "score", "ambiguous").collect()}
    assert all(got[k].lang_pred == ("en" if k % 2 else "xx") and 0.5 < got[k].score <= 1 for k in range(120))
    assert got[900].lang_pred == got[901].lang_pred == "und" and got[902].lang_pred == "en" and len(got) == 125 - 1
    assert {r.lang_pred for r in langid.identify(df, langid.learn(empty(spark))).collect()} == {"und"}
    assert langid.identify(empty(spark), codes).count() == 0


@pytest.mark.parametrize("n", [1, 2, 4, 5, 10])
def test_each_language_is_learnt_and_held_back(n):
    """Rows in turns, as learn() orders them."""
    langs = [f"l{k}" for k in range(n)] * 40
    back = langid.held_back(langs)
    assert [sum(b for b, x in zip(back, langs, strict=True) if x == f"l{k}") for k in range(n)] == [8] * n
    assert not langid.held_back(["rare", "other"]).any()


@pytest.mark.parametrize("n", [2, 3, 4, 5, 9, 30])
def test_codewords_are_apart(n):
    code = langid.codewords(n)
    near = (code.shape[1] - (code @ code.T - 2 * np.eye(n) * code.shape[1]).max()) / 2
    assert near >= max(1, code.shape[1] // 5) and len({tuple(c) for c in code}) == n


# decontamination


def plain_hits(text, items):
    words = decontam.words_of(text)
    hit, found = set(), set()
    for item, t in items:
        own = decontam.words_of(t)
        size = min(13, len(own))
        for k in range(max(0, len(own) - size + 1)) if own else ():
            for i in range(len(words) - size + 1):
                if words[i : i + size] == own[k : k + size]:
                    hit.update(range(i, i + size))
                    found.add(str(item))
    return len(words), len(hit), sorted(found)


@pytest.mark.parametrize("most", [1_000_000, 7])
def test_decontamination(spark, most):
    passage = prose(40, 77)
    items = [(1, passage), (2, "Tiny ITEM"), (10, passage), (3, None), (4, "..."), (None, "one two"), (5, prose(13, 5)), (5, prose(13, 5))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = [None, "", passage.upper(), "x " + " ".join(passage.split()[3:18]) + " y", prose(500, 6) + " tiny-item! " + prose(500, 7), "a tiny item", prose(13, 5), "one two", " ".join(passage.split()[:12]), "tiny\nitem tiny item"]
    df = table(spark, docs)
    got = decontam.hits(clashing(df), bench, most=most).select("doc_id", "text", "n_words", "n_hit", "items", "contaminated", "clean_text").collect()
    known = [(i, t) for i, t in items if i is not None]
    for r in got:
        n, hit, found = plain_hits(r.text, known)
        assert (r.n_words, r.n_hit, r["items"]) == (n, hit, found), r.text
        assert r.contaminated == (hit > 0 and 20 * hit >= n)
        assert (r.clean_text == r.text) if not hit else plain_hits(r.clean_text, known)[1] == 0 or len(r.clean_text) < len(r.text)
    assert len(got) == len(docs) + 2
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontam.report(df, none).where("n_hit > 0").count() == 0 and decontam.report(empty(spark), bench).count() == 0


# lines


def test_line_dedup(spark):
    rows = [(k, f"page {k}\nBoiler \n\nother {k % 4}", "en", "h" if k < 20 else None, 1) for k in range(24)] + [(50, None, "en", "h", 0), (51, "", "en", "h", 0)]
    df = clashing(spark.createDataFrame(rows, SCHEMA))
    got = {r.doc_id: r for r in linededup.drop_boilerplate(df).collect()}
    assert got[3].text == "page 3\n" and (got[3].n_lines, got[3].n_dropped) == (4, 2)
    assert got[21].text == "page 21\n\nother 1" and got[21].n_dropped == 1
    assert got[50].text is None and got[51].text == "" and len(got) == 26
    assert linededup.drop_boilerplate(empty(spark)).count() == 0


def test_line_dedup_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(linededup, "BROADCAST_LINES", 0)
    rows = [(k, f"page {k}\nBoiler", "en", "h", 1) for k in range(9)]
    assert {r.text for r in linededup.drop_boilerplate(spark.createDataFrame(rows, SCHEMA)).collect()} == {f"page {k}" for k in range(9)}


# toxicity


def test_toxicity(spark):
    rows = [(k, prose(40, k) + (" vilewordx " if k % 4 == 0 else " ") + prose(40, k + 1000), "en", "s", 1) for k in range(240)]
    rows += [(900, None, "en", "s", 0), (901, "", "en", "s", 0), (None, "vilewordx", "en", "s", 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(240)] + [(900, 1), (5000, 1), (None, 1), (1, None)], "doc_id long, toxic int")
    machine = toxicity.learn(df, labels, allowed=~toxicity.held_out())
    got = {r.doc_id: r for r in toxicity.score(clashing(df), machine).collect()}
    assert all(got[k].predicted == int(k % 4 == 0) for k in range(240) if zlib.crc32(str(k).encode()) % 5 == 0)
    assert got[900].score == got[901].score < 0.5 and got[None].predicted == 1 and len(got) == 243
    none = toxicity.learn(df, labels.limit(0))
    assert toxicity.score(df, none).where("predicted = 1").count() == 0
    assert toxicity.score(empty(spark), machine).count() == 0


def test_factors_learn_a_pair():
    r = np.random.default_rng(3)
    rows, y = [], []
    for _ in range(4000):
        a, b = r.random() < 0.5, r.random() < 0.5
        rows.append(np.array([1] * a + [2] * b + [10 + r.integers(50)]))
        y.append(int(a and b))
    m = toxicity.fit(rows, np.array(y), bits=8)
    k = {int(c): i for i, c in enumerate(np.flatnonzero(m.slot >= 0))}
    assert (m.v[k[1]] * m.v[k[2]]).sum() > 0.1


# SimHash


def plain_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if not words:
        return 0
    runs = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [b" ".join(words)]
    hs = [xxhash.xxh64_intdigest(x, 42) for x in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def plain_components(nodes, linked):
    comp = {n: n for n in nodes}

    def find(n):
        while comp[n] != n:
            n = comp[n]
        return n

    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if linked(a, b):
                comp[max(find(a), find(b))] = min(find(a), find(b))
    return {n: find(n) for n in nodes}


def test_simhash(spark):
    df = table(spark)
    got = by_id(simhash.near_duplicates(clashing(df)))
    rows = [(r.doc_id, r.text) for r in df.collect()]
    assert sorted(f"{plain_fingerprint(t):016x}" for _, t in rows) == sorted(r[1] for r in got)
    prints = sorted({plain_fingerprint(t) for _, t in rows})
    comp = plain_components(prints, lambda a, b: (a ^ b).bit_count() <= 3)
    least = {}
    for i, t in rows:
        c = comp[plain_fingerprint(t)]
        least[c] = min([x for x in (least.get(c), i) if x is not None], default=None)
    assert sorted(((i, least[comp[plain_fingerprint(t)]]) for i, t in rows), key=str) == sorted(((r[0], r[2]) for r in got), key=str)
    assert simhash.near_duplicates(empty(spark)).count() == 0


def test_simhash_links_are_whole(spark):
    """Clouds of near fingerprints, chains, and lone ones: the components are those of all pairs."""
    r, prints = random.Random(9), set()
    for _ in range(12):
        c = r.getrandbits(64)
        prints.add(c)
        for _ in range(25):
            x = c
            for _ in range(r.randint(1, 6)):
                x ^= 1 << r.randrange(64)
            prints.add(x)
        for _ in range(6):  # a chain that leaves the cloud
            for _ in range(3):
                c ^= 1 << r.randrange(64)
            prints.add(c)
    prints |= {r.getrandbits(64) for _ in range(200)}
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    from corpusloom.llm._shared import Workspace

    df = spark.createDataFrame([(p, 1) for p in signed], "fp long, weight long")
    got = {x.node: x.comp for x in simhash.linked(df, Workspace(spark, "test")).collect()}
    want = plain_components(sorted(signed), lambda a, b: ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 3)
    assert {p: got.get(p, p) for p in signed} == want


def test_long_chains_are_one_component(spark, monkeypatch):
    """Chains whose ids are in random order, far longer than rounds can follow link by link."""
    from corpusloom.llm import buckets
    from corpusloom.llm._shared import Workspace

    ids = list(range(40_000))
    random.Random(5).shuffle(ids)
    chains = [ids[:20_000], ids[20_000:39_000], ids[39_000:]]
    df = spark.createDataFrame([p for c in chains for p in zip(c, c[1:], strict=False)], "a long, b long")
    got = {r.node: r.comp for r in buckets.components(df, Workspace(spark, "test"), "chains").collect()}
    assert got == {k: min(c) for c in chains for k in c}
    monkeypatch.setattr(buckets, "ROUNDS", 2, raising=False)
    with pytest.raises(RuntimeError):
        buckets.components(df, Workspace(spark, "test"), "chains")


# BPE


def test_bpe(spark):
    lib = Tokenizer.from_file(WORD)
    df = table(spark)
    rows = bpe.encode(clashing(df), WORD).collect()
    want = {(r.doc_id, r.text): lib.encode(r.text or "", add_special_tokens=False).ids for r in df.collect()}
    assert sorted((r.doc_id, list(r.ids)) for r in rows if r.doc_id is not None) == sorted((k[0], v) for k, v in [((r.doc_id, r.text), want[r.doc_id, r.text]) for r in df.collect()] if k[0] is not None)
    assert all(r.decoded == lib.decode(list(r.ids), skip_special_tokens=False) for r in rows)
    digests = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.encode_digests(df, WORD).collect()}
    assert digests == {(k[0], len(v), hashlib.sha256(" ".join(map(str, v)).encode()).hexdigest(), hashlib.sha256(lib.decode(v, skip_special_tokens=False).encode()).hexdigest()) for k, v in want.items()}
    assert bpe.encode_digests(empty(spark), WORD).count() == 0


def test_automaton_is_canonical():
    """Against merging step by step, on a small vocabulary with ties and overlaps."""
    merges = [("a", "b"), ("b", "a"), ("a", "a"), ("ab", "a"), ("aa", "b"), ("ab", "ab"), ("aba", "ba"), ("b", "b")]
    vocab = {"a": 0, "b": 1} | {u + v: k + 2 for k, (u, v) in enumerate(merges)}
    auto = bpe.Automaton(vocab, merges)
    rank = {m: k for k, m in enumerate(merges)}
    for n in range(1, 11):
        for bits in range(1 << n):
            word = "".join("ab"[bits >> k & 1] for k in range(n))
            parts = list(word)
            while True:
                best = min((rank.get(p, 99), k) for k, p in enumerate([*zip(parts, parts[1:], strict=False), ("", "")]))
                if best[0] == 99:
                    break
                parts[best[1] : best[1] + 2] = ["".join(parts[best[1] : best[1] + 2])]
            assert [auto.label[i] for i in auto.encode(word)] == parts, word


# shards


def test_shards_round_trip():
    out = io.BytesIO()
    out.close = lambda: None
    w = sstable.Writer(out)
    docs = [(None, 3), (-5, 0), (-5, 2), (0, 1), (7, 100_000), (8, 5), (1 << 40, 200_000), ((1 << 40) + 1, 9)]
    want = [(sstable.key_of(i), np.arange(n, dtype="<u2").tobytes()) for i, n in docs]
    for k, v in want:
        w.add(k, v)
    w.close()
    r = sstable.Reader(out)
    assert list(r) == want and len(r.index) > 1 and (r.docs, r.ids) == (len(docs), sum(n for _, n in docs))
    assert r.get(sstable.key_of(-5)) == [want[1][1], want[2][1]] and r.get(sstable.key_of(1 << 40)) == [want[6][1]] and r.get(sstable.key_of(99)) == []
    assert [sstable.id_of(k) for k, _ in r] == [i for i, _ in docs]
    with pytest.raises(ValueError):
        w.keys and w.add(sstable.key_of(-9), b"")


def test_sstable(spark, monkeypatch):
    monkeypatch.setattr(sstable, "SHARD_BYTES", 4000)
    lib, df = Tokenizer.from_file(WORD), table(spark)
    rows = sorted(((r.doc_id, r.text or "") for r in df.collect()), key=lambda r: (r[0] if r[0] is not None else -(1 << 63), r[1]))
    want, start = [], 0
    for i, t in rows:
        ids = lib.encode(t, add_special_tokens=False).ids + [1]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(by_id(sstable.written_and_read(clashing(df), WORD)), key=lambda r: r[1]) == want
    assert sstable.written_and_read(empty(spark), WORD).count() == 0


# archives


@pytest.mark.parametrize("version", [1, 2])
def test_archive(spark, version):
    rows = [(1, "http://a.example/x y", "<p>a</p>"), (2, None, "<p>a</p>"), (3, "http://b.example/é", None), (4, "", ""), (5, "http://c", "\r\n\r\nHTTP/1.1 x\n"), (6, "http://d", "é" * 50_000), (None, "http://e", "<p>a</p>"), (2, None, "<p>a</p>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1))
    got = by_id(warc.archive(df, version))
    largest = {}
    for i, _, h in rows:
        largest[h or ""] = max(largest.get(h or "", -1), i if i is not None else -1)
    seen, want = set(), []
    for i, _, h in sorted(rows, key=lambda r: r[0] or 0):
        data, holder = (h or "").encode(), largest[h or ""]
        first = i == holder and (i, h or "") not in seen
        seen.add((i, h or ""))
        want.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if first else "revisit", None if first else holder))
    assert got == sorted(want, key=lambda r: (r[0] is not None, r[0] or 0, str(r)))
    assert warc.archive(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_arc_lines():
    head = warc.parse_arc_line("http://x/a b 1.2.3.4 20010203040506 text/html 12", warc.FIELDS[1])
    assert head["URL"] == "http://x/a b" and head["Archive-length"] == "12"
    with pytest.raises(ValueError):
        warc.parse_arc_line("http://x text/html", warc.FIELDS[1])
    assert warc.iso_date("20010203040506") == "2001-02-03T04:05:06Z"
