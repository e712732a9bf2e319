"""What only shows in long texts, repeated ids, hot buckets and interactions: each against a plain version."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_llm_operators import BYTE, SCHEMA, WORD, plain_components, plain_shingles, prose
from tokenizers import Tokenizer

from corpusloom.llm import _shared, bpe, buckets, langid, minhash, simhash, tokencount, toxicity, words
from corpusloom.llm._shared import Workspace

M = (1 << 64) - 1


# fingerprints


def plain_signature(text):
    """The permutations in whole numbers, one shingle at a time."""

    def scrambled(h):
        h = ((h ^ (h >> 30)) * 0xBF58476D1CE4E5B9) & M
        h = ((h ^ (h >> 27)) * 0x94D049BB133111EB) & M
        return h ^ (h >> 31)

    def rolled(values):
        return scrambled((sum(v * pow(0x9E3779B97F4A7C15, k, 1 << 64) for k, v in enumerate(values)) + len(values)) & M)

    own = (text or "").encode().translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))).split()
    hashes = [rolled([int(_shared._BYTES[b]) for b in w]) for w in own]
    runs = [rolled(hashes[i : i + 5]) for i in range(max(1, len(hashes) - 4))] if hashes else []
    return [min(((int(a) * (r >> 32) + int(b)) & M for r in runs), default=M) >> 32 for a, b in zip(minhash._A, minhash._B, strict=True)]


def test_signatures_against_a_plain_version():
    many = [None, "", "one", "one two", "ÉA b c d e", prose(12, 1), prose(40, 2), "a b c d e f a b c d e f"]
    assert minhash.signatures(pa.array(many)).tolist() == [plain_signature(t) for t in many]


def test_bands_find_what_all_pairs_find():
    """Recall of bands against shingle sets at 0.8, on copies of many degrees."""
    r, found, there = random.Random(4), 0, 0
    for k in range(300):
        one = prose(120, 5000 + k).split()
        other = list(one)
        for _ in range(r.randint(1, 4)):
            other[r.randrange(len(other))] = "changed"
        a, b = " ".join(one), " ".join(other)
        x, y = plain_shingles(a), plain_shingles(b)
        if len(x & y) / len(x | y) >= minhash.SIMILAR:
            s = minhash.signatures(pa.array([a, b])).reshape(2, minhash.BANDS, minhash.ROWS)
            there, found = there + 1, found + bool((s[0] == s[1]).all(axis=1).any())
    assert there > 50 and found / there >= 0.98


# token counts


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_long_texts_are_counted_past_every_split(path):
    lib, own = Tokenizer.from_file(path), tokencount.Counter(path)
    long = [prose(40_000, 21), "x" * 200_000, (prose(500, 22) + "\n\n é ") * 60, "1 " * 80_000]
    assert min(map(len, long)) > 2 * tokencount.PART
    assert own.counts(long).tolist() == [len(lib.encode(t, add_special_tokens=False).ids) for t in long]


# language


def test_language_samples_ids_not_rows(spark, monkeypatch):
    """10,000 rows of one id are one row; each language gives `sample` ids; more languages than LANGS: the largest."""
    seen = {}
    monkeypatch.setattr(langid, "fit", lambda rows, langs, steps=0: seen.update(n=len(rows), langs=langs) or langid.Codes([], np.ones((0, 1)), None, None, None))
    rows = [(7, prose(5, k), "en", "s", 1) for k in range(10_000)] + [(k, prose(5, k), "de" if k % 2 else "en", "s", 1) for k in range(100, 400)] + [(k, "rare words", f"r{k}", "s", 1) for k in range(5)]
    df = spark.createDataFrame(rows, SCHEMA)
    langid.learn(df, sample=50)
    assert seen["langs"].count("en") == seen["langs"].count("de") == 50 and seen["n"] == 105
    langid.learn(df.where("doc_id = 7"), sample=50)
    assert seen["langs"] == ["en"]
    monkeypatch.setattr(langid, "LANGS", 2)
    langid.learn(df, sample=50)
    assert set(seen["langs"]) == {"en", "de"}


def test_decoding_takes_the_nearest_codeword():
    """Against all codewords and losses one by one."""
    r = np.random.default_rng(8)
    langs = [f"l{k}" for k in range(7)]
    code = langid.codewords(7)
    codes = langid.Codes(langs, code, r.normal(size=(1 << langid.BITS, code.shape[1])), r.normal(size=code.shape[1]), r.random(code.shape[1]))
    for text in [prose(9, k) for k in range(20)]:
        cells = langid.grams(text)
        share = {c: (cells == c).mean() ** 0.5 for c in cells}
        margin = [sum(x * codes.w[c, b] for c, x in share.items()) + codes.bias[b] for b in range(code.shape[1])]
        loss = [sum(t * np.log1p(np.exp(-c * m)) for t, c, m in zip(codes.trust, code[k], margin, strict=True)) for k in range(7)]
        assert codes.decode(text)[0] == langs[int(np.argmin(loss))]


# toxicity


@pytest.mark.parametrize("name", ["either", "unless both", "both"])
def test_learn_finds_interactions(spark, name):
    """Labels that no word tells alone: held-out accuracy, and a plain score of the machine's weights."""
    label = {"either": lambda a, b, c: a != b, "unless both": lambda a, b, c: a and not (b and c), "both": lambda a, b, c: a and b}[name]
    r, rows, y = random.Random(3), [], []
    for k in range(3000):
        has = [r.random() < 0.5 for _ in range(3)]
        rows.append((k, " ".join([prose(25, k), *(w for w, h in zip(["qqalpha", "rrbeta", "ssgamma"], has, strict=True) if h), prose(25, k + 9000)]), "en", "s", 1))
        y.append(int(bool(label(*has))))
    df = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame(list(enumerate(y)), "doc_id long, toxic int")
    machine = toxicity.learn(df, labels, allowed=~toxicity.held_out())
    out = [k for k in range(3000) if zlib.crc32(str(k).encode()) % 5 == 0]
    scores = machine.score(pa.array([rows[k][1] for k in out]))
    assert np.mean([(s >= 0.5) == y[k] for s, k in zip(scores, out, strict=True)]) > 0.9
    slot = {int(c): i for i, c in enumerate(np.flatnonzero(machine.slot >= 0))}
    for k, s in list(zip(out, scores, strict=True))[:50]:
        on = sorted({slot[int(c)] for c in toxicity.terms(pa.array([rows[k][1]]))[1] if int(c) in slot})
        pairs = sum(float(machine.v[i] @ machine.v[j]) for n, i in enumerate(on) for j in on[:n])
        assert 1 / (1 + np.exp(-(machine.bias + sum(machine.w[i] for i in on) + pairs))) == pytest.approx(s)


def test_toxicity_samples_ids_not_rows(spark, monkeypatch):
    seen = {}
    monkeypatch.setattr(toxicity, "fit", lambda rows, labels, **more: seen.update(n=len(rows)) or toxicity.Machine(0.0, np.zeros(0, np.int64), np.zeros(0), np.zeros((0, 8))))
    rows = [(7, prose(5, k) + " bad", "en", "s", 1) for k in range(5000)] + [(k, prose(5, k), "en", "s", 1) for k in range(100, 140)]
    labels = [(7, 1)] * 100 + [(k, k % 2) for k in range(100, 140)]
    toxicity.learn(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, toxic int"), sample=30)
    assert seen["n"] == 30
    toxicity.learn(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert seen["n"] == 41


# SimHash


def test_finer_masks_miss_no_link():
    r = random.Random(2)
    for _ in range(3000):
        a = r.getrandbits(64)
        b = a
        for _ in range(3):
            b ^= 1 << r.randrange(64)
        for mask, finer in zip(simhash.block_masks(), simhash.finer_masks(), strict=True):
            if (a ^ b) & mask & M == 0:
                assert any((a ^ b) & f & M == 0 for f in finer)


def test_unlinked_members_of_one_bucket_are_not_paired(spark):
    """3,000 fingerprints that share a key and nothing else: few pairs, and still every link."""
    r, key = random.Random(6), simhash.block_masks()[0]
    free = ~key & M
    prints = [r.getrandbits(64) & free for _ in range(3000)]
    prints += [p ^ (1 << b) for p, b in zip(prints[:40], [k for k in range(64) if free >> k & 1] * 2, strict=False)]
    signed = sorted({p - (1 << 64) if p >> 63 else p for p in prints})
    placed = spark.createDataFrame([(0, 0, p, p) for p in signed], "t int, key long, node long, comp long")
    finer = F.array(*(F.array(*map(F.lit, ms)) for ms in simhash.finer_masks()))
    pairs = buckets.late_pairs(placed, lambda node, t: F.transform(F.element_at(finer, t + 1), lambda x: node.bitwiseAND(x)))
    assert pairs.count() < 60 * len(signed)  # all pairs: 9 million
    got = {x.node: x.comp for x in simhash.linked(spark.createDataFrame([(p, 1) for p in signed], "fp long, weight long"), Workspace(spark, "test")).collect()}
    want = plain_components(signed, lambda a, b: ((a ^ b) & M).bit_count() <= 3)
    assert {p: got.get(p, p) for p in signed} == want


# BPE


def test_long_texts_and_words():
    """Past the parts of a long text, words longer than a walk in step and than a hashed piece, and a full lexicon."""
    lib, own = Tokenizer.from_file(WORD), bpe.TextCoder(WORD)
    texts = [prose(260_000, 31), "abcdefgh" * 5000, "é" * 300 + " " + "it's" * 200, "x" * 49 + " " + "y" * 65 + " 日本" * 40, prose(30, 2), ""]
    assert len(texts[0]) > 1 << 20
    for column in (pa.array(texts), *(pa.array([t]) for t in texts)):
        for t, (n, of_ids, of_text) in zip(column.to_pylist(), own.digests(column), strict=True):
            ids = lib.encode(t, add_special_tokens=False).ids
            assert (n, of_ids) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
            assert of_text == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    own.words.most = 20
    for k in range(6):
        t = prose(50, 700 + k) + f" only{k} 'tis"
        assert own.encode(t) == lib.encode(t, add_special_tokens=False).ids
    with pytest.raises(ValueError):
        bpe.TextCoder(BYTE)


def test_pieces_are_the_vocabularys():
    lib, r = Tokenizer.from_file(WORD), random.Random(1)
    signs = "aAsStTrReEvVlLmMdD" + 3 * "'" + "é×É  \n\t12.,<|>ß\x1c\x00\xa0　日́"
    written = {b: chr(bpe.BYTE_SYMBOLS.get(b, b)) for b in range(256)}
    many = ["".join(r.choice(signs) for _ in range(r.randint(0, 14))) for _ in range(5000)]
    data, offs = _shared.utf8(pa.array(many))
    low, starts, ends, odd, bounds = words.pieces(data, offs)
    for k, t in enumerate(many):
        got = []
        for i in range(bounds[k], bounds[k + 1]):
            if odd[i]:
                got += [w for w, _ in lib.pre_tokenizer.pre_tokenize_str(lib.normalizer.normalize_str(data[starts[i] : ends[i]].tobytes().decode()))]
            else:
                got.append("".join(written[b] for b in low[starts[i] : ends[i]].tolist()))
        assert got == [w for w, _ in lib.pre_tokenizer.pre_tokenize_str(lib.normalizer.normalize_str(t))], t


def test_compiled_table_against_merging():
    """Every word up to 7 symbols of three, over a vocabulary with ties, overlaps, word ends and tokens that cannot come about."""
    merges = [("a", "b"), ("b", "a</w>"), ("a", "a"), ("ab", "a"), ("aa", "b</w>"), ("b", "c"), ("ab", "ab"), ("a", "bc"), ("aa", "a"), ("aba", "bc"), ("c", "c</w>"), ("abc", "cc</w>"), ("bc", "bc")]
    vocab = {t: k for k, t in enumerate([s + e for s in "abc" for e in ("", "</w>")] + [u + v for u, v in merges])}
    auto, rank = bpe.Automaton(vocab, merges, "</w>"), {m: k for k, m in enumerate(merges)}
    for n in range(1, 8):
        for m in range(3**n):
            word = "".join("abc"[m // 3**k % 3] for k in range(n))
            parts = [*word[:-1], word[-1] + "</w>"]
            while True:
                best = min((rank.get(p, 99), k) for k, p in enumerate([*zip(parts, parts[1:], strict=False), ("", "")]))
                if best[0] == 99:
                    break
                parts[best[1] : best[1] + 2] = ["".join(parts[best[1] : best[1] + 2])]
            assert auto.decode(auto.encode(word)) == parts == auto.decode(auto.walk_alone([auto.symbol[c] for c in word])), word
