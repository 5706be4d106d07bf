"""Token counts, phrase collocations and importance resampling: against the library, brute force and their SQL; edge cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from civiclens.llm import importance, phrases, queries, token_counts
from tests.conftest import SF_SMALL

BPE = public_tokenizers.path("byte_bpe_50k.json")


def lower(text):
    return (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def rows_of(df):
    columns = sorted(df.columns)
    return Counter(tuple(r[c] for c in columns) for r in df.collect())


def oracle(name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    out = con.sql(queries.ORACLE[name])
    order = np.argsort(out.columns)
    return Counter(tuple(r[i] for i in order) for r in out.fetchall())


# -- 11: token counts

@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(BPE)


@pytest.fixture(scope="module")
def merges():
    return token_counts.load_merges(BPE)


PARTS = ["a", "b", "s", "t", "re", "ve", "ll", "d", "m", "'", " ", "  ", "\n", "\t", "\r\n", " ", "\x1c", "\x85", "1", "23", "!", "...", "é", "日本", "😀", "<|endoftext|>",
         "<|endof", "text|>", "x" * 30, "'s", "'S", "\U000107bb", "ab" * 20]


def test_counts_equal_the_library(library, merges):
    rng = random.Random(1)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 30))) for _ in range(4000)]
    raw = [t.encode() for t in texts]
    counter = token_counts.Counter(merges)
    got = counter.rows(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(b) for b in raw])]))
    assert got.tolist() == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("word", [b"x" * 2048, b"ab" * 900, b"-" * 2047, b"a", "é日本😀".encode() * 60, random.Random(3).randbytes(1500), b"theing" * 300, b"xxxy" * 400])
def test_popping_equal_ranks_together_makes_the_same_merges(merges, word):
    assert token_counts.count_long(merges, word) == token_counts.count_short(merges, word)


def test_full_cache_and_long_words(library, merges, monkeypatch):
    monkeypatch.setattr(token_counts, "CACHED_WORDS", 3)
    text = "one two three four five six one two " + "xyz" * 3000 + " seven"
    counter = token_counts.Counter(merges)
    assert counter.rows(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)])).tolist() == [len(library.encode(text, add_special_tokens=False).ids)]
    assert len(counter.known) <= 3


def test_token_count_edges(edge, none, library):
    got = token_counts.count_tokens(edge, BPE, limit=3)
    assert {"score", "key", "text", "n_bytes", "n_tokens", "over_limit"} <= set(got.columns) and got.columns.count("n_tokens") == 1
    for r in got.collect():
        n = len(library.encode(r.text or "", add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit, r.score) == (len((r.text or "").encode()), n, n > 3, "clash")
    assert got.count() == edge.count() and token_counts.count_tokens(none, BPE).count() == 0


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError, match="byte-level"):
        token_counts.load_merges(public_tokenizers.path("word_bpe_49k.json"))


def test_op11_query(spark, library):
    rows = spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()
    want = Counter((r.doc_id, len((r.text or "").encode()), n := len(library.encode(r.text or "", add_special_tokens=False).ids), n > 1024) for r in rows)
    got = queries.op11_token_counts(spark, SF_SMALL)
    assert got.dtypes == [("doc_id", "bigint"), ("n_bytes", "bigint"), ("n_tokens", "bigint"), ("over_limit", "boolean")]
    assert Counter(map(tuple, got.collect())) == want


# -- 12: phrases

def brute_phrases(rows, least, longest=5):
    """rows: (lang, text). All surviving candidates as (lang, phrase, a, l, r, n, score)."""
    f, n, out = Counter(), Counter(), []
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f.update((lang, tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    found = {k: a for k, a in f.items() if a >= least and len(k[1]) > 1}
    for (lang, g), a in found.items():
        inside = any(a2 >= a and l2 == lang and len(h) > len(g) and any(h[i : i + len(g)] == g for i in range(len(h) - len(g) + 1)) for (l2, h), a2 in found.items())
        if not inside:
            score, k = min((1000 * a * n[lang] // (f[lang, g[:k]] * f[lang, g[k:]]), k) for k in range(1, len(g)))
            out.append((lang, " ".join(g), a, f[lang, g[:k]], f[lang, g[k:]], n[lang], score))
    return sorted(out)


def phrases_of(df, least, **kw):
    return sorted((r.lang, r.phrase, r.a, r.l, r.r, r.n, r.score) for r in phrases.collocations(df, least=least, **kw).collect())


@pytest.mark.parametrize("least", [2, 5, 20])
def test_phrases_equal_brute_force(spark, least):
    rng = random.Random(least)
    vocabulary = ["the", "The", "of", "and", "new", "york", "city", "é", "日本", "a\tb", "to  be", "x\x00y", "la"]
    rows = [(rng.choice(["en", "en", "fr", None]), "".join(rng.choice(vocabulary) + rng.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n", " ! "]) for _ in range(rng.randint(0, 60)))) for _ in range(60)]
    rows += [("en", "la la la la la la la la")] * 5 + [("fr", None), ("fr", ""), (None, " . "), ("en", "the same passage of more than five words, twice the same passage of more than five words")] * 3
    assert phrases_of(spark.createDataFrame(rows, "lang string, text string"), least) == brute_phrases(rows, least)


def test_phrases_when_slots_collide_and_batches_are_small(spark, monkeypatch):
    """Colliding slots only leave walks uncut; small batches only send more rows."""
    rows = [(r.lang, r.text) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    df = spark.createDataFrame(rows, "lang string, text string")
    want = phrases_of(df, 30)
    assert want
    original = phrases.frequent_slots
    monkeypatch.setattr(phrases, "frequent_slots", lambda *a: np.full_like(original(*a), 255))
    assert phrases_of(df, 30) == want
    monkeypatch.setattr(phrases, "frequent_slots", lambda *a: np.full_like(original(*a), 255) if len(a) > 3 else original(*a))
    monkeypatch.setattr(phrases, "WALKS", 50)
    assert phrases_of(df, 30) == want


def test_scores_beyond_64_bits(spark):
    n = 3 * 10**15
    rows = [("en", 0, "", n), ("en", 1, "a", 10**15), ("en", 1, "b", 2 * 10**15 - 1), ("en", 2, "a b", 10**15 - 7)]
    counts = spark.createDataFrame(rows, "lang string, words int, phrase string, n long")
    real = phrases.phrase_counts
    phrases.phrase_counts = lambda *a, **k: counts
    try:
        got = phrases.collocations(counts).first()
    finally:
        phrases.phrase_counts = real
    assert got.score == 1000 * (10**15 - 7) * n // (10**15 * (2 * 10**15 - 1))


def test_phrase_edges(edge, none):
    want = brute_phrases([(r.lang, r.text) for r in edge.collect()], 50)
    assert phrases_of(edge, 50) == want and want
    assert phrases.top_collocations(none).count() == 0
    top = phrases.top_collocations(edge, most=2, least=50).collect()
    for lang in {r.lang for r in top}:
        order = sorted((w for w in want if w[0] == lang), key=lambda w: (-w[6], -w[2], w[1].encode()))[:2]
        assert [(r.rank, r.phrase) for r in sorted(top, key=lambda r: r.rank) if r.lang == lang] == [(i, w[1]) for i, w in enumerate(order, 1)]


def test_op12_query_equals_its_sql(spark):
    got = rows_of(queries.op12_phrase_collocations(spark, SF_SMALL))
    assert got == oracle("op12_phrase_collocations")


# -- 13: importance

def brute_features(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
    return len(w), [" ".join(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def brute_resample(rows, target, percent=5, least=20):
    """rows: (doc_id, text). (doc_id, n_features, weight, score, rank) of each."""
    bucket = lambda f: zlib.crc32(f.encode()) % 10_000
    s, t = Counter(), Counter()
    parsed = [(i, *brute_features(x)) for i, x in rows]
    for _, _, fs in parsed:
        s.update(map(bucket, fs))
    for x in target:
        t.update(map(bucket, brute_features(x)[1]))
    S, T = sum(s.values()), sum(t.values())
    out = []
    for k, (i, n, fs) in enumerate(parsed):
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (S + 10_000) / ((s[b] + 1) * (T + 10_000)))) for b in map(bucket, fs))
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, n, k])
    pool = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0], r[6]))
    for rank, r in enumerate(pool[: percent * len(pool) // 100], 1):
        r[4] = rank
    return Counter(tuple(r[:5]) for r in out)


def test_checksums_of_all_lengths():
    rng = random.Random(7)
    texts = [None, "", " ", "One", "ÉCOLE é 日本 x1y", "a" * 63 + " " + "b" * 64 + " " + "c" * 700 + " d", "tail", "z " * 3 + "q" * 70_000 + " " + "r" * 300]
    texts += ["".join(rng.choice("abcZ 0-é\n") for _ in range(rng.randint(0, 50))) for _ in range(200)]
    doc, bucket, words = importance.features(pa.array(texts), 1 << 31)
    assert words.tolist() == [brute_features(t)[0] for t in texts]
    for k, t in enumerate(texts):
        assert sorted(bucket[doc == k].tolist()) == sorted(zlib.crc32(f.encode()) % (1 << 31) for f in brute_features(t)[1])


def resampled(df, target, **kw):
    return Counter((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in importance.resample(df, target, **kw).collect())


def test_resampling_equals_brute_force(spark, edge, none):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text")
    target = spark.read.parquet(f"{SF_SMALL}/benchmark.parquet")
    rows, aims = [tuple(r) for r in docs.collect()], [r.text for r in target.collect()]
    assert resampled(docs, target) == brute_resample(rows, aims)
    assert resampled(docs, target, percent=40, least_words=100) == brute_resample(rows, aims, 40, 100)
    mixed = edge.select("doc_id", "text", "score", F.lit("clash").alias("rank"), F.lit(1).alias("n"), F.lit(2).alias("before"), F.lit(3).alias("drawn"))
    assert resampled(mixed, target, percent=50, least_words=1) == brute_resample([(r.doc_id, r.text) for r in edge.collect()], aims, 50, 1)
    assert {"n", "before", "drawn"} <= set(importance.resample(mixed, target).columns)
    assert importance.resample(none, target.where("false")).count() == 0
    assert resampled(docs, target.where("false")) == brute_resample(rows, [])


def test_op13_query_equals_its_sql(spark):
    assert rows_of(queries.op13_importance_resampling(spark, SF_SMALL)) == oracle("op13_importance_resampling")
