"""Token files, merge-dropout, Kneser-Ney, neighbours and chat formatting: round trips, brute force, edge cases."""

import collections
import json
import math
import re
import unicodedata
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from civiclens.llm import chat_grammar, hilbert_ann, kneser_ney, merge_dropout, token_coder
from civiclens.llm.arrays import flat_bytes
from civiclens.llm.hash_arrays import open_store
from civiclens.llm.shared import stored
from tests.conftest import SF_SMALL
from tests.llm.conftest import TEXTS

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
PIECES, BYTES = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.json")


# -- 3: token files

@pytest.mark.parametrize("n", [0, 1, 4097])
def test_coder_round_trip(n):
    rng = np.random.default_rng(n)
    for ids in (np.minimum(rng.zipf(1.3, n), 65535), rng.integers(0, 65536, n), np.full(n, 65535), np.arange(n) % 3):
        ids = ids.astype(np.uint16)
        blocks = token_coder.encode_blocks(ids)
        sizes = np.minimum(token_coder.BLOCK, n - token_coder.BLOCK * np.arange(len(blocks)))
        assert (token_coder.decode_blocks(blocks, sizes) == ids).all()
        if len(blocks) > 1:  # blocks stand alone
            assert (token_coder.decode_blocks(blocks[1:], sizes[1:]) == ids[token_coder.BLOCK :]).all()


def test_predictable_ids_are_small():
    ids = np.tile(np.arange(200, dtype=np.uint16) * 251, 20)
    assert sum(map(len, token_coder.encode_blocks(ids))) < len(ids)


def test_damage_is_found():
    raw = bytearray(token_coder.pack(np.array([1]), np.array([5000]), (np.arange(5000) * 7 % 999).astype(np.uint16)))
    raw[-40] ^= 1
    with pytest.raises(ValueError):
        token_coder.unpack(bytes(raw))


def test_format_is_the_same():
    """Sizes and checksums of what the first version of the coder wrote."""
    rng = np.random.default_rng(7)
    for ids, want in ((np.minimum(rng.zipf(1.3, 9000), 65535), [(3746, 1122113268), (3710, 3811099662), (744, 1961336100)]), (rng.integers(0, 65536, 4097), [(8484, 3930370470), (10, 2101165051)]), (np.full(5000, 65535), [(20, 3654652985), (20, 2054234445)])):
        blocks = token_coder.encode_blocks(ids.astype(np.uint16))
        assert [(len(b), zlib.crc32(b)) for b in blocks] == want


class Counted:
    """The library, with the characters given to it counted."""

    def __init__(self, own):
        self.own, self.seen = own, 0

    def encode_batch_fast(self, texts, add_special_tokens):
        self.seen += sum(map(len, texts))
        return self.own.encode_batch_fast(texts, add_special_tokens=add_special_tokens)


def test_units_are_tokenized_once():
    from tokenizers import Tokenizer

    with open(BYTES) as f:
        model = f.read()
    odd = [chr(c) for c in range(0x3100) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c))[0] in "ZC"] + ["\U000e0001", "é", "字", "7", "'s", "<|endoftext|>"]
    texts = [*TEXTS, "", " ", "  a  b ", "a  b c\n d\t e \n\n f", *(f"x{c} {c}y {c} z {c}{c}  {c} " for c in odd)]
    texts = [t or "" for t in texts]
    library, ids = Tokenizer.from_str(model), token_coder.Ids(model, 2)
    ids.tokenizer = counted = Counted(ids.tokenizer)
    for held in (0, token_coder.HELD):  # forgetting changes nothing
        ids.held = token_coder.HELD + 1 if not held else ids.held
        got, sizes = ids.of(texts)
        want = [[*library.encode(t, add_special_tokens=False).ids, 2] for t in texts]
        assert got.tolist() == [i for w in want for i in w] and sizes.tolist() == [len(w) for w in want]
    counted.seen = 0
    got, sizes = ids.of(["some words come again and again"] * 1000)
    assert len(got) == 1000 * sizes[0] and counted.seen <= len("some words come again and again")


def test_whole_texts_where_the_file_needs_them():
    with open(BYTES) as f:
        spec = json.load(f)
    assert token_coder.cuts_at_spaces(json.dumps(spec))
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": None}, {"pre_tokenizer": spec["pre_tokenizer"] | {"add_prefix_space": True}},
                   {"added_tokens": [spec["added_tokens"][0] | {"rstrip": True}]}, {"added_tokens": [spec["added_tokens"][0] | {"content": "a b"}]}):
        assert not token_coder.cuts_at_spaces(json.dumps(spec | change))


def test_files_are_read_side_by_side(spark):
    rows = spark.range(0, 4000, 1, 4).selectExpr("id as doc_id", "repeat(concat('word ', id, ' '), 20) as text")
    parts = stored(token_coder.write_tokens(rows, BYTES, part_bytes=60_000))
    files = parts.count()
    tasks = token_coder.read_tokens(parts).groupBy(F.spark_partition_id()).agg(F.count("*"), F.min("start"), F.max("start")).collect()
    assert files > 8 and len(tasks) == files


def test_token_files(spark, edge, none):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BYTES)
    rows = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").limit(40).unionByName(edge.select("doc_id", "text"))
    parts = stored(token_coder.write_tokens(rows, BYTES, part_bytes=60_000))
    assert parts.count() > 1
    got = [(r.doc_id, r.start, r.n_tokens, r.crc) for r in token_coder.read_tokens(parts).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("crc")).collect()]
    want, at = [], 0
    for r in sorted(rows.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, (r.text or "").encode())):
        ids = [*t.encode(r.text or "", add_special_tokens=False).ids, 2]
        want.append((r.doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(got, key=lambda x: x[1]) == want
    first = parts.orderBy("part").first()
    store, path = open_store(first.path)
    assert store.open_input_stream(path).read()[:8] == token_coder.MAGIC
    empty = token_coder.write_tokens(none, BYTES)
    assert empty.count() == token_coder.read_tokens(empty).count() == 0


# -- 4: merge-dropout

@pytest.fixture(scope="module")
def vocabulary():
    return merge_dropout.load_vocabulary(PIECES)


def encoded(v, texts, variant=0, seed=1, dropout=0.0):
    ids, at = merge_dropout.encode_texts(v, *flat_bytes(pa.array(texts, pa.large_string())), np.full(len(texts), variant), seed, dropout)
    return [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)]


def test_without_dropout_equals_the_library(spark, vocabulary):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    texts = [r.text for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    # the library adds a space in front
    assert encoded(vocabulary, [" " + t for t in texts]) == [sp.encode(t) for t in texts]


def test_lockstep_equals_heap(spark, vocabulary, monkeypatch):
    texts = [r.text for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").limit(20).collect()]
    together = encoded(vocabulary, texts, 3, 5, 0.2)
    monkeypatch.setattr(merge_dropout, "LONG", 0)
    assert encoded(vocabulary, texts, 3, 5, 0.2) == together


def test_dropout_varies_and_decodes(spark, vocabulary, edge, none):
    texts = [t for t in TEXTS if t is not None]
    a, b = (encoded(vocabulary, texts, v, 1, 0.3) for v in (0, 1))
    assert a == encoded(vocabulary, texts, 0, 1, 0.3) and a != b and a != encoded(vocabulary, texts, 0, 2, 0.3)
    assert sum(map(len, a)) > sum(map(len, encoded(vocabulary, texts)))
    for dropout in (0.0, 0.1, 1.0):
        ids = merge_dropout.encode(edge, PIECES, dropout=dropout)
        back = merge_dropout.decode(ids.withColumnRenamed("ids", "own"), PIECES, ids="own")
        assert all(r.decoded == r.text for r in back.collect())
        assert all(r.decoded == r.text for r in merge_dropout.encode(edge, PIECES, dropout=dropout, decoded=True).collect())
    assert [r.ids for r in ids.where("text is null").collect()] == [None]
    assert merge_dropout.encode(none, PIECES).count() == 0


def test_each_occurrence_draws_for_itself(spark, vocabulary):
    whole = encoded(vocabulary, [" attention"])[0]
    one, = encoded(vocabulary, [" attention" * 2000], dropout=0.1)
    words, now = [], []
    for i in one:
        if now and vocabulary.piece_bytes[vocabulary.piece_at[i] : vocabulary.piece_at[i] + 1].tobytes() == b" ":
            words.append(tuple(now))
            now = []
        now.append(i)
    words.append(tuple(now))
    kinds = collections.Counter(words)
    assert len(words) == 2000 and len(kinds) > 8 and tuple(whole) in kinds  # more than eight in one document
    docs = spark.createDataFrame([(i, " attention") for i in range(400)], "doc_id long, text string")
    assert len({tuple(r.ids) for r in merge_dropout.encode(docs, PIECES).collect()}) > 8  # and over documents


def test_only_occurrences_with_a_skipped_merge_are_segmented_again(spark, vocabulary, monkeypatch):
    texts = [r.text for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").limit(20).collect()]
    calls, segmented = [], merge_dropout._segmented
    monkeypatch.setattr(merge_dropout, "_segmented", lambda v, data, starts, *a: calls.append(len(starts)) or segmented(v, data, starts, *a))
    units = [u for t in texts for u in re.findall(r" ?[^ \n\t]+", t)][:2000]
    a, b = encoded(vocabulary, units, 3, 5, 0.1), encoded(vocabulary, units)
    differ = sum(x != y for x, y in zip(a, b, strict=True))
    assert differ <= calls[1] < 2 * differ  # a skipped merge can leave the same pieces, made by another way


def test_reuse_changes_no_result(spark, vocabulary):
    texts = [r.text for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").limit(20).collect()]
    data, offsets = flat_bytes(pa.array(texts, pa.large_string()))
    together = encoded(vocabulary, texts, 3, 5, 0.2)
    salt = merge_dropout.mix(np.full(1, 5, np.uint64) + np.uint64(0x51ED27))[0]
    for text, ids in zip(texts, together, strict=True):
        raw = text.encode()
        want = []
        for m in re.finditer(rb"[\n\t]|(?: +|(?<=[^ ])|^)[^ \n\t]+| +", raw):
            with np.errstate(over="ignore"):
                key = merge_dropout.mix(merge_dropout.mix(np.full(1, 3, np.uint64) + salt) + np.uint64(m.start()))[0]
            unit, where = merge_dropout._symbols(vocabulary, np.frombuffer(m[0], np.uint8))
            with np.errstate(over="ignore"):
                want += merge_dropout.agenda(vocabulary, unit, where, key, 0.2).tolist()
        assert ids == want


# -- 5: Kneser-Ney

def tokens(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", (text or "").translate(LOWER)) if w] + ["</s>"]


class Brute:
    def __init__(self, texts):
        self.c, self.bi = collections.Counter(), collections.Counter()
        for t in texts:
            p = "<s>"
            for w in tokens(t):
                self.c[w] += 1
                self.bi[p, w] += 1
                p = w
        self.after, self.cu, self.left = collections.defaultdict(collections.Counter), collections.Counter(), collections.Counter()
        for (u, w), k in self.bi.items():
            self.after[u][min(k, 3)] += 1
            self.cu[u] += k
            self.left[w] += 1
        self.d, self.dl = (self.discounts(x.values()) for x in (self.bi, self.left))
        self.total, self.v = sum(self.left.values()), len(self.c)
        self.freed = sum(self.dl[min(k, 3)] for k in self.left.values()) / self.total

    @staticmethod
    def discounts(counts):
        n = collections.Counter(counts)
        y = n[1] / (n[1] + 2 * n[2]) if n[1] + n[2] else 0.5
        return [0] + [min(max(k - (k + 1) * y * n[k + 1] / n[k] if n[k] else k / 2, 0.05), k - 0.05) for k in (1, 2, 3)]

    def p(self, u, w):
        low = self.freed / (self.v + 1) + max(self.left[w] - self.dl[min(self.left[w], 3)], 0) / self.total
        if not self.cu[u]:
            return low
        k = self.bi[u, w]
        return max(k - self.d[min(k, 3)], 0) / self.cu[u] + sum(self.d[j] * self.after[u][j] for j in (1, 2, 3)) / self.cu[u] * low

    def score(self, text):
        p, total = "<s>", 0.0
        for w in tokens(text):
            total += math.log10(self.p(p, w))
            p = w
        return total


@pytest.mark.parametrize("range_bytes", [1 << 24, 40_000])
def test_scores_equal_brute_force(spark, range_bytes):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text")
    rows = docs.collect()
    model = kneser_ney.train(docs.where("doc_id % 3 <> 0"), range_bytes=range_bytes)
    brute = Brute([r.text for r in rows if r.doc_id % 3])
    n, v = sum(brute.c.values()), brute.v
    assert (model.tokens, model.types, model.documents) == (n, v, sum(r.doc_id % 3 > 0 for r in rows))
    got = {r.doc_id: r for r in kneser_ney.score(docs, model).collect()}
    for r in rows:
        g, t = got[r.doc_id], tokens(r.text)
        assert (g.n_tokens, g.n_known, g.train_tokens) == (len(t), sum(brute.c[w] > 0 for w in t), n)
        assert g.base_score == pytest.approx(sum(math.log10((brute.c[w] + 1) / (n + v + 1)) for w in t), abs=1e-6)
        assert g.score == pytest.approx(brute.score(r.text), abs=1e-6)
        assert g.perplexity == pytest.approx(10 ** (-g.score / g.n_tokens))


def test_busy_contexts_and_sums(spark):
    # one word precedes most tokens: its bigrams are dealt out by the second word
    rng = np.random.default_rng(2)
    texts = [" ".join(f"the w{k}" for k in rng.zipf(1.4, 60) if k < 5000) for _ in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model, brute = kneser_ney.train(docs, range_bytes=9000), Brute(texts)
    assert model.ranges > 3 and len(model.hot) > 1
    got = {r.doc_id: r.score for r in kneser_ney.score(docs, model).collect()}
    assert all(got[i] == pytest.approx(brute.score(t), abs=1e-6) for i, t in enumerate(texts))
    for u in ("<s>", "the", "never"):
        assert sum(brute.p(u, w) for w in [*brute.c, "unknown word"]) == pytest.approx(1)


def test_model_edges(edge, none):
    model = kneser_ney.train(edge)
    got = kneser_ney.score(edge, model)
    assert got.count() == edge.count() and {r.n_tokens for r in got.where("text is null or text = ''").collect()} == {1}
    assert kneser_ney.score(none, model).count() == 0
    untrained = kneser_ney.train(none)
    assert all(r.train_tokens == 0 and r.base_score == 0 and r.score == 0 for r in kneser_ney.score(edge, untrained).collect())


# -- 6: neighbours

def test_hilbert_curve_is_a_path():
    for d, bits in ((2, 4), (3, 3), (4, 2)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * d, indexing="ij"), -1).reshape(-1, d)
        keys = hilbert_ann.hilbert_keys(grid, bits)
        assert sorted(keys.tolist()) == list(range(len(grid)))
        assert (np.abs(np.diff(grid[np.argsort(keys)], axis=0)).sum(axis=1) == 1).all()


def brute_nearest(rows, k=20, every=20):
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], float)
    for i, v in zip(ids.tolist(), x, strict=True):
        if i % every == 0:
            score = (x * v).sum(axis=1)
            order = [j for j in np.lexsort((ids, -score)).tolist() if ids[j] != i][:k]
            yield i, [(int(ids[j]), float(score[j])) for j in order]


def test_recall_and_order(spark):
    rng = np.random.default_rng(6)
    for x in (rng.normal(size=(3000, 32)), rng.normal(size=(40, 16))[rng.integers(0, 40, 3000)] + 0.2 * rng.normal(size=(3000, 16))):
        rows = [(i, v.tolist()) for i, v in enumerate(x.astype(np.float32))]
        got = collections.defaultdict(list)
        for r in hilbert_ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).orderBy("query_id", "rank").collect():
            got[r.query_id].append((r.vec_id, r.score))
        want = dict(brute_nearest(rows))
        assert got.keys() == want.keys() and all(len(v) == 20 for v in got.values())
        assert sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want) / (20 * len(want)) >= 0.9
        exact = {(q, i): s for q in want for i, s in want[q]}
        for q, found in got.items():
            assert found == sorted(found, key=lambda p: (-p[1], p[0])) and q not in dict(found)
            assert all(s == pytest.approx(exact[q, i], abs=1e-12) for i, s in found if (q, i) in exact)


def test_equal_vectors_and_unusable_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [1.0, 0.5]) for i in range(200)] + [(300, [0.0, 1.0]), (300, [0.0, 1.0]), (320, [2.0, 0.0])]
    bad = [(400, None), (401, []), (402, [0.0, 0.0]), (403, [nan, 1.0]), (404, [inf, 1.0]), (405, [None, 1.0]), (406, [1.0, 2.0, 3.0]), (None, [9.0, 9.0])]
    frame = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>").withColumn("cell", F.lit("clash"))
    got = collections.defaultdict(list)
    for r in hilbert_ann.nearest(frame).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    want = dict(brute_nearest(list({i: (i, v) for i, v in rows}.values())))
    assert dict(got) == want
    few = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in hilbert_ann.nearest(few).collect()] == [(0, 1, 1, 2.0)]
    assert hilbert_ann.nearest(frame.where("false")).count() == 0


# -- 9: chat formatting

PIECE = ["<|im_start|>", "<|im_end|>", "<|", "|>", "\\", "\\b", "\\c", "\\n", "\n", "assistant", "user", "x", "é😀", "<", "im_end", "\\\\c"]


def test_round_trip(spark):
    rng = np.random.default_rng(7)
    rows = [(c, t, ["user", "assistant", "system", "assistant\n", "<|im_end|>", None][int(rng.integers(0, 6))],
             None if rng.random() < 0.1 else "".join(rng.choice(PIECE, int(rng.integers(0, 7))))) for c in range(150) for t in range(int(rng.integers(1, 6)))]
    rows += [(0, 0, "user", "tie"), (0, 0, "user", "tie"), (None, None, "assistant", "lost")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("clash"))
    whole = chat_grammar.format_conversations(turns)
    parsed = {r.conv_id: r for r in whole.withColumn("t", chat_grammar.parse(F.col("formatted"))).collect()}
    digests = {r.conv_id: r for r in chat_grammar.read_back(whole).collect()}
    conversations = collections.defaultdict(list)
    for c, t, role, text in rows:
        conversations[c].append(((t is not None, t or 0), role or "", text or ""))
    assert parsed.keys() == conversations.keys()
    for c, own in conversations.items():
        own.sort()
        r = parsed[c]
        assert r.n_broken == 0 and [(t.role, t.text) for t in r.t] == [(a, b) for _, a, b in own]
        said = [b for _, a, b in own if a == "assistant"]
        masked = [r.formatted[s.start : s.end] for s in r.loss_mask]
        assert [m.replace("\\c", "<|").replace("\\n", "\n").replace("\\b", "\\") for m in masked] == said
        assert digests[c].loss_chars == sum(map(len, said)) and digests[c].formatted_chars == len(r.formatted)


def test_plain_turns_are_left_alone(spark, none):
    turns = spark.createDataFrame([(1, 0, "user", "plain <b> a\\d |> text"), (1, 1, "assistant", "<|im_end|><|im_start|>assistant ok")],
                                  "conv_id long, turn long, role string, text string")
    got = chat_grammar.format_turns(turns).orderBy("turn").collect()
    assert [r.escaped for r in got] == [False, True]
    assert got[0].formatted == "<|im_start|>user\nplain <b> a\\d |> text<|im_end|>\n"
    assert chat_grammar.read_back(chat_grammar.format_conversations(turns.where("false"))).count() == 0
