"""The corpus pipeline against a brute-force version of its stages."""

import re

import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from civiclens.llm import langid, merge_dropout, spaced_seeds
from tests.conftest import SF_SMALL
from tests.llm.test_text_operators import FOREIGN, brute_join, brute_overlaps, python_spans


def brute_redaction(text):
    """Strong spans masked, overlapping ones as one (the small table has no weak parts to link)."""
    out, at = [], 0
    for start, end in sorted(tuple(map(int, s.split(":")[1:])) for s in python_spans(text).split(",") if s):
        if end <= at:
            continue
        if start >= at:
            out += [text[at:start], "[SECRET]"]
        at = end
    return "".join(out) + text[at:]


def test_pipeline_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").collect()]
    # language id: what the model rejects, which here is nothing that has a letter
    rejected = {r.doc_id for r in langid.predict(docs, langid.train(docs)).where("rejected").collect()}
    assert rejected == {d for d, r in rows.items() if not re.search(r"[^\W\d_]", r.text or "")}
    left = [(d, r.text) for d, r in rows.items() if d not in rejected]
    left = [(d, t) for d, t in left if any(key[0] == d == key[2] for key in _components(left)[d])]
    bad = {d for d, _ in brute_overlaps(left, items)}
    want = {d: brute_redaction(t) for d, t in left if d not in bad}
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, SF_SMALL).collect()}
    assert got.keys() == want.keys() and 0 < len(bad) < len(rows) > len(left)
    v = merge_dropout.load_vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    import numpy as np
    for d, text in want.items():
        r = got[d]
        data, _ = merge_dropout.decode_ids(v, np.array(r.ids), np.array([0, len(r.ids)]))
        assert data.tobytes().decode() == text and r.lossless and r.n_tokens == len(r.ids)
        assert (r.lang, r.source) == (rows[d].lang, rows[d].source)


_SEEN = {}


def _components(rows):
    """The brute-force rows (doc_id, size, component) of each id, with five words and 80 percent."""
    key = len(rows)
    if key not in _SEEN:
        _SEEN[key] = {}
        for row in brute_join(rows, 5, 80):
            _SEEN[key].setdefault(row[0], []).append(row)
    return _SEEN[key]


def test_stages_take_edge_rows(spark, edge):
    docs = edge.select("doc_id", "text", "lang", F.lit("s").alias("source"), F.length("text").cast("long").alias("n_chars"))
    for rows in (docs, docs.where("false")):
        for name, stage in corpus_pipeline.STAGES:
            rows = stage(spark, rows, SF_SMALL)
            if name != "tokenization":
                assert rows.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        assert all(r.lossless for r in rows.collect())


def test_a_leak_goes_and_its_neighbour_stays(spark):
    item = spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").first().text
    words = item.split()
    words[3] = "substituted"
    docs = spark.createDataFrame([(1, f"before {' '.join(words)} after", "en", "s", 1), (2, "nothing of the kind stands here", "en", "s", 1)],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    assert [r.doc_id for r in corpus_pipeline.benchmark_decontamination(spark, docs, SF_SMALL).collect()] == [2]
    assert spaced_seeds.find(docs, spark.read.parquet(f"{SF_SMALL}/benchmark.parquet")).count() >= 1


def test_language_stage_drops_foreign_texts(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    planted = spark.createDataFrame([(-1 - i, t, None, "s", len(t)) for i, t in enumerate(FOREIGN)],
                                    "doc_id long, text string, lang string, source string, n_chars long")
    columns = list(corpus_pipeline.COLUMNS)
    left = corpus_pipeline.language_id(spark, docs.select(*columns).unionByName(planted), SF_SMALL)
    assert {r.doc_id for r in left.collect()} == {r.doc_id for r in docs.where("text rlike '\\\\p{L}'").collect()}


def test_rows_are_decided_one_by_one(spark):
    words = [f"w{k}" for k in range(200)]
    a, bridge, b = (" ".join(words[k : k + 160]) for k in (0, 15, 30))  # the bridge is near both, which are not near each other
    item = spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").first().text
    rows = [(5, a), (5, "a text of its own that stands under the id of a copy"), (4, a), (4, a), (None, bridge), (6, b), (None, "only here, without an id"),
            (None, "only here, without an id"), (8, ""), (8, ""), (9, item), (9, "clean text beside a leak")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    left = corpus_pipeline.jaccard_deduplication(spark, docs, SF_SMALL)
    kept = sorted((r.doc_id or 0, r.text) for r in left.collect())
    assert kept == sorted([(4, a), (5, rows[1][1]), (0, rows[6][1]), (8, ""), (8, ""), (9, item), (9, rows[11][1])])
    assert [(r.doc_id, r.text) for r in corpus_pipeline.benchmark_decontamination(spark, docs.where("doc_id = 9"), SF_SMALL).collect()] == [(9, rows[11][1])]
