"""Language identification: averaged hashed subword embeddings with a linear softmax.

A document is the mean of the embeddings of its hashed byte n-grams (2 to 4 bytes, A-Z lowered,
white space as one boundary mark), followed by a linear layer and a softmax over the languages.
Embeddings and layer are trained by minibatch gradient descent in numpy on a bounded sample of
labelled rows (`per_language` rows of each language, `sample_rows` in all: documented parameters);
the temperature and the rejection threshold are fitted on a quarter of the sample that training
did not see. Prediction covers every row and every byte of its text.

Rejection does not go by the softmax, whose best of two languages is 0.5 or more for any text, but by
familiarity: the mean, over the n-grams of letters and white space, of the log2 frequency in the predicted
language's sample against an even spread. The threshold leaves one language out in turn on the held-out
quarter: its texts, predicted as one of the others, stand for foreign ones. It is the least that rejects
`reject` of them, or, where that would lose more, the one that loses a share of 1 - `keep` of the texts
predicted right. With a single language it is the latter.

Defined results. A text that is null or has no letter: language `und`, score 0, rejected. A text without
any n-gram of letters (a single byte) tells nothing and is rejected, if there is a model. Rows with
null text or null label are not trained on. Without any labelled row every prediction is `und` with
score 0, and only rows without a letter are rejected. Repeated rows are predicted alike. An empty
table gives an empty result. Columns of the input are kept; a column with the name of an output
column is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from .arrays import LOWER, SPACE, flat_bytes, pieces

BUCKETS = 1 << 14
UNKNOWN = "und"
#: Bytes of letters and white space: familiarity leaves digits and punctuation out.
PLAIN = SPACE.copy()
PLAIN[65:91] = PLAIN[97:123] = PLAIN[128:] = True


@dataclass(frozen=True)
class Model:
    languages: list[str]
    table: np.ndarray  # BUCKETS x languages: embeddings times the linear layer
    bias: np.ndarray
    temperature: float
    familiar: np.ndarray  # languages x BUCKETS: log2 of the frequency against an even spread
    threshold: float  # of the mean of familiar


def _grams(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For n = 2, 3, 4: the bucket of the n-gram that starts at each byte, which of them lie in one row, and
    which of these are plain."""
    code = np.where(SPACE[data], np.uint8(32), LOWER[data]).astype(np.uint32)
    left = np.repeat(offsets[1:], np.diff(offsets)) - np.arange(len(data))
    key = code.copy()
    good = PLAIN[data]
    plain = good.copy()
    for n in (2, 3, 4):
        m = max(0, len(key) - n + 1)
        key[:m] = key[:m] * np.uint32(257) + code[n - 1 :][:m]
        hashed = (key * np.uint32(2654435761) + np.uint32(n * 97)) >> np.uint32(18)
        plain[:m] &= good[n - 1 :][:m]
        ok = left >= n
        yield hashed, ok, ok & plain


def _row_ids(offsets: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(label, text) to (label, buckets, counts, plain): 10 bytes for each distinct n-gram of a text."""
    for batch in batches:
        for part in pieces(batch, "text", 1 << 20):
            data, offsets = flat_bytes(part.column("text"))
            buckets, counts, plain = [], [], []
            for a, b in zip(offsets[:-1], offsets[1:], strict=True):
                row, good = (np.concatenate(x) for x in zip(*((h[ok], good[ok]) for h, ok, good in _grams(data[a:b], np.array([0, b - a]))), strict=True))
                u, at, c = np.unique(row, return_inverse=True, return_counts=True)
                buckets.append(u.astype("<u2").tobytes())
                counts.append(c.astype("<f4").tobytes())
                plain.append(np.bincount(at, weights=good, minlength=len(u)).astype("<f4").tobytes())
            yield pa.RecordBatch.from_arrays([part.column("label"), *(pa.array(x, pa.binary()) for x in (buckets, counts, plain))],
                                             names=["label", "buckets", "counts", "plain"])


def sample(docs: DataFrame, text: str, label: str, per_language: int, sample_rows: int) -> list:
    """At most sample_rows labelled rows as n-gram counts: of each language the rows with the smallest
    hashes, about per_language of them. The fractions come from counts over all labelled rows."""
    rows = docs.where(F.col(text).isNotNull() & F.col(label).isNotNull()).select(
        F.col(label).cast("string").alias("label"), F.col(text).alias("text"))
    sizes = rows.groupBy("label").count().orderBy(F.desc("count"), "label").limit(sample_rows // 50).collect()
    each = min(per_language, sample_rows // max(1, len(sizes)))
    draw = F.pmod(F.xxhash64("text", F.lit("langid")), F.lit(1 << 30)) / (1 << 30)
    wanted = F.lit(False)
    for size in sizes:
        wanted = wanted | ((F.col("label") == size["label"]) & (draw < each / size["count"]))
    return rows.where(wanted).mapInArrow(_counts, "label string, buckets binary, counts binary, plain binary").limit(
        2 * sample_rows).collect() if sizes else []


def fit(rows: list, dimensions: int = 16, epochs: int = 12, rate: float = 0.5, keep: float = 0.999,
        reject: float = 0.99) -> Model:
    """Train on collected samples: minibatch gradient descent on embeddings and layer together."""
    languages = sorted({r["label"] for r in rows})
    if not languages:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0), 1.0, np.zeros((0, BUCKETS), np.float32), -np.inf)
    rng = np.random.default_rng(17)
    order = rng.permutation(len(rows))
    split = max(1, len(rows) * 3 // 4)
    label = np.array([languages.index(r["label"]) for r in rows])
    entries = [(np.frombuffer(r["buckets"], "<u2"), np.frombuffer(r["counts"], "<f4")) for r in rows]
    embed = rng.normal(0, 1 / dimensions, (BUCKETS, dimensions)).astype(np.float32)
    layer = np.zeros((dimensions, len(languages)), np.float32)
    layer += rng.normal(0, 1 / dimensions, layer.shape).astype(np.float32)
    bias = np.zeros(len(languages), np.float32)

    def mean(ids):
        lengths = np.array([len(entries[i][0]) for i in ids])
        buckets = np.concatenate([entries[i][0] for i in ids])
        weight = np.concatenate([entries[i][1] / max(1.0, entries[i][1].sum()) for i in ids])
        row = np.repeat(np.arange(len(ids)), lengths)
        out = np.zeros((len(ids), dimensions), np.float32)
        np.add.at(out, row, embed[buckets] * weight[:, None])
        return out, buckets, weight, row

    def softmax(z):
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        seen = rng.permutation(order[:split])
        for at in range(0, split, 32):
            ids = seen[at : at + 32]
            x, buckets, weight, row = mean(ids)
            g = softmax(x @ layer + bias)
            g[np.arange(len(ids)), label[ids]] -= 1
            back = g @ layer.T
            layer -= step * x.T @ g / len(ids) * 8
            bias -= step * g.mean(axis=0)
            np.add.at(embed, buckets, -step * 64 * back[row] * weight[:, None])
    held = order[split:] if split < len(rows) else order
    # 32 rows at a time, as in training: an n-gram takes many times its own bytes here
    z = np.concatenate([mean(held[at : at + 32])[0] for at in range(0, len(held), 32)]) @ layer + bias
    temperature = min((0.25, 0.5, 1.0, 2.0, 4.0), key=lambda t: -np.log(
        np.maximum(softmax(z / t)[np.arange(len(held)), label[held]], 1e-9)).mean())
    plain = [np.frombuffer(rows[i]["plain"], "<f4") for i in range(len(rows))]
    seen = np.zeros((len(languages), BUCKETS))
    for i in order[:split]:
        if plain[i].any():
            seen[label[i], entries[i][0]] += plain[i] / plain[i].sum()
    # a fiftieth is spread over all buckets, so that unseen ones count
    seen = seen / np.maximum(seen.sum(axis=1, keepdims=True), 1e-9) + 0.02 / BUCKETS
    familiar = np.log2(seen / seen.sum(axis=1, keepdims=True) * BUCKETS).astype(np.float32)
    told = [k for k, i in enumerate(held) if plain[i].any()]

    def familiarity(k: int, language: int) -> float:
        own = plain[held[k]]
        return float(familiar[language][entries[held[k]][0]] @ own / own.sum())

    best = z.argmax(axis=1)
    right = [familiarity(k, best[k]) for k in told if best[k] == label[held[k]]]
    others = np.where(np.arange(len(languages)) == label[held][:, None], -np.inf, z).argmax(axis=1)
    foreign = [familiarity(k, others[k]) for k in told] if len(languages) > 1 else []
    limits = [np.quantile(right, 1 - keep)] if right else []
    limits += [np.quantile(foreign, reject)] if foreign else []
    return Model(languages, embed @ layer, bias, float(temperature), familiar, float(min(limits, default=-np.inf)))


def train(docs: DataFrame, text: str = "text", label: str = "lang", per_language: int = 500,
          sample_rows: int = 8000) -> Model:
    """Fit a model on a bounded sample of the labelled rows of docs."""
    return fit(sample(docs, text, label, per_language, sample_rows))


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with lang_pred, score (calibrated probability, 0 to 1) and rejected."""
    names, temperature = model.languages, model.temperature
    table = docs.sparkSession.sparkContext.broadcast((model.table.astype(np.float32), model.familiar))  # 128 KB a language
    bias = model.bias.astype(np.float64)
    columns = [c for c in docs.columns if c.lower() not in ("lang_pred", "score", "rejected", "_letter", "_text")]
    fields = docs.select(*columns).schema.fields

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_bucket, familiar = np.ascontiguousarray(table.value[0].T), table.value[1].ravel()
        languages = pa.array(names, pa.string())
        for batch in batches:
            for part in pieces(batch, "_text", 1 << 20):
                data, offsets = flat_bytes(part.column("_text"))
                sums, size = np.zeros((len(names), part.num_rows)), np.zeros(part.num_rows)
                known_grams = []
                if len(data):
                    row = _row_ids(offsets)
                    for hashed, ok, plain in _grams(data, offsets):
                        known_grams.append((row[plain], hashed[plain]))
                        r, h = (row, hashed) if ok.all() else (row[ok], hashed[ok])
                        size += np.bincount(r, minlength=part.num_rows)
                        for k in range(len(names)):
                            sums[k] += np.bincount(r, weights=by_bucket[k][h], minlength=part.num_rows)
                letter = part.column("_letter").to_numpy(zero_copy_only=False).astype(bool)
                z = (sums / np.maximum(size, 1)).T + bias
                if names:
                    p = np.exp((z - z.max(axis=1, keepdims=True)) / temperature)
                    p /= p.sum(axis=1, keepdims=True)
                    best, score = p.argmax(axis=1), p.max(axis=1)
                    total, told = np.zeros(part.num_rows), np.zeros(part.num_rows)
                    for r, h in known_grams:
                        total += np.bincount(r, weights=familiar[best[r] * BUCKETS + h], minlength=part.num_rows)
                        told += np.bincount(r, minlength=part.num_rows)
                    strange = (told == 0) | (total / np.maximum(told, 1) < model_threshold)
                    known = pa.compute.if_else(pa.array(letter), languages.take(pa.array(best)), UNKNOWN)
                else:
                    strange = np.zeros(part.num_rows, bool)
                    score, known = np.zeros(part.num_rows), pa.array([UNKNOWN] * part.num_rows, pa.string())
                score = np.where(letter, score, 0.0)
                kept = [part.column(i) for i in range(len(columns))]
                yield pa.RecordBatch.from_arrays(
                    [*kept, known.cast(pa.string()), pa.array(score), pa.array(~letter | strange)],
                    names=[*columns, "lang_pred", "score", "rejected"])

    model_threshold = model.threshold
    schema = StructType([*fields, StructField("lang_pred", StringType()), StructField("score", DoubleType()),
                         StructField("rejected", BooleanType())])
    letter = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    return docs.select(*columns, letter.alias("_letter"), F.col(text).alias("_text")).mapInArrow(run, schema)
