"""N-gram Jaccard join by T-occurrence search (DivideSkip), with classes of linked documents.

A document's set holds the distinct word n-grams of its text (words [^\\x20\\x09-\\x0D]+, A-Z lowered;
with fewer words than n the whole sequence is one element). Two documents link when
100 * intersection >= percent * union. The result is exact up to 64-bit hashes of elements.

How the pairs are found, without listing all pairs of a group:

1. Documents with equal sets are one class (a 64-bit sum over the set); only classes are compared.
2. Sets of similar size share a scheme that cuts the hash range into D + 1 + E ranges, where D bounds
   the elements in which two linked sets of the scheme can differ. Linked sets agree in at least
   1 + E ranges. Each range gives a signature (scheme, range, sum of elements), and all rows of a signature
   are counted. Each set leaves out its E most common ones (of equally common ones those of the emptiest
   ranges, then by hash): whatever the two sets of a link leave out, of the ranges in which they agree the
   one that comes last in this order stays in both. So what many documents have in common, as a licence
   line or an empty range, makes no list unless it is most of them. The rest is the inverted index.
3. In each inverted list of several classes one member, drawn by hash, is the query of all others (a
   star, not all pairs). Pairs whose 1024-bit parity vectors differ in more bits than linked sets can
   differ in elements drop out.
4. Each query's candidates are searched in blocks with DivideSkip: short lists of the block's index
   are merged, long ones probed by binary search for candidates that can still reach the overlap.
5. Connected components of the links. Lists whose members are in different components get another
   star by another member, against members of other components only; after ROUNDS - 1 rounds the
   remaining pairs of different components in a list are compared, each (parity bound inside the join,
   step 4 for the rest). This makes the components exact: members of one need no further comparison.

Defined results. Null or empty texts and texts without words have n_shingles 0 and their own id as
component. Each input row gives one result row; repeated ids keep their rows, each with the component
of its own text. A null id is kept, and never is the smallest id of a component that has another.
An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .arrays import U64, flat_bytes, mix, pieces, word_hashes
from .components import joined
from .hash_arrays import GATHERED, HashArrays
from .shared import scratch, small_batches, stored

PARITY = 16  # words of 64 bits: near copies just below the limit still differ in more bits than linked sets can
#: Star rounds before the remaining pairs of different components are compared; the last places components only.
ROUNDS = 4


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """The sorted distinct hashed n-grams of each row."""
    h, rows = word_hashes(data, offsets)
    gram = np.zeros(max(0, len(h) - size + 1), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            gram = mix(gram * U64(3) + h[k : k + len(gram)] + U64(k))
        for a, b in zip(rows[:-1], rows[1:], strict=True):
            if b - a >= size:
                out = np.sort(gram[a : b - size + 1])
                yield out[np.concatenate([[True], out[1:] != out[:-1]])]
            elif b > a:
                whole = np.full(1, U64(b - a) << U64(56))
                for k in range(a, b):
                    whole = mix(whole * U64(5) + h[k])
                yield whole
            else:
                yield gram[:0]


@lru_cache(maxsize=None)
def _class(k: int) -> int:
    """Least size of the k-th class: 1, 2, ..., 8, 10, 12, 15, ... (a quarter more each)."""
    return 1 if k == 0 else max(_class(k - 1) + 1, _class(k - 1) * 5 // 4)


def _scheme_of(n: int) -> int:
    k = 0
    while _class(k + 1) <= n:
        k += 1
    return k


def signatures(tokens: np.ndarray, percent: int) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """Signatures of a sorted set in the scheme of its size, and in the next one if it can link into it: of each scheme
    those of all ranges, the elements of each range, and how many of them (E) may be left out."""
    n, out = len(tokens), []
    k = _scheme_of(n)
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(tokens ^ U64(0xA5A5A5A5DEADBEEF)), dtype=np.uint64)])
        for scheme in (k, k + 1):
            if scheme > k and 100 * n < percent * _class(scheme):
                continue
            most = 2 * (_class(scheme + 1) - 1) * (100 - percent) // (100 + percent)  # D
            spare = most and most // 3 + 2
            parts = most + 1 + spare
            edges = (np.arange(parts + 1, dtype=np.float64) * (2.0**64 / parts))
            at = np.searchsorted(tokens, edges[1:-1].astype(np.uint64))
            at = np.concatenate([[0], at, [n]])
            own = mix(sums[at[1:]] - sums[at[:-1]] + mix(U64(scheme) * U64(1 << 32) + np.arange(parts, dtype=np.uint64)))
            out.append((own, np.diff(at), spare))
    return out


def rarest(sig: np.ndarray, held: np.ndarray, spare: int, count: np.ndarray) -> np.ndarray:
    """Places of the signatures of one scheme that stay: all but the `spare` most common."""
    return np.lexsort((sig, -held, count))[: len(sig) - spare]


def _parity(tokens: np.ndarray) -> np.ndarray:
    bits = np.bincount((tokens >> U64(24)) % U64(64 * PARITY), minlength=64 * PARITY) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def _class_id(tokens: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(mix(tokens).sum(dtype=np.uint64, keepdims=True) + U64(len(tokens))).view(np.int64)


def sketches(docs: DataFrame, doc_id: str, text: str, size: int) -> DataFrame:
    """doc_id, h (hash of the text), n (set size), cls (class of equal sets), parity of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                n, cls, parity = [], [], []
                for tokens in shingle_sets(*flat_bytes(part.column("text")), size):
                    n.append(len(tokens))
                    cls.append(int(_class_id(tokens)[0]))
                    parity.append(_parity(tokens))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("h"), pa.array(n, pa.int64()), pa.array(cls, pa.int64()),
                     pa.array(parity, pa.list_(pa.int64()))], names=["doc_id", "h", "n", "cls", "parity"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, h long, n long, cls long, parity array<long>")


def divide_skip(query: np.ndarray, members: list[np.ndarray], percent: int) -> np.ndarray:
    """Positions of the members whose overlap with the query reaches percent of the union."""
    sizes = np.array([len(m) for m in members])
    required = -(-percent * (len(query) + sizes) // (100 + percent))  # overlap that each member must reach
    tokens = np.concatenate(members)
    member = np.repeat(np.arange(len(members)), sizes)
    at = np.minimum(np.searchsorted(query, tokens), len(query) - 1)
    inside = query[at] == tokens
    at, member = at[inside], member[inside]
    order = np.argsort(at, kind="stable")  # inverted lists of the query's elements, each sorted by member
    at, member = at[order], member[order]
    starts = np.searchsorted(at, np.arange(len(query) + 1))
    length = np.diff(starts)
    threshold = int(required.min())
    n_long = 0 if len(members) <= 8 else min(int(threshold / (0.0085 * np.log2(max(2, length.max(initial=0))) + 1)), threshold - 1)
    long = np.argsort(length, kind="stable")[len(query) - n_long :]
    is_long = np.zeros(len(query), bool)
    is_long[long] = True
    short = np.sort(member[~is_long[at]], kind="stable")  # merge of the short lists
    found, count = np.unique(short, return_counts=True)
    keep = count >= required[found] - n_long
    found, count = found[keep], count[keep]
    for k in long:  # probe
        row = member[starts[k] : starts[k + 1]]
        if len(row):
            place = np.minimum(np.searchsorted(row, found), len(row) - 1)
            count = count + (row[place] == found)
    return found[count >= required[found]]


def _hits(batch: pa.RecordBatch, size: int, percent: int) -> Iterator[pa.RecordBatch]:
    """The pairs of a batch that link, by blocks of whole rows with about 1 MB of either text: sets and hashes take many
    times the bytes of their texts."""
    for part in (p for x in pieces(batch, "x_text") for p in pieces(x, "q_text")):
        q, x = part.column("q").to_numpy(), part.column("x").to_numpy()
        sets = list(shingle_sets(*flat_bytes(part.column("x_text")), size))
        links = []
        cuts = [0, *(np.flatnonzero(q[1:] != q[:-1]) + 1).tolist(), len(q)]
        firsts = part.column("q_text").take(pa.array(cuts[:-1]))
        for a, b, mine in zip(cuts[:-1], cuts[1:], shingle_sets(*flat_bytes(firsts), size), strict=True):
            links.append(a + divide_skip(mine, sets[a:b], percent))
        hit = np.concatenate(links)
        yield pa.RecordBatch.from_arrays([pa.array(q[hit]), pa.array(x[hit])], names=["u", "v"])


def _verified(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (q, x) that link. texts: (cls, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _hits(batch, size, percent)

    both = pairs.join(texts.select(F.col("cls").alias("x"), F.col("text").alias("x_text")), "x").join(
        texts.select(F.col("cls").alias("q"), F.col("text").alias("q_text")), "q")
    return both.select("q", "x", "q_text", "x_text").mapInArrow(run, "u long, v long")


def _texts(docs: DataFrame, known: DataFrame, doc_id: str, text: str, size: int) -> DataFrame:
    """(cls, text) of the known classes, from the rows of their representatives. The wanted ids are looked up
    in mapped arrays, so that no other text is shuffled."""
    n = known.count()
    ids = HashArrays(scratch(docs.sparkSession, "wanted"), -(-n // GATHERED) or 1)
    ids.keep("id", known.select("rep").where("rep is not null"), lambda b: [mix(b.column("rep").to_numpy().astype(np.uint64))], least=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit, _ = ids.look("id", mix(batch.column("rep").to_numpy().astype(np.uint64)))
            for part in pieces(batch.filter(pa.array(hit)), "text"):
                mine = [int(_class_id(t)[0]) for t in shingle_sets(*flat_bytes(part.column("text")), size)]
                yield pa.RecordBatch.from_arrays([pa.array(mine, pa.int64()), part.column("text")], names=["cls", "text"])

    def classed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                mine = [int(_class_id(t)[0]) for t in shingle_sets(*flat_bytes(part.column("text")), size)]
                yield pa.RecordBatch.from_arrays([pa.array(mine, pa.int64()), part.column("text")], names=["cls", "text"])

    rows = docs.select(F.col(doc_id).cast("long").alias("rep"), F.col(text).alias("text")).where("text is not null")
    found = rows.where("rep is not null").mapInArrow(run, "cls long, text string")
    # classes that only rows without an id hold are looked up by the class
    nameless = rows.where("rep is null").select("text").distinct().mapInArrow(classed, "cls long, text string")
    return found.unionByName(nameless.join(known.where("rep is null").select("cls"), "cls", "left_semi").dropDuplicates(["cls"]))


def _can_link(percent: int, a: str, b: str) -> F.Column:
    """Sizes and parity vectors allow a link: a lower bound of the difference, so nothing is lost."""
    bits = sum((F.bit_count(F.col(f"{a}_p")[i].bitwiseXOR(F.col(f"{b}_p")[i])) for i in range(PARITY)), F.lit(0))
    na, nb = F.col(f"{a}_n"), F.col(f"{b}_n")
    return ((100 * F.least(na, nb) >= percent * F.greatest(na, nb))
            & (bits * (100 + percent) <= (na + nb) * (100 - percent)))


def link(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 3, percent: int = 90) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest linked id)."""
    return _linked(docs, doc_id, text, size, percent).select("doc_id", "n_shingles", "component_id")


def _linked(docs: DataFrame, doc_id: str, text: str, size: int, percent: int) -> DataFrame:
    """link's rows with h (hash of the text) and component (a class of the component, also where no row has an id)."""
    if not 80 <= percent <= 100:
        raise ValueError("the size classes hold for 80 to 100 percent")
    with small_batches(docs.sparkSession):  # all Python steps run in here; what is left to the caller are joins
        return _placed(docs, doc_id, text, size, percent)


def _placed(docs: DataFrame, doc_id: str, text: str, size: int, percent: int) -> DataFrame:
    sketch = stored(sketches(docs, doc_id, text, size), "sketch")
    filled = sketch.where("n > 0")
    classes = filled.groupBy("cls").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("parity").alias("p"))
    # signatures that two or more rows have; they are made anew from the texts when needed, not kept
    shingles = filled.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    sigs = HashArrays(scratch(docs.sparkSession, "signatures"), max(1, -(-shingles // (2 * GATHERED))))
    texts = docs.select(F.col(text).alias("text")).where("text is not null")

    def made(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, list[tuple[np.ndarray, int]], np.ndarray]]:
        """For the texts of about 1 MB: all signatures, for each scheme of each set its ranges' elements and E, and its class."""
        for part in pieces(batch, "text"):
            own, ranges, cls = [], [], []
            for tokens in shingle_sets(*flat_bytes(part.column("text")), size):
                if len(tokens):
                    for sig, held, spare in signatures(tokens, percent):
                        own.append(sig)
                        ranges.append((held, spare))
                        cls.append(_class_id(tokens))
            if own:
                yield np.concatenate(own), ranges, np.concatenate(cls)

    sigs.keep("sig", texts, lambda batch: (sig for sig, _, _ in made(batch)))

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for sig, ranges, cls in made(batch):
                hit, times = sigs.look("sig", sig, "sig_count")
                count = np.ones(len(sig), np.int64)
                count[hit] = times
                use, start = [], 0
                for held, spare in ranges:
                    end = start + len(held)
                    # linked sets agree in more than `spare` ranges
                    kept = start + rarest(sig[start:end], held, spare, count[start:end]) if hit[start:end].sum() > spare else held[:0]
                    use.append(kept[hit[kept]])
                    start = end
                cls = np.repeat(cls, [len(u) for u in use])
                yield pa.RecordBatch.from_arrays([pa.array(sig[np.concatenate(use)].view(np.int64)), pa.array(cls)], names=["sig", "cls"])

    lists = stored(texts.mapInArrow(shared, "sig long, cls long").distinct(), "lists")
    several = lists.groupBy("sig").agg(F.min("cls").alias("a"), F.max("cls").alias("b")).where("a < b").select("sig")
    members = stored(lists.join(several, "sig"), "members")
    known = stored(members.select("cls").distinct().join(classes, "cls"), "classes")
    side = lambda x: known.select(F.col("cls").alias(x), F.col("n").alias(f"{x}_n"), F.col("p").alias(f"{x}_p"))
    texts = stored(_texts(docs, known, doc_id, text, size), "texts")
    components = tested = None
    for turn in range(ROUNDS):
        # a star in each list that holds several components: one member against those of other components
        placed = members.withColumn("component", F.col("cls")) if components is None else members.join(
            components.withColumnRenamed("node", "cls"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
        placed = stored(placed, "placed")
        center = F.min(F.struct(F.xxhash64("cls", F.lit(turn)).alias("h"), "cls", "component")).alias("c")
        mixed = placed.groupBy("sig").agg(F.min("component").alias("a"), F.max("component").alias("b"), center).where("a < b")
        if turn == ROUNDS - 1:
            break
        stars = placed.join(mixed.select("sig", F.col("c.cls").alias("center"), F.col("c.component").alias("of")), "sig").where(
            "component <> of").select(F.least("cls", "center").alias("q"), F.greatest("cls", "center").alias("x")).distinct()
        stars = stars.join(side("x"), "x").join(side("q"), "q").where(_can_link(percent, "q", "x")).select("q", "x")
        stars = stored(stars if tested is None else stars.join(tested, ["q", "x"], "left_anti"), "stars")
        if not stars.head(1):
            break
        tested = stars if tested is None else tested.unionByName(stars)
        components = joined(components, stored(_verified(stars, texts, size, percent), "links"))
    # what is left: members of one list in different components, each pair
    left = placed.join(mixed.select("sig"), "sig").join(known.select("cls", "n", "p"), "cls")
    a = left.select("sig", F.col("cls").alias("q"), F.col("component").alias("q_c"), F.col("n").alias("q_n"), F.col("p").alias("q_p"))
    b = left.select(F.col("sig").alias("sig2"), F.col("cls").alias("x"), F.col("component").alias("x_c"), F.col("n").alias("x_n"), F.col("p").alias("x_p"))
    rest = a.join(b, (F.col("sig") == F.col("sig2")) & (F.col("q") < F.col("x")) & (F.col("q_c") != F.col("x_c"))
                  & _can_link(percent, "q", "x")).select("q", "x").distinct()
    rest = stored(rest if tested is None else rest.join(tested, ["q", "x"], "left_anti"), "rest")
    if rest.head(1):
        components = joined(components, stored(_verified(rest, texts, size, percent), "links"))
    if components is None:
        components = known.select(F.col("cls").alias("node"), F.col("cls").alias("component"))
    named = classes.select(F.col("cls").alias("node"), "rep").join(components, "node")
    least = named.groupBy("component").agg(F.min("rep").alias("least"))
    names = named.join(least, "component").select(F.col("node").alias("cls"), "least", "component")
    names = classes.select("cls", "rep").join(names, "cls", "left").select(
        "cls", F.coalesce("least", "rep").alias("component_id"), F.coalesce("component", "cls").alias("component"))
    return sketch.select("doc_id", "h", "n", "cls").join(names, "cls", "left").select(
        "doc_id", "h", F.col("n").alias("n_shingles"), "component",
        F.when(F.col("n") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 3, percent: int = 90,
                by_row: bool = False) -> DataFrame:
    """docs without the rows whose text is a copy of a document with a smaller id. Rows are told apart by id and text.
    Equal rows of one id, and rows with a null id, are kept; with by_row, exactly one row of each component stays: of
    the smallest id (null last), then the smallest hash of the text, then any of equal ones."""
    rows = _linked(docs, doc_id, text, size, percent)
    if by_row:
        rows = stored(rows.where("n_shingles > 0").groupBy("component", "doc_id", "h").count(), "linked")
        place = F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "h")
        first = rows.groupBy(F.col("component").alias("c")).agg(F.min(place).alias("first"))
        rows = rows.join(first, F.col("component") == F.col("c"))
        copies = rows.where(~place.eqNullSafe(F.col("first")))
    else:
        copies = rows.where("doc_id <> component_id")
    keys = lambda x: x.select(F.col("doc_id").alias("_i"), F.col("h").alias("_t")).distinct()
    marked = docs.withColumns({"_id": F.col(doc_id).cast("long"), "_h": F.xxhash64(text)})
    same = F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_h") == F.col("_t"))
    left = marked.join(keys(copies), same, "left_anti")
    if by_row:
        several = keys(rows.where("count > 1"))
        left = left.join(several, same, "left_anti").unionByName(left.join(several, same, "left_semi").dropDuplicates(["_id", "_h"]))
    return left.select(*docs.columns)
