"""Secret scan with multipart credential linking. DataFrame functions only.

Strong spans are found by pattern alone, leftmost and non-overlapping per kind:
  assign  (password|passwd|secret|token|api_?key) followed by = or : and a value of 12+ characters
  access  AKIA and capitals or digits, 18+ characters in all
  hex     16+ characters 0-9a-f
Weak candidates say little alone:
  ident     a named login, user, client or access key id
  value     an assignment as above (also pwd, pass, credential) whose value has 6 or more characters and
            that is not itself an assign span
  endpoint  a URL or database address
A weak candidate is reported when a complementary part begins within SCOPE code points of it in the
same text: value needs ident, access or endpoint; ident and endpoint need assign or value. The parts
are rows (text, cell of SCOPE code points, start) and meet in an interval join on equal or
neighbouring cells; a part counts once per neighbouring cell, whatever the number of partners.

Spans are code points, end exclusive. Defined results: a null text is empty and has no spans; equal
rows get equal results; an empty table gives an empty result; input columns are kept, and columns
named like an output column are replaced. The text, not the id, identifies a row in the join, so null
and repeated ids are harmless.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

SCOPE = 200
_CLASS = "A-Za-z0-9+/_.=-"
ASSIGN = rf"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([{_CLASS}]+)"""
ACCESS = "AKIA[A-Z0-9]{14,}"
HEX = "[0-9a-f]{16,}"
IDENT = rf"""(?i)(?:access_?key_?id|client_?id|user_?name|user|login|account)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._-]{{3,}})"""
VALUE = rf"""(?i)(?:password|passwd|secret|token|api_?key|pwd|pass|credential)["']?\x20*[:=]\x20*["']?([{_CLASS}]+)"""
ENDPOINT = r"""(?i)(?:https?|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqp|s3)://[^\s"'<>]+"""
KINDS = ("assign", "access", "hex", "ident", "value", "endpoint")
_SPAN = "array<struct<start:int,rank:int,end:int>>"


def _spans(text: Column, pattern: str, kind: str, group: int = 0, least: int = 0) -> Column:
    """Spans of all leftmost non-overlapping matches whose group has least or more characters. The gaps
    between the matches give their places."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    rows = F.arrays_zip(
        F.transform(gaps, lambda g: F.length(g)).alias("gap"), F.transform(found, lambda m: F.length(m)).alias("size"),
        (F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), lambda m: F.length(m)) if group
         else F.transform(found, lambda m: F.length(m))).alias("part"))
    # running end of the matches: an array of (start, end, part), built left to right
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,part:int>>").alias("out"))
    placed = F.aggregate(rows, start, lambda acc, r: F.when(r["size"].isNull(), acc).otherwise(F.struct(
        (acc["at"] + r["gap"] + r["size"]).alias("at"),
        F.concat(acc["out"], F.array(F.struct((acc["at"] + r["gap"]).alias("start"),
                                              (acc["at"] + r["gap"] + r["size"]).alias("end"), r["part"].alias("part")))).alias("out"))))["out"]
    ok = F.filter(placed, lambda s: s["part"] >= least)
    spans = F.transform(ok, lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), s["end"].alias("end")))
    return F.when(text.rlike(pattern), spans).otherwise(F.array().cast(_SPAN))


def _without(spans: Column, others: Column, kind: str) -> Column:
    """Those of spans that do not stand among others. Places are packed into numbers, which are compared by hash."""
    packed = lambda a: F.transform(a, lambda s: F.shiftleft(s["start"].cast("long"), 32) + s["end"])
    return F.transform(F.array_except(packed(spans), packed(others)), lambda p: F.struct(
        F.shiftright(p, 32).cast("int").alias("start"), F.lit(KINDS.index(kind)).alias("rank"),
        p.bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("end")))


def _named(spans: Column) -> Column:
    """kind:start:end by start, then kind as listed, comma-joined."""
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(
        ":", F.element_at(F.array(*map(F.lit, KINDS)), s["rank"] + 1), s["start"], s["end"])), ",")


def linked(parts: DataFrame, scope: int = SCOPE) -> DataFrame:
    """(key, weak): the weak spans of each key that have a complementary part within scope. parts: key, start, rank, end."""
    cell = F.floor(F.col("start") / scope)
    rank = {k: i for i, k in enumerate(KINDS)}
    weak = parts.where(F.col("rank") >= rank["ident"]).select("key", cell.alias("cell"), "start", "rank", "end", (F.col("rank") == rank["value"]).alias("wants_owner"))
    # of the complementary parts of a cell only the first and last start matter to parts of the cells beside it;
    # for the cell itself any part is near enough (its starts differ by less than scope)
    owner = F.col("rank").isin(rank["ident"], rank["access"], rank["endpoint"])
    bound = lambda ok, wants: (parts.where(ok).groupBy("key", cell.alias("there"))
                               .agg(F.min("start").alias("low"), F.max("start").alias("high")).withColumn("wants", F.lit(wants)))
    other = bound(owner, True).unionByName(bound(F.col("rank").isin(rank["assign"], rank["value"]), False))
    near = weak.withColumn("there", F.explode(F.array(F.col("cell") - 1, F.col("cell"), F.col("cell") + 1)))
    hits = near.join(other.withColumnRenamed("key", "key2").withColumnRenamed("there", "there2"),
                     (F.col("key") == F.col("key2")) & (F.col("there") == F.col("there2")) & (F.col("wants_owner") == F.col("wants"))
                     & ((F.col("there") == F.col("cell"))
                        | ((F.col("there") < F.col("cell")) & (F.col("start") - F.col("high") <= scope))
                        | ((F.col("there") > F.col("cell")) & (F.col("low") - F.col("start") <= scope))))
    spans = hits.select("key", "start", "rank", "end").distinct()
    return spans.groupBy("key").agg(F.collect_list(F.struct("start", "rank", "end")).alias("weak"))


def spans(docs: DataFrame, text: str = "text", scope: int = SCOPE) -> DataFrame:
    """docs with strong (array of start, rank, end), n_assign, n_access, n_hex, base (names of the strong
    spans), linked (the weak spans reported) and spans (names of all)."""
    made = ("strong", "n_assign", "n_access", "n_hex", "base", "linked", "spans", "_key", "_key2", "_weak", "_all")
    kept = [c for c in docs.columns if c.lower() not in made]
    body = F.coalesce(F.col(text), F.lit(""))
    # an equal text has equal parts: they are identified by its hash
    rows = docs.select(*kept, F.sha2(body, 256).alias("_key"), _spans(body, ASSIGN, "assign", 2, 12).alias("_a"),
                       _spans(body, ACCESS, "access").alias("_c"), _spans(body, HEX, "hex").alias("_h"))
    rows = rows.select(*kept, "_key", F.concat("_a", "_c", "_h").alias("strong"), F.size("_a").cast("long").alias("n_assign"),
                       F.size("_c").cast("long").alias("n_access"), F.size("_h").cast("long").alias("n_hex"))
    weak = docs.where(F.col(text).rlike(VALUE) | F.col(text).rlike(IDENT) | F.col(text).rlike(ENDPOINT)).select(F.col(text).alias("t")).distinct()
    t = F.col("t")
    parts = weak.select(F.sha2(t, 256).alias("key"), _spans(t, ASSIGN, "assign", 2, 12).alias("a"), _spans(t, VALUE, "value", 1, 6).alias("v"),
                        F.concat(_spans(t, ACCESS, "access"), _spans(t, IDENT, "ident", 1, 3), _spans(t, ENDPOINT, "endpoint")).alias("o"))
    parts = parts.select("key", F.explode(F.concat("a", _without(F.col("v"), F.col("a"), "value"), "o")).alias("s")).select("key", "s.start", "s.rank", "s.end")
    found = linked(parts, scope).select(F.col("key").alias("_key2"), "weak")
    joined = rows.join(found, rows["_key"] == F.col("_key2"), "left").withColumn("linked", F.coalesce("weak", F.array().cast(_SPAN)))
    return joined.select(*kept, "strong", "n_assign", "n_access", "n_hex", _named(F.col("strong")).alias("base"), "linked",
                         _named(F.concat("strong", "linked")).alias("spans"))


def redact(docs: DataFrame, text: str = "text", mark: str = "[SECRET]", scope: int = SCOPE) -> DataFrame:
    """docs whose text has every reported span (overlapping ones as one) replaced by mark; other texts are untouched."""
    columns = docs.columns
    rows = spans(docs, text, scope)
    every = F.array_sort(F.concat("strong", "linked"))
    # merge overlapping spans, left to right, into the stretches between them
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<from:int,to:int>>").alias("out"))
    merged = F.aggregate(every, start, lambda acc, s: F.when(s["end"] <= acc["at"], acc).otherwise(F.struct(
        s["end"].alias("at"),
        F.when((s["start"] < acc["at"]) & (F.size(acc["out"]) > 0), acc["out"])
        .otherwise(F.concat(acc["out"], F.array(F.struct(acc["at"].alias("from"), s["start"].alias("to"))))).alias("out"))))
    rows = rows.withColumn("_m", merged)
    clean = F.concat(F.array_join(F.transform(F.col("_m.out"), lambda g: F.concat(
        F.substring(F.col(text), g["from"] + 1, g["to"] - g["from"]), F.lit(mark))), ""),
        F.substring(F.col(text), F.col("_m.at") + 1, F.length(text)))
    return rows.withColumn(text, F.when(F.size("strong") + F.size("linked") > 0, clean).otherwise(F.col(text))).select(*columns)
