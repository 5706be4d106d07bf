"""Chat formatting with a grammar round trip. DataFrame functions only.

Template of a turn:  <|im_start|>ROLE\\nTEXT<|im_end|>\\n
The parser is deterministic: split at <|im_start|>, each piece is a role up to the first line feed, a
text up to its only <|im_end|>, and a line feed; then the escapes in role and text are undone:
    \\c  <|       \\n  line feed       \\b  \\
Every turn is first rendered as it is and parsed again. Where that doesn't give back exactly one turn
with the same role and text, its content is escaped (every backslash, every <|, and line feeds in
roles) and the turn is rendered anew. Escaped content holds no <|, and each of its backslashes begins
one of the three codes, so that the second rendering always parses back; `broken` tells of any turn
for which it did not (none, whatever the input).

Defined results. Null role or text: empty. Turns are ordered by turn (nulls first), then role, then
text, so ties have one order; repeated rows are turns of their own. A null conv_id is a conversation.
An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

START, END = "<|im_start|>", "<|im_end|>"
LOSS_ROLE = "assistant"


def _quoted(pattern: str) -> str:
    return rf"\Q{pattern}\E"


def escape(text: Column, role: bool = False) -> Column:
    out = F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("<|"), F.lit("\\c"))
    return F.replace(out, F.lit("\n"), F.lit("\\n")) if role else out


def unescape(text: Column) -> Column:
    out = F.replace(F.replace(text, F.lit("\\c"), F.lit("<|")), F.lit("\\n"), F.lit("\n"))
    return F.replace(out, F.lit("\\b"), F.lit("\\"))


def render(role: Column, text: Column) -> Column:
    return F.concat(F.lit(START), role, F.lit("\n"), text, F.lit(f"{END}\n"))


def parse(formatted: Column) -> Column:
    """Array of (role, text, raw) of the turns; raw is the text as it stands in the formatted string. A
    piece that breaks the grammar is a null turn."""
    pieces = F.split(formatted, _quoted(START), -1)

    def turn(piece: Column) -> Column:
        head = F.locate("\n", piece)
        body = F.split(F.substring(piece, head + 1, F.length(piece)), _quoted(END), -1)
        raw = F.get(body, F.lit(0))
        good = (head > 0) & (F.size(body) == 2) & (F.get(body, F.lit(1)) == "\n")
        return F.when(good, F.struct(unescape(F.substring(piece, F.lit(1), head - 1)).alias("role"), unescape(raw).alias("text"), raw.alias("raw")))

    # before the first mark nothing may stand
    return F.transform(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))), turn)


def _same(formatted: Column, role: Column, text: Column) -> Column:
    turns = parse(formatted)
    one = F.get(turns, F.lit(0))
    return F.coalesce((F.size(turns) == 1) & (one["role"] == role) & (one["text"] == text), F.lit(False))


def format_turns(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """turns as (conv_id, turn, role, text, formatted, escaped, broken)."""
    rows = turns.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"),
                        F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
                        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("plain", render(F.col("role"), F.col("text")))
    rows = rows.withColumn("escaped", ~_same(F.col("plain"), F.col("role"), F.col("text")))
    rows = rows.withColumn("formatted", F.when(~F.col("escaped"), F.col("plain")).otherwise(
        render(escape(F.col("role"), True), escape(F.col("text")))))
    broken = F.col("escaped") & ~_same(F.col("formatted"), F.col("role"), F.col("text"))
    return rows.select("conv_id", "turn", "role", "text", "formatted", "escaped", broken.alias("broken"))


def format_conversations(turns: DataFrame, **names) -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_mask (code point spans of assistant texts in
    formatted), n_escaped, n_broken. The loss mask is read from the formatted string by the parser."""
    rows = format_turns(turns, **names)
    whole = rows.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("turn", "role", "text", "formatted"))).alias("all"),
        F.sum(F.col("escaped").cast("long")).alias("n_escaped"), F.sum(F.col("broken").cast("long")).alias("n_broken"))
    whole = whole.select("conv_id", F.array_join(F.col("all.formatted"), "").alias("formatted"), "n_escaped", "n_broken")
    return whole.withColumn("loss_mask", loss_mask(F.col("formatted")))


def loss_mask(formatted: Column) -> Column:
    """Spans (start, end) in code points of the raw assistant texts."""
    pieces = F.transform(F.split(formatted, _quoted(START), -1), lambda p: F.struct(
        F.length(p).alias("size"), F.locate("\n", p).alias("head"),
        (F.substring_index(p, "\n", 1) == LOSS_ROLE).alias("loss")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))
    return F.aggregate(pieces, start, lambda acc, p: F.struct(
        (acc["at"] + p["size"] + len(START)).alias("at"),
        F.when(p["loss"], F.concat(acc["out"], F.array(F.struct(
            (acc["at"] + p["head"]).alias("start"), (acc["at"] + p["size"] - len(END) - 1).alias("end")))))
        .otherwise(acc["out"]).alias("out")))["out"]


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests from the formatted string and its loss mask alone: conv_id, n_turns, turns_sha256, loss_chars,
    loss_sha256, formatted_chars."""
    rows = formatted.withColumn("t", parse(F.col("formatted")))
    said = F.array_join(F.transform(F.col("t"), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    # the texts that the mask covers, taken from the parsed turns: cutting a long string span by span
    # would walk it from its start each time (tests compare both)
    loss = F.array_join(F.transform(F.filter("t", lambda t: t["role"] == LOSS_ROLE), lambda t: unescape(t["raw"])), "")
    rows = rows.withColumn("loss", loss)
    return rows.select("conv_id", F.size("t").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
                       F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
                       F.length("formatted").cast("long").alias("formatted_chars"))
