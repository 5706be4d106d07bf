"""Group-bys, pivots, topic counts and co-occurrence.

All counts run as partial (map-side) + final hash aggregates, so a hot key -- one
application or topic holding a third of the rows -- collapses to one row per task
before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from civiclens import constants as K
from civiclens.functions.lists import parse_int_list, restrict_to, unordered_pairs
from civiclens.functions.scalar import flag_in, percent


def overall_summary(apps: DataFrame) -> DataFrame:
    """G1: distinct applications, total units, total comments, mean comments (2 dp)."""
    return apps.agg(
        F.count_distinct("lpa_app_no").alias("total_applications"),
        F.coalesce(F.sum("total_no_proposed_residential_units"), F.lit(0)).alias("total_proposed_residential_units"),
        F.coalesce(F.sum("comment_count"), F.lit(0)).alias("total_comments"),
        F.round(F.avg("comment_count"), 2).alias("mean_comments_per_application"))


def council_stats(apps: DataFrame, digits: int = 6) -> DataFrame:
    """Per borough (null borough dropped): rows with an application number,
    units, comments, mean comments."""
    return (apps.where(F.col("borough").isNotNull()).groupBy("borough").agg(
        F.count("lpa_app_no").alias("total_applications"),
        F.coalesce(F.sum("total_no_proposed_residential_units"), F.lit(0)).alias("total_proposed_units"),
        F.coalesce(F.sum("comment_count"), F.lit(0)).alias("total_comments"),
        F.round(F.avg("comment_count"), digits).alias("mean_comments")))


def group_size(df: DataFrame, by: str | Sequence[str]) -> DataFrame:
    """Rows per group; null groups dropped (as pandas does)."""
    keys = [by] if isinstance(by, str) else list(by)
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).isNotNull()
    return df.where(cond).groupBy(*keys).agg(F.count("*").alias("n"))


def stance_by_council(comments: DataFrame, stances: Sequence[str] = K.STANCES,
                      digits: int = 6) -> DataFrame:
    """Per council, comments per listed stance and row percentages. The
    denominator is the listed stances only; other stance values are ignored. A council
    with other stances alone stays, with zero counts and NULL percentages."""
    counts = (comments.where(F.col("council").isNotNull())
              .groupBy("council").pivot("stance", list(stances)).count())
    names = {s: s.lower() for s in stances}
    counts = counts.select("council", *[F.coalesce(F.col(f"`{s}`"), F.lit(0)).alias(names[s]) for s in stances])
    total = sum((F.col(names[s]) for s in stances), F.lit(0))
    return (counts.withColumn("_total", total)
            .select("council", *[names[s] for s in stances],
                    *[F.round(percent(names[s], "_total"), digits).alias(f"pct_{names[s]}") for s in stances]))


# -- topics --------------------------------------------------------------------------
def topic_mentions(df: DataFrame, list_col: str = "topic_list", keep: Sequence[str] = ()) -> DataFrame:
    """A1: one row per list element (`topic`); a duplicate in one list counts twice."""
    return df.select(*keep, F.explode(list_col).alias("topic"))



def topic_frequency(topics: DataFrame, names: DataFrame, list_col: str = "topic_list",
                    digits: int = 2) -> DataFrame:
    """Mentions per named topic (0 if never mentioned), percent of all mentions of
    named topics, and rank (count desc, id asc). Topics missing from the lookup drop out."""
    counts = topic_mentions(topics, list_col).groupBy("topic").agg(F.count("*").alias("mentions"))
    base = (names.select("topic_id", "topic_group", "color")
            .join(counts, F.col("topic_id") == F.col("topic"), "left")
            .select("topic_id", "topic_group", "color",
                    F.coalesce(F.col("mentions"), F.lit(0)).alias("mentions")))
    # One row per named topic (a bounded lookup): the total and the rank are windows
    # over that small frame, so the mention counts are computed once.
    w = Window.orderBy(F.desc("mentions"), F.asc("topic_id"))
    total = F.sum("mentions").over(Window.partitionBy())
    return base.select("topic_id", "topic_group", "color", "mentions",
                       F.round(F.try_divide(F.col("mentions"), total) * 100, digits).alias("percentage"),
                       (F.row_number().over(w) - 1).cast("long").alias("rank"))


def topic_frequency_by_area(topics: DataFrame, names: DataFrame, inner: Sequence[str],
                            list_col: str = "topic_list", digits: int = 2) -> DataFrame:
    """Inner vs outer mentions per named topic and their percents. A comment with
    no council counts as outer. One explode, two conditional counts."""
    m = topic_mentions(topics.withColumn("_inner", flag_in("council", inner)), list_col, keep=["_inner"])
    counts = m.groupBy("topic").agg(F.count_if(F.col("_inner")).alias("inner_count"),
                                    F.count_if(~F.col("_inner")).alias("outer_count"))
    base = (names.select("topic_id", "topic_group", "color")
            .join(counts, F.col("topic_id") == F.col("topic"), "left")
            .select("topic_id", "topic_group", "color",
                    F.coalesce(F.col("inner_count"), F.lit(0)).alias("inner_count"),
                    F.coalesce(F.col("outer_count"), F.lit(0)).alias("outer_count")))
    # Totals as windows over the bounded per-topic frame (counts computed once).
    whole = Window.partitionBy()
    return base.select("*",
                       F.round(F.try_divide(F.col("inner_count"), F.sum("inner_count").over(whole)) * 100,
                               digits).alias("inner_pct"),
                       F.round(F.try_divide(F.col("outer_count"), F.sum("outer_count").over(whole)) * 100,
                               digits).alias("outer_pct"))


def first_topics(names: DataFrame, n: int) -> DataFrame:
    """The first n rows of the lookup in file order."""
    return names.where(F.col("file_order") < n)


def topic_by_housing_type(topics: DataFrame, names: DataFrame, n: int = K.TOP_TOPICS_BAR,
                          housing_order: Sequence[str] = K.HOUSING_ORDER,
                          list_col: str = "topic_list") -> DataFrame:
    """Mentions per (housing type, topic) for the first n topics of the lookup,
    zero-filled, for the housing types of `housing_order` present in the data."""
    top = first_topics(names, n).select("topic_id", "topic_group", "color", "file_order")
    counts = (topic_mentions(topics.where(F.col("housing_type").isNotNull()), list_col, keep=["housing_type"])
              .groupBy(F.col("housing_type").alias("_ht"), "topic").agg(F.count("*").alias("mentions")))
    present = (topics.where(F.col("housing_type").isin(list(housing_order)))
               .select("housing_type").distinct())
    # Grid of (present type) x (first n topics) built by a generator over a bounded
    # array, not by a cross join.
    ids = top.select(F.sort_array(F.collect_list("topic_id"))).scalar()
    grid = present.select("housing_type", F.explode(ids).alias("topic_id"))
    return (grid.join(F.broadcast(top), "topic_id")
            .join(counts, (F.col("housing_type") == F.col("_ht")) & (F.col("topic_id") == F.col("topic")), "left")
            .select("housing_type", "topic_id", "topic_group", "color", "file_order",
                    F.coalesce(F.col("mentions"), F.lit(0)).alias("mentions")))


def top_n_other(names: DataFrame, n: int = K.TOP_TOPICS_BAR, other_label: str = K.OTHER_LABEL,
                other_color: str = K.OTHER_COLOR_PIE, other_topic: int | None = None,
                digits: int = 6) -> DataFrame:
    """First n lookup rows plus one "other" row holding the rest of the counts
    (emitted even when 0), with each slice's share of the total."""
    top = names.where(F.col("file_order") < n).select(
        F.col("file_order").cast("long").alias("slice"), F.col("topic_id").cast("int").alias("topic_id"),
        "topic_group", "color", "topic_count")
    # A global aggregate returns exactly one row, so "other" exists even when empty.
    rest = names.where(F.col("file_order") >= n).agg(
        F.lit(n).cast("long").alias("slice"), F.lit(other_topic).cast("int").alias("topic_id"),
        F.lit(other_label).alias("topic_group"), F.lit(other_color).alias("color"),
        F.coalesce(F.sum("topic_count"), F.lit(0)).alias("topic_count"))
    out = top.unionByName(rest)
    total = names.select(F.sum("topic_count")).scalar()
    return out.withColumn("share", F.round(F.try_divide(F.col("topic_count") * 100.0, total), digits))


def nimby_share(names: DataFrame, ids: Sequence[int] = K.NIMBY_TOPIC_IDS, n: int = K.TOP_TOPICS_BAR,
                digits: int = 6) -> DataFrame:
    """The top-n + other slices with a NIMBY flag and the colour shown (grey-out
    for unflagged slices). "other" carries id -999 and is never flagged."""
    pie = top_n_other(names, n, K.OTHER_LABEL, K.OTHER_COLOR_NIMBY, K.OTHER_TOPIC_NIMBY, digits)
    flag = flag_in("topic_id", list(ids))
    return pie.select("*", flag.alias("is_nimby"),
                      F.when(flag, F.col("color")).otherwise(F.lit(K.OTHER_COLOR_NIMBY)).alias("shown_color"))


def top_topics(topics: DataFrame, k: int, list_col: str = "topic_list",
               distinct_per_row: bool = False) -> DataFrame:
    """O4 on list elements: the k most mentioned topics (count desc, id asc)."""
    lst = F.array_distinct(list_col) if distinct_per_row else F.col(list_col)
    return (topics.select(F.explode(lst).alias("topic")).groupBy("topic").agg(F.count("*").alias("n"))
            .orderBy(F.desc("n"), F.asc("topic")).limit(k))


def topic_cooccurrence(topics: DataFrame, names: DataFrame, k: int = K.TOP_TOPICS_COOCCURRENCE,
                       list_col: str = "topic_list") -> DataFrame:
    """Symmetric k x k count of comments naming both topics, for the k most
    mentioned topics; zero diagonal; labels from the lookup (else the id).

    Pairs are generated inside each row from the distinct topics intersected with the
    top-k (at most k(k-1)/2 per row), then counted with a partial aggregate."""
    top_ids = top_topics(topics, k, list_col).select(F.collect_list("topic")).scalar()
    pairs = (topics.select(restrict_to(list_col, top_ids).alias("_t"))
             .where(F.size("_t") > 1)
             .select(F.explode(unordered_pairs("_t")).alias("p"))
             .groupBy(F.col("p.a").alias("a"), F.col("p.b").alias("b")).agg(F.count("*").alias("n")))
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "n"))
    # k x k grid from the same scalar subquery (evaluated once), carried by one row.
    grid = (names.sparkSession.range(1).select(F.explode(top_ids).alias("topic_a"))
            .select("topic_a", F.explode(top_ids).alias("topic_b")))
    lab = names.select("topic_id", "topic_group")
    la = lab.select(F.col("topic_id").alias("_ia"), F.col("topic_group").alias("label_a"))
    lb = lab.select(F.col("topic_id").alias("_ib"), F.col("topic_group").alias("label_b"))
    return (grid.join(both, (F.col("topic_a") == F.col("a")) & (F.col("topic_b") == F.col("b")), "left")
            .join(la, F.col("topic_a") == F.col("_ia"), "left")
            .join(lb, F.col("topic_b") == F.col("_ib"), "left")
            .select("topic_a", "topic_b",
                    F.coalesce(F.col("label_a"), F.col("topic_a").cast("string")).alias("label_a"),
                    F.coalesce(F.col("label_b"), F.col("topic_b").cast("string")).alias("label_b"),
                    F.coalesce(F.col("n"), F.lit(0)).alias("n")))


def borough_topic_legend(points: DataFrame, k: int = K.BOROUGH_LEGEND_TOP) -> DataFrame:
    """Most frequent (primary_topic, topic_label, topic_color) among points with a
    primary topic; top k by count desc, topic asc."""
    return (points.where(F.col("primary_topic").isNotNull())
            .groupBy("primary_topic", "topic_label", "topic_color").agg(F.count("*").alias("n"))
            .orderBy(F.desc("n"), F.asc("primary_topic")).limit(k))


def lsoa_profile(comments: DataFrame, socio_vars: Sequence[str] = K.SOCIO_VARS,
                 digits: int | None = 6) -> DataFrame:
    """Comments per LSOA and the mean of each census share (null code dropped)."""
    r = (lambda c: F.round(c, digits)) if digits is not None else (lambda c: c)
    return (comments.where(F.col("lsoa_code").isNotNull()).groupBy("lsoa_code")
            .agg(F.count("comment_id").alias("num_comments"),
                 *[r(F.avg(v)).alias(v) for v in socio_vars]))
