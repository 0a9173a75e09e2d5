"""What is in force on a date.

Within a standard, editions start on distinct days, so after the reduction to one row per
(standard, day) a standard's timeline has at most as many rows as the calendar has days: the
windows below never see more than that, however many raw rows share one standard.
"""

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexspan import texts
from lexspan.functions.columns import parse_on_date, ru_date
from lexspan.functions.scale import keyed_join


def status(effective_from: Column, effective_to: Column, on_date: Column) -> Column:
    """Start day inclusive, end day exclusive."""
    return (
        F.when(on_date < effective_from, texts.NOT_YET)
        .when(effective_to.isNotNull() & (on_date >= effective_to), texts.REPEALED)
        .otherwise(texts.ACTIVE)
    )


def with_status(df: DataFrame, on_date: str = "on_date") -> DataFrame:
    return df.withColumn(
        "status", status(F.col("effective_from"), F.col("effective_to"), F.col(on_date))
    )


def not_in_force_warning(df: DataFrame, on_date: str = "on_date") -> DataFrame:
    """Add `warning` where the standard is not in force on the asked date."""
    return df.withColumn(
        "warning",
        F.when(
            F.col("status") != texts.ACTIVE,
            F.format_string(texts.MSG_NOT_IN_FORCE, ru_date(F.col(on_date)), F.col("status")),
        ),
    )


def with_on_date(df: DataFrame, value: str = "on_date", today: Column | None = None) -> DataFrame:
    """Replace the text parameter `value` by a date and add `error`."""
    on_date, error = parse_on_date(F.col(value), today)
    return df.withColumn("_date", on_date).withColumn("error", error).drop(value).withColumnRenamed(
        "_date", value
    )


def per_day(editions: DataFrame) -> DataFrame:
    """One edition per (standard, start day): the highest number, combined before the shuffle."""
    best = F.max_by(F.struct(F.col("id").alias("edition_id"), "edition_no"), F.struct("edition_no", "id"))
    days = editions.groupBy("standard_id", "effective_from").agg(best.alias("e"))
    return days.select("standard_id", "effective_from", "e.edition_id", "e.edition_no")


def validity(editions: DataFrame) -> DataFrame:
    """Editions with `valid_from` (inclusive) and `valid_to` (exclusive, null while current)."""
    by_start = Window.partitionBy("standard_id").orderBy("effective_from")
    return per_day(editions).select(
        "standard_id",
        "edition_id",
        "edition_no",
        F.col("effective_from").alias("valid_from"),
        F.lead("effective_from").over(by_start).alias("valid_to"),
    )


def editions_on(editions: DataFrame, dates: Sequence[date]) -> DataFrame:
    """The edition in force for every standard on each of a few dates.

    One aggregation pass: each date is one `max_by` with map-side combining, so a standard holding
    a third of all editions costs no more than any other. Standards without an edition on a date
    have no row for it.
    """
    pick = F.struct(F.col("id").alias("edition_id"), "edition_no")
    rank = F.struct("effective_from", "edition_no", "id")
    started = [F.col("effective_from") <= F.lit(d) for d in dates]
    wide = editions.groupBy("standard_id").agg(
        *[F.max_by(F.when(s, pick), F.when(s, rank)).alias(f"_{i}") for i, s in enumerate(started)]
    )
    rows = F.array(
        *[F.struct(F.lit(d).alias("on_date"), F.col(f"_{i}").alias("e")) for i, d in enumerate(dates)]
    )
    long = wide.select("standard_id", F.explode(rows).alias("r")).where("r.e IS NOT NULL")
    return long.select("standard_id", "r.on_date", "r.e.edition_id", "r.e.edition_no")


def edition_as_of(editions: DataFrame, params: DataFrame) -> DataFrame:
    """The edition in force for every distinct (standard_id, on_date) of `params`.

    As-of join as one merged timeline: edition starts and asked days are sorted together per
    standard and the newest start is carried forward, so nothing is compared pairwise. Asked days
    before the first edition keep a null edition.
    """
    asked = params.select("standard_id", F.col("on_date").alias("day")).distinct()
    starts = per_day(editions).select(
        "standard_id",
        F.col("effective_from").alias("day"),
        F.lit(0).alias("asks"),
        F.struct("edition_id", "edition_no", F.col("effective_from").alias("valid_from")).alias("e"),
    )
    timeline = starts.unionByName(
        asked.withColumn("asks", F.lit(1)), allowMissingColumns=True
    )
    carried = Window.partitionBy("standard_id").orderBy("day", "asks")
    resolved = timeline.withColumn("e", F.last("e", ignorenulls=True).over(carried))
    return resolved.where("asks = 1").select(
        "standard_id", F.col("day").alias("on_date"), "e.edition_id", "e.edition_no"
    )


def with_edition(params: DataFrame, editions: DataFrame) -> DataFrame:
    """params(standard_id, on_date, ...) -> the same rows with `edition_id` and `edition_no`."""
    return keyed_join(params, edition_as_of(editions, params), ["standard_id", "on_date"])


def with_fallback_edition(params: DataFrame, editions: DataFrame, standards: DataFrame) -> DataFrame:
    """As `with_edition`; a date before every edition falls back to the standard's own start day.

    Adds `known` (the standard exists), `has_editions` and `fell_back`. The asked date is kept.
    """
    std = standards.select(
        F.col("id").alias("standard_id"), "title", "order_date", "order_no",
        F.col("effective_from").alias("std_from"), F.col("effective_to").alias("std_to"), "source_url",
    )
    # What every standard falls back to is settled once per standard, not per request.
    started = keyed_join(editions, std.select("standard_id", "std_from"), ["standard_id"], "inner")
    early = F.col("effective_from") <= F.col("std_from")
    first = started.groupBy("standard_id").agg(
        F.max_by(
            F.when(early, F.struct(F.col("id").alias("edition_id"), "edition_no")),
            F.when(early, F.struct("effective_from", "edition_no", "id")),
        ).alias("first"),
        F.lit(True).alias("has_editions"),
    )
    std = std.join(first, "standard_id", "left").withColumn("known", F.lit(True))
    described = keyed_join(params, std, ["standard_id"])
    direct = keyed_join(described, edition_as_of(editions, params), ["standard_id", "on_date"])
    fell_back = F.col("edition_id").isNull() & F.col("first").isNotNull()
    return (
        direct.withColumn("known", F.coalesce("known", F.lit(False)))
        .withColumn("has_editions", F.coalesce("has_editions", F.lit(False)))
        .withColumn("fell_back", fell_back)
        .withColumn("edition_id", F.coalesce("edition_id", "first.edition_id"))
        .withColumn("edition_no", F.coalesce("edition_no", "first.edition_no"))
        .drop("first")
    )


def on_dates(df: DataFrame, dates: Sequence[date]) -> DataFrame:
    """Every row once per asked date (a few dates given as parameters)."""
    return df.withColumn("on_date", F.explode(F.array(*[F.lit(d) for d in dates])))


