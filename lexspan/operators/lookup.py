"""Lookups of standards and clauses for many requests at once."""

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexspan import texts
from lexspan.functions.columns import order_ref, ru_date
from lexspan.functions.scale import keyed_join, top_rows, written
from lexspan.operators import temporal


def lookup(params: DataFrame, standards: DataFrame) -> DataFrame:
    """params(standard_id, ...) -> standard columns plus `outcome` and `error`."""
    std = standards.withColumnRenamed("id", "standard_id").withColumn("_known", F.lit(True))
    found = keyed_join(params, std, ["standard_id"])
    return (
        found.withColumn("outcome", F.when(F.col("_known"), "found").otherwise("standard_not_found"))
        .withColumn(
            "error",
            F.when(
                F.col("_known").isNull(),
                F.format_string(texts.MSG_STANDARD_NOT_FOUND, F.col("standard_id")),
            ),
        )
        .drop("_known")
    )


def list_standards(
    standards: DataFrame, dates: Sequence[date], kind: str | None = None
) -> DataFrame:
    """Standards (of one kind) with their status on each date, ordered by year and number."""
    chosen = standards if kind is None else standards.where(F.col("kind") == kind)
    dated = temporal.with_status(temporal.on_dates(chosen, dates))
    return dated.orderBy("on_date", "year", "number", "id")


def outline(editions: DataFrame, clauses: DataFrame, dates: Sequence[date]) -> DataFrame:
    """(standard_id, on_date, pos, path, heading) of the edition in force, in document order."""
    current = temporal.editions_on(editions, dates).select("edition_id", "on_date")
    listed = keyed_join(
        clauses.select("standard_id", "edition_id", "pos", "path", "heading"),
        current, ["edition_id"], "inner",
    )
    return listed.select("standard_id", "on_date", "pos", "path", "heading").orderBy(
        "on_date", "standard_id", "pos"
    )


def children(clauses: DataFrame) -> DataFrame:
    """Children of each clause in document order, one row per child."""
    return clauses.where(F.col("parent_path").isNotNull()).select(
        "standard_id",
        "edition_id",
        F.col("parent_path").alias("path"),
        "pos",
        F.col("path").alias("child"),
    )


def successors(relations: DataFrame) -> DataFrame:
    """Standards that replace a standard, one row per pair."""
    replaced = relations.where(F.col("kind") == texts.REPLACED)
    return replaced.select(
        F.col("from_standard").alias("standard_id"), F.col("to_standard").alias("successor")
    ).distinct()


def available_paths(clauses: DataFrame, wanted: DataFrame) -> DataFrame:
    """(edition_id, available): the first paths of each wanted edition as one line."""
    rows = clauses.select("edition_id", "pos", "path").join(
        wanted.select("edition_id").distinct(), "edition_id", "left_semi"
    )
    first = top_rows(rows, ["edition_id"], [F.col("pos"), F.col("path")], texts.PREVIEW_PATHS)
    listed = F.array_sort(F.collect_list(F.struct("pos", "path")))
    return first.groupBy("edition_id").agg(
        F.array_join(F.transform(listed, lambda x: x["path"]), ", ").alias("available")
    )


def _iso(d: Column) -> Column:
    return d.cast("string")


def get_clauses(
    params: DataFrame, standards: DataFrame, editions: DataFrame, clauses: DataFrame
) -> DataFrame:
    """params(standard_id, path, on_date, ...) -> one answer per request.

    `outcome` is `found`, `standard_not_found`, `no_edition` or `clause_not_found`; a date before
    the first edition is answered from the edition of the standard's own start day and labelled
    as not yet in force. Children are a relation of their own: `children(clauses)`.

    Requests are reduced to distinct (edition, path) keys before they meet the clause table, so a
    clause asked for by a third of all requests is fetched once. The resolved and the answered
    requests are each used twice below, so they are written once instead of derived again.
    """
    resolved = written(temporal.with_fallback_edition(params, editions, standards), "resolved")
    keys = resolved.where("edition_id IS NOT NULL").select("edition_id", "path").distinct()
    body = clauses.select(
        "edition_id", "path", "heading", "text", "parent_path", F.lit(True).alias("_hit")
    ).join(keys, ["edition_id", "path"], "left_semi")
    parents = body.where("parent_path IS NOT NULL").select(
        "edition_id", F.col("parent_path").alias("path")
    )
    headings = clauses.select("edition_id", "path", "heading").join(
        parents.distinct(), ["edition_id", "path"], "left_semi"
    )
    with_parent = body.join(
        headings.select(
            "edition_id", F.col("path").alias("parent_path"), F.col("heading").alias("parent_heading")
        ),
        ["edition_id", "parent_path"],
        "left",
    )
    answered = keyed_join(resolved, with_parent, ["edition_id", "path"])
    hit = F.col("_hit").isNotNull()
    outcome = (
        F.when(~F.col("known") | ~F.col("has_editions"), "standard_not_found")
        .when(F.col("edition_id").isNull(), "no_edition")
        .when(~hit, "clause_not_found")
        .otherwise("found")
    )
    answered = written(answered.withColumn("outcome", outcome), "answered")
    # Only misses name paths; the other answers stay where they are.
    missed = answered.where("outcome = 'clause_not_found'")
    named = keyed_join(missed, available_paths(clauses, missed), ["edition_id"])
    answered = answered.where("outcome != 'clause_not_found'").unionByName(named, allowMissingColumns=True)
    at = F.when(F.col("fell_back"), F.col("std_from")).otherwise(F.col("on_date"))
    error = (
        F.when(F.col("outcome") == "standard_not_found", F.format_string(texts.MSG_STANDARD_NOT_FOUND, "standard_id"))
        .when(F.col("outcome") == "no_edition", F.format_string(texts.MSG_NO_EDITION, F.col("standard_id"), _iso(F.col("std_from"))))
        .when(
            F.col("outcome") == "clause_not_found",
            F.format_string(texts.MSG_CLAUSE_NOT_FOUND, "standard_id", "path", F.coalesce("available", F.lit(""))),
        )
    )
    standing = F.when(F.col("fell_back"), texts.NOT_YET).otherwise(
        temporal.status(F.col("std_from"), F.col("std_to"), at)
    )
    answered = (
        answered.withColumn("error", error)
        .withColumn("status", F.when(F.col("outcome") == "found", standing))
        .withColumn("order_ref", F.when(F.col("outcome") == "found", order_ref(F.col("order_date"), F.col("order_no"))))
    )
    answered = temporal.not_in_force_warning(answered)
    return answered.select(
        *params.columns,
        "outcome", "error", F.col("title").alias("standard_title"), "heading", "text", "parent_path",
        "parent_heading", "edition_id", "edition_no", "status", "warning", "order_ref", "source_url",
    )


def stale_warning(meta: DataFrame, today: Column) -> DataFrame:
    """meta(built_at, ...) -> adds `age_days`, `stale` and `warning`."""
    age = F.datediff(today, F.col("built_at"))
    stale = age > texts.STALE_AFTER_DAYS
    message = F.format_string(texts.MSG_STALE, ru_date(F.col("built_at")), age)
    return meta.withColumn("age_days", age).withColumn("stale", stale).withColumn(
        "warning", F.when(stale, message)
    )


def is_populated(meta: DataFrame, standards: DataFrame) -> DataFrame:
    """One row: whether both the manifest and the standards hold anything."""
    total = standards.agg(F.count("*")).scalar()
    counts = meta.agg(F.count("*").alias("metas")).withColumn("standards", total)
    return counts.withColumn("populated", (F.col("metas") > 0) & (F.col("standards") > 0))
