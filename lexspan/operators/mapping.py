"""Clauses <-> configuration objects, both ways, for many requests at once."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexspan import texts
from lexspan.functions.scale import each, keyed_join, top_rows, written
from lexspan.operators import temporal


def applicable(mapping: DataFrame, in_force: DataFrame, clauses: DataFrame) -> DataFrame:
    """Mapping rows whose edition gate is open and whose clause lives in the edition in force.

    in_force(standard_id, on_date, edition_id, edition_no); the result carries its columns. Paths meet their editions
    first: mapping rows are then moved once, by standard and path, and never meet an edition without their path.
    """
    paths = clauses.select("edition_id", F.col("path").alias("clause_path")).distinct()
    living = keyed_join(paths, in_force, ["edition_id"], "inner")
    met = keyed_join(mapping, living, ["standard_id", "clause_path"], "inner")
    return met.where("edition_from IS NULL OR edition_from <= edition_no")


def with_presentation(df: DataFrame, catalog: DataFrame) -> DataFrame:
    """Label of the row's own object, falling back to the reference itself."""
    labels = catalog.select("config", F.col("ref").alias("object_ref"), F.col("presentation").alias("_label"))
    named = keyed_join(df, labels, ["config", "object_ref"])
    return named.withColumn("presentation", F.coalesce("_label", "object_ref")).drop("_label")


def _requested(rows: DataFrame, asked: DataFrame, extra: list[str]) -> DataFrame:
    """Rows per request: by exact path where one is given, else all rows of the standard."""
    exact = asked.where("clause_path IS NOT NULL")
    whole = asked.where("clause_path IS NULL").drop("clause_path")
    by_path = keyed_join(rows, exact, ["standard_id", "clause_path", *extra], "inner")
    by_standard = keyed_join(rows, whole, ["standard_id", *extra], "inner")
    return by_path.unionByName(by_standard)


def ranked(rows: DataFrame, order: list) -> DataFrame:
    """Rows with their `rank` in the answer to their request; an answer is one object's or one standard's rows."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("request_id").orderBy(*order)))


def mappings_for(
    params: DataFrame, mapping: DataFrame, editions: DataFrame, clauses: DataFrame,
    catalog: DataFrame, built_at,
) -> DataFrame:
    """params(request_id, standard_id, clause_path?, config) -> mapping rows per request.

    Resolved as of the corpus' build date. A request without `clause_path` gets all rows of its
    standard. `rank` orders a request's rows by confidence (highest first), then reference, then path, then the rest.
    Only rows of a standard and configuration that is asked for meet the editions; what applies is stored, as it is read
    once for requests with a path and once for the others.
    """
    wanted = params.select("standard_id", "config").distinct()
    kept = keyed_join(mapping, wanted, ["standard_id", "config"], "left_semi")
    rows = written(applicable(kept, temporal.editions_on(editions, [built_at]), clauses), "applicable")
    hits = _requested(rows, params.select("request_id", "standard_id", "clause_path", "config"), ["config"])
    order = [F.desc("confidence"), "object_ref", "clause_path", "kind", "verified", "note"]
    return ranked(with_presentation(hits, catalog), order).select(
        "request_id", "standard_id", "config", "clause_path", "kind", "object_ref", "presentation",
        "note", "confidence", "verified", "rank",
    )


def clauses_by_object(
    params: DataFrame, mapping: DataFrame, editions: DataFrame, clauses: DataFrame,
    standards: DataFrame, catalog: DataFrame, built_at,
) -> DataFrame:
    """params(request_id, object_ref, config) -> clauses implemented by the object.

    The reference is matched without regard to case; `rank` orders an answer by confidence (highest first), then
    standard, path, reference and the rest. Duplicate facts are removed, with partial
    aggregation, before requests are matched.
    """
    wanted = params.select("config", F.lower("object_ref").alias("_ref")).distinct()
    kept = mapping.withColumn("_ref", F.lower("object_ref")).join(wanted, ["config", "_ref"], "left_semi")
    rows = applicable(kept, temporal.editions_on(editions, [built_at]), clauses)
    facts = rows.select(
        "_ref", "config", "standard_id", "clause_path", "kind", "object_ref", "note", "confidence",
        "verified",
    ).distinct()
    titled = keyed_join(
        facts, standards.select(F.col("id").alias("standard_id"), F.col("title").alias("standard_title")),
        ["standard_id"], "inner",
    )
    asked = params.select("request_id", "config", F.lower("object_ref").alias("_ref"))
    hits = keyed_join(with_presentation(titled, catalog), asked, ["config", "_ref"], "inner")
    order = [F.desc("confidence"), "standard_id", "clause_path", "object_ref", "kind", "verified", "note"]
    return ranked(hits, order).select(
        "request_id", "config", "standard_id", "standard_title", "clause_path", "kind", "object_ref",
        "presentation", "note", "confidence", "verified", "rank",
    )


def mapping_status(
    mapping: DataFrame, editions: DataFrame, clauses: DataFrame, standards: DataFrame, dates
) -> DataFrame:
    """(standard_id, on_date, mapping_status) for every standard on each date.

    Mapping rows are first folded to one per (standard, path, gate): whether all are verified.
    """
    every = temporal.on_dates(standards.select(F.col("id").alias("standard_id")), dates)
    return status_of(every, mapping, temporal.editions_on(editions, dates), clauses)


def status_of(
    every: DataFrame, mapping: DataFrame, in_force: DataFrame, clauses: DataFrame
) -> DataFrame:
    """Mapping status of the given distinct (standard_id, on_date) pairs."""
    folded = mapping.groupBy("standard_id", "clause_path", "edition_from").agg(
        F.bool_and("verified").alias("verified")
    )
    rows = applicable(folded, in_force, clauses)
    verdict = rows.groupBy("standard_id", "on_date").agg(F.bool_and("verified").alias("verified"))
    named = (
        F.when(F.col("verified"), texts.MAPPING_VERIFIED)
        .when(~F.col("verified"), texts.MAPPING_DRAFT)
        .otherwise(texts.MAPPING_NONE)
    )
    return every.join(verdict, ["standard_id", "on_date"], "left").select(
        "standard_id", "on_date", named.alias("mapping_status")
    )


def verification_warning(rows: DataFrame, by: list[str]) -> DataFrame:
    """Per group: whether any row is unverified, with the warning text. No rows, no warning."""
    flagged = rows.groupBy(*by).agg(F.bool_or(~F.col("verified")).alias("unverified"))
    return flagged.withColumn("warning", F.when(F.col("unverified"), texts.MSG_UNVERIFIED))


# --- external links -----------------------------------------------------------------------------


def links_for(params: DataFrame, links: DataFrame) -> DataFrame:
    """params(request_id, standard_id, clause_path?) -> link rows, ranked by path and source; editions play no part."""
    hits = _requested(links, params.select("request_id", "standard_id", "clause_path"), [])
    return ranked(hits, ["clause_path", "its_id", "title", F.md5("summary")]).select(
        "request_id", "standard_id", "clause_path", "its_id", "title", "summary", "verified", "rank"
    )


def check_link_path(
    params: DataFrame, standards: DataFrame, editions: DataFrame, clauses: DataFrame, built_at
) -> DataFrame:
    """params(request_id, standard_id, clause_path?) -> `outcome` of the request itself.

    The path must exist in the edition in force when the corpus was built, or in the first one
    if none was.
    """
    dated = params.withColumn("on_date", F.lit(built_at))
    resolved = temporal.with_fallback_edition(dated, editions, standards)
    paths = clauses.select(
        "edition_id", F.col("path").alias("clause_path"), F.lit(True).alias("_there")
    ).distinct()
    checked = keyed_join(resolved, paths, ["edition_id", "clause_path"])
    outcome = (
        F.when(~F.col("known"), "standard_not_found")
        .when(F.col("clause_path").isNull(), "ok")
        .when(~F.col("has_editions"), "standard_not_found")
        .when(F.col("edition_id").isNull(), "no_edition")
        .when(F.col("_there").isNull(), "clause_not_found")
        .otherwise("ok")
    )
    return checked.select(*params.columns, "edition_id", outcome.alias("outcome"))


# --- catalogue ----------------------------------------------------------------------------------


def known_configs(catalog: DataFrame) -> DataFrame:
    """Distinct configurations, one row each, sorted."""
    return catalog.select("config").distinct().orderBy("config")


def configs_line(catalog: DataFrame) -> DataFrame:
    """One row: all configurations in one line. There is one entry per configuration, not per object."""
    names = F.array_join(F.array_sort(F.collect_list("config")), ", ")
    return catalog.select("config").distinct().agg(names.alias("configs"))


def is_known(params: DataFrame, catalog: DataFrame) -> DataFrame:
    """params(request_id, object_ref, config) -> adds `known_config`, `known_object`."""
    configs = catalog.select("config").distinct().withColumn("_config", F.lit(True))
    objects = catalog.select("config", F.lower("ref").alias("_ref")).distinct().withColumn(
        "_object", F.lit(True)
    )
    asked = params.withColumn("_ref", F.lower("object_ref"))
    marked = keyed_join(keyed_join(asked, configs, ["config"]), objects, ["config", "_ref"])
    return marked.select(
        *params.columns,
        F.col("_config").isNotNull().alias("known_config"),
        F.col("_object").isNotNull().alias("known_object"),
    )


_GRAM = 3


def _grams(text: Column, size: int) -> Column:
    """Distinct substrings of exactly `size` characters."""
    places = F.sequence(F.lit(1), F.greatest(F.length(text) - size + 1, F.lit(1)))
    parts = F.transform(places, lambda i: F.substr(text, i, F.lit(size)))
    return F.filter(F.array_distinct(parts), lambda g: F.length(g) == size)


def _places(text: Column, in_ref: bool) -> Column:
    """Every place of a text with the three characters that begin there."""
    ats = F.sequence(F.lit(1), F.greatest(F.length(text) - _GRAM + 1, F.lit(1)))
    return F.transform(
        ats, lambda i: F.struct(F.substr(text, i, F.lit(_GRAM)).alias("gram"), i.alias("at"), F.lit(in_ref).alias("in_ref"))
    )


def suggest_objects(params: DataFrame, catalog: DataFrame, k: int = texts.SUGGESTIONS) -> DataFrame:
    """params(request_id, object_ref, config) -> (request_id, rank, suggestion).

    Catalogue rows whose reference or label contains the fragment, first `k` by reference. No
    fragment is compared with a whole catalogue: rows are indexed by substrings of their reference and label.
    - Of up to three characters, those that are asked for.
    - Of more, those as long as an asked fragment that begins with the same three characters. What is asked for is
      then met by equality, so that rows grow with the catalogue and not with its product with the fragments.
    A task cuts its entries of a substring to `k` before they are shuffled.
    """
    asked = params.select("config", F.lower("object_ref").alias("frag")).distinct()
    rows = catalog.select("config", "ref", "presentation")
    low_ref, low_label = F.lower("ref"), F.lower("presentation")
    short = asked.where(F.length("frag") <= _GRAM)
    sizes = [F.array(F.lit(""))] + [
        F.array_union(_grams(low_ref, n), _grams(low_label, n)) for n in range(1, _GRAM + 1)
    ]
    # Only what is asked for leaves a row, and of that the first `k` a task, before anything is shuffled by it.
    wanted = short.groupBy("config").agg(F.collect_set("frag").alias("_wanted"))
    entries = each(rows.join(wanted, "config"), ["config", "ref"], F.array_intersect(F.array_distinct(F.concat(*sizes)), F.col("_wanted")), "frag")
    from_short = top_rows(entries, ["config", "frag"], [F.col("ref")], k)

    long = asked.where(F.length("frag") > _GRAM)
    # Stored, so that their size is known to the join with the catalogue's places.
    begun = written(
        long.groupBy("config", F.left("frag", F.lit(_GRAM)).alias("gram")).agg(F.collect_set(F.length("frag")).alias("sizes")),
        "beginnings",
    )
    places = F.concat(_places(F.col("_ref"), True), _places(F.col("_label"), False))
    lowered = rows.select("config", "ref", low_ref.alias("_ref"), low_label.alias("_label"))
    placed = each(lowered, ["config", "ref", "_ref", "_label"], places, "p").select("config", "ref", "_ref", "_label", "p.*")
    sized = each(keyed_join(placed, begun, ["config", "gram"], "inner"), ["config", "ref", "_ref", "_label", "at", "in_ref"], F.col("sizes"), "size")
    text = F.when(F.col("in_ref"), F.col("_ref")).otherwise(F.col("_label"))
    # A row has one entry for a substring, made where the substring stands first.
    first = (F.position(F.col("frag"), text) == F.col("at")) & (F.col("in_ref") | ~F.contains("_ref", F.col("frag")))
    cut = sized.withColumn("frag", F.substr(text, F.col("at"), F.col("size")))
    kept = cut.where((F.length("frag") == F.col("size")) & first).select("config", "frag", "ref")
    from_long = keyed_join(top_rows(kept, ["config", "frag"], [F.col("ref")], k), long, ["config", "frag"], "inner")
    best = from_short.select("config", "frag", "rank", "ref").unionByName(
        from_long.select("config", "frag", "rank", "ref")
    )
    requests = params.select("request_id", "config", F.lower("object_ref").alias("frag"))
    return keyed_join(requests, best, ["config", "frag"], "inner").select(
        "request_id", "rank", F.col("ref").alias("suggestion")
    )


def classify_objects(
    params: DataFrame, hits: DataFrame, catalog: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Reverse-lookup outcome per request, and suggestions for unknown objects.

    `hits` is the result of `clauses_by_object`. Outcomes in order: `unknown_config`, `mapped`,
    `known_no_mapping`, `unknown`.
    """
    mapped = hits.groupBy("request_id").agg(
        F.count("*").alias("clauses"), F.bool_or(~F.col("verified")).alias("unverified")
    )
    marked = is_known(params, catalog).join(mapped, "request_id", "left")
    outcome = (
        F.when(~F.col("known_config"), "unknown_config")
        .when(F.col("clauses") > 0, "mapped")
        .when(F.col("known_object"), "known_no_mapping")
        .otherwise("unknown")
    )
    # Both are read twice: by the answers, and by the suggestions or the caller.
    decided = written(marked.withColumn("outcome", outcome), "decided")
    unknown = decided.where("outcome = 'unknown'").select(*params.columns)
    suggestions = written(suggest_objects(unknown, catalog), "suggestions")
    hinted = suggestions.groupBy("request_id").agg(F.count("*").alias("suggestions"))
    message = (
        F.when(F.col("outcome") == "unknown_config", _unknown_config())
        .when(F.col("outcome") == "mapped", "")
        .when(F.col("outcome") == "known_no_mapping", texts.MSG_OBJECT_NOT_MAPPED)
        .when(F.col("suggestions") > 0, texts.MSG_OBJECT_SUGGESTED)
        .otherwise(texts.MSG_OBJECT_UNKNOWN)
    )
    answered = (
        decided.join(hinted, "request_id", "left")
        .withColumn("configs", configs_line(catalog).scalar())
        .withColumn("message", message)
        .withColumn("clauses", F.coalesce("clauses", F.lit(0)))
        .withColumn("suggestions", F.coalesce("suggestions", F.lit(0)))
        .withColumn("unverified", F.coalesce("unverified", F.lit(False)))
    )
    return answered.select(
        *params.columns, "outcome", "clauses", "suggestions", "unverified", "message"
    ), suggestions


def _unknown_config() -> Column:
    none_known = F.format_string(texts.MSG_UNKNOWN_CONFIG, F.col("config"))
    listed = F.format_string(texts.MSG_KNOWN_CONFIGS, F.col("config"), F.col("configs"))
    return F.when(F.col("configs") == "", none_known).otherwise(listed)


def mapping_message(params: DataFrame, hits: DataFrame, catalog: DataFrame) -> DataFrame:
    """Forward-lookup message per request: rows, unknown configuration, or not filled in yet."""
    found = hits.groupBy("request_id").agg(
        F.count("*").alias("mappings"), F.bool_or(~F.col("verified")).alias("unverified")
    )
    configs = catalog.select("config").distinct().withColumn("_known", F.lit(True))
    marked = keyed_join(params, configs, ["config"]).join(found, "request_id", "left")
    message = (
        F.when(F.col("mappings") > 0, "")
        .when(F.col("_known").isNull(), _unknown_config())
        .otherwise(texts.MSG_NO_MAPPING)
    )
    return marked.withColumn("configs", configs_line(catalog).scalar()).select(
        *params.columns,
        F.coalesce("mappings", F.lit(0)).alias("mappings"),
        F.coalesce("unverified", F.lit(False)).alias("unverified"),
        message.alias("message"),
    )
