"""A published corpus and the questions it answers, each for a whole table of requests."""

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspan import texts
from lexspan.functions.scale import factorised, keyed_join, written
from lexspan.operators import lookup, mapping, search, temporal
from lexspan.sources import publish


@dataclass(frozen=True)
class Corpus:
    """Tables as in `schemas`, the day they were built, and a search index if one was built."""

    standard: DataFrame
    edition: DataFrame
    clause: DataFrame
    mapping: DataFrame
    config_object: DataFrame
    link: DataFrame
    standard_relation: DataFrame
    built_at: date
    index: search.Index | None = None
    lemmas: DataFrame | None = None

    def warnings(self, today: date) -> DataFrame:
        """Standing warnings of every answer: (warning), empty for a fresh corpus."""
        meta = self.standard.sparkSession.createDataFrame([(self.built_at,)], "built_at date")
        return lookup.stale_warning(meta, F.lit(today)).where("stale").select("warning")

    def list_standards(self, dates: Sequence[date], kind: str | None = None) -> DataFrame:
        """Registry rows per date with status and mapping status, ordered by year and number."""
        listed = lookup.list_standards(self.standard, dates, kind)
        states = mapping.mapping_status(self.mapping, self.edition, self.clause, self.standard, dates)
        named = listed.join(states.withColumnRenamed("standard_id", "id"), ["id", "on_date"])
        return named.orderBy("on_date", "year", "number", "id")

    def draft_warnings(self, summaries: DataFrame) -> DataFrame:
        """(on_date, warning) where a listed standard's mapping is an unreviewed draft."""
        rows = summaries.where(F.col("mapping_status") != texts.MAPPING_NONE).select(
            "on_date", (F.col("mapping_status") == texts.MAPPING_VERIFIED).alias("verified")
        )
        return mapping.verification_warning(rows, ["on_date"]).where("unverified").select("on_date", "warning")

    def get_standard(self, params: DataFrame) -> tuple[DataFrame, DataFrame]:
        """params(request_id, standard_id, on_date) -> (summaries, outlines).

        A summary names the edition that answers it; outlines(edition_id, standard_id, pos, path, heading) hold every asked
        edition once, however many requests it answers.
        A standard without an edition in force on the date is an error, as its outline is asked for
        too; what replaces a standard is `lookup.successors`.
        """
        in_force = temporal.edition_as_of(self.edition, params)
        dated = keyed_join(params, in_force, ["standard_id", "on_date"])
        numbered = self.edition.groupBy("standard_id").agg(F.lit(True).alias("_has"))
        known = keyed_join(lookup.lookup(dated, self.standard), numbered, ["standard_id"])
        outcome = (
            F.when((F.col("outcome") != "found") | F.col("_has").isNull(), "standard_not_found")
            .when(F.col("edition_id").isNull(), "no_edition")
            .otherwise("found")
        )
        error = F.when(
            F.col("outcome") == "standard_not_found", F.format_string(texts.MSG_STANDARD_NOT_FOUND, "standard_id")
        ).when(
            F.col("outcome") == "no_edition",
            F.format_string(texts.MSG_NO_EDITION, F.col("standard_id"), F.col("on_date").cast("string")),
        )
        answered = known.withColumn("outcome", outcome).withColumn("error", error).drop("_has")
        answered = temporal.with_status(answered)
        answered = answered.withColumn("status", F.when(F.col("outcome") == "found", F.col("status")))
        answered = written(answered, "standards-asked")
        found = answered.where("outcome = 'found'")
        pairs = found.select("standard_id", "on_date").distinct()
        states = mapping.status_of(
            pairs, self.mapping, found.select("standard_id", "on_date", "edition_id", "edition_no").distinct(), self.clause
        )
        summaries = keyed_join(answered, states, ["standard_id", "on_date"])
        listed = self.clause.select("edition_id", "standard_id", "pos", "path", "heading")
        return summaries, listed.join(found.select("edition_id").distinct(), "edition_id", "left_semi")

    def get_clause(self, params: DataFrame) -> DataFrame:
        """params(..., standard_id, path, on_date) -> the clause, its provenance, or why not."""
        return lookup.get_clauses(params, self.standard, self.edition, self.clause)

    def search_clauses(self, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
        """queries(query_id, query, on_date, standard_ids, k) -> (hits, messages)."""
        if self.index is None:
            raise ValueError("this corpus has no search index: save one with search.save_index")
        hits = search.search(queries, self.index, self.lemmas)
        shown = search.present(hits, queries, self.clause, self.standard)
        return shown, search.search_messages(queries, hits)

    def get_mapping(self, params: DataFrame) -> tuple[DataFrame, DataFrame]:
        """params(request_id, standard_id, clause_path, config) -> (answers, messages).

        Every request has one row of messages: `outcome` says whether its standard is known; for an unknown one
        `error` says so, `message` is null and there are no mapping rows. `answer_id` names the request's mapping
        rows, which requests for the same share.
        """
        keys = ["standard_id", "clause_path", "config"]
        relation, asked = factorised(params, keys)
        asked = asked.withColumnRenamed("answer_id", "request_id")
        there = self.standard.select(F.col("id").alias("standard_id"))
        known = asked.join(there, "standard_id", "left_semi")
        hits = mapping.mappings_for(known, self.mapping, self.edition, self.clause, self.config_object, self.built_at)
        marked = keyed_join(asked, there.distinct().withColumn("_there", F.lit(True)), ["standard_id"])
        told = mapping.mapping_message(marked, hits, self.config_object)
        unknown = F.col("_there").isNull()
        told = told.select(
            F.col("request_id").alias("answer_id"), *keys, "mappings", "unverified",
            F.when(unknown, "standard_not_found").otherwise("ok").alias("outcome"),
            F.when(~unknown, F.col("message")).alias("message"),
            F.when(unknown, F.format_string(texts.MSG_STANDARD_NOT_FOUND, "standard_id")).alias("error"),
        )
        return hits.withColumnRenamed("request_id", "answer_id"), keyed_join(relation, told, ["answer_id"], "inner")

    def find_by_object(self, params: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        """params(request_id, object_ref, config) -> (answers, outcomes, suggestions).

        Answers and suggestions are keyed by `answer_id`, which the outcome of every request names.
        """
        relation, asked = factorised(params, ["object_ref", "config"])
        asked = asked.withColumnRenamed("answer_id", "request_id")
        hits = written(
            mapping.clauses_by_object(
                asked, self.mapping, self.edition, self.clause, self.standard, self.config_object, self.built_at
            ),
            "clauses-by-object",
        )
        outcomes, suggestions = mapping.classify_objects(asked, hits, self.config_object)
        named = [df.withColumnRenamed("request_id", "answer_id") for df in (hits, outcomes, suggestions)]
        return named[0], keyed_join(relation, named[1], ["answer_id"], "inner"), named[2]

    def get_references(self, params: DataFrame) -> tuple[DataFrame, DataFrame]:
        """params(request_id, standard_id, clause_path) -> (links, outcomes with messages)."""
        checked = written(
            mapping.check_link_path(params, self.standard, self.edition, self.clause, self.built_at), "links-asked"
        )
        good = checked.where("outcome = 'ok'").select("request_id", "standard_id", "clause_path")
        links = mapping.links_for(good, self.link)
        counted = links.groupBy("request_id").agg(
            F.count("*").alias("links"), F.bool_or(~F.col("verified")).alias("unverified")
        )
        message = F.when(F.col("outcome") != "ok", None).when(F.col("links") > 0, "").otherwise(texts.MSG_NO_LINKS)
        answered = checked.join(counted, "request_id", "left").withColumn("message", message)
        return links, answered.select(
            *params.columns, "outcome", F.coalesce("links", F.lit(0)).alias("links"),
            F.coalesce("unverified", F.lit(False)).alias("unverified"), "message",
        )

    def registry(self, on_date: date, today: date) -> DataFrame:
        """The registry as ordered Markdown lines."""
        dated = temporal.with_status(self.standard.withColumn("on_date", F.lit(on_date)))
        states = mapping.mapping_status(self.mapping, self.edition, self.clause, self.standard, [on_date])
        return publish.registry_report(dated, states, on_date, self.warnings(today))


def load(spark, root: str, lemmas: DataFrame | None = None) -> Corpus:
    """The newest published build under `root` and its build date, with its index when one was published."""
    build = publish.latest(spark, root)
    names = ["standard", "edition", "clause", "mapping", "config_object", "link", "standard_relation"]
    index = search.open_index(spark, f"{build.path}/index") if "index" in build.tables else None
    return Corpus(**{n: build.table(spark, n) for n in names}, built_at=build.built_at, index=index, lemmas=lemmas)
