"""Nested source documents <-> flat tables, and the loaders' own row checks."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexspan import schemas, texts
from lexspan.functions.scale import each, keyed_join
from lexspan.operators.quality import unstable

# Positions that one written part of an edition spans; every edition is written in such parts.
PART_SPAN = 500


# Holds the text of a document that is no valid JSON, or whose values are not of their kinds.
CORRUPT = "_corrupt"
_READ = T.StructType([*schemas.DOCUMENT.fields, T.StructField(CORRUPT, T.StringType(), True)])


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """JSON documents of a directory with the file each one came from; unreadable ones are rows too."""
    # Read as texts: a JSON scan would not look at the columns that a query leaves out, and miss what is wrong there.
    files = spark.read.text(path, wholetext=True)
    return parse_documents(files.select(F.col("_metadata.file_path").alias("source_file"), F.col("value").alias("document")))


def parse_documents(records: DataFrame, text: str = "document") -> DataFrame:
    """records(source_file, text) -> documents as `read_documents` gives them; a text may hold a list of documents."""
    whole = F.array(F.coalesce(text, F.lit("")))
    listed = F.when(F.col(text).rlike(r"\A\s*\["), F.from_json(F.col(text), "array<string>"))
    rows = records.select("source_file", F.explode(F.coalesce(listed, whole)).alias("_text"))
    parsed = F.from_json("_text", _READ, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    rows = rows.select("source_file", "_text", parsed.alias("d"))
    names = [f"d.{f.name}" for f in schemas.DOCUMENT.fields]
    unread = F.when(F.col("_text").isNull() | F.col("d").isNull(), F.coalesce("_text", F.lit(""))).otherwise(F.col(f"d.{CORRUPT}"))
    return rows.select("source_file", *names, unread.alias(CORRUPT))


def isolate(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, quarantine) of read documents: good ones as `flatten_documents` takes them, and
    quarantine(source_file, id, error, digest), one row per error of each bad one.

    A bad document costs no other document anything: it is set aside as a whole, by itself.
    """
    unread = F.when(F.col(CORRUPT).isNotNull(), F.array(F.lit("unreadable document")))
    marked = docs.withColumn("_errors", F.coalesce(unread, _document_errors()))
    good = marked.where(F.size("_errors") == 0).drop("_errors", CORRUPT)
    bad = marked.where(F.size("_errors") > 0)
    digest = F.md5(F.coalesce(CORRUPT, F.to_json(F.struct(*[f.name for f in schemas.DOCUMENT.fields]))))
    return good, bad.select("source_file", "id", F.explode("_errors").alias("error"), digest.alias("digest"))


def edition_id(standard_id: Column, edition_no: Column) -> Column:
    return F.concat_ws("@", standard_id, edition_no)


def clause_id(edition: Column, path: Column) -> Column:
    return F.concat_ws("#", edition, path)


def flatten_documents(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """docs -> (standard, edition, clause); ids are derived, document order becomes `pos`.

    A document may come in parts: the standard is described by the one that does not continue another,
    an edition by its part 0. A clause keeps the position it states, else its place in the document.
    """
    standard = docs.where(~F.coalesce("continues", F.lit(False))).select(*[f.name for f in schemas.STANDARD.fields])
    parts = docs.select("id", F.explode("editions").alias("e")).select(
        F.col("id").alias("standard_id"),
        edition_id(F.col("id"), F.col("e.edition_no")).alias("edition_id"),
        "e.edition_no", "e.amending_order", "e.effective_from",
        F.coalesce("e.part", F.lit(0)).alias("part"), "e.clauses",
    )
    edition = parts.where("part = 0").select(
        F.col("edition_id").alias("id"), "standard_id", "edition_no", "amending_order", "effective_from"
    )
    clause = parts.select("standard_id", "edition_id", F.posexplode("clauses").alias("at", "c"))
    return standard, edition, clause.select(
        clause_id(F.col("edition_id"), F.col("c.path")).alias("id"),
        "standard_id",
        "edition_id",
        F.coalesce("c.pos", "at").alias("pos"),
        "c.path", "c.parent_path", "c.heading", "c.text",
    )


def _document_errors() -> Column:
    """Distinct errors of a document row."""
    def of_edition(e: Column) -> Column:
        clauses = F.coalesce(e["clauses"], F.array())
        paths = F.transform(clauses, lambda c: c["path"])
        return F.array_compact(F.array(
            F.when(e["edition_no"].isNull(), F.lit("edition without edition_no")),
            F.when(F.exists(paths, lambda p: p.isNull()), F.lit("clause without path")),
            F.when(
                F.size(F.array_distinct(F.filter(paths, lambda p: p.isNotNull())))
                < F.size(F.filter(paths, lambda p: p.isNotNull())),
                F.lit("duplicate clause path"),
            ),
        ))

    own = F.array_compact(F.array(F.when(F.col("id").isNull(), F.lit("missing id"))))
    nested = F.flatten(F.transform(F.coalesce("editions", F.array()), of_edition))
    return F.array_distinct(F.concat(own, nested))


def document_errors(docs: DataFrame) -> DataFrame:
    """(id, error): documents without an id, editions without a number, clauses without a path,
    clause paths given twice. Bad documents are listed; the others are unaffected."""
    return each(docs, ["id"], _document_errors(), "error")


def duplicate_sources(docs: DataFrame) -> DataFrame:
    """(id, source_file, files): every file that declares an id some other file declares too."""
    files = docs.select("id", "source_file").distinct()
    shared = files.groupBy("id").agg(F.count("*").alias("files")).where("files > 1")
    return keyed_join(files, shared, ["id"], "inner")


def nest_documents(
    standard: DataFrame, edition: DataFrame, clause: DataFrame, span: int = PART_SPAN
) -> DataFrame:
    """Flat tables -> (standard_id, edition_no, part, document): JSON documents that `flatten_documents` reads back.

    Every standard is written the same way, whatever its size: a row for each range of `span` positions of each
    edition, part 0 also when it holds no clause, and one row for a standard without editions. The part 0
    of a standard's first edition describes the standard, the others continue it.
    """
    fields = F.struct("pos", "path", "parent_path", "heading", "text")
    ed = edition.select(
        F.col("id").alias("edition_id"), "standard_id", "edition_no", "amending_order",
        F.col("effective_from").alias("edition_from"),
    )
    # A head stands for part 0 of an edition, with or without clauses; both are collected in one shuffle.
    placed = clause.select("edition_id", F.floor(F.col("pos") / span).cast("int").alias("part"), fields.alias("c"), F.lit(0).alias("head"))
    heads = ed.select("edition_id", F.lit(0).alias("part"), F.lit(1).alias("head"))
    collected = placed.unionByName(heads, allowMissingColumns=True).where("edition_id IS NOT NULL").groupBy("edition_id", "part").agg(
        F.array_sort(F.collect_list("c")).alias("clauses"), F.sum("head").alias("heads")
    )
    parts = collected.select("edition_id", "part", "clauses", F.explode(F.expr("array_repeat(0, greatest(int(heads), 1))")).alias("_head"))
    first = ed.groupBy("standard_id").agg(F.min(F.struct("edition_no", "edition_id"))["edition_id"].alias("first_id"))
    std = standard.withColumnRenamed("id", "standard_id").join(first, "standard_id", "left")
    # Standards meet the short edition rows first, so that texts are moved once more and not twice.
    described = std.join(ed.where("edition_id IS NOT NULL"), "standard_id", "left")
    full = keyed_join(described, parts, ["edition_id"])
    nested = F.struct(
        "edition_no", "amending_order", F.col("edition_from").alias("effective_from"), "part",
        F.coalesce("clauses", F.array().cast(schemas.DOCUMENT["editions"].dataType.elementType["clauses"].dataType)).alias("clauses"),
    )
    editions = F.when(F.col("edition_id").isNotNull(), F.array(nested)).otherwise(F.array().cast(schemas.DOCUMENT["editions"].dataType))
    continues = F.coalesce((F.col("edition_id") != F.col("first_id")) | (F.col("part") > 0), F.lit(False))
    own = [F.col("standard_id").alias("id")] + [F.col(f.name) for f in schemas.STANDARD.fields[1:]]
    document = F.struct(*own, editions.alias("editions"), continues.alias("continues"))
    return full.select("standard_id", "edition_no", F.coalesce("part", F.lit(0)).alias("part"), F.to_json(document).alias("document"))


def valid_edges(edges: DataFrame, standards: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, skipped): relations with both ends known, and the others."""
    ids = standards.select("id").distinct()
    marked = edges
    for end in ("from_standard", "to_standard"):
        known = ids.select(F.col("id").alias(end), F.lit(True).alias(f"_{end}"))
        marked = keyed_join(marked, known, [end])
    both = F.col("_from_standard").isNotNull() & F.col("_to_standard").isNotNull()
    columns = edges.columns
    return marked.where(both).select(*columns), marked.where(~both).select(*columns)


def load_catalog(objects: DataFrame, configs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(catalogue, duplicates): objects of configurations that have mappings, one per reference; references given twice.

    Of a reference given twice the row with the smallest kind and presentation stays. Both come from one aggregation.
    """
    kept = objects.join(configs.select("config").distinct(), "config", "left_semi")
    rest = [c for c in objects.columns if c not in ("config", "ref")]
    one = kept.groupBy("config", "ref").agg(F.min(F.struct(*rest)).alias("_row"), F.count("*").alias("rows"))
    return one.select("config", "ref", "_row.*"), one.where("rows > 1").select("config", "ref", "rows")


def check_mappings(mapping: DataFrame, clauses: DataFrame, catalog: DataFrame) -> DataFrame:
    """Mapping rows with every rule they break, one output row per broken rule."""
    paths = clauses.select(
        "standard_id", F.col("path").alias("clause_path"), F.lit(True).alias("_path")
    ).distinct()
    objects = catalog.select(
        "config", F.col("ref").alias("object_ref"), F.col("kind").alias("_kind")
    ).distinct()
    seen = keyed_join(mapping, paths, ["standard_id", "clause_path"])
    seen = keyed_join(seen, objects, ["config", "object_ref"])
    stable = ~unstable(F.col("clause_path"))
    broken = F.array_compact(F.array(
        F.when(~stable, F.lit("unstable path")),
        F.when(stable & F.col("_path").isNull(), F.lit("unknown path")),
        F.when(F.col("_kind").isNull(), F.lit("unknown object")),
        F.when(F.col("_kind") != F.col("kind"), F.lit("kind differs")),
        F.when(F.col("confidence") < texts.MIN_CONFIDENCE, F.lit("low confidence")),
    ))
    return each(seen, mapping.columns, broken, "violation")


def check_links(links: DataFrame, clauses: DataFrame) -> DataFrame:
    """Link rows with every rule they break, one output row per broken rule."""
    paths = clauses.select(
        "standard_id", F.col("path").alias("clause_path"), F.lit(True).alias("_path")
    ).distinct()
    seen = keyed_join(links, paths, ["standard_id", "clause_path"])
    stable = ~unstable(F.col("clause_path"))
    broken = F.array_compact(F.array(
        F.when(~stable, F.lit("unstable path")),
        F.when(stable & F.col("_path").isNull(), F.lit("unknown path")),
        F.when(F.length("summary") > texts.MAX_SUMMARY_CHARS, F.lit("summary too long")),
    ))
    return each(seen, links.columns, broken, "violation")


