"""Publishing a corpus as a whole, its fingerprints, snapshot comparison and reports."""

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from datetime import date

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspan import texts
from lexspan.functions.columns import ru_date

_MANIFEST = "manifest"
# Leading hex digits of a row digest that name its first-level bucket.
_DEPTH = 5


class PublishError(Exception):
    """The build broke a check or its id is taken; what was published before is untouched."""


@dataclass(frozen=True)
class Build:
    build_id: str
    path: str
    built_at: date
    tables: tuple[str, ...]

    def table(self, spark: SparkSession, name: str) -> DataFrame:
        return spark.read.parquet(f"{self.path}/{name}")


def _files(spark: SparkSession, path: str):
    """A path and its file system, as Spark reaches them."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def _claim(spark: SparkSession, path: str) -> bool:
    """Create an empty file; false if it is there already. Of two that try at once, one creates it."""
    place, files = _files(spark, path)
    files.mkdirs(place.getParent())
    try:
        if files.getScheme() == "file":
            # The local file system's own test and creation are two steps.
            local = spark._jvm.java.nio.file.Paths.get(place.toUri().getPath(), spark.sparkContext._gateway.new_array(spark._jvm.java.lang.String, 0))
            attributes = spark.sparkContext._gateway.new_array(spark._jvm.java.nio.file.attribute.FileAttribute, 0)
            spark._jvm.java.nio.file.Files.createFile(local, attributes)
        else:
            files.create(place, False).close()
    except Py4JJavaError as e:
        if "AlreadyExists" in e.java_exception.getClass().getName():
            return False
        raise
    return True


def _numbers(spark: SparkSession, root: str, ending: str) -> list[int]:
    place, files = _files(spark, f"{root}/{_MANIFEST}")
    if not files.exists(place):
        return []
    names = [f.getPath().getName() for f in files.listStatus(place)]
    return sorted(int(n.removesuffix(ending)) for n in names if n.endswith(ending) and n.removesuffix(ending).isdigit())


def publish(
    spark: SparkSession, tables: dict[str, DataFrame], root: str, build_id: str, built_at: date, checks,
    derived: dict[str, Callable] | None = None,
) -> Build:
    """Write all tables under a folder of this attempt, check what was written, then announce it.

    `derived` maps a name to a function of (stored tables, folder) that writes what is made from them, as a search
    index, and returns tables for the checks. `checks(tables)` returns violations(check, offender, detail).

    Readers only follow the manifest. Its entries are numbered files, and a build's id and number are claimed by creating
    a file that must not exist: of two builds under one id only one is announced, and no two share a number. An attempt
    that fails on the way, or comes second, is never seen, and its folder is removed. An id claimed by a build
    that was lost before its entry was written stays taken.
    """
    if _files(spark, root)[1].exists(_files(spark, f"{root}/{_MANIFEST}/ids/{build_id}")[0]):
        raise PublishError(f"build {build_id} exists")
    path, names = f"{root}/builds/{build_id}-{uuid.uuid4().hex}", sorted([*tables, *(derived or {})])
    folder, files = _files(spark, path)
    try:
        for name, df in tables.items():
            df.write.mode("errorifexists").parquet(f"{path}/{name}")
        stored = {name: spark.read.schema(df.schema).parquet(f"{path}/{name}") for name, df in tables.items()}
        for name, write in (derived or {}).items():
            stored.update(write(stored, f"{path}/{name}") or {})
        broken = checks(stored).limit(texts.PREVIEW_OFFENDERS).collect()
        if broken:
            raise PublishError("; ".join(f"{r['check']}: {r['offender']}" for r in broken))
        if not _claim(spark, f"{root}/{_MANIFEST}/ids/{build_id}"):
            raise PublishError(f"build {build_id} exists")
    except Exception:
        files.delete(folder, True)
        raise
    number = max(_numbers(spark, root, ".claim"), default=0) + 1
    while not _claim(spark, f"{root}/{_MANIFEST}/{number:09d}.claim"):
        number += 1
    entry = {"build_id": build_id, "built_at": built_at.isoformat(), "path": path, "tables": names}
    draft, _ = _files(spark, f"{root}/{_MANIFEST}/{number:09d}.draft")
    out = files.create(draft, True)
    out.write(bytearray(json.dumps(entry, ensure_ascii=False).encode()))
    out.close()
    files.rename(draft, _files(spark, f"{root}/{_MANIFEST}/{number:09d}.json")[0])
    return Build(build_id, path, built_at, tuple(names))


def latest(spark: SparkSession, root: str) -> Build:
    """The announced build with the highest number."""
    numbers = _numbers(spark, root, ".json")
    if not numbers:
        raise PublishError(f"nothing is published under {root}")
    text = spark.read.text(f"{root}/{_MANIFEST}/{numbers[-1]:09d}.json", wholetext=True).first()["value"]
    entry = json.loads(text)
    return Build(entry["build_id"], entry["path"], date.fromisoformat(entry["built_at"]), tuple(entry["tables"]))


# --- fingerprints -------------------------------------------------------------------------------


def _row_text() -> Column:
    return F.concat_ws("|", "id", "order_no", F.col("effective_from").cast("string"))


def registry_hash(standards: DataFrame) -> DataFrame:
    """One row: the merged digest of `id|order_no|effective_from` over all standards, at any size."""
    return corpus_fingerprint(standards, _row_text()).select(F.col("fingerprint").alias("registry_hash"))


def corpus_fingerprint(df: DataFrame, row_text: Column) -> DataFrame:
    """One row: a digest of any number of rows, whatever their order.

    Rows are digested where they are, then bucketed by the leading hex digits of the digest;
    buckets are digested and merged sixteen at a time up to the root, so every group stays small.
    Equal rows are counted first and enter once with their count.
    """
    level = (
        df.select(F.sha2(row_text, 256).alias("d")).groupBy("d").agg(F.count("*").alias("n"))
        .select(F.substring("d", 1, _DEPTH).alias("prefix"), F.concat_ws("*", "d", "n").alias("d"))
    )
    for width in range(_DEPTH, -1, -1):
        entries = F.array_join(F.array_sort(F.collect_list("d")), ",")
        level = level.groupBy(F.substring("prefix", 1, width).alias("prefix")).agg(
            F.sha2(entries, 256).alias("d")
        )
    return level.select(F.col("d").alias("fingerprint"))


# --- comparison ---------------------------------------------------------------------------------


def diff_registry(live: DataFrame, stored: DataFrame) -> DataFrame:
    """(change, standard_id, field, old, new): added, removed, and one row per changed field."""
    fields = list(texts.DIFF_FIELDS)

    def side(df: DataFrame, name: str) -> DataFrame:
        values = [F.col(f).cast("string").alias(f) for f in fields]
        return df.select(F.col("id").alias("standard_id"), F.struct(*values).alias(name))

    both = side(live, "live").join(side(stored, "stored"), "standard_id", "full_outer")
    added, removed = F.col("stored").isNull(), F.col("live").isNull()

    def row(change: str, field, old, new) -> Column:
        null = F.lit(None).cast("string")
        return F.struct(
            F.lit(change).alias("change"), (null if field is None else F.lit(field)).alias("field"),
            (null if old is None else old).alias("old"), (null if new is None else new).alias("new"),
        )

    changed = [
        F.when(
            ~added & ~removed & ~F.col(f"live.{f}").eqNullSafe(F.col(f"stored.{f}")),
            row("changed", f, F.col(f"stored.{f}"), F.col(f"live.{f}")),
        )
        for f in fields
    ]
    changes = F.array_compact(F.array(
        F.when(added, row("added", None, None, None)),
        F.when(removed, row("removed", None, None, None)),
        *changed,
    ))
    long = both.select("standard_id", F.explode(changes).alias("c"))
    return long.select("c.change", "standard_id", "c.field", "c.old", "c.new")


def render_diff(diff: DataFrame) -> DataFrame:
    """(section, standard_id, item, line) of the report in reading order; one line if nothing changed."""
    fields = list(texts.DIFF_FIELDS)
    section = F.when(F.col("change") == "added", 0).when(F.col("change") == "removed", 1).otherwise(2)
    item = F.coalesce(F.array_position(F.lit(fields), F.col("field")).cast("int"), F.lit(1))
    label = F.element_at(F.lit(list(texts.DIFF_FIELDS.values())), item)
    body = F.when(
        F.col("change") == "changed",
        F.format_string(
            "- `%s`: %s %s → %s", F.col("standard_id"), label,
            F.coalesce("old", F.lit("None")), F.coalesce("new", F.lit("None")),
        ),
    ).otherwise(F.format_string("- `%s`", F.col("standard_id")))
    lines = diff.select(section.alias("section"), "standard_id", item.alias("item"), body.alias("line"))
    titles = F.array(F.lit(texts.DIFF_ADDED), F.lit(texts.DIFF_REMOVED), F.lit(texts.DIFF_CHANGED))
    heads = lines.select("section").distinct().select(
        "section", F.lit("").alias("standard_id"), F.lit(0).alias("item"),
        F.get(titles, F.col("section")).alias("line"),
    )
    nothing = diff.limit(1).agg(F.count("*").alias("n")).where("n = 0").select(
        F.lit(0).alias("section"), F.lit("").alias("standard_id"), F.lit(0).alias("item"),
        F.lit(texts.DIFF_NONE).alias("line"),
    )
    return heads.unionByName(lines).unionByName(nothing).orderBy("section", "standard_id", "item")


def reproduces(derived: DataFrame, stored: DataFrame, key: list[str]) -> DataFrame:
    """(key..., side, rows): rows only one of two tables has, with how many more it has.

    Rows are compared by digest: the texts themselves stay where they are.
    """
    columns = derived.columns

    def side(df: DataFrame, sign: int) -> DataFrame:
        whole = F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
        return df.select(*key, whole.alias("digest"), F.lit(sign).alias("sign"))

    both = side(derived, 1).unionByName(side(stored, -1))
    balance = both.groupBy(*key, "digest").agg(F.sum("sign").alias("balance")).where("balance != 0")
    return balance.select(
        *key,
        F.when(F.col("balance") > 0, "derived").otherwise("stored").alias("side"),
        F.abs("balance").alias("rows"),
    )


# --- report -------------------------------------------------------------------------------------


def registry_report(
    standards: DataFrame, mapping_status: DataFrame, on_date: date, warnings: DataFrame
) -> DataFrame:
    """(section, year, number, id, line): the registry as a Markdown table, warnings on top.

    standards(…, status) on the date, mapping_status(standard_id, mapping_status),
    warnings(warning).
    """
    named = standards.join(
        mapping_status.select(F.col("standard_id").alias("id"), "mapping_status"), "id"
    )
    body = F.format_string(
        "| %s | %s | %s | %s | от %s № %s | %s | %s | %s |",
        "id", "kind", "number", "title", ru_date(F.col("order_date")), F.col("order_no"),
        ru_date(F.col("effective_from")), F.col("status"), F.col("mapping_status"),
    )
    spark = standards.sparkSession
    place = "section int, year int, number string, id string, line string"
    title = texts.REPORT_TITLE % on_date.strftime("%d.%m.%Y")
    fixed = [(0, 0, "", "", title), (1, 0, "", "", "")]
    fixed += [(4, i, "", "", line) for i, line in enumerate(texts.REPORT_HEADER)]
    top = spark.createDataFrame(fixed, place)
    notes = warnings.where("warning IS NOT NULL")
    quoted = notes.select(
        F.lit(2).alias("section"), F.lit(0).alias("year"), F.lit("").alias("number"),
        F.lit("").alias("id"), F.concat(F.lit("> "), "warning").alias("line"),
    )
    gap = notes.limit(1).select(
        F.lit(3).alias("section"), F.lit(0).alias("year"), F.lit("").alias("number"),
        F.lit("").alias("id"), F.lit("").alias("line"),
    )
    rows = named.select(F.lit(5).alias("section"), "year", "number", "id", body.alias("line"))
    parts = top.unionByName(quoted).unionByName(gap).unionByName(rows)
    return parts.orderBy("section", "year", "number", "id")
