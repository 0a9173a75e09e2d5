"""How often rows are moved: counted in plans, without broadcasts, as on large tables."""

import re
from datetime import date

import pytest
from pyspark.sql import functions as F

from lexspan.operators import mapping, quality
from lexspan.plans import queries
from lexspan.plans.binding import Binding
from lexspan.sources import documents


@pytest.fixture
def unbroadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def moves(df):
    return re.findall(r"Exchange hashpartitioning\((.*), \d+\)", plan_of(df))


def facts(spark):
    rows = spark.createDataFrame(
        [("s", "1", None, "A", "x", True), ("s", "2", 9, "A", "y", True), ("s", "3", 1, "B", "z", False), ("t", "1", None, "A", "x", False)],
        "standard_id string, clause_path string, edition_from int, config string, object_ref string, verified boolean",
    )
    return rows.withColumns({"kind": F.lit("k"), "note": F.lit(None).cast("string"), "confidence": F.lit(70)})


def tables(spark):
    day = date(1999, 1, 1)
    edition = spark.createDataFrame([("s@1", "s", 1, day), ("t@1", "t", 1, day)], "id string, standard_id string, edition_no int, effective_from date")
    clause = spark.createDataFrame([("s@1", "1"), ("s@1", "2"), ("s@1", "3"), ("t@1", "2")], "edition_id string, path string")
    return edition, clause


def test_mapping_rows_are_moved_once_to_what_applies(unbroadcast):
    edition, clause = tables(unbroadcast)
    in_force = edition.select("standard_id", F.lit(date(1999, 6, 30)).alias("on_date"), F.col("id").alias("edition_id"), "edition_no")
    rows = mapping.applicable(facts(unbroadcast), in_force, clause)
    plan = plan_of(rows)
    assert sorted((r.standard_id, r.clause_path) for r in rows.collect()) == [("s", "1"), ("s", "3")]
    assert re.search(r"SortMergeJoin \[standard_id#\d+, clause_path#\d+\]", plan) and "LeftSemi" not in plan


def test_requests_for_mappings_read_what_applies_once(unbroadcast):
    edition, clause = tables(unbroadcast)
    params = unbroadcast.createDataFrame([(1, "s", "1", "A"), (2, "s", None, "A"), (3, "s", None, "B")], "request_id int, standard_id string, clause_path string, config string")
    catalog = unbroadcast.createDataFrame([("A", "x", "X")], "config string, ref string, presentation string")
    hits = mapping.mappings_for(params, facts(unbroadcast), edition, clause, catalog, date(1999, 6, 30))
    assert sorted((r.request_id, r.clause_path, r.presentation) for r in hits.collect()) == [(1, "1", "X"), (2, "1", "X"), (3, "3", "z")]
    assert "/applicable-" in plan_of(hits)


def test_references_are_moved_once(unbroadcast):
    given = unbroadcast.createDataFrame([("a",), ("b",), ("b",)], "id string")
    used = unbroadcast.createDataFrame([(1, "a"), (2, "c"), (3, None)], "n int, ref string")
    space = quality.Keys((given, [F.col("id")]), ("twice",), (("exists", used, [F.col("ref")], F.col("n")),))
    found = quality.key_checks({"k": space})
    plan = plan_of(found)
    assert sorted((r.check, r.offender, r.detail) for r in found.collect()) == [("exists", "2", "c"), ("twice", "b", "2")]
    assert len(re.findall(r"Scan ExistingRDD\[n#\d+L?,ref#", plan)) == 1


def test_texts_are_moved_twice_when_nested(unbroadcast):
    text = "id string, edition_id string, pos int, path string, parent_path string, heading string, text string"
    clause = unbroadcast.createDataFrame([("c", "s@1", 0, "1", None, None, "one"), ("d", "s@1", 600, "2", None, None, "two")], text)
    edition = unbroadcast.createDataFrame([("s@1", "s", 1, None, date(1999, 1, 1))], "id string, standard_id string, edition_no int, amending_order string, effective_from date")
    names = "id string, kind string, number string, year int, title string, order_date date, order_no string, effective_from date, effective_to date, superseded_by string, source_url string"
    standard = unbroadcast.createDataFrame([("s", *[None] * 10), ("bare", *[None] * 10)], names)
    nested = documents.nest_documents(standard, edition, clause)
    assert sorted((r.standard_id, r.part) for r in nested.collect()) == [("bare", 0), ("s", 0), ("s", 1)]
    assert "FullOuter" not in plan_of(nested)


def test_lines_are_moved_once(unbroadcast, tmp_path):
    spark = unbroadcast
    spark.createDataFrame([(1, 7, date(1999, 1, 1))], "o_orderkey long, o_custkey long, o_orderdate date").write.parquet(f"{tmp_path}/orders.parquet")
    line = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_returnflag string, l_linestatus string"
    spark.createDataFrame([(1, 1, 5, 6, 1.0, "N", "O"), (1, 1, 4, 6, 1.0, "N", "O"), (2, 1, 4, 6, 1.0, "N", "O")], line).write.parquet(f"{tmp_path}/lineitem.parquet")
    clause = Binding(spark, str(tmp_path)).clause
    assert [(r.id, r.text) for r in clause.collect()] == [("c7@1#1", "Part 5 by supplier 6, NO")]
    assert not [m for m in moves(clause) if "l_linenumber" in m]


def test_a_batch_is_parsed_once(spark, monkeypatch):
    seen = []
    real = queries.documents.isolate
    monkeypatch.setattr(queries.documents, "isolate", lambda docs: seen.append(plan_of(docs)) or real(docs))
    queries.QUERIES["published_batch"](spark, "/root/testdata/sf0.001")
    assert len(seen) == 1 and "/parsed-" in seen[0]


def test_given_keys_are_counted_once(unbroadcast):
    given = unbroadcast.createDataFrame([("a", 1), ("b", 1), ("b", 1), ("a|1", 2), (None, 3)], "id string, no int")
    used = unbroadcast.createDataFrame([(1, "a", 1), (2, "c", 1), (3, "b", None), (4, "a|1", 3), (5, "a", 1)], "n int, ref string, no int")
    spaces = {
        "k": quality.Keys((given, [F.col("id")]), ("twice", "again"), (("exists", used, [F.col("ref")], F.col("n")),)),
        "pair": quality.Keys((given, [F.col("id"), F.col("no")]), (), (("pair exists", used, [F.col("ref"), F.col("no")], F.lit("x")),)),
    }
    found = quality.key_checks(spaces, ("pair exists",))
    assert sorted((r.check, r.offender, r.detail or "") for r in found.collect()) == [
        ("again", "b", "2"), ("exists", "2", "c"), ("pair exists", "x", ""), ("twice", "b", "2")]
    # Two of the three readers: keys given twice, references and those that name an offender once.
    assert len(re.findall(r"Reused(?:Exchange|QueryStage)|ReusedExchange", plan_of(found).split("== Initial Plan ==")[0])) >= 2
