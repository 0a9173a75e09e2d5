from datetime import date

import pytest
from pyspark.sql import functions as F

from lexspan import schemas, texts
from lexspan.operators import lookup


def d(text):
    return date.fromisoformat(text)


@pytest.fixture(scope="module")
def corpus(spark):
    def std(i, start, end=None, kind="ФСБУ", number="6/2020", year=2020):
        return (i, kind, number, year, f"Title {i}", d("2020-09-17"), "204н", d(start), end and d(end), None, "u")

    standards = spark.createDataFrame(
        [std("a", "2022-01-01"), std("b", "2020-01-01", "2023-01-01", "ПБУ", "10/99", 1999),
         std("late", "2020-01-01"), std("bare", "2020-01-01")],
        schemas.STANDARD,
    )
    editions = spark.createDataFrame(
        [("a@1", "a", 1, None, d("2022-01-01")), ("a@2", "a", 2, "x", d("2024-01-01")),
         ("b@1", "b", 1, None, d("2020-01-01")), ("late@1", "late", 1, None, d("2021-01-01"))],
        schemas.EDITION,
    )

    def cl(ed, pos, path, parent=None, heading=None):
        return (f"{ed}#{path}", ed.split("@")[0], ed, pos, path, parent, heading, f"text {ed} {path}")

    rows = [cl("a@1", 0, "1", heading="H"), cl("a@1", 1, "13", heading="I"), cl("a@1", 3, "13.б", "13"),
            cl("a@1", 2, "13.а", "13"), cl("a@1", 4, "13.заключение", "13"), cl("a@2", 0, "2"), cl("b@1", 0, "1"),
            cl("late@1", 0, "1")]
    return standards, editions, spark.createDataFrame(rows, schemas.CLAUSE)


def ask(spark, corpus, *rows):
    params = spark.createDataFrame(
        [(i, s, p, d(x)) for i, (s, p, x) in enumerate(rows)], "n int, standard_id string, path string, on_date date"
    )
    return {r.n: r for r in lookup.get_clauses(params, *corpus).collect()}


def test_clause_is_found_with_parent_heading_and_requisites(spark, corpus):
    got = ask(spark, corpus, ("a", "13.а", "2023-05-05"))[0]
    assert (got.outcome, got.text, got.parent_path, got.parent_heading) == ("found", "text a@1 13.а", "13", "I")
    assert got.edition_no == 1 and got.status == texts.ACTIVE and got.warning is None
    assert got.order_ref == "приказ Минфина России от 17.09.2020 № 204н"


def test_outcomes(spark, corpus):
    got = ask(
        spark, corpus, ("a", "1", "2021-01-01"), ("a", "1", "2024-06-01"), ("zzz", "1", "2024-06-01"),
        ("b", "1", "2023-01-01"), ("late", "1", "2019-01-01"), ("bare", "1", "2024-01-01"), ("late", "1", "2020-06-01"),
    )
    assert (got[0].outcome, got[0].status, got[0].on_date) == ("found", texts.NOT_YET, d("2021-01-01"))
    assert got[0].warning == "На 01.01.2021 стандарт не действует: не вступил в силу."
    assert got[1].outcome == "clause_not_found" and got[1].error.endswith("Доступные пункты: 2")
    assert got[2].outcome == "standard_not_found" and "'zzz'" in got[2].error
    assert (got[3].outcome, got[3].status) == ("found", texts.REPEALED)
    assert got[4].outcome == "no_edition" and got[4].error.endswith("действующей на 2020-01-01")
    assert got[5].outcome == "standard_not_found"
    assert got[6].outcome == "no_edition"


def test_children_and_outline_keep_document_order(spark, corpus):
    _, editions, clauses = corpus
    kids = lookup.children(clauses).where("path = '13'").orderBy("pos").collect()
    assert [r.child for r in kids] == ["13.а", "13.б", "13.заключение"]
    listed = lookup.outline(editions, clauses, [d("2023-01-01")]).where("standard_id = 'a'").collect()
    assert [r.path for r in listed] == ["1", "13", "13.а", "13.б", "13.заключение"]


def test_list_is_ordered_by_year_and_number_as_text(spark, corpus):
    standards = corpus[0]
    got = lookup.list_standards(standards, [d("2023-06-01")]).collect()
    assert [r.id for r in got] == ["b", "a", "bare", "late"]
    assert got[0].status == texts.REPEALED
    assert [r.id for r in lookup.list_standards(standards, [d("2023-06-01")], "ПБУ").collect()] == ["b"]


def test_lookup_reports_unknown_ids(spark, corpus):
    params = spark.createDataFrame([("a",), ("q",)], "standard_id string")
    got = {r.standard_id: r for r in lookup.lookup(params, corpus[0]).collect()}
    assert got["a"].title == "Title a" and got["a"].error is None
    assert got["q"].outcome == "standard_not_found" and got["q"].error == "Стандарт 'q' отсутствует в корпусе"


def test_successors(spark):
    rel = spark.createDataFrame(
        [("x", "z", "заменён"), ("x", "y", "заменён"), ("x", "w", "аналог")], schemas.STANDARD_RELATION
    )
    assert sorted(r.successor for r in lookup.successors(rel).collect()) == ["y", "z"]


def test_staleness_starts_after_ninety_days(spark):
    meta = spark.createDataFrame([(d("2026-01-01"),)], "built_at date")
    fresh = lookup.stale_warning(meta, F.lit(d("2026-04-01"))).first()
    stale = lookup.stale_warning(meta, F.lit(d("2026-04-02"))).first()
    assert (fresh.stale, fresh.warning) == (False, None)
    assert stale.stale and stale.warning.startswith("Корпус собран 01.01.2026 (91 дн. назад)")


def test_populated(spark, corpus):
    meta = spark.createDataFrame([(d("2026-01-01"),)], "built_at date")
    assert lookup.is_populated(meta, corpus[0]).first().populated
    assert not lookup.is_populated(meta.limit(0), corpus[0]).first().populated
