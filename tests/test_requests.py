from datetime import date

import pytest

import __spark_entry__ as entry
from lexspan import schemas, texts
from lexspan.operators import quality, search
from lexspan.plans import requests
from lexspan.sources import publish


def d(text):
    return date.fromisoformat(text)


BUILT = date(2024, 1, 1)


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    def std(i, start, end=None):
        return (i, "ФСБУ", "6/2020", 2020, f"Title {i}", d("2020-09-17"), "204н", d(start), end and d(end), None, "u")

    def cl(ed, pos, path, text):
        return (f"{ed}#{path}", ed.split("@")[0], ed, pos, path, None, None, text)

    t = {
        "standard": spark.createDataFrame([std("a", "2020-01-01"), std("old", "2000-01-01", "2021-01-01"), std("soon", "2030-01-01")], schemas.STANDARD),
        "edition": spark.createDataFrame(
            [("a@1", "a", 1, None, d("2020-01-01")), ("a@2", "a", 2, None, d("2023-01-01")),
             ("old@1", "old", 1, None, d("2000-01-01")), ("soon@1", "soon", 1, None, d("2030-01-01"))], schemas.EDITION),
        "clause": spark.createDataFrame(
            [cl("a@1", 0, "1", "основные средства"), cl("a@2", 0, "1", "основные средства и запасы"), cl("a@2", 1, "2", "аренда"),
             cl("old@1", 0, "1", "основные средства прежние"), cl("soon@1", 0, "1", "основные средства будущие")], schemas.CLAUSE),
        "mapping": spark.createDataFrame([("a", "1", None, "bp", None, "счёт", "01", None, 90, False)], schemas.MAPPING),
        "config_object": spark.createDataFrame([("bp", "01", "счёт", "Основные"), ("bp", "02", "счёт", "Износ")], schemas.CONFIG_OBJECT),
        "link": spark.createDataFrame([("a", "1", None, "i1", "t", "s", True)], schemas.LINK),
        "standard_relation": spark.createDataFrame([("old", "a", "заменён")], schemas.STANDARD_RELATION),
        "clause_relation": spark.createDataFrame([], schemas.CLAUSE_RELATION),
        "corpus_meta": spark.createDataFrame([(BUILT, "h", BUILT)], schemas.CORPUS_META),
    }
    def indexed(stored, path):
        search.save_index(search.with_validity(stored["clause"], stored["edition"]), path, buckets=3)
        return {"index": search.open_index(spark, path).lookup}

    root = str(tmp_path_factory.mktemp("corpus"))
    publish.publish(spark, t, root, "b1", BUILT, quality.validate, {"index": indexed})
    return requests.load(spark, root)


def test_list_and_warnings(corpus):
    listed = corpus.list_standards([d("2024-06-01")])
    got = {r.id: (r.status, r.mapping_status) for r in listed.collect()}
    assert got == {
        "a": (texts.ACTIVE, texts.MAPPING_DRAFT), "old": (texts.REPEALED, texts.MAPPING_NONE),
        "soon": (texts.NOT_YET, texts.MAPPING_NONE)}
    assert [r.warning for r in corpus.draft_warnings(listed).collect()] == [texts.MSG_UNVERIFIED]
    assert corpus.warnings(d("2024-03-31")).count() == 0
    assert corpus.warnings(d("2024-04-01")).first().warning.startswith("Корпус собран 01.01.2024 (91 дн.")


def test_get_standard(spark, corpus):
    asked = [(0, "a", d("2024-06-01")), (1, "a", d("2022-06-01")), (2, "soon", d("2024-06-01")), (3, "q", d("2024-06-01")), (4, "a", d("2024-06-02"))]
    params = spark.createDataFrame(asked, "request_id int, standard_id string, on_date date")
    summaries, outline = corpus.get_standard(params)
    got = {r.request_id: (r.outcome, r.status, r.mapping_status) for r in summaries.collect()}
    assert got == {
        0: ("found", texts.ACTIVE, texts.MAPPING_DRAFT), 1: ("found", texts.ACTIVE, texts.MAPPING_DRAFT),
        2: ("no_edition", None, None), 3: ("standard_not_found", None, None), 4: ("found", texts.ACTIVE, texts.MAPPING_DRAFT)}
    # Requests for one edition share its outline, by the edition that the summary names.
    assert {r.request_id: r.edition_id for r in summaries.collect()} == {0: "a@2", 1: "a@1", 2: None, 3: None, 4: "a@2"}
    assert sorted((r.edition_id, r.path) for r in outline.collect()) == [("a@1", "1"), ("a@2", "1"), ("a@2", "2")]


def test_search_labels_repealed_standards_and_skips_future_ones(spark, corpus):
    asked = [(0, "основные средства", d("2024-06-01"), [], 10), (1, "основные средства", d("2024-06-01"), ["a"], 10), (2, "нечто", d("2024-06-01"), [], 10)]
    queries = spark.createDataFrame(asked, "query_id int, query string, on_date date, standard_ids array<string>, k int")
    hits, messages = corpus.search_clauses(queries)
    got = {(r.query_id, r.clause_id): (r.status, r.snippet) for r in hits.collect()}
    assert got == {
        (0, "a@2#1"): (texts.ACTIVE, "основные средства и запасы"), (0, "old@1#1"): (texts.REPEALED, "основные средства прежние"),
        (1, "a@2#1"): (texts.ACTIVE, "основные средства и запасы")}
    assert {r.query_id: r.message for r in messages.collect()} == {0: "", 1: "", 2: texts.MSG_NO_HITS}


def test_clause_mapping_object_and_references(spark, corpus):
    clause = spark.createDataFrame([("a", "2", d("2024-06-01"))], "standard_id string, path string, on_date date")
    assert corpus.get_clause(clause).first().text == "аренда"
    asked = spark.createDataFrame([(0, "a", None, "bp"), (1, "old", None, "bp"), (2, "q", None, "bp"), (3, "a", None, "bp")], "request_id int, standard_id string, clause_path string, config string")
    rows, messages = corpus.get_mapping(asked)
    answers = {r.request_id: r.answer_id for r in messages.collect()}
    assert [(r.answer_id, r.presentation, r.rank) for r in rows.collect()] == [(answers[0], "Основные", 1)] and answers[0] == answers[3] != answers[1]
    assert {r.request_id: (r.outcome, r.message, r.error) for r in messages.collect()} == {
        0: ("ok", "", None), 1: ("ok", texts.MSG_NO_MAPPING, None),
        2: ("standard_not_found", None, "Стандарт 'q' отсутствует в корпусе"), 3: ("ok", "", None)}
    refs = spark.createDataFrame([(0, "01", "bp"), (1, "износ", "bp")], "request_id int, object_ref string, config string")
    clauses, outcomes, suggestions = corpus.find_by_object(refs)
    assert {r.request_id: r.outcome for r in outcomes.collect()} == {0: "mapped", 1: "unknown"}
    assert [r.suggestion for r in suggestions.collect()] == ["02"] and clauses.first().standard_title == "Title a"
    links, answered = corpus.get_references(asked.drop("config"))
    assert [r.its_id for r in links.orderBy("request_id").collect()] == ["i1", "i1"]
    assert {r.request_id: (r.outcome, r.message) for r in answered.collect()} == {
        0: ("ok", ""), 1: ("ok", texts.MSG_NO_LINKS), 2: ("standard_not_found", None), 3: ("ok", "")}


def test_registry_lines(corpus):
    lines = [r.line for r in corpus.registry(d("2024-06-01"), d("2024-06-01")).collect()]
    assert lines[0] == "# Реестр стандартов бухгалтерского учета на 01.06.2024" and lines[1] == ""
    assert lines[2].startswith("> Корпус собран") and lines[3] == "" and lines[4:6] == texts.REPORT_HEADER
    assert lines[6] == "| a | ФСБУ | 6/2020 | Title a | от 17.09.2020 № 204н | 01.01.2020 | действует | черновик |"
    assert len(lines) == 9


def small_tables(spark, folder):
    """One customer with three orders of 60 lines each, asked for by two orders of one day and one supplier."""
    rows = {
        "customer": ([(1, "C", 5, "BUILDING", 1.0)], "c_custkey long, c_name string, c_nationkey int, c_mktsegment string, c_acctbal double"),
        "orders": (
            [(1, 1, d("1995-01-01"), "O", "1-URGENT"), (2, 1, d("1996-01-01"), "O", "1-URGENT"), (3, 1, d("1996-01-01"), "O", "1-URGENT")],
            "o_orderkey long, o_custkey long, o_orderdate date, o_orderstatus string, o_orderpriority string"),
        "lineitem": (
            [(o, n, n, 7, 1.0, "A", "F", 0.0, 0.1) for o in (1, 2, 3) for n in range(1, 61)],
            "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_returnflag string, l_linestatus string, l_discount double, l_tax double"),
        "supplier": ([(7, 1.0, 5)], "s_suppkey long, s_acctbal double, s_nationkey int"),
        "part": ([(1, "Brand#1", "T", "a b")], "p_partkey long, p_brand string, p_type string, p_name string"),
        "documents": ([(1, "t", "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars int"),
        "labels": ([(1, 1)], "doc_id long, quality int"),
    }
    for name, (data, schema) in rows.items():
        spark.createDataFrame(data, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_search_clauses_answers_every_supplier_to_the_limit(spark, tmp_path):
    got = entry.queries()["search_clauses"](spark, small_tables(spark, tmp_path)).groupBy("query_id").count().collect()
    assert [(r.query_id, r["count"]) for r in got] == [(7, texts.MAX_HITS)]


def test_every_request_gets_its_outline(spark, tmp_path):
    got = entry.queries()["get_standard_outline"](spark, small_tables(spark, tmp_path))
    assert got.columns == ["request_id", "on_date", "standard_id", "edition_id", "pos", "path", "heading"]
    counted = {(r.request_id, r.edition_id): r["count"] for r in got.groupBy("request_id", "edition_id").count().collect()}
    # Two requests for one edition have an outline each.
    assert counted == {(1, "c1@1"): 60, (2, "c1@2"): 60, (3, "c1@2"): 60}


def test_search_clauses_shows_the_clauses_that_were_indexed(spark, tmp_path):
    found = entry.queries()["search_clauses"](spark, small_tables(spark, tmp_path))
    # They were stored: order lines are not read again for showing them.
    assert "l_linenumber" not in found._jdf.queryExecution().executedPlan().toString()
    assert {r.path for r in found.collect()} <= {str(n) for n in range(1, 61)} and found.count() == texts.MAX_HITS
