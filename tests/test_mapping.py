import random
from datetime import date

import pytest

from lexspan import schemas, texts
from lexspan.operators import mapping


def d(text):
    return date.fromisoformat(text)


def rows_of(spark, rows):
    return spark.createDataFrame(rows, schemas.MAPPING)


def m(std, path, ref, config="bp", edition_from=None, confidence=90, verified=False, kind="счёт"):
    return (std, path, edition_from, config, None, kind, ref, None, confidence, verified)


@pytest.fixture(scope="module")
def base(spark):
    standards = spark.createDataFrame(
        [(s, "ФСБУ", "1/2020", 2020, f"T{s}", d("2020-01-01"), "1н", d("2020-01-01"), None, None, "u") for s in "ab"],
        schemas.STANDARD,
    )
    editions = spark.createDataFrame(
        [("a@1", "a", 1, None, d("2020-01-01")), ("a@2", "a", 2, None, d("2022-01-01")), ("b@1", "b", 1, None, d("2030-01-01"))],
        schemas.EDITION,
    )
    clauses = spark.createDataFrame(
        [(f"{e}#{p}", e[0], e, i, p, None, None, "t") for e, i, p in
         [("a@1", 0, "1"), ("a@1", 1, "2"), ("a@2", 0, "2"), ("b@1", 0, "1")]],
        schemas.CLAUSE,
    )
    catalog = spark.createDataFrame(
        [("bp", "01.01", "счёт", "Основные средства"), ("bp", "01.09", "счёт", "Выбытие"), ("bp", "РегистрА", "регистр", "Регистр А")],
        schemas.CONFIG_OBJECT,
    )
    return standards, editions, clauses, catalog


def forward(spark, base, rows, asked, built="2023-01-01"):
    _, editions, clauses, catalog = base
    params = spark.createDataFrame(asked, "request_id int, standard_id string, clause_path string, config string")
    return mapping.mappings_for(params, rows_of(spark, rows), editions, clauses, catalog, d(built))


def test_gate_and_dropped_clause(spark, base):
    rows = [m("a", "1", "01.01"), m("a", "2", "01.01", edition_from=2), m("a", "2", "X", confidence=95)]
    got = forward(spark, base, rows, [(0, "a", None, "bp")]).orderBy("confidence").collect()
    assert [(r.clause_path, r.object_ref, r.presentation) for r in got] == [("2", "01.01", "Основные средства"), ("2", "X", "X")]
    early = forward(spark, base, rows, [(0, "a", None, "bp"), (1, "a", "2", "bp")], "2021-01-01").collect()
    assert sorted((r.request_id, r.clause_path, r.object_ref) for r in early) == [(0, "1", "01.01"), (0, "2", "X"), (1, "2", "X")]


def test_nothing_in_force_is_empty(spark, base):
    assert forward(spark, base, [m("b", "1", "01.01")], [(0, "b", None, "bp")]).count() == 0


def test_messages(spark, base):
    asked = [(0, "a", None, "bp"), (1, "a", None, "erp"), (2, "b", None, "bp")]
    rows = [m("a", "2", "01.01")]
    hits = forward(spark, base, rows, asked)
    params = spark.createDataFrame(asked, "request_id int, standard_id string, clause_path string, config string")
    got = {r.request_id: r for r in mapping.mapping_message(params, hits, base[3]).collect()}
    assert got[0].message == "" and got[0].unverified
    assert got[1].message == "Конфигурация 'erp' серверу неизвестна. Известные конфигурации: bp."
    assert got[2].message == texts.MSG_NO_MAPPING


def test_status_folds_to_draft_or_verified(spark, base):
    standards, editions, clauses, _ = base
    rows = rows_of(spark, [m("a", "1", "01.01", verified=True), m("a", "2", "01.01", edition_from=2)])
    days = [d("2019-01-01"), d("2021-01-01"), d("2023-01-01")]
    got = mapping.mapping_status(rows, editions, clauses, standards, days).where("standard_id = 'a'").orderBy("on_date")
    assert [r.mapping_status for r in got.collect()] == [texts.MAPPING_NONE, texts.MAPPING_VERIFIED, texts.MAPPING_DRAFT]


def reverse(spark, base, rows, asked, built="2023-01-01"):
    standards, editions, clauses, catalog = base
    params = spark.createDataFrame(asked, "request_id int, object_ref string, config string")
    hits = mapping.clauses_by_object(params, rows_of(spark, rows), editions, clauses, standards, catalog, d(built))
    answers, suggestions = mapping.classify_objects(params, hits, catalog)
    return hits, {r.request_id: r for r in answers.collect()}, suggestions.orderBy("request_id", "rank").collect()


def test_reverse_outcomes(spark, base):
    asked = [(0, "регистра", "bp"), (1, "01.09", "bp"), (2, "01.0", "bp"), (3, "%", "bp"), (4, "01.01", "erp"), (5, "ОСНОВНЫЕ", "bp")]
    rows = [m("a", "2", "РегистрА", kind="регистр"), m("a", "2", "РегистрА", kind="регистр"), m("a", "1", "01.09")]
    hits, got, suggestions = reverse(spark, base, rows, asked)
    assert [got[i].outcome for i in range(6)] == ["mapped", "known_no_mapping", "unknown", "unknown", "unknown_config", "unknown"]
    assert got[0].clauses == 1 and hits.first().presentation == "Регистр А"
    assert [(r.request_id, r.suggestion) for r in suggestions] == [(2, "01.01"), (2, "01.09"), (5, "01.01")]
    assert got[2].message == texts.MSG_OBJECT_SUGGESTED and got[3].message == texts.MSG_OBJECT_UNKNOWN


def test_suggestions_agree_with_brute_force(spark):
    rnd = random.Random(3)

    def word(low, high):
        return "".join(rnd.choice("абВ%_1") for _ in range(rnd.randint(low, high)))

    catalog = sorted({("one" if rnd.random() < 0.7 else "two", word(2, 9)) for _ in range(250)})
    objects = [(c, r, "счёт", word(0, 8)) for c, r in catalog]
    asked = [(i, word(0, 6), rnd.choice(["one", "two", "none"])) for i in range(120)]
    params = spark.createDataFrame(asked, "request_id int, object_ref string, config string")
    table = spark.createDataFrame(objects, schemas.CONFIG_OBJECT)
    got = {}
    for r in mapping.suggest_objects(params, table).orderBy("request_id", "rank").collect():
        got.setdefault(r.request_id, []).append(r.suggestion)
    for i, fragment, config in asked:
        low = fragment.lower()
        fits = [r for c, r, _, p in objects if c == config and (low in r.lower() or low in p.lower())]
        assert got.get(i, []) == sorted(fits)[:10], (fragment, config)


def test_links_ignore_editions_and_paths_are_checked(spark, base):
    standards, editions, clauses, _ = base
    links = spark.createDataFrame(
        [("a", "2", None, "i2", "t", "s", False), ("a", "9", None, "i9", "t", "s", True)], schemas.LINK
    )
    asked = [(0, "a", None), (1, "a", "2"), (2, "a", "1"), (3, "q", None), (4, "b", "1")]
    params = spark.createDataFrame(asked, "request_id int, standard_id string, clause_path string")
    got = sorted((r.request_id, r.its_id) for r in mapping.links_for(params, links).collect())
    assert got == [(0, "i2"), (0, "i9"), (1, "i2")]
    checked = mapping.check_link_path(params, standards, editions, clauses, d("2023-01-01")).collect()
    outcomes = {r.request_id: r.outcome for r in checked}
    assert outcomes == {0: "ok", 1: "ok", 2: "clause_not_found", 3: "standard_not_found", 4: "no_edition"}


def test_verification_warning(spark):
    rows = spark.createDataFrame([(1, True), (1, False), (2, True)], "g int, verified boolean")
    got = {r.g: r.warning for r in mapping.verification_warning(rows, ["g"]).collect()}
    assert got == {1: texts.MSG_UNVERIFIED, 2: None}


def test_a_task_passes_on_no_more_suggestions_than_are_shown(spark):
    objects = spark.range(4000).selectExpr("'bp' as config", "concat('a', lpad(id, 5, '0')) as ref", "'k' as kind", "'label' as presentation").repartition(4)
    params = spark.createDataFrame([(1, "A", "bp"), (2, "a0000", "bp"), (3, "zzz", "bp")], "request_id int, object_ref string, config string")
    found = mapping.suggest_objects(params, objects, 3)
    got = sorted(map(tuple, found.collect()))
    assert got == [(q, r, f"a0000{r - 1}") for q in (1, 2) for r in (1, 2, 3)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    limits = [line for line in plan.split("\n") if "WindowGroupLimit" in line and "Partial" in line]
    assert len(limits) >= 2 and all("frag" in line for line in limits)


def test_longer_fragments_meet_only_rows_that_hold_them(spark, monkeypatch):
    # Of two letters: fragments share any three characters with many rows, and are held by one or none.
    word = "translate(lpad(bin(id), 10, '0'), '01', 'ab')"
    objects = spark.range(200, 600).selectExpr("'bp' as config", f"concat('x', {word}) as ref", "'k' as kind", "'label' as presentation")
    params = spark.range(400).selectExpr("id as request_id", f"upper({word}) as object_ref", "'bp' as config")
    joined = []

    def counted(facts, dim, on, how="left"):
        both = facts.join(dim, on, how)
        joined.append((on, both))
        return both

    monkeypatch.setattr(mapping, "keyed_join", counted)
    got = sorted(map(tuple, mapping.suggest_objects(params, objects).collect()))
    assert got == [(i, 1, "x" + f"{i:010b}".translate({48: "a", 49: "b"})) for i in range(200, 400)]
    assert all(both.count() < 20 * 400 for _, both in joined)


def test_a_row_is_suggested_once_however_often_it_holds_the_fragment(spark):
    objects = [("bp", "abababab", "k", "xabab abab"), ("bp", "b", "k", "yabababy"), ("bp", "c", "k", "aba"), ("bp", "c", "k", "абаБАБ")]
    params = spark.createDataFrame([(1, "ABAB", "bp"), (2, "ababab", "bp"), (3, "ab ab", "bp"), (4, "БАБа", "bp"), (5, "абаб", "bp")], "request_id int, object_ref string, config string")
    got = sorted(map(tuple, mapping.suggest_objects(params, spark.createDataFrame(objects, schemas.CONFIG_OBJECT)).collect()))
    assert got == [(1, 1, "abababab"), (1, 2, "b"), (2, 1, "abababab"), (2, 2, "b"), (3, 1, "abababab"), (4, 1, "c"), (5, 1, "c")]
