import json
from datetime import date

import pytest
from pyspark.sql import functions as F

from lexspan import schemas, texts
from lexspan.functions import columns as C
from lexspan.sources import documents, publish, registry

DAY = date(2020, 1, 1)


def doc(i, editions):
    return {
        "id": i, "kind": "ФСБУ", "number": "1/2020", "year": 2020, "title": "T", "order_date": "2020-01-01",
        "order_no": "1н", "effective_from": "2020-01-01", "effective_to": None, "superseded_by": None,
        "source_url": "u", "editions": editions,
    }


def edition(no, *paths):
    clauses = [{"path": p, "parent_path": None, "heading": None, "text": f"t{p}"} for p in paths]
    return {"edition_no": no, "amending_order": None, "effective_from": f"202{no}-01-01", "clauses": clauses}


def test_documents_are_read_flattened_and_written_back(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(doc("a", [edition(1, "2", "1"), edition(2, "1")])), encoding="utf-8")
    (tmp_path / "b.json").write_text(json.dumps(doc("b", []), indent=1), encoding="utf-8")
    docs = documents.read_documents(spark, str(tmp_path))
    std, ed, cl = documents.flatten_documents(docs)
    assert sorted(r.id for r in std.collect()) == ["a", "b"]
    assert sorted(r.id for r in ed.collect()) == ["a@1", "a@2"]
    got = [(r.id, r.pos, r.text) for r in cl.orderBy("id").collect()]
    assert got == [("a@1#1", 1, "t1"), ("a@1#2", 0, "t2"), ("a@2#1", 0, "t1")]
    for size in (1, 500):
        nested = documents.nest_documents(std, ed, cl, span=size)
        assert nested.count() == (4 if size == 1 else 3)
        again = nested.select(F.from_json("document", schemas.DOCUMENT).alias("d")).select("d.*")
        std2, ed2, cl2 = documents.flatten_documents(again)
        assert sorted(map(str, std2.collect())) == sorted(map(str, std.collect()))
        assert sorted(map(tuple, cl2.collect())) == sorted(map(tuple, cl.collect()))
        assert sorted(map(tuple, ed2.collect())) == sorted(map(tuple, ed.collect()))


def test_ids_declared_twice_name_both_files(spark, tmp_path):
    for name, i in (("a", "x"), ("b", "x"), ("c", "y")):
        (tmp_path / f"{name}.json").write_text(json.dumps(doc(i, [])), encoding="utf-8")
    got = documents.duplicate_sources(documents.read_documents(spark, str(tmp_path))).collect()
    assert sorted((r.id, r.source_file[-6:], r.files) for r in got) == [("x", "a.json", 2), ("x", "b.json", 2)]


def test_bad_documents_are_listed(spark, tmp_path):
    no_number = {**edition(1, "1"), "edition_no": None}
    bad = [doc("ok", [edition(1, "1")]), doc("dup", [edition(1, "1", "1")]), doc(None, []), doc("n", [no_number]), doc("p", [edition(1, None)])]
    (tmp_path / "x.json").write_text(json.dumps(bad), encoding="utf-8")
    got = documents.document_errors(documents.read_documents(spark, str(tmp_path))).collect()
    assert {(r.id, r.error) for r in got} == {
        ("dup", "duplicate clause path"), (None, "missing id"), ("n", "edition without edition_no"), ("p", "clause without path")}


def test_edges_with_an_unknown_end_are_skipped(spark):
    std = spark.createDataFrame([("a",), ("b",)], "id string")
    edges = spark.createDataFrame([("a", "b", "аналог"), ("a", "q", "аналог"), ("q", "a", "аналог")], schemas.STANDARD_RELATION)
    kept, skipped = documents.valid_edges(edges, std)
    assert [tuple(r) for r in kept.collect()] == [("a", "b", "аналог")] and skipped.count() == 2


def test_catalogue_keeps_configs_with_mappings(spark):
    objects = spark.createDataFrame([("bp", "1"), ("bp", "1"), ("erp", "2")], "config string, ref string")
    kept, repeated = documents.load_catalog(objects, spark.createDataFrame([("bp",)], "config string"))
    assert [tuple(r) for r in kept.collect()] == [("bp", "1")] and [tuple(r) for r in repeated.collect()] == [("bp", "1", 2)]


def test_mapping_and_link_rules(spark):
    clauses = spark.createDataFrame([("c", "a", "e", 0, "1", None, None, "t")], schemas.CLAUSE)
    catalog = spark.createDataFrame([("bp", "01", "счёт", "x")], schemas.CONFIG_OBJECT)

    def row(path="1", kind="счёт", ref="01", confidence=60):
        return ("a", path, None, "bp", None, kind, ref, None, confidence, False)

    rows = [row(), row(path="1.заключение"), row(path="999"), row(ref="09"), row(kind="регистр"), row(confidence=59)]
    got = documents.check_mappings(spark.createDataFrame(rows, schemas.MAPPING), clauses, catalog).collect()
    assert sorted(r.violation for r in got) == ["kind differs", "low confidence", "unknown object", "unknown path", "unstable path"]
    links = [("a", "1", None, "i", "t", "s" * 400, False), ("a", "2", None, "i", "t", "s" * 401, False)]
    got = documents.check_links(spark.createDataFrame(links, schemas.LINK), clauses).collect()
    assert sorted(r.violation for r in got) == ["summary too long", "unknown path"]


REGISTRY = """<table><tr><th>a</th><th>b</th><th>c</th></tr>
<tr><td>1</td><td><a href="/ru/document?id_4=133537">ФСБУ 6/2020 &laquo;Основные средства&raquo;</a></td>
<td><a href="/x">Приказ от 17.09.2020</a> № 204н,</td><td>С отчетности за 2022 г.</td></tr>
<tr><td>2</td><td><a href='http://h/d'>ПБУ 9/99 "Доходы"</a></td><td>06.05.1999 № 32н</td>
<td>С отчетности за 2000 г. Утрачивает силу с 01.01.2027 г.</td></tr>
<tr><td>3</td><td><a href="d?1">ПБУ 16/02 «Информация»</a></td><td>02.07.2002 № 66н</td><td>с 1 Января 2003 года</td></tr>
<tr><td>ФСБУ 1/2020 «Мало ячеек»</td><td>01.01.2020 № 1</td></tr>
<tr><td>4</td><td>ФСБУ 2/2020 «Без приказа»</td><td>нет</td></tr>
<tr><td>5</td><td>ФСБУ 3/2020 «Без ссылки»</td><td>01.01.2020 № 1н</td><td>когда-нибудь</td></tr></table>"""


def test_registry_page(spark):
    df = spark.createDataFrame([("src", REGISTRY)], "source_url string, html string")
    got = {r.id: r for r in registry.parse_registry(df).collect()}
    assert set(got) == {"fsbu-6-2020", "pbu-9-99", "pbu-16-02", "fsbu-3-2020"}
    first = got["fsbu-6-2020"]
    assert (first.title, first.order_no, first.order_date) == ("Основные средства", "204н", date(2020, 9, 17))
    assert (first.effective_from, first.effective_to, first.year) == (date(2022, 1, 1), None, 2020)
    assert first.document_url == "https://minfin.gov.ru/ru/document?id_4=133537" and first.error is None
    old = got["pbu-9-99"]
    assert (old.effective_from, old.effective_to, old.year, old.document_url) == (DAY.replace(year=2000), date(2027, 1, 1), 1999, "http://h/d")
    assert (got["pbu-16-02"].year, got["pbu-16-02"].effective_from) == (2002, date(2003, 1, 1))
    assert got["pbu-16-02"].document_url == "https://minfin.gov.ru/d?1"
    assert got["fsbu-3-2020"].error == "no effective date; no document link"


def test_acts_of_every_shape(spark):
    payloads = [
        '{"items":[{"eoNumber":"1","complexName":"A"}, 7, {"eoNumber":"2"}]}', '[{"EoNumber":3,"Name":"C"}]',
        '{"items":[{"eoNumber":"","EoNumber":"4","complexName":"","name":"D"}]}', "{broken", '{"items":5}', "[]", "null",
    ]
    df = spark.createDataFrame([(p,) for p in payloads], "payload string")
    got = sorted((r.eo_number, r.title) for r in registry.parse_acts(df).collect())
    assert got == [("1", "A"), ("3", "C"), ("4", "D")]
    assert registry.parse_acts(df).first().pdf_url == "http://publication.pravo.gov.ru/file/pdf?eoNumber=1"


def test_search_url(spark):
    df = spark.createDataFrame([(date(2020, 9, 17), "204н")], "order_date date, order_no string")
    assert registry.search_urls(df).first().url == (
        "http://publication.pravo.gov.ru/api/Documents?Number=204%D0%BD&NumberSearchType=0"
        "&DocumentDateFrom=17.09.2020&DocumentDateTo=17.09.2020&PageSize=30&Index=1")


@pytest.mark.parametrize(
    "text, start, end",
    [
        ("с 01.04.2025 г.", date(2025, 4, 1), None),
        ("С 1 января 2022 г.", date(2022, 1, 1), None),
        ("За 2009 г. УТРАЧИВАЕТ СИЛУ с 01.01.2027 г.", date(2009, 1, 1), date(2027, 1, 1)),
        ("31.02.2020 за 2021 г.", None, None),
        ("неизвестно", None, None),
    ],
)
def test_dates_in_cells(spark, text, start, end):
    df = spark.createDataFrame([(text,)], "t string")
    got = df.select(C.parse_effective_from(df.t).alias("a"), C.parse_effective_to(df.t).alias("b")).first()
    assert (got.a, got.b) == (start, end)


def test_literal_and_case_insensitive_matching(spark):
    df = spark.createDataFrame([("РегистрСведений", "регистр", "%")], "a string, b string, c string")
    got = df.select(C.contains_ci(df.a, df.b), C.contains_ci(df.a, df.c), C.eq_ci(df.b, F.lit("РЕГИСТР"))).first()
    assert tuple(got) == (True, False, True)


# --- publishing ---------------------------------------------------------------------------------


def test_publish_is_all_or_nothing(spark, tmp_path):
    root, good = str(tmp_path), spark.createDataFrame([(1, "x")], "id int, text string")

    def checks(t):
        bad = t["clause"].where("text = ''")
        return bad.select(F.lit("blank").alias("check"), F.col("id").cast("string").alias("offender"), F.lit("").alias("detail"))

    publish.publish(spark, {"clause": good}, root, "b1", DAY, checks)
    assert publish.latest(spark, root).build_id == "b1"
    with pytest.raises(publish.PublishError, match="blank: 2"):
        publish.publish(spark, {"clause": spark.createDataFrame([(2, "")], good.schema)}, root, "b2", DAY, checks)
    assert publish.latest(spark, root).build_id == "b1" and len(list((tmp_path / "builds").iterdir())) == 1
    with pytest.raises(publish.PublishError, match="exists"):
        publish.publish(spark, {"clause": good}, root, "b1", DAY, checks)
    assert publish.latest(spark, root).table(spark, "clause").count() == 1
    publish.publish(spark, {"clause": good.unionAll(good)}, root, "b2", DAY, checks)
    newest = publish.latest(spark, root)
    assert (newest.build_id, newest.built_at, newest.tables) == ("b2", DAY, ("clause",))
    assert newest.table(spark, "clause").count() == 2


def test_bad_documents_are_set_aside_and_the_others_taken(spark, tmp_path):
    (tmp_path / "good.json").write_text(json.dumps(doc("a", [edition(1, "1", "2")]), indent=1), encoding="utf-8")
    (tmp_path / "cut.json").write_text(json.dumps(doc("b", [edition(1, "1")]))[:-7], encoding="utf-8")
    (tmp_path / "kind.json").write_text(json.dumps(doc("c", [edition(1, "1")]) | {"year": "soon"}), encoding="utf-8")
    (tmp_path / "empty.json").write_text("", encoding="utf-8")
    bad = [edition(1, "1", "1"), edition(2, "1", None), {**edition(3, "1"), "edition_no": None}]
    (tmp_path / "bad.json").write_text(json.dumps(doc(None, bad)), encoding="utf-8")
    good, quarantine = documents.isolate(documents.read_documents(spark, str(tmp_path)))
    assert [r.id for r in documents.flatten_documents(good)[2].orderBy("id").collect()] == ["a@1#1", "a@1#2"]
    found = {(r.source_file.rsplit("/", 1)[1], r.error) for r in quarantine.collect()}
    assert {f for f in found if f[0] != "empty.json"} == {
        ("cut.json", "unreadable document"), ("kind.json", "unreadable document"), ("bad.json", "missing id"),
        ("bad.json", "duplicate clause path"), ("bad.json", "clause without path"), ("bad.json", "edition without edition_no")}
    records = spark.createDataFrame([("x", None), ("y", "[1, 2"), ("z", json.dumps(doc("z", [])))], "source_file string, document string")
    good, quarantine = documents.isolate(documents.parse_documents(records))
    assert [r.id for r in good.collect()] == ["z"]
    assert sorted((r.source_file, r.error) for r in quarantine.collect()) == [("x", "unreadable document"), ("y", "unreadable document")]


def test_of_two_builds_under_one_id_one_is_announced(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor
    from threading import Barrier

    root, together = str(tmp_path), Barrier(4)

    def checks(t):
        together.wait(60)
        return t["clause"].where("id < 0").selectExpr("'c' as check", "'o' as offender", "'' as detail")

    def build(k):
        try:
            return publish.publish(spark, {"clause": spark.range(k + 1)}, root, "b%d" % (k // 3), DAY, checks)
        except publish.PublishError as e:
            return str(e)

    with ThreadPoolExecutor(4) as pool:
        got = list(pool.map(build, range(4)))
    won = [b for b in got if not isinstance(b, str)]
    assert sorted(b.build_id for b in won) == ["b0", "b1"] and got.count("build b0 exists") == 2
    assert sorted(p.name for p in (tmp_path / "manifest").glob("*.json")) == ["000000001.json", "000000002.json"]
    assert {p.name for p in (tmp_path / "builds").iterdir()} == {b.path.rsplit("/", 1)[1] for b in won}
    assert publish.latest(spark, root) in won
    with pytest.raises(publish.PublishError, match="nothing"):
        publish.latest(spark, root + "/none")


def std(spark, rows):
    return spark.createDataFrame(rows, "id string, order_no string, effective_from date, effective_to date")


def test_hashes(spark):
    import hashlib

    df = std(spark, [("b", "2н", DAY, None), ("a", "1н", DAY, None)])
    level = [hashlib.sha256(s.encode()).hexdigest() for s in ("a|1н|2020-01-01", "b|2н|2020-01-01")]
    level = {d[:5]: hashlib.sha256(f"{d}*1".encode()).hexdigest() for d in level}
    for width in range(4, -1, -1):
        merged = {}
        for prefix, d in level.items():
            merged.setdefault(prefix[:width], []).append(d)
        level = {p: hashlib.sha256(",".join(sorted(ds)).encode()).hexdigest() for p, ds in merged.items()}
    assert publish.registry_hash(df).first().registry_hash == level[""]
    many = spark.range(3000).select(F.col("id").cast("string").alias("s"))
    one = publish.corpus_fingerprint(many, F.col("s")).first().fingerprint
    assert one == publish.corpus_fingerprint(many.orderBy(F.rand()), F.col("s")).first().fingerprint
    assert one != publish.corpus_fingerprint(many.where("s != '7'"), F.col("s")).first().fingerprint
    assert one != publish.corpus_fingerprint(many.union(many.where("s = '7'")), F.col("s")).first().fingerprint


def test_diff_and_its_report(spark):
    stored = std(spark, [("a", "1", DAY, None), ("b", "1", DAY, None), ("gone", "1", DAY, None)])
    live = std(spark, [("a", "2", DAY, date(2027, 1, 1)), ("b", "1", DAY, None), ("new", "1", DAY, None)])
    got = {tuple(r) for r in publish.diff_registry(live, stored).collect()}
    assert got == {
        ("added", "new", None, None, None), ("removed", "gone", None, None, None),
        ("changed", "a", "order_no", "1", "2"), ("changed", "a", "effective_to", None, "2027-01-01")}
    lines = [r.line for r in publish.render_diff(publish.diff_registry(live, stored)).collect()]
    assert lines == [
        texts.DIFF_ADDED, "- `new`", texts.DIFF_REMOVED, "- `gone`", texts.DIFF_CHANGED,
        "- `a`: приказ 1 → 2", "- `a`: утрата силы None → 2027-01-01"]
    same = publish.render_diff(publish.diff_registry(stored, stored)).collect()
    assert [r.line for r in same] == [texts.DIFF_NONE]


def test_reproduction_counts_both_sides(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x"), (2, None)], "id int, t string")
    b = spark.createDataFrame([(1, "x"), (2, ""), (3, "z")], "id int, t string")
    got = {(r.id, r.side, r.rows) for r in publish.reproduces(a, b, ["id"]).collect()}
    assert got == {(1, "derived", 1), (2, "derived", 1), (2, "stored", 1), (3, "stored", 1)}
    assert publish.reproduces(a, a, ["id"]).count() == 0
