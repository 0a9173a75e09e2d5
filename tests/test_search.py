import math
import random
from collections import Counter
from datetime import date

import pytest

from lexspan import texts
from lexspan.operators import search

QUERY = "query_id int, query string, on_date date, standard_ids array<string>, k int"
CLAUSE = "clause_id string, standard_id string, valid_from date, valid_to date, heading string, text string"
DAY = date(2024, 1, 1)


def clauses(spark, rows):
    return spark.createDataFrame([(i, s, a, b, None, t) for i, s, a, b, t in rows], CLAUSE)


def index(spark, rows, lemmas=None):
    return search.build_index(clauses(spark, rows), lemmas)


def saved(spark, rows, path, buckets=5, lemmas=None):
    search.save_index(clauses(spark, rows), str(path), lemmas, buckets)
    return search.open_index(spark, str(path))


def ask(spark, rows):
    return spark.createDataFrame(rows, QUERY)


def model(docs, query, on_date, ids, k):
    """All of BM25 in plain Python: AND first, OR if AND finds nothing in force."""
    bags = {i: Counter(t.split()) for i, _, _, _, t in docs}
    n = len(docs)
    avgdl = sum(sum(b.values()) for b in bags.values()) / n
    wanted = Counter(query.split())
    live = {i for i, s, a, b, _ in docs if a <= on_date and (b is None or on_date < b) and (not ids or s in ids)}

    def score(bag):
        total = 0.0
        for term, times in wanted.items():
            df = sum(1 for b in bags.values() if term in b)
            tf = bag[term]
            if tf:
                idf = math.log((n - df + 0.5) / (df + 0.5))
                idf = idf if idf > 0 else 1e-6
                total += times * idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * sum(bag.values()) / avgdl))
        return total

    full = [i for i in live if all(t in bags[i] for t in wanted)]
    some = full or [i for i in live if any(t in bags[i] for t in wanted)]
    return sorted(((round(-score(bags[i]), 9), i) for i in some))[: min(k, 50)]


def test_scores_equal_the_probed_values(spark):
    docs = ["основной средство стоимость", "основной основной актив баланс отчет", "актив стоимость", "актив доход", "займ счёт май"]
    built = index(spark, [(str(i), "s", None, None, t) for i, t in enumerate(docs)])
    queries = ask(spark, [(1, "основной", DAY, [], 10), (2, "основной основной", DAY, [], 10), (3, "актив", DAY, [], 10)])
    got = {(r.query_id, r.clause_id): r.score for r in search.bm25(queries, built).collect()}
    assert got[1, "0"] == pytest.approx(0.3364722366, abs=1e-9)
    assert got[1, "1"] == pytest.approx(0.3895994319, abs=1e-9)
    assert got[2, "1"] == pytest.approx(2 * got[1, "1"], abs=1e-9)
    assert 0 < got[3, "3"] < 1e-5


@pytest.mark.parametrize("seed", [1, 2])
def test_search_agrees_with_the_plain_model(spark, tmp_path, seed):
    rnd = random.Random(seed)
    words = ["w%d" % i for i in range(14)]
    weights = [60, 40, 30, 20, 10, 8, 6, 5, 4, 3, 2, 2, 1, 1]
    clean = [w.replace("w", "слово") .translate(str.maketrans("0123456789", "абвгдежзик")) for w in words]
    docs = []
    for i in range(160):
        start = date(2020 + rnd.randrange(5), 1, 1)
        end = rnd.choice([None, date(2024, 6, 1), date(2025, 1, 1)])
        text = " ".join(rnd.choices(clean, weights, k=rnd.randint(1, 9)))
        docs.append((f"d{i:03d}", f"s{rnd.randrange(3)}", start, end, text))
    asked = []
    for q in range(60):
        ids = rnd.choice([[], [], ["s1"], ["s0", "s2"]])
        text = " ".join(rnd.choices([*clean, "нет"], k=rnd.randint(1, 5)))
        asked.append((q, text, date(rnd.choice([2021, 2024]), 3, 1), ids, rnd.choice([1, 3, 10, 60])))
    built = index(spark, docs)
    for one in (built, saved(spark, docs, tmp_path / "index")):
        got = {}
        for r in search.search(ask(spark, asked), one).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append((round(-r.score, 9), r.clause_id))
        for q, text, day, ids, k in asked:
            want = model(docs, text, day, ids, k)
            assert [i for _, i in got.get(q, [])] == [i for _, i in want], (text, day, ids, k)
            for (a, _), (b, _) in zip(got.get(q, []), want):
                assert a == pytest.approx(b, abs=1e-8)


def test_all_terms_win_over_any_term_only_in_force(spark):
    old = date(2020, 1, 1)
    docs = [("full", "s", old, date(2021, 1, 1), "альфа бета"), ("half", "s", old, None, "альфа гамма"), ("none", "s", old, None, "дельта")]
    built = index(spark, docs)
    queries = ask(spark, [(1, "альфа бета", date(2020, 6, 1), [], 10), (2, "альфа бета", DAY, [], 10), (3, "", DAY, [], 10), (4, "альфа", DAY, [], 0)])
    got = sorted((r.query_id, r.clause_id) for r in search.search(queries, built).collect())
    assert got == [(1, "full"), (2, "half")]
    messages = {r.query_id: (r.message, r.error) for r in search.search_messages(queries, search.search(queries, built)).collect()}
    assert messages == {1: ("", None), 2: ("", None), 3: (texts.MSG_NO_HITS, None), 4: (None, texts.MSG_BAD_LIMIT)}


def test_tokens_lemmas_and_stop_words(spark):
    lemmas = spark.createDataFrame(
        [("основных", "основный"), ("средств", "средство"), ("чём", "что"), ("фсбу", "фсб")], "form string, lemma string"
    )
    df = spark.createDataFrame([(1, "ФСБУ 6/2020: Основных средств, чём ли АБВ12")], "id int, text string")
    got = [r.term for r in search.terms(df, "text", ["id"], lemmas).orderBy("pos").collect()]
    assert got == ["фсбу", "6", "2020", "основный", "средство", "абв", "12"]
    built = index(spark, [("x", "s", None, None, "основных средств ли"), ("y", "s", None, None, "иное")], lemmas)
    found = search.search(ask(spark, [(1, "средств", DAY, [], 5)]), built, lemmas).collect()
    assert [r.clause_id for r in found] == ["x"]
    assert built.postings.where("clause_id = 'x'").first().dl == 2


def scans(df):
    """(table, rows out) of the file scans of an executed plan, and the number of shuffles above each."""
    plan = df._jdf.queryExecution().executedPlan()
    found = []

    def walk(node, shuffles):
        name = node.nodeName()
        if "Exchange" in name and "Broadcast" not in name:
            shuffles += 1
        if name.startswith("Scan"):
            found.append((name, node.metrics().apply("numOutputRows").value(), shuffles))
        children = [node.executedPlan()] if name.startswith("AdaptiveSparkPlan") else [node.plan()] if name.endswith("QueryStage") else []
        kids = node.children()
        for child in children or [kids.apply(i) for i in range(kids.size())]:
            walk(child, shuffles)

    walk(plan, 0)
    return found


def test_postings_are_not_shuffled_and_closed_eras_and_other_shards_not_read(spark, tmp_path):
    docs = [(f"d{i:04d}", f"s{i % 40}", date(2010 + i % 10, 1, 1), None if i % 10 == 9 else date(2011 + i % 10, 1, 1), "альфа слово%s" % "абвгд"[i // 10 % 5]) for i in range(2000)]
    built = saved(spark, docs, tmp_path / "index")
    # No broadcast: what is not bucketed has to be shuffled.
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        def read(day, ids):
            asked = ask(spark, [(1, "словоа", day, ids, 5)])
            limits = asked.select("query_id", "on_date", "standard_ids")
            leading = search.weighted(search.query_terms(asked), built).join(limits, "query_id")
            found = search.candidates(built, leading, limits)
            hits = found.collect()
            rows = [(n, shuffles) for where, n, shuffles in scans(found) if "_postings" in where]
            # Above the postings only the removal of repeated candidates shuffles.
            assert len(rows) == 1 and rows[0][1] <= 1
            return {r.clause_id for r in hits}, rows[0][0]

        early, every = read(date(2010, 6, 1), [])
        late, few = read(date(2030, 1, 1), [])
        only, fewest = read(date(2030, 1, 1), ["s9"])
        assert early == {d[0] for d in docs if d[2] == date(2010, 1, 1) and d[4].endswith("а")}
        assert late == {d[0] for d in docs if d[3] is None and d[4].endswith("а")} and only == {d for d in late if int(d[1:]) % 40 == 9}
        assert every == 4000 and few == 400 and 0 < fewest < few
        assert "Exchange" not in built.lookup.join(built.lookup.select("clause_id", "term"), ["clause_id", "term"])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_saved_index_opens_in_another_session_and_deals_out_hot_terms(spark, tmp_path):
    docs = [(f"d{i:03d}", "s", None, None, f"общее слово{'абвгдежз'[i % 8]}") for i in range(400)]
    one = saved(spark, docs, tmp_path / "index", buckets=4)
    salts = {r.term: r.salts for r in one.term_df.collect()}
    assert salts["общее"] == 2 and salts["словоа"] == 1 and {r.salt for r in one.postings.where("term = 'общее'").collect()} == {0, 1}
    other = search.open_index(spark.newSession(), str(tmp_path / "index"))
    assert sorted(map(tuple, other.postings.collect())) == sorted(map(tuple, one.postings.collect()))
    hits = search.search(ask(spark, [(1, "общее словоб", DAY, [], 50), (2, "общее", DAY, [], 3)]), one).collect()
    assert len([r for r in hits if r.query_id == 1]) == 50 and [r.clause_id for r in hits if r.query_id == 2] == ["d000", "d001", "d002"]


def test_relevance_gate_names_the_failing_group(spark):
    golden = spark.createDataFrame(
        [(k, "a", "good", False) for k in range(9)] + [(9, "a", "bad", False), (10, "b", "bad", False), (11, "c", "far", True)],
        "query_id int, expect_id string, expect_group string, lexical_limitation boolean",
    )
    top = [(k, 1, "a") for k in range(10)]

    def gate(rows):
        hits = spark.createDataFrame(rows, "query_id int, rank int, clause_id string")
        found = search.relevance_gate(search.judge(golden, hits), 0.95).collect()
        return {r.expect_group: (r.hits, r.misses, r.passed) for r in found}

    assert gate(top) == {"good": (9, 0, False), "bad": (1, 1, False)}
    assert gate([*top, (10, 3, "b")]) == {"good": (9, 0, True), "bad": (2, 0, True)}
    assert not any(passed for _, _, passed in gate([*top, (10, 3, "b"), (11, 1, "c")]).values())


def test_evaluation(spark):
    golden = spark.createDataFrame(
        [(1, "a", "g", False), (2, "b", "g", False), (3, "c", "h", True), (4, "d", "h", False)],
        "query_id int, expect_id string, expect_group string, lexical_limitation boolean",
    )
    hits = spark.createDataFrame([(1, 3, "a"), (2, 4, "b"), (3, 1, "c")], "query_id int, rank int, clause_id string")
    judged = search.judge(golden, hits)
    rate = search.hit_rate(judged).first()
    assert (rate.queries, rate.hits) == (3, 1) and rate.rate == pytest.approx(1 / 3)
    assert {(r.expect_group, r.misses) for r in search.misses(judged).collect()} == {("g", 1), ("h", 1)}
    assert [r.query_id for r in search.unexpectedly_passing(judged).collect()] == [3]


def test_a_common_term_adds_only_its_champions_and_clauses_are_counted_once(spark, tmp_path, monkeypatch):
    docs = [(f"d{i:03d}", f"s{i % 3}", date(2020, 1, 1), None, f"общее слово{'абвгдежз'[i % 8]}" + " мимо" * (i % 5)) for i in range(240)]
    stored, keep = [], search.written
    monkeypatch.setattr(search, "written", lambda df, name: stored.append(name) or keep(df, name))
    one = saved(spark, docs, tmp_path / "index", buckets=3)
    assert stored == ["index-counts"]
    asked = [(q, f"общее нет слово{'абвгдежз'[q % 8]}", DAY, ["s1"] if q % 5 == 0 else [], 40) for q in range(20)]
    queries = ask(spark, asked)
    limits = queries.select("query_id", "on_date", "standard_ids")
    common = search.weighted(search.query_terms(queries), one).where("term = 'общее'").join(limits, "query_id")
    found = search.champions(one, common, limits)
    assert {r["count"] for r in found.groupBy("query_id").count().collect()} == {texts.MAX_HITS}
    got = {}
    for r in search.search(queries, one).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.clause_id)
    for q, text, day, ids, k in asked:
        assert got[q] == [i for _, i in model(docs, text, day, ids, k)]


def test_all_scores_are_summed_where_the_clauses_terms_are(spark):
    docs = [(f"d{i:02d}", "s", None, None, f"общее слово{'абвг'[i % 4]}") for i in range(20)]
    scores = search.bm25(ask(spark, [(1, "общее словоб", DAY, [], 10)]), index(spark, docs))
    assert {(r.clause_id, r.matched) for r in scores.collect()} == {(d[0], 1 + d[4].endswith("б")) for d in docs}
    # Clauses are shuffled once, by clause; neither their terms nor the matching ones are.
    plan = scores._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(term" not in plan and "hashpartitioning(query_id" not in plan


def test_tokens_are_found_behind_the_shuffle_only(spark):
    lemmas = spark.createDataFrame([("основных", "основный")], "form string, lemma string")
    rows = clauses(spark, [("x", "s", None, None, "основных средств"), ("y", "s", None, None, None)])
    for known in (None, lemmas):
        counted = search._counted(rows, known)
        below = counted._jdf.queryExecution().optimizedPlan().toString().split("RepartitionByExpression")[1]
        assert "regexp_extract_all" not in below
        assert {(r.clause_id, r.term) for r in counted.collect()} >= {("x", None), ("x", "средств"), ("y", None)}


def test_passages_meet_documents_without_a_shuffle_of_words_or_texts(spark, tmp_path):
    from lexspan.plans import queries
    from lexspan.plans.binding import Binding

    docs = [(1, "alpha beta gamma delta", "en", "web"), (2, "alpha beta gamma omega", "fr", "book"), (10, "beta gamma", "en", "web"), (3, None, "en", "web")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    asked = [(1, "lpha beta gam"), (2, "beta gamma"), (3, "nowhere beta else"), (4, "a beta gamma del")]
    spark.createDataFrame(asked, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    found = queries._golden(Binding(spark, str(tmp_path)))
    assert "SortMergeJoin" not in found._jdf.queryExecution().executedPlan().toString()
    got = {r.query_id: (r.expect_id, r.lexical_limitation, r.expect_group) for r in found.collect()}
    assert got == {1: ("1", True, "book"), 2: ("1", True, "book"), 4: ("1", False, "web")}


def test_terms_of_a_large_part_of_all_clauses_are_stored_once(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(search, "DENSE_ROWS", 0)
    docs = [
        (f"d{i:03d}", f"s{i % 3}", date(2020 + i % 2, 1, 1), date(2022, 1, 1) if i % 5 == 0 else None, f"общее часть слово{'абвгдежзиклмнопрсту'[i % 19]}" + " мимо" * (i % 4))
        for i in range(190)
    ]
    one = saved(spark, docs, tmp_path / "index", buckets=3)
    assert {r.term for r in one.term_df.where("dense").collect()} == {"общее", "часть", "мимо"}
    for table in (one.postings, one.lookup):
        assert table.count() == 190 and table.where("term IN ('общее', 'часть', 'мимо')").count() == 0
    assert one.counts.where("term = 'общее'").count() == 190 and one.stats.first().n == 190
    texts_asked = ["общее словоа", "нет общее словоб", "мимо часть", "нет мимо", "общее", "словов мимо мимо"]
    asked = [(q, t, day, ids, k) for q, (t, day, ids, k) in enumerate((t, day, ids, k) for t in texts_asked for day in (date(2020, 3, 1), DAY) for ids in ([], ["s1"]) for k in (4, 60))]
    got = {}
    for r in search.search(ask(spark, asked), one).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((round(-r.score, 9), r.clause_id))
    for q, text, day, ids, k in asked:
        want = model(docs, text, day, ids, k)
        assert [i for _, i in got.get(q, [])] == [i for _, i in want], (text, day, ids, k)
        for (a, _), (b, _) in zip(got.get(q, []), want):
            assert a == pytest.approx(b, abs=1e-8)
    everything = {(r.query_id, r.clause_id): r.matched for r in search.bm25(ask(spark, [(1, "общее словоа", DAY, [], 5)]), one).collect()}
    assert everything == {(1, d[0]): 1 + ("словоа" in d[4]) for d in docs}
    # Counts meet what is found where they lie.
    found = spark.createDataFrame([(1, "d000", "s0"), (1, "d002", "s2")], "query_id int, clause_id string, standard_id string")
    words = spark.createDataFrame([(1, 2, "общее", 1.0), (1, 2, "мимо", 2.0)], "query_id int, n_terms int, term string, weight double")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        parts = search._dense_parts(one, found, words)
        assert sorted((r.clause_id, r.weight, r.tf) for r in parts.collect()) == [("d000", 1.0, 1), ("d002", 1.0, 1), ("d002", 2.0, 2)]
        assert [shuffles for where, _, shuffles in scans(parts) if "_counts" in where] == [0]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
