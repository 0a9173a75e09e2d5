"""Searches, joins, sharding, decontamination, tool calls and the pipeline against brute force."""

import json
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from check import TABLES, rows_of
from lexspan.llm import chosenpath, common, decontaminate, forest, langid, queries, rendezvous, toolcalls

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, _mid string, key string, n int, _dup_n int"
A = "one two three four five six seven eight nine ten eleven twelve"


def rows_with_noise(rows):
    return [(i, t, None, None, None, "x", "y", 1, 2) for i, t in rows]


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_agrees_with_sql(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    cursor = db.execute(queries.ORACLES[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows_of(df.columns, df.collect()) == rows_of(columns, cursor.fetchall())


def test_everything_is_registered():
    known = entry.queries()
    assert all(any(k.startswith(f"op{n}_") for k in known) for n in range(1, 14)) and "pipeline" in known


# Nearest neighbours.


def exact(vectors, asked, k):
    out = []
    for q, x in asked:
        scored = [(-float(np.dot(np.array(x, dtype=float), np.array(y, dtype=float))), v) for v, y in vectors if v != q]
        out += [(q, rank + 1, v) for rank, (_, v) in enumerate(sorted(scored)[:k])]
    return out


def test_nearest_neighbours_recall_and_scores(spark):
    rows = [(r.vec_id, r.embedding) for r in queries.table(spark, SF, "embeddings").collect()]
    mine = queries.op4_nearest_neighbours(spark, SF).collect()
    true = exact(rows, [r for r in rows if r[0] % 20 == 0], 20)
    found, wanted = {(r.query_id, r.vec_id) for r in mine}, {(q, v) for q, _, v in true}
    assert len(mine) == len(true) and len(found & wanted) >= 0.9 * len(wanted)
    vectors = {i: np.array(x, dtype=float) for i, x in rows}
    assert all(abs(r.score - vectors[r.query_id] @ vectors[r.vec_id]) < 1e-12 for r in mine)


def test_nearest_neighbours_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [nan, 1.0]), (6, [inf, 1.0]),
        (7, [None, 1.0]), (None, [1.0, 0.0]), (8, [0.5, 3.0]), (9, [-1.0, 0.0]), (10, []), (20, [0.0, 2.0]),
    ]
    table = spark.createDataFrame([(*r, "x") for r in rows], "id long, vector array<float>, block string")
    mine = forest.search(table, table.where("id % 20 = 0"), 3).collect()
    assert sorted((r.query_id, r.rank, r.vec_id) for r in mine) == [(0, 1, 1), (0, 2, 2), (0, 3, 8), (20, 1, 8), (20, 2, 0), (20, 3, 0)]
    assert forest.search(table.limit(0), table, 3).count() == 0


# Sharding.


def test_sharding_law(spark):
    mine = queries.op8_rendezvous_sharding(spark, SF).collect()
    texts = {r.doc_id: r.text for r in queries.table(spark, SF, "documents").collect()}
    slots = defaultdict(list)
    for r in mine:
        data = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(data) + 1, zlib.crc32(data))
        assert r.grown_shard in (r.shard, 16) and r.law == "key"
        slots[r.shard].append(r.slot)
    assert len(mine) == len(texts) and all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_sharding_weights_nulls_and_repeats(spark):
    table = spark.createDataFrame([(i, "x") for i in range(4000)] + [(None, "x"), (None, None), (5, "y"), (5, "y")], "doc_id long, shard string")
    rows = rendezvous.place(table.select("doc_id"), "doc_id", {0: 1.0, 1: 3.0}, {0: 1.0, 1: 3.0, 2: 1.0}).collect()
    counts = Counter(r.shard for r in rows)
    assert len(rows) == 4004 and 0.7 < counts[1] / len(rows) < 0.8
    assert len({r.shard for r in rows if r.doc_id is None}) == 1 and len({r.shard for r in rows if r.doc_id == 5}) == 1
    assert all(r.grown_shard in (r.shard, 2) for r in rows)
    assert rendezvous.place(table.select("doc_id").limit(0), "doc_id", {0: 1.0}, {0: 1.0, 1: 1.0}).count() == 0
    with pytest.raises(ValueError):
        rendezvous.shard_of(table["doc_id"], {})


# Chosen-path join.


def shingle_set(text):
    words = re.findall(r"[0-9a-z\x80-\U0010FFFF]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def brute_join(rows):
    sets = [shingle_set(t) for _, t in rows]
    near = [[j for j in range(len(rows)) if j != i and sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9] for i in range(len(rows))]
    out = []
    for i in range(len(rows)):
        seen, todo = {i}, [i]
        while todo:
            new = set(near[todo.pop()]) - seen
            seen |= new
            todo += new
        ids = [rows[k][0] for k in seen if rows[k][0] is not None]
        out.append((rows[i][0], min(ids, default=None), len(near[i])))
    return out


EDGES = [(1, A), (1, A), (2, A + " thirteen"), (3, A.upper()), (4, None), (None, None), (5, ""), (6, "!!"), (None, "only here are these words"), (7, "a b"), (8, "A, b."), (9, "b a")]


def test_chosen_path_edge_cases(spark):
    docs = spark.createDataFrame(rows_with_noise(EDGES), DOCS)
    sort = lambda rows: sorted(rows, key=str)
    assert sort((r.doc_id, r.class_id, r.n_links) for r in chosenpath.join(docs).collect()) == sort(brute_join(EDGES))
    kept = chosenpath.deduplicate(docs)
    assert kept.columns == docs.columns
    assert sort((r.doc_id, r.text) for r in kept.collect()) == sort([(1, A), (4, None), (None, None), (5, ""), (6, "!!"), (None, "only here are these words"), (7, "a b"), (9, "b a")])
    assert chosenpath.join(docs.limit(0)).count() == 0 and chosenpath.deduplicate(docs.limit(0)).count() == 0


def test_chosen_path_large_groups_meet_in_blocks(spark, monkeypatch):
    """Groups beyond the brute-force size are split, and compared in blocks where they cannot be split."""
    monkeypatch.setattr(chosenpath, "SMALL", 8)
    rng = np.random.default_rng(1)
    base = [f"w{k}" for k in rng.integers(0, 500, 120)]
    rows = []
    for i in range(90):
        words = list(base)
        for at in rng.integers(0, len(words), rng.integers(0, 4)):
            words[at] = f"x{i}"
        rows.append((i, " ".join(words)))
    rows += [(100 + i, " ".join(f"y{k}" for k in rng.integers(0, 400, 60))) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in chosenpath.join(docs).collect()) == sorted(brute_join(rows))


def test_runs_reach_the_recall():
    assert chosenpath.runs_needed(0.9, 1) < chosenpath.runs_needed(0.999, 1) < chosenpath.runs_needed(0.999, 4)


def test_components_join_chains(spark):
    edges = spark.createDataFrame([(k + 1, k) for k in range(40)] + [(100, 101)], "x long, y long")
    roots = {r.node: r.root for r in chosenpath.components(edges).collect()}
    assert roots == {k: 0 for k in range(41)} | {100: 100, 101: 100}


def test_word_hashes_do_not_depend_on_the_place():
    hasher = common.WordHasher()
    a, b = hasher(b"alpha beta GAMMA"), hasher(("x " * 70_000 + "Beta alpha, gamma").encode())
    assert a.tolist() == [b[-2], b[-3], b[-1]] and len(set(a.tolist())) == 3
    assert not len(hasher(b" ,;\n"))


# Decontamination.

ITEM = " ".join(f"item{k}" for k in range(30))


def test_decontamination_edge_cases(spark):
    changed = ITEM.replace("item15", "other")
    far = " ".join(f"item{k}" for k in range(30) if k % 6)
    rows = [
        (1, f"before {ITEM} after"), (1, f"before {ITEM} after"), (2, f"{changed}"), (3, far), (4, None), (5, ""), (None, f"x {ITEM.upper()}!"),
        (6, "five words are not enough"), (7, f"{' '.join(ITEM.split()[:28])}"), (8, "clean " * 50),
    ]
    docs = spark.createDataFrame(rows_with_noise(rows), DOCS)
    items = spark.createDataFrame([(1, ITEM, 5), (1, ITEM, 5), (2, None, 5), (3, "few words", 5), (None, ITEM, 5)], "item_id long, text string, size int")
    found = {(r.doc_id, r.item_id): (r.start, round(r.similarity, 6)) for r in decontaminate.leaks(docs, items).collect()}
    wanted = {1: (1, 1.0), None: (1, 1.0), 7: (0, round(24 / 26, 6))}
    assert found == {(d, i): v for d, v in wanted.items() for i in (1, None)}
    kept = decontaminate.decontaminate(docs, items)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["2", "3", "4", "5", "6", "8"]
    assert decontaminate.leaks(docs, items.limit(0)).count() == 0 and decontaminate.leaks(docs.limit(0), items).count() == 0


def brute_leaks(docs, items):
    """Best window of every (document, item), by counting the shingles of every window."""
    runs = lambda t: [tuple(w[i : i + 5]) for w in [re.findall(r"[^\W_]+", t.lower())] for i in range(len(w) - 4)]
    found = {}
    for doc_id, text in docs:
        own = runs(text)
        for item_id, item in items:
            bag = Counter(runs(item))
            size = bag.total()
            for start in range(len(own)):
                window = Counter(own[start : start + size])
                both = (window & bag).total()
                similarity = both / (window.total() + size - both)
                if similarity >= 0.8:
                    found[doc_id, item_id] = min(found.get((doc_id, item_id), (0, 0)), (-round(similarity, 9), start))
    return found


def test_windows_with_repeated_shingles_against_brute_force(spark):
    """Few words, so that shingles stand several times in windows and items, and many windows are like an item."""
    rng = np.random.default_rng(4)
    speak = lambda n: [f"w{k}" for k in rng.integers(0, 2, n)]
    items = [(k, speak(n)) for k, n in enumerate((12, 30, 30, 60, 90))]
    docs = []
    for k in range(24):
        body = speak(40)
        for number in rng.integers(0, len(items), 2):
            passage = list(items[number][1])
            for at in rng.integers(0, len(passage), k % 3):
                passage[at] = "other"
            body += passage + speak(int(rng.integers(0, 40)))
        docs.append((k, " ".join(body)))
    docs += [(100, " ".join(items[4][1] * 3)), (101, " ".join(items[3][1][:55])), (102, "w0 " * 200)]
    items = [(k, " ".join(w)) for k, w in items] + [(9, "w0 " * 40)]
    got = decontaminate.leaks(spark.createDataFrame(rows_with_noise(docs), DOCS), spark.createDataFrame(items, "item_id long, text string"))
    wanted = brute_leaks(docs, items)
    assert len(wanted) >= 30
    assert {(r.doc_id, r.item_id): (-round(r.similarity, 9), r.start) for r in got.collect()} == wanted


def test_an_item_of_twenty_thousand_words(spark):
    rng = np.random.default_rng(6)
    item = [f"w{k}" for k in rng.integers(0, 5_000, 20_000)]
    changed = [w if k % 1_000 else "other" for k, w in enumerate(item)]
    docs = [(1, " ".join(["before", *item, "after"])), (2, " ".join(changed)), (3, " ".join(item[:12_000])), (4, " ".join(reversed(item)))]
    found = decontaminate.leaks(spark.createDataFrame(rows_with_noise(docs), DOCS), spark.createDataFrame([(7, " ".join(item))], "item_id long, text string"))
    got = {r.doc_id: (r.item_id, r.start, r.similarity) for r in found.collect()}
    # Twenty other words, of which the first only shortens the window: 19 spoil five shingles each.
    assert got == {1: (7, 1, 1.0), 2: (7, 1, 19_900 / (19_995 + 19_996 - 19_900))}


def test_hamming_blocks_find_all_within_the_radius(spark):
    """Fingerprints that differ in RADIUS bits share a filed value in some block."""
    rng = np.random.default_rng(2)
    rows = []
    for k in range(200):
        value = int(rng.integers(-(2**63), 2**63 - 1))
        mask = sum(1 << int(b) for b in rng.choice(64, decontaminate.RADIUS, replace=False))
        other = (value ^ mask) & (2**64 - 1)
        rows.append((k, value, other - 2**64 if other >= 2**63 else other))
    table = spark.createDataFrame(rows, "k int, a long, b long")
    meet = F.size(F.array_intersect(decontaminate.parts(F.col("a"), True), decontaminate.parts(F.col("b"), False)))
    assert table.where(meet == 0).count() == 0


def test_fingerprints_count_many_shingles(spark):
    """A window of more shingles than a short counter holds: every bit is decided by the majority."""
    shares = [0, 0x5555555555555555, -1, -1]
    rows = spark.range(80_000).select(F.lit(1).alias("w"), F.element_at(F.array(*[F.lit(x).cast("long") for x in shares]), (F.col("id") % 4 + 1).cast("int")).alias("hash"))
    got = decontaminate.fingerprint(rows, ["w"]).first()
    assert (got.n, got.print) == (80_000, 0x5555555555555555)


# Tool calls.


def test_tool_calls(spark):
    calls = spark.createDataFrame(
        [
            ("a", "reply", '{"turn":1,"prompt":"x","conversation":2}', None), ("b", "reply", '{"prompt":" ","conversation":"2"}', "a"),
            ("c", "reply", "no json", "b"), ("d", "sing", "{}", "c"), ("e", "reply", None, "f"), ("f", None, "{}", "e"), ("g", "sing", "{}", "f"),
            ("a", "reply", '{"turn":1,"prompt":"x","conversation":2}', None), (None, "sing", "{}", "a"), ("h", "sing", '{"more":1}', "missing"),
        ],
        "call_id string, name string, arguments string, waits_for string",
    )
    results = spark.createDataFrame([("a", "r1"), ("b", "r2"), ("b", "r0"), ("zz", "lost"), (None, "lost"), ("c", None)], "call_id string, content string")
    rows = toolcalls.formatted(calls, results, toolcalls.TOOLS | {"sing": {}}).collect()
    by = {r.call_id: r for r in rows if r.call_id}
    assert {k: (r.status, r.depth, r.content) for k, r in by.items()} == {
        "a": ("linked", 0, "r1"), "b": ("ambiguous", 1, "r0"), "c": ("linked", 2, None), "d": ("unanswered", 3, None), "e": ("cycle", None, None),
        "f": ("cycle", None, None), "g": ("cycle", None, None), "h": ("unanswered", 0, None), "zz": ("orphan", None, "lost"),
    }
    assert sorted(r.status for r in rows if not r.call_id) == ["orphan", "unanswered"]
    assert by["a"].errors == "" and by["b"].errors == "reply.conversation: integer,reply.prompt: filled,reply.turn: integer"
    assert by["c"].errors == "not an object" and by["h"].errors == "sing: unknown member" and "unknown tool" in by["f"].errors
    assert by["a"].json == '{"arguments":{"conversation":2,"prompt":"x","turn":1},"call_id":"a","content":"r1","errors":"","name":"reply","status":"linked"}'
    assert all(json.loads(r.json)["status"] == r.status for r in rows)
    empty = toolcalls.formatted(calls.limit(0), results.limit(0), toolcalls.TOOLS)
    assert empty.count() == 0


def test_arguments_are_judged_by_their_types(spark):
    tools = {"reply": {"conversation": "integer", "prompt": "filled", "turn": "integer"}, "all": {"a": "array", "b": "boolean", "n": "number?", "o": "object", "s": "string"}}
    cases = [
        ("reply", '{"conversation":5,"prompt":"x","turn":1}', ""),
        ("reply", '{"conversation":"5","prompt":7,"turn":"1"}', "reply.conversation: integer,reply.prompt: filled,reply.turn: integer"),
        ("reply", '{"conversation":5,"prompt":["x"],"turn":1.5}', "reply.prompt: filled,reply.turn: integer"),
        ("reply", '{"conversation":123456789012345678901,"prompt":"null","turn":true}', "reply.turn: integer"),
        ("reply", '{"conversation":null,"prompt":{"x":1},"turn":-1}', "reply.conversation: integer,reply.prompt: filled"),
        ("reply", '{"turn":1,"turn":1,"conversation":5,"prompt":"x"}', "not an object"),
        ("reply", "[]", "not an object"), ("reply", "7", "not an object"), ("reply", None, "not an object"), ("reply", "", "not an object"),
        ("all", '{"a":[],"b":false,"n":1.5,"o":{},"s":""}', ""), ("all", '{"a":[1],"b":true,"o":{"x":1},"s":"x"}', ""),
        ("all", '{"a":{},"b":"true","n":"1","o":[],"s":1}', "all.a: array,all.b: boolean,all.n: number,all.o: object,all.s: string"),
        ("all", '{"a":[],"b":false,"n":null,"o":{},"s":"","x":1}', "all: unknown member"), (None, "{}", "unknown tool"),
    ]
    table = spark.createDataFrame([(k, *c) for k, c in enumerate(cases)], "k int, name string, arguments string, wanted string")
    got = table.select("k", "wanted", toolcalls.broken_rules(F.col("name"), F.col("arguments"), tools).alias("got"))
    assert [(r.k, r.got) for r in got.orderBy("k").collect()] == [(k, c[2]) for k, c in enumerate(cases)]


def test_tool_call_order_of_long_chains(spark):
    calls = spark.createDataFrame([(f"c{k}", "sing", "{}", f"c{k - 1}" if k else None) for k in range(100)], "call_id string, name string, arguments string, waits_for string")
    assert {int(r.call_id[1:]): r.depth for r in toolcalls.depths(calls).collect()} == {k: k for k in range(100)}


def test_conversations_with_nulls(spark):
    table = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "a"), (None, 0, "user", None), (1, None, "assistant", "x"), (1, 2, None, "y")], "conv_id long, turn long, role string, text string")
    calls, results = toolcalls.conversation_calls(table)
    rows = toolcalls.formatted(calls, results, toolcalls.TOOLS).collect()
    assert sorted((str(r.call_id), r.status) for r in rows) == [("1:0", "linked"), ("None", "orphan"), ("None", "unanswered")]


# The pipeline.


def test_pipeline_against_brute_force(spark):
    given = [(r.doc_id, r.text, r.lang) for r in queries.table(spark, SF, "documents").collect()]
    docs = queries.table(spark, SF, "documents")
    model = langid.fit(docs.select("doc_id", "text", "lang"))
    kept = [(i, t) for i, t, _ in given if model.predict(t)[0] != langid.UNKNOWN]
    classes = {i: c for i, c, _ in brute_join(kept)}
    kept = [(i, t) for i, t in kept if classes[i] == i]
    items = [re.findall(r"[^\W_]+", r.text.lower()) for r in queries.table(spark, SF, "benchmark").collect()]
    text_of = lambda t: " " + " ".join(re.findall(r"[^\W_]+", t.lower())) + " "
    clean = {i for i, t in kept if not any(f" {' '.join(w)} " in text_of(t) for w in items)}
    steps = docs
    for _, stage in corpus_pipeline.STAGES[:4]:
        steps = corpus_pipeline.written(stage(spark, steps, SF), "step")
        assert steps.columns == docs.columns
    rows = {r.doc_id: r.text for r in steps.collect()}
    assert set(rows) <= clean and len(clean) - len(rows) <= 2
    digits = re.compile(r"\S@\S+\.\w|\d+\.\d+\.\d+\.\d+|\+\d \(\d{3}\)")
    assert not any(digits.search(t) for t in rows.values())
    pieces = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in pieces} == set(rows) and corpus_pipeline.ORACLE_SQL is None


def test_stages_bear_nulls_repeats_other_columns_and_empty_tables(spark):
    text = "the quick brown fox jumps over the lazy dog and runs away again " * 3
    rows = [(1, text, "en", "s", 5), (1, text, "en", "s", 5), (2, text, None, None, None), (3, None, None, None, None), (4, "", "en", "s", 0), (5, "12 34", "en", "s", 5), (None, "mail a@b.cd now", "en", None, 1)]
    table = spark.createDataFrame([(*r, "x", "y", 1, 2) for r in rows], DOCS)
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, table, SF)
        assert out.columns == table.columns, name
        kept[name] = sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in out.collect())
        assert stage(spark, table.limit(0), SF).count() == 0, name
    ids = {name: [i for _, i, _ in found] for name, found in kept.items()}
    assert ids["language"] == [1, 1, 2, 0] and ids["near_copies"] == [1, 3, 4, 5, 0]
    assert ids["benchmark_leaks"] == ids["personal_data"] == [1, 1, 2, 3, 4, 5, 0] and "a@b.cd" not in str(kept["personal_data"])
    pieces = corpus_pipeline.packed(spark, table, SF).collect()
    assert len(pieces) == 7 and sum(r.doc_tokens == 1 for r in pieces) == 2
