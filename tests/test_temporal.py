import random
from datetime import date, timedelta

from pyspark.sql import functions as F

from lexspan import schemas, texts
from lexspan.operators import temporal


def d(text):
    return date.fromisoformat(text)


def editions(spark, rows):
    full = [(f"{s}@{n}", s, n, None, d(day)) for s, n, day in rows]
    return spark.createDataFrame(full, schemas.EDITION)


def test_edition_is_the_newest_started(spark):
    eds = editions(spark, [("s", 1, "2022-01-01"), ("s", 2, "2024-01-01")])
    days = [d(x) for x in ("2025-06-01", "2023-06-01", "2024-01-01", "2021-12-31")]
    by_day = {r.on_date: r.edition_no for r in temporal.editions_on(eds, days).collect()}
    assert by_day == {days[0]: 2, days[1]: 1, days[2]: 2}
    asked = spark.createDataFrame([("s", x) for x in days] + [("t", days[0])], "standard_id string, on_date date")
    found = {(r.standard_id, r.on_date): r.edition_no for r in temporal.edition_as_of(eds, asked).collect()}
    assert found == {("s", days[0]): 2, ("s", days[1]): 1, ("s", days[2]): 2, ("s", days[3]): None, ("t", days[0]): None}


def test_as_of_agrees_with_brute_force_on_a_hot_standard(spark):
    rnd = random.Random(5)
    start = d("2000-01-01")
    rows, seen = [], set()
    for i in range(300):
        s = "hot" if rnd.random() < 0.4 else f"s{rnd.randrange(20)}"
        day = start + timedelta(days=rnd.randrange(800))
        if (s, day) not in seen:
            seen.add((s, day))
            rows.append((s, len(rows) + 1, day.isoformat()))
    eds = editions(spark, rows)
    asked = [
        ("hot" if rnd.random() < 0.4 else f"s{rnd.randrange(22)}", start + timedelta(days=rnd.randrange(-20, 850)), i)
        for i in range(500)
    ]
    params = spark.createDataFrame(asked, "standard_id string, on_date date, n int")
    got = {r.n: r.edition_no for r in temporal.with_edition(params, eds).collect()}
    assert len(got) == 500
    for s, day, i in asked:
        started = [(d(x), n) for t, n, x in rows if t == s and d(x) <= day]
        assert got[i] == (max(started)[1] if started else None)


def test_validity_intervals_meet(spark):
    eds = editions(spark, [("s", 1, "2022-01-01"), ("s", 2, "2024-01-01")])
    spans = {r.edition_no: (r.valid_from, r.valid_to) for r in temporal.validity(eds).collect()}
    assert spans == {1: (d("2022-01-01"), d("2024-01-01")), 2: (d("2024-01-01"), None)}


def test_status_end_is_exclusive_and_start_inclusive(spark):
    rows = [(d("2000-01-01"), d("2027-01-01"), d(x)) for x in ("2027-01-01", "2026-12-31", "2000-01-01", "1999-12-31")]
    rows.append((d("2000-01-01"), None, d("2100-01-01")))
    df = spark.createDataFrame(rows, "effective_from date, effective_to date, on_date date")
    got = [r.status for r in temporal.with_status(df).collect()]
    assert got == [texts.REPEALED, texts.ACTIVE, texts.ACTIVE, texts.NOT_YET, texts.ACTIVE]


def test_on_date_parameter(spark):
    df = spark.createDataFrame([("2024-02-29",), ("2024-02-30",), ("29.02.2024",), (None,)], "on_date string")
    got = temporal.with_on_date(df, today=F.lit(d("2025-01-01"))).collect()
    assert [r.on_date for r in got] == [d("2024-02-29"), None, None, d("2025-01-01")]
    assert [r.error is None for r in got] == [True, False, False, True]
    assert "29.02.2024" in got[2].error
