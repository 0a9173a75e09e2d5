import random

from lexspan.operators import structure
from lexspan.operators.extract import HEADING_MARK as H

NOTE = "(в ред. приказа от 1 н)"


def parse(spark, *docs):
    df = spark.createDataFrame(list(enumerate(docs)), "doc int, text string")
    out = {i: [] for i in range(len(docs))}
    for r in structure.parse_clauses(df).orderBy("doc", "pos").collect():
        out[r.doc].append((r.path, r.parent_path, r.heading, r.text))
    return out


def lines(*blocks):
    return "\n\n".join(blocks)


def model(blocks):
    """The clause rules stated for each block on its own, by looking back and ahead in the whole list.

    Blocks are (kind, value): H heading, U heading without number, C clause number, S letter,
    D digit, T text, E editorial note.
    """
    at = range(len(blocks))
    key = {i: tuple(map(int, f"{blocks[i][1]}.0".split(".")[:2])) for i in at if blocks[i][0] == "C"}
    # A clause counts when it is beyond every clause that counts before it: beyond the greatest number so far.
    opens = [i for i in key if all(key[j] < key[i] for j in key if j < i)]
    last = lambda places, i: max((j for j in places if j < i), default=None)
    headings = [i for i in at if blocks[i][0] == "H" or (blocks[i][0] == "U" and last(opens, i) is not None)]
    # Whatever follows a clause out of order is passed over, up to the next heading or clause that counts.
    refused = [i for i in key if i not in opens]
    passed = {i for i in at if (r := last(refused, i)) is not None and not any(r < j < i for j in (*opens, *headings))}
    letter = {}
    for i in at:
        kind, value = blocks[i]
        if kind in "SD" and i not in passed and last(opens, i) is not None:
            before = last([j for j in letter if j > last(opens, i)], i)
            told = value if kind == "S" else {("6", "а"): "б", ("3", "ж"): "з"}.get((value, letter.get(before)))
            if told:
                letter[i] = told
    starts = sorted([*opens, *letter])
    ends = sorted([*opens, *headings, *refused])
    rows = []
    for i in starts:
        after = [j for j in at if j > i and last(starts, j) == i and j not in starts and j not in headings and j not in key and j not in passed]
        said = [(blocks[j][0], f"{blocks[j][1]}) s{blocks[j][1]}" if blocks[j][0] == "D" else blocks[j][1]) for j in after if blocks[j][0] in "TED"]
        if i in key:
            heading = last(headings, i)
            rows.append((blocks[i][1], None, None if heading is None else blocks[heading][1], " ".join([f"c{blocks[i][1]}.", *(v for _, v in said)])))
            continue
        number = blocks[last(opens, i)][1]
        # Text after a letter belongs to it when the next letter of the list follows first. A heading, a clause or
        # the end closes the list: what stands before it (without notes) is a conclusion, which then takes the letter's place.
        parts, path = [f"s{blocks[i][1]}"], f"{number}.{letter[i]}"
        nxt = min((j for j in starts if j > i), default=len(blocks))
        spoken = [j for j in after if blocks[j][0] in "TED"]
        stops = [j for j in ends if i < j < nxt] + [nxt]
        for low, high in zip([i, *stops], stops, strict=False):
            here = [said[k] for k, j in enumerate(spoken) if low < j < high]
            if high in letter:
                parts += [v for _, v in here]
            elif any(k != "E" for k, _ in here):
                rows.append((path, number, None, " ".join(parts)))
                parts, path = [v for k, v in here if k != "E"], f"{number}.заключение"
        rows.append((path, number, None, " ".join(parts)))
    return rows


def written(kind, value):
    return {
        "H": f"II. {value}", "U": H + value, "C": f"{value}. c{value}." if "." not in value else f"{value} c{value}.",
        "S": f"{value}) s{value}", "D": f"{value}) s{value}", "T": value, "E": value,
    }[kind]


def test_windows_agree_with_a_sequential_reading(spark):
    rnd = random.Random(11)
    docs = []
    for i in range(1500):
        blocks = []
        for j in range(rnd.randint(1, 16)):
            kind = rnd.choice("HUCCCSSSDDTTTE")
            value = {
                "H": f"Раздел {j}", "U": f"Подраздел {j}", "C": rnd.choice(["1", "2", "3", "4", "2.1", "3.5"]),
                "S": rnd.choice("абжз"), "D": rnd.choice("63"), "T": f"текст {j},", "E": NOTE,
            }[kind]
            blocks.append((kind, value))
        docs.append(blocks)
    got = parse(spark, *[lines(*[written(*b) for b in blocks]) for blocks in docs])
    for i, blocks in enumerate(docs):
        assert got[i] == model(blocks), blocks


def test_examples(spark):
    got = parse(
        spark,
        lines("I. Общие положения", "1. Настоящий.", "II. Условия", "4. Признаки:", "а) имеет форму;", "б) предназначен.", "5. Вправе."),
        lines("5. A.", "5.1. B.", "15.1 C.", "16. D."),
        lines("13. Способы:", "а) один;", "б) два.", "Способ общий.", "И ещё.", "14. Далее."),
        lines("3. Список:", "а) один;", NOTE, "4. Далее."),
        lines("16. Список:", "н) один;", NOTE, "о) два.", "(введен приказом N 1)", "Итог.", "17. Далее."),
        lines("14. Первый.", NOTE, "Второй."),
        lines("45. Информация:", "ж) результат, включенный в", "расходы;", "3) балансовая.", "46. Далее."),
        lines("1. Первый.", H + "III. Состав и содержание информации, раскрываемой в отчетности (в ред. приказа N 2)", "2. Второй."),
        lines(H + "ПОЛОЖЕНИЕ", "1. Первый.", H + "Баланс", "2. Второй."),
        lines("1. Общие положения", "1. Слово пере-\nнесено  и\nсложено.", "[[PAGE 3]]\n12\n", "2. Второй."),
        "",
    )
    assert [(p, h) for p, _, h, _ in got[0]] == [
        ("1", "Общие положения"), ("4", "Условия"), ("4.а", None), ("4.б", None), ("5", "Условия")]
    assert [p for p, *_ in got[1]] == ["5", "5.1", "15.1", "16"] and got[1][2][3] == "C."
    assert got[2][3] == ("13.заключение", "13", None, "Способ общий. И ещё.")
    assert [p for p, *_ in got[3]] == ["3", "3.а", "4"]
    assert got[4][1][3] == "один; " + NOTE and got[4][3] == ("16.заключение", "16", None, "Итог.")
    assert got[5] == [("14", None, None, f"Первый. {NOTE} Второй.")]
    assert [t for *_, t in got[6]] == ["Информация:", "результат, включенный в расходы;", "балансовая.", "Далее."]
    assert got[6][2][0] == "45.з"
    assert got[7][1][2] == "Состав и содержание информации, раскрываемой в отчетности"
    assert [(p, h) for p, _, h, _ in got[8]] == [("1", None), ("2", "Баланс")]
    assert got[9] == [("1", None, "Общие положения", "Слово перенесено и сложено."), ("2", None, "Общие положения", "Второй.")]
    assert got[10] == []


def test_a_document_costs_one_shuffle(spark):
    df = spark.createDataFrame([("d", "1. A")], "doc string, text string")
    plan = structure.parse_clauses(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_annex_slices(spark):
    order = (
        "Преамбула: ФСБУ 9/2021 «Один» и ФСБУ 10/2021 «Два»\nв одном предложении.\n\n"
        "ФЕДЕРАЛЬНЫЙ СТАНДАРТ БУХГАЛТЕРСКОГО УЧЕТА\nФСБУ 9/2021 «Один»\n\n1. Текст первого.\n\n"
        "ФСБУ 10 / 2021 \"Два\"\n\n1. Текст второго."
    )
    rows = [("9/2021", order), ("10/2021", order), ("0/2021", order), ("9/2021", "1. Один.")]
    got = structure.slice_annex(spark.createDataFrame(rows, "number string, text string")).collect()
    assert [r.outcome for r in got] == ["sliced", "sliced", "not_found", "unchanged"]
    assert got[0].text.startswith("ФЕДЕРАЛЬНЫЙ СТАНДАРТ") and "второго" not in got[0].text
    assert got[1].text.startswith("ФСБУ 10 / 2021") and "первого" not in got[1].text
    assert got[2].text is None and got[2].error.endswith("(в документе найдены приложения для: 10/2021, 9/2021)")
    assert got[3].text == "1. Один."


def test_completeness_and_lost_text(spark):
    docs = spark.createDataFrame(
        [("full", lines(*[f"{n}. Пункт {n}." for n in range(1, 6)], "Продолжение.", "2. Не по порядку.", "И его текст.")),
         ("thin", lines("1. Один.", "а) буква")), ("note", lines("1. Один.", "1.1. " + NOTE, "2. Два."))],
        "doc string, text string",
    )
    clauses = structure.parse_clauses(docs)
    got = {r.doc: (r.top_level, r.complete) for r in structure.looks_complete(clauses).collect()}
    assert got == {"full": (5, True), "thin": (1, False), "note": (3, False)}
    assert structure.lost_paragraphs(docs, clauses).count() == 0
    cut = clauses.where("path != '5' AND path != '1.а' AND NOT (doc = 'note' AND path = '1.1')")
    lost = sorted((r.doc, r.text) for r in structure.lost_paragraphs(docs, cut).collect())
    assert lost == [("full", "Продолжение."), ("full", "Пункт 5."), ("thin", "буква")]
