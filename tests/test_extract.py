import pytest

from lexspan.operators import extract
from lexspan.operators.extract import HEADING_MARK as H

CASES = [
    ("<p>1. Один.</p><p>2. Два.</p>", "1. Один.\n\n2. Два."),
    ("<p>1. A.</p><p>&nbsp;</p><p>2. B.</p>", "1. A.\n\n2. B."),
    ("<p>1. A   с пробелами.</p>", "1. A с пробелами."),
    ("<p>1. Часть.<br/>Ещё.</p>", "1. Часть. Ещё."),
    ("<p>1. A.</p><script>x('<p>')</script><!-- <p>no</p> --><style>p{}</style>", "1. A."),
    ("<div><p>внутри</p></div><p>после</p>", "внутри\n\nпосле"),
    ("<p><b>Без конца<br><p>Следующий", H + "Без конца\n\nСледующий"),
    ("<p>1. A &#171;x&#xBB; &amp;lt; &unknown;</p>", "1. A «x» &lt; &unknown;"),
    # headings
    ("<p><strong>V</strong><strong>. Раскрытие</strong></p>", H + "V . Раскрытие"),
    ("<p>1. Слово <b>жирное</b> внутри.</p>", "1. Слово жирное внутри."),
    ("<p>A</p><p align='center'>Баланс</p><p>B</p>", f"A\n\n{H}Баланс\n\nB"),
    ("<p>A</p><p style='text-align: center'>Баланс</p><p>B</p>", f"A\n\n{H}Баланс\n\nB"),
    ("<p>A</p><p align=center>Для целей</p><p align=center>Учёта</p><p>B</p>", "A\n\nДля целей\n\nУчёта\n\nB"),
    ("<p>A</p><p align=center>120 000</p><p>B</p>", "A\n\n120 000\n\nB"),
    ("<p>A</p><p align=center>Пример расчёта</p><p>B</p>", "A\n\nПример расчёта\n\nB"),
    ("<p>A</p><p align=center>Сумма, руб.</p><p>B</p>", "A\n\nСумма, руб.\n\nB"),
    ("<p>A</p><p align=center>II<sup>1</sup>. Раздел</p><p>B</p>", f"A\n\n{H}II1. Раздел\n\nB"),
    ("<p>A</p><p align=center>(в ред. Приказа от 1.1.2006 N 1н)</p><p>B</p>", "A\n\n(в ред. Приказа от 1.1.2006 N 1н)\n\nB"),
    ("<p>A</p><p align=center><em>Курсив</em></p><p>B</p>", "A\n\nКурсив\n\nB"),
    ("<p>17<sup>1</sup>. A</p>", "17.1. A"),
    # trimming
    ("<p>1. Утвердить</p><p>Приложение № 1 к приказу</p><p>1. A</p>", "Приложение № 1 к приказу\n\n1. A"),
    ("<p>УТВЕРЖДЕНО приказом</p><p>1. A</p><p>Утверждено приказом</p><p>1. A</p>", "УТВЕРЖДЕНО приказом\n\n1. A"),
    ("<p>Утверждено приказом</p><p>1. A</p><p>ПОЛОЖЕНИЕ ПО БУХГАЛТЕРСКОМУ УЧЕТУ</p><p>x</p><p>(утверждено приказом)</p><p>1. A</p>",
     "Утверждено приказом\n\n1. A"),
    ("<p>ПОЛОЖЕНИЕ ПО БУХГАЛТЕРСКОМУ УЧЕТУ</p><p>(утверждено приказом)</p><p>1. A</p>", "(утверждено приказом)\n\n1. A"),
    ("<p>28. A.</p><p>Приложение 1 к Положению по учёту</p><p>Пример 1.</p>", "28. A."),
    ("<p>28. A.</p><p>Приложение № 2</p><p>к Стандарту</p><p>1. B</p>", "28. A."),
    ("<p>28. A.</p><p>Приложение № 2</p><p>иное</p>", "28. A.\n\nПриложение № 2\n\nиное"),
    ("<p>1. A.</p><p>[1] Сноска.</p><p>[2] Сноска.</p>", "1. A."),
    ("<p>1. A.</p><p>[1] Сноска.</p><p>Приложение к Положению</p>", "1. A.\n\n Сноска."),
    ("<p>1. Со ссылкой [1], далее[2].</p>", "1. Со ссылкой, далее."),
    ("", ""),
]


def test_pages(spark):
    pages = [(i, f"<p>menu</p><div class='x text_wrapper y'>{body}</div><p>footer</p>") for i, (body, _) in enumerate(CASES)]
    pages.append((len(CASES), "<html><p>no wrapper</p></html>"))
    df = spark.createDataFrame(pages, "id int, html string")
    got = {r.id: r.text for r in extract.page_texts(df).collect()}
    for i, (body, expected) in enumerate(CASES):
        assert got[i] == expected, body
    assert got[len(CASES)] == ""


def test_extraction_needs_no_shuffle(spark):
    df = spark.createDataFrame([(1, "<p>x</p>")], "id int, html string")
    plan = extract.page_texts(df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


@pytest.mark.parametrize(
    "html, link",
    [
        ('<a href="/common/std.pdf">x</a>', "https://minfin.gov.ru/common/std.pdf"),
        ('<a class=c href="/std.pdf?v=2">x</a>', "https://minfin.gov.ru/std.pdf?v=2"),
        ('<a href="/a.html">x</a><a href="http://h/b.PDF">y</a>', "http://h/b.PDF"),
        ('<a href="/std.pdfx">x</a>', None),
    ],
)
def test_pdf_link(spark, html, link):
    df = spark.createDataFrame([(html,)], "html string")
    assert df.select(extract.pdf_link(df.html).alias("l")).first().l == link


def test_best_source_wins(spark):
    def src(name, *ids):
        return spark.createDataFrame([(i, name, f"{name}{i}") for i in ids], "id int, source string, text string")

    got = extract.choose_source(src("html", 1), src("pdf", 1, 2), src("order", 1, 2, 3)).collect()
    assert {(r.id, r.source, r.text) for r in got} == {(1, "html", "html1"), (2, "pdf", "pdf2"), (3, "order", "order3")}
