"""HTML pages -> paragraphs -> text ready for `structure`.

A page is one row, so everything that looks at neighbouring paragraphs works on an array inside
that row: extraction is a map over pages, without any shuffle.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexspan import texts
from lexspan.functions.columns import absolute_url, after_first, bind, matched, strip
from lexspan.functions.scale import each
from lexspan.functions.html import drop_invisible, element_body, node_text

# Marks a paragraph as a heading in extracted text; a private-use character.
HEADING_MARK = "\ue000"

# Start tags and end tags that end an open paragraph.
_ENDS_PARAGRAPH = (
    r"(?is)(?:</p\s*>|</?(?:address|article|blockquote|body|caption|center|dd|dir|div|dl|dt|fieldset"
    r"|footer|form|h[1-6]|header|html|li|main|menu|nav|ol|pre|section|table|tbody|td|tfoot|th|thead"
    r"|tr|ul)(?![\w-])).*\z"
)

# Phrases that mark the parts of a page.
ANNEX_START = (
    r"(?iuU)\A\(?\s*(?:утвержд(?:ен|ено|ена)\s+приказом|приложени[ея]\s*(?:№\s*\d+)?\s*к\s+приказ)"
)
TITLE_FRAGMENT = r"\A(?:ПОЛОЖЕНИЕ ПО БУХГАЛТЕРСКОМУ УЧЕТУ|ФЕДЕРАЛЬНЫЙ СТАНДАРТ БУХГАЛТЕРСКОГО УЧЕТА)\z"
APPENDIX = r"(?iuU)\Aприложени[ея]\s*(?:№\s*)?\d*\s*к\s+(?:положени|стандарт)"
APPENDIX_LABEL = r"(?iuU)\Aприложени[ея]\s*(?:№\s*)?\d*\s*\z"
APPENDIX_CONTINUED = r"(?iuU)\Aк\s+(?:положени|стандарт)"
FOOTNOTE = r"(?U)\A\[\d+\]\s"
FOOTNOTE_MARK = r"(?U)\s*\[\d+\]"
EDITORIAL_NOTE = r"(?iuU)\A\([^()]*(?:в\s+ред\.\s+приказ|введен\w*\s+приказ)[^()]*\)\z"
_MONEY = r"(?iu)руб\.|%|="
_EXAMPLE = r"(?iuU)\Aпример\b"
_LEADING_MARKER = r"(?U)\A[^\s.]{1,6}\.\s*"


def reglue(text: Column) -> Column:
    """Put a raised digit back on its number: `17 1 .` -> `17.1.`, `II 1 .` -> `II1.`."""
    arabic = F.regexp_replace(text, r"(?U)\A(\d+)\s+(\d+)\s*\.", "$1.$2.")
    roman = F.regexp_replace(text, r"(?U)\A([IVXLCDM]+)\s+(\d+)\s*\.", "$1$2.")
    return F.when(text.rlike(r"(?U)\A\d"), arabic).otherwise(roman)


def _wrapped_text(html: Column, tags: str) -> Column:
    """Text inside all `tags` elements, null when they are nested or absent."""
    inner = F.regexp_extract_all(
        html, F.lit(rf"(?is)<({tags})(?:\s[^>]*)?>(.*?)(?:</\1\s*>|\z)"), F.lit(2)
    )

    def joined(found: Column) -> Column:
        nested = F.exists(found, lambda x: x.rlike(rf"(?i)<(?:{tags})[\s>]"))
        text = F.array_join(F.transform(found, node_text), " ")
        return F.when((F.size(found) > 0) & ~nested, text)

    return bind(inner, joined)


def _piece(piece: Column) -> Column:
    html = F.regexp_replace(F.regexp_replace(piece, r"\A[^>]*>", ""), _ENDS_PARAGRAPH, "")
    return F.struct(F.regexp_extract(piece, r"\A([^>]*)>", 1).alias("attrs"), html.alias("html"))


def _read(p: Column) -> Column:
    raw = node_text(p["html"])
    return F.struct(p["attrs"].alias("attrs"), p["html"].alias("html"), raw.alias("raw"))


def _worded(p: Column) -> Column:
    text = reglue(strip(F.regexp_replace(p["raw"], "[ \t\u00a0]+", " ")))
    bold = _all_inside(p, "strong|b")
    return F.struct(
        text.alias("text"), bold.alias("bold"), _all_inside(p, "em|i").alias("italic"), p["attrs"].alias("attrs")
    )


def _all_inside(p: Column, tags: str) -> Column:
    """Whether a paragraph has text and all of it sits inside `tags` elements."""
    marked = p["html"].rlike(rf"(?i)<(?:{tags})[\s>]")
    whole = F.coalesce(_wrapped_text(p["html"], tags) == p["raw"], F.lit(False))
    return F.when(marked & (p["raw"] != ""), whole).otherwise(False)


def _flags(p: Column) -> Column:
    noted = p["italic"] | p["text"].rlike(EDITORIAL_NOTE)
    bold = p["bold"] & ~noted
    style = F.replace(
        F.lower(F.regexp_extract(p["attrs"], r"""(?is)\bstyle\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", 1)),
        F.lit(" "),
        F.lit(""),
    )
    align = F.lower(F.regexp_extract(p["attrs"], r"""(?is)\balign\s*=\s*["']?\s*([a-z]+)""", 1))
    centred = (align == "center") | F.contains(style, F.lit("text-align:center"))
    return F.struct(p["text"].alias("text"), bold.alias("bold"), (centred & ~bold & ~noted).alias("centred"))


def paragraph_array(html: Column, tag: str = "div", cls: str | None = "text_wrapper") -> Column:
    """Non-empty paragraphs of the body element: array<struct<text, bold, centred>>."""
    body = element_body(drop_invisible(html), tag, cls)
    pieces = F.transform(after_first(F.split(body, r"(?i)<p(?=[\s/>])")), _piece)
    worded = F.transform(F.transform(pieces, _read), _worded)
    return F.transform(F.filter(worded, lambda p: p["text"] != ""), _flags)


def title_like(text: Column) -> Column:
    """A centred line that names something rather than showing a worked example's data."""
    body = F.regexp_replace(text, _LEADING_MARKER, "")
    return ~text.rlike(_MONEY) & ~text.rlike(_EXAMPLE) & ~body.rlike(r"(?U)\d")


def _at(paras: Column, i: Column, field: str) -> Column:
    return F.get(paras, i)[field]


def mark_headings(paras: Column) -> Column:
    """array<struct<text, heading>>: bold lines, and centred lines standing on their own."""

    def one(p: Column, i: Column) -> Column:
        alone = ~F.coalesce(_at(paras, i - 1, "centred"), F.lit(False)) & ~F.coalesce(
            _at(paras, i + 1, "centred"), F.lit(False)
        )
        heading = p["bold"] | (p["centred"] & alone & title_like(p["text"]))
        return F.struct(p["text"].alias("text"), heading.alias("heading"))

    return F.transform(paras, one)


def _positions(paras: Column, test) -> Column:
    """Zero-based positions of the paragraphs that pass `test(paragraph, position)`."""
    marked = F.transform(paras, lambda p, i: F.when(test(p, i), i))
    return F.filter(marked, lambda i: i.isNotNull())


def _cut(paras: Column, start: Column, end: Column) -> Column:
    return F.slice(paras, start + 1, F.greatest(end - start, F.lit(0)))


def one_copy(df: DataFrame, paras: str = "paras") -> DataFrame:
    """Keep one copy of the document: from the first annex marker to the second one, or to a
    repeated title fragment before it."""
    p = F.col(paras)
    first, second = F.get(F.col("_annex"), F.lit(0)), F.get(F.col("_annex"), F.lit(1))
    fragments = F.filter(F.col("_title"), lambda i: (i >= first) & (i < second))
    end = F.coalesce(F.get(fragments, F.lit(0)), second, F.size(p))
    return (
        df.withColumn("_annex", _positions(p, lambda x, _: x["text"].rlike(ANNEX_START)))
        .withColumn("_title", _positions(p, lambda x, _: x["text"].rlike(TITLE_FRAGMENT)))
        .withColumn(paras, _cut(p, F.coalesce(first, F.lit(0)), end))
        .drop("_annex", "_title")
    )


def drop_tail(df: DataFrame, paras: str = "paras") -> DataFrame:
    """Cut at the first nested appendix; where there is none, drop the closing footnotes."""
    p = F.col(paras)

    def opens_appendix(x: Column, i: Column) -> Column:
        split_caption = x["text"].rlike(APPENDIX_LABEL) & F.coalesce(
            _at(p, i + 1, "text").rlike(APPENDIX_CONTINUED), F.lit(False)
        )
        return x["text"].rlike(APPENDIX) | split_caption

    appendix = F.get(_positions(p, opens_appendix), F.lit(0))
    last_kept = F.array_max(_positions(p, lambda x, _: ~x["text"].rlike(FOOTNOTE)))
    return df.withColumn("_end", F.coalesce(appendix, last_kept + 1, F.lit(0))).withColumn(
        paras, _cut(p, F.lit(0), F.col("_end"))
    ).drop("_end")


def strip_marks(text: Column) -> Column:
    """Take inline footnote marks out of a paragraph, with the blank before them."""
    return F.regexp_replace(text, FOOTNOTE_MARK, "")


def paragraph_rows(pages: DataFrame, tag: str = "div", cls: str | None = "text_wrapper") -> DataFrame:
    """pages(id, html) -> (id, pos, text, bold, centred), one row per paragraph."""
    rows = each(pages, ["id"], paragraph_array(F.col("html"), tag, cls), "p", pos="pos")
    return rows.select("id", "pos", "p.text", "p.bold", "p.centred")


def document_paragraphs(pages: DataFrame, tag: str = "div", cls: str | None = "text_wrapper") -> DataFrame:
    """pages(id, html) -> (id, paras): the document's own paragraphs with heading flags."""
    found = pages.select("id", paragraph_array(F.col("html"), tag, cls).alias("paras"))
    marked = found.select("id", mark_headings(F.col("paras")).alias("paras"))
    return drop_tail(one_copy(marked))


def page_texts(pages: DataFrame, tag: str = "div", cls: str | None = "text_wrapper") -> DataFrame:
    """pages(id, html) -> (id, text): paragraphs set apart by blank lines, headings marked."""

    def line(p: Column) -> Column:
        mark = F.when(p["heading"], HEADING_MARK).otherwise("")
        return F.concat(mark, strip_marks(p["text"]))

    kept = document_paragraphs(pages, tag, cls)
    return kept.select("id", F.array_join(F.transform("paras", line), "\n\n").alias("text"))


def pdf_link(html: Column, base: str = texts.REGISTRY_BASE_URL) -> Column:
    """Absolute address of the first linked PDF, null when the page links none."""
    href = matched(
        html, r"""(?i)<a\s[^>]*?\bhref\s*=\s*["']?([^"'\s>]*\.pdf(?:[?#][^"'\s>]*)?)(?=["'\s>])""", 1
    )
    return absolute_url(F.replace(href, F.lit("&amp;"), F.lit("&")), base)


def choose_source(*ranked: DataFrame) -> DataFrame:
    """One text per id from sources given best first, each (id, source, text) with unique ids.

    A source only fills the ids no better one has, so the texts of the best source never move.
    """
    best = ranked[0]
    taken = best.select("id")
    for df in ranked[1:]:
        best = best.unionByName(df.join(taken, "id", "left_anti"))
        taken = taken.unionByName(df.select("id"))
    return best.select("id", "source", "text")
