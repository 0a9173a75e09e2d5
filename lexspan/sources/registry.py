"""Scraped registry pages and act payloads -> typed tables, and request addresses."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexspan import texts
from lexspan.functions.columns import (
    absolute_url, after_first, form_encode, make_id, normalise_year, parse_effective_from, parse_effective_to,
    ru_date, strip,
)
from lexspan.functions.scale import each
from lexspan.functions.html import decode_entities, drop_invisible, node_text

# How a registry row names a standard and its order.
TITLE = r"""(?U)(ФСБУ|ПБУ)\s*(\d+/\d+)\s*[«"']([^»"']+)[»"']"""
ORDER = r"(?U)([0-9]{2}\.[0-9]{2}\.[0-9]{4})[^\n]*?№\s*(\S+)"


def parse_registry(pages: DataFrame) -> DataFrame:
    """pages(source_url, html) -> one row per registry entry, with `error` where it is incomplete.

    Rows of fewer than three cells, without a title or without an order are no entries.
    """
    pieces = after_first(F.split(drop_invisible(F.col("html")), r"(?i)<tr(?=[\s>])"))

    def cells_of(piece: Column) -> Column:
        row = F.regexp_replace(piece, r"(?is)</(?:tr|table|tbody)\s*>.*\z", "")
        tds = F.transform(
            after_first(F.split(row, r"(?i)<td(?=[\s>])")),
            lambda td: F.regexp_replace(F.regexp_replace(td, r"\A[^>]*>", ""), r"(?is)</td\s*>.*\z", ""),
        )
        return F.transform(tds, lambda td: F.struct(td.alias("html"), node_text(td).alias("text")))

    # Rows are judged inside the array: a filter after the explode would be pushed down and read
    # every cell again.
    def is_entry(tds: Column) -> Column:
        line = F.array_join(F.transform(tds, lambda td: td["text"]), " ")
        return (F.size(tds) >= 3) & line.rlike(TITLE) & F.exists(tds, lambda td: td["text"].rlike(ORDER))

    rows = F.filter(F.transform(pieces, cells_of), is_entry)
    entries = (
        each(pages, ["source_url"], rows, "tds")
        .withColumn("cells", F.transform("tds", lambda td: td["text"]))
        .withColumn("joined", F.array_join("cells", " "))
        .withColumn("order_cell", F.get(F.filter("cells", lambda c: c.rlike(ORDER)), F.lit(0)))
    )
    titled = F.array_position(F.transform("cells", lambda c: c.rlike(TITLE)), F.lit(True))
    title_td = F.get("tds", titled - 1)["html"]
    href = F.regexp_extract(title_td, r"""(?is)<a\s[^>]*?\bhref\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", 1)
    href = decode_entities(strip(F.regexp_replace(href, r"""\A["']|["']\z""", "")))
    entries = entries.withColumn("href", href)
    kind, number = F.regexp_extract("joined", TITLE, 1), F.regexp_extract("joined", TITLE, 2)
    typed = entries.select(
        make_id(kind, number).alias("id"),
        kind.alias("kind"),
        number.alias("number"),
        normalise_year(number).alias("year"),
        strip(F.regexp_extract("joined", TITLE, 3)).alias("title"),
        F.try_to_date(F.regexp_extract("order_cell", ORDER, 1), "dd.MM.yyyy").alias("order_date"),
        F.regexp_replace(F.regexp_extract("order_cell", ORDER, 2), r"\A[.,;]+|[.,;]+\z", "").alias("order_no"),
        parse_effective_from(F.element_at("cells", -1)).alias("effective_from"),
        parse_effective_to(F.col("joined")).alias("effective_to"),
        "source_url",
        F.when(F.col("href") != "", absolute_url(F.col("href"))).alias("document_url"),
    )
    error = F.concat_ws(
        "; ",
        F.when(F.col("order_date").isNull(), "bad order date"),
        F.when(F.col("effective_from").isNull(), "no effective date"),
        F.when(F.col("document_url").isNull(), "no document link"),
    )
    return typed.withColumn("error", F.nullif(error, F.lit("")))


def parse_acts(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """Payload rows -> (..., eo_number, title, pdf_url); malformed payloads give no rows.

    A payload is an object with `items` or a bare array; field names come in several spellings.
    """
    keep = [c for c in payloads.columns if c != payload]
    value = F.try_parse_json(F.col(payload))
    parsed = payloads.select(*keep, value.alias("_v"))
    items = F.coalesce(
        F.try_variant_get("_v", "$.items", "array<variant>"),
        F.try_variant_get("_v", "$", "array<variant>"),
    )
    item = each(parsed, keep, items, "_i")

    def first(*names: str):
        found = [F.nullif(F.try_variant_get("_i", f"$.{n}", "string"), F.lit("")) for n in names]
        return F.coalesce(*found)

    acts = item.select(
        *keep, first("eoNumber", "EoNumber").alias("eo_number"),
        first("complexName", "name", "Name").alias("title"),
    ).where("eo_number IS NOT NULL AND title IS NOT NULL")
    address = F.concat(F.lit(f"{texts.ACTS_BASE_URL}/file/pdf?eoNumber="), "eo_number")
    return acts.withColumn("pdf_url", address)


def search_urls(orders: DataFrame) -> DataFrame:
    """orders(order_date, order_no, ...) -> adds the address that finds exactly that order."""
    day = form_encode(ru_date(F.col("order_date")))
    query = F.concat_ws(
        "&",
        F.concat(F.lit("Number="), form_encode(F.col("order_no"))),
        F.lit("NumberSearchType=0"),
        F.concat(F.lit("DocumentDateFrom="), day),
        F.concat(F.lit("DocumentDateTo="), day),
        F.lit("PageSize=30"),
        F.lit("Index=1"),
    )
    return orders.withColumn("url", F.concat(F.lit(f"{texts.ACTS_BASE_URL}/api/Documents?"), query))
