"""Scalar column functions, all built from expressions Spark evaluates in the JVM."""

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexspan import texts

# Every blank character of Unicode.
BLANKS = (
    " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

TOKEN_PATTERN = r"[0-9]+|\p{L}+"


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with `value` evaluated once however often `use` refers to it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def after_first(parts: Column) -> Column:
    """All elements of an array but the first."""
    return F.filter(parts, lambda _, i: i > 0)


def strip(c: Column) -> Column:
    """Trim any Unicode blank from both ends."""
    return F.trim(c, F.lit(BLANKS))


def matched(c: Column, pattern: str, group: int) -> Column:
    """Group of the first match, null when the pattern does not match."""
    return F.when(c.rlike(pattern), F.regexp_extract(c, pattern, group))


def eq_ci(a: Column, b: Column) -> Column:
    return F.lower(a) == F.lower(b)


def contains_ci(haystack: Column, fragment: Column) -> Column:
    """Literal, case-insensitive substring test; `%` and `_` mean themselves."""
    return F.contains(F.lower(haystack), F.lower(fragment))


def snippet(text: Column) -> Column:
    return F.substring(text, 1, texts.SNIPPET_CHARS)


def ru_date(d: Column) -> Column:
    return F.date_format(d, "dd.MM.yyyy")


def order_ref(order_date: Column, order_no: Column) -> Column:
    return F.format_string(texts.MSG_ORDER_REF, ru_date(order_date), order_no)


def word_count(c: Column) -> Column:
    """Number of blank-separated words."""
    return F.regexp_count(c, F.lit(r"(?U)\S+"))


def normalise_breaks(text: Column) -> Column:
    """Join hyphenated line breaks, turn single line breaks into blanks, collapse blanks."""
    joined = F.regexp_replace(text, r"(?U)(\w)-\n(\w)", "$1$2")
    joined = F.regexp_replace(joined, r"(?<!\n)\n(?!\n)", " ")
    return strip(F.regexp_replace(joined, r"[ \t]{2,}", " "))


def tokens(text: Column) -> Column:
    """Lower-case tokens in text order; digits and letters never share a token."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN_PATTERN), F.lit(0))


def parse_on_date(value: Column, today: Column | None = None) -> tuple[Column, Column]:
    """(date, error) of an ISO date parameter, with hyphens or without; a missing parameter means today."""
    default = F.current_date() if today is None else today
    iso = F.when(value.rlike(r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}\z"), F.try_to_date(value, "yyyy-MM-dd"))
    iso = iso.when(value.rlike(r"\A[0-9]{8}\z"), F.try_to_date(value, "yyyyMMdd"))
    on_date = F.when(value.isNull(), default).otherwise(iso)
    error = F.when(value.isNotNull() & iso.isNull(), F.format_string(texts.MSG_BAD_DATE, value))
    return on_date, error


# --- registry cells -----------------------------------------------------------------------------

# How dates are written in the registry's cells.
_FULL_DATE = r"([0-9]{2})\.([0-9]{2})\.([0-9]{4})"
_WORD_DATE = r"(?iuU)([0-9]{1,2})\s+(" + "|".join(texts.MONTHS) + r")\s+([0-9]{4})"
_YEAR_ONLY = r"(?iuU)за\s*([0-9]{4})\s*г"
_EXPIRY = r"(?iuU)утрачивает силу(?:\s*с)?\s*([0-9]{2}\.[0-9]{2}\.[0-9]{4})"
_EXPIRY_CLAUSE = r"(?ius)утрачивает силу.*\z"


def normalise_year(number: Column) -> Column:
    """Year behind the slash of a number; two digits from 90 on belong to the last century."""
    suffix = F.split_part(number, F.lit("/"), F.lit(2))
    value = suffix.try_cast("int")
    century = F.when(value >= 90, 1900 + value).otherwise(2000 + value)
    return F.when(F.length(suffix) == 4, value).otherwise(century)


def make_id(kind: Column, number: Column) -> Column:
    prefix = F.when(kind == texts.KINDS[0], "fsbu").otherwise("pbu")
    return F.concat(prefix, F.lit("-"), F.replace(number, F.lit("/"), F.lit("-")))


def parse_effective_from(text: Column) -> Column:
    """Start date in a free-text cell, null when none can be read.

    A numeric date wins over a date in words, which wins over "for year N"; the expiry phrase
    is ignored.
    """
    return bind(F.regexp_replace(text, _EXPIRY_CLAUSE, ""), _effective_from)


def _effective_from(t: Column) -> Column:
    month_name = F.lower(F.regexp_extract(t, _WORD_DATE, 2))
    month_no = F.lpad(F.array_position(F.lit(texts.MONTHS), month_name).cast("string"), 2, "0")
    words = F.concat_ws(
        "-",
        F.regexp_extract(t, _WORD_DATE, 3),
        month_no,
        F.lpad(F.regexp_extract(t, _WORD_DATE, 1), 2, "0"),
    )
    first_day = F.concat(F.regexp_extract(t, _YEAR_ONLY, 1), F.lit("-01-01"))
    return (
        F.when(t.rlike(_FULL_DATE), F.try_to_date(F.regexp_extract(t, _FULL_DATE, 0), "dd.MM.yyyy"))
        .when(t.rlike(_WORD_DATE), F.try_to_date(words, "yyyy-MM-dd"))
        .when(t.rlike(_YEAR_ONLY), F.try_to_date(first_day, "yyyy-MM-dd"))
    )


def parse_effective_to(text: Column) -> Column:
    """Expiry date after the expiry phrase, null when there is none."""
    return F.try_to_date(matched(text, _EXPIRY, 1), "dd.MM.yyyy")


def absolute_url(href: Column, base: str = texts.REGISTRY_BASE_URL) -> Column:
    return bind(
        href,
        lambda h: F.when(h.rlike(r"(?i)\A[a-z][a-z0-9+.-]*:"), h)
        .when(F.startswith(h, F.lit("//")), F.concat(F.lit("https:"), h))
        .when(F.startswith(h, F.lit("/")), F.concat(F.lit(base), h))
        .otherwise(F.concat(F.lit(base + "/"), h)),
    )


def form_encode(value: Column) -> Column:
    """Percent-encode one form value; `~` stays literal and `*` is encoded."""
    encoded = F.url_encode(value)
    return F.replace(F.replace(encoded, F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
