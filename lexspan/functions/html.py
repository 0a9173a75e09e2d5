"""HTML fragments to text with column expressions."""

from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexspan.functions.columns import bind, strip

# All named character references, from the standard library's table.
ENTITIES = {name[:-1]: value for name, value in html5.items() if name.endswith(";")}

_REFERENCE = r"&(?:#([0-9]{1,7})|#[xX]([0-9a-fA-F]{1,6})|([A-Za-z][A-Za-z0-9]{1,31}));"


def _named() -> Column:
    return F.create_map(*[F.lit(x) for pair in ENTITIES.items() for x in pair])


def _decoded(piece: Column) -> Column:
    """A piece of text with the reference it starts with, if any, replaced."""
    decimal = F.regexp_extract(piece, r"\A" + _REFERENCE, 1)
    hexadecimal = F.regexp_extract(piece, r"\A" + _REFERENCE, 2)
    name = F.regexp_extract(piece, r"\A" + _REFERENCE, 3)
    code = F.when(hexadecimal != "", hexadecimal).when(decimal != "", F.conv(decimal, 10, 16))
    char = F.coalesce(
        F.decode(F.unhex(F.lpad(code, 8, "0")), "UTF-32"), F.try_element_at(_named(), name)
    )
    whole = F.regexp_extract(piece, r"\A" + _REFERENCE, 0)
    rest = F.substr(piece, F.length(whole) + 1)
    replaced = F.when(char.isNotNull(), F.concat(char, rest)).otherwise(piece)
    return F.when(F.startswith(piece, F.lit("&")), replaced).otherwise(piece)


def decode_entities(c: Column) -> Column:
    """Replace character references, each once; text without `&` is passed through untouched."""

    def decoded(text: Column) -> Column:
        pieces = F.transform(F.split(text, "(?=" + _REFERENCE + ")"), _decoded)
        return F.when(F.contains(text, F.lit("&")), F.array_join(pieces, "")).otherwise(text)

    return bind(c, decoded)


def drop_invisible(html: Column) -> Column:
    """Take out script and style elements and comments; what they separated stays separated."""
    visible = F.regexp_replace(html, r"(?is)<(script|style)\b[^>]*>.*?(?:</\1\s*>|\z)", "<!>")
    return F.regexp_replace(visible, r"(?s)<!--.*?(?:-->|\z)", "<!>")


# Stands for a tag while a fragment is read; a private-use character.
_TAG = "\ue002"


def node_text(html: Column) -> Column:
    """Text nodes, each trimmed, empty ones dropped, joined by one blank."""
    # Tags become a mark first, so that entities are decoded once per text and not per node.
    text = decode_entities(F.regexp_replace(html, r"<[^>]*>", _TAG))
    nodes = F.transform(F.split(text, _TAG), strip)
    return F.array_join(F.filter(nodes, lambda n: n != ""), " ")


def element_body(html: Column, tag: str, cls: str | None = None) -> Column:
    """Inner HTML of the first `tag` (carrying class `cls`), up to its own closing tag."""
    attrs = (
        rf"""\bclass\s*=\s*(?:"[^"]*(?<![\w-]){cls}(?![\w-])[^"]*"|'[^']*(?<![\w-]){cls}(?![\w-])[^']*'"""
        rf"""|{cls}(?![\w-]))[^>]*"""
        if cls
        else "[^>]*"
    )
    opener = rf"(?is)<{tag}(?![\w-])[^>]*?{attrs}>" if cls else rf"(?is)<{tag}(?![\w-]){attrs}>"
    rest = F.regexp_extract(html, opener + r"(.*)\z", 1)
    pieces = F.split(rest, rf"(?i)(?=</?{tag}(?![\w-]))")

    def step(acc: Column, piece: Column) -> Column:
        closes = piece.rlike(rf"(?i)\A</{tag}(?![\w-])")
        opens = piece.rlike(rf"(?i)\A<{tag}(?![\w-])")
        depth = acc["depth"] + F.when(opens, 1).when(closes, -1).otherwise(0)
        return F.when(acc["depth"] == 0, acc).otherwise(
            F.struct(
                depth.alias("depth"),
                (acc["kept"] + F.when(depth > 0, 1).otherwise(0)).alias("kept"),
            )
        )

    start = F.struct(F.lit(1).alias("depth"), F.lit(0).alias("kept"))

    def inside(found: Column) -> Column:
        kept = F.aggregate(found, start, step)["kept"]
        return F.array_join(F.slice(found, F.lit(1), kept), "")

    return bind(pieces, inside)
