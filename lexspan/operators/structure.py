"""Document text -> numbered clauses and lettered subclauses.

A document arrives as one row. It is hashed to a task once, as a whole; every later window and
the final grouping use that same partitioning, so a document costs a single shuffle and no group
is larger than one document.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexspan import texts
from lexspan.functions.columns import normalise_breaks, strip, word_count
from lexspan.functions.scale import each
from lexspan.operators.extract import EDITORIAL_NOTE, HEADING_MARK

# Shapes of the text's own markers.
PAGE_FURNITURE = r"(?md)^\[\[PAGE [0-9]+\]\][ \t]*\n(?:[0-9]{1,4}[ \t]*\n)?"
DECIMAL_CLAUSE = r"(?U)\A([0-9]+\.[0-9]+)\.?\s*"
PLAIN_CLAUSE = r"(?U)\A([0-9]+)\.\s*"
SUBCLAUSE = r"(?U)\A([а-я])\)\s*"
DIGIT_SUBCLAUSE = r"(?U)\A([36])\)\s*"
SECTION = r"(?Ud)\A([^\s.]{1,6})\s*\.\s+([^\n]+)\z"
TRAILING_NOTE = r"(?iuU)\s*\([^()]*(?:в\s+ред\.\s+приказ|введен\w*\s+приказ)[^()]*\)\s*\z"
ANNEX_TITLE = (
    r"(?:ФЕДЕРАЛЬНЫЙ(?U:\s+)СТАНДАРТ(?U:\s+)БУХГАЛТЕРСКОГО(?U:\s+)УЧЕТА[ \t]*\n[ \t]*)?"
    r"(?:ФСБУ|ПБУ)[ \t]*([0-9]+[ \t]*/[ \t]*[0-9]+)[ \t]*"
)
_ANNEX = r"(?md)^" + ANNEX_TITLE + r"""[«"'][^»"'\n]*[»"'][ \t]*(?=\n[ \t]*\n|\z)"""
# A digit read in place of a letter: digit, the letter it stands for, the letter that must precede.
DIGIT_LETTERS = [("6", "б", "а"), ("3", "з", "ж")]

_BREAK = "\ue001"


def slice_annex(df: DataFrame, text: str = "text", number: str = "number") -> DataFrame:
    """Cut the annex of standard `number` out of a text that carries several.

    Adds `outcome` (`unchanged`, `sliced`, `not_found`) and `error`; `text` becomes the slice, or
    null when the wanted annex is not there.
    """
    pieces = F.split(F.regexp_replace(F.col(text), _ANNEX, _BREAK + "$0"), _BREAK)
    annexes = F.transform(
        F.slice(F.col("_pieces"), F.lit(2), F.greatest(F.size("_pieces") - 1, F.lit(0))),
        lambda p: F.struct(
            F.regexp_replace(F.regexp_extract(p, r"\A" + ANNEX_TITLE, 1), r"(?U)\s+", "").alias("no"),
            p.alias("body"),
        ),
    )
    target = F.regexp_replace(F.col(number), r"(?U)\s+", "")
    wanted = F.filter(F.col("_annexes"), lambda a: a["no"] == target)
    found = F.array_join(
        F.array_sort(F.array_distinct(F.transform("_annexes", lambda a: a["no"]))), ", "
    )
    none = F.size("_annexes") == 0
    hit = F.get(wanted, F.lit(0))["body"]
    return (
        df.withColumn("_pieces", pieces)
        .withColumn("_annexes", annexes)
        .withColumn("_hit", hit)
        .withColumn(
            "outcome",
            F.when(none, "unchanged").when(F.col("_hit").isNotNull(), "sliced").otherwise("not_found"),
        )
        .withColumn(
            "error",
            F.when(
                F.col("outcome") == "not_found",
                F.format_string(texts.MSG_NO_ANNEX, F.col(number), found),
            ),
        )
        .withColumn(text, F.when(none, F.col(text)).otherwise(F.col("_hit")))
        .drop("_pieces", "_annexes", "_hit")
    )


def blocks(docs: DataFrame) -> DataFrame:
    """docs(doc, text) -> (doc, pos, block): page marks out, split on blank lines."""
    clean = F.regexp_replace("text", PAGE_FURNITURE, "")
    placed = docs.select("doc", "text").repartition("doc")
    split = each(placed, ["doc"], F.split(clean, r"(?U)\n\s*\n"), "raw", pos="pos")
    filled = split.where(F.col("raw").rlike(r"(?U)\S"))
    return filled.select("doc", "pos", strip(F.col("raw")).alias("block"))


def classify(rows: DataFrame) -> DataFrame:
    """blocks(doc, pos, block) -> adds kind, heading, number, major, minor, letter, body, note.

    Kinds: H heading, U heading without a number, C numbered clause, S lettered subclause,
    D digit that may stand for a letter, T running text.
    """
    block = F.col("block")
    marked = F.startswith(block, F.lit(HEADING_MARK))
    line, body, title = F.col("_line"), F.col("body"), F.col("_title")
    # A heading's own title loses a trailing editorial note.
    without_note = strip(F.regexp_replace(title, TRAILING_NOTE, ""))
    sectioned = F.col("_marker") != ""
    plain = (
        sectioned
        & (~F.col("_marker").rlike(r"(?U)\A\d+\z") | (F.col("_marker") == "1"))
        & ~title.rlike(r"[.,;:]\z")
        & (word_count(title) <= texts.HEADING_MAX_WORDS)
    )
    number = F.when(
        body.rlike(DECIMAL_CLAUSE), F.regexp_extract(body, DECIMAL_CLAUSE, 1)
    ).otherwise(F.regexp_extract(body, PLAIN_CLAUSE, 1))
    kind = (
        F.when(marked & sectioned, "H")
        .when(marked, "U")
        .when(plain, "H")
        .when(body.rlike(SUBCLAUSE), "S")
        .when(body.rlike(DIGIT_SUBCLAUSE), "D")
        .when(number != "", "C")
        .otherwise("T")
    )
    k = F.col("kind")
    heading = F.when(k == "U", strip(F.regexp_replace(line, TRAILING_NOTE, ""))).when(k == "H", title)
    digits = F.col("number")
    opened = (
        F.when(k == "S", F.regexp_replace(body, SUBCLAUSE, ""))
        .when(k == "D", F.regexp_replace(body, DIGIT_SUBCLAUSE, ""))
        .when((k == "C") & body.rlike(DECIMAL_CLAUSE), F.regexp_replace(body, DECIMAL_CLAUSE, ""))
        .when(k == "C", F.regexp_replace(body, PLAIN_CLAUSE, ""))
    )
    return (
        rows.withColumn("_line", F.when(marked, strip(F.substr(block, F.lit(2)))).otherwise(block))
        .withColumn("body", normalise_breaks(block))
        .withColumn("_marker", F.regexp_extract("_line", SECTION, 1))
        .withColumn("_title", strip(F.regexp_extract("_line", SECTION, 2)))
        .withColumn("_title", without_note)
        .withColumn("kind", kind)
        .withColumn("heading", heading)
        .withColumn("number", F.when(k == "C", number))
        .withColumn("major", F.split_part(digits, F.lit("."), F.lit(1)).try_cast("decimal(38,0)"))
        .withColumn(
            "minor",
            F.when(F.contains(digits, F.lit(".")), F.split_part(digits, F.lit("."), F.lit(2)))
            .when(digits.isNotNull(), "0")
            .try_cast("decimal(38,0)"),
        )
        .withColumn(
            "letter",
            F.when(k == "S", F.regexp_extract(body, SUBCLAUSE, 1)).when(
                k == "D", F.regexp_extract(body, DIGIT_SUBCLAUSE, 1)
            ),
        )
        .withColumn("opened", opened)
        .withColumn("note", (k == "T") & body.rlike(EDITORIAL_NOTE))
        .drop("block", "_line", "_marker", "_title")
    )


def _before():
    return Window.partitionBy("doc").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)


def _so_far():
    return Window.partitionBy("doc").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)


def _after():
    """Looking ahead on the reversed order: a frame that only grows costs one pass."""
    backwards = Window.partitionBy("doc").orderBy(F.desc("pos"))
    return backwards.rowsBetween(Window.unboundedPreceding, -1)


def _last(c: Column, window) -> Column:
    return F.last(c, ignorenulls=True).over(window)


def sequence(rows: DataFrame) -> DataFrame:
    """Add who opens what: accepted clauses, discarded runs, valid subclauses.

    `acc` marks an accepted clause, `flag` is 0 at a heading or accepted clause and 1 at a clause
    number that does not rise, `disc` marks rows of a discarded run, `sub` holds the letter of a
    valid subclause.
    """
    kind = F.col("kind")
    key = F.when(kind == "C", F.struct("major", "minor"))
    out = rows.withColumn("_top", F.max(key).over(_before())).withColumn(
        "acc", (kind == "C") & (F.col("_top").isNull() | (F.struct("major", "minor") > F.col("_top")))
    )
    out = out.withColumn("begun", F.coalesce(F.max("acc").over(_before()), F.lit(False)))
    out = out.where("kind != 'U' OR begun")
    out = out.withColumn(
        "flag", F.when(kind.isin("H", "U") | F.col("acc"), 0).when(kind == "C", 1)
    )
    out = out.withColumn("disc", F.coalesce(_last(F.col("flag"), _before()), F.lit(0)) == 1)
    live = ~F.col("disc") & F.col("begun")
    literal = (kind == "S") & live
    opens_run = F.col("acc") | literal
    out = out.withColumn(
        "_prev", _last(F.when(F.col("acc"), "").when(literal, F.col("letter")), _before())
    )
    stands_for = F.when(F.lit(False), "")
    fits = F.lit(False)
    for digit, letter, previous in DIGIT_LETTERS:
        stands_for = stands_for.when(F.col("letter") == digit, letter)
        fits = fits | ((F.col("letter") == digit) & (F.col("_prev") == previous))
    # Only the first fitting digit of a run counts: compare the running count with its value at
    # the start of the run.
    out = out.withColumn("_fits", F.coalesce((kind == "D") & live & fits, F.lit(False)))
    out = out.withColumn("_seen", F.coalesce(F.sum(F.col("_fits").cast("int")).over(_before()), F.lit(0)))
    out = out.withColumn("_seen0", _last(F.when(opens_run, F.col("_seen")), _before()))
    first_fit = F.col("_fits") & (F.col("_seen") == F.col("_seen0"))
    return out.withColumn(
        "sub", F.when(literal, F.col("letter")).when(first_fit, stands_for)
    ).drop("_top", "_prev", "_fits", "_seen", "_seen0")


def assemble(rows: DataFrame) -> DataFrame:
    """Sequenced blocks -> (doc, pos, path, parent_path, heading, text)."""
    opens = F.col("acc") | F.col("sub").isNotNull()
    flushes = F.col("flag").isNotNull()
    out = (
        rows.withColumn("opens", opens)
        .withColumn("entity", _last(F.when(opens, F.col("pos")), _so_far()))
        .withColumn("in_sub", _last(F.when(opens, F.col("sub").isNotNull()), _so_far()))
        .withColumn("clause", _last(F.when(F.col("acc"), F.col("number")), _so_far()))
        .withColumn("seg", F.coalesce(F.sum(flushes.cast("int")).over(_before()), F.lit(0)))
        .withColumn("heading", _last(F.when(F.col("flag") == 0, F.col("heading")), _before()))
        .withColumn(
            "next",
            F.coalesce(
                _last(F.when(flushes, "F").when(F.col("sub").isNotNull(), "S"), _after()), F.lit("F")
            ),
        )
    )
    # A digit that did not turn out to be a letter is running text.
    text = F.col("kind").isin("T", "D") & F.col("sub").isNull() & ~F.col("disc")
    out = out.where(F.col("opens") | (text & F.col("entity").isNotNull()))
    closing = ~F.col("opens") & F.col("in_sub") & (F.col("next") == "F")
    out = out.where(~closing | ~F.col("note")).withColumn("closing", closing)
    out = out.withColumn(
        "_concluded", _last(F.when(F.col("closing"), F.struct("entity", "seg")), _before())
    )
    same = F.col("_concluded.entity") == F.col("entity")
    part = (
        F.when(F.col("closing"), F.col("seg"))
        .when(~F.col("opens") & F.col("in_sub") & same, F.col("_concluded.seg"))
        .otherwise(-1)
    )
    piece = F.when(F.col("opens"), F.col("opened")).otherwise(F.col("body"))
    grouped = (
        out.withColumn("part", part)
        .groupBy("doc", "entity", "part")
        .agg(
            F.min("pos").cast("int").alias("pos"),
            F.max("clause").alias("clause"),
            F.max("sub").alias("sub"),
            F.max("in_sub").alias("in_sub"),
            F.max(F.when(F.col("acc"), F.col("heading"))).alias("heading"),
            F.collect_list(F.struct("pos", piece.alias("s"))).alias("pieces"),
        )
    )
    pieces = F.filter(
        F.transform(F.array_sort("pieces"), lambda x: x["s"]), lambda s: s != ""
    )
    concluded = F.col("part") >= 0
    path = (
        F.when(concluded, F.concat_ws(".", "clause", F.lit(texts.CONCLUSION)))
        .when(F.col("in_sub"), F.concat_ws(".", "clause", "sub"))
        .otherwise(F.col("clause"))
    )
    return grouped.select(
        "doc",
        "pos",
        path.alias("path"),
        F.when(F.col("in_sub"), F.col("clause")).alias("parent_path"),
        F.when(~F.col("in_sub"), F.col("heading")).alias("heading"),
        strip(F.array_join(pieces, " ")).alias("text"),
    )


def parse_clauses(docs: DataFrame) -> DataFrame:
    """docs(doc, text) -> (doc, pos, path, parent_path, heading, text)."""
    return assemble(sequence(classify(blocks(docs))))


def looks_complete(clauses: DataFrame, least: int = texts.MIN_TOP_LEVEL_CLAUSES) -> DataFrame:
    """(doc, top_level, complete): whether enough distinct top-level clauses were found."""
    top = F.countDistinct(F.when(F.col("parent_path").isNull(), F.col("path")))
    return clauses.groupBy("doc").agg(top.alias("top_level")).withColumn(
        "complete", F.col("top_level") >= least
    )


def lost_paragraphs(docs: DataFrame, clauses: DataFrame) -> DataFrame:
    """Paragraphs found in no clause of their document, documented drops left out.

    Both sides are brought back to one row per document, so no text is repeated per paragraph.
    """
    seq = sequence(classify(blocks(docs)))
    opener = F.col("kind") == "C"
    kept = seq.where(
        F.col("kind").isin("S", "D", "T", "C")
        & (F.col("begun") | F.col("acc"))
        & (F.col("acc") | (~opener & ~F.col("disc")))
    )
    said = F.when(opener, F.col("opened")).otherwise(F.col("body"))
    candidate = F.when(
        said.rlike(SUBCLAUSE), F.regexp_replace(said, SUBCLAUSE, "")
    ).otherwise(F.regexp_replace(said, DIGIT_SUBCLAUSE, ""))
    listed = (
        kept.where(~strip(said).rlike(EDITORIAL_NOTE))
        .select("doc", "pos", strip(candidate).alias("text"))
        .where("text != ''")
        .groupBy("doc")
        .agg(F.collect_list(F.struct("pos", "text")).alias("paras"))
    )
    hay = clauses.groupBy("doc").agg(
        F.array_sort(F.collect_list(F.struct("pos", F.concat_ws(" ", "text", "heading").alias("said")))).alias("pieces")
    )
    joined = listed.join(hay, "doc", "left").withColumn(
        "hay", F.coalesce(F.array_join("pieces.said", " "), F.lit(""))
    )
    missing = F.filter("paras", lambda p: ~F.contains(F.col("hay"), p["text"]))
    return each(joined, ["doc"], missing, "p").select("doc", "p.pos", "p.text")
