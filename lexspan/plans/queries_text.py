"""Registered queries over pages and texts: extraction, structuring, scraped fields."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexspan import texts
from lexspan.functions import columns as C
from lexspan.functions.html import element_body
from lexspan.operators import extract, structure, temporal
from lexspan.plans.binding import TODAY, Binding
from lexspan.plans.queries import query
from lexspan.sources import publish, registry

# --- pages --------------------------------------------------------------------------------------

_BODY = "regexp_extract(html, '(?is)<article[^>]*>(.*)</article>', 1)"


def _pieces(html: str) -> str:
    return f"""list_transform((string_split(regexp_replace({html}, '(?i)<p([\\s>/])', chr(1) || '\\1', 'g'), chr(1)))[2:],
      lambda x: regexp_replace(regexp_replace(x, '^[^>]*>', ''), '(?is)(</p\\s*>|</?(article|div|footer|h[1-6]|ul|li|nav)[^a-z0-9-]).*$', ''))"""


def _tags(html: str) -> str:
    """Attributes of the paragraphs that `_pieces` gives."""
    return f"""list_transform((string_split(regexp_replace({html}, '(?i)<p([\\s>/])', chr(1) || '\\1', 'g'), chr(1)))[2:], lambda x: regexp_extract(x, '^[^>]*', 0))"""


def _node(x: str) -> str:
    """Text nodes of a fragment, trimmed and joined."""
    decoded = f"replace(replace(replace({x}, '&quot;', '\"'), '&middot;', '·'), '&amp;', '&')"
    split = f"string_split(regexp_replace({x}, '<[^>]*>', chr(2), 'g'), chr(2))"
    node = decoded.replace(x, "n", 1)
    return f"""array_to_string(list_filter(list_transform({split}, lambda n: regexp_replace({node}, '^\\s+|\\s+$', '', 'g')), lambda n: n <> ''), ' ')"""


_PARAS = f""",
cut AS (SELECT page_id, url, {_pieces('body')} AS ps, {_tags('body')} AS tags FROM source_pages),
raw_paras AS (SELECT page_id, url, unnest(ps) AS html, replace(lower(unnest(tags)), ' ', '') AS tag, generate_subscripts(ps, 1) AS i FROM cut),
node_paras AS (SELECT page_id, url, i, html, tag, {_node('html')} AS raw,
    regexp_extract_all(html, '(?is)<(strong|b)(\\s[^>]*)?>(.*?)(</(strong|b)\\s*>|$)', 3) AS bolds FROM raw_paras),
flag_paras AS (
  SELECT page_id, url, i, tag, regexp_replace(regexp_replace(trim(regexp_replace(raw, '[ \\t]+', ' ', 'g')),
      '^(\\d+)\\s+(\\d+)\\s*\\.', '\\1.\\2.'), '^([IVXLCDM]+)\\s+(\\d+)\\s*\\.', '\\1\\2.') AS text,
    len(bolds) > 0 AND raw <> '' AND raw = {_node("array_to_string(bolds, ' <x> ')")} AS bold
  FROM node_paras),
placed_paras AS (
  SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS pos,
    NOT bold AND regexp_matches(tag, 'align=["'']?center|text-align:center') AS centred
  FROM flag_paras WHERE text <> ''),
paras AS (
  SELECT page_id, url, pos, text, bold,
    bold OR (centred AND NOT coalesce(lag(centred) OVER w, false) AND NOT coalesce(lead(centred) OVER w, false)
      AND NOT regexp_matches(text, '(?i)руб\\.|%|=') AND NOT regexp_matches(regexp_replace(text, '^[^\\s.]{{1,6}}\\.\\s*', ''), '\\d')) AS heading
  FROM placed_paras WINDOW w AS (PARTITION BY page_id ORDER BY pos))"""

_PLAIN_PAGES = f""",
source_pages AS (SELECT page_id, url, {_BODY} AS body FROM pages)""" + _PARAS


def _pages(b: Binding) -> DataFrame:
    return b.read("pages").select(F.col("page_id").alias("id"), "html")


@query("SELECT page_id AS id, CAST(pos AS INTEGER) AS pos, text FROM paras", _PLAIN_PAGES)
def paragraphs(b: Binding) -> DataFrame:
    return extract.paragraph_rows(_pages(b), "article", None).select("id", "pos", "text")


@query("SELECT page_id AS id, CAST(pos AS INTEGER) AS pos, text FROM paras WHERE bold", _PLAIN_PAGES)
def bold_headings(b: Binding) -> DataFrame:
    found = extract.paragraph_rows(_pages(b), "article", None)
    return found.where("bold").select("id", "pos", "text")


# Lines in the middle: headings where they stand alone, also beside a bold one; not beside each other, nor what shows a sum.
_CENTRED = (
    '<p align="center">Раздел посередине</p><p>between</p>'
    '<p style="Text-Align: center">Первая строка</p><p style="text-align:center">Вторая строка</p><p>between</p>'
    '<p align=center>Итого сто руб.</p><p>between</p><p align="center"><b>Жирная строка</b></p><p align="center">IV. Рядом с жирной</p><p>between</p>'
)

# Every page gets an annex marker, centred lines and footnotes; some get a second copy or an appendix.
_MARKED_PAGES = f""",
source_pages AS (
  SELECT page_id, url, '<p>Приложение № 1 к приказу</p>' || body || '{_CENTRED}'
    || CASE WHEN contains(url, '#') THEN '<p>ПОЛОЖЕНИЕ ПО БУХГАЛТЕРСКОМУ УЧЕТУ</p><p>Name</p><p>(утверждено приказом)</p>' || body ELSE '' END
    || CASE WHEN contains(url, '?') THEN '<p>Приложение № 2</p><p>к Положению</p><p>1. Example</p>' ELSE '' END
    || '<p>Text[7] with a mark [8].</p><p>[1] First note.</p><p>[2] Second note.</p>' AS body
  FROM (SELECT page_id, url, {_BODY} AS body FROM pages))""" + _PARAS + """,
marks AS (
  SELECT *, CASE WHEN regexp_matches(text, '(?i)^\\(?\\s*(?:утвержд(?:ен|ено|ена)\\s+приказом|приложени[ея]\\s*(?:№\\s*\\d+)?\\s*к\\s+приказ)')
           THEN row_number() OVER (PARTITION BY page_id, regexp_matches(text, '(?i)^\\(?\\s*(?:утвержд(?:ен|ено|ена)\\s+приказом|приложени[ея]\\s*(?:№\\s*\\d+)?\\s*к\\s+приказ)')
                ORDER BY pos) END AS annex FROM paras),
bounds AS (
  SELECT page_id, min(pos) FILTER (annex = 1) AS first, min(pos) FILTER (annex = 2) AS second,
         max(pos) + 1 AS size FROM marks GROUP BY 1),
copies AS (
  SELECT m.page_id, m.pos, m.text, m.heading, lead(m.text) OVER (PARTITION BY m.page_id ORDER BY m.pos) AS after
  FROM marks m JOIN bounds b USING (page_id)
  LEFT JOIN (SELECT p.page_id, min(p.pos) AS pos FROM paras p JOIN bounds b ON b.page_id = p.page_id
             WHERE p.text IN ('ПОЛОЖЕНИЕ ПО БУХГАЛТЕРСКОМУ УЧЕТУ', 'ФЕДЕРАЛЬНЫЙ СТАНДАРТ БУХГАЛТЕРСКОГО УЧЕТА')
               AND p.pos >= b.first AND p.pos < b.second GROUP BY 1) t USING (page_id)
  WHERE m.pos >= coalesce(b.first, 0) AND m.pos < coalesce(t.pos, b.second, b.size)),
ends AS (
  SELECT page_id, min(pos) FILTER (regexp_matches(text, '(?i)^приложени[ея]\\s*(?:№\\s*)?\\d*\\s*к\\s+(?:положени|стандарт)')
      OR (regexp_matches(text, '(?i)^приложени[ея]\\s*(?:№\\s*)?\\d*\\s*$') AND regexp_matches(after, '(?i)^к\\s+(?:положени|стандарт)'))) AS appendix,
    max(pos) FILTER (NOT regexp_matches(text, '^\\[\\d+\\]\\s')) + 1 AS content
  FROM copies GROUP BY 1),
kept AS (SELECT c.*, regexp_replace(text, '\\s*\\[\\d+\\]', '', 'g') AS stripped FROM copies c JOIN ends e USING (page_id)
         WHERE pos < coalesce(appendix, content))"""


def _marked_pages(b: Binding) -> DataFrame:
    body = element_body(F.col("html"), "article")
    second = F.concat(
        F.lit("<p>ПОЛОЖЕНИЕ ПО БУХГАЛТЕРСКОМУ УЧЕТУ</p><p>Name</p><p>(утверждено приказом)</p>"), F.col("body")
    )
    appendix = "<p>Приложение № 2</p><p>к Положению</p><p>1. Example</p>"
    html = F.concat(
        F.lit("<div class='text_wrapper'><p>Приложение № 1 к приказу</p>"),
        F.col("body"),
        F.lit(_CENTRED),
        F.when(F.contains("url", F.lit("#")), second).otherwise(""),
        F.when(F.contains("url", F.lit("?")), appendix).otherwise(""),
        F.lit("<p>Text[7] with a mark [8].</p><p>[1] First note.</p><p>[2] Second note.</p></div>"),
    )
    rows = b.read("pages").withColumn("body", body)
    return rows.select(F.col("page_id").alias("id"), html.alias("html"))


@query(
    """SELECT page_id AS id, string_agg(CASE WHEN heading THEN chr(57344) ELSE '' END || stripped, chr(10) || chr(10) ORDER BY pos) AS text
    FROM kept GROUP BY 1""",
    _MARKED_PAGES,
)
def page_texts(b: Binding) -> DataFrame:
    return extract.page_texts(_marked_pages(b))


@query(
    """SELECT page_id AS id, CASE WHEN contains(url, '?') THEN 'https://minfin.gov.ru/files/' || page_id || '.pdf?v=2'
      WHEN contains(url, '#') THEN 'http://x.example/' || page_id || '.PDF' END AS link FROM pages"""
)
def pdf_links(b: Binding) -> DataFrame:
    number = F.col("page_id").cast("string")
    anchor = (
        F.when(F.contains("url", F.lit("?")), F.concat(F.lit('<p><a class="f" href="/files/'), number, F.lit('.pdf?v=2">pdf</a>')))
        .when(F.contains("url", F.lit("#")), F.concat(F.lit("<p><a href='http://x.example/"), number, F.lit(".PDF'>pdf</a>")))
        .otherwise("")
    )
    html = F.concat("html", anchor)
    return b.read("pages").select(F.col("page_id").alias("id"), extract.pdf_link(html).alias("link"))


@query(
    """SELECT id, source, md5(text) AS digest FROM (
      SELECT id, source, text, row_number() OVER (PARTITION BY id ORDER BY prio) AS rn FROM (
        SELECT page_id AS id, 'html' AS source, html AS text, 0 AS prio FROM pages
          WHERE len(regexp_extract_all(html, '<p[\\s>]')) >= 5
        UNION ALL SELECT doc_id, 'pdf', text, 1 FROM documents
        UNION ALL SELECT conv_id * 1000 + turn, 'order', text, 2 FROM conversations)) WHERE rn = 1"""
)
def choose_source(b: Binding) -> DataFrame:
    enough = texts.MIN_TOP_LEVEL_CLAUSES
    complete = F.regexp_count("html", F.lit(r"<p[\s>]")) >= enough
    html = b.read("pages").where(complete).select(
        F.col("page_id").alias("id"), F.lit("html").alias("source"), F.col("html").alias("text")
    )
    pdf = b.read("documents").select(F.col("doc_id").alias("id"), F.lit("pdf").alias("source"), "text")
    order = b.read("conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.lit("order").alias("source"), "text"
    )
    return extract.choose_source(html, pdf, order).select("id", "source", F.md5("text").alias("digest"))


# --- structure ----------------------------------------------------------------------------------

# Every line of a document becomes a block whose marker follows from the line's length.
_LINE = """CASE n % 11 WHEN 0 THEN 'II. Раздел ' || n WHEN 1 THEN (n % 40) || '. ' || line WHEN 2 THEN (n % 40) || '. ' || line
  WHEN 3 THEN (n % 40) || '.' || (n % 5) || ' ' || line WHEN 4 THEN 'а) ' || line WHEN 5 THEN 'ж) ' || line
  WHEN 6 THEN '6) ' || line WHEN 7 THEN '3) ' || line WHEN 8 THEN line
  WHEN 9 THEN '(в ред. приказа ' || n || ')' ELSE chr(57344) || 'Подраздел ' || n END"""

_BLOCKS = f""",
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(generate_series(0, len(string_split(text, chr(10))) - 1)) AS i
          FROM documents),
marked AS (SELECT doc_id, i, {_LINE} AS block FROM (SELECT *, length(line) AS n FROM lines)),
blocks AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS pos,
                  regexp_replace(block, '^\\s+|\\s+$', '', 'g') AS block
           FROM marked WHERE regexp_matches(block, '\\S'))"""

_NOTE = "(?:в\\s+ред\\.\\s+приказ|введен[\\p{L}\\p{N}_]*\\s+приказ)"

_TREE = _BLOCKS + f""",
c1 AS (
  SELECT *, starts_with(block, chr(57344)) AS marked,
    CASE WHEN starts_with(block, chr(57344)) THEN trim(substr(block, 2)) ELSE block END AS ln,
    trim(regexp_replace(block, '[ \\t]{{2,}}', ' ', 'g')) AS body FROM blocks),
c2 AS (
  SELECT *, regexp_extract(ln, '^([^\\s.]{{1,6}})\\s*\\.\\s+([^\\n]+)$', 1) AS marker,
    trim(regexp_replace(trim(regexp_extract(ln, '^([^\\s.]{{1,6}})\\s*\\.\\s+([^\\n]+)$', 2)), '(?i)\\s*\\([^()]*{_NOTE}[^()]*\\)\\s*$', '')) AS title,
    regexp_extract(body, '^([0-9]+\\.[0-9]+)\\.?\\s*', 1) AS dec, regexp_extract(body, '^([0-9]+)\\.\\s*', 1) AS num FROM c1),
c3 AS (
  SELECT *, CASE WHEN marked AND marker <> '' THEN 'H' WHEN marked THEN 'U'
      WHEN marker <> '' AND (NOT regexp_matches(marker, '^[0-9]+$') OR marker = '1') AND NOT regexp_matches(title, '[.,;:]$')
           AND len(regexp_extract_all(title, '\\S+')) <= 6 THEN 'H'
      WHEN regexp_matches(body, '^[а-я]\\)') THEN 'S' WHEN regexp_matches(body, '^[36]\\)') THEN 'D'
      WHEN dec <> '' OR num <> '' THEN 'C' ELSE 'T' END AS kind FROM c2),
c4 AS (
  SELECT doc_id, pos, kind, body, CASE WHEN kind = 'U' THEN trim(regexp_replace(ln, '(?i)\\s*\\([^()]*{_NOTE}[^()]*\\)\\s*$', ''))
      WHEN kind = 'H' THEN title END AS heading,
    CASE WHEN kind = 'C' THEN CASE WHEN dec <> '' THEN dec ELSE num END END AS number,
    CASE WHEN kind = 'C' THEN TRY_CAST(split_part(CASE WHEN dec <> '' THEN dec ELSE num END, '.', 1) AS DECIMAL(38,0)) END AS major,
    CASE WHEN kind = 'C' THEN CASE WHEN dec <> '' THEN TRY_CAST(split_part(dec, '.', 2) AS DECIMAL(38,0)) ELSE 0 END END AS minor,
    CASE WHEN kind IN ('S', 'D') THEN substr(body, 1, 1) END AS letter,
    CASE WHEN kind IN ('S', 'D') THEN regexp_replace(body, '^.\\)\\s*', '')
      WHEN kind = 'C' AND dec <> '' THEN regexp_replace(body, '^[0-9]+\\.[0-9]+\\.?\\s*', '')
      WHEN kind = 'C' THEN regexp_replace(body, '^[0-9]+\\.\\s*', '') END AS opened,
    kind = 'T' AND regexp_matches(body, '(?i)^\\([^()]*{_NOTE}[^()]*\\)$') AS note
  FROM c3),
s1 AS (SELECT *, max(CASE WHEN kind = 'C' THEN {{'a': major, 'b': minor}} END) OVER w AS top FROM c4
       WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s2 AS (SELECT *, kind = 'C' AND (top IS NULL OR {{'a': major, 'b': minor}} > top) AS acc FROM s1),
s3 AS (SELECT *, coalesce(bool_or(acc) OVER w, false) AS begun FROM s2
       WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s4 AS (SELECT *, CASE WHEN kind IN ('H', 'U') OR acc THEN 0 WHEN kind = 'C' THEN 1 END AS flag FROM s3 WHERE kind <> 'U' OR begun),
s5 AS (SELECT *, coalesce(last_value(flag IGNORE NULLS) OVER w, 0) = 1 AS disc FROM s4
       WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s6 AS (SELECT *, kind = 'S' AND NOT disc AND begun AS lit FROM s5),
s7 AS (SELECT *, last_value(CASE WHEN acc THEN '' WHEN lit THEN letter END IGNORE NULLS) OVER w AS prev,
         last_value(CASE WHEN acc OR lit THEN pos END IGNORE NULLS) OVER w AS run FROM s6
       WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s8 AS (SELECT *, kind = 'D' AND NOT disc AND begun AND ((letter = '6' AND prev = 'а') OR (letter = '3' AND prev = 'ж')) AS fits FROM s7),
s9 AS (SELECT *, CASE WHEN lit THEN letter WHEN fits AND row_number() OVER (PARTITION BY doc_id, run, fits ORDER BY pos) = 1
         THEN CASE letter WHEN '6' THEN 'б' ELSE 'з' END END AS sub FROM s8),
a1 AS (SELECT *, acc OR sub IS NOT NULL AS opens FROM s9),
a2 AS (
  SELECT * REPLACE (last_value(CASE WHEN flag = 0 THEN heading END IGNORE NULLS) OVER p AS heading),
    last_value(CASE WHEN opens THEN pos END IGNORE NULLS) OVER w AS entity,
    last_value(CASE WHEN opens THEN sub IS NOT NULL END IGNORE NULLS) OVER w AS in_sub,
    last_value(CASE WHEN acc THEN number END IGNORE NULLS) OVER w AS clause_no,
    coalesce(sum(CASE WHEN flag IS NOT NULL THEN 1 ELSE 0 END) OVER p, 0) AS seg,
    coalesce(first_value(CASE WHEN flag IS NOT NULL THEN 'F' WHEN sub IS NOT NULL THEN 'S' END IGNORE NULLS) OVER f, 'F') AS nxt
  FROM a1
  WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
         p AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         f AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
a3 AS (SELECT *, NOT opens AND in_sub AND nxt = 'F' AS closing FROM a2
       WHERE opens OR (kind IN ('T', 'D') AND sub IS NULL AND NOT disc AND entity IS NOT NULL)),
a4 AS (SELECT *, last_value(CASE WHEN closing THEN {{'e': entity, 's': seg}} END IGNORE NULLS) OVER w AS concluded
       FROM a3 WHERE NOT closing OR NOT note
       WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
a5 AS (SELECT *, CASE WHEN closing THEN seg WHEN NOT opens AND in_sub AND concluded.e = entity THEN concluded.s ELSE -1 END AS part,
         CASE WHEN opens THEN opened ELSE body END AS piece FROM a4),
tree AS (
  SELECT doc_id, min(pos) AS pos,
    CASE WHEN part >= 0 THEN max(clause_no) || '.заключение' WHEN bool_or(in_sub) THEN max(clause_no) || '.' || max(sub) ELSE max(clause_no) END AS path,
    CASE WHEN bool_or(in_sub) THEN max(clause_no) END AS parent_path,
    CASE WHEN NOT bool_or(in_sub) THEN max(CASE WHEN acc THEN heading END) END AS heading,
    trim(coalesce(string_agg(CASE WHEN piece <> '' THEN piece END, ' ' ORDER BY pos), '')) AS text
  FROM a5 GROUP BY doc_id, entity, part)"""


def _structured(b: Binding) -> DataFrame:
    def marked(line: Column) -> Column:
        n = F.length(line)
        rest = n % 11
        clause = F.concat((n % 40).cast("string"), F.lit(". "), line)
        rules = [
            (0, F.concat(F.lit("II. Раздел "), n.cast("string"))),
            (1, clause),
            (2, clause),
            (3, F.concat((n % 40).cast("string"), F.lit("."), (n % 5).cast("string"), F.lit(" "), line)),
            (4, F.concat(F.lit("а) "), line)),
            (5, F.concat(F.lit("ж) "), line)),
            (6, F.concat(F.lit("6) "), line)),
            (7, F.concat(F.lit("3) "), line)),
            (8, line),
            (9, F.concat(F.lit("(в ред. приказа "), n.cast("string"), F.lit(")"))),
        ]
        out = F.when(rest == 0, rules[0][1])
        for value, text in rules[1:]:
            out = out.when(rest == value, text)
        return out.otherwise(F.concat(F.lit(extract.HEADING_MARK + "Подраздел "), n.cast("string")))

    lines = F.filter(F.transform(F.split("text", "\n"), marked), lambda x: x.rlike(r"\S"))
    return b.read("documents").select(
        F.col("doc_id").alias("doc"), F.array_join(lines, "\n\n").alias("text")
    )


@query("SELECT doc_id AS doc, pos, block FROM blocks", _BLOCKS)
def blocks(b: Binding) -> DataFrame:
    return structure.blocks(_structured(b))


@query(
    """SELECT doc_id AS doc, pos, kind, acc, disc, sub FROM s9""",
    _TREE,
)
def clause_sequence(b: Binding) -> DataFrame:
    rows = structure.sequence(structure.classify(structure.blocks(_structured(b))))
    return rows.select("doc", "pos", "kind", "acc", "disc", "sub")


@query("SELECT doc_id AS doc, pos, path, parent_path, heading, text FROM tree", _TREE)
def clause_tree(b: Binding) -> DataFrame:
    return structure.parse_clauses(_structured(b))


@query(
    """SELECT doc_id AS doc, 'derived' AS side, count(*) AS "rows" FROM tree WHERE pos % 50 = 7 OR pos % 60 = 9 GROUP BY 1
    UNION ALL SELECT doc_id, 'stored', count(*) FROM tree WHERE pos % 50 = 7 AND pos % 60 <> 9 GROUP BY 1""",
    _TREE,
)
def reproduced_corpus(b: Binding) -> DataFrame:
    """Web pages -> paragraphs -> text -> clauses, in one plan, against stored clauses of which some were changed or lost."""
    docs = _structured(b)

    def paragraph(block: Column) -> Column:
        line = F.regexp_replace(block, extract.HEADING_MARK, "")
        for mark, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
            line = F.replace(line, F.lit(mark), F.lit(entity))
        bold = F.startswith(block, F.lit(extract.HEADING_MARK))
        return F.when(bold, F.concat(F.lit("<p><b>"), line, F.lit("</b></p>"))).otherwise(F.concat(F.lit("<p>"), line, F.lit("</p>")))

    body = F.array_join(F.transform(F.split("text", "\n\n"), paragraph), "\n")
    pages = docs.select(F.col("doc").alias("id"), F.concat(F.lit('<div class="text_wrapper">'), body, F.lit("</div>")).alias("html"))
    derived = structure.parse_clauses(extract.page_texts(pages).withColumnRenamed("id", "doc"))
    stored = structure.parse_clauses(docs).where("pos % 60 <> 9")
    stored = stored.withColumn("text", F.when(F.col("pos") % 50 == 7, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return publish.reproduces(derived, stored, ["doc"]).groupBy("doc", "side").agg(F.sum("rows").alias("rows"))


@query(
    """SELECT doc_id AS doc, count(DISTINCT CASE WHEN parent_path IS NULL THEN path END) AS top_level,
      count(DISTINCT CASE WHEN parent_path IS NULL THEN path END) >= 5 AS complete FROM tree GROUP BY 1""",
    _TREE,
)
def complete_documents(b: Binding) -> DataFrame:
    return structure.looks_complete(structure.parse_clauses(_structured(b)))


@query(
    """SELECT doc_id AS doc, path, count(*) AS "rows" FROM tree GROUP BY 1, 2 HAVING count(*) > 1""", _TREE
)
def repeated_paths(b: Binding) -> DataFrame:
    """Clause paths a document yields twice: a list closed twice has two conclusions."""
    tree = structure.parse_clauses(_structured(b))
    return tree.groupBy("doc", "path").agg(F.count("*").alias("rows")).where("rows > 1")


_LOSS = _TREE + """,
broken AS (SELECT * FROM tree WHERE NOT contains(path, '.')),
hay AS (SELECT doc_id, string_agg(concat_ws(' ', text, heading), ' ' ORDER BY pos) AS hay FROM broken GROUP BY 1),
cand AS (
  SELECT doc_id, pos, trim(CASE WHEN regexp_matches(t, '^[а-я]\\)\\s*') THEN regexp_replace(t, '^[а-я]\\)\\s*', '')
      ELSE regexp_replace(t, '^[36]\\)\\s*', '') END) AS text
  FROM (SELECT *, CASE WHEN kind = 'C' THEN opened ELSE body END AS t FROM s9
        WHERE kind IN ('S', 'D', 'T', 'C') AND (begun OR acc) AND (acc OR (kind <> 'C' AND NOT disc)) AND NOT (kind = 'T' AND note)))"""


@query(
    """SELECT c.doc_id AS doc, c.pos, c.text FROM cand c LEFT JOIN hay h ON h.doc_id = c.doc_id
    WHERE c.text <> '' AND NOT contains(coalesce(h.hay, ''), c.text)""",
    _LOSS,
)
def text_loss(b: Binding) -> DataFrame:
    """With only whole numbered clauses kept, what the others held counts as lost."""
    docs = _structured(b)
    kept = structure.parse_clauses(docs).where(~F.contains("path", F.lit(".")))
    return structure.lost_paragraphs(docs, kept)


@query(
    """SELECT doc_id AS doc, CASE WHEN lang = 'en' THEN 'sliced' WHEN lang = 'fr' THEN 'sliced' WHEN lang = 'de' THEN 'not_found' ELSE 'unchanged' END AS outcome,
      CASE WHEN lang = 'de' THEN 'В тексте не найдено приложение для стандарта ''3/2020'' (в документе найдены приложения для: 1/2020, 2/2020)' END AS error,
      md5(CASE lang WHEN 'en' THEN 'ФСБУ 1/2020 «A»' || chr(10) || chr(10) || text || chr(10) || chr(10)
        WHEN 'fr' THEN 'ФЕДЕРАЛЬНЫЙ СТАНДАРТ БУХГАЛТЕРСКОГО УЧЕТА' || chr(10) || 'ПБУ 2 / 2020 "B"' || chr(10) || chr(10) || source
        WHEN 'de' THEN NULL ELSE text END) AS digest
    FROM documents"""
)
def annex_slices(b: Binding) -> DataFrame:
    order = F.concat(
        F.lit("Preamble\n\nФСБУ 1/2020 «A»\n\n"), "text",
        F.lit('\n\nФЕДЕРАЛЬНЫЙ СТАНДАРТ БУХГАЛТЕРСКОГО УЧЕТА\nПБУ 2 / 2020 "B"\n\n'), "source",
    )
    number = F.when(F.col("lang") == "en", "1/2020").when(F.col("lang") == "fr", "2/2020").otherwise("3/2020")
    docs = b.read("documents").select(
        F.col("doc_id").alias("doc"), number.alias("number"),
        F.when(F.col("lang") == "es", F.col("text")).otherwise(order).alias("text"),
    )
    cut = structure.slice_annex(docs)
    return cut.select("doc", "outcome", "error", F.md5("text").alias("digest"))


@query(
    """SELECT conv_id, turn, regexp_replace(regexp_replace(regexp_replace(replace(text, chr(10), '-' || chr(10)),
        '([\\p{L}\\p{N}_])-\\n([\\p{L}\\p{N}_])', '\\1\\2', 'g'), '\\n', ' ', 'g'), '[ \\t]{2,}', ' ', 'g') AS text
    FROM conversations"""
)
def joined_lines(b: Binding) -> DataFrame:
    """Every line break of a conversation turned into a hyphenated one."""
    broken = F.replace("text", F.lit("\n"), F.lit("-\n"))
    return b.read("conversations").select("conv_id", "turn", C.normalise_breaks(broken).alias("text"))


# --- scraped fields -----------------------------------------------------------------------------

_APPLIES = """CASE o_orderpriority WHEN '1-URGENT' THEN 'С отчетности за ' || year(day) || ' г. Утрачивает силу с '
    || strftime(day + 400, '%d.%m.%Y') || ' г.'
  WHEN '2-HIGH' THEN 'с ' || strftime(day, '%d.%m.%Y') || ' г.'
  WHEN '3-MEDIUM' THEN 'С ' || day(day) || ' ' || ['января','февраля','марта','апреля','мая','июня','июля','августа','сентября','октября','ноября','декабря'][month(day)] || ' ' || year(day) || ' г.'
  WHEN '4-NOT SPECIFIED' THEN 'не указано' ELSE 'За ' || year(day) || 'г' END"""
_FROM = """CASE o_orderpriority WHEN '4-NOT SPECIFIED' THEN NULL WHEN '1-URGENT' THEN make_date(year(day), 1, 1)
  WHEN '5-LOW' THEN make_date(year(day), 1, 1) ELSE day END"""
_TO = "CASE o_orderpriority WHEN '1-URGENT' THEN day + 400 END"


def _applies(b: Binding) -> DataFrame:
    day, year = F.col("day"), F.year("day").cast("string")
    month = F.element_at(F.lit(texts.MONTHS), F.month("day"))
    p = F.col("o_orderpriority")
    words = F.concat(F.lit("С "), F.dayofmonth("day").cast("string"), F.lit(" "), month, F.lit(" "), year, F.lit(" г."))
    cell = (
        F.when(p == "1-URGENT", F.concat(
            F.lit("С отчетности за "), year, F.lit(" г. Утрачивает силу с "), C.ru_date(F.date_add(day, 400)), F.lit(" г.")))
        .when(p == "2-HIGH", F.concat(F.lit("с "), C.ru_date(day), F.lit(" г.")))
        .when(p == "3-MEDIUM", words)
        .when(p == "4-NOT SPECIFIED", "не указано")
        .otherwise(F.concat(F.lit("За "), year, F.lit("г")))
    )
    return b.orders.withColumn("cell", cell)


@query(f"SELECT o_orderkey, {_APPLIES} AS cell, {_FROM} AS effective_from, {_TO} AS effective_to FROM ords")
def dates_from_text(b: Binding) -> DataFrame:
    cell = F.col("cell")
    return _applies(b).select(
        "o_orderkey", "cell", C.parse_effective_from(cell).alias("effective_from"),
        C.parse_effective_to(cell).alias("effective_to"),
    )


@query(
    """SELECT id, number, year,
      CASE kind WHEN 'ФСБУ' THEN 'fsbu' ELSE 'pbu' END || '-' || replace(number, '/', '-') AS made_id FROM standard"""
)
def year_from_number(b: Binding) -> DataFrame:
    return b.standard.select(
        "id", "number", C.normalise_year(F.col("number")).alias("year"),
        C.make_id(F.col("kind"), F.col("number")).alias("made_id"),
    )


@query(
    f"""SELECT 'fsbu-' || o_custkey || '-' || year(day) AS id, 'ФСБУ' AS kind, o_custkey || '/' || year(day) AS number,
      CAST(year(day) AS INTEGER) AS year, o_orderpriority AS title, day AS order_date, o_custkey || 'н' AS order_no,
      {_FROM} AS effective_from, {_TO} AS effective_to, 'page-' || o_orderkey AS source_url,
      CASE WHEN o_orderstatus = 'F' THEN NULL ELSE 'https://minfin.gov.ru/ru/document?id_4=' || o_orderkey || '&x=1' END AS document_url,
      CASE WHEN o_orderpriority = '4-NOT SPECIFIED' AND o_orderstatus = 'F' THEN 'no effective date; no document link'
           WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'no effective date' WHEN o_orderstatus = 'F' THEN 'no document link' END AS error
    FROM ords"""
)
def parse_registry(b: Binding) -> DataFrame:
    """A registry page per order: a header row, an entry, and a row too short to be one."""
    key, cust = F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")
    name = F.concat(
        F.lit("ФСБУ "), cust, F.lit("/"), F.year("day").cast("string"), F.lit(" «"), "o_orderpriority", F.lit("»")
    )
    link = F.when(F.col("o_orderstatus") == "F", name).otherwise(
        F.concat(F.lit('<a href="/ru/document?id_4='), key, F.lit('&amp;x=1">'), name, F.lit("</a>"))
    )
    html = F.concat(
        F.lit("<table><tr><th>N</th><th>Name</th><th>Order</th></tr><tr><td>"), key, F.lit("</td><td>"), link,
        F.lit('</td><td class="o">Приказ от '), C.ru_date(F.col("day")), F.lit("&nbsp;№ "), cust,
        F.lit("н.</td><td>"), "cell", F.lit("</td></tr><tr><td>ФСБУ 1/2020 «X»</td><td>short</td></tr></table>"),
    )
    pages = _applies(b).select(F.concat(F.lit("page-"), key).alias("source_url"), html.alias("html"))
    return registry.parse_registry(pages)


@query(
    """SELECT event_id, CAST(event_id AS VARCHAR) AS eo_number, event_type AS title,
      'http://publication.pravo.gov.ru/file/pdf?eoNumber=' || event_id AS pdf_url
    FROM events WHERE event_type NOT IN ('error', 'signup')"""
)
def parse_acts(b: Binding) -> DataFrame:
    """Payloads of every shape: an object, a bare array, other spellings, no title, broken JSON."""
    number, kind = F.col("event_id").cast("string"), F.col("event_type")
    payload = (
        F.when(kind == "view", F.format_string('{"items":[{"eoNumber":"%s","name":"%s","p":%s}, 5]}', number, kind, "props"))
        .when(kind == "click", F.format_string('[{"EoNumber":%s,"complexName":"","Name":"%s"}]', number, kind))
        .when(kind == "purchase", F.format_string('{"items":[{"eoNumber":"","EoNumber":"%s","complexName":"%s"}]}', number, kind))
        .when(kind == "signup", F.format_string('{"items":[{"eoNumber":"%s"}]}', number))
        .otherwise(F.format_string('{"items":[%s', number))
    )
    return registry.parse_acts(b.read("events").select("event_id", payload.alias("payload")))


@query(
    """SELECT o_orderkey, 'http://publication.pravo.gov.ru/api/Documents?Number=' || o_custkey || '%D0%BD+%2A~&NumberSearchType=0&DocumentDateFrom='
      || strftime(day, '%d.%m.%Y') || '&DocumentDateTo=' || strftime(day, '%d.%m.%Y') || '&PageSize=30&Index=1' AS url FROM ords"""
)
def search_urls(b: Binding) -> DataFrame:
    number = F.concat(F.col("o_custkey").cast("string"), F.lit("н *~"))
    orders = b.orders.select("o_orderkey", F.col("day").alias("order_date"), number.alias("order_no"))
    return registry.search_urls(orders).select("o_orderkey", "url")


@query(
    """SELECT event_id, CASE WHEN event_type = 'error' THEN NULL WHEN event_type = 'signup' THEN DATE '1999-09-28'
        ELSE CAST(ts AS DATE) END AS on_date,
      CASE WHEN event_type = 'error' THEN 'on_date должен быть датой в формате ГГГГ-ММ-ДД, получено ''' || strftime(ts, '%d.%m.%Y') || '''' END AS error
    FROM events"""
)
def on_date_parameters(b: Binding) -> DataFrame:
    kind, day = F.col("event_type"), F.to_date("ts")
    given = F.when(kind == "error", C.ru_date(day)).when(kind == "click", F.date_format(day, "yyyyMMdd")).when(kind != "signup", day.cast("string"))
    asked = b.read("events").select("event_id", given.alias("on_date"))
    return temporal.with_on_date(asked, today=F.lit(TODAY)).select("event_id", "on_date", "error")
