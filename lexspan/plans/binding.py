"""A corpus seen in the test tables: each table plays a role of the data model.

customer is a standard, its orders (one per day) are editions, order lines are clauses and
mapping rows, part is the object catalogue, documents are external links and texts, pages are
document pages. `SQL` says the same as common table expressions.
"""

import uuid
from datetime import date
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspan import texts
from lexspan.functions.scale import exists, scratch_dir, written
from lexspan.operators import search

DATES = [date(1996, 3, 15), date(1998, 7, 1), date(2001, 12, 31)]
BUILT_AT = date(1999, 6, 30)
TODAY = date(1999, 9, 28)


def _str(c) -> Column:
    return F.col(c).cast("string") if isinstance(c, str) else c.cast("string")


def _tag(prefix: str, c) -> Column:
    return F.concat(F.lit(prefix), _str(c))


# Saved search indexes by application, folder and name.
_SAVED: dict[tuple[str, str, str], str] = {}


class Binding:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir
        self._stored: dict[str, DataFrame] = {}

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def stored(self, name: str) -> DataFrame:
        """A role table written once, for queries that read it several times: the built corpus."""
        if name not in self._stored:
            self._stored[name] = written(getattr(self, name), name)
        return self._stored[name]

    def index(self, name: str, clauses, lemmas: DataFrame | None = None) -> search.Index:
        """The search index of one corpus, saved once per session for all queries that read it."""
        path = _SAVED.get(key := (self.spark.sparkContext.applicationId, self.dir, name))
        if path is None or not exists(self.spark, path):
            path = _SAVED[key] = f"{scratch_dir(self.spark)}/index-{name}-{uuid.uuid4().hex}"
            search.save_index(clauses(), path, lemmas)
        return search.open_index(self.spark, path)

    @cached_property
    def orders(self) -> DataFrame:
        return self.read("orders").withColumn("day", F.to_date("o_orderdate"))

    @cached_property
    def numbered_order(self) -> DataFrame:
        """The order of each customer and day that makes an edition, numbered by day."""
        from pyspark.sql import Window

        per_day = self.orders.groupBy("o_custkey", "day").agg(F.max("o_orderkey").alias("orderkey"))
        number = F.row_number().over(Window.partitionBy("o_custkey").orderBy("day"))
        return per_day.withColumn("edition_no", number)

    @staticmethod
    def _edition_id() -> Column:
        return F.concat(_tag("c", "o_custkey"), F.lit("@"), _str("edition_no"))

    @cached_property
    def ordered_edition(self) -> DataFrame:
        """Editions with the order behind each."""
        return self.numbered_order.select(
            self._edition_id().alias("id"),
            _tag("c", "o_custkey").alias("standard_id"),
            "edition_no",
            F.lit(None).cast("string").alias("amending_order"),
            F.col("day").alias("effective_from"),
            "orderkey",
        )

    @cached_property
    def edition(self) -> DataFrame:
        return self.ordered_edition.drop("orderkey")

    @cached_property
    def standard(self) -> DataFrame:
        span = self.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(
            F.min("day").alias("first"), F.max("day").alias("last")
        )
        c = self.read("customer").join(span, "c_custkey", "left")
        first = F.coalesce("first", F.lit(date(1995, 1, 1)))
        start = F.when(F.col("c_mktsegment") == "FURNITURE", F.date_sub(first, 30)).otherwise(first)
        year = F.year(first)
        repealed = F.col("c_acctbal") < 0
        shown = F.when(F.col("c_mktsegment") == "BUILDING", F.substring(_str(year), 3, 2)).otherwise(_str(year))
        return c.select(
            _tag("c", "c_custkey").alias("id"),
            F.when(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), texts.KINDS[0])
            .otherwise(texts.KINDS[1]).alias("kind"),
            F.concat_ws("/", _str("c_nationkey"), shown).alias("number"),
            year.alias("year"),
            F.col("c_name").alias("title"),
            first.alias("order_date"),
            F.concat(_str("c_nationkey"), F.lit("н")).alias("order_no"),
            start.alias("effective_from"),
            F.when(repealed, F.date_add("last", 1)).alias("effective_to"),
            F.when(repealed, _tag("c", F.col("c_custkey") * 2)).alias("superseded_by"),
            _tag("https://example.org/c", "c_custkey").alias("source_url"),
        )

    @cached_property
    def line(self) -> DataFrame:
        """One order line per (order, line number) of each edition; lines meet editions first, so that they are shuffled once."""
        fields = F.struct("l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "l_linestatus")
        ed = self.numbered_order.select(F.col("orderkey").alias("l_orderkey"), "o_custkey", "edition_no")
        keys = ["l_orderkey", "l_linenumber", "o_custkey", "edition_no"]
        best = self.read("lineitem").join(ed, "l_orderkey").groupBy(*keys).agg(F.max(fields).alias("l"))
        return best.select(*keys, "l.*")

    @staticmethod
    def path() -> Column:
        concluding = (F.col("l_linestatus") == "O") & (F.col("l_returnflag") == "R")
        return F.concat(_str("l_linenumber"), F.when(concluding, "." + texts.CONCLUSION).otherwise(""))

    @cached_property
    def clause(self) -> DataFrame:
        later = F.col("l_linenumber") > 3
        named = self.line.withColumns({"standard_id": _tag("c", "o_custkey"), "edition_id": self._edition_id()})
        return named.select(
            F.concat_ws("#", "edition_id", self.path()).alias("id"),
            "standard_id",
            "edition_id",
            F.col("l_linenumber").alias("pos"),
            self.path().alias("path"),
            F.when(later, _str(F.col("l_linenumber") - 3)).alias("parent_path"),
            F.when(F.col("l_returnflag") == "N", _tag("Раздел ", "l_linestatus")).alias("heading"),
            F.format_string(
                "Part %d by supplier %d, %s%s", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus"
            ).alias("text"),
        )

    @cached_property
    def config_object(self) -> DataFrame:
        return self.read("part").select(
            F.col("p_brand").alias("config"), _tag("P", "p_partkey").alias("ref"),
            F.col("p_type").alias("kind"), F.col("p_name").alias("presentation"),
        )

    @cached_property
    def mapping(self) -> DataFrame:
        owner = self.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
        part = self.read("part").select(F.col("p_partkey").alias("l_partkey"), "p_brand", "p_type")
        rows = self.read("lineitem").join(owner, "l_orderkey").join(part, "l_partkey")
        other = (F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F")
        return rows.select(
            _tag("c", "o_custkey").alias("standard_id"),
            self.path().alias("clause_path"),
            F.when(F.col("l_discount") > 0.02, F.col("l_linenumber")).alias("edition_from"),
            F.col("p_brand").alias("config"),
            F.lit(None).cast("string").alias("version_from"),
            F.when(F.col("l_tax") == 0, "прочее").otherwise(F.col("p_type")).alias("kind"),
            F.when(other, _tag("S", "l_suppkey")).otherwise(_tag("P", "l_partkey")).alias("object_ref"),
            F.lit(None).cast("string").alias("note"),
            (F.col("l_quantity") * 2).cast("int").alias("confidence"),
            (F.col("l_returnflag") == "A").alias("verified"),
        )

    @cached_property
    def link(self) -> DataFrame:
        marks = self.read("labels").select("doc_id", "quality")
        return self.read("documents").join(marks, "doc_id", "left").select(
            _tag("c", "doc_id").alias("standard_id"),
            _str(F.col("n_chars") % 7 + 1).alias("clause_path"),
            F.when(F.col("lang") == "en", 1).when(F.col("lang") == "de", 9).alias("edition_from"),
            F.col("source").alias("its_id"),
            F.col("lang").alias("title"),
            F.col("text").alias("summary"),
            (F.coalesce("quality", F.lit(0)) == 1).alias("verified"),
        )

    @staticmethod
    def _relation_kind() -> Column:
        flag = F.col("l_returnflag")
        return (
            F.when(flag == "A", texts.RELATION_KINDS[0])
            .when(flag == "N", texts.RELATION_KINDS[1])
            .otherwise(texts.RELATION_KINDS[2])
        )

    @cached_property
    def standard_relation(self) -> DataFrame:
        return self.read("lineitem").select(
            _tag("c", "l_suppkey").alias("from_standard"),
            _tag("c", "l_partkey").alias("to_standard"),
            self._relation_kind().alias("kind"),
        )

    @cached_property
    def clause_relation(self) -> DataFrame:
        quantity = F.col("l_quantity").cast("int")
        return self.read("lineitem").select(
            _tag("c", "l_suppkey").alias("from_standard"),
            _str("l_linenumber").alias("from_clause_path"),
            F.when(F.col("l_tax") > 0.04, F.col("l_linenumber")).alias("from_edition_from"),
            _tag("c", "l_partkey").alias("to_standard"),
            _str(quantity).alias("to_clause_path"),
            F.when(F.col("l_discount") > 0.05, quantity).alias("to_edition_from"),
            self._relation_kind().alias("kind"),
        )

    # --- requests -------------------------------------------------------------------------------

    @cached_property
    def clause_request(self) -> DataFrame:
        unknown = (F.col("o_orderstatus") == "F") & (F.col("o_orderpriority") == "5-LOW")
        return self.orders.select(
            F.col("o_orderkey").alias("request_id"),
            F.when(unknown, _tag("x", "o_custkey")).otherwise(_tag("c", "o_custkey")).alias("standard_id"),
            F.substring("o_orderpriority", 1, 1).alias("path"),
            F.when(F.col("o_orderstatus") == "P", F.date_sub("day", 900))
            .otherwise(F.col("day")).alias("on_date"),
        )

    @cached_property
    def mapping_request(self) -> DataFrame:
        segment = F.col("c_mktsegment")
        return self.read("customer").select(
            F.col("c_custkey").alias("request_id"),
            _tag("c", "c_custkey").alias("standard_id"),
            F.when(segment == "BUILDING", "1").when(segment == "MACHINERY", "2")
            .when(segment == "AUTOMOBILE", "3").alias("clause_path"),
            _tag("Brand#", "c_nationkey").alias("config"),
        )

    @cached_property
    def object_request(self) -> DataFrame:
        part, customer = self.read("part"), self.read("customer")
        known = part.select(
            _tag("p-", "p_partkey").alias("request_id"), _tag("p", "p_partkey").alias("object_ref"),
            F.col("p_brand").alias("config"),
        )
        words = part.select(
            _tag("q-", "p_partkey").alias("request_id"),
            F.upper(F.split_part("p_name", F.lit(" "), F.lit(2))).alias("object_ref"),
            _tag("Brand#", "p_size").alias("config"),
        )
        digits = customer.select(
            _tag("c-", "c_custkey").alias("request_id"), _str("c_custkey").alias("object_ref"),
            _tag("Brand#", "c_nationkey").alias("config"),
        )
        return known.unionByName(words).unionByName(digits)

    def tables(self) -> dict[str, DataFrame]:
        derived = ["standard", "edition", "clause", "mapping", "standard_relation", "clause_relation"]
        return {
            **{name: self.stored(name) for name in derived},
            "config_object": self.config_object, "link": self.link,
        }


_PATH = "CAST(l_linenumber AS VARCHAR) || CASE WHEN l_linestatus = 'O' AND l_returnflag = 'R' THEN '.заключение' ELSE '' END"
_KIND = "CASE l_returnflag WHEN 'A' THEN 'заменён' WHEN 'N' THEN 'аналог' ELSE 'отсылка' END"

SQL = f"""
dates(on_date) AS (VALUES (DATE '1996-03-15'), (DATE '1998-07-01'), (DATE '2001-12-31')),
ords AS (SELECT *, CAST(o_orderdate AS DATE) AS day FROM orders),
ordered_edition AS (
  SELECT 'c' || o_custkey || '@' || edition_no AS id, 'c' || o_custkey AS standard_id,
         CAST(edition_no AS INTEGER) AS edition_no, day AS effective_from, orderkey
  FROM (SELECT o_custkey, day, max(o_orderkey) AS orderkey,
               row_number() OVER (PARTITION BY o_custkey ORDER BY day) AS edition_no
        FROM ords GROUP BY o_custkey, day)),
edition AS (SELECT id, standard_id, edition_no, effective_from FROM ordered_edition),
validity AS (
  SELECT id AS edition_id, standard_id, edition_no, effective_from AS valid_from,
         lead(effective_from) OVER (PARTITION BY standard_id ORDER BY effective_from) AS valid_to
  FROM edition),
in_force AS (
  SELECT v.standard_id, d.on_date, v.edition_id, v.edition_no FROM validity v JOIN dates d
    ON v.valid_from <= d.on_date AND (v.valid_to IS NULL OR d.on_date < v.valid_to)),
built AS (
  SELECT standard_id, edition_id, edition_no FROM validity
  WHERE valid_from <= DATE '1999-06-30' AND (valid_to IS NULL OR DATE '1999-06-30' < valid_to)),
standard AS (
  SELECT 'c' || c_custkey AS id,
         CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'ФСБУ' ELSE 'ПБУ' END AS kind,
         c_nationkey || '/' || CASE WHEN c_mktsegment = 'BUILDING'
           THEN substr(CAST(year(first) AS VARCHAR), 3, 2) ELSE CAST(year(first) AS VARCHAR) END AS number,
         CAST(year(first) AS INTEGER) AS year, c_name AS title, first AS order_date,
         c_nationkey || 'н' AS order_no,
         CASE WHEN c_mktsegment = 'FURNITURE' THEN first - 30 ELSE first END AS effective_from,
         CASE WHEN c_acctbal < 0 THEN last + 1 END AS effective_to,
         CASE WHEN c_acctbal < 0 THEN 'c' || (c_custkey * 2) END AS superseded_by,
         'https://example.org/c' || c_custkey AS source_url
  FROM (SELECT c.*, coalesce(s.first, DATE '1995-01-01') AS first, s.last
        FROM customer c LEFT JOIN (SELECT o_custkey, min(day) AS first, max(day) AS last FROM ords GROUP BY 1) s
          ON s.o_custkey = c.c_custkey)),
line AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_returnflag, l_linestatus
  FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey DESC,
          l_suppkey DESC, l_quantity DESC, l_returnflag DESC, l_linestatus DESC) AS rn FROM lineitem)
  WHERE rn = 1),
clause AS (
  SELECT e.id || '#' || ({_PATH}) AS id, e.standard_id, e.id AS edition_id, l_linenumber AS pos,
         {_PATH} AS path,
         CASE WHEN l_linenumber > 3 THEN CAST(l_linenumber - 3 AS VARCHAR) END AS parent_path,
         CASE WHEN l_returnflag = 'N' THEN 'Раздел ' || l_linestatus END AS heading,
         'Part ' || l_partkey || ' by supplier ' || l_suppkey || ', ' || l_returnflag || l_linestatus AS text
  FROM line JOIN ordered_edition e ON e.orderkey = line.l_orderkey),
config_object AS (
  SELECT p_brand AS config, 'P' || p_partkey AS ref, p_type AS kind, p_name AS presentation FROM part),
mapping AS (
  SELECT 'c' || o_custkey AS standard_id, {_PATH} AS clause_path,
         CASE WHEN l_discount > 0.02 THEN l_linenumber END AS edition_from, p_brand AS config,
         CASE WHEN l_tax = 0 THEN 'прочее' ELSE p_type END AS kind,
         CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN 'S' || l_suppkey ELSE 'P' || l_partkey END AS object_ref,
         CAST(l_quantity * 2 AS INTEGER) AS confidence, l_returnflag = 'A' AS verified
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey),
link AS (
  SELECT 'c' || d.doc_id AS standard_id, CAST(n_chars % 7 + 1 AS VARCHAR) AS clause_path,
         CASE lang WHEN 'en' THEN 1 WHEN 'de' THEN 9 END AS edition_from, source AS its_id,
         lang AS title, text AS summary, coalesce(quality, 0) = 1 AS verified
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id),
standard_relation AS (
  SELECT 'c' || l_suppkey AS from_standard, 'c' || l_partkey AS to_standard, {_KIND} AS kind FROM lineitem),
clause_relation AS (
  SELECT 'c' || l_suppkey AS from_standard, CAST(l_linenumber AS VARCHAR) AS from_clause_path,
         CASE WHEN l_tax > 0.04 THEN l_linenumber END AS from_edition_from,
         'c' || l_partkey AS to_standard, CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) AS to_clause_path,
         CASE WHEN l_discount > 0.05 THEN CAST(l_quantity AS INTEGER) END AS to_edition_from, {_KIND} AS kind
  FROM lineitem),
clause_request AS (
  SELECT o_orderkey AS request_id,
         CASE WHEN o_orderstatus = 'F' AND o_orderpriority = '5-LOW' THEN 'x' ELSE 'c' END || o_custkey AS standard_id,
         substr(o_orderpriority, 1, 1) AS path,
         CASE WHEN o_orderstatus = 'P' THEN day - 900 ELSE day END AS on_date
  FROM ords),
mapping_request AS (
  SELECT c_custkey AS request_id, 'c' || c_custkey AS standard_id,
         CASE c_mktsegment WHEN 'BUILDING' THEN '1' WHEN 'MACHINERY' THEN '2' WHEN 'AUTOMOBILE' THEN '3' END AS clause_path,
         'Brand#' || c_nationkey AS config
  FROM customer),
object_request AS (
  SELECT 'p-' || p_partkey AS request_id, 'p' || p_partkey AS object_ref, p_brand AS config FROM part
  UNION ALL SELECT 'q-' || p_partkey, upper(split_part(p_name, ' ', 2)), 'Brand#' || p_size FROM part
  UNION ALL SELECT 'c-' || c_custkey, CAST(c_custkey AS VARCHAR), 'Brand#' || c_nationkey FROM customer),
applicable AS (
  SELECT m.*, b.edition_id FROM mapping m JOIN built b ON b.standard_id = m.standard_id
  WHERE (m.edition_from IS NULL OR m.edition_from <= b.edition_no)
    AND EXISTS (SELECT 1 FROM clause c WHERE c.edition_id = b.edition_id AND c.path = m.clause_path)),
resolved AS (
  SELECT r.request_id, r.standard_id, r.path, r.on_date, s.id IS NOT NULL AS known, s.title,
         s.order_date, s.order_no, s.effective_from AS std_from, s.effective_to AS std_to, s.source_url,
         EXISTS (SELECT 1 FROM edition e WHERE e.standard_id = r.standard_id) AS has_editions,
         coalesce(v.edition_id, f.edition_id) AS edition_id, coalesce(v.edition_no, f.edition_no) AS edition_no,
         v.edition_id IS NULL AND f.edition_id IS NOT NULL AS fell_back
  FROM clause_request r LEFT JOIN standard s ON s.id = r.standard_id
  LEFT JOIN validity v ON v.standard_id = r.standard_id AND v.valid_from <= r.on_date
    AND (v.valid_to IS NULL OR r.on_date < v.valid_to)
  LEFT JOIN validity f ON f.standard_id = s.id AND f.valid_from <= s.effective_from
    AND (f.valid_to IS NULL OR s.effective_from < f.valid_to))
"""
