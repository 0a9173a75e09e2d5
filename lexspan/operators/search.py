"""Full-text search with BM25 for many queries at once.

The index is a set of plain tables. `postings` has one row per (clause, term) and carries the
clause's length and validity, so a query term meets everything it needs in one join. `lookup` holds the same
rows by clause, for completing the scores of candidates. A saved index is bucketed by those keys, so neither
table is shuffled again by any query. Where terms that stand in a large part of all clauses make most of the index, they
are in neither, but read from `counts`, where clauses were counted: most of it would be their postings.
"""

import hashlib
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexspan import texts
from lexspan.functions.columns import snippet, tokens
from lexspan.functions.scale import each, keyed_join, top_rows, written
from lexspan.operators import temporal

# Clause columns that travel with every posting.
_CARRIED = ["clause_id", "standard_id", "valid_from", "valid_to"]
# The `era` of clauses that nothing has replaced yet; others have the year in which they were replaced.
OPEN_ERA = 9999
# Parts that standards are dealt over, so that a restricted search reads only those of its standards.
SHARDS = 4
# A saved index reads a term from `counts` when more than one clause in `DENSE_PART` holds it, and more than `DENSE_ROWS` do, if
# such terms make most of the index; where they do not, setting them apart would cost more reading than it saves.
DENSE_PART = 16
DENSE_ROWS = 1 << 13
# Form of a saved index.
VERSION = 2


@dataclass(frozen=True)
class Index:
    """postings(term, salt, era, shard, clause_id, standard_id, valid_from, valid_to, tf, dl),
    lookup(clause_id, term, tf, dl), counts(clause_id, standard_id, valid_from, valid_to, dl, term, tf),
    term_df(term, df, salts, dense), stats(n, avgdl, unique): one row.

    A term whose postings are more than one bucket's share is dealt over `salts` buckets by clause; a `dense` one is in `counts` alone.
    `unique` says that no clause id stands for clauses of different lengths or validity.
    """

    postings: DataFrame
    lookup: DataFrame
    counts: DataFrame
    term_df: DataFrame
    stats: DataFrame


def terms(
    df: DataFrame, text: str, keep: list[str], lemmas: DataFrame | None = None
) -> DataFrame:
    """df -> (keep..., pos, term), one row per kept token.

    lemmas(form, lemma) is keyed by the lower-case form; protected abbreviations keep their form,
    and stop words are dropped by lemma. Indexing and querying both go through here.
    """
    found = each(df, keep, tokens(F.col(text)), "term", pos="pos")
    if lemmas is not None:
        found = _lemmatised(found, lemmas)
    return found.where(~F.col("term").isin(texts.STOP_LEMMAS))


def _lemmatised(found: DataFrame, lemmas: DataFrame) -> DataFrame:
    """Terms replaced by their lemmas, but for protected abbreviations."""
    forms = lemmas.where(~F.col("form").isin(texts.PROTECTED_TERMS)).select(F.col("form").alias("term"), "lemma")
    joined = keyed_join(found, forms, ["term"])
    return joined.withColumn("term", F.coalesce("lemma", "term")).drop("lemma")


def index_text(heading: Column, text: Column) -> Column:
    return F.concat(F.coalesce(heading, F.lit("")), F.lit(" "), text)


def with_validity(clauses: DataFrame, editions: DataFrame) -> DataFrame:
    """Clauses with the days on which their edition is the one in force."""
    spans = temporal.validity(editions).select("edition_id", "valid_from", "valid_to")
    return keyed_join(
        clauses.withColumnRenamed("id", "clause_id"), spans, ["edition_id"], "inner",
    )


# Clauses are counted in this many times the usual partitions, as a row unfolds into many.
_SPREAD = 4


def _counted(clauses: DataFrame, lemmas: DataFrame | None) -> DataFrame:
    """(carried..., dl, term, tf): a clause's terms, and a row without a term whose tf is its number of clauses.

    Whole clauses are shuffled, once; their tokens are counted where they arrive, and only there: a plain explode
    would add a filter on the array's size, which runs on the other side of the shuffle too.
    """
    partitions = _SPREAD * int(clauses.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texted = clauses.select(*_CARRIED, index_text(F.col("heading"), F.col("text")).alias("_text"))
    texted = texted.repartition(partitions, "clause_id")
    marker = F.array(F.lit(None).cast("string"))
    if lemmas is None:
        # Without lemmas the length is known inside the row, before tokens are set apart.
        kept = F.filter(tokens(F.col("_text")), lambda t: ~t.isin(texts.STOP_LEMMAS))
        kept = texted.select(*_CARRIED, F.coalesce(kept, F.array().cast("array<string>")).alias("_tokens"))
        sized = kept.select(*_CARRIED, F.size("_tokens").cast("long").alias("dl"), F.concat("_tokens", marker).alias("_tokens"))
        return sized.select(*_CARRIED, "dl", F.explode_outer("_tokens").alias("term")).groupBy(*_CARRIED, "dl", "term").agg(
            F.count("*").alias("tf")
        )
    marked = F.concat(F.coalesce(tokens(F.col("_text")), F.array().cast("array<string>")), marker)
    forms = texted.select(*_CARRIED, F.explode_outer(marked).alias("term")).groupBy(*_CARRIED, "term").agg(F.count("*").alias("tf"))
    found = _lemmatised(forms, lemmas).where(F.col("term").isNull() | ~F.col("term").isin(texts.STOP_LEMMAS))
    length = F.sum(F.when(F.col("term").isNotNull(), F.col("tf"))).over(Window.partitionBy("clause_id"))
    return found.withColumn("dl", length).groupBy(*_CARRIED, "dl", "term").agg(F.sum("tf").alias("tf"))


def _by_term(placed: DataFrame) -> DataFrame:
    """Counted rows with their salt as postings; era and shard follow from what a row carries."""
    return placed.select(
        "term", "salt", "clause_id", "standard_id", "valid_from", "valid_to", "tf", "dl",
        F.coalesce(F.year("valid_to"), F.lit(OPEN_ERA)).alias("era"), _shard(F.col("standard_id")).alias("shard"),
    )


def _salt(salts: str) -> Column:
    return F.coalesce(F.pmod(F.xxhash64("clause_id"), salts), F.lit(0)).cast("int")


def _index(all_counted: DataFrame, by_term: DataFrame | None = None, buckets: int = 1) -> Index:
    """The index of counted clauses; by_term(term, df, tf): their sums by term, where those are stored."""
    counted = all_counted.where("term IS NOT NULL")
    repeated = all_counted.where("term IS NULL AND clause_id IS NOT NULL").groupBy("clause_id").count().where("count > 1")
    unique = repeated.agg(F.count("*") == 0).scalar()
    sums = (all_counted if by_term is None else by_term).agg(
        F.coalesce(F.sum(F.when(F.col("term").isNull(), F.col("tf"))), F.lit(0)).alias("n"),
        F.sum(F.when(F.col("term").isNotNull(), F.col("tf"))).alias("total"),
    )
    stats = sums.select("n", (F.col("total") / F.col("n")).alias("avgdl"), unique.alias("unique"))
    held = counted.groupBy("term").agg(F.count("*").alias("df")) if by_term is None else by_term.where("term IS NOT NULL").select("term", "df")
    if buckets == 1:
        term_df = held.withColumns({"salts": F.lit(1), "dense": F.lit(False)})
        return Index(_by_term(counted.withColumn("salt", F.lit(0))), _by_clause(counted), counted, term_df, stats)
    share = F.greatest(F.lit(1), F.floor(held.agg(F.sum("df")).scalar() / buckets))
    common = (F.col("df") > DENSE_ROWS) & (F.col("df") * DENSE_PART > sums.select("n").scalar())
    most = held.agg(2 * F.sum(F.when(common, F.col("df"))) > F.sum("df")).scalar()
    dense = F.coalesce(common & most, F.lit(False))
    term_df = held.withColumn("salts", F.coalesce(F.ceil(F.col("df") / share), F.lit(1)).cast("int")).withColumn("dense", dense)
    # Terms of more than one bucket's share: never more than there are buckets; dense ones: `DENSE_PART` times those of a mean clause.
    hot = F.broadcast(term_df.where("salts > 1 OR dense").select("term", "salts", "dense"))
    kept = counted.join(hot, "term", "left").where(~F.coalesce("dense", F.lit(False)))
    # Rows are moved as short as they are.
    moved = kept.select("term", _salt("salts").alias("salt"), "clause_id", "standard_id", "valid_from", "valid_to", "tf", "dl")
    by_clause = _by_clause(kept).repartition(buckets, "clause_id", "term")
    return Index(_by_term(moved.repartition(buckets, "term", "salt")), by_clause, counted, term_df, stats)


def _by_clause(counted: DataFrame) -> DataFrame:
    return counted.select("clause_id", "term", "tf", "dl")


def build_index(clauses: DataFrame, lemmas: DataFrame | None = None, buckets: int = 1) -> Index:
    """clauses(clause_id, standard_id, valid_from, valid_to, heading, text) -> Index, derived anew by every reader.

    `save_index` writes it for the many queries that a corpus answers.
    """
    return _index(_counted(clauses, lemmas), None, buckets)


def _shard(standard_id: Column) -> Column:
    return F.pmod(F.xxhash64(standard_id), F.lit(SHARDS)).cast("int")


# What the tables of a saved index are bucketed and partitioned by.
_LAYOUT = {
    "counts": (["clause_id"], []),
    "postings": (["term", "salt"], ["era", "shard"]),
    "lookup": (["clause_id", "term"], []),
    "term_df": (["term"], []),
    "stats": ([], []),
}


def _save(rows: DataFrame, path: str, name: str, buckets: int) -> DataFrame:
    """One table of a saved index; the writer sorts rows by partition, bucket and key."""
    by, partitions = _LAYOUT[name]
    writer = rows.write.format("parquet").option("path", f"{path}/{name}").option("compression", "zstd")
    if by:
        writer = writer.bucketBy(buckets, *by).sortBy(*by)
    if partitions:
        writer = writer.partitionBy(*partitions)
    table = _table_name(path, name)
    writer.saveAsTable(table)
    return rows.sparkSession.table(table)


def save_index(
    clauses: DataFrame, path: str, lemmas: DataFrame | None = None, buckets: int | None = None
) -> None:
    """Write the index of `clauses` to a folder that does not exist yet, its tables in buckets.

    Clauses are read and counted once, where they arrive by clause, which is how `counts` is stored; the other tables come from it.
    """
    spark = clauses.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    spark.range(1).select(F.lit(buckets).alias("buckets"), F.lit(VERSION).alias("version")).write.mode("errorifexists").parquet(f"{path}/layout")
    if lemmas is not None:
        lemmas = written(lemmas.select("form", "lemma"), "index-lemmas")
    counted = _save(_counted(clauses, lemmas), path, "counts", buckets)
    by_term = written(counted.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf")), "index-counts")
    built = _index(counted, by_term, buckets)
    _save(built.postings, path, "postings", buckets)
    _save(built.lookup, path, "lookup", buckets)
    _save(built.term_df.repartition(buckets, "term"), path, "term_df", buckets)
    _save(built.stats, path, "stats", buckets)


def _table_name(path: str, name: str) -> str:
    return f"lexspan_{hashlib.md5(path.encode()).hexdigest()}_{name}"


def open_index(spark: SparkSession, path: str) -> Index:
    """A saved index; its tables are declared in this session's catalogue where they are not known yet."""
    found, layout = {}, spark.read.parquet(f"{path}/layout").first().asDict()
    if layout.get("version") != VERSION:
        raise ValueError(f"{path} is of another form: save the index anew")
    for name, (by, partitions) in _LAYOUT.items():
        table = _table_name(path, name)
        if not spark.catalog.tableExists(table):
            columns = ", ".join(f"{c} {t}" for c, t in spark.read.parquet(f"{path}/{name}").dtypes)
            placed = f" PARTITIONED BY ({', '.join(partitions)})" if partitions else ""
            if by:
                placed += f" CLUSTERED BY ({', '.join(by)}) SORTED BY ({', '.join(by)}) INTO {layout['buckets']} BUCKETS"
            spark.sql(f"CREATE TABLE {table} ({columns}) USING parquet{placed} LOCATION '{path}/{name}'")
            if partitions:
                spark.sql(f"ALTER TABLE {table} RECOVER PARTITIONS")
        found[name] = spark.table(table)
    return Index(**found)


def query_terms(queries: DataFrame, lemmas: DataFrame | None = None) -> DataFrame:
    """queries(query_id, query, ...) -> (query_id, term, qtf, n_terms)."""
    counted = terms(queries, "query", ["query_id"], lemmas).groupBy("query_id", "term").agg(
        F.count("*").alias("qtf")
    )
    sizes = counted.groupBy("query_id").agg(F.count("*").alias("n_terms"))
    return counted.join(sizes, "query_id")


def weighted(asked: DataFrame, index: Index) -> DataFrame:
    """Query terms with their weight and document frequency; statistics cover the whole index."""
    known = asked.join(index.term_df, "term", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    n = index.stats.select("n").scalar()
    idf = F.ln((n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    floored = F.when(idf <= 0, texts.BM25_IDF_FLOOR).otherwise(idf)
    return known.withColumn("weight", F.col("qtf") * floored)


def _part(avgdl: Column) -> Column:
    """Contribution of one matching term to a clause's score."""
    k1, b = texts.BM25_K1, texts.BM25_B
    norm = k1 * (1 - b + b * F.col("dl") / avgdl)
    return F.col("weight") * F.col("tf") * (k1 + 1) / (F.col("tf") + norm)


_KEYS = ["query_id", "clause_id", "standard_id", "n_terms"]


def _summed(parts: DataFrame, index: Index) -> DataFrame:
    """(query_id, clause_id, standard_id, n_terms, score, matched) over matching terms with their weight."""
    scored = parts.withColumn("part", _part(index.stats.select("avgdl").scalar()))
    return scored.groupBy(*_KEYS).agg(F.sum("part").alias("score"), F.count("*").alias("matched"))


def bm25(queries: DataFrame, index: Index, lemmas: DataFrame | None = None) -> DataFrame:
    """Score of every clause sharing a term with a query: (query_id, clause_id, score, matched).

    This is the whole relation, for checking; `search` finds the best hits without building it. An index that is not saved
    holds a clause's terms together, so that with few enough query terms to be broadcast no matching term is shuffled.
    """
    index = replace(index, stats=written(index.stats.select("n", "avgdl"), "index-stats"))
    asked = written(weighted(query_terms(queries, lemmas), index), "query-weights")
    parts = index.counts.join(asked, "term").withColumn("standard_id", F.lit(None))
    return _summed(parts, index).select("query_id", "clause_id", "score", "matched", "n_terms")


_IN_FORCE = "valid_from IS NULL OR (valid_from <= on_date AND (valid_to IS NULL OR on_date < valid_to))"
_FREE = "(standard_ids IS NULL OR size(standard_ids) <= 0)"


def _readable(postings: DataFrame, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The postings that some query can hit, and those that some restricted query can; whole eras and shards are left unread.

    A clause replaced in a year is in force on no later year's days. If every query is restricted, only the
    shards of the named standards count.
    """
    first = asked.agg(F.min(F.year("on_date"))).scalar()
    free = asked.agg(F.max(F.expr(_FREE))).scalar()
    named = asked.select(F.explode("standard_ids").alias("id")).agg(F.collect_set(_shard(F.col("id")))).scalar()
    live = postings.where(F.col("era") >= first)
    return live.where(free | F.array_contains(named, F.col("shard"))), live.where(F.array_contains(named, F.col("shard")))


# Terms that are broadcast at most; more of them are met by a shuffle.
_FEW = 100_000


def _matching(index: Index, asked: DataFrame, restrictions: DataFrame) -> DataFrame:
    """asked(term, salts, dense, on_date, standard_ids, ...) with the rows in force and wanted that hold its term.

    What is restricted meets the rows of its standards alone, by key: a common term has too many others. Dense terms
    meet `counts`, and only if some are asked for.
    """
    held = _held(index.postings, asked.where("NOT dense").drop("dense"), restrictions)
    dense = asked.where("dense").drop("dense")
    if dense.limit(1).count():
        few = F.broadcast(dense.select("term", "salts").distinct())
        rows = _by_term(index.counts.join(few, "term").withColumn("salt", _salt("salts")))
        held = held.unionByName(_held(rows, dense, restrictions, F.broadcast))
    return held.where(_IN_FORCE)


def _held(postings: DataFrame, asked: DataFrame, restrictions: DataFrame, small=lambda df: df) -> DataFrame:
    """asked(term, salts, on_date, standard_ids, ...) with the postings of its terms; `small` marks the free ones where they are few."""
    every, some = _readable(postings, restrictions)
    salted = asked.where(_FREE).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    named = asked.where(f"NOT {_FREE}").withColumn("standard_id", F.explode(F.array_distinct("standard_ids"))).drop("salts")
    size = named.limit(_FEW + 1).count()
    held = every.join(small(salted) if salted.limit(_FEW + 1).count() <= _FEW else salted, ["term", "salt"])
    if size:
        held = held.unionByName(some.join(F.broadcast(named) if size <= _FEW else named, ["term", "standard_id"]))
    return held


def candidates(index: Index, leading: DataFrame, restrictions: DataFrame) -> DataFrame:
    """(query_id, clause_id, standard_id): clauses in force and wanted that hold a leading term of a query.

    restrictions(query_id, on_date, standard_ids): all queries. Date and standards are tested inside the join.
    """
    asked = leading.select("query_id", "term", "salts", "dense", "on_date", "standard_ids")
    return _matching(index, asked, restrictions).select("query_id", "clause_id", "standard_id").distinct()


def champions(index: Index, leading: DataFrame, restrictions: DataFrame) -> DataFrame:
    """(query_id, clause_id, standard_id): of the clauses in force and wanted that hold a leading term, the best by that term.

    As many as any query gets, found once for all queries that weigh the term alike on the same day and standards.
    """
    alike = ["term", "weight", "on_date", "standard_ids"]
    named = leading.withColumn("_need", F.md5(F.to_json(F.struct(*alike))))
    needs = named.select("_need", "salts", "dense", *alike).distinct()
    held = _matching(index, needs, restrictions).where("clause_id IS NOT NULL")
    scored = held.withColumn("_part", F.round(_part(index.stats.select("avgdl").scalar()), 9))
    best = top_rows(scored.select("_need", "clause_id", "standard_id", "_part"), ["_need"], [F.col("_part").desc(), F.col("clause_id")], texts.MAX_HITS)
    return named.select("query_id", "_need").join(best, "_need").select("query_id", "clause_id", "standard_id")


def _complete(index: Index, leading: DataFrame, asked: DataFrame, restrictions: DataFrame, last: Column) -> DataFrame:
    """Full scores of the clauses in force that hold a leading term of a query.

    Only leading terms generate candidates; all of the query's terms are looked up for those candidates. Of a
    leading term that is `last` only the champions are taken.
    """
    last = last & index.stats.select("unique").scalar()
    found = candidates(index, leading.where(~last), restrictions)
    best = leading.where(last)
    if best.limit(1).count():
        found = found.union(champions(index, best, restrictions)).distinct()
    words = asked.select("query_id", "n_terms", "term", "weight", "dense")
    checks = keyed_join(found, words.where("NOT dense").drop("dense"), ["query_id"], "inner")
    # A lookup is unique per (clause, term), so a check finds at most one.
    # Checks are the fewer, so that the lookup is read through them without being sorted.
    parts = checks.hint("shuffle_hash").join(index.lookup, ["clause_id", "term"]).select(*_KEYS, "weight", "tf", "dl")
    dense = words.where("dense")
    if dense.limit(1).count():
        parts = parts.unionByName(_dense_parts(index, found, dense))
    return _summed(parts, index)


def _dense_parts(index: Index, found: DataFrame, words: DataFrame) -> DataFrame:
    """(query_id, clause_id, standard_id, n_terms, weight, tf, dl): the dense words of the queries in the clauses found.

    A clause's counts of these words are together, and meet what is found by clause alone.
    """
    asked = words.groupBy("query_id", "n_terms").agg(F.collect_list(F.struct("term", "weight")).alias("_words"))
    rows = index.counts.join(F.broadcast(words.select("term").distinct()), "term", "left_semi")
    held = rows.groupBy("clause_id").agg(F.collect_list(F.struct("term", "tf", "dl")).alias("_held"))
    both = keyed_join(found, asked, ["query_id"], "inner").join(held, "clause_id")
    of = "flatten(transform(_words, w -> transform(filter(_held, h -> h.term = w.term), h -> struct(w.weight, h.tf, h.dl))))"
    return each(both, _KEYS, F.expr(of), "_part").select(*_KEYS, "_part.*")


def search(
    queries: DataFrame, index: Index, lemmas: DataFrame | None = None
) -> DataFrame:
    """queries(query_id, query, on_date, standard_ids, k) -> (query_id, rank, clause_id, standard_id, score).

    A clause must hold every term of the query; only for queries without such a clause in the
    editions in force does any term do. `k` is cut to the largest allowed number of hits, and a
    `k` below 1 is an error, which `search_messages` reports. Common terms generate no candidates where rarer ones decide:

    1. Whatever holds all terms holds the rarest one: candidates come from it alone.
    2. Queries left open are tried on their rarest terms, as many as should give `k` hits. The
       k-th score reached this way is a floor for the final answer.
    3. Terms that even together cannot lift a clause to that floor are dropped as sources of
       candidates (their contribution is still counted). Without a floor every term stays one.
    4. Where all other terms of a query are such sources, its commonest term only adds clauses that hold
       no other: the best by that term are enough, as each of them scores no less than by it alone.
    """
    limits = queries.select("query_id", "on_date", "standard_ids", F.least("k", F.lit(texts.MAX_HITS)).alias("k")).where("k >= 1")
    asked = weighted(query_terms(queries, lemmas), index).join(limits, "query_id")
    by_rarity = Window.partitionBy("query_id").orderBy("df", "term")
    earlier = by_rarity.rowsBetween(Window.unboundedPreceding, -1)
    lightest = Window.partitionBy("query_id").orderBy("weight", "term")
    bound = F.col("weight") * (texts.BM25_K1 + 1)
    commonest = Window.partitionBy("query_id").orderBy(F.col("df").desc(), F.col("term").desc())
    known = asked.where("df > 0").withColumns({
        "_at": F.row_number().over(by_rarity),
        "_last": F.row_number().over(commonest) == 1,
        "_covered": F.coalesce(F.sum("df").over(earlier), F.lit(0)),
        "_reach": F.sum(bound).over(lightest.rowsBetween(Window.unboundedPreceding, 0)),
    })

    # Three small results cut the plan: each is read by several of the steps that follow.
    known = written(known, "query-terms")
    strict = written(_top(_complete(index, known.where("_at = 1"), known, limits, F.col("_last")).where("matched = n_terms"), known), "strict-hits")
    open_terms = known.join(strict.select("query_id").distinct(), "query_id", "left_anti")
    seeds = open_terms.where(F.col("_covered") < _ENOUGH * F.col("k"))
    tried = written(_top(_complete(index, seeds, open_terms, limits, F.col("_last")), open_terms), "tried-hits")
    floors = tried.groupBy("query_id").agg(F.min("score").alias("floor"), F.count("*").alias("got"))
    judged = open_terms.join(floors, "query_id", "left")
    idle = F.coalesce((F.col("got") >= F.col("k")) & (F.col("_reach") < F.col("floor") - _MARGIN), F.lit(False))
    judged = judged.withColumn("_idle", idle).withColumn("_all", ~F.max("_idle").over(Window.partitionBy("query_id")))
    loose = _top(_complete(index, judged.where("NOT _idle"), open_terms, limits, F.col("_last") & F.col("_all")), open_terms)
    return strict.unionByName(loose)


# Seeds should cover this many times the wanted number of hits.
_ENOUGH = 4
# Room for the rounding of scores when they are ranked.
_MARGIN = 1e-6


def _top(scored: DataFrame, asked: DataFrame) -> DataFrame:
    """The best hits per query, ties broken by clause."""
    best = top_rows(
        scored, ["query_id"], [F.round("score", 9).desc(), F.col("clause_id")], texts.MAX_HITS
    )
    limits = asked.groupBy("query_id").agg(F.max("k").alias("k"))
    return best.join(limits, "query_id").where("rank <= k").select(
        "query_id", "rank", "clause_id", "standard_id", "score"
    )


def present(hits: DataFrame, queries: DataFrame, clauses: DataFrame, standards: DataFrame) -> DataFrame:
    """Attach title, path, heading, snippet and status on the asked date to the hits."""
    # Only the clauses that were hit are taken along, cut to what is shown.
    body = clauses.select(
        F.col("id").alias("clause_id"), "path", "heading", snippet(F.col("text")).alias("snippet")
    ).join(hits.select("clause_id").distinct(), "clause_id", "left_semi")
    std = standards.select(
        F.col("id").alias("standard_id"), F.col("title").alias("standard_title"),
        "effective_from", "effective_to",
    )
    dated = hits.join(queries.select("query_id", "on_date"), "query_id")
    full = keyed_join(keyed_join(dated, body, ["clause_id"], "inner"), std, ["standard_id"], "inner")
    return temporal.with_status(full).select(
        "query_id", "rank", "clause_id", "standard_id", "standard_title", "path", "heading",
        "snippet", "score", "status",
    )


def search_messages(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """(query_id, hits, message, error): queries without any hit get the hint.

    A `k` below 1 (or null) is an error: nothing was searched, so there is no message.
    """
    counted = hits.groupBy("query_id").agg(F.count("*").alias("hits"))
    joined = queries.select("query_id", F.coalesce(F.col("k") >= 1, F.lit(False)).alias("_asked")).join(counted, "query_id", "left")
    asked = F.col("_asked")
    return joined.select(
        "query_id",
        F.coalesce("hits", F.lit(0)).alias("hits"),
        F.when(~asked, None).when(F.col("hits") > 0, "").otherwise(texts.MSG_NO_HITS).alias("message"),
        F.when(~asked, texts.MSG_BAD_LIMIT).alias("error"),
    )


def judge(golden: DataFrame, hits: DataFrame, k: int = 3) -> DataFrame:
    """golden(query_id, expect_id, expect_group, lexical_limitation) -> adds `hit`.

    hits(query_id, rank, clause_id): whether the expected clause is among the first `k`.
    """
    top = hits.where(F.col("rank") <= k).select(
        "query_id", F.col("clause_id").alias("expect_id"), F.lit(True).alias("_hit")
    )
    return golden.join(top.distinct(), ["query_id", "expect_id"], "left").withColumn(
        "hit", F.coalesce("_hit", F.lit(False))
    ).drop("_hit")


def hit_rate(judged: DataFrame) -> DataFrame:
    """One row over the unmarked queries: queries, hits, rate."""
    scored = judged.where(~F.col("lexical_limitation"))
    return scored.agg(
        F.count("*").alias("queries"),
        F.sum(F.col("hit").cast("int")).alias("hits"),
        F.avg(F.col("hit").cast("int")).alias("rate"),
    )


def misses(judged: DataFrame) -> DataFrame:
    """Unmarked queries that missed, grouped by what they expected."""
    return judged.where(~F.col("lexical_limitation") & ~F.col("hit")).groupBy("expect_group").agg(
        F.count("*").alias("misses")
    )


def unexpectedly_passing(judged: DataFrame) -> DataFrame:
    """Queries marked as out of reach that hit all the same."""
    return judged.where(F.col("lexical_limitation") & F.col("hit"))


def relevance_gate(judged: DataFrame, least: float = texts.LEAST_HIT_RATE) -> DataFrame:
    """(expect_group, queries, hits, misses, rate, overall, passed): per group of the unmarked queries.

    `passed` holds for the whole evaluation: the rate over all unmarked queries reaches `least`, and no query
    marked as out of reach hits. The groups with misses are what a failed gate names.
    """
    one = F.when(F.col("hit"), 1).otherwise(0)
    scored = judged.where(~F.col("lexical_limitation"))
    overall = scored.agg(F.avg(one)).scalar()
    surprising = unexpectedly_passing(judged).agg(F.count("*")).scalar()
    grouped = scored.groupBy("expect_group").agg(F.count("*").alias("queries"), F.sum(one).alias("hits"), F.avg(one).alias("rate"))
    return grouped.select(
        "expect_group", "queries", "hits", (F.col("queries") - F.col("hits")).alias("misses"), "rate", overall.alias("overall"),
        ((overall >= least) & (surprising == 0)).alias("passed"),
    )
