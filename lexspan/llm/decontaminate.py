"""Benchmark decontamination with SimHash windows and a multi-index Hamming search, in DataFrame functions only.

1. Texts become words (runs of letters and digits, lower-cased) and these five-word shingles. A window that
   reaches the similarity shares a shingle with its item, so only windows as long as an item that hold one of
   the shingles of items of that length are laid; no other window can match.
2. A window's fingerprint has 64 bits: bit b is set when most of its shingles' hashes have it set.
   A document's counters run on from shingle to shingle, and a window's are the difference of two of them, so that
   a window costs two rows however long it is.
3. Fingerprints are cut into `BLOCKS` parts. Two within `RADIUS` bits differ in at most RADIUS / BLOCKS of some part,
   so an item is filed under every value that close to its own, and a window looks up its own values: no pair within
   the radius is missed.
4. Pairs within the radius are verified exactly: shingles weighted by how often they occur, the sum of the smaller
   weights over the sum of the larger ones. What a shingle adds, it adds to a run of starts: its windows in which it
   has not stood as often as in the item before. Two events a shingle, summed up along the starts, verify all windows.

Defined results: a null text, or one of under five words, has no shingles and matches nothing, as document or as item;
a window at the end of a text may be shorter than its item; equal rows are one document; of several windows for one
item the most similar counts, the earliest among equals; other columns are ignored; empty tables give no rows.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexspan.functions.columns import bind
from lexspan.functions.scale import each, written
from lexspan.llm.common import checked, free_name, row_key

WORDS = 5
SIMILARITY = 0.8
# Bits in which the fingerprints of two passages at the similarity may differ: on average ten, rarely over eighteen.
RADIUS = 20
BLOCKS = 7
# Fixed value: what separates words.
BETWEEN_WORDS = r"[^\p{L}\p{N}]+"

BITS = 64
# Counters of two bits share a long, 31 bits each: no text has more shingles.
COUNTER = 31
LANE = 2
LANES = [f"lane{k}" for k in range(BITS // LANE)]


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), BETWEEN_WORDS), "")


def shingle_hashes(text: Column) -> Column:
    """Hashes of all runs of five words of a text in order; null where there is none.

    The words are bound to a lambda variable, so that they are split once and not once per run.
    """

    def runs(tokens):
        found = F.transform(F.sequence(F.lit(1), F.size(tokens) - (WORDS - 1)), lambda i: F.xxhash64(F.slice(tokens, i, WORDS)))
        return F.when(F.size(tokens) >= WORDS, found)

    return bind(words(text), runs)


def lanes() -> list[Column]:
    """The bits of `hash` as counters, `LANE` of them in each long; written as SQL, as so many calls would take seconds."""
    bit = lambda b, at: f"shiftleft(shiftrightunsigned(hash, {b}) & 1L, {COUNTER * at})"
    return [F.expr(" + ".join(bit(LANE * k + at, at) for at in range(LANE))) for k in range(len(LANES))]


def majority() -> Column:
    """The fingerprint of `n` shingles from their summed counters."""
    ones = lambda bit: f"(shiftrightunsigned({LANES[bit // LANE]}, {COUNTER * (bit % LANE)}) & {(1 << COUNTER) - 1}L)"
    return F.expr(" | ".join(f"if({ones(bit)} * 2 > n, shiftleft(1L, {bit}), 0L)" for bit in range(BITS)))


def fingerprint(rows: DataFrame, by: list[str]) -> DataFrame:
    """SimHash of the `hash` rows of each group: `print`, and the number of shingles `n`."""
    sums = rows.groupBy(*by).agg(F.count("*").alias("n"), *[F.sum(lane).alias(name) for lane, name in zip(lanes(), LANES, strict=True)])
    return sums.select(*by, "n", majority().alias("print"))


def block_bounds() -> list[tuple[int, int]]:
    """(first bit, width) of each part of a fingerprint."""
    edges = [BITS * k // BLOCKS for k in range(BLOCKS + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def parts(value: Column, variants: bool) -> Column:
    """The parts of a fingerprint as (block, value); with `variants` every value within the part's radius."""
    out = []
    for block, (first, width) in enumerate(block_bounds()):
        own = F.shiftrightunsigned(value, first).bitwiseAND(F.lit((1 << width) - 1).cast("long"))
        masks = [m for m in range(1 << width) if bin(m).count("1") <= RADIUS // BLOCKS] if variants else [0]
        close = F.transform(F.expr(f"array({', '.join(f'{m}L' for m in masks)})"), lambda m, own=own: own.bitwiseXOR(m))
        out.append(F.transform(close, lambda v, block=block: F.struct(F.lit(block).alias("block"), v.alias("value"))))
    return F.concat(*out)


def item_tables(benchmark: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Shingles (item, size, hash, weight), their lengths (hash, size), and the index (item, item_id, size, block, value, item_print, item_n).

    `item` stands for one text of one id; `size` counts its words.
    """
    texts = benchmark.select("item_id", "text").dropDuplicates()
    hashes = texts.select("item_id", F.xxhash64("item_id", "text").alias("item"), shingle_hashes(F.col("text")).alias("hashes"))
    sized = each(hashes.withColumn("size", F.size("hashes") + WORDS - 1), ["item_id", "item", "size"], F.col("hashes"), "hash")
    rows = written(sized, "items")
    bags = rows.groupBy("item", "size", "hash").agg(F.count("*").cast("int").alias("weight"))
    lengths = rows.select("hash", "size").distinct()
    prints = fingerprint(rows, ["item_id", "item", "size"]).withColumnRenamed("n", "item_n").withColumnRenamed("print", "item_print")
    index = prints.select("*", F.explode(parts(F.col("item_print"), True)).alias("part")).select("*", "part.*").drop("part")
    return bags, lengths, index


def windows(docs: DataFrame, lengths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Windows that may match (key, size, start), and the shingles (key, hashes) of the documents that have one."""
    keyed = docs.select(row_key().alias("key"), "text")
    spots = each(keyed, ["key"], shingle_hashes(F.col("text")), "hash", "at")
    hits = spots.join(checked(lengths), "hash").groupBy("key", "size").agg(F.sort_array(F.collect_set("at")).alias("places"))
    # A place starts the windows that reach it, but for those that a place before it has started.
    before = lambda i: F.when(i > 0, F.get("places", i - 1) + 1).otherwise(0)
    runs = F.transform("places", lambda at, i: F.sequence(F.greatest(F.lit(0), at - F.col("size") + WORDS, before(i)), at))
    laid = written(each(each(hits, ["key", "size"], runs, "run"), ["key", "size"], F.col("run"), "start"), "windows")
    there = checked(laid.select("key").distinct())
    texts = keyed.join(there, "key", "left_semi").dropDuplicates(["key"])
    return laid, written(texts.select("key", shingle_hashes(F.col("text")).alias("hashes")), "hits")


def window_prints(laid: DataFrame, held: DataFrame) -> DataFrame:
    """(key, size, start, n, print) of every window; one shuffle of the documents' shingles and two rows a window."""
    none = lambda kind: F.lit(None).cast(kind)
    shingles = each(held, ["key"], F.col("hashes"), "hash", "at").select("key", "at", "hash", none("int").alias("size"), none("int").alias("start"), F.lit(0).alias("sign"))
    # What stands before a place, is counted there; behind the last shingle, all of the text is.
    ends = F.array(F.struct(F.col("start").alias("at"), F.lit(-1).alias("sign")), F.struct((F.col("start") + F.col("size") - (WORDS - 1)).alias("at"), F.lit(1).alias("sign")))
    marks = laid.select("key", "size", "start", F.explode(ends).alias("end")).select("key", "end.at", none("long").alias("hash"), "size", "start", "end.sign")
    order = Window.partitionBy("key").orderBy("at", F.col("sign") == 0).rowsBetween(Window.unboundedPreceding, 0)
    counted = [F.sum(F.coalesce(lane, F.lit(0).cast("long"))).over(order).alias(name) for lane, name in zip(lanes(), LANES, strict=True)]
    so_far = shingles.unionByName(marks).select("key", "size", "start", "sign", F.count("hash").over(order).alias("n"), *counted).where("sign <> 0")
    sums = so_far.groupBy("key", "size", "start").agg(*[F.expr(f"sum(sign * {c}) AS {c}") for c in ["n", *LANES]])
    return sums.select("key", "size", "start", "n", majority().alias("print"))


def shared(pairs: DataFrame, held: DataFrame, bags: DataFrame) -> DataFrame:
    """`pairs` (key, item, start, ...) with `both`: for all shingles, the smaller of their counts in the window and in the item."""
    with_pairs = checked(pairs.select("key", "item").distinct())
    there = held.join(checked(pairs.select("key").distinct()), "key", "left_semi")
    met = each(there, ["key"], F.col("hashes"), "hash", "at").join(checked(bags), "hash").join(with_pairs, ["key", "item"], "left_semi")
    placed = met.groupBy("key", "item", "size", "hash", "weight").agg(F.sort_array(F.collect_list("at")).alias("places"))
    # The shingle at a place counts for windows from behind the place where it stood `weight` times before.
    behind = lambda i: F.when(i >= F.col("weight"), F.get("places", i - F.col("weight")) + 1).otherwise(0)
    event = lambda at, by: F.struct(at.alias("at"), F.lit(by).alias("by"))
    events = F.flatten(F.transform("places", lambda at, i: F.array(event(F.greatest(F.lit(0), at - F.col("size") + WORDS, behind(i)), 1), event(at + 1, -1))))
    changes = each(placed, ["key", "item"], events, "event").groupBy("key", "item", "event.at").agg(F.sum("event.by").alias("by"))
    asked = pairs.withColumns({"at": F.col("start"), "by": F.lit(0).cast("long"), "asked": F.lit(True)})
    order = Window.partitionBy("key", "item").orderBy("at", F.col("asked").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    rows = asked.unionByName(changes, allowMissingColumns=True).withColumn("both", F.sum("by").over(order))
    return rows.where("asked").drop("at", "by", "asked")


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(key, doc_id, item_id, start, similarity) for every document that holds a passage like a benchmark item."""
    bags, lengths, index = item_tables(benchmark)
    laid, held = windows(docs, lengths)
    prints = window_prints(laid, held)
    looked = prints.select("*", F.explode(parts(F.col("print"), False)).alias("part")).select("*", "part.*").drop("part")
    near = looked.join(checked(index), ["size", "block", "value"])
    near = near.where(F.bit_count(F.col("print").bitwiseXOR(F.col("item_print"))) <= RADIUS)
    pairs = written(near.select("key", "start", "n", "item_id", "item", "item_n").distinct(), "pairs")
    common = shared(pairs, held, bags)
    scored = common.withColumn("similarity", F.col("both") / (F.col("n") + F.col("item_n") - F.col("both"))).where(F.col("similarity") >= SIMILARITY)
    best = scored.groupBy("key", "item_id").agg(F.min(F.struct((-F.col("similarity")).alias("less"), "start")).alias("best"))
    best = best.select("key", "item_id", F.col("best.start").alias("start"), (-F.col("best.less")).alias("similarity"))
    found = written(best, "leaks")
    ids = docs.select("doc_id", row_key().alias("key")).join(checked(found.select("key").distinct()), "key", "left_semi").distinct()
    return found.join(ids, "key").select("key", "doc_id", "item_id", "start", "similarity")


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """`docs` without the documents that hold a benchmark passage."""
    key = free_name(docs, "_leak_key")
    gone = checked(leaks(docs, benchmark).select(F.col("key").alias(key)).distinct())
    return docs.withColumn(key, row_key()).join(gone, key, "left_anti").select(*docs.columns)
