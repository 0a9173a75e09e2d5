"""Trie of conversation prefixes, with count-min screening of prefix digests.

1. `rebuilt`: conversations as rows (conv_id, depth, digest of the turn). `digested` gives every prefix a 128-bit digest: two
   running sums without carries over hashes of (position, turn), so that a window that holds one value makes them.
2. `sketch`: tasks count the digests of their prefixes in `ROWS` rows of cells; counts stop at two. The bits that say which
   cells were met more than once are the broadcast, of bounded size.
3. A prefix with a cell met once is proven to belong to one conversation, and so is all that follows it there: these tails
   become nodes where they are. Only prefixes that may be shared are shuffled by digest and grouped exactly.
4. The smallest member of a node stands for it. Along a conversation the nodes it stands for are its last ones, so one
   running sum from the end of every conversation, added up per node, gives all sums over subtrees without walking levels.

Defined results: turns are ordered by turn (null first), then role, then the digest of the text; null roles and texts are empty; a row without a
conv_id belongs to no conversation; repeated rows are turns of their own; other columns are ignored; an empty table gives no
rows. Numbers of turns are unbounded: conversations are windows that spill, never one cell.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexspan.functions.scale import written
from lexspan.llm.common import mix64

FAMILY = 5
KEPT = 9
# Rows of the sketch; cells in a row for each prefix, and at most.
ROWS = 4
CELLS_EACH = 8
MOST_CELLS = 1 << 24
# Cells that one task merges, and bytes of listed members that are hashed as one block.
SLICE = 1 << 16
LISTED = 1 << 16

NOTHING = hashlib.sha256(b"").hexdigest()


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, depth, x, y, bytes): the turns of each conversation from 1, with a 128-bit digest of role and text."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), text.alias("text"))
    # The digest takes the text's place before the shuffle, and orders the texts of turns that are otherwise tied.
    whole = F.md5(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"))
    thin = rows.select("conv_id", "turn", "role", whole.alias("digest"), F.octet_length("text").cast("long").alias("bytes"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "digest")
    half = lambda at: F.conv(F.substring("digest", at, 16), 16, -10).cast("long")
    return thin.select("conv_id", F.row_number().over(order).cast("long").alias("depth"), half(1).alias("x"), half(17).alias("y"), "bytes")


def rebuilt(own: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin with turns of their family's first one, as (conv_id, depth, x, y, bytes), and their
    lengths (conv_id, total); `own` is a table from `turns`."""
    lengths = own.groupBy("conv_id").agg(F.max("depth").alias("length"))
    head = F.col("conv_id") - F.col("conv_id") % FAMILY
    kept = F.crc32(F.col("conv_id").cast("string").cast("binary")) % KEPT
    lengths = lengths.select("conv_id", "length", head.alias("head"), kept.alias("kept"))
    heads = lengths.where("conv_id = head").select("head", F.col("length").alias("lent"))
    plan = lengths.join(heads, "head", "left").withColumn("lent", F.least("kept", F.coalesce("lent", F.lit(0))))
    # The first of a family lends to itself what it had.
    plan = plan.select("conv_id", "head", "kept", "lent", (F.col("lent") + F.greatest(F.lit(0), F.col("length") - F.col("kept"))).alias("total"))
    plan = written(plan, "families")
    after = own.join(plan.select("conv_id", "kept", "lent"), "conv_id").where("depth > kept")
    after = after.select("conv_id", (F.col("depth") - F.col("kept") + F.col("lent")).alias("depth"), "x", "y", "bytes")
    lending = own.where(F.col("depth") < KEPT).where(F.col("conv_id") % FAMILY == 0).withColumnRenamed("conv_id", "head")
    before = plan.where("lent > 0").select("conv_id", "head", "lent").join(lending, "head").where("depth <= lent")
    return after.union(before.select("conv_id", "depth", "x", "y", "bytes")), plan.select("conv_id", "total")


def digested(rows: DataFrame) -> DataFrame:
    """Rows with the digest (a, b) of the prefix that ends there instead of the turn's own."""
    path = Window.partitionBy("conv_id").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    placed = [F.xxhash64(F.lit(k), "depth", "x", "y") for k in (1, 2)]
    return rows.select("conv_id", "depth", *[F.bit_xor(h).over(path).alias(n) for h, n in zip(placed, "ab", strict=True)], "bytes")


def cells(a, b, size: int):
    """The cell of each digest in each row of the sketch."""
    a, b = a.view(np.uint64), b.view(np.uint64) | np.uint64(1)
    return [(mix64(a + np.uint64(k) * b) & np.uint64(size - 1)).astype(np.int64) + k * size for k in range(ROWS)]


def sketch(prefixes: DataFrame, size: int) -> bytes:
    """Bits of the cells that were met more than once, by all prefixes (a, b)."""
    cell = np.dtype("<u4")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(ROWS * size, dtype=np.uint8)
        for batch in batches:
            a, b = batch.column("a").to_numpy(), batch.column("b").to_numpy()
            for here in cells(a, b, size):
                found, times = np.unique(here, return_counts=True)
                held[found] = np.minimum(held[found] + np.minimum(times, 2), 2)
        for at in range(0, len(held), SLICE):
            part = held[at : at + SLICE]
            once, more = np.flatnonzero(part == 1).astype(cell).tobytes(), np.flatnonzero(part == 2).astype(cell).tobytes()
            if once or more:
                yield pa.RecordBatch.from_arrays([pa.array([at // SLICE], pa.int32()), pa.array([once], pa.binary()), pa.array([more], pa.binary())], names=["slice", "once", "more"])

    def merge(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(SLICE, dtype=np.uint8)
        for batch in batches:
            for once, more in zip(batch.column("once").to_pylist(), batch.column("more").to_pylist(), strict=True):
                for data, times in ((once, 1), (more, 2)):
                    at = np.frombuffer(data, dtype=cell)
                    held[at] = np.minimum(held[at] + times, 2)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([np.packbits(held == 2).tobytes()], pa.binary())], names=["slice", "bits"])

    parts = prefixes.select("a", "b").mapInArrow(count, "slice int, once binary, more binary")
    found = parts.groupBy("slice").applyInArrow(merge, "slice int, bits binary").toArrow()
    bits = bytearray(max(SLICE, ROWS * size) // 8)
    for k, data in zip(found.column("slice").to_pylist(), found.column("bits").to_pylist(), strict=True):
        bits[k * SLICE // 8 : (k + 1) * SLICE // 8] = data
    return bytes(bits)


def screened(prefixes: DataFrame, size: int, bits) -> DataFrame:
    """Prefixes with `tail`: whether they are proven to belong to one conversation."""
    names = prefixes.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(bits.value, dtype=np.uint8)
        # Conversation and depth of the last row, and whether it is proven.
        last = (None, None, False)
        for batch in batches:
            conv, depth = batch.column("conv_id").to_numpy(), batch.column("depth").to_numpy()
            shared = np.ones(len(conv), dtype=bool)
            for here in cells(batch.column("a").to_numpy(), batch.column("b").to_numpy(), size):
                shared &= (table[here >> 3] >> (7 - (here & 7)) & 1).astype(bool)
            tail = ~shared
            if len(conv):
                # Where a row follows the prefix one turn shorter, and that is proven, it is proven too.
                start = np.concatenate([[True], (conv[1:] != conv[:-1]) | (depth[1:] != depth[:-1] + 1)])
                tail[0] |= last[2] and conv[0] == last[0] and depth[0] == last[1] + 1
                first = np.maximum.accumulate(np.where(start, np.arange(len(conv)), 0))
                tail = np.maximum.accumulate(np.where(tail, np.arange(len(conv)), -1)) >= first
                last = (conv[-1], depth[-1], bool(tail[-1]))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(tail)], names=[*names, "tail"])

    schema = ", ".join(f"{c} {t}" for c, t in prefixes.dtypes)
    return prefixes.mapInArrow(run, f"{schema}, tail boolean")


def listed(ends: DataFrame) -> DataFrame:
    """(a, b, depth, ends_sha256) of members (a, b, depth, conv_id): the digest of their ids, ascending, comma-joined.

    Ids are joined into blocks where they lie after a sort over all tasks, so that a node that ends most conversations is
    dealt over many of them; the digest, which has no parts, then passes over a few blocks, one at a time.
    """
    key = ["a", "b", "depth"]

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, first, held, size = None, None, [], 0

        def block():
            values = [*now, first, ",".join(held).encode()]
            kinds = [pa.int64()] * 4 + [pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=[*key, "first", "ids"])

        for batch in batches:
            for *node, conv in zip(*(batch.column(c).to_pylist() for c in (*key, "conv_id")), strict=True):
                if node != now or size > LISTED:
                    if now is not None:
                        yield block()
                    now, first, held, size = node, conv, [], 0
                held.append(str(conv))
                size += len(held[-1]) + 1
        if now is not None:
            yield block()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None

        def row():
            return pa.RecordBatch.from_arrays([*(pa.array([v], pa.int64()) for v in now), pa.array([state.hexdigest()])], names=[*key, "ends_sha256"])

        for batch in batches:
            for *node, ids in zip(*(batch.column(c).to_pylist() for c in (*key, "ids")), strict=True):
                if node != now:
                    if now is not None:
                        yield row()
                    now, state = node, hashlib.sha256(ids)
                else:
                    state.update(b"," + ids)
        if now is not None:
            yield row()

    parts = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = ends.select(*key, "conv_id").repartitionByRange(parts, *key, "conv_id").sortWithinPartitions(*key, "conv_id")
    blocks = dealt.mapInArrow(join, "a long, b long, depth long, first long, ids binary")
    rows = blocks.repartition(parts, *key).sortWithinPartitions(*key, "first")
    return rows.mapInArrow(digest, "a long, b long, depth long, ends_sha256 string")


def sha(ids: Column) -> Column:
    return F.sha2(ids.cast("string").cast("binary"), 256)


def trie(conversations: DataFrame) -> DataFrame:
    """One row per node of the rebuilt conversations' trie: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256."""
    spark = conversations.sparkSession
    rows, lengths = rebuilt(written(turns(conversations), "turns"))
    lengths = written(lengths, "lengths")
    prefixes = written(digested(rows).join(lengths, "conv_id"), "prefixes")
    size = SLICE // ROWS
    while size < min(MOST_CELLS, CELLS_EACH * prefixes.count()):
        size *= 2
    bits = spark.sparkContext.broadcast(sketch(prefixes, size))
    marked = written(screened(prefixes, size, bits), "screened")

    key = ["a", "b", "depth"]
    empty = lengths.select("conv_id", F.lit(0).cast("long").alias("depth"), *[F.lit(0).cast("long").alias(c) for c in ("a", "b", "bytes")], "total")
    maybe = marked.where("not tail").drop("tail").unionByName(empty)
    ends = F.sum((F.col("depth") == F.col("total")).cast("long"))
    grouped = maybe.groupBy(*key).agg(F.min("conv_id").alias("top"), F.count("*").alias("n_convs"), ends.alias("n_ends"), F.max("bytes").alias("size"))
    nodes = written(grouped, "nodes")

    # Every prefix with its node's smallest member; the empty one's, which all share, is a single row.
    inner = maybe.where("depth > 0").join(nodes.where("depth > 0"), key)
    root = F.broadcast(nodes.where("depth = 0"))
    seen = inner.unionByName(maybe.where("depth = 0").join(root, key))
    stands = F.col("top") == F.col("conv_id")
    down, up = Window.partitionBy("conv_id").orderBy("depth"), Window.partitionBy("conv_id").orderBy(F.desc("depth"))
    so_far = up.rowsBetween(Window.unboundedPreceding, 0)
    childless = F.when(F.col("depth") == F.col("total"), stands & (F.col("n_ends") == F.col("n_convs"))).otherwise(F.row_number().over(up) == 1)
    above = F.when(F.lag("depth").over(down) == F.col("depth") - 1, F.lag("top").over(down)).otherwise(F.col("conv_id"))
    seen = seen.select(
        *key, "conv_id", "top", "total", stands.alias("stands"), F.when(F.col("depth") > 0, above).alias("parent"),
        F.when(stands, (F.col("n_convs") - 1) * F.col("size")).otherwise(F.lit(0)).alias("saved"), childless.cast("long").alias("leaf"),
    )
    seen = seen.withColumns({"saved": F.sum("saved").over(so_far), "leaf": F.sum("leaf").over(so_far)})
    seen = written(seen, "seen")

    # A node's parent, sums over its subtree, and its children: nodes of which its conversations name it as parent, told
    # by depth and smallest member, and the first prefixes of tails.
    sums = seen.groupBy(*key).agg(F.sum("saved").alias("saved_tokens"), F.sum("leaf").alias("n_leaves"), F.max(F.when(F.col("stands"), F.col("parent"))).alias("parent_conv_id"))
    tails = marked.where("tail")
    reached = seen.select("conv_id", (F.col("depth") + 1).alias("depth"), "top")
    first = tails.join(reached, ["conv_id", "depth"], "left").select(
        "conv_id", "depth", F.coalesce("top", "conv_id").alias("parent_conv_id"), F.col("top").isNotNull().alias("opens"), "total"
    )
    first = written(first, "tails")
    summed = written(nodes.join(sums, key), "sums")
    named = summed.where("depth > 0").select("parent_conv_id", (F.col("depth") - 1).alias("depth"))
    named = named.union(first.where("opens").select("parent_conv_id", F.col("depth") - 1))
    children = named.groupBy(F.col("parent_conv_id").alias("top"), "depth").agg(F.count("*").alias("n_children"))
    members = listed(maybe.where("depth = total").select(*key, "conv_id"))
    shared = summed.join(children, ["top", "depth"], "left").join(members, key, "left").select(
        F.col("top").alias("conv_id"), "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), "n_leaves",
        "saved_tokens", F.coalesce("ends_sha256", F.lit(NOTHING)).alias("ends_sha256"),
    )
    ending = F.col("depth") == F.col("total")
    single = first.select(
        "conv_id", "depth", "parent_conv_id", F.lit(1).cast("long").alias("n_convs"), (~ending).cast("long").alias("n_children"),
        F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"), F.when(ending, sha(F.col("conv_id"))).otherwise(F.lit(NOTHING)).alias("ends_sha256"),
    )
    return shared.unionByName(single)
