"""Helpers of the text operators: stored tables, gapless ranks, checked joins, words and their hashes."""

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexspan.functions.scale import scratch_dir, written

# Rows up to which one side of a join may be broadcast; each row is a few dozen bytes.
SMALL_ROWS = 1_000_000

_MULTIPLIER = 0x9E3779B97F4A7C15


def free_name(df: DataFrame, name: str) -> str:
    """`name`, with underscores in front until no column of `df` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Send Python tasks fewer rows at a time: a row is a whole text, and some texts are very long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def stored(df: DataFrame, name: str) -> DataFrame:
    """`df` as a Parquet table in the shared folder, with a unique `_mid` per row.

    `_mid >> 33` numbers the task that wrote the row, which bounds what one later window holds.
    """
    return written(df.withColumn("_mid", F.monotonically_increasing_id()), name)


def bucketed(df: DataFrame, name: str, by: str, buckets: int, partition: str) -> DataFrame:
    """`df` as a table in the shared folder, split by the values of `partition` and bucketed by `by`.

    A join on `by` leaves the table where it is, and only the other side is shuffled.
    """
    spark, table = df.sparkSession, f"lexspan_{name}_{uuid.uuid4().hex}"
    writer = df.write.format("parquet").option("path", f"{scratch_dir(spark)}/{table}").option("compression", "zstd")
    writer.partitionBy(partition).bucketBy(buckets, by).sortBy(by).saveAsTable(table)
    return spark.table(table)


def gapless(table: DataFrame, groups: list[str], name: str) -> DataFrame:
    """Number the rows of each group from 0 without gaps; `table` comes from `stored`.

    A window only holds the rows that one task wrote of one group; the counts of (group, task)
    give the offsets, so that a group with most rows is numbered by many tasks.
    """
    part = F.shiftright("_mid", 33)
    rows = table.withColumn("_part", part)
    counts = rows.groupBy(*groups, "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*groups).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*groups, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_from"))
    local = F.row_number().over(Window.partitionBy(*groups, "_part").orderBy("_mid")) - 1
    numbered = rows.withColumn("_local", local)
    return (
        numbered.join(offsets, [*groups, "_part"])
        .withColumn(name, F.col("_local") + F.col("_from"))
        .drop("_part", "_local", "_from")
    )


def checked(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """`df` marked for broadcast when it is counted to have at most `rows` rows, else as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def row_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """A key for a document row: its id and content; equal rows share it."""
    return F.xxhash64(F.col(doc_id), F.col(text))


def fold_table() -> bytes:
    """Byte table that lower-cases A-Z and turns every other ASCII byte but digits and letters into a space."""
    table = bytearray(range(256))
    for b in range(128):
        c = chr(b)
        table[b] = ord(c.lower()) if c.isalnum() else 32
    return bytes(table)


def mix64(x):
    """Finaliser of a 64-bit hash over a uint64 array."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHasher:
    """64-bit hashes of the words of a text, computed over its bytes at once.

    A word's hash is a polynomial in its bytes, read off prefix sums that are shifted back to the
    word's start by the inverse powers of the (odd) base, hence the same at every place.
    """

    def __init__(self):
        self.table = fold_table()
        self.inverse = np.uint64(pow(_MULTIPLIER, -1, 1 << 64))
        self.size = 0
        self.grow(1 << 16)

    def grow(self, n: int) -> None:
        def powers(base):
            out = np.full(n, base, dtype=np.uint64)
            out[0] = 1
            return np.multiply.accumulate(out)

        self.size = n
        self.up, self.down = powers(np.uint64(_MULTIPLIER)), powers(self.inverse)

    def __call__(self, text: bytes):
        """Hashes of the words, in order: runs of digits, letters and non-ASCII bytes, A-Z lowered."""
        data = np.frombuffer(text.translate(self.table), dtype=np.uint8)
        n = len(data)
        if n + 1 > self.size:
            self.grow(max(n + 1, 2 * self.size))
        inside = np.zeros(n + 2, dtype=np.int8)
        inside[1:-1] = data != 32
        edges = np.flatnonzero(np.diff(inside))
        start, end = edges[::2], edges[1::2]
        if not len(start):
            return np.empty(0, dtype=np.uint64)
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(data.astype(np.uint64) * self.up[:n], out=sums[1:])
        return mix64((sums[end] - sums[start]) * self.down[start] + (end - start).astype(np.uint64))


def shingles(words, size: int = 5):
    """Distinct hashes, sorted, of all runs of `size` words; a shorter text is one run; none without words."""
    n = len(words)
    if not n:
        return words
    if n < size:
        return np.array([mix64(chain(words)[None])[0]], dtype=np.uint64)
    total = np.zeros(n - size + 1, dtype=np.uint64)
    for k in range(size):
        total = total * np.uint64(_MULTIPLIER) + words[k : n - size + 1 + k]
    return np.unique(mix64(total))


def chain(words):
    """One hash of a short sequence of word hashes, its length included."""
    total = np.uint64(len(words))
    with np.errstate(over="ignore"):
        for w in words:
            total = total * np.uint64(_MULTIPLIER) + w
    return total


def groups(batches: Iterator[pa.RecordBatch], keys: list[str], rest: list[str]):
    """Rows of each group, as lists by column, of batches sorted by `keys`."""
    now, held = None, [[] for _ in rest]
    for batch in batches:
        if not batch.num_rows:
            continue
        key_columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, dtype=bool)
        for column in key_columns:
            change[1:] |= column[1:] != column[:-1]
        starts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        columns = [batch.column(c).to_pylist() for c in rest]
        for a, b in zip(starts, starts[1:], strict=False):
            key = tuple(c[a] for c in key_columns)
            if key != now:
                if now is not None:
                    yield now, held
                now, held = key, [[] for _ in rest]
            for column, values in zip(held, columns, strict=True):
                column.extend(values[a:b])
    if now is not None:
        yield now, held
