"""Packing documents into sequences as a cutting-stock problem solved by column generation.

1. `pieces`: each task tokenises whole texts and cuts a document's ids into full sequences and a rest.
2. Rests are counted by length class (length rounded up to `GRAIN` tokens): a histogram of bounded size.
3. `patterns`: a linear program over that histogram. Its columns are patterns (how many rests of each class
   share a sequence); a knapsack dynamic program prices new columns by the dual values until none helps.
   Rounded down, the patterns take almost all rests; what is left over is filled largest first.
4. `pack`: documents are ranked within their class, and rank r takes the r-th place that the patterns offer.

Defined results: a null text is an empty one, whose only token is the end id; repeated rows are packed as
often as they come; a null doc_id is kept; other columns are ignored; an empty table gives no rows.
"""

import base64
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexspan.llm.common import gapless, stored

SEQUENCE = 2048
END_ID = 1
# Tokens per length class. A smaller grain pads less and makes a larger linear program.
GRAIN = 8
# Distinct words whose ids one task keeps: the first it meets, so the frequent ones; others are encoded anew.
CACHED_WORDS = 200_000
# The linear program stops when its bound proves it within this share of the optimum.
GAP = 0.002

PIECES = "doc_id long, start long, length long, doc_tokens long, ids binary"


class Encoder:
    """Ids of whole texts as little-endian unsigned 32-bit numbers, by a byte-level BPE vocabulary.

    The vocabulary's pre-tokenizer starts a new piece at a space that stands before a visible character.
    A text is therefore the sum of its parts at such spaces, and the ids of a part are kept for the next time.
    """

    def __init__(self, ranks: list[str], pattern: str):
        table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks)}
        self.bpe = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.known: dict[str, bytes] = {}

    def ids(self, text: str) -> bytes:
        return array("I", self.bpe.encode_ordinary(text)).tobytes()

    def __call__(self, text: str) -> bytes:
        parts = text.split(" ")
        known, out, room = self.known, [], CACHED_WORDS - len(self.known)
        # Parts that a space may belong to in another way (runs of blanks, line ends after a blank) are read together.
        held = parts[0]
        for part in parts[1:]:
            if part and not part[0].isspace():
                ids = known.get(held)
                if ids is None:
                    ids = self.ids(held)
                    if room > 0:
                        known[held], room = ids, room - 1
                out.append(ids)
                held = " " + part
            else:
                held += " " + part
        out.append(self.ids(held))
        return b"".join(out)


def pieces(docs: DataFrame, ranks_path: str, pattern: str, length: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """Every document's ids and the end id, cut into runs of `length` and one shorter rest."""
    with open(ranks_path) as file:
        ranks = docs.sparkSession.sparkContext.broadcast(file.read().splitlines())
    end, width = np.array([end_id], dtype="<u4").tobytes(), 4 * length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(ranks.value, pattern)
        kinds = [pa.int64()] * 4 + [pa.binary()]
        for batch in batches:
            out, held = [[] for _ in kinds], 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encoder(text.as_py() or "") + end
                for at in range(0, len(ids), width):
                    part = ids[at : at + width]
                    for column, value in zip(out, (doc_id, at // 4, len(part) // 4, len(ids) // 4, part), strict=True):
                        column.append(value)
                held += len(ids)
                if held > 1 << 23:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["doc_id", "start", "length", "doc_tokens", "ids"])
                    out, held = [[] for _ in kinds], 0
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["doc_id", "start", "length", "doc_tokens", "ids"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECES)


def priced_columns(values, capacity: int):
    """Unbounded knapsack over items of size 1..capacity: the best filling's value, and for each class the
    best filling that holds it, when that is worth more than one sequence; classes without demand are worth -1."""
    best, last = np.zeros(capacity + 1), np.zeros(capacity + 1, dtype=np.int64)
    for room in range(1, capacity + 1):
        with_item = values[1 : room + 1] + best[room - 1 :: -1][:room]
        k = int(np.argmax(with_item))
        best[room], last[room] = best[room - 1], 0
        if with_item[k] > best[room] + 1e-12:
            best[room], last[room] = with_item[k], k + 1
    out = []
    for k in range(1, capacity + 1):
        if values[k] >= 0 and values[k] + best[capacity - k] > 1 + 1e-9:
            counts, room = np.zeros(capacity + 1), capacity - k
            counts[k] = 1
            while room:
                if last[room]:
                    counts[last[room]] += 1
                room -= int(last[room]) or 1
            out.append(counts)
    return best[capacity], out


def patterns(histogram: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Patterns (class -> count) with how often each is used; together they hold the histogram exactly.

    The work depends on the number of classes, not on the number of documents.
    """
    sizes = sorted(k for k, n in histogram.items() if n)
    if not sizes:
        return []
    demand = np.array([histogram[k] for k in sizes], dtype=float)
    columns = []
    for row, k in enumerate(sizes):
        column = np.zeros(len(sizes))
        column[row] = capacity // k
        columns.append(column)
    inverse = np.diag([1 / (capacity // k) for k in sizes])
    amounts = inverse @ demand
    values = np.zeros(capacity + 1)
    # No packing can need less than all lengths together, nor less than the dual bound of the program.
    material = demand @ np.array(sizes) / capacity
    for _ in range(20 * len(sizes)):
        if amounts.sum() <= (1 + GAP) * material:
            break
        values[:] = -1
        values[sizes] = inverse.sum(axis=0)
        value, pool = priced_columns(values, capacity)
        if not pool or 1 - 1 / value <= GAP:
            break
        pool = np.array(pool)[:, sizes]
        # The priced columns enter one after the other, as long as the changed dual values still favour one.
        for _ in range(len(pool)):
            gains = pool @ inverse.sum(axis=0)
            entering = pool[int(np.argmax(gains))]
            change = inverse @ entering
            up = change > 1e-9
            if gains.max() <= 1 + 1e-9 or not up.any():
                break
            ratio = np.where(up, amounts / np.where(up, change, 1), np.inf)
            leave = int(np.argmin(ratio))
            step = max(0.0, ratio[leave])
            amounts -= step * change
            amounts[leave] = step
            np.maximum(amounts, 0, out=amounts)
            columns[leave] = entering
            pivot = inverse[leave] / change[leave]
            inverse -= np.outer(change, pivot)
            inverse[leave] = pivot
    left = {k: int(histogram[k]) for k in sizes}
    used = []
    for column, amount in sorted(zip(columns, amounts, strict=True), key=lambda x: -x[1]):
        counts = {k: int(c) for k, c in zip(sizes, column, strict=True) if c}
        times = min([int(amount + 1e-6), *(left[k] // c for k, c in counts.items())])
        if times:
            used.append((counts, times))
            for k, c in counts.items():
                left[k] -= c * times
    # The rest: largest class that still fits, as often as it fits; equal fillings are taken together.
    while any(left.values()):
        room, counts = capacity, {}
        for k in reversed(sizes):
            c = min(left[k], room // k)
            if c:
                counts[k] = c
                room -= c * k
        times = min(left[k] // c for k, c in counts.items())
        used.append((counts, times))
        for k, c in counts.items():
            left[k] -= c * times
    return used


def places(spark: SparkSession, used: list[tuple[dict[int, int], int]]) -> DataFrame:
    """The places that the patterns offer: for each class, runs of ranks with the sequence of the first.

    Their number is bounded by classes and patterns.
    """
    rows, base, offered = [], 0, {}
    for counts, times in used:
        order = 0
        for k, c in sorted(counts.items(), reverse=True):
            for _ in range(c):
                first = offered.get(k, 0)
                rows.append((k, first, first + times, base, order))
                offered[k], order = first + times, order + 1
        base += times
    return spark.createDataFrame(rows, "class int, first long, until long, base long, item int")


def pack(table: DataFrame, length: int = SEQUENCE, grain: int = GRAIN) -> DataFrame:
    """Sequence and offset of every piece; `table` is a stored one with `length` and further columns."""
    spark = table.sparkSession
    capacity = length // grain
    classed = table.withColumn("class", F.ceil(F.col("length") / F.lit(grain)).cast("int"))
    histogram = {r["class"]: r["n"] for r in classed.groupBy("class").agg(F.count("*").alias("n")).collect()}
    full = histogram.pop(capacity, 0)
    used = patterns(histogram, capacity)
    if full:
        used.append(({capacity: 1}, full))
    offered = F.broadcast(places(spark, used))
    ranked = gapless(classed, ["class"], "rank")
    placed = ranked.join(offered, "class").where("rank >= first and rank < until")
    placed = placed.withColumn("sequence_id", F.col("base") + F.col("rank") - F.col("first"))
    before = Window.partitionBy("sequence_id").orderBy("item").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0))).drop(
        "class", "rank", "first", "until", "base", "item", "_mid"
    )


def sequences(packed: DataFrame) -> DataFrame:
    """The token ids of each sequence, pieces in order; a sequence is bounded by its length."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    ids = F.aggregate(parts, F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["ids"]))
    return packed.groupBy("sequence_id").agg(ids.alias("ids"), F.sum("length").alias("tokens"))


def digests(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Tokenise, store the pieces once, pack: one row per piece with the checksum of its ids."""
    whole = stored(pieces(docs, ranks_path, pattern), "pieces")
    thin = whole.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "_mid")
    return pack(thin).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
