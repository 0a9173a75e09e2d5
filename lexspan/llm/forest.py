"""Approximate nearest neighbours with forests of hash prefixes.

Vectors are dealt into blocks of bounded size. In a block, every tree is a sorted array of long hash strings: the signs of
random projections, most significant first. A query descends each tree to the longest prefix it shares with some
string (a binary search, as strings with a common prefix stand next to each other), and then ascends all trees at once,
one bit at a time, until the vectors under its prefixes number enough. These candidates are scored exactly, and the
best of all blocks are merged. Queries travel in blocks too, so no task and no row grows with the input.

Nearness is the inner product. Vectors get one more coordinate that brings all of a block to the same norm, for which
larger inner products are smaller angles; queries have 0 there.

Defined results: vectors that are null, zero, of another length than the first query's in their block, or hold a null or
non-finite component take no part, neither do rows without an id; repeated query ids are one query; every other
row is a candidate of its own, so repeated rows come up once each; rows with the query's id are never its neighbours; with
fewer candidates than asked for, all are returned; other columns are ignored; an empty table gives no rows.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexspan.llm.common import stored

TREES = 128
BITS = 32
# Rows of a block, and queries that visit it together.
BLOCK = 4096
QUERIES = 2048
# The ascent goes on until the vectors under the prefixes, over all trees, number this share of the block and so many
# for each neighbour that is asked for; the second part matters in small blocks, whose neighbours are far.
ENOUGH = 0.75
PER_NEIGHBOUR = 40
SEED = 20_240_607


def usable(vector: Column) -> Column:
    """Whether a vector takes part: not null, finite everywhere, not zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(vector, lambda x: x != 0)


class Forest:
    """The trees of one block."""

    def __init__(self, vectors):
        self.vectors = vectors
        norms = np.sqrt((vectors**2).sum(axis=1))
        lifted = np.sqrt(np.maximum(norms.max() ** 2 - norms**2, 0))
        rng = np.random.default_rng(SEED)
        self.planes = rng.standard_normal((vectors.shape[1] + 1, TREES * BITS))
        strings = self.strings(np.hstack([vectors, lifted[:, None]]))
        self.order = np.argsort(strings, axis=1, kind="stable")
        self.sorted = np.take_along_axis(strings, self.order, axis=1)

    def strings(self, vectors):
        """Hash strings, trees x vectors, as integers whose first bit is the string's first."""
        out = np.zeros((TREES, len(vectors)), dtype=np.int64)
        for bit in range(BITS):
            out = out << 1 | (vectors @ self.planes[:, bit * TREES : (bit + 1) * TREES] > 0).T
        return out

    def under(self, strings, depth):
        """For each tree and query, the run of the sorted array that shares the query's first `depth` bits."""
        drop = BITS - depth
        low = strings >> drop << drop
        lo = np.stack([np.searchsorted(t, q) for t, q in zip(self.sorted, low, strict=True)])
        hi = np.stack([np.searchsorted(t, q) for t, q in zip(self.sorted, low + (1 << drop), strict=True)])
        return lo, hi

    def candidates(self, queries, k: int):
        """Candidate places for each query: those under its prefixes at the deepest level that has enough."""
        strings = self.strings(np.hstack([queries, np.zeros((len(queries), 1))]))
        n = self.vectors.shape[0]
        enough = min(ENOUGH * n + PER_NEIGHBOUR * k, TREES * n)
        good, bad = np.zeros(len(queries), dtype=np.int64), np.full(len(queries), BITS + 1)
        while (bad - good > 1).any():
            middle = (good + bad) // 2
            lo, hi = self.under(strings, middle)
            reached = (hi - lo).sum(axis=0) >= enough
            good, bad = np.where(reached, middle, good), np.where(reached, bad, middle)
        lo, hi = self.under(strings, good)
        for q in range(len(queries)):
            taken = np.zeros(self.vectors.shape[0], dtype=bool)
            for t in np.flatnonzero(hi[:, q] > lo[:, q]).tolist():
                taken[self.order[t, lo[t, q] : hi[t, q]]] = True
            yield np.flatnonzero(taken)


def block_search(k: int):
    """The best `k` candidates of one (item block, query block)."""

    def run(table: pa.Table) -> pa.Table:
        ids, is_query = table.column("id").to_numpy(), table.column("is_query").to_numpy(zero_copy_only=False)
        lists = table.column("vector").combine_chunks()
        widths = lists.value_lengths().to_numpy()
        out = [np.empty(0, dtype=np.int64)], [np.empty(0, dtype=np.int64)], [np.empty(0)]
        for width in np.unique(widths[is_query]).tolist():
            mine = widths == width
            flat = lists.filter(pa.array(mine)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
            which = is_query[mine]
            queries, query_ids = flat[which], ids[mine][which]
            items, item_ids = flat[~which], ids[mine][~which]
            if not len(items):
                continue
            forest = Forest(items)
            for q, at in enumerate(forest.candidates(queries, k)):
                at = at[item_ids[at] != query_ids[q]]
                # Row sums, not a matrix product: equal vectors get equal scores, so that ties are ties.
                score = (items[at] * queries[q]).sum(axis=1)
                best = np.lexsort((item_ids[at], -score))[:k]
                out[0].append(np.full(len(best), query_ids[q]))
                out[1].append(item_ids[at][best])
                out[2].append(score[best])
        return pa.table({"query_id": np.concatenate(out[0]), "vec_id": np.concatenate(out[1]), "score": np.concatenate(out[2])})

    return run


def search(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The `k` nearest rows of `vectors` (id, vector) to each row of `queries` (id, vector): query_id, rank, vec_id, score."""
    take_part = F.col("id").isNotNull() & usable(F.col("vector"))
    items = stored(vectors.where(take_part), "vectors")
    asked = stored(queries.where(take_part).dropDuplicates(["id"]), "queries")
    blocks = -(-items.count() // BLOCK) or 1
    asked_blocks = -(-asked.count() // QUERIES) or 1
    deal = lambda n: F.pmod(F.xxhash64("_mid"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    there = items.select(deal(blocks).alias("block"), every(asked_blocks).alias("asked"), "id", "vector", F.lit(False).alias("is_query"))
    come = asked.select(every(blocks).alias("block"), deal(asked_blocks).alias("asked"), "id", "vector", F.lit(True).alias("is_query"))
    found = there.union(come).groupBy("block", "asked").applyInArrow(block_search(k), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
