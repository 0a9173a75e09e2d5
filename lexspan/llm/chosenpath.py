"""Similarity join on word shingles by the chosen-path recursion.

1. Documents with the same set of five-word shingles are one node, so copies never meet as pairs.
2. Every node has `COORDINATES` min-wise samples of its set. In each run, a tree node draws one or two
   coordinates, the same for all sets that reach it, and a set moves on to the child named by its own sample there:
   two sets stay together with the chance that they share the sampled token. Buckets of one set end, buckets of at
   most `SMALL` sets are compared by brute force, larger ones are split again, down to `DEPTH`. A bucket that is
   still larger there is compared whole, in blocks that are dealt over many tasks: first each block ties its sets to
   roots, then pairs of blocks tie roots to roots.
3. Runs are repeated until a pair at the threshold is missed with a chance below 1 - `RECALL`.
4. The pairs whose samples agree enough give candidate clusters; in a cluster all pairs are verified exactly on
   their shingle sets, in blocks. No pair is ever written: tasks return link counts and a spanning forest.

Defined results: a text of one to four words is one shingle; a text without words (or null) is a class of its own
without links; repeated rows are copies of each other; among equal ids the first stored row stands for the class;
a class whose documents all have a null id has a null class id; other columns are ignored; an empty table gives no rows.
"""

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexspan.functions.scale import written
from lexspan.llm.common import WordHasher, checked, free_name, groups, mix64, row_key, shingles, stored

SIMILARITY = 0.8
COORDINATES = 64
# Share of pairs at the threshold that the runs must find, and the deepest split.
RECALL = 0.999
DEPTH = 3
# Sets that are compared by brute force, and the block that a larger bucket is dealt in.
SMALL = 256
BLOCK = 256
# Agreement of samples from which a pair is a candidate: four standard deviations under the threshold.
AGREE = SIMILARITY - 4 * math.sqrt(SIMILARITY * (1 - SIMILARITY) / COORDINATES)
# Chance that a tree node draws a second coordinate: a pair at the threshold keeps one meeting place on average.
SECOND = 1 / SIMILARITY - 1


def runs_needed(recall: float = RECALL, depth: int = DEPTH, similarity: float = SIMILARITY) -> int:
    """Runs after which a pair at `similarity` has met in a bucket of depth `depth` with chance `recall`."""
    lost = 0.0
    for _ in range(depth):
        apart = 1 - similarity * (1 - lost)
        lost = (1 - SECOND) * apart + SECOND * apart * apart
    return math.ceil(math.log(1 - recall) / math.log(lost))


def fingerprints(docs: DataFrame) -> DataFrame:
    """Per row: `n` shingles, a 128-bit key of the shingle set and the min-wise samples."""
    seeds = mix64(np.arange(1, COORDINATES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    factors = (seeds >> np.uint64(32)).astype(np.uint32) | np.uint32(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            n, a, b, samples, sketch = [], [], [], [], []
            for text in batch.column("text").cast(pa.binary()):
                found = shingles(hasher(text.as_py() or b""))
                n.append(len(found))
                if not len(found):
                    a.append(0), b.append(0), samples.append(None), sketch.append(None)
                    continue
                a.append(int(found.sum(dtype=np.uint64).view(np.int64)))
                b.append(int(mix64(found ^ seeds[0]).sum(dtype=np.uint64).view(np.int64)))
                low = np.full(COORDINATES, 0xFFFFFFFF, dtype=np.uint32)
                for at in range(0, len(found), 2048):
                    part = found[at : at + 2048]
                    x, y = part.astype(np.uint32), (part >> np.uint64(32)).astype(np.uint32)
                    drawn = (x[None, :] ^ (y[None, :] * factors[:, None])) * np.uint32(0x85EBCA6B)
                    drawn ^= drawn >> np.uint32(15)
                    np.minimum(low, drawn.min(axis=1), out=low)
                samples.append(low.tobytes())
                sketch.append(low.astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("key"), pa.array(n, pa.int32()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(samples, pa.binary()), pa.array(sketch, pa.binary())],
                names=["doc_id", "key", "n", "a", "b", "samples", "sketch"],
            )

    rows = docs.select(F.col("doc_id").cast("long"), row_key().alias("key"), "text")
    return rows.mapInArrow(run, "doc_id long, key long, n int, a long, b long, samples binary, sketch binary")


def children(rows: DataFrame, runs: int | None) -> DataFrame:
    """Children of each (path, node) for its `samples`; with `runs`, the roots' children of that many runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes = batch.column("node").to_numpy()
            samples = np.frombuffer(b"".join(batch.column("samples").to_pylist()), dtype=np.uint32).reshape(-1, COORDINATES)
            if runs is None:
                starts = [(batch.column("path").to_numpy().view(np.uint64), np.arange(len(nodes)))]
            else:
                starts = [(np.full(len(nodes), r + 1, dtype=np.uint64), np.arange(len(nodes))) for r in range(runs)]
            for path, at in starts:
                first, second = mix64(path ^ np.uint64(0x51ED270B)), mix64(path ^ np.uint64(0x2545F491))
                drawn = [(first, np.ones(len(path), dtype=bool)), (second, (second >> np.uint64(11)).astype(float) / 2**53 < SECOND)]
                for which, here in drawn:
                    c = (which % np.uint64(COORDINATES)).astype(np.int64)[here]
                    token = samples[at[here], c].astype(np.uint64)
                    child = mix64(mix64(path[here] + np.uint64(1) + c.astype(np.uint64)) ^ token)
                    yield pa.RecordBatch.from_arrays([pa.array(child.view(np.int64)), pa.array(nodes[at[here]])], names=["path", "node"])

    return rows.mapInArrow(run, "path long, node long")


def blocks_of(size: str, block: int = BLOCK) -> Column:
    return F.ceil(F.col(size) / F.lit(block)).cast("int")


def own_block(size: str) -> Column:
    """The block of a group of `size` that a node is in."""
    return F.pmod(F.xxhash64("node", F.lit(7)), blocks_of(size)).cast("int")


def dealt(rows: DataFrame, size: str) -> DataFrame:
    """Rows with `own` and the block pair (`i`, `j`) they take part in, one for every block of their group."""
    out = rows.withColumn("other", F.explode(F.sequence(F.lit(0), blocks_of(size) - 1)))
    return out.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")}).drop("other")


class Forest:
    """Union-find over positions; every set keeps its smallest node as the root."""

    def __init__(self, nodes):
        self.nodes, self.up = nodes, list(range(len(nodes)))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def link(self, x: int, y: int) -> None:
        x, y = self.root(x), self.root(y)
        if x != y:
            low, high = (x, y) if self.nodes[x] < self.nodes[y] else (y, x)
            self.up[high] = low

    def edges(self) -> list[tuple[int, int]]:
        return [(self.nodes[k], self.nodes[self.root(k)]) for k in range(len(self.nodes)) if self.root(k) != k]


def agreeing(one, others):
    """Places of the rows of `others` whose samples agree enough with those of `one`."""
    return np.flatnonzero((others == one).sum(axis=1) >= AGREE * COORDINATES).tolist()


def sketches(values: list[bytes]):
    return np.frombuffer(b"".join(values), dtype=np.uint8).reshape(-1, COORDINATES)


def block_roots(buckets: DataFrame) -> DataFrame:
    """Buckets (path, own, node, sketch, ...) with `root`: within each block, sets whose samples agree enough are tied
    to one of them, directly or through others. Every set is one row again."""
    names = buckets.columns

    kinds = [pa.binary() if n == "sketch" else pa.int32() if n == "own" else pa.int64() for n in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [[] for _ in (*names, "root")]

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(held, [*kinds, pa.int64()], strict=True)], names=[*names, "root"])

        for _, columns in groups(batches, ["path", "own"], names):
            nodes, table = columns[names.index("node")], sketches(columns[names.index("sketch")])
            forest = Forest(nodes)
            for k in range(len(nodes) - 1):
                for x in agreeing(table[k], table[k + 1 :]):
                    forest.link(k, k + 1 + x)
            for column, values in zip(held, [*columns, [nodes[forest.root(k)] for k in range(len(nodes))]], strict=True):
                column += values
            if len(held[0]) > 20_000:
                yield batch()
                held = [[] for _ in (*names, "root")]
        yield batch()

    schema = ", ".join(f"{c} {t}" for c, t in buckets.dtypes)
    rows = buckets.repartition("path", "own").sortWithinPartitions("path", "own")
    return rows.mapInArrow(run, f"{schema}, root long")


def across_blocks(rooted: DataFrame) -> DataFrame:
    """Edges between the roots of two blocks of a bucket: at most a spanning forest over the roots of each pair of blocks,
    so that blocks of one large cluster, which have a root each, return a single edge."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, i, _), (own, roots, values) in groups(batches, ["path", "i", "j"], ["own", "root", "sketch"]):
            table, own = sketches(values), np.array(own)
            left, right = np.flatnonzero(own == i), np.flatnonzero(own != i)
            distinct = sorted(set(roots))
            place = {root: k for k, root in enumerate(distinct)}
            forest, there = Forest(distinct), np.array([place[roots[x]] for x in right.tolist()], dtype=np.int64)
            others = table[right]
            for k in left.tolist():
                for x in agreeing(table[k], others):
                    forest.link(place[roots[k]], int(there[x]))
            edges = forest.edges()
            if edges:
                yield pa.RecordBatch.from_pydict({"x": [x for x, _ in edges], "y": [y for _, y in edges]}, schema=edge)

    edge = pa.schema([("x", pa.int64()), ("y", pa.int64())])
    rows = dealt(rooted, "size").where("i < j").repartition("path", "i", "j").sortWithinPartitions("path", "i", "j")
    return rows.select("path", "i", "j", "own", "root", "sketch").mapInArrow(run, "x long, y long")


def sketch_edges(buckets: DataFrame) -> DataFrame:
    """Edges that connect, in each bucket (path, size, node, sketch), the sets whose samples agree enough.

    A bucket is one block or several. Inside a block a set is tied to its root; blocks are then tied root to root.
    """
    rooted = written(block_roots(buckets.withColumn("own", own_block("size"))), "rooted")
    inside = rooted.where("node <> root").select(F.col("node").alias("x"), F.col("root").alias("y"))
    return inside.union(across_blocks(rooted.where(F.col("size") > BLOCK)))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of all nodes that have an edge; the root is the smallest node that can be reached.

    Each round takes the smallest root among the neighbours, then the root's root, and stores the result.
    """
    both = written(edges.union(edges.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct(), "edges")
    roots = written(both.groupBy("x").agg(F.min("y").alias("near")).select(F.col("x").alias("node"), F.least("x", "near").alias("root")), "roots")
    while True:
        near = both.join(roots.withColumnRenamed("node", "y"), "y").groupBy("x").agg(F.min("root").alias("near"))
        lower = roots.join(near.withColumnRenamed("x", "node"), "node").select("node", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        above = roots.select(F.col("node").alias("root"), F.col("root").alias("above"))
        new = lower.join(above, "root").select("node", "old", F.least("root", "above").alias("root"))
        new = written(new, "roots")
        if new.where("old <> root").isEmpty():
            return new.select("node", "root")
        roots = new.select("node", "root")


def verified(members: DataFrame) -> DataFrame:
    """Exact links inside each block pair of a cluster: per node, the linked documents and the root of its links.

    `members` has cluster, i, j, own, node, copies and the sorted shingle hashes `set`.
    """

    def links(sets, own, i, j):
        inside = i == j
        if len(sets) == 2:
            if not inside and own[0] == own[1]:
                return []
            a, b = sets
            both = len(np.intersect1d(a, b, assume_unique=True))
            return [(0, np.array([1]))] if both >= SIMILARITY * (len(a) + len(b) - both) - 1e-9 else []
        sizes = np.array([len(s) for s in sets], dtype=np.float64)
        owner = np.repeat(np.arange(len(sets)), sizes.astype(np.int64))
        values, place, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        shared = count > 1
        number = np.cumsum(shared) - 1
        kept = shared[place]
        column, row = number[place[kept]], owner[kept]
        both = np.zeros((len(sets), len(sets)), dtype=np.float64)
        order = np.argsort(column, kind="stable")
        column, row = column[order], row[order]
        for at in range(0, int(shared.sum()), 4096):
            a, b = np.searchsorted(column, [at, at + 4096])
            part = np.zeros((len(sets), 4096), dtype=np.float32)
            part[row[a:b], column[a:b] - at] = 1
            both += part @ part.T
        near = both >= SIMILARITY * (sizes[:, None] + sizes[None, :] - both) - 1e-9
        own = np.array(own)
        if not inside:
            near &= own[:, None] != own[None, :]
        return [(k, found) for k in range(len(sets)) if len(found := k + 1 + np.flatnonzero(near[k, k + 1 :]))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, i, j), (own, nodes, copies, sets) in groups(batches, ["cluster", "i", "j"], ["own", "node", "copies", "set"]):
            first = {node: k for k, node in reversed(list(enumerate(nodes)))}
            at = sorted(first.values())
            own, nodes, copies = [own[k] for k in at], [nodes[k] for k in at], np.array([copies[k] for k in at])
            if len(nodes) < 2:
                continue
            forest, linked = Forest(nodes), np.zeros(len(nodes), dtype=np.int64)
            for k, found in links([np.frombuffer(sets[x], dtype=np.uint64) for x in at], own, i, j):
                linked[k] += copies[found].sum()
                linked[found] += copies[k]
                for x in found.tolist():
                    forest.link(k, x)
            hit = np.flatnonzero(linked)
            if len(hit):
                roots = [nodes[forest.root(k)] for k in hit.tolist()]
                yield pa.RecordBatch.from_pydict({"node": [nodes[k] for k in hit.tolist()], "root": roots, "links": linked[hit]}, schema=out)

    out = pa.schema([("node", pa.int64()), ("root", pa.int64()), ("links", pa.int64())])
    rows = members.repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j")
    return rows.mapInArrow(run, "node long, root long, links long")


def sets(rows: DataFrame) -> DataFrame:
    """The sorted shingle hashes of each row's text, as bytes; other columns stay."""
    names = [c for c in rows.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            values = [shingles(hasher(t.as_py() or b"")).tobytes() for t in batch.column("text").cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(values, pa.binary())], names=[*names, "set"])

    schema = ", ".join(f"{c} {t}" for c, t in rows.dtypes if c != "text")
    return rows.mapInArrow(run, f"{schema}, set binary")


def candidate_clusters(nodes: DataFrame) -> DataFrame:
    """(node, root) of the nodes that the recursion's buckets connect; `nodes` is stored."""
    thin = nodes.select("node", "samples")
    frontier, leaves, depth = children(thin, runs_needed()), None, 1
    while True:
        sizes = frontier.groupBy("path").agg(F.count("*").alias("size")).where("size > 1")
        level = written(frontier.join(sizes, "path"), "paths")
        done = level if depth == DEPTH else level.where(F.col("size") <= SMALL)
        leaves = done if leaves is None else leaves.union(done)
        rest = level.where(F.col("size") > SMALL)
        if depth == DEPTH or rest.isEmpty():
            break
        frontier, depth = children(rest.join(thin, "node").select("path", "node", "samples"), None), depth + 1
    buckets = leaves.select("path", "size", "node").join(nodes.select("node", "sketch"), "node")
    return components(sketch_edges(buckets))


def join(docs: DataFrame) -> DataFrame:
    """One row per document: `class_id` (smallest id of the documents it is linked with, directly or through
    others), `n_links` (other documents at the similarity or above), `key` (its row key), and `keep` for
    one row of each class. `key` and `keep` serve deduplication."""
    prints = stored(fingerprints(docs), "fingerprints")
    classes = prints.where("n > 0").groupBy("n", "a", "b").agg(F.min("_mid").alias("node"), F.count("*").alias("copies"))
    classes = written(classes, "classes")
    own = prints.select(F.col("_mid").alias("node"), "key", "samples", "sketch")
    nodes = written(classes.select("node", "copies").join(own, "node"), "nodes")

    clusters = written(candidate_clusters(nodes), "clusters")
    sizes = clusters.groupBy("root").agg(F.count("*").alias("size"))
    members = clusters.join(sizes, "root").join(nodes.select("node", "copies", "key"), "node")
    members = members.select(F.col("root").alias("cluster"), "size", "node", "copies", "key")
    texts = docs.select(row_key().alias("key"), "text").join(checked(members), "key")
    found = written(verified(dealt(sets(texts.drop("key")).withColumn("own", own_block("size")), "size").select("cluster", "i", "j", "own", "node", "copies", "set")), "links")

    linked = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(found.where("node <> root").select(F.col("node").alias("x"), F.col("root").alias("y")))
    per_class = (
        classes.join(linked, "node", "left").join(roots, "node", "left")
        .select("n", "a", "b", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "node").alias("root"))
    )
    rows = prints.select("doc_id", "key", "_mid", "n", "a", "b").join(per_class, ["n", "a", "b"], "left")
    rows = written(rows.select("doc_id", "key", "_mid", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("root", "_mid").alias("root")), "members")
    head = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_mid")).alias("head"))
    return rows.join(head, "root").select(
        "doc_id", F.col("head.doc_id").alias("class_id"), "n_links", "key", (F.col("_mid") == F.col("head._mid")).alias("keep")
    )


def deduplicate(docs: DataFrame) -> DataFrame:
    """`docs` with one row of each class; of rows equal in id and text one stays."""
    key, times, keep = (free_name(docs, c) for c in ("_dup_key", "_dup_n", "_dup_keep"))
    rows = written(join(docs).select(F.col("key").alias(key), F.col("keep").alias(keep)), "kept")
    told = rows.groupBy(key).agg(F.count("*").alias(times), F.max(keep).alias(keep))
    told = told.where((F.col(times) > 1) | ~F.col(keep))
    marked = docs.withColumn(key, row_key()).join(checked(told), key, "left")
    single = marked.where(F.col(times).isNull()).select(*docs.columns)
    repeated = marked.where(F.col(times).isNotNull() & F.col(keep)).dropDuplicates([key]).select(*docs.columns)
    return single.union(repeated)
