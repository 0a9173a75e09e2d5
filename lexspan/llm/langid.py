"""Language identification by hierarchical discrimination.

A text becomes the relative frequencies of its hashed letter groups (one to three characters, blanks at word
edges), square-rooted. Languages are grouped into families: the two groups whose mean profiles are closest are merged until
`families` are left (about the square root of the number of languages). A text is first given to a family, by the closest mean
profile of the families, each with a linear support vector machine against every other family; inside the family, one
linear support vector machine for every pair of languages votes.

Only the fitting works on a bounded sample: about `SAMPLE` documents, as many of each language, drawn by a hash of the id.
Predictions read whole texts and nothing else.

Defined results: a null text, or one without a letter, is `und` with score 0; without any labelled text everything is
`und`; a language that has one labelled text is learned from that text; repeated rows get equal predictions; other columns
are ignored; an empty table gives no rows.
"""

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspan.functions.scale import written

UNKNOWN = "und"
# Hashed features of each order (one, two, three characters), a power of two.
WIDTH = 1024
ORDERS = 3
# Labelled documents that the machines are fitted on, shared out evenly among the languages, each of which has at least so many.
SAMPLE = 1200
LEAST = 50
EPOCHS = 12
REGULAR = 1e-4

RESULT = "doc_id long, held_out boolean, lang_pred string, score double"


def is_held_out(doc_id) -> bool:
    """Documents that do not train: crc32 of the id as text, modulo 5, is 0. A null id neither trains nor is held out."""
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0


def profile(text: str):
    """Feature vector of a whole text, or None when it holds no letter."""
    letters = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    # ASCII letters and what lies beyond ASCII are kept; a beyond-ASCII character counts as a letter when Python says so.
    keep = ((letters >= 97) & (letters <= 122)) | (letters >= 128)
    if not keep.any() or (not (letters[keep] < 128).any() and not any(c.isalpha() for c in text)):
        return None
    codes = np.where(keep, letters, 32).astype(np.uint32)
    # Runs of blanks are one blank, and the text has one at either end.
    codes = codes[(codes != 32) | np.concatenate([[True], codes[1:] != codes[:-1]])]
    codes = np.concatenate([[np.uint32(32)], codes, [np.uint32(32)]])
    out, group = np.empty(ORDERS * WIDTH, dtype=np.float32), np.zeros(len(codes), dtype=np.uint32)
    for order in range(ORDERS):
        group = group[: len(codes) - order] * np.uint32(0x01000193) + codes[order:]
        mixed = (group ^ (group >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        counts = np.bincount(mixed >> np.uint32(32 - WIDTH.bit_length() + 1), minlength=WIDTH)
        out[order * WIDTH : (order + 1) * WIDTH] = np.sqrt(counts / max(1, len(group)))
    return out / np.float32(ORDERS**0.5)


def machine(positive, negative, rng):
    """Linear support vector machine (hinge loss, averaged stochastic subgradient): weights with the bias last."""
    x = np.vstack([positive, negative])
    x = np.hstack([x, np.ones((len(x), 1), dtype=np.float32)])
    y = np.concatenate([np.ones(len(positive)), -np.ones(len(negative))])
    weight = np.where(y > 0, len(y) / (2 * max(1, len(positive))), len(y) / (2 * max(1, len(negative))))
    w, mean, step = np.zeros(x.shape[1]), np.zeros(x.shape[1]), 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(x))
        for at in range(0, len(x), 32):
            part = order[at : at + 32]
            step += 1
            rate = 1 / (REGULAR * (step + 1000))
            off = y[part] * (x[part] @ w) < 1
            w *= 1 - rate * REGULAR
            w += rate / len(part) * ((y[part] * weight[part] * off) @ x[part])
            if epoch >= EPOCHS // 2:
                mean += (w - mean) / (step - (EPOCHS // 2) * -(-len(x) // 32))
    return mean.astype(np.float32)


class Model:
    """Families, the machines between families, and those between the languages of a family."""

    def __init__(self, samples: dict[str, np.ndarray], families: int | None = None):
        self.languages = sorted(samples)
        rng = np.random.default_rng(5)
        groups = [[k] for k in self.languages]
        centre = lambda group: np.mean([samples[k].mean(axis=0) for k in group], axis=0)
        wanted = families or max(1, round(len(groups) ** 0.5))
        while len(groups) > wanted:
            centres = [centre(g) for g in groups]
            _, a, b = min((float(((centres[i] - centres[j]) ** 2).sum()), i, j) for i in range(len(groups)) for j in range(i + 1, len(groups)))
            groups[a] += groups.pop(b)
        self.families = [sorted(g) for g in groups]
        stack = lambda group: np.vstack([samples[k] for k in group])
        pairs = lambda n: [(i, j) for i in range(n) for j in range(i + 1, n)]
        self.between = {(i, j): machine(stack(self.families[i]), stack(self.families[j]), rng) for i, j in pairs(len(self.families))}
        self.inside = [{(i, j): machine(samples[g[i]], samples[g[j]], rng) for i, j in pairs(len(g))} for g in self.families]

    @staticmethod
    def vote(machines, n: int, x) -> tuple[int, float]:
        """The class with most won pairs (then the larger margins) and its mean agreement, 0.5 to 1."""
        if n == 1:
            return 0, 1.0
        wins, margins = np.zeros(n), np.zeros(n)
        for (i, j), w in machines.items():
            m = float(x @ w[:-1] + w[-1])
            wins[i if m > 0 else j] += 1
            margins[i] += np.tanh(m)
            margins[j] -= np.tanh(m)
        best = max(range(n), key=lambda k: (wins[k], margins[k], -k))
        return best, 0.5 + 0.5 * max(0.0, margins[best] / (n - 1))

    def predict(self, text: str | None) -> tuple[str, float]:
        x = profile(text) if text else None
        if x is None or not self.languages:
            return UNKNOWN, 0.0
        family, a = self.vote(self.between, len(self.families), x)
        language, b = self.vote(self.inside[family], len(self.families[family]), x)
        return self.families[family][language], float(a * b)


def fit(labelled: DataFrame, families: int | None = None) -> Model:
    """The model from (doc_id, text, lang), on at most `SAMPLE` whole texts."""
    trains = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) != 0
    rows = labelled.where(F.col("text").isNotNull() & F.col("lang").isNotNull()).where(trains)
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return Model({}, families)
    each = max(LEAST, SAMPLE // len(counts))
    # A language's share of hash values lets through a little more than it may keep.
    share = F.create_map(*[F.lit(x) for k, n in sorted(counts.items()) for x in (k, min(1.0, 1.3 * each / n))])
    drawn = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    chosen = rows.where(drawn < F.element_at(share, F.col("lang")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(lang, x.tobytes()) for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True) if (x := profile(text)) is not None]
            yield pa.RecordBatch.from_pydict({"lang": [a for a, _ in found], "x": [b for _, b in found]}, schema=pa.schema([("lang", pa.string()), ("x", pa.binary())]))

    # All tasks profile at once; the driver then reads the stored sample, which is bounded, a few files at a time.
    profiles = written(chosen.select("lang", "text").mapInArrow(run, "lang string, x binary"), "language")
    samples: dict[str, list] = {}
    for r in profiles.coalesce(4).toLocalIterator():
        kept = samples.setdefault(r["lang"], [])
        if len(kept) < each:
            kept.append(np.frombuffer(bytes(r["x"]), dtype=np.float32))
    return Model({k: np.vstack(v) for k, v in samples.items()}, families)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every document; reads its id (for held_out) and its whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            told = [shared.value.predict(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([is_held_out(i) for i in ids], pa.bool_()), pa.array([a for a, _ in told], pa.string()), pa.array([b for _, b in told], pa.float64())],
                names=["doc_id", "held_out", "lang_pred", "score"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, RESULT)


def filtered(docs: DataFrame, model: Model) -> DataFrame:
    """`docs` without those that are rejected, that is whose language is `und`: no text, or no letter in it.

    Without any learned language, only the letters count.
    """
    names, shared = docs.columns, docs.sparkSession.sparkContext.broadcast(model)

    def keeps(text: str | None) -> bool:
        model = shared.value
        return model.predict(text)[0] != UNKNOWN if model.languages else profile(text or "") is not None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [keeps(t.as_py()) for t in batch.column("text")]
            yield batch.filter(pa.array(kept, pa.bool_())).select(names)

    return docs.mapInArrow(run, docs.schema)
