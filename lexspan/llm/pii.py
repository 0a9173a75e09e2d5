"""Personal data by bootstrapped contextual extraction.

Rules with checks (address syntax, number ranges, the Luhn sum) find the seed entities of every text. Besides, every
run of digits, with blanks, brackets, hyphens or dots inside, and every other token that looks like an identifier is a mention with
the words before it. A pattern is a kind, a context and a shape: which words stand before, which characters the mention has,
separators left out. Spark builds the graph of patterns and instances and scores it in
rounds: a pattern is as good as the instances it finds, against a prior that asks for support; an instance is as good as its
patterns together. Seeds stay at 1. Patterns above `CONFIDENT` that several different seeds support turn their other
mentions into new spans of their kind.

Defined results: a null text is an empty one, without spans; a new span never overlaps a rule's; equal rows get equal
spans; very long texts are read whole; offsets count code points; other columns are ignored; an empty table gives no rows.
"""

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspan.functions.scale import written
from lexspan.llm.common import free_name, row_key

# Kinds in their order, and the expressions of the rules.
KINDS = ["email", "ip", "card", "phone"]
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
IP = r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
CARD = r"[0-9]([\x20-]?[0-9])+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"

# A token of at least five characters; it may be an identifier when it holds a digit or an at sign.
MENTION = r"[^\s\"'<>|,;()]{5,}"
# Digits that separators may part, as in cards and phones; a whole token at either end.
RUN = r"(?<![^\s\"'<>|,;()])\+?(?:\([0-9]+\)[\x20-]{0,2})?[0-9]+(?:(?:\.|[\x20()-]{1,3})[0-9]+)*(?=[.!?:*&%$#]*(?:[\s\"'<>|,;()]|\Z))"
# What a shape leaves out, and what besides where the value starts with a plus sign.
SEPARATORS = "\x20()-"
PLUS_SEPARATORS = SEPARATORS + "."
ROUNDS = 4
CONFIDENT = 0.8
# Different seeds that a pattern needs, and the weight of the doubt that it starts with.
SUPPORT = 5
DOUBT = 1.0
# What an instance that is no seed is worth at most, so that patterns do not confirm themselves.
UNSEEN = 0.5
PLACEHOLDER = "<{}>"
# Spans, of some 30 bytes each, up to which they are broadcast to the texts they are cut from.
SMALL_SPANS = 1_000_000

SPAN = "struct<kind:int,start:int,end:int>"
MENTIONS = "struct<context:string,shape:string,value:string,kind:int,start:int,end:int>"
FOUND = f"doc_id long, key long, spans array<{SPAN}>, mentions array<{MENTIONS}>"


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


class Rules:
    """The rules, compiled, and what they find in one text."""

    def __init__(self):
        # An address is found from its at sign, and no number starts inside another: both keep long runs linear.
        self.domain = re.compile(EMAIL.partition("@")[2])
        self.local = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
        self.ip, self.card, self.phone = (re.compile(x) for x in ("(?<![0-9])" + IP, CARD, PHONE))
        self.digit, self.mention, self.word = re.compile("[0-9]"), re.compile(f"(?P<run>{RUN})|{MENTION}"), re.compile(r"[^\W\d_]+")
        self.run = re.compile(RUN)
        self.symbols, self.identifier = re.compile(r"[^0-9]"), re.compile("[@0-9]")

    def emails(self, text: str) -> list[tuple[int, int, int]]:
        out, done, at = [], 0, text.find("@")
        while at >= 0:
            start = at
            while start > done and text[start - 1] in self.local:
                start -= 1
            m = self.domain.match(text, at + 1) if start < at else None
            done = m.end() if m else at + 1
            if m:
                out.append((0, start, done))
            at = text.find("@", done)
        return out

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        """(kind, start, end), by start and kind."""
        out = self.emails(text)
        first = self.digit.search(text)
        if first:
            # No rule but the first can match before the first digit, or the plus sign in front of it.
            at = max(0, first.start() - 1)
            out += [(1, *m.span()) for m in self.ip.finditer(text, at) if all(int(p[-4:]) <= 255 and len(p.lstrip("0")) < 4 for p in m[0].split("."))]
            for m in self.card.finditer(text, at):
                if m.end() - m.start() >= 14:
                    digits = self.symbols.sub("", m[0])
                    if 14 <= len(digits) <= 19 and luhn(digits):
                        out.append((2, *m.span()))
            if "+" in text:
                out += [(3, *m.span()) for m in self.phone.finditer(text, at) if 10 <= len(self.symbols.sub("", m[0])) <= 15]
        return sorted(out, key=lambda x: (x[1], x[0], x[2]))

    def mentions(self, text: str, spans) -> list[tuple]:
        """Seeds, runs of digits and identifier-like tokens with the two words before them."""
        if not spans and not self.digit.search(text) and "@" not in text:
            return []
        places = [(a, b, kind) for kind, a, b in spans]
        taken = []
        for a, b, _ in sorted(places):
            if taken and a < taken[-1][1]:
                taken[-1] = (taken[-1][0], max(b, taken[-1][1]))
            else:
                taken.append((a, b))
        k = 0
        for m in self.mention.finditer(text):
            if not self.identifier.search(m[0]):
                continue
            a, b = m.span()
            while text[b - 1] in ".!?:*&%$#" and b - a > 1:
                b -= 1
            while k < len(taken) and taken[k][1] <= a:
                k += 1
            if k == len(taken) or b <= taken[k][0]:
                found = [(a, b)]
            elif m["run"]:
                # A rule's span inside a run leaves what stands before and after it.
                inside = [t for t in taken[k : k + b - a] if t[0] < b]
                found = [r.span() for x, y in zip([a, *(t[1] for t in inside)], [*(t[0] for t in inside), b], strict=True) if x < y for r in self.run.finditer(text, x, y)]
            else:
                found = []
            places += [(x, y, None) for x, y in found if y - x >= 5]
        out = []
        for a, b, kind in places:
            before = self.word.findall(text, max(0, a - 60), a)[-2:]
            if before:
                value = text[a:b]
                out.append((" ".join(before).lower(), shape(value), value, kind, a, b))
        return out


def shape(value: str) -> str:
    """Kinds of characters, runs shortened: digits 9, letters a, separators nothing, others themselves."""
    out, left = [], PLUS_SEPARATORS if value.startswith("+") else SEPARATORS
    for c in value:
        if c in left:
            continue
        s = "9" if c.isdigit() else "a" if c.isalpha() else c
        if not out or out[-1] != s:
            out.append(s)
    return "".join(out[:24])


def scan(docs: DataFrame) -> DataFrame:
    """Rule spans and mentions of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules = Rules()
        for batch in batches:
            spans, mentions = [], []
            for text in batch.column("text"):
                text = text.as_py() or ""
                found = rules.spans(text)
                spans.append([dict(zip(("kind", "start", "end"), x, strict=True)) for x in found])
                mentions.append([dict(zip(("context", "shape", "value", "kind", "start", "end"), x, strict=True)) for x in rules.mentions(text, found)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), pa.array(spans, span), pa.array(mentions, mention)], names=["doc_id", "key", "spans", "mentions"])

    place = [("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]
    span = pa.list_(pa.struct(place))
    mention = pa.list_(pa.struct([(c, pa.string()) for c in ("context", "shape", "value")] + place))
    rows = docs.select(F.col("doc_id").cast("long"), row_key().alias("key"), "text")
    return rows.mapInArrow(run, FOUND)


def graph(scanned: DataFrame) -> DataFrame:
    """Mentions as (key, pattern, value, kind, start, end); a mention stands under its last word and its last two.

    A run of digits also stands under a shape that tells no plus sign, so that numbers without one can follow those with one.
    """
    rows = scanned.select("key", F.explode("mentions").alias("m")).select("key", "m.*")
    one = F.element_at(F.split("context", " "), -1)
    shapes = [F.col("shape"), F.when(F.col("shape").isin("9", "+9"), F.lit("?9")).otherwise(F.col("shape"))]
    patterns = F.array_distinct(F.array(*[F.concat_ws("\t", c, s) for s in shapes for c in (one, F.col("context"))]))
    return rows.select("key", F.explode(patterns).alias("pattern"), F.xxhash64("value").alias("value"), "kind", "start", "end")


def confident_patterns(mentions: DataFrame) -> DataFrame:
    """(pattern, kind, score) of the patterns that the scored graph trusts."""
    seeds = mentions.where("kind is not null")
    supported = seeds.groupBy("pattern", "kind").agg(F.count_distinct("value").alias("support")).where(F.col("support") >= SUPPORT).select("pattern", "kind")
    # Only patterns with support can be trusted; the graph of the rest need not be scored.
    edges = mentions.join(supported.withColumnRenamed("kind", "of"), "pattern").groupBy("pattern", "of", "value").agg(
        F.max((F.coalesce(F.col("kind"), F.lit(-1)) == F.col("of")).cast("int")).alias("seed")
    )
    edges = written(edges, "edges")
    instances = edges.groupBy("of", "value").agg(F.max("seed").cast("double").alias("good"))
    for _ in range(ROUNDS):
        scored = edges.join(instances, ["of", "value"]).groupBy("pattern", "of").agg(
            (F.sum("good") / (F.count("*") + F.lit(DOUBT))).alias("score")
        )
        patterns = written(scored, "patterns")
        missed = edges.join(patterns, ["pattern", "of"]).groupBy("of", "value").agg(
            F.max("seed").alias("seed"), F.sum(F.log(F.greatest(1 - F.col("score"), F.lit(1e-9)))).alias("doubt")
        )
        good = F.when(F.col("seed") == 1, F.lit(1.0)).otherwise(UNSEEN * (1 - F.exp("doubt")))
        instances = written(missed.select("of", "value", good.alias("good")), "instances")
    return patterns.where(F.col("score") >= CONFIDENT).select("pattern", F.col("of").alias("kind"), "score")


def find(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, key, `spans` of the rules and `new` spans of the trusted patterns (arrays of kind, start, end)."""
    scanned = written(scan(docs), "scanned")
    mentions = graph(scanned)
    trusted = confident_patterns(mentions)
    hits = mentions.where("kind is null").drop("kind").join(trusted, "pattern")
    # One kind per place: the best pattern's, then the first kind.
    one = hits.groupBy("key", "start", "end").agg(F.min(F.struct((-F.col("score")).alias("less"), "kind")).alias("best"))
    per_text = one.groupBy("key").agg(F.sort_array(F.collect_set(F.struct(F.col("best.kind").alias("kind"), "start", "end"))).alias("new"))
    none = F.array().cast(f"array<{SPAN}>")
    return scanned.select("doc_id", "key", "spans").join(per_text, "key", "left").withColumn("new", F.coalesce("new", none))


def listed(spans):
    """`kind:start:end` of every span, by start, then kind, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def redact(docs: DataFrame) -> DataFrame:
    """`docs` with every span replaced by its kind in angle brackets; a column `n_chars` is the new text's length.

    Overlapping spans become one, named after the first.
    """
    found = written(find(docs).select("key", F.concat("spans", "new").alias("all")).where(F.size("all") > 0).dropDuplicates(["key"]), "redact")
    names, key, cut = docs.columns, free_name(docs, "_pii_key"), free_name(docs, "_pii_spans")
    found = found.select(F.col("key").alias(key), F.col("all").alias(cut))
    # The side's size is its spans, of which a long text may have any number, not its rows.
    n = found.agg(F.sum(F.size(cut)).alias("n")).first()["n"] or 0
    marked = docs.withColumn(key, row_key()).join(F.broadcast(found) if n <= SMALL_SPANS else found, key, "left")

    def replaced(text: str, spans: list[dict]) -> str:
        out, at = [], 0
        for s in sorted(spans, key=lambda s: (s["start"], s["kind"])):
            if s["start"] >= at:
                out += [text[at : s["start"]], PLACEHOLDER.format(KINDS[s["kind"]].upper())]
            at = max(at, s["end"])
        return "".join([*out, text[at:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(c) for c in names]
            spans = batch.column(cut)
            if spans.null_count < batch.num_rows:
                where = names.index("text")
                text = columns[where].to_pylist()
                for k in spans.is_valid().to_numpy(zero_copy_only=False).nonzero()[0].tolist():
                    text[k] = replaced(text[k], spans[k].as_py())
                columns[where] = pa.array(text, columns[where].type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    out = marked.select(*names, cut).mapInArrow(run, docs.schema)
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars")))
    return out.select(*names)

