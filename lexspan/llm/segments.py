"""SentencePiece encoding and decoding through a table of distinct chunks.

No piece of the vocabulary crosses from a visible character to a whitespace marker, so a text falls into chunks (markers
and what follows them up to the next marker) that are segmented independently of each other.

1. `chunked`: tasks deal whole texts into blocks of about `BLOCK` bytes. A block holds, for every place of its texts, the
   number of the chunk there; a chunk that occurs more often has a smaller number. Its distinct chunks go out in lists, one
   for each hash part.
2. `answered`: a part receives the lists of all blocks, segments each distinct chunk once, and answers every list.
3. `encode`: a block meets its answers again, and the ids of each place are read off by the chunk's number.

So a chunk is shuffled once per block it occurs in and once back, not once per place. Blocks are stored in buckets by their
name and stay there, and a place costs one or two bytes.

Defined results: a null text is an empty one, whose ids are the end id alone and which decodes to the empty text; repeated
rows are encoded as often as they come; a null doc_id is kept; other columns are ignored; an empty table gives no rows.
A marker character in a text counts as a space, as the library does, and is decoded to one. A vocabulary that joins pieces
across markers, or that changes texts before it segments them, is an error.
"""

import re
import uuid
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspan.llm.common import bucketed

# Bytes of text in a block (a longer text is a block of its own), and ids that one task returns at a time.
BLOCK = 1 << 25
RETURNED = 1 << 20
# Chunks that a part keeps with their ids; beyond, it forgets them and segments anew what comes again.
KNOWN = 2_000_000

MARKER = "▁"
CHUNK = re.compile(" +[^ ]*")
# What changes if a vocabulary normalises texts: blanks at both ends and in runs, compatibility forms.
PROBE = "  A ﬁ  ①\tb\n "


def model(path: str) -> bytes:
    """The vocabulary's file, checked to keep texts as they are and to segment chunks independently."""
    with open(path, "rb") as file:
        proto = file.read()
    library = sentencepiece.SentencePieceProcessor(model_proto=proto)
    if any(MARKER in library.id_to_piece(i).lstrip(MARKER) for i in range(library.get_piece_size())):
        raise ValueError("pieces of this vocabulary cross whitespace markers")
    if library.decode(library.encode(PROBE)) != PROBE:
        raise ValueError("this vocabulary normalises texts")
    return proto


def packed(numbers) -> bytes:
    """32-bit numbers, compressed by byte planes: small numbers leave most planes empty."""
    data = np.ascontiguousarray(np.asarray(numbers, dtype="<u4").view(np.uint8).reshape(-1, 4).T).tobytes()
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def unpacked(data: bytes):
    size = int.from_bytes(data[:8], "little")
    planes = np.frombuffer(pa.decompress(data[8:], decompressed_size=size, codec="zstd", asbytes=True), dtype=np.uint8)
    return np.ascontiguousarray(planes.reshape(4, -1).T).view("<u4").ravel()


def packed_texts(texts: list[str]) -> bytes:
    data = "".join(texts).encode()
    sizes = packed([len(t) for t in texts])
    return len(sizes).to_bytes(8, "little") + sizes + len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def unpacked_texts(data: bytes) -> list[str]:
    at = 8 + int.from_bytes(data[:8], "little")
    ends = np.cumsum(unpacked(data[8:at])).tolist()
    size = int.from_bytes(data[at : at + 8], "little")
    text = pa.decompress(data[at + 8 :], decompressed_size=size, codec="zstd", asbytes=True).decode()
    return [text[a:b] for a, b in zip([0, *ends], ends, strict=False)]


BLOCKS = "block string, part int, doc_ids array<long>, places array<long>, data binary"


def chunked(docs: DataFrame, parts: int) -> DataFrame:
    """Per block a row with part -1 (its documents, their numbers of places, the chunk numbers in order) and a row with a
    list of distinct chunks for every part. The k-th chunk of a part's list has the number k * parts + part."""

    def closed(numbers: dict[str, int], codes: array, doc_ids: list, places: list):
        chunks, codes = list(numbers), np.frombuffer(codes, dtype=np.uint32) if codes else np.empty(0, dtype=np.uint32)
        part = np.array([zlib.crc32(c.encode()) % parts for c in chunks], dtype=np.int64)
        order = np.lexsort((-np.bincount(codes, minlength=len(chunks)), part))
        first = np.searchsorted(part[order], np.arange(parts + 1))
        renumbered = np.empty(len(chunks), dtype=np.int64)
        renumbered[order] = (np.arange(len(chunks)) - first[part[order]]) * parts + part[order]
        block, lists = uuid.uuid4().hex, []
        for p in range(parts):
            here = order[first[p] : first[p + 1]].tolist()
            if here:
                lists.append((p, packed_texts([chunks[k] for k in here])))
        none = [None] * len(lists)
        columns = [[block] * (len(lists) + 1), [-1, *(p for p, _ in lists)], [doc_ids, *none], [places, *none], [packed(renumbered[codes]), *(d for _, d in lists)]]
        kinds = [pa.string(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["block", "part", "doc_ids", "places", "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, codes, doc_ids, places, size = defaultdict(count().__next__), array("I"), [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py()
                chunks = CHUNK.findall(" " + text.replace(MARKER, " ")) if text else []
                codes.extend(map(numbers.__getitem__, chunks))
                doc_ids.append(doc_id)
                places.append(len(chunks))
                size += len(text or "") + 8
                if size >= BLOCK:
                    yield closed(numbers, codes, doc_ids, places)
                    numbers, codes, doc_ids, places, size = defaultdict(count().__next__), array("I"), [], [], 0
        if doc_ids:
            yield closed(numbers, codes, doc_ids, places)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, BLOCKS)


def answered(lists: DataFrame, proto) -> DataFrame:
    """The ids of every list's chunks: as many numbers of ids as chunks, then the ids. One part segments a chunk once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = sentencepiece.SentencePieceProcessor(model_proto=proto.value)
        bare = len(library.encode("a"))
        now, known = None, {}
        for batch in batches:
            for block, part, data in zip(*(batch.column(c).to_pylist() for c in ("block", "part", "data")), strict=True):
                if part != now or len(known) > KNOWN:
                    # A marker alone, which ends a text, is read off behind another chunk: the library takes "" for no text.
                    now, known = part, {" ": np.array(library.encode("a ")[bare:], dtype="<i4").tobytes()}
                chunks = unpacked_texts(data)
                new = [c for c in chunks if c not in known]
                # The library puts a marker in front of a text, which stands for the chunk's first one.
                for chunk, ids in zip(new, library.encode([c[1:] for c in new], num_threads=1), strict=True):
                    known[chunk] = np.array(ids, dtype="<i4").tobytes()
                found = [known[c] for c in chunks]
                ids = np.frombuffer(b"".join(found), dtype="<i4").view("<u4")
                answer = packed(np.concatenate([np.array([len(x) // 4 for x in found], dtype="<u4"), ids]))
                yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([part], pa.int32()), pa.array([len(chunks)], pa.int64()), pa.array([answer], pa.binary())], names=["block", "part", "size", "data"])

    rows = lists.repartition("part").sortWithinPartitions("part")
    return rows.select("block", "part", "data").mapInArrow(run, "block string, part int, size long, data binary")


def encode(docs: DataFrame, path: str, decoded: bool = False) -> DataFrame:
    """(doc_id, ids array<int>) with the end id, of every whole text; with `decoded` also what the ids decode to."""
    spark = docs.sparkSession
    proto = spark.sparkContext.broadcast(model(path))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    names = ["doc_id", "ids", "decoded"] if decoded else ["doc_id", "ids"]
    schema = "doc_id long, ids array<int>" + (", decoded string" if decoded else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = sentencepiece.SentencePieceProcessor(model_proto=proto.value)
        for batch in batches:
            for doc_ids, places, data, answers in zip(*(batch.column(c) for c in ("doc_ids", "places", "data", "answers")), strict=True):
                yield from read_off(library, doc_ids.as_py(), places.as_py(), data.as_py(), answers.as_py() or [])

    def read_off(library, doc_ids: list, places: list, data: bytes, answers: list) -> Iterator[pa.RecordBatch]:
        # Per chunk number: where its ids start among all ids of the block, and how many there are; the last is the end.
        last = max([0, *(x["size"] * parts for x in answers)])
        first, length, flat, filled = np.zeros(last + 1, dtype=np.int64), np.zeros(last + 1, dtype=np.int64), [], 0
        for x in answers:
            values, n = unpacked(x["data"]), x["size"]
            lengths = values[:n].astype(np.int64)
            numbers = np.arange(n) * parts + x["part"]
            first[numbers], length[numbers] = filled + np.cumsum(lengths) - lengths, lengths
            flat.append(values[n:])
            filled += len(values) - n
        first[last], length[last] = filled, 1
        flat = np.concatenate([*flat, np.array([library.eos_id()], dtype="<u4")]).view(np.int32)
        codes, at, doc = unpacked(data).astype(np.int64), 0, 0
        while doc < len(doc_ids):
            # Documents are taken together until they hold enough places.
            upto, end = doc, at
            while upto < len(doc_ids) and (upto == doc or end - at < RETURNED):
                end, upto = end + places[upto], upto + 1
            ends = np.cumsum(places[doc:upto])
            here = np.insert(codes[at:end], ends, last)
            lengths = length[here]
            total = np.cumsum(lengths)
            ids = flat[np.repeat(first[here] - total + lengths, lengths) + np.arange(total[-1])]
            bounds = np.concatenate([[0], total[ends + np.arange(upto - doc)]]).astype(np.int32)
            columns = [pa.array(doc_ids[doc:upto], pa.int64()), pa.ListArray.from_arrays(pa.array(bounds), pa.array(ids))]
            if decoded:
                columns.append(pa.array([library.decode(ids[a:b].tolist()) for a, b in zip(bounds, bounds[1:], strict=False)], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=names)
            doc, at = upto, end

    blocks = bucketed(chunked(docs, parts).withColumn("head", F.col("part") < 0), "chunks", "block", parts, "head")
    answers = answered(blocks.where("not head"), proto).groupBy("block").agg(F.collect_list(F.struct("part", "size", "data")).alias("answers"))
    rows = blocks.where("head").select("block", "doc_ids", "places", "data").join(answers, "block", "left")
    return rows.select("doc_ids", "places", "data", "answers").mapInArrow(run, schema)


def decode(rows: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of rows (doc_id, ids): what the library makes of the ids; null ids decode to the empty text."""
    proto = rows.sparkSession.sparkContext.broadcast(model(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = sentencepiece.SentencePieceProcessor(model_proto=proto.value)
        for batch in batches:
            texts = [library.decode(ids.as_py() or []) for ids in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return rows.select(F.col("doc_id").cast("long"), F.col("ids").cast("array<int>")).mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every text."""
    rows = encode(docs, path, decoded=True)
    listed = F.concat_ws(" ", F.col("ids").cast("array<string>"))
    return rows.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed.cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
