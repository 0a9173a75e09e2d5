"""Conversation prefixes, SentencePiece chunks and collocations against brute force."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from lexspan.llm import collocations, prefixes, segments

VOCABULARY = public_tokenizers.path("piece_bpe_32k.model")

# Prefix trie.


def brute_trie(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            own[conv].append((turn is not None, turn or 0, role, digest, text))
    own = {c: [(x[2], x[4]) for x in sorted(found)] for c, found in own.items()}
    built = {}
    for c, found in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = own.get(c - c % 5, [])[:h] + found[h:]
    members = defaultdict(list)
    for c, found in built.items():
        for d in range(len(found) + 1):
            members[tuple(found[:d])].append(c)
    out = []
    for path, convs in members.items():
        below = [q for q in members if q[: len(path)] == path]
        leaves = [q for q in below if not any(len(r) == len(q) + 1 and r[: len(q)] == q for r in members)]
        ends = sorted(c for c in convs if len(built[c]) == len(path))
        out.append((
            min(convs), len(path), min(members[path[:-1]]) if path else None, len(convs), sum(len(q) == len(path) + 1 for q in below), len(leaves),
            sum((len(members[q]) - 1) * len(q[-1][1].encode()) for q in below if q), hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
        ))
    return sorted(out, key=str)


CONVERSATIONS = "conv_id long, turn long, role string, text string, a long, depth string, top long, tail boolean"


def table_of(spark, rows):
    return spark.createDataFrame([(*r, 7, "x", 1, True) for r in rows], CONVERSATIONS)


def talk(seed, n):
    draw = random.Random(seed)
    rows = []
    for c in range(n):
        text = [draw.choice("ab") for _ in range(draw.randint(0, 6))]
        rows += [(c, t, "user" if t % 2 == 0 else "assistant", f"text {w}" if draw.random() < 0.8 else f"{w} {c}") for t, w in enumerate(text)]
    return rows


@pytest.mark.parametrize("cells", [1 << 24, 1 << 14])
def test_trie_agrees_with_brute_force(spark, monkeypatch, cells):
    monkeypatch.setattr(prefixes, "MOST_CELLS", cells)
    rows = talk(3, 60) + [(2, None, None, "first"), (2, None, "user", None), (2, 1, "user", "tied"), (2, 1, "user", "tied"), (2, 1, "a", "other"), (None, 0, "user", "nobody's")]
    rows += [(1000 + k, t, "user", "same é") for k in range(40) for t in range(4)]
    mine = prefixes.trie(table_of(spark, rows)).collect()
    assert sorted((tuple(r) for r in mine), key=str) == brute_trie(rows)


def test_trie_of_a_long_conversation_and_of_none(spark):
    rows = [(c, t, "user", f"turn {t}" if t < 300 or c else "own") for c in (5, 10, 0) for t in range(600 - 100 * (c // 5))]
    mine = {(r.conv_id, r.depth): r for r in prefixes.trie(table_of(spark, rows)).collect()}
    assert mine[0, 300].n_convs == 3 and mine[0, 301].n_convs == 1 and mine[5, 301].parent_conv_id == 0
    assert mine[0, 600].n_children == 0 and mine[0, 0].n_leaves == 2 and mine[5, 400].ends_sha256 == hashlib.sha256(b"10").hexdigest()
    assert prefixes.trie(table_of(spark, [])).count() == 0


def test_screening_proves_only_single_prefixes(spark):
    rng = np.random.default_rng(1)
    own = rng.integers(-(1 << 62), 1 << 62, (4000, 2))
    values = np.concatenate([own, own[:1000]])
    rows = [(int(k), 1, int(a), int(b), 0, 1) for k, (a, b) in enumerate(values)]
    table = spark.createDataFrame(rows, "conv_id long, depth long, a long, b long, bytes long, total long").repartition(8)
    size = 1 << 15
    bits = spark.sparkContext.broadcast(prefixes.sketch(table, size))
    tails = {r.conv_id for r in prefixes.screened(table, size, bits).where("tail").collect()}
    assert not tails & (set(range(1000)) | set(range(4000, 5000))) and len(tails) > 2900


def test_members_are_listed_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(prefixes, "LISTED", 100)
    table = spark.range(5000).selectExpr("1L as a", "2L as b", "3L as depth", "id * 7 - 100 as conv_id")
    row = prefixes.listed(table).collect()
    assert [r.ends_sha256 for r in row] == [hashlib.sha256(",".join(str(k * 7 - 100) for k in range(5000)).encode()).hexdigest()]


# SentencePiece.

TEXTS = [
    None, "", " ", "  ", "a", " a", "a ", "  two  blanks  ", "line\nends\r\n\ttabs", "▁marker▁▁ in text▁", "日本語 テキスト é ﬁ ①", "😀 emoji‍", "\x00 nul",
    "x" * 5000, "long " * 20000, " " * 40, "the the the", "the the the", "a b　c", "</s> <s> <unk> <0x41>",
]


def test_segments_agree_with_the_library(spark, monkeypatch):
    monkeypatch.setattr(segments, "BLOCK", 2000)
    monkeypatch.setattr(segments, "RETURNED", 50)
    library = sentencepiece.SentencePieceProcessor(model_file=VOCABULARY)
    rows = [(k if k != 4 else None, t, "x", 1, "y") for k, t in enumerate(TEXTS)]
    table = spark.createDataFrame(rows, "doc_id long, text string, block string, part int, ids string").repartition(3)
    mine = segments.encode(table, VOCABULARY, decoded=True).collect()
    expected = [(k if k != 4 else None, ids := library.encode(t or "", add_eos=True), library.decode(ids)) for k, t in enumerate(TEXTS)]
    assert sorted((tuple(r) for r in mine), key=str) == sorted(expected, key=str)
    back = segments.decode(segments.encode(table, VOCABULARY), VOCABULARY).collect()
    assert sorted(map(tuple, back), key=str) == sorted(((k, text) for k, _, text in expected), key=str)
    digests = {r.doc_id: r for r in segments.digests(table, VOCABULARY).collect()}
    assert digests[0].n_tokens == 1 and digests[0].ids_sha256 == hashlib.sha256(b"2").hexdigest() and digests[0].decoded_sha256 == hashlib.sha256(b"").hexdigest()
    assert segments.encode(table.limit(0), VOCABULARY).count() == 0


def test_chunks_are_segmented_once_per_part(spark):
    table = spark.createDataFrame([(k, "one two three " * 10) for k in range(50)], "doc_id long, text string").repartition(5)
    lists = segments.chunked(table, 4).where("part >= 0").collect()
    assert {c for r in lists for c in segments.unpacked_texts(r.data)} == {" one", " two", " three", " "}
    assert len(lists) <= 5 * 4


def test_numbers_survive_packing():
    for numbers in ([], [0], [1, 2**32 - 1, 256, 65536]):
        assert segments.unpacked(segments.packed(numbers)).tolist() == numbers


def test_vocabularies_that_change_texts_are_refused(tmp_path, monkeypatch):
    monkeypatch.setattr(segments, "PROBE", "▁a")
    with pytest.raises(ValueError):
        segments.model(VOCABULARY)


# Collocations.


def brute_collocations(rows, least, top):
    counts, totals = Counter(), Counter()
    fold = str.maketrans({chr(k): chr(k + 32) for k in range(65, 91)})
    for _, text, lang in rows:
        lang, text = lang if lang is not None else "und", (text or "").translate(fold)
        for c in ".,;:!?\n\x0b\x0c\r":
            text = text.replace(c, "\n")
        for piece in text.split("\n"):
            words = [w for w in piece.replace("\t", " ").split(" ") if w]
            totals[lang] += len(words)
            for size in range(1, 6):
                for k in range(len(words) - size + 1):
                    counts[lang, tuple(words[k : k + size])] += 1
    frequent = {p: n for p, n in counts.items() if len(p[1]) > 1 and n >= least}
    out = defaultdict(list)
    for (lang, phrase), a in frequent.items():
        inside = any(
            other == lang and len(longer) > len(phrase) and n >= a and any(longer[k : k + len(phrase)] == phrase for k in range(len(longer)))
            for (other, longer), n in frequent.items()
        )
        if not inside:
            cuts = [(1000 * a * totals[lang] // (counts[lang, phrase[:k]] * counts[lang, phrase[k:]]), k) for k in range(1, len(phrase))]
            score, k = min(cuts)
            out[lang].append((-score, -a, " ".join(phrase).encode(), counts[lang, phrase[:k]], counts[lang, phrase[k:]]))
    return sorted(
        (lang, rank + 1, phrase.decode(), -a, left, right, totals[lang], -score)
        for lang, found in out.items() for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top])
    )


def prose(seed, n):
    draw = random.Random(seed)
    words = ["The", "of", "a", "é", "ß", "x", "New", "York", "city"] + [f"w{k}" for k in range(40)]
    rows = [(k, " ".join(draw.choices(words, weights=[12, 10, 9, 5, 4, 4, 3, 3, 3] + [1] * 40, k=60)) + draw.choice([". ", "\n", ";new york", " "]) + "new york\tcity of a", draw.choice(["en", "de", None])) for k in range(n)]
    return rows + [(None, None, "en"), (1, "", None), (2, " .,\t", "fr"), (3, "of a " * 5000, "de"), (3, "of a " * 5000, "de")]


def docs_of(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 5) for r in rows], "doc_id long, text string, lang string, a long, phrase string, n long")


@pytest.mark.parametrize("limits", [{}, {"ENTRIES": 50, "WORDS": 30, "FINER": 1, "READ": 20, "BURST": 3}])
def test_collocations_agree_with_brute_force(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(collocations, name, value)
    rows = prose(5, 120)
    mine = collocations.collocations(docs_of(spark, rows).repartition(4), least=4, top=60).collect()
    assert sorted(map(tuple, mine)) == brute_collocations(rows, 4, 60)


def test_collocations_of_nothing(spark):
    assert collocations.collocations(docs_of(spark, [])).count() == 0
    assert collocations.collocations(docs_of(spark, [(1, None, None)])).count() == 0


def test_trie_bursts_and_gives_up_whole_subtrees():
    draw = random.Random(2)
    for burst, levels in ((4096, 2), (3, 1), (3, 2), (2, 4)):
        trie, counts = collocations.HatTrie(burst, levels), Counter()
        for _ in range(3000):
            phrase = tuple(draw.randint(0, 4) for _ in range(draw.randint(3, 5)))
            trie.add(phrase)
            counts[phrase] += 1
        assert trie.size == len(counts)
        out, left = ([e for first, node in trie.cut(keep) for e in trie.entries(node, (first,))] for keep in (trie.size // 2, 0))
        assert not {p[0] for p, _ in out} & {p[0] for p, _ in left} and trie.size == 0
        assert Counter(dict(out + left)) == counts


def test_hot_prefixes_are_dealt_by_the_whole_phrase(spark):
    table = spark.createDataFrame([("en", "of", 900), ("en", "a", 90), ("en", "", 1000)], "lang string, phrase string, f long")
    hot = collocations.salts(table, 1000, 10)
    assert hot == {b"en\0of": 9}
    dealt = {}
    for word in (b"of", b"a"):
        collocations.dealt_out(dealt, b"en", word, [(word + b" %d" % k, 1) for k in range(500)], 10, hot)
    found = {word: {part for (part, _), phrases in dealt.items() if any(p.startswith(word) for p, _ in phrases)} for word in (b"of", b"a")}
    assert len(found[b"of"]) == 9 and len(found[b"a"]) == 1 and sum(map(len, dealt.values())) == 1000
