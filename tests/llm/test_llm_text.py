"""Packing, licence scan, language identification, context mixing and personal data against brute force."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lexspan.llm import langid, licenses, mixing, packing, pii, queries

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, _mid string, key string, n int, rank int"

# Nulls in every column, an empty and a blank text, a repeated row, one id with two texts, a long text.
ROWS = [
    (1, "The cat is licensed under CC BY-NC 4.0. All rights reserved.", "en", "a"),
    (1, "The cat is licensed under CC BY-NC 4.0. All rights reserved.", "en", "a"),
    (1, "another text with id one", "en", None),
    (2, None, "en", "b"),
    (3, "", None, None),
    (4, "  \n\t ", "de", "b"),
    (None, "mail a.b@c.de or +1 (234) 555-6789, 4111 1111 1111 1111 from 10.0.0.255", None, "c"),
    (5, "12345 !! 67890 $$", "fr", "c"),
    (6, "word " * 6000 + "the end", "en", "c"),
    (7, "é è ñ ü 中文 <|endoftext|>  two  blanks\n\n x", "fr", "c"),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, lang, s, None if t is None else len(t), "x", "y", 1, 2) for i, t, lang, s in ROWS]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def given(spark):
    return queries.table(spark, SF, "documents")


def key(row):
    return tuple((x is None, x) for x in row)


def ids_of(text):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, packing.END_ID]


def check_packing(rows, texts):
    wanted = Counter()
    for doc_id, text in texts:
        ids = ids_of(text)
        for at in range(0, len(ids), packing.SEQUENCE):
            part = np.array(ids[at : at + packing.SEQUENCE], dtype="<u4")
            wanted[doc_id, at, len(part), zlib.crc32(part.tobytes()), len(ids)] += 1
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows) == wanted
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= packing.SEQUENCE
    return sequences


def test_packing_edge_cases(docs):
    check_packing(packing.digests(docs, *queries.vocabulary()).collect(), [(i, t) for i, t, _, _ in ROWS])


def test_packing_whole_table_is_near_the_bound(spark, given):
    rows = queries.op1_packing(spark, SF).collect()
    sequences = check_packing(rows, [(r.doc_id, r.text) for r in given.collect()])
    tokens = sum(r.length for r in rows)
    assert len(sequences) <= np.ceil(tokens / packing.SEQUENCE) * 1.02 + 1
    assert packing.digests(given.limit(0), *queries.vocabulary()).count() == 0


def test_packing_gives_back_the_ids(docs):
    pieces = packing.stored(packing.pieces(docs, *queries.vocabulary()), "pieces")
    packed = packing.pack(pieces)
    whole = {r.sequence_id: np.frombuffer(bytes(r.ids), dtype="<u4").tolist() for r in packing.sequences(packed).collect()}
    for r in packed.where("doc_id = 7").collect():
        assert whole[r.sequence_id][r.offset : r.offset + r.length] == ids_of(ROWS[-1][1])


@pytest.mark.parametrize("histogram", [{}, {5: 3}, {1: 1000, 128: 7, 200: 11}, {k: 1 + k % 7 for k in range(1, 256)}])
def test_patterns_hold_the_histogram(histogram):
    used = packing.patterns(histogram, 256)
    held = Counter()
    for counts, times in used:
        assert times > 0 and sum(k * c for k, c in counts.items()) <= 256
        for k, c in counts.items():
            held[k] += c * times
    assert held == Counter(histogram)


WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def base_labels(text):
    words = WORDS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    places = []
    for phrase, label in licenses.BASE.items():
        p = phrase.split()
        places += [(i, label) for i in range(len(words)) if words[i : i + len(p)] == p]
    starts = [i for i, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


def test_license_scan(docs, given):
    for table in (docs, given):
        rows = licenses.scan(table).collect()
        mine = [(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in rows]
        wanted = [(r.doc_id, *base_labels(r.text)) for r in table.collect()]
        assert sorted(mine, key=key) == sorted(wanted, key=key)
        for r in rows:
            assert set(r.base_labels.split(",")) <= set(r.labels.split(",")) | {""} and 0 <= r.score <= 1
    assert {r.labels for r in licenses.scan(docs).where("doc_id = 1 and n_base > 0").collect()} == {"cc-by,cc-by-nc-4.0,reserved"}
    assert licenses.scan(docs.limit(0)).count() == 0


def test_license_templates_are_found_in_place(spark):
    table = spark.createDataFrame([(k, f"some words before {text}, and after") for k, (_, text, _) in enumerate(licenses.TEMPLATES)], "doc_id long, text string")
    for r in licenses.scan(table).collect():
        assert licenses.TEMPLATES[r.doc_id][0] in r.labels.split(","), r


def test_language_id_held_out(spark, given):
    rows = queries.op3_language_id(spark, SF).collect()
    lang = {r.doc_id: r.lang for r in given.collect()}
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert len(rows) == len(lang) and sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.95 * len(held)


def test_language_id_edge_cases(docs, given):
    model = langid.fit(given.select("doc_id", "text", "lang"))
    rows = langid.identify(docs, model).collect()
    assert sorted(str(r.doc_id) for r in rows if r.lang_pred == langid.UNKNOWN) == ["2", "3", "4", "5"]
    assert all(0 <= r.score <= 1 for r in rows)
    kept = langid.filtered(docs, model)
    assert kept.columns == docs.columns and kept.count() == len(ROWS) - 4
    nothing = langid.fit(given.select("doc_id", "text", "lang").limit(0))
    assert {r.lang_pred for r in langid.identify(docs, nothing).collect()} == {langid.UNKNOWN}
    assert langid.identify(docs.limit(0), model).count() == 0


def test_language_filter_without_languages_keeps_letters(docs):
    nothing = langid.fit(docs.select("doc_id", "text", "lang").limit(0))
    assert langid.filtered(docs, nothing).count() == len(ROWS) - 4


def brute_base(rows):
    tokens = {}
    for k, (doc_id, text) in enumerate(rows):
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        tokens[k] = [*re.findall(r"[^\x20\x09-\x0D]+", lowered), None]
    held = [doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2 for doc_id, _ in rows]
    counts = Counter(t for k, ts in tokens.items() if not held[k] for t in ts)
    total, distinct = sum(counts.values()), len(counts)
    base = lambda ts: sum(np.log10((counts[t] + 1) / (total + distinct + 1)) for t in ts)
    return [(rows[k][0], held[k], len(ts), sum(counts[t] > 0 for t in ts), total, base(ts)) for k, ts in tokens.items()]


def test_context_mixing(docs, given):
    for table in (docs, given):
        rows = mixing.scores(table).collect()
        wanted = sorted(brute_base([(r.doc_id, r.text) for r in table.collect()]), key=key)
        mine = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in rows), key=key)
        assert [x[:5] for x in mine] == [x[:5] for x in wanted]
        assert np.allclose([x[5] for x in mine], [x[5] for x in wanted], rtol=1e-9)
        assert all(np.isfinite(r.score) and r.score < 0 for r in rows)
    assert mixing.scores(docs.limit(0)).count() == 0


def test_context_mixing_learns_the_language(spark, given):
    """Held-out prose costs fewer bits a byte than the same letters in disorder."""
    rng = np.random.default_rng(3)
    texts = [(r.doc_id, r.text) for r in given.collect()]
    held = [(i, t) for i, t in texts if mixing.is_held_out(i)]
    mixed = ["".join(rng.permutation(list(t))) for _, t in held]
    disorder = [(i, t) for i, t in zip((i for i in range(10**6, 2 * 10**6) if mixing.is_held_out(i)), mixed, strict=False)]
    rows = {r.doc_id: r.score for r in mixing.scores(spark.createDataFrame(texts + disorder, "doc_id long, text string")).collect()}
    plain, wild = sum(rows[i] for i, _ in held), sum(rows[i] for i, _ in disorder)
    assert plain > 0.8 * wild
    assert -plain / np.log10(2) / sum(len(t.encode()) for _, t in held) < 4


def brute_contexts(stream, at):
    """Contexts of the seven predictors before the byte `at` of a coded text, and the place in the word."""
    text = b"\0\0\0 " + stream
    i = at + 4
    begin = text.rindex(b" ", 0, i)
    before = max(text.rfind(b" ", 0, begin), 0)
    return [text[i - k : i] for k in range(5)] + [text[begin:i], text[before:i]], i - 1 - begin


def test_context_mixing_counts_are_exact(spark):
    """Scores under fixed weights against counts of whole contexts, across word ends, kept in a dictionary."""
    texts = [(k, t) for k, t in enumerate(["", "a b a c", "a b a c", " Le chat  a vu le chateau ", "chat chateaux é 中文 a a a", "of a cat\nof a dog of"] * 3)]
    streams = [b" ".join([*t.lower().encode().split(), b""]) + b" " for _, t in texts]
    counts, going = Counter(), lambda byte, k: (256 | byte) >> (8 - k)
    for (i, _), s in zip(texts, streams, strict=True):
        for at, byte in enumerate(s) if not mixing.is_held_out(i) else ():
            for order, context in enumerate(brute_contexts(s, at)[0]):
                counts.update((order, context, going(byte, k)) for k in range(9))
    mixer, wanted = mixing.Mixer(), []
    for s in streams:
        wanted.append(0)
        for at, byte in enumerate(s):
            contexts, place = brute_contexts(s, at)
            pairs = [[(counts[o, c, going(byte, k + 1)], counts[o, c, going(byte, k)]) for k in range(8)] for o, c in enumerate(contexts)]
            x = np.array([[mixing.log_odds(went, total - went) for went, total in p] for p in pairs], dtype=np.float32)
            gate = mixing.gates(np.full(8, place), np.array([total for _, total in pairs[5]]))
            wanted[-1] += mixer.cost(x, gate, np.array([byte >> (7 - k) & 1 for k in range(8)])).sum()
    chunks = mixing.written(mixing.chunk_words(spark.createDataFrame(texts, "doc_id long, text string").coalesce(1), 3), "chunks")
    table = mixing.written(mixing.edges(chunks), "edges")
    sums = Counter()
    for r in table.select("sums").collect():
        sums.update({x.key: x.n for x in r.sums})
    short = mixing.short_counts(*(np.array(x) for x in zip(*sums.items(), strict=True)))
    mine = np.zeros(len(texts))
    for r in mixing.text_costs(table, short, mixer).collect():
        mine[np.array(r.postings) & (mixing.CHUNK_DOCS - 1)] += r.own
    assert np.allclose(mine, wanted, rtol=1e-5)


def test_context_mixing_weights_fit_all_training_text(given):
    table = mixing.written(mixing.edges(mixing.written(mixing.chunk_words(given, 2), "chunks")), "edges")
    found = table.selectExpr("explode(sums) s").groupBy("s.key").agg({"s.n": "sum"}).toArrow()
    short = mixing.short_counts(found.column(0).to_numpy(), found.column(1).to_numpy().astype(float))
    before, after = (np.abs(mixing.summed(table, short, m, "slopes")[:, :, 0]).sum() for m in (mixing.Mixer(), mixing.fitted(table, short)))
    assert after < 0.05 * before
    trained = sum(len(b" ".join([*(r.text or "").lower().encode().split(), b""])) + 1 for r in given.collect() if not mixing.is_held_out(r.doc_id))
    assert mixing.summed(table, short, mixing.Mixer(), "hits")[0].sum() == 8 * trained


def test_context_mixing_reads_word_order(spark):
    """The same words in another order cost more; bits and bytes go with the score."""
    held = [i for i in range(200) if mixing.is_held_out(i)][:2]
    texts = [(i, "the grey cat sat on the old mat") for i in range(40) if not mixing.is_held_out(i)] + [(held[0], "the grey cat sat on the old mat"), (held[1], "mat the on cat the old sat grey")]
    rows = {r.doc_id: r for r in mixing.scores(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    plain, wild = (rows[i] for i in held)
    assert plain.n_known == wild.n_known and plain.bits < 0.5 * wild.bits
    assert np.isclose(plain.bits, -plain.score / np.log10(2)) and plain.bytes == wild.bytes == len("the grey cat sat on the old mat") + 2


def test_a_decision_distribution_sums_to_one():
    """All continuations of one byte share the whole probability."""
    tables = np.zeros((mixing.ORDERS, 2, mixing.SLOTS), dtype=np.float32)
    mixer = mixing.Mixer()
    spelled = mixer.log10([bytes([b]) for b in range(256)], tables)
    end = mixer.log10([b""], tables)[0]
    ends = mixer.log10([bytes([b, 32]) for b in range(1)], tables)
    assert np.isfinite(spelled).all() and np.isfinite(ends).all()
    assert abs(sum(10 ** (s - end) for s in spelled) - 1) < 1e-3


KINDS = [
    re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def brute_spans(text):
    digits = lambda s: [int(c) for c in s if c in "0123456789"]
    ok = [
        lambda s: True, lambda s: all(int(p) <= 255 for p in s.split(".")),
        lambda s: 14 <= len(digits(s)) <= 19 and sum(sum(divmod(d * 2, 10)) if k % 2 else d for k, d in enumerate(digits(s)[::-1])) % 10 == 0,
        lambda s: 10 <= len(digits(s)) <= 15,
    ]
    return sorted((m.start(), k, m.end()) for k, p in enumerate(KINDS) for m in p.finditer(text) if ok[k](m[0]))


TRICKY = [
    "a@b.c_d@e.f x@y a@@b.c", "..@a.b@c.d", "1.2.3.4.5.6.7.8", "0001.0255.256.1 256.1.1.1.1", "4111111111111111 4111-1111 1111-1111 41111",
    "+1 (234) 555-6789+1234567890", "+1 12", "+" * 50, "9" * 5000, "1." * 3000, "x@" * 2000, "a" * 100_000 + "@b.c", "٣٣٣.١.١.١ ４１１１", None, "",
]


def test_personal_data_rules(docs, given):
    rules = pii.Rules()
    texts = [*TRICKY, *(r.text for r in given.collect()), *(t for _, t, _, _ in ROWS)]
    for text in texts:
        assert [(a, k, b) for k, a, b in rules.spans(text or "")] == brute_spans(text or ""), (text or "")[:80]


def test_personal_data_learns_patterns(spark):
    """Numbers that fail their check sum are found after the words that stand before valid ones, others are not."""
    valid = [f"customer card number {n} was charged" for n in ("4111111111111111", "5500005555555559", "4012888888881881", "5105105105105100", "4222222222222220", "6011111111111117")]
    texts = [*valid * 3, "customer card number 4111111111111112 was charged", "the total was 123456789 units", "order 99887766 of 4111111111111112", "no data here"]
    found = pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    new = {r.doc_id: [(s.kind, texts[r.doc_id][s.start : s.end]) for s in r.new] for r in found if r.new}
    assert new == {18: [(2, "4111111111111112")]}


def test_personal_data_learns_written_forms(spark):
    """Phones and cards that the rules miss are found after trusted words, whatever separates their digits."""
    phones = [f"please call +1 (234) 555-67{k} today" for k in range(10, 40)]
    numbers = [n for n in map(str, range(4111111111111000, 4111111111111300)) if pii.luhn(n)]
    cards = [f"customer card number {n[:4]} {n[4:8]} {n[8:12]} {n[12:]} was charged" for n in numbers]
    unseen = {
        "please call +49 (30) 12-34 today": (3, "+49 (30) 12-34"), "please call 030 1234-56 today": (3, "030 1234-56"), "please call (234) 555-6789.": (3, "(234) 555-6789"),
        "customer card number 4111 1111 1111 1112 was charged": (2, "4111 1111 1111 1112"), "customer card number 10.0.0.1 4111-1111-1111-1112": None, "the total was 1234 5678 units": None,
    }
    texts = [*phones, *cards, *unseen]
    found = pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    new = {texts[r.doc_id]: [(s.kind, texts[r.doc_id][s.start : s.end]) for s in r.new] for r in found if r.new}
    assert {t: x for t, x in new.items() if unseen.get(t)} == {t: [x] for t, x in unseen.items() if x}
    assert "the total was 1234 5678 units" not in new and not set(new) & {*phones, *cards}
    rules = pii.Rules()
    assert [m[2] for m in rules.mentions(texts[-2], rules.spans(texts[-2]))] == ["10.0.0.1", "4111-1111-1111-1112"]


def test_personal_data_redaction(docs, spark):
    rows = pii.redact(docs)
    assert rows.columns == docs.columns and rows.dtypes == docs.dtypes and rows.count() == len(ROWS)
    text = rows.where("doc_id is null").first().text
    assert text == "mail <EMAIL> or <PHONE>, <CARD> from <IP>"
    assert {r.text for r in rows.where("doc_id <> 2").collect()} >= {ROWS[0][1], "", ROWS[-1][1]}
    assert all(r.n_chars == len(r.text) for r in rows.where("text is not null").collect())
    assert pii.find(docs.limit(0)).count() == 0 and pii.redact(docs.limit(0)).count() == 0
    clashing = docs.withColumnsRenamed({"lang": "_pii_key", "source": "_PII_spans"})
    again = pii.redact(clashing)
    assert again.columns == clashing.columns and sorted(map(str, again.collect())) == sorted(map(str, rows.toDF(*clashing.columns).collect()))


def test_op7_lists_spans(spark, given):
    import hashlib

    rows = {r.doc_id: r for r in queries.op7_personal_data(spark, SF).collect()}
    for d in given.collect():
        spans = brute_spans(d.text)
        listed = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in spans)
        r = rows[d.doc_id]
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == x for _, k, _ in spans) for x in range(4))
        assert set(filter(None, listed.split(","))) <= set(r.spans.split(","))
