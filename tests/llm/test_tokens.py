import io
import random
import zlib

import numpy as np
import pytest

pytest.importorskip("loomline.llm")
from hypothesis import given, settings
from hypothesis import strategies as st

from loomline.llm import token_counts as C
from loomline.llm import token_output as O

WORDS, BYTES = C.vocabulary_path("word_bpe_49k.json"), C.vocabulary_path("byte_bpe_50k.json")
TEXT = st.text(alphabet=st.sampled_from("abzAZéÉß'’std.,!_0129 \t\n\r\x0b\x0c\x1c\x1f\x7f\x00\x85\xa0́İΣς漢ǅ²½<|>"), max_size=40)


@given(TEXT | st.text(max_size=20))
@settings(max_examples=400, deadline=None)
def test_counts_and_ids_equal_the_library(text):
    c, e = C.counter_of(WORDS), O.encoder_of(BYTES)
    assert c.count(text) == c.encode([text])[0]
    assert e.ids(text) == e.encode(text)


def test_special_strings_inside_texts():
    c, e = C.counter_of(WORDS), O.encoder_of(BYTES)
    for text in ("a <|endoftext|> b", "<|startoftext|>x", "x <|endoftext|", " <|endoftext|>\n\nq"):
        assert c.count(text) == c.encode([text])[0]
        assert e.ids(text) == e.encode(text)


def test_prefix_counts_answer_budgets():
    c = C.counter_of(WORDS)
    prefix = c.prefix_counts("one two three, four")
    assert prefix[0] == 0 and prefix[-1] == c.count("one two three, four")
    n = c.pieces_within(prefix, 2)
    assert prefix[n] <= 2 < prefix[n + 1]


@pytest.mark.parametrize("seed", range(6))
def test_blocks_round_trip(seed):
    r = random.Random(seed)
    counts = [r.choice([0, 1, 3, 127, 128, 129, 1000]) for _ in range(r.choice([0, 1, 20]))]
    ids = np.array([r.choice([2, 5, 50256, r.randrange(50257), 2**32 - 1 if seed == 5 else 7]) for _ in range(sum(counts))], dtype="<u4")
    image = O.encode_file(np.arange(len(counts)), np.array(counts, np.uint32), ids)
    head = O.read_head(image)
    n = head.n
    assert head.counts.tolist() == counts and n == len(ids) and head.doc_ids.tolist() == list(range(len(counts)))
    assert O.decode_ids(image, 0, n).tolist() == ids.tolist()
    for _ in range(5):
        a = r.randrange(n + 1)
        b = r.randrange(a, n + 1)
        assert O.decode_ids(image, a, b).tolist() == ids[a:b].tolist()


ROWS = [(5, "the quick brown fox, 12 isn't"), (1, None), (3, ""), (2, "Été\n\n  x\ty"), (9, "long " * 5000), (3, ""), (None, "no id")]


@pytest.fixture
def docs(spark):
    return spark.createDataFrame([(*r, "x") for r in ROWS], "doc_id long, text string, n_tokens string")


def test_counts_of_odd_rows(docs, spark):
    got = sorted(map(tuple, C.count_tokens(docs, WORDS, 100).collect()), key=str)
    c = C.counter_of(WORDS)
    want = [(i, len((t or "").encode()), n := c.encode([t or ""])[0], n > 100) for i, t in ROWS]
    assert got == sorted(want, key=str)
    assert C.count_tokens(docs.limit(0), WORDS).count() == 0
    assert {r.doc_id: r.prefix_tokens for r in C.prefix_table(docs, WORDS).collect()}[1] == [0]


def test_files_of_odd_rows(docs):
    e = O.encoder_of(BYTES)
    want, at = [], 0
    for i, t in sorted(ROWS, key=lambda r: (r[0] is None, r[0])):
        ids = e.encode(t or "") + (2).to_bytes(4, "little")
        want.append((i, at, len(ids) // 4, zlib.crc32(ids)))
        at += len(ids) // 4
    assert sorted(map(tuple, O.token_output(docs, BYTES).collect()), key=lambda r: r[1]) == want
    assert O.token_output(docs.limit(0), BYTES).count() == 0


def test_small_files_and_stretches(docs, monkeypatch):
    whole = sorted(map(tuple, O.token_output(docs, BYTES).collect()), key=lambda r: r[1])
    e, text = O.encoder_of(BYTES), "long words, 12 of them  here\n and isn't " * 900
    monkeypatch.setattr(O, "CHARS", 100)
    assert len(list(O.cuts(text))) > 100 and e.ids(text) == e.encode(text)
    file = O.TokenFile(out := io.BytesIO(), False)
    monkeypatch.setattr(O, "PACKED_IDS", 256)
    for n in (0, 3, 700, 0, 128, 5000):
        file.add(bytes(range(4)) * n)
        file.end(n)
    file.close()
    reader = O.read_head(out.getvalue())
    assert O.document_sums(reader) == [zlib.crc32(bytes(range(4)) * n) for n in (0, 3, 700, 0, 128, 5000)]
    assert [r[3] for r in whole] == [zlib.crc32(e.encode(t or "") + (2).to_bytes(4, "little")) for _, t in sorted(ROWS, key=lambda r: (r[0] is None, r[0]))]


def test_a_frequent_row_is_dealt_out(spark):
    rows = spark.range(4000).selectExpr("if(id % 3 = 0, 7L, id) AS doc_id", "if(id % 3 = 0, 'the same text', concat('text ', id)) AS text")
    got = sorted(map(tuple, O.token_output(rows, BYTES).collect()), key=lambda r: r[1])
    assert [g[0] for g in got] == sorted(r.doc_id for r in rows.collect())
    assert all(a[1] + a[2] == b[1] for a, b in zip(got, got[1:]))


def test_query_keeps_rows_without_id(spark, tmp_path):
    e = O.encoder_of(BYTES)
    rows = [(5, "the quick brown fox"), (None, "no id"), (2, None), (None, None), (None, "no id"), (7, ""), (None, "Été " * 300)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, O.op7_token_output(spark, str(tmp_path)).collect()), key=lambda r: r[1])
    coded = [(i, e.encode(t or "") + (2).to_bytes(4, "little")) for i, t in rows]
    assert sorted(((i, n, c) for i, _, n, c in got), key=str) == sorted(((i, len(b) // 4, zlib.crc32(b)) for i, b in coded), key=str)
    assert [g[0] for g in got] == [2, 5, 7, None, None, None, None]
    ends = [start + n for _, start, n, _ in got]
    assert [start for _, start, _, _ in got] == [0, *ends[:-1]]


@pytest.mark.parametrize("text", ["it’s a “quoted” word — and more, 12 of them", "漢字 and 仮名, mixed", "a <|endoftext|> b, c", "Σίσυφος’s stone <|endoftext|>\n\n  x"])
def test_prefixes_of_unusual_texts(text):
    c = C.counter_of(WORDS)
    prefix = c.prefix_counts(text)
    encoding = c.tokenizer.encode(text, add_special_tokens=False)
    ends = {w: end for w, (_, end) in zip(encoding.word_ids, encoding.offsets)}  # the last token of each piece
    assert len(prefix) == len(ends) + 1 > 4
    assert prefix == [0, *(c.encode([text[:end]])[0] for end in ends.values())]
    for limit in range(prefix[-1] + 2):
        n = c.pieces_within(prefix, limit)
        assert prefix[n] <= limit and (n == len(ends) or limit < prefix[n + 1])
        assert c.within(text, limit) == (prefix[-1], prefix[-1] > limit)


def test_query_counts_by_prefixes(monkeypatch):
    c = C.counter_of(WORDS)
    monkeypatch.setattr(c, "prefix_counts", lambda text: [0, 3, 7])
    assert c.count("x") == 7
    assert [c.within("x", n) for n in (2, 6, 7)] == [(7, True), (7, True), (7, False)]
