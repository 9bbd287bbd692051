import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tessella.llm import tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = ["a b", "", None, " lead", "two  spaces", "tail ", "tab\there", "x \n y", "é x don't 'll", "<|endoftext|> z <|endoftext|>", "a<|endoftext|>b", "<|endoftext", "\n\nq w\n", "日本 語 ok", "a b", "\x1c s \x1f t", "word " * 3000, "​ z ́q"]


def truth(texts):
    t = Tokenizer.from_file(PATH)
    return [np.array(t.encode(x or "", add_special_tokens=False).ids + [0], "<u4").tobytes() for x in texts]


def test_memo_equals_plain_encoding():
    e = tokens.Encoder(PATH)
    assert [x + b"\0\0\0\0" for x in e.encode([t or "" for t in TEXTS])] == truth(TEXTS)


def test_memo_equals_plain_encoding_on_documents():
    import pyarrow.parquet as pq

    texts = pq.read_table("/root/testdata/sf0.001/documents.parquet").column("text").to_pylist()
    texts += [t.replace(" ", "\n", 3).replace("e", "'s") for t in texts]
    e = tokens.Encoder(PATH)
    assert [x + b"\0\0\0\0" for x in e.encode(texts)] == truth(texts)


def test_round_trip(spark):
    rows = [(i * 3, t, "other") for i, t in enumerate(TEXTS)]
    m = tokens.write_tokens(spark.createDataFrame(rows, "doc_id long, text string, file string"), PATH, partitions=4)
    got = sorted(tokens.read_documents(m).collect())
    want, at = truth(TEXTS), 0
    for r, w, (i, _, _) in zip(got, want, rows, strict=True):
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32, bytes(r.ids)) == (i, at, len(w) // 4, zlib.crc32(w), w)
        at += len(w) // 4
    assert [r.doc_id for r in tokens.read_documents(m, [6, 9]).collect()] == [6, 9]


def test_damage_is_found_and_plain_zstd_reads(spark, tmp_path):
    m = tokens.write_tokens(spark.createDataFrame([(1, "a b c"), (2, "d")], "doc_id long, text string"), PATH, partitions=1).collect()
    path = m[0].file.removeprefix("file://")
    raw = bytearray(open(path, "rb").read())
    f = tokens.SeekableFile("file://" + path)
    assert len(f) == 2
    raw[int(f.starts[1]) + 8] ^= 1
    (tmp_path / "bad").write_bytes(raw)
    bad = tokens.SeekableFile(f"file://{tmp_path}/bad")
    bad.read(0)
    with pytest.raises(Exception):
        bad.read(1)


def test_empty_table(spark):
    m = tokens.write_tokens(spark.createDataFrame([], "doc_id long, text string"), PATH)
    assert tokens.read_documents(m).count() == 0


def test_only_texts_that_come_again_are_remembered():
    e = tokens.Encoder(PATH)
    texts = ["x w" + "".join("abcdefghij"[i // n % 10] for n in (1, 10, 100)) + " %" for i in range(1000)]
    want = [x[:-4] for x in truth(texts)]
    assert e.encode(texts) == want and len(e.words) < 50
    assert e.encode(texts) == want and len(e.words) >= 1000


def test_each_different_word_is_looked_up_once():
    e, calls = tokens.Encoder(PATH), []
    look = e._word
    e._word = lambda *a: (calls.append(a), look(*a))[1]
    texts = [f"abc{a}. xyz{b}!\nqrs{b}, tuv{a}" for a in "abcdefghijklmnopqrst" for b in "abcdefghijklmnopqrst"]
    assert e.encode(texts) == [x[:-4] for x in truth(texts)]
    assert len(calls) < 120


def test_marks_and_line_feeds_equal_plain_encoding():
    r = random.Random(1)
    words = ["der", "Über", "don't", "'ll", "a1", "5€", "×", "x×", "ÿ", "ǅ", "ж", "-", "(q)", "²", "…", "日", "\t", "<|endoftext|>", ""]
    marks = ["", ".", ",", "...", "'s,", "!?'", "|", "%%%", "é.", "÷,"]
    texts = ["".join(r.choice(words) + r.choice(marks) + r.choice("  \n") for _ in range(r.randrange(6)))[: r.choice((-1, 99))] for _ in range(4000)]
    e = tokens.Encoder(PATH)
    assert [x + b"\0\0\0\0" for x in e.encode(texts)] == truth(texts)


def test_parts_have_all_rows_in_order(monkeypatch):
    monkeypatch.setattr(tokens, "PART_BYTES", 10)
    texts = ["a b", None, "c" * 35, "", "d e", "f", "g h i j k l"]
    batch = pa.record_batch({"doc_id": list(range(8)), "text": ["cut off", *texts]}).slice(1)
    parts = list(tokens._parts(batch))
    assert len(parts) > 2 and pa.Table.from_batches(parts).to_pylist() == batch.to_pylist()
    e = tokens.Encoder(PATH)
    assert [x + b"\0\0\0\0" for p in parts for x in e.encode(p.column(1).fill_null(""))] == truth(texts)
    assert [p.num_rows for p in tokens._parts(batch.slice(0, 0))] == [0] and e.encode([]) == []
