import random
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pytest
from tokenizers import Tokenizer

from ledgerlens.llm import token_files as T
from ledgerlens.llm.queries import QUERIES


@pytest.mark.parametrize("bits", [1, 3, 8, 13, 16, 17, 31])
def test_pack_round_trip(bits):
    ids = np.random.default_rng(bits).integers(0, 2 ** bits, 1003).astype(np.uint32)
    data = T.pack(ids, bits)
    assert len(data) == -(-1003 * bits // 8) and (T.unpack(data, bits, 1003) == ids).all()
    assert T.bit_width(2 ** bits) == bits and T.bit_width(2 ** bits + 1) == bits + 1


def test_random_access(tmp_path):
    rng = np.random.default_rng(5)
    texts = [rng.integers(0, 2 ** 13, n).astype(np.uint32) for n in (0, 3, 9000, 1, 20_000, 0)]
    with open(tmp_path / "f", "wb") as f:
        w = T.TokenWriter(f, 13)
        for i, ids in enumerate(texts):
            w.add(None if i == 1 else i, ids)
        w.close()
    with open(tmp_path / "f", "rb") as f:
        got = T.TokenFile(f, (tmp_path / "f").stat().st_size)
        assert [(k, ids.tolist()) for k, ids in got.all_documents(5000)] == [(None if i == 1 else i, x.tolist()) for i, x in enumerate(texts)]
        whole = np.concatenate(texts)
        for a, b in ((0, 1), (4095, 4097), (5, 5), (8000, 29_004)):
            assert (got.tokens(a, b) == whole[a:b]).all()
        assert (got.document(4) == texts[4]).all()
    (tmp_path / "cut").write_bytes((tmp_path / "f").read_bytes()[:-3])
    with open(tmp_path / "cut", "rb") as f, pytest.raises(ValueError):
        T.TokenFile(f, (tmp_path / "cut").stat().st_size)


def expected(tokenizer, texts):
    out, start = [], 0
    for i, t in texts:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [1]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_query_equals_library(spark, small, documents, vocabulary):
    tokenizer = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    got = [tuple(r)[:4] for r in QUERIES["op2_token_files"](spark, small).orderBy("doc_id").collect()]
    assert got == expected(tokenizer, sorted(documents.items()))


@pytest.mark.parametrize("file", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_odd_texts_equal_library(odd_texts, vocabulary, file):
    tokenizer = Tokenizer.from_file(vocabulary(file))
    encoder = T.TextEncoder(vocabulary(file))
    assert encoder.cuts == (file == "word_bpe_49k.json")
    rng = random.Random(8)
    parts = ["ANKARA", "BELEDİYESİ", "İ", "i̇", "ß", "ŉ", "ǰ", ".", ",", " ", "\n", "  ", "é", "e\u0301", "\u0301", "Σ", "'s", "9", "<|endoftext|>", "<|startoftext|>", "日本", "\u3000", "\t", "K"]
    texts = [*odd_texts, "ANKARA BELEDİYESİ.", "İ,", "A\u0307.", *("".join(rng.choice(parts) for _ in range(rng.randint(1, 8))) for _ in range(3000))]
    ids, bounds = encoder.encode(pa.array(texts))
    for i, t in enumerate(texts):
        assert ids[bounds[i]:bounds[i + 1]].tolist() == tokenizer.encode(t or "", add_special_tokens=False).ids, repr(t)


def test_words_are_encoded_once_whatever_their_case_and_mark(vocabulary):
    path = vocabulary("word_bpe_49k.json")
    encoder, tokenizer = T.TextEncoder(path), Tokenizer.from_file(path)
    for white in " \n":
        texts = [f"a{white}{word}{mark}" for word in ("harbour", "Harbour", "HARBOUR") for mark in ("", ".", ",", ";", ")")]
        ids, bounds = encoder.encode(pa.array(texts))
        assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert encoder.n == 6  # "a", " harbour" and four marks


def test_lowered_and_cut_texts_equal_library(vocabulary):
    path = vocabulary("word_bpe_49k.json")
    encoder, tokenizer = T.TextEncoder(path), Tokenizer.from_file(path)
    rng = random.Random(3)
    parts = ["A", "J", "K", "z", "\u030c", "\u0307", "\u0338", "\u0345", "Σ", "É", "ǅ", "İ", "٣", "7", "=", "<", ">", "|", "'", "'S", "'re", "-", "_", "`", "\x7f", "\xad", "\u200d",
             "<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>", "X<|", " ", "\n", "\r\n", "\xa0", "\x85", "\x1c"]
    texts = ["", "J\u030c", "J", "\u030c", None, "B", *("".join(rng.choice(parts) for _ in range(rng.randint(1, 9))) for _ in range(20_000))]
    ids, bounds = encoder.encode(pa.array(texts))
    for i, t in enumerate(texts):
        assert ids[bounds[i]:bounds[i + 1]].tolist() == tokenizer.encode(t or "", add_special_tokens=False).ids, repr(t)


def test_defined_cases(spark, table, vocabulary):
    path = vocabulary("word_bpe_49k.json")
    docs = table(["b a", None, "x", "x", "c"], [5, None, 3, 3, 4])
    got = [tuple(r) for r in T.token_file_digests(docs, path, 1).orderBy("start").collect()]
    tokenizer = Tokenizer.from_file(path)
    assert got == expected(tokenizer, [(None, None), (3, "x"), (3, "x"), (4, "c"), (5, "b a")])
    assert T.token_file_digests(docs.limit(0), path, 1).collect() == []


def test_files_are_listed_in_order(spark, scratch, table, vocabulary):
    docs = table([f"text {i}" for i in range(50)], list(range(50))[::-1])
    files = T.write_token_files(docs, vocabulary("word_bpe_49k.json"), scratch, end_id=None).collect()
    assert sum(f["documents"] for f in files) == 50
    keys = []
    for f in sorted(files, key=lambda f: f["part"]):
        fs, path = pyarrow.fs.FileSystem.from_uri(f["path"])
        with fs.open_input_file(path) as stream:
            keys += T.TokenFile(stream, stream.size()).keys.tolist()
    assert keys == list(range(50))
