import hashlib
import json

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from ledgerlens.llm import bpe, pieces
from ledgerlens.llm.queries import QUERIES


@pytest.fixture(scope="module")
def library(vocabulary):
    return Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def lexicon(vocabulary, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("lexicon") / "l.bin")
    bpe.compile_lexicon([" the", "the", " thes", " running", "running", " idiot", "a", " é", "日本"], vocabulary("byte_bpe_50k.json"), path)
    return bpe.Lexicon(path)


def test_automaton_is_minimal_and_numbers_words():
    words = sorted(b"nation station stations nations ration rations a".split())
    root = bpe.minimal_automaton(words)
    flat = bpe.flatten(root)
    assert len(flat["final"]) < sum(map(len, words)) / 2 and flat["final"].sum() == 2  # ends: "...n", and "a" or "...s"
    reached, state = [], 0
    for w in words:
        state, out = 0, 0
        for c in w:
            i = list(flat["arc_key"]).index(state * 256 + c)
            state, out = flat["arc_to"][i], out + flat["arc_out"][i]
        reached.append(out)
    assert reached == list(range(len(words)))


def test_lexicon_places(lexicon):
    known = sorted(w.encode() for w in [" the", "the", " thes", " running", "running", " idiot", "a", " é", "日本"])
    asked = [*known, b" th", b"", b" thesx", "日".encode()]
    assert lexicon.places(asked).tolist() == [*range(len(known)), -1, -1, -1, -1]


def test_odd_texts_equal_library(lexicon, library, odd_texts):
    ids, bounds = lexicon.encode(pa.array(odd_texts))
    for i, (t, written, text) in enumerate(zip(odd_texts, lexicon.written(ids, bounds), lexicon.decoded(ids, bounds), strict=True)):
        want = library.encode(t or "", add_special_tokens=False).ids
        assert ids[bounds[i]:bounds[i + 1]].tolist() == want and written == ",".join(map(str, want))
        assert text.decode() == library.decode(want, skip_special_tokens=False)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["a", " ", "  ", "\n", "\t", "the", "'s", "1", "é", "ñ", ".", "\x85", " ", "<|endoftext|>", "zq", "日"]), max_size=25).map("".join))
def test_encoding_equals_library(lexicon, library, text):
    ids, _ = lexicon.encode(pa.array([text, None]))
    assert ids.tolist() == library.encode(text, add_special_tokens=False).ids


def test_texts_without_spaces_are_not_remembered(lexicon):
    """Long pieces leave no trace in a worker's memory but their ids, which count."""
    lexicon.encode(pa.array(["日本語" * 1000, "x" * 3000]))
    assert max(map(len, lexicon.memo), default=0) <= pieces.LONGEST


def test_long_words_merge_alike(vocabulary):
    with open(vocabulary("byte_bpe_50k.json"), "rb") as f:
        merger = bpe.Merger(json.load(f))
    word = b" " + b"thingandreallytheing" * 2
    assert merger._merge_long([merger.first[b] for b in word]) == merger.merge(word)


def test_query_equals_library(spark, small, documents, library):
    rows = QUERIES["op5_bpe"](spark, small).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(documents)
    for r in rows:
        ids = library.encode(documents[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_defined_cases_and_round_trip(spark, table, vocabulary, odd_texts):
    path = vocabulary("byte_bpe_50k.json")
    docs = table([*odd_texts, "a"], [None, 1, 1, *range(3, len(odd_texts) + 1)])
    ids = bpe.encode(docs, path, ["doc_id", "copy", "n"])
    assert ids.columns == ["doc_id", "copy", "n", "ids"]
    back = bpe.decode(ids, path, ["doc_id"])
    assert sorted(str(r["text"]) for r in back.collect()) == sorted(t or "" for t in [*odd_texts, "a"])
    assert bpe.encode_digests(docs.limit(0), path).collect() == []
    assert bpe.encode_digests(table([None]), path).collect()[0]["n_tokens"] == 0


def test_word_counts_and_lexicon_words(spark, table):
    docs = table(["the cat. the dog", "the  cat", None])
    counts = {r["word"]: r["n"] for r in bpe.word_counts(docs).collect()}
    assert counts == {"the": 2, " cat": 2, ".": 1, " the": 1, " dog": 1, " ": 1}
    assert sorted(bpe.lexicon_words(docs, size=3)) == [" cat", "the"]
