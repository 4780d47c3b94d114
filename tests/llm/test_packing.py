import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from ledgerlens.llm import packing as P
from ledgerlens.llm import pieces as E
from ledgerlens.llm.queries import QUERIES

FILE = "byte_bpe_50k.json"
ODD = ["a  b", " a", "a ", "\n", "a\nb", "a\n\nb", "a.\nB, c", "x y  z", "a  b", "  a", "　 b 　", "it's  we'll <|endoftext|> a", "a <|endoftext|>", "\n<|endoftext|>\n",
       "<|endoftext|>.a", "é. è, ñ", "é. ä,", "1.5, 2,3 .", "...a ,b", "tab\tb \tc\x1c d\x85 e", "日本語。 です", "« guillemets » “quoted” – dash", "x" * 700, "ab " * 500, "💥 a💥 b", "a\r\nb\r c", "A.B.C. d", "\x0b a \x0c b", "\x00 a\x00 b"]


def test_pieces_equal_library(vocabulary, odd_texts):
    path = vocabulary(FILE)
    library, encoder = Tokenizer.from_file(path), E.PieceEncoder(path)
    assert encoder.cuts
    rng = random.Random(4)
    parts = [*ODD, " ", "\n", ".", ",", "'s", " ", " ", "é", "word", " the", "9", "-", "\t", "²", "́", "İ", "​"]
    texts = [*odd_texts, *ODD, *("".join(rng.choice(parts) for _ in range(rng.randint(1, 12))) for _ in range(3000))]
    for at in range(0, len(texts), 400):
        some = texts[at:at + 400]
        ids, bounds = encoder.encode(pa.array([None, *some], pa.string()).slice(1))
        for i, t in enumerate(some):
            assert ids[bounds[i]:bounds[i + 1]].tolist() == library.encode(t or "", add_special_tokens=False).ids, repr(t)


def test_other_vocabularies_encode_whole_texts(vocabulary):
    path = vocabulary("word_bpe_49k.json")
    library, encoder = Tokenizer.from_file(path), E.PieceEncoder(path)
    assert not encoder.cuts
    ids, bounds = encoder.encode(pa.array(["A b.", None, "", "c  d"]))
    assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == [library.encode(t, add_special_tokens=False).ids for t in ("A b.", "", "", "c  d")]


def test_memory_is_bounded_in_bytes(vocabulary, monkeypatch):
    monkeypatch.setattr(E, "MEMO_BYTES", 100_000)
    encoder, rng = E.PieceEncoder(vocabulary(FILE)), random.Random(1)
    for _ in range(30):
        encoder.encode(pa.array([" ".join("".join(rng.choices("abcdefgh", k=9)) for _ in range(200)) + "日本" * 300]))
        assert len(encoder.memo) < 1000 and encoder.held < 300_000
        assert max(map(len, encoder.memo)) <= E.LONGEST


def plain_best_fit(lengths, capacity, most_open):
    """The definition, over lists of all open sequences."""
    free, open_, out = [], [], []
    for n in lengths:
        fits = [s for s in open_ if free[s] >= n]
        if fits:
            s = min(fits, key=lambda s: free[s])
        else:
            s = len(free)
            free.append(capacity)
            if len(open_) >= most_open and n < capacity:
                open_.remove(min(open_, key=lambda s: free[s]))
            open_.append(s)
        out.append(capacity - free[s])
        free[s] -= n
        open_ = [s for s in open_ if free[s]]
    return out, free


@pytest.mark.parametrize("most_open", [1, 3, 20, 1000])
def test_best_fit_equals_its_definition(most_open):
    rng = random.Random(most_open)
    lengths = [rng.choice([rng.randint(1, 50), rng.randint(1, 10), 50]) for _ in range(600)]
    fit = P.BestFit(50, most_open)
    put = [fit.put(n) for n in lengths]
    offsets, free = plain_best_fit(lengths, 50, most_open)
    used = {}
    for (s, o), n in zip(put, lengths, strict=True):
        assert o == used.get(s, 0)
        used[s] = o + n
    assert [o for _, o in put] == offsets
    assert sorted(used.values()) == sorted(50 - f for f in free) and fit.n_open <= most_open


def test_bounds_of_pieces():
    doc, piece, start, length = P.piece_bounds(np.array([1, 1024, 1025, 3000]), 1024)
    assert list(zip(doc.tolist(), piece.tolist(), start.tolist(), length.tolist(), strict=True)) == [
        (0, 0, 0, 1), (1, 0, 0, 1024), (2, 0, 0, 1), (2, 1, 1, 1024), (3, 0, 0, 952), (3, 1, 952, 1024), (3, 2, 1976, 1024)]


def check(rows, texts, tokenizer, capacity, end):
    """Pieces are those of the texts, sequences are gapless; returns how many."""
    want = []
    for i, t in texts:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, end]
        first, start = (len(ids) - 1) % capacity + 1, 0
        for piece, stop in enumerate(range(first, len(ids) + 1, capacity)):
            want.append((i, piece, start, stop - start, zlib.crc32(np.array(ids[start:stop], "<u4").tobytes())))
            start = stop
    assert sorted((tuple(r)[:5] for r in rows), key=repr) == sorted(want, key=repr)
    used = {}
    for r in sorted(rows, key=lambda r: r["offset"]):
        assert r["offset"] == used.get(r["sequence_id"], 0)
        used[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(used.values(), default=0) <= capacity
    return len(used), -(-sum(used.values()) // capacity)


def test_query_packs_every_document(spark, small, documents, vocabulary):
    rows = QUERIES["op12_best_fit_packing"](spark, small).collect()
    n, least = check(rows, documents.items(), Tokenizer.from_file(vocabulary(FILE)), 1024, 2)
    assert n <= 1.02 * least + 1


def test_defined_cases(spark, table, vocabulary, odd_texts):
    path = vocabulary(FILE)
    texts = [*zip([*range(len(odd_texts))], odd_texts, strict=True), (None, None), (None, "x"), (3, "a"), (3, "a"), (3, "a")]
    docs = table([t for _, t in texts], [i for i, _ in texts])
    placed = P.packed_documents(docs, path, 40, 7, ids=True, most_open=5, task_rows=8)
    tokenizer = Tokenizer.from_file(path)
    n, _ = check([r for r in placed.drop("ids").collect()], texts, tokenizer, 40, 7)
    whole = P.sequences(P.packed_documents(docs, path, 40, 7, ids=True)).collect()
    held = sorted((d["document"], d["start"]) for s in whole for d in s["documents"] if d["document"] == 8)
    assert len(whole) <= n and held[0] == (8, 0)
    ids = {(d["document"], d["start"]): s["ids"][sum(e["length"] for e in s["documents"][:i]):][:d["length"]] for s in whole for i, d in enumerate(s["documents"])}
    assert [x for k in held for x in ids[k]] == [*tokenizer.encode(odd_texts[8], add_special_tokens=False).ids, 7]
    assert P.packed_documents(docs.limit(0), path, 40, 7).collect() == []
    with pytest.raises(ValueError):
        P.BestFit(10).put(11)
