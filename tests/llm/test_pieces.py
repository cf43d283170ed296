import hashlib
import random

import numpy as np
import pytest
import sentencepiece

from epiframe.llm import pieces
from epiframe.llm.merges import merge_one, merge_words

ODD = ["a", "b", " ", "  ", "\n", "\t", "ing", " the", "▁", "é", "é", "中", "😀", "　", "\x00", "<s>", "</s>", "<0x0A>", ".", "12"]


@pytest.fixture(scope="module")
def library(piece_path):
    return sentencepiece.SentencePieceProcessor(model_file=piece_path)


def fuzz(n=1500):
    rng = random.Random(3)
    return ["".join(rng.choice(ODD) for _ in range(rng.randint(0, 30))) for _ in range(n)] + [
        "", " ", "  ", "\n", " \n", "a" * 3000, "ab" * 700, "x  ", " " * 200, "中" * 700, "\n\n a"]


def test_ids_and_decoding_equal_the_library(piece_path, library):
    texts = fuzz()
    flat, sizes = pieces.encode_texts(piece_path, texts)
    for text, ids in zip(texts, np.split(flat, np.cumsum(sizes)[:-1])):
        assert ids.tolist() == library.encode(text) + [library.eos_id()]
        assert pieces.model(piece_path).decode(ids.tolist()) == library.decode(ids.tolist())


def test_decoding_any_ids_equals_the_library(piece_path, library):
    rng = random.Random(4)
    for _ in range(3000):
        ids = [rng.choice([rng.randrange(3, 32000), rng.randrange(3, 259), 28705, 2, 1]) for _ in range(rng.randrange(12))]
        assert pieces.model(piece_path).decode(ids) == library.decode(ids)


def test_rounds_and_queue_agree(piece_path):
    table = pieces.model(piece_path).pairs
    rng = np.random.default_rng(5)
    symbols = rng.integers(28705, 28800, 6000).astype(np.int32)
    lens = np.diff(np.concatenate(([0], np.sort(rng.choice(np.arange(1, 6000), 300, replace=False)), [6000])))
    flat, sizes = merge_words(table, symbols, lens, long_word=10**9)
    ends = np.cumsum(lens)
    for ids, a, b in zip(np.split(flat, np.cumsum(sizes)[:-1]), ends - lens, ends):
        assert ids.tolist() == merge_one(table, symbols[a:b].tolist())


def test_query_on_whole_table(spark, library):
    from epiframe.llm.queries import QUERIES
    from tests.conftest import SF_SMALL

    got = {r["doc_id"]: r for r in QUERIES["op7_pieces"](spark, SF_SMALL).collect()}
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        ids = library.encode(d["text"] or "") + [2]
        assert got[d["doc_id"]]["n_tokens"] == len(ids)
        assert got[d["doc_id"]]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[d["doc_id"]]["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_nulls_repeats_and_empty_table(make_docs, piece_path):
    docs = make_docs([None, "", "x", "x"])
    rows = pieces.decode(pieces.encode(docs.unionByName(docs), piece_path), piece_path).collect()
    assert len(rows) == 8
    assert {(r["doc_id"], len(r["ids"]), r["decoded"]) for r in rows} == {(0, 1, ""), (1, 1, ""), (2, 2, "x"), (3, 2, "x")}
    assert pieces.encode(make_docs([]), piece_path).collect() == []
