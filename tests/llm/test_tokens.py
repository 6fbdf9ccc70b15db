"""Packing and token counts against the tokenizer library."""

import zlib
from collections import defaultdict

import numpy as np
import pytest

from prepflow.llm.packing import Limits, Packer, Piece, WordIds, pack
from prepflow.llm.token_counts import Counter, count_tokens
from prepflow.llm.queries import tokenizer_path

WORD_FILE, BYTE_FILE = tokenizer_path("word_bpe_49k.json"), tokenizer_path("byte_bpe_50k.json")


def library(path):
    from tokenizers import Tokenizer
    return Tokenizer.from_file(path)


def test_word_ids_equal_the_library(odd_texts):
    ids, whole = WordIds(WORD_FILE), library(WORD_FILE)
    for t in filter(None, [*odd_texts, "ΣΑΣ ὈΔΥΣΣΕΎΣ İstanbul é \x1c a b ﻿", "don't we'll", "x<|endoftext|>y"]):
        expected = np.array(whole.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes()
        assert ids(t.encode()) == expected, t


@pytest.mark.parametrize("chunk", [1 << 16, 7, 1])
def test_counts_equal_the_library_for_any_chunks(odd_texts, chunk):
    counter, whole = Counter(BYTE_FILE), library(BYTE_FILE)
    texts = [t for t in odd_texts if t and len(t) < 3000] + ["  a", "a  ", "a \n b", "<|endoftext|> <|endoftext|>", " x \x85 y"]
    for t in texts:
        assert counter.count(t, chunk) == len(whole.encode(t, add_special_tokens=False).ids), t


def test_counts_of_a_table(spark, odd_documents):
    whole = library(BYTE_FILE)
    rows = count_tokens(odd_documents, BYTE_FILE).collect()
    assert len(rows) == odd_documents.count()
    texts = {r.doc_id: r.text or "" for r in odd_documents.collect()}
    for r in rows:
        t = texts[r.doc_id]
        assert (r.n_bytes, r.n_tokens) == (len(t.encode()), len(whole.encode(t, add_special_tokens=False).ids))
    assert count_tokens(odd_documents.limit(0), BYTE_FILE).count() == 0


def check_pieces(rows, limits):
    docs, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        docs[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
        assert r.length == len(r.ids) // 4 > 0
    for pieces in sequences.values():
        pieces.sort(key=lambda p: p.offset)
        assert [p.offset for p in pieces] == [sum(x.length for x in pieces[:i]) for i in range(len(pieces))]
        assert sum(p.length for p in pieces) <= limits.tokens and len(pieces) <= limits.segments
        assert sum(p.loss_tokens for p in pieces) <= limits.loss_tokens
    return docs, sequences


def test_packing_is_whole_and_dense(spark, odd_documents):
    rows = pack(odd_documents, WORD_FILE).collect()
    docs, sequences = check_pieces(rows, Limits())
    ids, texts = WordIds(WORD_FILE), {r.doc_id: r.text or "" for r in odd_documents.collect()}
    assert docs.keys() == texts.keys()
    for doc_id, pieces in docs.items():
        expected = ids(texts[doc_id].encode()) + np.array([2], dtype="<u4").tobytes()
        copies = sum(p.start == 0 for p in pieces)
        assert sum(p.length for p in pieces) == copies * len(expected) // 4
        for p in pieces:
            assert p.ids == expected[4 * p.start:4 * (p.start + p.length)] and p.doc_tokens == len(expected) // 4
            assert zlib.crc32(p.ids) >= 0
    lengths = [sum(p.length for p in s) for s in sequences.values()]
    assert sum(0 if n & (n - 1) == 0 else 4096 - n for n in lengths) == 0
    assert pack(odd_documents.limit(0), WORD_FILE).count() == 0


def test_simultaneous_limits():
    """Prompts bear no loss; sequences keep all three limits and lose no token."""
    limits, rng = Limits(tokens=64, segments=4, loss_tokens=30, pool=16), np.random.default_rng(3)
    packer, placed, total = Packer(limits), [], 0
    for i in range(400):
        n = int(rng.integers(1, 150))
        total += n
        placed += packer.add(Piece(i, 0, bytes(4 * n), n, int(rng.integers(0, n + 1))))
    placed += packer.finish()
    assert sum(p.length for _, _, p in placed) == total
    by = defaultdict(list)
    for s, offset, p in placed:
        by[s].append((offset, p))
    for pieces in by.values():
        assert sum(p.length for _, p in pieces) <= 64 and len(pieces) <= 4 and sum(p.loss for _, p in pieces) <= 30


def test_loss_column(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h", 5), (2, "a b", 0)], "doc_id long, text string, prompt long")
    rows = pack(docs, WORD_FILE, limits=Limits(8, 4, 3), loss_from_col="prompt").collect()
    docs, _ = check_pieces(rows, Limits(8, 4, 3))
    assert sum(p.loss_tokens for p in docs[1]) == 4 and sum(p.length for p in docs[1]) == 9
