"""Token ids, packing, token files and longest-match counts."""

import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer, normalizers, pre_tokenizers

from kveil.llm import packing, token_files, tokens, wordpiece_counts, words
from kveil.session import shared_dir

KINDS = [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)]


def library(name, texts):
    tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
    tokenizer.encode_special_tokens = True
    return [e.ids for e in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


@pytest.mark.parametrize("name,space", KINDS)
@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab É.,'  \n\t ×́…1٠Z\x1c", max_size=12), max_size=12))
def test_same_ids(name, space, texts):
    got = tokens.encoder(public_tokenizers.path(name), space).encode(*words.flat(pa.array(texts, pa.string())))
    want = library(name, texts)
    assert [got.ids[a:b].tolist() for a, b in zip(got.ptr[:-1], got.ptr[1:])] == want


def test_another_tokenizer_file_is_noticed(tmp_path):
    """Cut rules of another file are not assumed: its texts go through the library whole."""
    texts = ["Some Words  here, don't", "", "x", "Ünïcode 日本 12345", None, "x"]
    for name, space in KINDS:
        tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
        assert tokens.is_known(tokenizer, space) and not tokens.is_known(tokenizer, not space)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.normalizer = normalizers.Lowercase()
    tokenizer.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Digits(True), pre_tokenizers.ByteLevel(add_prefix_space=True)])
    path = str(tmp_path / "other.json")
    tokenizer.save(path)
    got = tokens.Encoder(path, True).encode(*words.flat(pa.array(texts, pa.string())), end_id=0)
    want = [e.ids + [0] for e in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert [got.ids[a:b].tolist() for a, b in zip(got.ptr[:-1], got.ptr[1:])] == want
    added = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    added.add_tokens(["Words"])
    assert not tokens.is_known(added, True)


def test_memo_is_bounded(monkeypatch, rows):
    monkeypatch.setattr(tokens, "MEMO_ENTRIES", 50)
    coder = tokens.Encoder(public_tokenizers.path("word_bpe_49k.json"), False)
    texts = [t for _, t in rows if t]
    for text, want in zip(texts, library("word_bpe_49k.json", texts)):
        assert coder.encode(*words.flat(pa.array([text]))).ids.tolist() == want


def test_first_fit():
    rnd = random.Random(2)
    sizes = np.array([rnd.randint(1, 100) for _ in range(300)])
    where, offset = packing.first_fit_decreasing(sizes, 100)
    free: list[int] = []
    for i in np.argsort(-sizes, kind="stable"):
        k = next((k for k, f in enumerate(free) if f >= sizes[i]), len(free))
        if k == len(free):
            free.append(100)
        assert (where[i], offset[i]) == (k, 100 - free[k])
        free[k] -= sizes[i]


def test_pack(docs, rows, empty):
    path = public_tokenizers.path("byte_bpe_50k.json")
    cut = packing.pieces(docs, path, 0, True, capacity=64, with_ids=True)
    got = packing.pack(cut, capacity=64, group_pieces=30).collect()
    want = sorted((i is None, i or 0, ids + [0]) for (i, _), ids in zip(rows, library("byte_bpe_50k.json", [t for _, t in rows])))
    for r in got:
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) and r["length"] == len(r["ids"]) <= 64
    by_doc: dict = {}
    for r in got:
        by_doc.setdefault((r["doc_id"], r["doc_tokens"]), []).append((r["start"], r["ids"]))
    total = sorted(i for _, _, ids in want for i in ids)
    assert sorted(i for r in got for i in r["ids"]) == total
    for none, i, ids in want:
        pieces = by_doc[(None if none else i, len(ids))]
        assert all(piece == ids[start : start + len(piece)] or len(pieces) > -(-len(ids) // 64) for start, piece in pieces)
    sequences: dict = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 64
    assert packing.pack(packing.pieces(empty, path, 0, True)).count() == 0


def test_token_files(spark, docs, rows, empty):
    path = public_tokenizers.path("word_bpe_49k.json")
    folder = shared_dir(spark, "t")
    token_files.write(docs, folder, path, 1, False)
    got = sorted(token_files.read(spark, folder).collect(), key=lambda r: r["start"])
    at = 0
    for r in got:
        assert r["start"] == at and r["n_tokens"] == len(r["ids"])
        at += r["n_tokens"]
    ids = [r["doc_id"] for r in got]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    want = [(i, x + [1]) for (i, _), x in zip(rows, library("word_bpe_49k.json", [t for _, t in rows]))]
    assert sorted(map(str, want)) == sorted(str((r["doc_id"], r["ids"])) for r in got)
    digest = {(r["start"], r["ids_crc32"]) for r in token_files.digest(token_files.read(spark, folder)).collect()}
    assert digest == {(r["start"], zlib.crc32(np.array(r["ids"], "<u4").tobytes())) for r in got}
    assert {r["doc_id"] for r in token_files.lookup(spark, folder, [3, 30]).collect()} == {3, 30}
    nothing = shared_dir(spark, "t")
    token_files.write(empty, nothing, path, 1, False)
    assert token_files.read(spark, nothing).count() == 0


def greedy(vocabulary, word):
    count, at = 0, 0
    while at < len(word):
        end = next((e for e in range(len(word), at, -1) if word[at:e] in vocabulary), 0)
        if not end:
            return -1
        at, count = end, count + 1
    return count


@settings(max_examples=80, deadline=None)
@given(st.sets(st.text("abc", min_size=1, max_size=5), max_size=12), st.lists(st.text("abc", min_size=1, max_size=12), min_size=1, max_size=20))
def test_automaton(vocabulary, texts):
    vocabulary, texts = {v.encode() for v in vocabulary}, [t.encode() for t in texts]
    bounds = np.append(0, np.cumsum([len(t) for t in texts]))
    got = wordpiece_counts.Automaton(vocabulary).counts(np.frombuffer(b"".join(texts), np.uint8), bounds)
    assert got.tolist() == [greedy(vocabulary, t) for t in texts]


def test_token_counts(docs, rows, empty):
    pieces = wordpiece_counts.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    vocabulary = set(pieces)
    got = wordpiece_counts.token_counts(docs, pieces).collect()
    want = []
    for i, t in rows:
        found = [greedy(vocabulary, w.encode()) for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
        want.append((i, len(found), sum(map(abs, found)), sum(f < 0 for f in found)))
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got)
    assert wordpiece_counts.token_counts(empty, pieces[:300]).count() == 0
