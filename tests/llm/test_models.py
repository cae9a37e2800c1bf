"""Language model, classifier and pipeline."""

import math
import re
import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
from conftest import FOLDER
from oracle_check import compare, connect

from kveil.llm import classifier, elias_fano, ngram_lm, queries
from kveil.session import shared_dir

W = re.compile(r"[^\x20\x09-\x0D]+")


def words_of(text):
    return W.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def test_base_scores(spark, docs, rows):
    count = Counter()
    for i, t in rows:
        if i is not None and zlib.crc32(str(i).encode()) % 5 != 1:
            count.update([*words_of(t), None])
    total, distinct = sum(count.values()), len(count)
    want = Counter()
    for i, t in rows:
        tokens = [*words_of(t), None]
        base = sum(math.log10((count[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in tokens)
        held = i is None or zlib.crc32(str(i).encode()) % 5 == 1
        want[i, held, len(tokens), sum(count[w] > 0 for w in tokens), total, round(base, 6)] += 1
    got = ngram_lm.score(docs, ngram_lm.fit(docs, shared_dir(spark, "t"))).collect()
    assert Counter((*r[:5], round(r["base_score"], 6)) for r in got) == want
    assert all(r["score"] <= 0 for r in got)


def test_model_is_a_distribution():
    """Over all known words, the end and one unknown word the probabilities of a context sum to 1, quantisation aside."""
    pairs = Counter({(1, 2): 5, (1, 3): 1, (1, 4): 1, (2, 1): 3, (2, 3): 2, (3, 1): 1, (4, 2): 1})
    context, successor = (np.repeat(np.array([p[k] for p in pairs], np.uint64), list(pairs.values())) for k in range(2))
    levels = ngram_lm.build_levels(context, successor, np.ones(len(context), np.uint32))
    trie = ngram_lm.Trie(levels)
    words = np.array([1, 2, 3, 4, 5], np.uint64)
    weight = np.array([5, 7, 4, 1, 0]) + 0.5
    unigram = weight / weight.sum()
    for c, n in ((1, 7), (2, 5), (3, 1), (9, 0)):
        total, backoff, code = trie.query(np.array([c], np.uint64), np.array([5]), words)
        assert total[0] == n
        p = ngram_lm.restore(code) + ngram_lm.restore(backoff)[0] * unigram
        assert 0.998 < p.sum() <= 1 + 1e-9
        assert [x > 0 for x in code] == [(c, w) in pairs for w in range(1, 6)]


def test_query_decodes_only_the_range_of_its_context(monkeypatch):
    rng = np.random.default_rng(1)
    context = np.sort(rng.integers(0, 2000, 200_000)).astype(np.uint64)
    context[:60_000] = 5  # a context over many blocks
    successor = rng.integers(0, 50_000, len(context)).astype(np.uint64)
    levels = ngram_lm.build_levels(context, successor, np.ones(len(context), np.uint32))
    trie, n, seen, decode = ngram_lm.Trie(levels), len(levels["codes"]), [], elias_fano.decode
    pairs, totals = Counter(zip(context.tolist(), successor.tolist())), Counter(context.tolist())
    every = decode(trie._coded("successors"), 0, n)
    place = dict(zip(every.tolist(), range(n)))
    heads, vocabulary = np.unique(context), np.unique(successor)

    def watched(coded, begin, end):
        if len(coded["low"]) == n:
            seen.append(end - begin)
        return decode(coded, begin, end)

    monkeypatch.setattr(elias_fano, "decode", watched)
    for c in (5, int(context[100_000]), int(context[-1]), 1_000_000):
        mine = successor[context == c][:: 1 if c != 5 else 20_000]
        words = np.concatenate([mine, rng.integers(0, 60_000, 3).astype(np.uint64)])
        seen.clear()
        total, _, code = trie.query(np.array([c], np.uint64), np.array([len(words)]), words)
        assert total[0] == totals[c]
        for w, x in zip(words.tolist(), code):
            key = int(np.searchsorted(heads, c)) * len(vocabulary) + int(np.searchsorted(vocabulary, w))
            assert x == (levels["codes"][place[key]] if (c, w) in pairs else 0)
        assert sum(seen) <= 6 * elias_fano.SAMPLE < n / 4


def test_model_beats_base(spark):
    docs = spark.read.parquet(FOLDER + "/documents.parquet")
    got = ngram_lm.score(docs, ngram_lm.fit(docs, shared_dir(spark, "t"))).where("held_out").groupBy().sum("score", "base_score").first()
    assert got[0] > got[1]


def test_scores_do_not_depend_on_partitions(spark):
    docs = spark.read.parquet(FOLDER + "/documents.parquet")
    before, got = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for n in (1, 13):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            rows = ngram_lm.score(docs, ngram_lm.fit(docs, shared_dir(spark, "t"))).collect()
            got.append(sorted((r["doc_id"], r["n_known"], r["base_score"], r["score"]) for r in rows))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    # Sums over a text run in group order, which leaves rounding in the last digits.
    assert [r[:2] for r in got[0]] == [r[:2] for r in got[1]]
    assert np.abs(np.array(got[0])[:, 2:] - np.array(got[1])[:, 2:]).max() < 1e-6


def test_lm_edges(spark, empty):
    model = ngram_lm.fit(empty, shared_dir(spark, "t"))
    assert ngram_lm.score(empty, model).count() == 0
    row = ngram_lm.score(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), model).first()
    assert (row["n_tokens"], row["n_known"], row["train_tokens"], row["base_score"]) == (3, 0, 0, 0.0)


def test_classifier(spark, docs, rows, empty):
    folder = FOLDER.replace("0.001", "0.1")
    texts, labels = spark.read.parquet(folder + "/documents.parquet"), spark.read.parquet(folder + "/labels.parquet")
    model = classifier.fit(texts, labels)
    scored = classifier.score(texts, model).join(labels, "doc_id").where("held_out").toPandas()
    assert (scored.predicted == scored.quality).mean() > 0.97
    odd = classifier.score(docs, model).collect()
    assert len(odd) == len(rows) and all(0 <= r["score"] <= 1 for r in odd)
    assert all(r["held_out"] == (r["doc_id"] is None or zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in odd)
    assert classifier.score(empty, model).count() == 0
    none = classifier.fit(docs, spark.createDataFrame([(1, None), (None, 1)], "doc_id long, quality int"))
    assert {r["score"] for r in classifier.score(docs, none).collect()} == {0.5}


def test_pipeline(spark, docs, empty):
    table = spark.read.parquet(FOLDER + "/documents.parquet")
    at = table
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, at, FOLDER).checkpoint()
        assert kept.columns == table.columns, name
        assert kept.count() <= at.count() and kept.select("doc_id").distinct().count() == kept.count()
        at = kept
    packed = corpus_pipeline.STAGES[-1][1](spark, at, FOLDER)
    assert {r["doc_id"] for r in packed.select("doc_id").collect()} == {r["doc_id"] for r in at.select("doc_id").collect()}
    assert corpus_pipeline.run(spark, FOLDER).groupBy().sum("length").first() == packed.groupBy().sum("length").first()
    for source in (docs, empty):
        at = source
        for _, stage in corpus_pipeline.STAGES:
            at = stage(spark, at, FOLDER)
        at.count()


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, name):
    if name in queries.ORACLES:
        assert compare(spark, connect(FOLDER), queries.QUERIES[name], queries.ORACLES[name], FOLDER) is None
    else:
        assert queries.QUERIES[name](spark, FOLDER).count() > 0
