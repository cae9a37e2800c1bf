"""The registered queries and the pipeline, row by row, on a folder of small tables."""

import hashlib
import math
import random
import zlib
from collections import Counter

import corpus_pipeline
import duckdb
import numpy as np
import public_tokenizers
import pytest
from test_matching import contaminated, linked, removed
from test_models import words_of
from test_tokens import greedy, library

from kveil.llm import ngram_lm, queries, quality_rules, token_files, wordpiece_counts
from kveil.session import shared_dir


def made_corpus():
    """Prose that passes the quality rules, with copies, near copies, shared passages, benchmark passages and rejects."""
    rnd = random.Random(21)
    common = "the and of to in is that for it with as was on be at by this have from or one had not but what all were when we there can an your which their".split()
    vocabulary = ["".join(rnd.choice("aeioulnrstmdk") for _ in range(rnd.randint(3, 8))) for _ in range(500)]

    def prose(n):
        out = []
        while n > 0:
            size = min(n, rnd.randint(7, 14))
            out.append(" ".join(rnd.choice(common if rnd.random() < 0.4 else vocabulary) for _ in range(size)).capitalize() + ".")
            n -= size
        return "\n".join(out)

    benchmark = [(i * 3, prose(rnd.choice([5, 14, 30])).replace("\n", " ")) for i in range(6)]
    passage = prose(40)
    rows = [(i, prose(rnd.randint(60, 160))) for i in range(30)]
    rows += [(40 + i, rows[3][1]) for i in range(4)]
    for i in range(5):
        words = rows[7][1].split(" ")
        words[rnd.randrange(len(words))] = "altered"
        rows.append((50 + i, " ".join(words)))
    rows += [(60 + i, f"{prose(70)}\n{passage}\n{prose(50)}") for i in range(4)]
    rows += [(70 + i, f"{prose(60)}\n{benchmark[i][1]}\n{prose(40)}") for i in range(6)]
    rows += [(80, "too short"), (81, None), (82, ""), (83, "same words here " * 60), (84, "é" * 30 + rows[0][1][:200]), (85, prose(1500))]
    rnd.shuffle(rows)
    return rows, benchmark


@pytest.fixture(scope="module")
def corpus():
    return made_corpus()


@pytest.fixture(scope="module")
def folder(spark, corpus, tmp_path_factory):
    rows, benchmark = corpus
    path = str(tmp_path_factory.mktemp("tables"))
    data = [(i, t, "en", "made", len(t or "")) for i, t in rows]
    spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(path + "/documents.parquet")
    spark.createDataFrame(benchmark, "item_id long, text string").write.parquet(path + "/benchmark.parquet")
    return path


def rows_of(df):
    return sorted(str(tuple(r)) for r in df.collect())


def test_op1(spark, corpus, folder):
    assert rows_of(queries.op1_suffix_dedup(spark, folder)) == sorted(map(str, removed(corpus[0])))


def test_op2(spark, corpus, folder):
    got = queries.op2_packing(spark, folder).collect()
    ids = {i: np.array([*x, 0], "<u4") for (i, _), x in zip(corpus[0], library("byte_bpe_50k.json", [t for _, t in corpus[0]]))}
    pieces, fill = {}, {}
    for r in got:
        pieces.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
        fill.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        assert r["doc_tokens"] == len(ids[r["doc_id"]])
        assert r["ids_crc32"] == zlib.crc32(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]].tobytes())
    assert set(pieces) == set(ids)
    for cuts, total in [(p, len(ids[i])) for i, p in pieces.items()] + [(s, None) for s in fill.values()]:
        at = 0
        for start, length in sorted(cuts):
            assert start == at
            at += length
        assert at == total if total is not None else at <= 1024
    assert len(fill) <= 1.1 * sum(map(len, ids.values())) / 1024 + 1


def test_op3(spark, corpus, folder):
    assert rows_of(queries.op3_inverted_index(spark, folder)) == sorted(map(str, contaminated(*corpus)))


def test_op4(spark, corpus, folder):
    vocabulary, want = set(wordpiece_counts.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))), []
    for i, t in corpus[0]:
        found = [greedy(vocabulary, w.encode()) for w in (t or "").split()]
        want.append((i, len(found), sum(map(abs, found)), sum(f < 0 for f in found)))
    assert rows_of(queries.op4_wordpiece_counts(spark, folder)) == sorted(map(str, want))


def test_op7_scores(spark, corpus, folder):
    """Bigrams with absolute discounts, counted anew; stored logarithms are rounded down by 1/5000 at most."""
    count, pairs, heads = Counter(), Counter(), Counter()
    for i, t in corpus[0]:
        if zlib.crc32(str(i).encode()) % 5 != 1:
            tokens = [*words_of(t), None]
            count.update(tokens)
            pairs.update(zip(["<s>", *tokens], tokens))
            heads.update(["<s>", *tokens[:-1]])
    n = Counter(pairs.values())
    y = n[1] / (n[1] + 2 * n[2])
    raw = {k: k - (k + 1) * y * n[k + 1] / n[k] if n[k] else 0.75 for k in (1, 2, 3)}
    low_high = {1: 0.98, 2: 1.9, 3: 2.8}
    discount = {k: min(max(raw[k], 0.05), low_high[k]) for k in raw}
    total, distinct, lost = sum(count.values()), len(count), Counter()
    for (h, _), c in pairs.items():
        lost[h] += min(discount[min(c, 3)], c)
    got = {r["doc_id"]: r for r in queries.op7_ngram_lm(spark, folder).collect()}
    for i, t in corpus[0]:
        tokens, score = [*words_of(t), None], 0.0
        for h, w in zip(["<s>", *tokens], tokens):
            p = (count[w] + 0.5) / (total + 0.5 * (distinct + 1))
            if heads[h]:
                c = pairs[h, w]
                p = (max(c - discount[min(c, 3)], 0) / heads[h] if c else 0) + lost[h] / heads[h] * p
            score += math.log10(p)
        assert got[i]["train_tokens"] == total and got[i]["n_tokens"] == len(tokens)
        assert score - len(tokens) / 2500 <= got[i]["score"] <= score + 1e-6


def test_a_stored_model_scores_alike_in_any_session(spark, folder):
    docs, before, got = spark.read.parquet(folder + "/documents.parquet"), spark.conf.get("spark.sql.shuffle.partitions"), []
    model = ngram_lm.fit(docs, shared_dir(spark, "t"))
    try:
        for n in (1, 4, 13):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            got.append(sorted((r["doc_id"], r["n_known"], round(r["score"], 6)) for r in ngram_lm.score(docs, model).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got[0] == got[1] == got[2]


def test_op10(spark, corpus, folder):
    at, want = 0, []
    for (i, _), ids in sorted(zip(corpus[0], library("word_bpe_49k.json", [t for _, t in corpus[0]]))):
        ids = np.array([*ids, 1], "<u4")
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert rows_of(queries.op10_token_files(spark, folder)) == sorted(map(str, want))


def test_pipeline_against_brute_force(spark, corpus, folder):
    rows, benchmark = corpus
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    passed = {r[0] for r in con.execute(f"SELECT doc_id FROM ({quality_rules.oracle_sql()}) WHERE kept").fetchall()}
    left = [(i, t) for i, t in rows if i in passed]
    assert 40 < len(left) < len(rows)
    left = [(i, t) for (i, t), (_, _, root) in zip(left, linked(left, 5, 80)) if i == root]
    assert 7 in dict(left) and not {50, 51, 52, 53, 54} & set(dict(left))
    kept = {}
    for i, n, gone, _, digest in removed(left):
        kept[i] = (n - gone, digest)
    docs = spark.read.parquet(folder + "/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, folder).checkpoint() if name != "suffix_dedup" else stage(spark, docs, folder)
    cut = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert {i: (len(t.encode()), hashlib.sha256(t.encode()).hexdigest()) for i, t in cut} == kept
    assert any(kept[i][0] < len(t.encode()) for i, t in left)
    clean = {i: t for (i, t), found in zip(cut, contaminated(cut, benchmark)) if not found[5]}
    assert 0 < len(clean) < len(cut)
    tokens = dict(zip(clean, map(len, library("byte_bpe_50k.json", list(clean.values())))))
    total = Counter()
    for r in corpus_pipeline.run(spark, folder).collect():
        total[r["doc_id"]] += r["length"]
    assert total == {i: n + 1 for i, n in tokens.items()}


def test_bloom_filters_skip_files_and_stripes(spark, folder):
    """An id inside the range of the files, but in none, is excluded without reading its rows."""
    docs = spark.range(20_000).selectExpr("id * 10 AS doc_id", "'a b c' AS text")
    out = shared_dir(spark, "t")
    token_files.write(docs, out, public_tokenizers.path("word_bpe_49k.json"), 1, False)

    def rows_read(i):
        found = token_files.lookup(spark, out, [i])
        found.collect()
        plan = found._jdf.queryExecution().executedPlan()
        scans = plan.collectLeaves()
        return sum(scans.apply(k).metrics().apply("numOutputRows").value() for k in range(scans.size()) if "orc" in scans.apply(k).toString()), found.count()

    read, found = rows_read(100_000)
    assert found == 1 and read < 20_000 / 2
    read, found = rows_read(100_001)
    assert found == 0 and read == 0
