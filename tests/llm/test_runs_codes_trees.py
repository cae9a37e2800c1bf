"""Periodic runs, vector codes and reply trees against brute force."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from conftest import FOLDER
from hypothesis import given, settings
from hypothesis import strategies as st
from oracle_check import compare, connect

from kveil.llm import periodic_runs, queries, reply_trees, vector_codes
from kveil.session import reliable_checkpoint

W = re.compile(r"[^\x20\x09-\x0D]+")


# ---------------------------------------------------------------- periodic runs


def all_runs(words, shortest=12, repeats=2):
    """Every lag at every place."""
    out = {}
    for p in range(1, len(words) // repeats + 1):
        i = 0
        while i + p < len(words):
            if words[i] != words[i + p]:
                i += 1
                continue
            j = i
            while j + p < len(words) and words[j] == words[j + p]:
                j += 1
            if j + p - i >= max(shortest, repeats * p):
                out.setdefault((i, j + p), p)
            i = j
    return sorted((s, e - s, p) for (s, e), p in out.items())


def left_over(words, runs):
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    return [w for i, w in enumerate(words) if i not in gone]


def texts_with_runs():
    rnd, made = random.Random(3), []
    for _ in range(400):
        words = [rnd.randrange(rnd.choice([1, 2, 3, 40])) for _ in range(rnd.randint(0, 80))]
        for _ in range(rnd.randint(0, 3) if words else 0):
            a = rnd.randrange(len(words))
            p, end = 1 + rnd.randrange(max(1, (len(words) - a) // 2)), rnd.randint(a, len(words))
            for i in range(a, end):
                words[i] = words[a + (i - a) % p]
        made.append(words)
    return made


@pytest.mark.parametrize("shortest, repeats", [(12, 2), (6, 3), (2, 2)])
def test_runs_of_many_texts(shortest, repeats):
    made = texts_with_runs()
    ptr = np.append(0, np.cumsum([len(w) for w in made]))
    got = periodic_runs.runs_of(np.array(sum(made, []), np.int64), ptr, shortest, repeats).tolist()
    want = [[s + o, s + n + o, p] for w, o in zip(made, ptr.tolist()) for s, n, p in sorted(all_runs(w, shortest, repeats), key=lambda r: (r[0], r[2]))]
    assert got == want


def test_frequency_splitting_goes_on_to_stability():
    rnd = random.Random(5)
    words = [rnd.randrange(60) for _ in range(200)] + list(range(100, 107)) * 3 + [rnd.randrange(60) for _ in range(200)]
    start, size = periodic_runs.split_by_frequency(np.array(words), np.array([0, len(words)]), 12, 2)
    for s, n in zip(start.tolist(), size.tolist()):
        assert n >= 12 and min(Counter(words[s : s + n]).values()) >= 2
    assert any(s <= 200 and s + n >= 221 for s, n in zip(start.tolist(), size.tolist()))


def test_a_deceiving_hash_is_noticed():
    """Thue-Morse words have equal polynomial hashes modulo 2^64 from 1024 words on."""
    words = np.array([bin(i).count("1") % 2 for i in range(2048)])
    words = np.concatenate([words, 1 - words, words, words, 1 - words])
    got = periodic_runs.runs_of(words, np.array([0, len(words)])).tolist()
    assert got == [[s, s + n, p] for s, n, p in sorted(all_runs(words.tolist()), key=lambda r: (r[0], r[2]))]


def run_row(doc_id, words):
    runs = sorted(all_runs(words), key=lambda r: (r[0], r[2]))
    top = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    lines = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
    kept = " ".join(left_over(words, runs))
    return (
        doc_id, len(runs), *(top or (None,) * 3), top and 1000 * top[1] // top[2], hashlib.sha256(lines.encode()).hexdigest(),
        hashlib.sha256(kept.encode()).hexdigest(),
    )


def test_runs_on_odd_rows(spark, docs, rows, empty):
    got = Counter(tuple(r) for r in periodic_runs.digest(periodic_runs.find(docs)).collect())
    assert got == Counter(run_row(i, W.findall(t or "")) for i, t in rows)
    assert any(r["n_runs"] for r in periodic_runs.digest(periodic_runs.find(docs)).collect())
    assert periodic_runs.find(empty).count() == 0


def test_op11_query(spark):
    def repeated(doc_id, text):
        words, h = W.findall(text or ""), zlib.crc32(str(doc_id).encode())
        n, g = len(words), h // 10
        if h % 10 or not n:
            return words
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]

    table = [r for r in spark.read.parquet(FOLDER + "/documents.parquet").select("doc_id", "text").collect() if len(W.findall(r["text"] or "")) < 3000]
    want = {run_row(r["doc_id"], repeated(*r)) for r in table}
    got = {tuple(r) for r in queries.op11_periodic_runs(spark, FOLDER).collect()}
    assert want <= got and any(r[1] for r in want)


# ---------------------------------------------------------------- vector codes


def plain_codes(vectors, parts, entries, rounds):
    x = np.floor(4096 * np.array(vectors, np.float64)).astype(np.int64)
    width = x.shape[1] // parts
    cut = x.reshape(len(x), parts, width)
    books = cut[:entries].transpose(1, 0, 2).copy()
    for k in range(rounds + 1):
        far = ((cut[:, :, None, :] - books[None]) ** 2).sum(axis=3)
        code = far.argmin(axis=2)
        if k < rounds:
            for p, e in itertools.product(range(parts), range(books.shape[1])):
                own = cut[code[:, p] == e, p]
                if len(own):
                    books[p, e] = own.sum(axis=0) // len(own)
    return code, far.min(axis=2).sum(axis=1), books


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**32 - 1), st.integers(1, 90), st.integers(1, 5), st.sampled_from([2, 1000, vector_codes.LARGEST]))
def test_masks_find_the_nearest(seed, count, width, largest):
    rng = np.random.default_rng(seed)
    entries, x = rng.integers(-largest, largest + 1, (count, width)), rng.integers(-largest, largest + 1, (50, width))
    x[:10] = entries[rng.integers(0, count, 10)]
    far = ((x[:, None] - entries[None]) ** 2).sum(axis=2)
    code, best = vector_codes.Masks(entries).nearest(x, rng.integers(0, count, 50))
    assert (best == far.min(axis=1)).all() and (code == far.argmin(axis=1)).all()


def test_masks_leave_few_candidates():
    rng = np.random.default_rng(2)
    entries = rng.integers(0, 1000, (256, 8))
    x = entries[rng.integers(0, 256, 500)] + rng.integers(-3, 4, (500, 8))
    mask = vector_codes.Masks(entries).candidates(x, np.full(500, 30))
    count = sum(int(v).bit_count() for v in mask.reshape(-1))
    assert 500 <= count < 1000


@pytest.mark.parametrize("parts, entries, rounds", [(8, 16, 6), (2, 70, 3), (1, 3, 0)])
def test_codes_against_all_distances(spark, parts, entries, rounds):
    rng = np.random.default_rng(4)
    vectors = np.round(rng.normal(size=(300, 16)), 1).astype(np.float32)
    vectors[100:180] = vectors[7]  # a hot vector
    data = [(i, v.tolist(), None if i % 7 == 0 else i % 3) for i, v in enumerate(vectors)]
    random.Random(1).shuffle(data)
    table = spark.createDataFrame(data, "vec_id long, embedding array<float>, label int").repartition(5)
    code, error, books = plain_codes(vectors, parts, entries, rounds)
    total = Counter()
    for i, _, label in data:
        total[label] += int(error[i])
    checksum = hashlib.sha256(",".join(str(v) for v in books.reshape(-1).tolist()).encode()).hexdigest()
    want = {(i, label, "".join(f"{c:02x}" for c in code[i]), int(error[i]), total[label], checksum) for i, _, label in data}
    assert {tuple(r) for r in vector_codes.compress(table, parts, entries, rounds).collect()} == want


def test_codes_on_odd_rows(spark):
    nan, inf = math.nan, math.inf
    data = [
        (1, [0.5, 1.0]), (2, None), (3, [nan, 1.0]), (4, [1.0, None]), (5, [inf, 0.0]), (6, [1.0, 2.0, 3.0]), (7, [1e30, 0.0]), (7, [0.5, 1.0]),
        (None, [0.25, 0.0]), (8, []), (9, [0.5, 1.0]),
    ]
    names = "part int, entry int, members int, x int, total int"
    table = spark.createDataFrame([(i, v, None, 0, 0, 0, 0, 0) for i, v in data], f"vec_id long, embedding array<float>, label int, {names}")
    got = sorted(((r["vec_id"], r["code"], r["error"]) for r in vector_codes.compress(table, parts=2, entries=4).collect()), key=str)
    assert got == sorted([
        (1, "0000", 0), (6, None, None), (7, None, None), (7, "0000", 0), (8, None, None), (9, "0000", 0), (None, "0303", 0),
    ], key=str)
    assert vector_codes.compress(table.limit(0)).count() == 0
    with pytest.raises(ValueError):
        vector_codes.compress(table, parts=8)


# ---------------------------------------------------------------- reply trees


@given(st.text(alphabet="\\#</turn>: ab\n"), st.text(alphabet="\\#</turn>: ab\n"))
@settings(max_examples=300, deadline=None)
def test_template_is_reversible(role, text):
    one = reply_trees.OPEN + reply_trees.escape(role, role=True) + reply_trees.MIDDLE + reply_trees.escape(text) + reply_trees.CLOSE
    for r, t, a, b in reply_trees.parse(one + one):
        assert (r, t) == (role, text) and reply_trees.unescape((one + one)[a:b]) == text


def plain_branches(rows, top):
    """Per tree the best (rank, leaf, path) by walking up from every leaf."""
    trees = {}
    for tree, message, parent, _, _, score in rows:
        nodes = trees.setdefault(tree, {})
        old = nodes.get(message, (None, None))
        parents = [p for p in (old[0], parent) if p is not None]
        scores = [s for s in (old[1], score) if s is not None]
        nodes[message] = (min(parents, default=None), max(scores, default=None))
    out = {}
    for tree, nodes in trees.items():
        up = {m: p if p in nodes and p is not None and p != m else None for m, (p, _) in nodes.items()}
        found = []
        for leaf in set(nodes) - {p for p in up.values() if p is not None}:
            path, at = [], leaf
            while at is not None and len(path) <= len(nodes):
                path.append(at)
                at = up[at]
            if leaf is None:
                path = [None]
            if at is not None and leaf is not None:
                continue  # a circle
            found.append((-sum(nodes[m][1] or 0 for m in path), leaf is not None, leaf or 0, leaf, path[::-1]))
        for rank, (_, _, _, leaf, path) in enumerate(sorted(found, key=lambda f: f[:3])[:top], 1):
            out[tree, leaf] = (rank, path)
    return out


def made_trees():
    rnd, rows = random.Random(8), []
    for tree in range(25):
        n = rnd.choice([1, 2, 5, 30])
        for m in range(n):
            parent = rnd.randrange(m) if m and rnd.random() < 0.95 else None
            rows.append((tree, m, parent, rnd.choice(["user", "assistant", None]), f"{tree}-{m} \\### x: </turn>", rnd.choice([None, 1.0, 2.0, -1.0])))
    rows += [(50, m, m - 1, "assistant", f"m{m}", 0.0) for m in range(200)]  # a hot, deep tree
    rows += [(51, 0, None, "user", "a", 0.0), (51, 1, 0, "assistant", "b", 0.0), (51, 1, 0, "assistant", "b", 0.0), (51, 1, 0, "assistant", "a", 0.0)]
    rows += [(52, 1, 2, "user", "circle", 0.0), (52, 2, 1, "user", "circle", 0.0), (52, 3, 2, "user", "behind it", 0.0)]
    rows += [(53, 1, 99, "user", "absent parent", None), (53, 4, 4, "user", "own parent", None)]
    rows += [(None, 1, None, "user", None, None), (None, 2, 1, "assistant", "", None), (54, None, None, "user", "no id", None)]
    return rows


@pytest.mark.parametrize("top, part_chars", [(1, 1 << 22), (3, 1 << 22), (2, 30)])
def test_branches_against_walking(spark, top, part_chars):
    rows = made_trees()
    random.Random(2).shuffle(rows)
    table = spark.createDataFrame(
        [(*r, 0, 0, 0) for r in rows], "tree_id long, message_id long, parent_id long, role string, text string, score double, far int, rank int, depth int"
    ).repartition(6)
    got = {}
    for r in sorted(reply_trees.format_branches(table, top=top, part_chars=part_chars).collect(), key=lambda r: (r["first_depth"], r["part"])):
        rank, turns, loss, whole = got.setdefault((r["tree_id"], r["leaf_id"]), (r["rank"], [], [], []))
        turns += [t[:2] for t in reply_trees.parse(r["formatted"])]
        loss += [reply_trees.unescape(r["formatted"][s["start"] : s["stop"]]) for s in r["loss"]]
        whole.append(r["whole"])
        assert r["n_turns"] == len(list(reply_trees.parse(r["formatted"])))
    said = {}
    for tree, message, _, role, text, _ in rows:
        said.setdefault((tree, message), []).append((role or "", text or ""))
    want = {key: (rank, [t for m in path for t in sorted(said[key[0], m])]) for key, (rank, path) in plain_branches(rows, top).items()}
    assert {k: v[:2] for k, v in got.items()} == want
    assert all(v[2] == [t for role, t in v[1] if role == "assistant"] for v in got.values())
    assert all(v[3] == [True] or not any(v[3]) for v in got.values())
    assert top != 2 or any(len(v[3]) > 1 for v in got.values())


def test_steps_are_stored_in_few_partitions(spark, monkeypatch):
    """Each step had the partitions of the one before and as many more, however few its rows."""
    conf = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    old = {k: spark.conf.get(k) for k in conf}
    table = spark.createDataFrame([(t, m, m - 1 if m else None, 1.0) for t in range(3) for m in range(20)], "tree_id long, message_id long, parent_id long, score double")
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        steps = reply_trees.jumps(table)
        most = max(spark.sparkContext.defaultParallelism, 1)
        assert len(steps) == 6 and all(s.rdd.getNumPartitions() <= most and s.count() == 60 for s in steps)
        # More rows are still more partitions.
        monkeypatch.setattr(reply_trees, "STEP_ROWS", 2)
        assert all(s.rdd.getNumPartitions() == 30 for s in reply_trees.jumps(table))
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_read_back_joins_parts(spark):
    rows = [(tree, m, m - 1 if m else None, "assistant" if m % 2 else "user", f"text {m} of {tree}", 0.0) for tree in range(5) for m in range(40)]
    table = spark.createDataFrame(rows, "tree_id long, message_id long, parent_id long, role string, text string, score double")
    got = [sorted(tuple(r) for r in reply_trees.read_back(reliable_checkpoint(reply_trees.format_branches(table, part_chars=n))).collect()) for n in (50, 1 << 20)]
    assert got[0] == got[1] and len(got[0]) == 5


def test_chains(spark):
    rows = [(1, 5, "user", "b"), (1, 2, "user", "a"), (1, 9000, "user", "c"), (1, 9000, "user", "c"), (1, None, "user", "z"), (None, 0, "user", "n")]
    _, links = reply_trees.chains(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    low = reply_trees.FIRST
    assert {tuple(r)[:3] for r in links.collect()} == {(1, low, None), (1, 2, low), (1, 5, 2), (1, 9000, 5), (None, 0, None)}


def test_no_conversations(spark):
    none = spark.createDataFrame([], "tree_id long, message_id long, parent_id long, role string, text string, score double")
    assert reply_trees.read_back(reliable_checkpoint(reply_trees.format_branches(none))).count() == 0


@pytest.mark.parametrize("name", ["op12_vector_codes", "op13_reply_trees"])
def test_queries_equal_sql(spark, name):
    assert compare(spark, connect(FOLDER), queries.QUERIES[name], queries.ORACLES[name], FOLDER) is None
