"""Suffix dedup, inverted index and Jaccard join against brute force."""

import hashlib
import re

import numpy as np
import pytest

from kveil.llm import elias_fano, inverted_index, jaccard_join, suffix_dedup
from kveil.llm.components import components
from kveil.session import shared_dir

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
LETTERS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def removed(rows, length=50):
    first: dict = {}
    order = lambda i: (i is None, i or 0)
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - length + 1):
            w = b[k : k + length]
            if w not in first or order(i) < order(first[w]):
                first[w] = i
    for i, t in rows:
        b = (t or "").encode()
        gone = [False] * len(b)
        for k in range(len(b) - length + 1):
            if order(first[b[k : k + length]]) < order(i):
                gone[k : k + length] = [True] * length
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        yield i, len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest()


def test_suffix_dedup(docs, rows, empty):
    got = suffix_dedup.dedup(docs).drop("tkey").collect()
    assert sorted(map(str, removed(rows))) == sorted(str(tuple(r)) for r in got)
    assert suffix_dedup.dedup(empty).count() == 0
    with pytest.raises(ValueError):
        suffix_dedup.dedup(docs, length=20)


def test_keep_first(docs, rows, empty):
    got = suffix_dedup.keep_first(docs)
    assert got.columns == docs.columns and got.count() == len(rows)
    texts = {r["doc_id"]: r["text"] for r in got.collect()}
    assert texts[30] and texts[31] == "" and texts[60] == "" and texts[20 - 1] == dict(rows)[19]
    assert suffix_dedup.keep_first(empty).columns == empty.columns


def test_suffix_buckets():
    strings = [b"abcabcabcabcabcabcabc", b"xabcabcabcabcabcabcabcabc", b"abcabcabcabcabcabcab!"]
    data, bounds = np.frombuffer(b"".join(strings), np.uint8), np.append(0, np.cumsum([len(s) for s in strings]))
    bucket = suffix_dedup.suffix_buckets(data, bounds, 18)
    seen: dict = {}
    for s, a in zip(strings, bounds):
        for k in range(len(s)):
            head = s[k : k + 18]
            assert (bucket[a + k] >= 0) == (len(head) == 18)
            if len(head) == 18:
                assert seen.setdefault(head, bucket[a + k]) == bucket[a + k]
    assert [seen[h] for h in sorted(seen)] == sorted(seen.values()) and len(set(seen.values())) == len(seen)


def contaminated(rows, items, size=10):
    windows: dict = {}
    for item, text in items:
        w = LETTERS.findall(lower(text))
        n = min(size, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add(item)
    for i, t in rows:
        w, hit, found = LETTERS.findall(lower(t)), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    found |= windows[tuple(w[k : k + n])]
                    hit.update(range(k, k + n))
        names = sorted(str(x) for x in found if x is not None)
        yield i, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)


def test_index(spark, docs, rows, empty):
    base = dict(rows)[30]
    texts = [" ".join(base.split()[20:34]).upper(), "two words", None, "", dict(rows)[3], "same line here " * 5, "日本語 don"]
    items = [(i * 7, t) for i, t in enumerate(texts)] + [(0, texts[0]), (None, " ".join(dict(rows)[5].split()[:11]))]
    table = spark.createDataFrame(items, "item_id long, text string")
    index = inverted_index.build(docs, shared_dir(spark, "t"))
    want = sorted(map(str, contaminated(rows, items)))
    for size in (1 << 20, 40):
        got = inverted_index.summarise(inverted_index.search(index, table, block_bytes=size)).collect()
        assert sorted(str(tuple(r)) for r in got) == want
    none = inverted_index.summarise(inverted_index.search(index, table.limit(0)))
    assert none.count() == len(rows) and none.where("contaminated").count() == 0
    clean = inverted_index.keep_clean(docs, table, shared_dir(spark, "t"))
    assert clean.columns == docs.columns and clean.count() == sum(s.endswith("False)") for s in want)
    bare = inverted_index.build(empty, shared_dir(spark, "t"))
    assert inverted_index.search(bare, table).count() == 0


def test_index_in_small_lots(spark, docs, monkeypatch):
    """Results do not depend on how many postings are held at once; a quoted line that repeats is one window for all its items."""
    line = "the same line of ten words stands here again and again"
    items = [(i, f"{line} {line}") for i in range(20)] + [(30, "other words " + line)]
    table = spark.createDataFrame(items, "item_id long, text string")
    texts = spark.createDataFrame([(1, f"{line}\n" * 300), (2, "nothing of that"), (3, line)], "doc_id long, text string")
    got = []
    for lot in (7, 1 << 19):
        monkeypatch.setattr(inverted_index, "POSTINGS", lot)
        index = inverted_index.Segment(inverted_index.build(texts.coalesce(1), shared_dir(spark, "t")).first().asDict())
        queries = inverted_index.Queries([i for i, _ in items], [t for _, t in items], 10)
        windows, ptr, owners = queries.by_length[0]
        assert len(windows) == len(set(map(tuple, windows.tolist()))) and ptr[-1] == len(owners) < 20 * 12 + 12
        lots = [len(w) for w, _ in index.phrases(index.codes(queries.terms)[windows])]
        assert max(lots) <= lot
        found = inverted_index._found(index, {"segment": 0, "doc_ids": [1, 2, 3]}, queries)
        got.append(found.to_pylist())
    assert got[0] == got[1] and [len(r["items"]) for r in got[0]] == [21, 0, 21]


def test_chained_sets_do_not_meet(spark, monkeypatch):
    """A chain of documents that share half their words with the next has no links: the work per set stays flat."""
    monkeypatch.setattr(jaccard_join, "BLOCK_DOCS", 20)
    seen, product = [], jaccard_join._product

    def counted(keyed, keys, percent):
        if "low" in keys:
            seen.append(keyed.count())
        return product(keyed, keys, percent)

    monkeypatch.setattr(jaccard_join, "_product", counted)
    share = []
    for size in (100, 400):
        seen.clear()
        rows = [(i, " ".join(f"w{i * 10 + k}" for k in range(20))) for i in range(size)]
        got = jaccard_join.join(spark.createDataFrame(rows, "doc_id long, text string"), 3, 60).collect()
        assert all(r["component_id"] == r["doc_id"] for r in got)
        share.append(sum(seen) / size)
    assert share[1] < 1.2 * share[0] + 0.5, share


def test_near(spark):
    rows = [(1, "a b c d e f a"), (2, "c x x x a"), (3, "f e a"), (4, None)]
    index = inverted_index.build(spark.createDataFrame(rows, "doc_id long, text string"), shared_dir(spark, "t"))
    got = inverted_index.near(index, ["a c", "e f zz", "f a"], 3).collect()
    assert sorted(map(tuple, got)) == [(1, 0, 0), (1, 2, 5), (3, 2, 0)]


def test_near_items(spark, docs, rows):
    items = [(1, dict(rows)[3]), (2, "same line here now"), (3, None), (None, "same line"), (4, "absentword here")]
    index = inverted_index.build(docs, shared_dir(spark, "t"))
    got = inverted_index.near_items(index, spark.createDataFrame(items, "item_id long, text string"), 3, 6, block_bytes=30).collect()
    want = []
    for item, text in items:
        asked = set(LETTERS.findall(lower(text))[:3])
        for i, t in rows if item is not None and asked else []:
            w = LETTERS.findall(lower(t))
            want += [(i, item, k) for k in range(len(w)) if w[k] in asked and asked <= set(w[k : k + 6])]
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got) and want


def linked(rows, n, percent):
    sets = []
    for _, t in rows:
        w = SPACE.findall(lower(t))
        sets.append({tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set()))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                root[find(a)] = find(b)
    groups: dict = {}
    for k, (i, _) in enumerate(rows):
        groups.setdefault(find(k), []).append(i)
    low = {k: min((i for i in g if i is not None), default=None) for k, g in groups.items()}
    return [(i, len(s), low[find(k)] if s else i) for k, ((i, _), s) in enumerate(zip(rows, sets))]


@pytest.mark.parametrize("n,percent,block", [(3, 90, 2048), (5, 80, 2048), (3, 90, 2)])
def test_join(docs, rows, monkeypatch, n, percent, block):
    monkeypatch.setattr(jaccard_join, "BLOCK_DOCS", block)
    got = jaccard_join.join(docs, n, percent).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(str, linked(rows, n, percent))) == sorted(str(tuple(r)) for r in got)


def test_keep_one(docs, rows, empty):
    got = jaccard_join.keep_one(docs)
    assert got.columns == docs.columns
    want = linked(rows, 5, 80)
    wordless = sum(n == 0 for _, n, _ in want)
    assert got.count() == wordless + len({low if low is not None else f"null{k}" for k, (_, n, low) in enumerate(want) if n})
    assert jaccard_join.join(empty).count() == 0 and jaccard_join.keep_one(empty).count() == 0


def test_size_classes():
    for percent in (50, 80, 90, 100):
        ends = jaccard_join.classes(percent, 500)
        place = np.searchsorted(ends, np.arange(1, 501), "right")
        for a in range(1, 501):
            largest = min(500, a * 100 // percent)
            assert place[largest - 1] - place[a - 1] <= 1


def test_components(spark):
    links = [(1, 2), (3, 2), (9, 8), (8, 7), (7, 6), (5, 5), (10, 20), (20, 30), (30, 10)]
    got = components(spark.createDataFrame(links, "a long, b long")).collect()
    want = {1: 1, 2: 1, 3: 1, 6: 6, 7: 6, 8: 6, 9: 6, 10: 10, 20: 10, 30: 10}
    assert {r["node"]: r["root"] for r in got} == want and len(got) == len(want)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_elias_fano():
    rng = np.random.default_rng(1)
    for n, top in ((0, 1), (1, 1), (5000, 3000), (9000, 1 << 40), (100, 2**63)):
        values = np.sort(rng.integers(0, top, n).astype(np.uint64))
        coded = elias_fano.encode(values)
        arrays = elias_fano.load(elias_fano.dump(coded))
        assert elias_fano.decode(arrays, 0, n).tolist() == values.tolist()
        for a, b in ((0, n // 2), (n // 3, n), (n // 2, n // 2)):
            assert elias_fano.decode(coded, a, b).tolist() == values[a:b].tolist()


def test_packed_and_plain_ranks_agree():
    rng = np.random.default_rng(3)
    key, at = rng.integers(0, 50, 300).astype(np.uint64), np.sort(rng.choice(10_000, 300, replace=False))
    packed, plain = suffix_dedup._ranks(key, at, 40), suffix_dedup._ranks(key, at, 64)
    assert [x.tolist() for x in packed] == [x.tolist() for x in plain]
    values = dict(zip(at.tolist(), key.tolist()))
    order = [values[i] for i in packed[0].tolist()]
    assert order == sorted(order) and packed[1].tolist() == np.unique(key, return_inverse=True)[1][np.argsort(key, kind="stable")].tolist()
    assert suffix_dedup._ranks(key[:0], at[:0], 40)[0].tolist() == []
