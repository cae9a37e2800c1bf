"""Quality rules and sharding."""

import re
import zlib
from collections import Counter

from kveil.llm import quality_rules, sharding

W = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    w = W.findall(text or "")
    windows = Counter(zip(w, w[1:], w[2:]))
    covered = {k + j for k in range(len(w) - 2) for j in range(3) if windows[w[k], w[k + 1], w[k + 2]] > 1}
    lines = [x for x in (text or "").split("\n") if W.search(x)]
    symbols = len(re.findall(r"[#*$%&|<>]", text or ""))
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), symbols, len(lines) - len(set(lines)), len(covered), failed


def test_measures(docs, rows):
    got = quality_rules.judge(quality_rules.measure(docs)).select(
        "doc.doc_id", "doc.text", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    ).collect()
    assert len(got) == len(rows)
    for r in got:
        assert tuple(r[2:8]) == brute(r["text"]), r["doc_id"]
        assert not (r["base_failed"] and r["kept"])


def test_rules_are_one_condition():
    rule = quality_rules.Rule("x", "a", "b", 1, 2)
    assert quality_rules.compile_rules((rule,)) == "1000 * a >= 1 * b AND 1000 * a <= 2 * b"
    assert quality_rules.compile_rules(()) == "true"


def test_keep(docs, empty):
    kept = quality_rules.keep(docs)
    assert kept.columns == docs.columns
    assert quality_rules.keep(empty).count() == 0
    assert quality_rules.judge(quality_rules.measure(empty)).count() == 0


def test_no_python(docs):
    plan = quality_rules.keep(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_permutation():
    for n in (1, 2, 3, 10, 97, 1000, 4099):
        dom, keys = sharding.domain(n), sharding.round_keys(5)
        places = [sharding.permute(i, dom, keys) for i in range(n)]
        assert sorted(places) == list(range(n))
        assert [sharding.inverse(p, dom, keys) for p in places] == list(range(n))
        # Walking never needs more steps than there are points beyond n.
        assert dom.a * dom.b - n == dom.walk


def test_assign(docs, rows, empty):
    got = sharding.assign(docs).collect()
    assert len(got) == len(rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter(
        (i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows
    )
    dom, keys = sharding.domain(len(rows)), sharding.round_keys(2024)
    for r in got:
        place = sharding.permute(r["row_number"], dom, keys)
        assert (r["shard"], r["slot"]) == (place % sharding.SHARDS, place // sharding.SHARDS)
    ids = [r["doc_id"] for r in sorted(got, key=lambda r: r["row_number"])]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    assert sharding.assign(empty).count() == 0
