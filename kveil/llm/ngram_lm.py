"""LM scoring with Elias-Fano n-gram tries: bigrams, absolute discounts, unigram back-off.

The order is fixed at two: a context is one word.

Contexts are dealt to slices by hash; each slice holds a trie of its own. Level one are
the contexts, with monotone pointers to level two, their successors. A successor is
stored relative to its context: context number times vocabulary size plus the word's
number in the slice's vocabulary, which makes the level one monotone sequence, so the
search for a successor is a search for a value inside its context's range: the pointers
name the blocks of the range, and only the block that can hold the value is decoded. All sequences
are Elias-Fano coded; probabilities and back-off weights are quantised logarithms,
rounded down. Levels are memory-mapped by the task that queries them.

    P(w | h) = max(c(h w) - D, 0) / c(h) + b(h) * P(w),   P(w) = (c(w) + 0.5) / (N + 0.5 (V + 1))

D depends on the count (1, 2, more) and is estimated once from the counts of counts of
all slices, so it does not depend on how many there are. A context never seen leaves P(w). Groups send their distinct bigrams with
counts, so a frequent pair reaches its slice once per group.

Tokens are the words of a text (no white space, A-Z lowered) and one end; null text has
the end only. Rows with a null id are scored and held out. Words are known by 64-bit
hashes, successors within a context by 48 bits of them. Repeated rows count as often as
they stand; an empty table gives an empty result, and without training rows all counts
are zero.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kveil.llm import elias_fano, groups, words

START, END = np.uint64(0x51A7C0DE51A7C0DE), np.uint64(0xE11DC0DEE11DC0DE)
STEP = 5000.0  # quantisation: codes per unit of log10, 16 bits
BLOB = groups.BLOB
COUNTS = ["n1", "n2", "n3", "n4"]
MODEL = "slice int, slices int, tokens long, contexts long, levels binary"
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def held_out(doc_id: Column, folds: int = 5, fold: int = 1) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(True))


class Bigrams:
    """Distinct contexts and bigrams of a group, and the bigram of every token in text order."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        parts, counts = [], []
        for i, j in words.slices(offsets):
            part = words.split(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            parts.append(part.hashes())
            counts.append(np.diff(part.ptr))
        word = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        count = np.concatenate(counts) if counts else np.zeros(0, np.int64)
        n = len(count)
        self.ptr = np.append(0, np.cumsum(count + 1))
        # Words are numbered once; before and after are the same numbers, shifted by the start or the end.
        distinct, number = np.unique(word, return_inverse=True)
        self.known = np.unique(np.append(distinct, [START, END])) if n else distinct
        number = np.searchsorted(self.known, distinct)[number]
        del word, parts
        w = np.full(self.ptr[-1], np.searchsorted(self.known, END), np.int64)
        inside = np.ones(self.ptr[-1], bool)
        inside[self.ptr[1:] - 1] = False
        w[inside] = number
        pair = np.full(self.ptr[-1], np.searchsorted(self.known, START), np.int64)
        inside[:] = True
        inside[self.ptr[:-1]] = False
        pair[inside] = number
        del number, inside
        pair *= len(self.known)
        pair += w
        del w
        pair, of_token, self.times = np.unique(pair, return_inverse=True, return_counts=True)
        self.of_token = of_token.astype(np.int32)
        self.h, self.w = (pair // max(1, len(self.known)), pair % max(1, len(self.known))) if len(pair) else (pair, pair)
        self.docs = n

    def blobs(self, grp: int, count: int, with_times: bool) -> pa.Table:
        """One row per slice: contexts with their successors, in hash order."""
        context, size = np.unique(self.h, return_counts=True)
        order, border = groups.slice_order(self.known[context], count)
        first = np.cumsum(size) - size

        def body(p: np.ndarray) -> bytes:
            successors = self.known[self.w[words.ranges(first[p], size[p])]]
            head = np.array([len(p)], "<u8").tobytes() + self.known[context[p]].astype("<u8").tobytes() + size[p].astype("<u4").tobytes()
            return head + groups.pack48(successors)

        def extra(p: np.ndarray) -> bytes:
            return self.times[words.ranges(first[p], size[p])].astype("<u4").tobytes() if with_times else b""

        return groups.blobs(grp, order, border, body, extra)


def _parse(body: pa.Buffer) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Contexts, their successor counts, and the 48-bit successors."""
    m = int.from_bytes(body[:8], "little")
    context = np.frombuffer(body, "<u8", m, 8)
    size = np.frombuffer(body, "<u4", m, 8 + 8 * m).astype(np.int64)
    return context, size, groups.unpack48(body[8 + 12 * m :]) >> np.uint64(16)


def counts_of_counts(counts: np.ndarray) -> list[int]:
    """How many bigrams occur once, twice, three and four times."""
    return [int(np.count_nonzero(counts == k)) for k in range(1, 5)]


def discounts(n: list[int]) -> np.ndarray:
    """Discounts of counts 1, 2 and more, from the counts of counts; never all of a count."""
    if n[0] == 0 or n[1] == 0:
        return np.array([0.75, 0.75, 0.75])
    y = n[0] / (n[0] + 2 * n[1])
    raw = [k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] else 0.75 for k in (1, 2, 3)]
    return np.clip(raw, 0.05, [0.98, 1.9, 2.8])


def quantise(p: np.ndarray) -> np.ndarray:
    """Code of log10 p rounded down; 0 stands for nothing."""
    out = np.zeros(len(p), np.uint16)
    some = p > 0
    out[some] = np.clip(65535 - np.ceil(-np.log10(p[some]) * STEP - 1e-9), 1, 65535)
    return out


def restore(code: np.ndarray) -> np.ndarray:
    return np.where(code > 0, 10.0 ** ((code.astype(np.float64) - 65535) / STEP), 0.0)


def _counted(context: np.ndarray, successor: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Contexts, vocabulary, and distinct bigrams (context number times vocabulary size plus word number) with counts."""
    heads, h = np.unique(context, return_inverse=True)
    vocabulary, w = np.unique(successor, return_inverse=True)
    pair = h.astype(np.int64) * len(vocabulary) + w
    del h, w
    pair, inverse = np.unique(pair, return_inverse=True)
    return heads, vocabulary, pair, np.bincount(inverse, times, len(pair)).astype(np.int64)


def build_levels(context: np.ndarray, successor: np.ndarray, times: np.ndarray, of_counts: list[int] | None = None) -> dict[str, np.ndarray]:
    """The trie of bigrams given in any order, with repeats; without ``of_counts`` they are the whole corpus."""
    heads, vocabulary, pair, count = _counted(context, successor, times)
    owner = pair // max(1, len(vocabulary))
    total = np.bincount(owner, count, len(heads))
    d = discounts(counts_of_counts(count) if of_counts is None else of_counts)[np.minimum(count, 3) - 1]
    lost = np.bincount(owner, np.minimum(d, count), len(heads))
    levels = {"codes": quantise(np.maximum(count - d, 0) / total[owner]), "backoff": quantise(lost / total)}
    pointers = np.append(0, np.cumsum(np.bincount(owner, minlength=len(heads))))
    sequences = {"heads": heads, "totals": np.cumsum(total).astype(np.uint64), "pointers": pointers, "vocabulary": vocabulary, "successors": pair}
    for name, values in sequences.items():
        for part, a in elias_fano.encode(values).items():
            levels[f"{name}.{part}"] = a
    return levels


class Trie:
    """Queries on mapped levels; only blocks that can hold an answer are decoded."""

    def __init__(self, levels: dict[str, np.ndarray]):
        self.levels = levels

    def _coded(self, name: str) -> dict[str, np.ndarray]:
        return {part: self.levels[f"{name}.{part}"] for part in ("low", "high", "places")}

    def query(self, context: np.ndarray, size: np.ndarray, successor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Count and back-off code per context, probability code per successor (0: unseen)."""
        head = elias_fano.find(self._coded("heads"), context)
        found = np.flatnonzero(head >= 0)
        total, backoff = np.zeros(len(head), "<i8"), np.full(len(head), 65535, "<u2")
        first, last = np.zeros(len(head), np.int32), np.zeros(len(head), np.int32)
        heads, number = np.unique(head[found], return_inverse=True)
        sums, pointers = self._coded("totals"), self._coded("pointers")
        below = np.where(heads > 0, elias_fano.take(sums, np.maximum(heads - 1, 0)).astype(np.int64), 0)
        total[found] = (elias_fano.take(sums, heads).astype(np.int64) - below)[number]
        backoff[found] = self.levels["backoff"][heads][number]
        first[found] = (elias_fano.take(pointers, heads).astype(np.int64) // elias_fano.SAMPLE)[number]
        last[found] = ((elias_fano.take(pointers, heads + 1).astype(np.int64) - 1) // elias_fano.SAMPLE)[number]
        key = elias_fano.find(self._coded("vocabulary"), successor)
        owner = np.repeat(np.arange(len(head), dtype=np.int32), size)
        asked = np.flatnonzero((head[owner] >= 0) & (key >= 0))
        owner, key = owner[asked], key[asked]
        key += head[owner] * len(self.levels["vocabulary.low"])
        at = elias_fano.find(self._coded("successors"), key, first[owner], last[owner])
        code = np.zeros(len(successor), "<u2")
        code[asked[at >= 0]] = self.levels["codes"][at[at >= 0]]
        return total, backoff, code


def _ask_counts(count: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.filter(pc.invert(table["held_out"]))
        grams = Bigrams(*groups.texts(groups.in_order(table)))
        return grams.blobs(table["grp"][0].as_py() if len(table) else 0, count, True)

    return run


def _bigrams(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Contexts, successors and counts in the blobs of a slice."""
    context, successor = [], []
    for body in table["body"]:
        c, size, s = _parse(body.as_buffer())
        context.append(np.repeat(c, size))
        successor.append(s)
    times = np.concatenate(groups.views(table["extra"], "<u4"))
    return np.concatenate(context), np.concatenate(successor), times


def _count(table: pa.Table) -> pa.Table:
    return pa.table([pa.array([n], pa.int64()) for n in counts_of_counts(_counted(*_bigrams(table))[-1])], names=COUNTS)


def _build(table: pa.Table, of_counts: pa.Table) -> pa.Table:
    if not len(table):
        return pa.table({
            **{c: pa.array([], pa.int32()) for c in ("slice", "slices")}, **{c: pa.array([], pa.int64()) for c in ("tokens", "contexts")},
            "levels": pa.array([], pa.binary()),
        })
    context, successor, times = _bigrams(table)
    levels = build_levels(context, successor, times, [of_counts[c][0].as_py() for c in COUNTS])
    heads = len(levels["heads.low"])
    return pa.table(
        [
            *(pa.array([t[0].as_py()], pa.int32()) for t in (table["slice"], of_counts["slices"])), pa.array([int(times.sum())]), pa.array([heads]),
            pa.array([elias_fano.dump(levels)], pa.binary()),
        ],
        names=["slice", "slices", "tokens", "contexts", "levels"],
    )


def _dealt(docs: DataFrame, count: int) -> DataFrame:
    return groups.grouped(docs.select("doc_id", "text", held_out(F.col("doc_id").cast("long")).alias("held_out")), count, "doc_id", "text", "held_out")


def fit(docs: DataFrame, folder: str) -> DataFrame:
    """Learn from the rows that are not held out; the model is a table of one trie per slice."""
    parts = groups.group_count(docs)
    count = groups.slice_count(parts)
    asked = _dealt(docs, parts).groupBy("grp").applyInArrow(groups.lean(_ask_counts(count)), BLOB)
    # Both passes over the blobs of a slice read the same exchange.
    of_counts = asked.groupBy("slice").applyInArrow(groups.lean(_count), ", ".join(f"{c} long" for c in COUNTS)).agg(*[F.sum(c).alias(c) for c in COUNTS])
    numbers = docs.sparkSession.range(count).select(F.col("id").cast("int").alias("slice"), F.lit(count).alias("slices"))
    for_slices = numbers.crossJoin(F.broadcast(of_counts))
    asked.groupBy("slice").cogroup(for_slices.groupBy("slice")).applyInArrow(groups.lean(_build), MODEL).write.mode("errorifexists").parquet(folder)
    return read(docs.sparkSession, folder)


def read(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(MODEL).parquet(folder)


def _ask_scores(count: int):
    def run(table: pa.Table) -> pa.Table:
        return Bigrams(*groups.texts(groups.in_order(table))).blobs(table["grp"][0].as_py(), count, False)

    return run


def _answer(table: pa.Table, model: pa.Table) -> pa.Table:
    """Per context its count and back-off code (body), per successor its code (extra)."""
    empty = build_levels(*(np.zeros(0, np.uint64),) * 2, np.zeros(0, np.uint32))
    trie = Trie(elias_fano.load(model["levels"][0].as_py()) if len(model) else empty)
    asked = [_parse(b.as_buffer()) for b in table["body"]]
    total, backoff, code = trie.query(*(np.concatenate([x[k] for x in asked]) for k in range(3))) if asked else ((), (), ())
    body, extra, m, n = [], [], 0, 0
    for context, _, successor in asked:
        body.append(total[m : m + len(context)].tobytes() + backoff[m : m + len(context)].tobytes())
        extra.append(code[n : n + len(successor)].tobytes())
        m, n = m + len(context), n + len(successor)
    return pa.table([table["grp"], table["slice"], pa.array(body, pa.binary()), pa.array(extra, pa.binary())], names=["grp", "slice", "body", "extra"])


def _score(count: int, tokens: int, vocabulary: int):
    def run(table: pa.Table, reply: pa.Table) -> pa.Table:
        table = groups.in_order(table)
        grams = Bigrams(*groups.texts(table))
        context, size = np.unique(grams.h, return_counts=True)
        order, border = groups.slice_order(grams.known[context], count)
        first = np.cumsum(size) - size
        total, backoff = np.zeros(len(grams.known), np.int64), np.full(len(grams.known), 65535, np.uint16)
        code = np.zeros(len(grams.h), np.uint16)
        for s, body, extra in zip(reply["slice"].to_pylist(), reply["body"], groups.views(reply["extra"], "<u2")):
            mine = order[border[s] : border[s + 1]]
            total[context[mine]] = np.frombuffer(body.as_buffer(), "<i8", len(mine))
            backoff[context[mine]] = np.frombuffer(body.as_buffer(), "<u2", len(mine), 8 * len(mine))
            code[words.ranges(first[mine], size[mine])] = extra
        # A text has one start and one end, so ends are counted by the start's count.
        times = total.copy()
        times[grams.known == END] = total[grams.known == START]
        unigram = (times + 0.5) / (tokens + 0.5 * (vocabulary + 1))
        model = restore(code) + restore(backoff)[grams.h] * unigram[grams.w]
        sums = [np.append(0, np.cumsum(x[grams.of_token])) for x in (np.log10(unigram)[grams.w], np.log10(model), (times > 0)[grams.w].astype(np.int64))]
        base, score, known = (x[grams.ptr[1:]] - x[grams.ptr[:-1]] for x in sums)
        n = grams.docs
        return pa.table(
            [
                table["doc_id"], table["held_out"], pa.array(np.diff(grams.ptr)), pa.array(known), pa.array([tokens] * n, pa.int64()),
                pa.array(base), pa.array(score),
            ],
            names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )

    return run


def score(docs: DataFrame, model: DataFrame) -> DataFrame:
    """Base and model log10 probability of every text; questions go to as many slices as the model was built with."""
    sums = model.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("contexts"), F.lit(0)), F.coalesce(F.max("slices"), F.lit(1))).first()
    count = sums[2]
    dealt = _dealt(docs, groups.group_count(docs))
    asked = dealt.groupBy("grp").applyInArrow(groups.lean(_ask_scores(count)), BLOB)
    reply = asked.groupBy("slice").cogroup(model.select("slice", "levels").groupBy("slice")).applyInArrow(groups.lean(_answer), BLOB)
    # Contexts are all words and the start; words and the end are the vocabulary.
    return dealt.groupBy("grp").cogroup(reply.groupBy("grp")).applyInArrow(groups.lean(_score(count, *sums[:2])), SCORES)
