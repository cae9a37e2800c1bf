"""Benchmark decontamination with a distributed positional inverted index.

``build`` turns the documents into segments of whole documents; a segment stores, per
term, the sorted list of the positions of its tokens. ``search`` sends the test windows
to all segments, in blocks of bounded size, equal windows once; a segment takes the
postings of the rarest term of each window, shifts them by the term's offset, and
intersects them with the other lists, again from the rarest, a bounded number of
postings at a time. ``near`` finds terms close together in any order.

Words follow ``words.LETTERS`` after lower-casing A-Z. Null or wordless texts have no
words and are never hit; items without words match nothing; an item without an id still
hits words but is not listed. Null ids and repeated rows are kept as rows of their own;
empty tables give empty results or clean documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kveil.llm import groups, rows, words

WINDOW = 10
BLOCK_BYTES = 4 << 20
POSTINGS = 1 << 19  # shifted postings held at once
SEGMENT = (
    "segment long, doc_ids array<long>, doc_words binary, terms binary, term_sizes binary, term_counts binary, postings binary"
)
FOUND = "segment long, ordinal int, doc_id long, n_words long, spans array<struct<start:long,end:long>>, items array<long>"


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number = TaskContext.get().partitionId() << 32
    for batch in batches:
        data, offsets = words.flat(batch.column(1))
        for i, j in words.slices(offsets):
            part = words.split(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], words.LETTERS, lower=True)
            codes, terms = part.codes()
            count = np.diff(part.ptr)
            # A gap of one position keeps phrases from crossing documents.
            position = np.arange(len(codes), dtype=np.int64) + np.repeat(np.arange(j - i), count)
            order = np.argsort(codes, kind="stable")
            size = np.bincount(codes, minlength=len(terms))
            postings = position[order]
            delta = np.diff(postings, prepend=0)
            first = np.cumsum(size) - size
            delta[first] = postings[first]
            buffers = terms.buffers()
            bounds = np.frombuffer(buffers[1], np.int64)[: len(terms) + 1] if len(terms) else np.zeros(1, np.int64)
            body = np.frombuffer(buffers[2], np.uint8)[bounds[0] : bounds[-1]] if len(terms) else np.zeros(0, np.uint8)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([number], pa.int64()),
                    pa.array([batch.column(0).slice(i, j - i).to_pylist()], pa.list_(pa.int64())),
                    *[
                        pa.array([x.tobytes()], pa.binary())
                        for x in (count.astype("<i4"), body, np.diff(bounds).astype("<i4"), size.astype("<i4"), delta.astype("<u4"))
                    ],
                ],
                names=["segment", "doc_ids", "doc_words", "terms", "term_sizes", "term_counts", "postings"],
            )
            number += 1


def build(docs: DataFrame, folder: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Write the index of all texts to ``folder`` and return its segments."""
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    texts.mapInArrow(lambda batches: groups.released(_segments(batches)), SEGMENT).write.mode("errorifexists").option("compression", "zstd").parquet(folder)
    return docs.sparkSession.read.schema(SEGMENT).parquet(folder)


class Segment:
    """One segment in memory: per term the sorted list of its positions, and all lists as one sequence of (term, position)."""

    def __init__(self, row: dict):
        def numbers(name: str, kind: str) -> np.ndarray:
            return np.frombuffer(row[name], kind)

        self.doc_words = numbers("doc_words", "<i4").astype(np.int64)
        self.doc_start = np.cumsum(self.doc_words + 1) - (self.doc_words + 1)
        bounds = np.append(0, np.cumsum(numbers("term_sizes", "<i4"), dtype=np.int64))
        self.terms = pa.Array.from_buffers(
            pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(row["terms"])]
        )
        self.count = numbers("term_counts", "<i4").astype(np.int64)
        self.first = np.append(0, np.cumsum(self.count))
        sums = np.cumsum(numbers("postings", "<u4"), dtype=np.int64)
        base = np.zeros(len(self.count), np.int64)
        has = self.first[:-1] > 0
        base[has] = sums[self.first[:-1][has] - 1]
        self.postings = sums - np.repeat(base, self.count)
        self.length = int((self.doc_words + 1).sum()) + 1
        # Term number and position in one number: a search finds a position in the list of any term.
        self.entries = np.repeat(np.arange(len(self.count), dtype=np.int64) * self.length, self.count) + self.postings

    def holds(self, term: np.ndarray, position: np.ndarray) -> np.ndarray:
        """Whether each position stands in the list of its term."""
        wanted = term * self.length + position
        at = np.searchsorted(self.entries, wanted)
        return (at < len(self.entries)) & (self.entries[np.minimum(at, len(self.entries) - 1)] == wanted)

    def codes(self, terms: pa.Array) -> np.ndarray:
        """Numbers of ``terms`` here, -1 where absent."""
        return pc.fill_null(pc.index_in(terms, value_set=self.terms), -1).to_numpy(zero_copy_only=False)

    def phrases(self, windows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Window number and start position of every occurrence of rows of ``windows`` (term numbers, -1: absent), in bounded lots."""
        windows = windows.astype(np.int64)
        lists = np.where(windows >= 0, self.count[windows] if len(self.count) else 0, 0)
        alive = np.flatnonzero((lists > 0).all(axis=1))
        if not len(alive):
            return
        order = np.argsort(lists[alive], axis=1, kind="stable")
        rarest = windows[alive, order[:, 0]]
        ends = np.append(0, np.cumsum(self.count[rarest]))
        for begin in range(0, int(ends[-1]), POSTINGS):
            lot = np.arange(begin, min(begin + POSTINGS, int(ends[-1])))
            which = np.searchsorted(ends, lot, "right") - 1
            start = self.postings[self.first[rarest[which]] + lot - ends[which]] - order[which, 0]
            inside = (start >= 0) & (start + windows.shape[1] <= self.length)
            which, start = which[inside], start[inside]
            for j in range(1, windows.shape[1]):
                offset = order[which, j]
                match = self.holds(windows[alive[which], offset], start + offset)
                which, start = which[match], start[match]
            if len(which):
                yield alive[which], start

    def near(self, codes: np.ndarray, width: int) -> np.ndarray:
        """Start positions of spans of ``width`` words that hold every term of ``codes`` and begin with one of them."""
        codes = np.unique(codes)
        if not len(codes) or codes[0] < 0:
            return np.zeros(0, np.int64)
        lists = [self.postings[self.first[c] : self.first[c + 1]] for c in codes]
        rarest = min(lists, key=len)
        begin = np.unique(np.concatenate(lists))
        at = np.searchsorted(rarest, begin)
        begin = begin[(at < len(rarest)) & (rarest[np.minimum(at, len(rarest) - 1)] < begin + width)]
        doc = np.searchsorted(self.doc_start, begin, "right")
        for own in sorted(lists, key=len):
            at = np.searchsorted(own, begin)
            hit = own[np.minimum(at, len(own) - 1)]
            keep = (at < len(own)) & (hit < begin + width) & (np.searchsorted(self.doc_start, hit, "right") == doc)
            begin, doc = begin[keep], doc[keep]
        return begin


class Queries:
    """The distinct windows of a block of items, by length, over the block's own terms.

    Window ``k`` of a length belongs to ``owners[ptr[k]:ptr[k + 1]]``, numbers of items.
    """

    def __init__(self, item_ids: list[int | None], texts: list[str | None], window: int):
        data, offsets = words.flat(pa.array(texts, pa.string()))
        part = words.split(data, offsets, words.LETTERS, lower=True)
        codes, terms = part.codes()
        self.terms, self.item_ids, self.window = terms, item_ids, window
        count = np.diff(part.ptr)
        self.by_length: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for length in sorted({*np.minimum(count, window).tolist()} - {0}):
            items = np.flatnonzero(np.minimum(count, window) == length)
            many = count[items] - length + 1
            at = words.ranges(part.ptr[items], many)
            windows, number = np.unique(codes[at[:, None] + np.arange(length)], axis=0, return_inverse=True)
            pair = np.unique(np.stack([number.reshape(-1), np.repeat(items, many)], axis=1), axis=0)
            self.by_length.append((windows, np.searchsorted(pair[:, 0], np.arange(len(windows) + 1)), pair[:, 1]))


def _search(block):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = block.value
        found = (_found(Segment(row), row, queries) for batch in batches for row in batch.to_pylist())
        yield from groups.released(found)

    return run


def _found(segment: Segment, row: dict, queries: Queries) -> pa.RecordBatch:
    known = segment.codes(queries.terms)
    edge = np.zeros(segment.length + 1, np.int32)
    pairs = [np.zeros((0, 2), np.int64)]
    for windows, ptr, owners in queries.by_length:
        seen = [np.zeros((0, 2), np.int64)]
        for which, start in segment.phrases(known[windows]):
            np.add.at(edge, start, 1)
            np.add.at(edge, start + windows.shape[1], -1)
            doc = np.searchsorted(segment.doc_start, start, "right") - 1
            seen.append(np.unique(np.stack([doc, which], axis=1), axis=0))
        doc, which = np.unique(np.concatenate(seen), axis=0).T
        many = ptr[which + 1] - ptr[which]
        pairs.append(np.unique(np.stack([np.repeat(doc, many), owners[words.ranges(ptr[which], many)]], axis=1), axis=0))
    # Windows are whole within a document, so no hit covers the gap behind it.
    hit = np.cumsum(edge) > 0
    turn = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
    begin, end = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
    doc = np.searchsorted(segment.doc_start, begin, "right") - 1
    n = len(segment.doc_words)
    base = segment.doc_start[doc] if len(doc) else np.zeros(0, np.int64)
    spans = pa.ListArray.from_arrays(
        pa.array(np.searchsorted(doc, np.arange(n + 1)).astype(np.int32)),
        pa.StructArray.from_arrays([pa.array(begin - base), pa.array(end - base)], names=["start", "end"]),
    )
    found = np.unique(np.concatenate(pairs), axis=0)
    ids = [queries.item_ids[i] for i in found[:, 1].tolist()]
    items = pa.ListArray.from_arrays(pa.array(np.searchsorted(found[:, 0], np.arange(n + 1)).astype(np.int32)), pa.array(ids, pa.int64()))
    return pa.RecordBatch.from_arrays(
        [
            pa.array([row["segment"]] * n, pa.int64()), pa.array(np.arange(n, dtype=np.int32)), pa.array(row["doc_ids"], pa.int64()),
            pa.array(segment.doc_words), spans, items,
        ],
        names=["segment", "ordinal", "doc_id", "n_words", "spans", "items"],
    )


def _blocks(items: DataFrame, item_id: str, text: str, block_bytes: int) -> Iterator[tuple[list, list]]:
    """The items in blocks of about ``block_bytes``; one block at a time is on the driver."""
    texts_of = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(text).cast("string").alias("text"))
    ids, texts, size = [], [], 0
    for row in texts_of.toLocalIterator():
        ids.append(row["item_id"])
        texts.append(row["text"])
        size += len(row["text"] or "") + 16
        if size >= block_bytes:
            yield ids, texts
            ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def search(
    index: DataFrame, items: DataFrame, window: int = WINDOW, item_id: str = "item_id", text: str = "text", block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """Per document: n_words, the spans of hit words and the items with occurring windows.

    Test sets beyond ``block_bytes`` are searched block by block and the hits merged.
    """
    context = index.sparkSession.sparkContext
    parts = [
        index.mapInArrow(_search(context.broadcast(Queries(ids, texts, window))), FOUND)
        for ids, texts in _blocks(items, item_id, text, block_bytes)
    ] or [index.mapInArrow(_search(context.broadcast(Queries([], [], window))), FOUND)]
    if len(parts) == 1:
        return parts[0].drop("segment", "ordinal")
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    merged = every.groupBy("segment", "ordinal").agg(
        F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"),
        F.array_sort(F.flatten(F.collect_list("spans"))).alias("_spans"), F.flatten(F.collect_list("items")).alias("items"),
    )

    def join(done, span):
        last = F.element_at(done, -1)
        grown = F.concat(
            F.slice(done, 1, F.size(done) - 1),
            F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], span["end"]).alias("end"))),
        )
        return F.when((F.size(done) > 0) & (F.get(done, F.size(done) - 1)["end"] >= span["start"]), grown).otherwise(F.concat(done, F.array(span)))

    empty = F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)")
    return merged.select("doc_id", "n_words", F.aggregate("_spans", empty, join).alias("spans"), "items")


def summarise(found: DataFrame) -> DataFrame:
    """n_hit, n_items, items_sha256 and contaminated beside doc_id and n_words."""
    names = F.array_sort(F.transform(F.array_distinct(F.array_compact("items")), lambda i: i.cast("string")))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size(names).cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ",").cast("binary"), 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
    )


def keep_clean(docs: DataFrame, items: DataFrame, folder: str, window: int = WINDOW) -> DataFrame:
    """The documents without any occurring window, with their own columns; the index goes to ``folder``."""
    key = rows.row_key(F.col("doc_id"), F.xxhash64("text"))
    index = build(docs.select(key.alias("doc_id"), "text"), folder)
    hit = search(index, items, window).where(F.size("spans") > 0).select("doc_id")
    return rows.without(docs, hit, key)


def near(index: DataFrame, phrases: list[str], width: int, numbers: list[int] | None = None) -> DataFrame:
    """doc_id, phrase number and start word of spans of ``width`` words that hold all words of a phrase in any order.

    ``phrases`` is a short list given by the caller, ``numbers`` its numbers (by default its places).
    """
    numbers = list(range(len(phrases))) if numbers is None else numbers
    queries = [(i, Queries([i], [p], 1 << 30)) for i, p in zip(numbers, phrases)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                segment = Segment(row)
                for number, query in queries:
                    start = segment.near(segment.codes(query.terms), width)
                    doc = np.searchsorted(segment.doc_start, start, "right") - 1
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([row["doc_ids"][d] for d in doc.tolist()], pa.int64()), pa.array([number] * len(start), pa.int64()),
                            pa.array(start - segment.doc_start[doc] if len(doc) else start),
                        ],
                        names=["doc_id", "phrase", "start"],
                    )

    return index.mapInArrow(run, "doc_id long, phrase long, start long")


def near_items(index: DataFrame, items: DataFrame, first_words: int, width: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, item_id and start word of spans of ``width`` words that hold the first ``first_words`` words of an item in any order.

    A span begins with one of them. Items without words or ids match nothing.
    """
    out = index.sparkSession.createDataFrame([], "doc_id long, item_id long, start long")
    for ids, texts in _blocks(items.where(F.col("item_id").isNotNull()), "item_id", "text", block_bytes):
        data, offsets = words.flat(pa.array(texts, pa.string()))
        part = words.split(data, offsets, words.LETTERS, lower=True)
        every = [w.decode() for w in part.array().to_pylist()]
        heads = [" ".join(every[a : min(b, a + first_words)]) for a, b in zip(part.ptr[:-1], part.ptr[1:])]
        out = out.unionByName(near(index, heads, width, ids).withColumnRenamed("phrase", "item_id"))
    return out


def oracle_sql(window: int = WINDOW) -> str:
    """``summarise(search(...))`` over documents and benchmark in DuckDB SQL."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    split = f"regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {split} AS w FROM documents),
i AS (SELECT item_id, w, least(len(w), {window}) AS n FROM (SELECT item_id, {split} AS w FROM benchmark) WHERE len(w) > 0),
iw AS (SELECT DISTINCT item_id, n, array_to_string(w[k:k + n - 1], ' ') AS s FROM i, unnest(range(1, len(w) - n + 2)) AS t(k)),
dw AS (SELECT r, k, n, array_to_string(w[k:k + n - 1], ' ') AS s FROM d, (SELECT DISTINCT n FROM iw), unnest(range(1, len(w) - n + 2)) AS t(k)),
m AS (SELECT r, k, n, item_id FROM dw JOIN iw USING (n, s)),
h AS (SELECT r, count(DISTINCT k + j) AS n_hit FROM (SELECT DISTINCT r, k, n FROM m), unnest(range(0, n)) AS t(j) GROUP BY r),
f AS (SELECT r, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS names FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS x FROM m) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN f USING (r)
"""


def near_sql(first_words: int, width: int) -> str:
    """``near_items`` over documents and benchmark in DuckDB SQL."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    split = f"regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""
WITH i AS (SELECT item_id, list_distinct({split}[1:{first_words}]) AS q FROM benchmark),
d AS (SELECT row_number() OVER () AS r, doc_id, {split} AS w FROM documents),
spot AS (SELECT r, doc_id, unnest(w) AS x, unnest(range(len(w))) AS k FROM d),
m AS (SELECT item_id, len(q) AS n, r, doc_id, k, x FROM (SELECT *, unnest(q) AS x FROM i) JOIN spot USING (x))
SELECT a.doc_id, a.item_id, a.k AS start FROM m a JOIN m b ON b.r = a.r AND b.item_id = a.item_id AND b.k BETWEEN a.k AND a.k + {width - 1}
GROUP BY a.r, a.doc_id, a.item_id, a.k, a.n HAVING count(DISTINCT b.x) = a.n"""
