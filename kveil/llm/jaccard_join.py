"""N-gram Jaccard join: blocked products of the document by n-gram incidence.

1. Every group of documents asks for the document frequency of its n-grams.
2. In the global order "rare first" two sets that reach the threshold share an n-gram
   among the first ``n - ceil(t * n) + 1`` of each (the size-derived prefix). N-grams of
   a single document fill the prefix but make no candidates, so a document is a
   candidate only if nearly all of it occurs elsewhere.
3. Documents that share a prefix n-gram fall into one cluster; each set goes to its
   cluster once, equal sets as one. Large clusters are cut into blocks by size class
   (sets of classes further apart than one cannot link) and hash.
4. A task multiplies the incidence of a block, or of two blocks, in column blocks,
   accumulates overlap counts, and drops pairs as soon as the columns left cannot lift
   them to their bound. It returns a spanning forest of the links.

Blocks are first linked within, then one set per component across blocks, then the
rest of clusters that are still not one component. Across blocks a set meets only the
blocks that hold one of its prefix n-grams in another component: sets that are merely
chained into one cluster by their neighbours never meet.

A text with fewer words than n is one n-gram of all its words; null and wordless texts
have no n-gram and link with nothing. Equal texts link. Null ids take part, but never
name a component unless all its ids are null. Repeated rows stay rows; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kveil.llm import groups, rows, words
from kveil.llm.components import components
from kveil.session import reliable_checkpoint

BLOCK_DOCS = 2048
BLOCK_NGRAMS = 1 << 21
DENSE = 1 << 21
PREFIX = "doc_id long, tkey long, n int, set_id long, size_class int, prefix array<long>, body binary"


def ngram_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> Iterator[np.ndarray]:
    """Per text, its distinct n-grams as sorted 64-bit hashes."""
    for i, j in words.slices(offsets):
        part = words.split(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        hashes = part.hashes()
        with np.errstate(over="ignore"):
            grams = np.zeros(max(0, len(hashes) - n + 1), np.uint64)
            for k in range(n):
                grams = words.mix(grams + hashes[k : k + len(grams)] + np.uint64(k + 1))
            for a, b in zip(part.ptr[:-1].tolist(), part.ptr[1:].tolist()):
                if b - a >= n:
                    yield np.unique(grams[a : b - n + 1])
                elif b > a:
                    short = np.full(1, b - a, np.uint64)
                    for h in hashes[a:b]:
                        short = words.mix(short + h)
                    yield short
                else:
                    yield hashes[:0]


def classes(percent: int, largest: int) -> np.ndarray:
    """Lower ends of size classes; sets that can link are in one class or in neighbours."""
    ends = [1, 2]
    while ends[-1] <= largest:
        ends.append(max((ends[-1] - 1) * 100 // percent + 1, ends[-1] + 1))
    return np.array(ends)


def _ask(n: int, count: int):
    def run(table: pa.Table) -> pa.Table:
        grp = table["grp"][0].as_py()
        sets = list(ngram_sets(*groups.texts(table), n))
        keys, times = np.unique(np.concatenate(sets), return_counts=True)
        order, border = groups.slice_order(keys, count)
        small = np.minimum(times, 255).astype(np.uint8)
        return groups.blobs(grp, order, border, lambda p: groups.pack48(keys[p]), lambda p: small[p].tobytes())

    return run


def _frequencies(table: pa.Table) -> pa.Table:
    """Answer every n-gram with log2 of its document frequency (0: one document)."""
    bodies = [groups.unpack48(b) for b in groups.views(table["body"], np.uint8)]
    times = np.concatenate(groups.views(table["extra"], np.uint8))
    keys, inverse = np.unique(np.concatenate(bodies), return_inverse=True)
    total = np.bincount(inverse, weights=times, minlength=len(keys))
    level = np.ceil(np.log2(total)).astype(np.uint8)[inverse]
    ends = np.cumsum([len(b) for b in bodies])
    parts = [level[e - len(b) : e].tobytes() for b, e in zip(bodies, ends)]
    return pa.table([table["grp"], table["slice"], pa.array(parts, pa.binary()), pa.array([None] * len(parts), pa.binary())], names=["grp", "slice", "body", "extra"])


def _prefixes(n: int, percent: int, count: int):
    def run(table: pa.Table, reply: pa.Table) -> pa.Table:
        table = groups.in_order(table)
        sets = list(ngram_sets(*groups.texts(table), n))
        every = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        keys, inverse = np.unique(every, return_inverse=True)
        order, border = groups.slice_order(keys, count)
        level = groups.answers(reply, order, border, "u1")[inverse]
        sizes = np.array([len(s) for s in sets], np.int64)
        ends = np.cumsum(sizes)
        bounds = classes(percent, int(sizes.max(initial=0)))
        size_class = np.searchsorted(bounds, sizes, "right")
        set_ids, prefixes, bodies = [], [], []
        with np.errstate(over="ignore"):
            for own, end, size in zip(sets, ends.tolist(), sizes.tolist()):
                set_ids.append(int(words.mix(np.sum(words.mix(own ^ np.uint64(0x5851F42D4C957F2D)), keepdims=True) + np.uint64(size)).view(np.int64)[0]))
                shared = None
                if size:
                    rank = level[end - size : end]
                    length = size - -(-size * percent // 100) + 1
                    if np.count_nonzero(rank == 0) < length:
                        first = np.lexsort((own, rank))[:length]
                        shared = own[first[rank[first] > 0]]
                prefixes.append(shared.view(np.int64) if shared is not None else None)
                bodies.append(own.astype("<u8").tobytes() if shared is not None else None)
        return pa.table(
            [
                table["doc_id"], table["tkey"], pa.array(sizes.astype(np.int32)), pa.array(set_ids, pa.int64()),
                pa.array(size_class.astype(np.int32)), pa.array(prefixes, pa.list_(pa.int64())), pa.array(bodies, pa.binary()),
            ],
            names=["doc_id", "tkey", "n", "set_id", "size_class", "prefix", "body"],
        )

    return run


def overlap_links(bodies: list[np.ndarray], percent: int) -> np.ndarray:
    """Matrix of pairs with 100 * overlap >= percent * union, by a product in column blocks."""
    m, sizes = len(bodies), np.array([len(b) for b in bodies], np.float64)
    every = np.concatenate(bodies)
    _, column, times = np.unique(every, return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(m), sizes.astype(np.int64))
    shared = times[column] > 1
    row, column = row[shared], column[shared]
    _, column = np.unique(column, return_inverse=True)
    width = int(column.max()) + 1 if len(column) else 0
    # overlap >= p / (100 + p) * (size + size), so sets of unlike sizes never link.
    need = percent / (100 + percent) * (sizes[:, None] + sizes[None, :]) - 1e-6
    left = np.bincount(row, minlength=m).astype(np.float64)
    count = np.zeros((m, m), np.float32)
    alive = np.minimum(left[:, None], left[None, :]) >= need
    np.fill_diagonal(alive, False)
    step = max(64, DENSE // m)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for begin in range(0, width, step):
        if not alive.any():
            break
        a, b = np.searchsorted(column, (begin, begin + step))
        block = np.zeros((m, min(step, width - begin)), np.float32)
        block[row[a:b], column[a:b] - begin] = 1
        count += block @ block.T
        left -= np.bincount(row[a:b], minlength=m)
        alive &= count + np.minimum(left[:, None], left[None, :]) >= need
    return alive


def spanning(linked: np.ndarray) -> np.ndarray:
    """For every row, the first row of its component."""
    root = np.full(len(linked), -1)
    for i in range(len(linked)):
        if root[i] < 0:
            front = np.zeros(len(linked), bool)
            front[i] = True
            while front.any():
                root[front] = i
                front = linked[front].any(axis=0) & (root < 0)
    return root


def _multiply(percent: int):
    def run(table: pa.Table) -> pa.Table:
        ids, labels = table["set_id"].to_numpy(), table["label"].to_numpy()
        empty = pa.table([pa.array([], pa.int64())] * 2, names=["a", "b"])
        if len(ids) < 2 or (labels == labels[0]).all():
            return empty
        order = np.argsort(ids)
        bodies = table["body"].to_pylist()
        root = spanning(overlap_links([np.frombuffer(bodies[i], "<u8") for i in order], percent))
        ids = ids[order]
        rest = root != np.arange(len(ids))
        return pa.table([pa.array(ids[rest]), pa.array(ids[root[rest]])], names=["a", "b"])

    return run


def _product(keyed: DataFrame, keys: list[str], percent: int) -> DataFrame:
    return keyed.select(*keys, "set_id", "label", "body").groupBy(*keys).applyInArrow(_multiply(percent), "a long, b long")


def _blocked(sets: DataFrame) -> DataFrame:
    """Add ``big`` (the cluster needs several blocks), ``block`` and ``blocks`` (block count by class)."""
    per_class = sets.groupBy("cluster", "size_class").agg(F.count(F.lit(1)).alias("_docs"), F.sum("n").alias("_grams"))
    blocks = F.ceil(F.greatest(F.col("_docs") / BLOCK_DOCS, F.col("_grams") / BLOCK_NGRAMS)).cast("int")
    per_cluster = per_class.groupBy("cluster").agg(
        ((F.sum("_docs") > BLOCK_DOCS) | (F.sum("_grams") > BLOCK_NGRAMS)).alias("big"),
        F.map_from_entries(F.collect_list(F.struct("size_class", blocks.alias("blocks")))).alias("blocks"),
    )
    joined = sets.join(per_cluster, "cluster")
    own = F.pmod(F.xxhash64("set_id"), F.greatest(F.lit(1), F.try_element_at("blocks", F.col("size_class")))).cast("int")
    whole = F.struct(F.lit(0).alias("c"), F.lit(0).alias("p"))
    cut = F.struct(F.col("size_class").alias("c"), own.alias("p"))
    return joined.withColumn("block", F.when(F.col("big"), cut).otherwise(whole))


def _pairs(blocked: DataFrame, grams: DataFrame, diagonal: bool) -> DataFrame:
    """Each set once per pair of blocks that it takes part in: its own and one that shares a prefix n-gram with it.

    ``grams``: set_id, gram. Blocks beside each other are of one size class or of
    neighbours. An n-gram whose sets are all of one component asks for nothing.
    """
    held = grams.join(blocked.select("set_id", "cluster", "size_class", "block", "label"), "set_id")
    mixed = held.groupBy("gram").agg((F.min("label") != F.max("label")).alias("_mixed")).where("_mixed").select("gram")
    held = held.join(mixed, "gram")
    there = held.select("gram", F.col("size_class").alias("_class"), F.col("block").alias("_other")).distinct()
    meets = F.abs(F.col("_class") - F.col("size_class")) <= 1
    if not diagonal:
        meets = meets & (F.col("_other") != F.col("block"))
    met = held.join(there, "gram").where(meets).select(
        "set_id", "cluster", F.least("block", "_other").alias("low"), F.greatest("block", "_other").alias("high")
    ).distinct()
    return met.join(blocked.select("set_id", "label", "body"), "set_id")


def link_sets(sets: DataFrame, grams: DataFrame, percent: int) -> DataFrame:
    """``node`` and ``root`` of sets (set_id, n, size_class, cluster, body) that link with another set; ``grams`` are their prefixes."""
    blocked = reliable_checkpoint(_blocked(sets.withColumn("label", F.col("set_id"))))
    links = reliable_checkpoint(_product(blocked, ["cluster", "block"], percent))
    found = components(links)
    big = blocked.where("big")
    if big.isEmpty():
        return found

    def labelled(rows: DataFrame, found: DataFrame) -> DataFrame:
        return rows.drop("label").join(found.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn(
            "label", F.coalesce("root", "set_id")
        ).drop("root")

    found = reliable_checkpoint(found)
    first = labelled(big, found).groupBy("cluster", "block", "label").agg(F.min("set_id").alias("set_id"))
    heads = big.drop("big", "block", "blocks").join(first.select("set_id"), "set_id", "left_semi")
    across = _product(_pairs(reliable_checkpoint(_blocked(heads)), grams, diagonal=True), ["cluster", "low", "high"], percent)
    links = reliable_checkpoint(links.union(across))
    found = reliable_checkpoint(components(links))
    now = labelled(big, found)
    split = now.groupBy("cluster").agg((F.min("label") != F.max("label")).alias("_split")).where("_split").select("cluster")
    rest = _product(_pairs(now.join(split, "cluster"), grams, diagonal=False), ["cluster", "low", "high"], percent)
    return components(links.union(rest))


def join(docs: DataFrame, n: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, tkey (a hash of the text), n_shingles, set_id and component_id of every row."""
    parts = groups.group_count(docs, text)
    dealt, count = groups.grouped(docs, parts, doc_id, text), groups.slice_count(parts)
    asked = dealt.groupBy("grp").applyInArrow(groups.lean(_ask(n, count)), groups.BLOB)
    reply = asked.groupBy("slice").applyInArrow(groups.lean(_frequencies), groups.BLOB)
    kept_sets = dealt.groupBy("grp").cogroup(reply.groupBy("grp")).applyInArrow(groups.lean(_prefixes(n, percent, count)), PREFIX)
    kept_sets = reliable_checkpoint(kept_sets)
    shared = kept_sets.where("prefix is not null").select("set_id", F.explode("prefix").alias("gram")).distinct()
    lead = shared.groupBy("gram").agg(F.min("set_id").alias("b"))
    near = shared.join(lead, "gram").where("set_id <> b").select(F.col("set_id").alias("a"), "b").distinct()
    cluster = components(near).select(F.col("node").alias("set_id"), F.col("root").alias("cluster"))
    sets = kept_sets.where("body is not null").groupBy("set_id").agg(
        F.first("n").alias("n"), F.first("size_class").alias("size_class"), F.first("body").alias("body")
    )
    found = link_sets(sets.join(cluster, "set_id"), shared, percent).select(F.col("node").alias("set_id"), "root")
    lowest = kept_sets.where("n > 0").groupBy("set_id").agg(F.min("doc_id").alias("_low")).join(found, "set_id", "left")
    root = F.coalesce("root", "set_id")
    named = lowest.groupBy(root.alias("_root")).agg(F.min("_low").alias("component_id"))
    label = lowest.select("set_id", root.alias("_root")).join(named, "_root").select("set_id", "component_id")
    plain = kept_sets.select("doc_id", "tkey", F.col("n").cast("long").alias("n_shingles"), "set_id")
    empty = plain.where("n_shingles = 0").withColumn("component_id", F.col("doc_id"))
    return plain.where("n_shingles > 0").join(label, "set_id").select("doc_id", "tkey", "n_shingles", "set_id", "component_id").unionByName(empty)


def keep_one(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """One document of each component, with its own columns: the smallest id, then the smallest text hash.

    Wordless documents stay.
    """
    joined = reliable_checkpoint(join(docs, n, percent).where("n_shingles > 0"))
    order = F.struct(F.col("doc_id").isNull().alias("x"), "doc_id", "tkey")
    group = [F.col("component_id"), F.when(F.col("component_id").isNull(), F.col("set_id")).alias("_set")]
    key = rows.row_key(F.col("doc_id"), F.col("tkey"))
    copies = joined.groupBy(*group, "doc_id", "tkey").agg(F.count(F.lit(1)).alias("_rows"))
    first = copies.groupBy("component_id", "_set").agg(F.min(order).alias("_first")).select(
        rows.row_key(F.col("_first.doc_id"), F.col("_first.tkey")).alias("_key")
    )
    gone = copies.select(key.alias("_key")).join(first, "_key", "left_anti")
    left = rows.without(docs, gone, rows.row_key(F.col("doc_id"), F.xxhash64("text")))
    twice, many = rows.bounded(copies.where("_rows > 1").select(key.alias("_twice")).join(first, F.expr("_twice = _key"), "left_semi"))
    if not many:
        return left
    keyed = left.select(F.struct("*").alias("doc"), rows.row_key(F.col("doc_id"), F.xxhash64("text")).alias("_key"))
    once = keyed.join(twice, F.expr("_key = _twice"), "left_anti")
    repeated = keyed.join(twice, F.expr("_key = _twice"), "left_semi").dropDuplicates(["_key"])
    return once.unionByName(repeated).select("doc.*")


def oracle_sql(n: int, percent: int) -> str:
    """doc_id, n_shingles and component_id in DuckDB SQL, for small tables: it counts all pairs with a common n-gram."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT r, CASE WHEN len(w) < {n} THEN array_to_string(w, ' ') ELSE array_to_string(w[k:k + {n} - 1], ' ') END AS s
  FROM d, unnest(range(1, greatest(len(w) - {n} + 1, 1) + 1)) AS t(k) WHERE len(w) > 0),
c AS (SELECT r, count(*) AS n FROM g GROUP BY r),
p AS (SELECT a.r AS x, b.r AS y, count(*) AS m FROM g a JOIN g b ON a.s = b.s AND a.r < b.r GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN c u ON u.r = x JOIN c v ON v.r = y WHERE 100 * m >= {percent} * (u.n + v.n - m)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
reach AS (SELECT r, r AS z FROM d UNION SELECT reach.r, e.y FROM reach JOIN e ON e.x = reach.z)
SELECT any_value(d.doc_id) AS doc_id, coalesce(any_value(c.n), 0) AS n_shingles, min(o.doc_id) AS component_id
FROM reach JOIN d ON d.r = reach.r JOIN d o ON o.r = reach.z LEFT JOIN c ON c.r = d.r GROUP BY d.r
"""
