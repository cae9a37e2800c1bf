"""Vector code compression: product codes whose nearest entries are found by slicing and intersecting bitmasks.

A vector is cut into equal parts; each part is replaced by the number of the nearest
entry of its codebook. All arithmetic is on integers (``floor(SCALE * x)``), so results
do not depend on the order of sums.

Nearest entry of a part: the codebook's coordinates are sorted per dimension, with a
bitmask of the entries before each place. The distance to one entry (the last known one,
or the first) gives a radius that the nearest can not exceed; in each dimension the
entries within that radius are a range of the sorted coordinates, and the exclusive or of
its two prefix masks names them. ANDed over the dimensions these masks leave the exact
candidates, and only their distances are computed. Ties go to the lower entry.

The codebooks (parts x entries x part width numbers) are the only thing that passes the
driver. A round reads the stored integers once and sends one partial sum per task, part
and entry; equal vectors or labels do not matter to it. Rows whose vector is null or
holds null or non-finite components are dropped, as the contract says. Vectors of another
length than the first (by id) or with an integer beyond +-2^25 have no codes: their code
and error are null. Repeated rows and ids each count; null ids come last; ties between
first rows go to the smaller vector. With fewer vectors than entries the codebook is
smaller; an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kveil.llm.rows import bounded
from kveil.session import reliable_checkpoint, shared_dir

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
LARGEST = 1 << 25
CHUNK = 1 << 14
WORD = 64  # entries per mask


class Codebooks(NamedTuple):
    """``entries[part]``: the entries of one part, one per row."""

    entries: np.ndarray

    def sha256(self) -> str:
        """Checksum of all components by part, entry and place within the part."""
        return hashlib.sha256(",".join(map(str, self.entries.reshape(-1).tolist())).encode()).hexdigest()


class Masks:
    """Sorted coordinates of one codebook with prefix entry masks."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        count, width = entries.shape
        self.words = -(-count // WORD)
        order = np.argsort(entries, axis=0, kind="stable")
        self.sorted = np.take_along_axis(entries, order, 0).T.copy()
        self.prefix = np.zeros((width, self.words, count + 1), np.uint64)
        for d in range(width):
            for place, entry in enumerate(order[:, d].tolist()):
                self.prefix[d, :, place + 1] = self.prefix[d, :, place]
                self.prefix[d, entry // WORD, place + 1] |= np.uint64(1 << entry % WORD)

    def candidates(self, x: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """Mask words of the entries within ``radius`` in every dimension, one row per vector."""
        all_ = [(1 << min(WORD, len(self.entries) - WORD * w)) - 1 for w in range(self.words)]
        mask = np.tile(np.array(all_, np.uint64), (len(x), 1))
        for d in range(x.shape[1]):
            low = np.searchsorted(self.sorted[d], x[:, d] - radius, "left")
            high = np.searchsorted(self.sorted[d], x[:, d] + radius, "right")
            for w in range(self.words):
                mask[:, w] &= self.prefix[d, w, high] ^ self.prefix[d, w, low]
        return mask

    def nearest(self, x: np.ndarray, guess: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entry with the least squared distance (ties: lowest) and that distance; ``guess`` is any entry per vector."""
        best = np.square(x - self.entries[guess]).sum(axis=1)
        radius = np.sqrt(best.astype(np.float64)).astype(np.int64) + 1
        mask, entry = self.candidates(x, radius), guess.copy()
        for e in range(len(self.entries)):
            rows = np.flatnonzero(mask[:, e // WORD] >> np.uint64(e % WORD) & np.uint64(1))
            far = np.square(x[rows] - self.entries[e]).sum(axis=1)
            better = (far < best[rows]) | (far == best[rows]) & (e < entry[rows])
            best[rows[better]], entry[rows[better]] = far[better], e
        return entry, best


def _encode(books: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes and squared distances, one column per part."""
    parts, _, width = books.shape
    code, far = np.zeros((len(x), parts), np.int64), np.zeros((len(x), parts), np.int64)
    for p in range(parts):
        masks, own = Masks(books[p]), x[:, p * width : (p + 1) * width]
        for a in range(0, len(x), CHUNK):
            part = own[a : a + CHUNK]
            # A first guess from the middle dimension: the entry at the vector's place among the sorted coordinates.
            if width:
                order = np.argsort(books[p][:, width // 2], kind="stable")
                place = np.searchsorted(masks.sorted[width // 2], part[:, width // 2])
                guess = order[np.minimum(place, len(order) - 1)]
            else:
                guess = np.zeros(len(part), np.int64)
            code[a : a + CHUNK, p], far[a : a + CHUNK, p] = masks.nearest(part, guess)
    return code, far


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def quantised(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, label and ``x``, the components as integers (null: outside +-2^25); rows without a whole finite vector are dropped."""
    rows = vectors.select(
        F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("v")
    )
    # NaN counts as larger than every number and null is caught by the sizes, so one comparison is enough.
    finite = F.col("v").isNotNull() & F.forall("v", lambda c: F.coalesce(F.abs(c) < float("inf"), F.lit(False)))
    fits = F.forall("v", lambda c: F.abs(c) < float(LARGEST / SCALE))
    whole = F.when(fits, F.transform("v", lambda c: F.floor(c * float(SCALE)).cast("int")))
    return rows.where(finite).select("vec_id", "label", whole.alias("x"))


def _sums(books: np.ndarray):
    parts, count, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, members = np.zeros((parts, count, width), np.int64), np.zeros((parts, count), np.int64)
        for batch in batches:
            x = _matrix(batch.column(0), parts * width).astype(np.int64)
            code, _ = _encode(books, x)
            for p in range(parts):
                members[p] += np.bincount(code[:, p], minlength=count)
                order = np.argsort(code[:, p], kind="stable")
                own, sizes = x[order, p * width : (p + 1) * width], np.bincount(code[:, p], minlength=count)
                used = np.flatnonzero(sizes)
                if len(used) and width:
                    sums[p, used] += np.add.reduceat(own, (np.cumsum(sizes) - sizes)[used], axis=0)
        part, entry = np.nonzero(members)
        yield pa.RecordBatch.from_pydict({
            "part": pa.array(part.astype(np.int32)), "entry": pa.array(entry.astype(np.int32)), "members": pa.array(members[part, entry]),
            "total": pa.array(list(sums[part, entry]), pa.list_(pa.int64())),
        })

    return run


def _round(rows: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round: every used entry becomes the floored mean of its parts."""
    width = books.shape[2]
    partial = rows.select("x").mapInArrow(_sums(books), "part int, entry int, members long, total array<long>")
    sums = [F.sum(F.col("total")[d]).alias(f"s{d}") for d in range(width)]
    out = books.copy()
    # parts x entries rows at most
    for r in partial.groupBy("part", "entry").agg(F.sum("members").alias("members"), *sums).collect():
        out[r["part"], r["entry"]] = [r[f"s{d}"] // r["members"] for d in range(width)]
    return out


def fit(stored: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks | None:
    """Codebooks of stored integer vectors, started from the vectors with the smallest ids; None without vectors.

    Vectors as long as the first one take part; ``parts`` must divide that length.
    """
    usable = stored.where("x IS NOT NULL")
    order = [F.col("vec_id").asc_nulls_last(), F.col("x")]
    first = usable.select("vec_id", "x").orderBy(*order).limit(1).collect()
    if not first:
        return None
    length = len(first[0]["x"])
    if length % parts:
        raise ValueError(f"vectors of {length} components can not be cut into {parts} equal parts")
    same = usable.where(F.size("x") == length)
    start = np.array([r["x"] for r in same.select("vec_id", "x").orderBy(*order).limit(entries).collect()], np.int64)
    books = start.reshape(len(start), parts, length // parts).transpose(1, 0, 2).copy()
    for _ in range(rounds):
        books = _round(same, books)
    return Codebooks(books)


def encode(stored: DataFrame, books: Codebooks) -> DataFrame:
    """vec_id, label, ``code`` (two hex digits a part) and ``error`` (summed squared distances) of every stored vector."""
    entries = books.entries
    length = entries.shape[0] * entries.shape[2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(2), length).astype(np.int64)
            code, far = _encode(entries, x)
            text = code.astype(np.uint8)
            digits = [row.tobytes().hex() for row in text]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(digits, pa.string()), pa.array(far.sum(axis=1))], names=["vec_id", "label", "code", "error"]
            )

    fits = F.coalesce((F.size("x") == length) & F.col("x").isNotNull(), F.lit(False))
    types = {f.name: f.dataType.simpleString() for f in stored.schema}
    schema = f"vec_id {types['vec_id']}, label {types['label']}, code string, error long"
    none = stored.where(~fits).select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    return stored.where(fits).mapInArrow(run, schema).unionByName(none)


def compress(
    vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS,
    vec_id: str = "vec_id", vector: str = "embedding", label: str = "label",
) -> DataFrame:
    """vec_id, label, code, error, ``label_error`` (errors summed over equal labels, nulls together) and codebooks_sha256.

    The integers are stored once in the shared folder, since every round reads them. The
    sums per label come from partial sums and meet the rows by a broadcast only if they are few.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code of two hex digits names at most 256 entries")
    spark = vectors.sparkSession
    folder = shared_dir(spark, "vector-codes")
    integers = quantised(vectors, vec_id, vector, label)
    integers.write.parquet(folder)
    stored = spark.read.schema(integers.schema).parquet(folder)
    books = fit(stored, parts, entries, rounds)
    if books is None:
        none = F.lit(None)
        return stored.select(
            "vec_id", "label", none.cast("string").alias("code"), none.cast("long").alias("error"), none.cast("long").alias("label_error"),
            none.cast("string").alias("codebooks_sha256"),
        )
    coded = reliable_checkpoint(encode(stored, books))
    sums, _ = bounded(coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "_label"))
    joined = coded.join(sums, F.col("label").eqNullSafe(F.col("_label")))
    return joined.select("vec_id", "label", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))


def _floor_div(total: str, count: str) -> str:
    return f"(({total}) - ((({total}) % ({count})) + ({count})) % ({count})) // ({count})"


def oracle_sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> str:
    """DuckDB SQL of the same codes, with every distance computed."""
    steps = [f"""
whole AS (SELECT vec_id, label, [CAST(floor({SCALE} * CAST(c AS DOUBLE)) AS BIGINT) FOR c IN embedding] AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
cut AS (SELECT vec_id, part, x[part * len(x) // {parts} + 1 : (part + 1) * len(x) // {parts}] AS v FROM whole, range({parts}) AS t(part)),
book0 AS (SELECT part, entry, v FROM cut JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM whole) USING (vec_id) WHERE entry < {entries})"""]
    for k in range(rounds + 1):
        steps.append(f"""near{k} AS MATERIALIZED (SELECT vec_id, part, v, min(s).entry AS entry, min(s).far AS far FROM (
  SELECT vec_id, c.part, c.v, {{'far': list_sum(list_transform(list_zip(c.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, 'entry': b.entry}} AS s
  FROM cut c JOIN book{k} b ON b.part = c.part) GROUP BY 1, 2, 3)""")
        if k < rounds:
            steps.append(f"""mean{k} AS (SELECT part, entry, list({_floor_div('total', 'n')} ORDER BY pos) AS v FROM (
  SELECT part, entry, pos, sum(v[pos + 1]) AS total, count(*) AS n FROM near{k}, (SELECT unnest(range(max(len(v)))) AS pos FROM cut) GROUP BY 1, 2, 3) GROUP BY 1, 2),
book{k + 1} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(m.v, b.v) AS v FROM book{k} b LEFT JOIN mean{k} m USING (part, entry))""")
    return f"""WITH {','.join(steps)},
coded AS (SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(far)::BIGINT AS error FROM near{rounds} GROUP BY 1),
labelled AS (SELECT vec_id, label, code, error FROM coded JOIN whole USING (vec_id))
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) FROM book{rounds}) AS codebooks_sha256 FROM labelled"""
