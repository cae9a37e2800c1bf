"""Chat formatting of reply trees: iterative self-joins enumerate root-to-leaf paths, the best branches become conversations.

A message belongs to a tree and answers its parent. Ids, parents and scores (narrow rows)
are joined with themselves: each step doubles how far a message sees towards its root, so
a branch of n messages takes log2 n steps. A branch is a leaf with all its ancestors; its
score is the sum of theirs. The ``top`` branches of each tree are spread into their
messages by the same jumps, from the longest to the shortest, meet the texts by (tree,
message), and are sorted by (branch, depth) over range partitions: a tree or branch that
holds a third of all rows is cut by depth and fills many tasks.

Template: ``### role: text</turn>`` and a newline per turn. In roles and texts a backslash
goes before every backslash, ``###`` and ``</turn>`` (in roles also before a colon), so
that markers can not be forged and ``parse`` gives back what went in. A conversation is
one row, or several parts of about ``PART_CHARS`` characters, cut between turns. ``loss``
lists the character ranges of the texts that are trained on.

Null tree ids are one tree, null message ids of a tree one message. A parent that is
null, absent or the message itself makes a root. Rows that share a message id are turns
of one message, in the order of role and text (its parent is the smallest given, its score
the largest), so repeated rows are repeated turns. Messages in a circle of parents have no
root and are on no path. Null roles and texts are empty, null scores 0; branches of equal
score rank by leaf id. Empty tables give no conversations; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from kveil.session import reliable_checkpoint

OPEN, MIDDLE, CLOSE = "### ", ": ", "</turn>\n"
TRAINED = "assistant"
PART_CHARS = 1 << 22
STEP_ROWS = 1 << 17
BLOCK, FIRST = 4096, -(1 << 63)


def escape(text: str, role: bool = False) -> str:
    out = text.replace("\\", "\\\\").replace("###", "\\###").replace("</turn>", "\\</turn>")
    return out.replace(":", "\\:") if role else out


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL) if "\\" in text else text


_ROLE_END = re.compile(r"\\.|: ", re.DOTALL)
_TEXT_END = re.compile(r"\\.|</turn>\n", re.DOTALL)


def _until(pattern: re.Pattern, text: str, at: int) -> int:
    """Where the next marker stands that no backslash covers."""
    while True:
        found = pattern.search(text, at)
        if found is None:
            raise ValueError("the text ends inside a turn")
        if found[0][0] != "\\":
            return found.start()
        at = found.end()


def parse(text: str) -> Iterator[tuple[str, str, int, int]]:
    """Role, text and the range of the (escaped) text of every turn of a formatted conversation."""
    at = 0
    while at < len(text):
        if not text.startswith(OPEN, at):
            raise ValueError("a turn must begin with its marker")
        end = _until(_ROLE_END, text, at + len(OPEN))
        begin = end + len(MIDDLE)
        stop = _until(_TEXT_END, text, begin)
        yield unescape(text[at + len(OPEN) : end]), unescape(text[begin:stop]), begin, stop
        at = stop + len(CLOSE)


def _meets(tree: str = "_t", message: str = "_m", of: str = "message_id") -> Column:
    """Null-safe meeting of (tree_id, ``of``) with the renamed keys of another side."""
    return F.col("tree_id").eqNullSafe(F.col(tree)) & F.col(of).eqNullSafe(F.col(message))


def _keys(df: DataFrame, *others: Column | str) -> DataFrame:
    return df.select(F.col("tree_id").alias("_t"), F.col("message_id").alias("_m"), *others)


def _stored(step: DataFrame, messages: int) -> DataFrame:
    """Store the narrow rows of a step, one per message, in as many partitions as they need.

    A union has the partitions of both sides: left as they are, each step would have more than the one before.
    """
    return reliable_checkpoint(step.coalesce(max(step.sparkSession.sparkContext.defaultParallelism, math.ceil(messages / STEP_ROWS))))


def _links(links: DataFrame) -> tuple[DataFrame, int]:
    """One narrow row per message: its parent, if the tree has it, and its score; and their number."""
    node = links.groupBy("tree_id", "message_id").agg(F.min("parent_id").alias("parent_id"), F.max("score").cast("double").alias("score"))
    proper = F.when(~F.col("parent_id").eqNullSafe(F.col("message_id")), F.col("parent_id"))
    # Both sides of the join read what is stored; the links are worked out once.
    node = reliable_checkpoint(node.select("tree_id", "message_id", proper.alias("parent_id"), F.coalesce("score", F.lit(0.0)).alias("score")))
    # A null parent meets nothing here, not even the message whose id is null.
    known = node.join(_keys(node), F.col("tree_id").eqNullSafe(F.col("_t")) & (F.col("parent_id") == F.col("_m")), "left")
    return known.select("tree_id", "message_id", F.col("_m").alias("parent_id"), "score"), node.count()


def jumps(links: DataFrame) -> list[DataFrame]:
    """Step k: for every message its ancestor ``far`` at ``distance`` 2^k, or its root if that is nearer.

    ``total`` sums the scores from the message to just before ``far``; ``rooted`` tells
    that ``far`` is the root. The last step has only rooted rows.
    """
    answers = F.col("parent_id").isNotNull()
    known, messages = _links(links)
    first = known.select(
        "tree_id", "message_id", F.coalesce("parent_id", "message_id").alias("far"), answers.cast("long").alias("distance"),
        F.when(answers, F.col("score")).otherwise(0.0).alias("total"), (~answers).alias("rooted"), "score",
    )
    steps = [_stored(first, messages)]
    while True:
        now = steps[-1]
        open_ = now.where(~F.col("rooted"))
        if open_.isEmpty():
            return steps
        if 2 ** (len(steps) - 1) > messages:  # further than all messages: a circle
            return [s.join(_keys(open_), _meets(), "left_anti") for s in steps]
        then = _keys(now, F.col("far").alias("_far"), F.col("distance").alias("_distance"), F.col("total").alias("_total"), F.col("rooted").alias("_rooted"))
        moved = open_.join(then, F.col("tree_id").eqNullSafe(F.col("_t")) & (F.col("far") == F.col("_m"))).select(
            "tree_id", "message_id", F.col("_far").alias("far"), (F.col("distance") + F.col("_distance")).alias("distance"),
            (F.col("total") + F.col("_total")).alias("total"), F.col("_rooted").alias("rooted"), "score",
        )
        steps.append(_stored(now.where("rooted").unionByName(moved), messages))


def branches(links: DataFrame, top: int = 1) -> DataFrame:
    """tree_id, leaf_id, rank, length, branch_score, message_id and depth (0: root) of the messages on the ``top`` branches of each tree."""
    steps = jumps(links)
    every = steps[-1]
    parents = steps[0].where("distance > 0").select(F.col("tree_id").alias("_t"), F.col("far").alias("_m")).distinct()
    roots = _keys(every.where("distance = 0"), F.col("score").alias("_score"))
    scored = every.join(parents, _meets(), "left_anti").join(roots, _meets(of="far")).select(
        "tree_id", F.col("message_id").alias("leaf_id"), (F.col("distance") + 1).alias("length"), (F.col("total") + F.col("_score")).alias("branch_score")
    )
    best = Window.partitionBy("tree_id").orderBy(F.desc("branch_score"), "leaf_id")
    path = scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top).withColumns(
        {"message_id": F.col("leaf_id"), "depth": F.col("length") - 1}
    )
    # Every distance is a sum of distinct powers of two: each jump is taken from all messages found before.
    for k in range(len(steps) - 1, -1, -1):
        far = _keys(steps[k].where(F.col("distance") == 2**k), "far")
        here = F.struct("message_id", "depth")
        there = F.struct(F.col("far").alias("message_id"), (F.col("depth") - 2**k).alias("depth"))
        both = F.when(F.col("far").isNull(), F.array(here)).otherwise(F.array(here, there))
        path = path.join(far, _meets(), "left").select("tree_id", "leaf_id", "rank", "length", "branch_score", F.explode(both).alias("at")).select(
            "tree_id", "leaf_id", "rank", "length", "branch_score", "at.message_id", "at.depth"
        )
    return path


SCHEMA = (
    "tree_id {tree}, leaf_id {message}, rank int, branch_score double, first_depth long, part int, whole boolean, n_turns long, "
    "formatted string, loss array<struct<start: long, stop: long>>"
)


def _format(part_chars: int, schema: pa.Schema):
    """Rows sorted by (tree, leaf, depth, role, text) to parts of conversations."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = None
        head: dict = {}
        texts: list[str] = []
        loss: list[dict] = []
        size = number = last = 0

        def part(ends: bool) -> pa.RecordBatch:
            whole = number == 0 and head["depth"] == 0 and ends and last == head["length"] - 1
            row = [head["tree_id"], head["leaf_id"], head["rank"], head["branch_score"], head["depth"], number, whole, len(texts), "".join(texts), loss]
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema)], schema=schema)

        for row in _rows(batches):
            now = (row["tree_id"], row["leaf_id"])
            if texts and (now != key or size >= part_chars):
                yield part(now != key)
                number = number + 1 if now == key else 0
                texts, loss, size = [], [], 0
            if not texts:
                head = row
            key, last = now, row["depth"]
            begin = OPEN + escape(row["role"], role=True) + MIDDLE
            body = escape(row["text"])
            if row["role"] == TRAINED:
                loss.append({"start": size + len(begin), "stop": size + len(begin) + len(body)})
            texts.append(begin + body + CLOSE)
            size += len(begin) + len(body) + len(CLOSE)
        if texts:
            yield part(True)

    return run


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(0, batch.num_rows, 64):
            yield from batch.slice(i, 64).to_pylist()


def _types(df: DataFrame) -> dict[str, str]:
    return {"tree": df.schema["tree_id"].dataType.simpleString(), "message": df.schema[df.columns[1]].dataType.simpleString()}


def format_branches(texts: DataFrame, links: DataFrame | None = None, top: int = 1, part_chars: int = PART_CHARS) -> DataFrame:
    """The ``top`` branches of each tree as formatted conversations with loss ranges.

    ``texts``: tree_id, message_id, role, text. ``links``: tree_id, message_id, parent_id,
    score, taken from ``texts`` if not given. Ids of messages and parents are of one type.
    ``whole`` tells that a row is its whole conversation; else the rows of (tree_id,
    leaf_id) follow each other by (first_depth, part).
    """
    path = branches((texts if links is None else links).select("tree_id", "message_id", "parent_id", "score"), top)
    path = _keys(path, "leaf_id", "rank", "branch_score", "length", "depth")
    said = texts.select("tree_id", "message_id", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = said.join(path, _meets()).drop("_t", "_m", "message_id")
    # Rows of one (branch, depth) share a partition, so a partition's border is a border between messages.
    spread = rows.repartitionByRange("tree_id", "leaf_id", "depth").sortWithinPartitions("tree_id", "leaf_id", "depth", "role", "text")
    schema = StructType.fromDDL(SCHEMA.format(**_types(said)))
    return spread.mapInArrow(_format(part_chars, to_arrow_schema(schema)), schema)


class _Digest:
    """Running checksums of one conversation."""

    def __init__(self):
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.formatted_chars = 0

    def add(self, formatted: str, loss: list[dict]) -> None:
        for role, text, _, _ in parse(formatted):
            self.turns.update(f"{role}\n{text}\n".encode())
            self.n_turns += 1
        for span in loss:
            text = unescape(formatted[span["start"] : span["stop"]])
            self.loss.update(text.encode())
            self.loss_chars += len(text)
        self.formatted_chars += len(formatted)

    def row(self) -> list:
        return [self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.formatted_chars]


DIGEST = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _digests(schema: pa.Schema):
    """Rows of one conversation follow each other; nothing but the running checksums is held."""

    def batch_of(done: list[list]) -> pa.RecordBatch:
        columns = list(zip(*done)) or [()] * len(schema)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, at, done = None, None, []
        for row in _rows(batches):
            now = (row["tree_id"], row["leaf_id"])
            if at is not None and now != key:
                done.append([*key, *at.row()])
                at = None
                if len(done) == 1000:
                    yield batch_of(done)
                    done = []
            if at is None:
                key, at = now, _Digest()
            at.add(row["formatted"], row["loss"])
        if at is not None:
            done.append([*key, *at.row()])
        yield batch_of(done)

    return run


def read_back(conversations: DataFrame) -> DataFrame:
    """Turns and trained texts of stored conversations, parsed from the formatted text: counts and checksums.

    Whole conversations are read where they lie; only the parts of longer ones are
    brought together, in order, and pass one after the other.
    """
    names = ["tree_id", "leaf_id"]
    schema = StructType.fromDDL("tree_id {tree}, leaf_id {message}, ".format(**_types(conversations)) + DIGEST)
    digests = _digests(to_arrow_schema(schema))
    columns = [*names, "formatted", "loss"]
    parts = conversations.where("NOT whole").repartition(*names).sortWithinPartitions(*names, "first_depth", "part")
    return conversations.where("whole").select(columns).mapInArrow(digests, schema).unionByName(parts.select(columns).mapInArrow(digests, schema))


def chains(rows: DataFrame, tree: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Texts and links of linear conversations: each turn answers the one before it; a null turn comes first.

    Only the keys are sorted, in blocks of ``BLOCK`` turn numbers, so that a conversation of any length is many groups.
    """
    number = F.coalesce(F.col(order).cast("long"), F.lit(FIRST))
    texts = rows.select(F.col(tree).alias("tree_id"), number.alias("message_id"), F.col(role).alias("role"), F.col(text).alias("text"))
    turns = texts.select("tree_id", "message_id", F.floor(F.col("message_id") / BLOCK).alias("block")).distinct()
    within = F.lag("message_id").over(Window.partitionBy("tree_id", "block").orderBy("message_id"))
    ends = turns.groupBy("tree_id", "block").agg(F.max("message_id").alias("end"))
    before = ends.select(
        F.col("tree_id").alias("_t"), F.col("block").alias("_m"), F.lag("end").over(Window.partitionBy("tree_id").orderBy("block")).alias("_end")
    ).where("_end IS NOT NULL")
    linked = turns.withColumn("_within", within).join(before, _meets(of="block"), "left")
    return texts, linked.select("tree_id", "message_id", F.coalesce("_within", "_end").alias("parent_id"), F.lit(0.0).alias("score"))


def oracle_sql(extra: str) -> str:
    """DuckDB SQL of the digests of ``conversations`` and the rows ``extra``."""
    def escaped(text: str) -> str:
        return f"replace(replace(replace({text}, '\\', '\\\\'), '###', '\\###'), '</turn>', '\\</turn>')"

    order = "ORDER BY turn NULLS FIRST, role, text"
    return f"""WITH turns AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM (
  SELECT conv_id, turn, role, text FROM conversations UNION ALL {extra}))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' {order})) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = '{TRAINED}'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' {order}) FILTER (role = '{TRAINED}'), '')) AS loss_sha256,
  sum({len(OPEN + MIDDLE + CLOSE)} + length(replace({escaped('role')}, ':', '\\:')) + length({escaped('text')}))::BIGINT AS formatted_chars
FROM turns GROUP BY conv_id"""
