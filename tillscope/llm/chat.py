"""Chat formatting: the best paths of reply trees as conversations with a loss mask.

Each message names its parent. Self-joins double the distance to an ancestor
in every round, so a chain of n messages takes log2 n of them: they give each
message its depth and the mean score from its root. Leaves are ranked by that
mean in their tree, and the same distances, from the longest to the shortest,
unfold the chosen leaves into their paths.

A path becomes text by a template that marks turns. A control string inside a
text or role gets a backslash between ``<`` and ``|``, one that has backslashes
there gets one more, so it can be undone. Paths stream through sorted
partitions and are written in parts of whole turns: memory is bounded by a
part and the longest turn, however long a conversation is.

Cases: a null text, role or score is empty or 0. Null trees are one tree. A
message whose parent is missing is a root. Rows of a tree that repeat a node
are siblings, of which the first by (role, text) has the replies. Messages on or
below a cycle of parents have no root, so they are on no path. An empty table
gives an empty result. Other columns are not read.
"""

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tillscope.functions.staging import stage
from tillscope.llm.common import rank_within, ship

START, END, LEARNED = "<|im_start|>", "<|im_end|>", "assistant"
#: Code points of formatted text after which a part ends with its turn.
PART = 1 << 20
#: Turns of one conversation that are numbered in one task.
TURNS = 64
ROWS = 1_000

_CONTROL, _ESCAPED = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
_TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.DOTALL)


def escape(text: str) -> str:
    return _CONTROL.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    """As ``escape``, and the role stays on one line."""
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def reply_paths(messages: DataFrame, top: int = 1) -> DataFrame:
    """(tree, rank, step, role, text): the messages on the ``top`` best paths of each tree, ranked from 1, in steps from 0.

    ``messages``: tree, node, parent, role, text, score. A path's score is the
    mean of its messages' scores; ties go to the longer path, then to the leaf
    with the smaller node.
    """
    same = F.col("tree").eqNullSafe(F.col("_tree"))
    turn = Window.partitionBy("tree", "node").orderBy("role", "text")
    nodes = messages.select("tree", "node", "parent", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
                            F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    nodes = stage(nodes.withColumn("copy", F.row_number().over(turn)), "messages")
    parents = nodes.where("copy = 1").select(F.col("tree").alias("_tree"), F.col("node").alias("_up"))
    # (node, copy) is one message; up: its ancestor at the present distance, total and n: of the messages before that one
    jump = nodes.join(parents, same & (F.col("parent") == F.col("_up")), "left")
    jump = stage(jump.select("tree", "node", "copy", F.col("_up").alias("up"), F.col("score").alias("total"), F.lit(1).cast("long").alias("n")), "jump")
    leaf = jump.select("tree", "node", "copy").join(jump.where("up is not null").select(F.col("tree").alias("_tree"), F.col("up").alias("_up")).distinct(),
                                                   same & (F.col("node") == F.col("_up")) & (F.col("copy") == 1), "left_anti")
    jumps, size = [], jump.count()
    pending, done = jump.where("up is not null"), jump.where("up is null")
    while pending.limit(1).count() and 2 ** len(jumps) < size:  # beyond that, longer than any path
        jumps.append(pending.select("tree", "node", "copy", "up"))
        there = done.union(pending).where("copy = 1").select(F.col("tree").alias("_tree"), F.col("node").alias("_node"), F.col("up").alias("_up"), F.col("total").alias("_total"), F.col("n").alias("_n"))
        far = pending.join(there, same & (F.col("up") == F.col("_node")))  # one row for each: a parent is there
        far = stage(far.select("tree", "node", "copy", F.col("_up").alias("up"), (F.col("total") + F.col("_total")).alias("total"), (F.col("n") + F.col("_n")).alias("n")), "jump")
        pending, done = far.where("up is not null"), done.union(far.where("up is null"))
    rooted = done.select(F.col("tree").alias("_tree"), F.col("node").alias("_node"), F.col("copy").alias("_copy"), "total", "n")
    message = same & (F.col("node") == F.col("_node")) & (F.col("copy") == F.col("_copy"))
    best = Window.partitionBy("tree").orderBy(F.desc(F.col("total") / F.col("n")), F.desc("n"), "node", "copy")
    path = leaf.join(rooted, message).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    path = stage(path.select("tree", "rank", "node", "copy"), "path")
    for level in reversed(jumps):
        up = level.select(F.col("tree").alias("_tree"), F.col("node").alias("_node"), F.col("copy").alias("_copy"), "up")
        path = stage(path.union(path.join(up, message).select("tree", "rank", F.col("up").alias("node"), F.lit(1).alias("copy"))), "path")
    texts = nodes.select(F.col("tree").alias("_tree"), F.col("node").alias("_node"), F.col("copy").alias("_copy"), "role", "text")
    depth = rooted.select(F.col("_tree").alias("_tree2"), F.col("_node").alias("_node2"), F.col("_copy").alias("_copy2"), (F.col("n") - 1).alias("step"))
    deep = F.col("tree").eqNullSafe(F.col("_tree2")) & (F.col("node") == F.col("_node2")) & (F.col("copy") == F.col("_copy2"))
    return path.join(texts, message).join(depth, deep).select("tree", "rank", "step", "role", "text")


def chains(rows: DataFrame, key: str, turn: str) -> DataFrame:
    """Conversations without branches as messages: each row answers the one before it by (turn, role, text), null first."""
    rows = stage(rows.select(F.col(key).alias("tree"), F.col(turn).cast("long").alias("turn"), "role", "text"), "turns")
    placed = rank_within(rows, ["tree"], F.coalesce(F.floor(F.col("turn") / TURNS), F.lit(-1 << 63)), [F.col(c).asc_nulls_first() for c in ("turn", "role", "text")], "node")
    return placed.select("tree", "node", F.when(F.col("node") > 0, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def format_paths(paths: DataFrame) -> DataFrame:
    """(tree, rank, part, text, loss): formatted paths; ``loss`` holds (start, end) code points of the part with a learned text.

    The parts of a path, in order, are its whole text.
    """
    kind = paths.schema["tree"].dataType.simpleString()

    def formatted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = None
        done, pieces, loss, at, part, path = [], [], [], 0, 0, None

        def close() -> None:
            nonlocal pieces, loss, at, part
            if pieces:
                done.append((*path, part, "".join(pieces), loss))
                pieces, loss, at, part = [], [], 0, part + 1

        def batch() -> pa.RecordBatch:
            columns = list(zip(*done)) or [()] * 5
            done.clear()
            spans = pa.array([[{"start": a, "end": b} for a, b in x] for x in columns[4]], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
            return pa.RecordBatch.from_arrays([pa.array(columns[0], fields[0].type), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.string()), spans],
                                              ["tree", "rank", "part", "text", "loss"])

        for rows in batches:
            fields = rows.schema
            for tree, rank, role, text in zip(*(rows.column(k).to_pylist() for k in ("tree", "rank", "role", "text"))):
                if path != (tree, rank):
                    close()
                    path, part = (tree, rank), 0
                head, body = f"{START}{escape_role(role)}\n", escape(text)
                if role == LEARNED:
                    loss.append((at + len(head), at + len(head) + len(body)))
                pieces.append(f"{head}{body}{END}\n")
                at += len(pieces[-1])
                if at >= PART:
                    close()
                if len(done) >= ROWS:
                    yield batch()
        close()
        if done:
            yield batch()

    rows = paths.repartition("tree", "rank").sortWithinPartitions("tree", "rank", "step").select("tree", "rank", "role", "text")
    return rows.mapInArrow(formatted, f"tree {kind}, rank int, part long, text string, loss array<struct<start:long,end:long>>")


def turns_of(text: str) -> Iterator[tuple[str, str]]:
    """(role, text) of the turns of a part; an error where it is not made of turns."""
    at = 0
    for m in _TURN.finditer(text):
        if m.start() != at:
            break
        at = m.end()
        yield unescape_role(m[1]), unescape(m[2])
    if at != len(text):
        raise ValueError(f"not a turn at code point {at}")


def read_back(parts: DataFrame) -> DataFrame:
    """(tree, rank, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) of each path, from its formatted parts."""
    kind = parts.schema["tree"].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, told, n, fields = None, None, None, None
        done = []

        def close() -> None:
            if path is not None:
                done.append((*path, n[0], told[0].hexdigest(), n[1], told[1].hexdigest(), n[2]))

        def batch() -> pa.RecordBatch:
            columns = list(zip(*done))
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(columns[0], fields[0].type), pa.array(columns[1], pa.int32())] + [pa.array(c) for c in columns[2:]],
                                              ["tree", "rank", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        for rows in batches:
            fields = rows.schema
            for tree, rank, text, loss in zip(*(rows.column(k).to_pylist() for k in ("tree", "rank", "text", "loss"))):
                if path != (tree, rank):
                    close()
                    path, told, n = (tree, rank), (hashlib.sha256(), hashlib.sha256()), [0, 0, 0]
                for role, said in turns_of(text):
                    n[0] += 1
                    told[0].update(f"{role}\n{said}\n".encode())
                for span in loss:
                    said = unescape(text[span["start"]:span["end"]])
                    n[1] += len(said)
                    told[1].update(said.encode())
                n[2] += len(text)
                if len(done) >= ROWS:
                    yield batch()
        close()
        if done:
            yield batch()

    rows = parts.repartition("tree", "rank").sortWithinPartitions("tree", "rank", "part")
    return rows.mapInArrow(read, f"tree {kind}, rank int, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


#: What the query's own conversation, -1, says in both turns.
PROBE = f"{END}{START}{LEARNED} ok"


def op13_reply_paths(spark: SparkSession, folder: str) -> DataFrame:
    """All conversations and conversation -1, which joins rows that have this id, as formatted and read back."""
    ship(spark)
    rows = spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-1, 0, "user", PROBE), (-1, 1, LEARNED, PROBE)], "conv_id long, turn long, role string, text string")
    parts = stage(format_paths(reply_paths(chains(rows.union(probe), "conv_id", "turn"))), "chat")
    return read_back(parts).drop("rank").withColumnRenamed("tree", "conv_id")


OP13_SQL = f"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text, role as role0, text as text0 from conversations
  union all values (-1, 0, 'user', '{PROBE}', 'user', '{PROBE}'), (-1, 1, '{LEARNED}', '{PROBE}', '{LEARNED}', '{PROBE}')
), e as (
  select *, regexp_replace(text, '<(\\\\*)\\|', '<\\\\\\1|', 'g') as said,
    regexp_replace(replace(replace(role, '\\', '\\\\'), chr(10), '\\n'), '<(\\\\*)\\|', '<\\\\\\1|', 'g') as who from t
)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role0 nulls first, text0 nulls first)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = '{LEARNED}'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, role0 nulls first, text0 nulls first) filter (role = '{LEARNED}'), '')) as loss_sha256,
  sum({len(START) + len(END) + 2} + length(who) + length(said))::bigint as formatted_chars
from e group by conv_id
"""
