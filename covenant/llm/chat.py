"""Chat formatting from reply trees: paths from root to leaf, branches ranked by score, one conversation per chosen path.

Messages point to the message they answer. Which messages a leaf's path holds is found by self-joins that double their
reach: after k rounds every message knows its ancestor 2^k steps up, and the path of each chosen leaf grows by the
ancestors of its members. A tree of depth n takes log2(n) rounds, and no round makes more rows than there are messages
plus members of chosen paths. Leaves are ranked per tree by the sum of the scores along their paths, which the same
doubling adds up.

The template. A turn is `<s>[role]text[/]</s>`. Inside texts and roles a backslash and a letter stand for each `<`, `[`
and `]`, and a backslash and a dash for a backslash, so no text can forge a mark, and all is read back exactly. The loss
mask is the stretch of each assistant text, kept as spans of the formatted string.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from covenant.llm.common import settled

LEARNT = "assistant"
_OPEN, _CLOSE = "<s>[", "[/]</s>"
#: What stands for the characters that marks are made of; the backslash comes first, and last on the way back.
_CODES = [("\\", "\\-"), ("<", "\\l"), ("[", "\\o"), ("]", "\\c")]


def escaped(text: str) -> str:
    for plain, code in _CODES:
        text = text.replace(plain, code)
    return text


def unescaped(text: Column) -> Column:
    for plain, code in reversed(_CODES):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation of (role, text) and the stretches of it that the loss covers."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{_OPEN}{escaped(role)}]", escaped(text)
        if role == LEARNT:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, _CLOSE]
        at += len(head) + len(body) + len(_CLOSE)
    return "".join(parts), spans


def parsed(formatted: Column) -> Column:
    """The turns of a formatted conversation as an array of (role, text). No text or role holds a mark or its parts."""
    parts = F.split(formatted, r"\[/\]</s>")

    def turn(part: Column) -> Column:
        end = F.instr(part, F.lit("]"))
        role = F.substring(part, F.lit(len(_OPEN) + 1), end - (len(_OPEN) + 1))
        return F.struct(unescaped(role).alias("role"), unescaped(F.substring(part, end + 1, F.length(part))).alias("text"))

    return F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), turn)


def paths(messages: DataFrame, best: int = 1) -> DataFrame:
    """(tree, path_rank, leaf, depth, message): the messages on the best paths of each tree, the root at depth 0.

    messages: (message, parent, score), message unique. A parent that is null or no message makes a root; a null score
    counts as zero. Paths rank by their sum of scores, then by the smaller leaf. Messages above which parents go round
    in a circle have no root and are on no path.
    """
    nodes = messages.select("message", "parent", F.coalesce("score", F.lit(0.0)).cast("double").alias("score"))
    known = nodes.select(F.col("message").alias("parent"))
    nodes = settled(
        nodes.join(known.withColumn("found", F.lit(True)), "parent", "left").select(
            "message", F.when(F.col("found"), F.col("parent")).alias("parent"), "score"
        )
    )
    # up: the ancestor `steps` up while there is one; total and depth: of the messages passed on the way, itself included
    reach = nodes.select("message", F.col("parent").alias("up"), F.col("score").alias("total"), F.lit(1).alias("depth"), F.col("message").alias("top"))
    jumps = [nodes.where("parent IS NOT NULL").select("message", F.col("parent").alias("up"))]
    arrived, pending = [reach.where("up IS NULL")], reach.where("up IS NOT NULL")
    rounds = max(nodes.count(), 1).bit_length()
    for _ in range(rounds):
        # those on the way step on by what the one they have reached has passed; the others are done and stay as they are
        ahead = reduce(DataFrame.unionByName, [*arrived, pending]).select(*(F.col(c).alias(f"{c}_") for c in reach.columns))
        stepped = settled(
            pending.join(ahead, F.col("up") == F.col("message_")).select(
                "message",
                F.col("up_").alias("up"),
                (F.col("total") + F.col("total_")).alias("total"),
                (F.col("depth") + F.col("depth_")).alias("depth"),
                F.col("top_").alias("top"),
            )
        )
        arrived.append(stepped.where("up IS NULL"))
        pending = stepped.where("up IS NOT NULL")
        if pending.isEmpty():
            break
        jumps.append(pending.select("message", "up"))
    reach = reduce(DataFrame.unionByName, arrived)
    parents = nodes.where("parent IS NOT NULL").select(F.col("parent").alias("message")).distinct()
    order = Window.partitionBy("top").orderBy(F.desc("total"), "message")
    leaves = reach.join(parents, "message", "left_anti").withColumn("path_rank", F.row_number().over(order))
    chosen = leaves.where(F.col("path_rank") <= best)
    members = chosen.select(F.col("top").alias("tree"), "path_rank", F.col("message").alias("leaf"), "message")
    for jump in jumps:
        members = members.unionByName(members.join(jump, "message").select("tree", "path_rank", "leaf", F.col("up").alias("message")))
        members = settled(members)
    return members.join(reach.select("message", (F.col("depth") - 1).alias("depth")), "message")


def conversations_as_trees(turns: DataFrame) -> DataFrame:
    """(message, parent, score, conv_id, role, text) for turns (conv_id, turn, role, text): each row answers the one before.

    Rows of a conversation go by turn, then role, then text, nulls first, so repeated rows stay apart. Null texts and
    roles are empty; a null conv_id is a conversation of its own.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = turns.select("conv_id", "turn", "role", "text").withColumn("place", F.row_number().over(order))
    key = lambda place: F.struct(F.col("conv_id"), place.alias("place"))
    return rows.select(
        key(F.col("place")).alias("message"),
        F.when(F.col("place") > 1, key(F.col("place") - 1)).alias("parent"),
        F.lit(0.0).alias("score"),
        "conv_id",
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )


def format_paths(messages: DataFrame, best: int = 1) -> DataFrame:
    """(tree, path_rank, formatted, spans): a formatted conversation for each chosen path of messages.

    messages: (message, parent, score, role, text). spans: where in it the loss applies, [start, end) in characters.
    One conversation is one string and must fit in a task. An empty table gives an empty result.
    """
    texts = messages.select("message", "role", "text")
    turns = paths(messages, best).join(texts, "message")
    whole = turns.groupBy("tree", "path_rank").agg(F.array_sort(F.collect_list(F.struct("depth", "role", "text"))).alias("turns"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [render([(t["role"], t["text"]) for t in turns.as_py()]) for turns in batch.column(2)]
            spans = pa.array([[list(span) for span in spans] for _, spans in made], pa.list_(pa.list_(pa.int64())))
            columns = [batch.column(0), batch.column(1), pa.array([text for text, _ in made], pa.string()), spans]
            yield pa.RecordBatch.from_arrays(columns, names=["tree", "path_rank", "formatted", "spans"])

    kind = whole.schema["tree"].dataType.simpleString()
    return whole.mapInArrow(each, f"tree {kind}, path_rank int, formatted string, spans array<array<long>>")


def digests(formatted: DataFrame) -> DataFrame:
    """(tree, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), read back from format_paths()."""
    text = F.col("formatted")
    under = lambda span: unescaped(F.substring(text, (span[0] + 1).cast("int"), (span[1] - span[0]).cast("int")))
    read = formatted.select("tree", text, parsed(text).alias("turns"), F.array_join(F.transform("spans", under), "").alias("learnt"))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "tree",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(whole, 256).alias("turns_sha256"),
        F.length("learnt").cast("long").alias("loss_chars"),
        F.sha2("learnt", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
