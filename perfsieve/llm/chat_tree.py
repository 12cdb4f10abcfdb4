"""Chat formatting as a prefix tree: turns that conversations share from the start are written once.

Every turn is known by a digest of its conversation up to it, so equal digests are equal prefixes.
Conversations, as lists of these digests, are dealt by range and sorted; neighbours then share
their longest prefixes, and what a conversation does not share with the one before it are the new
nodes, in depth-first order. A shard (one range, one file) is a sequence of its own: a prefix that
reaches over its border is written again at the start of the next shard.

Each node carries its place in the shard's sequence, the position of its first character in its own
conversation, and the intervals of the sequence that hold its ancestors: exactly what it attends to
besides itself. Offsets, positions and intervals count characters of the formatted text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from perfsieve.llm.common import join_by_size, table
from perfsieve.session import materialize, work_folder

# Strings that steer the model; they mark turns and must not come from a text.
CONTROL = ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<<ROLE>>", "<</ROLE>>"]
OPEN = {"user": "<s>[INST] ", "assistant": "<s> ", "system": "<s><<SYS>> "}
CLOSE = {"user": " [/INST]", "assistant": " </s>", "system": " <</SYS>>"}
LEARNED_ROLE = "assistant"

_RAW = re.compile(r"\\|" + "|".join(map(re.escape, CONTROL)))
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)


def escape(text: str) -> str:
    """``text`` without control strings: a backslash breaks each after its first character, and doubles itself."""
    return _RAW.sub(lambda m: "\\\\" if m[0] == "\\" else m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[1], text)


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """(formatted turn, start and end of its text inside)."""
    before = OPEN.get(role, f"<s><<ROLE>>{escape(role)}<</ROLE>> ")
    inner = escape(text)
    return before + inner + CLOSE.get(role, " </s>"), len(before), len(before) + len(inner)


TURNS = "conv_id long, place long, node string, role string, text string, length long"
_TURNS = pa.schema(
    [("conv_id", pa.int64()), ("place", pa.int64()), ("node", pa.string()), ("role", pa.string()), ("text", pa.string()), ("length", pa.int64())]
)


def _name_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Turns in order of (conversation, turn) with their place and the digest of the prefix they end."""
    conversation, place, state = object(), 0, None
    for batch in batches:
        out = []
        for conv_id, role, text in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
            if conv_id != conversation:
                conversation, place, state = conv_id, 0, hashlib.sha256()
            # Lengths first, so no two different prefixes feed the digest the same bytes.
            role_bytes, text_bytes = role.encode(), text.encode()
            state.update(b"%d %d " % (len(role_bytes), len(text_bytes)) + role_bytes + text_bytes)
            out.append((conv_id, place, state.hexdigest()[:32], role, text, len(format_turn(role, text)[0])))
            place += 1
        if out:
            columns = [pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _TURNS, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, schema=_TURNS)


PLACED = (
    "conv_id long, place long, shard int, number long, offset long, position long,"
    " ancestors array<struct<start: long, end: long>>, leaf string"
)
_PLACED = pa.schema(
    [
        ("conv_id", pa.int64()),
        ("place", pa.int64()),
        ("shard", pa.int32()),
        ("number", pa.int64()),
        ("offset", pa.int64()),
        ("position", pa.int64()),
        ("ancestors", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
        ("leaf", pa.string()),
    ]
)


def _place_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """New nodes of sorted conversations, depth first, with their place in the shard's sequence."""
    shard, number, offset = TaskContext.get().partitionId(), 0, 0
    # Of the conversation before: (node, offset, length) from the root.
    path: list[tuple[str, int, int]] = []
    for batch in batches:
        out = []
        for conv_id, turns in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            shared = 0
            while shared < min(len(path), len(turns)) and path[shared][0] == turns[shared]["node"]:
                shared += 1
            del path[shared:]
            position = sum(length for _, _, length in path)
            spans: list[dict] = []
            for _, start, length in path:
                _extend(spans, start, length)
            for place in range(shared, len(turns)):
                node, length = turns[place]["node"], turns[place]["length"]
                leaf = node if place == len(turns) - 1 else None
                out.append((conv_id, place, shard, number, offset, position, [dict(s) for s in spans], leaf))
                path.append((node, offset, length))
                _extend(spans, offset, length)
                number, offset, position = number + 1, offset + length, position + length
            if shared == len(turns) and turns:
                raise ValueError("a conversation that is a prefix of the one before sorts before it")
        if out:
            columns = [pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _PLACED, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, schema=_PLACED)


def _extend(spans: list[dict], start: int, length: int) -> None:
    """Add an interval that begins where the last one ends, or later."""
    if spans and spans[-1]["end"] == start:
        spans[-1]["end"] = start + length
    else:
        spans.append({"start": start, "end": start + length})


PACKED = (
    "shard int, number long, leaf string, role string, formatted string, text_start long, text_end long,"
    " offset long, position long, ancestors array<struct<start: long, end: long>>, learned boolean"
)
_PACKED = pa.schema(
    [
        ("shard", pa.int32()),
        ("number", pa.int64()),
        ("leaf", pa.string()),
        ("role", pa.string()),
        ("formatted", pa.string()),
        ("text_start", pa.int64()),
        ("text_end", pa.int64()),
        ("offset", pa.int64()),
        ("position", pa.int64()),
        ("ancestors", _PLACED.field("ancestors").type),
        ("learned", pa.bool_()),
    ]
)


def _format_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        column = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
        roles = column["role"].to_pylist()
        formatted, starts, ends = [], [], []
        for role, text in zip(roles, column["text"].to_pylist(), strict=True):
            whole, start, end = format_turn(role, text)
            formatted.append(whole)
            starts.append(start)
            ends.append(end)
        made = {"formatted": formatted, "text_start": starts, "text_end": ends, "learned": [r == LEARNED_ROLE for r in roles]}
        columns = [pa.array(made[f.name], f.type) if f.name in made else column[f.name] for f in _PACKED]
        yield pa.RecordBatch.from_arrays(columns, names=_PACKED.names)


def write_tree(
    conversations: DataFrame,
    path: str,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> None:
    """Write ``path``/nodes (the packed sequences) and ``path``/conversations (conv_id, leaf).

    Turns are ordered by turn, then role, then text; null texts and roles are empty, a null turn
    comes first, and a null conv_id is one more conversation. Repeated rows are turns of their own.
    An empty table leaves no rows; other columns are not read. A conversation's turns pass one task
    as a stream (its digest needs them in order); what is held of it are its turns' digests.
    """
    spark = conversations.sparkSession
    rows = conversations.select(
        F.col(conv_col).cast("long").alias("conv_id"),
        F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(role_col), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    order = ["conv_id", "turn", "role", "text"]
    turns = rows.repartition("conv_id").sortWithinPartitions(*order).mapInArrow(_name_nodes, TURNS)
    turns = materialize(turns, "chat-turns")
    paths = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("place", "node", "length"))).alias("turns"))
    paths = paths.select("conv_id", F.transform("turns", lambda t: F.struct(t["node"].alias("node"), t["length"].alias("length"))).alias("turns"))
    ends = F.element_at("turns", -1)["node"]
    leaves = materialize(paths.select("conv_id", ends.alias("leaf")), "chat-leaves")
    leaves.write.parquet(f"{path}/conversations")
    first = leaves.groupBy("leaf").agg(F.min("conv_id").alias("f_id")).withColumnRenamed("leaf", "f_leaf")
    # One conversation of each content; a null id can only stand for itself.
    distinct = paths.withColumn("leaf", ends).join(
        first, (F.col("leaf") == F.col("f_leaf")) & F.col("conv_id").eqNullSafe(F.col("f_id")), "left_semi"
    )
    sorted_paths = distinct.select("conv_id", "turns").repartitionByRange("turns").sortWithinPartitions("turns")
    placed = materialize(sorted_paths.mapInArrow(_place_nodes, PLACED), "chat-places").withColumnRenamed("conv_id", "p_id").withColumnRenamed("place", "p_place")
    texts = turns.select("conv_id", "place", "role", "text")
    nodes = placed.join(texts, F.col("p_id").eqNullSafe(F.col("conv_id")) & (F.col("p_place") == F.col("place")))
    nodes = nodes.select("shard", "number", "leaf", "role", "text", "offset", "position", "ancestors")
    packed = nodes.repartition("shard").sortWithinPartitions("shard", "number").mapInArrow(_format_nodes, PACKED)
    packed.write.option("compression", "zstd").parquet(f"{path}/nodes")


LEAVES = (
    "leaf string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
)
_LEAVES = pa.schema(
    [
        ("leaf", pa.string()),
        ("n_turns", pa.int64()),
        ("turns_sha256", pa.string()),
        ("loss_chars", pa.int64()),
        ("loss_sha256", pa.string()),
        ("formatted_chars", pa.int64()),
    ]
)


def _parse(formatted: str) -> str:
    """The role a formatted turn begins with."""
    for role, mark in OPEN.items():
        if role != "assistant" and formatted.startswith(mark):
            return role
    if formatted.startswith("<s><<ROLE>>"):
        return unescape(formatted[len("<s><<ROLE>>") : formatted.index("<</ROLE>>")])
    return "assistant"


def _read_leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Walk the nodes of each shard depth first; digests go on from the ancestor's, so shared turns are read once."""
    shard = None
    # Per ancestor: its interval, then turns, digest of turns, learned characters, their digest, length up to its end.
    path: list[tuple] = []
    for batch in batches:
        out = []
        names = ["shard", "leaf", "formatted", "text_start", "text_end", "offset", "position", "ancestors", "learned"]
        columns = [batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names]
        for at, leaf, formatted, start, end, offset, position, ancestors, learned in zip(*columns, strict=True):
            if at != shard:
                shard, path = at, []
            covered = ancestors[-1]["end"] if ancestors else 0
            while path and path[-1][1] > covered:
                path.pop()
            if sum(a["end"] - a["start"] for a in ancestors) != position or (path[-1][6] if path else 0) != position:
                raise ValueError("a node's position differs from its ancestors")
            turns, all_turns, chars, loss = path[-1][2:6] if path else (0, hashlib.sha256(), 0, hashlib.sha256())
            text = unescape(formatted[start:end])
            all_turns = all_turns.copy()
            all_turns.update(f"{_parse(formatted)}\n{text}\n".encode())
            if learned:
                loss = loss.copy()
                loss.update(text.encode())
                chars += len(text)
            length = position + len(formatted)
            path.append((offset, offset + len(formatted), turns + 1, all_turns, chars, loss, length))
            if leaf is not None:
                out.append((leaf, turns + 1, all_turns.hexdigest(), chars, loss.hexdigest(), length))
        if out:
            made = [pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _LEAVES, strict=True)]
            yield pa.RecordBatch.from_arrays(made, schema=_LEAVES)


def read_tree(spark: SparkSession, path: str) -> DataFrame:
    """Per conversation, from the written sequences: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    nodes = spark.read.parquet(f"{path}/nodes").select(
        "shard", "number", "leaf", "formatted", "text_start", "text_end", "offset", "position", "ancestors", "learned"
    )
    ordered = nodes.repartition("shard").sortWithinPartitions("shard", "number")
    found = ordered.mapInArrow(_read_leaves, LEAVES)
    members = spark.read.parquet(f"{path}/conversations")
    counts = members.groupBy(F.col("leaf").alias("m_leaf")).agg(F.count(F.lit(1)).alias("size"))
    leaves = materialize(found.join(counts, F.col("leaf") == F.col("m_leaf")).drop("m_leaf"), "chat-read")
    return join_by_size(members, leaves, "leaf", "size", F.xxhash64("conv_id")).drop("leaf", "size")


def _query(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame(
        [(-1, 0, "user", told), (-1, 1, "assistant", told)], "conv_id long, turn long, role string, text string"
    )
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    path = work_folder(spark, "chat-tree")
    write_tree(rows.unionByName(extra), path)
    return read_tree(spark, path)


def _sql_escaped(text: str) -> str:
    """The length of the escaped text in SQL: each backslash and each control string adds a character."""
    added = f"length({text}) - length(replace({text}, chr(92), ''))"
    for mark in CONTROL:
        added += f" + (length({text}) - length(replace({text}, '{mark}', ''))) // {len(mark)}"
    return f"length({text}) + {added}"


def _sql_frame() -> str:
    arms = " ".join(f"WHEN '{r}' THEN {len(OPEN[r]) + len(CLOSE[r])}" for r in OPEN)
    return f"CASE role {arms} ELSE {len('<s><<ROLE>><</ROLE>>  </s>')} + {_sql_escaped('role')} END"


QUERIES = {"op2_chat_tree": _query}
CHECKS = {
    "op2_chat_tree": f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum({_sql_escaped('text')} + {_sql_frame()}) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""
}
