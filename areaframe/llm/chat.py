"""Chat formatting as a prefix tree: shared first turns are emitted once, depth first.

Every turn's node is named by a digest of the whole conversation up to it. Distinct
conversations, sorted by their lists of nodes, are the leaves of the tree in depth-first
order, and what a conversation does not share with the one before it is exactly what it adds.
Each such segment carries its tokens, its first position (the tokens before it in its own
conversation) and the stretches of the stream that its tokens may attend to besides the
ones before them in the segment.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import save
from .tokencounts import RANKS, Encoder, load_ranks

#: The template's control strings. None is a prefix of another.
CONTROLS = ("[INST]", "[/INST]", "<s>", "</s>", "<<SYS>>", "<</SYS>>", "<<ROLE>>", "<</ROLE>>")
_ANY = "|".join(re.escape(c) for c in CONTROLS)
_ESCAPED = re.compile(rf"\\(\\|{_ANY})")
_CONTROL = re.compile(_ANY)
ROLES = {"user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>"), "system": ("<<SYS>>", "<</SYS>>")}


def escape(text: str) -> str:
    """Control strings and backslashes behind a backslash."""
    return _CONTROL.sub(lambda m: "\\" + m[0], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[1], text)


def turn_parts(role: str, text: str) -> list[str]:
    """A turn as control strings and escaped texts by turns: control, text, control ..."""
    if role in ROLES:
        return [ROLES[role][0], escape(text), ROLES[role][1]]
    return ["<<ROLE>>", escape(role), "<</ROLE>>", escape(text), "</s>"]


class ChatCoder:
    """Token ids of turns and back. Control strings have ids of their own, behind the vocabulary."""

    def __init__(self, path: str = RANKS):
        self.encoder = Encoder(load_ranks(path))
        self.base = len(self.encoder.sizes)
        self.spelled = {i: t for t, i in self.encoder.ranks.items()}

    def encode(self, role: str, text: str) -> tuple[np.ndarray, int, int]:
        """Ids of a turn, and the span that is under the loss mask (empty unless the assistant's)."""
        out, loss = [], (0, 0)
        size = 0
        for i, part in enumerate(turn_parts(role, text)):
            ids = np.array([self.base + CONTROLS.index(part)]) if i % 2 == 0 else self.encoder.encode(part)
            if role == "assistant" and i == 1:
                loss = (size, size + len(ids))
            out.append(ids)
            size += len(ids)
        return np.concatenate(out), *loss

    def decode(self, ids) -> str:
        parts = [CONTROLS[i - self.base].encode() if i >= self.base else self.spelled[i] for i in ids]
        return b"".join(parts).decode()


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted conversation."""
    pieces, at, plain = [], 0, []
    for m in re.finditer(rf"\\(?:\\|{_ANY})|({_ANY})", formatted):
        plain.append(formatted[at : m.start()])
        at = m.end()
        if m[1] is None:
            plain.append(m[0][1:])
        else:
            pieces.append(("".join(plain), m[1]))
            plain = []
    names = {v[0]: k for k, v in ROLES.items()}
    turns, i = [], 0
    while i < len(pieces):
        opened = pieces[i][1]
        if opened in names:
            turns.append((names[opened], pieces[i + 1][0]))
            i += 2
        else:
            turns.append((pieces[i + 1][0], pieces[i + 2][0]))
            i += 3
    return turns


def gather_conversations(
    rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """(conv, roles, texts, path): one row per conversation. A conversation is one sequence of
    tokens and one digest, so its own turns, and no other's, are brought together; path names
    a node per turn. Turns in order of ``turn_col``, then role and text; null sorts first."""
    blank = F.lit("")
    turn = F.struct(
        F.col(turn_col).alias("t"), F.coalesce(F.col(role_col), blank).alias("role"), F.coalesce(F.col(text_col), blank).alias("text")
    )
    convs = (
        rows.groupBy(F.col(conv_col).alias("conv")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
        .select("conv", F.col("turns.role").alias("roles"), F.col("turns.text").alias("texts"))
    )
    kind = rows.schema[conv_col].dataType.simpleString()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths = []
            for roles, texts in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                node, path = b"", []
                for role, text in zip(roles, texts):
                    own, said = role.encode(), text.encode()
                    node = hashlib.blake2b(b"%s%d:%s%s" % (node, len(own), own, said), digest_size=16).digest()
                    path.append(node)
                paths.append(path)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(paths, pa.list_(pa.binary()))], names=["conv", "roles", "texts", "path"]
            )

    return convs.mapInArrow(task, f"conv {kind}, roles array<string>, texts array<string>, path array<binary>")


def _shared_turns(leaves: DataFrame) -> DataFrame:
    """(leaf, path, shard, rank, shared): leaves in depth-first order, and how many first turns each
    shares with the leaf before it. Shards are ranges of the order; the first leaf of a
    shard is measured against the last of the shard before."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, rank, before = TaskContext.get().partitionId(), 0, None
        for batch in batches:
            paths = batch.column(1).to_pylist()
            shared = []
            for path in paths:
                shared.append(None if before is None else common(before, path))
                before = path
            n = len(paths)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([shard] * n, pa.int32()), pa.array(range(rank, rank + n), pa.int64()),
                 pa.array(shared, pa.int32())],
                names=["leaf", "path", "shard", "rank", "shared"],
            )
            rank += n

    def common(a: list, b: list) -> int:
        n = 0
        for x, y in zip(a, b):
            if x != y:
                break
            n += 1
        return n

    kind = "leaf binary, path array<binary>, shard int, rank bigint, shared int"
    order = leaves.select("leaf", "path").repartitionByRange(
        max(1, leaves.sparkSession.sparkContext.defaultParallelism * 3), "path"
    ).sortWithinPartitions("path")
    ranked = save(order.mapInArrow(task, kind), "ranked")
    # One row per shard.
    edges = ranked.groupBy("shard").agg(F.max("path").alias("last"), F.min("path").alias("first"))
    lag = F.lag("last").over(Window.orderBy("shard"))
    same = F.transform(F.arrays_zip(F.col("first").alias("x"), F.col("before").alias("y")), lambda p: p["x"].eqNullSafe(p["y"]))
    differs = F.array_position(same, F.lit(False))
    lengths = F.least(F.size("first"), F.size("before"))
    met = edges.withColumn("before", lag).select(
        F.col("shard").alias("_shard"),
        F.when(F.col("before").isNull(), 0).when(differs == 0, lengths).otherwise(F.least(differs - 1, lengths)).cast("int").alias("_met"),
    )
    return ranked.join(met, F.col("shard") == F.col("_shard")).select(
        "leaf", "path", "shard", "rank", F.coalesce("shared", "_met").alias("shared")
    )


SEGMENT = (
    "leaf binary, shard int, rank bigint, nodes array<binary>, parents array<binary>, turn_tokens array<int>, "
    "token_ids array<int>, loss array<struct<start:int,end:int>>, position_start bigint, n_tokens bigint"
)


def format_tree(convs: DataFrame, path: str = RANKS) -> DataFrame:
    """The tree's segments in depth-first order, one row each.

    ``stream_start``: where its tokens begin in the stream of all segments. ``position_start``: the
    position id of its first token, the others count on. ``nodes`` and ``turn_tokens``: its turns
    and their sizes. ``loss``: spans of its tokens under the loss mask. ``attends``: stretches [start,
    end) of the stream, all its ancestors and nothing else, that every token of it sees; inside
    the segment attention is causal. Takes :func:`gather_conversations`.
    """
    coder = ChatCoder(path)
    some = convs.filter(F.size("path") > 0).withColumn("leaf", F.element_at("path", -1))
    # Equal conversations are one leaf; one of them lends its texts.
    chosen = save(some.groupBy("leaf").agg(F.min(F.struct(F.col("conv").isNull(), "conv")).alias("_rep")), "leaves")
    lent = save(
        some.join(chosen, "leaf").filter(F.col("conv").eqNullSafe(F.col("_rep.conv"))).select("leaf", "roles", "texts", "path"), "lent"
    )
    order = save(_shared_turns(lent), "order")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in SEGMENT.split(", ")]
            for i in range(batch.num_rows):
                leaf, roles, texts, nodes, shard, rank, shared = (batch.column(k)[i].as_py() for k in range(7))
                if shared >= len(nodes):
                    continue
                coded = [coder.encode(r, t) for r, t in zip(roles, texts)]
                sizes = [len(c[0]) for c in coded]
                own = coded[shared:]
                starts = np.cumsum([0, *[len(c[0]) for c in own]])
                row = (
                    leaf, shard, rank, nodes[shared:], [None, *nodes][shared : len(nodes)], sizes[shared:],
                    np.concatenate([c[0] for c in own]).astype(np.int32),
                    [{"start": int(s + c[1]), "end": int(s + c[2])} for s, c in zip(starts, own) if c[2] > c[1]],
                    sum(sizes[:shared]), sum(sizes[shared:]),
                )
                for column, value in zip(out, row):
                    column.append(value)
            kinds = [pa.binary(), pa.int32(), pa.int64(), pa.list_(pa.binary()), pa.list_(pa.binary()), pa.list_(pa.int32()),
                     pa.list_(pa.int32()), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(out, kinds)], names=re.findall(r"(?:^|, )(\w+) ", SEGMENT)
            )

    joined = lent.join(order.select("leaf", "shard", "rank", "shared"), "leaf")
    segments = save(
        joined.select("leaf", "roles", "texts", "path", "shard", "rank", "shared").mapInArrow(task, SEGMENT), "segments"
    )
    # Where each segment begins: sums over shards, then inside the shard.
    sums = segments.groupBy("shard").agg(F.sum("n_tokens").alias("_n"))
    offsets = sums.select(
        F.col("shard").alias("_shard"),
        F.coalesce(F.sum("_n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
    )
    inside = F.sum("n_tokens").over(Window.partitionBy("shard").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1))
    starts = save(
        segments.select("leaf", "shard", "rank", "nodes", "turn_tokens", F.coalesce(inside, F.lit(0)).alias("_in"))
        .join(offsets, F.col("shard") == F.col("_shard"))
        .select("leaf", "nodes", "turn_tokens", (F.col("_before") + F.col("_in")).alias("stream_start")),
        "starts",
    )
    ends = F.transform(
        F.sequence(F.lit(1), F.size("turn_tokens")),
        lambda k: F.col("stream_start") + F.aggregate(F.slice("turn_tokens", 1, k), F.lit(0).cast("bigint"), lambda acc, x: acc + x),
    )
    spots = save(
        starts.select(F.explode(F.arrays_zip("nodes", "turn_tokens", ends.alias("ends"))).alias("s")).select(
            F.col("s.nodes").alias("node"), (F.col("s.ends") - F.col("s.turn_tokens")).alias("start"), F.col("s.ends").alias("end")
        ),
        "spots",
    )
    above = save(
        order.filter("shared > 0 AND shared < size(path)").select(
            "leaf", F.posexplode(F.slice("path", F.lit(1), F.col("shared"))).alias("depth", "node")
        ),
        "above",
    )
    seen = above.join(spots, "node").groupBy("leaf").agg(
        F.sort_array(F.collect_list(F.struct("depth", "start", "end"))).alias("spans")
    )
    merged = F.aggregate(
        "spans",
        F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)"),
        lambda acc, s: F.when(
            (F.size(acc) > 0) & (F.element_at(acc, -1)["end"] == s["start"]),
            F.concat(
                F.slice(acc, F.lit(1), F.size(acc) - 1),
                F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), s["end"].alias("end"))),
            ),
        ).otherwise(F.concat(acc, F.array(F.struct(s["start"].alias("start"), s["end"].alias("end"))))),
    )
    attends = seen.select("leaf", merged.alias("attends"))
    none = F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)")
    return (
        segments.join(starts.select("leaf", "stream_start"), "leaf").join(attends, "leaf", "left")
        .withColumn("attends", F.coalesce("attends", none))
    )


def read_back(segments: DataFrame, convs: DataFrame, path: str = RANKS) -> DataFrame:
    """Per conversation what its tokens say: roles, texts, the text under the loss mask, and the
    number of characters formatted. The tokens are taken from the segments by node."""
    coder = ChatCoder(path)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for nodes, sizes, ids, loss in zip(*(batch.column(k).to_pylist() for k in range(4))):
                at = 0
                for node, n in zip(nodes, sizes):
                    masked = [(x["start"] - at, x["end"] - at) for x in loss if at <= x["start"] < at + n]
                    start, end = masked[0] if masked else (0, 0)
                    rows.append((node, ids[at : at + n], start, end))
                    at += n
            kinds = [pa.binary(), pa.list_(pa.int32()), pa.int32(), pa.int32()]
            columns = list(zip(*rows)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["node", "ids", "from", "to"])

    nodes = save(
        segments.select("nodes", "turn_tokens", "token_ids", "loss").mapInArrow(cut, "node binary, ids array<int>, from int, to int"), "nodes"
    )
    some = convs.select("conv", "path", F.element_at("path", -1).alias("leaf"))
    members = save(some.select("conv", "leaf"), "members")
    # Equal conversations have equal paths, so any one of them serves: first() is the same on every attempt.
    steps = save(
        some.groupBy("leaf").agg(F.first("path").alias("path")).select("leaf", F.posexplode("path").alias("at", "node")), "steps"
    )
    whole = steps.join(nodes, "node").groupBy("leaf").agg(
        F.sort_array(F.collect_list(F.struct("at", "ids", F.col("from").alias("a"), F.col("to").alias("b")))).alias("turns")
    )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for turns in batch.column(1).to_pylist():
                formatted = "".join(coder.decode(t["ids"]) for t in turns)
                parsed = parse(formatted)
                out[0].append([r for r, _ in parsed])
                out[1].append([t for _, t in parsed])
                out[2].append("".join(unescape(coder.decode(t["ids"][t["a"] : t["b"]])) for t in turns))
                out[3].append(len(formatted))
            kinds = [pa.list_(pa.string()), pa.list_(pa.string()), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, k) for c, k in zip(out, kinds)]],
                names=["leaf", "roles", "texts", "loss_text", "formatted_chars"],
            )

    kind = "leaf binary, roles array<string>, texts array<string>, loss_text string, formatted_chars bigint"
    texts = save(whole.mapInArrow(read, kind), "texts")
    return members.join(texts, "leaf").drop("leaf")


def round_trip(rows: DataFrame, path: str = RANKS) -> DataFrame:
    """(conv, roles, texts, loss_text, formatted_chars) of all conversations, formatted and read back.

    Defined cases: a null role or text is empty; a null turn comes first; a null conversation id
    is a conversation of its own; rows with equal turns follow role and text, repeated rows
    are repeated turns. Other columns are not read. An empty table gives no rows.
    """
    convs = save(gather_conversations(rows), "conversations")
    return read_back(format_tree(convs, path), convs, path)
