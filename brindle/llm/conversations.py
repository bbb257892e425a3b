"""Conversations from message rows."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.session import cut_lineage

SYSTEM, USER, TEXTLESS_USER, ASSISTANT, TEXTLESS_ASSISTANT, BROKEN = range(6)
START, WAITING, ANSWERED, REFUSED = range(4)
#: The automaton: next state by symbol, from START, WAITING, ANSWERED and REFUSED. A chat is kept if it ends ANSWERED.
STEP = {
    SYSTEM: (START, WAITING, ANSWERED, REFUSED),
    USER: (WAITING, REFUSED, WAITING, REFUSED),
    TEXTLESS_USER: (REFUSED,) * 4,
    ASSISTANT: (REFUSED, ANSWERED, ANSWERED, REFUSED),
    TEXTLESS_ASSISTANT: (REFUSED, WAITING, ANSWERED, REFUSED),
    BROKEN: (REFUSED,) * 4,
}


def packed(states: tuple[int, ...]) -> int:
    """A map of states to states as one number, two bits a state."""
    return sum(s << (2 * i) for i, s in enumerate(states))


SAME = packed((START, WAITING, ANSWERED, REFUSED))
#: The map that follows when a symbol is read after a map.
THEN = {(m, symbol): packed(tuple(STEP[symbol][(m >> (2 * i)) & 3] for i in range(4))) for m in range(256) for symbol in STEP}


def _no_constant(name: str):
    raise ValueError(name)


def read_parts(parts: str | None) -> str | None:
    """The texts of the parts, joined by line ends ("" without any); null if ``parts`` is no JSON array."""
    try:
        found = json.loads(parts, parse_constant=_no_constant)
    except (TypeError, ValueError, RecursionError):
        return None
    if not isinstance(found, list):
        return None
    texts = [p["text"] for p in found if isinstance(p, dict) and p.get("type") == "text" and isinstance(p.get("text"), str)]
    return "\n".join(t for t in texts if t.strip()).encode("utf-8", "replace").decode()


def _read(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            roles, times = batch.column(2).to_pylist(), batch.column(4).is_null().to_pylist()
            texts = [read_parts(p) for p in batch.column(3).to_pylist()]
            symbols = []
            for role, text, untimed in zip(roles, texts, times):
                if role == "system" and text is not None and not untimed:
                    symbols.append(SYSTEM)
                elif role not in ("user", "assistant") or text is None or untimed:
                    symbols.append(BROKEN)
                else:
                    symbols.append((USER if text else TEXTLESS_USER) if role == "user" else (ASSISTANT if text else TEXTLESS_ASSISTANT))
            out = [batch.column(0), batch.column(1), batch.column(4), pa.array([0 if r == "user" else 1 for r in roles], pa.int8()),
                pa.array(symbols, pa.int8())]
            yield pa.RecordBatch.from_arrays(out + [batch.column(2), pa.array(texts, pa.string())] * with_text,
                ["id", "chat_id", "at", "later", "symbol", "role", "text"][: 7 if with_text else 5])

    return run


def ordered_messages(messages: DataFrame, with_text: bool) -> DataFrame:
    """Each message once, as an automaton symbol, range-partitioned and sorted by chat and time.

    A long chat spans several partitions. Messages of one ``id`` are deliveries of one message; those without id are the
    same only if they are alike in all columns.
    """
    role = F.lower(F.regexp_replace("role", r"(?U)^\s+|(?<!\s)\s+$", ""))
    columns = messages.select("id", "chat_id", role.alias("role"), "parts", F.col("created_at").alias("at")).filter("chat_id is not null")
    schema = "id string, chat_id string, at timestamp_ntz, later tinyint, symbol tinyint" + ", role string, text string" * with_text
    read = columns.select(F.col("id").cast("string"), F.col("chat_id").cast("string"), "role", "parts", F.col("at")
        .cast("timestamp_ntz")).mapInArrow(_read(with_text), schema)
    rest = [c for c in read.columns if c != "id"]
    same = F.when(F.col("id").isNull(), F.xxhash64(*rest))
    once = read.groupBy("id", same.alias("_same")).agg(F.max(F.struct(*rest)).alias("_m")).select("id", "_m.*")
    order = ["chat_id", "at", "later", "id"]
    return once.repartitionByRange(*order).sortWithinPartitions(*order)


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each chat of the sorted partition: what its messages here make of each state, and which symbols they are."""
    part = TaskContext.get().partitionId()
    out: dict[str, list[int]] = {}  # insertion order is the order of chats; only the last can grow
    for batch in batches:
        for chat, symbol in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if (seen := out.get(chat)) is None:
                if len(out) > 50_000:
                    yield _segment_batch(out, part)
                    out = {}
                seen = out[chat] = [SAME, 0, 0]
            seen[0] = THEN[seen[0], symbol]
            seen[1] |= 1 << symbol
            seen[2] += 1
    yield _segment_batch(out, part)


def _segment_batch(out: dict[str, list[int]], part: int) -> pa.RecordBatch:
    col = lambda i: pa.array([v[i] for v in out.values()], pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(list(out), pa.string()), pa.array([part] * len(out), pa.int32()), col(0), col(1), col(2)],
        ["chat_id", "part", "made", "symbols", "size"])


#: A packed map applied to a state, in SQL.
APPLY = "(s, x) -> shiftright(x.made, 2 * s) & 3"
SEGMENTS = "chat_id string, part int, made int, symbols int, size int"


def chat_states(ordered: DataFrame) -> DataFrame:
    """``chat_id``, the automaton's final ``state``, the bit set ``symbols`` and ``size`` of every chat.

    Each partition reduces its stretch of a chat to one map of states; a chat has at most one per partition, and they are
    applied in order, so that no task needs a whole chat.
    """
    segments = ordered.select("chat_id", "symbol").mapInArrow(_segments, SEGMENTS)
    state = F.expr(f"aggregate(sort_array(collect_list(struct(part, made))), {START}, {APPLY})")
    return segments.groupBy("chat_id").agg(state.alias("state"), F.bit_or("symbols").alias("symbols"), F.sum("size").alias("size"))


def reason(state: str = "state", symbols: str = "symbols"):
    """Why a chat is left out, the gravest reason first; null if it is kept."""
    has = lambda s: F.col(symbols).bitwiseAND(F.lit(1 << s)) != 0
    empty = F.col(symbols).bitwiseAND(F.lit(~(1 << SYSTEM))) == 0
    return F.when(F.col(state) == ANSWERED, None).when(has(BROKEN), "broken").when(empty, "empty").when(has(TEXTLESS_USER),
        "empty_turn").otherwise("missing_reply_or_opening")


def refused_chats(messages: DataFrame) -> DataFrame:
    """``chat_id`` and ``reason`` of every chat that is broken, empty, or lacks an opening user turn or a reply.

    Messages without ``chat_id`` belong to no chat. A null or odd role, null or unreadable ``parts`` and a null
    ``created_at`` break the chat. Equal times put the user first. Other columns are not read.
    """
    return chat_states(ordered_messages(messages, with_text=False)).filter(F.col("state") != ANSWERED).select("chat_id", reason().alias("reason"))


def conversations(messages: DataFrame) -> DataFrame:
    """The kept chats as rows ``chat_id``, ``turn`` (from 0), ``role``, ``text``, ``created_at`` in order of time.

    The turn number is the place within the partition's stretch of the chat plus the sizes of its stretches before.
    """
    ordered = cut_lineage(_numbered(ordered_messages(messages, with_text=True)))
    sizes = ordered.groupBy("chat_id", "part").agg(F.count(F.lit(1)).alias("size"), F.bit_or("symbols").alias("symbols"),
        F.max(F.struct("place", "made")).alias("last"))
    before = F.coalesce(F.sum("size").over(Window.partitionBy("chat_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    made = F.expr(f"aggregate(array_sort(collect_list(struct(part, last.made as made)) over (partition by chat_id)), {START}, {APPLY})")
    kept = sizes.withColumn("state", made).withColumn("before", before).filter(F.col("state") == ANSWERED).select("chat_id", "part", "before")
    return ordered.join(kept, ["chat_id", "part"]).select("chat_id", (F.col("place") + F.col("before")).alias("turn"), "role", "text", F.col("at")
        .alias("created_at"))


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, chat, place, made = TaskContext.get().partitionId(), None, 0, SAME
    for batch in batches:
        places, maps = [], []
        for c, symbol in zip(batch.column(0).to_pylist(), batch.column(4).to_pylist()):
            if c != chat:
                chat, place, made = c, 0, SAME
            made = THEN[made, symbol]
            places.append(place)
            maps.append(made)
            place += 1
        n = batch.num_rows
        symbols = pa.array([1 << s for s in batch.column(4).to_pylist()], pa.int32())
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], symbols, pa.array([part] * n, pa.int32()), pa.array(places, pa.int64()),
            pa.array(maps, pa.int32())], ["chat_id", "at", "role", "text", "symbols", "part", "place", "made"])


def _numbered(ordered: DataFrame) -> DataFrame:
    return ordered.select("chat_id", "at", "role", "text", "symbol").mapInArrow(_number,
        "chat_id string, at timestamp_ntz, role string, text string, symbols int, part int, place bigint, made int")
