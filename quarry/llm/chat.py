"""Conversations formatted as training sequences, assembled from tokens.

A conversation's turns, in order, become one sequence: for each turn the reserved id that opens its role, the ids of its
text, and the reserved id that closes it. Texts are encoded by themselves and the reserved ids, which lie beyond the
vocabulary, are spliced between, so no text can ever yield one and no merge reaches across a boundary. The mask, which
says what the loss counts, comes from prefix sums: +1 where a learned role's text begins, -1 where it ends.

The written form is the same with ``### Role:`` and ``</turn>`` for the reserved ids. In texts, a control string gets a
backslash after its first character, and so do those that have backslashes there already, one more each; ``unescaped``
takes it away. Texts are escaped before they are encoded, so ids and written form say the same, and ``read_back`` finds
role and text of every turn in the ids alone.

``assemble`` gives a sequence as one row per turn, with its place in the sequence, because a conversation may have any
number of turns: no task ever holds a whole one. Rows are ranged by conversation and turn, and a conversation that
crosses from one range to the next takes up its offset from the ranges before, of which only the totals of their first
and last conversation are needed.

Defined cases: a null text is empty; a null turn comes first, and turns with equal numbers are in an order that depends
on their roles and texts only; repeated rows are turns of their own; a null conversation is one like any other; a role
that is not among ``ROLES``, or null, is written as ``other`` with its name as the first line of the text (null as an
empty name, and a name ends at its first line break); a very long text is one row; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import cut
from quarry.llm.packing import Encoder

#: The roles with a reserved id each, in this order from ``first_reserved`` on; the id after them closes a turn.
ROLES = ("system", "user", "assistant", "tool", "other")
LEARNED = ("assistant",)
END = "</turn>"
OPENING = {r: f"### {r.capitalize()}: " for r in ROLES}
#: What a text must not say by itself: the strings that mark turns (with or without the space behind a role).
CONTROL = [END, *[s.rstrip() for s in OPENING.values()]]
_HEAD = "|".join(f"{re.escape(s[0])}(?=\\\\*{re.escape(s[1:])})" for s in CONTROL)
_MARKED = "|".join(f"{re.escape(s[0])}\\\\(?=\\\\*{re.escape(s[1:])})" for s in CONTROL)
ESCAPE, UNESCAPE = re.compile(_HEAD), re.compile(_MARKED)
TURNS = "n_ids int, ids array<int>, mask array<byte>, at long, part int, nth long"


def escaped(text: str) -> str:
    """The text with a backslash more in each of its control strings, those with backslashes in them included."""
    return ESCAPE.sub(lambda m: m.group() + "\\", text)


def unescaped(text: str) -> str:
    return UNESCAPE.sub(lambda m: m.group()[0], text)


def written(role: Column, text: Column) -> Column:
    """The written form of a turn, from its role among ``ROLES`` and its escaped text."""
    opening = F.create_map(*[F.lit(x) for pair in OPENING.items() for x in pair])
    return F.concat(F.element_at(opening, role), text, F.lit(END))


class Codec:
    """Turns to ids and back."""

    def __init__(self, vocabulary: str, first_reserved: int | None):
        self.encoder = Encoder(vocabulary)
        self.encoder.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        size = self.encoder.tokenizer.get_vocab_size(with_added_tokens=True)
        self.first = size if first_reserved is None else first_reserved
        if self.first < size:
            raise ValueError(f"reserved ids begin at {size} or later")
        self.end = self.first + len(ROLES)

    def turn(self, role: str | None, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Ids and mask of one turn."""
        if role not in ROLES or role == "other":
            role, text = "other", f"{role or ''}\n{text or ''}"
        own = np.frombuffer(self.encoder(escaped(text or "")), "<u4")
        ids = np.concatenate([[self.first + ROLES.index(role)], own, [self.end]]).astype(np.int32)
        step = np.zeros(len(ids) + 1, np.int8)
        if role in LEARNED:
            step[1] += 1
            step[len(ids) - 1] -= 1
        return ids, np.cumsum(step[:-1], dtype=np.int8)

    def text(self, ids: np.ndarray) -> str:
        """The written text of ids that hold no reserved one."""
        return self.encoder.fast.decode_bytes(ids.tolist()).decode()

    def read(self, ids: np.ndarray, mask: np.ndarray) -> tuple[str | None, str, str, str]:
        """Of one turn: role, text, escaped text, and the text under the mask."""
        if len(ids) < 2 or not self.first <= ids[0] < self.end or ids[-1] != self.end or (ids[1:-1] >= self.first).any():
            raise ValueError("not the ids of a turn")
        role, inner = ROLES[ids[0] - self.first], self.text(ids[1:-1])
        learned = unescaped(self.text(ids[(mask > 0) & (ids < self.first)]))
        text = unescaped(inner)
        if role == "other":
            role, _, text = text.partition("\n")
        return role, text, inner, learned


_codecs: dict[tuple, Codec] = {}


def codec(vocabulary: str, first_reserved: int | None) -> Codec:
    key = (vocabulary, first_reserved)
    return _codecs.get(key) or _codecs.setdefault(key, Codec(*key))


def assemble(df: DataFrame, vocabulary: str, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", *, first_reserved: int | None = None) -> DataFrame:
    """One row per turn of the formatted conversations: conv, turn, nth (its number from 0), ids, mask, n_ids, and
    ``start``, its place in the conversation's sequence."""
    rows = df.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    keys = [F.asc_nulls_first(c) for c in ("conv", "turn", "tie")]
    ranged = rows.withColumn("tie", F.xxhash64("role", "text")).repartitionByRange(*keys).sortWithinPartitions(*keys)
    ranged = ranged.select("conv", "turn", "role", "text", F.spark_partition_id().alias("part"))
    kinds = ", ".join(f"{c} {ranged.schema[c].dataType.simpleString()}" for c in ("conv", "turn"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = codec(vocabulary, first_reserved)
        current, at, nth = None, 0, 0
        for batch in batches:
            conv = batch.column("conv").to_pylist()
            ids, masks, places, numbers = [], [], [], []
            for i, (role, text) in enumerate(zip(batch.column("role").to_pylist(), batch.column("text").to_pylist(), strict=True)):
                if (conv[i],) != current:
                    current, at, nth = (conv[i],), 0, 0
                one, mask = made.turn(role, text)
                ids.append(one)
                masks.append(mask)
                places.append(at)
                numbers.append(nth)
                at, nth = at + len(one), nth + 1
            sizes = np.array([len(x) for x in ids], np.int32)
            ends = pa.array(np.append(0, np.cumsum(sizes)), pa.int32())
            flat = lambda x, t: pa.ListArray.from_arrays(ends, pa.array(np.concatenate(x), t))
            columns = [batch.column("conv"), batch.column("turn"), pa.array(sizes), flat(ids, pa.int32()), flat(masks, pa.int8()), pa.array(places, pa.int64()), batch.column("part"), pa.array(numbers, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["conv", "turn", "n_ids", "ids", "mask", "at", "part", "nth"])

    turns = cut(ranged.mapInArrow(run, f"{kinds}, {TURNS}"), "turns")
    return turns.join(F.broadcast(_carried(turns)), turns["part"].eqNullSafe(F.col("c_part")) & turns["conv"].eqNullSafe(F.col("c_conv")), "left").select(
        "conv", "turn", (F.col("nth") + F.coalesce("c_turns", F.lit(0))).alias("nth"), "ids", "mask", "n_ids", (F.col("at") + F.coalesce("c_ids", F.lit(0))).alias("start")
    )


def _carried(turns: DataFrame) -> DataFrame:
    """Of the conversations that cross into a range from the one before: the turns and ids before it. At most one row
    per range, as only its first conversation can have begun before."""
    here = turns.groupBy("part", "conv").agg(F.max(F.col("nth") + 1).alias("turns"), F.max(F.col("at") + F.col("n_ids")).alias("ids"))
    order = F.struct(F.col("conv").isNotNull().alias("some"), F.col("conv").alias("conv"))
    ends = turns.groupBy("part").agg(F.min(order).alias("first"), F.max(order).alias("last"))
    ends = ends.select(F.col("part").alias("e_part"), "first", "last")
    edge = here.join(ends, F.col("part") == F.col("e_part")).filter(F.col("conv").eqNullSafe(F.col("first.conv")) | F.col("conv").eqNullSafe(F.col("last.conv")))
    parts = edge.select("part", "conv", "turns", "ids", F.col("conv").eqNullSafe(F.col("first.conv")).alias("is_first")).collect()  # two rows per range at most
    out, before = [], {}
    for r in sorted(parts, key=lambda r: (r["part"], not r["is_first"])):
        if r["is_first"] and r["conv"] in before:
            out.append((r["part"], r["conv"], *before[r["conv"]]))
        n, ids = before.get(r["conv"], (0, 0))
        before = {r["conv"]: (n + r["turns"], ids + r["ids"])}
    kind = turns.schema["conv"].dataType.simpleString()
    return turns.sparkSession.createDataFrame(out, f"c_part int, c_conv {kind}, c_turns long, c_ids long")


def read_back(made: DataFrame, vocabulary: str, *, first_reserved: int | None = None) -> DataFrame:
    """What the ids and masks of assembled turns say: conv, nth, role, text, escaped (the text as written), learned (the
    text under the mask)."""
    kind = made.schema["conv"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(vocabulary, first_reserved)
        for batch in batches:
            read = [own.read(ids.values.to_numpy(), mask.values.to_numpy()) for ids, mask in zip(batch.column("ids"), batch.column("mask"), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("conv"), batch.column("nth"), *[pa.array([r[i] for r in read], pa.string()) for i in range(4)]], ["conv", "nth", "role", "text", "escaped", "learned"])

    return made.select("conv", "nth", "ids", "mask").mapInArrow(run, f"conv {kind}, nth long, role string, text string, escaped string, learned string")


def digests(turns: DataFrame) -> DataFrame:
    """Per conversation of ``read_back``: conv, n_turns, SHA-256 of role, line break, text, line break of every turn,
    code points and SHA-256 of the text under the mask, and code points as written. A digest is made turn after turn
    from sorted rows, so a conversation of any length takes the memory of one turn; its bytes are a single stream by
    nature."""
    kind = turns.schema["conv"].dataType.simpleString()
    names = ["conv", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    said = F.when(F.col("role").isin(*[r for r in ROLES if r != "other"]), F.col("role")).otherwise("other")
    fields = turns.select("conv", "nth", F.concat("role", F.lit("\n"), "text", F.lit("\n")).alias("line"), "learned", F.length(written(said, F.col("escaped"))).cast("long").alias("chars"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state = None, None
        done: list[tuple] = []

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            types = [conv_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)

        def ended() -> None:
            done.append((current[0], state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

        for batch in batches:
            for conv, line, learned, chars in zip(*[batch.column(c).to_pylist() for c in ("conv", "line", "learned", "chars")], strict=True):
                if (conv,) != current:
                    if state:
                        ended()
                    current, state = (conv,), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                state[0] += 1
                state[1].update(line.encode())
                state[2] += len(learned)
                state[3].update(learned.encode())
                state[4] += chars
            if done:
                yield batch_of(done)
                done = []
        if state:
            ended()
            yield batch_of(done)

    from pyspark.sql.pandas.types import to_arrow_type

    conv_type = to_arrow_type(turns.schema["conv"].dataType)
    by_conv = fields.repartition("conv").sortWithinPartitions("conv", "nth")
    return by_conv.mapInArrow(run, f"conv {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
