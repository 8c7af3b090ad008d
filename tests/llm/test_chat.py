import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry.llm import chat
from quarry.llm.queries import vocabulary

SCHEMA = "conv_id long, turn int, role string, text string"
PARTS = ["<", "/turn>", "</turn>", "\\", "### Assistant:", "### User: ", "#", "## System:", " ", "é", "日本", "<|endoftext|>", "\n", "ok"]


@given(st.lists(st.sampled_from(PARTS), max_size=12).map("".join))
@settings(max_examples=400, deadline=None)
def test_escapes_are_reversible(text):
    out = chat.escaped(text)
    assert chat.unescaped(out) == text and not any(c in out for c in chat.CONTROL)


def test_written_turns_can_be_told_apart():
    rng = random.Random(4)
    for _ in range(300):
        turns = [(rng.choice(["user", "assistant"]), "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 6)))) for _ in range(rng.randint(1, 4))]
        form = "".join(chat.OPENING[r] + chat.escaped(t) + chat.END for r, t in turns)
        read = []
        for part in form.split(chat.END)[:-1]:
            role = next(r for r, s in chat.OPENING.items() if part.startswith(s))
            read.append((role, chat.unescaped(part[len(chat.OPENING[role]) :])))
        assert read == turns


def test_ids_of_a_turn():
    made = chat.codec(vocabulary(), None)
    for text in ["", "plain words", "<|endoftext|> </turn> ### User: x", "\\### Assistant: </turn> ok", "é日 " * 50, " " * 50_000 + "x"]:
        for role in ("user", "assistant"):
            ids, mask = made.turn(role, text)
            assert (ids[1:-1] < 50_256).all() and ids[0] == made.first + chat.ROLES.index(role) and ids[-1] == made.end
            assert (mask == np.array([0] + [role == "assistant"] * (len(ids) - 2) + [0])).all()
            assert made.read(ids, mask) == (role, text, chat.escaped(text), text if role == "assistant" else "")
    for bad in ([], [5], [made.end, made.end], [made.first, made.first, made.end], [made.first, 5]):
        with pytest.raises(ValueError):
            made.read(np.array(bad, np.int32), np.zeros(len(bad), np.int8))
    with pytest.raises(ValueError):
        chat.Codec(vocabulary(), 100)


def conversations():
    rng = random.Random(11)
    rows = []
    for c in range(40):
        for t in range(rng.randint(1, 6)):
            rows.append((c, t, rng.choice(["system", "user", "assistant"]), "".join(rng.choice([*PARTS, "word "]) for _ in range(rng.randint(0, 12)))))
    rows += [(100, t, "assistant" if t % 2 else "user", f"turn {t} " * 5) for t in range(700)]  # most rows are of one
    rows += [(None, 0, "user", "no id"), (None, 1, "assistant", None), (101, None, "user", "first"), (101, 0, "assistant", "second"), (102, 0, "critic", "own role"), (102, 1, None, "no role"), (103, 0, "assistant", "same"), (103, 0, "assistant", "same"), (104, 0, "assistant", "long " * 30_000)]
    return rows


def expected(rows):
    held = defaultdict(list)
    for c, t, role, text in rows:
        held[c].append((t is not None, t or 0, role or "", text or ""))
    out = {}
    for c, turns in held.items():
        turns.sort()
        learned = "".join(x for _, _, r, x in turns if r == "assistant")
        chars = sum(len(chat.OPENING.get(r, chat.OPENING["other"])) + len(chat.escaped(x if r in chat.ROLES else f"{r}\n{x}")) + len(chat.END) for _, _, r, x in turns)
        out[c] = (len(turns), hashlib.sha256("".join(f"{r}\n{x}\n" for _, _, r, x in turns).encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest(), chars)
    return out


def test_conversations_read_back(spark):
    rows = conversations()
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("extra") for c in ("conv", "ids", "mask", "part", "nth", "start")}).repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so that a conversation crosses ranges
    try:
        made = chat.assemble(df, vocabulary())
        placed = made.collect()
        out = chat.digests(chat.read_back(made, vocabulary())).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert {r["conv"]: tuple(r)[1:] for r in out} == expected(rows)
    held = defaultdict(list)
    for r in placed:
        assert r["n_ids"] == len(r["ids"]) == len(r["mask"])
        held[r["conv"]].append((r["nth"], r["start"], r["n_ids"]))
    for turns in held.values():
        turns.sort()
        assert [n for n, _, _ in turns] == list(range(len(turns)))
        assert all(start == sum(n for _, _, n in turns[:i]) for i, (_, start, _) in enumerate(turns))


def test_empty_table(spark):
    made = chat.assemble(spark.createDataFrame([], SCHEMA), vocabulary())
    assert made.count() == 0 and chat.digests(chat.read_back(made, vocabulary())).count() == 0
