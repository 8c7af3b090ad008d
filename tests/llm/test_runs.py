import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import runs


def brute(words, least=6):
    """Every run, from the definition: try all periods at all places."""
    n, out = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(least, 4 * q):
                part = words[i : i + length]
                if not any(all(part[x] == part[x + p] for x in range(length - p)) for p in range(1, q)):
                    out.append((i, length, q))
            i = max(j, i + 1)
    return sorted(out)


def found(texts, least=6):
    flat = [x for t in texts for x in t]
    names = {x: k for k, x in enumerate(dict.fromkeys(flat))}
    return runs.find(np.array([names[x] for x in flat], np.int64), np.array([len(t) for t in texts], np.int64), least)


def planted(rng, n, letters):
    """Words with repeated stretches at random places, some of them repeated again as a whole."""
    w = [rng.choice(letters) for _ in range(n)]
    for _ in range(rng.randint(0, 4)):
        if not w:
            break
        a, p = rng.randrange(len(w)), rng.randint(1, max(1, len(w) // 6))
        block = w[a : a + p]
        w[a : a + p] = (block * rng.randint(2, 9))[: rng.randint(1, 4 * n)]
        if rng.random() < 0.3:
            w[rng.randrange(len(w))] = "changed"
    return w


@pytest.mark.parametrize("letters", [1, 2, 3, 20])
def test_runs_equal_the_definition(letters):
    rng = random.Random(letters)
    texts = [planted(rng, rng.randint(0, 70), [f"w{i}" for i in range(letters)]) for _ in range(250)]
    texts += [[], ["w0"], ["w0"] * 5, ["w0"] * 6, ["w0"] * 300, ["w0", "w1"] * 3, ["w0", "w1"] * 4, ["w0", "w1"] * 4 + ["w0"]]
    assert found(texts) == [brute(t) for t in texts]
    assert found(texts, least=1) == [brute(t, 1) for t in texts]


def test_runs_of_long_periods_and_powers_of_powers():
    rng = random.Random(9)
    texts = []
    for p in [*range(1, 40), 63, 64, 65, 127, 128, 200]:
        block = [f"x{rng.randrange(3)}" for _ in range(p)]
        texts.append([f"a{i}" for i in range(rng.randint(0, 9))] + block * 4 + block[: rng.randrange(p)] + ["z"] * rng.randint(0, 3))
        inner = [f"y{rng.randrange(2)}" for _ in range(max(1, p // 8))] * 8 + ["end"]  # a stretch of a small period in each repeat
        texts.append((inner * 5)[: 5 * len(inner) - rng.randrange(len(inner))])
        texts.append(block * 3 + block[:-1])  # one word short of a run
    assert found(texts) == [brute(t) for t in texts]


def test_fibonacci_and_thue_morse_words():
    a, b = ["a"], ["a", "b"]
    while len(b) < 400:
        a, b = b, b + a
    morse = [str(bin(i).count("1") % 2) for i in range(512)]
    assert found([b, morse, b + morse, morse * 4]) == [brute(t) for t in (b, morse, b + morse, morse * 4)]


def test_work_on_long_texts_is_bounded():
    """A million words of one, of a period of 1000, and of passages that come twice."""
    rng = random.Random(3)
    block, passage = [rng.randrange(5000) for _ in range(1000)], [rng.randrange(5000) for _ in range(250_000)]
    texts = [np.zeros(1_000_000, np.int64), np.array(block * 1000), np.array(passage * 2 + passage[::-1] * 2)]
    out = [runs.find(t.astype(np.int64), np.array([len(t)], np.int64))[0] for t in texts]
    assert out == [[(0, 1_000_000, 1)], [(0, 1_000_000, 1000)], []]


def test_marked_and_collapsed_texts(spark):
    texts = [None, "", "  ", "a b c d e f", "go " * 5, "go " * 6, "x\ty\n" * 4 + "z", "é 日 " * 5, "a b c " * 4 + "d e " * 4 + "f", "a\x1cb " * 6, "p q  p q", "k " + "one two three four five " * 4000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(None, texts[5]), (5, texts[5])], "doc_id long, text string").withColumns({c: F.lit("extra") for c in ("id", "runs", "collapsed", "n_words")}).repartition(3)
    for group_words in (1 << 18, 1):
        out = runs.mark(df, group_words=group_words).collect()
        assert len(out) == len(texts) + 2
        for r in out:
            text = texts[5] if r["id"] is None else texts[r["id"]]
            w = [x for x in __import__("re").split("[\x20\x09-\x0d]+", text or "") if x]
            want = brute(w) if len(w) < 1000 else [(1, 20_000, 5)]
            gone = {i for s, n, q in want for i in range(s + q, s + n)}
            assert r["n_words"] == len(w) and [(x["start"], x["length"], x["period"]) for x in r["runs"]] == want
            assert r["collapsed"] == " ".join(x for i, x in enumerate(w) if i not in gone)
    kept = {r["doc_id"]: r["text"] for r in runs.collapse(df).collect()}
    assert runs.collapse(df).columns == df.columns and kept[None] == kept[5] == "go" and kept[10] == texts[10] and kept[0] is None and kept[8] == "a b c d e f"
    assert runs.mark(df.limit(0)).count() == runs.collapse(df.limit(0)).count() == 0
