import math
import random
import re
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarry.llm import lexical
from quarry.llm.common import cut

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def brute(docs, items, k):
    found = [(i, TERM.findall((t or "").translate(LOWER))) for i, t in docs]
    n_docs, total = sum(1 for _, t in found if t), sum(len(t) for _, t in found)
    held = Counter(x for _, t in found for x in set(t))
    out = []
    for item, text in items:
        asked = set(TERM.findall((text or "").translate(LOWER)))
        scores = []
        for i, t in found:
            tf, s = Counter(t), 0
            for x in asked & set(tf):
                w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * held[x] + 1)))
                s += w * (1_000_000_000 * tf[x] // (1000 * tf[x] + 20 * (50 + 50 * len(t) * n_docs // total)))
            if s > 0:
                scores.append((-s, i is None, i))
        out += [(item, r, i, -s) for r, (s, _, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=lambda x: (str(x[0]), x[1]))


def searched(docs, items, k, **options):
    made = cut(lexical.index(docs, **options), "index")
    return sorted(((r["item"], r["rank"], r["id"], r["score"]) for r in lexical.search(made, items, k=k).collect()), key=lambda x: (str(x[0]), x[1]))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(12)
    vocabulary = [f"t{i}" for i in range(300)]
    words = lambda n: " ".join(vocabulary[min(int(rng.paretovariate(0.6)) - 1, 299)] for _ in range(n))
    docs = [(i, words(rng.randint(1, 150))) for i in range(500)]
    docs += [(1000 + i, docs[7][1]) for i in range(90)]  # more equal scores than there are places
    docs += [(2000, None), (2001, ""), (2002, "...  \n"), (2003, "T1,t2;É-t3_日本 ÀB"), (2004, words(30_000)), (None, "t250 t251"), (None, "t250"), (2005, docs[3][1]), (2005, docs[3][1])]
    items = [(i, words(rng.randint(1, 40))) for i in range(25)] + [(90, docs[7][1]), (91, None), (92, "?!"), (93, "absent"), (94, "É 日本 T1 t1 T1 àb"), (None, "t250"), (95, "t5 t9"), (95, "t5 t9")]
    return docs, items


@pytest.mark.parametrize("options", [{}, {"shard_bytes": 4000, "block": 4}, {"shard_bytes": 30_000, "block": 16}])
def test_search_equals_scoring_every_document(spark, rows, options):
    docs, items = rows
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit("extra") for c in ("term", "shard", "ids", "rank")}).repartition(3)
    asked = spark.createDataFrame(items, "item_id long, text string").withColumn("q", F.lit("extra"))
    assert searched(df, asked, 50, **options) == brute(docs, items, 50)
    assert searched(df, asked, 3, **options) == brute(docs, items, 3)


def test_queries_in_groups(spark, rows):
    docs, items = rows
    made = cut(lexical.index(spark.createDataFrame(docs, "doc_id long, text string")), "index")
    out = lexical.search(made, spark.createDataFrame(items, "item_id long, text string"), k=5, max_terms=40).collect()
    assert Counter((r["item"], r["id"], r["score"]) for r in out) == Counter((q, i, s) for q, _, i, s in brute(docs, items, 5))


def test_empty_and_textless_tables(spark):
    docs, items = spark.createDataFrame([(1, None), (2, "?")], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert searched(docs, items, 5) == searched(docs.limit(0), items, 5) == searched(docs.withColumn("text", F.lit("a")), items.limit(0), 5) == []
    assert searched(spark.createDataFrame([("x", "a b")], "doc_id string, text string"), items, 5) == [(1, 1, "x", 287 * (10**9 // (1000 + 2000)))]


def test_blocks_are_rejected_before_decompression(spark, rows):
    """With one frequent term and a few rare ones, most blocks of the frequent list stay packed."""
    docs = pa.array([i for i in range(20_000)]), pa.array(["common " + ("rare " * 3 if i % 5000 == 0 else f"x{i} y{i}") for i in range(20_000)])
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(lexical.index(spark.createDataFrame([], "doc_id long, text string")).schema)
    batches = list(lexical.shard_rows(0, *docs, 64, schema))
    total = 20_000 + 4 * 3 + 2 * (20_000 - 4)
    lists = {t: e for b in batches for _, t, e in lexical.lists_of(b, 20_000, total) if t in (None, "common", "rare")}
    shard = lexical.Shard(lists, 20_000, total)
    read = []
    plain = shard.decoded
    shard.decoded = lambda t, blocks: read.append((t, len(blocks))) or plain(t, blocks)
    best = shard.best([("common", 5), ("rare", 9000)], 3, 0)
    assert {p for _, p in best} == {0, 5000, 10_000, 15_000}
    assert dict(read) == {"rare": 1, "common": 4} and len(shard.lists["common"][0]) == 313


def test_numbers_survive_packing():
    import numpy as np

    rng = random.Random(1)
    values = np.array([rng.randrange(1 << rng.randint(1, 35)) for _ in range(3000)] + [0, 127, 128, (1 << 35) - 1])
    data, end = lexical.packed(values)
    assert len(data) == end[-1] and (lexical.unpacked(data) == values).all()
    assert len(lexical.unpacked(lexical.packed(np.array([], np.int64))[0])) == 0


def test_terms_match_the_expression():
    texts = ["Ab,cd", None, "", "é", "é x", "9_Z`{}ÿ", "  ", "日本 語"]
    found, counts = lexical.terms_of(pa.array(texts))
    want = defaultdict(list)
    for i, t in enumerate(texts):
        want[i] = TERM.findall((t or "").translate(LOWER))
    assert found.to_pylist() == [x for i in range(len(texts)) for x in want[i]] and counts.tolist() == [len(want[i]) for i in range(len(texts))]
