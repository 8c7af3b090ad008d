import random
from collections import Counter, defaultdict

import corpus_pipeline as pipeline
from pyspark.sql import functions as F
from quarry.llm import html_main, pii
from quarry.llm.common import cut


def test_stages(spark):
    rng = random.Random(9)
    stops, rare = ["the", "of", "and", "in"], [f"word{i}" for i in range(3000)]
    text = lambda n: " ".join(rng.choice(stops) if i % 3 == 0 else rng.choice(rare) for i in range(n))
    clean = [text(rng.randint(60, 200)) for _ in range(40)]
    near = []
    for t in clean[:8]:
        w = t.split()
        w[len(w) // 2] = "other"
        near.append(" ".join(w))
    junk = [" | ".join(rng.choice(rare) for _ in range(80)), "too short", None]
    texts = clean + near + [clean[0], clean[1].upper()] + junk
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    seen = {}
    for name, stage in pipeline.STAGES:
        out = cut(stage(spark, docs, ""), "stage")
        seen[name] = [r["doc_id"] for r in out.select("doc_id").collect()]
        if name != pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
            docs = out
    n = len(clean) + len(near)
    assert set(seen["quality rules"]) == set(range(n + 2))
    assert set(seen["exact dedup"]) == set(range(n + 2)) - {0, 1}  # the copies with larger identifiers stay
    left = set(seen["near dedup"])
    groups = defaultdict(set)
    for k in range(8):
        groups[k] = {k, 40 + k} | ({n} if k == 0 else {n + 1} if k == 1 else set())
    assert all(len(left & g) == 1 for g in groups.values()) and set(range(8, 40)) <= left
    assert set(seen["mixing"]) <= left and len(seen["mixing"]) > len(left)
    assert set(seen["packing"]) == set(seen["mixing"])


def test_near_dedup_links_by_similarity(spark):
    """Pairs just above 0.8 of the five-word shingles are linked, those just below are not."""
    rng = random.Random(31)
    words = lambda n: [f"w{rng.randrange(20000)}" for _ in range(n)]
    sets = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    texts, similarity = [], []
    for k in range(160):
        a = words(rng.randint(80, 400))
        if k % 2:
            b = a + words(int(len(a) * rng.uniform(0.17, 0.33)))
        else:
            b = [rng.choice(words(1)) if rng.random() < 0.026 else x for x in a]
        one, two = sets(a), sets(b)
        similarity.append(len(one & two) / len(one | two))
        texts += [" ".join(a), " ".join(b)]
    passage = " ".join(words(60))  # many texts share a passage
    texts += [passage + " " + " ".join(words(60)) for _ in range(40)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    left = {r["doc_id"] for r in pipeline.near_copies(spark, docs, "").collect()}
    gone = {2 * k + 1 for k, x in enumerate(similarity) if x >= 0.8}
    assert 40 < len(gone) < 150 and sum(0.8 <= x < 0.85 for x in similarity) > 20
    assert set(range(len(texts))) - left == gone


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def staged(spark, docs):
    out = {}
    for name, stage in pipeline.STAGES:
        made = cut(stage(spark, docs, ""), "stage")
        out[name] = made
        docs = made
    return out


def test_stages_on_unusual_rows(spark):
    """Nulls in every column, empty and long texts, repeated rows, rows without an identifier and clashing names."""
    rng = random.Random(2)
    stops, rare = ["the", "of", "and", "in"], [f"word{i}" for i in range(3000)]
    text = lambda n: " ".join(rng.choice(stops) if i % 3 == 0 else rng.choice(rare) for i in range(n))
    long, plain = text(20_000), [text(80) for _ in range(6)]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(plain)] + [(50, long, None, None, None), (51, None, None, None, None), (52, "", "en", "s", 0), (0, plain[0], "en", "s", len(plain[0])), (None, plain[1], "en", "s", 0), (None, text(90), "en", None, 0)]
    docs = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit("extra") for c in ("id", "row", "size", "copies", "component", "piece", "kept")})
    made = staged(spark, docs)
    assert all(df.columns == docs.columns for name, df in list(made.items())[:-1])
    held = {name: Counter(r["doc_id"] for r in df.select("doc_id").collect()) for name, df in made.items()}
    assert held["quality rules"] == Counter([0, 0, 1, 2, 3, 4, 5, 50, None, None])  # null and short texts go
    assert held["exact dedup"] == Counter([0, 1, 2, 3, 4, 5, 50, None])  # one row per text; the copy without an identifier goes
    assert set(held["near dedup"]) >= {0, 1, 2, 3, 4, 5, 50}  # a text that nothing is near to stays
    assert set(held["mixing"]) == set(held["near dedup"]) and set(held["packing"]) == set(held["mixing"])
    pieces = made["packing"].collect()
    bins = defaultdict(list)
    for r in pieces:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    assert all(sum(n for _, n in b) <= 1024 and sorted(b)[0][0] == 0 for b in bins.values())


def test_stages_on_empty_tables(spark):
    made = staged(spark, spark.createDataFrame([], DOCS))
    assert [df.count() for df in made.values()] == [0] * len(pipeline.STAGES)


def test_pages_without_rows_or_identifiers(spark):
    pages = spark.createDataFrame([(None, None, None), (1, "u", "<p>Some words, here.</p>"), (1, "u", "<p>Some words, here.</p>")], "page_id long, url string, html string").withColumns({c: F.lit("extra") for c in ("id", "text", "n_chars")})
    assert sorted(str(tuple(r)) for r in html_main.extract(pages).collect()) == ["(1, 'u', 'Some words, here.', 17)"] * 2 + ["(None, None, '', 0)"]
    assert html_main.extract(pages.limit(0)).count() == 0
    people = spark.createDataFrame([(None, "mail a.b@c.example"), (None, None), (3, "mail a.b@c.example")], "doc_id long, text string")
    out = [r["text"] for r in pii.pseudonymise(people, key="k").collect()]
    assert len(set(out)) == 2 and None in out
