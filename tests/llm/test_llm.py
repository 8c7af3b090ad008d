import hashlib
import math
import random
import re
import time
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from quarry.llm import exact_dedup, html_main, langid, line_dedup, mixing, packing, pii, quality, sharding, simhash
from quarry.llm.common import cut

LOWER = {c: c + 32 for c in range(65, 91)}
SPACE = re.compile(r"[\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words_of(text):
    return [w for w in SPACE.split(text or "") if w]


def prose(rng, n, vocabulary=None):
    return " ".join(rng.choice(vocabulary or [f"w{i}" for i in range(400)]) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    """Documents with nulls, empty and long texts, equal texts in other case, near copies and a hot source."""
    rng = random.Random(5)
    texts = [prose(rng, rng.randint(1, 120)) for _ in range(60)]
    texts += [texts[0], texts[0].upper(), texts[1], None, "", "", "É", "é", "a b", "A  B", "\n\n", prose(rng, 4000)]
    for t in texts[2:12]:
        w = t.split()
        w[rng.randrange(len(w))] = "changed"
        texts.append(" ".join(w) + "\nlast line of this text\nlast line of this text")
    return [(i, t, rng.choice(["en", "fr", None]), "hot" if i % 3 else rng.choice(["a", "b", None]), len(t or "")) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(5)


@pytest.fixture(scope="module")
def clashing(docs):
    """Extra columns with names that the operators use as well."""
    names = ["id", "key", "kept", "size", "shard", "bin", "copies", "found", "component", "row", "piece", "no", "line", "n"]
    return docs.withColumns({c: F.lit("extra") for c in names})


# ---- exact dedup

def test_exact_groups(docs, rows):
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[(t or "").translate(LOWER)].append(i)
    want = {i: (max(g), len(g)) for g in groups.values() for i in g}
    for options in ({}, {"runs": 1}, {"runs": 7, "fan_in": 2}):
        got = exact_dedup.assign(docs, keep="largest", **options).collect()
        assert {r["doc_id"]: (r["_xd_keep"], r["_xd_n"]) for r in got} == want
    kept = exact_dedup.drop_copies(docs)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(min(g) for g in groups.values()) and kept.columns == docs.columns


def test_exact_repeated_rows_and_null_ids(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (None, "a"), (None, "b")], "doc_id long, text string")
    assert Counter((r["doc_id"], r["text"]) for r in exact_dedup.drop_copies(df).collect()) == {(1, "a"): 1, (None, "b"): 1}
    assert {(r["doc_id"], r["_xd_keep"], r["_xd_n"], r["_xd_kept"]) for r in exact_dedup.assign(df).collect()} == {(1, 1, 3, True), (None, 1, 3, False), (None, None, 1, True)}
    with pytest.raises(ValueError):
        exact_dedup.groups(df, keep="newest")


# ---- quality

def plain_quality(text):
    w = words_of(text)
    lines = [x for x in (text or "").split("\n") if words_of(x)]
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = Counter(grams)
    covered = {p for i, g in enumerate(grams) if n[g] > 1 for p in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_quality(spark):
    rng = random.Random(2)
    texts = [None, "", "a", "a b", "x y z x y z", "a a a a a", "# *x* <b>\n# *x* <b>\n\n", "é ü\tß\x0bq\x0cr\n", *[prose(rng, 80, ["the", "of", "a", "is"]) for _ in range(5)], *[prose(rng, 80) for _ in range(5)]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in quality.verdict(df).collect():
        want = plain_quality(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r["kept"] and r["base_failed"])
    assert quality.keep_good(df).columns == df.columns


def test_quality_keeps_prose_and_names_rules(spark):
    rng = random.Random(3)
    good = " ".join(rng.choice(["the", "of", "and"]) if i % 3 == 0 else f"word{rng.randrange(10**6)}" for i in range(200))
    bad = " | ".join(f"cell{rng.randrange(10**6)}" for _ in range(200))
    out = {r["doc_id"]: r for r in quality.verdict(spark.createDataFrame([(1, good), (2, bad)], "doc_id long, text string")).collect()}
    assert out[1]["kept"] and out[1]["broken_rules"] == [] and not out[2]["kept"] and "symbols" in out[2]["broken_rules"]
    assert [r["doc_id"] for r in quality.keep_good(spark.createDataFrame([(1, good), (2, bad)], "doc_id long, text string")).collect()] == [1]


# ---- SimHash

def plain_print(text, width):
    w = (text or "").translate(LOWER)
    w = words_of(w)
    shingles = [" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))] if w else []
    bits = [0] * 64
    for s in shingles:
        h = xxhash.xxh64(s.encode(), seed=42).intdigest()
        for b in range(64):
            bits[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * bits[b] > len(shingles))


def plain_components(rows, radius, width=3):
    f = [plain_print(t, width) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (f[i] ^ f[j]).bit_count() <= radius:
                root[max(find(i), find(j))] = min(find(i), find(j))
    names = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        names[find(i)].append(d)
    return {d: min(names[find(i)]) for i, (d, _) in enumerate(rows)}, {d: x for (d, _), x in zip(rows, f, strict=True)}


@pytest.mark.parametrize(("radius", "leaf_rows"), [(3, 1024), (3, 4), (11, 8), (20, 1)])
def test_components_match_brute_force(docs, rows, radius, leaf_rows):
    pairs = [(r[0], r[1]) for r in rows]
    want, prints = plain_components(pairs, radius)
    got = simhash.near_copies(docs, width=3, radius=radius, leaf_rows=leaf_rows).collect()
    assert {r["id"]: r["component"] for r in got} == want
    assert {r["id"]: r["f0"] % 2**64 for r in got} == prints


def test_dense_leaves_are_dealt_in_slices(spark):
    """Random points within few bits of each other: one leaf with far more points than its size."""
    rng = np.random.default_rng(1)
    values = {0}
    while len(values) < 600:
        values.add(int(sum(1 << int(b) for b in rng.choice(10, rng.integers(1, 6)))))
    values |= {v | 1 << 63 for v in list(values)[:50]}
    signed = [v - 2**64 if v >= 2**63 else v for v in values]
    points = spark.createDataFrame([(v, v) for v in signed], "pid long, f0 long")
    edges = [(r["a"] % 2**64, r["b"] % 2**64) for r in simhash.links(points, 1, leaf_rows=8, sample_rows=16).collect()]
    root = {v: v for v in values}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    def joined(pairs):
        for v in values:
            root[v] = v
        for a, b in pairs:
            root[find(a)] = find(b)
        out = defaultdict(set)
        for v in values:
            out[find(v)].add(v)
        return {frozenset(x) for x in out.values()}

    assert joined(edges) == joined((a, b) for a in values for b in values if a < b and (a ^ b).bit_count() <= 1)


def test_components_of_long_chains(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100)] + [(200 + i, 200) for i in range(1, 30)]
    got = {r["node"]: r["root"] for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {101: 100} | {200 + i: 200 for i in range(1, 30)}


def test_state_of_many_edges_does_not_overflow(spark):
    """What tells one round of components from the next must hold for any number of edges."""
    edges = spark.range(20_000_000).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert simhash._state(edges)[0] == 20_000_000 and simhash._state(edges) != simhash._state(edges.filter("a > 0"))


def test_words_of_a_fingerprint_are_majorities():
    rng = np.random.default_rng(3)
    for n in (1, 2, 255, 256, 700):
        h = simhash.mixed_words(rng.integers(0, 2**64, n, dtype=np.uint64), 3)
        want = [sum(1 << b for b in range(64) if 2 * sum(int(x) >> b & 1 for x in row) > n) for row in h]
        assert simhash.majority(h).tolist() == want


@pytest.mark.parametrize("options", [{}, {"leaf_rows": 4}, {"leaf_rows": 1, "neighbours": 1}])
def test_similar_texts_match_brute_force(spark, options):
    """Families of near copies, of which many are just below or above the threshold, and texts that share a passage."""
    rng = random.Random(17)
    vocabulary = [f"v{i}" for i in range(5000)]
    texts = []
    for _ in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(60, 150))]
        for _ in range(rng.randint(2, 14)):
            w = list(base)
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            texts.append(" ".join(w + [rng.choice(vocabulary) for _ in range(rng.choice([0, 0, 8, 20]))]))
    passage = prose(rng, 50, vocabulary)
    texts += [f"{passage} {prose(rng, 40, vocabulary)}" for _ in range(15)] + [texts[0], texts[0].upper(), None, "", "a b", "A  b"]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (words_of((t or "").translate(LOWER)) for t in texts)]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9:
                root[max(find(i), find(j))] = min(find(i), find(j))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("row", F.lit("extra"))
    assert {r["id"]: r["component"] for r in simhash.similar_texts(df, **options).collect()} == {i: find(i) for i in range(len(texts))}
    assert sorted(r["doc_id"] for r in simhash.drop_similar(df, **options).collect()) == sorted({find(i) for i in range(len(texts))})
    assert simhash.drop_similar(df.limit(0)).count() == 0


def test_near_pairs_of_a_task_take_bounded_memory():
    """A task of near copies only: all pairs are near, and are never held at once."""
    n = 4000
    pdf = pd.DataFrame({"part": 0, "role": 0, "pid": np.arange(n), "c0": np.arange(n), **{f"c{1 + w}": np.zeros(n, np.int64) for w in range(simhash.WORDS)}})
    tracemalloc.start()
    given = sum(len(x) for x in simhash._across_in_parts(pdf, (10, 100), 1))
    across = tracemalloc.get_traced_memory()[1]
    tracemalloc.reset_peak()
    nearest = simhash._nearest(pdf[["part", "role", "pid", "c0", "c1"]].assign(c0=0), (10, 20), 2)
    both = max(across, tracemalloc.get_traced_memory()[1])
    tracemalloc.stop()
    assert given == n * (n - 1) // 2 and len(nearest) == 2 * n
    assert both < 100_000_000


def test_longer_fingerprints_decide_on_pairs(spark):
    rng = np.random.default_rng(8)
    base = rng.integers(0, 2**32, 300, dtype=np.uint32)
    sets = [np.unique(np.concatenate([base[k:], rng.integers(0, 2**32, k, dtype=np.uint32)])).astype("<u4") for k in (0, 10, 30, 60, 120, 300)]
    prints = cut(spark.createDataFrame([(i, x.tobytes()) for i, x in enumerate(sets)], "row long, grams binary"), "prints")
    pairs = cut(spark.createDataFrame([(a, b) for b in range(len(sets)) for a in range(b)], "a long, b long"), "pairs")
    long = [simhash.majority(simhash.mixed_words(x.astype(np.uint64), simhash.LONG + 1)[1:]) for x in sets]
    want = sorted((a, b) for b in range(len(sets)) for a in range(b) if int(np.bitwise_count(long[a] ^ long[b]).sum()) <= 359)
    assert sorted(map(tuple, simhash.sketched(pairs, prints, 359).collect())) == want and 0 < len(want) < 15


def test_near_copies_go(docs):
    kept = simhash.drop_near_copies(docs, radius=3)
    assert kept.columns == docs.columns and kept.filter("text = ''").count() == 0  # equal to the null text before it


# ---- language

def test_held_out_accuracy(spark):
    rng = random.Random(4)
    syllables = {"en": ["the", "ing", "th", "er", "wh"], "de": ["sch", "ung", "ei", "ä", "ß"], "fr": ["eau", "ment", "é", "ç", "qu"]}
    made = [(i, " ".join("".join(rng.choice(syllables[x]) for _ in range(3)) for _ in range(rng.randint(8, 60))), x) for i in range(300) for x in [rng.choice(list(syllables))]]
    df = spark.createDataFrame(made, "doc_id long, text string, lang string")
    known = langid.prototypes(df.filter("doc_id % 4 != 2"))
    out = {r["id"]: r for r in langid.identify(df, known).collect()}
    held = [m for m in made if m[0] % 4 == 2]
    assert sum(out[i]["lang_pred"] == x for i, _, x in held) >= 0.95 * len(held)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 ... !"), (4, "漢字")], "doc_id long, text string")
    got = {r["id"]: (r["lang_pred"], r["score"]) for r in langid.identify(odd, known).collect()}
    assert got[1] == got[2] == got[3] == ("und", 0.0) and got[4][0] in syllables and 0 <= got[4][1] <= 1
    none = langid.prototypes(df.withColumn("lang", F.lit(None).cast("string")))
    assert none == {} and {r["lang_pred"] for r in langid.identify(df, none).collect()} == {"und"}
    assert langid.prototypes(df, sample_rows=50).keys() <= syllables.keys()


def test_bundles_are_sums_of_bound_vectors():
    p = langid.Profiles(dim=64)
    text = "abcab"
    total = np.zeros(64)
    for i in range(len(text)):
        a, b, c = p.letters(np.array([ord(x) for x in f" {text} "[i : i + 3]]))
        total += np.roll(a, 2) * np.roll(b, 1) * c.astype(float)
    assert p.bundles([text])[0] == pytest.approx(total / np.linalg.norm(total), abs=1e-5)


def test_every_letter_has_a_vector_of_its_own():
    p = langid.Profiles()
    points = np.array([i for i in range(0x20000) if chr(i).isalpha()])
    vectors = p.letters(points)
    assert vectors.shape == (len(points), 1024) and np.isin(vectors[:500], (-1, 1)).all()
    assert len({v.tobytes() for v in np.packbits(vectors > 0, axis=1)}) == len(points)
    near = np.array([ord(x) for x in "aàáâãäåąbcçdeéèêiíoóöōuüsßшщжя漢字𐐨"])
    cosine = p.letters(near).astype(np.int64) @ p.letters(near).astype(np.int64).T / 1024
    assert np.abs(cosine - np.eye(len(near))).max() < 0.2
    # a text's grams keep letters apart that share their low 16 bits
    assert len(p.grams("𐐨\u0428")[0]) == 2 and p.grams("𐐨")[0].tolist() != p.grams(chr(ord("𐐨") & 0xFFFF))[0].tolist()
    with pytest.raises(ValueError):
        langid.Profiles(n=4)


# ---- pages

PAGE = """<html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><header class="site-header"><a href="/">Home</a></header>
<nav><ul><li>Menu, one.</li></ul></nav><!-- hidden, text --><div class="cookie-notice">We use cookies, accept them now please.</div><div id="content"><article><h1>A &amp; B&nbsp;title</h1>
<p><b>First   paragraph, with&#33; words and more of them.<br><p>Second paragraph, which is long enough, says this.</p><div class="ad">Buy now, cheap, today.</div>
<ul><li>One item<li>Two items</ul><p>Short.</p><blockquote>Quoted, said someone.</blockquote></article><section id="comments"><p>Nice article, I liked reading it very much, thanks.</p></section></div>
<aside>Related, things.</aside><form><label>Name</label><input></form><footer>&copy; Someone, somewhere.</footer></body></html>"""
TEXT = "A & B title\nFirst paragraph, with! words and more of them.\nSecond paragraph, which is long enough, says this.\nOne item\nTwo items\nShort.\nQuoted, said someone."


def test_main_text():
    assert html_main.main_text(PAGE) == TEXT
    assert html_main.main_text(PAGE.replace("article", "div")) == TEXT
    assert html_main.main_text(PAGE[: PAGE.index("Quoted")] + "Quo<b cla").endswith("Short.\nQuo")
    for empty in ("", "<html></html>", "<nav>Menu, only.</nav>", "<!DOCTYPE html>", "<script>x", "<p>"):
        assert html_main.main_text(empty) == ""
    assert html_main.main_text("plain text only") == "plain text only"
    assert html_main.main_text("<article>" + "<p>Some words, here.</p>" * 3000 + "</article>").count("\n") == 2999


STORY = "<h1>A title</h1><p>The first paragraph of it, which has some words.</p><h2 id=\"search\">A part</h2><p class=\"share-price\">The second one, with a price.</p>"
STORY_TEXT = "A title\nThe first paragraph of it, which has some words.\nA part\nThe second one, with a price."


@pytest.mark.parametrize(
    "page",
    [
        f"<body><article>{STORY}</article><div class=ad>Buy, now.</div></body>",
        f"<body><form action=x><div id=content>{STORY}</div><input></form></body>",
        f"<body><div class='ad-hoc'>{STORY}</div><nav>Menu, one.</nav></body>",
        f"<body><div class='has-sidebar layout-with-menu'><article>{STORY}</article><div class=sidebar>Other, things.</div></div></body>",
        f"<body><div id='search-results'><main>{STORY}</main></div><div id=comments><p>{'A comment, from a reader. ' * 40}</p></div></body>",
        f"<body><article>{STORY.replace('<h2', '<section id=related-work><h2')}</section></article></body>",
        f"<body><article>{STORY.replace('<h2', '<section id=discussion><h2')}</section><div class=related>More, of this.</div></article></body>",
    ],
)
def test_names_do_not_hide_an_article(page):
    assert html_main.main_text(page) == STORY_TEXT


def test_inline_elements_of_a_sentence_stay():
    text = "<article><h1>T</h1><p>Let <math><mi>x</mi></math> be a <button>key</button> and <label>name</label>, ok.</p><button>Share, please.</button></article>"
    assert html_main.main_text(text) == "T\nLet x be a key and name, ok."


def test_deep_nesting_takes_linear_time():
    import time

    began = time.perf_counter()
    deep = html_main.main_text("<article>" + "<b>" * 50_000 + "Some words, deep inside." + "</b>" * 50_000 + "</article>")
    html_main.main_text("<div>" * 50_000 + "<li>a, b" * 2000)
    assert deep == "Some words, deep inside." and time.perf_counter() - began < 20


def test_extract(spark):
    df = spark.createDataFrame([(1, "u", PAGE), (2, None, None), (2, None, None)], "page_id long, url string, html string")
    assert sorted((r["id"], r["text"], r["n_chars"]) for r in html_main.extract(df).collect()) == [(1, TEXT, len(TEXT)), (2, "", 0), (2, "", 0)]


# ---- pseudonyms

def luhn(d):
    return sum(v - 9 * (v > 9) for i, c in enumerate(reversed(d)) for v in [int(c) * (1 + i % 2)]) % 10 == 0


def mod97(s):
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97


def test_pseudonyms(spark):
    texts = [
        "mail bob.Smith99@ex-ample.co.uk, x@y.org! card 4111 1111 1111 1111 4111111111111111 and 4111111111111112.",
        "ip 192.168.0.1. not 300.1.1.1; on 2024-02-29, not 2023-02-29; 31.12.1999 31/02/1999",
        "ssn 123-45-6789 not 000-12-3456; tel +1 (743) 555-3824, (212) 555-0199, 212-555-0199, +49 30 1234567.",
        "DE89 3704 0044 0532 0130 00 and GB82WEST12345698765432 not DE00370400440532013000",
        None, "", "no data here", "again 192.168.0.1 x@y.org", "x" * 5000 + " 192.168.0.1",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("found", F.lit("old"))
    out = pii.pseudonymise(df, key="k").cache()
    got = {r["doc_id"]: r for r in out.collect()}
    assert [got[i]["found"] for i in range(4)] == [["email", "email", "card", "card"], ["ip", "iso_date", "date"], ["ssn", "phone", "phone", "phone", "phone"], ["iban", "iban"]]
    assert got[4]["text"] is None and got[5]["text"] == "" and got[6]["text"] == texts[6]
    shape = lambda t: re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub("[0-9]", "9", t)))
    for i in (0, 2, 3):
        assert got[i]["text"] != texts[i] and shape(got[i]["text"]) == shape(texts[i])
    assert "4111111111111112" in got[0]["text"] and "300.1.1.1" in got[1]["text"] and "2023-02-29" in got[1]["text"] and "31/02/1999" in got[1]["text"]
    spaced, plain = re.findall(r"\d{4} \d{4} \d{4} \d{4}|\b\d{16}\b", got[0]["text"])[:2]
    assert spaced.replace(" ", "") == plain and luhn(plain) and plain != "4" + "1" * 15
    assert all(mod97(x.replace(" ", "")) == 1 for x in re.findall(r"DE\d\d(?: \d{4}){4} \d\d|GB\w{20}", got[3]["text"]))
    ip = re.search(r"ip ((?:\d+\.){3}\d+)", got[1]["text"])[1]
    assert all(int(x) < 256 for x in ip.split(".")) and ip in got[7]["text"] and ip in got[8]["text"]
    back = pii.pseudonymise(out.select("doc_id", "text"), key="k", reverse=True)
    assert {r["doc_id"]: r["text"] for r in back.collect()} == dict(enumerate(texts))
    other = pii.pseudonymise(df, key="other").filter("doc_id = 1").first()["text"]
    assert other != got[1]["text"]


def test_pseudonyms_of_short_and_long_mail_addresses(spark):
    texts = ["me@" + "a." * 100_000, "x@y.org2 a@b.com-foo q@-b.com w@b..com", *[f"{c}@{d}.org" for d in ("one", "two") for c in "abcdefghijklmnopqrstuvwxyz"], " " * 1_000_000 + "a@b.org", "@" * 50_000]
    out = {r["doc_id"]: r for r in pii.pseudonymise(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), key="k").collect()}
    assert out[0]["text"] == texts[0] and out[0]["found"] == [] and out[55]["text"] == texts[55]
    assert out[1]["found"] == ["email", "email"] and out[1]["text"][1:8] == "@y.org2" and out[1]["text"].endswith("@b.com-foo q@-b.com w@b..com")
    one, two = ([out[i]["text"][0] for i in range(k, k + 26)] for k in (2, 28))
    assert sorted(one) == sorted(two) == sorted("abcdefghijklmnopqrstuvwxyz") and one != two
    assert len({(ord(b) - ord(a)) % 26 for a, b in zip("abcdefghijklmnopqrstuvwxyz", one, strict=True)}) > 2  # no mere shift
    assert out[54]["found"] == ["email"]
    with pytest.raises(TypeError):
        pii.pseudonymise(spark.createDataFrame([(1, "a")], "doc_id long, text string"))


def test_runs_of_white_space(spark, vocabulary):
    run = " \t\n\r" * 250_000
    df = spark.createDataFrame([(1, f"a{run}b", "en", "s", 0), (2, run, "en", "s", 0)], DOCS)
    assert {r["id"]: r["size"] for r in mixing.mix(df).collect()} == {1: 2, 2: 0}
    assert {r["doc_id"]: (r["n_words"], r["word_chars"]) for r in quality.verdict(df).collect()} == {1: (2, 2), 2: (0, 0)}
    encode = packing.Encoder(vocabulary)
    assert np.frombuffer(encode(" " * 1_000_000 + "a"), "<u4").tolist() == encode.tokenizer.encode(" " * 1_000_000 + "a", add_special_tokens=False).ids
    assert simhash.fingerprint(f"a{run}b".encode()) == simhash.fingerprint(b"a b")


def test_pseudonyms_are_permutations(spark):
    df = spark.range(10000).select(F.lpad(F.col("id").cast("string"), 4, "0").alias("d"))
    cipher = pii.Cipher("k")
    assert df.select(cipher.digits("x", F.col("d")).alias("y")).filter("y rlike '^[0-9]{4}$'").distinct().count() == 10000
    days = spark.range(0, 36525, 1).select(F.expr("date_add(date '2000-01-01', cast(id as int))").alias("d"))
    moved = days.select(cipher.date("date", F.year("d"), F.month("d"), F.day("d")).alias("y")).distinct()
    assert moved.filter("year(y) between 2000 and 2099").count() == 36525


# ---- packing

@pytest.fixture(scope="module")
def vocabulary():
    tokens = pytest.importorskip("public_tokenizers")
    return tokens.path("byte_bpe_50k.json")


def test_ids_are_those_of_the_tokenizers_library(vocabulary):
    encode = packing.Encoder(vocabulary)
    cases = ["", "a", " a", "a\n\nb  c", "x \n y", "don't it's", " \n", "é ñ  ", "a   b", "1 2 33", "a　b  c", "<|endoftext|> a", "a\n \nb", "日本 語", "\U0001f600 x", "\x85  ", "٠١ Ⅰ"]
    for t in cases:
        assert np.frombuffer(encode(t), "<u4").tolist() == encode.tokenizer.encode(t, add_special_tokens=False).ids, repr(t)


def test_packing(docs, rows, vocabulary):
    from quarry.llm.common import cut

    capacity = 64
    encode = packing.Encoder(vocabulary)
    ids = {i: np.append(np.frombuffer(encode(t or ""), "<u4"), 2).astype("<u4") for i, t, *_ in rows}
    out = packing.pack(cut(packing.pieces(docs, vocabulary, capacity=capacity), "p"), capacity=capacity, district_rows=16).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in out:
        by_doc[r["id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
        assert zlib.crc32(ids[r["id"]][r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"]
    assert by_doc.keys() == ids.keys()
    for i, parts in by_doc.items():
        parts.sort(key=lambda r: r["piece"])
        assert [r["piece"] for r in parts] == list(range(len(parts))) and len(parts) == max(1, -(-len(ids[i]) // capacity))
        assert all(r["length"] == capacity for r in parts[1:]) and sum(r["length"] for r in parts) == len(ids[i])
    for parts in by_sequence.values():
        parts.sort(key=lambda r: r["offset"])
        at = 0
        for r in parts:
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity
    least = -(-sum(map(len, ids.values())) // capacity)
    assert len(by_sequence) <= least * 1.03 + 1


def test_crossover_keeps_every_piece_once():
    rng = np.random.default_rng(0)
    size = rng.integers(1, 900, 300)
    a, b = (packing.packed(size, 1024, rng.permutation(300)) for _ in range(2))
    for _ in range(20):
        child = packing.crossed(a, b, size, 1024, rng)
        assert child.fill.max() <= 1024 and child.fill.sum() == size.sum() and len(child.bin_of) == 300
        a, b = child, a
    best = packing.evolve(size, 1024, 1, [])
    assert best.bins <= packing.packed(size, 1024, np.argsort(-size, kind="stable")).bins


def test_repeated_and_empty(spark, vocabulary):
    from quarry.llm.common import cut

    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (2, None)], "doc_id long, text string")
    out = packing.pack(cut(packing.pieces(df, vocabulary), "p")).collect()
    assert Counter((r["id"], r["length"]) for r in out) == {(1, 3): 2, (2, 1): 1} and len({r["sequence_id"] for r in out}) == 1
    along = sorted((r["offset"], r["length"]) for r in out)
    assert [at for at, _ in along] == [sum(n for _, n in along[:i]) for i in range(3)]
    assert packing.pack(cut(packing.pieces(df.limit(0), vocabulary), "p")).count() == 0


# ---- mixing

def test_targets_fill_up(spark):
    sizes = [("a", 100), ("b", 1000), ("c", 10), ("d", 500), (None, 50), ("z", 0)]
    df = spark.createDataFrame(sizes, "_mx_source string, _mx_size long")
    got = {r["_mx_source"]: r["_mx_target"] for r in mixing.targets(df).collect()}
    order = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, (s, _) in enumerate(order)}
    left, full = 1.5 * sum(n for _, n in sizes), {}
    while True:
        rest = [s for s, _ in sizes if s not in full]
        share = {s: left * weight[s] / sum(weight[x] for x in rest) for s in rest}
        over = {s: 2.0 * n for s, n in sizes if s in share and share[s] >= 2 * n}
        if not over:
            break
        full |= over
        left -= sum(over.values())
    assert got == pytest.approx(full | share)


def test_mix(docs, rows):
    out = mixing.mix(docs, rows_per_bin=7).collect()
    again = {r["id"]: r["copies"] for r in mixing.mix(docs.repartition(2), rows_per_bin=7).collect()}
    assert {r["id"]: r["copies"] for r in out} == again == {r["id"]: r["copies"] for r in mixing.mix(docs).collect()}
    assert all(r["size"] == len(words_of(rows[r["id"]][1])) and r["copies"] <= 2 for r in out)
    for source in {r["source"] for r in out}:
        own = [r for r in out if r["source"] == source]
        taken, largest = sum(r["copies"] * r["size"] for r in own), max(r["size"] for r in own)
        assert own[0]["source_size"] == sum(r["size"] for r in own) and abs(taken - own[0]["target"]) <= largest / 2 + 1
    mixed = mixing.mixed(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r["copies"] for r in out)


def test_a_pair_is_given_by_its_first_block():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2, 64 * simhash.WORDS)
    bits = np.stack([base ^ (rng.random(base.size) < 0.04 * (1 + i % 3)) for i in range(80)])
    words = np.packbits(bits, axis=1, bitorder="little").view("<i8")
    frame = pd.DataFrame({"pid": np.arange(80), "role": 0, "c0": np.arange(80), "c1": [w.tobytes() for w in words], **{f"c{2 + k}": words[:, k] for k in range(simhash.WORDS)}})
    once, always = ([simhash._across(frame.assign(part=k), (12, 90), near) for k in range(len(simhash.BLOCKS))] for near in (simhash.NEAR, -1))
    pairs = [{(a, b) for x in found for a, b in zip(x["a"], x["b"], strict=True)} for found in (once, always)]
    assert pairs[0] == pairs[1] and len(pairs[0]) > 500
    assert sum(map(len, once)) < 1.5 * len(pairs[0]) < sum(map(len, always)) / 3


# ---- sharding

def test_shards(docs, rows):
    out = sharding.shard(docs, 7, rows_per_block=5).collect()
    size = {i: len((t or "").encode()) + 16 for i, t, *_ in rows}
    assert {r["id"]: r["size"] for r in out} == size and {r["id"]: r["crc"] for r in out} == {i: zlib.crc32((t or "").encode()) for i, t, *_ in rows}
    by = defaultdict(list)
    for r in out:
        by[r["shard"]].append(r)
    assert by.keys() <= set(range(7)) and all(sorted(r["slot"] for r in x) == list(range(len(x))) for x in by.values())
    mean, largest = sum(size.values()) / 7, max(size.values())
    assert all(abs(sum(r["size"] for r in x) - mean) <= largest for x in by.values())
    again = {r["id"]: r["shard"] for r in sharding.shard(docs.repartition(3), 7).collect()}
    assert again == {r["id"]: r["shard"] for r in out}


def test_shards_are_near_equal_and_groups_whole(spark):
    rng = random.Random(8)
    texts = [prose(rng, rng.randint(20, 60)) for _ in range(1500)]
    made = [(i, texts[i % 700] if i < 1400 else "hot text of many rows", "en", f"s{i % 5}" if i % 3 else "big", 0) for i in range(2100)]
    out = sharding.shard(spark.createDataFrame(made, DOCS), 10).collect()
    total = Counter()
    places = defaultdict(set)
    for r in out:
        total[r["shard"]] += r["size"]
        places[made[r["id"]][1]].add(r["shard"])
    mean = sum(total.values()) / 10
    assert len(total) == 10 and max(abs(v - mean) for v in total.values()) <= 0.03 * mean
    most = max(mean / 100, max(r["size"] for r in out))
    held = Counter()
    for r in out:
        held[made[r["id"]][1]] += r["size"]
    small = [t for t in places if held[t] <= most]
    assert len(small) > 100 and all(len(places[t]) == 1 for t in small)  # small groups are never parted


def test_sources_that_begin_alike_are_split_by_name(spark):
    made = [(i, f"text number {i:05d} of some words", "en", f"https://site{i % 50:02d}.org", 0) for i in range(2000)]
    df = spark.createDataFrame(made, DOCS)
    want = None
    for max_value_bytes in (1 << 20, 0):  # values sent to every task, or shuffled
        rows = sharding.points(df, 10, "doc_id", "text", ("source", "lang"), max_value_bytes)
        cells = {(made[r["id"]][3], r["k1"] >> sharding.TIE_BITS) for r in rows.collect()}
        assert len(cells) == 50 and sorted(cells) == sorted(cells, key=lambda x: x[1])  # one place each, in order
        want = want or cells
        assert cells == want
    held = defaultdict(set)
    for r in sharding.shard(df, 10).collect():
        held[r["shard"]].add(made[r["id"]][3])
    assert len(held) == 10 and max(map(len, held.values())) <= 7  # 5, and those that a cut divides


def test_groups_for_shards_are_equal_texts(spark):
    df = spark.createDataFrame([(1, "Some text"), (2, "some text"), (3, "some text")], "doc_id long, text string")
    assert [r["_xd_n"] for r in exact_dedup.assign(df, fold=False).orderBy("doc_id").collect()] == [1, 2, 2]
    assert [r["_xd_n"] for r in exact_dedup.assign(df).orderBy("doc_id").collect()] == [3, 3, 3]


# ---- lines

def edits(a, b, most):
    if abs(len(a) - len(b)) > most:
        return most + 1
    above = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(above[j] + 1, row[-1] + 1, above[j - 1] + (x != y)))
        above = row
    return above[-1]


@pytest.mark.parametrize("threshold", [1, 2, 3])
def test_lines_match_brute_force(spark, threshold):
    rng = random.Random(threshold)
    base = ["".join(rng.choice("abcd ") for _ in range(rng.randint(8, 45))) for _ in range(25)]

    def changed(s):
        s = list(s)
        for _ in range(rng.randint(0, threshold + 1)):
            p = rng.randrange(len(s) + 1)
            s[p : p + rng.randint(0, 1)] = rng.choice(["", "a", "é", "d"])
        return "".join(s)

    made = [(i, "\n".join(changed(rng.choice(base)) if rng.random() < 0.9 else " \t" for _ in range(rng.randint(0, 6)))) for i in range(80)] + [(900, None), (901, ""), (902, "x" * 9000)]
    first = {}
    for i, t in made:
        for no, line in enumerate((t or "").split("\n")):
            if words_of(line):
                first[line] = min(first.get(line, (i, no)), (i, no))
    root, degree = {x: x for x in first}, Counter()

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    long_ones = [x for x in first if len(x) >= 20]
    for k, a in enumerate(long_ones):
        for b in long_ones[:k]:
            if edits(a, b, threshold) <= threshold:
                degree[a] += 1
                degree[b] += 1
                root[find(a)] = find(b)
    best = {}
    for x in first:
        best[find(x)] = min(best.get(find(x), first[x]), first[x])
    want = {}
    for i, t in made:
        own = [(no, x) for no, x in enumerate((t or "").split("\n")) if x in first]
        want[i] = (len(own), sum(degree[x] for _, x in own), [no for no, x in own if best[find(x)] != (i, no)])
    df = spark.createDataFrame(made, "doc_id long, text string").withColumn("line", F.lit("extra"))
    for options in ({}, {"least": 1}):  # all segments are frequent in the second case
        assert {r["id"]: (r["n_lines"], r["n_links"], r["dropped"]) for r in line_dedup.mark(df, threshold=threshold, **options).collect()} == want
    cleaned = {r["doc_id"]: r["text"] for r in line_dedup.drop_lines(df, threshold=threshold).collect()}
    assert cleaned == {i: "\n".join(x for no, x in enumerate(t.split("\n")) if no not in want[i][2]) if want[i][2] else t for i, t in made}


@pytest.mark.parametrize("threshold", [1, 2, 3, 4])
def test_banded_distance(spark, threshold):
    rng = random.Random(40 + threshold)
    made = []
    for _ in range(400):
        a = "".join(rng.choice("abé😀 ") for _ in range(rng.randint(0, 12)))
        b = list(a)
        for _ in range(rng.randint(0, threshold + 2)):
            p = rng.randrange(len(b) + 1)
            b[p : p + rng.randint(0, 1)] = rng.choice(["", "a", "b", "é", "ab"])
        made.append((a, "".join(b)))
    out = spark.createDataFrame(made, "a string, b string").select("a", "b", line_dedup.within_edits(F.col("a"), F.col("b"), threshold).alias("near")).collect()
    assert all(r["near"] == (edits(r["a"], r["b"], threshold) <= threshold) for r in out)


def test_lines_of_one_length_meet_from_one_side(spark):
    """Of near lines of one length only one finds the other; lines of other lengths are found as well."""
    base = "the quick brown fox jumps over a lazy dog"
    same = [base[:i] + "z" + base[i + 1 :] for i in range(0, 40, 3)]
    docs = spark.createDataFrame(list(enumerate([*same, base + "q", base[1:]])), "doc_id long, text string")
    signed = cut(line_dedup.signed_lines(docs, 2, 20, "doc_id", "text"), "signed")
    met = [(r["x"], r["y"]) for r in line_dedup.met_lines(signed, 2).select("x", "y").collect()]
    keys = {r["text"]: r["k"] for r in docs.select("text", F.xxhash64("text").alias("k")).collect()}
    mine = {keys[t] for t in same}
    within = [p for p in met if set(p) <= mine]
    assert {frozenset(p) for p in within} == {frozenset((a, b)) for a in mine for b in mine if a != b}
    assert all(x < y for x, y in within)
    links = {r["id"]: r["n_links"] for r in line_dedup.mark(docs).collect()}
    assert links[len(same)] == len(same) + 1 and links[1] == len(same) + 1


def test_lines_of_one_beginning_do_not_all_meet(spark):
    """6,000 lines that share their first 36 characters, with some true near copies among them."""
    rng = random.Random(77)
    tail = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(64))
    lines = [f"Every line begins with these letters{tail()}" for _ in range(6000)]
    lines += [x[:50] + "ZZ" + x[52:] for x in lines[:40]] + [x[:70] + "Q" + x[70:] for x in lines[40:60]]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "doc_id long, text string")
    signed = line_dedup.signed_lines(df, 2, 20, "doc_id", "text").cache()
    index = signed.select(F.explode(line_dedup.index_hashes()).alias("sig")).groupBy("sig").agg(F.count(F.lit(1)).alias("n"))
    probe = signed.select(F.explode(line_dedup.probe_hashes()).alias("sig")).groupBy("sig").agg(F.count(F.lit(1)).alias("m"))
    assert index.join(probe, "sig").agg(F.sum(F.col("n") * F.col("m"))).first()[0] < 200_000  # of 36 million
    assert {r["id"] for r in line_dedup.mark(df).filter("n_dropped > 0").collect()} == set(range(6000, 6060))


# ---- every operator on empty tables, clashing columns and null rows

def test_clashing_columns(clashing, docs, vocabulary):
    assert exact_dedup.drop_copies(clashing).columns == clashing.columns
    assert quality.keep_good(clashing).columns == clashing.columns
    assert mixing.mixed(clashing).columns == clashing.columns
    assert simhash.drop_near_copies(clashing).count() == simhash.drop_near_copies(docs).count()
    assert line_dedup.drop_lines(clashing).columns == clashing.columns
    assert sharding.shard(clashing, 3).count() == langid.identify(clashing, {}).count() == docs.count()
    assert pii.pseudonymise(clashing, key="k").count() == docs.count()
    assert packing.pieces(clashing, vocabulary).count() == packing.pieces(docs, vocabulary).count()


def test_empty_tables(docs):
    none = docs.limit(0)
    counts = [exact_dedup.assign(none), exact_dedup.drop_copies(none), quality.verdict(none), mixing.mix(none), mixing.mixed(none), simhash.near_copies(none), simhash.drop_near_copies(none), line_dedup.mark(none), line_dedup.drop_lines(none), sharding.shard(none, 4), pii.pseudonymise(none, key="k"), langid.identify(none, langid.prototypes(none))]
    assert [x.count() for x in counts] == [0] * len(counts)


def test_null_identifiers(spark, vocabulary):
    df = spark.createDataFrame([(None, "some words here", None, None, None), (None, None, None, None, None), (1, "some words here", "en", "s", 3)], DOCS)
    assert simhash.near_copies(df).filter("component = 1").count() == 2
    assert mixing.mix(df).count() == 3 and sharding.shard(df, 2).count() == 3 and packing.pieces(df, vocabulary).count() == 3
    assert {r["id"]: r["n_dropped"] for r in line_dedup.mark(df).collect()} == {None: 0, 1: 1}
    assert langid.identify(df, langid.prototypes(df)).count() == 3 and math.isfinite(sum(r["score"] for r in langid.identify(df, {}).collect()))


def test_packing_keeps_null_identifiers(spark, vocabulary):
    from quarry.llm.common import cut

    rng = random.Random(3)
    df = spark.createDataFrame([(None if i % 3 else i, prose(rng, rng.randint(1, 90))) for i in range(60)], "doc_id long, text string")
    parts = cut(packing.pieces(df, vocabulary, capacity=64), "p")
    out = packing.pack(parts, capacity=64, district_rows=16).collect()
    assert Counter((r["row"], r["piece"]) for r in out) == Counter((r["row"], r["piece"]) for r in parts.collect())
    assert len({r["row"] for r in out if r["id"] is None}) == 40
    sequences = defaultdict(list)
    for r in out:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for s in sequences.values():
        assert all(at == sum(n for _, n in sorted(s)[:i]) for i, (at, _) in enumerate(sorted(s))) and sum(n for _, n in s) <= 64


def test_pseudonyms_of_values_before_numbers(spark):
    card, iban = "4111 1111 1111 1111", "ES91 2100 0418 4502 0005 1332"
    texts = [f"{card} 12/27", "4111111111111111 123", "4111-1111-1111-1111 2 times", f"{iban} 12", "AT611904300234573201 BIC", f"{iban} {card} 12/27"]
    tails = [" 12/27", " 123", " 2 times", " 12", " BIC", " 12/27"]
    texts += [f"4111 1111 1111 1111 {i}" for i in range(10, 60)]
    df = pii.pseudonymise(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), key="k")
    out = sorted(df.collect(), key=lambda r: r["doc_id"])
    for r, text, tail in zip(out, texts, tails + [t[-3:] for t in texts[6:]], strict=True):
        by_chance = text.startswith(card) and luhn(re.sub("[^0-9]", "", text))  # a longer number that passes as well
        assert r["found"] and (by_chance or r["text"].endswith(tail)) and len(r["text"]) == len(text)
        assert "1111 1111" not in r["text"] and "4111" not in r["text"][:4] and "2100 0418" not in r["text"] and "1904300234573201" not in r["text"]
    back = sorted(pii.pseudonymise(df.drop("found"), key="k", reverse=True).collect(), key=lambda r: r["doc_id"])
    assert [r["text"] for r in back] == texts


def test_written_forms_of_a_number_stay_linked(spark):
    """Phone numbers by their digits, mail addresses whatever their case; and back again."""
    forms = [["+1 555 123 4567", "+15551234567", "(555) 123-4567", "555-123-4567", "555.123.4567"], ["+44 20 7946 0958", "+442079460958", "+44-20-7946-0958"], ["+358 40 123 4567", "+358401234567"]]
    mails = ["Bob.Smith@Example.com", "bob.smith@example.com", "BOB.SMITH@EXAMPLE.COM"]
    texts = [f"call {x} now" for group in forms for x in group] + [f"to {x}." for x in mails]
    df = pii.pseudonymise(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), key="k")
    out = [r["text"] for r in df.orderBy("doc_id").collect()]
    at = 0
    for group, code in zip(forms, ("1", "44", "358"), strict=True):
        new = out[at : at + len(group)]
        at += len(group)
        national = {re.sub("[^0-9]", "", x).removeprefix(code if "+" in x else "") for x in new}
        assert len(national) == 1 and national != {re.sub("[^0-9]", "", group[-1]).removeprefix(code)}
        assert [re.sub("[0-9]", "0", x[5:-4]) for x in new] == [re.sub("[0-9]", "0", x) for x in group]
        assert all(x[5:].startswith(f"+{code}") for x in new if "+" in x)
    assert len({x.lower() for x in out[at:]}) == 1 and [re.sub("[a-z]", "a", re.sub("[A-Z]", "A", x)) for x in out[at:]] == [re.sub("[a-z]", "a", re.sub("[A-Z]", "A", x)) for x in texts[at:]]
    assert out[at] != texts[at]
    back = pii.pseudonymise(df.drop("found"), key="k", reverse=True).orderBy("doc_id").collect()
    assert [r["text"] for r in back] == texts


def test_groups_that_fit_a_shard_stay_whole(spark):
    rng = random.Random(18)
    texts = [prose(rng, 40) for _ in range(900)] + ["a text that many have " * 3] * 250 + ["another one " * 9] * 90
    made = [(i, t, "en", f"s{i % 7}", 0) for i, t in enumerate(texts)]
    total, places = Counter(), defaultdict(set)
    for r in sharding.shard(spark.createDataFrame(made, DOCS), 8).collect():
        total[r["shard"]] += r["size"]
        places[texts[r["id"]]].add(r["shard"])
    mean = sum(total.values()) / 8
    assert 0.5 * mean < 250 * (len(texts[900]) + 16) < mean and all(len(p) == 1 for p in places.values())
    assert max(abs(v - mean) for v in total.values()) <= 0.03 * mean


@pytest.mark.parametrize("part", ["<a ", "<a b='", '<a b="x>', "<!--", "<", "</", "</p ", "<p/", "<a//", "<script>", "<![CDATA[", "<?x", "&amp", "<p a=b "])
def test_broken_pages_are_read_once(part):
    began = time.perf_counter()
    html_main.main_text(part * 100_000)
    html_main.main_text("<a" + part[-1] * 200_000)
    assert time.perf_counter() - began < 5


def test_names_inside_articles():
    story = "".join(f"<p>Sentence {i} of the story, which goes on for a while.</p>" for i in range(6))
    kept = "\n".join(f"Sentence {i} of the story, which goes on for a while." for i in range(6))
    said = "<p>A reader says, at some length, that it is good.</p>" * 2
    for gone in ('<div id="comments">', '<div class="comments-area">', '<section class="post-comments">', '<div id="sidebar">', '<div id="cookie-banner">', '<div class="newsletter-signup">'):
        for tag in ("main", "article"):
            end = "</section>" if "section" in gone else "</div>"
            assert html_main.main_text(f"<body><{tag}><h1>Head</h1>{story}{gone}{said}{end}</{tag}></body>") == f"Head\n{kept}"
    own = "<h2>Points</h2><p>The results, as we read them, are clear enough.</p><p>They hold, with some care, for all cases.</p>"
    text = "Points\nThe results, as we read them, are clear enough.\nThey hold, with some care, for all cases."
    for stays, end in (('<div class="discussion">', "</div>"), ('<div class="notice">', "</div>"), ('<section id="discussion">', "</section>")):
        assert html_main.main_text(f"<body><article><h1>Head</h1>{story}{stays}{own}{end}</article></body>") == f"Head\n{kept}\n{text}"
    assert html_main.main_text(f"<body><h1>Head</h1>{story}<section id='discussion'>{own}</section></body>") == f"Head\n{kept}\n{text}"
    small = '<div class="notice"><p>We use files, see here.</p></div>'
    assert html_main.main_text(f"<body><article><h1>Head</h1>{story}{small}</article></body>") == f"Head\n{kept}"


# ---- a plain twin of the keyed permutations

def feistel(key, kind, left, right, left_size, right_size):
    for r in range(8):
        other = right if r % 2 == 0 else left
        h = int(hashlib.sha256(f"{key}|{kind}|{r}|{other}".encode()).hexdigest()[:12], 16)
        if r % 2 == 0:
            left = (left + h) % left_size
        else:
            right = (right + h) % right_size
    return left, right


def moved_digits(key, kind, d):
    half = len(d) // 2
    a, b = feistel(key, kind, int(d[:half]), int(d[half:]), 10**half, 10 ** (len(d) - half))
    return f"{a:0{half}d}{b:0{len(d) - half}d}"


def refilled(form, digits):
    rest = iter(digits)
    return "".join(next(rest) if c.isdigit() else c for c in form)


def luhn_digit(payload):
    total = sum(sum(divmod(int(c) * (2 - i % 2), 10)) for i, c in enumerate(reversed(payload)))
    return str(-total % 10)


def test_pseudonyms_equal_a_plain_feistel_network(spark):
    import datetime

    key, rng, made = "another key", random.Random(6), []
    for _ in range(25):
        digits = "".join(rng.choice("0123456789") for _ in range(15))
        card = digits + luhn_digit(digits)
        new = moved_digits(key, "card", digits)
        form = rng.choice(["{}{}{}{}", "{} {} {} {}", "{}-{}-{}-{}"]).format(*[card[i : i + 4] for i in (0, 4, 8, 12)])
        made.append((form, refilled(form, new + luhn_digit(new))))
        code, own = rng.choice(["1", "44", "358"]), "".join(rng.choice("0123456789") for _ in range(10))
        form = f"+{code} {own[:3]} {own[3:6]} {own[6:]}"
        made.append((form, refilled(form, code + moved_digits(key, f"phone|{code}", own))))
        area, group, serial = rng.choice([*range(1, 666), *range(667, 900)]), rng.randint(1, 99), rng.randint(1, 9999)
        place = area - (2 if area > 666 else 1)
        a, b = feistel(key, "ssn", place * 99 + group - 1, serial - 1, 898 * 99, 9999)
        area2 = a // 99 + (2 if a // 99 >= 665 else 1)
        made.append((f"{area:03d}-{group:02d}-{serial:04d}", f"{area2:03d}-{a % 99 + 1:02d}-{b + 1:04d}"))
        day = datetime.date(1900, 1, 1) + datetime.timedelta(rng.randrange(73_000))
        first, x, y = (datetime.date(1900, 1, 1), 92, 397) if day.year < 2000 else (datetime.date(2000, 1, 1), 75, 487)
        n = (day - first).days
        a, b = feistel(key, "date", n // y, n % y, x, y)
        new = first + datetime.timedelta(a * y + b)
        made += [(f"{day:%Y-%m-%d}", f"{new:%Y-%m-%d}"), (f"{day:%d.%m.%Y}", f"{new:%d.%m.%Y}")]
    df = spark.createDataFrame([(i, f"it is {old} there") for i, (old, _) in enumerate(made)], "doc_id long, text string")
    out = {r["doc_id"]: r["text"] for r in pii.pseudonymise(df, key=key).collect()}
    assert [out[i] for i in range(len(made))] == [f"it is {new} there" for _, new in made]


def test_content_nodes_equal_plain_tag_path_ratios():
    """A twin in plain arithmetic: ratios per path, smoothed along the page, multiplied, held against the spread."""
    rng = random.Random(13)
    tags = ["p", "li", "td", "b", "h2", "span", "div"]

    def fragment(depth):
        out = []
        for _ in range(rng.randint(1, 4)):
            t = rng.choice(tags)
            said = " ".join(rng.choice(["word", "more,", "end.", "&amp;", "x"]) for _ in range(rng.randint(0, 14)))
            out.append(f"<{t}>{said}{fragment(depth - 1) if depth and rng.random() < 0.6 else ''}</{t}>")
        return "".join(out)

    for _ in range(150):
        page = html_main.Page()
        page.feed(f"<body>{fragment(4)}</body>")
        paths = []
        for e, _, _ in page.texts:
            path = []
            while e > 0:
                path.append(page.tag[e])
                e = page.parent[e]
            paths.append("/".join(reversed(path)))
        texts = [" ".join(t.split()) for _, _, t in page.texts]
        seen = [i for i, t in enumerate(texts) if t]
        points = [sum(c in ".,;:!?" for c in t) for t in texts]
        of = defaultdict(list)
        for i in seen:
            of[paths[i]].append(i)
        mean = lambda xs: sum(xs) / len(xs)
        weights = [math.exp(-k * k / 2) for k in (-2, -1, 0, 1, 2)]

        def smooth(values):
            if len(values) < 2:
                return values
            at = lambda i: values[min(max(i, 0), len(values) - 1)]
            return [sum(w * at(i + k) for w, k in zip(weights, (-2, -1, 0, 1, 2))) / sum(weights) for i in range(len(values))]

        long = smooth([mean([len(texts[j]) for j in of[paths[i]]]) for i in seen])
        marks = smooth([mean([points[j] for j in of[paths[i]]]) for i in seen])
        fused = dict(zip(seen, (a * b for a, b in zip(long, marks))))
        limit = 0.2 * math.sqrt(mean([(x - mean(list(fused.values()))) ** 2 for x in fused.values()])) if fused else 0
        want = [bool(t) and mean([fused[j] for j in of[paths[i]]]) >= limit and any(points[j] for j in of[paths[i]]) for i, t in enumerate(texts)]
        near = [bool(t) and abs(mean([fused[j] for j in of[paths[i]]]) - limit) < 1e-9 for i, t in enumerate(texts)]
        assert [w for w, n in zip(want, near) if not n] == [c for c, n in zip(html_main.content_nodes(page), near) if not n]


def test_shards_equal_a_plain_walk_of_weighted_cuts(spark):
    """Every cut of the tree is along its node's widest dimension and as near to the wanted weight as one value allows,
    and the rows fall where a plain walk says."""
    rng = random.Random(23)
    made = [(i, prose(rng, max(1, int(rng.paretovariate(1.1) * 8) % 400)), rng.choice(["en", "fr", None]), f"s{int(rng.paretovariate(1)) % 9}", 0) for i in range(700)]
    made += [(700 + i, "a text that a good part of a shard holds", "en", "s1", 0) for i in range(40)]
    df = spark.createDataFrame(made, DOCS)
    points = sharding.points(df, 9, "doc_id", "text", ("source", "lang"))
    root = sharding.build(points, 9, 3)
    rows = [r.asDict() for r in points.collect()]
    target = sum(r["size"] for r in rows) / 9
    room = [target - sum(r["size"] for r in rows if r["home"] == s) for s in range(9)]
    place = {r["id"]: r["home"] for r in rows if r["home"] is not None}
    assert 0 < len(place) and len(set(place.values())) == 1

    def walk(node, own):
        if node.left is None:
            place.update({r["id"]: node.shard for r in own})
            return
        widths = [max(r[f"k{d}"] for r in own) // 2**32 - min(r[f"k{d}"] for r in own) // 2**32 for d in range(3)]
        assert node.dim == widths.index(max(widths))
        half = node.k // 2
        want = sum(r["size"] for r in own) * sum(room[node.shard : node.shard + half]) / sum(room[node.shard : node.shard + node.k])
        weight = Counter()
        for r in own:
            weight[r[f"k{node.dim}"]] += r["size"]
        sums, total = [0], 0
        for v in sorted(weight):
            total += weight[v]
            sums.append(total)
        below = sum(w for v, w in weight.items() if v <= node.cut)
        assert abs(below - want) <= min(abs(x - want) for x in sums) + sum(r["size"] for r in own) / node.k * 0.001
        walk(node.left, [r for r in own if r[f"k{node.dim}"] <= node.cut])
        walk(node.right, [r for r in own if r[f"k{node.dim}"] > node.cut])

    walk(root, [r for r in rows if r["home"] is None])
    assert {r["id"]: r["shard"] for r in sharding.shard(df, 9).collect()} == place
