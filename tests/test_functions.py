import hashlib
import math
from urllib.parse import quote

import pytest
from pyspark.sql import functions as F

from quarry.functions import lines, links, paths, vectors
from quarry.operators import chunk, discover, embed


def column(spark, values, expression, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[1] for r in rows.select("i", expression(F.col("x"))).orderBy("i").collect()]


def test_skip_reasons(spark):
    """One path or more for every entry of every rule."""
    cases = [(f"team{i}/{d}/part/unit.lua", "excluded_dir") for i, d in enumerate(paths.EXCLUDED_DIRS)] + [("./obj//.//deep.kt", "excluded_dir")]
    cases += [(f"team/{n}", "secret") for n in paths.SECRET_NAMES] + [(f"keys/store{e.upper()}", "secret") for e in paths.SECRET_SUFFIXES] + [(f"{n}_old.sql", "secret") for n in paths.SECRET_PREFIXES]
    cases += [(f"web/{n}", "lockfile") for n in paths.LOCKFILES] + [(f"web/theme{e}", "generated") for e in paths.GENERATED_SUFFIXES]
    cases += [(f"team/sheet.{e}", None) for e in paths.EXTENSIONS] + [(n, None) for n in paths.ALLOWED_NAMES] + [(f"team/{n}zz", None) for n in paths.ALLOWED_PREFIXES]
    cases += [(x, "unsupported_type") for x in ("uv.lock", "art/photo.tiff", "ledger.qqq", "vendor", "")] + [("team/vendor.hs", None), ("nested/dist.css", None)]
    assert column(spark, [x for x, _ in cases], paths.skip_reason) == [r for _, r in cases]


def test_languages(spark):
    known = {f"sheet.{e}": language for e, language in paths.EXTENSIONS.items()} | {f"SHEET.x.{e.upper()}": language for e, language in paths.EXTENSIONS.items()} | dict(paths.NAMES)
    unknown = ["ledger.qqq", "plainname", "COPYING", "Dockerfile.build", ".rs", "sheet.", ""]
    assert column(spark, [*known, *unknown], paths.language_of) == [*known.values(), *[None] * len(unknown)]


def test_binary(spark):
    values = [b"\x00", b"text, then\x00", b"only text\n", b"", b"z" * 8192 + b"\x00", b"z" * 8191 + b"\x00"]
    assert column(spark, values, lambda x: paths.looks_binary(x, 8192), "binary") == [True, True, False, False, False, True]


def test_lines_are_those_of_splitlines(spark):
    breaks = ["\n", "\r", "\r\n", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x85", " ", " "]
    texts = ["", "a", "a\n", "\n", "\n\n\n", "a\r\n\r\nb", "a\n\rb", "\r\n", "   ", *[f"a{b}b{b}" for b in breaks], *[f"{b}a" for b in breaks]]
    assert column(spark, texts, lines.lines) == [t.splitlines() for t in texts]


def test_decoding(spark):
    values = [b"caf\xc3\xa9", b"\xff\xfe", b"a\xe2\x82", b"\xed\xa0\x80x", b""]
    assert column(spark, values, lines.decoded, "binary") == [v.decode("utf-8", "replace") for v in values]


@pytest.mark.parametrize(("n", "window", "overlap", "spans"), [(1, 40, 10, [(1, 1)]), (41, 40, 10, [(1, 40), (31, 41)]), (12, 12, 3, [(1, 12)]), (13, 12, 3, [(1, 12), (10, 13)]), (23, 9, 0, [(1, 9), (10, 18), (19, 23)]), (0, 40, 10, [])])
def test_windows(spark, n, window, overlap, spans):
    text = "\n".join(f"line{i}" for i in range(1, n + 1))
    rows = chunk.chunked(spark.createDataFrame([("p", text)], "path string, text string"), window=window, overlap=overlap).orderBy("chunk_index").collect()
    assert [(r["start_line"], r["end_line"]) for r in rows] == spans
    for i, r in enumerate(rows):
        content = "\n".join(text.splitlines()[r["start_line"] - 1 : r["end_line"]])
        assert r["chunk_index"] == i and r["content"] == content
        assert r["content_sha256"] == hashlib.sha256(f"p\n{r['start_line']}\n{r['end_line']}\n{content}".encode()).hexdigest()


def test_windows_match_a_plain_count(spark):
    cases = [(n, w, o) for n in range(0, 60, 3) for w, o in ((1, 0), (7, 3), (10, 9), (12, 0))]
    for w, o in {(w, o) for _, w, o in cases}:
        ns = [n for n, a, b in cases if (a, b) == (w, o)]

        def plain(n, w=w, o=o):
            out, at = 0, 0
            while n and at < n:
                out += 1
                if at + w >= n:
                    break
                at += w - o
            return out

        assert column(spark, ns, lambda x, w=w, o=o: lines.window_count(x, w, o), "int") == [plain(n) for n in ns]


@pytest.mark.parametrize(("window", "overlap"), [(0, 0), (-3, 0), (7, 7), (7, 9), (5, -1)])
def test_bad_windows(window, overlap):
    with pytest.raises(ValueError):
        lines.check_window(window, overlap)


@pytest.mark.parametrize("dim", [8, 64, 100, 768])
def test_hash_vectors(spark, dim):
    texts = ["seven", "eight words", "let x = 1;", "", "ß\n"]

    def plain(text):
        raw = b"".join(hashlib.sha256(f"{i}:{text}".encode()).digest() for i in range(-(-dim // 16)))
        v = [int.from_bytes(raw[2 * i : 2 * i + 2]) / 65535 - 0.5 for i in range(dim)]
        length = math.sqrt(sum(x * x for x in v))
        return [x / length for x in v]

    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    made = embed.HashProvider(dim).column(rows, "text", "v").orderBy("i").collect()
    for r, t in zip(made, texts, strict=True):
        assert r["v"] == pytest.approx(plain(t), abs=1e-6)
        assert math.sqrt(sum(x * x for x in r["v"])) == pytest.approx(1, abs=1e-6)


def test_cosine(spark):
    rows = spark.createDataFrame([([1.0, 0.0], [0.0, 2.0]), ([1.0, 1.0], [-1.0, -1.0]), ([3.0, 4.0], [3.0, 4.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<float>, b array<float>")
    assert [r[0] for r in rows.select(vectors.cosine(F.col("a"), F.col("b"))).collect()] == [0.0, pytest.approx(-1), pytest.approx(1), None]


def test_wrong_width_stops_the_job(spark):
    rows = spark.createDataFrame([([1.0, 0.0],)], "a array<float>")
    with pytest.raises(Exception, match="width 3"):
        rows.select(vectors.checked_width(F.col("a"), 3)).collect()


def test_urls(spark):
    base = "https://github.com/crate-works/big_bin"
    good = {base: "big_bin", f"{base}.git": "big_bin", f"{base}/": "big_bin", f"\t {base}\u3000\n": "big_bin", f"{base}?tab=x#part": "big_bin", "HTTPS://GitHub.COM/9/x.y-z_0": "x.y-z_0", f"https://github.com/{'a' * 100}/b": "b", f"https://github.com:0/c/d{' ' * 50_000}": "d"}
    schemes = [base.replace("https", x) for x in ("http", "ftp", "git+https", "")]
    hosts = [base.replace("github.com", x) for x in ("github.com.example.net", "www.github.com", "example.net", "me@github.com", "me:pw@github.com", "github.com:8443")]
    places = ["https://github.com", "https://github.com/", "https://github.com/crate-works", f"{base}/issues", "https://github.com/-x/y", "https://github.com/x/.y", "https://github.com/x/" + "y" * 101, "https://github.com/x/y z"]
    bad = [*schemes, *hosts, *places, f"{base[:30]}\n{base[30:]}", f"{base}\x00", " ", "", "big bin", None]
    out = column(spark, [*good, *bad], links.parsed_url)
    assert [x["repo_name"] for x in out] == [*good.values(), *[None] * len(bad)]
    assert all((x["reason"] is None) == (x["clone_url"] is not None) for x in out)


def test_citation_parts_are_encoded(spark):
    values = ["a b", "x+y", "ü/ñ", "!'()*~-_.", "#?&="]
    assert column(spark, values, links.encoded) == [quote(v, safe="!'()*~-_.") for v in values]


def test_classified_passes_other_columns(spark):
    rows = spark.createDataFrame([("x.py", "old", 1)], "path string, note string, n int")
    assert discover.classified(rows).first().asDict() == {"path": "x.py", "note": "old", "n": 1, "keep": True, "reason": None, "language": "python"}
