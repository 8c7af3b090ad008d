"""Line deduplication by a segment-partition edit join, in DataFrame operations only.

Equal lines are one line, known by two independent 64-bit hashes, whatever their number. Each distinct line of at least
``min_chars`` characters is cut into ``threshold + 1`` segments of near equal length: of two lines within ``threshold``
edits, one keeps a segment of the other untouched. The segments are indexed by line length and place; a line probes, for
each length up to ``threshold`` shorter than its own, the substrings that can align with a segment (the
multi-match-aware windows, so the fewest that miss nothing). Index and probes meet in one equi-join on a hash of (length,
place, substring), which also compares sketches of the lines' letters; only hashes move, not lines.

A segment that very many lines have (a bounded sample tells which) would make all of them meet. The edits of such a pair
are all in the rest of the lines, so the rest is cut in segments again, and the pair must share a segment of the rest as
well. Which segments count as frequent changes the work, never the result.

Pairs that are left are verified on their texts by a banded bit-parallel edit distance: for each number of edits a word
of 2 x ``threshold`` + 1 bits holds which diagonals of the band can be reached, and each character moves all of them by
shifts and masks.

Linked lines form classes (components). A class keeps its first occurrence, by document identifier and line number;
``mark`` tells which lines of each document go, and ``drop_lines`` returns the documents without them.

Defined cases: a null text has no lines; blank lines are no lines and always stay; lines shorter than ``min_chars`` link
to equal lines only; very long lines are cut and hashed like others; rows with equal identifiers count as one document;
among rows with equal identifiers, equal line numbers share their fate; an empty table gives an empty result; other
columns are passed through by ``drop_lines``, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import SPACE, cut, text_or_empty
from quarry.llm.simhash import components

KEY = ["ka", "kb"]


def line_key(line: Column) -> list[Column]:
    return [F.xxhash64(line).alias("ka"), F.xxhash64(F.lit("second"), line).alias("kb")]


def occurrences(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per line that is not blank: id, no (from 0), line and its key."""
    rows = df.select(F.col(id_col).alias("id"), F.posexplode(F.split(text_or_empty(text_col), "\n")).alias("no", "line"))
    return rows.filter(F.col("line").rlike(f"[^{SPACE}]")).select("id", "no", "line", *line_key(F.col("line")))


def _segment(length: Column, i: int, threshold: int) -> tuple[Column, Column]:
    """Start (from 1) and length of segment i (from 1) of a line of this length; the last ones take the remainder."""
    k = threshold + 1
    base, longer = F.floor(length / k).cast("int"), k - length % k  # segments after the first ``longer`` have one more
    start = base * (i - 1) + F.greatest(F.lit(0), F.lit(i - 1) - longer) + 1
    return start, base + (F.lit(i) > longer).cast("int")


def _probes(threshold: int, shorter: int) -> list[tuple[int, int]]:
    """(segment, shift) of the substrings that a line probes in lines that are ``shorter`` by so many characters; those
    with shift 0 of its own length are its own segments."""
    out = []
    for i in range(1, threshold + 2):
        lo, hi = max(-(i - 1), shorter - (threshold + 1 - i)), min(i - 1, shorter + threshold + 1 - i)
        out += [(i, shift) for shift in range(lo, hi + 1)]
    return out


def signatures(line: Column, n: Column, threshold: int, frequent: list[int] | None = None) -> tuple[Column, Column]:
    """Two arrays of hashes of (length, place, substring): those of the line's own segments, and its further probes. A
    line of 3 x (threshold + 1) characters or more has room for all. A ``frequent`` hash gives way to those of it with the
    segments of the line's rest, where the rest has room."""
    own, further = [], []
    for shorter in range(threshold + 1):
        length = n - shorter
        for i, shift in _probes(threshold, shorter):
            start, size = _segment(length, i, threshold)
            sig = F.xxhash64(length, F.lit(i), F.substr(line, start + shift, size))
            mine = shorter == shift == 0
            if not frequent:
                (own if mine else further).append(F.array(sig))
                continue
            rest = F.concat(F.substr(line, F.lit(1), start + shift - 1), F.substr(line, start + shift + size, n))
            left = n - size - shorter  # characters of the rest of the line that is met
            deep = sig.isin(frequent) & (left >= 3 * (threshold + 1))

            def inner(probes: list[tuple[int, int]], sig: Column = sig, rest: Column = rest, left: Column = left) -> Column:
                out = []
                for j, move in probes:
                    at, long = _segment(left, j, threshold)
                    out.append(F.xxhash64(sig, F.lit(j), F.substr(rest, at + move, long)))
                return F.flatten(F.transform(F.array(F.lit(0)), lambda _: F.array(*out)))  # in a lambda, as it is rare and long

            every = _probes(threshold, shorter)
            if mine:
                own.append(F.when(deep, inner([x for x in every if x[1] == 0])).otherwise(F.array(sig)))
                others = [x for x in every if x[1] != 0]
                if others:
                    further.append(F.when(deep, inner(others)).otherwise(F.array().cast("array<bigint>")))
            else:
                further.append(F.when(deep, inner(every)).otherwise(F.array(sig)))
    return F.flatten(F.array(*own)), F.flatten(F.array(*further))


#: Characters that are counted in a sketch; which ones only matters for speed.
COUNTED = " etaoinsrhldcum.pgybfw,é"


def letter_sketch(line: Column) -> Column:
    """Two bits for each of 24 characters: the Gray code of its count modulo 4, in which counts that differ by one
    differ in one bit. An edit takes at most one character out and puts one in, so it flips at most two bits."""
    out = F.lit(0).cast("long")
    for k, c in enumerate(COUNTED):
        count = F.octet_length(line) - F.octet_length(F.replace(line, F.lit(c), F.lit("")))
        count = F.shiftright(count, 1) if len(c.encode()) > 1 else count  # two bytes each
        out = out.bitwiseOR(F.shiftleft(count.bitwiseXOR(F.shiftright(count, 1)).bitwiseAND(F.lit(3)).cast("long"), 2 * k))
    return out


#: From this bit on a sketch has the line's length modulo 8; lines that meet differ by 4 characters at most.
LENGTH_AT = 2 * len(COUNTED)


def length_sketch(line: Column) -> Column:
    return F.shiftleft((F.length(line) % 8).cast("long"), LENGTH_AT).bitwiseOR(letter_sketch(line))


#: Characters that are counted in the lines of a pair; which ones only matters for speed.
PAIR_COUNTED = " abcdefghijklmnopqrstuvwxyz0123456789.,;:-"


def letter_counts(line: Column) -> Column:
    return F.array(*[F.octet_length(line) - F.octet_length(F.replace(line, F.lit(c), F.lit(""))) for c in PAIR_COUNTED])


def counts_allow(a: Column, b: Column, threshold: int) -> Column:
    """Whether letter counts are such that ``threshold`` edits could do: each takes one character out or puts one in, or
    both."""
    lost = lambda x, y: F.aggregate(F.zip_with(x, y, lambda m, n: F.greatest(m - n, F.lit(0))), F.lit(0), lambda s, v: s + v)
    return (lost(a, b) <= threshold) & (lost(b, a) <= threshold)


def within_edits(a: Column, b: Column, threshold: int) -> Column:
    """Whether two strings are within ``threshold`` edits, by bits for the diagonals of the band."""
    k, width = threshold, 2 * threshold + 1
    band = (1 << width) - 1
    # bit k + o of level e: after i characters of a and i + o of b, with e edits at most
    start = sum((((1 << (e + 1)) - 1) << k & band) << (e * width) for e in range(k + 1))

    def step(state: Column, x: Column, right: Column) -> Column:
        same = F.lit(0).cast("long")
        for j in range(width):
            same = same.bitwiseOR(F.when(F.get(right, x["i"] + (j - k)) == x["c"], F.lit(1 << j).cast("long")).otherwise(F.lit(0).cast("long")))

        def moved(m: Column) -> Column:
            level = lambda e: F.shiftrightunsigned(state, e * width).bitwiseAND(F.lit(band))
            now, out = None, None
            for e in range(k + 1):
                reached = level(e).bitwiseAND(m)
                if e:  # another character, one of a left out, one of b put in
                    before = level(e - 1)
                    reached = reached.bitwiseOR(before).bitwiseOR(F.shiftrightunsigned(before, 1)).bitwiseOR(F.shiftleft(now, 1).bitwiseAND(F.lit(band)))
                now = reached
                out = now if out is None else out.bitwiseOR(F.shiftleft(now, e * width))
            return out

        return F.get(F.transform(F.array(same), moved), F.lit(0))

    def walked(right: Column) -> Column:  # the characters of b, split once
        placed = F.transform(F.split(a, ""), lambda c, i: F.struct(c.alias("c"), i.alias("i")))
        return F.aggregate(placed, F.lit(start).cast("long"), lambda state, x: step(state, x, right))

    def ends(last: Column) -> Column:
        place = F.pow(F.lit(2.0), F.length(b) - F.length(a) + k).cast("long")  # the diagonal of both ends
        levels = [F.shiftrightunsigned(last, e * width).bitwiseAND(place) != 0 for e in range(k + 1)]
        return F.exists(F.array(*levels), lambda x: x)

    once = lambda value, body: F.get(F.transform(F.array(value), body), F.lit(0))
    return F.when(F.abs(F.length(a) - F.length(b)) > k, False).when((a == "") | (b == ""), True).otherwise(once(once(F.split(b, ""), walked), ends))


def frequent_segments(rows: DataFrame, threshold: int, n: int | None = None, *, sample_rows: int = 200_000, least: int = 64, most: int = 2000) -> list[int]:
    """Hashes of the segments that at least ``least`` distinct lines of a sample of about ``sample_rows`` have, the most
    frequent ``most`` of them."""
    n = rows.count() if n is None else n
    share = min(1.0, sample_rows / max(1, n))
    sample = rows.filter(F.pmod("ka", F.lit(1 << 30)) < int(share * (1 << 30))).groupBy("ka").agg(F.first("line").alias("line"))
    own, _ = signatures(F.col("line"), F.length("line"), threshold)
    counts = sample.select(F.explode(own).alias("sig")).groupBy("sig").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    return [r["sig"] for r in counts.orderBy(F.desc("n"), "sig").limit(most).collect()]


def signed_lines(df: DataFrame, threshold: int, min_chars: int, id_col: str, text_col: str, n: int | None = None, **sampling) -> DataFrame:
    """One row per distinct line that may link to another: ka, sketch and sigs, an array of the number of its own
    segments' hashes, these, and its further probes. ``n``: how many lines there are about."""
    if not 1 <= threshold <= 4:
        raise ValueError("threshold must be from 1 to 4")
    if min_chars < 3 * (threshold + 1):
        raise ValueError("min_chars must be at least 3 x (threshold + 1)")
    rows = occurrences(df, id_col, text_col).filter(F.length("line") >= min_chars)
    own, further = signatures(F.col("line"), F.length("line"), threshold, frequent_segments(rows, threshold, n, **sampling))
    rows = rows.select("ka", own.alias("own"), further.alias("further"), length_sketch(F.col("line")).alias("sketch"))
    rows = rows.select("ka", F.concat(F.array(F.size("own").cast("long")), "own", "further").alias("sigs"), "sketch")
    return rows.groupBy("ka").agg(F.first("sigs").alias("sigs"), F.first("sketch").alias("sketch"))  # equal lines are one


def index_hashes() -> Column:
    return F.slice("sigs", F.lit(2), F.get("sigs", F.lit(0)).cast("int"))


def probe_hashes() -> Column:
    return F.slice("sigs", F.lit(2), F.size("sigs"))


def line_pairs(lines: DataFrame, threshold: int) -> DataFrame:
    """Pairs (a, b) of ``ka`` of the signed ``lines`` that share a segment and whose sketches are as near as ``threshold``
    edits allow."""
    return met_lines(lines, threshold).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def met_lines(lines: DataFrame, threshold: int) -> DataFrame:
    """Each such pair (x, y) as often as segments of x meet probes of y. Either of two lines of one length finds the other
    if they are within ``threshold`` edits, so the greater ``ka`` alone is asked to."""
    index = lines.select(F.col("ka").alias("x"), F.col("sketch").alias("sx"), F.explode(index_hashes()).alias("sig"))
    probe = lines.select(F.col("ka").alias("y"), F.col("sketch").alias("sy"), F.explode(probe_hashes()).alias("sig"))
    apart = F.col("sx").bitwiseXOR(F.col("sy"))
    near = F.bit_count(apart.bitwiseAND(F.lit((1 << LENGTH_AT) - 1))) <= 2 * threshold
    other_length = F.shiftrightunsigned(apart, LENGTH_AT) != 0
    return index.join(probe, (index["sig"] == probe["sig"]) & ((F.col("x") < F.col("y")) | (other_length & (F.col("x") != F.col("y")))) & near)


def line_links(df: DataFrame, pairs: DataFrame, lines: DataFrame, threshold: int, id_col: str, text_col: str, *, max_rows: int = 1 << 19, pairs_per_task: int = 1000) -> DataFrame:
    """Those of the ``pairs`` that are within ``threshold`` edits, as numbers of ``lines``, which says where they are. Only
    the documents that hold the pairs' first occurrences are read for it; they are shuffled where those are more than
    ``max_rows``."""
    keys = cut(pairs.select(F.explode(F.array("a", "b")).alias("ka")).distinct(), "pair-keys")
    wanted = keys.join(lines, "ka").groupBy(F.col("at.id").alias("id")).agg(F.collect_list(F.struct(F.col("at.no").alias("no"), "ka", "kb", "num")).alias("lines"))
    wanted = cut(wanted, "wanted-lines")  # of a document at most its own lines
    few = keys.limit(max_rows + 1).count() <= max_rows
    docs = df.select(F.col(id_col).alias("doc"), text_or_empty(text_col).alias("text"))
    texts = docs.join(wanted.hint("broadcast" if few else "merge"), docs["doc"].eqNullSafe(wanted["id"]))
    texts = texts.select(F.split("text", "\n").alias("all"), "lines").select(F.inline(F.transform("lines", lambda x: F.struct(x["num"].alias("num"), x["ka"].alias("ka"), x["kb"].alias("kb"), F.get("all", x["no"]).alias("line")))))
    ka, kb = line_key(F.col("line"))
    texts = cut(texts.filter((F.col("ka") == ka) & (F.col("kb") == kb)).groupBy("num", "ka").agg(F.first("line").alias("line")), "pair-lines")
    texts = texts.withColumn("counts", letter_counts(F.col("line")))
    left, right = (texts.select(F.col("ka").alias(p), F.col("num").alias(f"n{p}"), F.col("line").alias(f"l{p}"), F.col("counts").alias(f"c{p}")) for p in ("a", "b"))
    met = pairs.join(left, "a").join(right, "b").filter(counts_allow(F.col("ca"), F.col("cb"), threshold)).select("na", "nb", "la", "lb")
    met = met.repartition(max(1, -(-pairs.count() // pairs_per_task)))  # characters cost more than the rows' bytes tell
    near = met.filter(within_edits(F.col("la"), F.col("lb"), threshold))
    return near.select(F.least("na", "nb").alias("a"), F.greatest("na", "nb").alias("b"))


def classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, threshold: int = 2, min_chars: int = 20, **sampling) -> DataFrame:
    """One row per distinct line: its key, the class's first occurrence (first), rows of the line, its links."""
    lines = occurrences(df, id_col, text_col).groupBy(*KEY).agg(F.min(F.struct("id", "no")).alias("at"), F.count(F.lit(1)).alias("n"))
    lines = cut(lines.withColumn("num", F.monotonically_increasing_id()), "lines")
    signed = signed_lines(df, threshold, min_chars, id_col, text_col, lines.count(), **sampling)
    pairs = cut(line_pairs(signed, threshold), "line-pairs")
    links = cut(line_links(df, pairs, lines, threshold, id_col, text_col), "line-links")
    degree = links.select(F.explode(F.array("a", "b")).alias("num")).groupBy("num").agg(F.count(F.lit(1)).alias("links"))
    linked = degree.join(components(links).withColumnRenamed("node", "num"), "num", "left").select("num", "links", F.coalesce("root", "num").alias("root"))
    linked = cut(linked, "line-classes")
    all_lines = lines.join(linked, "num", "left").withColumn("links", F.coalesce("links", F.lit(0)))
    firsts = cut(all_lines.filter("root IS NOT NULL").groupBy("root").agg(F.min("at").alias("first")), "line-firsts")
    return all_lines.join(firsts, "root", "left").select(*KEY, F.coalesce("first", "at").alias("first"), "n", "links")


def mark(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per document: id, n_lines, n_links (links of its lines to other lines), n_dropped and dropped, the
    numbers of the lines that repeat an earlier line exactly or nearly."""
    known = cut(classes(df, id_col, text_col, **options), "line-table")
    joined = occurrences(df, id_col, text_col).select("id", "no", *KEY).join(known, KEY, "left")
    goes = ~F.struct("id", "no").eqNullSafe(F.struct(F.col("first.id").alias("id"), F.col("first.no").alias("no")))
    per_doc = joined.groupBy("id").agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.coalesce(F.sum("links"), F.lit(0)).alias("n_links"),
        F.sort_array(F.collect_set(F.when(goes, F.col("no")))).alias("dropped"),
    )
    none = F.array().cast("array<int>")
    every = df.select(F.col(id_col).alias("doc")).distinct()
    out = every.join(per_doc, every["doc"].eqNullSafe(per_doc["id"]), "left").select(F.col("doc").alias("id"), F.coalesce("n_lines", F.lit(0)).alias("n_lines"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("dropped", none).alias("dropped"))
    return out.select("id", "n_lines", "n_links", F.size("dropped").cast("long").alias("n_dropped"), "dropped")


def drop_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``df`` with the lines that ``mark`` drops taken out of its text."""
    marked = cut(mark(df, id_col, text_col, **options).filter("n_dropped > 0").select(F.col("id").alias("_ld_id"), F.col("dropped").alias("_ld_dropped")), "line-marks")
    lines = F.split(F.col(text_col), "\n")
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("_ld_dropped"))
    text = F.when(F.col("_ld_dropped").isNull(), F.col(text_col)).otherwise(F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n"))
    return df.join(marked, F.col(id_col).eqNullSafe(F.col("_ld_id")), "left").withColumn(text_col, text).select(*[f"`{c}`" for c in df.columns])
