"""SimHash near-duplicates found through vantage-point trees.

A fingerprint has a bit set where over half of the text's shingle hashes have it set; further words of a long
fingerprint come from the same hashes, mixed anew. A vantage-point tree partitions fingerprints by Hamming distance: a
node's vantage point splits its points at their median distance. It is fitted on a bounded sample, which only decides the
balance, never the result. By the triangle inequality a fingerprint within ``near`` bits of another can only be in leaves
whose distance shells, widened by ``near``, hold the latter; all other branches are pruned. So each fingerprint is stored
in its own leaf and sent as a query to the overlapping leaves that come later in the tree, and every pair within ``near``
bits meets once. Whole words are too long for that: the distances of unlike texts lie close together. The trees therefore
stand over blocks of bits, one tree for each block, whose distance obeys the triangle inequality as well.

``near_copies`` links fingerprints of one word at ``radius`` or fewer differing bits. It is exact: two within ``radius``
are within radius // parts bits in one of ``parts`` blocks, and every pair met is compared on all bits.

``similar_texts`` links texts that share at least ``threshold`` of their shingles. The trees over the blocks of a long
fingerprint find candidates, whose bounds follow from the angle between shingle sets at the threshold, not from data; each
candidate pair is then compared on the shingles' hashes. In a first round every text meets its nearest neighbours, which
joins nearly all groups with few pairs; in a second one, texts that had more neighbours than that meet those of other
groups, in trees of their own. Their pairs are compared by fingerprints four times as long, which move only to those
pairs. A pair at the threshold is missed with a probability of about one per cent, and less above it. Work grows with the square of a group only where its texts are near the threshold, but below it.

A leaf with more points than ``8 * leaf_rows`` is dealt in slices, of points and of queries: every pair of slices is a
task of its own. Components are found by alternating large-star and small-star steps, with lineage cut at each step. A
component is named by the smallest identifier reachable; rows take it by an equi-join, whose hot keys Spark splits.

Defined cases: a null or empty text has fingerprint zero and links like any other; a text with fewer words than a
shingle has one shingle, its whole word sequence; very long texts are read whole, in memory that grows with their length;
equal texts and repeated rows have equal fingerprints and components; null identifiers never name a component unless it
has no other; an empty table gives an empty result; other columns are ignored and, by the functions that drop rows, passed
through whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import cut, dropped, restricted, text_or_empty

ONES = np.uint64(0x0101010101010101)


def shingle_hashes(text: bytes, width: int) -> np.ndarray:
    """XXH64 of each shingle of a UTF-8 text: bytes.lower and bytes.split know ASCII letters and white space only."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < width:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*[words[i:] for i in range(width)], strict=False))
    return np.fromiter((xxhash.xxh64_intdigest(s, 42) for s in shingles), dtype=np.uint64)


def mixed_words(h: np.ndarray, words: int) -> np.ndarray:
    """The hashes, and ``words - 1`` further ones of each by the finaliser of the SplitMix generator."""
    out = np.empty((words, len(h)), np.uint64)
    out[0] = h
    z = h[None, :] + (np.arange(1, words, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[:, None]
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    out[1:] = z ^ (z >> np.uint64(31))
    return out


def majority(h: np.ndarray) -> np.ndarray:
    """Of hashes (words, n): the bits that over half of the n have set, as ``words`` numbers."""
    words, n = h.shape
    counts = np.zeros((words, 64), dtype=np.int64)
    pad = np.zeros((words, -n % 255), np.uint64)
    for b in range(8):  # bit b of all eight bytes at once, in sums that fit a byte
        part = np.concatenate([(h >> np.uint64(b)) & ONES, pad], axis=1).reshape(words, -1, 255)
        counts[:, b::8] = np.add.reduce(part, axis=2).view(np.uint8).reshape(words, -1, 8).sum(axis=1, dtype=np.int64)
    return np.packbits(2 * counts > n, axis=1, bitorder="little").view("<u8").ravel()


def fingerprint(text: bytes, width: int = 3) -> int:
    """The fingerprint of one word, over all shingles, repeats included."""
    h = shingle_hashes(text, width)
    return int(majority(h[None, :])[0]) if len(h) else 0


def fingerprints(df: DataFrame, width: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: id and its fingerprint ``f0``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py(), width) for t in batch.column("text").cast(pa.binary())], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found)], names=["id", "f0"])

    return df.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text")).mapInArrow(run, "id long, f0 long")


class Tree:
    """A vantage-point tree over 64-bit fingerprints, under the Hamming distance of the bits in ``mask``."""

    def __init__(self, sample: np.ndarray, mask: int, leaf_points: int, seed: int = 0):
        self.mask = np.uint64(mask)
        self.rng = np.random.default_rng(seed)
        self.nodes: list[tuple[np.uint64, int, int, int]] = []  # vantage point, median, inner and outer child; a leaf is ~number
        self.leaves = 0
        self.root = self._grow(sample, leaf_points)

    def distance(self, x: np.ndarray, v: np.uint64) -> np.ndarray:
        return np.bitwise_count((x ^ v) & self.mask)

    def _grow(self, points: np.ndarray, leaf_points: int) -> int:
        best = None
        if len(points) > leaf_points:
            for v in self.rng.choice(points, 5):
                d = self.distance(points, v)
                mu = int(np.median(d))
                mu -= bool(np.all(d <= mu))
                inner = np.count_nonzero(d <= mu)
                if 0 < inner < len(points) and (best is None or d.std() > best[0]):
                    best = (d.std(), v, mu, d <= mu)
        if best is None:
            self.leaves += 1
            return ~(self.leaves - 1)
        _, v, mu, inside = best
        at = len(self.nodes)
        self.nodes.append(None)
        self.nodes[at] = (v, mu, self._grow(points[inside], leaf_points), self._grow(points[~inside], leaf_points))
        return at

    def route(self, x: np.ndarray, radius: int, queries: bool) -> Iterator[tuple[int, np.ndarray, bool]]:
        """(leaf, positions in x, whether it is their own leaf); with ``queries`` also the later leaves that may hold
        points within ``radius``."""
        todo = [(self.root, np.arange(len(x)), True)]
        while todo:
            at, rows, home = todo.pop()
            if not len(rows):
                continue
            if at < 0:
                yield ~at, rows, home
                continue
            v, mu, inner, outer = self.nodes[at]
            d = self.distance(x[rows], v).astype(np.int64)
            if home:
                inside = d <= mu
                todo += [(inner, rows[inside], True), (outer, rows[~inside], True)]
                if queries:  # outer leaves are later ones: those points need not come here
                    todo.append((outer, rows[inside & (d + radius > mu)], False))
            else:
                todo += [(inner, rows[d - radius <= mu], False), (outer, rows[d + radius > mu], False)]


@dataclass
class Forest:
    """Trees over blocks of bits: ``word[k]`` is the number of the fingerprint's word in which block k lies."""

    trees: list[Tree]
    word: list[int]
    near: int
    most: int


def planted(points: DataFrame, blocks: list[tuple[int, int]], near: int, *, leaf_rows: int, sample_rows: int) -> Forest:
    """Trees over ``blocks`` (word, mask) of the ``points`` (f0, f1, ...)."""
    n = points.count()
    share = min(1.0, sample_rows / max(1, n))
    names = [f"f{w}" for w in sorted({w for w, _ in blocks})]
    hashed = F.pmod(F.xxhash64("f0", F.lit("sample")), F.lit(1 << 30)) < int(share * (1 << 30))
    sample = points.filter(hashed).select(*names).limit(2 * sample_rows).toArrow()
    columns = {c: sample.column(c).to_numpy().astype(np.int64).view(np.uint64) for c in names}
    leaf_points = max(4, int(leaf_rows * sample.num_rows / max(1, n)))
    trees = [Tree(columns[f"f{w}"], mask, leaf_points, seed=k) for k, (w, mask) in enumerate(blocks)]
    return Forest(trees, [w for w, _ in blocks], near, 8 * leaf_rows)


def _slice_of(pid: np.ndarray, slices: int) -> np.ndarray:
    return ((pid.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % slices


def routed(points: DataFrame, forest: Forest, carried: Callable[[int], list[str]]) -> DataFrame:
    """``points`` (pid, f0, ...; written) in their own and all overlapping leaves of each tree, as tasks (part, leaf, i, j).
    Role 0: compare with all rows of the task; role 1: a slice that is compared with role 0 only, of which nothing else
    is wanted here; role 2: queries from other leaves. ``carried(word)`` names the columns that come along, as c0, c1, ..."""
    trees, word, near, most = forest.trees, forest.word, forest.near, forest.most

    def values(batch: pa.RecordBatch, k: int) -> np.ndarray:
        return batch.column(f"f{word[k]}").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(k, at, len(rows) if home else 0, 0 if home else len(rows)) for k, tree in enumerate(trees) for at, rows, home in tree.route(values(batch, k), near, True)]
            columns = list(zip(*out, strict=True)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int64(), pa.int64()), strict=True)], names=["part", "leaf", "homes", "queries"])

    words = sorted({f"f{w}" for w in word})
    found = points.select(*words).mapInArrow(sizes, "part int, leaf int, homes long, queries long").groupBy("part", "leaf").agg(F.sum("homes").alias("homes"), F.sum("queries").alias("queries"))
    large = found.filter((F.col("homes") > most) | (F.col("queries") > most)).collect()  # leaves are bounded by the sample
    slices = {(r["part"], r["leaf"]): (max(1, -(-r["homes"] // most)), max(1, -(-r["queries"] // most))) for r in large}

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pid = batch.column("pid").to_numpy(zero_copy_only=False).astype(np.int64)
            for k, tree in enumerate(trees):
                out: list[tuple[np.ndarray, ...]] = []
                for at, rows, home in tree.route(values(batch, k), near, True):
                    s, u = slices.get((k, at), (1, 1))
                    same = np.zeros(len(rows), np.int32)
                    mine = _slice_of(pid[rows], s if home else u)
                    for t in range(s):
                        if home:  # to the tasks of its slice and each other slice, and of its slice and each further slice of queries
                            out.append((same + at, np.minimum(mine, t), np.maximum(mine, t), (mine > t).astype(np.int32), rows))
                        else:
                            out.append((same + at, same + t, np.where(mine == 0, t, s + mine - 1), np.where(mine == 0, 2, 1), rows))
                    for q in range(1, u if home else 1):
                        out.append((same + at, mine, same + s + q - 1, same, rows))
                if out:
                    leaf, i, j, role, rows = (np.concatenate(c) for c in zip(*out, strict=True))
                    took = batch.take(pa.array(rows))
                    keys = [pa.array(np.full(len(rows), k), pa.int32()), *[pa.array(c, pa.int32()) for c in (leaf, i, j, role)]]
                    own = ["pid", *carried(word[k])]
                    yield pa.RecordBatch.from_arrays([*keys, *[took.column(c) for c in own]], names=["part", "leaf", "i", "j", "role", "pid", *[f"c{n}" for n in range(len(own) - 1)]])

    kinds = dict(points.dtypes)
    schema = "part int, leaf int, i int, j int, role int, pid long" + "".join(f", c{n} {kinds[c]}" for n, c in enumerate(carried(0)))
    needed = dict.fromkeys(["pid", *words, *[c for w in sorted(set(word)) for c in carried(w)]])
    return points.select(*needed).mapInArrow(dealt, schema)


TASK = ["part", "leaf", "i", "j"]


def _unsigned(column: pd.Series) -> np.ndarray:
    return column.to_numpy(np.int64).view(np.uint64)


def _forest(pdf: pd.DataFrame, radius: int) -> pd.DataFrame:
    """A spanning forest of the links of a leaf's points (role 0) among themselves and with the other roles."""
    pdf = pdf.sort_values(["role", "pid"], kind="stable")
    f, pid, role = _unsigned(pdf["c0"]), pdf["pid"].to_numpy(np.int64), pdf["role"].to_numpy()
    own = int(np.count_nonzero(role == 0))
    label = np.arange(len(pdf))
    cross_only = bool(own and (role == 1).any())  # two slices: only links between them are wanted here
    step = max(1, 4_000_000 // max(1, len(pdf)))
    for lo in range(0, own, step):
        near = np.bitwise_count(f[lo : min(lo + step, own), None] ^ f[None, :]) <= radius
        if cross_only:
            near[:, :own] = False
        for i in np.flatnonzero(np.count_nonzero(near, axis=1) > (0 if cross_only else 1)):
            met = np.unique(np.append(label[near[i]], label[lo + i]))
            if len(met) > 1:
                label[np.isin(label, met)] = met[0]
    linked = np.flatnonzero(label != np.arange(len(pdf)))
    return pd.DataFrame({"a": pid[label[linked]], "b": pid[linked]})


def links(points: DataFrame, radius: int = 3, *, parts: int | None = None, leaf_rows: int = 1024, sample_rows: int = 200_000) -> DataFrame:
    """Links (a, b) between ``points`` (pid, f0; written, distinct): enough of those at ``radius`` or fewer bits to join
    all that are linked. Within ``radius`` bits in all is within radius // parts bits in one of ``parts`` blocks."""
    parts = parts or max(1, (radius + 2) // 2)
    edges = [64 * i // parts for i in range(parts + 1)]
    blocks = [(0, sum(1 << b for b in range(lo, hi))) for lo, hi in zip(edges, edges[1:], strict=False)]
    forest = planted(points, blocks, radius // parts, leaf_rows=leaf_rows, sample_rows=sample_rows)
    return routed(points, forest, lambda w: ["f0"]).groupBy(*TASK).applyInPandas(lambda pdf: _forest(pdf, radius), "a long, b long")


def _state(edges: DataFrame) -> tuple:
    """What tells one round's edges from the next one's; no sum that could overflow."""
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b) but the roots; a root is the smallest node of its component."""
    least, most = F.least("a", "b"), F.greatest("a", "b")
    edges = cut(edges.filter("a != b").select(least.alias("a"), most.alias("b")).distinct(), "cc-edges")
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = cut(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "cc-low")
        large = both.filter("b > a").join(low, "a").select(F.col("m").alias("a"), "b")  # larger neighbours go to the smallest
        large = cut(large.filter("a != b").distinct(), "cc-large")
        low = cut(large.groupBy("b").agg(F.min("a").alias("m")), "cc-low")
        small = large.join(low, "b")  # smaller neighbours, and the node itself, go to the smallest
        small = small.select(F.col("m").alias("a"), F.explode(F.array("a", "b")).alias("b")).filter("a != b").distinct()
        edges = cut(small, "cc-edges")
        state = _state(edges)
        if state == seen:
            return edges.select(F.col("b").alias("node"), F.col("a").alias("root"))
        seen = state


def named(rows: DataFrame, points: DataFrame, edges: DataFrame) -> DataFrame:
    """``rows`` (pid, ...) with ``component``, the smallest ``first`` of the ``points`` (pid, first) that ``edges`` join."""
    roots = components(edges)
    rooted = points.join(roots, points["pid"] == roots["node"], "left").select("pid", "first", F.coalesce("root", "pid").alias("root"))
    rooted = cut(rooted, "point-roots")
    lowest = cut(rooted.groupBy("root").agg(F.min("first").alias("component")), "component-names")
    table = cut(rooted.join(lowest, "root").select("pid", "component"), "point-components")
    return rows.join(table, "pid")


def near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, width: int = 3, radius: int = 3, **options) -> DataFrame:
    """One row per row of ``df``: id, ``f0`` and ``component``."""
    prints = cut(fingerprints(df, width, id_col, text_col).withColumn("pid", F.col("f0")), "fingerprints")
    points = cut(prints.groupBy("pid", "f0").agg(F.min("id").alias("first")), "points")
    return named(prints, points, links(points, radius, **options)).select("id", "f0", "component")


def drop_near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``df`` that name their component, with its own columns: one document of each group."""
    return keepers(df, near_copies(df, id_col, text_col, **options), id_col)


def keepers(df: DataFrame, found: DataFrame, id_col: str) -> DataFrame:
    """The rows of ``df`` whose identifier names a component in ``found`` (id, component). Rows without an identifier
    cannot be chosen between: they stay where no identifier names their component, and else go."""
    stays = found.groupBy("id").agg(F.bool_or(F.col("id").eqNullSafe(F.col("component"))).alias("stays"))
    return dropped(df, cut(stays.filter("NOT stays").select("id"), "near-dropped"), id_col)


# ---- similarity of shingle sets

#: Words of the fingerprints that all texts get, and of those that crowded texts in a pair get as well.
WORDS, LONG = 8, 32

#: How many pairs of a task are compared at a time: this bounds a task's memory, whatever share of them is near.
AT_ONCE = 500_000


@dataclass(frozen=True)
class Bounds:
    """By how many bits texts at the similarity differ, at most (to three standard deviations): the angle between the
    shingle sets gives the share of bits, as hyperplanes through it are random."""

    threshold: float

    def bits(self, n: int) -> int:
        p = math.acos(2 * self.threshold / (1 + self.threshold)) / math.pi
        return math.ceil(n * p + 3 * math.sqrt(n * p * (1 - p)))


#: Two blocks of 16 bits in each word. Texts at 0.8 differ by one bit or none in a block with a probability of 0.28.
NEAR = 1
BLOCKS = [(w, 0xFFFF << shift) for w in range(WORDS) for shift in (0, 32)]


def shingle_set(text: bytes, width: int) -> np.ndarray:
    """The distinct shingles' hashes in order; a text without words has the hash 0."""
    h = shingle_hashes(text, width)
    return np.unique(h) if len(h) else np.zeros(1, np.uint64)


def long_fingerprints(df: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """One row per row of ``df``: id, row, f0 to f7 over the set of shingles, and ``grams``, the set as 32 bits of each
    hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints, grams = np.zeros((len(batch), WORDS), np.uint64), []
            for i, t in enumerate(batch.column("text").cast(pa.binary())):
                h = shingle_set(t.as_py(), width)
                prints[i] = majority(mixed_words(h, WORDS))
                grams.append(np.unique((h >> np.uint64(32)).astype("<u4")).tobytes())
            own = [batch.column("id"), batch.column("row"), *[pa.array(prints[:, k].view(np.int64)) for k in range(WORDS)], pa.array(grams, pa.binary())]
            yield pa.RecordBatch.from_arrays(own, names=["id", "row", *[f"f{k}" for k in range(WORDS)], "grams"])

    schema = "id long, row long, " + ", ".join(f"f{k} long" for k in range(WORDS)) + ", grams binary"
    return df.select(F.col(id_col).cast("long").alias("id"), F.monotonically_increasing_id().alias("row"), text_or_empty(text_col).alias("text")).mapInArrow(run, schema)


def _candidates(f: np.ndarray, own: int, cross_only: bool, bits: int, both_ways: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (a, b) of the rows of a task that differ by at most ``bits`` bits of ``f``, in parts. The first ``own`` rows
    meet all; with ``both_ways`` the others meet them as well."""
    for lo, hi, first, last in [(0, own, own if cross_only else 0, len(f)), *([(own, len(f), 0, own)] if both_ways else [])]:
        step = max(1, AT_ONCE // max(1, last - first))
        for at in range(lo, hi, step):
            a, b = np.nonzero(np.bitwise_count(f[at : min(at + step, hi), None] ^ f[None, first:last]) <= bits)
            a, b = a + at, b + first
            yield a[a != b], b[a != b]


def _nearest(pdf: pd.DataFrame, bits: tuple[int, int], k: int) -> pd.DataFrame:
    """For each row of a task its ``k`` nearest candidates, and whether it has ``more``. Columns c0 and c1: two words."""
    pdf = pdf.sort_values(["role", "pid"], kind="stable")
    f, g, pid, role = _unsigned(pdf["c0"]), _unsigned(pdf["c1"]), pdf["pid"].to_numpy(np.int64), pdf["role"].to_numpy()
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))]
    for a, b in _candidates(f, int(np.count_nonzero(role == 0)), bool((role == 1).any()), bits[0], True):
        d = np.bitwise_count(f[a] ^ f[b]).astype(np.int64) + np.bitwise_count(g[a] ^ g[b])
        near = d <= bits[1]
        a, b, d = a[near], b[near], d[near]
        order = np.lexsort((pid[b], d, a))
        a, b, d = a[order], b[order], d[order]
        start = np.searchsorted(a, a)
        first = np.arange(len(a)) - start < k
        many = np.searchsorted(a, a, side="right") - start > k
        found.append((pid[a[first]], pid[b[first]], d[first], many[first]))
    a, b, d, more = (np.concatenate(c) for c in zip(*found, strict=True))
    return pd.DataFrame({"a": a, "b": b, "d": d, "more": more})


def _across_in_parts(pdf: pd.DataFrame, bits: tuple[int, int], near: int) -> Iterator[pd.DataFrame]:
    """All candidate pairs of a task whose roots differ, in parts. Columns c0: the root; the last ones: all words; between
    them there may be a longer fingerprint c1 to compare instead. A pair within ``near`` bits in some blocks surely meets
    in each of them, and is given by the first alone; one that meets by chance only is given wherever it does."""
    pdf = pdf.sort_values(["role", "pid"], kind="stable")
    at = 2 if f"c{1 + WORDS}" in pdf else 1
    words = np.stack([_unsigned(pdf[f"c{at + w}"]) for w in range(WORDS)])
    whole = words.T if at == 1 else np.frombuffer(b"".join(pdf["c1"]), "<u8").reshape(len(pdf), -1)
    part, root, pid, role = int(pdf["part"].iloc[0]), pdf["c0"].to_numpy(np.int64), pdf["pid"].to_numpy(np.int64), pdf["role"].to_numpy()
    own = int(np.count_nonzero(role == 0))
    for a, b in _candidates(words[BLOCKS[part][0]], own, bool((role == 1).any()), bits[0], False):
        wanted = (root[a] != root[b]) & ((b >= own) | (a < b))
        a, b = a[wanted], b[wanted]
        found = [np.zeros((0, 2), np.int64)]
        for at in range(0, len(a), 50_000):
            x, y = a[at : at + 50_000], b[at : at + 50_000]
            close = np.bitwise_count(whole[x] ^ whole[y]).sum(axis=1, dtype=np.int64) <= bits[1]
            x, y = x[close], y[close]
            first = np.full(len(x), part)
            for k in range(len(BLOCKS) - 1, -1, -1):
                word, mask = BLOCKS[k]
                differ = words[word][x] ^ words[word][y]
                first[(np.bitwise_count(differ & np.uint64(mask)) <= near) & (np.bitwise_count(differ) <= bits[0])] = k
            given = first == part
            found.append(np.sort(np.stack([pid[x[given]], pid[y[given]]], axis=1), axis=1))
        pairs = np.concatenate(found)
        if len(pairs):
            yield pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})


def _across(pdf: pd.DataFrame, bits: tuple[int, int], near: int) -> pd.DataFrame:
    return pd.concat([pd.DataFrame({"a": [], "b": []}, dtype=np.int64), *_across_in_parts(pdf, bits, near)])


def longer(prints: DataFrame) -> DataFrame:
    """(row, long): fingerprints of ``LONG`` words from the shingles' hashes in ``prints`` (row, grams)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [majority(mixed_words(np.frombuffer(g.as_py(), "<u4").astype(np.uint64), LONG + 1)[1:]).tobytes() for g in batch.column("grams")]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(made, pa.binary())], names=["row", "long"])

    return prints.select("row", "grams").mapInArrow(run, "row long, long binary")


def sketched(pairs: DataFrame, prints: DataFrame, bits: int) -> DataFrame:
    """Those of the ``pairs`` (a, b; written) whose longer fingerprints differ by at most ``bits`` bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u8").reshape(len(batch), -1) for c in ("la", "lb"))
            keep = np.bitwise_count(one ^ two).sum(axis=1, dtype=np.int64) <= bits
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("a", "b")], names=["a", "b"]).filter(pa.array(keep))

    wanted = cut(pairs.select(F.explode(F.array("a", "b")).alias("row")).distinct(), "sketch-keys")
    made = cut(longer(restricted(prints.select("row", "grams"), wanted, "row")), "sketches")
    left, right = (made.select(F.col("row").alias(p), F.col("long").alias(f"l{p}")).hint("merge") for p in ("a", "b"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "la", "lb").mapInArrow(run, "a long, b long")


def similar(pairs: DataFrame, prints: DataFrame, threshold: float) -> DataFrame:
    """Those of the ``pairs`` (a, b; written) whose shingle sets are similar enough. Only the sets of rows that are in a
    pair move."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for left, right in zip(batch.column("la"), batch.column("lb"), strict=True):
                one, two = (np.frombuffer(x.as_py(), "<u4") for x in (left, right))
                both = len(np.intersect1d(one, two, assume_unique=True))
                keep.append(both >= threshold * (len(one) + len(two) - both) - 1e-9)
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("a", "b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    wanted = cut(pairs.select(F.explode(F.array("a", "b")).alias("row")).distinct(), "pair-keys")
    sets = cut(restricted(prints.select("row", "grams"), wanted, "row"), "pair-sets")
    left, right = (sets.select(F.col("row").alias(p), F.col("grams").alias(f"l{p}")).hint("merge") for p in ("a", "b"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "la", "lb").mapInArrow(run, "a long, b long")


def similar_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, width: int = 5, threshold: float = 0.8, neighbours: int = 2, leaf_rows: int = 2048, sample_rows: int = 100_000) -> DataFrame:
    """One row per row of ``df``: id and ``component``, the smallest identifier of its texts' group."""
    bound = Bounds(threshold)
    words = [f"f{k}" for k in range(WORDS)]
    prints = cut(long_fingerprints(df, width, id_col, text_col), "long-fingerprints")
    # rows with equal fingerprints are one point; a text of them stands for it
    points = cut(prints.groupBy(*words).agg(F.min("id").alias("first"), F.min("row").alias("pid")), "points")
    forest = planted(points, BLOCKS, NEAR, leaf_rows=leaf_rows, sample_rows=sample_rows)
    tasks = routed(points, forest, lambda w: [f"f{w}", f"f{(w + 1) % WORDS}"]).groupBy(*TASK)
    limits = bound.bits(64), bound.bits(128)
    met = tasks.applyInPandas(lambda pdf: _nearest(pdf, limits, neighbours), "a long, b long, d long, more boolean")
    # of each text the nearest of all its leaves: a few for each leaf
    met = met.groupBy("a").agg(F.array_sort(F.collect_set(F.struct("d", "b"))).alias("near"), F.bool_or("more").alias("more"))
    met = cut(met.select("a", F.slice("near", 1, neighbours + 1).alias("near"), (F.col("more") | (F.size("near") > neighbours + 1)).alias("more")), "nearest")
    pairs = met.select("a", F.explode("near.b").alias("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    pairs = cut(pairs, "nearest-pairs")
    found = cut(similar(pairs, prints, threshold), "near-links")
    # texts that had more candidates than they met: the others of theirs that are still in different groups
    crowded = cut(met.filter("more").select(F.col("a").alias("pid")).distinct(), "crowded")
    roots = components(found)
    left = restricted(points, crowded, "pid").join(roots, F.col("pid") == F.col("node"), "left").select("pid", *words, F.coalesce("root", "pid").alias("root"))
    left = cut(left, "crowded-points")
    most = bound.bits(64), bound.bits(64 * WORDS)
    tasks = routed(left, planted(left, BLOCKS, NEAR, leaf_rows=leaf_rows, sample_rows=sample_rows), lambda w: ["root", *words]).groupBy(*TASK)

    def across(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from _across_in_parts(pd.concat(list(parts)), most, NEAR)

    rest = cut(tasks.applyInPandas(across, "a long, b long").distinct().join(pairs, ["a", "b"], "left_anti"), "crowded-pairs")
    rest = cut(sketched(rest, prints, bound.bits(64 * LONG)), "other-pairs")
    edges = found.unionByName(similar(rest, prints, threshold))
    rows = prints.select("id", *words).join(points.select("pid", *words), words).select("id", "pid")
    return named(rows, points.select("pid", "first"), edges).select("id", "component")


def drop_similar(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``df`` that name their component, with its own columns: one document of each group."""
    return keepers(df, similar_texts(df, id_col, text_col, **options), id_col)
