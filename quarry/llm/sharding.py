"""Sharding by a k-d tree over metadata, with leaves of equal bytes.

The points are documents, weighted by bytes; the dimensions are the logarithm of their length and the ranks of their
source and language among the distinct values, each scaled to its range over the table. A node that still has k shards is split along its widest dimension at the distributed weighted
quantile floor(k / 2) / k (a median where k is even), until every leaf is one shard of about the target bytes. The
driver holds only the tree: at each level one aggregate gives each open node's ranges, and a few histograms of at most
``bins`` rows per node narrow down the cut. The tree becomes one column expression; rows are never moved for a split.

Documents with equal texts form a group. Its metadata is that of the group (smallest source and language), and all its
rows have one place in every dimension, so no cut parts them. A group of more than a hundredth of a shard's bytes, of
which there are at most a hundred per shard, would make a cut uneven: such groups are put into shards beforehand, the
largest first and each into the emptiest, and the tree shares out what room is left. A group that has more bytes than a
shard and than the largest document fits no shard and is dealt row by row.

Slots count a shard's rows from 0: rows are numbered within (shard, block) and the blocks' counts are summed.

Defined cases: a null text has no bytes and weighs 16; very long texts are single points, and a shard cannot be smaller
than its longest document; a null source or language comes first in its dimension; rows with
equal identifiers and texts may part only if their group is dealt by row; an empty table gives an empty result; fewer
documents than shards leave shards empty; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm import exact_dedup
from quarry.llm.common import cut

SIZE_EXTRA = 16
CELL_BITS, TIE_BITS = 30, 32


@dataclass
class Node:
    k: int
    shard: int
    dim: int | None = None
    cut: int | None = None
    left: Node | None = None
    right: Node | None = None


def _ranked(rows: DataFrame, name: str, place: str, max_bytes: int) -> tuple[DataFrame, int]:
    """``rows`` (written) with the rank of ``name`` among its distinct values as ``place``, from 1 (null: 0); and how many
    values there are. The values go to every task where they hold at most ``max_bytes``; else both sides are shuffled."""
    values = rows.select(name).filter(F.col(name).isNotNull()).distinct().orderBy(name)
    own = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))  # counts from 0 within a sorted partition
    values = cut(values.select(F.col(name).alias("_kd_value"), F.spark_partition_id().alias("_kd_part"), own.alias("_kd_own")), "shard-values")
    held = values.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("_kd_value") + F.lit(32)).alias("bytes")).first()
    # one row per partition
    before = F.sum("_kd_n").over(Window.orderBy("_kd_part").rowsBetween(Window.unboundedPreceding, -1))
    parts = values.groupBy("_kd_part").agg(F.count(F.lit(1)).alias("_kd_n")).select("_kd_part", F.coalesce(before, F.lit(0)).alias("_kd_before"))
    ranks = values.join(F.broadcast(parts), "_kd_part").select("_kd_value", (F.col("_kd_before") + F.col("_kd_own") + 1).cast("double").alias(place))
    how = "broadcast" if (held["bytes"] or 0) <= max_bytes else "merge"
    joined = rows.join(ranks.hint(how), F.col(name) == F.col("_kd_value"), "left").drop("_kd_value")
    return joined.withColumn(place, F.coalesce(place, F.lit(0.0))), held["n"]


def points(df: DataFrame, shards: int, id_col: str, text_col: str, meta: tuple[str, ...], max_value_bytes: int = 64 << 20) -> DataFrame:
    """One narrow row per document: identifier, size, crc32 and its place k0, k1, ... in each dimension."""
    size = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long") + SIZE_EXTRA
    crc = F.crc32(F.coalesce(F.col(text_col), F.lit("")))
    carry = {f"_kd_m{i}": (m, F.min) for i, m in enumerate(meta)}
    rows = df.select(id_col, text_col, *[m for m in meta if m not in (id_col, text_col)], size.alias("_kd_size"), crc.alias("_kd_crc"))
    rows = exact_dedup.assign(rows, id_col, text_col, carry=carry, fold=False)
    size = F.col("_kd_size")
    rows = rows.select(  # no text: it is not shuffled
        F.col(id_col).alias("id"),
        size.alias("size"),
        F.col("_kd_crc").alias("crc"),
        F.xxhash64("_xd_digest").alias("group"),
        (F.col("_xd_n") * size).alias("group_bytes"),
        F.log(size.cast("double")).alias("x0"),
        *carry,
    )
    rows = cut(rows, "shard-rows")
    top = rows.agg(F.sum("size").alias("total"), F.max("size").alias("largest"), F.min("x0").alias("lo"), F.max("x0").alias("hi"), *[F.max(F.col(m).isNull()).alias(f"null{i}") for i, m in enumerate(carry)]).first()
    ends = [(top["lo"] or 0.0, top["hi"] or 0.0)]
    for i, m in enumerate(carry):
        rows, n = _ranked(rows, m, f"x{i + 1}", max_value_bytes)
        ends.append((0.0 if top[f"null{i}"] else 1.0, float(n)))
    target = (top["total"] or 0) / shards
    most = max(target, top["largest"] or 0)
    homes = _homes(rows, shards, target, most)
    mask = F.lit((1 << TIE_BITS) - 1)
    tie = F.when(F.col("group_bytes") > most, F.xxhash64("group", "id")).otherwise(F.col("group")).bitwiseAND(mask)

    def place(d: int) -> Column:
        lo, hi = ends[d]
        cell = F.floor((F.col(f"x{d}") - lo) / F.lit((hi - lo) or 1.0) * ((1 << CELL_BITS) - 1)).cast("long")
        return F.shiftleft(cell, TIE_BITS).bitwiseOR(tie)

    rows = rows.join(F.broadcast(homes), F.col("group") == F.col("home_group"), "left")
    return cut(rows.select("id", "size", "crc", "home", *[place(d).alias(f"k{d}") for d in range(len(ends))]), "shard-points")


def _homes(rows: DataFrame, shards: int, target: float, most: float) -> DataFrame:
    """The shards of the groups that are large but fit one: home_group, home."""
    large = rows.filter((F.col("group_bytes") > F.col("size")) & (F.col("group_bytes") > target / 100) & (F.col("group_bytes") <= most))
    held = large.groupBy("group").agg(F.max("group_bytes").alias("bytes")).collect()  # at most 100 per shard
    filled, placed = [(0, s) for s in range(shards)], []
    for r in sorted(held, key=lambda r: (-r["bytes"], r["group"])):
        size, s = heapq.heappop(filled)
        placed.append((r["group"], s))
        heapq.heappush(filled, (size + r["bytes"], s))
    return rows.sparkSession.createDataFrame(placed, "home_group long, home int")


def _walk(node: Node, leaf) -> Column:
    """The column that sends a row down the tree; ``leaf`` gives a leaf's value."""
    if node.left is None:
        return leaf(node)
    return F.when(F.col(f"k{node.dim}") <= F.lit(node.cut), _walk(node.left, leaf)).otherwise(_walk(node.right, leaf))


def build(rows: DataFrame, shards: int, dims: int, *, bins: int = 4096, tolerance: float = 0.001) -> Node:
    """The tree over the points ``rows`` that have no home. ``tolerance``: by how much of a shard's bytes a cut may be off."""
    placed = {r["home"]: r["w"] for r in rows.groupBy("home").agg(F.sum("size").alias("w")).collect()}
    target = sum(placed.values()) / shards
    room = [max(0.0, target - placed.get(i, 0)) for i in range(shards)]
    rows = rows.filter("home IS NULL")

    def share(n: Node) -> float:
        """Of the node's bytes, those for its lower shards."""
        half, whole = sum(room[n.shard : n.shard + n.k // 2]), sum(room[n.shard : n.shard + n.k])
        return half / whole if whole else (n.k // 2) / n.k

    root = Node(shards, 0)
    open_nodes = [root] if shards > 1 else []
    while open_nodes:
        number = {id(n): i for i, n in enumerate(open_nodes)}
        at = _walk(root, lambda n: F.lit(number.get(id(n), -1)))
        here = rows.withColumn("node", at).filter("node >= 0")
        stats = here.groupBy("node").agg(F.sum("size").alias("w"), *[f(f"k{d}").alias(f"{n}{d}") for d in range(dims) for n, f in (("lo", F.min), ("hi", F.max))]).collect()
        state = {}
        for s in stats:
            n = open_nodes[s["node"]]
            n.dim = max(range(dims), key=lambda d: ((s[f"hi{d}"] >> TIE_BITS) - (s[f"lo{d}"] >> TIE_BITS), -d))
            state[s["node"]] = {"lo": s[f"lo{n.dim}"], "hi": s[f"hi{n.dim}"], "below": 0, "want": s["w"] * share(n), "slack": s["w"] / n.k * tolerance}
        for i, n in enumerate(open_nodes):  # a node without rows is cut anywhere
            if i not in state:
                n.dim, n.cut = 0, 0
        narrow = dict(state)
        while narrow:
            value, low, step = F.lit(None).cast("long"), F.lit(None).cast("long"), F.lit(None).cast("long")
            for i, s in narrow.items():
                s["step"] = max(1, -(-(s["hi"] - s["lo"] + 1) // bins))
                value = F.when(F.col("node") == i, F.col(f"k{open_nodes[i].dim}")).otherwise(value)
                low = F.when(F.col("node") == i, F.lit(s["lo"])).otherwise(low)
                step = F.when(F.col("node") == i, F.lit(s["step"])).otherwise(step)
            part = here.filter(F.col("node").isin(list(narrow))).select("node", "size", value.alias("v"), low.alias("low"), step.alias("step"))
            top = F.element_at(F.create_map(*[F.lit(x) for i, s in narrow.items() for x in (i, s["hi"])]), F.col("node"))
            part = part.filter((F.col("v") >= F.col("low")) & (F.col("v") <= top))
            counts = part.groupBy("node", F.expr("(v - low) div step").alias("bin")).agg(F.sum("size").alias("w"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect()
            of = defaultdict(list)
            for c in sorted(counts, key=lambda c: c["bin"]):
                of[c["node"]].append(c)
            for i, s in list(narrow.items()):
                below = s["below"]
                for c in of[i]:
                    lo, hi = c["lo"], c["hi"]  # of the points in the bin, so that empty ranges cost no further histogram
                    if below + c["w"] >= s["want"] or hi == s["hi"]:
                        break
                    below += c["w"]
                if c["w"] <= s["slack"] or lo == hi:
                    nearer = abs(below + c["w"] - s["want"]) <= abs(below - s["want"])
                    open_nodes[i].cut = hi if nearer else lo - 1
                    del narrow[i]
                else:
                    s |= {"lo": lo, "hi": hi, "below": below}
        following = []
        for n in open_nodes:
            half = n.k // 2
            n.left, n.right = Node(half, n.shard), Node(n.k - half, n.shard + half)
            following += [x for x in (n.left, n.right) if x.k > 1]
        open_nodes = following
    return root


def shard(df: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", *, meta: tuple[str, ...] = ("source", "lang"), rows_per_block: int = 16384) -> DataFrame:
    """One row per row of ``df``: id, size, crc, shard and slot."""
    if shards < 1:
        raise ValueError("shards must be at least 1")
    rows = points(df, shards, id_col, text_col, meta)
    root = build(rows, shards, len(meta) + 1)
    blocks = max(1, -(-rows.count() // (shards * rows_per_block)))
    dealt = rows.withColumn("shard", F.coalesce("home", _walk(root, lambda n: F.lit(n.shard)))).withColumn("block", F.pmod(F.xxhash64("id", "crc"), F.lit(blocks)))
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    counts = cut(dealt.groupBy("shard", "block").count().select("shard", "block", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before")), "shard-blocks")
    own = F.row_number().over(Window.partitionBy("shard", "block").orderBy("id", "crc")) - 1
    return dealt.withColumn("own", own).join(counts, ["shard", "block"]).select("id", "size", "crc", "shard", (F.col("own") + F.col("before")).cast("long").alias("slot"))
