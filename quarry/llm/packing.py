"""Best-fit packing of tokenised documents into sequences by a grouping genetic algorithm on islands.

A document's ids are cut into pieces of at most ``capacity`` (only longer ones are cut; the first piece takes the
remainder). Pieces are dealt over districts by a hash; a district is evolved on two islands, which start from different
orders and are tasks of their own. A solution's genes are whole bins. Crossover copies one parent, injects well-filled
bins of the other, removes the bins that hold a piece twice and packs the displaced pieces again by best fit, longest
first. After an epoch each island's elite migrates to the other one and both evolve again from the two elites. The
better island's full bins are final; the pieces of its worse-filled bins migrate to the next round, where fewer
districts remain, until one district of such pieces is left. Every island stops when it has reached the lower bound.

A district is at most about ``district_rows`` pieces, so no task grows with the table. Pieces as long as a sequence
are sequences of their own and take no part.

Defined cases: a null or empty text is the end id alone; repeated rows are packed each; rows with equal identifiers are
told apart by a row number that the written pieces carry, and so are rows without one; very long texts give many pieces of one tokenizer call; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import cut, text_or_empty

#: Fixed value: how byte-level vocabularies of this family split a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: From this length on the fast encoder may run out of its stack (it does beyond 500,000 characters).
LONG_RUN = re.compile(r"\s{20000}")
PIECES = "id long, row long, piece int, start long, length long, ids_crc32 long"


class Encoder:
    """Ids of a byte-level BPE vocabulary file of the ``tokenizers`` library.

    The file's vocabulary is loaded as merge ranks into ``tiktoken``, which gives the same ids several times faster
    (the tests compare them). Texts that name a special token, and those whose runs of white space are too long for the
    fast one's regular expressions, go to the ``tokenizers`` library itself.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        # byte-level vocabularies write each byte as a printable character
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
        ranks = {bytes(byte_of[c] for c in token): rank for token, rank in self.tokenizer.get_vocab(with_added_tokens=False).items() if token not in self.special}
        self.fast = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> bytes:
        """The ids, as little-endian unsigned 32-bit numbers."""
        if any(x in text for x in self.special) or LONG_RUN.search(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        return self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4").tobytes()


_encoders: dict[str, Encoder] = {}


def cut_pieces(ids: bytes, capacity: int) -> Iterator[tuple[int, int, int]]:
    """(start, length, crc32) of the pieces of a document with these ids."""
    n = len(ids) // 4
    end = (n - 1) % capacity + 1
    start = 0
    while start < n:
        yield start, end - start, zlib.crc32(ids[4 * start : 4 * end])
        start, end = end, end + capacity


def pieces(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", *, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """One row per piece of every row of ``df``: id, row, piece, start, length, ids_crc32."""
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoders.get(vocabulary) or _encoders.setdefault(vocabulary, Encoder(vocabulary))
        for batch in batches:
            rows: tuple[list, ...] = ([], [], [], [], [], [])
            for i, text in enumerate(batch.column("text")):
                for k, (start, length, crc) in enumerate(cut_pieces(encode(text.as_py()) + end, capacity)):
                    for column, v in zip(rows, (i, i, k, start, length, crc), strict=True):
                        column.append(v)
            take = pa.array(rows[0], pa.int64())
            own = [batch.column("id").take(take), batch.column("row").take(take), pa.array(rows[2], pa.int32()), *[pa.array(x, pa.int64()) for x in rows[3:]]]
            yield pa.RecordBatch.from_arrays(own, ["id", "row", "piece", "start", "length", "ids_crc32"])

    return df.select(F.col(id_col).cast("long").alias("id"), F.monotonically_increasing_id().alias("row"), text_or_empty(text_col).alias("text")).mapInArrow(run, PIECES)


class Packing:
    """A solution: the bin of each piece, by number."""

    def __init__(self, bin_of: np.ndarray, size: np.ndarray, capacity: int):
        _, self.bin_of = np.unique(bin_of, return_inverse=True)
        self.fill = np.bincount(self.bin_of, weights=size).astype(np.int64)
        self.bins = len(self.fill)
        self.worth = (-self.bins, float(np.sum((self.fill / capacity) ** 2)))


def best_fit(order: np.ndarray, size: np.ndarray, bin_of: np.ndarray, fill: list[int], capacity: int) -> None:
    """Put the pieces in ``order`` into the fullest bin that has room, opening bins where none has."""
    with_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r: some bin has room r
    for b, f in enumerate(fill):
        with_room[capacity - f].append(b)
        rooms |= 1 << (capacity - f)
    for i, s in zip(order.tolist(), size[order].tolist(), strict=True):
        fits = rooms >> s
        if fits:
            room = s + (fits & -fits).bit_length() - 1
            b = with_room[room].pop()
            if not with_room[room]:
                rooms ^= 1 << room
        else:
            room, b = capacity, len(fill)
            fill.append(0)
        bin_of[i] = b
        fill[b] += s
        with_room[room - s].append(b)
        rooms |= 1 << (room - s)


def packed(size: np.ndarray, capacity: int, order: np.ndarray) -> Packing:
    bin_of = np.empty(len(size), dtype=np.int64)
    best_fit(order, size, bin_of, [], capacity)
    return Packing(bin_of, size, capacity)


def crossed(a: Packing, b: Packing, size: np.ndarray, capacity: int, rng: np.random.Generator) -> Packing:
    """A child of ``a`` with well-filled bins of ``b``."""
    good = b.fill >= np.quantile(b.fill, 0.5)
    taken = (good & (rng.random(b.bins) < rng.uniform(0.1, 0.6)))[b.bin_of]
    gone = np.zeros(a.bins, dtype=bool)
    gone[a.bin_of[taken]] = True  # these bins of a hold a piece twice
    gone[np.argsort(a.fill, kind="stable")[: max(1, a.bins // 50)]] = True  # mutation: the worst bins go too
    loose = gone[a.bin_of] & ~taken
    bin_of = np.where(taken, b.bin_of + a.bins, a.bin_of)
    left = np.flatnonzero(~loose)
    _, dense = np.unique(bin_of[left], return_inverse=True)
    bin_of[left] = dense
    fill = np.bincount(dense, weights=size[left]).astype(np.int64).tolist() if len(left) else []
    displaced = np.flatnonzero(loose)
    best_fit(displaced[np.argsort(-size[displaced], kind="stable")], size, bin_of, fill, capacity)
    return Packing(bin_of, size, capacity)


def evolve(size: np.ndarray, capacity: int, seed: int, elites: list[np.ndarray], *, population: int = 4, generations: int = 8) -> Packing:
    """The island's best solution; from ``elites`` where there are any, else from best fit in noisy orders."""
    rng = np.random.default_rng(seed)
    least = -(-int(size.sum()) // capacity)
    pool = [Packing(e, size, capacity) for e in elites] or [packed(size, capacity, np.argsort(-size, kind="stable"))]
    best = max(pool, key=lambda x: x.worth)
    if best.bins <= least:
        return best
    while len(pool) < population:
        pool.append(packed(size, capacity, np.argsort(-size * rng.uniform(0.8, 1.2, len(size)), kind="stable")))
    for _ in range(generations):
        pool.sort(key=lambda x: x.worth, reverse=True)
        if pool[0].bins <= least:
            break
        a, b = rng.choice(population, 2, replace=False)
        pool[population - 2 :] = [crossed(pool[0], pool[max(a, b)], size, capacity, rng), crossed(pool[min(a, b)], pool[0], size, capacity, rng)]
    return max(pool, key=lambda x: x.worth)


_ROW = "district long, island int, row long, piece int, length long"


def pack(parts: DataFrame, *, capacity: int = 1024, district_rows: int = 4096, full: float = 0.99, rounds: int = 6) -> DataFrame:
    """``parts`` (from ``pieces``, written) with ``sequence_id`` and ``offset``. A piece is known by its row number and its
    place, which are never null; identifiers may be."""
    def first(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["row", "piece"], kind="stable")
        island = int(pdf["island"].iloc[0])
        size = pdf["length"].to_numpy(np.int64)
        elites = [packed(size, capacity, np.argsort(-size * np.random.default_rng(island).uniform(0.9, 1.1, len(size)), kind="stable")).bin_of] if island else []
        return pdf.assign(bin=evolve(size, capacity, island + 1, elites).bin_of)

    def second(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["origin", "row", "piece"], kind="stable")
        islands = [x for _, x in pdf.groupby("origin", sort=True)]
        own, island = islands[0].copy(), int(pdf["island"].iloc[0])
        size = own["length"].to_numpy(np.int64)
        best = evolve(size, capacity, island + 101, [x["bin"].to_numpy(np.int64) for x in islands])
        own["bin"], own["fill"] = best.bin_of, best.fill[best.bin_of]
        own["bins"], own["worth"] = best.bins, best.worth[1]
        return own.drop(columns="origin")

    done = parts.filter(F.col("length") >= capacity).select("row", "piece", (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    results = [done]
    left = parts.filter(F.col("length") < capacity).select("row", "piece", "length")
    n = left.count()
    for r in range(rounds):
        if not n:
            break
        districts = -(-n // district_rows)
        rows = left.withColumn("district", F.pmod(F.xxhash64("row", "piece", F.lit(r)), F.lit(districts)).cast("long"))
        rows = rows.select("district", F.explode(F.array(F.lit(0), F.lit(1))).alias("island"), "row", "piece", "length")
        one = rows.groupBy("district", "island").applyInPandas(first, f"{_ROW}, bin long")
        moved = one.withColumnRenamed("island", "origin").withColumn("island", F.explode(F.array(F.lit(0), F.lit(1))))
        two = cut(moved.groupBy("district", "island").applyInPandas(second, f"{_ROW}, bin long, fill long, bins long, worth double"), "pack-round")
        best = two.groupBy("district").agg(F.max(F.struct(-F.col("bins"), "worth", -F.col("island")))["col3"].alias("win"))
        won = two.join(best, "district").filter(F.col("island") == -F.col("win"))
        last = districts == 1 or r == rounds - 1
        enough = 0 if last else capacity * (1 - (1 - full) * 2**r)
        ready = won.filter(F.col("fill") >= enough)
        number = F.lit(r).cast("long") * (1 << 56) + F.col("district") * (1 << 20) + F.col("bin")
        # a bin has few pieces; its rows stay with their district
        along = F.sum("length").over(Window.partitionBy("district", "bin").orderBy("row", "piece").rowsBetween(Window.unboundedPreceding, 0))
        results.append(ready.select("row", "piece", number.alias("sequence_id"), (along - F.col("length")).cast("long").alias("offset")))
        if last:
            break
        left = cut(won.filter(F.col("fill") < enough).select("row", "piece", "length"), "pack-left")
        n = left.count()
    placed = results[0]
    for x in results[1:]:
        placed = placed.unionByName(x)
    return parts.join(placed, ["row", "piece"]).select(*parts.columns, "sequence_id", "offset")
