"""Ranked lexical search: a sharded inverted index, read by Block-Max MaxScore.

``index`` cuts the documents into shards of about ``shard_bytes`` of text where they lie, without a shuffle. A shard has
one row per term with its postings in blocks, which are compressed apart, and one row (term null) with the shard's
documents. Of each block the row tells the last document and, for four ranges of term frequency, the shortest document.
These bound the scores in the block under whatever the corpus' statistics turn out to be, without decompression.

``search`` joins the lists of the queries' terms only. A task ranks its shards one after the other and keeps a heap per
query. A list's greatest block bound is its global bound. The lists with the least bounds, whose bounds together stay
below the heap's threshold, are not essential: documents that only they hold are never looked at. Documents of essential
lists are candidates. The other lists are read from the greatest bound down, and a candidate goes once its score and the
bound of the block where it would be cannot reach the threshold; only blocks in which candidates are left are
decompressed. The tasks' heaps are merged by one window. Bounds are never below a score and rejection is strict, so the
result is that of scoring every document.

The score is in 64-bit integers: with n terms in the document, N documents with a term, L terms in all, df documents with
the term and tf occurrences, m = 50 + 50 n N div L and a term gives floor(1000 ln((2 N + 2) / (2 df + 1))) times
(10^9 tf div (1000 tf + 20 m)).

Memory: a shard while it is built (some 30 times ``shard_bytes``), the lists of one shard, and ``k`` rows per query. The
queries go to every task in groups of about ``max_terms`` terms; a larger query set takes several passes.

Defined cases: a null text, and one without a term, has no terms and is never found; a query without terms finds
nothing; repeated rows, of documents as of queries, count as rows of their own; documents without an identifier come
last among equal scores; a text longer than a shard is a shard of its own; empty tables give an empty result; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import ascii_lower, cut, text_or_empty

#: Fixed value: what ends a term.
TERM = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
#: Each byte of UTF-8 in lower case, or 0 where it ends a term.
FOLD = np.array([b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 0 for b in range(256)], dtype=np.uint8)
#: The greatest term frequency of each range that a block's bound tells apart; the last has no end.
RANGES = (1, 2, 4)


def terms_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The terms of all texts in order, and how many each text has."""
    column = texts.cast(pa.large_string()).fill_null("")
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    folded = FOLD[data]
    inside = folded != 0
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    first = ends[:-1][ends[:-1] < len(data)]
    begins[first] = inside[first]  # a term does not go on in the next text
    at = np.flatnonzero(begins)
    letters = folded[inside]
    offsets = np.append(np.cumsum(inside, dtype=np.int64)[at] - 1, len(letters))
    terms = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(offsets), pa.py_buffer(letters))
    return terms, np.diff(np.searchsorted(at, ends))


def packed(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers below 2^35 as bytes of seven bits, and where each number's bytes end."""
    size = np.ones(len(values), np.int64)
    for k in range(1, 5):
        size += values >= 1 << 7 * k
    end = np.cumsum(size)
    out = np.zeros(end[-1] if len(end) else 0, np.uint8)
    for k in range(5):
        some = np.flatnonzero(size > k)
        out[(end - size)[some] + k] = (values[some] >> 7 * k & 127) | np.where(size[some] > k + 1, 128, 0)
    return out, end


def unpacked(data: np.ndarray) -> np.ndarray:
    last = np.flatnonzero(data < 128)
    if len(last) == len(data):  # the usual case: all numbers below 128
        return data.astype(np.int64)
    first = np.append(0, last[:-1] + 1)
    out = data[first].astype(np.int64) & 127
    for k in range(1, int((last - first).max()) + 1):
        some = np.flatnonzero(last - first >= k)
        out[some] |= (data[first[some] + k].astype(np.int64) & 127) << 7 * k
    return out


def shard_rows(number: int, ids: pa.Array, texts: pa.Array, block: int, schema: pa.Schema, batch_rows: int = 20_000) -> Iterator[pa.RecordBatch]:
    """The rows of one shard."""
    terms, sizes = terms_of(texts)
    some = int(np.count_nonzero(sizes))
    one = {"shard": [number], "df": [some], "total": [int(sizes.sum())], "ids": [ids.to_pylist()], "sizes": [sizes]}
    yield pa.RecordBatch.from_arrays([pa.array(one.get(f.name, [None]), f.type) for f in schema], schema=schema)
    if not some:
        return
    coded = terms.dictionary_encode()
    order = pc.sort_indices(coded.dictionary).to_numpy()
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    key, tf = np.unique(place[coded.indices.to_numpy()] * len(sizes) + np.repeat(np.arange(len(sizes)), sizes), return_counts=True)
    code, doc = np.divmod(key, len(sizes))
    first = np.searchsorted(code, np.arange(len(order) + 1))  # the postings of term i: first[i] to first[i + 1]
    nth = np.arange(len(code)) - first[code]
    starts = np.flatnonzero(nth % block == 0)
    ends = np.append(starts[1:], len(code))
    delta = doc.copy()
    delta[1:] -= doc[:-1]
    delta[starts] = doc[starts]
    data, end = packed(np.column_stack([delta, tf]).ravel())
    list_of = code[starts]
    list_end = np.append(0, end[2 * first[1:] - 1])  # bytes
    n_blocks = np.append(0, np.cumsum(np.bincount(list_of, minlength=len(order))))
    length, most = sizes[doc], np.maximum.reduceat(tf, starts)
    shortest, low = [], 0
    for high in (*RANGES, 1 << 62):
        least = np.minimum.reduceat(np.where((tf > low) & (tf <= high), length, 1 << 31), starts)
        shortest.append(np.where(least == 1 << 31, 0, least))
        low = high
    columns = {
        "shard": pa.array(np.full(len(order), number)), "term": coded.dictionary.take(pa.array(order)).cast(pa.string()), "df": pa.array(np.diff(first), pa.int32()),
        "postings": pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(order), [None, pa.py_buffer(list_end.astype(np.int64)), pa.py_buffer(data)]).cast(pa.binary()),
    }
    for name, values in {"last": doc[ends - 1], "ends": end[2 * ends - 1] - list_end[list_of], "most": most, **{f"short{i}": x for i, x in enumerate(shortest)}}.items():
        columns[name] = pa.ListArray.from_arrays(pa.array(n_blocks, pa.int32()), pa.array(values, pa.int32()))
    empty = {f.name: pa.nulls(len(order), f.type) for f in schema}
    made = pa.RecordBatch.from_arrays([columns.get(f.name, empty[f.name]).cast(f.type) for f in schema], schema=schema)
    for at in range(0, len(order), batch_rows):
        yield made.slice(at, batch_rows)


def index(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shard_bytes: int = 16 << 20, block: int = 128) -> DataFrame:
    """The index of all rows: one row per shard and term, and one per shard for its documents."""
    from pyspark.sql.pandas.types import to_arrow_schema

    from quarry.schemas import struct

    kind = df.schema[id_col].dataType.simpleString()
    blocks = ", ".join(f"`{c}` array<int>" for c in ("last", "ends", "most", *[f"short{i}" for i in range(len(RANGES) + 1)]))
    spec = struct(f"shard long, term string, df int, total long, ids array<{kind}>, sizes array<int>, postings binary, {blocks}")
    schema = to_arrow_schema(spec)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 24
        held, size = [], 0

        def flushed() -> Iterator[pa.RecordBatch]:
            nonlocal number, held, size
            ids, texts = (pa.concat_arrays([x.column(i) for x in held]) for i in (0, 1))
            yield from shard_rows(number, ids, texts, block, schema)
            number, held, size = number + 1, [], 0

        for batch in batches:
            length = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy().astype(np.int64))
            at = 0
            while at < batch.num_rows:
                before = length[at - 1] if at else 0
                to = max(at + 1, int(np.searchsorted(length, before + shard_bytes - size, "right")))
                held.append(batch.slice(at, to - at))
                size += int(length[to - 1] - before)
                at = to
                if size >= shard_bytes or at < batch.num_rows:
                    yield from flushed()
        if held:
            yield from flushed()

    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, spec)


def value(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * tf // (1000 * tf + 20 * m)


def kth(scores: np.ndarray, k: int) -> int:
    """The k-th greatest, or 0 where there are fewer."""
    return int(np.partition(scores, len(scores) - k)[len(scores) - k]) if len(scores) >= k else 0


def lists_of(batch: pa.RecordBatch, n_docs: int, n_terms: int) -> Iterator[tuple]:
    """Of rows of the index: shard, term, and what ``Shard`` needs to know of the row."""
    flat = {f.name: batch.column(f.name).values.to_numpy().astype(np.int64) for f in batch.schema if pa.types.is_list(f.type) and f.name != "ids"}
    at = {c: batch.column(c).offsets.to_numpy() for c in ("last", "sizes")}
    bound = np.zeros(len(flat["most"]), np.int64)
    low = 0
    for i, high in enumerate((*RANGES, 1 << 62)):
        short = flat[f"short{i}"]
        bound = np.maximum(bound, np.where((short > 0) & (flat["most"] > low), value(np.minimum(flat["most"], high), 50 + 50 * short * n_docs // n_terms), 0))
        low = high
    for i, (shard, term) in enumerate(zip(batch.column("shard").to_pylist(), batch.column("term").to_pylist(), strict=True)):
        if term is None:
            yield shard, term, (batch.column("ids")[i].as_py(), flat["sizes"][at["sizes"][i] : at["sizes"][i + 1]])
        else:
            a, b = at["last"][i], at["last"][i + 1]
            data = np.frombuffer(batch.column("postings")[i].as_buffer(), np.uint8)
            yield shard, term, (flat["last"][a:b], np.append(0, flat["ends"][a:b]), bound[a:b], data, int(bound[a:b].max()))


class Shard:
    """The documents of one shard and the lists of some terms."""

    def __init__(self, rows: dict, n_docs: int, n_terms: int):
        self.ids, sizes = rows.pop(None)
        self.m = 50 + 50 * sizes * n_docs // n_terms
        self.lists = rows
        self.read: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def decoded(self, term: str, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Documents and values in some blocks of a list, in order."""
        _, ends, _, data, _ = self.lists[term]
        if len(blocks) < len(ends) - 1:
            data = np.concatenate([data[ends[b] : ends[b + 1]] for b in blocks])
        first = np.append(0, np.cumsum(ends[blocks + 1] - ends[blocks]))[:-1]
        size = np.add.reduceat(data < 128, first) // 2  # postings in each block
        numbers = unpacked(data)
        docs = np.cumsum(numbers[0::2])
        before = np.append(0, docs)[np.cumsum(size) - size]
        docs -= np.repeat(before, size)
        return docs, value(numbers[1::2], self.m[docs])

    def whole(self, term: str) -> tuple[np.ndarray, np.ndarray]:
        if term not in self.read:
            self.read[term] = self.decoded(term, np.arange(len(self.lists[term][0])))
        return self.read[term]

    def best(self, terms: list[tuple[str, int]], k: int, threshold: int) -> list[tuple[int, int]]:
        """(score, place) of documents that reach ``threshold``; all of the best k that do are among them."""
        lists = sorted((w * self.lists[t][4], t, w) for t, w in terms if w > 0 and t in self.lists)
        below = np.cumsum([0, *[bound for bound, _, _ in lists]])  # what the first i lists can give together
        empty, threshold, rest = threshold < 1, max(threshold, 1), len(lists)
        score = np.zeros(len(self.ids), np.int64)
        while below[rest] >= threshold:  # else the lists before this one are not essential
            rest -= 1
            _, t, w = lists[rest]
            docs, gained = self.whole(t)
            score[docs] += w * gained
            if empty:  # no heap to begin with: the scores so far give a threshold
                own = score[score > 0]
                threshold = max(threshold, kth(own, k))
        found = np.flatnonzero(score)
        own = score[found]
        for i in range(rest, -1, -1):
            threshold = max(threshold, kth(own, k))
            kept = own + below[i] >= threshold
            found, own = found[kept], own[kept]
            if i == 0 or not len(found):
                break
            _, t, w = lists[i - 1]
            last, _, bound, _, _ = self.lists[t]
            block = np.searchsorted(last, found)
            there = np.flatnonzero(block < len(last))
            rejected = np.zeros(len(found), bool)
            rejected[there] = own[there] + w * bound[block[there]] + below[i - 1] < threshold
            there = there[~rejected[there]]
            if len(there):
                docs, gained = self.read.get(t) or self.decoded(t, np.unique(block[there]))
                at = np.minimum(np.searchsorted(docs, found[there]), len(docs) - 1)
                own[there] += np.where(docs[at] == found[there], w * gained[at], 0)
            found, own = found[~rejected], own[~rejected]
        return list(zip(own.tolist(), found.tolist(), strict=True))


def asked_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(q, item, terms): the distinct terms of every row of ``items``."""
    found = F.regexp_extract_all(ascii_lower(text_or_empty(text_col)), F.lit(TERM), F.lit(0))
    return items.select(F.monotonically_increasing_id().alias("q"), F.col(id_col).alias("item"), F.array_distinct(found).alias("terms"))


def search(made: DataFrame, items: DataFrame, id_col: str = "item_id", text_col: str = "text", *, k: int = 50, max_terms: int = 1 << 18) -> DataFrame:
    """The ``k`` best documents for every row of ``items`` in the written index ``made``: item, rank, id, score."""
    asked = cut(asked_terms(items, id_col, text_col), "asked")
    kind = made.schema["ids"].dataType.elementType.simpleString()
    n_docs, n_terms = made.filter("term IS NULL").agg(F.coalesce(F.sum("df"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first()
    total = asked.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()[0]
    groups = -(-total // max_terms) if n_terms else 0
    found = asked.sparkSession.createDataFrame([], f"q long, score long, id {kind}")
    for g in range(groups):
        own = asked.filter(F.pmod(F.xxhash64("q"), F.lit(groups)) == g).select("q", F.explode("terms").alias("term"))
        found = found.unionByName(_heaps(made, own, k, n_docs, n_terms, kind))
    order = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    best = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return best.join(asked.select("q", "item"), "q").select("item", "rank", "id", "score")


def _heaps(made: DataFrame, own: DataFrame, k: int, n_docs: int, n_terms: int, kind: str) -> DataFrame:
    """Each task's best for a group of queries (q, term)."""
    names = own.select("term").distinct().hint("broadcast")  # at most about max_terms
    lists = made.join(names, "term", "left_semi")
    weight = F.floor(1000 * F.log(F.lit(2.0 * n_docs + 2) / (2 * F.sum("df") + 1))).cast("long")
    weights = {r["term"]: r["w"] for r in lists.groupBy("term").agg(weight.alias("w")).collect()}
    queries: dict[int, list[tuple[str, int]]] = {}
    for r in own.collect():
        if r["term"] in weights:
            queries.setdefault(r["q"], []).append((r["term"], weights[r["term"]]))
    shared = own.sparkSession.sparkContext.broadcast(queries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps: dict[int, list] = {q: [] for q in shared.value}

        def rank(rows: dict) -> None:
            shard = Shard(rows, n_docs, n_terms)
            for q, terms in shared.value.items():
                heap = heaps[q]
                new = shard.best(terms, k, heap[-1][0] if len(heap) == k else 0)
                if new:
                    heap += [(s, shard.ids[at]) for s, at in new]
                    heap.sort(key=lambda x: (-x[0], x[1] is None, x[1]))
                    del heap[k:]

        current, held = None, {}
        for batch in batches:
            for shard, term, entry in lists_of(batch, n_docs, n_terms):
                if shard != current and held:
                    rank(held)
                    held = {}
                current = shard
                held[term] = entry
        if held:
            rank(held)
        rows = [(q, s, i) for q, heap in heaps.items() for s, i in heap]
        yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate((pa.int64(), pa.int64(), id_type))], ["q", "score", "id"])

    from pyspark.sql.pandas.types import to_arrow_type

    id_type = to_arrow_type(made.schema["ids"].dataType.elementType)
    by_shard = lists.unionByName(made.filter("term IS NULL")).repartition("shard").sortWithinPartitions("shard")
    return by_shard.mapInArrow(run, f"q long, score long, id {kind}")
