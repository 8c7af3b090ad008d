"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A letter n-gram is bound by permuting (rolling) its letters' vectors by
their place and multiplying them; a text is the bundle (sum) of its n-grams' vectors; a language's prototype is the
bundle of its training texts, each scaled to length one. A text is given the language whose prototype has the highest
cosine with it.

Bundling is linear, so a batch of texts becomes counts of n-grams, whose bound vectors are made once per batch and
multiplied with the counts. Letters are lower-cased; every run of other characters is one boundary symbol, the space.
Each code point has a vector of its own, whose signs are the bits of a hash of it; nothing is stored per alphabet.

Training reads about ``sample_rows`` labelled texts, those whose identifiers hash below a bound, whole; all of them where
there are no more than that.

Defined cases: a null text, or one without letters, is ``und`` with score 0; ties go to the language that sorts first;
null labels are not learned; with no labelled text every text is ``und``; repeated rows get equal answers; very long
texts are counted in parts; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import text_or_empty

N, DIM, SEED = 3, 1024, 7
POINT_BITS = 21  # of a code point
NO_LETTER = re.compile(r"[\W\d_]+")
UNKNOWN = "und"


class Profiles:
    """Letter vectors, and n-gram vectors bound from them."""

    def __init__(self, n: int = N, dim: int = DIM, seed: int = SEED):
        if not 1 <= n <= 63 // POINT_BITS:
            raise ValueError("n must be 1 to 3")
        self.n, self.dim, self.seed = n, dim, seed

    def letters(self, points: np.ndarray) -> np.ndarray:
        """One row of +1 and -1 per code point."""
        lanes = -(-self.dim // 64)
        x = (points.astype(np.uint64)[:, None] * np.uint64(lanes) + np.arange(lanes, dtype=np.uint64)) ^ np.uint64(self.seed << 40)
        x = (x + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)  # three multiplications with odd constants mix all bits
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        signs = np.unpackbits((x ^ (x >> np.uint64(31))).view(np.uint8), axis=1)[:, : self.dim]
        return signs.astype(np.int8) * 2 - 1

    def grams(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Distinct n-grams of the text by number, and their counts."""
        clean = NO_LETTER.sub(" ", f" {text.lower()} ")
        if not any(map(str.isalpha, clean)):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        points = np.frombuffer(clean.encode("utf-32-le"), dtype="<u4").astype(np.int64)
        keys = np.zeros(len(points) - self.n + 1, dtype=np.int64)
        for i in range(self.n):
            keys = keys << POINT_BITS | points[i : len(points) - self.n + 1 + i]
        return np.unique(keys, return_counts=True)

    def bound(self, keys: np.ndarray) -> np.ndarray:
        places = [keys >> POINT_BITS * i & (1 << POINT_BITS) - 1 for i in range(self.n)]
        points, at = np.unique(np.concatenate(places), return_inverse=True)
        letters = self.letters(points)
        out = np.ones((len(keys), self.dim), dtype=np.int8)
        for i, own in enumerate(at.reshape(self.n, -1)):  # the last letter is not rolled, the one before by one, ...
            out *= np.roll(letters, i, axis=1)[own]
        return out.astype(np.float32)

    def bundles(self, texts: list[str]) -> np.ndarray:
        """The texts' vectors, scaled to length one; zero where a text has no letters."""
        counted = [self.grams(t) for t in texts]
        keys = np.unique(np.concatenate([k for k, _ in counted])) if counted else np.empty(0, np.int64)
        out = np.zeros((len(texts), self.dim), dtype=np.float32)
        for lo in range(0, len(keys), 8192):
            part = keys[lo : lo + 8192]
            weights = np.zeros((len(texts), len(part)), dtype=np.float32)
            for i, (k, c) in enumerate(counted):
                a, b = np.searchsorted(k, (part[0], part[-1] + 1))
                weights[i, np.searchsorted(part, k[a:b])] = c[a:b]
            out += weights @ self.bound(part)
        length = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(length > 0, length, 1)


_profiles: list[Profiles] = []


def _shared() -> Profiles:
    if not _profiles:
        _profiles.append(Profiles())
    return _profiles[0]


def _slices(column: pa.Array, size: int = 256) -> Iterator[list[str]]:
    for lo in range(0, len(column), size):
        yield column.slice(lo, size).to_pylist()


def prototypes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", *, sample_rows: int = 20_000) -> dict[str, np.ndarray]:
    """A unit vector for each label of the sample's texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _shared()
        for batch in batches:
            label, at = batch.column("label").to_pylist(), 0
            sums: dict[str, np.ndarray] = {}
            for texts in _slices(batch.column("text")):
                for v, x in zip(own.bundles(texts), label[at : at + len(texts)], strict=True):
                    sums[x] = sums.get(x, 0) + v.astype(np.float64)
                at += len(texts)
            place = np.tile(np.arange(own.dim), len(sums))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(list(sums), own.dim).tolist(), pa.string()), pa.array(place, pa.int32()), pa.array(np.concatenate(list(sums.values())) if sums else np.empty(0), pa.float64())], names=["label", "place", "v"])

    labelled = df.filter(F.col(label_col).isNotNull()).select(F.col(label_col).cast("string").alias("label"), text_or_empty(text_col).alias("text"), F.xxhash64(F.col(id_col)).alias("h"))
    n = labelled.count()
    if n > sample_rows:  # about sample_rows, by hash
        labelled = labelled.filter(F.pmod("h", F.lit(1 << 40)) < int(sample_rows / n * (1 << 40)))
    summed = labelled.select("label", "text").mapInArrow(run, "label string, place int, v double").groupBy("label", "place").agg(F.sum("v").alias("v"))
    found: dict[str, np.ndarray] = {}
    for r in summed.collect():  # labels x DIM numbers
        found.setdefault(r["label"], np.zeros(DIM))[r["place"]] = r["v"]
    return {k: (v / np.linalg.norm(v)).astype(np.float32) for k, v in sorted(found.items()) if np.linalg.norm(v) > 0}


def identify(df: DataFrame, known: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: id, lang_pred and score, the cosine with the language's prototype (below 0: 0)."""
    names = list(known)
    matrix = np.stack([known[x] for x in names], axis=1) if names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _shared()
        for batch in batches:
            pred, score = [], []
            for texts in _slices(batch.column("text")):
                bundles = own.bundles(texts)
                if matrix is None:
                    pred += [UNKNOWN] * len(texts)
                    score += [0.0] * len(texts)
                    continue
                cosine = (bundles @ matrix).astype(np.float64)
                best = np.argmax(cosine, axis=1)
                none = ~bundles.any(axis=1)
                pred += [UNKNOWN if none[i] else names[b] for i, b in enumerate(best)]
                score += [0.0 if none[i] else float(min(1.0, max(0.0, cosine[i, b]))) for i, b in enumerate(best)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=["id", "lang_pred", "score"])

    return df.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text")).mapInArrow(run, "id long, lang_pred string, score double")
