"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a document, each counted once: words (case and outer punctuation folded),
word beginnings of 4 to 6 characters, neighbouring pairs and pairs with one word between,
hashed into 2^BITS coordinates. FTRL-proximal gives every coordinate its own rate and L1
leaves few weights, so the model is a short list that a closure carries to executors
(at most 2^BITS pairs, whatever the corpus).

Labelled rows used: at most ``max_rows``, those with the smallest hash of doc_id; one task
trains on them. Scoring reads every whole text and no other column. Null and empty texts
have no features and score as the intercept. Repeated rows are scored each. Without usable labelled rows there are no weights and the intercept is
``UNTRAINED``, so that an untrained model rejects nothing; labels that are null are not used.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heddle.llm.chunks import coded, slices
from heddle.llm.common import crc_mod
from heddle.llm.shingles import MULTIPLIER, mix

BITS = 20
OUTER = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~“”«»„…"
ALPHA, BETA, L1, L2, EPOCHS = 0.5, 1.0, 6.0, 0.1, 3
MAX_ROWS = 16_000
UNTRAINED = -2.0


def _coordinates(h: np.ndarray, kind: int) -> np.ndarray:
    return (mix(h * MULTIPLIER + np.uint64(kind)) >> np.uint64(64 - BITS)).astype(np.int32)


def features(texts: pa.Array, weighty: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(document's place, coordinate) pairs; a coordinate may occur again in its document.

    weighty: only coordinates marked in this array are returned.
    """
    codes, ends, chunks = coded(texts)
    doc = np.repeat(np.arange(len(ends)), np.diff(np.concatenate(([0], ends))))
    if not len(codes):
        return np.zeros(0, np.int64), np.zeros(0, np.int32)
    folded = [w.strip(OUTER) for w in pc.utf8_lower(chunks).to_pylist()]
    digest = xxhash.xxh3_64_intdigest
    hashes = np.fromiter(map(digest, folded), np.uint64, len(folded))
    words = hashes[codes]
    docs, coordinates = [], []

    def add(places, found, on=None):
        keep = on if weighty is None else (weighty[found] if on is None else on & weighty[found])
        docs.append(places if keep is None else places[keep])
        coordinates.append(found if keep is None else found[keep])

    def add_of_word(found, on=None):  # a feature of the distinct word alone
        keep = (np.ones(len(found), bool) if on is None else on) & (True if weighty is None else weighty[found])
        at = np.flatnonzero(keep[codes])
        docs.append(doc[at])
        coordinates.append(found[codes[at]])

    add_of_word(_coordinates(hashes, 1))
    for size in (4, 5, 6):
        start = np.fromiter((digest(w[:size]) for w in folded), np.uint64, len(folded))
        add_of_word(_coordinates(start, 1 + size), np.fromiter((len(w) > size for w in folded), bool, len(folded)))
    for gap in (1, 2):
        add(doc[gap:], _coordinates(words[:-gap] * MULTIPLIER ^ words[gap:], 10 + gap), doc[gap:] == doc[:-gap])
    return np.concatenate(docs), np.concatenate(coordinates)


def _distinct(doc: np.ndarray, coordinate: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    both = np.unique((doc.astype(np.int64) << BITS) | coordinate)
    return both >> BITS, (both & ((1 << BITS) - 1)).astype(np.int32)


def coordinates_of(text: Column) -> Column:
    @F.arrow_udf("array<int>")
    def hashed(texts: pa.Array) -> pa.Array:
        out = []
        for part in slices(texts):
            doc, coordinate = _distinct(*features(part))
            out += np.split(coordinate, np.searchsorted(doc, np.arange(1, len(part))))
        return pa.array(out, pa.list_(pa.int32()))

    return hashed(text)


def train(rows: list[np.ndarray], labels: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """FTRL-proximal over the rows in their order, EPOCHS times: (coordinates, weights, intercept)."""
    size = (1 << BITS) + 1  # the last is the intercept, without L1
    z, n = np.zeros(size), np.zeros(size)
    l1 = np.full(size, L1)
    l1[-1] = 0.0

    def weights(at):
        zi = z[at]
        return np.where(np.abs(zi) <= l1[at], 0.0, -(zi - np.sign(zi) * l1[at]) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    for _ in range(EPOCHS):
        for coordinates, y in zip(rows, labels, strict=True):
            at = np.append(coordinates, size - 1)
            w = weights(at)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - sigma * w
            n[at] += g * g
    w = weights(np.arange(size))
    kept = np.flatnonzero(w[:-1])
    return kept.astype(np.int32), w[kept], float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", holdout: int = 5, max_rows: int = MAX_ROWS) -> tuple[np.ndarray, np.ndarray, float]:
    """Weights learnt from the labelled documents outside the hold-out fold (crc32 of the id mod ``holdout`` = 0)."""
    own = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("y"))
    own = own.where(F.col("id").isNotNull() & F.col("y").isNotNull() & (crc_mod(F.col("id"), holdout) != 0))
    chosen = own.groupBy("id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(max_rows)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = texts.join(F.broadcast(chosen), "id")  # at most max_rows ids
    rows = found.select("id", "y", coordinates_of(F.col("text")).alias("x")).orderBy(F.xxhash64("id"), "id", "x").limit(max_rows)

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, y = [], []
        for batch in batches:
            y += batch.column(1).to_pylist()
            lists = batch.column(2)
            flat, edges = lists.flatten().to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            x += np.split(flat, (edges - edges[0])[1:-1]) if len(lists) else []
        at, w, intercept = train(x, np.array(y)) if y else (np.zeros(0, np.int32), np.zeros(0), UNTRAINED)
        yield pa.RecordBatch.from_pydict({"at": pa.array([at], pa.list_(pa.int32())), "w": pa.array([w], pa.list_(pa.float64())), "intercept": [intercept]})

    model = rows.coalesce(1).mapInArrow(one, "at array<int>, w array<double>, intercept double").first()
    return (np.array(model["at"], np.int32), np.array(model["w"]), model["intercept"]) if model else (np.zeros(0, np.int32), np.zeros(0), UNTRAINED)


def score(text: Column, model: tuple[np.ndarray, np.ndarray, float]) -> Column:
    at, w, intercept = model

    @F.arrow_udf("double")
    def scores(texts: pa.Array) -> pa.Array:
        dense = np.zeros(1 << BITS)
        dense[at] = w
        out = []
        for part in slices(texts):
            doc, coordinate = _distinct(*features(part, dense != 0))
            total = np.bincount(doc, dense[coordinate], len(part)) + intercept
            out.append(1 / (1 + np.exp(-np.clip(total, -35, 35))))
        return pa.array(np.concatenate(out) if out else np.zeros(0))

    return scores(text)
