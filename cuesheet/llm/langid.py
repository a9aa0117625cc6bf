"""Language identification by the nearest of several centroids per language.

A text becomes a vector of character n-grams (one to three, letters only, hashed to 2^16 places) with weights
``log(1 + count) * idf``, scaled to length one. Every language of the training rows gets a few centroids by spherical
k-means; a text gets the language of the centroid with the largest cosine. It is *rejected* if that cosine lies below
the radius of its size class, which is learned from snippets of the training rows: what is farther from every centroid
than any known text of its size is in none of the known languages.

The fit reads a bounded sample of labelled rows: ``FIT_ROWS`` per language, chosen by a hash of the row. Prediction
reads all of every text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from cuesheet.llm.arrow import slices
from cuesheet.session import stored

FIT_ROWS = 600
CENTROIDS = 3
BITS = 16
DIMENSIONS = 1 << BITS
STEPS = 8
UNDETERMINED = "und"
_SIZES = BITS + 2  # size classes: powers of two of the number of different n-grams
_SNIPPETS = (1, 2, 4, 8, 16, 32, 64, 128, 256)
_SLACK = 0.7  # share of the smallest cosine seen among a size class's snippets that still is accepted


@lru_cache(1)
def _letters() -> np.ndarray:
    """For each code point whether it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def ngram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray, int]:
    """(places, counts, total) of the n-grams of a text; no letter gives none."""
    empty = np.empty(0, np.int64)
    if not text:
        return empty, empty, 0
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = _letters()[points]
    if not is_letter.any():
        return empty, empty, 0
    # Everything between two words is one space, and so are the text's ends.
    points = np.where(is_letter, points, np.uint32(32))
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]
    points = np.concatenate([[np.uint32(32)], points[keep], [np.uint32(32)]]).astype(np.uint32)
    grams = []
    mixed = points * np.uint32(0x9E3779B1)
    grams.append(mixed)
    if len(points) > 1:
        mixed = (mixed[:-1] ^ (mixed[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA77) + points[1:] * np.uint32(0xC2B2AE3D)
        grams.append(mixed)
    if len(points) > 2:
        mixed = (mixed[:-1] ^ (mixed[:-1] >> np.uint32(13))) * np.uint32(0x27D4EB2F) + points[2:] * np.uint32(0x165667B1)
        grams.append(mixed)
    codes = np.concatenate(grams)
    codes ^= codes >> np.uint32(15)
    codes *= np.uint32(0x2C1B3C6D)
    codes >>= np.uint32(32 - BITS)
    counts = np.bincount(codes, minlength=DIMENSIONS) if len(codes) > 4096 else None
    if counts is None:
        places, found = np.unique(codes, return_counts=True)
    else:
        places = np.flatnonzero(counts)
        found = counts[places]
    return places.astype(np.int64), found, len(codes)


def weighted(places: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    values = np.log1p(counts) * idf[places]
    return (values / (np.sqrt((values * values).sum()) or 1.0)).astype(np.float32)


def size_class(places: np.ndarray) -> int:
    """By the number of different n-grams: a text that repeats itself says as little as a short one."""
    return min(_SIZES - 1, len(places).bit_length())


@dataclass
class Model:
    languages: list[str]  # of each centroid
    idf: np.ndarray
    centroids: np.ndarray  # one column per centroid
    radius: np.ndarray  # smallest accepted cosine by size class

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, cosine, rejected)."""
        places, counts, total = ngram_counts(text)
        if not total or not self.languages:
            return UNDETERMINED, 0.0, True
        cosines = weighted(places, counts, self.idf) @ self.centroids[places]
        best = int(np.argmax(cosines))
        score = float(min(1.0, max(0.0, cosines[best])))
        return self.languages[best], score, score < self.radius[size_class(places)]


def _fit_group(idf: np.ndarray):
    """Centroids and radii of one language, from its bounded sample."""

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["rank", "text"])[:FIT_ROWS]
        texts = rows["text"].tolist()
        vectors = []
        for text in texts:
            places, counts, total = ngram_counts(text)
            if total:
                vectors.append((places, weighted(places, counts, idf)))
        if not vectors:
            return pd.DataFrame({"lang": [], "centroid": [], "radius": []})

        def cosines(centre: np.ndarray) -> np.ndarray:
            return np.array([float(values @ centre[places]) for places, values in vectors])

        def centre_of(chosen) -> np.ndarray:
            total = np.zeros(DIMENSIONS)
            for k in chosen:
                places, values = vectors[k]
                total[places] += values
            return total / (np.linalg.norm(total) or 1.0)

        # Start: the mean, then always the row that is farthest from all centroids so far.
        centres = [centre_of(range(len(vectors)))]
        near = cosines(centres[0])
        while len(centres) < min(CENTROIDS, len(vectors)):
            centres.append(centre_of([int(np.argmin(near))]))
            near = np.maximum(near, cosines(centres[-1]))
        for _ in range(STEPS):
            own = np.argmax(np.stack([cosines(c) for c in centres]), axis=0)
            centres = [centre_of(np.flatnonzero(own == k)) if (own == k).any() else c for k, c in enumerate(centres)]
        radius = np.full(_SIZES, np.inf)
        for text in texts:
            pieces = text.split()
            for n in (*_SNIPPETS, len(pieces)):
                if n > len(pieces):
                    continue
                places, counts, total = ngram_counts(" ".join(pieces[:n]))
                if total:
                    values = weighted(places, counts, idf)
                    best = max(float(values @ c[places]) for c in centres)
                    radius[size_class(places)] = min(radius[size_class(places)], best)
        return pd.DataFrame(
            {
                "lang": [rows["lang"].iloc[0]] * len(centres),
                "centroid": [c.astype(np.float32) for c in centres],
                "radius": [radius] * len(centres),
            }
        )

    return fit


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, rows = np.zeros(DIMENSIONS, np.int64), 0
    for part in slices(batches):
        for text in part.column(0).to_pylist():
            places, _, _ = ngram_counts(text)
            total[places] += 1
            rows += 1
    yield pa.RecordBatch.from_arrays([pa.array([total]), pa.array([rows], pa.int64())], ["found", "rows"])


def fit(labelled: DataFrame) -> Model:
    """A model from rows (text, lang); rows without text or lang are left out. No rows give a model without languages."""
    rows = labelled.where("text IS NOT NULL AND lang IS NOT NULL")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return Model([], np.ones(DIMENSIONS), np.zeros((DIMENSIONS, 0), np.float32), np.zeros(_SIZES))
    share = F.lit(None).cast("double")
    for lang, n in sizes.items():
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, 1.2 * FIT_ROWS / n))).otherwise(share)
    # The row's rank is a hash in [0, 1); the fit cuts what the share leaves over FIT_ROWS.
    ranked = rows.withColumn("rank", F.pmod(F.xxhash64("key", "text"), F.lit(1 << 30)) / F.lit(float(1 << 30)))
    sample = stored(ranked.where(F.col("rank") < share).select("text", "lang", "rank"), "langid-sample")
    found, total = np.zeros(DIMENSIONS), 0
    counted = sample.select("text").mapInArrow(_document_counts, "found array<long>, rows long")
    for r in counted.toLocalIterator():
        found += np.asarray(r["found"])
        total += r["rows"]
    idf = np.log((1 + total) / (1 + found)) + 0.1
    fitted = sample.groupBy("lang").applyInPandas(
        _fit_group(idf.astype(np.float32)), "lang string, centroid array<float>, radius array<double>"
    )
    parts = sorted(fitted.collect(), key=lambda r: r["lang"])
    radius = np.min([r["radius"] for r in parts], axis=0) if parts else np.zeros(_SIZES)
    # A size that no snippet had takes the radius of the next smaller one, so longer texts are never judged stricter.
    low = 0.0
    for k in range(_SIZES):
        low = radius[k] if np.isfinite(radius[k]) else low
        radius[k] = low
    return Model(
        [r["lang"] for r in parts],
        idf.astype(np.float32),
        np.array([r["centroid"] for r in parts], np.float32).reshape(len(parts), DIMENSIONS).T.copy(),
        radius * _SLACK,
    )


def identify(documents: DataFrame, model: Model) -> DataFrame:
    """``documents(doc_id, text)`` with lang_pred, score (the cosine, 0 to 1) and rejected.

    Null texts and texts without a letter are ``und``, score 0, rejected. Equal cosines go to the language that sorts
    first. Every row gives one row; further columns are ignored.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)  # bounded: languages * CENTROIDS vectors

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            found = [shared.value.predict(text) for text in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    pa.array([f[0] for f in found], pa.string()),
                    pa.array([f[1] for f in found], pa.float64()),
                    pa.array([f[2] for f in found], pa.bool_()),
                ],
                ["doc_id", "lang_pred", "score", "rejected"],
            )

    return documents.select("doc_id", "text").mapInArrow(
        run, "doc_id long, lang_pred string, score double, rejected boolean"
    )


def accepted(documents: DataFrame, model: Model) -> DataFrame:
    """The rows whose text is not rejected, with all their columns."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    at = documents.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            keep = [not shared.value.predict(text)[2] for text in part.column(at).to_pylist()]
            yield part.filter(pa.array(keep, pa.bool_()))

    return documents.mapInArrow(run, T.StructType([T.StructField(f.name, f.dataType) for f in documents.schema]))


def held_out(doc_id="doc_id"):
    """Rows that the fit never sees: a checksum of the id, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def training_rows(documents: DataFrame) -> DataFrame:
    return documents.where(~held_out()).select(F.col("doc_id").alias("key"), "text", "lang")
