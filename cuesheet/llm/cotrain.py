"""Quality by co-training: a classifier of text content and one of page metadata teach each other.

The content view sees hashed byte trigrams of the text and its shape (how much of it repeats, how much is not letters),
the metadata view the columns source, lang and the size class of n_chars. Both are made of naive Bayes models in which
every row has an equal say. In each round both are fitted, calibrated on rows
kept apart, and each labels the unlabelled rows that it is most sure of, for the *other* view's next fit. At the end
both views are calibrated again, a small logistic model combines them, and every document is scored from its whole text.

Only the labelled rows are a bounded sample: at most ``LABELLED``, those with the smallest hashes of their ids, one row
an id. Every other row of the corpus takes part in every round: a view labels all rows that it is sure of (``SURE``),
and what reaches the driver are sums by place. In round t the rows so labelled weigh at most t / ROUNDS of the labelled
ones, in the proportion of the classes, so the fit behaves alike at every size. All documents are scored.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from cuesheet.llm.arrow import slices
from cuesheet.session import stored

LABELLED = 8_000
ROUNDS = 4
SURE = 0.9  # a view labels a row for the other if the wrong class has lost so much of its share among labelled rows
UNIT = float(1 << 24)  # sums are added up as integers of this fraction, so that their order does not matter
HOLD = 4  # one labelled row in so many is kept for calibration
KEEP = 0.5
PLACES = 1 << 16
_SHAPE = 1 << 8
_META = 1 << 12
_TABLES = (PLACES, _SHAPE, _META)
_VIEW = (0, 0, 1)  # the view of each table
_CONTENT, _METADATA = [0, 1], [2]


_ODD = re.compile(r"\w+")


def trigrams(text: str | None) -> np.ndarray:
    """Places of the byte trigrams of a text, in lower case."""
    data = np.frombuffer((text or "").lower().encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint32)
    if len(data) < 3:
        return np.empty(0, np.uint32)
    codes = (data[:-2] << np.uint32(16)) | (data[1:-1] << np.uint32(8)) | data[2:]
    codes *= np.uint32(0x9E3779B1)
    return codes >> np.uint32(16)


def shape(text: str | None) -> np.ndarray:
    """Places for the share of words that repeat the word before, of distinct words (by size), and of odd characters."""
    found = (text or "").split()
    if not found:
        return np.empty(0, np.int64)
    n = len(found)
    again = sum(map(str.__eq__, found[1:], found[:-1])) / n
    distinct = len(set(found)) / n
    joined = "".join(found)
    odd = len(_ODD.sub("", joined)) / len(joined)
    size = min(13, n.bit_length())
    return np.array([int(10 * again), 16 + 11 * size + int(10 * distinct), 200 + int(20 * odd)])


def metadata(columns: list[str]) -> Column:
    """The metadata of a row as places: one for each of the columns that it has, with nulls as a value of their own."""
    values = {
        "source": F.col("source").cast("string") if "source" in columns else None,
        "lang": F.col("lang").cast("string") if "lang" in columns else None,
        "n_chars": F.floor(F.log2(F.greatest(F.col("n_chars"), F.lit(1)))).cast("string") if "n_chars" in columns else None,
    }
    found = [
        F.pmod(F.xxhash64(F.lit(name), F.coalesce(value, F.lit("\x00"))), F.lit(_META)).cast("int")
        for name, value in values.items()
        if value is not None
    ]
    return F.array(*found).cast("array<int>")


@dataclass
class Bayes:
    """Log odds by place; a row's score is their mean over its places, 0 without any."""

    weights: np.ndarray

    @staticmethod
    def fit(good: np.ndarray, bad: np.ndarray) -> Bayes:
        """From the summed shares of the places among good and bad rows."""
        smooth = 0.1 / 100
        odds = np.log((good + smooth) / (good.sum() + smooth * len(good)))
        return Bayes((odds - np.log((bad + smooth) / (bad.sum() + smooth * len(bad)))).astype(np.float32))

    def score(self, places: np.ndarray) -> float:
        return float(self.weights[places].mean()) if len(places) else 0.0


def logistic(features: np.ndarray, labels: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Slopes, which are never negative, and the intercept of a logistic model, by Newton's method."""
    x = np.column_stack([features, np.ones(len(labels))])
    beta = np.zeros(x.shape[1])
    penalty = np.append(np.full(x.shape[1] - 1, ridge), 1e-6)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (labels - p) - penalty * beta
        hessian = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty + 1e-9)
        step = np.linalg.solve(hessian, gradient)
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    if (beta[:-1] < 0).any() and x.shape[1] > 1:
        good = beta[:-1] >= 0
        rest = logistic(features[:, good], labels, ridge)
        beta = np.zeros(x.shape[1])
        beta[np.append(good, True)] = rest
    return beta


def _chance(logit: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


@dataclass
class Model:
    """The tables' log odds; each view's logistic model of its tables' scores; the one of the views' logits."""

    tables: list[Bayes]
    content: np.ndarray
    meta: np.ndarray
    combined: np.ndarray
    prior: float = 0.5  # share of good rows among those with a label

    def sure(self, chance: float) -> int | None:
        """The label that a view gives to the other one, if any."""
        if 1 - chance <= (1 - SURE) * (1 - self.prior):
            return 1
        return 0 if chance <= (1 - SURE) * self.prior else None

    def logits(self, scores: np.ndarray) -> np.ndarray:
        """Calibrated logits by (content, metadata) of the tables' scores."""
        return np.column_stack(
            [
                scores[:, _CONTENT] @ self.content[:-1] + self.content[-1],
                scores[:, _METADATA] @ self.meta[:-1] + self.meta[-1],
            ]
        )

    def chances(self, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """By content, by metadata, and by both."""
        logits = self.logits(scores)
        return _chance(logits[:, 0]), _chance(logits[:, 1]), _chance(logits @ self.combined[:-1] + self.combined[-1])


UNKNOWN = Model([Bayes(np.zeros(n, np.float32)) for n in _TABLES], np.zeros(3), np.zeros(2), np.zeros(3))


def _places(part: pa.RecordBatch, text: int, meta: int) -> Iterator[tuple[np.ndarray, ...]]:
    for content, places in zip(part.column(text).to_pylist(), part.column(meta).to_pylist()):
        yield trigrams(content), shape(content), np.array(places or [], np.int64)


def _gathered(rows: DataFrame, labels_of: Callable[[pa.RecordBatch, list], list]) -> tuple[list[np.ndarray], np.ndarray]:
    """For each table (bad, good): the summed shares of the places over the rows that its view has labels for.

    ``labels_of(part, places)`` gives a label or null for each view and row. Also how many rows each (view, label) has.
    Tasks send what they have summed up, by place, so the result has a fixed size.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros((2, n)) for n in _TABLES]
        counts = np.zeros((2, 2), np.int64)
        for part in slices(batches):
            places_of = list(_places(part, 0, 1))
            for labels, row in zip(labels_of(part, places_of), places_of):
                for view, label in enumerate(labels):
                    if label is not None:
                        counts[view, label] += 1
                for places, view, total in zip(row, _VIEW, sums):
                    label = labels[view]
                    if label is not None and len(places):
                        total[label] += np.bincount(places, minlength=total.shape[1]) / len(places)
        cells = [(table, *np.nonzero(total), total[np.nonzero(total)] * UNIT) for table, total in enumerate(sums)]
        cells.append((len(_TABLES), *(x.ravel() for x in np.indices((2, 2))), counts.ravel()))
        for table, label, place, value in cells:
            columns = [np.full(len(label), table), label, place, np.rint(value)]
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], ["t", "label", "place", "v"])

    found = rows.mapInArrow(run, "t long, label long, place long, v long")
    sums, counts = [np.zeros((2, n)) for n in _TABLES], np.zeros((2, 2))
    for r in found.groupBy("t", "label", "place").agg(F.sum("v").alias("v")).collect():  # at most 2 * sum(_TABLES) + 4
        if r["t"] == len(_TABLES):
            counts[r["label"], r["place"]] = r["v"]  # by (view, label)
        else:
            sums[r["t"]][r["label"], r["place"]] = r["v"] / UNIT
    return sums, counts


def given_sums(taught: DataFrame) -> tuple[list[np.ndarray], np.ndarray]:
    """Of rows (text, meta, label): their labels are for both views."""
    return _gathered(taught.select("text", "meta", "label"), lambda part, _: [(x, x) for x in part.column(2).to_pylist()])


def pseudo_sums(pool: DataFrame, model: Model) -> tuple[list[np.ndarray], np.ndarray]:
    """Of all rows (text, meta): each view learns from those that the *other* one is sure of."""
    shared = pool.sparkSession.sparkContext.broadcast(model)

    def labels_of(_: pa.RecordBatch, places_of: list) -> list:
        scores = np.array([[t.score(p) for t, p in zip(shared.value.tables, places)] for places in places_of])
        content, meta, _ = shared.value.chances(scores.reshape(-1, len(_TABLES)))
        return [(shared.value.sure(m), shared.value.sure(c)) for c, m in zip(content, meta)]

    return _gathered(pool.select("text", "meta"), labels_of)


def mixed_sums(given: tuple, pseudo: tuple | None, turn: int) -> list[np.ndarray]:
    """Sums of labelled rows and of rows labelled by the other view, which weigh turn / ROUNDS of them class by class,
    and none of them more than a labelled one."""
    sums, counts = given
    if pseudo is None:
        return sums
    made = []
    for own, other, view in zip(sums, pseudo[0], _VIEW):
        weight = np.minimum(1.0, counts[view] * turn / ROUNDS / np.maximum(pseudo[1][view], 1))
        made.append(own + other * weight[:, None])
    return made


def _scores(rows: DataFrame, tables: list[Bayes]) -> list[tuple[int, np.ndarray]]:
    """(label, scores of the tables) of the bounded rows that are kept for calibration, in the order of their ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            found = [[t.score(p) for t, p in zip(tables, places)] for places in _places(part, 2, 3)]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(found, pa.list_(pa.float64()))], ["key", "label", "scores"]
            )

    kept = rows.select("key", "label", "text", "meta").mapInArrow(run, "key long, label int, scores array<double>")
    return [(r["label"], np.array(r["scores"])) for r in sorted(kept.collect(), key=lambda r: r["key"])]


def labelled_sample(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """At most LABELLED rows, stored: key, label, held, text, meta. Ids without a label of 0 or 1 are not labelled.

    Of labels that disagree the greater one counts, of rows with the same id the one with the smallest text. The order
    of the ids' hashes picks the rows, and of these one in HOLD is held back for calibration.
    """
    marks = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy("doc_id").agg(F.max("quality").cast("int").alias("label"))
    marks = stored(marks.withColumn("order", F.xxhash64("doc_id")), "cotrain-labels")
    share = min(1.0, 2.0 * LABELLED / max(1, marks.count()))
    some = marks.where(F.pmod("order", F.lit(1 << 30)) / F.lit(float(1 << 30)) <= share).orderBy("order", "doc_id").limit(LABELLED)
    rank = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("held")), F.lit(HOLD))
    chosen = some.select("doc_id", "label", (rank == 0).alias("held"))
    texts = documents.where("doc_id IS NOT NULL").select("doc_id", F.struct("text", metadata(documents.columns).alias("meta")).alias("row"))
    # LABELLED rows at most are broadcast; only their texts are moved.
    found = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label", "held").agg(F.min("row").alias("row"))
    return stored(found.select(F.col("doc_id").alias("key"), "label", "held", "row.text", "row.meta"), "cotrain-sample")


def fit(documents: DataFrame, labels: DataFrame) -> Model:
    """A model from ``documents(doc_id, text, ...)`` and ``labels(doc_id, quality)``.

    Without labels of both kinds, also among the rows kept for calibration, nothing can be learned: UNKNOWN.
    """
    sample = labelled_sample(documents, labels)
    kinds = {(r["held"], r["label"]): r["n"] for r in sample.groupBy("held", "label").agg(F.count("*").alias("n")).collect()}
    if len(kinds) < 4:
        return UNKNOWN
    held, given = sample.where("held"), given_sums(sample.where("NOT held"))
    # All rows but those of the sample, also rows without an id.
    rows = documents.select("doc_id", "text", metadata(documents.columns).alias("meta"))
    pool = rows.join(F.broadcast(sample.select(F.col("key").alias("doc_id"))), "doc_id", "left_anti")
    prior, pseudo = given[1][0, 1] / given[1][0].sum(), None
    for turn in range(ROUNDS + 1):
        tables = [Bayes.fit(good, bad) for bad, good in mixed_sums(given, pseudo, turn)]
        found = _scores(held, tables)
        truth, scores = np.array([label for label, _ in found]), np.array([s for _, s in found])
        views = [logistic(scores[:, columns], truth) for columns in (_CONTENT, _METADATA)]
        model = Model(tables, *views, np.zeros(3), prior)
        if turn < ROUNDS:
            pseudo = pseudo_sums(pool, model)
    model.combined = logistic(model.logits(scores), truth)
    return model


def score(documents: DataFrame, model: Model, keep: float = KEEP) -> DataFrame:
    """Per row of ``documents(doc_id, text, source, lang, n_chars)``: doc_id, p_content, p_metadata, score, kept.

    All are chances of good quality; ``kept`` is score >= keep. Null, empty and very short texts say nothing by their
    content, which leaves the metadata to decide; metadata columns that are missing are left out, nulls are a value.
    Under a model that could not be fitted all chances are 0.5 and all rows are kept.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)  # two tables of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for part in slices(batches):
            scores = np.array([[t.score(p) for t, p in zip(known.tables, places)] for places in _places(part, 1, 2)])
            yield pa.RecordBatch.from_arrays(
                [part.column(0), *map(pa.array, known.chances(scores.reshape(-1, len(_TABLES))))],
                ["doc_id", "p_content", "p_metadata", "score"],
            )

    rows = documents.select("doc_id", "text", metadata(documents.columns).alias("meta"))
    found = rows.mapInArrow(run, "doc_id long, p_content double, p_metadata double, score double")
    return found.withColumn("kept", F.col("score") >= keep)
