"""Document quality by regularised quadratic discriminant analysis.

A document becomes a short vector of transformed statistics of its whole text. For each class the mean and covariance of
those vectors are found over *all* training rows as distributed sums; the covariance is shrunk towards the pooled one and
then towards a multiple of the identity, factored once by Cholesky, and a document's score is the logistic of the
difference of the two log densities, taken from Mahalanobis distances through the cached factors' inverses, which are made
once with the factors. Features are clipped to a few pooled standard deviations, so one odd statistic can't decide alone,
and the difference counts half (``slope``): the statistics depend on each other beyond a covariance, which makes densities
too sure of themselves. The slope changes neither the order of scores nor what lies above 0.5.

The texts are read once: the vectors are kept as a small table, which training and scoring both read.

Defined results: a null or empty text has the statistics of an empty text and a score; without training rows of both
classes every score is the share of label 1 (or 0); repeated rows are scored each; repeated labels take the larger;
other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterloom.llm import common

FEATURES = (
    "log_chars", "log_words", "word_length", "upper", "digits", "symbols", "pipes", "exclaims", "punctuation", "white", "distinct_words", "top_word",
    "repeated_neighbours", "line_length", "distinct_lines", "short_lines", "ends_in_stop", "compression",
)
CLIP = 6.0


def _classes() -> np.ndarray:
    """One row for each byte class, to be multiplied with a text's byte counts."""
    rows = ["ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "#$%&*@^~=+<>\\{}_", "|", "!", ".,;:?'\"()-", " \t\n\r"]
    out = np.zeros((len(rows), 256))
    for i, chars in enumerate(rows):
        out[i, [ord(c) for c in chars]] = 1
    return out


_CLASS = _classes()


def statistics(text: str) -> list[float]:
    data = text.encode()
    n = max(1, len(data))
    upper, digits, symbols, pipes, exclaims, punctuation, white = (_CLASS @ np.bincount(np.frombuffer(data, np.uint8), minlength=256)) / n
    words = text.split()
    m = max(1, len(words))
    distinct = len(set(words))
    same = sum(map(str.__eq__, words, words[1:]))
    runs = same / m
    lines = [x for x in text.split("\n") if x]
    k = max(1, len(lines))
    root = math.sqrt
    return [
        math.log1p(len(text)), math.log1p(len(words)), math.log1p(len(text) / m), root(upper), root(digits), root(symbols), root(pipes), root(exclaims), root(punctuation), root(white),
        math.log((distinct + 1) / (m + 1)) / math.log(m + 2), root(runs), root(1 - distinct / m), math.log1p(len(text) / k), math.log((len(set(lines)) + 1) / (k + 1)), root(sum(len(x) < 20 for x in lines) / k),
        root(sum(x[-1] in ".!?" for x in lines) / k), math.log((len(zlib.compress(data, 1)) + 40) / (n + 40)),
    ]


def vectors(docs: DataFrame) -> DataFrame:
    """doc_id and its vector, a row for each row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = pa.array([statistics(t) for t in batch.column(1).to_pylist()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), x], names=["doc_id", "x"])

    common.ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), common.text_or_empty().alias("text")).mapInArrow(run, "doc_id long, x array<double>")


@dataclass
class Discriminant:
    mean: list[np.ndarray]
    factor: list[np.ndarray]  # lower Cholesky factors
    inverse: list[np.ndarray]  # of the factors
    log_det: list[float]
    log_prior: list[float]
    centre: np.ndarray
    scale: np.ndarray
    slope: float
    constant: float | None = None

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        z = np.clip((x - self.centre) / self.scale, -CLIP, CLIP)
        density = []
        for c in (0, 1):
            y = (z - self.mean[c]) @ self.inverse[c].T
            density.append(self.log_prior[c] - 0.5 * ((y * y).sum(axis=1) + self.log_det[c]))
        return 1 / (1 + np.exp(-np.clip(self.slope * (density[1] - density[0]), -700, 700)))


def _lower_inverse(factor: np.ndarray) -> np.ndarray:
    """Inverse of a lower triangular matrix, row by row from the top."""
    out = np.zeros_like(factor)
    for i in range(len(factor)):
        out[i, i] = 1 / factor[i, i]
        out[i, :i] = -(factor[i, :i] @ out[:i, :i]) / factor[i, i]
    return out


def _sums(rows: DataFrame, d: int) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Count, sum and sum of outer products of z for each class y, added up on the executors."""
    cells = [(i, j) for i in range(d) for j in range(i, d)]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for y, part in frame.groupby("y"):
                z = np.stack(part["z"].to_numpy())
                out.append((int(y), float(len(z)), z.sum(axis=0), (z.T @ z)[np.triu_indices(d)]))
            yield pd.DataFrame(out, columns=["y", "n", "s", "q"])

    parts = rows.mapInPandas(run, "y int, n double, s array<double>, q array<double>")
    total = parts.groupBy("y").agg(F.sum("n"), *[F.sum(F.col("s")[i]) for i in range(d)], *[F.sum(F.col("q")[i]) for i in range(len(cells))]).collect()
    out = {}
    for r in total:
        q = np.zeros((d, d))
        q[np.triu_indices(d)] = r[2 + d :]
        out[r[0]] = (r[1], np.array(r[2 : 2 + d]), q + np.triu(q, 1).T)
    return out


def fit(x: DataFrame, labels: DataFrame, label: str, held_out, *, to_pooled: float = 0.1, to_identity: float = 0.05, slope: float = 0.5) -> Discriminant:
    """x: vectors(); all rows of ``labels`` that are not held out are used."""
    d = len(FEATURES)
    known = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg((F.max(label) > 0).cast("int").alias("y"))
    rows = x.join(known, "doc_id")
    raw = _sums(rows.select("y", F.col("x").alias("z")), d)
    if len(raw) < 2 or min(v[0] for v in raw.values()) < 2:
        n1, n = raw.get(1, (0.0,))[0], sum(v[0] for v in raw.values())
        return Discriminant([], [], [], [], [], np.zeros(d), np.ones(d), slope, n1 / n if n else 0.0)
    n = sum(v[0] for v in raw.values())
    centre = sum(v[1] for v in raw.values()) / n
    scale = np.sqrt(np.maximum(sum(np.diag(v[2]) for v in raw.values()) / n - centre**2, 1e-6))

    def clipped(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            z = np.clip((np.stack(frame["x"].to_numpy()) - centre) / scale, -CLIP, CLIP) if len(frame) else []
            yield pd.DataFrame({"y": frame["y"].astype("int32"), "z": list(z)})

    sums = _sums(rows.select("y", "x").mapInPandas(clipped, "y int, z array<double>"), d)
    mean = [sums[c][1] / sums[c][0] for c in (0, 1)]
    cov = [sums[c][2] / sums[c][0] - np.outer(mean[c], mean[c]) for c in (0, 1)]
    pooled = sum(sums[c][0] * cov[c] for c in (0, 1)) / n
    factor, log_det = [], []
    for c in (0, 1):
        # a small class leans more on the pooled covariance
        a = to_pooled + (1 - to_pooled) * d / (d + sums[c][0])
        s = (1 - a) * cov[c] + a * pooled
        s = (1 - to_identity) * s + to_identity * max(np.trace(s) / d, 1e-3) * np.eye(d)
        factor.append(np.linalg.cholesky(s))
        log_det.append(2 * float(np.log(np.diag(factor[-1])).sum()))
    return Discriminant(mean, factor, list(map(_lower_inverse, factor)), log_det, [math.log(sums[c][0] / n) for c in (0, 1)], centre, scale, slope)


def score(x: DataFrame, model: Discriminant) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(1).to_pylist()
            s = model.scores(np.array(rows)) if rows else np.empty(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return x.mapInArrow(run, "doc_id long, score double, predicted int")


def held_out_3(doc_id):
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = common.keep(vectors(common.read(spark, sf_dir, "documents")), "quality-vectors")
    model = fit(x, common.read(spark, sf_dir, "labels"), "quality", held_out_3)
    return score(x, model).select("doc_id", held_out_3(F.col("doc_id")).alias("held_out"), "score", "predicted")
