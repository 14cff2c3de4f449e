"""Document quality from a linear-chain conditional random field over lines.

Each line gets features of itself and its two neighbours; the field labels lines
good or bad, and the length-weighted mean of the forward-backward marginals is the
document's quality, calibrated to a probability. The field is trained here, on a
bounded sample of labelled documents (line labels are those of the document).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import slices, small_batches, table

SYMBOLS, UPPER, DIGITS = b"#*$%&|<>{}[]=\\/^~_@+", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789"
N_FEATURES = 13
OWN = N_FEATURES - 1  # the last one is constant
PER_BATCH = 1024
CELLS = 200_000


@dataclass(frozen=True)
class QualityParams:
    """sample: labelled documents that train the field, at most, chosen by a hash of the id.
    sample_lines: longer documents don't train (they are scored like all others). rounds, rate:
    of Adam. l2: of the weights. threshold: predicted good from this score."""

    sample: int = 3000
    sample_lines: int = 400
    rounds: int = 150
    rate: float = 0.1
    l2: float = 1e-3
    threshold: float = 0.3
    folds: int = 5


def line_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(lines x features, weight of each line) of a whole text; a null or empty text is one empty line."""
    rows, weights, seen = [], [], set()
    for line in (text or "").split("\n"):
        b = line.encode("utf-8", "surrogatepass")
        n, words = len(b), b.split()
        k = max(1, len(words))
        distinct = len(set(words))
        sym, up, dig = (n - len(b.translate(None, x)) for x in (SYMBOLS, UPPER, DIGITS))
        chars = max(1, n - b.count(b" "))
        rows.append((
            sym / chars, up / chars, dig / chars, b.count(b"|") / k, b.count(b"!") / k, (b.count(b".") + b.count(b",")) / k,
            distinct / k, np.log1p(len(words) / max(1, distinct)), np.log1p(len(words)) / 5, min(chars / k, 30) / 10,
            float(n > 0 and line in seen), float(not words), 1.0,
        ))
        seen.add(line)
        weights.append(n + 1)
    return np.array(rows, np.float32), np.array(weights, np.float32)


def with_neighbours(x: np.ndarray) -> np.ndarray:
    """Own features and those of the line before and after (zero beyond the ends)."""
    z = np.zeros((1, OWN), np.float32)
    own = x[:, :OWN]
    return np.concatenate((x, np.concatenate((z, own[:-1])), np.concatenate((own[1:], z))), axis=1)


def marginals(scores: list[np.ndarray], trans: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """(P(good) of each line, pair expectations 2 x 2 per chain, log Z) of chains with emission
    log-odds `scores` (state 1 against state 0) and transition weights. Chains run side by side,
    the longest first, so a step works on those that are still running."""
    order = np.argsort([-len(s) for s in scores], kind="stable")
    lens = np.array([len(scores[i]) for i in order])
    T, D = int(lens[0]), len(order)
    e = np.zeros((T, D))
    for col, i in enumerate(order):
        e[: lens[col], col] = scores[i]
    active = np.searchsorted(-lens, -np.arange(T), side="left")  # chains longer than t
    alpha = np.zeros((T, D, 2))
    alpha[0, :, 1] = e[0]
    for t in range(1, T):
        n = active[t]
        a = alpha[t - 1, :n, :, None] + trans
        alpha[t, :n] = np.logaddexp(a[:, 0], a[:, 1])
        alpha[t, :n, 1] += e[t, :n]
    beta, pair = np.zeros((T, D, 2)), np.zeros((D, 2, 2))
    final = alpha[lens - 1, np.arange(D)]
    z = np.logaddexp(final[:, 0], final[:, 1])
    for t in range(T - 2, -1, -1):
        n = active[t + 1]
        nxt = beta[t + 1, :n].copy()
        nxt[:, 1] += e[t + 1, :n]
        m = trans + nxt[:, None, :]
        beta[t, :n] = np.logaddexp(m[:, :, 0], m[:, :, 1])
        pair[:n] += np.exp(alpha[t, :n, :, None] + m - z[:n, None, None])
    good = np.exp(alpha[..., 1] + beta[..., 1] - z)
    out: list = [None] * D
    pairs, logz = np.empty((D, 2, 2)), np.empty(D)
    for col, i in enumerate(order):
        out[i] = good[: lens[col], col]
        pairs[i], logz[i] = pair[col], z[col]
    return out, pairs, logz


@dataclass
class Field:
    mean: np.ndarray
    scale: np.ndarray
    w: np.ndarray
    trans: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    def quality(self, texts: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Length-weighted marginals of documents given as (features, weights)."""
        if not texts:
            return np.zeros(0)
        x = [((with_neighbours(f) - self.mean) / self.scale) @ self.w for f, _ in texts]
        order, good, at = sorted(range(len(x)), key=lambda i: -len(x[i])), {}, 0
        while at < len(order):  # chains of like length together, a bounded number of cells at a time
            group = order[at : at + max(1, CELLS // len(x[order[at]]))]
            good.update(zip(group, marginals([x[i] for i in group], self.trans)[0]))
            at += len(group)
        return np.array([float(np.clip((good[i] * w).sum() / w.sum(), 0, 1)) for i, (_, w) in enumerate(texts)])

    def score(self, texts: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * _logit(self.quality(texts)) + self.shift)))


def _logit(q: np.ndarray) -> np.ndarray:
    q = np.clip(q, 1e-4, 1 - 1e-4)
    return np.log(q / (1 - q))


def train(docs: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, params: QualityParams) -> Field:
    """Maximum conditional likelihood by Adam; then Platt calibration of the aggregate."""
    x = [with_neighbours(f).astype(np.float64) for f, _ in docs]
    flat = np.concatenate(x) if x else np.zeros((1, N_FEATURES + 2 * OWN))
    mean, scale = flat.mean(0), flat.std(0) + 1e-3
    mean[OWN], scale[OWN] = 0.0, 1.0
    f = Field(mean.astype(np.float32), scale.astype(np.float32), np.zeros(flat.shape[1], np.float32), np.zeros((2, 2)))
    if not len(x) or len(set(y.tolist())) < 2:  # nothing to learn from: the share of good ones
        f.shift = float(_logit(np.array([y.mean() if len(y) else 0.5]))[0])
        f.slope = 0.0
        return f
    x = [(v - mean) / scale for v in x]
    flat = np.concatenate(x)
    lens = np.array([len(v) for v in x])
    cut = np.cumsum(lens)[:-1]
    rate_of = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())) / lens  # both labels and all documents count alike
    truth = np.repeat(y, lens)
    line_rate = np.repeat(rate_of, lens)
    true_pair = np.zeros((len(y), 2, 2))
    true_pair[np.arange(len(y)), y, y] = lens - 1
    theta = np.zeros(flat.shape[1] + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for k in range(1, params.rounds + 1):
        w, trans = theta[:-4], theta[-4:].reshape(2, 2)
        good, pair, _ = marginals(np.split(flat @ w, cut), trans)
        gw = ((truth - np.concatenate(good)) * line_rate) @ flat / len(y)
        gt = ((true_pair - pair) * rate_of[:, None, None]).sum(0).ravel() / len(y)
        g = np.concatenate((gw, gt)) - params.l2 * theta
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta + params.rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
    f.w, f.trans = theta[:-4].astype(np.float32), theta[-4:].reshape(2, 2)
    q = _logit(f.quality(docs))
    a, b = 1.0, 0.0
    for _ in range(500):  # Platt: two parameters by gradient steps
        p = 1 / (1 + np.exp(-(a * q + b)))
        a, b = a + 0.05 * float(((y - p) * q).mean()) - 1e-3 * a * 0.05, b + 0.3 * float((y - p).mean())
    f.slope, f.shift = max(a, 0.05), b
    return f


def held_out(doc_id, folds: int):
    return F.coalesce(F.crc32(F.col(doc_id).cast("long").cast("string")) % folds == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, params: QualityParams = QualityParams()) -> Field:
    """A field from at most params.sample labelled documents outside the held-out fold.

    Only features come to the driver: at most sample * sample_lines rows of 13 numbers. A
    document with several labels counts as bad if one says so; null labels are ignored.
    """
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").cast("int").alias("y"))
    chosen = known.where(~held_out("doc_id", params.folds)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(params.sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            rows = [(d, y, *line_features(t)) for d, y, t in zip(*(b.column(k).to_pylist() for k in range(3))) if (t or "").count("\n") < params.sample_lines]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2].tobytes() for r in rows], pa.binary()), pa.array([r[3].tobytes() for r in rows], pa.binary())],
                ["doc_id", "y", "x", "w"],
            )

    chosen = chosen.select(F.col("doc_id").alias("_id"), "y")  # at most params.sample rows
    own = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    joined = own.join(F.broadcast(chosen), own.doc_id == chosen._id).select("doc_id", "y", "text")
    rows = joined.mapInArrow(run, "doc_id long, y int, x binary, w binary").dropDuplicates(["doc_id"]).collect()
    rows.sort(key=lambda r: r["doc_id"])
    data = [(np.frombuffer(r["x"], np.float32).reshape(-1, N_FEATURES), np.frombuffer(r["w"], np.float32)) for r in rows]
    return train(data, np.array([r["y"] for r in rows], np.int64), params)


def scored(docs: DataFrame, field: Field) -> DataFrame:
    """(doc_id, score) for each row, from the text alone; other columns aren't read. Null text: as empty."""
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = shared.value
        for b in slices(batches):
            texts = b.column(1)
            out = []
            for at in range(0, b.num_rows, PER_BATCH):
                out.append(f.score([line_features(t) for t in texts.slice(at, PER_BATCH).to_pylist()]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.concatenate(out) if out else np.zeros(0))], ["doc_id", "score"])

    return small_batches(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")


def op6_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, params = table(spark, sf_dir, "documents"), QualityParams()
    out = scored(docs, fit(docs, table(spark, sf_dir, "labels"), params))
    return out.select(
        "doc_id", held_out("doc_id", params.folds).alias("held_out"), "score", (F.col("score") >= params.threshold).cast("int").alias("predicted")
    )


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: rows whose text scores under the threshold go. A field on the rows' own
    texts decides row by row, so nothing is joined or shuffled.

    Columns of any name pass through. A null text is scored as an empty one. Repeated rows and rows of null doc_id are
    scored each; a score at the threshold stays. Texts of any length are scored whole. Empty in, empty out.
    """
    params = QualityParams()
    shared = spark.sparkContext.broadcast(fit(docs, table(spark, sf_dir, "labels"), params))

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:  # one call per task
        for s in texts:
            parts = [shared.value.score([line_features(t) for t in s[at : at + PER_BATCH]]) for at in range(0, len(s), PER_BATCH)]
            yield pd.Series(np.concatenate(parts) if parts else np.zeros(0))

    return docs.where(score(F.col("text")) >= params.threshold)
