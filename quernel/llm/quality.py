"""Quality classifier: naive Bayes log-count ratios scale n-gram indicators, a linear hinge-loss model is fitted by dual coordinate descent.

N-grams are byte trigrams of the whole text, hashed into ``HASHED`` places, and trigrams of repetition marks
(whether a word equals the one 1, 2 or 3 words before it). A text's vector holds each place once, scaled by
its log-count ratio and brought to unit length, so that long texts weigh as short ones.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_text, text_bytes, unused, word_hashes

HASHED = 1 << 16
LAGS = (1, 2, 3)
FEATURES = HASHED + 8 * len(LAGS)
#: Bound of the labelled rows that the model is fitted on, of each class, those with the least hash of their id.
SAMPLE = 4000


def places(column: pa.Array) -> list[np.ndarray]:
    """The distinct feature places of each text (uint32, ascending); texts under three bytes and four words have none."""
    data, off = text_bytes(column)
    key = np.zeros(0, np.uint32)
    if len(data) >= 3:
        key = (data[:-2].astype(np.uint32) << 16) | (data[1:-1].astype(np.uint32) << 8) | data[2:]
        key = (key * np.uint32(0x9E3779B1)) >> np.uint32(16)
    word, row, _, _ = word_hashes(column, lower=False)
    ends = np.searchsorted(row, np.arange(len(column) + 1))
    marks = []
    for k, lag in enumerate(LAGS):
        mark = np.zeros(len(word), np.uint32)
        mark[lag:] = (word[lag:] == word[:-lag]) & (row[lag:] == row[:-lag])
        if len(mark) >= 3:
            marks.append(HASHED + 8 * k + 4 * mark[:-2] + 2 * mark[1:-1] + mark[2:])
    seen = np.zeros(FEATURES, bool)
    out = []
    for a, b, p, q in zip(off[:-1], off[1:], ends[:-1], ends[1:]):
        seen[key[a : max(a, b - 2)]] = True
        if q - p >= 4:
            for mark in marks:
                seen[mark[p + 1 : q - 2]] = True
        at = np.flatnonzero(seen)
        seen[at] = False
        out.append(at.astype(np.uint32))
    return out


@dataclass
class NbSvm:
    """margin = weight . indicator / norm + bias; score = 1 / (1 + exp(-(slope * margin + shift)))."""

    weight: np.ndarray  # log-count ratio times hinge-loss weight, float32
    square: np.ndarray  # squared log-count ratio, float32
    bias: float
    slope: float
    shift: float

    def margin(self, at: np.ndarray) -> float:
        norm = math.sqrt(float(self.square[at].sum())) if len(at) else 0.0
        return (float(self.weight[at].sum()) / norm if norm else 0.0) + self.bias

    def score(self, at: np.ndarray) -> float:
        z = self.slope * self.margin(at) + self.shift
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))


def packed(at: np.ndarray) -> bytes:
    """Feature places in the shorter of two forms, a list or a bit for each place: never more than about 8 kB."""
    if 4 * len(at) <= FEATURES // 8:
        return b"\0" + at.tobytes()
    bits = np.zeros(FEATURES, bool)
    bits[at] = True
    return b"\1" + np.packbits(bits).tobytes()


def unpacked(raw) -> np.ndarray:
    if isinstance(raw, np.ndarray):
        return raw
    return np.frombuffer(raw, np.uint32, offset=1) if raw[0] == 0 else np.flatnonzero(np.unpackbits(np.frombuffer(raw, np.uint8, offset=1), count=FEATURES)).astype(np.uint32)


def dual_descent(rows: list, scale: np.ndarray, y: np.ndarray, top: np.ndarray, epochs: int, seed: int, settled: float = 1e-3) -> tuple[np.ndarray, np.ndarray, float]:
    """(alpha, weights, bias) of the hinge-loss model over rows of places, whose values are ``scale`` there, brought to length one.

    Coordinate descent on the dual: minimise |sum of alpha y x|^2 / 2 - sum of alpha for alpha from 0 to ``top``, x with a
    one for the bias. Passes in random order until the steps of one are below ``settled`` on average.
    """
    alpha, w, bias = np.zeros(len(rows)), np.zeros(len(scale)), 0.0
    length = np.array([np.linalg.norm(scale[unpacked(r)]) for r in rows])
    square = 1.0 + (length > 1e-12)
    rng = np.random.Generator(np.random.PCG64(seed))
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            at = unpacked(rows[i])
            v = scale[at] / max(1e-12, length[i])
            gradient = y[i] * (w[at] @ v + bias) - 1
            new = min(max(alpha[i] - gradient / square[i], 0.0), top[i])
            if (step := new - alpha[i]) != 0:
                alpha[i] = new
                w[at] += step * y[i] * v
                bias += step * y[i]
                moved += abs(step)
        if moved < settled * len(rows):
            break
    return alpha, w, bias


def fit(rows: list, label: np.ndarray, totals: tuple[int, int], cost: float = 1.0, epochs: int = 12, seed: int = 11) -> NbSvm:
    """Fit on rows of feature places (arrays, or ``packed``) and labels 0/1; ``totals`` are the classes' counts among all labelled rows (for the score's prior).

    With one class only, or none, the score is that class's share (one half without labels).
    """
    n0, n1 = totals
    zero = np.zeros(FEATURES, np.float32)
    if not (label == 0).any() or not (label == 1).any():
        share = (n1 + 1) / (n0 + n1 + 2)
        return NbSvm(zero, zero, 0.0, 0.0, math.log(share / (1 - share)))
    count = np.ones((2, FEATURES))
    for at, y in zip(rows, label):
        count[int(y), unpacked(at)] += 1
    count /= count.sum(1, keepdims=True)
    ratio = np.log(count[1] / count[0])
    # rows of a class share its weight, so that the rare class is not given up
    share = np.array([len(rows) / (2 * max(1, (label == c).sum())) for c in (0, 1)])
    _, w, bias = dual_descent(rows, ratio, np.where(label == 1, 1.0, -1.0), cost * share[label.astype(int)] * 10, epochs, seed)
    model = NbSvm((w * ratio).astype(np.float32), (ratio**2).astype(np.float32), float(bias), 1.0, 0.0)
    # logistic calibration of the margin, the classes weighted as among all labelled rows
    m = np.array([model.margin(unpacked(at)) for at in rows])
    weight = np.where(label == 1, n1 / max(1, (label == 1).sum()), n0 / max(1, (label == 0).sum()))
    weight = weight / weight.sum()
    target = np.where(label == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * m + b, -500, 500)))
        g, h = weight * (p - target), weight * p * (1 - p) + 1e-9 * weight
        hess = np.array([[(h * m * m).sum() + 1e-6, (h * m).sum()], [(h * m).sum(), h.sum() + 1e-6]])
        step = np.linalg.solve(hess, np.array([(g * m).sum() + 1e-6 * a, g.sum()]))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    model.slope, model.shift = float(a), float(b)
    return model


def held_out(id_col):
    """Whether crc32 of the id as text leaves 0 modulo 5: such rows are never learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> NbSvm:
    """Fit on at most ``sample`` labelled documents of each class that are not held out, those with the least hash of their id.

    Left out: null ids and labels, labels other than 0 and 1, ids that are labelled both ways, labels without a
    document. Labels that repeat count once. Of documents that repeat an id the text with the least hash is taken
    (null texts last), so that the driver gets 2 x ``sample`` rows of about 8 kB at most. Null and empty texts have no features.
    """
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(id_col)).groupBy(F.col(id_col).alias("_id"))
    known = known.agg(F.min(label_col).cast("int").alias("_y"), F.max(label_col).cast("int").alias("_z")).where("_y = _z").drop("_z")
    totals = {r._y: r.n for r in known.groupBy("_y").agg(F.count("*").alias("n")).collect()}
    # a bounded number of rows, whatever the size of the tables
    picked = [known.where(F.col("_y") == c).orderBy(F.xxhash64("_id"), "_id").limit(sample) for c in (0, 1)]
    picked = picked[0].unionByName(picked[1])
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).join(F.broadcast(picked), "_id").select("_id", "_y", F.xxhash64("text").alias("rank"), F.col("text").isNull().alias("none"), "text")

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([part.column("_id"), part.column("_y"), part.column("none"), part.column("rank"), pa.array(map(packed, places(part.column("text"))), pa.binary())], names=["id", "y", "none", "rank", "at"])

    kind = rows.schema["_id"].dataType.simpleString()
    rows = map_text(rows, "text", run, f"id {kind}, y int, none boolean, rank long, at binary")
    got = rows.groupBy("id", "y").agg(F.min(F.struct("none", "rank", "at"))["at"].alias("at")).collect()
    got.sort(key=lambda r: (r.id, r.y))
    return fit([bytes(r["at"]) for r in got], np.array([r.y for r in got], int), (totals.get(0, 0), totals.get(1, 0)))


def score(docs: DataFrame, model: NbSvm, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """Adds the score (0 to 1, higher: quality likelier) of each whole text; null and empty texts get the model's bias alone.

    All columns pass: where one has the new name, the new column is called with further underscores.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # two vectors of FEATURES numbers
    name = unused(out_col, docs)

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        m = sent.value
        got = [m.score(at) for at in places(part.column(text_col))]
        return pa.RecordBatch.from_arrays([*part.columns, pa.array(got, pa.float64())], names=[*part.schema.names, name])

    return map_text(docs, text_col, run, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.3) -> DataFrame:
    """(id, held_out, score, predicted) of every row: predicted is 1 if the score is ``least`` or more.

    Null and empty texts, null ids (not held out) and repeated rows are scored like others; equal texts have equal
    scores. Without labels every score is one half. An empty table gives none. Other columns are ignored. What
    is learned from is said at ``train``.
    """
    model = train(docs, labels, id_col, text_col)
    rows = score(docs.select(F.col(id_col), F.col(text_col)), model, text_col)
    return rows.select(id_col, held_out(id_col).alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))
