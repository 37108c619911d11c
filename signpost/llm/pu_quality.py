"""Quality classifier by positive-unlabelled learning.

Trusted positives are documents labelled good; the unlabelled set is web text as it comes. With the share pi of good
documents, a scorer's risk over the unseen negatives is its negative risk on unlabelled text less pi times its negative
risk on positives. That difference is an estimate and may fall below zero once the scorer fits single documents; the
non-negative estimator stops there: such a step goes the other way. The scorer is a network with one hidden layer over
proportions of the text (symbols, capitals, repeated lines, words and word pairs, lengths). Its logits are set against
the labels of the training fold, so that a score of 0.7 means what it says.

The fit uses at most `max_labelled` labelled and `max_unlabelled` unlabelled ids, the first by a hash of their id, and of
each at most `TEXTS_PER_ID` different texts, so that no id fills the bounds or the driver;
scoring covers every document. pi is the share of good ones among the training labels, which are a sample of the web
text.

Defined cases: null and empty texts have the features of an empty text and are scored; a null label is no label; repeated
rows are scored alike; without training labels every score is 0.5; without documents there are no rows; further columns are
ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_LABELLED = 6_000
MAX_UNLABELLED = 12_000
#: Different texts of one id in the fit.
TEXTS_PER_ID = 4
THRESHOLD = 0.7

SYMBOLS = b"#*$%&|<>=_~^@{}[]\\/+"
STOPS = b".,;:?-'\"()"
UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
DIGITS = b"0123456789"


def features(text: str | None) -> list[float]:
    """Proportions of a whole text; the sizes enter as logarithms."""
    raw = (text or "").encode("utf-8", "replace")
    words = raw.split()
    n, size = len(words), len(raw)
    if not n:
        return [0.0] * N_FEATURES
    share = lambda chars: (size - len(raw.translate(None, chars))) / size
    distinct = len(set(words))
    pairs = len(set(zip(words, words[1:], strict=False)))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    longest = max(map(len, words))
    tails = sum(w[-1:] in (b"*", b"#", b"$", b"%", b"&", b"!") for w in words)
    return [
        math.sqrt(share(SYMBOLS)),
        share(STOPS),
        math.sqrt(share(UPPER)),
        math.sqrt(share(DIGITS)),
        math.sqrt(share(b"!")),
        sum(map(bytes.isupper, words)) / n,
        tails / n,
        distinct / n,
        pairs / max(1, n - 1),
        len(set(lines)) / len(lines),
        sum(x.rstrip()[-1:] in (b".", b"!", b"?", b'"') for x in lines) / len(lines),
        math.log1p(n),
        math.log1p(len(lines)),
        math.log1p(n / len(lines)),
        sum(map(len, words)) / n / 10,
        math.log1p(longest),
        math.log1p(n) * (1 - distinct / n),
    ]


N_FEATURES = 17


def fit_nnpu(
    positive: np.ndarray, unlabelled: np.ndarray, prior: float, *, hidden: int = 16, steps: int = 900, rate: float = 0.01
) -> list[np.ndarray]:
    """Weights of the scorer that minimises the non-negative risk (sigmoid loss), by Adam on whole batches."""
    rng = np.random.default_rng(7)
    d = positive.shape[1]
    w = [rng.normal(0, 1 / math.sqrt(d), (d, hidden)), np.zeros(hidden), rng.normal(0, 1 / math.sqrt(hidden), hidden), np.zeros(1)]
    m, v = [np.zeros_like(x) for x in w], [np.zeros_like(x) for x in w]
    for step in range(1, steps + 1):
        hp, zp = forward(w, positive)
        hu, zu = forward(w, unlabelled)
        # sigmoid loss: l(z) = s(-z) for a positive, s(z) for a negative; both have slope -+ s(z) s(-z)
        sp, su = 1 / (1 + np.exp(-zp)), 1 / (1 + np.exp(-zu))
        slope_p, slope_u = sp * (1 - sp) / len(zp), su * (1 - su) / len(zu)
        negative = su.mean() - prior * sp.mean()
        if negative >= 0:
            gp, gu = -prior * slope_p - prior * slope_p, slope_u
        else:
            gp, gu = prior * slope_p, -slope_u
        grads = [np.zeros_like(x) for x in w]
        for x, h, g in ((positive, hp, gp), (unlabelled, hu, gu)):
            back = np.outer(g, w[2]) * (1 - h * h)
            grads[0] += x.T @ back
            grads[1] += back.sum(0)
            grads[2] += h.T @ g
            grads[3] += g.sum()
        for i, g in enumerate(grads):
            g = g + 1e-4 * w[i]
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.999 * v[i] + 0.001 * g * g
            w[i] = w[i] - rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    return w


def forward(w: list[np.ndarray], x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    h = np.tanh(x @ w[0] + w[1])
    return h, np.clip(h @ w[2] + w[3], -30, 30)


def calibrate(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve through (logit, label), by Newton steps; smoothed targets keep it finite."""
    n1, n0 = y.sum(), (1 - y).sum()
    t = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        g = np.array([((p - t) * z).sum() + 1e-3 * a, (p - t).sum()])
        q = p * (1 - p)
        hess = np.array([[(q * z * z).sum() + 1e-3, (q * z).sum()], [(q * z).sum(), q.sum() + 1e-6]])
        step = np.linalg.solve(hess, g)
        a, b = a - np.clip(step[0], -1, 1), b - np.clip(step[1], -1, 1)
    return float(a), float(b)


class QualityModel:
    """Standardisation, network and calibration; small enough to travel with every task."""

    def __init__(self, mean, scale, weights, slope, offset):
        self.mean, self.scale, self.weights, self.slope, self.offset = mean, scale, weights, slope, offset

    def score(self, rows: np.ndarray) -> np.ndarray:
        _, z = forward(self.weights, np.clip((rows - self.mean) / self.scale, -8, 8))
        return 1 / (1 + np.exp(-np.clip(self.slope * z + self.offset, -30, 30)))


def held_out_fold(doc_id: Column, parts: int, fold: int) -> Column:
    """Whether crc32 of the id as text falls into the fold; a null id counts as the text ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts == fold


def train(
    docs: DataFrame,
    labels: DataFrame,
    trainable: Column,
    *,
    max_labelled: int = MAX_LABELLED,
    max_unlabelled: int = MAX_UNLABELLED,
) -> QualityModel | None:
    """Fit on the first rows by id hash; `trainable` tells by `doc_id` whose labels may be used. None without labels."""
    order = F.xxhash64("doc_id")
    known = (
        labels.where(trainable & F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.max("quality").alias("quality"))
        .orderBy(order, "doc_id")
        .limit(max_labelled)
    )
    # unlabelled text is drawn without a look at labels
    drawn = docs.select("doc_id").where("doc_id is not null").distinct().orderBy(order, "doc_id").limit(max_unlabelled)
    wanted = known.join(drawn.select("doc_id", F.lit(True).alias("drawn")), "doc_id", "full_outer").select(
        "doc_id", "quality", F.coalesce("drawn", F.lit(False)).alias("drawn")
    )
    sample = docs.select("doc_id", F.xxhash64("text").alias("version"), "text")
    # an id may have any share of the rows: equal ones count once, and of different texts the first by hash
    versions = sample.select("doc_id", "version").join(F.broadcast(wanted), "doc_id").distinct()
    first = F.row_number().over(Window.partitionBy("doc_id").orderBy("version"))
    chosen = versions.withColumn("place", first).where(F.col("place") <= TEXTS_PER_ID).drop("place")
    rows = sample.join(F.broadcast(chosen), ["doc_id", "version"]).select("doc_id", "version", "quality", "drawn", "text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set = set()
        for b in batches:
            keys = list(zip(b["doc_id"], b["version"], strict=True))
            new = [k not in seen and not seen.add(k) for k in keys]
            b = b[new]
            yield b[["doc_id", "version", "quality", "drawn"]].assign(x=[features(t) for t in b["text"]])

    kind = sample.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, version long, quality int, drawn boolean, x array<double>"
    rows = rows.mapInPandas(run, schema).dropDuplicates(["doc_id", "version"]).toPandas()
    rows = rows.sort_values(["doc_id", "version"]).astype({"quality": "float64"})
    # labelled ones, then unlabelled ones; a document may be both
    rows = pd.concat([rows[rows["quality"].notna()], rows[rows["drawn"].astype(bool)].assign(quality=np.nan)])
    if not rows["quality"].notna().any():
        return None
    x = np.array(rows["x"].tolist()).reshape(-1, N_FEATURES)
    y = rows["quality"].to_numpy(dtype=float, na_value=np.nan)
    u = x[np.isnan(y)] if np.isnan(y).any() else x
    mean, scale = u.mean(0), u.std(0) + 1e-6
    std = lambda a: np.clip((a - mean) / scale, -8, 8)
    known_y, known_x = y[~np.isnan(y)], std(x[~np.isnan(y)])
    prior = float(np.clip(known_y.mean(), 0.01, 0.99))
    positive = known_x[known_y == 1] if (known_y == 1).any() else known_x
    weights = fit_nnpu(positive, std(u), prior)
    slope, offset = calibrate(forward(weights, known_x)[1], known_y)
    return QualityModel(mean, scale, weights, slope, offset)


def score_documents(docs: DataFrame, model: QualityModel | None) -> DataFrame:
    """The input's columns and `score`, which replaces a column of that name."""
    if model is None:
        return docs.withColumn("score", F.lit(0.5))

    @F.pandas_udf("double")
    def scored(text: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.array([features(t) for t in text]).reshape(-1, N_FEATURES)))

    return docs.withColumn("score", scored("text"))
