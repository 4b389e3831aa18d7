"""A quality classifier by Bradley-Terry pairwise ranking.

A document's strength is w . x over features of its text. Preference pairs (a document labelled good over one
labelled bad) train w by logistic loss on feature differences. The quantile of the training scores that separates
the labels best becomes the threshold; score = sigmoid(strength - threshold).

Features are shares of byte classes, of repeated words, of table and symbol words and line shapes, over the whole
text. Labels, language, source and id are never inputs.

Training reads every labelled row outside the held-out third, and the loss is over all pairs of a good and a bad one;
nothing is sampled. A pair's loss depends on two strengths only, so each Newton step is one pass that sums counts,
features and their products by label and narrow ranges of strength (``STEPS``), about whose mean strength the loss is
expanded to the second order; the driver gets these sums, whose number does not grow with the rows. The threshold comes from the counts
of all rows by label and still narrower ranges (``LEVELS``).

Defined results: null text counts as empty; rows of ``labels`` that repeat an id are averaged, null labels are
ignored; without rows of both labels every score is 0.5. One row per input row; an empty table gives an empty result.
Texts of any length are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C
from . import rolling as R

#: Ranges of strength for a unit at 0 (wider further out, by asinh): for the sums of a step, and for the threshold.
STEPS, LEVELS = 32, 1024
#: Words by which a text counts half.
DOUBT = 8
#: Byte classes, in the order of the features.
CLASSES = {
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "digit": b"0123456789",
    "blank": b" \t\x0b\x0c\r",
    "line": b"\n",
    "stop": b".,;:?'\"()-",
    "shout": b"!",
    "bar": b"|",
    "sign": b"#$%&*@^~_+=<>/\\[]{}`",
    "control": bytes([*range(9), *range(14, 32), 127]),
    "high": bytes(range(128, 256)),
}
_OF_BYTE = np.zeros(256, np.uint8)
for _i, _c in enumerate(CLASSES.values()):
    _OF_BYTE[list(_c)] = _i
WORDS = ("repeated", "one_byte", "upper_word", "sign_end", "shout_end", "long_word")
NAMES = [*CLASSES, *WORDS, "word_bytes", "words_a_line", "log_words", "no_words"]


def features(column: pa.Array) -> np.ndarray:
    """A row of features for each text."""
    out = np.zeros((len(column), len(NAMES)))
    k = len(CLASSES)
    for first, end, data, offsets in R.blocks(column):
        rows = end - first
        kind = _OF_BYTE[data]
        size = np.maximum(np.diff(offsets), 1)
        for c in range(k):
            hits = np.r_[0, np.cumsum(kind == c, dtype=np.int64)]
            out[first:end, c] = (hits[offsets[1:]] - hits[offsets[:-1]]) / size
        row, s, e, h = R.row_words(data, offsets)
        n = np.bincount(row, minlength=rows)
        share = np.maximum(n, 1)
        again = np.r_[False, (h[1:] == h[:-1]) & (row[1:] == row[:-1])] if len(h) else np.zeros(0, bool)
        last, head = (data[e - 1], data[s]) if len(s) else (data[:0], data[:0])
        last_kind, head_kind = _OF_BYTE[last], _OF_BYTE[head]
        second = _OF_BYTE[data[np.minimum(s + 1, e - 1)]] if len(s) else head_kind
        wide = e - s
        for i, x in enumerate((again, wide == 1, (head_kind == 1) & (second == 1) & (wide > 1), last_kind == 8, last_kind == 6, wide > 24)):
            out[first:end, k + i] = np.bincount(row[x], minlength=rows) / share
        out[first:end, k + 6] = np.bincount(row, weights=wide, minlength=rows) / share / 10
        out[first:end, k + 7] = np.log1p(n / (1 + out[first:end, 4] * size)) / 5
        out[first:end, k + 8] = np.log1p(n) / 10
        out[first:end, k + 9] = n == 0
    return out


def standard(x: np.ndarray, centre: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Standardised features, drawn to the centre where a text has few words to judge by."""
    words = np.expm1(10 * x[:, NAMES.index("log_words")])
    return (x - centre) / scale * (words / (words + DOUBT))[:, None]


@dataclass
class Ranker:
    weights: np.ndarray
    centre: np.ndarray
    scale: np.ndarray
    threshold: float

    def score(self, x: np.ndarray) -> np.ndarray:
        s = standard(x, self.centre, self.scale) @ self.weights - self.threshold
        return 1 / (1 + np.exp(-np.clip(s, -500, 500)))


def _by_strength(model: Ranker | None, steps: int, products: bool):
    """Sums over rows by label and range of strength: _i (-1: the count, else products of feature _i with all) and m0..."""
    k = len(NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            if not b.num_rows:
                continue
            x, y = b.column("x").flatten().to_numpy().reshape(-1, k), b.column("_y").to_numpy()
            z = standard(x, model.centre, model.scale) if model else x
            at = np.floor(steps * np.arcsinh(z @ model.weights)).astype(np.int64) if model else np.zeros(len(y), np.int64)
            order = np.lexsort((y, at))
            z, at, y = np.c_[z, np.ones(len(z))][order], at[order], y[order]
            first = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (y[1:] != y[:-1])])
            sums = np.add.reduceat((z[:, :, None] * z[:, None, :]).reshape(len(z), -1), first) if products else np.diff(np.r_[first, len(z)])
            for i, s in zip(first, sums, strict=True):
                key = (int(at[i]), int(y[i]))
                total[key] = total[key] + s if key in total else s
        if not total:
            return
        size = k + 1 if products else 1
        keys, sums = np.repeat(np.array(list(total)), size, axis=0), np.array(list(total.values()), np.float64).reshape(-1, size)
        i = np.tile(np.arange(size), len(total))
        yield pa.RecordBatch.from_arrays([pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array(i), *map(pa.array, sums.T.copy())], ["_at", "_y", "_i", *(f"m{j}" for j in range(size))])

    return run


def gathered(rows: DataFrame, model: Ranker | None, steps: int = 1, products: bool = True) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each label: ranges of strength, ascending, and in each the products of all features and 1 summed over its
    rows (without ``products``: its rows). Without a model all rows are one range and features are as they are."""
    size = len(NAMES) + 1 if products else 1
    columns = [f"m{j}" for j in range(size)]
    parts = rows.mapInArrow(_by_strength(model, steps, products), "_at long, _y long, _i long, " + ", ".join(f"{c} double" for c in columns))
    found = parts.groupBy("_at", "_y", "_i").agg(*(F.sum(c).alias(c) for c in columns)).toPandas().sort_values(["_at", "_i"])
    of = {y: found[found._y == y] for y in (0, 1)}
    return {y: (f._at.to_numpy()[::size], f[columns].to_numpy().reshape((-1, size, size) if products else -1)) for y, f in of.items()}


def _loss(w: np.ndarray, sums: dict[int, tuple[np.ndarray, np.ndarray]], ridge: float) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean over all pairs of log(1 + exp(-w . (x_good - x_bad))) + ridge |w|^2 / 2, its gradient and second derivatives."""
    k = len(w)
    (n, x, xx), (m, y, yy) = ((s[:, k, k], s[:, k, :k], s[:, :k, :k]) for s in (sums[1][1], sums[0][1]))
    pairs = n.sum() * m.sum()
    s, r = x @ w / n, y @ w / m
    # how features and strengths vary within a range: the next terms of the expansion about its mean strength
    with_s, with_r = xx @ w - x * s[:, None], yy @ w - y * r[:, None]
    spread = ((with_s @ w / n)[:, None] + (with_r @ w / m)[None, :]) / 2
    apart = s[:, None] - r[None, :]
    p = np.exp(-np.logaddexp(0, apart))
    v = p * (1 - p)
    loss = n @ (np.logaddexp(0, -apart) + v * spread) @ m / pairs + ridge * (w @ w) / 2
    wrong = p + v * (1 - 2 * p) * spread
    grad = ((n @ wrong) @ y + (n @ v) @ with_r - (wrong @ m) @ x + (v @ m) @ with_s) / pairs + ridge * w
    cross = x.T @ v @ y
    second = (np.tensordot(v @ m, xx, 1) + np.tensordot(n @ v, yy, 1) - cross - cross.T) / pairs + ridge * np.eye(k)
    return float(loss), grad, second


def fit_pairs(rows: DataFrame, ridge: float = 1e-3, rounds: int = 40) -> Ranker | None:
    """Newton steps on the loss over all pairs of a good and a bad row of (_y, x), halved where one leads up."""
    k = len(NAMES)
    every = gathered(rows, None)
    if not all(len(at) for at, _ in every.values()):
        return None
    total = sum(s.sum(axis=0) for _, s in every.values())
    # numbers of the model are rounded, so that the order in which tasks end does not show
    centre = np.round(total[k, :k] / total[k, k], 9)
    scale = np.round(np.sqrt(np.maximum(np.diag(total)[:k] / total[k, k] - centre**2, 0)), 9)
    scale[scale < 1e-6] = 1
    model, step, before = Ranker(np.zeros(k), centre, scale, 0.0), np.zeros(k), np.inf
    for _ in range(rounds):
        loss, grad, second = _loss(model.weights, gathered(rows, model, STEPS), ridge)
        if loss > before + 1e-6:
            step = step / 2
            model.weights = np.round(model.weights + step, 9)
            continue
        before, step = loss, np.linalg.solve(second, grad)
        model.weights = np.round(model.weights - step, 9)
        if grad @ step < 1e-7:  # twice what the loss can still lose
            break
    # the quantile of the scores at which the two error rates are least in sum
    (bad_at, bad), (good_at, good) = gathered(rows, model, LEVELS, False).values()
    levels = np.unique(np.r_[good_at, bad_at])
    below = lambda at, n: np.r_[0, np.cumsum(n)][np.searchsorted(at, levels)] / n.sum()
    wrong = below(good_at, good) + 1 - below(bad_at, bad)
    best = np.flatnonzero(np.isclose(wrong, wrong.min(), rtol=0, atol=1e-12))
    model.threshold = float(np.sinh(levels[best[len(best) // 2]] / LEVELS))
    return model


def held_out(id_col: str = "doc_id") -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Ranker | None:
    """Learns from all labelled rows outside the held-out third. Features, not texts, meet the labels."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col)).groupBy(F.col(id_col).cast("long").alias("_id")).agg((F.avg(label_col) >= 0.5).cast("int").alias("_y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1) * len(NAMES), pa.int32()), pa.array(features(b.column("text")).ravel()))
            yield pa.RecordBatch.from_arrays([b.column("_id"), x], ["_id", "x"])

    C.small_batches(docs.sparkSession)
    texts = docs.where(F.col(id_col).isNotNull() & ~held_out(id_col)).select(F.col(id_col).cast("long").alias("_id"), C.text_or_empty(text_col).alias("text"))
    rows = C.written(texts.mapInArrow(run, "_id long, x array<double>").join(known, "_id").select("_y", "x"), "quality-rows")
    model = fit_pairs(rows)
    C.removed(rows)
    return model


def score(docs: DataFrame, model: Ranker | None, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs; with ``keep`` the rows predicted 1 instead, unchanged."""
    schema = docs.schema if keep else "_id long, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = features(b.column(text_col if keep else "text"))
            s = model.score(x) if model else np.full(len(x), 0.5)
            if keep:
                yield b.filter(pa.array(s >= 0.5))
            else:
                yield pa.RecordBatch.from_arrays([b.column("_id"), pa.array(s)], ["_id", "score"])

    C.small_batches(docs.sparkSession)
    if keep:
        return docs.mapInArrow(run, schema)
    scored = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
    return scored.select(F.col("_id").alias("doc_id"), F.coalesce(held_out("_id"), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
