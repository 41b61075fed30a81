"""Quality classifier: random Fourier features of document statistics, ridge regression, isotonic calibration.

Gaussian-kernel features (Rahimi & Recht 2007) of a few dozen statistics; the normal equations are summed
by partition and then in a tree, over every labelled row that isn't held out, in folds. The folds choose the
ridge, and the scores that each row gets from the other folds' equations calibrate the final ones by pooling
adjacent violators over a fixed grid of bins: rows that a model was fitted on would flatter it.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbline.llm.common import discard, held_out, saved, scratch, tidy

STATISTICS = (
    "log_bytes", "log_words", "log_lines", "upper", "lower", "digit", "space", "line_break", "end_mark", "comma", "shout", "pipe", "symbol", "other_mark",
    "high_byte", "word_length", "word_spread", "distinct", "top_word", "short_word", "long_word", "upper_word", "marked_word", "lines_repeated", "bytes_repeated",
    "line_words", "pairs_repeated", "entropy",
)
_KINDS = np.full(256, 10)
for _k, _chars in enumerate((range(65, 91), range(97, 123), range(48, 58), b" \t", b"\n\r", b".?;:", b",", b"!", b"|", b"#$%&*~^_=+<>@\\{}[]", range(128, 256))):
    _KINDS[list(_chars)] = _k if _k < 10 else 11


def statistics(text: str | None) -> list[float]:
    """STATISTICS of a whole text; all 0 for null and empty texts."""
    if not text:
        return [0.0] * len(STATISTICS)
    raw = text.encode("utf-8", "surrogatepass")
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    kinds = np.bincount(_KINDS, counts, minlength=12) / len(raw)
    share = counts[counts > 0] / len(raw)
    words, lines = raw.split(), [x for x in raw.split(b"\n") if x.strip()]
    n = max(1, len(words))
    lengths = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    seen, by_line = Counter(words), Counter(lines)
    repeated = {k: c for k, c in by_line.items() if c > 1}
    pairs = set(zip(words, words[1:]))
    marked = sum(c for w, c in seen.items() if not w[-1:].isalnum() and w[-1] < 128)
    return [
        math.log1p(len(raw)), math.log1p(len(words)), math.log1p(len(lines)), *kinds[:10].tolist(), kinds[10], kinds[11],
        lengths.mean(), lengths.std(), len(seen) / n, max(seen.values(), default=0) / n, float((lengths <= 3).mean()), float((lengths >= 12).mean()),
        sum(c for w, c in seen.items() if len(w) > 1 and w.isupper()) / n, marked / n, sum(c - 1 for c in repeated.values()) / max(1, len(lines)),
        sum(len(k) * (c - 1) for k, c in repeated.items()) / len(raw), math.log1p(n / max(1, len(lines))), 1 - len(pairs) / max(1, len(words) - 1), float(-(share * np.log2(share)).sum()),
    ]


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, x): statistics of every row's whole text, stored; a few hundred bytes a row."""
    kind = docs.schema[id_col].dataType.simpleString()

    def work(frames):
        for frame in frames:
            yield pd.DataFrame({"id": frame["id"], "x": [statistics(t) for t in frame["text"]]})

    # ids pass Python as text, where a null among whole numbers would make them floats
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    return saved(rows.mapInPandas(tidy(work), "id string, x array<double>").withColumn("id", F.col("id").cast(kind)), "statistics")


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    projection: np.ndarray
    phase: np.ndarray
    weights: np.ndarray
    levels: np.ndarray  # calibrated score by bin of the raw score, [0, 1] cut into equal bins

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.hstack([np.cos(z @ self.projection + self.phase) * math.sqrt(2 / len(self.phase)), np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def bins(self, raw: np.ndarray) -> np.ndarray:
        return np.clip((raw * len(self.levels)).astype(int), 0, len(self.levels) - 1)

    def score(self, x: np.ndarray) -> np.ndarray:
        """The bin's calibrated level, ordered within a level by the raw score."""
        raw = self.raw(x)
        return np.clip(0.999 * self.levels[self.bins(raw)] + 0.001 * np.clip(raw, 0, 1), 0, 1)


def _summed(rows: DataFrame, of, fan: int = 16) -> dict[int, np.ndarray]:
    """By fold, the sum over its rows of of(x, y, fold), an array: by partition, then in a tree of `fan` arrays a task."""

    def part(frames):
        from pyspark import TaskContext

        total: dict[int, np.ndarray] = {}
        for frame in frames:
            for fold, own in frame.groupby("fold"):
                total[fold] = total.get(fold, 0) + of(np.stack(own["x"].to_numpy()), own["y"].to_numpy(float), int(fold))
        g = TaskContext.get().partitionId()
        yield pd.DataFrame([(int(fold), g, v.tobytes()) for fold, v in total.items()], columns=["fold", "g", "v"])

    def add(frame):
        total = sum(np.frombuffer(v) for v in frame["v"])
        return pd.DataFrame({"fold": frame["fold"].iloc[:1], "g": frame["g"].iloc[:1], "v": [total.tobytes()]})

    kind = "fold int, g int, v binary"
    parts = saved(rows.mapInPandas(tidy(part), kind), "sums")
    most = parts.agg(F.max("g")).first()[0] or 0
    while most:
        most //= fan
        after = saved(parts.withColumn("g", F.floor(F.col("g") / fan).cast("int")).groupBy("fold", "g").applyInPandas(add, kind), "sums")
        discard(parts)
        parts = after
    return {r["fold"]: np.frombuffer(r["v"]) for r in parts.collect()}  # an array for each fold


def isotonic(hits: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Non-decreasing level per bin of least squared error, by pooling adjacent violators; empty bins take their neighbours'."""
    blocks: list[list[float]] = []  # level, weight, bins
    for h, c in zip(hits, counts):
        blocks.append([h / c if c else (blocks[-1][0] if blocks else 0.0), c, 1])
        while len(blocks) > 1 and blocks[-2][0] > blocks[-1][0]:
            b, a = blocks.pop(), blocks.pop()
            w = a[1] + b[1]
            blocks.append([(a[0] * a[1] + b[0] * b[1]) / w if w else a[0], w, a[2] + b[2]])
    return np.concatenate([np.full(int(n), level) for level, _, n in blocks])


FOLDS = 5
RIDGES = (1e-5, 1e-4, 1e-3, 1e-2, 0.1, 1.0)


def _solve(gram: np.ndarray, right: np.ndarray, ridge: float, n: float) -> np.ndarray:
    """Ridge regression's weights; the last feature, a constant, is not drawn to 0."""
    d = len(right)
    pull = np.append(np.full(d - 1, ridge * n / (d - 1)), 0) + 1e-9
    return np.linalg.solve(gram + np.diag(pull), right)


def fit(stats: DataFrame, labels: DataFrame, label: str = "quality", dims: int = 256, width: float = 0.03, ridges: tuple[float, ...] = RIDGES, bins: int = 200, seed: int = 7, id_col: str = "doc_id") -> Model:
    """Fit on every labelled row that isn't held out. stats: of measured(). Without such rows every score is 0.5.

    Labels that are null or not 0 or 1 are left out; of repeated labels the largest counts. Rows that repeat
    an id are rows of their own, in one fold. Of `ridges` that of least squared error over left-out folds is taken.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(id_col)).groupBy(F.col(id_col).alias("id")).agg(F.max(label).alias("y"))
    fold = F.pmod(F.xxhash64("id"), F.lit(FOLDS)).cast("int")
    with scratch(stats.sparkSession):
        rows = stats.join(known, "id").select("x", F.col("y").cast("double").alias("y"), fold.alias("fold"))
        return _fit(saved(rows, "labelled"), dims, width, ridges, bins, seed)


def _fit(rows: DataFrame, dims: int, width: float, ridges: tuple[float, ...], bins: int, seed: int) -> Model:
    """rows: (x, y, fold)."""
    k, d = len(STATISTICS), dims + 1
    first = sum(_summed(rows, lambda x, y, fold: np.concatenate([[len(y)], x.sum(0), (x**2).sum(0)])).values(), np.zeros(1 + 2 * k))
    n = first[0]
    rng = np.random.default_rng(seed)
    mean = first[1 : 1 + k] / max(n, 1)
    scale = np.sqrt(np.maximum(first[1 + k :] / max(n, 1) - mean**2, 1e-8))
    model = Model(mean, scale, rng.normal(0, math.sqrt(width), (k, dims)), rng.uniform(0, 2 * math.pi, dims), np.zeros(d), np.zeros(bins))
    if not n:
        model.weights[-1], model.levels = 0.5, np.full(bins, 0.5)
        return model

    def equations(x, y, fold):
        z = model.features(x)
        return np.concatenate([[len(y)], (z.T @ z).ravel(), z.T @ y])

    own = _summed(rows, equations)
    total = sum(own.values())
    split = lambda v: (v[1 : 1 + d * d].reshape(d, d), v[1 + d * d :])
    left_out = {f: np.stack([_solve(*split(total - v), r, n - v[0]) for r in ridges], axis=1) for f, v in own.items()}

    def tested(x, y, fold):
        """For each ridge: squared error, then hits and counts by bin, of the scores that other folds' equations give."""
        raw = model.features(x) @ left_out[fold]
        return np.concatenate([_binned(raw[:, i], y, model, bins) for i in range(len(ridges))])

    found = sum(_summed(rows, tested).values()).reshape(len(ridges), -1)
    best = int(found[:, 0].argmin())
    model.weights = _solve(*split(total), ridges[best], n)
    model.levels = isotonic(found[best, 1 : 1 + bins], found[best, 1 + bins :])
    return model


def _binned(raw: np.ndarray, y: np.ndarray, model: Model, bins: int) -> np.ndarray:
    at = model.bins(raw)
    return np.concatenate([[((raw - y) ** 2).sum()], np.bincount(at, y, bins), np.bincount(at, minlength=bins)])


def score(stats: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """Per row: (id, held_out, score, predicted). Null and empty texts have scores like any other; null ids are not held out."""
    kind = stats.schema["id"].dataType.simpleString()

    def work(frames):
        for frame in frames:
            value = model.score(np.stack(frame["x"].to_numpy())) if len(frame) else []
            yield pd.DataFrame({"id": frame["id"], "score": value})

    out = stats.withColumn("id", F.col("id").cast("string")).mapInPandas(tidy(work), "id string, score double").withColumn("id", F.col("id").cast(kind))
    return out.select("id", held_out("id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
