"""A quantile booster for traffic volumes, and its cross-validation by route."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbline.params import Params


class QuantileTrees:
    """Gradient-boosted trees for a quantile of log1p(target), on histogram bins.

    Splits follow the pinball loss's gradient; leaves take the weighted quantile of their residuals.
    """

    def __init__(self, quantile: float, rounds: int, rate: float, leaves: int, least: int, l2: float, bins: int = 32):
        self.q, self.rounds, self.rate, self.leaves, self.least, self.l2, self.bins = quantile, rounds, rate, leaves, least, l2, bins
        self.trees: list[list[tuple]] = []

    def _leaf(self, r: np.ndarray, w: np.ndarray) -> float:
        order = np.argsort(r, kind="stable")
        c = np.cumsum(w[order])
        return float(r[order][min(np.searchsorted(c, self.q * c[-1]), len(r) - 1)] * w.sum() / (w.sum() + self.l2 * w.mean()))

    def fit(self, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> QuantileTrees:
        y = np.log1p(y)
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(x.shape[1])]
        b = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)], axis=1)
        self.base = self._leaf(y, w) if len(y) else 0.0
        at = np.full(len(y), self.base)
        for _ in range(self.rounds if len(y) else 0):
            r = y - at
            g = w * np.where(r > 0, self.q, self.q - 1)
            leaf_of = np.zeros(len(y), int)
            splits: list[tuple] = []  # (leaf, feature, bin, new leaf)
            open_ = {0: self._best(b, g, w, np.arange(len(y)))}
            n = 1
            while n < self.leaves:
                leaf = max((k for k, v in open_.items() if v), key=lambda k: open_[k][0], default=None)
                if leaf is None:
                    break
                _, j, cut = open_[leaf]
                rows = np.nonzero(leaf_of == leaf)[0]
                leaf_of[rows[b[rows, j] > cut]] = n
                splits.append((leaf, j, cut, n))
                for k in (leaf, n):
                    open_[k] = self._best(b, g, w, np.nonzero(leaf_of == k)[0])
                n += 1
            values = np.array([self._leaf(r[leaf_of == k], w[leaf_of == k]) for k in range(n)])
            at += self.rate * values[leaf_of]
            self.trees.append((splits, values))
        return self

    def _best(self, b: np.ndarray, g: np.ndarray, w: np.ndarray, rows: np.ndarray):
        if len(rows) < 2 * self.least:
            return None
        best, gs, ws = None, g[rows].sum(), w[rows].sum()
        for j in range(b.shape[1]):
            k = len(self.edges[j]) + 1
            gl, wl, nl = (np.cumsum(np.bincount(b[rows, j], v, k))[:-1] for v in (g[rows], w[rows], None))
            ok = (nl >= self.least) & (len(rows) - nl >= self.least)
            if ok.any():
                gain = np.where(ok, gl**2 / (wl + self.l2) + (gs - gl) ** 2 / (ws - wl + self.l2) - gs**2 / (ws + self.l2), -1)
                i = int(gain.argmax())
                if gain[i] > 1e-12 and (best is None or gain[i] > best[0]):
                    best = (float(gain[i]), j, i)
        return best

    def predict(self, x: np.ndarray) -> np.ndarray:
        b = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)], axis=1)
        out = np.full(len(x), self.base)
        for splits, values in self.trees:
            leaf = np.zeros(len(x), int)
            for at, j, cut, new in splits:
                leaf[(leaf == at) & (b[:, j] > cut)] = new
            out += self.rate * values[leaf]
        return np.expm1(out)


def _matrix(frame: pd.DataFrame, numbers: list[str], categories: list[str], codes: dict, medians: dict) -> np.ndarray:
    cols = [frame[c].astype(float).fillna(medians[c]).to_numpy() for c in numbers]
    cols += [frame[c].astype(object).where(frame[c].notna(), None).map(lambda v, c=c: codes[c].get(str(v), -1)).to_numpy(float) for c in categories]
    return np.stack(cols, axis=1)


def _fit(frame: pd.DataFrame, numbers: list[str], categories: list[str], target: str, weight: str, m: dict):
    codes = {c: {v: i for i, v in enumerate(sorted(frame[c].dropna().astype(str).unique()))} for c in categories}
    medians = {c: float(np.nan_to_num(frame[c].astype(float).median())) for c in numbers}
    trees = QuantileTrees(m["quantile"], m["max_iter"], m["learning_rate"], m["max_leaf_nodes"], m["min_samples_leaf"], m["l2"])
    trees.fit(_matrix(frame, numbers, categories, codes, medians), frame[target].to_numpy(float), frame[weight].to_numpy(float))
    return lambda other: trees.predict(_matrix(other, numbers, categories, codes, medians))


def predict(train: DataFrame, rows: DataFrame, numbers: list[str], categories: list[str], target: str, weight: str, p: Params, key: str = "id", most: int = 50_000) -> DataFrame:
    """(key, predicted): predictions for rows, clipped to the floor and the largest volume.

    train: counted segments, at most `most` of them (those of least hash of key: a bounded sample for the fit).
    """
    m = p["aadt.model"]
    sample = train.orderBy(F.xxhash64(key), key).limit(most).select(*numbers, *categories, target, weight).toPandas()
    kind = rows.schema[key].dataType.simpleString()
    if sample.empty:
        return rows.select(key, F.lit(None).cast("double").alias("predicted"))
    model, low, high = _fit(sample, numbers, categories, target, weight, m), float(p["aadt.impute_floor"]), float(m["max_aadt"])

    def work(frames):
        for frame in frames:
            yield pd.DataFrame({key: frame[key], "predicted": np.clip(model(frame), low, high) if len(frame) else []})

    return rows.select(key, *numbers, *categories).mapInPandas(work, f"{key} {kind}, predicted double")


def cross_validate(train: DataFrame, numbers: list[str], categories: list[str], target: str, weight: str, group: str, p: Params, key: str = "id") -> DataFrame:
    """(key, fold, predicted): out-of-fold predictions; a route's rows share a fold, and folds are fitted side by side."""
    m = p["aadt.model"]
    folds, low, high = m["cv_folds"], float(p["aadt.impute_floor"]), float(m["max_aadt"])
    rows = train.select(key, *numbers, *categories, target, weight, F.pmod(F.xxhash64(group), F.lit(folds)).cast("int").alias("own"))
    copies = rows.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
    kind = train.schema[key].dataType.simpleString()

    def work(frame):
        test = frame["own"] == frame["fold"].iloc[0]
        got = np.full(int(test.sum()), low)
        if test.any() and (~test).any():
            got = np.clip(_fit(frame[~test], numbers, categories, target, weight, m)(frame[test]), low, high)
        return pd.DataFrame({key: frame.loc[test, key], "fold": frame.loc[test, "fold"], "predicted": got})

    return copies.groupBy("fold").applyInPandas(work, f"{key} {kind}, fold int, predicted double")
