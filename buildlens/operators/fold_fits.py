"""Fits of one fold in one task: its rows come once, all its candidates are fitted to them.

A fold is a bounded group (``window`` rows and a fifth more), so its windows are
views that the task cuts from the rows; they are never stored or shuffled.

The classifier is ridge-penalised logistic regression with an intercept, as in Spark
ML (features scaled by their weighted deviation, weighted mean loss, half the squared
norm times ``reg_param``). A fold has fewer windows than a window has cells, so the
weights are sums of the fold's windows, and Newton steps solve for the sums' factors.
Each step is halved until the loss falls. The fit depends on nothing random.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import sequences as S

WEIGHTS, BEFORE_WINDOW, NONE = "weights", "before_window", "none"
BALANCES = [WEIGHTS, BEFORE_WINDOW, NONE]
#: Least penalty: without any, a fold that can be separated has no best weights.
LEAST_PENALTY = 1e-4
#: Beyond these log odds a class is as good as certain.
CERTAIN = 30.0


def fold_views(x: np.ndarray, length: int) -> np.ndarray:
    """For each row the ``length`` rows before it as one flat vector; zeros before the first."""
    full = np.vstack([np.zeros((length, x.shape[1])), x])
    cut = np.lib.stride_tricks.sliding_window_view(full, length, axis=0)[: len(x)]
    return cut.transpose(0, 2, 1).reshape(len(x), -1)


def synthetic_rows(x: np.ndarray, y: np.ndarray, seed: int, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(rows, labels) that bring the smaller class to parity; none if there is one class.

    Bases take turns; a new row lies between its base and one of the ``k`` nearest
    rows of the class (a copy, if the base is alone).
    """
    counts = np.bincount(y, minlength=2)
    missing = int(abs(counts[0] - counts[1]))
    if not counts.min() or not missing:
        return x[:0], y[:0]
    small = int(counts.argmin())
    rows, rng = x[y == small], np.random.default_rng(seed)
    squares = (rows**2).sum(axis=1)
    distance = squares[:, None] + squares - 2 * rows @ rows.T
    np.fill_diagonal(distance, np.inf)
    near = np.argsort(distance, axis=1, kind="stable")[:, : min(k, len(rows) - 1)]
    base = np.arange(missing) % len(rows)
    pick = near[base, rng.integers(0, near.shape[1], missing)] if near.size else base
    share = rng.random((missing, 1))
    return rows[base] + share * (rows[pick] - rows[base]), np.full(missing, small)


def _class_weights(y: np.ndarray, balance: str) -> np.ndarray:
    """Shares that add up to 1; with weights, both classes have half of them."""
    counts = np.maximum(np.bincount(y, minlength=2), 1)
    weight = 1.0 / counts[y] if balance == WEIGHTS else np.ones(len(y))
    return weight / weight.sum()


def _chance(odds: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(odds, -CERTAIN, CERTAIN)))


def newton_in_dual(
    gram: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float, steps: int
) -> tuple[np.ndarray, float]:
    """(factors, intercept) of the least penalised loss; log odds are gram @ factors + intercept."""
    share = float(weight @ y)
    if share <= 0 or share >= weight.sum():
        return np.zeros(len(y)), CERTAIN if share > 0 else -CERTAIN
    penalty = max(penalty, LEAST_PENALTY)
    factors, intercept = np.zeros(len(y)), float(np.log(share / (weight.sum() - share)))
    along = np.zeros(len(y))  # gram @ factors

    def loss(along: np.ndarray, factors: np.ndarray, intercept: float) -> float:
        odds = along + intercept
        return float(weight @ (np.logaddexp(0.0, odds) - y * odds) + penalty / 2 * (factors @ along))

    value = loss(along, factors, intercept)
    for _ in range(steps):
        odds = along + intercept
        p = _chance(odds)
        root = np.sqrt(np.maximum(weight * p * (1 - p), 1e-10 * weight))
        inner = root[:, None] * gram * root
        inner.flat[:: len(y) + 1] += penalty
        goal = root * odds - weight * (p - y) / root
        u, v = np.linalg.solve(inner, np.stack([goal, root], axis=1)).T
        next_intercept = float(root @ u / (root @ v))
        next_factors = root * (u - next_intercept * v)
        move, climb, size = gram @ next_factors - along, next_intercept - intercept, 1.0
        while size > 1e-6:
            tried = (along + size * move, factors + size * (next_factors - factors),
                     intercept + size * climb)
            reached = loss(*tried)
            if reached <= value:
                break
            size /= 2
        else:
            break
        (along, factors, intercept), gain, value = tried, value - reached, reached
        if gain <= 1e-10 * max(value, 1e-10):
            break
    return factors, intercept


class FoldFits:
    """The fits of one fold; windows of one length are prepared once."""

    def __init__(self, x: np.ndarray, y: np.ndarray, train: np.ndarray, balance: str, seed: int):
        # rows without a label are part of later windows, but are not fitted or scored
        self.x, self.y, self.known, self.train = np.nan_to_num(
            x, posinf=0.0, neginf=0.0), np.nan_to_num(y).astype(int), ~np.isnan(y), train
        self.balance, self.seed = balance, seed
        self.prepared: dict[int, tuple | None] = {}
        self.scored: dict[tuple, list] = {}

    def _prepare(self, length: int) -> tuple | None:
        views, at = fold_views(self.x, length), np.arange(len(self.x))
        # training windows are complete
        train = at[self.train & self.known & (at >= length)]
        fit = train[: len(train) - S.held_out(len(train))]
        if not len(fit):
            return None
        parts = [("train", fit), ("validation", train[len(fit):]),
                 ("test", at[~self.train & self.known])]
        inputs, y = views[fit], self.y[fit]
        if self.balance == BEFORE_WINDOW:
            # held-out rows take no part, so no synthetic row knows them
            rows, labels = self.x[: fit[-1] + 1], self.y[: fit[-1] + 1]
            known = self.known[: fit[-1] + 1]
            more, more_labels = synthetic_rows(rows[known], labels[known], self.seed)
            late = fold_views(np.vstack([rows, more]), length)[len(rows):]
            inputs, y = np.vstack([inputs, late]), np.append(y, more_labels)
        weight = _class_weights(y, self.balance)
        mean = weight @ inputs
        spread = weight @ (inputs - mean) ** 2 / max(1.0 - float(weight @ weight), 1e-12)
        scale = np.where(spread > 0, 1.0 / np.sqrt(np.where(spread > 0, spread, 1.0)), 0.0)
        z = (inputs - mean) * scale
        return parts, views, z, z @ z.T, y, weight, mean, scale

    def score(self, length: int, penalty: float, steps: int) -> list[tuple[str, np.ndarray, np.ndarray]]:
        """(part, labels, chances) of the training, validation and test rows."""
        key = (length, penalty, steps)
        if key in self.scored:
            return self.scored[key]
        if length not in self.prepared:
            self.prepared = {length: self._prepare(length)}
        made = self.prepared[length]
        result = []
        if made is not None:
            parts, views, z, gram, y, weight, mean, scale = made
            factors, intercept = newton_in_dual(gram, y, weight, penalty, steps)
            beta = scale * (z.T @ factors)
            chances = _chance(views @ beta + (intercept - mean @ beta))
            result = [(name, self.y[rows], chances[rows]) for name, rows in parts if len(rows)]
        self.scored[key] = result
        return result


def _seed(proj: str, exp: int, seed: int) -> int:
    return zlib.crc32(f"{seed}:{exp}:{proj}".encode())


_SCORED = "proj string, exp int, iter int, candidate int, part string, y int, p double"


def score_folds(rows: DataFrame, candidates: DataFrame, balance: str = WEIGHTS, seed: int = 42) -> DataFrame:
    """Scored rows (proj, exp, iter, candidate, part, y, p) of all candidates.

    ``rows`` are (proj, exp, position, split, y, vector); ``candidates`` have (proj, exp,
    iter, candidate, time_step, reg_param, max_iter). One task fits a fold's candidates,
    equal ones once. ``balance`` is 'weights', 'before_window' (synthetic rows of the
    smaller class follow the fitted rows before windows are cut) or 'none'.
    """
    if balance not in BALANCES:
        raise ValueError(f"unknown balance {balance!r}")

    def score(fold: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        found = [pd.DataFrame({"proj": [], "exp": [], "iter": [], "candidate": [], "part": [],
                               "y": [], "p": []})]
        if len(fold) and len(wanted):
            fold = fold.sort_values("position")
            proj, exp = fold["proj"].iloc[0], int(fold["exp"].iloc[0])
            fits = FoldFits(np.stack(fold["vector"]), fold["y"].to_numpy(float),
                            (fold["split"] == S.TRAIN).to_numpy(), balance, _seed(proj, exp, seed))
            for c in wanted.sort_values(["time_step", "reg_param", "max_iter"]).itertuples():
                for part, y, p in fits.score(int(c.time_step), float(c.reg_param), int(c.max_iter)):
                    found.append(pd.DataFrame({
                        "proj": proj, "exp": exp, "iter": int(c.iter), "candidate": int(c.candidate),
                        "part": part, "y": y, "p": p}))
        return pd.concat(found[1:] or found)

    keys = ["proj", "exp"]
    return rows.groupBy(*keys).cogroup(candidates.groupBy(*keys)).applyInPandas(score, _SCORED)


def rebalanced_folds(rows: DataFrame, seed: int = 42) -> DataFrame:
    """(proj, exp, synthetic, y, vector): the labelled training rows of each fold, and
    synthetic ones to parity."""

    def balanced(fold: pd.DataFrame) -> pd.DataFrame:
        fold = fold.sort_values("position")
        proj, exp = fold["proj"].iloc[0], int(fold["exp"].iloc[0])
        x, y = np.stack(fold["vector"]), fold["y"].to_numpy(int)
        more, labels = synthetic_rows(
            np.nan_to_num(x, posinf=0.0, neginf=0.0), y, _seed(proj, exp, seed))
        return pd.DataFrame({
            "proj": proj, "exp": exp, "synthetic": [False] * len(x) + [True] * len(more),
            "y": np.append(y, labels), "vector": [*x, *more]})

    train = rows.filter((F.col("split") == S.TRAIN) & F.col("y").isNotNull())
    return train.groupBy("proj", "exp").applyInPandas(
        balanced, "proj string, exp int, synthetic boolean, y int, vector array<double>")
