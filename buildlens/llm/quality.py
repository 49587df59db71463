"""Quality scores from compression with zstandard dictionaries.

One dictionary is built from good and one from bad labelled texts. A text of the
kind that a dictionary was built from compresses better with it, so the
difference of the two compressed sizes, divided by the text's size, tells the
kinds apart. A logistic curve, fitted on other labelled texts, turns it into a
probability; the text's own compressibility (the size with the good dictionary,
divided likewise) is its second input, as a difference means less in a text
that hardly needs a dictionary.

Labels are learned from a bounded sample: ``dictionary_rows`` of each class and
``curve_rows`` of both, the first in the order of a hash, of texts up to
``longest`` bytes. Scoring is row-wise over every whole text.

Defined cases: null text is empty text; empty texts get the share of label 1
among the sample. Labels without id or value, and ids with contradicting
labels, are not learned from. With one class only, every score is its label;
without labels it is 0.5.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rows import map_rows

DICTIONARY_BYTES = 112_640
LEVEL = 3


def is_held_out(key: Column, folds: int = 5) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % folds == 0, F.lit(False))


def build_dictionary(texts: list[bytes]) -> bytes:
    """A trained dictionary; too few texts to train on become one as they are."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, texts).as_bytes()
    except zstandard.ZstdError:
        return b"\n".join(texts)[:DICTIONARY_BYTES]


def compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    data = zstandard.ZstdCompressionDict(dictionary)
    data.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(dict_data=data, level=LEVEL, write_checksum=False,
                                    write_content_size=False, write_dict_id=False)


def inputs(text: bytes, good, bad) -> tuple[float, float]:
    """The normalised difference and the normalised size of a text that isn't empty."""
    with_good, with_bad = len(good.compress(text)), len(bad.compress(text))
    return (with_bad - with_good) / len(text), with_good / len(text)


def fit_curve(values: np.ndarray, labels: np.ndarray, ridge: float = 1e-3, rounds: int = 30):
    """Weights of a logistic curve by Newton's method, the intercept first."""
    mean, spread = values.mean(axis=0), values.std(axis=0) + 1e-9
    data = np.column_stack([np.ones(len(values)), (values - mean) / spread])
    weights = np.zeros(data.shape[1])
    keep = ridge * np.eye(len(weights))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(data @ weights, -30, 30)))
        slope = data.T @ (p - labels) + keep @ weights
        weights -= np.linalg.solve((data * (p * (1 - p))[:, None]).T @ data + keep, slope)
    scaled = weights[1:] / spread
    return np.concatenate(([weights[0] - scaled @ mean], scaled))


@dataclass(frozen=True)
class Model:
    """What scoring needs; two dictionaries of bounded size and a few numbers."""

    good: bytes
    bad: bytes
    weights: tuple[float, ...] | None
    base: float

    def scorer(self):
        if self.weights is None:
            return lambda text: self.base
        good, bad = compressor(self.good), compressor(self.bad)
        start, *slopes = self.weights

        def score(text: str | None) -> float:
            if not text:
                return self.base
            at = start + sum(w * x for w, x in zip(slopes, inputs(text.encode("utf-8"), good, bad),
                                                   strict=True))
            return float(1 / (1 + np.exp(-np.clip(at, -30, 30))))

        return score


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "quality", dictionary_rows: int = 1_000, curve_rows: int = 4_000,
        longest: int = 1_000_000) -> Model:
    """Learn from labelled rows that are not held out, a bounded sample of them."""
    known = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)
                          & ~is_held_out(F.col(id_col)))
    known = known.groupBy(F.col(id_col).alias("_id")).agg(
        F.min(label_col).alias("label"), F.max(label_col).alias("_max"))
    known = known.filter(F.col("label") == F.col("_max")).drop("_max")
    known = known.withColumn("_order", F.xxhash64("_id"))

    def first(rows: DataFrame, count: int, use: str) -> DataFrame:
        return rows.orderBy("_order", "_id").limit(count).select("_id", "label", F.lit(use).alias("use"))

    # two rows of three may build dictionaries, the others fit the curve
    to_build, to_fit = F.pmod("_order", F.lit(3)) > 0, F.pmod("_order", F.lit(3)) == 0
    chosen = first(known.filter(to_build & (F.col("label") == 1)), dictionary_rows, "good").union(
        first(known.filter(to_build & (F.col("label") == 0)), dictionary_rows, "bad")).union(
        first(known.filter(to_fit), curve_rows, "curve"))
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).filter(
        (F.octet_length("text") > 0) & (F.octet_length("text") <= longest))
    rows = texts.join(F.broadcast(chosen), "_id").select("use", "label", "_id", "text").collect()
    rows.sort(key=lambda r: (r["_id"], r["text"]))
    by_use = {use: [(r["text"].encode("utf-8"), r["label"]) for r in rows if r["use"] == use]
              for use in ("good", "bad", "curve")}
    seen = [r["label"] for r in rows if r["use"] == "curve"] or [r["label"] for r in rows]
    base = float(np.mean(seen)) if seen else 0.5
    good, bad = ([t for t, _ in by_use[u]] for u in ("good", "bad"))
    if not good or not bad or len({label for _, label in by_use["curve"]}) < 2:
        return Model(b"", b"", None, base)
    good, bad = build_dictionary(good), build_dictionary(bad)
    tools = compressor(good), compressor(bad)
    values = np.array([inputs(text, *tools) for text, _ in by_use["curve"]])
    weights = fit_curve(values, np.array([label for _, label in by_use["curve"]], dtype=float))
    return Model(good, bad, tuple(map(float, weights)), base)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text",
          threshold: float = 0.3) -> DataFrame:
    """(id, held_out, score, predicted) of every row; only the text is an input of the score."""

    def work():
        scorer = model.scorer()
        return lambda rows: [(scorer(text),) for (text,) in rows]

    scored = map_rows(docs, [text_col], "score double", work, keep=[id_col])
    return scored.select(id_col, is_held_out(F.col(id_col)).alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"))
