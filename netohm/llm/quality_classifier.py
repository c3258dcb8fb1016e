"""Document quality by regularised quadratic discriminant analysis.

Statistics of a text are built-in column expressions, transformed to roughly normal scales. Class means and covariances
come from sums over all training rows that Spark aggregates; covariances shrink toward the pooled one and toward its
diagonal. The Cholesky factors of both classes are computed once, and the score is the logistic of the
Mahalanobis log-density difference, as a column expression again.

Defined cases: null and empty texts have zero counts and get a score like any other; training rows without a
label are left out; with one class only, or no labels, the score is that class's share (0.5 without labels);
repeated rows are scored each; extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netohm.llm.work import written

SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
POOLED, DIAGONAL, RIDGE = 0.3, 0.1, 1e-3
FEATURES = ("x_len", "x_word", "x_symbol", "x_upper", "x_shout", "x_lines", "x_vocab")


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the transformed statistics of every text."""
    text = F.coalesce("text", F.lit(""))
    words = F.filter(F.split(text, SPACES), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x, F.lit(" \t\r\x0b\x0c")) != "")
    raw = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.length(text).alias("chars"),
        F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).alias("solid"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).alias("symbols"),
        (F.length(text) - F.length(F.translate(text, "!", ""))).alias("shouts"),
        (F.length(text) - F.length(F.regexp_replace(text, r"\p{Lu}", ""))).alias("uppers"),
        F.size(words).alias("words"),
        F.size(F.array_distinct(words)).alias("vocab"),
        F.size(lines).alias("lines"),
        F.size(F.array_distinct(lines)).alias("own_lines"),
    )
    c = F.col
    return raw.select(
        "doc_id",
        F.log1p("words").alias("x_len"),
        ((c("solid") + 100) / (c("words") + 20)).alias("x_word"),
        F.sqrt(c("symbols") / (c("words") + 5)).alias("x_symbol"),
        F.sqrt(c("uppers") / (c("chars") + 20)).alias("x_upper"),
        F.sqrt(c("shouts") / (c("words") + 5)).alias("x_shout"),
        F.sqrt((c("lines") - c("own_lines")) / (c("lines") + 3)).alias("x_lines"),
        F.log((c("vocab") + 10) / (c("words") + 10)).alias("x_vocab"),
    )


def moments(rows: DataFrame, label: str, features: tuple[str, ...]) -> dict[int, tuple[int, np.ndarray, np.ndarray]]:
    """Count, mean and covariance of each class, from sums that partial aggregation makes."""
    p = len(features)
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    got = rows.groupBy(label).agg(F.count("*").alias("n"), *[F.sum(f).alias(f"s{i}") for i, f in enumerate(features)], *[F.sum(F.col(features[i]) * F.col(features[j])).alias(f"q{i}_{j}") for i, j in pairs])
    out = {}
    for r in got.collect():  # one row for each class
        mean = np.array([r[f"s{i}"] for i in range(p)]) / r["n"]
        second = np.zeros((p, p))
        for i, j in pairs:
            second[i, j] = second[j, i] = r[f"q{i}_{j}"] / r["n"]
        out[r[label]] = (r["n"], mean, second - np.outer(mean, mean))
    return out


class Discriminant:
    """Means, shrunk covariances and their Cholesky factors."""

    def __init__(self, classes: dict[int, tuple[int, np.ndarray, np.ndarray]], pooled: float = POOLED, diagonal: float = DIAGONAL):
        self.n = {k: classes[k][0] if k in classes else 0 for k in (0, 1)}
        self.whole = all(self.n.values())
        if not self.whole:
            return
        total = sum(self.n.values())
        common = sum(classes[k][0] * classes[k][2] for k in (0, 1)) / total
        self.mean, self.factor, self.logdet = {}, {}, {}
        for k in (0, 1):
            s = (1 - pooled) * classes[k][2] + pooled * common
            s = (1 - diagonal) * s + diagonal * np.diag(np.diag(common)) + RIDGE * np.eye(len(s))
            low = np.linalg.cholesky(s)
            self.mean[k], self.factor[k] = classes[k][1], np.linalg.inv(low)
            self.logdet[k] = 2 * float(np.log(np.diag(low)).sum())

    def distance(self, k: int, features: tuple[str, ...]) -> Column:
        """Squared Mahalanobis distance as a column."""
        total = F.lit(0.0)
        for row in range(len(features)):
            z = F.lit(0.0)
            for i in range(row + 1):
                z = z + F.lit(float(self.factor[k][row, i])) * (F.col(features[i]) - F.lit(float(self.mean[k][i])))
            total = total + z * z
        return total

    def score(self, features: tuple[str, ...]) -> Column:
        if not self.whole:
            n = sum(self.n.values())
            return F.lit(self.n[1] / n if n else 0.5)
        prior = math.log(self.n[1] / self.n[0]) - 0.5 * (self.logdet[1] - self.logdet[0])
        logit = F.lit(prior) - (self.distance(1, features) - self.distance(0, features)) / 2
        return 1 / (1 + F.exp(-F.greatest(F.least(logit, F.lit(30.0)), F.lit(-30.0))))


def train(stats: DataFrame, labels: DataFrame, label: str = "quality") -> Discriminant:
    """Fit on every row of labels; one row for each doc_id."""
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where("y in (0, 1)")
    return Discriminant(moments(stats.join(marked, "doc_id"), "y", FEATURES))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, score and predicted (1 if score >= threshold) of every document, learnt from labels."""
    stats = written(statistics(docs), "statistics")
    model = train(stats, labels)
    return stats.select("doc_id", model.score(FEATURES).alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
