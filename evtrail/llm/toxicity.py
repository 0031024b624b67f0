"""Toxicity by weak supervision.

1. Lexicon: words and word beginnings that stand far more often in rows labelled toxic than in the
   others, counted in Spark over the labelled training rows (a bounded sample of them, see
   `max_labelled`); the strongest `lexicon_size` become voters, along with patterns for shouting,
   direct address and strong punctuation.
2. Label model: voters vote or abstain on every labelled training row.  Their rates of voting in either class
   and the share of toxic rows are estimated by expectation maximisation, which starts from the
   labels; voters that agree beyond what the two classes explain are taken for one source and
   share their weight, so a correlated lexicon does not count twice.
3. A linear classifier on the voters and text measures is trained on the posterior labels, and its
   score is what the operator returns.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucket_of, claim, written

PREFIXES = (4, 5, 6)
_LETTERS = re.compile(r"[^\W\d_]+")
_PATTERNS = (re.compile(r"[!?]{2,}"), re.compile(r"\b(?:[A-Z]{3,}\W+){3,}"), re.compile(r"\b(?:you|your|du|tu|vous|usted)\b", re.I))
_COUNTS = (1, 2, 3, 5)


def features_of(text: str | None) -> dict[str, list[str]]:
    """Each lower-case word with its features: itself and its beginnings, marked with a star."""
    return {w: [w, *(w[:k] + "*" for k in PREFIXES if len(w) > k)] for w in set(_LETTERS.findall(text.lower()))} if text else {}


@dataclass(frozen=True)
class Model:
    lexicon: tuple[str, ...]
    weights: tuple[float, ...]
    bias: float

    def measures(self, texts: list[str | None]) -> np.ndarray:
        """A row a text: votes of the lexicon, of the patterns, of so many words in the lexicon; then
        how many such words there are, and how densely."""
        at = {w: i for i, w in enumerate(self.lexicon)}
        m, p = len(at), len(_PATTERNS)
        x = np.zeros((len(texts), m + p + len(_COUNTS) + 2))
        for i, text in enumerate(texts):
            if text:
                words, hits = features_of(text), 0
                for features in words.values():
                    if found := [at[f] for f in features if f in at]:
                        hits += 1
                        x[i, found] = 1
                x[i, m : m + p] = [bool(q.search(text)) for q in _PATTERNS]
                x[i, m + p : m + p + len(_COUNTS)] = [hits >= k for k in _COUNTS]
                x[i, -2] = np.log1p(hits)
                x[i, -1] = min(1.0, 20 * hits / max(1, len(words)))
        return x

    def score(self, texts: list[str | None]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.measures(texts) @ np.array(self.weights) + self.bias, -30, 30)))


def label_model(votes: np.ndarray, start: np.ndarray, rounds: int = 20, correlated: float = 0.5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posterior of each row, each voter's rate of voting in clean and toxic rows, and its share.

    EM over a two-class mixture from the posterior `start`.  After it, the correlations of the votes
    that the classes leave are measured; a voter among k correlated ones then counts 1/k, and EM
    runs again."""
    n, m = votes.shape
    share = np.ones(m)
    for again in range(2):
        post = np.clip(start, 0.02, 0.98)
        for _ in range(rounds):
            pi = np.clip(post.mean(), 1e-3, 0.5)
            on = np.array([((1 - post) @ votes + 0.05) / ((1 - post).sum() + 1), (post @ votes + 0.05) / (post.sum() + 0.1)])
            ratio = (np.log(on[1] / on[0]) * votes + np.log((1 - on[1]) / (1 - on[0])) * (1 - votes)) @ share
            new = 1 / (1 + np.exp(-np.clip(ratio + np.log(pi / (1 - pi)), -30, 30)))
            done, post = np.abs(new - post).max() < 1e-4, new
            if done:
                break
        if not again and n > 1:
            left = votes - np.outer(1 - post, on[0]) - np.outer(post, on[1])
            cov = left.T @ left / n
            scale = np.sqrt(np.maximum(np.diag(cov), 1e-12))
            share = 1 / (np.abs(cov / np.outer(scale, scale)) > correlated).sum(1).clip(1)
    return post, on, share


def linear(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 30) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by Newton steps."""
    a = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(a.shape[1])
    keep = np.full(a.shape[1], ridge * len(a))
    keep[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + np.diag(keep + 1e-9), a.T @ (y - p) - keep * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def train(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    max_labelled: int = 20_000,
    lexicon_size: int = 200,
    min_rows: int = 3,
) -> Model:
    """Learns from labelled rows whose crc32(id) modulo 4 is not 2, at most about `max_labelled` of them
    by a hash of the id and of the row (that bounds what is broadcast and what comes to the driver).
    Repeated rows count once, of an id with two labels the larger; rows without id or label are not
    learned from.  Without labels of both kinds the model scores everything near 0."""
    labelled = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y is not null").where(bucket_of("id", 4) != 2)
    labelled = labelled.groupBy("id").agg(F.max("y").alias("y"))
    n = labelled.count()
    if n > max_labelled:  # about so many, by a hash that no order of rows changes
        labelled = labelled.where(F.pmod(F.xxhash64("id"), F.lit(1 << 40)) < int((1 << 40) * max_labelled / n))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(labelled), "id").dropDuplicates(["id", "text"])
    rows = written(rows, "toxicity-rows")
    n = rows.count()
    if n > 2 * max_labelled:  # ids that stand there again and again with other texts
        rows = rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(1 << 40)) < int((1 << 40) * max_labelled / n))
    rows = rows.select("text", F.col("y").cast("long"))

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("toxicity")
        for batch in batches:  # summed per batch, so that little is shuffled
            total: dict[str, list[int]] = {}
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for f in {f for fs in features_of(text).values() for f in fs}:
                    t = total.setdefault(f, [0, 0])
                    t[0] += 1
                    t[1] += y
            yield pa.RecordBatch.from_arrays([pa.array(list(total)), pa.array([t[0] for t in total.values()], pa.int64()), pa.array([t[1] for t in total.values()], pa.int64())], names=["f", "n", "t"])

    of = rows.agg(F.count("*").alias("n"), F.sum("y").alias("t")).first()
    n, toxic = of["n"], of["t"] or 0
    if not toxic or toxic == n:
        return Model((), (0.0,) * (len(_PATTERNS) + len(_COUNTS) + 2), -5.0)
    counts = rows.mapInArrow(explode, "f string, n long, t long").groupBy("f").agg(F.sum("n").alias("n"), F.sum("t").alias("t"))
    clean_rate = (F.col("n") - F.col("t") + 0.5) / (n - toxic + 1)
    lift = F.log((F.col("t") + 0.5) / (toxic + 1) / clean_rate)
    strong = counts.where(F.col("t") >= max(min_rows, toxic // 500)).where(lift > 2.5).select("f", (lift * F.sqrt(F.col("t"))).alias("s"), "t")
    lexicon = tuple(r["f"] for r in strong.orderBy(F.desc("s"), "f").limit(lexicon_size).collect())
    blank = Model(lexicon, (), 0.0)
    voters = len(lexicon) + len(_PATTERNS) + len(_COUNTS)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = blank.measures(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array([r.astype("<f4").tobytes() for r in x], pa.binary()), batch.column(1)], names=["x", "y"])

    # rows come in any order, and the sums below should not depend on it
    got = sorted((r["x"], r["y"]) for r in rows.mapInArrow(measure, "x binary, y long").collect())
    x = np.array([np.frombuffer(r, "<f4") for r, _ in got], float)
    post, _, _ = label_model(x[:, :voters], np.array([y for _, y in got], float))
    w, b = linear(x, post)
    return Model(lexicon, tuple(w.tolist()), b)


def scorer(model: Model):
    """The score as a function of a text column."""

    @F.arrow_udf("double")
    def of(texts: pa.Array) -> pa.Array:
        claim("toxicity")
        return pa.array(np.concatenate([model.score(texts[i : i + 500].to_pylist()) for i in range(0, len(texts), 500)] or [np.zeros(0)]))

    return of


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document row: id and score.  Null and empty texts have no votes and get the score
    of a text without any; repeated rows give repeated results, an empty table none; very long texts are
    read whole; columns but the two named are not looked at.  Narrow: no shuffle."""
    return docs.select(id_col, scorer(model)(F.col(text_col).cast("string")).alias("score"))
