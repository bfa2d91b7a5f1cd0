"""Quality scores by regularised quadratic discriminant analysis of document statistics.

Every text is reduced to some twenty statistics, by numpy over whole batches of bytes.  Each class has a mean and a covariance,
shrunk towards its diagonal and towards that of both classes; with the inverses of their Cholesky factors a score is the difference of two
log densities, scaled to a probability on the training rows.
"""

from __future__ import annotations

import dataclasses

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from antecede.llm.labelled import held_out, training_labels
from antecede.llm.near_dup import chunks, words_of
from antecede.session import materialize

TRAINING_ROWS = 20_000  # of each class
SHRINK = 0.1
KINDS = {  # bytes by kind
    "letter": [*range(65, 91), *range(97, 123), *range(128, 256)],
    "upper": [*range(65, 91)],
    "digit": [*range(48, 58)],
    "space": [9, 10, 11, 12, 13, 32],
    "line": [10],
    "stop": [46],
    "bang": [33],
    "comma": [44],
    "symbol": [*b"#$%&*+<=>@[\\]^_`{|}~/"],
}
STATISTICS = 20


def _per_doc(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(values, dtype=np.int64)])[ends])


def _distinct(keys: np.ndarray, docs: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of each document, and how often its most frequent one occurs."""
    order = np.lexsort((keys, docs))
    k, d = keys[order], docs[order]
    first = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (d[1:] != d[:-1])])) if len(k) else np.zeros(0, np.int64)
    most = np.zeros(n, dtype=np.int64)
    np.maximum.at(most, d[first], np.diff(np.append(first, len(k))))
    return np.bincount(d[first], minlength=n), most


def statistics(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Transformed statistics of each document in ``data`` (UTF-8, not lowered), all 0 for an empty one."""
    n = len(ends) - 1
    size = np.diff(ends)
    count = {}
    for kind, values in KINDS.items():
        table = np.zeros(256, dtype=bool)
        table[values] = True
        count[kind] = _per_doc(table[data], ends)
    lower = data.copy()
    lower[(data >= 65) & (data <= 90)] += 32
    words, bounds = words_of(lower, ends)
    of = np.diff(bounds)
    docs = np.repeat(np.arange(n), of)
    kinds, most = _distinct(words, docs, n)
    same = np.zeros(len(words), dtype=np.int64)
    same[1:] = (words[1:] == words[:-1]) & (docs[1:] == docs[:-1])
    triples = (words[:-2] * np.uint64(3) + words[1:-1]) * np.uint64(5) + words[2:] if len(words) > 2 else words[:0]
    whole = docs[: len(triples)] == docs[2 : 2 + len(triples)]
    phrases, most_phrase = _distinct(triples[whole], docs[: len(triples)][whole], n)
    share = lambda a, b: np.sqrt(a / np.maximum(b, 1))
    return np.stack([
        np.log1p(size), np.log1p(of), share(count["letter"], size), share(count["upper"], count["letter"]),
        share(count["digit"], size), share(count["space"], size), np.log1p(count["line"]), share(count["stop"], of),
        share(count["bang"], of), share(count["comma"], of), share(count["symbol"], of), share(count["symbol"], size),
        np.log1p(count["letter"] / np.maximum(of, 1)), share(kinds, of), share(most, of), share(_per_doc(same, bounds), of),
        share(phrases, of), share(most_phrase, of), np.log1p(of / np.maximum(count["stop"], 1)),
        np.log1p(of / np.maximum(count["line"] + 1, 1)),
    ], axis=1)


def _reduce(batches):
    for batch in batches:
        for at, to, data, ends in chunks(batch.column(1)):
            found = statistics(data, ends)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(at, to - at), pa.array([*found], pa.list_(pa.float64()))], ["doc_id", "statistics"]
            )


@dataclasses.dataclass
class Discriminant:
    """Two classes: means, inverses of the Cholesky factors of their covariances, half log determinants; and the scale."""

    center: np.ndarray
    spread: np.ndarray
    means: list[np.ndarray]
    inverse: list[np.ndarray]
    half_log: list[float]
    scale: tuple[float, float] = (1.0, 0.0)

    def difference(self, x: np.ndarray) -> np.ndarray:
        """Log density of class 1 less that of class 0."""
        z = (x - self.center) / self.spread
        d = [-0.5 * (((z - m) @ inv.T) ** 2).sum(axis=1) - h for m, inv, h in zip(self.means, self.inverse, self.half_log, strict=True)]
        return d[1] - d[0]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        a, b = self.scale
        return 1 / (1 + np.exp(-np.clip(a * squeezed(self.difference(x)) + b, -40, 40)))


def squeezed(d: np.ndarray) -> np.ndarray:
    """Densities far out differ by thousands; their order stays."""
    return np.arcsinh(d)


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3, rounds: int = 50) -> np.ndarray:
    """Weights (the last for the constant) of a logistic regression, by Newton steps."""
    a = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(a.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -40, 40)))
        g = a.T @ (weight * (p - y)) + ridge * w
        h = (a * (weight * p * (1 - p))[:, None]).T @ a + (ridge + 1e-9) * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w = w - step * min(1.0, 5 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(x: np.ndarray, y: np.ndarray, share: float, shrink: float = SHRINK) -> Discriminant:
    """``share``: of class 1 among all labels; the rows given may be dealt otherwise."""
    both = len(np.unique(y)) == 2
    center, spread = (x.mean(0), np.maximum(x.std(0), 1e-6)) if len(x) else (np.zeros(STATISTICS), np.ones(STATISTICS))
    z = (x - center) / spread
    eye = np.eye(STATISTICS)
    pooled = np.cov(z.T) if len(z) > 1 else eye
    model = Discriminant(center, spread, [], [], [])
    for c in (0, 1):
        own = z[y == c] if both else z
        cov = np.cov(own.T) if len(own) > 1 else pooled
        diagonal = np.diag(np.diag(cov))
        kept = (1 - shrink) * ((1 - shrink) * cov + shrink * diagonal) + shrink * np.diag(np.diag(pooled)) + 1e-4 * eye
        factor = np.linalg.cholesky(kept)
        model.means.append(own.mean(0) if len(own) else np.zeros(STATISTICS))
        model.inverse.append(np.linalg.inv(factor))
        model.half_log.append(float(np.log(np.diag(factor)).sum()))
    if not both:  # one label or none: the share of ones is all that is known
        p = min(max(share, 1e-3), 1 - 1e-3)
        model.scale = (0.0, float(np.log(p / (1 - p))))
        return model
    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    a, b = logistic(squeezed(model.difference(x))[:, None], y, weight)
    model.scale = (float(max(a, 1e-6)), float(b))
    return model


def _score(model: Discriminant):
    def run(batches):
        for batch in batches:
            x = np.array(batch.column(1).to_pylist(), dtype=np.float64).reshape(batch.num_rows, STATISTICS)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model(x))], ["doc_id", "score"])

    return run


def scores(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = TRAINING_ROWS, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs`` (doc_id, text; others ignored).

    ``labels`` has doc_id and ``label`` (0 or 1); held-out rows and nulls are not learned from, and at most ``most`` rows of
    each class are.  A null text is empty and has a score like any other.  With labels of one class, or none, every score is
    the share of ones (0.5 without labels).  Repeated rows are scored each, and of rows that share an id one is learned from; an
    empty table gives an empty result.  Long texts are read whole, in pieces.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    reduced = materialize(texts.mapInArrow(_reduce, "doc_id long, statistics array<double>"))
    training, share = training_labels(labels, label, most)
    # One row for each id, however often it is repeated: at most 2 * most rows reach the driver.
    drawn = reduced.join(F.broadcast(training), "doc_id").groupBy("doc_id").agg(F.min("statistics"), F.max("y"))
    rows = [r[1:] for r in sorted(drawn.collect())]
    x = np.array([r[0] for r in rows], dtype=np.float64).reshape(-1, STATISTICS)
    model = fit(x, np.array([r[1] for r in rows], dtype=np.float64), share)
    scored = reduced.mapInArrow(_score(model), "doc_id long, score double")
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )
