"""Nearest neighbours by learned partitions of a neighbour graph.

On a bounded sample the graph of nearest neighbours is cut into partitions of equal size with few edges between them.  A
small classifier learns, for a vector, how its neighbours spread over the partitions.  Every vector of the table goes to its
most probable partition; a query goes to its several most probable ones, and what it meets is ranked exactly.  How many is
set on the sample, so that the target recall is met there.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from antecede.llm.vectors import blocks, matrix, numbered, sample, unit, usual_dim
from antecede.session import materialize

SAMPLE = 8_192
TARGET = 0.95
PER_PART = 8_000  # vectors in a partition, roughly
MOST_PARTS = 256
GRAPH_DEGREE = 16
HIDDEN = 128
BASE_PIECE, ASKED_PIECE = 16_000, 2_000


def neighbours(x: np.ndarray, asked: np.ndarray, k: int) -> np.ndarray:
    """Places in ``x`` of the ``k`` largest inner products of each row of ``x[asked]``, without itself."""
    out = np.empty((len(asked), min(k, len(x) - 1)), dtype=np.int64)
    for at in range(0, len(asked), 512):
        some = asked[at : at + 512]
        s = x[some] @ x.T
        s[np.arange(len(some)), some] = -np.inf
        out[at : at + 512] = np.argpartition(-s, out.shape[1] - 1, axis=1)[:, : out.shape[1]]
    return out


def balanced_parts(x: np.ndarray, near: np.ndarray, parts: int, rounds: int = 8, slack: float = 1.05) -> np.ndarray:
    """A partition of the neighbour graph: halves along main directions first, then moves to where most neighbours are.

    No partition grows beyond ``slack`` times its share, and none shrinks below 2 - ``slack`` times it.
    """
    part = np.zeros(len(x), dtype=np.int64)

    def halve(members: np.ndarray, first: int, n: int) -> None:
        if n == 1 or len(members) < 2:
            part[members] = first
            return
        some = x[members] - x[members].mean(axis=0)
        direction = np.linalg.eigh(some.T @ some)[1][:, -1]
        order = members[np.argsort(some @ direction, kind="stable")]
        cut = round(len(order) * (n // 2) / n)
        halve(order[:cut], first, n // 2)
        halve(order[cut:], first + n // 2, n - n // 2)

    halve(np.arange(len(x)), 0, parts)
    size = np.bincount(part, minlength=parts)
    most, least = math.ceil(slack * len(x) / parts), math.floor((2 - slack) * len(x) / parts)
    back: list[list[int]] = [[] for _ in range(len(x))]
    for i, row in enumerate(near.tolist()):
        for j in row:
            back[j].append(i)
    edges = [row + back[i] for i, row in enumerate(near.tolist())]
    random = np.random.default_rng(3)
    for _ in range(rounds):
        moved = 0
        for i in random.permutation(len(x)):
            votes = np.bincount(part[edges[i]], minlength=parts)
            old = part[i]
            for new in np.argsort(-votes, kind="stable")[:3]:
                if votes[new] <= votes[old]:
                    break
                if size[new] < most and size[old] > least:
                    part[i], moved = new, moved + 1
                    size[new] += 1
                    size[old] -= 1
                    break
        if moved < len(x) / 200:
            break
    return part


class Router:
    """One hidden layer; trained to give the share of a vector's neighbours in each partition."""

    def __init__(self, x: np.ndarray, share: np.ndarray, hidden: int = HIDDEN, epochs: int = 40, rate: float = 0.003):
        random = np.random.default_rng(4)
        scale = lambda a, b: random.standard_normal((a, b)) * math.sqrt(2 / a)
        self.w = [scale(x.shape[1], hidden), np.zeros(hidden), scale(hidden, share.shape[1]) * 0.1, np.zeros(share.shape[1])]
        mean, square = [np.zeros_like(w) for w in self.w], [np.zeros_like(w) for w in self.w]
        step = 0
        for _ in range(epochs):
            order = random.permutation(len(x))
            for at in range(0, len(x), 256):
                some = order[at : at + 256]
                a = x[some]
                h = np.maximum(a @ self.w[0] + self.w[1], 0)
                p = self._soft(h @ self.w[2] + self.w[3])
                d = (p - share[some]) / len(some)
                dh = (d @ self.w[2].T) * (h > 0)
                step += 1
                for i, g in enumerate((a.T @ dh, dh.sum(0), h.T @ d, d.sum(0))):
                    mean[i] = 0.9 * mean[i] + 0.1 * g
                    square[i] = 0.999 * square[i] + 0.001 * g * g
                    self.w[i] = self.w[i] - rate * (mean[i] / (1 - 0.9**step)) / (np.sqrt(square[i] / (1 - 0.999**step)) + 1e-8)

    @staticmethod
    def _soft(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """Probability of each partition, for unit vectors."""
        return self._soft(np.maximum(x @ self.w[0] + self.w[1], 0) @ self.w[2] + self.w[3])


class Index:
    """The router, and how many partitions a query asks."""

    def __init__(self, drawn: np.ndarray, rows: int, k: int, target: float):
        parts = int(min(MOST_PARTS, max(2, 2 ** round(math.log2(max(rows, 1) / PER_PART + 1e-9)))))
        near = neighbours(drawn, np.arange(len(drawn)), GRAPH_DEGREE)
        part = balanced_parts(drawn, near, parts)
        share = np.zeros((len(drawn), parts))
        np.add.at(share, (np.repeat(np.arange(len(drawn)), near.shape[1]), part[near].ravel()), 1 / max(near.shape[1], 1))
        # A fifth of the sample asks; the router has not seen it.
        held = np.arange(len(drawn)) % 5 == 0
        directions = unit(drawn)
        self.router = Router(directions[~held], share[~held])
        self.ask = parts
        asked = np.flatnonzero(held)[:1000]
        own = self.router(directions).argmax(axis=1)
        wanted = own[neighbours(drawn, asked, k)]
        rank = np.argsort(np.argsort(-self.router(directions[asked]), axis=1), axis=1)
        needed = rank[np.arange(len(asked))[:, None], wanted]
        for m in range(1, parts + 1):
            if (needed < m).mean() >= target:
                self.ask = m
                break


def _assign(index: Index | None, dim: int, every: int):
    def run(batches):
        for batch in batches:
            vectors = matrix(batch.column(2))
            rows, ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            own, asked = [-1] * len(rows), [[-1]] * len(rows)
            usual = [k for k, v in enumerate(vectors) if len(v) == dim and index is not None]
            if usual:
                p = index.router(unit(np.stack([vectors[k] for k in usual])))
                order = np.argsort(-p, axis=1, kind="stable")[:, : index.ask].tolist()
                for k, best in zip(usual, order, strict=True):
                    own[k], asked[k] = best[0], best
            out = []
            for k, v in enumerate(vectors):
                blob = np.ascontiguousarray(v, dtype=np.float64).tobytes()
                out.append((rows[k], ids[k], blob, len(v), own[k], False))
                if ids[k] is not None and ids[k] % every == 0:
                    out.extend((rows[k], ids[k], blob, len(v), part, True) for part in asked[k])
            yield pa.RecordBatch.from_pylist([dict(zip(ROUTED.names, r, strict=True)) for r in out], schema=ROUTED)

    return run


ROUTED = pa.schema([
    ("row", pa.int64()), ("vec_id", pa.int64()), ("vector", pa.binary()), ("dim", pa.int32()), ("part", pa.int32()), ("ask", pa.bool_()),
])
NO_ID = np.iinfo(np.int64).max


def _rank(k: int):
    def run(part: pd.DataFrame) -> pd.DataFrame:
        base, asked = part[~part["asked"]], part[part["asked"]]
        y, rows = np.frombuffer(b"".join(base["vector"])).reshape(len(base), -1), base["row"].to_numpy()
        ids = base["vec_id"].fillna(NO_ID).to_numpy().astype(np.int64)
        out = []
        for at in range(0, len(asked), 250):
            some = asked.iloc[at : at + 250]
            scores = np.frombuffer(b"".join(some["vector"])).reshape(len(some), -1) @ y.T
            scores[some["row"].to_numpy()[:, None] == rows[None]] = -np.inf
            edge = np.partition(scores, -min(k, len(base)), axis=1)[:, -min(k, len(base))]
            for query, query_id, s, least in zip(some["row"], some["vec_id"], scores, edge, strict=True):
                good = np.flatnonzero((s >= least) & (s > -np.inf))
                good = good[np.lexsort((ids[good], -s[good]))[:k]]
                out.append(pd.DataFrame({"query": query, "query_id": query_id, "row": rows[good], "vec_id": ids[good], "score": s[good]}))
        return pd.concat(out) if out else pd.DataFrame(columns=["query", "query_id", "row", "vec_id", "score"])

    return run


def search(table: DataFrame, k: int = 20, every: int = 20, target: float = TARGET) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` largest inner products of every row whose vec_id is divisible by ``every``.

    ``table`` has vec_id and embedding; other columns are ignored.  Candidates are all rows but the query's own, ties go to the
    smaller vec_id (null last).  Vectors that are null, empty, zero or hold null or non-finite components take no part;
    those of an unusual dimension are compared with all of theirs.  Repeated rows are candidates each.  An empty table gives
    an empty result.  The router is fitted on at most ``SAMPLE`` vectors; every vector is indexed.  Tables of every size are
    routed, over two partitions at least, so the result is approximate unless all are asked; with at most 10 * ``k`` vectors
    of the usual dimension there is nothing to fit on, and a query meets all rows.
    """
    rows = numbered(table).where("usable").select("row", "vec_id", "embedding")
    dim, total = usual_dim(rows), rows.count()
    drawn = sample(rows, SAMPLE, dim)
    index = Index(drawn, total, k, target) if len(drawn) > 10 * k else None
    routed = materialize(rows.mapInArrow(
        _assign(index, dim, every), "row long, vec_id long, vector binary, dim int, part int, ask boolean"
    ))
    met = blocks(routed.where("NOT ask").drop("ask"), routed.where("ask").drop("ask"), ["dim", "part"], BASE_PIECE, ASKED_PIECE)
    found = met.groupBy("dim", "part", "x", "y").applyInPandas(_rank(k), "query long, query_id long, row long, vec_id long, score double")
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", "row")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(
        "query_id", "rank", F.when(F.col("vec_id") < NO_ID, F.col("vec_id")).alias("vec_id"), "score"
    )
