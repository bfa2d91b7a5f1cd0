"""Near-duplicate vectors by an inverted multi-index.

Unit vectors are cut into halves, and each half has a codebook of its own; a vector lies in the cell of its two nearest codewords.
A search walks the cells in order of how far the vector would have to move to enter them (multi-sequence traversal: the
next best of two sorted lists), until cells are too far for a vector at the threshold to lie there.  That distance is set on a
sample, so that the target share of vectors moved to exactly the threshold is still met.  What is met is verified.

Equal vectors are one node with a weight.  Cells are dealt to blocks of bounded size, and every two blocks meet in a task, which
asks the cells of each for the vectors of the other and gives counts and a spanning forest of its links, not its pairs.  A vector
is sent once for each block, however many cells it asks.
"""

from __future__ import annotations

import heapq
import math
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from antecede.llm.graph import components, merge, spread
from antecede.llm.vectors import numbered, sample, unit, usual_dim
from antecede.session import materialize

THRESHOLD = 0.95
SAMPLE = 8_192
TARGET = 0.999
PER_CELL = 64  # vectors in a cell, roughly
MOST_WORDS = 512
BLOCK_BYTES = 40_000_000  # of vectors in a block, roughly
BLOCK_ROWS, FEW_BLOCKS = 2_000, 4  # smaller tables have blocks of that many vectors, up to that many blocks
MOVES, ASKING, MEETING = 2_097_152, 16_384, 256  # held at once: moves of a half, vectors that ask, vectors of a cell
LISTED = 65_536  # links that are held as a list


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    random = np.random.default_rng(seed)
    words = x[random.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        near = distances(x, words).argmin(axis=1)
        n = np.bincount(near, minlength=k)
        sums = np.zeros_like(words)
        np.add.at(sums, near, x)
        words = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], words)
    return np.unique(words, axis=0)


def distances(x: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Squared distances."""
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ words.T + (words * words).sum(1)[None], 0)


def moves(x: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest codeword of each row, and the distance to the border of every other codeword's cell."""
    d = distances(x, words)
    best = d.argmin(axis=1)
    apart = np.sqrt(distances(words, words))[best]
    apart[np.arange(len(x)), best] = 1
    return best, np.maximum(d - d[np.arange(len(x)), best][:, None], 0) / (2 * np.maximum(apart, 1e-12))


def traverse(first: np.ndarray, second: np.ndarray, most: float):
    """Cells (i, j) in order of first[i]**2 + second[j]**2 up to ``most``**2: multi-sequence traversal."""
    one, two = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    a, b, limit = (first[one] ** 2).tolist(), (second[two] ** 2).tolist(), most * most
    heap, pushed = [(a[0] + b[0], 0, 0)], {(0, 0)}
    while heap:
        cost, i, j = heapq.heappop(heap)
        if cost > limit:
            return
        yield int(one[i]), int(two[j])
        for p, q in ((i + 1, j), (i, j + 1)):
            if p < len(a) and q < len(b) and (p, q) not in pushed:
                pushed.add((p, q))
                heapq.heappush(heap, (a[p] + b[q], p, q))


class Index:
    """Two codebooks and how far to walk."""

    def __init__(self, drawn: np.ndarray, rows: int, threshold: float, target: float, seed: int = 6):
        x = unit(drawn)
        self.half = x.shape[1] // 2
        k = int(min(MOST_WORDS, max(2, 2 ** math.ceil(math.log2(math.sqrt(max(rows, 1) / PER_CELL) + 1e-9)))))
        self.words = [kmeans(part, k) for part in self.halves(x)]
        # Partners at exactly the threshold, in a random direction.
        noise = np.random.default_rng(seed).standard_normal(x.shape)
        noise -= (noise * x).sum(1, keepdims=True) * x
        length = np.linalg.norm(noise, axis=1, keepdims=True)
        y = threshold * x + math.sqrt(1 - threshold**2) * noise / np.maximum(length, 1e-12)
        walk = np.zeros(len(x))
        for part, other, words in zip(self.halves(x), self.halves(y), self.words, strict=True):
            walk += moves(part, words)[1][np.arange(len(x)), distances(other, words).argmin(axis=1)] ** 2
        self.walk = float(np.sqrt(np.quantile(walk, target))) + 1e-9

    def halves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return x[:, : self.half], x[:, self.half :]

    def place(self, x: np.ndarray):
        """Own cell of each unit vector (two columns), and the moves into all others, by halves."""
        (i, a), (j, b) = (moves(part, words) for part, words in zip(self.halves(x), self.words, strict=True))
        return i, j, a, b

    def cell(self, x: np.ndarray) -> np.ndarray:
        """Number of each unit vector's own cell."""
        i, j = (distances(part, words).argmin(axis=1) for part, words in zip(self.halves(x), self.words, strict=True))
        return i * len(self.words[1]) + j

    def callers(self, a: np.ndarray, b: np.ndarray, p: int, qs: np.ndarray) -> list[np.ndarray]:
        """Who asks each cell (p, q), by the squared moves of many vectors (``a`` by vectors, ``b`` by codewords).

        These are the vectors whose ``traverse`` comes to the cell: a walk has no other end than its distance, so its order is free.
        """
        some = np.flatnonzero(a[:, p] <= self.walk**2)
        k, who = np.nonzero(a[some, p] + b[np.ix_(qs, some)] <= self.walk**2)
        return np.split(some[who], np.searchsorted(k, np.arange(1, len(qs))))

    def way(self, x: np.ndarray, own: np.ndarray, cell: np.ndarray) -> np.ndarray:
        """Squared move of each unit vector from its own cell into another, a cell for each."""
        total = np.zeros(len(x))
        width = len(self.words[1])
        for part, words, o, t in zip(self.halves(x), self.words, np.divmod(own, width), np.divmod(cell, width), strict=True):
            far, near = words[t], words[o]
            apart = np.sqrt(((far - near) ** 2).sum(1))
            more = np.maximum(((part - far) ** 2).sum(1) - ((part - near) ** 2).sum(1), 0)
            total += np.where(o == t, 0, more / (2 * np.maximum(apart, 1e-12))) ** 2
        return total


def _mixed(x: np.ndarray, n: int) -> np.ndarray:
    """A number below ``n`` for each whole number, evenly dealt."""
    return ((x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % np.uint64(n)


def _assign(index: Index | None, dim: int, kind: str, ways: int, hot: np.ndarray):
    """Cell and block of every vector.  Cells with a large share of the table, and those of another dimension, go to all blocks."""

    def run(batches):
        for batch in batches:
            lists = batch.column(2)
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            flat = np.ascontiguousarray(lists.flatten().to_numpy(zero_copy_only=False), dtype=kind)
            ends = np.cumsum(sizes)
            cell = np.full(len(sizes), -1, dtype=np.int64)
            usual = np.flatnonzero((sizes == dim) & (index is not None))
            if len(usual):
                cell[usual] = index.cell(unit(flat[(ends - sizes)[usual, None] + np.arange(dim)].astype(np.float64)))
            rows = batch.column(0).to_numpy(zero_copy_only=False)
            block = np.where((cell < 0) | np.isin(cell, hot), _mixed(rows, ways), _mixed(cell, ways))
            offsets = np.concatenate([[0], ends * flat.itemsize]).astype(np.int32)
            vector = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(flat)])
            whole = [pa.array(x.astype(np.int32)) for x in (sizes, cell, block)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], vector, *whole], names=["row", "n", "vector", "dim", "cell", "block"])

    return run


class _Block:
    """Vectors of a block in the order of their cells, from ``at`` on among those of the task."""

    def __init__(self, row: np.ndarray, n: np.ndarray, cell: np.ndarray, raw: np.ndarray, at: int):
        order = np.argsort(cell, kind="stable")
        self.row, self.n, self.cell, self.raw, self.at = row[order], n[order], cell[order], raw[order], at
        self.near = np.empty(raw.shape, dtype=np.float32)
        for k in range(0, len(row), ASKING):
            self.near[k : k + ASKING] = self.unit(slice(k, k + ASKING))
        self.cells, starts = np.unique(self.cell, return_index=True)
        self.ends = np.append(starts, len(row))

    def unit(self, at) -> np.ndarray:
        return unit(self.raw[at].astype(np.float64))


class _Meeting:
    """Counts and a spanning forest of the links between two blocks, or inside one."""

    def __init__(self, index: Index | None, threshold: float, blocks: list[_Block]):
        self.index, self.threshold, self.blocks = index, threshold, blocks
        self.doubt = (blocks[0].raw.shape[1] + 16) * 2.0**-23  # more than what single precision is off
        self.row = np.concatenate([b.row for b in blocks])
        self.linked = np.zeros(len(self.row), dtype=np.int64)
        self.by_rank = np.argsort(self.row, kind="stable")
        self.rank = np.argsort(self.by_rank, kind="stable")  # nodes of the forest, so that the least is the smallest row
        self.tree = np.arange(len(self.row))
        self.listed: list[tuple[np.ndarray, np.ndarray]] = []
        self.waiting = 0

    def found(self) -> pa.RecordBatch:
        one, two = self.blocks[0], self.blocks[-1]
        for asking, base in [(one, one)] if one is two else [(one, two), (two, one)]:
            step = ASKING if self.index is None else max(1, min(ASKING, MOVES // max(map(len, self.index.words))))
            for at in range(0, len(asking.row), step):
                self._ask(asking, np.arange(at, min(at + step, len(asking.row))), base)
            self._settle(asking, base)
        row = self.row[self.by_rank]
        some, tied = np.flatnonzero(self.linked), np.flatnonzero(self.tree != np.arange(len(row)))
        a, b = np.concatenate([self.row[some], row[tied]]), np.concatenate([np.full(len(some), -1), row[self.tree[tied]]])
        n = np.concatenate([self.linked[some], np.zeros(len(tied), dtype=np.int64)])
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (a, n, b)], names=["a", "n", "b"])

    def _ask(self, asking: _Block, who: np.ndarray, base: _Block) -> None:
        if self.index is None:
            return self._meet(asking, who, base, 0, len(base.row))
        _, _, a, b = self.index.place(asking.unit(who))
        a, b = a**2, np.ascontiguousarray(b.T**2)
        p, q = np.divmod(base.cells, len(self.index.words[1]))
        first, starts = np.unique(p, return_index=True)
        for i, start, end in zip(first, starts, np.append(starts[1:], len(p)), strict=True):
            for c, callers in zip(range(start, end), self.index.callers(a, b, i, q[start:end]), strict=True):
                if len(callers):
                    self._meet(asking, who[callers], base, base.ends[c], base.ends[c + 1])

    def _meet(self, asking: _Block, who: np.ndarray, base: _Block, start: int, end: int) -> None:
        """Finds the links between vectors that ask and those of a cell: in single precision, in double where that is in doubt."""
        x = asking.near[who]
        for at in range(start, end, MEETING):
            to = np.arange(at, min(at + MEETING, end))
            close = x @ base.near[to[0] : to[-1] + 1].T
            hits = close >= self.threshold - self.doubt
            if not hits.any():
                continue
            if asking is base:
                hits &= who[:, None] != to[None]
            i, j = np.nonzero(hits & (close < self.threshold + self.doubt))
            for k in range(0, len(i), ASKING):
                u, v = i[k : k + ASKING], j[k : k + ASKING]
                hits[u, v] = np.einsum("ij,ij->i", asking.unit(who[u]), base.unit(to[v])) >= self.threshold
            n = np.count_nonzero(hits)
            if n > LISTED or n > 4_096 and n > 0.02 * hits.size:
                self._crowd(asking, who, base, to, hits)
            elif n:
                i, j = np.nonzero(hits)
                self.listed.append((who[i], to[j]))
                self.waiting += n
                if self.waiting >= LISTED:
                    self._settle(asking, base)

    def _settle(self, asking: _Block, base: _Block) -> None:
        """Counts listed links.  A partner that does not ask the asking vector's cell is credited here."""
        listed, self.listed, self.waiting = self.listed, [], 0
        if not listed:
            return
        i, j = (np.concatenate(x) for x in zip(*listed, strict=True))
        np.add.at(self.linked, i + asking.at, base.n[j])
        for k in range(0, len(i) if self.index is not None else 0, ASKING):
            u, v = i[k : k + ASKING], j[k : k + ASKING]
            once = self.index.way(base.unit(v), base.cell[v], asking.cell[u]) > self.index.walk**2
            np.add.at(self.linked, v[once] + base.at, asking.n[u[once]])
        self.tree = merge(self.tree, self.rank[i + asking.at], self.rank[j + base.at])

    def _crowd(self, asking: _Block, who: np.ndarray, base: _Block, to: np.ndarray, hits: np.ndarray) -> None:
        """What ``_settle`` does, where many of the pairs are links: by matrices instead of lists."""
        np.add.at(self.linked, who + asking.at, hits @ base.n[to])
        if self.index is not None:
            _, _, a, b = self.index.place(base.unit(to))
            p, q = np.divmod(asking.cell[who], len(self.index.words[1]))
            once = hits & (a.T[p] ** 2 + b.T[q] ** 2 > self.index.walk**2)
            self.linked[to + base.at] += asking.n[who] @ once
        own, other = self.rank[who + asking.at], self.rank[to + base.at]
        low_own, low_other = spread(hits, own, other)
        self.tree = merge(self.tree, np.concatenate([own, other]), np.concatenate([low_own, low_other]))


def _meet(index: Index | None, dim: int, kind: str, ways: int, threshold: float):
    """Every two blocks that a task has got, and every block with itself, dimension by dimension."""

    def run(batches):
        held = defaultdict(list)
        for batch in batches:
            size, pair = (batch.column(c).to_numpy() for c in ("dim", "pair"))
            key = size.astype(np.int64) << 32 | pair
            for k in np.unique(key):
                part = batch.filter(pa.array(key == k))
                raw = np.frombuffer(b"".join(part.column("vector").to_pylist()), dtype=kind).reshape(len(part), -1)
                held[k].append((*(part.column(c).to_numpy() for c in ("row", "n", "cell", "block")), raw))
        while held:
            k, parts = held.popitem()
            row, n, cell, block, raw = (np.concatenate(x) for x in zip(*parts, strict=True))
            del parts
            numbers, width = np.unique(block), raw.shape[1]
            if len(numbers) == 1 and (k & 0xFFFFFFFF) < ways * (ways - 1) // 2:
                continue  # the other block has none of this dimension
            blocks, at = [], 0
            for b in numbers:
                own = np.flatnonzero(block == b)
                blocks.append(_Block(row[own], n[own], cell[own], raw[own], at))
                at += len(own)
            del raw
            yield _Meeting(index if width == dim else None, threshold, blocks).found()

    return run


def links(table: DataFrame, threshold: float = THRESHOLD, target: float = TARGET) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of ``table`` (vec_id, embedding; others ignored).

    A pair is linked if its cosine, in double precision, is at least ``threshold`` and one of the two asks the other's cell;
    n_links counts rows, equal vectors too.  Vectors that are null, empty, zero or hold null or non-finite components link with
    nothing; vectors of different dimensions do not link, and those of an unusual dimension are compared with all of
    theirs.  Null ids are passed on and are the smallest of no component but their own.  An empty table gives an empty result.
    The codebooks and the walk are fitted on at most ``SAMPLE`` vectors; every vector is indexed and asked.
    """
    rows = numbered(table)
    good = rows.where("usable")
    key = ["d1", "d2"]
    wide = F.col("embedding").cast("array<double>")
    digested = good.select("row", F.xxhash64(wide).alias("d1"), F.xxhash64(F.lit(1), wide).alias("d2"))
    nodes = materialize(digested.groupBy(*key).agg(F.min("row").alias("node"), F.count("*").alias("n")))
    if nodes.where("n > 1").isEmpty():  # the stored rows serve as they are
        vectors = good.select("row", F.lit(1).cast("long").alias("n"), "embedding")
    else:
        vectors = materialize(good.join(nodes, good["row"] == nodes["node"]).select("row", "n", "embedding"))
    kind, size = ("<f4", 4) if dict(rows.dtypes)["embedding"] == "array<float>" else ("<f8", 8)
    dim = usual_dim(vectors)
    total, numbers = vectors.agg(F.count("*"), F.coalesce(F.sum(F.size("embedding")), F.lit(0))).first()
    drawn = sample(vectors, SAMPLE, dim)
    index = Index(drawn, total, threshold, target) if dim > 1 else None
    ways = max(1, math.ceil(numbers * size / BLOCK_BYTES), min(FEW_BLOCKS, math.ceil(total / BLOCK_ROWS)))
    cells, counts = np.unique(index.cell(unit(drawn)) if index is not None else np.empty(0, dtype=np.int64), return_counts=True)
    hot = cells[counts > len(drawn) / (32 * ways)]
    placed = vectors.mapInArrow(
        _assign(index, dim, kind, ways, hot), "row long, n long, vector binary, dim int, cell int, block int"
    ).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(ways - 1))))
    low, high, two = F.least("block", "other"), F.greatest("block", "other"), ways * (ways - 1) // 2
    pair = F.when(low < high, (high * (high - 1) / 2).cast("int") + low).otherwise(two + low)
    odd = F.when(F.col("dim") == dim, 0).otherwise(F.hash("dim") % 65_536)
    met = placed.select("row", "n", "vector", "dim", "cell", "block", pair.alias("pair")).repartitionById(
        two + ways, F.pmod(F.col("pair") + odd, F.lit(two + ways)).cast("int")
    )
    found = materialize(met.mapInArrow(_meet(index, dim, kind, ways, threshold), "a long, n long, b long"))
    counts = materialize(found.where("b < 0").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("linked")))
    owner = materialize(components(found.where("b >= 0").select("a", "b")))
    node = nodes.join(counts, "node", "left").join(owner, "node", "left").select(
        *key, (F.col("n") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("component")
    )
    member = materialize(digested.join(materialize(node), key).select("row", "n_links", "component"))
    placed = materialize(rows.select("row", "vec_id").join(member, "row", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "row").alias("component")
    ))
    least = materialize(placed.groupBy("component").agg(F.min("vec_id").alias("component_id")))
    return placed.join(least, "component").select(
        "vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept")
    )
