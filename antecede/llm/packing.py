"""Packing token pieces into windows by best-fit decreasing.

Documents are encoded once; overlong ones are cut into full windows and a rest.  Pieces are dealt at random into blocks
of about ``BLOCK`` pieces, and each block is packed by itself: the longest piece first, into the tightest window
that still takes it.  A block is large enough that packing it alone costs nothing measurable in padding.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from antecede.llm.tokens import encoder
from antecede.session import materialize

BLOCK = 16_000
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
PACKED = f"{PIECE}, sequence_id long, offset long"


def _cut(path: str, window: int, end: int):
    last = np.array([end], dtype="<u4").tobytes()

    def run(batches):
        ids_of = encoder(path).ids
        for batch in batches:
            out: list[list[int]] = [[], [], [], [], []]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = ids_of(text) + last
                for at in range(0, len(ids), 4 * window):
                    piece = ids[at : at + 4 * window]
                    for column, value in zip(out, (doc_id, at // 4, len(piece) // 4, zlib.crc32(piece), len(ids) // 4), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return run


class OpenWindows:
    """Segment tree over remaining capacities: how many windows have each, and the tightest that takes a length."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.tree = [0] * (2 * self.leaves)
        self.ids: list[list[int]] = [[] for _ in range(window + 1)]

    def _add(self, capacity: int, by: int) -> None:
        node = capacity + self.leaves
        while node:
            self.tree[node] += by
            node >>= 1

    def put(self, capacity: int, window_id: int) -> None:
        self.ids[capacity].append(window_id)
        self._add(capacity, 1)

    def take(self, length: int) -> tuple[int, int] | None:
        """(capacity, window) of the tightest open window with room for ``length``."""
        tree, node = self.tree, length + self.leaves
        if not tree[node]:
            while node > 1 and (node & 1 or not tree[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if tree[2 * node] else 2 * node + 1
        capacity = node - self.leaves
        self._add(capacity, -1)
        return capacity, self.ids[capacity].pop()


def best_fit_decreasing(lengths, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Window and offset of every piece; pieces of equal length are placed in the order given."""
    lengths = np.asarray(lengths, dtype=np.int64)
    where, offset, opened, windows = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), OpenWindows(window), 0
    for i in np.argsort(-lengths, kind="stable"):
        length = int(lengths[i])
        found = opened.take(length)
        if found is None:
            found, windows = (window, windows), windows + 1
        where[i], offset[i] = found[1], window - found[0]
        if found[0] > length:
            opened.put(found[0] - length, found[1])
    return where, offset


def _pack(window: int):
    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["doc_id", "start"], kind="stable")
        where, offset = best_fit_decreasing(part["length"], window)
        part["sequence_id"], part["offset"] = (part["block"].to_numpy() << 32) + where, offset
        return part.drop(columns="block")

    return run


def pack(docs: DataFrame, tokenizer: str, window: int = 1024, end: int = 0) -> DataFrame:
    """Pieces of every row of ``docs`` (doc_id, text; other columns are ignored) and their places.

    doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: one row for each piece; ``end`` closes each
    document.  A null text is empty: one piece that holds ``end`` alone.  Rows with a null or repeated doc_id are
    packed each.  Ties go by doc_id and start.  An empty table gives no piece.  Only numbers are shuffled.
    """
    cut = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(
        _cut(tokenizer, window, end), PIECE
    )
    pieces = materialize(cut.withColumn("row", F.monotonically_increasing_id()))
    blocks = max(1, math.ceil(pieces.count() / BLOCK))
    block = F.pmod(F.xxhash64("row"), F.lit(blocks)).alias("block")
    columns = [c.split()[0] for c in PIECE.split(", ")]
    return pieces.select(*columns, block).groupBy("block").applyInPandas(_pack(window), PACKED)
