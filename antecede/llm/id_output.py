"""Token ids of all documents as a table of compressed shards, in ascending doc_id order, and back.

Documents are encoded once and stored as ids.  They are dealt to ranges of doc_id and sorted; every task writes its ids as
shards of some millions of ids (see ``id_coder`` for their bytes), a row for each shard in a Parquet table, which Spark
commits as a whole: a lost executor leaves no half file, and any store that Spark reaches will do.  Only ids are shuffled,
never texts.  Files are read shard by shard; no document spans two shards.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from antecede.llm.chunks import chunk_encoder
from antecede.llm.id_coder import TOGETHER, open_shards, pack_shards
from antecede.llm.ranges import PID, in_ranges, partitions_for, totals_before
from antecede.session import materialize, work_folder

SHARD = 1_024 * 4_096  # ids; a longer document is a shard of its own
LETTERS = 1 << 23  # bytes of texts that are encoded at once
RANGE = 4 * SHARD  # ids of a range of doc_id, about
SHARDS = "shard long, docs long, n_ids long, before long, body binary"


def _encode(path: str, end: int):
    def run(batches):
        encoder = chunk_encoder(path)
        last = np.array([end], dtype=encoder.dtype).tobytes()
        for batch in batches:
            at = 0
            while at < batch.num_rows:  # some millions of letters at once, or one very long text
                size, to = 0, at
                while to < batch.num_rows and (to == at or size < LETTERS):
                    size += batch.column(1)[to].as_buffer().size
                    to += 1
                ids = encoder.many(batch.column(1).slice(at, to - at).to_pylist())
                yield _rows(batch.column(0).slice(at, to - at).to_pylist(), [i + last for i in ids], encoder.dtype.itemsize)
                at = to

    return run


def _rows(docs: list, ids: list[bytes], width: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(docs, pa.int64()), pa.array([len(i) // width for i in ids], pa.int64()), pa.array(ids, pa.binary())],
        ["doc_id", "n_tokens", "ids"],
    )


def _write(width: int):
    def run(batches):
        shard, before, docs, lengths, bodies, held, full = 0, 0, [], [], [], 0, []

        def packed():
            found = pack_shards([row[2:] for row in full])
            heads = [(number, len(d), sum(n), start) for number, start, d, n, _ in full]
            full.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(v, pa.int64()) for v in zip(*heads, strict=True)] + [pa.array(found, pa.binary())],
                ["shard", "docs", "n_ids", "before", "body"],
            )

        for batch in batches:
            for doc_id, n, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if docs and held + n > SHARD:
                    full.append((shard, before, docs, lengths, np.frombuffer(b"".join(bodies), f"<u{width}")))
                    shard, before, docs, lengths, bodies, held = shard + 1, before + held, [], [], [], 0
                    if len(full) == TOGETHER:
                        yield packed()
                docs.append(doc_id)
                lengths.append(n)
                bodies.append(ids.as_py())
                held += n
        if docs:
            full.append((shard, before, docs, lengths, np.frombuffer(b"".join(bodies), f"<u{width}")))
            yield packed()

    return run


def write_ids(docs: DataFrame, tokenizer: str, path: str, end: int = 1) -> DataFrame:
    """Writes the ids of ``docs`` (doc_id, text; other columns are ignored) to the new folder ``path``; what is there, as a frame.

    Every document's ids are followed by ``end``.  A null text is empty: ``end`` alone.  Null doc_ids come first; rows
    with equal doc_id are written each, shorter ones first.  An empty table gives a folder without
    shards.  A text of any length is one row of ids, and a shard is at least one document.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    coded = materialize(rows.mapInArrow(_encode(tokenizer, end), "doc_id long, n_tokens long, ids binary"))
    coded = coded.withColumn("row", F.monotonically_increasing_id())
    total = coded.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]
    # Rows that repeat a doc_id, whole copies too, are dealt by length, checksum and row, so no doc_id is too much for a range.
    keys = [F.col("doc_id"), F.col("n_tokens"), F.crc32("ids"), F.col("row")]
    shards = in_ranges(coded, partitions_for(total, RANGE), keys).drop("row").mapInArrow(_write(chunk_encoder(tokenizer).dtype.itemsize), SHARDS)
    shards.withColumn(PID, F.spark_partition_id()).write.parquet(path)
    return spark.read.schema(f"{SHARDS}, `{PID}` int").parquet(path)


def _opened(batches, column: int) -> Iterator[tuple]:
    """Rows of shards, (other values, what the shard holds), a few shards at once; the bytes are in ``column``."""
    held = []

    def found():
        for (row, _), shard in zip(held, open_shards([body for _, body in held]), strict=True):
            yield row, shard
        held.clear()

    for batch in batches:
        for i in range(batch.num_rows):
            row = [batch.column(j)[i].as_py() for j in range(batch.num_columns)]
            held.append((row, row.pop(column)))
            if len(held) == TOGETHER:
                yield from found()
    yield from found()


def _read(batches):
    for (part, before), (docs, lengths, ids) in _opened(batches, 2):
        ends = np.cumsum(lengths)
        begins = ends - lengths
        raw = ids.astype("<u4").tobytes()
        crcs = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays(
            [pa.array([part] * len(docs), pa.int32()), pa.array(docs, pa.int64()), pa.array(before + begins, pa.int64()),
             pa.array(np.asarray(lengths, np.int64)), pa.array(crcs, pa.int64())],
            [PID, "doc_id", "start", "n_tokens", "ids_crc32"],
        )


def read_documents(shards: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in ``shards``, from their bytes.

    ``start``: the ids of all documents before it.  A damaged shard stops the job.
    """
    spark = shards.sparkSession
    before = totals_before(shards.select(PID, "n_ids"), PID, "n_ids")
    found = shards.select(PID, "before", "body").mapInArrow(_read, f"`{PID}` int, doc_id long, start long, n_tokens long, ids_crc32 long")
    parts = spark.createDataFrame(list(before.items()) or [(0, 0)], f"`{PID}` int, base long")  # a row for each task that wrote
    return found.join(F.broadcast(parts), PID).select("doc_id", (F.col("start") + F.col("base")).alias("start"), "n_tokens", "ids_crc32")


def read_ids(shards: DataFrame) -> DataFrame:
    """doc_id and ids (an array) of every document in ``shards``."""

    def run(batches):
        for _, (docs, lengths, ids) in _opened(batches, 0):
            offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), lists], ["doc_id", "ids"])

    return shards.select("body").mapInArrow(run, "doc_id long, ids array<int>")


def round_trip(docs: DataFrame, tokenizer: str, end: int = 1) -> DataFrame:
    """What the files of ``docs`` give when they are read back; they lie in the application's work folder."""
    path = f"{work_folder(docs.sparkSession)}/token-ids-{uuid.uuid4().hex}"
    return read_documents(write_ids(docs, tokenizer, path, end))
