"""The trie of conversation prefixes, with totals of every subtree.

Conversations are put in order over all tasks: turns are sorted in ranges, numbered, and every prefix gets a name, the
polynomial hash of its turns (four residues of 31 bits), whose running sums go on from one range to the next, so a
conversation of any length meets in no task.  Prefixes of equal name are one node.

Totals of subtrees are found by time-forward processing.  Nodes are sorted by reverse level order, deepest first; a node
takes the messages that wait for it in a priority queue, adds its own part, and sends the sum to its parent.  The queue
spills sorted runs to the scratch folders that Spark gives the task.  This is done within shards first: a shard root is the
topmost node on a path with at most ``MEMBERS`` conversations, its subtree belongs to one shard, and no subtree holds more
than ``MEMBERS`` conversations.  What the shard roots send is summed for each parent, and the nodes above them, one for each
``MEMBERS`` turns of the table at most, are processed the same way.  A node with a single conversation needs no processing:
it has one leaf and saves nothing.
"""

from __future__ import annotations

import hashlib
import heapq
import os
import struct
import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from antecede.llm.ranges import PID, in_ranges
from antecede.session import materialize

FAMILY, MOST_SHARED = 100, 6
MEMBERS = 1_000  # conversations of a shard root at most
QUEUED = 500_000  # messages of a queue in memory
JOINED = 65_536  # ids of a stretch that is hashed at once

PRIME = (1 << 31) - 1
BASES = (1_103_515_245, 1_664_525_007, 1_566_083_941, 1_812_433_253)  # any four numbers below PRIME would do
#: Powers of each base with exponents 0 to -5.
BACK = [[pow(pow(b, PRIME - 2, PRIME), i, PRIME) for i in range(MOST_SHARED)] for b in BASES]
LANES = range(len(BASES))
KEY = ["depth", "k1", "k2"]


class _Powers:
    def __init__(self, base: int):
        self.base, self.known = base, np.ones(1, np.uint64)

    def __call__(self, most: int) -> np.ndarray:
        while len(self.known) <= most:
            step = np.uint64(pow(self.base, len(self.known), PRIME))
            self.known = np.concatenate([self.known, self.known * step % PRIME])
        return self.known


def _prefixes(batches):
    """Place and names of the prefixes before and after every turn, as if each conversation began in this task."""
    powers = [_Powers(b) for b in BASES]
    last, count, sums = None, 0, [0] * len(BASES)
    for batch in batches:
        if not batch.num_rows:
            continue
        conv = batch.column(0).to_numpy()
        starts = np.flatnonzero(np.concatenate([[True], conv[1:] != conv[:-1]]))
        run = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(conv))))
        place = np.arange(len(conv)) - starts[run]
        goes_on = conv[0] == last
        place[run == 0] += count if goes_on else 0
        columns = [batch.column(0), pa.array(place), batch.column(1)]
        after = []
        for i in LANES:
            terms = batch.column(2 + i).to_numpy().astype(np.uint64) * powers[i](int(place.max()))[place] % PRIME
            whole = np.cumsum(terms)
            names = whole - (whole[starts] - terms[starts])[run]
            if goes_on:
                names[run == 0] += np.uint64(sums[i])
            after.append(names % PRIME)
            columns += [pa.array(((names + PRIME - terms) % PRIME).astype(np.int64)), pa.array(after[i].astype(np.int64))]
        last, count, sums = conv[-1], int(place[-1]) + 1, [int(a[-1]) for a in after]
        yield pa.RecordBatch.from_arrays(columns, ["conv_id", "place", "chars", *[f"{n}{i}" for i in LANES for n in ("x", "e")]])


def _carried(parts: list) -> list[tuple]:
    """(task, conversation, turns before, for each lane names before and the power to go on with), where a task goes on."""
    out, last, count, sums = [], None, 0, [0] * len(BASES)
    for part, first, end in parts:
        on = first == last
        own, names = end["place"] + 1, [end[f"e{i}"] for i in LANES]
        ahead = [pow(b, count, PRIME) for b in BASES]
        if on:
            out.append((part, first, count, *[v for i in LANES for v in (sums[i], ahead[i])]))
        if on and first == end["conv_id"]:
            count, sums = count + own, [(sums[i] + ahead[i] * names[i]) % PRIME for i in LANES]
        else:
            last, count, sums = end["conv_id"], own, names
    return out


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, place (from 0), chars, and for each lane x and e: names of the prefix before and after the turn."""
    spark = conversations.sparkSession
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    digest = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), text.alias("text"),
        F.length(text).cast("long").alias("chars"), digest.alias("digest"),
    ).where("conv_id IS NOT NULL")
    short = lambda name: F.substring(name, 1, 64)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = in_ranges(
        materialize(rows), tasks, [F.col("conv_id"), F.col("turn"), short("role"), short("text")], [F.col(c) for c in ("conv_id", "turn", "role", "text")]
    )
    lane = lambda i: (F.conv(F.substring("digest", 8 * i + 1, 8), 16, 10).cast("long") % PRIME).alias(f"t{i}")
    names = ", ".join(f"x{i} long, e{i} long" for i in LANES)
    found = ordered.select("conv_id", "chars", *map(lane, LANES)).mapInArrow(_prefixes, f"conv_id long, place long, chars long, {names}")
    turns = materialize(found.withColumn(PID, F.spark_partition_id()))
    ends = turns.groupBy(PID).agg(F.min("conv_id"), F.max(F.struct("conv_id", "place", *[f"e{i}" for i in LANES]))).orderBy(PID)
    carry = ", ".join(f"s{i} long, b{i} long" for i in LANES)
    carried = spark.createDataFrame(_carried(ends.collect()), f"`{PID}` int, conv_id long, before long, {carry}")  # a row a task at most
    on = lambda name, i: F.when(F.col("before").isNull(), F.col(name)).otherwise((F.col(f"s{i}") + F.col(f"b{i}") * F.col(name)) % PRIME)
    return materialize(turns.join(F.broadcast(carried), [PID, "conv_id"], "left").select(
        "conv_id", (F.col("place") + F.coalesce("before", F.lit(0))).alias("place"), "chars",
        *[on(f"{n}{i}", i).alias(f"{n}{i}") for i in LANES for n in ("x", "e")],
    ))


def _named(lanes: list[Column], one: str, two: str) -> list[Column]:
    pair = lambda a, b: a * F.lit(1 << 31) + b
    return [pair(lanes[0], lanes[1]).alias(one), pair(lanes[2], lanes[3]).alias(two)]


def occurrences(conversations: DataFrame) -> DataFrame:
    """A row for every prefix of every rebuilt conversation: conv_id, depth, k1, k2, q1, q2 (of its parent), chars, ends.

    Conversation c is rebuilt from the first h turns of c - c % 100 and its own turns after its first h.
    """
    turns = numbered_turns(conversations)
    first = turns.where(F.col("place") < MOST_SHARED - 1).groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("place", "chars", *[f"e{i}" for i in LANES]))).alias("w")  # five at most
    )
    sizes = turns.groupBy("conv_id").agg(F.count("*").alias("own"))
    h = F.crc32(F.col("conv_id").cast("string")) % MOST_SHARED
    convs = sizes.withColumns({"h": h, "family": F.col("conv_id") - F.col("conv_id") % FAMILY}).join(first, "conv_id")
    heads = first.select(F.col("conv_id").alias("family"), F.col("w").alias("head"))
    convs = convs.join(heads, "family", "left").withColumn("head", F.coalesce("head", F.slice("w", 1, 0)))
    convs = convs.withColumn("m", F.least("h", F.size("head")).cast("long"))
    at = lambda words, i, name: F.when(F.col(i) == 0, F.lit(0)).otherwise(F.try_element_at(words, F.col(i).cast("int"))[name])
    convs = materialize(convs.select(
        "conv_id", "own", "h", "m", F.slice("head", F.lit(1), F.col("m").cast("int")).alias("head"),
        *[at("head", "m", f"e{i}").alias(f"pm{i}") for i in LANES],
        *[F.coalesce(at("w", "h", f"e{i}"), F.lit(0)).alias(f"ph{i}") for i in LANES],
    ))
    begun = convs.select("conv_id", "own", "h", "m", "head", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m"))).alias("depth"))
    begun = begun.withColumn("up", F.greatest(F.col("depth") - 1, F.lit(0)))
    shared = begun.select(
        "conv_id", "depth", *_named([at("head", "depth", f"e{i}") for i in LANES], "k1", "k2"),
        *_named([at("head", "up", f"e{i}") for i in LANES], "q1", "q2"),
        at("head", "depth", "chars").cast("long").alias("chars"), ((F.col("depth") == F.col("m")) & (F.col("own") <= F.col("h"))).alias("ends"),
    )
    back = lambda i: F.element_at(F.array(*map(F.lit, BACK[i])), (F.col("h") - F.col("m") + 1).cast("int"))
    moved = lambda n, i: (F.col(f"pm{i}") + back(i) * ((F.col(f"{n}{i}") - F.col(f"ph{i}") + PRIME) % PRIME)) % PRIME
    rest = turns.join(convs.drop("head"), "conv_id").where(F.col("place") >= F.col("h")).select(
        "conv_id", (F.col("m") + F.col("place") - F.col("h") + 1).alias("depth"),
        *_named([moved("e", i) for i in LANES], "k1", "k2"), *_named([moved("x", i) for i in LANES], "q1", "q2"),
        "chars", (F.col("place") == F.col("own") - 1).alias("ends"),
    )
    return shared.union(rest)


class SpillingQueue:
    """Smallest first, of tuples of five whole numbers; beyond ``most`` in memory the larger half becomes a sorted run on disk."""

    ROW = struct.Struct("<5q")

    def __init__(self, most: int = QUEUED):
        self.most, self.heap, self.runs, self.files = most, [], [], []

    def push(self, item: tuple[int, ...]) -> None:
        heapq.heappush(self.heap, item)
        if len(self.heap) > self.most:
            self.heap.sort()
            run, self.heap = self.heap[self.most // 2 :], self.heap[: self.most // 2]
            # Scratch of the task, as Spark's own spills: unnamed, gone with it, and made anew if the task is.
            file = tempfile.TemporaryFile(dir=os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or None)  # noqa: SIM115
            file.writelines(self.ROW.pack(*item) for item in run)
            file.seek(0)
            self.files.append(file)
            self._next(self._read(file))

    def _read(self, file):
        while data := file.read(self.ROW.size * 4_096):
            yield from self.ROW.iter_unpack(data)

    def _next(self, run) -> None:
        if (item := next(run, None)) is not None:
            heapq.heappush(self.runs, (item, id(run), run))

    def first(self) -> tuple[int, ...] | None:
        held = self.heap[0] if self.heap else None
        return min(held, self.runs[0][0]) if held and self.runs else held or (self.runs[0][0] if self.runs else None)

    def pop(self) -> tuple[int, ...]:
        if self.runs and (not self.heap or self.runs[0][0] <= self.heap[0]):
            item, _, run = heapq.heappop(self.runs)
            self._next(run)
            return item
        return heapq.heappop(self.heap)

    def close(self) -> None:
        for file in self.files:
            file.close()


TOTALS = "depth long, k1 long, k2 long, n_leaves long, saved_tokens long"


def _time_forward(queued: int):
    """Nodes deepest first: depth, k1, k2, q1, q2, inside (whether the parent is in this run), leaves, saved (its own)."""

    def run(batches):
        waiting = SpillingQueue(queued)
        for batch in batches:
            out: list[list[int]] = [[], [], [], [], []]
            for depth, k1, k2, q1, q2, inside, leaves, saved in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                while (top := waiting.first()) is not None and top[:3] == (-depth, k1, k2):
                    message = waiting.pop()
                    leaves, saved = leaves + message[3], saved + message[4]
                if inside:
                    waiting.push((1 - depth, q1, q2, leaves, saved))
                for column, value in zip(out, (depth, k1, k2, leaves, saved), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["depth", "k1", "k2", "n_leaves", "saved_tokens"])
        waiting.close()

    return run


def _forward(nodes: DataFrame, queued: int) -> DataFrame:
    """``nodes`` are dealt to their tasks already."""
    order = nodes.sortWithinPartitions(F.desc("depth"), "k1", "k2")
    return order.select(*KEY, "q1", "q2", "inside", "leaves", "saved").mapInArrow(_time_forward(queued), TOTALS)


def _joined(batches):
    """Ids of each node, comma-joined, in stretches."""
    key, first, ids = None, None, []

    def row():
        return pa.RecordBatch.from_arrays(
            [pa.array([v], pa.int64()) for v in (*key, first)] + [pa.array([",".join(map(str, ids))])], [*KEY, "first", "ids"]
        )

    for batch in batches:
        rows: list[list] = [[], [], [], [], []]
        for *name, conv in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if name != key or len(ids) == JOINED:
                if key is not None:
                    for column, value in zip(rows, (*key, first, ",".join(map(str, ids))), strict=True):
                        column.append(value)
                key, first, ids = name, conv, []
            ids.append(conv)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in rows[:4]] + [pa.array(rows[4], pa.string())], [*KEY, "first", "ids"])
    if key is not None:
        yield row()


def _hashed(batches):
    key, digest = None, None
    for batch in batches:
        out: list[list] = [[], [], [], []]
        for *name, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if name == key:
                digest.update(b"," + ids.encode())
                continue
            if key is not None:
                for column, value in zip(out, (*key, digest.hexdigest()), strict=True):
                    column.append(value)
            key, digest = name, hashlib.sha256(ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out[:3]] + [pa.array(out[3], pa.string())], [*KEY, "ends_sha256"])
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([v], pa.int64()) for v in key] + [pa.array([digest.hexdigest()])], [*KEY, "ends_sha256"])


def _end_hashes(spark: SparkSession, ends: DataFrame) -> DataFrame:
    """Digest of the joined ids of every node.  A node's ids are joined by many tasks; one hashes their stretches in order."""
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    columns = [F.col(c) for c in (*KEY, "conv_id")]
    stretches = in_ranges(ends, tasks, columns).mapInArrow(_joined, "depth long, k1 long, k2 long, first long, ids string")
    return stretches.repartition(tasks, *KEY).sortWithinPartitions(*KEY, "first").select(*KEY, "ids").mapInArrow(
        _hashed, "depth long, k1 long, k2 long, ends_sha256 string"
    )


def prefix_trie(conversations: DataFrame, members: int = MEMBERS, queued: int = QUEUED) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node.

    ``conversations``: conv_id, turn, role, text; other columns are ignored.  Rows without conv_id belong to no conversation.
    Null turns come first; turns of equal number go by role, then by text (bytes); repeated rows are turns of their own.
    Null roles and texts are empty; an empty text is a turn.  Texts of any length are hashed whole.  Without a
    conversation there is no node, the root included.
    """
    spark = conversations.sparkSession
    seen = materialize(occurrences(conversations))
    nodes = materialize(seen.groupBy(*KEY).agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("chars").alias("chars"), F.min("q1").alias("q1"), F.min("q2").alias("q2"),
    ))
    # Both sides are tables, so Spark can split the join at a parent with very many children.
    above = nodes.select(
        (F.col("depth") + 1).alias("depth"), F.col("k1").alias("q1"), F.col("k2").alias("q2"), F.col("conv_id").alias("parent_conv_id"), F.col("n_convs").alias("parent_n")
    )
    parent = ["depth", "q1", "q2"]
    below = materialize(nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("q1").alias("k1"), F.col("q2").alias("k2")).agg(
        F.count("*").alias("n_children"), F.count_if(F.col("n_convs") == 1).alias("singles")
    ))
    tree = materialize(nodes.join(above, parent, "left").join(below, KEY, "left").fillna(0, ["n_children", "singles"]))
    shared = tree.where("n_convs > 1").select(
        *KEY, "q1", "q2", "conv_id", "n_convs", "parent_n",
        (F.col("singles") + (F.col("n_children") == 0).cast("long")).alias("leaves"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"),
    )
    # Of each conversation: the first node on its path with few members.  That of a node's smallest member is its shard root.
    top = materialize(shared.where(F.col("n_convs") > members).select(*KEY, F.lit(True).alias("high")))
    roots = seen.join(top, KEY, "left").where("high IS NULL").groupBy("conv_id").agg(F.min(F.struct(*KEY)).alias("root"))
    low = shared.where(F.col("n_convs") <= members).join(roots, "conv_id").withColumn("inside", F.coalesce(F.col("parent_n") <= members, F.lit(False)))
    within = materialize(_forward(low.repartition("root"), queued))
    sent = within.join(low.where(~F.col("inside") & (F.col("depth") > 0)).select(*KEY, "q1", "q2"), KEY)
    sent = sent.groupBy((F.col("depth") - 1).alias("depth"), F.col("q1").alias("k1"), F.col("q2").alias("k2")).agg(
        F.sum("n_leaves").alias("more_leaves"), F.sum("saved_tokens").alias("more_saved")
    )
    high = shared.where(F.col("n_convs") > members).join(sent, KEY, "left").select(
        *KEY, "q1", "q2", (F.col("depth") > 0).alias("inside"),
        (F.col("leaves") + F.coalesce("more_leaves", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("more_saved", F.lit(0))).alias("saved"),
    )
    across = _forward(high.coalesce(1), queued)  # one node for each `members` turns at most
    totals = within.union(across)
    ends = materialize(seen.where("ends").select(*KEY, "conv_id"))
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    return tree.join(totals, KEY, "left").join(_end_hashes(spark, ends), KEY, "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.coalesce("n_leaves", F.lit(1)).cast("long").alias("n_leaves"),
        F.coalesce("saved_tokens", F.lit(0)).cast("long").alias("saved_tokens"), F.coalesce("ends_sha256", empty).alias("ends_sha256"),
    )


PREFIX_TRIE_SQL = """
WITH RECURSIVE steps(i, s, v) AS (
  SELECT i, 0, i::BIGINT FROM range(256) r(i)
  UNION ALL SELECT i, s + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM steps WHERE s < 8),
crc AS (SELECT list(v ORDER BY i) AS tbl FROM steps WHERE s = 8),
turns AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list({'r': role, 't': text} ORDER BY turn NULLS FIRST, role, text) AS w FROM turns GROUP BY conv_id),
cut AS (
  SELECT conv_id, w, xor(list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
    lambda c, b: xor(c >> 8, tbl[(xor(c, b) & 255) + 1])), 4294967295) % 6 AS h FROM own, crc),
rebuilt AS (
  SELECT c.conv_id, list_concat(coalesce(b.w[1:c.h], []), c.w[c.h + 1:]) AS w
  FROM cut c LEFT JOIN own b ON b.conv_id = c.conv_id - c.conv_id % 100),
paths AS (SELECT conv_id, d, w[1:d] AS p, d = len(w) AS ends FROM (SELECT conv_id, w, unnest(range(0, len(w) + 1)) AS d FROM rebuilt)),
nodes AS (
  SELECT p, d, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
  FROM paths GROUP BY p, d),
children AS (SELECT p[1:d - 1] AS p, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY ALL),
tree AS (
  SELECT n.*, coalesce(n_children, 0) AS n_children, CASE WHEN d = 0 THEN 0 ELSE (n_convs - 1) * length(p[d].t) END AS saved
  FROM nodes n LEFT JOIN children USING (p)),
subtrees AS (
  SELECT p[1:e] AS p, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved)::BIGINT AS saved_tokens
  FROM (SELECT *, unnest(range(0, d + 1)) AS e FROM tree) GROUP BY ALL)
SELECT t.conv_id, t.d AS depth, u.conv_id AS parent_conv_id, t.n_convs, t.n_children, n_leaves, saved_tokens, t.ends_sha256
FROM tree t JOIN subtrees USING (p) LEFT JOIN nodes u ON t.d > 0 AND u.p = t.p[1:t.d - 1]"""
