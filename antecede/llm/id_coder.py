"""Shards of token ids, compressed by an adaptive context-mixing range coder.

A shard is bytes: a head, the ids of some documents one after the other, cut into blocks of ``BLOCK`` ids.  Every block
starts from the same state and has its own checksum, so any block can be read without the others.

An id is predicted by three orders at once.  Order 2 and order 1 name the id that last followed the two ids (the one id)
before, each with a confidence of 0 to 3; order 0 has a share for every id of the shard.  The mixed probability of an id is
w2 [order 2 names it] + w1 [order 1 names it] + w0 share(id); the weights belong to the pair of confidences and to whether
both name the same id, and learn after every id which order was right.  One step of a range coder of 62 bits codes the id.

Blocks are independent, so they are coded side by side: step t codes id t of all blocks with numpy.  A call of numpy costs
about as much as its work on a thousand blocks, so the blocks of several shards go together; the bytes of a shard do not
depend on what is coded beside it.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

U = np.uint64
MAGIC = b"MIXID002"
BLOCK = 4_096
LANES = 2_048  # blocks coded side by side
TOGETHER = 2  # shards of LANES / 2 blocks each that are worth coding at once
SLOTS = 1_024  # of the tables of order 1 and 2, for each block: those of all lanes then fit the cache
FINE = 18  # order 0 has shares of 2 ** FINE, more where a shard has very many different ids
RATE = 5  # weights move by 1 / 2 ** RATE
ONE = 1 << 16
LEAST = 64  # no weight falls below LEAST / ONE
TOP = ONE - 3 * LEAST
EMPTY = -4  # of a slot: names no id, confidence 0
FEW = U(1 << 46)  # a span below it puts out a digit
ODD = 40_503  # spreads the id before the last over the slots
HEAD = struct.Struct("<8sIQQIIQQ")  # magic, crc32 of the head, ids, documents, block, different ids, bytes of the tables, of the index


class DamagedShard(ValueError):
    """A head or a block does not agree with its checksum."""


def shares(counts: np.ndarray, fine: int) -> np.ndarray:
    """Whole shares of 2 ** fine in proportion to ``counts``, one at least."""
    total, room = int(counts.sum()), (1 << fine) - len(counts)
    parts = 1 + (counts.astype(np.float64) * (room / total)).astype(np.int64)
    parts[np.argmax(parts)] += (1 << fine) - int(parts.sum())
    return parts


def _fine(kinds: int) -> int:
    return max(FINE, kinds.bit_length() + 2)


class _Shares:
    """Order 0 of some shards: ``below`` and ``share`` of their ids, one shard after the other."""

    def __init__(self, parts: list[np.ndarray], fine: list[int]):
        self.parts, self.fine = parts, fine
        self.share = np.concatenate(parts).astype(U)
        self.below = np.concatenate([np.cumsum(p) - p for p in parts]).astype(U)
        sizes = [len(p) for p in parts]
        self.first = np.cumsum(sizes) - sizes

    def owners(self) -> tuple[np.ndarray, np.ndarray]:
        """The rank that each unit of a shard belongs to, and where the units of a shard begin."""
        owner = np.concatenate([np.repeat(np.arange(len(p), dtype=np.int32), p) for p in self.parts])
        return owner, np.cumsum([0, *(1 << f for f in self.fine[:-1])])


class _Lanes:
    """What the orders know of each block, and the weights of the orders.

    Order 2 is the first row of an array, order 1 the second, so one call of numpy serves both.  Arrays are made once and
    written again in every step; constants are whole arrays of the type they meet, which spares numpy conversions.
    """

    def __init__(self, lanes: int, fine: np.ndarray):
        pair = (2, lanes)
        self.row = np.arange(2 * lanes, dtype=np.int64).reshape(pair) * SLOTS
        self.table = np.full(2 * lanes * SLOTS, EMPTY, np.int32)
        self.weights = np.concatenate([np.tile(start, lanes) for start in _first_weights()]).astype(np.int64)
        self.states = np.arange(2 * lanes, dtype=np.int64).reshape(pair) * 32
        self.context = np.zeros(pair, np.int64)
        self.mixed = np.zeros(lanes, np.int64)  # of the id before the last
        self.at, self.state, self.weight, self.aim = (np.zeros(pair, np.int64) for _ in range(4))
        self.entry, self.sure, self.named, self.more, self.new = (np.zeros(pair, np.int32) for _ in range(5))
        self.sum, self.same = np.zeros(lanes, np.int32), np.zeros(lanes, bool)
        self.mask, self.odd = np.full(pair, SLOTS - 1), np.full(lanes, ODD)
        self.one, self.two, self.three = (np.full(pair, k, np.int32) for k in (1, 2, 3))
        self.least, self.top, self.rate = (np.full(pair, k) for k in (LEAST, LEAST + TOP, RATE))
        self.fine, self.whole = np.tile(fine, (2, 1)), np.full(lanes, ONE, U)
        self.reach, self.rest = np.zeros(pair, U), np.zeros(lanes, U)

    def predict(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The widths of order 2 and order 1 and the weight of order 0; ``named`` is what the orders name."""
        np.bitwise_and(self.context, self.mask, out=self.at)
        np.add(self.at, self.row, out=self.at)
        self.table.take(self.at, out=self.entry, mode="clip")
        np.bitwise_and(self.entry, self.three, out=self.sure)
        np.right_shift(self.entry, self.two, out=self.named)
        np.left_shift(self.sure[0], self.two[0], out=self.sum)
        np.add(self.sum, self.sure[1], out=self.sum)
        np.left_shift(self.sum, self.one[0], out=self.sum)
        np.equal(self.named[0], self.named[1], out=self.same)
        np.add(self.sum, self.same.view(np.int8), out=self.sum)
        np.add(self.states, self.sum, out=self.state)
        self.weights.take(self.state, out=self.weight, mode="clip")
        weight = self.weight.view(U)
        np.subtract(self.whole, weight[0], out=self.rest)
        np.subtract(self.rest, weight[1], out=self.rest)
        np.left_shift(weight, self.fine, out=self.reach)
        return self.reach[0], self.reach[1], self.rest

    def learn(self, ids: np.ndarray, new: np.ndarray, hit: np.ndarray, only1: np.ndarray) -> None:
        """``new``: entries that name ``ids`` for the first time.  ``only1``: order 1 named the id and order 2 did not."""
        np.copyto(self.aim, self.least)
        np.putmask(self.aim[0], hit[0], self.top[0])
        np.putmask(self.aim[1], only1, self.top[1])
        np.subtract(self.aim, self.weight, out=self.aim)
        np.right_shift(self.aim, self.rate, out=self.aim)
        np.add(self.weight, self.aim, out=self.weight)
        self.weights[self.state] = self.weight
        np.add(self.entry, self.one, out=self.more)
        np.bitwise_or(self.entry, self.three, out=self.sure)
        np.minimum(self.more, self.sure, out=self.more)  # a confidence of 3 at most
        np.copyto(self.new, new)
        np.putmask(self.new, hit, self.more)
        self.table[self.at] = self.new
        self.context[1] = ids
        np.add(self.mixed, self.context[1], out=self.context[0])
        np.multiply(self.context[1], self.odd, out=self.mixed)


def _first_weights() -> tuple[np.ndarray, np.ndarray]:
    """Of each state: confidence of order 2, of order 1, whether both name the same id."""
    sure = np.arange(4, dtype=np.int32)
    w2 = np.clip(ONE * sure // (sure + 3), LEAST, ONE // 2)[:, None, None]
    w1 = np.clip((ONE - w2) * sure[:, None] // (sure[:, None] + 4), LEAST, ONE // 4)
    shape = (4, 4, 2)
    return np.broadcast_to(w2, shape).ravel().astype(np.int32), np.broadcast_to(w1, shape).ravel().astype(np.int32)


def _write_blocks(ranks: np.ndarray, shares: _Shares, shard: np.ndarray) -> list[bytes]:
    """``ranks``: a column for each block; ``shard``: which one the block belongs to."""
    lanes, fine, first = len(shard), np.array(shares.fine, U)[shard], shares.first[shard]
    model, place = _Lanes(lanes, fine), np.empty(lanes, np.int64)
    owners, digits = [], []  # of every step: the blocks that put out a digit, and the digits
    low, span = np.zeros(lanes, U), np.full(lanes, 1 << 62, U)
    unit_bits, few, zero = fine + U(16), np.full(lanes, FEW), np.zeros(lanes, U)
    keep, digit_bits, scale = U((1 << 46) - 1), U(46), U(16)
    start, width = np.empty(lanes, U), np.empty(lanes, U)
    hit, only1, small = np.empty((2, lanes), bool), np.empty(lanes, bool), np.empty(lanes, bool)
    for ids in ranks:
        reach2, reach1, rest = model.predict()
        np.equal(model.named, ids, out=hit)
        np.greater(hit[1], hit[0], out=only1)
        # Of an id that no order names; the others are put over it.
        np.add(first, ids, out=place)
        shares.share.take(place, out=width, mode="clip")
        shares.below.take(place, out=start, mode="clip")
        np.multiply(width, rest, out=width)
        np.multiply(start, rest, out=start)
        np.add(start, reach2, out=start)
        np.add(start, reach1, out=start)
        np.putmask(start, only1, reach2)
        np.putmask(start, hit[0], zero)
        np.putmask(width, only1, reach1)
        np.putmask(width, hit[0], reach2)
        np.right_shift(span, unit_bits, out=span)
        np.multiply(start, span, out=start)
        np.add(low, start, out=low)
        np.multiply(span, width, out=span)
        np.less(span, few, out=small)
        due = small.nonzero()[0]
        while due.size:
            value, wide = low[due], span[due] << scale
            owners.append(due.astype(np.uint16))
            digits.append((value >> digit_bits).astype(np.uint32))  # 17 bits: a carry is settled below
            low[due] = (value & keep) << scale
            span[due] = wide
            due = due[wide < FEW]
        model.learn(ids, (ids << 2) + 1, hit, only1)
    end = (low >> U(30)) + U(1)
    owners += [np.arange(lanes, dtype=np.uint16)] * 2
    digits += [(end >> scale).astype(np.uint32), (end & U(0xFFFF)).astype(np.uint32)]
    del model, ids
    owner, flat = np.concatenate(owners), np.concatenate(digits)
    del owners, digits
    flat = flat[np.argsort(owner, kind="stable")]
    while (over := flat >> 16).any():
        flat &= 0xFFFF
        flat[:-1] += over[1:]
    body, ends = flat.astype("<u2").tobytes(), 2 * np.cumsum(np.bincount(owner, minlength=lanes))
    return [body[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]


def _read_blocks(bodies: list[bytes], steps: int, shares: _Shares, shard: np.ndarray) -> np.ndarray:
    lanes, cap = len(bodies), max(map(len, bodies)) // 2 + 13
    digits = np.zeros((lanes, cap), np.uint16)
    for i, body in enumerate(bodies):
        digits[i, : len(body) // 2] = np.frombuffer(body, "<u2")
    digits = digits.ravel()
    fine, first = np.array(shares.fine, U)[shard], shares.first[shard]
    model, (owner, units) = _Lanes(lanes, fine), shares.owners()
    units = units[shard]
    pos = np.arange(lanes, dtype=np.int64) * cap
    most = pos + cap - 1
    code = np.zeros(lanes, U)
    for _ in range(4):
        code = (code << U(16)) | digits[pos].astype(U)
        pos += 1
    span = np.full(lanes, 1 << 62, U)
    unit_bits, few, two, zero, scale = fine + U(16), np.full(lanes, FEW), np.full(lanes, 2, U), np.zeros(lanes, U), U(16)
    value, start, width, both = (np.empty(lanes, U) for _ in range(4))
    unit, place = np.empty(lanes), np.empty(lanes, np.int64)
    hit, only1, known, small = np.empty((2, lanes), bool), np.empty(lanes, bool), np.empty(lanes, bool), np.empty(lanes, bool)
    out = np.empty((steps, lanes), np.int32)
    for ids in out:
        reach2, reach1, rest = model.predict()
        np.right_shift(span, unit_bits, out=span)
        np.right_shift(code, two, out=value)
        np.floor_divide(value, span, out=value)
        np.add(reach2, reach1, out=both)
        np.less(value, reach2, out=hit[0])
        np.less(value, both, out=known)
        np.greater(known, hit[0], out=only1)
        # Of an id that no order names; the others are put over it.  Quotients below 2 ** 30 of divisors up to 2 ** 16:
        # rounding never reaches the next whole number.
        np.subtract(value, both, out=value)
        np.true_divide(value.view(np.int64), rest.view(np.int64), out=unit)
        np.copyto(place, unit, casting="unsafe")
        np.add(place, units, out=place)
        owner.take(place, out=ids, mode="clip")
        np.add(first, ids, out=place)
        shares.share.take(place, out=width, mode="clip")
        shares.below.take(place, out=start, mode="clip")
        np.multiply(width, rest, out=width)
        np.multiply(start, rest, out=start)
        np.add(start, both, out=start)
        np.putmask(ids, only1, model.named[1])
        np.putmask(ids, hit[0], model.named[0])
        np.putmask(start, only1, reach2)
        np.putmask(start, hit[0], zero)
        np.putmask(width, only1, reach1)
        np.putmask(width, hit[0], reach2)
        np.multiply(start, span, out=start)
        np.left_shift(start, two, out=start)
        np.subtract(code, start, out=code)
        np.multiply(span, width, out=span)
        np.less(span, few, out=small)
        due = small.nonzero()[0]
        while due.size:
            at, wide = pos[due], span[due] << scale
            code[due] = (code[due] << scale) | digits[np.minimum(at, most[due])]
            pos[due] = at + 1
            span[due] = wide
            due = due[wide < FEW]
        np.equal(model.named[1], ids, out=hit[1])
        model.learn(ids, (ids << 2) + 1, hit, only1)
    return out.T


def _kinds(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different ids in order, the rank of every id among them, and how often each occurs."""
    if not len(ids) or int(ids.max()) >= 1 << 22:
        return np.unique(ids, return_inverse=True, return_counts=True)
    counts = np.bincount(ids)
    kinds = np.flatnonzero(counts)
    rank = np.zeros(len(counts), np.int32)
    rank[kinds] = np.arange(len(kinds))
    return kinds.astype(np.uint32), rank[ids], counts[kinds]


def _checksum(ids: np.ndarray, body: bytes) -> int:
    return zlib.crc32(body, zlib.crc32(ids.astype("<u4").tobytes()))


def pack_shards(shards: list[tuple[list[int | None], list[int], np.ndarray]], block: int = BLOCK) -> list[bytes]:
    """The bytes of each shard: the names of its documents, how many ids each has, and the ids of all in a row."""
    shards = [(docs, lengths, ids if ids.dtype == np.uint16 else ids.astype(np.uint32, copy=False)) for docs, lengths, ids in shards]
    tables, kinds, parts, padded = [], [], [], []
    for _, _, ids in shards:
        names, ranks, counts = _kinds(ids)
        n = -(-len(ids) // block)
        steps = len(ids) if n == 1 else block
        kinds.append(len(names))
        parts.append(shares(counts, _fine(len(names))) if n else np.zeros(0, np.int64))
        tables.append(zlib.compress(np.diff(names, prepend=np.uint32(0)).astype("<u4").tobytes() + parts[-1].astype("<u4").tobytes()) if n else b"")
        blocks = np.zeros(n * steps, np.uint16 if len(names) <= 1 << 16 else np.int32)
        blocks[: len(ids)] = ranks
        del ranks
        padded.append(blocks.reshape(n, steps))
    bodies: list[list[bytes]] = [[] for _ in shards]
    for some in _groups([(b.shape[1], len(b)) for b in padded]):
        order0, shard = _order0(some, parts, kinds)
        ranks = np.empty((padded[some[0][0]].shape[1], len(shard)), np.int32)
        for (i, a, b), columns in zip(some, _by_shard(ranks.T, some), strict=True):
            columns[:] = padded[i][a:b]
        for (i, _, _), found in zip(some, _by_shard(_write_blocks(ranks, order0, shard), some), strict=True):
            bodies[i] += found
    return [_whole(*x, block) for x in zip(shards, tables, kinds, bodies, strict=True)]


def _groups(shapes: list[tuple[int, int]]) -> list[list[tuple[int, int, int]]]:
    """What is coded at once, LANES blocks of one length at most: (shard, its first block, the block after its last).

    ``shapes``: length and number of the blocks of each shard.
    """
    groups = []
    for steps in sorted({length for length, n in shapes if n}):
        room = 0
        for i, (length, n) in enumerate(shapes):
            at = 0
            while length == steps and at < n:
                if not room:
                    groups.append([])
                    room = LANES
                to = min(n, at + room)
                groups[-1].append((i, at, to))
                room, at = room - (to - at), to
    return groups


def _order0(some: list[tuple[int, int, int]], parts: list[np.ndarray], kinds: list[int]) -> tuple[_Shares, np.ndarray]:
    order0 = _Shares([parts[i] for i, _, _ in some], [_fine(kinds[i]) for i, _, _ in some])
    return order0, np.repeat(np.arange(len(some)), [b - a for _, a, b in some])


def _by_shard(rows, some: list[tuple[int, int, int]]) -> list:
    ends = np.cumsum([b - a for _, a, b in some]).tolist()
    return [rows[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def _whole(shard: tuple, tables: bytes, kinds: int, bodies: list[bytes], block: int) -> bytes:
    doc_ids, lengths, ids = shard
    index = zlib.compress(
        np.array([d is None for d in doc_ids], np.uint8).tobytes()
        + np.array([d or 0 for d in doc_ids], "<i8").tobytes() + np.array(lengths, "<i8").tobytes()
    )
    sums = [_checksum(ids[i * block : (i + 1) * block], body) for i, body in enumerate(bodies)]
    sizes = np.array([len(b) for b in bodies], "<u4").tobytes() + np.array(sums, "<u4").tobytes()
    rest = tables + index + sizes
    fields = (len(ids), len(doc_ids), block, kinds, len(tables), len(index))
    crc = zlib.crc32(rest, zlib.crc32(struct.pack("<QQIIQQ", *fields)))
    return HEAD.pack(MAGIC, crc, *fields) + rest + b"".join(bodies)


def pack_shard(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray, block: int = BLOCK) -> bytes:
    """The bytes of one shard."""
    return pack_shards([(doc_ids, lengths, ids)], block)[0]


class _Opened:
    """A shard's head, checked, and the bytes of its blocks."""

    def __init__(self, data: bytes):
        if len(data) < HEAD.size:
            raise DamagedShard("shorter than a head")
        magic, crc, self.n_ids, n_docs, self.block, self.kinds, in_tables, in_index = HEAD.unpack_from(data)
        if magic != MAGIC or not self.block:
            raise DamagedShard("not a shard")
        n = -(-self.n_ids // self.block)
        at = HEAD.size + in_tables + in_index
        rest = data[HEAD.size : at + 8 * n]
        if zlib.crc32(rest, zlib.crc32(data[12 : HEAD.size])) != crc:
            raise DamagedShard("the head does not agree with its checksum")
        index = zlib.decompress(rest[in_tables : in_tables + in_index])
        empty = np.frombuffer(index, np.uint8, n_docs)
        names, self.lengths = np.frombuffer(index, "<i8", 2 * n_docs, n_docs).reshape(2, n_docs)
        self.docs = [None if e else int(d) for e, d in zip(empty, names, strict=True)]
        tables = np.frombuffer(zlib.decompress(rest[:in_tables]) if n else b"", "<u4")
        self.of_rank, self.parts = np.cumsum(tables[: self.kinds], dtype=np.uint32), tables[self.kinds :].astype(np.int64)
        sizes, self.sums = np.frombuffer(data, "<u4", 2 * n, at).reshape(2, n)
        ends = at + 8 * n + np.cumsum(sizes, dtype=np.int64)
        self.bodies = [data[end - size : end] for end, size in zip(ends.tolist(), sizes.tolist(), strict=True)]
        self.steps = self.n_ids if n == 1 else self.block
        self.ids = np.empty(n * self.steps, np.uint32)

    def take(self, first: int, ranks: np.ndarray) -> None:
        blocks = self.ids.reshape(-1, self.steps)
        for at in range(0, len(ranks), 64):
            some = ranks[at : at + 64]
            blocks[first + at : first + at + len(some)] = self.of_rank[np.minimum(some, self.kinds - 1)]

    def checked(self) -> tuple[list[int | None], np.ndarray, np.ndarray]:
        ids = self.ids[: self.n_ids]
        for i, body in enumerate(self.bodies):
            if _checksum(ids[i * self.block : (i + 1) * self.block], body) != self.sums[i]:
                raise DamagedShard(f"block {i} does not agree with its checksum")
        return self.docs, self.lengths, ids


def open_shards(shards: list[bytes]) -> list[tuple[list[int | None], np.ndarray, np.ndarray]]:
    """(doc ids, lengths, ids) of the bytes of each shard; raises DamagedShard if a checksum does not hold."""
    opened = [_Opened(data) for data in shards]
    for some in _groups([(x.steps, len(x.bodies)) for x in opened]):
        order0, shard = _order0(some, [x.parts for x in opened], [x.kinds for x in opened])
        ranks = _read_blocks([body for i, a, b in some for body in opened[i].bodies[a:b]], opened[some[0][0]].steps, order0, shard)
        for (i, first, _), own in zip(some, _by_shard(ranks, some), strict=True):
            opened[i].take(first, own)
    return [x.checked() for x in opened]


def open_shard(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """(doc ids, lengths, ids) of the bytes of one shard."""
    return open_shards([data])[0]
