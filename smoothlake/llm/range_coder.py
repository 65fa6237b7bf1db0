"""An adaptive context-mixing range coder for token ids, run on many blocks at once.

Each block starts from the same state and is coded on its own. Order zero is a table of the section's id
frequencies, which is written beside the blocks; the ids that followed the current two ids and the current one
when last seen in the block (orders two and one) are predicted with a confidence, the number of times in a row
that they were right. Adaptive shares, kept by both confidences and by whether the predictions agree, mix the
orders: ``ONE`` units between them, of which order zero has the rest. The mixture gives each id one interval
of 2^30, which a 64-bit range coder with 16-bit words narrows down to.

All blocks of a section advance by one id per step, so each step is a few array operations; encoder and decoder
run the same model code on the same integers.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

LANES = 2048  # blocks coded in step
LARGEST, SMALLEST = 2048, 256  # ids of a block; the last one of a section is filled up
SLOTS = 256  # remembered contexts of each order (a power of two)
ONE, UNIT = 1024, 20  # shares of the orders, log2 of one share
ID, SURE = (1 << 24) - 1, 1 << 24  # a slot: id + 1, and above it the confidence
LOW = 1 << 48  # of the coder's span


def block_size(n: int) -> int:
    """Ids of a block in a section of ``n``: a power of two, smaller where few ids would leave lanes idle."""
    return min(LARGEST, max(SMALLEST, 1 << (n // LANES).bit_length()))


class Frequencies:
    """Order zero: shares of the ids that occur, 2^UNIT in all."""

    def __init__(self, ids: np.ndarray, counts: np.ndarray):
        self.ids, whole = ids, 1 << UNIT
        f = 1 + counts.astype(np.int64) * (whole - len(ids)) // int(counts.sum())
        f[np.argmax(f)] += whole - f.sum()
        self.ends = np.concatenate(([0], np.cumsum(f))).astype(np.uint64)
        self.counts = counts

    @classmethod
    def of(cls, ids: np.ndarray) -> Frequencies:
        counts = np.bincount(ids)
        found = np.flatnonzero(counts)
        n = counts[found]
        # what is written: counts of at most 2^16, which decide the shares
        return cls(found, np.maximum(n * min(1.0, 65535 / n.max()), 1).astype(np.int64))

    def pack(self) -> bytes:
        steps = np.diff(self.ids, prepend=0).astype("<u4")
        return zlib.compress(steps.tobytes() + (self.counts - 1).astype("<u2").tobytes(), 6)

    @classmethod
    def unpack(cls, packed: bytes) -> Frequencies:
        raw = zlib.decompress(packed)
        n = len(raw) // 6
        return cls(np.cumsum(np.frombuffer(raw[: 4 * n], "<u4").astype(np.int64)), np.frombuffer(raw[4 * n :], "<u2").astype(np.int64) + 1)

    def by_id(self) -> tuple[np.ndarray, np.ndarray]:
        """(first share, shares) of each id."""
        first, size = np.zeros(int(self.ids[-1]) + 1, np.uint64), np.zeros(int(self.ids[-1]) + 1, np.uint64)
        first[self.ids], size[self.ids] = self.ends[:-1], np.diff(self.ends)
        return first, size

    def by_share(self) -> np.ndarray:
        """The place among the ids of each share."""
        return np.repeat(np.arange(len(self.ids), dtype=np.uint32), np.diff(self.ends).astype(np.int64))


def _shares() -> np.ndarray:
    """The shares of orders two and one that a block begins with, by context: agreement, confidence of either."""
    begin = np.array([0, 64, 256, 512])
    two = np.broadcast_to(begin[None, :, None], (2, 4, 4))
    one = np.minimum(begin, 900 - two) * np.array([1, 0])[:, None, None]
    return np.stack([two.ravel(), one.ravel()])


def _constants(kind, *values) -> list[np.ndarray]:
    """As arrays, which cost less per operation than scalars."""
    return [np.array(v, kind) for v in values]


class Model:
    """The state of all blocks of a section. Rows of two: order two, order one."""

    def __init__(self, lanes: int):
        at = np.arange(lanes)
        self.slots, self.contexts = np.stack([at, at + lanes]) * SLOTS, np.stack([at, at + lanes]) * 32
        self.after = np.zeros(2 * lanes * SLOTS, np.uint32)
        self.shares = np.repeat(_shares().astype(np.int16)[:, None, :], lanes, axis=1).ravel()
        self.last, self.older, self.h = np.zeros(lanes, np.uint32), np.zeros(lanes, np.uint32), np.zeros((2, lanes), np.uint32)
        self.k1, self.k2, self.mid, self.down, self.id, self.sure, self.most, self.conf = _constants(np.uint32, 2654435761, 2246822519, 15, 33 - SLOTS.bit_length(), ID, SURE, 3 * SURE, 24)
        self.four, self.agree = _constants(np.int64, 4, 16)
        self.full, self.rate = _constants(np.int16, ONE - 16, 4)
        self.one, self.unit = _constants(np.int64, ONE, UNIT)

    def predict(self) -> None:
        h = self.h
        np.multiply(self.last, self.k1, out=h[1])
        np.bitwise_xor(h[1], h[1] >> self.mid, out=h[0])
        h[0] += self.older * self.k2
        self.i = self.slots + (h >> self.down)
        self.e = self.after.take(self.i, mode="clip")
        self.p = p = self.e & self.id
        c = self.e >> self.conf
        self.context = self.contexts + (c[0] * self.four + c[1] + (p[0] == p[1]) * self.agree)
        self.f = self.shares.take(self.context, mode="clip")
        self.both = (self.f[0] + self.f[1]).astype(np.int64)

    def update(self, ids: np.ndarray, seen: np.ndarray, hit: np.ndarray) -> None:
        self.after[self.i] = np.where(hit, np.minimum(self.e + self.sure, seen | self.most), seen | self.sure)
        hit[1] &= ~hit[0]
        self.shares[self.context] = self.f + ((hit * self.full - self.f) >> self.rate)
        self.older, self.last = self.last, ids


def encode(blocks: np.ndarray, f: Frequencies) -> list[bytes]:
    """One byte string per row of ``blocks`` ([n, steps] of uint32 ids below 2^24 - 1, all of them in ``f``)."""
    lanes, steps = blocks.shape
    m = Model(lanes)
    first, size = f.by_id()
    low, span = np.zeros(lanes, np.uint64), np.full(lanes, 0xFFFFFFFFFFFFFFFF, np.uint64)
    width = steps * 2 + 32  # an id takes at most 30 bits
    at = np.arange(lanes)
    words, n = np.zeros(lanes * width, np.uint16), at * width
    columns = np.ascontiguousarray(blocks.T)
    after = columns + np.uint32(1)
    whole, word, rest, least = _constants(np.uint64, 30, 16, 48, LOW)
    (next_word,) = _constants(np.int64, 1)
    for step in range(steps):
        ids, seen = columns[step], after[step]
        m.predict()
        hit = seen == m.p
        f0 = (m.one - m.both).view(np.uint64)
        start = f0 * first.take(ids)
        start += (m.both << m.unit).view(np.uint64)
        share = f0 * size.take(ids)
        by = np.flatnonzero(hit[0] | hit[1])
        if len(by):  # predicted, and with a share
            two, (f2, f1) = hit[0, by], m.f[:, by]
            mine = np.where(two, f2, f1).astype(np.int64)
            some = mine > 0
            by, mine, before = by[some], mine[some], np.where(two, 0, f2)[some].astype(np.int64)
            start[by], share[by] = (before << m.unit).view(np.uint64), (mine << m.unit).view(np.uint64)
        unit = span >> whole
        start *= unit
        new = low + start
        over = np.flatnonzero(new < low)
        low, span = new, unit * share
        if len(over):
            p = n[over] - 1
            while len(p):  # a carry runs back through the words already out
                words[p] += np.uint16(1)
                p = p[words[p] == 0] - 1
        m.update(ids, seen, hit)
        small = np.flatnonzero(span < least)
        while len(small):
            lo, to, wide = low.take(small), n.take(small), span.take(small) << word
            words[to] = lo >> rest
            n[small] = to + next_word
            low[small] = lo << word
            span[small] = wide
            small = small[wide < least]
    for _ in range(4):
        words[n] = low >> rest
        n += 1
        low = low << word
    return [words[i * width : n[i]].astype("<u2").tobytes() for i in range(lanes)]


def decode(parts: list[bytes], steps: int, f: Frequencies) -> np.ndarray:
    """The inverse of ``encode``: [len(parts), steps] of ids."""
    lanes = len(parts)
    m = Model(lanes)
    of_share, ids_of = f.by_share(), f.ids.astype(np.uint32)
    first, size = f.ends[:-1].copy(), np.diff(f.ends)
    width = max(len(p) for p in parts) // 2 + 4
    words = np.zeros(lanes * width, np.uint16)
    for i, p in enumerate(parts):
        words[i * width : i * width + len(p) // 2] = np.frombuffer(p, "<u2", len(p) // 2)
    at = np.arange(lanes)
    n = at * width
    code = np.zeros(lanes, np.uint64)
    whole, word, least, top, none = _constants(np.uint64, 30, 16, LOW, (1 << 30) - 1, 0)
    for _ in range(4):
        code = (code << word) | words.take(n)
        n += 1
    span = np.full(lanes, 0xFFFFFFFFFFFFFFFF, np.uint64)
    out = np.empty((steps, lanes), np.uint32)
    (one,) = _constants(np.uint32, 1)
    (next_word,) = _constants(np.int64, 1)
    for step in range(steps):
        m.predict()
        unit = span >> whole
        v = np.minimum(code // unit, top)
        f0 = (m.one - m.both).view(np.uint64)
        before = (m.both << m.unit).view(np.uint64)
        predicted = v < before
        by = np.flatnonzero(predicted)
        v0 = v - before
        v0[by] = none
        place = of_share.take(v0 // f0, mode="clip")
        start, share = f0 * first.take(place), f0 * size.take(place)
        start += before
        ids = ids_of.take(place)
        if len(by):
            f2, f1 = m.f[:, by]
            two = (v[by].view(np.int64) >> m.unit) < f2
            p = m.p[:, by]
            ids[by] = np.where(two, p[0], p[1]) - one
            start[by] = (np.where(two, 0, f2).astype(np.int64) << m.unit).view(np.uint64)
            share[by] = (np.where(two, f2, f1).astype(np.int64) << m.unit).view(np.uint64)
        start *= unit
        code -= start
        span = unit * share
        seen = ids + one
        m.update(ids, seen, seen == m.p)
        out[step] = ids
        small = np.flatnonzero(span < least)
        while len(small):
            take, wide = n.take(small), span.take(small) << word
            code[small] = (code.take(small) << word) | words.take(take, mode="clip")
            n[small] = take + next_word
            span[small] = wide
            small = small[(wide < least) & (wide > none)]
    return np.ascontiguousarray(out.T)


HEADER = struct.Struct("<QIII")  # ids, ids of a block, blocks, bytes of the frequencies


def encode_section(ids: np.ndarray) -> bytes:
    """A section: header, checksum of what stands before the blocks, frequencies, a table of the blocks (bytes and
    CRC-32 of the ids and those bytes), the blocks."""
    size = block_size(len(ids))
    blocks = -(-len(ids) // size)
    filled = np.full(blocks * size, ids[-1], np.uint32)
    filled[: len(ids)] = ids
    f = Frequencies.of(ids)
    parts = encode(filled.reshape(blocks, size), f)
    sums = [zlib.crc32(p, zlib.crc32(ids[i * size : (i + 1) * size].astype("<u4").tobytes())) for i, p in enumerate(parts)]
    packed, table = f.pack(), np.array([[len(p) for p in parts], sums], "<u4").T.tobytes()
    head = HEADER.pack(len(ids), size, blocks, len(packed))
    return head + struct.pack("<I", zlib.crc32(head + packed + table)) + packed + table + b"".join(parts)


def decode_section(read) -> bytes:
    """The ids (little-endian unsigned 32-bit bytes) of the section that ``read(n)`` gives the bytes of; a
    ValueError where anything fails its checksum."""

    def whole(n: int) -> bytes:
        got = read(n)
        if len(got) < n:
            raise ValueError("a section is cut short")
        return got

    head = whole(HEADER.size)
    (check,) = struct.unpack("<I", whole(4))
    n, size, blocks, packed = HEADER.unpack(head)
    freq, table = whole(packed), whole(8 * blocks)
    if zlib.crc32(head + freq + table) != check:
        raise ValueError("the head of a section fails its checksum")
    lengths, sums = np.frombuffer(table, "<u4").reshape(blocks, 2).T.tolist()
    parts = [whole(k) for k in lengths]
    with np.errstate(divide="ignore"):  # spans of a damaged block may come to nothing
        ids = decode(parts, size, Frequencies.unpack(freq)).astype("<u4", copy=False).reshape(-1)[:n].tobytes()
    for i, want in enumerate(sums):
        if zlib.crc32(parts[i], zlib.crc32(ids[4 * i * size : 4 * (i + 1) * size])) != want:
            raise ValueError(f"block {i} of a section fails its checksum")
    return ids
