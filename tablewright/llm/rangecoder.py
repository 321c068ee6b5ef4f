"""An adaptive range coder for token ids whose models mix predictions of order 0, 1 and 2.

Ids are cut into blocks of BLOCK; each block starts from fresh models and ends in its own
checksum, so it can be decoded alone. Orders 1 and 2 predict the id that last followed the one
or two ids before, with a confidence: how often in a row it has. Order 0 is the file's table of
frequencies. An id's share is the sum of what each order gives it, by weights that adapt in each
block: a set of its own for either confidence and whether both predictions agree. What is coded
is which prediction holds under these weights; if none does, the id follows under order 0.

Blocks of one file go in lockstep: step t codes the t-th id of every block at once, so each
numpy call works on as many lanes as there are blocks. All is integer arithmetic, which gives
the same results on every machine. Tables are small (SLOTS) and calls few, as what a step costs
is memory out of reach of the caches and the calls themselves.

The coder's range has 63 bits and gives 32 at a time; the encoder adds carries at the end.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

BLOCK, LANES = 4096, 2048
MAGIC = b"TWIDS\x00\x02\n"
SLOTS = 10  # bits of a prediction table
SYMBOLS = 12  # bits of a total of the weights
U, U32 = np.uint64, np.uint32
LOW31, LOW32 = U(0x7FFFFFFF), U(0xFFFFFFFF)
SURE = U32(3)  # the bits of a slot that say how sure it is
GROWN = np.array([1, 2, 3, 3, 0], U32)  # the next confidence, by the last one where a prediction held; 4: it didn't
LEAST = U32(16)  # least weight of orders 1 and 2
GAIN = np.array([1984 << 16, 1984, 0], U32)  # what the weight of the order that held gains, 16 bits for each


class CorruptFile(ValueError):
    """A checksum, a length or the magic is wrong."""


class Models:
    """State of all lanes; predict() and learn() alternate. A slot of a prediction table holds an
    id and, in its lowest 2 bits, how sure it is; a row of weights those of order 2 and 1."""

    def __init__(self, lanes: int) -> None:
        lane = np.arange(lanes)
        self.base, self.row = lane << SLOTS, lane << 5
        self.one, self.two = np.zeros(lanes << SLOTS, U32), np.zeros(lanes << SLOTS, U32)
        self.weights = np.zeros(lanes << 5, U32)
        self.last, self.before = np.zeros(lanes, U32), np.zeros(lanes, U32)

    def drop(self) -> None:
        """The last lane has ended."""
        self.base, self.row, self.last, self.before = self.base[:-1], self.row[:-1], self.last[:-1], self.before[:-1]

    def predict(self) -> tuple[np.ndarray, np.ndarray]:
        """Where the share of order 2 ends and where that of order 1 does, in 1 << SYMBOLS."""
        h = self.last * U32(2654435761)
        self.at1 = (h >> U32(32 - SLOTS)) + self.base
        h ^= self.before
        h *= U32(3266489917)
        self.at2 = (h >> U32(32 - SLOTS)) + self.base
        self.got1, self.got2 = a, b = self.one.take(self.at1, mode="clip"), self.two.take(self.at2, mode="clip")
        k = b & SURE
        k <<= U32(2)
        k |= a & SURE
        k |= ((a ^ b) <= SURE).view(np.uint8) << np.uint8(4)
        self.at = k + self.row
        self.weight = w = self.weights.take(self.at, mode="clip")
        # weights tend to 1984 << 5 in sum, so order 0 always keeps a share
        two = (w >> U32(20)) + LEAST
        one = (w >> U32(4)) & U32(0xFFF)
        one += LEAST
        one += two
        return two.astype(U), one.astype(U)

    def learn(self, ids: np.ndarray, s: np.ndarray) -> None:
        w = self.weight
        w -= (w >> U32(5)) & U32(0x07FF07FF)
        w += GAIN.take(s, mode="clip")
        self.weights[self.at] = w
        x = ids << U32(2)
        for table, at, got in ((self.one, self.at1, self.got1), (self.two, self.at2, self.got2)):
            got ^= x
            table[at] = GROWN.take(np.minimum(got, U32(4), out=got), mode="clip") + x
        self.before, self.last = self.last, ids


def frequencies(ids: np.ndarray) -> np.ndarray:
    """Order-0 counts, scaled to a total of 1 << 20 (1 << 24 for many different ids), at least 1
    for each id that occurs."""
    counts = np.bincount(ids) if len(ids) else np.ones(1, np.int64)
    n = int((counts > 0).sum())
    bits = 20 if n <= 1 << 18 else 24
    room = (1 << bits) - n
    f = np.where(counts > 0, 1 + counts * room // counts.sum(), 0)
    f[int(f.argmax())] += (1 << bits) - int(f.sum())
    return f.astype(np.uint32)


def _bounds(f: np.ndarray) -> tuple[np.ndarray, np.uint64]:
    """Sums before each frequency, and the bits of their total."""
    cum = np.concatenate(([0], np.cumsum(f, dtype=U))).astype(U)
    return cum, U(int(cum[-1]).bit_length() - 1)


def _runs(count: int) -> list[tuple[int, int, int]]:
    """Steps (from, to) and the lanes that have them: the last block may be short."""
    n, rest = -(-count // BLOCK), count % BLOCK
    runs = [(0, rest, n), (rest, BLOCK, n - 1)] if rest else [(0, BLOCK, n)]
    return [r for r in runs if r[2]]


def encode(ids: np.ndarray) -> bytes:
    """The file body of an array of ids (below 2**30)."""
    ids = np.ascontiguousarray(ids, np.uint32)
    f = frequencies(ids)
    table = zlib.compress(f.astype("<u4").tobytes(), 6)
    cum, bits = _bounds(f)
    n = -(-len(ids) // BLOCK)
    out = [MAGIC, struct.pack("<QIII", len(ids), n, len(table), zlib.crc32(table)), table]
    for i in range(0, n, LANES):
        out += _encode_lanes(ids[i * BLOCK : (i + LANES) * BLOCK], f.astype(U), cum, bits)
    return b"".join(out)


def _encode_lanes(ids: np.ndarray, f: np.ndarray, cum: np.ndarray, bits: np.uint64) -> list[bytes]:
    n = -(-len(ids) // BLOCK)
    grid = np.zeros((n, BLOCK), U32)
    grid.reshape(-1)[: len(ids)] = ids
    grid = np.ascontiguousarray(grid.T)
    words = np.zeros((n, BLOCK + 4), U)
    flat = words.reshape(-1)
    at = np.arange(n) * (BLOCK + 4)
    low, size = np.zeros(n, U), np.full(n, LOW31 << U(32), U)
    m = Models(n)
    for begin, end, lanes in _runs(len(ids)):
        if lanes < n:
            m.drop()
        lo, sz, to = low[:lanes], size[:lanes], at[:lanes]
        for t in range(begin, end):
            x = grid[t, :lanes]
            two, one = m.predict()
            g = x << U32(2)  # 0: order 2 holds, 1: order 1, 2: neither
            s = ((g ^ m.got1) > SURE).view(np.uint8) + np.uint8(1)
            s *= ((g ^ m.got2) > SURE).view(np.uint8)
            past1, past2 = s > 0, s > 1
            esc = past2.nonzero()[0]
            a, e = two * past1, np.where(past1, one, two)
            a[esc] = one[esc]
            e[esc] = 1 << SYMBOLS
            sz >>= U(SYMBOLS)
            lo += sz * a
            sz *= e - a
            y = x[esc]
            r = sz[esc] >> bits
            lo[esc] += r * cum[y]
            sz[esc] = r * f[y]
            go = (sz <= LOW31).nonzero()[0]
            k, v = to[go], lo[go]
            flat[k] = v >> U(31)
            to[go] = k + 1
            lo[go] = (v & LOW31) << U(32)
            sz[go] <<= U(32)
            m.learn(x, s)
    for _ in range(2):
        flat[at] = low >> U(31)
        low = (low & LOW31) << U(32)
        at += 1
    lengths = at - np.arange(n) * (BLOCK + 4)
    words = words[:, : int(lengths.max())]
    while (carry := words >> U(32)).any():
        words &= LOW32
        words[:, :-1] += carry[:, 1:]
    out = []
    for i in range(n):
        body = words[i, : lengths[i]].astype("<u4").tobytes()
        out.append(struct.pack("<III", min(BLOCK, len(ids) - i * BLOCK), len(body), zlib.crc32(body)) + body)
    return out


def decode(data: bytes) -> np.ndarray:
    """The ids of a file body; CorruptFile where a checksum doesn't hold."""
    head = len(MAGIC) + 20
    if data[: len(MAGIC)] != MAGIC or len(data) < head:
        raise CorruptFile("not a file of this format")
    total, n, size, crc = struct.unpack("<QIII", data[len(MAGIC) : head])
    table = data[head : head + size]
    if zlib.crc32(table) != crc:
        raise CorruptFile("frequency table")
    f = np.frombuffer(zlib.decompress(table), "<u4").astype(U)
    cum, bits = _bounds(f)
    at, blocks = head + size, []
    for i in range(n):
        if len(data) < at + 12:
            raise CorruptFile(f"block {i} is missing")
        count, length, crc = struct.unpack("<III", data[at : at + 12])
        body = data[at + 12 : at + 12 + length]
        if len(body) != length or zlib.crc32(body) != crc:
            raise CorruptFile(f"block {i}")
        if count != min(BLOCK, total - i * BLOCK):
            raise CorruptFile(f"size of block {i}")
        blocks.append(np.frombuffer(body, "<u4"))
        at += 12 + length
    if at != len(data):
        raise CorruptFile("more than its blocks")
    find = np.repeat(np.arange(len(f), dtype=U32), f.astype(np.int64)) if bits <= 20 else None
    parts = [_decode_lanes(blocks[i : i + LANES], min(LANES * BLOCK, total - i * BLOCK), f, cum, bits, find) for i in range(0, n, LANES)]
    return np.concatenate(parts) if parts else np.zeros(0, np.uint32)


def _decode_lanes(blocks: list[np.ndarray], count: int, f: np.ndarray, cum: np.ndarray, bits: np.uint64, find: np.ndarray | None) -> np.ndarray:
    n = len(blocks)
    words = np.zeros((n, max(map(len, blocks)) + 4), U)
    for i, w in enumerate(blocks):
        words[i, : len(w)] = w
    code = (words[:, 0] << U(31)) | (words[:, 1] >> U(1))
    # a state holds 63 bits, so what follows begins within a word
    words[:, :-1] = ((words[:, :-1] & U(1)) << U(31)) | (words[:, 1:] >> U(1))
    flat = words.reshape(-1)
    at = np.arange(n) * words.shape[1] + 1
    grid = np.zeros((BLOCK, n), U32)
    size = np.full(n, LOW31 << U(32), U)
    m = Models(n)
    for begin, end, lanes in _runs(count):
        if lanes < n:
            m.drop()
        co, sz, to = code[:lanes], size[:lanes], at[:lanes]
        for t in range(begin, end):
            two, one = m.predict()
            sz >>= U(SYMBOLS)
            past1, past2 = co >= sz * two, co >= sz * one
            s = past1.view(np.uint8) + past2.view(np.uint8)
            x = np.where(past1, m.got1, m.got2)
            x >>= U32(2)
            esc = past2.nonzero()[0]
            a, e = two * past1, np.where(past1, one, two)
            a[esc] = one[esc]
            e[esc] = 1 << SYMBOLS
            co -= sz * a
            sz *= e - a
            r = sz[esc] >> bits
            c = co[esc]
            v = c // r
            y = find.take(v.view(np.int64), mode="clip") if find is not None else np.searchsorted(cum, v, "right") - 1
            x[esc] = y
            co[esc] = c - r * cum[y]
            sz[esc] = r * f[y]
            go = (sz <= LOW31).nonzero()[0]
            k = to[go]
            co[go] = (co[go] << U(32)) | flat[k]
            to[go] = k + 1
            sz[go] <<= U(32)
            grid[t, :lanes] = x
            m.learn(x, s)
    return np.ascontiguousarray(grid.T).reshape(-1)[:count]
