"""Token-id files: documents in blocks of an adaptive context-mixing range code.

A file is a head and then blocks, one after another, each a byte string of its own:

    head    "PWDOCS2\\0", number of documents and of ids (8 bytes each), size and crc32 of
            the table (4 bytes each), table: deflated doc_ids, null flags and lengths
    block   "PWIDS2\\0\\0", number of ids, number of lanes, size of the alphabet, crc32 of
            the ids as little-endian 32-bit numbers, crc32 of the rest, size of the rest
            (4 bytes each); the rest: deflated alphabet, words of each lane (16 bits each),
            range code

Every block starts with fresh models, so any block can be read alone and damage stays
inside it.  Three models predict the next id: counts of what followed the last two ids
(order 2, hashed contexts with a check), of what followed the last id (order 1), and of
all ids so far (order 0).  Each id's probability is the weighted sum of the three, and
the weights follow, for each pair of confidences, what each order has been worth.  The
mixed distribution drives a 48-bit range coder.

A block's ids are cut into lanes, stretches that advance in step: at each step every lane
codes one id under the same models, which then learn from all lanes.  A step is a few
dozen array operations, in integers only, that reader and writer do alike.  The number
of lanes follows the block's length; models and their adaption are the same at any."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np

DOCS_MAGIC, MAGIC = b"PWDOCS2\0", b"PWIDS2\0\0"
BLOCK = 1 << 22  # most ids of a block
LANES = 4096
LANE_IDS = 512  # ids a lane, where the block is too short for all lanes
_K2, _K1 = 1, 4  # ids that an order-2 and an order-1 context remembers
_ROW = {2: np.uint64, 4: np.complex128}[_K1]  # a number as wide as an order-1 row
_KEPT = _K2 + _K1
_SLOTS = 1 << 16  # order-2 contexts
_TOP = 250  # counts are halved beyond
_MIX, _BASE = 12, 18  # bits of the mixed candidates' total and of the order-0 total
_ALL = (1 << _MIX) - 64  # the rest of the total is always left to order 0
_FULL, _LOW = (1 << 48) - 1, 1 << 32
_LEVELS = np.digitize(np.arange(_K1 * (_TOP + 8)), [1, 2, 3, 5, 9, 20, 60]).astype(np.int16)  # confidence by count
_PART = np.append(0, (1 << 12) // (4 * np.arange(1, _K1 * (_TOP + 8)) + 1)).astype(np.int32)
_CLIP = "clip"  # all places exist; without the check, look-ups are faster
_ID, _ONE, _SIXTEEN = np.uint32(0xFFFF), np.uint32(1 << 16), np.uint32(16)


class _Mixer:
    """The models of one block; reader and writer drive it alike.

    A context's row holds entries of a count (high 16 bits) and an id (low); an order-2
    row begins with its check.  ``e`` has the entries that the lanes are at as columns,
    order 2 first."""

    def __init__(self, alphabet: int, lanes: int):
        self.n, self.lanes = max(alphabet, _K1), lanes  # a blank row's ids exist
        self.blank = np.arange(_K1, dtype=np.uint32)  # count 0, ids that differ
        self.one = np.tile(self.blank, (self.n, 1))
        self.two = np.zeros((_SLOTS, _K2 + 1), np.uint32)
        # whole rows as single numbers, which move faster
        self.one_rows, self.two_rows = self.one.view(_ROW)[:, 0], self.two.view(np.uint64)[:, 0]
        self.a, self.b = np.zeros(lanes, np.uint32), np.zeros(lanes, np.uint32)
        self.weight = np.array([1200, 1800, 900], np.int32)[:, None].repeat(64, 1)  # order 2, 1, 0 by class
        self.count = np.ones(self.n, np.int64)
        self.recent: list[np.ndarray] = []
        self.step = 0
        self._refresh()

    def _refresh(self) -> None:
        """Order 0 moves up to all that has been seen."""
        if self.recent:
            self.count += 24 * np.bincount(np.concatenate(self.recent), minlength=self.n)
            self.recent = []
        f = 1 + self.count * ((1 << _BASE) - self.n) // self.count.sum()
        f[np.argmax(f)] += (1 << _BASE) - f.sum()
        self.base, self.below = f.astype(np.int32), (np.cumsum(f) - f).astype(np.int32)
        self.inverse = None

    def predict(self) -> None:
        """Candidates, their shares of the mixed total and where these end."""
        h = self.a * np.uint32(0x9E3779B1) + self.b * np.uint32(0x85EBCA6B)
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        self.slot, check = h >> np.uint32(16), h | np.uint32(1)
        self.check, row = check, self.two_rows.take(self.slot, mode=_CLIP).view(np.uint32)
        self.e = e = np.empty((_KEPT, self.lanes), np.uint32)
        np.multiply(row[1::2], row[::2] == check, out=e[0])
        e[_K2:] = self.one_rows.take(self.b, mode=_CLIP).view(np.uint32).reshape(-1, _K1).T
        self.cand = cand = (e & _ID).view(np.int32)
        count = (e >> _SIXTEEN).view(np.int32)
        n2, n1 = count[0], np.add.reduce(count[_K2:], 0)
        self.kind = (_LEVELS.take(n2, mode=_CLIP) << 3) + _LEVELS.take(n1, mode=_CLIP)
        w2, w1, self.w0 = self.weight.take(self.kind, 1, mode=_CLIP)
        self.g2, self.g1 = w2 * _PART.take(n2, mode=_CLIP), w1 * _PART.take(n1, mode=_CLIP)
        f = np.empty_like(count)
        np.multiply(count[:_K2], self.g2, out=f[:_K2])
        np.multiply(count[_K2:], self.g1, out=f[_K2:])
        f >>= 10
        # what both orders name is one candidate
        other = cand[_K2:] != cand[0]
        f[0] += np.add.reduce(f[_K2:], 0)
        f[_K2:] *= other
        f[0] -= np.add.reduce(f[_K2:], 0)
        zero = self.base.take(cand, mode=_CLIP)
        zero *= self.w0
        zero >>= _BASE
        zero[_K2:] *= other
        f += zero
        self.f, self.upto = f, f.copy()
        for k in range(1, _KEPT):
            self.upto[k] += self.upto[k - 1]

    def learn(self, ids: np.ndarray) -> None:
        """All models move on by the ids (uint32) that the lanes have coded."""
        if self.step % 16 == 0:
            self._reweigh(ids)
        e, fresh = self.e, ids | _ONE
        hit = (self.cand.view(np.uint32) == ids).view(np.uint8) * _ONE
        # of the two contexts' entries, what came counts one more, or else takes the
        # place of the rarest
        e[0] = np.where(hit[0], e[0] + _ONE, fresh)
        x, hit = e[_K2:], hit[_K2:]
        least = np.minimum.reduce(x, 0)
        change = (fresh - least) * (np.bitwise_or.reduce(hit, 0) == 0)
        hit += (x == least) * change
        x += hit
        if self.step % 4 == 0 and e.max() >= np.uint32(_TOP << 16):
            full = np.flatnonzero(np.maximum.reduce(e, 0) >= np.uint32(_TOP << 16))
            old = e[:, full]
            e[:, full] = (old >> np.uint32(17) << _SIXTEEN) | (old & _ID)
        row = np.empty((self.lanes, 2), np.uint32)
        row[:, 0], row[:, 1] = self.check, e[0]
        self.two_rows[self.slot] = row.view(np.uint64)[:, 0]
        self.one_rows[self.b] = np.ascontiguousarray(x.T).view(_ROW)[:, 0]
        self.a, self.b = self.b, ids
        self.recent.append(ids)
        self.step += 1
        if self.step < 16 or self.step % 16 == 0:
            self._refresh()

    def _reweigh(self, ids: np.ndarray) -> None:
        """Each order's weight moves to its part in the probabilities of what came."""
        count = (self.e >> _SIXTEEN).view(np.int32) * (self.cand.view(np.uint32) == ids)
        worth = np.stack([count[:_K2].sum(0) * self.g2 >> 2, count[_K2:].sum(0) * self.g1 >> 2, (self.base[ids].astype(np.int64) * self.w0 >> 10) + 1]).astype(np.int64)
        worth = (worth << 12) // worth.sum(0)
        part = np.stack([np.bincount(self.kind, w, 64) for w in worth]).astype(np.int64)  # whole numbers: exact sums
        total = part.sum(0)
        seen = total > 0
        aim = part[:, seen] * _ALL // total[seen]
        rate = np.minimum(total[seen] >> 12, 32)  # classes seen often move faster
        old = self.weight[:, seen].astype(np.int64)
        self.weight[:, seen] = np.maximum(old + ((aim - old) * rate >> 7), 16)
        over = np.maximum(self.weight.sum(0) - _ALL, 0)
        self.weight[self.weight.argmax(0), np.arange(64)] -= over


def _lanes(n: int) -> int:
    """Lanes of a block of ``n`` ids."""
    return max(1, min(LANES, n // LANE_IDS))


def _columns(ids: np.ndarray, lanes: int) -> np.ndarray:
    """Lanes as columns; the shorter ones end in 0."""
    short, more = divmod(len(ids), lanes)
    grid = np.zeros((short + (more > 0), lanes), ids.dtype)
    cut = more * (short + 1)
    if more:
        grid[:, :more] = ids[:cut].reshape(more, short + 1).T
    grid[:short, more:] = ids[cut:].reshape(lanes - more, short).T
    return grid


def _in_line(grid: np.ndarray, n: int) -> np.ndarray:
    """The ids that `_columns` has put into columns."""
    short, more = divmod(n, grid.shape[1])
    return np.concatenate([grid[:, :more].T.ravel() if more else grid[:0, 0], grid[:short, more:].T.ravel()])


def encode_block(ids: np.ndarray) -> bytes:
    """One block of at most BLOCK ids."""
    n = len(ids)
    alphabet = np.flatnonzero(np.bincount(ids, minlength=1))
    number = np.zeros(1 << 16, np.uint32)
    number[alphabet] = np.arange(len(alphabet))
    codes = number[ids]
    lanes = _lanes(n)
    grid = _columns(codes, lanes)
    steps = len(grid)
    m = _Mixer(len(alphabet), lanes)
    low, rng = np.zeros(lanes, np.int64), np.full(lanes, _FULL, np.int64)
    out, sent = [], []  # 16-bit words with carries still in them, and whose they are
    for t in range(steps):
        x = grid[t]
        m.predict()
        mine = m.f * (m.cand == x.view(np.int32))
        size = np.add.reduce(mine, 0)
        start = np.add.reduce((m.upto - m.f) * (mine > 0), 0)
        named, top = size > 0, m.upto[-1]
        rest = (1 << _MIX) - top
        start = np.where(named, start << _BASE, (top << _BASE) + rest * m.below.take(x, mode=_CLIP))
        size = np.where(named, size << _BASE, rest * m.base.take(x, mode=_CLIP))
        step = rng >> (_MIX + _BASE)
        if t == steps - 1 and n % lanes:  # lanes that have ended stay as they are
            size = size.astype(np.int64)
            start[n % lanes :], size[n % lanes :], step[n % lanes :] = 0, rng[n % lanes :], 1
        low += step * start
        rng = step * size
        while (small := rng < _LOW).any():
            lane = np.flatnonzero(small)
            sent.append(lane.astype(np.uint16))
            out.append((low.take(lane, mode=_CLIP) >> 32).astype(np.int32))
            low = np.where(small, (low & (_LOW - 1)) << 16, low)
            rng <<= small * np.int64(16)
        m.learn(x)
    out.append(((low + _LOW - 1) >> 32).astype(np.int32))  # the one number in the range that ends in zeros
    sent.append(np.arange(lanes, dtype=np.uint16))
    lane = np.concatenate(sent)
    code, words = np.concatenate(out)[np.argsort(lane, kind="stable")], np.bincount(lane, minlength=lanes)
    while (over := np.flatnonzero(code > 0xFFFF)).size:  # carries run to the left
        code[over] -= 1 << 16
        code[over - 1] += 1  # places that differ
    code = code.astype("<u2").tobytes()
    table = zlib.compress(np.diff(alphabet.astype(np.int64), prepend=-1).astype("<u2").tobytes(), 9)
    rest = len(table).to_bytes(4, "little") + table + words.astype("<u2").tobytes() + code
    head = [n, lanes, len(alphabet), zlib.crc32(ids.astype("<u4").tobytes()), zlib.crc32(rest), len(rest)]
    return MAGIC + np.array(head, "<u4").tobytes() + rest


def decode_block(raw: bytes, at: int = 0) -> tuple[np.ndarray, int]:
    """Ids of the block at ``at``, and where it ends; raises on damage."""
    if raw[at : at + 8] != MAGIC or len(raw) < at + 32:
        raise ValueError(f"no token block at byte {at}")
    n, lanes, symbols, crc, crc_rest, size = (int(x) for x in np.frombuffer(raw, "<u4", 6, at + 8))
    rest = raw[at + 32 : at + 32 + size]
    if len(rest) != size or zlib.crc32(rest) != crc_rest or lanes != _lanes(n):
        raise ValueError(f"damaged token block at byte {at}")
    cut = 4 + int.from_bytes(rest[:4], "little")
    alphabet = np.cumsum(np.frombuffer(zlib.decompress(rest[4:cut]), "<u2").astype(np.int64)) - 1
    words = np.frombuffer(rest, "<u2", lanes, cut).astype(np.int64)
    width = int(words.max()) + 4
    flat = np.zeros(lanes * width, np.uint16)
    flat.reshape(lanes, width)[np.arange(width) < words[:, None]] = np.frombuffer(rest, "<u2", -1, cut + 2 * lanes)
    read = np.arange(lanes) * width
    code = sum(flat[read + i].astype(np.int64) << 32 - 16 * i for i in range(3))
    read += 3
    last = np.arange(lanes) * width + width - 1
    rng = np.full(lanes, _FULL, np.int64)
    steps = -(-n // lanes)
    grid = np.zeros((steps, lanes), np.uint32)
    m = _Mixer(symbols, lanes)
    row = np.arange(lanes, dtype=np.int32)
    for t in range(steps):
        m.predict()
        step = rng >> (_MIX + _BASE)
        target = (code / step).astype(np.int32)  # exact: quotients are below 2^30 and steps 4 or more
        np.minimum(target, (1 << (_MIX + _BASE)) - 1, out=target)
        k = np.add.reduce(m.upto <= target >> _BASE, 0, dtype=np.int32)
        named = k < _KEPT
        where = np.minimum(k, _KEPT - 1) * np.int32(lanes) + row
        f, upto = m.f.ravel().take(where, mode=_CLIP), m.upto.ravel().take(where, mode=_CLIP)
        if m.inverse is None:
            m.inverse = np.repeat(np.arange(m.n, dtype=np.uint32), m.base)
        top = m.upto[-1]
        rest = (1 << _MIX) - top
        other = m.inverse.take((np.maximum(target - (top << _BASE), 0) / rest).astype(np.int32), mode=_CLIP)
        x = np.where(named, m.cand.ravel().take(where, mode=_CLIP).view(np.uint32), other)
        start = np.where(named, (upto - f) << _BASE, (top << _BASE) + rest * m.below.take(x, mode=_CLIP))
        size_ = np.where(named, f << _BASE, rest * m.base.take(x, mode=_CLIP))
        if t == steps - 1 and n % lanes:
            size_ = size_.astype(np.int64)
            x[n % lanes :], start[n % lanes :], size_[n % lanes :], step[n % lanes :] = 0, 0, rng[n % lanes :], 1
        code -= step * start
        rng = step * size_
        while (small := rng < _LOW).any():
            code = np.where(small, code << 16 | flat.take(np.minimum(read, last), mode=_CLIP), code)
            read += small
            rng <<= small * np.int64(16)
        grid[t] = x
        m.learn(x)
    ids = alphabet.astype(np.uint16)[_in_line(grid, n)]
    if zlib.crc32(ids.astype("<u4").tobytes()) != crc:
        raise ValueError(f"damaged token block at byte {at}")
    return ids, at + 32 + size


def write_ids(ids: np.ndarray) -> bytes:
    """``ids`` as blocks, one after another."""
    return b"".join(encode_block(ids[i : i + BLOCK]) for i in range(0, len(ids), BLOCK))


def read_ids(raw: bytes, at: int = 0) -> Iterator[np.ndarray]:
    """The ids of each block from byte ``at`` on."""
    while at < len(raw):
        ids, at = decode_block(raw, at)
        yield ids


def write_file(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """A whole file: documents' ids (null allowed) and lengths, then ``ids`` in blocks."""
    null = np.array([d is None for d in doc_ids], bool)
    names = np.array([0 if d is None else d for d in doc_ids], "<i8")
    table = zlib.compress(np.diff(names, prepend=np.int64(0)).astype("<i8").tobytes() + np.packbits(null).tobytes() + lengths.astype("<u8").tobytes(), 6)
    head = np.array([len(names), len(ids)], "<u8").tobytes() + np.array([len(table), zlib.crc32(table)], "<u4").tobytes()
    return DOCS_MAGIC + head + table + write_ids(ids)


def read_file(raw: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """doc_ids, lengths and ids of a file; raises on damage."""
    if raw[:8] != DOCS_MAGIC or len(raw) < 32:
        raise ValueError("no token-id file")
    (n, total), (size, crc) = (x.tolist() for x in (np.frombuffer(raw, "<u8", 2, 8), np.frombuffer(raw, "<u4", 2, 24)))
    table = raw[32 : 32 + size]
    if len(table) != size or zlib.crc32(table) != crc:
        raise ValueError("damaged document table")
    table = zlib.decompress(table)
    null = np.unpackbits(np.frombuffer(table, np.uint8, -(-n // 8), 8 * n), count=n).astype(bool)
    names = np.cumsum(np.frombuffer(table, "<i8", n)).tolist()
    lengths = np.frombuffer(table, "<u8", n, 8 * n + -(-n // 8)).astype(np.int64)
    ids = np.concatenate([np.zeros(0, np.uint16), *read_ids(raw, 32 + size)])
    if len(ids) != total or lengths.sum() != total:
        raise ValueError("token-id file with blocks missing")
    return [None if x else d for d, x in zip(names, null.tolist())], lengths, ids
