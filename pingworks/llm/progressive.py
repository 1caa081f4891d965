"""Progressive JPEG in numpy: many images at once.

The reader takes any progressive Huffman-coded 8-bit file of one to four components: it
accumulates spectral-selection and successive-approximation scans into coefficient
arrays.  Each restart interval is a lane; the lanes of all images advance one symbol a
step, so a step is a few array operations for thousands of lanes.  The writer makes
three-component 4:2:0 files from coefficient arrays with a fixed scan script."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np

from pingworks.llm.bytescan import ranges

# Zig-zag order of an 8 x 8 block.
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, (i // 8 if (i // 8 + i % 8) % 2 else i % 8))))
#: Restart interval in MCUs; a component alone has as many blocks as these MCUs hold.
RESTART = 8
_LAYOUT = ((2, 2), (1, 1), (1, 1))
# Scans: (components, first, last coefficient, previous bit, bit).
SCRIPT = [
    ((0, 1, 2), 0, 0, 0, 1), ((0,), 1, 5, 0, 1), ((1,), 1, 5, 0, 1), ((2,), 1, 5, 0, 1), ((0,), 6, 63, 0, 0), ((1,), 6, 63, 0, 0), ((2,), 6, 63, 0, 0),
    ((0, 1, 2), 0, 0, 1, 0), ((0,), 1, 5, 1, 0), ((1,), 1, 5, 1, 0), ((2,), 1, 5, 1, 0),
]


@dataclass(frozen=True)
class Table:
    """A Huffman table: how many codes of each length 1..16, and the symbols."""

    counts: tuple[int, ...]
    symbols: tuple[int, ...]

    def codes(self) -> tuple[np.ndarray, np.ndarray]:
        """Code and length by symbol."""
        code, at, codes, lengths = 0, 0, np.zeros(256, np.int64), np.zeros(256, np.int64)
        for n, count in enumerate(self.counts, 1):
            for s in self.symbols[at : at + count]:
                codes[s], lengths[s], code = code, n, code + 1
            at, code = at + count, code << 1
        return codes, lengths

    def lookup(self) -> np.ndarray:
        """Length << 8 | symbol for each 16-bit prefix; 0 where there is no code."""
        out = np.zeros(1 << 16, np.int32)
        codes, lengths = self.codes()
        for s in self.symbols:
            n = int(lengths[s])
            out[int(codes[s]) << (16 - n) : (int(codes[s]) + 1) << (16 - n)] = n << 8 | s
        return out


def _table(groups: list[tuple[int, list[int]]]) -> Table:
    counts = [0] * 16
    for n, symbols in groups:
        counts[n - 1] = len(symbols)
    return Table(tuple(counts), tuple(s for _, x in groups for s in x))


_EOBS = [r << 4 for r in range(15)]
DC_TABLE = _table([(4, list(range(12)))])
_SHORT = [(2, [0x03, 0x04, 0x07]), (4, [0x01, 0x06]), (5, [0x13, 0x02, 0x17]), (6, [0x14]), (7, [0x05]), (9, [0x11]), (10, [0x12, 0x24]), (11, [0x23]), (12, [0x00, 0x08])]
_LONG = [x for x in [r << 4 | s for r in range(16) for s in range(1, 11)] + [0xF0] + _EOBS if not any(x in g for _, g in _SHORT)]
#: Short codes for what text bytes less media.OFFSET give: few zeros, small numbers and blanks.
AC_TABLE = _table([*_SHORT, (16, _LONG)])
REFINE_TABLE = _table([(6, [r << 4 | 1 for r in range(16)] + [0xF0] + _EOBS)])


def _size_of(x: np.ndarray) -> np.ndarray:
    return np.frexp(np.abs(x).astype(np.float64))[1].astype(np.int64)


def _bits(x: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The ``size`` bits that follow a symbol: negative numbers less one."""
    return np.where(x < 0, x + (1 << size) - 1, x)


def _pack(lane: np.ndarray, value: np.ndarray, length: np.ndarray, lanes: int) -> list[bytes]:
    """Bit items (in lane order) to one stuffed byte string a lane, padded with ones."""
    per = np.bincount(lane, length, lanes).astype(np.int64)
    size = -(-per // 8)
    start = np.cumsum(size) - size
    before = np.cumsum(length) - length
    of_lane = np.cumsum(per) - per
    at = 8 * start[lane] + before - of_lane[lane]
    words = np.zeros(int(size.sum()) // 4 + 3, np.uint32)
    # items lie in ascending places: each as 64 bits from the start of its 32-bit word,
    # those of one word joined by one reduction
    word, x = at >> 5, value.astype(np.uint64) << (64 - (at & 31) - length).astype(np.uint64)
    if len(x):
        firsts = np.flatnonzero(np.diff(word, prepend=-1))
        x = np.bitwise_or.reduceat(x, firsts)
        word = word[firsts]
        words[word] |= (x >> np.uint64(32)).astype(np.uint32)
        words[word + 1] |= x.astype(np.uint32)
    raw = np.frombuffer(words.astype(">u4").tobytes(), np.uint8).copy()
    raw[start + size - 1] |= ((1 << (8 * size - per)) - 1).astype(np.uint8)
    raw = raw.tobytes()
    ends = (start + size).tolist()
    return [raw[a:b].replace(b"\xff", b"\xff\x00") for a, b in zip(start.tolist(), ends)]


def _dc_items(v: np.ndarray, lane: np.ndarray, comp: np.ndarray, order: np.ndarray):
    """Difference coding of ``v`` in scan order, per lane and component."""
    key = np.lexsort((order, comp, lane))
    x = v[key]
    diff = x.copy()
    same = (lane[key][1:] == lane[key][:-1]) & (comp[key][1:] == comp[key][:-1])
    diff[1:] -= np.where(same, x[:-1], 0)
    out = np.zeros_like(v)
    out[key] = diff
    codes, lengths = DC_TABLE.codes()
    s = _size_of(out)
    return codes[s] << s | _bits(out, s), lengths[s] + s


def _ac_items(c: np.ndarray, lane: np.ndarray):
    """First scan of a band: ``c`` is (blocks, band), shifted already."""
    codes, lengths = AC_TABLE.codes()
    block, k = np.nonzero(c)
    x = c[block, k].astype(np.int64)
    run = k.copy()
    same = np.zeros(len(k), bool)
    same[1:] = block[1:] == block[:-1]
    run[1:] -= np.where(same[1:], k[:-1] + 1, 0)
    s = _size_of(x)
    symbol = (run & 15) << 4 | s
    value, length = codes[symbol] << s | _bits(x, s), lengths[symbol] + s
    width = c.shape[1]
    last = np.full(len(c), -1)
    last[block] = k  # the last write stays
    key = block * 4 * width + 4 * k + 3
    zrl = np.repeat(np.arange(len(k)), run >> 4)
    ends = np.flatnonzero(last < width - 1)
    if len(zrl) or len(ends):
        key = np.concatenate([key, key[zrl] - 1, ends * 4 * width + 4 * width - 1])
        value = np.concatenate([value, np.full(len(zrl), codes[0xF0]), np.full(len(ends), codes[0])])
        length = np.concatenate([length, np.full(len(zrl), lengths[0xF0]), np.full(len(ends), lengths[0])])
        block = np.concatenate([block, block[zrl], ends])
        order = np.argsort(key, kind="stable")
        value, length, block = value[order], length[order], block[order]
    return lane[block], value, length


def _refine_items(c: np.ndarray, lane: np.ndarray):
    """Refinement of a band of at most 16 coefficients to its last bit."""
    codes, lengths = REFINE_TABLE.codes()
    size = np.abs(c).astype(np.int64)
    new, old, width = size == 1, size > 1, c.shape[1]
    seg = np.cumsum(new, axis=1) - new  # a new one closes its segment
    run = np.cumsum(size == 0, axis=1)
    b, k = np.nonzero(new)
    before = np.zeros(len(b), np.int64)
    same = np.zeros(len(b), bool)
    same[1:] = b[1:] == b[:-1]
    before[1:] = np.where(same[1:], run[b[:-1], k[:-1]], 0)
    r = run[b, k] - before
    sign = (c[b, k] > 0).astype(np.int64)
    last = np.full(len(c), -1)
    last[b] = k
    ends = np.flatnonzero(last < width - 1)
    ob, ok = np.nonzero(old)
    key = np.concatenate([(b * 32 + seg[b, k]) * 32, (ends * 32 + new[ends].sum(1)) * 32, (ob * 32 + seg[ob, ok]) * 32 + 1 + ok])
    value = np.concatenate([codes[r << 4 | 1] << 1 | sign, np.full(len(ends), codes[0]), size[ob, ok] & 1])
    length = np.concatenate([lengths[r << 4 | 1] + 1, np.full(len(ends), lengths[0]), np.ones(len(ob), np.int64)])
    block = np.concatenate([b, ends, ob])
    order = np.argsort(key, kind="stable")
    return lane[block[order]], value[order], length[order]


def _segment(marker: int, body: bytes) -> bytes:
    return bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body


def _dht(kind: int, number: int, t: Table) -> bytes:
    return _segment(0xC4, bytes([kind << 4 | number, *t.counts, *t.symbols]))


def _sos(comps: tuple[int, ...], first: int, last: int, high: int, low: int) -> bytes:
    table = 1 if high and first else 0
    return _segment(0xDA, bytes([len(comps), *[x for c in comps for x in (c + 1, table)], first, last, high << 4 | low]))


def grid(mcus: int) -> tuple[int, int]:
    """Width and height in MCUs of an image that holds so many; a side has 16 bits."""
    width = max(min(mcus, 16 * RESTART), -(-mcus // (65535 // 16)))
    return width, -(-mcus // width)


def write(coefficients: list[tuple[np.ndarray, int, int]], comments: list[bytes]) -> list[bytes]:
    """Files from (blocks in MCU order as (n, 6, 64) zig-zag coefficients, width and
    height in MCUs), with quantisers of one and a comment each."""
    blocks = np.concatenate([c for c, _, _ in coefficients])
    files = np.repeat(np.arange(len(coefficients)), [len(c) for c, _, _ in coefficients])
    first = np.cumsum([0] + [len(c) for c, _, _ in coefficients])
    mcu = np.arange(len(blocks)) - first[files]
    width = np.array([w for _, w, _ in coefficients])[files]
    # of each component: rows of `blocks`, file and place in the component's own order
    own = []
    for comp, (h, v) in enumerate(_LAYOUT):
        part = blocks[:, 0:4] if comp == 0 else blocks[:, 3 + comp : 4 + comp]
        sub = np.arange(h * v)
        y, x = (mcu // width)[:, None] * v + sub // h, (mcu % width)[:, None] * h + sub % h
        place = (y * (width * h)[:, None] + x).ravel()
        order = np.lexsort((place, np.repeat(files, h * v)))
        own.append((part.reshape(-1, 64)[order], np.repeat(files, h * v)[order], place[order], h * v * RESTART))
    scans: list[list[list[bytes]]] = []
    for comps, lo, hi, high, low in SCRIPT:
        if len(comps) > 1:
            v = blocks[:, :, 0].astype(np.int64)
            lane_mcu = _lanes(files, mcu, RESTART)
            lane, comp = np.repeat(lane_mcu, 6), np.tile([0, 0, 0, 0, 1, 2], len(blocks))
            if high:
                value, length = v.ravel() & 1, np.ones(v.size, np.int64)
            else:
                value, length = _dc_items((v >> low).ravel(), lane, comp, np.arange(v.size))
            of_file = files
        else:
            c, of_file, place, restart = own[comps[0]]
            band = c[:, lo : hi + 1].astype(np.int64)
            lane_mcu = lane = _lanes(of_file, place, restart)
            if high:
                lane, value, length = _refine_items(band, lane_mcu)
            else:
                lane, value, length = _ac_items(np.sign(band) * (np.abs(band) >> low), lane_mcu)
        n = int(lane_mcu[-1]) + 1 if len(lane_mcu) else 0
        packed = _pack(lane, value, length, n)
        lane_file = np.zeros(n, np.int64)
        lane_file[lane_mcu] = of_file
        cuts = np.searchsorted(lane_file, np.arange(len(coefficients) + 1)).tolist()
        scans.append([packed[a:b] for a, b in zip(cuts[:-1], cuts[1:])])
    tables = _dht(0, 0, DC_TABLE) + _dht(1, 0, AC_TABLE) + _dht(1, 1, REFINE_TABLE)
    out = []
    for f, (_, w, h) in enumerate(coefficients):
        sof = bytes([8]) + (16 * h).to_bytes(2, "big") + (16 * w).to_bytes(2, "big") + bytes([3, 1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])
        parts = [b"\xff\xd8", _segment(0xFE, comments[f]), _segment(0xDB, bytes([0] + [1] * 64)), _segment(0xC2, sof), tables]
        interval = None
        for (comps, lo, hi, high, low), lanes in zip(SCRIPT, scans):
            need = RESTART * (4 if comps == (0,) else 1)
            if need != interval:
                parts.append(_segment(0xDD, need.to_bytes(2, "big")))
                interval = need
            parts.append(_sos(comps, lo, hi, high, low))
            for i, lane in enumerate(lanes[f]):
                if i:
                    parts.append(bytes([0xFF, 0xD0 + (i - 1) % 8]))
                parts.append(lane)
        out.append(b"".join([*parts, b"\xff\xd9"]))
    return out


def _lanes(files: np.ndarray, place: np.ndarray, restart: int) -> np.ndarray:
    """Lane of each unit: a new one for each file and every ``restart`` units."""
    new = np.ones(len(files), np.int64)
    new[1:] = (files[1:] != files[:-1]) | (place[1:] % restart == 0)
    return np.cumsum(new) - 1


@dataclass
class Image:
    """A file's frame; ``base`` is where each component's blocks start in the batch."""

    width: int = 0
    height: int = 0
    comps: list[tuple[int, int, int, int]] = field(default_factory=list)  # id, h, v, quantiser
    quant: dict[int, np.ndarray] = field(default_factory=dict)
    comment: bytes = b""
    base: list[int] = field(default_factory=list)
    scans: list[tuple] = field(default_factory=list)

    def shape(self, c: int) -> tuple[int, int, int, int]:
        """Blocks of a component: stored rows and columns, real rows and columns."""
        _, h, v, _ = self.comps[c]
        hm, vm = max(x[1] for x in self.comps), max(x[2] for x in self.comps)
        mx, my = -(-self.width // (8 * hm)), -(-self.height // (8 * vm))
        return my * v, mx * h, -(-(-(-self.height * v // vm)) // 8), -(-(-(-self.width * h // hm)) // 8)


_CUT = re.compile(rb"\xff[^\x00]")


def parse(raw: bytes, tables: dict[bytes, int]) -> Image:
    """Frame, tables and scans of a file; entropy-coded parts are cut at restarts."""
    img, at, huff, interval = Image(), 2, {}, 0
    if raw[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG file")
    while True:
        marker, size = raw[at + 1], int.from_bytes(raw[at + 2 : at + 4], "big")
        if raw[at] != 0xFF:
            raise ValueError("marker expected")
        if marker == 0xD9:
            return img
        body, at = raw[at + 4 : at + 2 + size], at + 2 + size
        if marker == 0xFE:
            img.comment = body
        elif marker == 0xDB:
            while body:
                wide = body[0] >> 4
                values = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else "u1").astype(np.int64)
                img.quant[body[0] & 15], body = values, body[65 + 64 * wide :]
        elif marker == 0xC2:
            img.height, img.width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
            img.comps = [(body[i], body[i + 1] >> 4, body[i + 1] & 15, body[i + 2]) for i in range(6, 6 + 3 * body[5], 3)]
        elif marker in (0xC0, 0xC1, 0xC3, *range(0xC5, 0xC8), *range(0xC9, 0xCC), *range(0xCD, 0xD0)):
            raise ValueError("not a progressive Huffman file")
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                huff[body[0]], body = tables.setdefault(body[1 : 17 + n], len(tables)), body[17 + n :]
        elif marker == 0xDD:
            interval = int.from_bytes(body, "big")
        elif marker == 0xDA:
            ids = [c[0] for c in img.comps]
            comps = [ids.index(body[1 + 2 * i]) for i in range(body[0])]
            dc, ac = [huff.get(body[2 + 2 * i] >> 4, 0) for i in range(body[0])], huff.get(0x10 | body[2] & 15, 0)
            lo, hi, bits = body[-3:]
            parts, start = [], at
            for m in _CUT.finditer(raw, at):
                if 0xD0 <= raw[m.start() + 1] <= 0xD7:
                    parts.append(raw[start : m.start()])
                    start = m.end()
                elif raw[m.start() + 1] != 0xFF:
                    break
            else:
                raise ValueError("file ends within a scan")
            parts.append(raw[start : m.start()])
            at = m.start()
            img.scans.append((comps, lo, hi, bits >> 4, bits & 15, dc, ac, interval, [p.replace(b"\xff\x00", b"\xff") for p in parts]))


@lru_cache(maxsize=2048)
def _order(width: int, height: int, frame: tuple, comps: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, int]:
    """Blocks of a scan in coding order (from the image's first), which of the scan's
    components each belongs to, and blocks an MCU."""
    img = Image(width, height, list(frame))
    bases = np.cumsum([0] + [img.shape(c)[0] * img.shape(c)[1] for c in range(len(frame))])
    if len(comps) == 1:
        _, cols, real_rows, real_cols = img.shape(comps[0])
        seq = (np.arange(real_rows)[:, None] * cols + np.arange(real_cols)).ravel() + bases[comps[0]]
        return seq, np.zeros(len(seq), np.int64), 1
    rows, cols = img.shape(comps[0])[0] // frame[comps[0]][2], img.shape(comps[0])[1] // frame[comps[0]][1]
    my, mx = np.divmod(np.arange(rows * cols), cols)
    seqs, which = [], []
    for j, c in enumerate(comps):
        _, h, v, _ = frame[c]
        for y in range(v):
            for x in range(h):
                seqs.append((my * v + y) * (cols * h) + mx * h + x + bases[c])
                which.append(j)
    return np.stack(seqs, 1).ravel(), np.tile(which, rows * cols), len(seqs)


class _Lanes:
    """Restart intervals of scans of one kind, with a bit position each."""

    def __init__(self, lookups: np.ndarray):
        self.lookups, self.parts, self.rows = lookups, [], []
        self.seq, self.n_seq, self.comps, self.tables = [], 0, [], []

    def add(self, img: Image, scan: tuple) -> None:
        comps, lo, hi, high, low, dc, ac, interval, parts = scan
        seq, comp, unit = _order(img.width, img.height, tuple(img.comps), tuple(comps))
        step = (interval or len(seq)) * unit
        for i, p in enumerate(parts):
            n = min(step, len(seq) - i * step)
            if n > 0:
                self.rows.append((self.n_seq + i * step, n, lo, hi, low, ac))
                self.parts.append(p)
        self.seq.append(seq + img.base[0])
        if lo == 0:  # only DC scans mix components
            self.comps.append(comp)
            self.tables.append(np.array(dc)[comp])
        self.n_seq += len(seq)

    def ready(self) -> None:
        sizes = np.array([len(p) + 8 for p in self.parts], np.int64)
        raw = np.frombuffer(b"".join(p + b"\xff" * 8 for p in self.parts), np.uint8).astype(np.int64)
        w = np.zeros(len(raw), np.int64)
        for k in range(5):  # a window of 40 bits at each byte
            w[: len(raw) - k] |= raw[k:] << (32 - 8 * k)
        self.window = w
        self.bit = 8 * (np.cumsum(sizes) - sizes)
        self.end = self.bit + 8 * (sizes - 5)
        self.at, self.n, self.lo, self.hi, self.low, self.ac = (np.array(x, np.int64) for x in zip(*self.rows))
        self.stop = self.at + self.n
        self.block = np.concatenate(self.seq)
        if self.comps:
            self.table, self.comp = np.concatenate(self.tables), np.concatenate(self.comps)

    def symbols(self, w: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Next symbol of lanes ``w``, and their window and the bit behind the symbol."""
        bit = np.minimum(self.bit[w], self.end[w])
        win, off = self.window[bit >> 3], bit & 7
        found = self.lookups[table * 65536 + (win >> (24 - off) & 0xFFFF)]
        if not found.all():
            raise ValueError("no such code")
        return found & 255, win, off + (found >> 8)

    def bits(self, w: np.ndarray, count: np.ndarray) -> np.ndarray:
        bit = np.minimum(self.bit[w], self.end[w])
        out = self.window[bit >> 3] >> (40 - (bit & 7) - count) & ((1 << count) - 1)
        self.bit[w] += count
        return out


def _signed(extra: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.where(extra < (1 << size >> 1), extra - (1 << size) + 1, extra)


def _dc_first(L: _Lanes, coef: np.ndarray) -> None:
    pred = np.zeros((len(L.at), 4), np.int64)
    for t in range(int(L.n.max())):
        w = np.flatnonzero(L.n > t)
        at = L.at[w] + t
        size, win, used = L.symbols(w, L.table[at])
        extra = win >> (40 - used - size) & ((1 << size) - 1)
        L.bit[w] = (np.minimum(L.bit[w], L.end[w]) >> 3 << 3) + used + size
        c = L.comp[at]
        pred[w, c] += _signed(extra, size)
        coef[L.block[at], 0] = pred[w, c] << L.low[w]


def _dc_refine(L: _Lanes, coef: np.ndarray) -> None:
    one = np.ones(len(L.at), np.int64)
    for t in range(int(L.n.max())):
        w = np.flatnonzero(L.n > t)
        coef[L.block[L.at[w] + t], 0] |= (L.bits(w, one[w]) << L.low[w]).astype(coef.dtype)


def _ac_first(L: _Lanes, coef: np.ndarray) -> None:
    flat = coef.reshape(-1)
    w, at, k = np.arange(len(L.at)), L.at.copy(), L.lo.copy()
    lo, hi, low, stop, ac, bit, end = L.lo, L.hi, L.low, L.stop, L.ac * 65536, L.bit, L.end
    window, lookups, block = L.window, L.lookups, L.block
    while len(w):
        win, off = window[bit >> 3], bit & 7
        found = lookups[ac + (win >> (24 - off) & 0xFFFF)]
        size, used = found & 15, off + (found >> 8)
        run = found >> 4 & 15
        extra = win >> (40 - used - size) & ((1 << size) - 1)
        bit = np.minimum((bit - off) + used + size, end)
        k = k + run
        put = size > 0
        if put.all():
            flat[block[at] * 64 + np.minimum(k, 63)] = _signed(extra, size) << low
        else:
            p = np.flatnonzero(put)
            flat[block[at[p]] * 64 + np.minimum(k[p], 63)] = _signed(extra[p], size[p]) << low[p]
            if not found.all():
                raise ValueError("no such code")
            e = np.flatnonzero(~put & (run < 15))  # ends of blocks
            if len(e):
                r = run[e]
                more = window[bit[e] >> 3] >> (40 - (bit[e] & 7) - r) & ((1 << r) - 1)
                bit[e] += r
                at[e] += (1 << r) + more - 1
                k[e] = hi[e]
        k += 1
        over = k > hi
        at += over
        k = np.where(over, lo, k)
        if over.any():
            live = at < stop
            if not live.all():
                w, at, k, lo, hi, low, stop, ac, bit, end = (x[live] for x in (w, at, k, lo, hi, low, stop, ac, bit, end))


def _ac_refine(L: _Lanes, coef: np.ndarray) -> None:
    n = len(L.at)
    at, k = L.at.copy(), L.lo.copy()
    pending, run, new, eob = np.zeros(n, bool), np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    one = np.ones(n, np.int64)
    while len(live := np.flatnonzero(at < L.stop)):
        ask = live[~pending[live] & (eob[live] == 0)]
        if len(ask):
            symbol, _, used = L.symbols(ask, L.ac[ask])
            L.bit[ask] = (np.minimum(L.bit[ask], L.end[ask]) >> 3 << 3) + used
            r, s = symbol >> 4, symbol & 15
            ends = ask[(s == 0) & (r < 15)]
            if len(ends):
                re_ = r[(s == 0) & (r < 15)]
                eob[ends] = (1 << re_) + L.bits(ends, re_)
            go = (s > 0) | (r == 15)
            pending[ask], run[ask], new[ask] = go, r, 0
            put = ask[s > 0]
            new[put] = (2 * L.bits(put, one[put]) - 1) << L.low[put]
        b = L.block[at[live]]
        v = coef[b, k[live]].astype(np.int64)
        old = v != 0
        o = live[old]
        fix = L.bits(o, one[o]) * ((np.abs(v[old]) >> L.low[o] & 1) == 0)
        coef[b[old], k[o]] = v[old] + np.sign(v[old]) * (fix << L.low[o])
        z = live[~old & (eob[live] == 0)]
        done = z[run[z] == 0]
        coef[L.block[at[done]], k[done]] = new[done]
        pending[done] = False
        run[z] -= 1
        k[live] += 1
        over = live[k[live] > L.hi[live]]
        at[over] += 1
        k[over] = L.lo[over]
        pending[over] = False
        eob[over] = np.maximum(eob[over] - 1, 0)


def read(files: list[bytes]) -> tuple[list[Image], np.ndarray]:
    """Frames of the files, and all their blocks as (n, 64) zig-zag coefficients."""
    tables: dict[bytes, int] = {}
    images = [parse(f, tables) for f in files]
    total = 0
    for img in images:
        for c in range(len(img.comps)):
            img.base.append(total)
            rows, cols, _, _ = img.shape(c)
            total += rows * cols
    coef = np.zeros((total, 64), np.int32)
    lookups = np.concatenate([Table(tuple(t[:16]), tuple(t[16:])).lookup() for t in tables] or [np.zeros(65536, np.int32)])
    # runs of first AC scans touch different coefficients, so they may advance together
    depth, step = max([len(i.scans) for i in images], default=0), 0
    while step < depth:
        groups: dict[str, _Lanes] = {}
        ahead = step + 1
        plain = lambda s: all(len(i.scans) <= s or (i.scans[s][1] > 0 and i.scans[s][3] == 0) for i in images)
        while plain(step) and ahead < depth and plain(ahead):
            ahead += 1
        for img in images:
            for scan in img.scans[step:ahead]:
                kind = ("dc" if scan[1] == 0 else "ac") + ("_refine" if scan[3] else "_first")
                groups.setdefault(kind, _Lanes(lookups)).add(img, scan)
        for kind, lanes in groups.items():
            if lanes.rows:
                lanes.ready()
                {"dc_first": _dc_first, "dc_refine": _dc_refine, "ac_first": _ac_first, "ac_refine": _ac_refine}[kind](lanes, coef)
        step = ahead
    return images, coef


_U = np.arange(8)
_COS = np.cos((2 * _U[:, None] + 1) * _U[None, :] * np.pi / 16) * np.where(_U == 0, np.sqrt(0.125), 0.5)[None, :]
#: From zig-zag coefficients to samples, as one matrix.
_INVERSE = np.kron(_COS, _COS).T[ZIGZAG]


def samples(coef: np.ndarray) -> np.ndarray:
    """Blocks of 8 x 8 samples, 0 to 255.  The hair above one half keeps ties on one
    side whatever the batch, so equal blocks give equal samples."""
    out = coef.astype(np.float64) @ _INVERSE
    np.floor(out + (128.5 + 1e-6), out=out)
    return np.clip(out, 0, 255, out=out).astype(np.uint8).reshape(-1, 8, 8)


def all_samples(images: list[Image], coef: np.ndarray) -> np.ndarray:
    """Samples of all blocks of a batch, dequantised."""
    for img in images:
        for c, (_, _, _, q) in enumerate(img.comps):
            if (img.quant[q] != 1).any():
                rows, cols, _, _ = img.shape(c)
                coef[img.base[c] : img.base[c] + rows * cols] *= img.quant[q].astype(coef.dtype)
    return samples(coef)


def tensor(img: Image, pixels: np.ndarray) -> np.ndarray:
    """Full-resolution RGB of an image, from the samples of its batch: chroma is
    repeated to the size of luma."""
    hm, vm = max(x[1] for x in img.comps), max(x[2] for x in img.comps)
    full = []
    for c, (_, h, v, _) in enumerate(img.comps):
        rows, cols, _, _ = img.shape(c)
        plane = pixels[img.base[c] : img.base[c] + rows * cols].reshape(rows, cols, 8, 8).swapaxes(1, 2).reshape(rows * 8, cols * 8)
        full.append(np.repeat(np.repeat(plane, vm // v, 0), hm // h, 1)[: img.height, : img.width])
    if len(full) < 3:
        return np.repeat(full[0][:, :, None], 3, 2)
    y, cb, cr = (x.astype(np.int32) for x in full[:3])
    cb, cr = cb - 128, cr - 128
    # 16-bit fixed point of the usual matrix
    rgb = np.stack([(y << 16) + 91881 * cr, (y << 16) - 22554 * cb - 46802 * cr, (y << 16) + 116130 * cb], 2) + 32768 >> 16
    return np.clip(rgb, 0, 255).astype(np.uint8)
