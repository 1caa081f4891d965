from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pytest
from conftest import SMALL

from pingworks.llm import media
from pingworks.llm import progressive as J
from pingworks.llm.shared import new_path


def _payloads():
    rng = np.random.default_rng(1)
    o = media.OFFSET
    return [
        b" " * 192, bytes([o]) * 384, bytes(rng.integers(0, 256, 192 * 3, dtype=np.uint8)), bytes(rng.integers(o - 2, o + 3, 192 * 41, dtype=np.uint8)),
        bytes(rng.choice([o, o, o, o - 1, o + 1, 0, 255, o + 2], 192 * 50).astype(np.uint8)), bytes(rng.integers(0, 256, 192 * 300, dtype=np.uint8)),
    ]


def test_payloads_come_back_and_batches_do_not_matter():
    payloads = _payloads()
    files = media.to_jpeg(payloads)
    together = media.from_jpeg(files)
    for p, f, (back, rgb) in zip(payloads, files, together):
        assert back == p and media.to_jpeg([p]) == [f]
        assert (media.from_jpeg([f])[0][1] == rgb).all() and rgb.dtype == np.uint8 and rgb.shape[2] == 3


class _Scalar:
    """A plain bit-by-bit reader of a progressive file, as the standard words it."""

    def __init__(self, raw):
        self.tables = {}
        self.img = J.parse(raw, self.tables)
        self.by_number = {n: J.Table(tuple(t[:16]), tuple(t[16:])) for t, n in self.tables.items()}
        self.coef = [np.zeros((self.img.shape(c)[0], self.img.shape(c)[1], 64), int) for c in range(len(self.img.comps))]

    def bit(self):
        v = self.data[self.pos >> 3] >> (7 - (self.pos & 7)) & 1 if self.pos >> 3 < len(self.data) else 1
        self.pos += 1
        return v

    def bits(self, n):
        v = 0
        for _ in range(n):
            v = v << 1 | self.bit()
        return v

    def symbol(self, number):
        codes, lengths = self.by_number[number].codes()
        known = {(int(lengths[s]), int(codes[s])): s for s in self.by_number[number].symbols}
        code = 0
        for n in range(1, 17):
            code = code << 1 | self.bit()
            if (n, code) in known:
                return known[n, code]
        raise ValueError

    def extend(self, n):
        v = self.bits(n)
        return v - (1 << n) + 1 if n and v < 1 << (n - 1) else v

    def decode(self):
        img = self.img
        for comps, lo, hi, high, low, dc, ac, interval, parts in img.scans:
            if len(comps) > 1:
                rows, cols = img.shape(comps[0])[0] // img.comps[comps[0]][2], img.shape(comps[0])[1] // img.comps[comps[0]][1]
                units = [
                    [(j, c, my * img.comps[c][2] + y, mx * img.comps[c][1] + x) for j, c in enumerate(comps) for y in range(img.comps[c][2]) for x in range(img.comps[c][1])]
                    for my in range(rows) for mx in range(cols)
                ]
            else:
                _, _, rows, cols = img.shape(comps[0])
                units = [[(0, comps[0], y, x)] for y in range(rows) for x in range(cols)]
            step = interval or len(units)
            for i, part in enumerate(parts):
                self.data, self.pos, pred, self.eob = part, 0, {}, 0
                for unit in units[i * step : (i + 1) * step]:
                    for j, c, y, x in unit:
                        b = self.coef[c][y, x]
                        if lo == 0 and not high:
                            pred[c] = pred.get(c, 0) + self.extend(self.symbol(dc[j]))
                            b[0] = pred[c] << low
                        elif lo == 0:
                            b[0] |= self.bit() << low
                        elif not high:
                            self.first(b, lo, hi, low, ac)
                        else:
                            self.refine(b, lo, hi, low, ac)
        return self.coef

    def first(self, b, lo, hi, low, ac):
        if self.eob:
            self.eob -= 1
            return
        k = lo
        while k <= hi:
            r, s = divmod(self.symbol(ac), 16)
            if s:
                k += r
                b[k] = self.extend(s) * (1 << low)
                k += 1
            elif r == 15:
                k += 16
            else:
                self.eob = (1 << r) + self.bits(r) - 1
                return

    def refine(self, b, lo, hi, low, ac):
        def correct(k):
            if self.bit() and not abs(b[k]) >> low & 1:
                b[k] += (1 if b[k] > 0 else -1) << low

        k = lo
        while k <= hi and not self.eob:
            r, s = divmod(self.symbol(ac), 16)
            new = 0
            if s:
                new = (1 if self.bit() else -1) << low
            elif r < 15:
                self.eob = (1 << r) + self.bits(r)
                break
            while k <= hi:
                if b[k]:
                    correct(k)
                elif r == 0:
                    b[k] = new
                    k += 1
                    break
                else:
                    r -= 1
                k += 1
        if self.eob:
            for q in range(k, hi + 1):
                if b[q]:
                    correct(q)
            self.eob -= 1


def test_reader_equals_a_plain_reader():
    for f in media.to_jpeg(_payloads()[:5]):
        (img,), coef = J.read([f])
        for c, want in enumerate(_Scalar(f).decode()):
            rows, cols, _, _ = img.shape(c)
            assert (coef[img.base[c] : img.base[c] + rows * cols].reshape(rows, cols, 64) == want).all()


def _runs_file() -> bytes:
    """A hand-made grey file of 20 x 12 pixels without restarts, whose AC scans use runs
    of ended blocks and zero runs of sixteen."""
    ac = J._table([(4, [0x00, 0x10, 0x01, 0xF0, 0x02, 0x21, 0x11])])
    codes, lengths = ac.codes()
    put = lambda s: (int(codes[s]), int(lengths[s]))

    def scan(items):
        text = "".join(f"{v:0{n}b}" for v, n in items if n)
        text += "1" * (-len(text) % 8)
        return bytes(int(text[i : i + 8], 2) for i in range(0, len(text), 8)).replace(b"\xff", b"\xff\x00")

    d, n = J.DC_TABLE.codes()
    dc = [x for v in (3, 0, 1, 0, 2, 0) for x in ((int(d[v]), int(n[v])), ((1 << v) - 1, v))]
    first = [put(0x01), (1, 1), put(0xF0), put(0x02), (2, 2), put(0x00), put(0x10), (1, 1), put(0x21), (0, 1), put(0x10), (0, 1)]
    # block 0 has two old numbers; 1-3 none; 4 one; 5 none
    second = [put(0x11), (1, 1), (1, 1), put(0x00), (0, 1), put(0x10), (1, 1), put(0x01), (0, 1), put(0x10), (0, 1), (1, 1)]
    frame = bytes([8, 0, 12, 0, 20, 1, 1, 0x11, 0])
    parts = [b"\xff\xd8", J._segment(0xDB, bytes([0] + [1] * 64)), J._segment(0xC2, frame), J._dht(0, 0, J.DC_TABLE), J._dht(1, 0, ac)]
    for lo, hi, high, low, items in ((0, 0, 0, 0, dc), (1, 63, 0, 1, first), (1, 63, 1, 0, second)):
        parts += [J._segment(0xDA, bytes([1, 1, 0, lo, hi, high << 4 | low])), scan(items)]
    return b"".join([*parts, b"\xff\xd9"])


def test_foreign_file_with_runs_of_ended_blocks():
    f = _runs_file()
    (img,), coef = J.read([f])
    assert (coef.reshape(2, 3, 64) == _Scalar(f).decode()[0]).all() and (coef != 0).sum() > 6
    rgb = J.tensor(img, J.all_samples([img], coef))
    assert rgb.shape == (12, 20, 3) and (rgb[:, :, 0] == rgb[:, :, 2]).all()


def test_inverse_transform_is_the_cosine_sum():
    rng = np.random.default_rng(2)
    c = rng.integers(-60, 60, (3, 64))
    got = J.samples(c)
    for b in range(3):
        f = np.zeros(64)
        f[J.ZIGZAG] = c[b]
        for y in range(8):
            for x in range(8):
                s = sum(
                    (0.5**0.5 if u == 0 else 1) * (0.5**0.5 if v == 0 else 1) * f[v * 8 + u] * np.cos((2 * x + 1) * u * np.pi / 16) * np.cos((2 * y + 1) * v * np.pi / 16)
                    for u in range(8) for v in range(8)
                ) / 4
                assert got[b, y, x] == min(255, max(0, int(np.floor(s + 128.5 + 1e-6))))


def test_damage_is_refused():
    with pytest.raises(ValueError):
        J.read([b"no image"])


def test_query_and_edges(spark):
    texts = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    seen = {}
    for r in media.query(spark, SMALL).collect():
        t = texts[r.doc_id]
        p = t.ljust(max(192, -(-len(t) // 192) * 192), b" ")
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(t), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]))
        assert seen.setdefault(t, (r.media_sha256, r.feature)) == (r.media_sha256, r.feature)
    docs = spark.createDataFrame([(1, None), (1, ""), (2, "x" * 50_000)], "doc_id long, text string")
    path = new_path(spark, "media")
    media.store(docs, path)
    rows = sorted(media.load(spark, path, tensors=True).collect(), key=lambda r: (r.doc_id, r.n_bytes))
    assert [r.payload_bytes for r in rows] == [192, 192, 50_112] and rows[0].feature == rows[1].feature
    assert all(len(r.tensor) == r.height * r.width * 3 for r in rows)
    path = new_path(spark, "media")
    media.store(docs.limit(0), path)
    assert media.load(spark, path).count() == 0


@pytest.mark.parametrize("mcus", [1, 128, 129, 128 * 4095, 128 * 4095 + 1, 2_000_000])
def test_sides_fit_in_16_bits(mcus):
    width, height = J.grid(mcus)
    assert width * height >= mcus > width * (height - 1) and max(width, height) * 16 <= 65535


def test_wide_images_round_trip(monkeypatch):
    rng = np.random.default_rng(8)
    monkeypatch.setattr(J, "grid", lambda n: (-(-n // 2), 2))
    payload = rng.integers(32, 127, 384 * 301, dtype=np.uint8).tobytes()
    (got, rgb), = media.from_jpeg(media.to_jpeg([payload]))
    assert got == payload and rgb.shape == (32, 151 * 16, 3)


def test_query_returns_the_tensors(spark):
    rows = media.query(spark, SMALL).collect()
    assert len(rows) == spark.read.parquet(f"{SMALL}/documents.parquet").count()
    for r in rows[:50]:
        rgb = np.frombuffer(r.tensor, np.uint8).reshape(r.height, r.width, 3)
        assert r.feature.startswith(f"{r.width}x{r.height};") and r.feature.endswith(f"crc={zlib.crc32(rgb.tobytes())}")
