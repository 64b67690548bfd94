"""Progressive JPEG in numpy: scans accumulate into coefficient arrays.

The decoder takes any Huffman-coded progressive stream without restart markers whose chroma is sampled as luma or at half
of it.  Where a scan's bits have one layout throughout (every coefficient of one size, or every block one run of
correction bits), the layout is verified and the scan is read as a matrix; any other scan goes symbol by symbol.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np

BLOCK = 64
#: Stored samples are coefficients of 256 + byte: all of one bit size, also after the last bit is split off.
_SHIFT = 256
_BANDS = ((1, 5), (6, 63))
_AC_FIRST, _AC_REFINE, _DC = (0, {0x08: "0", 0x00: "10"}), (1, {0x00: "0", 0x01: "10"}), (0, {k: f"{k:04b}" for k in range(9)})


def _zigzag() -> np.ndarray:
    """Place in the block, row by row, of each coefficient in the order of a scan: along the anti-diagonals, to and fro."""
    at = sorted(((i + j, j if (i + j) % 2 == 0 else i, i * 8 + j) for i in range(8) for j in range(8)))
    return np.array([p for _, _, p in at])


ZIGZAG = _zigzag()


def _basis() -> np.ndarray:
    """(64, 64): coefficients, row by row, to samples."""
    u = np.arange(8)
    c = np.cos((2 * u[None, :] + 1) * u[:, None] * np.pi / 16) * np.where(u == 0, np.sqrt(0.5), 1.0)[:, None] / 2
    return np.einsum("ux,vy->uvxy", c, c).reshape(64, 64)


BASIS = _basis()


# --- writing -------------------------------------------------------------------------------------


def _segment(marker: int, body: bytes) -> bytes:
    return bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body


def _table(kind: int, where: int, codes: dict[int, str]) -> bytes:
    lengths = [sum(len(c) == n for c in codes.values()) for n in range(1, 17)]
    return bytes([kind << 4 | where, *lengths, *sorted(codes, key=lambda s: (len(codes[s]), codes[s]))])


_TABLES = _segment(0xDB, bytes([0]) + bytes([1] * 64)) + _segment(0xC4, _table(0, *_DC) + _table(1, *_AC_FIRST) + _table(1, *_AC_REFINE))


def _scan(parts: list[tuple[int, int]], band: tuple[int, int], high: int, low: int, bits: np.ndarray) -> bytes:
    body = bytes([len(parts)]) + b"".join(bytes([c, t]) for c, t in parts) + bytes([*band, high << 4 | low])
    data = np.packbits(bits)
    data[-1] |= (1 << -len(bits) % 8) - 1
    return _segment(0xDA, body) + data.tobytes().replace(b"\xff", b"\xff\x00")


def _units(y: np.ndarray, cb: np.ndarray, cr: np.ndarray) -> np.ndarray:
    """DC values in the order of an interleaved scan: (units, 6)."""
    rows, cols = cb.shape
    return np.concatenate((y.reshape(rows, 2, cols, 2).transpose(0, 2, 1, 3).reshape(-1, 4), cb.reshape(-1, 1), cr.reshape(-1, 1)), 1)


def _dc_bits(units: np.ndarray) -> np.ndarray:
    diff = np.empty_like(units)
    diff[:, :4] = np.diff(units[:, :4].ravel(), prepend=0).reshape(-1, 4)
    diff[:, 4:] = np.diff(units[:, 4:], axis=0, prepend=0)
    d = diff.ravel()
    size = np.ceil(np.log2(np.abs(d) + 1)).astype(int)
    value = np.where(d < 0, d + (1 << size) - 1, d)
    word = size << 8 | value << (8 - size)
    bits = (word[:, None] >> np.arange(11, -1, -1)) & 1
    return bits[np.arange(12) < (4 + size)[:, None]].astype(np.uint8)


def encode(data: bytes) -> bytes:
    """data, with bytes 0 up to a positive multiple of 64, as the coefficients of a 4:2:0 progressive JPEG.  A comment
    holds the numbers of bytes and blocks."""
    blocks = max(1, -(-len(data) // BLOCK))
    units = -(-blocks // 6)
    cols = int(np.ceil(np.sqrt(units)))
    rows = -(-units // cols)
    flat = np.zeros(rows * cols * 6 * BLOCK, np.uint8)
    flat[: len(data)] = np.frombuffer(data, np.uint8)
    flat = flat.reshape(-1, BLOCK)
    part = [flat[: 4 * rows * cols], flat[4 * rows * cols : 5 * rows * cols], flat[5 * rows * cols :]]
    shape = [(2 * rows, 2 * cols), (rows, cols), (rows, cols)]
    high = [(p >> 1) | 128 for p in part]  # (256 + byte) >> 1
    out = [b"\xff\xd8", _segment(0xFE, f"{len(data)} {blocks}".encode()), _TABLES]
    out.append(_segment(0xC2, bytes([8]) + (16 * rows).to_bytes(2, "big") + (16 * cols).to_bytes(2, "big") + bytes([3, 1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])))
    dc = [h[:, 0].astype(int).reshape(s) for h, s in zip(high, shape, strict=True)]
    out.append(_scan([(1, 0), (2, 0), (3, 0)], (0, 0), 0, 1, _dc_bits(_units(*dc))))
    for first, last in _BANDS:
        for c in range(3):
            bits = np.zeros((len(part[c]), last - first + 1, 9), np.uint8)
            bits[:, :, 1:] = np.unpackbits(high[c][:, first : last + 1, None], axis=2)
            out.append(_scan([(c + 1, 0)], (first, last), 0, 1, bits.ravel()))
    dc = [(p[:, 0] & 1).reshape(s) for p, s in zip(part, shape, strict=True)]
    out.append(_scan([(1, 0), (2, 0), (3, 0)], (0, 0), 1, 0, _units(*dc).ravel()))
    for c in range(3):
        bits = part[c] & 1
        bits[:, 0] = 0  # the code of a run of one block
        out.append(_scan([(c + 1, 1)], (1, 63), 1, 0, bits.ravel()))
    return b"".join(out) + b"\xff\xd9"


# --- reading -------------------------------------------------------------------------------------


@lru_cache(64)
def _huffman(lengths: bytes, symbols: bytes) -> _Huffman:
    return _Huffman(lengths, symbols)


class _Huffman:
    def __init__(self, lengths: bytes, symbols: bytes):
        self.code: dict[int, tuple[int, int]] = {}
        look = []
        code = k = 0
        for n, count in enumerate(lengths, 1):
            for _ in range(count):
                self.code[symbols[k]] = (code, n)
                look += [(n, symbols[k])] * (1 << (16 - n))
                code, k = code + 1, k + 1
            code <<= 1
        self.look = look + [(16, 0)] * ((1 << 16) - len(look))


class _Bits:
    """The bits of a scan, and the 16 that follow each place."""

    def __init__(self, data: bytes):
        self.raw = np.frombuffer(data.replace(b"\xff\x00", b"\xff"), np.uint8)
        self.bits = np.unpackbits(self.raw)
        self.at = 0
        self._ahead: list[int] | None = None

    def ahead(self) -> list[int]:
        if self._ahead is None:
            b = np.concatenate((self.raw, np.full(4, 255, np.uint8))).astype(np.uint32)
            three = b[:-2] << 16 | b[1:-1] << 8 | b[2:]
            self._ahead = ((three[:, None] >> (8 - np.arange(8, dtype=np.uint32))) & 0xFFFF).ravel().tolist()
        return self._ahead

    def symbol(self, h: _Huffman) -> int:
        n, s = h.look[self.ahead()[self.at]]
        self.at += n
        return s

    def take(self, n: int) -> int:
        v = self.ahead()[self.at] >> (16 - n)
        self.at += n
        return v

    def signed(self, n: int) -> int:
        v = self.take(n) if n else 0
        return v if not n or v >> (n - 1) else v - (1 << n) + 1


def _dc_first(bits: _Bits, h: list[_Huffman], count: int) -> np.ndarray:
    """(count, len(h)) differences, one table per column."""
    out, ahead, at = [], bits.ahead(), 0
    looks = [x.look for x in h] * count
    for look in looks:
        n, s = look[ahead[at]]
        at += n
        if s:
            v = ahead[at] >> (16 - s)
            at += s
            out.append(v if v >> (s - 1) else v - (1 << s) + 1)
        else:
            out.append(0)
    return np.array(out).reshape(count, len(h))


def _ac_first(bits: _Bits, h: _Huffman, coef: np.ndarray, first: int, last: int, low: int) -> None:
    n = last - first + 1
    for symbol, (code, length) in h.code.items():  # one layout: every coefficient has this symbol
        size = symbol & 15
        wide = length + size
        if symbol >> 4 == 0 and size and len(coef) * n * wide <= len(bits.bits) < len(coef) * n * wide + 8:
            rows = bits.bits[: len(coef) * n * wide].reshape(-1, wide)
            want = np.array([code >> (length - 1 - i) & 1 for i in range(length)], np.uint8)
            if (rows[:, :length] == want).all():
                if size <= 8:
                    value = np.packbits(rows[:, length:], axis=1).ravel().astype(np.int32) >> (8 - size)
                else:
                    value = rows[:, length:] @ (1 << np.arange(size - 1, -1, -1, dtype=np.int32))
                value = np.where(rows[:, length], value, value - (1 << size) + 1)
                coef[:, first : last + 1] = (value << low).reshape(-1, n)
                return
    run = 0
    for block in coef:
        if run:
            run -= 1
            continue
        k = first
        while k <= last:
            s = bits.symbol(h)
            skip, size = s >> 4, s & 15
            if size:
                k += skip
                block[k] = bits.signed(size) << low
                k += 1
            elif skip == 15:
                k += 16
            else:
                run = (1 << skip) - 1 + (bits.take(skip) if skip else 0)
                break


def _ac_refine(bits: _Bits, h: _Huffman, coef: np.ndarray, first: int, last: int, low: int) -> None:
    n = last - first + 1
    one = 1 << low
    if 0 in h.code and len(h.code):
        code, length = h.code[0]
        wide = length + n
        if len(coef) * wide <= len(bits.bits) < len(coef) * wide + 8 and coef[:, first : last + 1].all():
            rows = bits.bits[: len(coef) * wide].reshape(-1, wide)
            want = np.array([code >> (length - 1 - i) & 1 for i in range(length)], np.uint8)
            if (rows[:, :length] == want).all():  # one layout: every block is a run of its own, all its bits are corrections
                part = coef[:, first : last + 1]
                part += np.where(part > 0, one, -one) * rows[:, length:]
                return
    run = 0
    for block in coef:
        k = first
        if not run:
            while k <= last:
                s = bits.symbol(h)
                skip, size = s >> 4, s & 15
                fresh = 0
                if size:
                    fresh = one if bits.take(1) else -one
                elif skip < 15:
                    run = (1 << skip) + (bits.take(skip) if skip else 0)
                    break
                while k <= last:
                    if block[k]:
                        if bits.take(1):
                            block[k] += one if block[k] > 0 else -one
                    elif skip:
                        skip -= 1
                    else:
                        break
                    k += 1
                if fresh and k <= last:
                    block[k] = fresh
                k += 1
        if run:
            for j in range(k, last + 1):
                if block[j] and bits.take(1):
                    block[j] += one if block[j] > 0 else -one
            run -= 1


_MARKER = re.compile(b"\xff[^\x00\xd0-\xd7]", re.DOTALL)
_RESTART = re.compile(b"\xff[\xd0-\xd7]")


class Image:
    """A decoded stream: per component coef (blocks, 64) in scan order, size in blocks, sampling and quantisers."""

    def __init__(self, data: bytes):
        self.comment = b""
        quant, tables, at = {}, {}, 2
        self.interval = 0
        while data[at + 1] != 0xD9:
            marker, n = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
            body, at = data[at + 4 : at + 2 + n], at + 2 + n
            if marker == 0xFE:
                self.comment = body
            elif marker == 0xDB:
                while body:
                    wide = 2 if body[0] >> 4 else 1
                    quant[body[0] & 15] = np.frombuffer(body[1 : 1 + 64 * wide], ">u2" if wide == 2 else np.uint8).astype(float)
                    body = body[1 + 64 * wide :]
            elif marker == 0xC4:
                while body:
                    k = sum(body[1:17])
                    tables[body[0]] = _huffman(body[1:17], body[17 : 17 + k])
                    body = body[17 + k :]
            elif marker == 0xC2:
                self.height, self.width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
                self.parts = {body[6 + 3 * i]: (body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(body[5])}
                self.across, self.down = max(p[0] for p in self.parts.values()), max(p[1] for p in self.parts.values())
                self.cols, self.rows = -(-self.width // (8 * self.across)), -(-self.height // (8 * self.down))
                self.coef = {c: np.zeros((self.rows * v * self.cols * h, BLOCK), np.int32) for c, (h, v, _) in self.parts.items()}
                self.quant = {c: quant[q] for c, (_, _, q) in self.parts.items()}
            elif marker == 0xDA:
                end = _MARKER.search(data, at)
                if not end:
                    raise ValueError("a scan without an end")
                self._read(body, data[at : end.start()], tables)
                at = end.start()
            elif marker == 0xDD:
                self.interval = int.from_bytes(body, "big")
            elif 0xC0 <= marker <= 0xCF:
                raise ValueError("not a progressive Huffman-coded JPEG")

    def _order(self, c: int, alone: bool) -> np.ndarray:
        """Blocks of a component in the order of a scan: (units, blocks a unit)."""
        h, v, _ = self.parts[c]
        grid = np.arange(self.rows * v * self.cols * h).reshape(self.rows * v, self.cols * h)
        if alone:
            wide, tall = -(-self.width * h // (8 * self.across)), -(-self.height * v // (8 * self.down))
            return grid[:tall, :wide].reshape(-1, 1)
        return grid.reshape(self.rows, v, self.cols, h).transpose(0, 2, 1, 3).reshape(-1, v * h)

    def _read(self, head: bytes, data: bytes, tables: dict) -> None:
        """A scan; with a restart interval, each so many units of it stand alone behind a marker."""
        parts = [(head[1 + 2 * i], head[2 + 2 * i]) for i in range(head[0])]
        orders = [self._order(c, len(parts) == 1) for c, _ in parts]
        count = len(orders[0])
        step = self.interval or count
        made = _RESTART.split(data) if self.interval else [data]
        if len(made) != -(-count // step):
            raise ValueError(f"{len(made) - 1} restart markers where {-(-count // step) - 1} are due")
        for k, part in enumerate(made):
            if count:
                self._read_part(parts, head[-3:], part, [o[k * step : (k + 1) * step] for o in orders], tables)

    def _read_part(self, parts: list[tuple[int, int]], shape: bytes, data: bytes, orders: list[np.ndarray], tables: dict) -> None:
        first, last, approx = shape
        high, low, bits = approx >> 4, approx & 15, _Bits(data)
        if first:
            (c, t), order = parts[0], orders[0].ravel()
            coef = self.coef[c] if len(order) == len(self.coef[c]) else self.coef[c][order]
            (_ac_refine if high else _ac_first)(bits, tables[16 | t & 15], coef, first, last, low)
            if coef is not self.coef[c]:
                self.coef[c][order] = coef
            return
        wide = [o.shape[1] for o in orders]
        count = len(orders[0])
        if high:
            values = bits.bits[: count * sum(wide)].reshape(count, -1).astype(np.int32) << low
        else:
            values = _dc_first(bits, [tables[t >> 4] for (_, t), w in zip(parts, wide, strict=True) for _ in range(w)], count)
        at = 0
        for (c, _), o, w in zip(parts, orders, wide, strict=True):
            v, at = values[:, at : at + w].ravel(), at + w
            if high:
                self.coef[c][o.ravel(), 0] |= v
            else:
                self.coef[c][o.ravel(), 0] = np.cumsum(v) << low

    def plane(self, c: int) -> np.ndarray:
        """Samples of a component, 0 to 255, at the resolution it has in the stream."""
        h, v, _ = self.parts[c]
        natural = np.zeros((len(self.coef[c]), BLOCK))
        natural[:, ZIGZAG] = self.coef[c] * self.quant[c]
        # The small addend decides halves alike whatever the order of summation.
        x = np.floor(natural @ BASIS + (128.5 + 1e-6)).clip(0, 255).astype(np.uint8)
        return x.reshape(self.rows * v, self.cols * h, 8, 8).transpose(0, 2, 1, 3).reshape(self.rows * v * 8, self.cols * h * 8)

    def rgb(self) -> np.ndarray:
        """(height, width, 3), chroma upsampled to full resolution."""
        full = []
        for c, (h, v, _) in self.parts.items():
            p = self.plane(c)
            full.append(p.repeat(self.down // v, 0).repeat(self.across // h, 1)[: self.height, : self.width].astype(np.int32))
        if len(full) == 1:
            return np.repeat(full[0][:, :, None], 3, 2).astype(np.uint8)
        y, cb, cr = full[0], full[1] - 128, full[2] - 128
        out = np.empty((*y.shape, 3), np.uint8)  # fixed point, 16 bits
        out[:, :, 0] = (y + ((91881 * cr + 32768) >> 16)).clip(0, 255)
        out[:, :, 1] = (y - ((22554 * cb + 46802 * cr + 32768) >> 16)).clip(0, 255)
        out[:, :, 2] = (y + ((116130 * cb + 32768) >> 16)).clip(0, 255)
        return out

    def stored(self) -> tuple[bytes, int]:
        """The payload that encode() stored, and its length without padding."""
        n, blocks = map(int, self.comment.split())
        flat = np.concatenate([self.coef[c] for c in self.parts])[:blocks] - _SHIFT
        return flat.astype(np.uint8).tobytes(), n
