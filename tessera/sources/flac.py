"""FLAC, read by place and written: lossless frames of constant, verbatim, fixed and linearly predicted channels with Rice-coded residuals.

Bits are handled as arrays, a frame at a time. Reading looks for a frame by halving the file where a part is asked for, so a file isn't decoded from its start. A frame whose checksum is wrong is an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from operator import mul

import numpy as np

BLOCK = 4096
#: The format's codes for block sizes, rates and widths, and the weights of its fixed predictors.
BLOCKS = {1: 192, **{k: 576 << k - 2 for k in range(2, 6)}, **{k: 256 << k - 8 for k in range(8, 16)}}
RATES = {1: 88_200, 2: 176_400, 3: 192_000, 4: 8000, 5: 16_000, 6: 22_050, 7: 24_000, 8: 32_000, 9: 44_100, 10: 48_000, 11: 96_000}
WIDTHS = {1: 8, 2: 12, 4: 16, 5: 20, 6: 24, 7: 32}
FIXED = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))
LEFT_SIDE, RIGHT_SIDE, MID_SIDE = 8, 9, 10


def _crc_table(poly: int, bits: int) -> list[int]:
    out = []
    for k in range(256):
        c = k << bits - 8
        for _ in range(8):
            c = (c << 1) ^ (poly if c >> bits - 1 else 0)
            c &= (1 << bits) - 1
        out.append(c)
    return out


_CRC8, _CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)


def crc8(data: bytes) -> int:
    c = 0
    for b in data:
        c = _CRC8[c ^ b]
    return c


def crc16(data: bytes) -> int:
    c = 0
    for b in data:
        c = (c << 8) & 0xFFFF ^ _CRC16[c >> 8 ^ b]
    return c


class Bits:
    """Bits of a frame, read in turn."""

    def __init__(self, data: bytes, at: int = 0):
        self.bits = np.unpackbits(np.frombuffer(data, np.uint8))
        self.at = at
        place = np.where(self.bits, np.arange(len(self.bits)), len(self.bits))
        self.one = np.minimum.accumulate(place[::-1])[::-1].tolist()  # where the next 1 is

    def take(self, n: int) -> int:
        if self.at + n > len(self.bits):
            raise EOFError
        out = 0
        for b in self.bits[self.at : self.at + n].tolist():
            out = out << 1 | b
        self.at += n
        return out

    def signed(self, n: int) -> int:
        x = self.take(n)
        return x - (1 << n) if n and x >> n - 1 else x

    def unary(self) -> int:
        if self.at >= len(self.one) or self.one[self.at] >= len(self.bits):
            raise EOFError
        n = self.one[self.at] - self.at
        self.at += n + 1
        return n

    def array(self, count: int, n: int) -> np.ndarray:
        """count signed numbers of n bits."""
        if self.at + count * n > len(self.bits):
            raise EOFError
        b = self.bits[self.at : self.at + count * n].reshape(count, n).astype(np.int64)
        self.at += count * n
        x = b @ (1 << np.arange(n - 1, -1, -1, dtype=np.int64)) if n else np.zeros(count, np.int64)
        return np.where(x >> max(0, n - 1) & 1, x - (1 << n), x) if n else x

    def rice(self, count: int, k: int) -> np.ndarray:
        """count signed numbers in Rice code: zeros up to a 1, then k bits; even ones are positive."""
        one, p, ends, step = self.one, self.at, [], k + 1
        size = len(self.bits)
        for _ in range(count):
            if p >= size:
                raise EOFError
            q = one[p]
            ends.append(q)
            p = q + step
        if p > size:
            raise EOFError
        end = np.array(ends, np.int64)
        begin = np.concatenate(([self.at], end[:-1] + step)) if count else end
        x = (end - begin) << k
        for j in range(k):
            x |= self.bits[end + 1 + j].astype(np.int64) << k - 1 - j
        self.at = p
        return (x >> 1) ^ -(x & 1)


@dataclass
class Head:
    """A frame's header: its first sample, samples, channels or how two of them are told, width, and bytes of the header."""

    first: int
    size: int
    mode: int
    width: int
    length: int


def header(data: bytes, rate: int, width: int, block: int) -> Head | None:
    """The header that data begins with; None if it is none, or broken."""
    if len(data) < 6 or data[0] != 0xFF or data[1] & 0xFE != 0xF8:
        return None
    by_sample, size, hertz, mode, bits = data[1] & 1, data[2] >> 4, data[2] & 15, data[3] >> 4, data[3] >> 1 & 7
    if size == 0 or hertz == 15 or mode > MID_SIDE or bits == 3 or data[3] & 1:
        return None
    lead = data[4]
    more = 0 if lead < 0x80 else 8 - (lead ^ 0xFF).bit_length() - 1
    if more < 0 or more > 6 or lead & 0xC0 == 0x80:
        return None
    number, at = (lead & (0x7F >> more + (more > 0))), 5
    tail = data[5 : 5 + more]
    if len(tail) < more or any(b & 0xC0 != 0x80 for b in tail):
        return None
    for b in tail:
        number = number << 6 | b & 0x3F
    at += more
    n = BLOCKS.get(size)
    if n is None:
        n = int.from_bytes(data[at : at + size - 5], "big") + 1
        at += size - 5
    at += {12: 1, 13: 2, 14: 2}.get(hertz, 0)
    if at >= len(data) or crc8(data[:at]) != data[at]:
        return None
    return Head(number if by_sample else number * block, n, mode, WIDTHS.get(bits, width), at + 1)


def _channel(bits: Bits, n: int, width: int) -> np.ndarray:
    if bits.take(1):
        raise ValueError("a broken channel")
    kind = bits.take(6)
    wasted = bits.unary() + 1 if bits.take(1) else 0
    width -= wasted
    if kind == 0:
        x = np.full(n, bits.signed(width), np.int64)
    elif kind == 1:
        x = bits.array(n, width)
    elif 8 <= kind <= 12:
        order = kind - 8
        x = _restored(bits.array(order, width), _residual(bits, n, order), order)
    elif kind >= 32:
        order = kind - 31
        warm = bits.array(order, width)
        precision = bits.take(4) + 1
        shift = bits.signed(5)
        weights = bits.array(order, precision).tolist()
        if precision == 16 or shift < 0:
            raise ValueError("a broken predictor")
        x = _predicted(warm, _residual(bits, n, order), weights, shift)
    else:
        raise ValueError("a channel of an unknown kind")
    return x << wasted


def _restored(warm: np.ndarray, residual: np.ndarray, order: int) -> np.ndarray:
    """Undoes a fixed predictor, that is order differences: the first value of each difference comes from the warm-up."""
    d = residual
    for k in range(order - 1, -1, -1):
        start = np.diff(warm, k)[-1] if k < len(warm) else 0
        d = np.cumsum(np.concatenate(([start], d)))[1:]
    return np.concatenate((warm, d))


def _predicted(warm: np.ndarray, residual: np.ndarray, weights: list[int], shift: int) -> np.ndarray:
    x, order = warm.tolist(), len(weights)
    back = weights[::-1]
    for r in residual.tolist():
        x.append(r + (sum(map(mul, back, x[-order:])) >> shift))
    return np.array(x, np.int64)


def _residual(bits: Bits, n: int, order: int) -> np.ndarray:
    method = bits.take(2)
    if method > 1:
        raise ValueError("a residual of an unknown kind")
    size, parts = 4 + method, 1 << bits.take(4)
    if n % parts or n // parts < order:
        raise ValueError("a broken residual")
    out = []
    for p in range(parts):
        count = n // parts - (order if p == 0 else 0)
        k = bits.take(size)
        out.append(bits.array(count, bits.take(5)) if k == (1 << size) - 1 else bits.rice(count, k))
    return np.concatenate(out)


def frame(data: bytes, head: Head) -> tuple[np.ndarray, int]:
    """Samples (n, channels) of the frame that data begins with, and its bytes."""
    bits = Bits(data, 8 * head.length)
    two = head.mode >= LEFT_SIDE
    wide = {LEFT_SIDE: 1, RIGHT_SIDE: 0, MID_SIDE: 1}.get(head.mode)
    got = [_channel(bits, head.size, head.width + (two and k == wide)) for k in range(2 if two else head.mode + 1)]
    end = -(-bits.at // 8)
    if len(data) < end + 2:
        raise EOFError
    if crc16(data[:end]) != int.from_bytes(data[end : end + 2], "big"):
        raise ValueError("a frame's checksum is wrong")
    if head.mode == LEFT_SIDE:
        got[1] = got[0] - got[1]
    elif head.mode == RIGHT_SIDE:
        got[0] = got[0] + got[1]
    elif head.mode == MID_SIDE:
        mid = got[0] << 1 | got[1] & 1
        got = [(mid + got[1]) >> 1, (mid - got[1]) >> 1]
    return np.stack(got, axis=1), end + 2


@dataclass
class Flac:
    """An open FLAC file."""

    file: object
    size: int
    rate: int
    channels: int
    width: int
    frames: int
    block: int
    most: int
    at: int

    @classmethod
    def opened(cls, file, size: int) -> Flac:
        if file.read(4) != b"fLaC":
            raise ValueError("not a FLAC file")
        info, at = None, 4
        while True:
            head = file.read(4)
            if len(head) < 4:
                raise ValueError("the FLAC file ends early")
            n = int.from_bytes(head[1:], "big")
            if head[0] & 127 == 0:
                info = file.read(n)
            at += 4 + n
            file.seek(at)
            if head[0] & 128:
                break
        if info is None or len(info) < 18:
            raise ValueError("no description in the FLAC file")
        packed = int.from_bytes(info[10:18], "big")
        rate, channels, width = packed >> 44, (packed >> 41 & 7) + 1, (packed >> 36 & 31) + 1
        largest = int.from_bytes(info[7:10], "big")
        block = int.from_bytes(info[2:4], "big")
        return cls(file, size, rate, channels, width, packed & (1 << 36) - 1, block, largest or block * channels * 5 + 64, at)

    def _fits(self, head: Head) -> bool:
        return head.size <= max(self.block, 16) and head.first + head.size <= max(self.frames, head.size) and head.width == self.width and (2 if head.mode >= LEFT_SIDE else head.mode + 1) == self.channels

    def _find(self, low: int, high: int) -> tuple[int, Head] | None:
        """The first whole frame that begins at low or later, before high. Its checksum tells it from samples that look like a header."""
        while low < high:
            self.file.seek(low)
            data = self.file.read(min(high - low, 2 * self.most) + 16)
            k = data.find(b"\xff")
            while 0 <= k < min(len(data) - 5, high - low):
                head = header(data[k : k + 16], self.rate, self.width, self.block)
                if head is not None and self._fits(head) and self._sound(low + k, head, data[k:]):
                    return low + k, head
                k = data.find(b"\xff", k + 1)
            low += max(1, len(data) - 16)
        return None

    def _sound(self, at: int, head: Head, data: bytes) -> bool:
        try:
            frame(data, head)
        except EOFError:
            try:
                self._decoded(at, head)
            except ValueError:
                return False
        except ValueError:
            return False
        return True

    def _place(self, sample: int) -> int:
        """A place in the file from which on the frame with the sample is found."""
        low, high = self.at, self.size
        while high - low > 2 * self.most:
            mid = (low + high) // 2
            got = self._find(mid, high)
            if got is not None and got[1].first <= sample:
                low = got[0]
            else:
                high = mid
        return low

    def parts(self, a: int, b: int) -> Iterator[tuple[int, np.ndarray]]:
        """(first sample, samples) of the frames from the one with sample a on, up to sample b."""
        got = self._find(self._place(a), self.size)
        while got is not None and got[1].first + got[1].size <= a:
            got = self._find(got[0] + got[1].length, self.size)
        due = a
        while due < b:
            if got is None or got[1].first > due:
                raise ValueError("a frame is missing or broken in the FLAC file")
            at, head = got
            x, n = self._decoded(at, head)
            yield head.first, x
            due = head.first + head.size
            got = self._next(at + n) if due < b else None

    def _next(self, at: int) -> tuple[int, Head] | None:
        self.file.seek(at)
        head = header(self.file.read(16), self.rate, self.width, self.block)
        return (at, head) if head is not None and self._fits(head) else None

    def _decoded(self, at: int, head: Head) -> tuple[np.ndarray, int]:
        n = self.most + 16
        while True:
            self.file.seek(at)
            data = self.file.read(n)
            try:
                return frame(data, head)
            except EOFError:
                if len(data) < n:
                    raise ValueError("the FLAC file ends early") from None
                n *= 2

    def whole(self, a: int, b: int) -> np.ndarray:
        """Samples a to b of all channels, as whole numbers."""
        if b <= a:
            return np.zeros((0, self.channels), np.int64)
        parts = [x[max(0, a - first) : b - first] for first, x in self.parts(a, b)]
        return np.concatenate(parts)

    def read(self, a: int, b: int) -> np.ndarray:
        """Samples a to b as one channel from -1 to 1, their mean."""
        return (self.whole(a, b).mean(axis=1) / (1 << self.width - 1)).astype(np.float32)


class Packed:
    """Bits to be written."""

    def __init__(self) -> None:
        self.parts: list[np.ndarray] = []

    def put(self, value: int, n: int) -> None:
        self.array(np.array([value]), n)

    def array(self, x: np.ndarray, n: int) -> None:
        self.parts.append((x.astype(np.int64)[:, None] >> np.arange(n - 1, -1, -1) & 1).astype(np.uint8).ravel())

    def rice(self, x: np.ndarray, k: int) -> None:
        u = np.where(x < 0, -2 * x - 1, 2 * x)
        end = np.cumsum((u >> k) + 1 + k)
        out = np.zeros(int(end[-1]) if len(end) else 0, np.uint8)
        stop = end - k - 1
        out[stop] = 1
        for j in range(k):
            out[stop + 1 + j] = u >> k - 1 - j & 1
        self.parts.append(out)

    def bytes(self) -> bytes:
        return np.packbits(np.concatenate(self.parts)).tobytes()


def _linear(x: np.ndarray, order: int, precision: int = 12) -> tuple[list[int], int] | None:
    """Weights of a linear predictor as whole numbers, with their shift, by the autocorrelation of the windowed samples."""
    f = x * np.hanning(len(x))
    r = np.array([f[: len(f) - k] @ f[k:] for k in range(order + 1)])
    if r[0] <= 0:
        return None
    at = np.abs(np.arange(order)[:, None] - np.arange(order)[None])
    try:
        w = np.linalg.solve(r[at] + np.eye(order) * r[0] * 1e-9, r[1:])
    except np.linalg.LinAlgError:
        return None
    top = np.abs(w).max()
    if not np.isfinite(top) or top <= 0:
        return None
    shift = int(min(15, precision - 2 - np.floor(np.log2(top))))
    if shift < 0:
        return None
    most = (1 << precision - 1) - 1
    return np.clip(np.rint(w * (1 << shift)), -most - 1, most).astype(int).tolist(), shift


def _rice_plan(residual: np.ndarray, n: int, order: int) -> tuple[int, int, list[int]]:
    """Bits, partition order and parameters of the best of some ways to code a residual."""
    best = None
    u = np.where(residual < 0, -2 * residual - 1, 2 * residual)
    for depth in range(7):
        parts = 1 << depth
        if n % parts or n // parts <= order:
            break
        cuts = np.arange(1, parts) * (n // parts) - order
        total, ks = 6, []
        for part in np.split(u, cuts):
            mean = part.mean() if len(part) else 0
            guess = max(0, int(np.log2(mean))) if mean >= 1 else 0
            cost, k = min(((int((part >> k).sum()) + len(part) * (k + 1), k) for k in range(max(0, guess - 1), min(30, guess + 1) + 1)))
            total += cost + 5
            ks.append(k)
        if best is None or total < best[0]:
            best = (total, depth, ks)
    return best


def _subframe(x: np.ndarray, width: int) -> tuple[int, list]:
    """Bits and parts (number, width or a residual's plan) of a channel in the shortest of the ways."""
    n = len(x)
    if (x == x[0]).all():
        return 8 + width, [("put", 0, 8), ("array", x[:1], width)]
    best = (8 + n * width, [("put", 2, 8), ("array", x, width)])
    for order, weights in enumerate(FIXED):
        if order < n:
            residual = np.diff(x, order)
            plan = _rice_plan(residual, n, order)
            cost = 8 + order * width + plan[0]
            if cost < best[0]:
                best = (cost, [("put", (8 + order) << 1, 8), ("array", x[:order], width), ("rice", residual, plan, order)])
    order = 8
    found = _linear(x.astype(float), order) if n > 64 and width <= 25 else None
    if found is not None:
        weights, shift = found
        guess = np.zeros(n - order, np.int64)
        for j, w in enumerate(weights):
            guess += w * x[order - 1 - j : n - 1 - j]
        residual = x[order:] - (guess >> shift)
        plan = _rice_plan(residual, n, order)
        cost = 8 + order * width + 9 + 12 * order + plan[0]
        if cost < best[0] and np.abs(residual).max() < 1 << 30:
            best = (cost, [("put", (31 + order) << 1, 8), ("array", x[:order], width), ("put", 11, 4), ("put", shift, 5), ("array", np.array(weights), 12), ("rice", residual, plan, order)])
    return best


def _write(out: Packed, parts: list, n: int) -> None:
    for kind, *x in parts:
        if kind != "rice":
            getattr(out, kind)(*x)
            continue
        residual, (_, depth, ks), order = x
        wide = max(ks) > 14
        out.put(int(wide), 2)
        out.put(depth, 4)
        cuts = np.arange(1, 1 << depth) * (n >> depth) - order
        for part, k in zip(np.split(residual, cuts), ks):
            out.put(k, 4 + wide)
            out.rice(part, k)


def _number(x: int) -> bytes:
    """A frame's number in as many bytes as it needs."""
    if x < 0x80:
        return bytes([x])
    more = next(k for k in range(1, 7) if x < 1 << (6 - k) + 6 * k)
    lead = (0xFF << 7 - more) & 0xFF | x >> 6 * more
    return bytes([lead, *(0x80 | x >> 6 * k & 0x3F for k in range(more - 1, -1, -1))])


def encoded(x: np.ndarray, rate: int, width: int = 16, block: int = BLOCK) -> bytes:
    """Samples (n, channels) as whole numbers of width bits (8, 12, 16, 20 or 24) in a FLAC file."""
    n, channels = x.shape
    x = x.astype(np.int64)
    if not 1 <= channels <= 8 or width not in WIDTHS.values() or width > 24 or (n and (x.max() >= 1 << width - 1 or x.min() < -(1 << width - 1))):
        raise ValueError(f"{channels} channels of {width} bits")
    frames, code = [], {v: k for k, v in WIDTHS.items()}[width]
    hertz = {v: k for k, v in RATES.items()}.get(rate, 0)
    for k, a in enumerate(range(0, n, block)):
        part = x[a : a + block]
        size = len(part)
        ways = [(channels - 1, [_subframe(part[:, c], width) for c in range(channels)])]
        if channels == 2:
            left, right = ways[0][1]
            side, mid = _subframe(part[:, 0] - part[:, 1], width + 1), _subframe((part[:, 0] + part[:, 1]) >> 1, width)
            ways += [(LEFT_SIDE, [left, side]), (RIGHT_SIDE, [side, right]), (MID_SIDE, [mid, side])]
        mode, channel = min(ways, key=lambda w: sum(c[0] for c in w[1]))
        head = bytes([0xFF, 0xF8, 7 << 4 | hertz, mode << 4 | code << 1]) + _number(k) + (size - 1).to_bytes(2, "big")
        out = Packed()
        for c in channel:
            _write(out, c[1], size)
        data = head + bytes([crc8(head)]) + out.bytes()
        frames.append(data + crc16(data).to_bytes(2, "big"))
    raw = (x[:, :, None] >> np.arange(0, 8 * -(-width // 8), 8) & 0xFF).astype(np.uint8).tobytes()
    sizes = [len(f) for f in frames] or [0]
    info = block.to_bytes(2, "big") * 2 + min(sizes).to_bytes(3, "big") + max(sizes).to_bytes(3, "big") + (rate << 44 | channels - 1 << 41 | width - 1 << 36 | n).to_bytes(8, "big") + hashlib.md5(raw).digest()
    return b"fLaC" + bytes([0x80]) + len(info).to_bytes(3, "big") + info + b"".join(frames)
