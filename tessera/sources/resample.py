"""Band-limited change of the sample rate."""

from __future__ import annotations

from math import gcd

import numpy as np

#: Zero crossings of the filter to either side, its middle as a share of the lower Nyquist frequency, and the shape of its Kaiser window: 80 dB down from that frequency on, level up to five sixths of it.
CROSSINGS, MIDDLE, SHAPE = 32, 0.92, 7.86


class Resampler:
    """From one rate to another, both whole numbers: a windowed sinc in as many phases as the ratio has, so any part of a signal gives the samples that the whole gives."""

    def __init__(self, rate: int, to: int):
        g = gcd(rate, to)
        self.up, self.down = to // g, rate // g
        slow = min(1.0, to / rate)
        self.reach = 0 if rate == to else int(np.ceil(CROSSINGS / slow)) + 1
        at = np.arange(-self.reach, self.reach + 1)[None] - np.arange(self.up)[:, None] / self.up
        span = np.clip(1 - (at * slow / (CROSSINGS + 1)) ** 2, 0, None)
        taps = np.sinc(at * slow * MIDDLE) * np.i0(SHAPE * np.sqrt(span)) * (span > 0)
        self.taps = taps / taps.sum(axis=1, keepdims=True)  # a constant stays as it is in every phase

    def length(self, n: int) -> int:
        """Samples that n samples become."""
        return -(-n * self.up // self.down)

    def place(self, first: int) -> int:
        """The first of the new samples that doesn't begin before the old sample first."""
        return -(-first * self.up // self.down)

    def part(self, x: np.ndarray, base: int, a: int, b: int) -> np.ndarray:
        """New samples a to b, from old ones x that begin at base. What x doesn't reach to is silent."""
        if self.up == self.down:
            return x[a - base : b - base].astype(np.float32)
        out = np.empty(max(0, b - a), np.float32)
        if not len(out):
            return out
        low, high = a * self.down // self.up - self.reach, (b - 1) * self.down // self.up + self.reach + 1
        held = np.zeros(high - low)
        i, j = max(low, base), min(high, base + len(x))
        if j > i:
            held[i - low : j - low] = x[i - base : j - base]
        views = np.lib.stride_tricks.sliding_window_view(held, 2 * self.reach + 1)
        for m in range(a, min(b, a + self.up)):  # the samples of one phase lie down apart
            rows = views[m * self.down // self.up - self.reach - low :: self.down]
            of = out[m - a :: self.up]
            of[:] = rows[: len(of)] @ self.taps[m * self.down % self.up]
        return out


def resampled(x: np.ndarray, rate: int, to: int) -> np.ndarray:
    """A whole signal at another rate."""
    if rate == to or not len(x):
        return x.astype(np.float32)
    r = Resampler(rate, to)
    return r.part(x, 0, 0, r.length(len(x)))
