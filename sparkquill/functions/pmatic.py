"""Bit-wise coding that tolerates small differences between the encoder's and the decoder's model.

A token is the bits of its number; each bit has a conditional probability given the bits before it.
The encoder sends, besides the bit, a helper bit that says how the probability was rounded, so that a
decoder whose probabilities differ by at most ``delta`` rounds to the same value.
"""

from __future__ import annotations

import math

import numpy as np

from sparkquill.functions.coder import Decoder, Encoder

TOTAL = 1 << 18


def radius(delta: float, safety: float = 1.01) -> float:
    """The half width of a rounding bin: 1 / (2 m), the greatest m with bins wider than twice delta."""
    if not 0 < delta < 0.25:
        raise ValueError("delta lies between 0 and 1/4")
    m = math.floor(1 / (2 * (2 * delta * safety)) - 1e-12)
    r = 1 / (2 * max(m, 1))
    if r <= 2 * delta:
        raise ValueError("delta leaves no room for bins")
    return r


def quantise(p: float, delta: float, r: float) -> tuple[int, float]:
    """Helper bit and rounded probability: a bin's centre, or near an inner boundary that boundary."""
    m = round(1 / (2 * r))
    k = min(int(p / (2 * r)), m - 1)
    nearest = round(p / (2 * r))
    if 0 < nearest < m and abs(p - nearest * 2 * r) < delta:
        return 1, nearest * 2 * r
    return 0, (2 * k + 1) * r


def requantise(q: float, helper: int, r: float) -> float:
    """The encoder's rounded probability, from the decoder's own and the helper bit."""
    m = round(1 / (2 * r))
    if helper:
        return min(max(round(q / (2 * r)), 1), m - 1) * 2 * r
    return (2 * min(int(q / (2 * r)), m - 1) + 1) * r


def padded(p: np.ndarray) -> np.ndarray:
    """Probabilities of a number of tokens that is a power of two; added ones have none."""
    size = 1 << max(0, len(p) - 1).bit_length()
    out = np.zeros(size)
    out[: len(p)] = p
    return out / out.sum()


def conditional_ones(p: np.ndarray) -> list[np.ndarray]:
    """For each depth and prefix, the probability that the next bit is 1; 1/2 where the prefix has none."""
    levels, mass = [], p
    while len(mass) > 1:
        pair = mass.reshape(-1, 2)
        total = pair.sum(1)
        levels.append(np.where(total > 0, pair[:, 1] / np.where(total > 0, total, 1), 0.5))
        mass = total
    return levels[::-1]


def greatest_difference(p: np.ndarray, q: np.ndarray) -> float:
    """Of the conditional probabilities of two models over all prefixes."""
    return max((float(np.abs(a - b).max()) for a, b in zip(conditional_ones(padded(p)), conditional_ones(padded(q)), strict=True)), default=0.0)


def _ones(p: float) -> int:
    p = min(max(p, 1e-12), 1 - 1e-12)
    return min(max(int(p * TOTAL), 1), TOTAL - 1)


#: The helper bit's own probability of being 1.
def _helper_ones(delta: float, r: float) -> int:
    return _ones(min(0.5, delta / r))


def encode(tokens, probabilities, delta: float) -> tuple[list[int], float]:
    """Bits of tokens under a probability vector for each, and the share of helper bits that are 1."""
    r, coder, helpers, steps = radius(delta), Encoder(), 0, 0
    h = _helper_ones(delta, r)
    for token, p in zip(tokens, probabilities, strict=True):
        levels = conditional_ones(padded(np.asarray(p, float)))
        for depth, level in enumerate(levels):
            shift = len(levels) - 1 - depth
            helper, q = quantise(float(level[token >> shift + 1]), delta, r)
            coder.put(*((TOTAL - h, TOTAL) if helper else (0, TOTAL - h)), TOTAL)
            ones = _ones(q)
            coder.put(*((TOTAL - ones, TOTAL) if token >> shift & 1 else (0, TOTAL - ones)), TOTAL)
            helpers, steps = helpers + helper, steps + 1
    return coder.finished(), helpers / steps if steps else 0.0


def decode(bits, probabilities, delta: float) -> list[int]:
    """Tokens, from probabilities that may differ from the encoder's by up to delta."""
    r, coder, out = radius(delta), Decoder(bits), []
    h = _helper_ones(delta, r)

    def bit(ones: int) -> int:
        one = int(coder.slot(TOTAL) >= TOTAL - ones)
        coder.take(*((TOTAL - ones, TOTAL) if one else (0, TOTAL - ones)), TOTAL)
        return one

    for p in probabilities:
        token = 0
        for level in conditional_ones(padded(np.asarray(p, float))):
            q = requantise(float(level[token]), bit(h), r)
            token = token << 1 | bit(_ones(q))
        out.append(token)
    return out


def nearby(p: np.ndarray, delta: float, seed: int) -> np.ndarray:
    """A vector near p whose conditional probabilities differ by at most delta; p itself if none is found."""
    noise = np.random.default_rng(seed).standard_normal(len(p)) * delta
    for _ in range(30):
        q = np.clip(p * (1 + noise), 1e-12, None)
        q /= q.sum()
        if greatest_difference(p, q) <= delta:
            return q
        noise /= 2
    return p
