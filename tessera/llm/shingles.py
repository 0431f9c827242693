"""Tokens, shingle sets and their sketches.

Tokens are maximal runs of Unicode letters and numbers of the lower-cased text.  A text in one of
the ``char_langs`` is the set of all sequences of ``char_n`` consecutive characters of its joined
tokens, any other text the set of all sequences of ``word_n`` consecutive tokens.  Shingles are
64-bit mixes; sets are sorted arrays of distinct values.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import xxhash

#: Maximal runs of letters and numbers: exactly the characters for which str.isalnum() holds.
TOKEN = re.compile(r"[^\W_]+")

_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)

_S30, _S27, _S31 = np.uint64(30), np.uint64(27), np.uint64(31)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> _S30)) * _M2
    x = (x ^ (x >> _S27)) * _M3
    return x ^ (x >> _S31)


@dataclass(frozen=True)
class ShingleRule:
    """Defaults are the general ones (five words); queries state their own."""

    word_n: int = 5
    char_n: int = 5
    char_langs: tuple[str, ...] = ("ja",)


class _TokenHashes(dict):
    def __missing__(self, token: str) -> int:
        h = self[token] = xxhash.xxh3_64_intdigest(token.encode("utf-8", "surrogatepass"))
        return h


class Shingler:
    """Turns texts into sorted shingle sets; holds a bounded cache of token hashes.

    A shingle is the mix of a sum of its units, each times the odd multiplier of its place."""

    def __init__(self, rule: ShingleRule, cache: int = 200_000):
        self.rule, self.cache, self._known = rule, cache, _TokenHashes()
        self._places = np.random.default_rng(11).integers(0, 2**63, size=max(rule.word_n, rule.char_n), dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def _token_hashes(self, tokens: list[str]) -> np.ndarray:
        if len(self._known) > self.cache:
            self._known.clear()
        return np.fromiter(map(self._known.__getitem__, tokens), dtype=np.uint64, count=len(tokens))

    def __call__(self, text: str, lang: str | None, salt: np.uint64 = np.uint64(0)) -> np.ndarray:
        """``salt`` keeps sets of different kinds apart: with another salt no shingle is the same."""
        tokens = TOKEN.findall(text.lower())
        if lang in self.rule.char_langs:
            n = self.rule.char_n
            units = np.frombuffer("".join(tokens).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
            units = mix(units * _M1 + np.uint64(1))
        else:
            n = self.rule.word_n
            units = self._token_hashes(tokens)
        count = len(units) - n + 1
        if count < 1:
            return np.empty(0, dtype=np.uint64)
        h = np.full(count, salt, dtype=np.uint64)
        for i in range(n):
            h += units[i : i + count] * self._places[i]
        h = mix(h)
        h.sort()
        return h[np.concatenate([[True], h[1:] != h[:-1]])]


#: Parity bits of the short sketch; the other 16 bits of its two words hold the set's size.
SHORT = 112
#: Steps per doubling of the size code.
SIZE_STEPS = 1024
SIZE_SHIFT = 48


@dataclass(frozen=True)
class SketchPlan:
    """``samples`` minwise samples in disjoint bands of ``rows``, all folded into one odd sketch of ``bits`` bits.

    A pair at similarity s shares a band with probability 1 - (1 - s**rows)**bands, for the default 96
    bands 0.9996 at s = 0.6, 0.99999 at 0.65 and more beyond.  Five rows keep what merely shares common
    phrases apart: at s = 0.05 one pair in 30,000 shares a band.  ``slack`` is how far the sketch's
    estimate may lie below the threshold before a candidate is dropped without exact verification: five
    standard deviations of the estimate.
    """

    samples: int = 480
    rows: int = 5
    bits: int = 1024
    slack: float = 0.17
    seed: int = 7

    @property
    def bands(self) -> int:
        return self.samples // self.rows


class Sketcher:
    def __init__(self, plan: SketchPlan):
        self.plan = plan
        rng = np.random.default_rng(plan.seed)
        self._a = rng.integers(0, 2**31, size=(plan.samples, 1), dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        self._b = rng.integers(0, 2**32, size=(plan.samples, 1), dtype=np.uint32)
        # no sample serves two bands, so that bands are independent
        self._bands = np.arange(plan.bands * plan.rows).reshape(-1, plan.rows)

    def minima(self, sets: list[np.ndarray]) -> np.ndarray:
        """(samples, texts): the minwise samples of non-empty sets.

        Shingles are mixed already, so the upper half of one, times an odd number, orders them at random;
        blocks of 1,024 shingles stay in the cache."""
        out = np.full((len(sets), self.plan.samples), np.uint32(0xFFFFFFFF))
        for row, s in zip(out, sets):
            short = (s >> np.uint64(32)).astype(np.uint32)
            for at in range(0, len(short), 1024):
                h = self._a * short[at : at + 1024]
                h += self._b
                np.minimum(row, h.min(axis=1), out=row)
        return np.ascontiguousarray(out.T).astype(np.uint64)

    def band_keys(self, minima: np.ndarray) -> np.ndarray:
        """(texts, bands): one 64-bit key per band, different bands never share a key space."""
        h = np.repeat(np.arange(1, self.plan.bands + 1, dtype=np.uint64)[:, None], minima.shape[1], axis=1)
        for i in range(self.plan.rows):
            h = mix(h * _M1 + minima[self._bands[:, i]])
        return np.ascontiguousarray(h.T)

    def odd_sketches(self, minima: np.ndarray) -> np.ndarray:
        """(texts, bits / 64): parity bitmaps; every (position, minimum) toggles one bit."""
        p = self.plan
        texts = minima.shape[1]
        parity = np.zeros((texts, p.bits), dtype=np.uint8)
        rows = np.arange(texts)
        places = np.arange(1, p.samples + 1, dtype=np.uint64) * _M1
        for i in range(p.samples):
            bit = (mix(minima[i] + places[i]) % np.uint64(p.bits)).astype(np.int64)
            parity[rows, bit] ^= 1
        return np.packbits(parity, axis=1, bitorder="little").view(np.uint64)

    def short_sketches(self, minima: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """(texts, 2): a parity bit of each of the first 112 samples and the size of the set on a logarithmic
        scale, small enough to travel with postings."""
        parity = np.zeros((minima.shape[1], 128), dtype=np.uint8)
        parity[:, :SHORT] = (mix(minima[:SHORT] + _M1) & np.uint64(1)).astype(np.uint8).T
        words = np.packbits(parity, axis=1, bitorder="little").view(np.uint64)
        words[:, 1] |= np.floor(SIZE_STEPS * np.log2(sizes)).astype(np.uint64) << np.uint64(SIZE_SHIFT)
        return words

    @staticmethod
    def most_short_bits(threshold: float) -> int:
        """Differing short bits beyond which a pair is below the threshold: the mean at the threshold, where a
        bit differs with probability (1 - s) / 2, plus five standard deviations."""
        p = (1 - threshold) / 2
        return int(np.ceil(SHORT * p + 5 * np.sqrt(SHORT * p * (1 - p))))

    @staticmethod
    def most_size_steps(threshold: float) -> int:
        """Difference of size codes beyond which the threshold is out of reach: sizes differ by 1 / s at most."""
        return int(np.ceil(SIZE_STEPS * np.log2(1 / threshold))) + 1

    def most_differing_bits(self, threshold: float) -> int:
        """The XOR population count above which the estimated similarity is below threshold - slack.

        With k samples, two sketches at similarity s differ in k' = 2k(1 - s) toggles, and n bits that
        receive k' toggles hold n/2 (1 - exp(-2k'/n)) ones on average.
        """
        p = self.plan
        s = max(0.0, threshold - p.slack)
        toggles = 2 * p.samples * (1 - s)
        return int(np.ceil(p.bits / 2 * (1 - np.exp(-2 * toggles / p.bits))))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Exact similarity of two sorted sets; two empty sets are similar to nothing (0)."""
    if not len(a) or not len(b):
        return 0.0
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / (len(a) + len(b) - common)
