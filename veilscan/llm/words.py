"""Words of many texts at once in numpy: places, documents and 64-bit hashes, without a Python loop over words; and a
filter of keys of bounded size."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

STEP = np.uint64(0x100000001B3)
MIX = np.uint64(0x9E3779B97F4A7C15)
_folded: list[np.ndarray] = []


def _fold_table() -> np.ndarray:
    """Code point -> its lower-case code point where it belongs to a word, else 0."""
    if not _folded:
        t = np.zeros(sys.maxunicode + 1, np.uint32)
        for cp in range(sys.maxunicode + 1):
            c = chr(cp)
            if c.isalnum():
                t[cp] = ord(c.lower()[0])
        _folded.append(t)
    return _folded[0]


def powers(n: int, base: np.uint64) -> np.ndarray:
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Words:
    """codes: code points of all texts, a separator after each; per word: start and end in codes, doc, hash, counter
    (only digits)."""

    def __init__(self, texts: list[str]):
        joined = "\0".join(texts) + "\0"
        self.codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        low = _fold_table()[self.codes]
        flags = low > 0
        edge = np.diff(np.concatenate([[0], flags.view(np.int8), [0]]))
        self.start, self.end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        self.text_end = np.cumsum(lengths)
        self.text_start = self.text_end - lengths
        self.doc = np.searchsorted(self.text_end, self.start, "right")
        digit = (low >= 48) & (low <= 57)
        self.counter = np.zeros(len(self.start), bool)
        if not len(self.start):
            self.hash = np.zeros(0, np.uint64)
            return
        self.counter = self._all(digit)
        at = np.flatnonzero(flags)
        word = np.searchsorted(self.start, at, "right") - 1
        first = np.searchsorted(at, self.start)
        place = np.arange(len(at)) - first[word]
        value = low[at].astype(np.uint64) * powers(int(place.max()) + 1, STEP)[place]
        self.hash = np.add.reduceat(value, first) * MIX
        self.hash ^= self.hash >> np.uint64(29)

    def _all(self, flag: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flag)])
        return total[self.end] - total[self.start] == self.end - self.start

    def without_counters(self) -> Words:
        """The same words but those that are only digits."""
        out = object.__new__(Words)
        keep = ~self.counter
        out.codes, out.text_start, out.text_end = self.codes, self.text_start, self.text_end
        out.start, out.end, out.doc, out.hash, out.counter = self.start[keep], self.end[keep], self.doc[keep], self.hash[keep], self.counter[keep]
        return out

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Rolling hashes of n consecutive words of one text: (first word of each, hash)."""
        count = len(self.hash) - n + 1
        if count <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        h = np.zeros(count, np.uint64)
        for k, p in enumerate(powers(n, np.uint64(0xD6E8FEB86659FD93))):
            h += self.hash[k : k + count] * p
        at = np.flatnonzero(self.doc[:count] == self.doc[n - 1 :])
        return at, h[at]


def later(keys: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Whether the same key stood earlier in the same document; keys come in order of place."""
    mixed = keys ^ (docs.astype(np.uint64) * MIX + np.uint64(1)) * STEP
    out = np.ones(len(mixed), bool)
    out[np.unique(mixed, return_index=True)[1]] = False
    return out


# ---------------------------------------------------------------------------------------------- a filter of keys

FILTER_BITS = 1 << 30  # at most 128 MB are sent around; a fuller filter lets more through, and a join decides
SLICE_BITS = 1 << 19
SECOND = np.uint64(0xC2B2AE3D27D4EB4F)


def _probes(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    keys = keys.astype(np.uint64)
    return (keys * MIX) >> np.uint64(64 - bits.bit_length() + 1), (keys * SECOND) >> np.uint64(64 - bits.bit_length() + 1)


def _bits_of(bits: int):
    """Slices of the filter with the bits of one partition's keys."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        slices: dict[int, np.ndarray] = {}
        for batch in batches:
            for probe in _probes(batch["key"].to_numpy(np.int64), bits):
                for s in np.unique(probe // SLICE_BITS).tolist():
                    own = slices.setdefault(s, np.zeros(min(bits, SLICE_BITS), bool))
                    own[(probe[probe // SLICE_BITS == s] % SLICE_BITS).astype(np.int64)] = True
        yield pd.DataFrame([(s, np.packbits(own).tobytes()) for s, own in slices.items()], columns=["slice", "bits"])

    return run


def _either(rows: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"slice": rows["slice"].iloc[:1], "bits": [np.bitwise_or.reduce([np.frombuffer(b, np.uint8) for b in rows["bits"]]).tobytes()]})


def key_filter(keys: DataFrame, n_keys: int, most_bits: int | None = None) -> np.ndarray:
    """Packed bits that the long column ``key`` sets; at most FILTER_BITS of them, whatever the number of keys."""
    bits = min(most_bits or FILTER_BITS, 1 << max(16, (16 * n_keys).bit_length()))
    out = np.zeros(bits // 8, np.uint8)
    for r in keys.select("key").mapInPandas(_bits_of(bits), "slice long, bits binary").groupBy("slice").applyInPandas(_either, "slice long, bits binary").collect():
        out[r["slice"] * SLICE_BITS // 8 :][: min(bits, SLICE_BITS) // 8] = np.frombuffer(r["bits"], np.uint8)
    return out


def passing(packed: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Places of the keys that may be in the filter."""
    ok = np.arange(len(keys))
    for k in (0, 1):
        probe = _probes(keys[ok], len(packed) * 8)[k].astype(np.int64)
        ok = ok[(packed[probe >> 3] >> (7 - (probe & 7)).astype(np.uint8)) & 1 == 1]
    return ok
