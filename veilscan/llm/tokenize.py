"""Byte-level BPE encoding of whole texts on padded numpy matrices.

A text falls into chunks that begin at a space before a visible character; such a place is always a boundary of the
pre-tokenizer. Chunks not seen before are split by the tokenizer's own pattern into pieces. New pieces are grouped by
length into padded matrices of byte ids; in each round every row merges its leftmost pair of minimum rank, found in
an open-addressing hash table, and finished rows leave the matrix. Long pieces merge all occurrences of their minimum
pair at once, from left to right; this gives the same ids unless a pair that ranks before the merged one comes up on the
way. Only tokens that have such a pair (found when the vocabulary is loaded) are looked at for it, and where it does come
up one occurrence is merged and the round repeated.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZER_DIR = os.environ.get("VEILSCAN_TOKENIZERS", "/opt/tokenizers")
#: The public pre-tokenizer pattern of the 50k byte-level vocabulary (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The same pattern over ASCII, for the standard library's faster engine (fixed value).
ASCII_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"""
CUT = re.compile(r" (?=\S)")
UNEVEN = re.compile(r" (?:\s|\Z)")  # a space that is no cut
LONG = 64  # bytes from which a piece merges all occurrences of its minimum pair in a round
NONE = np.int32(2**31 - 1)
CACHE = 500_000  # chunks kept between batches; a cache only


class PairTable:
    """(left id, right id) -> rank of the joined token, by open addressing in numpy."""

    def __init__(self, ranks: dict[bytes, int]):
        keys, values = [], []
        early: set[int] = set()  # tokens with a pair that ranks before the token itself
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    keys.append(a << 20 | b)
                    values.append(rank)
                    early.update(x for x in (a, b) if rank < x)
        self.early = early
        self.bits = max(4, (4 * len(keys)).bit_length())
        self.mask = (1 << self.bits) - 1
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, NONE, np.int32)
        k, v = np.array(keys, np.int64), np.array(values, np.int32)
        slot = self._slot(k)
        while len(k):  # each round one key wins each free slot, the others step on
            free = self.keys[slot] == -1
            first = np.zeros(len(k), bool)
            first[np.unique(slot, return_index=True)[1]] = True
            won = free & first
            self.keys[slot[won]], self.values[slot[won]] = k[won], v[won]
            k, v, slot = k[~won], v[~won], slot[~won]
            taken = self.keys[slot] != k
            slot = np.where(taken, (slot + 1) & self.mask, slot)
        self.values[self.keys == -1] = NONE

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs, NONE where there is no such pair or a side is padding (-1)."""
        shape = left.shape
        keys = (left.astype(np.int64) << 20 | right.astype(np.int64)).ravel()
        keys[(left < 0).ravel() | (right < 0).ravel()] = -2
        out = np.full(len(keys), NONE, np.int32)
        todo = np.flatnonzero(keys >= 0)
        slot = self._slot(keys[todo])
        while len(todo):
            there = self.keys[slot]
            hit = there == keys[todo]
            out[todo[hit]] = self.values[slot[hit]]
            on = ~hit & (there != -1)
            todo, slot = todo[on], (slot[on] + 1) & self.mask
        return out.reshape(shape)


class Encoder:
    def __init__(self, path: str):
        import regex

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.pieces_of = regex.compile(PATTERN).findall
        self.ascii_pieces_of = re.compile(ASCII_PATTERN, re.ASCII).findall
        self.byte_ids = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        self.table = PairTable(ranks)
        self.clear()

    def clear(self) -> None:
        self.inner: dict[str, int] = {}  # chunk without its leading space -> place in the pool
        self.first: dict[str, int] = {}  # chunk at the start of a text
        self.pieces: dict[str, np.ndarray] = {}
        self.pool = np.zeros(0, np.int32)
        self.starts = np.zeros(1, np.int64)

    def _matrix(self, pieces: list[bytes], width: int) -> np.ndarray:
        flat = np.frombuffer(b"".join(pieces), np.uint8)
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        m = np.full((len(pieces), width), -1, np.int32)
        m[np.arange(width) < sizes[:, None]] = self.byte_ids[flat]
        return m

    def _merge_rows(self, m: np.ndarray) -> list[np.ndarray]:
        """Rounds over a padded matrix; each row merges its leftmost minimum-rank pair."""
        out: list[np.ndarray | None] = [None] * len(m)
        rows = np.arange(len(m))
        ranks = self.table.rank(m[:, :-1], m[:, 1:]) if m.shape[1] > 1 else np.full((len(m), 0), NONE, np.int32)
        while len(rows):
            if ranks.shape[1]:
                at = ranks.argmin(axis=1)
                low = ranks[np.arange(len(rows)), at]
            else:
                at = low = np.full(len(rows), NONE)
            done = low == NONE
            for i in np.flatnonzero(done):
                row = m[i]
                out[rows[i]] = row[row >= 0]
            if done.any():  # compaction
                m, ranks, rows, at, low = m[~done], ranks[~done], rows[~done], at[~done], low[~done]
                if not len(rows):
                    break
            n, width = m.shape
            source = np.arange(width - 1)[None, :] + (np.arange(width - 1)[None, :] > at[:, None])
            m = np.take_along_axis(m, source, axis=1)
            r = np.arange(n)
            m[r, at] = low
            if width - 1 < 2:
                ranks = np.full((n, 0), NONE, np.int32)
                continue
            source = np.arange(width - 2)[None, :] + (np.arange(width - 2)[None, :] >= at[:, None])
            ranks = np.take_along_axis(ranks, np.minimum(source, width - 2), axis=1)
            right = np.minimum(at, width - 3)
            ranks[r, right] = np.where(at <= width - 3, self.table.rank(m[r, right], m[r, right + 1]), ranks[r, right])
            left = np.maximum(at - 1, 0)
            ranks[r, left] = np.where(at > 0, self.table.rank(m[r, left], m[r, left + 1]), ranks[r, left])
        return out

    def _merge_long(self, piece: bytes) -> np.ndarray:
        row = self.byte_ids[np.frombuffer(piece, np.uint8)]
        ranks = self.table.rank(row[:-1], row[1:])
        while len(ranks) and (low := ranks.min()) != NONE:
            at = np.flatnonzero(ranks == low)
            if len(at) > 1:  # of a run of overlapping pairs every other one is merged, from the left
                run = np.concatenate([[True], np.diff(at) > 1])
                at = at[(at - at[run][np.cumsum(run) - 1]) % 2 == 0]
            if len(at) > 1 and int(low) in self.table.early:
                # a pair that ranks before this one and comes up on the way would have to be merged first
                merged = np.zeros(len(row), bool)
                merged[at + 1] = True
                before = np.where(at >= 2, np.where(merged[np.maximum(at - 1, 0)], low, row[np.maximum(at - 1, 0)]), np.where(at == 1, row[0], -1))
                after = np.where(at + 2 < len(row), row[np.minimum(at + 2, len(row) - 1)], -1)
                new = np.full(len(at), low, np.int32)
                if min(self.table.rank(before.astype(np.int32), new).min(), self.table.rank(new, after.astype(np.int32)).min()) < low:
                    at = at[:1]
            row[at] = low
            keep = np.ones(len(row), bool)
            keep[at + 1] = False
            ranks = np.append(ranks, NONE)[keep][:-1]
            row = row[keep]
            now = at - np.arange(len(at))  # only pairs beside a merged token are new
            beside = np.concatenate([now, now - 1])
            beside = beside[(beside >= 0) & (beside < len(ranks))]
            ranks[beside] = self.table.rank(row[beside], row[beside + 1])
        return row

    def _encode_pieces(self, pieces: list[str]) -> dict[str, np.ndarray]:
        raw = [p.encode("utf-8", "replace") for p in pieces]
        ids: dict[str, np.ndarray] = {}
        buckets: dict[int, list[int]] = {}
        for i, b in enumerate(raw):
            if len(b) > LONG:
                ids[pieces[i]] = self._merge_long(b)
            else:
                buckets.setdefault(4 * -(-len(b) // 4), []).append(i)
        for width, at in sorted(buckets.items()):
            for k in range(0, len(at), 8192):
                some = at[k : k + 8192]
                for i, row in zip(some, self._merge_rows(self._matrix([raw[i] for i in some], width))):
                    ids[pieces[i]] = row
        return ids

    def _learn(self, chunks: list[str], known: dict[str, int], lead: str) -> None:
        whole = [lead + c for c in chunks]
        found = [self.ascii_pieces_of(c) if c.isascii() else self.pieces_of(c) for c in whole]
        if new := list({p for f in found for p in f if p not in self.pieces}):
            self.pieces.update(self._encode_pieces(new))
        pieces = self.pieces
        rows = [pieces[p] for f in found for p in f]
        per_piece = np.concatenate([[0], np.cumsum(np.fromiter(map(len, rows), np.int64, len(rows)))])
        ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))
        base = len(self.starts) - 1
        known.update(zip(chunks, range(base, base + len(chunks))))
        self.starts = np.concatenate([self.starts, self.starts[-1] + per_piece[ends]])
        self.pool = np.concatenate([self.pool, *rows])

    def _places(self, chunks: list[str], known: dict[str, int], lead: str) -> list[int]:
        places = list(map(known.get, chunks))
        if None in places:
            self._learn(list(dict.fromkeys(c for c, at in zip(chunks, places) if at is None)), known, lead)
            places = list(map(known.get, chunks))
        return places

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and the number of ids of each text. Null and empty texts have none."""
        if len(self.inner) + len(self.first) > CACHE:
            self.clear()
        heads, tails, counts = [], [], []
        for text in texts:
            parts = (CUT.split(text) if UNEVEN.search(text) else text.split(" ")) if text else [""]
            heads.append(parts[0])
            tails.extend(parts[1:])
            counts.append(len(parts))
        at = np.empty(len(heads) + len(tails), np.int64)
        ends = np.cumsum(counts)
        is_head = np.zeros(len(at), bool)
        is_head[ends - counts] = True
        at[~is_head] = self._places(tails, self.inner, " ")
        at[is_head] = self._places(heads, self.first, "")
        n = np.diff(self.starts)[at]
        last = np.cumsum(n)
        total = int(last[-1]) if len(last) else 0
        index = np.arange(total) + np.repeat(self.starts[at] - (last - n), n)
        return self.pool[index], np.diff(np.concatenate([[0], last])[np.concatenate([[0], ends])])


_encoders: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    """One per Python worker and vocabulary."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def encode(df: DataFrame, id_col: str, text_col: str, vocabulary: str | None = None) -> DataFrame:
    """(id, ids array<int>) of every row by the byte-level vocabulary, without special tokens.

    Null and empty texts give an empty list. Whole texts are encoded; the strings of special tokens are ordinary text.
    Works row by row without a shuffle; repeated rows give repeated rows, an empty table gives an empty one, and only the
    two named columns are read.
    """
    path = vocabulary or os.path.join(TOKENIZER_DIR, "byte_bpe_50k.tiktoken")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        encoder = _encoder(path)
        for batch in batches:
            for k in range(0, batch.num_rows, 1024):
                part = batch.slice(k, 1024)
                flat, counts = encoder.encode(part.column(1).to_pylist())
                offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([part.column(0), ids], names=["id", "ids"])

    kind = df.schema[id_col].dataType.simpleString()
    out = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, ids array<int>")
    return out.withColumnRenamed("id", id_col)
