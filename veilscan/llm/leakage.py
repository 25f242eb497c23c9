"""Passages of held-out test items in a corpus: n-gram seeds join both sides, then Smith-Waterman alignment decides.

A seed is three words of four consecutive ones, in order: all three in a row, or the second or third of the four left
out. A passage whose edits are isolated words, replaced or left out, keeps a known number of such seeds near one diagonal
(``least_seeds``), and they are rare in other texts. So
  1. the items' seeds go into one bit filter of bounded size, which is sent to all executors,
  2. the corpus is read once; only stretches of a document with enough filtered seeds close together go on, with the
     hashes of their words,
  3. the seeds of stretches and items meet in a hash join, however many items share a seed; pairs of stretch and item with
     enough seeds near one diagonal are counted by an aggregation,
  4. those pairs are aligned, all of a batch at once in numpy; the aligned span of the item's words decides.
"""

from __future__ import annotations

import html
import math
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shuffle_partitions, written
from .words import Words, key_filter, passing

PATTERNS = ((0, 1, 2), (0, 1, 3), (0, 2, 3))  # places of the words of a seed
WEIGHTS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
MARGIN = 40  # words beside the seeds of a stretch that are aligned too
STRETCH = 600  # words aligned at once; longer stretches overlap by half
MATCH, MISS, GAP = 2, -1, -1
TAG = re.compile(r"</?[A-Za-z][^<>]*>")
UNSEEN = re.compile("[\u00ad\u200b-\u200f\u2060\ufeff]")


def plain(text: str) -> str:
    """Text without markup, entities, invisible signs and compatibility forms."""
    if "<" in text:
        text = TAG.sub(" ", text)
    if "&" in text:
        text = html.unescape(text)
    if not text.isascii():
        text = unicodedata.normalize("NFKC", UNSEEN.sub("", text))
    return text


def own_wording(text: str) -> str:
    """An item without its instruction line."""
    head, sep, rest = text.partition("\n")
    return rest if sep else head


def seeds_of(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(first word, hash) of every seed of every text, by pattern."""
    at, keys = [], []
    for pattern in PATTERNS:
        n = len(w.hash) - pattern[-1]
        if n <= 0:
            continue
        first = np.flatnonzero(w.doc[:n] == w.doc[pattern[-1] :])
        at.append(first)
        keys.append(sum(w.hash[first + k] * x for k, x in zip(pattern, WEIGHTS)))
    return (np.concatenate(at), np.concatenate(keys)) if at else (np.zeros(0, np.int64), np.zeros(0, np.uint64))


def least_seeds(least: int, ratio: float) -> tuple[int, int]:
    """(seeds, words the diagonal moves by at most) of every passage of such a length and share of words in place.

    A passage is a row of pieces of least to 2 * least - 1 words, one of which has the share too. With m of its n words in
    place and isolated edits, a piece is n - m + 1 runs at most. A run of r > 1 words has r - 2 seeds of its own and one
    with each run beside it; so all words but single ones and two at the ends begin a seed, 2m - n - 2 at least.
    """
    sizes = [(n, math.ceil(n * ratio)) for n in range(least, 2 * least)]
    return max(1, min(2 * m - n - 2 for n, m in sizes)), max(n - m for n, m in sizes)


# ---------------------------------------------------------------------------------------------- both sides of the join


def item_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per item its words and seeds, as hashes."""
    for batch in batches:
        w = Words([plain(own_wording(t)) for t in batch["t"]])
        at, keys = seeds_of(w)
        first, last = (np.searchsorted(w.doc, np.arange(len(batch)), side) for side in ("left", "right"))
        whose = w.doc[at]
        own = [np.flatnonzero(whose == k) for k in range(len(batch))]
        yield pd.DataFrame({"item": batch["i"], "item_words": [w.hash[a:b].view(np.int64) for a, b in zip(first, last)], "keys": [keys[o].view(np.int64) for o in own], "places": [(at[o] - first[k]).astype(np.int32) for k, o in enumerate(own)]})


def stretches_of(packed: np.ndarray, texts: list[str], need: int, within: int) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(text, word hashes, seeds, their places) of every stretch where so many filtered seeds begin within so many words."""
    w = Words([plain(t) for t in texts])
    at, keys = seeds_of(w)
    ok = passing(packed, keys)
    ok = ok[np.argsort(at[ok], kind="stable")]
    at, keys = at[ok], keys[ok]
    n = len(at) - need + 1
    if n <= 0:
        return []
    full = np.flatnonzero((at[need - 1 :] - at[:n] < within) & (w.doc[at[:n]] == w.doc[at[need - 1 :]]))
    kept = np.zeros(len(at), bool)
    for k in range(need):
        kept[full + k] = True
    at, keys = at[kept], keys[kept]
    if not len(at):
        return []
    first, last = (np.searchsorted(w.doc, np.arange(len(texts)), side) for side in ("left", "right"))
    out = []
    cuts = np.flatnonzero((np.diff(at) > MARGIN) | (np.diff(w.doc[at]) > 0)) + 1
    for part in np.split(np.arange(len(at)), cuts):
        doc = int(w.doc[at[part[0]]])
        a, b = max(int(at[part[0]]) - MARGIN, first[doc]), min(int(at[part[-1]]) + 4 + MARGIN, last[doc])
        while True:
            end = min(a + STRETCH, b)
            some = part[(at[part] >= a) & (at[part] < end)]
            if len(some) >= need:
                out.append((doc, w.hash[a:end], keys[some], at[some] - a))
            if end == b:
                break
            a += STRETCH // 2
    return out


# ---------------------------------------------------------------------------------------------- alignment


def promising(pairs: list[tuple[np.ndarray, np.ndarray]], least: int, ratio: float) -> np.ndarray:
    """Whether so large a share of the item's words in some window stands in the stretch at all, in whatever order; a
    passage has a piece of least to 2 * least - 1 item words with the share, so nothing that aligns is lost."""
    out = np.zeros(len(pairs), bool)
    order = np.argsort([len(b) for _, b in pairs], kind="stable")
    for some in np.split(order, range(512, len(order), 512)):
        there = np.zeros((len(some), max((len(pairs[i][1]) for i in some), default=0) + 1), np.int32)
        for row, i in zip(there, some):
            a, b = pairs[i]
            row[1 : len(b) + 1] = np.isin(b, a)
        np.cumsum(there, axis=1, out=there)
        for n in range(least, min(2 * least, there.shape[1])):
            out[some] |= (there[:, n:] - there[:, :-n]).max(axis=1) >= n * ratio
    return out


def align(pairs: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[int, int, int]]:
    """(score, span of item words, matches) of the best local alignment of each (stretch, item).

    Gaps cost one a word on either side and may have any length: along the item they are a running maximum of score plus
    place. Score, first item word and matches of a way go together in one integer.
    """
    if not pairs:
        return []
    rows, cols, n = max(len(a) for a, _ in pairs), max(len(b) for _, b in pairs), len(pairs)
    text, item = np.zeros((n, rows), np.uint64), np.zeros((n, cols), np.uint64)
    filled = np.zeros((n, cols), bool)
    for k, (a, b) in enumerate(pairs):
        text[k, : len(a)], item[k, : len(b)], filled[k, : len(b)] = a, b, True
        text[k, len(a) :] = 1  # equals no item word of consequence
    # matches below (12 bits), the distance of the first word from the end above (24 bits), and the score on top
    one, unit = np.int64(1) << 36, (np.int64(1) << 36) - 1
    start = (np.int64(cols) - np.arange(cols, dtype=np.int64)) << 12
    ramp = np.arange(cols, dtype=np.int64) * one * -GAP
    cell = np.zeros((n, cols + 1), np.int64)
    best = np.zeros(n, np.int64)
    where = np.zeros(n, np.int64)
    r = np.arange(n)
    for i in range(rows):
        same = (item == text[:, i : i + 1]) & filled
        left = cell[:, :-1]
        new = np.where(left >= one, left, start)
        new += np.where(same, MATCH * one + 1, MISS * one)
        np.maximum(new, cell[:, 1:] + GAP * one, out=new)
        new += ramp
        np.maximum.accumulate(new, axis=1, out=new)
        new -= ramp
        new[new < one] = 0
        cell[:, 1:] = new
        top = new.argmax(axis=1)
        high = new[r, top]
        better = high >> 36 > best >> 36
        best[better], where[better] = high[better], top[better]
    score, way = best >> 36, best & unit
    return [(int(s), int(t - (cols - (p >> 12)) + 1) if s else 0, int(p & 4095)) for s, t, p in zip(score, where, way)]


def _aligned(least: int, ratio: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            pairs = [(np.asarray(a, np.int64).view(np.uint64), np.asarray(b, np.int64).view(np.uint64)) for a, b in zip(batch["words"], batch["item_words"])]
            keep = np.flatnonzero(promising(pairs, least, ratio)).tolist()
            keep.sort(key=lambda i: (len(pairs[i][1]) // 8, len(pairs[i][0])))
            rows = []
            for k in range(0, len(keep), 128):
                some = keep[k : k + 128]
                rows += [(i, *got) for i, got in zip(some, align([pairs[j] for j in some])) if got[1] >= least and got[2] >= got[1] * ratio]
            out = pd.DataFrame(rows, columns=["k", "score", "span", "matches"])
            at = out.pop("k").to_numpy(int)
            yield pd.DataFrame({"row": batch["row"].to_numpy()[at], "id": batch["id"].to_numpy()[at], "item": batch["item"].to_numpy()[at]}).join(out)

    return run


def leaks(documents: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", least_span: int = 20, slack: int = 1, least_matches: float = 0.7) -> DataFrame:
    """(doc_id, item_id, score, span, matches): every document with every item a passage of which leaked into it.

    span is the number of the item's own words the passage reaches over. An edited word at the edge of a passage cannot be
    aligned, hence slack. Null and empty documents leak nothing, nor do items without words of their own; repeated rows
    give repeated rows. Neither the corpus nor the items reach the driver, only the filter of bounded size does.
    """
    spark = documents.sparkSession
    least = max(least_span - slack, 1)
    need, drift = least_seeds(least, least_matches)
    kind = documents.schema[id_col].dataType.simpleString()
    stated = items.select(F.col(item_id).cast("long").alias("i"), F.col(item_text).alias("t")).where(F.col("t").isNotNull())
    own = written(stated.mapInPandas(item_rows, "item long, item_words array<long>, keys array<long>, places array<int>"), "leak-items")
    n_seeds = own.agg(F.sum(F.size("keys"))).first()[0] or 0
    schema = f"row long, id {kind}, stretch int, words array<long>, keys array<long>, at array<int>"
    if not n_seeds:
        return spark.createDataFrame([], f"`{id_col}` {kind}, item_id long, score int, span int, matches int")
    packed = spark.sparkContext.broadcast(key_filter(own.select(F.explode("keys").alias("key")), n_seeds))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        row = TaskContext.get().partitionId() << 33  # every row of the input is a document of its own
        for batch in batches:
            cut = (batch["text"].str.len().cumsum() // 2_000_000).to_numpy()
            for c in np.unique(cut):
                ids, texts = (batch[x][cut == c].tolist() for x in ("id", "text"))
                found = stretches_of(packed.value, texts, need, 2 * least)
                yield pd.DataFrame([(row + doc, ids[doc], k, words.view(np.int64), keys.view(np.int64), at.astype(np.int32)) for k, (doc, words, keys, at) in enumerate(found)], columns=["row", "id", "stretch", "words", "keys", "at"])
                row += len(texts)

    corpus = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull())
    stretches = written(corpus.mapInPandas(run, schema), "leak-stretches")
    ours = own.select("item", F.inline(F.arrays_zip(F.col("keys").alias("key"), F.col("places").alias("place")))).toDF("item", "key", "place")
    theirs = stretches.select("row", "stretch", F.inline(F.arrays_zip("keys", "at"))).toDF("row", "stretch", "key", "at")
    step = drift + 1  # half overlapping bands of twice the width hold any such move of the diagonal
    bands = F.explode(F.transform(F.array(F.lit(0), F.lit(1)), lambda p: F.struct(p.alias("phase"), F.floor((F.floor((F.col("place") - F.col("at")) / step) + p) / 2).alias("band"))))
    near = theirs.join(ours, "key").select("row", "stretch", "item", bands.alias("b")).groupBy("row", "stretch", "item", "b").count().where(F.col("count") >= need)
    pairs = near.select("row", "stretch", "item").distinct()
    # a fixed number of partitions: the rows are small, but each is an alignment
    both = pairs.repartition(shuffle_partitions(spark), "row", "stretch").join(stretches.select("row", "id", "stretch", "words"), ["row", "stretch"]).join(own.select("item", "item_words"), "item")
    found = both.select("row", "id", "item", "words", "item_words").mapInPandas(_aligned(least, least_matches), f"row long, id {kind}, item long, score int, span int, matches int")
    best = found.groupBy("row", "item").agg(F.first("id").alias(id_col), F.max(F.struct("score", "span", "matches")).alias("best"))
    return best.select(id_col, F.col("item").alias("item_id"), "best.score", "best.span", "best.matches")
