"""Repetition inside a single document: rolling hashes of word n-grams and of lines, sentences and paragraphs in numpy.

A word lies in a repeated stretch when a run of n words around it, or the whole line, sentence or paragraph it is in,
already stood earlier in the same document, or when it belongs to a short phrase said again and again in a row. Letter case, punctuation, spacing and the values of counters do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import STEP, Words, later, powers

LENGTHS = (5, 10, 20)  # words; the shortest decides what is repeated, the longer ones are reported beside it
IN_A_ROW = 3  # sayings of a short phrase right after itself that make a repetition; twice is emphasis
NEWLINES = np.array([10, 11, 12, 13, 0x85, 0x2028, 0x2029, 0], np.uint32)
STOPS = np.array([ord(c) for c in ".!?…。！？;"], np.uint32)
BLANKS = np.array([9, 10, 11, 12, 13, 32, 0xA0, 0], np.uint32)


def _covered(n_words: int, first: np.ndarray, length: np.ndarray | int) -> np.ndarray:
    steps = np.zeros(n_words + 1, np.int64)
    np.add.at(steps, first, 1)
    np.add.at(steps, first + length, -1)
    return np.cumsum(steps)[:-1] > 0


def _segments(w: Words, breaks: np.ndarray, least: int) -> np.ndarray:
    """Words that lie in a segment between breaks, of at least so many words, which stood earlier."""
    segment = np.concatenate([[0], np.cumsum(breaks)])[w.start]
    first = np.flatnonzero(np.concatenate([[True], np.diff(segment) > 0]))
    size = np.diff(np.concatenate([first, [len(segment)]]))
    place = np.arange(len(segment)) - np.repeat(first, size)
    keys = np.add.reduceat(w.hash * powers(int(size.max()), STEP)[place], first) + size.astype(np.uint64)
    return np.repeat(later(keys, w.doc[first]) & (size >= least), size)


def _in_a_row(w: Words) -> np.ndarray:
    """Words of a phrase of one to four words that is said again right after itself, from its second saying on, where it
    is said IN_A_ROW times at least."""
    out = np.zeros(len(w.hash), bool)
    for k in range(1, LENGTHS[0]):
        n = len(w.hash) - k
        if n <= 0:
            break
        same = np.concatenate([[False] * k, (w.hash[k:] == w.hash[:-k]) & (w.doc[k:] == w.doc[:-k])])
        edge = np.diff(np.concatenate([[0], same.view(np.int8), [0]]))
        first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        long = last - first >= k * (IN_A_ROW - 1)
        out |= _covered(len(out), first[long], last[long] - first[long])
    return out


def _with_counters(all_words: Words, covered: np.ndarray) -> np.ndarray:
    """Coverage of all words from that of the words that are no counters: a counter between covered words is covered."""
    out = np.zeros(len(all_words.start), bool)
    out[~all_words.counter] = covered
    place = np.cumsum(~all_words.counter)  # words that are no counters up to here
    before = np.concatenate([[False], covered])[place]
    after = np.concatenate([covered, [False]])[np.minimum(place, len(covered))]
    doc = all_words.doc[~all_words.counter]
    same = np.concatenate([[-1], doc])[place] == all_words.doc
    same_after = np.concatenate([doc, [-1]])[np.minimum(place, len(covered))] == all_words.doc
    # at the end of a text its last covered word decides
    return np.where(all_words.counter, before & same & (after | ~same_after), out)


def measure(texts: list[str]) -> pd.DataFrame:
    """Per text: words, and the shares of words in repeated stretches and of characters in repeated n-grams and lines."""
    everything = Words(texts)
    w = everything.without_counters()
    n, docs = len(w.start), len(texts)
    total = np.bincount(everything.doc, minlength=docs)
    signs = (everything.end - everything.start).astype(np.float64)
    chars = np.bincount(everything.doc, signs, minlength=docs)

    def share(flags: np.ndarray, base: np.ndarray, weights: np.ndarray | float = 1.0) -> np.ndarray:
        got = np.bincount(everything.doc, _with_counters(everything, flags) * weights, minlength=docs)
        return np.divide(got, base, out=np.zeros(docs), where=base > 0)

    if not n:
        zero = np.zeros(docs)
        return pd.DataFrame({"n_words": total, "share": zero, **{f"char_share_{k}": zero for k in LENGTHS}, "line_share": zero})
    runs = {}
    for k in LENGTHS:
        at, keys = w.grams(k)
        runs[k] = _covered(n, at[later(keys, w.doc[at])], k)
    newline, blank = np.isin(w.codes, NEWLINES), np.isin(w.codes, BLANKS)
    stop = np.isin(w.codes, STOPS) & np.concatenate([blank[1:], [True]])
    lines = _segments(w, newline, 1)
    any_ = runs[LENGTHS[0]] | lines | _segments(w, newline | stop, 2) | _in_a_row(w)
    return pd.DataFrame({"n_words": total, "share": share(any_, total), **{f"char_share_{k}": share(runs[k], chars, signs) for k in LENGTHS}, "line_share": share(lines, chars, signs)})


def repetition(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, n_words, share, char_share_5, char_share_10, char_share_20, line_share) of every row.

    share is the share of words in repeated stretches. Null, empty and wordless texts have 0 words and shares of 0. Whole
    texts are measured, each on its own, without a shuffle; repeated rows give repeated rows.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch["text"].fillna("")
            # texts are taken together up to about two million signs, so that memory is bounded by the longest text
            cut = (texts.str.len().cumsum() // 2_000_000).to_numpy()
            for k in np.unique(cut):
                part = texts[cut == k].tolist()
                out = measure(part)
                out.insert(0, "id", batch["id"].to_numpy()[cut == k])
                yield out

    kind = df.schema[id_col].dataType.simpleString()
    shares = ", ".join(f"char_share_{k} double" for k in LENGTHS)
    return df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInPandas(run, f"id {kind}, n_words long, share double, {shares}, line_share double").withColumnRenamed("id", id_col)
