"""Text decoded with the wrong encoding: found and repaired by expectation-maximization.

The latent variable of a word is the chain of encodings it went through (none, or one of CHAINS). Observed are the
distinct words with a non-ASCII character, counted per pool, a pool being a field and the format of the file it is from.
The likelihood of a word under a chain is that of its repaired form in a character-bigram model of correct text; the
prior of a chain belongs to the pool. E-step: posteriors of all distinct words. M-step: priors per pool, and the bigram
counts with every word counted in its repaired forms by posterior. So weak evidence pools across records: a lone odd
word in a pool with much damage is read differently from the same word in a clean pool. Each record is then decided by
its best run of neighbouring words under one chain, and repaired where that run's posterior favours the repair.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from operator import add

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shuffle_partitions, written

#: Chains by name: the encodings the text was really in and wrongly read as, one pair per wrong reading, in order.
CHAINS: dict[str, list[tuple[str, str]]] = {
    **{f"utf8-as-{w}": [("utf_8", w)] for w in ("cp1252", "cp1251", "cp437", "cp850", "cp866", "koi8_r", "mac_roman", "cp1250", "iso8859_5", "mac_cyrillic", "iso8859_15")},
    **{f"utf8-as-{w}-twice": [("utf_8", w)] * 2 for w in ("cp1252", "cp1251", "cp437", "cp866")},
    "utf8-as-cp1251-as-cp1252": [("utf_8", "cp1251"), ("utf_8", "cp1252")],
    "utf8-as-cp1252-as-cp1251": [("utf_8", "cp1252"), ("utf_8", "cp1251")],
    **{f"cp1252-as-{w}": [("cp1252", w)] for w in ("cp1251", "cp437", "cp850", "cp866", "koi8_r", "mac_roman", "cp1250")},
    **{f"cp1251-as-{w}": [("cp1251", w)] for w in ("cp1252", "koi8_r", "cp866", "cp437", "cp850", "mac_cyrillic", "iso8859_5", "mac_roman")},
    **{f"koi8_r-as-{w}": [("koi8_r", w)] for w in ("cp1251", "cp1252", "cp866")},
    **{f"cp866-as-{w}": [("cp866", w)] for w in ("cp1251", "cp1252", "koi8_r")},
    **{f"mac_cyrillic-as-{w}": [("mac_cyrillic", w)] for w in ("cp1251", "cp1252")},
    **{f"iso8859_5-as-{w}": [("iso8859_5", w)] for w in ("cp1251", "cp1252")},
}
NAMES = list(CHAINS)
BLANK = "\t\n\x0b\x0c\r "
WORD = re.compile(rf"[^{BLANK}]*[^\x00-\x7f][^{BLANK}]*")
LOST = "�"
ROUNDS = 8  # at most; they end when the priors of the chains settle
SETTLED = 2e-3  # total change of the chains' shares between rounds
POOLS = 1000  # a pool with less than this part of all words has the prior of all pools
LONGEST = 200  # signs of a word that is kept with its repaired forms; a longer one is repaired again in each round
PART = 1 << 20  # signs of distinct words that a task holds at once, besides its last text
SMOOTH = 2.0  # weight of the unigrams behind the bigrams
BROKEN = -6.0  # log odds of a word the chain cannot explain inside a run
NEED = 0.0  # log odds above which a record counts as damaged: the repair is likelier than the text as it stands
_to_byte: dict[str, dict[str, int]] = {}


def _bytes_of(text: str, encoding: str) -> bytes | None:
    """The bytes that read as this text; positions an encoding leaves undefined stand for themselves, as do C1 signs."""
    if encoding not in _to_byte:
        table = {chr(b): b for b in range(0x80, 0xA0)} if encoding in ("cp1252", "cp1251", "cp1250", "iso8859_15") else {}
        table.update({bytes([b]).decode(encoding, "ignore") or chr(b): b for b in range(256)})
        _to_byte[encoding] = table
    table = _to_byte[encoding]
    try:
        return bytes([table[c] for c in text])
    except KeyError:
        return None


def undo(text: str, chain: list[tuple[str, str]]) -> str | None:
    """The text before the wrong readings, None where this chain cannot have made it."""
    for real, read_as in reversed(chain):
        raw = _bytes_of(text, read_as)
        if raw is None:
            return None
        try:
            text = raw.decode(real)
        except UnicodeDecodeError:
            return None
    return text


def repairs(word: str) -> list[tuple[int, str]]:
    """(chain, repaired word) of every chain that can have made the word; of equal repairs the first chain counts."""
    seen, out = {word}, []
    for k, chain in enumerate(CHAINS.values()):
        fixed = undo(word, chain)
        if fixed is not None and fixed not in seen and not any(0x7F <= ord(c) < 0xA0 or c < " " or c == LOST for c in fixed):
            seen.add(fixed)
            out.append((k, fixed))
    return out


def _shape(word: str) -> str:
    return "^" + re.sub(r"[0-9]+", "0", word) + "$"


class Letters:
    """Character bigrams with a unigram behind them; tables of the size of the alphabet, not of the corpus."""

    def __init__(self, pairs: dict[str, float]):
        self.pairs = pairs
        self.left: Counter = Counter()
        self.right: Counter = Counter()
        for pair, n in pairs.items():
            self.left[pair[0]] += n
            self.right[pair[1]] += n
        self.total = sum(self.right.values())
        self.memo: dict[str, float] = {}

    def __call__(self, word: str) -> float:
        s, ll = _shape(word), 0.0
        for i in range(len(s) - 1):
            pair = s[i : i + 2]
            v = self.memo.get(pair)
            if v is None:
                uni = (self.right[pair[1]] + 0.02) / (self.total + 0.02 * 65536)
                v = self.memo[pair] = math.log((self.pairs.get(pair, 0.0) + SMOOTH * uni) / (self.left[pair[0]] + SMOOTH))
            ll += v
        return ll


def _words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Counts of words of any length per pool, summed within the partition before the shuffle."""
    counts: dict[tuple[str, str], int] = {}
    signs = 0

    def out() -> pd.DataFrame:
        rows = [(p, w, n) for (p, w), n in counts.items()]
        counts.clear()
        return pd.DataFrame(rows, columns=["pool", "word", "n"])

    for batch in batches:
        for pool, text in zip(batch["pool"], batch["text"]):
            if text.isascii():
                continue
            for w in WORD.findall(text):
                n = counts.get((pool, w), 0)
                counts[pool, w] = n + 1
                if not n:
                    signs += len(w)
            if signs > PART or len(counts) > 200_000:
                yield out()
                signs = 0
    yield out()


def _key(word: str) -> str:
    """What a word is joined by, as KEY has it: itself, or the digest of a long one behind a blank, which no word has."""
    return word if len(word) <= LONGEST else " " + hashlib.sha256(word.encode()).hexdigest()


KEY = f"if(length(word) <= {LONGEST}, word, concat(' ', sha2(word, 256)))"


def _candidates(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        found = [[(k, _key(f)) for k, f in repairs(w)] for w in batch["word"]]
        yield batch.assign(chains=[[k for k, _ in f] for f in found], fixed=[[w for _, w in f] for f in found])


def _plain_start(chains, word: str, n: int, rival: int) -> bool:
    """Before the first E-step: words no UTF-8 chain explains, without signs that only damage makes, and at least as
    frequent in the corpus as each of their repaired forms."""
    return n >= rival and LOST not in word and not any(NAMES[k].startswith("utf8") for k in chains) and not re.search(r"[\x80-\x9f]", word)


def _expect(letters: Letters | None, priors: dict[str, list[float]]):
    """E-step over distinct words; sums for the M-step, folded within each partition: (kind, key, chain, n)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pairs: defaultdict = defaultdict(float)
        uses: defaultdict = defaultdict(float)
        for batch in batches:
            for pool, word, n, chains, fixed, all_n, rival in zip(*(batch[c] for c in ("pool", "word", "n", "chains", "fixed", "all_n", "rival"))):
                if LOST in word:
                    continue
                if len(word) > LONGEST:
                    fixed = [undo(word, CHAINS[NAMES[k]]) for k in chains]
                if letters is None:
                    share = [(-1, word, 1.0)] if _plain_start(chains, word, all_n, rival) else []
                else:
                    prior = priors.get(pool) or priors[""]
                    logs = [prior[-1] + letters(word)] + [prior[k] + letters(f) for k, f in zip(chains, fixed)]
                    top = max(logs)
                    weights = [math.exp(x - top) for x in logs]
                    s = sum(weights)
                    share = [(k, w, x / s) for k, w, x in zip([-1, *chains], [word, *fixed], weights) if x > 1e-4 * s]
                weight = 1 + math.log(n)  # a word said often teaches its letters little more
                for k, w, p in share:
                    uses[pool, k] += p * n
                    shape = _shape(w)
                    if len(word) > LONGEST:  # and so does a pair said often in a long word, be it text without blanks or a blob
                        for pair, c in Counter(map(add, shape, shape[1:])).items():
                            pairs[pair] += p * weight * (1 + math.log(c))
                        continue
                    for i in range(len(shape) - 1):
                        pairs[shape[i : i + 2]] += p * weight
        rows = [("pair", k, 0, v) for k, v in pairs.items()] + [("use", pool, k, v) for (pool, k), v in uses.items()]
        yield pd.DataFrame(rows, columns=["kind", "key", "chain", "n"])

    return run


def fit(texts: DataFrame) -> tuple[dict[str, float], dict[str, list[float]]]:
    """(bigram counts, log priors per pool; "" is all pools) from (pool, text).

    What reaches the driver is bounded by the alphabet squared (bigrams that occur) and by POOLS times chains.
    """
    # a fixed number of partitions here and below: distinct words are few bytes, but each is tried under every chain
    parts = shuffle_partitions(texts.sparkSession)
    words = texts.select("pool", "text").mapInPandas(_words, "pool string, word string, n long").repartition(parts, "pool", "word").groupBy("pool", "word").agg(F.sum("n").alias("n"))
    words = written(words.mapInPandas(_candidates, "pool string, word string, n long, chains array<int>, fixed array<string>"), "mojibake-words")
    sizes = words.groupBy("pool").agg(F.sum("n").alias("n"))
    large = sizes.where(F.col("n") * POOLS >= sizes.agg(F.sum("n").alias("total")).first()["total"]) if not words.isEmpty() else sizes
    known = [r["pool"] for r in large.collect()]  # POOLS at most
    words = words.withColumn("pool", F.when(F.col("pool").isin(known), F.col("pool")).otherwise(""))
    words = words.withColumn("key", F.expr(KEY))
    count = words.groupBy("key").agg(F.sum("n").alias("all_n"))
    forms = words.select("key", F.explode("fixed").alias("form")).distinct()
    rivals = forms.join(count.select(F.col("key").alias("form"), F.col("all_n").alias("rival")), "form").groupBy("key").agg(F.max("rival").alias("rival"))
    words = written(words.join(count, "key").join(rivals, "key", "left").withColumn("rival", F.coalesce("rival", F.lit(0))).repartition(parts, "key"), "mojibake-rivals")
    letters, priors, pairs, shares = None, {"": []}, {}, None
    for _ in range(ROUNDS + 1):
        sums = words.mapInPandas(_expect(letters, priors), "kind string, key string, chain int, n double").groupBy("kind", "key", "chain").agg(F.sum("n").alias("n")).toPandas()
        pairs = {r.key: r.n for r in sums[sums["kind"] == "pair"].itertuples()}
        uses = sums[sums["kind"] == "use"]
        everywhere = uses.groupby("chain")["n"].sum().to_dict()
        total = sum(everywhere.values()) or 1.0
        base = [(everywhere.get(k, 0.0) + 1e-3 * total / len(NAMES)) / (1.001 * total) for k in [*range(len(NAMES)), -1]]
        before, shares = shares, base
        priors = {"": [math.log(b + 1e-12) for b in base]}
        for pool, rows in uses.groupby("key"):
            own, size = dict(zip(rows["chain"], rows["n"])), rows["n"].sum()
            priors[pool] = [math.log((own.get(k, 0.0) + 50 * b) / (size + 50) + 1e-12) for k, b in zip([*range(len(NAMES)), -1], base)]
        started, letters = letters is not None, Letters(pairs)
        if started and before and sum(abs(a - b) for a, b in zip(before, shares)) < SETTLED:
            break
    return pairs, priors


class Judge:
    """Decides one text at a time; what it knows of words is kept between texts."""

    def __init__(self, pairs: dict[str, float], priors: dict[str, list[float]]):
        self.letters, self.priors, self.memo = Letters(pairs), priors, {}

    def gains(self, word: str) -> dict[int, tuple[float, str]] | None:
        """Per chain the gain in log likelihood and the repaired word; None where no repair is likelier."""
        if len(self.memo) > 400_000:
            self.memo.clear()
        plain = self.letters(word)
        all_ = {k: (self.letters(f) - plain, f) for k, f in repairs(word)}
        out = self.memo[word] = all_ if any(g > 0 for g, _ in all_.values()) else None
        return out

    def __call__(self, pool: str, text: str) -> tuple[bool, str | None, str]:
        """(damaged?, chain, repaired text)."""
        if text.isascii():
            return False, None, text
        lost = LOST in text
        memo, gains = self.memo, self.gains
        words = WORD.findall(text)
        known = [memo[w] if w in memo else gains(w) for w in words]
        if not any(known):
            return lost, None, text
        prior = self.priors.get(pool) or self.priors[""]
        best = (NEED, None, 0, 0)
        for k in {k for g in known if g for k, (v, _) in g.items() if v > 0}:
            run, start = 0.0, 0
            for i, g in enumerate(known):
                v = min(g[k][0], 20.0) if g and k in g else BROKEN
                if run <= 0:
                    run, start = 0.0, i
                run += v
                score = run + prior[k] - prior[-1]
                if score > best[0]:
                    best = (score, k, start, i + 1)
        if best[1] is None:
            return lost, None, text
        k = best[1]
        out, at = [], 0
        for i, m in enumerate(WORD.finditer(text)):
            g = known[i]
            if g and k in g and (best[2] <= i < best[3] or g[k][0] > NEED):
                out += [text[at : m.start()], g[k][1]]
                at = m.end()
        return True, NAMES[k], "".join(out) + text[at:]


def damaged(texts: DataFrame) -> DataFrame:
    """(id, chain, repaired) of the affected rows of (id, pool, text); chain is null where nothing can be restored.

    Null, empty and ASCII texts are never affected. A text with U+FFFD always is. Rows repeated in the input are repeated
    in the result; whole texts are read; only the three named columns are.
    """
    schema = texts.schema["id"].dataType.simpleString()
    texts = texts.where(F.col("text").isNotNull() & F.col("text").rlike(r"[^\x00-\x7F]")).select("id", F.coalesce("pool", F.lit("")).alias("pool"), "text")
    pairs, priors = fit(texts)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        judge = Judge(pairs, priors)
        for batch in batches:
            rows = []
            for i, pool, text in zip(batch["id"], batch["pool"], batch["text"]):
                yes, chain, fixed = judge(pool, text)
                if yes:
                    rows.append((i, chain, fixed))
            yield pd.DataFrame(rows, columns=["id", "chain", "repaired"])

    return texts.mapInPandas(run, f"id {schema}, chain string, repaired string")
