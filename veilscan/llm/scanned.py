"""Noise in text from scanned pages: found by kind, and the text put back into continuous paragraphs.

Words are grouped by the skeleton that all look-alike readings of a word share; within a group the frequent form, with
support from the word before it, is what the others are misreadings of. Lines are compared with digits masked: a title
line at the edge of two pages is a running header. SQL windows over the lines of a text drop headers and page numbers,
join words split over line ends, and reflow lines into paragraphs.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written
from .words import key_filter, passing

#: What scanning makes of letters, several signs for one first (fixed values).
GROUPS = [("vv", "w"), ("rn", "m"), ("nn", "m"), ("ii", "u"), ("li", "h"), ("cl", "d"), ("ьl", "ы"), ("ьi", "ы"), ("гі", "п"), ("jl", "л")]
SINGLE_RU = {ord("8"): "в", ord("6"): "б", ord("0"): "о", ord("3"): "з", ord("m"): "т", ord("q"): "д", ord("и"): "н"}
SINGLE_LAT = {ord("8"): "b", ord("6"): "b", ord("0"): "o", ord("1"): "l", ord("!"): "l", ord("|"): "l", ord("i"): "l", ord("5"): "s", ord("9"): "g", ord("c"): "e", ord("f"): "t"}
CYRILLIC = re.compile("[Ѐ-ӿ]")
TOKEN = re.compile(r"[\w!|]*[^\W\d_][\w!|]*(?:-[^\W\d_]+)*")
MAILBOX = re.compile(r"(?<!\S)\S*(?:@|://|\S\[(?:at|dot)\])\S*")
LINE_END = re.compile(r"\r\n|[\n\x0c\r]")
SIGNS = "-¬‐\xad"
BREAK = re.compile(rf"([^\W\d_]+)([{SIGNS}])[ \t]*\r?\n[ \t]*([^\W\d_]+)")
OVER_LINES = re.compile(rf"(?<=[^\W\d_])[{SIGNS}][ \t]*\r?\n[ \t]*([^\W\d_])")
RATIO, SUPPORTED_RATIO, LEAST = 20, 4, 4
SHORTEST = 3  # letters of a word that counts as misread; shorter ones differ in a sign from too many others
PAGE_EDGE = 4  # lines (titles, numbers, empty ones) over which a word split at a page end goes on
KEPT = 300_000  # counts of words held in a task before they are passed on; a flush, no bound

_WORDS = r"(?:page|pagc|paqe|seite|scite|página|pagina|страница|стр\.?|лист|p\.|pág\.?|pag\.?|s\.|bl\.|blatt|folio|hoja|feuillet)"
_OF = r"(?:of|0f|von|v0n|de|dc|из|нз|sur|/)"
#: A page number with words or signs; alone on a line, or after a title and a wide gap.
DECORATED = re.compile(rf"(?i)(?:{_WORDS}\s*\d{{1,5}}(?:\s*{_OF}\s*\d{{1,5}})?|[-–—]\s?\d{{1,5}}\s?[-–—]|\[\s?\d{{1,5}}\s?\]|\(\s?\d{{1,5}}\s?\)|(?P<a>\d{{1,4}})\s?/\s?(?P<b>\d{{1,4}})|\d{{1,4}}\s(?:of|von|de|из|sur)\s\d{{1,4}})")
BARE = re.compile(r"\d{1,4}")
GAP = re.compile(r"\s{3,}")
BULLET = re.compile(r"^(?:[-*•–]|\d{1,3}[.)])\s")


@lru_cache(maxsize=200_000)
def skeleton(word: str) -> str:
    """One form for all look-alike readings of a word."""
    w = word.lower()
    for several, one in GROUPS:
        w = w.replace(several, one)
    return w.translate(SINGLE_RU if CYRILLIC.search(w) else SINGLE_LAT)


def page_number(text: str) -> bool:
    m = DECORATED.fullmatch(text.strip())
    return bool(m) and not (m["a"] and int(m["a"]) >= int(m["b"]))


def look(lines: list[str]) -> list[tuple[str | None, bool]]:
    """Per line: the masked key of what may be a title (else None), and whether it holds a page number."""
    plain = [x.strip() for x in lines]
    numeric = [bool(BARE.fullmatch(x)) for x in plain]
    out: list[tuple[str | None, bool]] = []
    for k, x in enumerate(plain):
        if not x:
            out.append((None, False))
            continue
        if numeric[k]:
            near = plain[max(0, k - 1) : k] + plain[k + 1 : k + 2]
            table = any(BARE.fullmatch(y) for y in near) or any(re.fullmatch(r"[^\W\d_]{1,12}\.?|units.*", y) for y in near if len(y) <= 12)
            out.append((None, not table))
            continue
        if page_number(x):
            out.append((None, True))
            continue
        title, numbered = x, False
        parts = GAP.split(x)
        if len(parts) == 2:
            for a, b in ((parts[0], parts[1]), (parts[1], parts[0])):
                if page_number(b) or BARE.fullmatch(b):
                    title, numbered = a, True
                    break
        key = None
        if 4 <= len(title) <= 70 and title[-1] not in ".!?,;:" and not BULLET.match(title) and len(re.findall(r"\d+", title)) <= 1 and not (title[0].islower()) and len(re.findall(r"[^\W\d_]{2,}", title)) >= 2:
            key = re.sub(r"\d+", "9", " ".join(skeleton(t) if not t.isdigit() else t for t in re.findall(r"[\w!|]+|[^\w\s]", title)))
        out.append((key, numbered))
    return out


def _lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for table, i, scope, page, text in zip(batch["source_table"], batch["record_id"], batch["scope"], batch["page"], batch["text"]):
            lines = LINE_END.split(text)
            filled = [k for k, x in enumerate(lines) if x.strip()]
            edge = set(filled[:2]) | set(filled[-2:]) if page else set(filled)
            for k, (key, numbered) in enumerate(look(lines)):
                rows.append((table, i, scope, k, lines[k], key if k in edge else None, numbered and k in edge))
        yield pd.DataFrame(rows, columns=["source_table", "record_id", "scope", "line_no", "line", "title", "numbered"])


LINES = "source_table string, record_id long, scope string, line_no int, line string, title string, numbered boolean"


def _breaks(text: str) -> Iterator[tuple[str, str, str]]:
    """(left, sign, right) of words that go on in a later line, also where a page ends in between."""
    if not any(sign + "\n" in text or sign + " \n" in text or sign + "\r" in text or sign + "\x0c" in text for sign in SIGNS):
        return
    lines = LINE_END.split(text)
    seen = None
    for k, line in enumerate(lines[:-1]):
        m = re.search(rf"([^\W\d_]+)([{SIGNS}])\s*$", line)
        if not m:
            continue
        after = k + 1
        if not re.match(r"\s*[^\W\d_]", lines[after]) or not lines[after].lstrip()[0].islower():
            seen = seen or look(lines)
            while after < min(k + 1 + PAGE_EDGE, len(lines)) and (seen[after][0] or seen[after][1] or not lines[after].strip()):
                after += 1
        n = re.match(r"\s*([^\W\d_]+)", lines[after]) if after < len(lines) else None
        if n and n[1][0].islower():
            yield m[1], m[2], n[1]


def _words(text: str) -> Iterator[tuple[str, str]]:
    """(word, word before) of a text, with words split over line ends joined and addresses left out."""
    whole = MAILBOX.sub(" ", text) if "@" in text or "://" in text or "[at]" in text or "[dot]" in text else text
    whole = OVER_LINES.sub(lambda m: m[1] if m[1].islower() else "-" + m[1], whole)
    low = whole.lower()
    before = ""
    for w in TOKEN.findall(low if len(low) == len(whole) else "".join(c if len(c.lower()) != 1 else c.lower() for c in whole)):
        w = w.strip("!|_")
        if len(w) >= SHORTEST:
            yield w, before
        before = w


MARKS = "kind string, source_table string, record_id long, scope string, line_no int, a string, b string, c string, n long"
MARK_COLUMNS = [c.split()[0] for c in MARKS.split(", ")]


def _marks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """All that one reading of the texts tells, by kind: title (a: its key) and number, lines that look like it; break, a
    word split over a line end (a: joined, b: with its hyphen, c: the sign); and count, how many texts of this task hold a
    word after another (a: word, b: before, c: skeleton), summed before anything is written or shuffled."""
    counts: Counter = Counter()

    def flush() -> pd.DataFrame:
        rows = [("count", None, None, None, None, w, b, skeleton(w), n) for (w, b), n in counts.items()]
        counts.clear()
        return frame(rows)

    def frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame({c: pd.array(v, dtype={"record_id": "Int64", "line_no": "Int32", "n": "Int64"}.get(c, object)) for c, v in zip(MARK_COLUMNS, zip(*rows))}) if rows else pd.DataFrame(columns=MARK_COLUMNS)

    for batch in batches:
        rows = []
        for table, i, scope, page, text in zip(batch["source_table"], batch["record_id"], batch["scope"], batch["page"], batch["text"]):
            counts.update(set(_words(text)))
            lines = LINE_END.split(text)
            filled = [k for k, x in enumerate(lines) if x.strip()]
            edge = set(filled[:2]) | set(filled[-2:]) if page else set(filled)
            seen = look(lines)
            for k, (key, numbered) in enumerate(seen):
                if k in edge and key:
                    rows.append(("title", table, i, scope, k, key, None, None, None))
                if k in edge and numbered:
                    rows.append(("number", table, i, scope, k, None, None, None, None))
            rows += [("break", table, i, scope, None, (left + right).lower(), f"{left}-{right}".lower(), sign, None) for left, sign, right in _breaks(text)]
        yield frame(rows)
        if len(counts) > KEPT:
            yield flush()
    yield flush()


def _odd(word: Column) -> Column:
    """A sign inside a word that no word has: a digit, an exclamation mark or a letter of another script."""
    return word.rlike(r"[0-9!|]") | (word.rlike("[a-z]") & word.rlike("[\u0400-\u04ff]"))


def _pages(texts: DataFrame) -> DataFrame:
    """(source_table, record_id, scope, page, text) of texts that hold something."""
    return texts.select("source_table", F.col("record_id").cast("long").alias("record_id"), "scope", "page", "text").where(F.col("text").isNotNull() & F.col("text").rlike(r"\S"))


def counted(marks: DataFrame) -> DataFrame:
    """(skel, word, before, n): how many texts hold each word after each word; all counts of words come from this table."""
    return written(marks.where("kind = 'count'").groupBy(F.col("c").alias("skel"), F.col("a").alias("word"), F.col("b").alias("before")).agg(F.sum("n").alias("n")), "scanned-counts")


def misread_words(counts: DataFrame) -> DataFrame:
    """(word, meant): distinct words that are misreadings, and the form they stand for.

    A form with an odd sign is misread when its group has a plain form seen LEAST times. A form of letters only is misread
    when the group's frequent form is RATIO times as frequent, or SUPPORTED_RATIO times and it alone follows the word
    before. One group holds the readings of one word; groups are aggregated map-side, never gathered.
    """
    forms = counts.where(F.col("skel") != "").groupBy("skel", "word").agg(F.sum("n").alias("n"))
    heads = forms.where(~_odd(F.col("word"))).groupBy("skel").agg(F.max_by("word", F.struct("n", "word")).alias("meant"), F.max("n").alias("top"))
    pairs = forms.join(heads, "skel").where((F.col("word") != F.col("meant")) & (F.col("top") >= LEAST))
    often = F.col("top") >= F.col("n") * RATIO
    # 1st and 3rd are words; a longer one that begins with a digit is none, a shorter one only where the plain form is frequent
    short = F.col("word").rlike("^[0-9]") & (F.length("word") < 5)
    odd = _odd(F.col("word")) & (F.col("top") >= F.col("n")) & (~short | often & ~F.col("word").rlike("^[0-9]+(?:st|nd|rd|th)$"))
    # t and f begin names that differ in nothing else; two signs for one do not
    first = F.substring("word", 1, 1) == F.substring("meant", 1, 1)
    several = reduce(lambda a, b: a | b, [F.col("word").startswith(g) & F.col("meant").startswith(one) for g, one in GROUPS])
    clear = (first | several) & often
    pairs = written(pairs.select("word", "meant", (odd | clear).alias("sure"), (~odd & first & (F.col("top") >= F.col("n") * SUPPORTED_RATIO)).alias("likely")).where("sure OR likely"), "scanned-pairs")
    unsure = pairs.where("NOT sure").select("word", "meant")
    own = counts.where(F.col("before") != "").join(unsure, "word").select("before", "word", "meant", "n")
    usual = counts.join(unsure.select(F.col("meant").alias("word")).distinct(), "word", "left_semi").select("before", F.col("word").alias("meant"), F.col("n").alias("of_meant"))
    supported = own.join(usual, ["before", "meant"]).groupBy("word", "meant").agg(F.max(F.col("of_meant") / F.col("n")).alias("r")).where(F.col("r") >= RATIO)
    return pairs.where("sure").select("word", "meant").unionByName(supported.select("word", "meant"))


def misread_in(pages: DataFrame, misread: DataFrame) -> DataFrame:
    """(source_table, record_id, word, meant): the misread words of each text. The texts are read once more; only words that
    pass a filter of bounded size leave the task, so that a word misread everywhere costs a row a text and no more."""
    spark = pages.sparkSession
    misread = written(misread, "scanned-misread")
    packed = spark.sparkContext.broadcast(key_filter(misread.select(F.xxhash64("word").alias("key")), misread.count()))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        known: dict[str, bool] = {}
        for batch in batches:
            per_text = [{w for w, _ in _words(t)} for t in batch["text"]]
            if new := [w for w in set().union(*per_text) if w not in known]:
                keys = np.fromiter((xxhash.xxh64_intdigest(w.encode("utf-8", "replace"), 42) for w in new), np.uint64, len(new))
                there = np.zeros(len(new), bool)
                there[passing(packed.value, keys)] = True
                if len(known) > KEPT:
                    known = {w: known[w] for some in per_text for w in some if w in known}
                known.update(zip(new, there.tolist()))
            rows = [(table, i, w) for table, i, some in zip(batch["source_table"], batch["record_id"], per_text) for w in some if known[w]]
            yield pd.DataFrame(rows, columns=["source_table", "record_id", "word"])

    return pages.mapInPandas(run, "source_table string, record_id long, word string").join(misread, "word")


def split_words(marks: DataFrame, counts: DataFrame) -> DataFrame:
    """(source_table, record_id, word, skel): words split over a line end that are no compounds with a hyphen of their own.

    Signs that only stand for a break always count. A plain hyphen counts where the joined word stands elsewhere, or where
    the hyphenated form does not.
    """
    broken = marks.where("kind = 'break'").select("source_table", "record_id", F.col("a").alias("word"), F.col("b").alias("skel"), F.col("c").alias("before")).distinct()
    asked = broken.where(F.col("before") == "-")
    wanted = asked.select("word").union(asked.select("skel")).distinct()
    seen = counts.join(wanted, "word", "left_semi").groupBy("word").agg(F.sum("n").alias("n"))
    joined = seen.withColumnRenamed("n", "n_joined")
    compound = seen.select(F.col("word").alias("skel"), F.col("n").alias("n_compound"))
    # the joined form always stands once, in this very place
    known = asked.join(joined, "word", "left").join(compound, "skel", "left")
    split = known.where(F.col("n_compound").isNull() | (F.coalesce("n_joined", F.lit(0)) > F.col("n_compound")))
    return broken.where(F.col("before") != "-").unionByName(split.select(broken.columns)).select("source_table", "record_id", "word", "skel")


def running_titles(marks: DataFrame) -> DataFrame:
    """(scope, title): title lines that stand on two pages of a scope at least; extremes are folded map-side."""
    place = F.struct("record_id", "line_no")
    seen = marks.where("kind = 'title'").groupBy("scope", F.col("a").alias("title")).agg(F.min(place).alias("first"), F.max(place).alias("last"))
    apart = F.when(F.startswith("scope", F.lit("text:")), F.col("first") != F.col("last")).otherwise(F.col("first.record_id") != F.col("last.record_id"))
    return seen.where(apart).select("scope", "title")


def analysed(texts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The texts that hold something, and written tables of what stands in them and of the counts of their words."""
    pages = _pages(texts)
    marks = written(pages.mapInPandas(_marks, MARKS), "scanned-marks")
    return pages, marks, counted(marks)


def noise(texts: DataFrame) -> DataFrame:
    """(source_table, record_id, noise): one row per record and kind of noise, as TESTDATA names them.

    texts: source_table, record_id, scope (what the pages of one scan share), page (whether the text is one page), text.
    Null, empty and blank texts have none; repeated rows count once.
    """
    pages, marks, counts = analysed(texts)
    key = ["source_table", "record_id"]
    headers = marks.where("kind = 'title'").withColumnRenamed("a", "title").join(running_titles(marks), ["scope", "title"], "left_semi").select(*key).distinct().withColumn("noise", F.lit("running_header"))
    numbers = marks.where("kind = 'number'").select(*key).distinct().withColumn("noise", F.lit("page_number"))
    breaks = split_words(marks, counts).select(*key).distinct().withColumn("noise", F.lit("hyphen_break"))
    misread = misread_in(pages, misread_words(counts)).select(*key).distinct().withColumn("noise", F.lit("ocr_char"))
    return headers.unionByName(numbers).unionByName(breaks).unionByName(misread)


def reflowed(texts: DataFrame) -> DataFrame:
    """(source_table, record_id, text): headers and page numbers gone, split words joined, misread words replaced, and the
    lines of a paragraph on one line; paragraphs stay apart by an empty line."""
    pages, marks, counts = analysed(texts)
    lines = pages.mapInPandas(_lines, LINES)
    key = ["source_table", "record_id"]
    titles = running_titles(marks).withColumn("header", F.lit(True))
    body = lines.join(titles, ["scope", "title"], "left").withColumn("gone", F.coalesce("header", F.lit(False)) | F.col("numbered"))
    order = Window.partitionBy(*key).orderBy("line_no")
    kept = body.where(~F.col("gone")).withColumn("empty", F.trim("line") == "").withColumn("paragraph", F.sum(F.col("empty").cast("int")).over(order)).where(~F.col("empty"))
    joined = kept.groupBy(*key, "paragraph").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", F.trim("line").alias("line")))), lambda x: x["line"]), "\n").alias("text"))
    fixes = split_words(marks, counts).select(*key, F.struct(F.col("skel").alias("was"), F.col("word").alias("now"), F.lit("h").alias("kind")).alias("fix"))
    misread = misread_in(pages, misread_words(counts)).select(*key, F.struct(F.col("word").alias("was"), F.col("meant").alias("now"), F.lit("t").alias("kind")).alias("fix"))
    per_record = fixes.unionByName(misread).groupBy(*key).agg(F.collect_set("fix").alias("fixes"))  # at most the words of one text

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text, fixes in zip(batch["text"], batch["fixes"]):
                fixes = [] if fixes is None else fixes
                split = {f["was"] for f in fixes if f["kind"] == "h"}
                meant = {f["was"]: f["now"] for f in fixes if f["kind"] == "t"}

                def whole(m: re.Match) -> str:
                    return m[1] + ("" if f"{m[1]}-{m[3]}".lower() in split else "-") + m[3]

                def right(m: re.Match) -> str:
                    w = m.group().strip("!|_")
                    now = meant.get(w.lower())
                    if now is None:
                        return m.group()
                    was, parts = w.split("-"), now.split("-")
                    now = "-".join(p.upper() if w.isupper() else p[0].upper() + p[1:] if o[0].isupper() else p for o, p in zip(was, parts))
                    return m.group().replace(w, now)

                text = BREAK.sub(whole, text).replace("\n", " ")
                out.append(TOKEN.sub(right, text) if meant else text)
            yield batch[["source_table", "record_id", "paragraph"]].assign(text=out)

    flowed = joined.join(per_record, key, "left").mapInPandas(run, "source_table string, record_id long, paragraph long, text string")
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("paragraph", "text"))), lambda x: x["text"]), "\n\n")
    return flowed.groupBy(*key).agg(whole.alias("text"))
