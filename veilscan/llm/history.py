"""Deduplicating arriving batches of findings against everything accepted before.

A store keeps one row per accepted finding in a bucketed table: a hash of the normalised content (file, pattern type,
line), and the paragraph hash (file, pattern type, span of four lines) the table is bucketed by. A new batch
  1. folds its own full copies (equal content hash) into their first row, before any shuffle of whole rows,
  2. takes out full copies of the history by a semi-join on the content hash,
  3. finds which of the rest share a paragraph with the history by a semi-join on three paragraph hashes each, and looks up
     the accepted row only for those,
  4. settles what is left within the batch in the order of ids, per file, type and block of lines,
  5. appends the hashes of what it accepted, once per batch key.
All joins with the store are bucket-local on its side, which is neither moved nor rehashed; history is never reprocessed.
The number of buckets belongs to the store, which can be opened again by its name in another session.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..session import scratch, shared_dir, shuffle_partitions, written

SPAN = 4  # lines of a paragraph hash; lines at most NEAR apart lie in the same or a neighbouring span
NEAR = 3
BLOCK = 1 << 16  # lines that one step of the settling looks at together; rounds grow with the blocks a chain crosses
STORED = "hk long, hk2 long, line long, id long, batch string, para long"
EXTRACTION_MARKS = [" (архив)", " (OCR)"]  # fixed values: marks that extraction appends to a path


@F.pandas_udf(StringType())
def _nfc(path: pd.Series) -> pd.Series:
    import unicodedata

    return path.map(lambda p: None if p is None else unicodedata.normalize("NFC", p))


def same_path(path: Column) -> Column:
    """One spelling per file: file:// and percent escapes, backslashes, doubled slashes, . and .. segments, outer
    blanks, decomposed letters and extraction marks are undone. Letter case stays. Null stays null."""
    p = F.trim(path)
    p = F.when(p.rlike("^(?i)file://"), F.try_url_decode(F.regexp_replace(F.regexp_replace(p, "^(?i)file://(?:localhost)?", ""), r"\+", "%2B"))).otherwise(p)
    for _ in range(2):
        for mark in EXTRACTION_MARKS:
            p = F.trim(F.regexp_replace(p, r"\s*\Q" + mark.strip() + r"\E$", ""))
    p = F.translate(p, "\\", "/")
    decomposed = F.when(p.rlike(r"\p{M}|[\x{1100}-\x{11FF}]"), p)  # all other rows send nulls
    p = F.coalesce(_nfc(decomposed), p)
    p = F.regexp_replace(p, "/(?:\\.?/)+", "/")
    p = F.regexp_replace(p, "(?<=.)/\\.?$", "")

    def step(kept: Column, part: Column) -> Column:
        up = (part == "..") & (F.size(kept) > 1) & (F.element_at(kept, -1) != "..")
        return F.when(up, F.slice(kept, F.lit(1), F.size(kept) - 1)).otherwise(F.concat(kept, F.array(part)))

    folded = F.array_join(F.aggregate(F.split(p, "/"), F.array().cast("array<string>"), step), "/")
    return F.when(p.contains(".."), folded).otherwise(p)


def same_type(kind: Column) -> Column:
    """One spelling per pattern type: letter case, outer blanks and - or blank for _ do not matter."""
    return F.regexp_replace(F.lower(F.trim(kind)), r"[-\s]+", "_")


def _settle_block(own: np.ndarray, line: np.ndarray, id_: np.ndarray, accepted: np.ndarray) -> np.ndarray:
    """Of one run of rows (sorted by line): accepted id of each row, 0 undecided; -1 in accepted: not known yet."""
    state = accepted.copy()  # -1 unknown, own id accepted, other id: repeats it
    left = np.searchsorted(line, line - NEAR, "left")
    right = np.searchsorted(line, line + NEAR, "right")
    for i in np.argsort(id_, kind="stable"):
        if state[i] != -1:
            continue
        best, open_ = None, False
        for j in range(left[i], right[i]):
            if id_[j] < id_[i]:
                if state[j] == -1:
                    open_ = True
                elif state[j] == id_[j] and (best is None or id_[j] < best):
                    best = id_[j]
        if best is not None and not open_:
            state[i] = best
        elif best is None and not open_ and own[i]:
            state[i] = id_[i]
    return state


def _settle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    rest = None
    columns = ["hk", "hk2", "line", "id", "acc"]

    def work(rows: pd.DataFrame) -> pd.DataFrame:
        hk, hk2, blk = rows["hk"].to_numpy(), rows["hk2"].to_numpy(), rows["blk"].to_numpy()
        line, id_ = rows["line"].to_numpy(np.int64), rows["id"].to_numpy(np.int64)
        own, acc = rows["own"].to_numpy(bool), rows["acc"].fillna(-1).to_numpy(np.int64).copy()
        same = (hk[1:] == hk[:-1]) & (hk2[1:] == hk2[:-1]) & (blk[1:] == blk[:-1]) & (np.diff(line) <= NEAR)
        starts = np.flatnonzero(np.concatenate([[True], ~same]))
        ends = np.concatenate([starts[1:], [len(line)]])
        alone = ends - starts == 1
        i = starts[alone]
        acc[i] = np.where(own[i] & (acc[i] == -1), id_[i], acc[i])
        for a, b in zip(starts[~alone], ends[~alone]):
            acc[a:b] = _settle_block(own[a:b], line[a:b], id_[a:b], acc[a:b])
        out = rows.assign(acc=acc)[own]
        return out.assign(acc=out["acc"].astype("Int64").mask(out["acc"] == -1))[columns]

    for batch in batches:
        rows = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
        if not len(rows):
            continue
        last = rows.iloc[-1]
        tail = (rows["hk"] == last["hk"]) & (rows["hk2"] == last["hk2"]) & (rows["blk"] == last["blk"])
        done, rest = rows[~tail], rows[tail]
        if len(done):
            yield work(done.reset_index(drop=True))
    if rest is not None and len(rest):
        yield work(rest.reset_index(drop=True))


class History:
    """The accepted findings so far, as hashes in a bucketed table in the shared folder."""

    def __init__(self, spark: SparkSession, buckets: int | None = None, name: str | None = None):
        """A new store, or the one of that name. buckets counts for a new store only: as many as the session's shuffle
        partitions by default, so that probing it is spread as widely as any other step."""
        self.spark, self.buckets, self.empty = spark, buckets or shuffle_partitions(spark), True
        self.name = name or f"veilscan_history_{uuid.uuid4().hex[:12]}"
        self.path = f"{shared_dir(spark)}/{self.name}" if name else scratch(spark, self.name)
        if name:
            self._open()

    def _open(self) -> None:
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path + "-buckets")
        if hadoop.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
            self.buckets, self.empty = self.spark.read.parquet(self.path + "-buckets").first()[0], False
            self.spark.sql(f"CREATE TABLE IF NOT EXISTS {self.name} ({STORED}) USING parquet CLUSTERED BY (para) SORTED BY (para) INTO {self.buckets} BUCKETS LOCATION '{self.path}'")

    def close(self) -> None:
        """Take the store out of the session's catalogue; its files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

    def _append(self, accepted: DataFrame, key: str) -> None:
        if not self.empty and not self.spark.table(self.name).where(F.col("batch") == key).isEmpty():
            return  # the batch came before, and its hashes are there
        rows = accepted.select("hk", "hk2", "line", "id", F.lit(key).alias("batch"), F.xxhash64("hk", "hk2", F.floor(F.col("line") / SPAN)).alias("para"))
        writer = rows.repartition(self.buckets, "para").write.bucketBy(self.buckets, "para").sortBy("para").format("parquet")
        if self.empty:
            writer.option("path", self.path).mode("overwrite").saveAsTable(self.name)
            self.spark.createDataFrame([(self.buckets,)], "buckets int").coalesce(1).write.mode("overwrite").parquet(self.path + "-buckets")
        else:
            writer.mode("append").saveAsTable(self.name)
        self.empty = False

    def _known(self, reps: DataFrame, key: str) -> DataFrame:
        """The accepted row of the store each first row repeats."""
        store = self.spark.table(self.name).where(F.col("batch") != key).select("para", F.col("hk").alias("s_hk"), F.col("hk2").alias("s_hk2"), F.col("line").alias("s_line"), F.col("id").alias("s_id"))
        # equal hashes besides the bucket key are compared by xor, or they would become join keys the buckets do not match
        same = (F.col("hk").bitwiseXOR(F.col("s_hk")) == 0) & (F.col("hk2").bitwiseXOR(F.col("s_hk2")) == 0) & (F.col("s_id") < F.col("id"))
        own = reps.withColumn("para", F.xxhash64("hk", "hk2", F.floor(F.col("line") / SPAN)))
        full = written(own.join(store, (own["para"] == store["para"]) & same & (F.col("line") - F.col("s_line") == 0), "left_semi").withColumn("copy", F.lit(True)), "history-full")
        rest = own.join(full.select("hk", "hk2", "line"), ["hk", "hk2", "line"], "left_anti").select("hk", "hk2", "line", "id")
        spans = F.explode(F.array(*[F.floor(F.col("line") / SPAN) + d for d in (-1, 0, 1)]))
        probes = rest.withColumn("span", spans).select("hk", "hk2", "line", "id", F.xxhash64("hk", "hk2", "span").alias("para"))
        covered = probes.join(store, (probes["para"] == store["para"]) & same & (F.abs(F.col("line") - F.col("s_line")) <= NEAR), "left_semi").withColumn("copy", F.lit(False))
        both = full.select("hk", "hk2", "line", "id", "para", "copy").unionByName(covered)
        hits = both.join(store, (both["para"] == store["para"]) & same & (F.abs(F.col("line") - F.col("s_line")) <= F.when(F.col("copy"), 0).otherwise(NEAR)))
        return hits.groupBy("hk", "hk2", "line", "id").agg(F.min("s_id").alias("acc"))

    def add(self, batch: DataFrame, id_col: str = "finding_id", path_col: str = "file_path", kind_col: str = "pattern_type", line_col: str = "line_number", key: str | None = None) -> DataFrame:
        """Take a batch in; returns (id, acc): each row that takes part with the accepted row it repeats, or itself.

        Rows whose path or line is null are never repeats and are not in the result; a null pattern type is a type of its
        own. Batches must come in the order of ids. Only the four named columns are read. An empty batch changes nothing.
        A batch that comes again under its key, after a failure, gets the same result and is stored once.
        """
        key = key or uuid.uuid4().hex
        p, k = same_path(F.col(path_col)), F.coalesce(same_type(F.col(kind_col)), F.lit("\0"))
        rows = batch.where(F.col(path_col).isNotNull() & F.col(line_col).isNotNull()).select(p.alias("p"), k.alias("k"), F.col(line_col).cast("long").alias("line"), F.col(id_col).cast("long").alias("id"))
        keyed = written(rows.select(F.xxhash64("p", "k").alias("hk"), F.xxhash64("k", "p", F.lit(7)).alias("hk2"), "line", "id"), "history-batch")
        reps = keyed.groupBy("hk", "hk2", "line").agg(F.min("id").alias("id"))
        todo = reps.withColumn("acc", F.lit(None).cast("long"))
        decided = None
        if not self.empty:
            reps = written(reps, "history-first")
            known = written(self._known(reps, key), "history-known")
            decided = known.select("hk", "hk2", "line", "id", "acc")
            todo = reps.join(known.select("hk", "hk2", "line"), ["hk", "hk2", "line"], "left_anti").withColumn("acc", F.lit(None).cast("long"))
        context = None  # accepted rows beside those still open
        while True:
            step = written(self._round(todo if context is None else todo.unionByName(context)), "history-round")
            settled = step.where(F.col("acc").isNotNull())
            decided = settled if decided is None else decided.unionByName(settled)
            todo = step.where(F.col("acc").isNull())
            if todo.isEmpty():
                break
            mine = todo.select("hk", "hk2").distinct()
            context = written(decided.where(F.col("acc") == F.col("id")).join(mine, ["hk", "hk2"], "left_semi"), "history-context")
        decided = written(decided.dropDuplicates(["hk", "hk2", "line"]), "history-decided")
        self._append(decided.where(F.col("acc") == F.col("id")).select("hk", "hk2", "line", "id"), key)
        return keyed.join(decided.select("hk", "hk2", "line", "acc"), ["hk", "hk2", "line"]).select("id", "acc")

    @staticmethod
    def _round(rows: DataFrame) -> DataFrame:
        blk = F.floor(F.col("line") / BLOCK)
        at = F.pmod(F.col("line"), F.lit(BLOCK))
        places = F.array_compact(F.array(F.struct(blk.alias("blk"), F.lit(True).alias("own")), F.when(at < NEAR, F.struct((blk - 1).alias("blk"), F.lit(False).alias("own"))), F.when(at >= BLOCK - NEAR, F.struct((blk + 1).alias("blk"), F.lit(False).alias("own")))))
        spread = rows.select("hk", "hk2", "line", "id", "acc", F.inline(places))
        return spread.repartition("hk", "hk2", "blk").sortWithinPartitions("hk", "hk2", "blk", "line").mapInPandas(_settle, "hk long, hk2 long, line long, id long, acc long")


def repeated_findings(findings: DataFrame, steps: int = 3, id_col: str = "finding_id") -> DataFrame:
    """(finding_id_a, finding_id_b): every repeated finding b with the accepted finding a it repeats.

    The table arrives in ``steps`` batches of consecutive ids, each checked against the store of all before it.
    """
    spark = findings.sparkSession
    history = History(spark)
    low, high = findings.agg(F.min(id_col), F.max(id_col)).first()
    if low is None:
        return spark.createDataFrame([], "finding_id_a long, finding_id_b long")
    width = -(-(high - low + 1) // steps)
    pairs = None
    for k in range(steps):
        batch = findings.where((F.col(id_col) >= low + k * width) & (F.col(id_col) < low + (k + 1) * width))
        done = history.add(batch, id_col)
        pairs = done if pairs is None else pairs.unionByName(done)
    history.close()
    return pairs.where(F.col("acc") != F.col("id")).select(F.col("acc").alias("finding_id_a"), F.col("id").alias("finding_id_b"))
