"""The N highest-scoring rows of every group, by skipping row groups on their statistics.

1. Cluster: range-partition on (group, score desc, tie) and sort, so that each row group of the written files holds
   few groups and a narrow span of scores. A hot group spreads over as many files as it needs. Tables whose files are
   clustered already are read as they are (``top_n_of_files``).
2. Catalogue: read the footers only; per row group the span of groups and of scores.
3. Floor: a row group that holds one single group and at least N rows proves that the group's N-th score is at least
   its lowest score. Row groups of that group whose highest score is strictly below the floor are never opened.
4. Read: one task per file; row groups in descending maximum score; a row group is skipped when its maximum is strictly
   below the N-th score seen so far of every group in it, for which of a row group of several groups only the group column
   is read. Equal scores are read, for the tie rule.
5. Merge: at most N rows per (file, group) meet in one window.

In files clustered by step 1 a row group of several groups holds the best rows of all but the first of them, so that only
row groups of one group can be skipped there.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch, shuffle_partitions, written

CATALOG = "file_no long, file string, ordinal int, n_rows long, g_min string, g_max string, s_min double, s_max double, nulls long"


def footers(files: list[str], numbers: list[int], columns: list[str]) -> pd.DataFrame:
    """The catalogue rows of some of the files; a span is null where the file has no statistics."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    rows = []
    for i in numbers:
        system, path = fs.FileSystem.from_uri(files[i])
        meta = pq.ParquetFile(system.open_input_file(path)).metadata
        at = [meta.schema.names.index(c) for c in columns[:2]]
        for k in range(meta.num_row_groups):
            part = meta.row_group(k)
            g, s = (part.column(c).statistics for c in at)
            known_g, known_s = g is not None and g.has_min_max, s is not None and s.has_min_max
            nulls = -1 if g is None or s is None or g.null_count is None or s.null_count is None else g.null_count + s.null_count
            rows.append((i, files[i], k, part.num_rows, g.min if known_g else None, g.max if known_g else None, s.min if known_s else None, s.max if known_s else None, nulls))
    return pd.DataFrame(rows, columns=[c.split()[0] for c in CATALOG.split(", ")])


def _footers(files: list[str], columns: list[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield footers(files, batch["id"].tolist(), columns)

    return run


def _above(nth: dict[str, list[float]], groups, n: int, most: float) -> bool:
    """Whether each of the groups has n rows already, all of them above the score."""
    return all(len(best := nth.get(g, ())) == n and best[0] > most for g in groups)


def best_of_file(catalog: pd.DataFrame, n: int, names: list[str], least: float, most: float) -> pd.DataFrame:
    """At most n rows of each group of one file; catalog: its row groups that may hold some."""
    import heapq

    import pyarrow.parquet as pq
    from pyarrow import fs

    group, score, tie = names
    system, path = fs.FileSystem.from_uri(catalog["file"].iloc[0])
    parquet = pq.ParquetFile(system.open_input_file(path))
    nth: dict[str, list[float]] = {}  # a heap of the best n scores of each group so far
    kept = []
    for r in catalog.sort_values("s_max", ascending=False, na_position="first").itertuples():
        if r.g_min is not None and r.s_max is not None and _above(nth, {r.g_min, r.g_max}, n, r.s_max):
            inside = [r.g_min] if r.g_min == r.g_max else parquet.read_row_group(int(r.ordinal), columns=[group]).column(0).unique().to_pylist()
            if _above(nth, (g for g in inside if g is not None), n, r.s_max):
                continue
        rows = parquet.read_row_group(int(r.ordinal), columns=names).select(names).to_pandas()
        rows = rows[rows[group].notna() & (rows[score] >= least) & (rows[score] <= most)]
        rows = rows.sort_values([group, score, tie], ascending=[True, False, True], kind="stable").groupby(group, sort=False).head(n)
        for g, s in zip(rows[group].tolist(), rows[score].tolist()):
            best = nth.setdefault(g, [])
            heapq.heappush(best, s) if len(best) < n else heapq.heappushpop(best, s)
        kept.append(rows)
    best = pd.concat(kept) if kept else pd.DataFrame(columns=names)
    best = best.sort_values([group, score, tie], ascending=[True, False, True], kind="stable").groupby(group, sort=False).head(n)
    return best.set_axis(["g", "s", "t"], axis=1)


def _best(n: int, names: list[str], least: float, most: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = [batch for batch in batches if len(batch)]
        for _, catalog in pd.concat(rows).groupby("file") if rows else ():
            yield best_of_file(catalog, n, names, least, most)

    return run


def top_n_of_files(spark: SparkSession, path: str, group: str, score: str, tie: str, n: int, least: float = -math.inf, most: float = math.inf) -> DataFrame:
    """As top_n_by_group, over a parquet folder as it lies: nothing is shuffled but row-group statistics and the results.

    Group must be a string, score a double without NaN and -0.0, tie of an integer type. The better the files are clustered by
    group, the more row groups stay closed; the result is the same.
    """
    stored = spark.read.parquet(path)
    tie_type = stored.schema[tie].dataType.simpleString()
    files = sorted(stored.inputFiles())  # names only; as many as files
    columns = [group, score, tie]
    catalog = written(spark.range(0, len(files), 1, len(files)).mapInPandas(_footers(files, columns), CATALOG), "topn-catalog")
    alone = (F.col("g_min") == F.col("g_max")) & (F.col("nulls") == 0)
    floor = catalog.where(alone & (F.col("n_rows") >= n) & (F.col("s_min") >= F.lit(least)) & (F.col("s_max") <= F.lit(most))).groupBy(F.col("g_min").alias("g")).agg(F.max("s_min").alias("floor"))
    unread = (F.col("g_min") == F.col("g_max")) & (F.col("s_max") < F.col("floor"))
    outside = (F.col("s_max") < F.lit(least)) | (F.col("s_min") > F.lit(most))
    wanted = catalog.join(floor, F.col("g_min") == F.col("g"), "left").where(~F.coalesce(unread, F.lit(False)) & ~F.coalesce(outside, F.lit(False))).drop("g", "floor")
    # a partition per file by its number: the catalogue is small, what its rows stand for is not
    best = wanted.repartitionByRange(len(files), "file_no").mapInPandas(_best(n, columns, least, most), f"g string, s double, t {tie_type}")
    rank = F.row_number().over(Window.partitionBy("g").orderBy(F.col("s").desc(), F.col("t")))
    return best.withColumn("rank", rank).where(F.col("rank") <= n).select(F.col("g").alias(group), F.col("s").alias(score), F.col("t").alias(tie), "rank")


def top_n_by_group(df: DataFrame, group: str, score: str, tie: str, n: int, least: float | None = None, most: float | None = None, row_group_bytes: int = 1 << 20) -> DataFrame:
    """The n rows of each group with the highest score; equal scores by the smaller tie value.

    Takes the three named columns only, so extra columns of any name do no harm. A null group has no rows; scores that
    are null, NaN, below ``least`` or above ``most`` do not take part. Groups with fewer rows give all of them. Rows
    that are repeated with their tie value count as often as they stand. An empty table gives an empty result. Group
    must be a string. row_group_bytes is the size of the written row groups; it changes what is skipped, never the result.

    Returns group, score, tie and rank (1 to n).
    """
    spark = df.sparkSession
    s = F.col(score).cast("double") + F.lit(0.0)  # -0.0 sorts as 0.0
    base = df.select(F.col(group).alias("g"), s.alias("s"), F.col(tie).alias("t")).where(F.col("g").isNotNull() & F.col("s").isNotNull() & ~F.isnan("s"))
    if least is not None:
        base = base.where(F.col("s") >= F.lit(float(least)))
    if most is not None:
        base = base.where(F.col("s") <= F.lit(float(most)))
    path = scratch(spark, "topn-clustered")
    order = [F.col("g"), F.col("s").desc(), F.col("t")]
    base.repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order).write.option("parquet.block.size", row_group_bytes).parquet(path)
    names = {"g": group, "s": score, "t": tie}
    if not spark.read.schema(base.schema).parquet(path).inputFiles():
        return spark.createDataFrame([], f"`{group}` string, `{score}` double, `{tie}` {base.schema['t'].dataType.simpleString()}, rank int")
    best = top_n_of_files(spark, path, "g", "s", "t", n, -math.inf if least is None else least, math.inf if most is None else most)
    return best.select(*(F.col(k).alias(v) for k, v in names.items()), "rank")
