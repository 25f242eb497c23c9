"""The scan as a stream: new files become findings, exactly once by checkpoint, with windowed rates on top."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import scan
from ..operators.ignore import IgnoreRules, only_extensions, unignored

FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"
#: Files of a batch while a stream runs, and where all files that are there are taken at once. A batch has costs of its own,
#: a second or two, and no result depends on its size.
ARRIVING, THERE = 1000, 16_000
#: Tasks that list the files of a batch, and what opening a file counts for when files are put together in a task.
LISTING_TASKS, OPEN_COST = 64, "64k"


def arriving_files(spark: SparkSession, folder: str, pattern: str = "*", per_trigger: int = ARRIVING) -> DataFrame:
    """Files of a tree as they arrive. Spark leaves out names that begin with . or _; the batch lister does not."""
    return spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).option("maxFilesPerTrigger", per_trigger).load(folder)


def with_status(files: DataFrame, rules: IgnoreRules | None = None, only: list[str] | None = None, without: list[str] | None = None, max_size: int = 100 << 20) -> DataFrame:
    """(path, length, scan_status, skip_reason, text): extension filters and size first, then binary sniffing and overlong
    lines. The content of a file that is out of scope is never looked at."""
    path = F.col("path")
    rules = rules or IgnoreRules.default()
    kept = files.where(~F.coalesce(rules.column(path), F.lit(False)))
    out_of_scope = ~only_extensions(path, only or [])
    if without:
        out_of_scope = out_of_scope | only_extensions(path, without)
    reason = F.when(out_of_scope, "extension").when(F.col("length") > max_size, "size")
    content = F.when(reason.isNull(), F.col("content"))
    text = F.make_valid_utf8(content.cast("string"))  # decode() would fail the stream on invalid bytes
    binary = F.instr(F.decode(F.substring(content, 1, 512), "ISO-8859-1"), "\0") > 0
    reason = F.coalesce(reason, F.when(binary, "binary"))
    status = F.when(reason.isNotNull(), "skipped").when(scan.too_long_lines(text), "error").otherwise("scanned")
    return kept.select("path", "length", status.alias("scan_status"), reason.alias("skip_reason"), text.alias("text")).withColumn("text", F.when(F.col("scan_status") == "scanned", F.col("text")))


def in_scope(folder: str, spark: SparkSession, max_size: int, per_trigger: int = ARRIVING) -> tuple[DataFrame, DataFrame]:
    """(files whose content is read, files too large to be): the size is asked of the source, which then leaves their bytes
    alone; a file above the source's own limit does not stop the stream."""
    files = arriving_files(spark, folder, per_trigger=per_trigger)
    return files.where(F.col("length") <= max_size), files.where(F.col("length") > max_size).drop("content")


def stream_findings(files: DataFrame, **options) -> DataFrame:
    return scan.findings(with_status(files, **options).where("scan_status = 'scanned'"), "path", "text", strip_cr=True).withColumnRenamed("path", "file_path")


def for_small_files(spark: SparkSession) -> SparkSession:
    """A session with the settings of the given one in which many small files take few tasks. As Spark has it, each file of a
    batch is listed by a task of its own, and a task reads as many as fit at 4 MB each, three or four where it gets 16 MB."""
    own = spark.newSession()
    for key, value in spark.conf.getAll.items() - own.conf.getAll.items():
        own.conf.set(key, value)
    own.conf.set("spark.sql.sources.parallelPartitionDiscovery.parallelism", LISTING_TASKS)
    own.conf.set("spark.sql.files.openCostInBytes", OPEN_COST)
    return own


class StreamScan:
    """Start, pause, resume and stop one streaming scan.

    Each batch of files goes to a table of statuses and a table of findings, and its findings, without those the ignore
    filter takes out, to callbacks.
    """

    def __init__(self, spark: SparkSession, folder: str, out: str, checkpoint: str, **options):
        self.spark, self.folder, self.out, self.checkpoint, self.options = spark, folder, out, checkpoint, options
        self.callbacks: list[Callable[[DataFrame, int], None]] = []
        self.query: StreamingQuery | None = None
        self.ignored: DataFrame | None = None
        self.limit = options.get("max_size", 100 << 20)

    def ignoring(self, files: DataFrame | None) -> StreamScan:
        """Callbacks get no findings of these files (file_path); what is stored stays whole."""
        self.ignored = files
        return self

    def on_batch(self, callback: Callable[[DataFrame, int], None]) -> StreamScan:
        self.callbacks.append(callback)
        return self

    def start(self, once: bool = False) -> StreamScan:
        """Does nothing while the scan runs. once: all files that are there, then end. The stream runs in a session of its own,
        so that it is not among the streams of the given one; results and callbacks are of the given one."""
        if self.active:
            return self
        read, large = in_scope(self.folder, for_small_files(self.spark), self.limit, THERE if once else ARRIVING)
        # the content is a column of one side only, and both sides read the same files
        files = read.unionByName(large, allowMissingColumns=True)

        def sink(batch: DataFrame, number: int) -> None:
            # a batch that is run again after a failure overwrites its own folders
            seen = with_status(batch, **self.options)
            seen.drop("text").write.mode("overwrite").parquet(f"{self.out}-status/batch={number}")
            found = scan.findings(seen.where("scan_status = 'scanned'"), "path", "text", strip_cr=True).withColumnRenamed("path", "file_path")
            found.write.mode("overwrite").parquet(f"{self.out}/batch={number}")
            for c in self.callbacks:
                c(unignored(self.spark.read.parquet(f"{self.out}/batch={number}"), self.ignored), number)

        writer = files.writeStream.foreachBatch(sink).option("checkpointLocation", self.checkpoint)
        self.query = (writer.trigger(availableNow=True) if once else writer).start()
        return self

    @property
    def active(self) -> bool:
        return self.query is not None and self.query.isActive

    @property
    def state(self) -> str:
        if self.query is None:
            return "idle"
        return "running" if self.query.isActive else "error" if self.query.exception() else "stopped"

    def pause(self) -> None:
        """Stop; the checkpoint keeps what was done, and start() goes on from there."""
        if self.active:
            self.query.stop()

    resume = start
    cancel = pause

    def progress(self) -> dict | None:
        return self.query.lastProgress if self.query else None

    def wait(self) -> StreamScan:
        if self.query:
            self.query.awaitTermination()
        return self

    def result(self) -> DataFrame:
        return self.spark.read.parquet(self.out)

    def findings_of(self, path: str) -> DataFrame:
        return self.result().where(F.col("file_path") == path)

    def statuses(self) -> DataFrame:
        """(path, length, scan_status, skip_reason) of every file that came, but for those no rule lets in."""
        return self.spark.read.parquet(f"{self.out}-status")

    def counters(self) -> DataFrame:
        """One row: files that came, scanned, skipped and failed, their bytes, and findings."""
        s = F.col("scan_status")
        files = self.statuses().agg(F.count("*").alias("files"), F.count_if(s == "scanned").alias("scanned"), F.count_if(s == "skipped").alias("skipped"), F.count_if(s == "error").alias("errors"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))
        return files.crossJoin(self.result().agg(F.count("*").alias("findings")))  # one row each


def windowed_rates(events: DataFrame, time_col: str, kind_col: str, window: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Counts per kind and tumbling window; rows later than the watermark are dropped by streams, never by batches."""
    return events.withWatermark(time_col, late).groupBy(F.window(time_col, window).alias("w"), kind_col).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), kind_col, "n")
