"""A versioned observation table whose merges rewrite only the partitions that a batch touches.

Layout: ``data/commit=n/bucket=b/month=m`` holds what commit n wrote, with b a hash of the series and m the month of the period;
``log/commit=n`` is one small file that names, for every partition, the commit whose files are current, and their rows. A
commit counts once its log file stands (one file, so it is there or not); files of a run that failed before that are never read
and are written over when it runs again. Older commits stay readable. One writer at a time.
"""
from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage
from . import versioned as V

ROW_TYPES = {"version_id": "string", "series_id": "string", "obs_start": "date", "obs_end": "date", "value": "double", "status": "string",
             "source_published_at": "timestamp", "first_seen_at": "timestamp", "retrieved_at": "timestamp", "raw_sha256": "string",
             "revision_no": "int", "is_current": "boolean", "superseded_at": "timestamp", "attrs": "string"}
ROWS = ", ".join(f"{c} {ROW_TYPES[c]}" for c in V.COLUMNS)
PLACE = ["bucket", "month"]
_LOG = "bucket int, month int, written long, n_rows long, mark decimal(38,0), buckets int"


@dataclass(frozen=True)
class Merge:
    """What one commit did: partitions it touched, partitions it changed, by how many rows the table grew. ``repeated`` if it
    stood already."""
    commit: int
    touched: int
    rewritten: int
    added: int
    repeated: bool = False


class PartitionedVersions:
    def __init__(self, spark: SparkSession, root: str, buckets: int = 64):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets

    def place(self, rows: DataFrame) -> DataFrame:
        """``rows`` with bucket and month; a null period belongs to month 0."""
        return rows.withColumns({"bucket": F.pmod(F.xxhash64("series_id"), F.lit(self.buckets)).cast("int"),
                                 "month": F.coalesce(F.year("obs_start") * 100 + F.month("obs_start"), F.lit(0)).cast("int")})

    def commits(self) -> list[int]:
        """Numbers of the commits that stand, by names only."""
        try:
            files = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{self.root}/log").select("path")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return []
        return sorted(r[0] for r in files.select(F.regexp_extract("path", r"/commit=(\d+)/[^/]*\.parquet$", 1).cast("long")).distinct().collect() if r[0] is not None)

    def partitions(self, commit: int | None) -> DataFrame:
        """(bucket, month, written, n_rows, mark, buckets) as of a commit: one row per partition; mark sums hashes of its rows."""
        if commit is None:
            return self.spark.createDataFrame([], _LOG)
        return self.spark.read.schema(_LOG).parquet(f"{self.root}/log/commit={commit}")

    def read(self, commit: int | None = None, series: list[str] | None = None) -> DataFrame:
        """The table as of a commit (the last by default). ``series`` narrows the files to the buckets of those series.

        The log's rows choose the files through partition pruning; nothing is listed on the driver but what Spark lists itself.
        """
        stands = self.commits()
        if commit is None:
            commit = stands[-1] if stands else None
        if commit is None:
            return self.spark.createDataFrame([], ROWS)
        if commit not in stands:
            raise ValueError(f"there is no commit {commit}")
        live = self.partitions(commit).select(*PLACE, F.col("written").alias("commit"))
        if series is not None:
            wanted = self.spark.createDataFrame([(s,) for s in series], "series_id string")
            live = live.join(wanted.select(F.pmod(F.xxhash64("series_id"), F.lit(self.buckets)).cast("int").alias("bucket")).distinct(), "bucket", "left_semi")
        files = self.spark.read.schema(f"{ROWS}, commit long, bucket int, month int").parquet(f"{self.root}/data")
        table = files.join(live, ["commit", *PLACE], "left_semi").select(*V.COLUMNS)
        return table if series is None else table.where(F.col("series_id").isin(series))

    def merge(self, commit: int, rows: DataFrame, advance: Callable[[DataFrame, DataFrame], DataFrame]) -> Merge:
        """Commit ``advance(stored rows of the touched partitions, rows)``.

        A commit number that stands already is not run again, so a repeated batch or a restart changes nothing. A partition
        whose rows come out as they were keeps its files.
        """
        stands = self.commits()
        if commit in stands:
            return Merge(commit, 0, 0, 0, True)
        before = max((c for c in stands if c < commit), default=None)
        old = self.partitions(before)
        if before is not None and (r := old.select("buckets").first()) is not None and r[0] != self.buckets:
            raise ValueError(f"the table has {r[0]} buckets, not {self.buckets}")
        rows = cut_lineage(self.place(rows))
        touched = cut_lineage(rows.select(*PLACE).distinct().join(old.drop("buckets"), PLACE, "left"))
        paths = [f"{self.root}/data/commit={r.written}/bucket={r.bucket}/month={r.month}" for r in touched.where("written IS NOT NULL").collect()]   # as many as partitions touched
        stored = self.spark.read.schema(ROWS).parquet(*paths) if paths else self.spark.createDataFrame([], ROWS)
        return self._write(commit, old, touched, self.place(advance(stored, rows.drop(*PLACE)).select(*V.COLUMNS)))

    def load(self, versions: DataFrame) -> Merge:
        """The first commit of an empty table, from rows that are versions already: written once, nothing is merged."""
        if self.commits():
            raise ValueError("the table has commits already")
        old = self.partitions(None)
        return self._write(0, old, old.drop("buckets"), self.place(versions.select(*V.COLUMNS)))

    def _write(self, commit: int, old: DataFrame, touched: DataFrame, after: DataFrame) -> Merge:
        data = f"{self.root}/data/commit={commit}"
        after.hint("rebalance", *PLACE).write.mode("overwrite").partitionBy(*PLACE).parquet(data)
        try:
            new = self.spark.read.schema(f"{ROWS}, bucket int, month int").parquet(data).groupBy(*PLACE).agg(
                F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*V.COLUMNS).cast("decimal(38,0)")).alias("m"))
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            new = self.spark.createDataFrame([], "bucket int, month int, n long, m decimal(38,0)")
        new = cut_lineage(new.join(touched, PLACE, "left").where("NOT (n <=> n_rows AND m <=> mark)").select(*PLACE, "n", "m", F.coalesce("n_rows", F.lit(0)).alias("was")))
        log = old.drop("buckets").join(new.select(*PLACE), PLACE, "left_anti").unionByName(
            new.select(*PLACE, F.lit(commit).cast("long").alias("written"), F.col("n").alias("n_rows"), F.col("m").alias("mark")))
        log.withColumn("buckets", F.lit(self.buckets)).coalesce(1).write.mode("overwrite").parquet(f"{self.root}/log/commit={commit}")
        n = new.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("n") - F.col("was")), F.lit(0))).first()
        return Merge(commit, max(touched.count(), n[0]), n[0], n[1])

    def absorb(self, commit: int, rows: DataFrame, seen_at: str) -> Merge:
        """Rows of any number of batches, each stamped with when it was seen."""
        return self.merge(commit, rows, lambda stored, new: V.absorb_batches(stored, new, seen_at))

    def merge_batch(self, commit: int, batch: DataFrame, retrieved_at) -> Merge:
        """One batch retrieved at one instant; it states a key once at most."""
        return self.merge(commit, batch, lambda stored, new: V.merge_observations(stored, new, retrieved_at)[0])
