"""Resumable incremental harvest of landed pages."""

from __future__ import annotations

import datetime
from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.fixed import FIRST_DAY, RECORD_SETS
from ..session import cut, discard, shuffles_end
from ..sources.records import in_window, project_record, read_records, valid_records
from ..sources.tables import PAPERS_RAW, BucketTable, SnapshotTable, latest_per_key

# Arrival order within a run: a later set wins, then a later page, then the later datestamp in it.
ARRIVAL = ("landed_at", "landed_in", "datestamp", "updated", "title")
LANDED = f"{PAPERS_RAW}, datestamp string, landed_at timestamp, landed_in string, landed_set string, landed_run int, set_rank int"
RUNS = "run int, from_date string, until_date string, scanned long, valid long, saved long, waiting long"


def flat_records(
    spark: SparkSession,
    landing: str,
    streaming: bool = False,
    from_date: str | None = None,
    until_date: str | None = None,
    files_per_batch: int | None = None,
) -> DataFrame:
    records = read_records(spark, landing, streaming, files_per_batch)
    rows = project_record(valid_records(records))
    return in_window(rows, from_date, until_date)


class Harvest:
    """A table of papers and what is kept beside it: records that wait for their window, and one
    state row per run.

    Only pages that landed since the last run are read. A run takes from these and from the waiting
    records what its window holds; the rest waits. Of an id's records the last one in the window
    counts, and it takes the place of earlier ones that wait; where a later one waits, it is taken
    only if the table does not have the id. So no record is lost, and none replaces a later one.

    A run stages its pages, merges by parts of the table, writes what waits and the state row, and
    only then forgets the staged pages. After a failure the next run finds them and repeats the
    rest, which changes nothing that was done.
    """

    def __init__(
        self, spark: SparkSession, landing: str, target: str, checkpoint: str, sets: Sequence[str] = RECORD_SETS, buckets: int = 64
    ):
        self.spark, self.landing, self.checkpoint, self.sets = spark, landing, checkpoint, list(sets)
        target = target.rstrip("/")
        self.table = BucketTable(spark, target, PAPERS_RAW, ["id"], buckets)
        self.waiting = SnapshotTable(spark, f"{target}_waiting", LANDED)
        self._staged, self._runs = f"{target}_landed", f"{target}_runs"

    def _path(self, uri: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(uri)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _read(self, folder: str, schema: str) -> DataFrame:
        path, system = self._path(folder)
        if not system.exists(path):
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).parquet(folder)
        return rows.select(*T.StructType.fromDDL(schema).names)

    def runs(self) -> DataFrame:
        """One row per completed run: its window, records scanned and valid in the pages it read,
        records saved (each one in the window, also where a later one takes its place), and records
        left waiting."""
        return self._read(self._runs, RUNS)

    def window(self, from_date: str | None, until_date: str | None, first_day: str = FIRST_DAY) -> tuple[str, str]:
        """From where the last run ended, or the first day of all, until today."""
        if from_date is None:
            last = self.runs().orderBy(F.desc("run")).select("until_date").first()
            from_date = (last.until_date if last else None) or first_day
        return from_date, until_date or datetime.date.today().isoformat()

    def run(self, from_date: str | None = None, until_date: str | None = None, files_per_batch: int | None = None) -> DataFrame:
        """One run over all new pages; returns its state row. None leaves a side of the window open."""
        number = 1 + (self.runs().agg(F.max("run")).first()[0] or 0)
        self._stage(number, files_per_batch)
        staged, counts = f"{self._staged}/rows", f"{self._staged}/counts"
        landed = self._read(staged, LANDED)
        both = landed.unionByName(self.waiting.read())
        # What landed and what waits are tables already.
        both = both.withColumn("seq", F.struct("landed_run", "set_rank", *ARRIVAL))
        window = in_window(both, from_date, until_date)
        saved = Observation()
        taken = latest_per_key(window.observe(saved, F.count(F.lit(1)).alias("saved")), ["id"], [F.col("seq")])
        taken = cut(taken, "harvest-taken")
        mine = taken.select(F.col("id").alias("_id"), F.col("seq").alias("_seq"))
        day = F.substring("datestamp", 1, 10)
        outside = F.lit(False)
        for bound in [day < from_date] * bool(from_date) + [day > until_date] * bool(until_date):
            outside = outside | F.coalesce(bound, F.lit(True))
        rest = both.where(outside).join(mine, F.col("id") == F.col("_id"), "left")
        rest = rest.where("_seq is null or seq > _seq").drop("_id", "_seq")
        rest = cut(latest_per_key(rest, ["id", "datestamp"], [F.col("seq")]), "harvest-waiting")
        left = rest.count()
        self._merge(taken, rest)
        if left or not self.waiting.read().isEmpty():
            self.waiting.replace(rest.drop("seq"))
        discard(self.spark, [taken, rest])
        seen = self._read(counts, "scanned long, valid long").agg(F.sum("scanned").alias("scanned"), F.sum("valid").alias("valid")).first()
        row = (number, from_date, until_date, seen.scanned or 0, seen.valid or 0, saved.get.get("saved", 0), left)
        state = self.spark.createDataFrame([row], RUNS)
        state.coalesce(1).write.mode("append").parquet(self._runs)
        path, system = self._path(self._staged)
        system.delete(path, True)
        return state

    def _stage(self, number: int, files_per_batch: int | None) -> None:
        """New pages as rows beside the table, and how many records each batch had."""
        rank = F.coalesce(F.array_position(F.array(*map(F.lit, self.sets)), F.col("landed_set")), F.lit(0)).cast("int")

        def stage(batch: DataFrame, n: int) -> None:
            scanned, valid = Observation(), Observation()
            rows = project_record(valid_records(batch.observe(scanned, F.count(F.lit(1)).alias("n"))))
            rows = rows.observe(valid, F.count(F.lit(1)).alias("n"))
            rows = rows.withColumns({"datestamp": F.coalesce("datestamp", F.lit("")), "landed_run": F.lit(number), "set_rank": rank})
            # A batch that is replayed replaces what it wrote before.
            with shuffles_end(self.spark):
                rows.write.mode("overwrite").option("compression", "zstd").parquet(f"{self._staged}/rows/batch={n}")
            counts = self.spark.createDataFrame([(scanned.get.get("n", 0), valid.get.get("n", 0))], "scanned long, valid long")
            counts.coalesce(1).write.mode("overwrite").parquet(f"{self._staged}/counts/batch={n}")

        records = read_records(self.spark, self.landing, True, files_per_batch)
        query = (
            records.writeStream.foreachBatch(stage)
            .option("checkpointLocation", self.checkpoint)
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()

    def _merge(self, taken: DataFrame, rest: DataFrame) -> None:
        """Rows that the table lacks or has otherwise go into their parts of it; ``taken`` is used up."""
        parts = self.table.touched(taken)
        if not parts:
            return
        columns = [f.name for f in self.table.schema.fields]
        known = self.table.read(parts).select(F.col("id").alias("_id"), F.struct(*columns).alias("_row"))
        later = rest.select(F.col("id").alias("_later")).distinct()
        rows = taken.join(known, F.col("id") == F.col("_id"), "left").join(later, F.col("id") == F.col("_later"), "left")
        new = F.col("_id").isNull() | (F.col("_later").isNull() & ~F.struct(*columns).eqNullSafe(F.col("_row")))
        self.table.upsert(rows.where(new).select(*columns), [taken])


def ingest(
    spark: SparkSession,
    landing: str,
    target: str,
    checkpoint: str,
    from_date: str | None = None,
    until_date: str | None = None,
    files_per_batch: int | None = None,
) -> DataFrame:
    """Merge every page not seen before and return the table at ``target``.

    The dates bound what this run takes, both are open by default; a record outside waits for a
    later run. By default all that has landed is one batch; ``files_per_batch`` splits a backlog.
    """
    found = Harvest(spark, landing, target, checkpoint)
    found.run(from_date, until_date, files_per_batch)
    return found.table.read()


def harvest(
    spark: SparkSession,
    landing: str,
    target: str,
    checkpoint: str,
    from_date: str | None = None,
    until_date: str | None = None,
    sets: Sequence[str] = RECORD_SETS,
    first_day: str = FIRST_DAY,
) -> DataFrame:
    """A run from where the last one ended (at first from ``first_day``) until today; returns its
    window and counts.

    Pages lie in a folder for each set, or in none; of a record that several sets hold the one in
    the last of ``sets`` counts.
    """
    found = Harvest(spark, landing, target, checkpoint, sets)
    return found.run(*found.window(from_date, until_date, first_day))
