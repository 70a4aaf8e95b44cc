"""Keyed tables on plain Parquet: merge logic as DataFrames, versions as folders."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut, discard, shuffles_end

# Schemas as DDL, so that importing needs no session.
PAPERS_RAW = (
    "id string, title string, authors string, published string, summary string, link string, "
    "categories string, updated string, pdf_url string"
)
PAPERS = (
    "id string, title string, authors string, published string, summary string, link string, "
    "kmeans_cluster int, agg_cluster int, hdbscan_cluster int, ai_regex_hit int, "
    "ai_sem_sim double, ai_stage2_keep int, ai_stage2_reason string, domain_tag string"
)
EMBEDDINGS = "paper_id string, model string, dim int, vector array<float>, created_at timestamp"
CLUSTER_META = (
    "method string, cluster_id int, label string, confidence double, terms array<string>, "
    "created_at timestamp"
)


def read_table(
    spark: SparkSession,
    path: str,
    columns: Sequence[str] | None = None,
    where: Column | None = None,
    spread: bool = False,
) -> DataFrame:
    """Parquet scan; the filter and the column list reach the reader.

    ``spread`` is for scans that feed heavy work per row: a table with fewer splits than the
    cluster has cores is dealt out evenly. A large table has more splits and is left alone.
    """
    df = spark.read.parquet(path)
    if where is not None:
        df = df.where(where)
    df = df.select(*columns) if columns else df
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if spread and df.rdd.getNumPartitions() < cores else df


def ensure_columns(df: DataFrame, schema: T.StructType | str) -> DataFrame:
    """Add what is missing from ``schema`` as typed NULLs; leave the rest alone."""
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    missing = {
        f.name: F.lit(None).cast(f.dataType) for f in schema.fields if f.name not in df.columns
    }
    return df.withColumns(missing) if missing else df


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key, the last in ``order``.

    ``row_number() = 1`` gets a group limit before the shuffle, so a key with a third of all
    rows ships one row per map task.
    """
    newest_first = Window.partitionBy(*keys).orderBy(*[o.desc() for o in order])
    return df.withColumn("_rn", F.row_number().over(newest_first)).where("_rn = 1").drop("_rn")


def union_sets(
    frames: Sequence[DataFrame], keys: Sequence[str] = ("id",), order: Sequence[Column] = ()
) -> DataFrame:
    """Union of harvest sets; a record listed in several is kept once, from the last set."""
    tagged = [df.withColumn("_set", F.lit(i)) for i, df in enumerate(frames)]
    both = reduce(DataFrame.unionByName, tagged)
    return latest_per_key(both, keys, [F.col("_set"), *order]).drop("_set")


def _matched(target: DataFrame, source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys of ``source`` already in ``target``: a key-only scan of the large side."""
    return target.select(*keys).join(source.select(*keys), list(keys), "left_semi")


def upsert(
    target: DataFrame,
    source: DataFrame,
    keys: Sequence[str],
    update_cols: Sequence[str] | str = "*",
    order_by: Sequence[Column] | None = None,
    prune: bool = False,
) -> DataFrame:
    """The table after ``source`` is merged into ``target`` by ``keys``.

    Listed columns take the source's value (a NULL too), all others keep the target's. New keys
    are inserted. A key repeated in the source counts once: ``order_by`` says which row, last wins;
    without it the greatest row does, column by column. ``prune`` also drops target rows whose
    key is absent from the source.

    No full outer join: a small batch is broadcast and the large table is never shuffled.
    """
    keys = list(keys)
    rest = [F.col(c) for c in source.columns if c not in keys]
    source = latest_per_key(source, keys, order_by or rest or [F.col(keys[0])])
    source = source.select(*[c for c in source.columns if c in target.columns])
    cols = [c for c in source.columns if c not in keys] if update_cols == "*" else list(update_cols)
    merged = update_by_key(target, source, keys, cols, "inner" if prune else "left")
    fresh = source.join(_matched(target, source, keys), keys, "left_anti")
    return merged.unionByName(fresh, allowMissingColumns=True)


def update_by_key(
    target: DataFrame,
    updates: DataFrame,
    keys: Sequence[str],
    cols: Sequence[str],
    how: str = "left",
) -> DataFrame:
    """Overwrite ``cols`` where a key matches; insert nothing."""
    keys = list(keys)
    new = updates.select(
        *keys, *[F.col(c).alias(f"_new_{c}") for c in cols], F.lit(True).alias("_hit")
    )
    joined = target.join(new, keys, how)
    return joined.select(
        *[
            F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c)
            if c in cols
            else F.col(c)
            for c in target.columns
        ]
    )


def audit_integrity(
    child: DataFrame, parent: DataFrame, child_key: str, parent_key: str
) -> DataFrame:
    """Child rows that point at no parent."""
    parents = parent.select(F.col(parent_key).alias(child_key))
    return child.join(parents, child_key, "left_anti")


def cascade(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Child rows that survive when orphans are removed."""
    parents = parent.select(F.col(parent_key).alias(child_key))
    return child.join(parents, child_key, "left_semi")


class SnapshotTable:
    """A table kept as numbered Parquet folders; the newest complete folder is the table.

    Plain Parquet cannot be changed in place, nor overwritten while it is read. Each write makes
    a new folder, which counts only once Spark has put its success marker there, so a reader or
    a crashed writer never sees half a table. Use a table format with MERGE where you have one.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, keep: int = 2):
        self.spark, self.path, self.keep = spark, path.rstrip("/"), keep
        self.schema = T.StructType.fromDDL(schema)
        jvm = spark._jvm
        self._hadoop_path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._hadoop_path(self.path).getFileSystem(
            spark._jsc.hadoopConfiguration()
        )

    def versions(self) -> list[int]:
        root = self._hadoop_path(self.path)
        if not self._fs.exists(root):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(root)]
        done = [
            n for n in names
            if n.startswith("v") and self._fs.exists(self._hadoop_path(f"{self.path}/{n}/_SUCCESS"))
        ]
        return sorted(int(n[1:]) for n in done)

    def read(self) -> DataFrame:
        done = self.versions()
        if not done:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(self._folder(done[-1]))

    def replace(self, df: DataFrame) -> DataFrame:
        done = self.versions()
        columns = [F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema.fields]
        whole = ensure_columns(df, self.schema).select(*columns)
        number = done[-1] + 1 if done else 1
        with shuffles_end(self.spark):
            whole.write.mode("overwrite").option("compression", "zstd").parquet(self._folder(number))
        for old in (done + [number])[: -self.keep]:
            self._fs.delete(self._hadoop_path(self._folder(old)), True)
        return self.read()

    def upsert(self, source: DataFrame, keys: Sequence[str], **how) -> DataFrame:
        return self.replace(upsert(self.read(), source, keys, **how))

    def update_by_key(
        self, updates: DataFrame, keys: Sequence[str], cols: Sequence[str]
    ) -> DataFrame:
        return self.replace(update_by_key(self.read(), updates, keys, cols))

    def _folder(self, number: int) -> str:
        return f"{self.path}/v{number:08d}"


class BucketTable:
    """A keyed table in ``buckets`` parts by hash of the key, of which a merge rewrites those it touches.

    The parts are Hive partitions of plain Parquet and are replaced by Spark's dynamic partition
    overwrite, so every other part keeps its files. The merged rows are written aside first; a part
    is only exchanged once they are complete, and a merge that is repeated gives the same table. A
    reader that began before must not go on reading a part that has been exchanged since.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: Sequence[str], buckets: int = 64):
        self.spark, self.keys, self.buckets = spark, list(keys), buckets
        self.path = path.rstrip("/")
        # Parts of another number of buckets would not be found again.
        self.folder = f"{self.path}/buckets-{buckets}"
        self.schema = T.StructType.fromDDL(schema)
        self._stored = T.StructType([*self.schema.fields, T.StructField("_bucket", T.IntegerType())])

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def read(self, buckets: Sequence[int] | None = None) -> DataFrame:
        """All rows, or those of some parts; the others are not opened."""
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        if not where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where):
            return self.spark.createDataFrame([], self.schema)
        rows = self.spark.read.schema(self._stored).parquet(self.folder)
        if buckets is not None:
            rows = rows.where(F.col("_bucket").isin(list(buckets)))
        return rows.drop("_bucket")

    def touched(self, source: DataFrame) -> list[int]:
        """Parts that hold or would hold the source's keys: at most ``buckets`` numbers."""
        found = source.select(self._bucket().alias("b")).distinct().collect()
        return sorted(r["b"] for r in found)

    def upsert(self, source: DataFrame, after: Sequence[DataFrame] = (), **how) -> DataFrame:
        """The table after ``upsert`` of ``source``; ``prune`` would concern all parts and is refused.
        Tables of cuts in ``after`` are read for the source alone and are deleted once it is written."""
        if how.get("prune"):
            raise ValueError("a merge by parts cannot prune")
        source = cut(source, "merge-source", after)
        parts = self.touched(source)
        if parts:
            merged = upsert(self.read(parts), source, self.keys, **how)
            columns = [F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema.fields]
            whole = ensure_columns(merged, self.schema).select(*columns)
            whole = cut(whole.withColumn("_bucket", self._bucket()), "merged", [source])
            with shuffles_end(self.spark):
                whole.repartition(len(parts), "_bucket").write.mode("overwrite").options(
                    partitionOverwriteMode="dynamic", compression="zstd"
                ).partitionBy("_bucket").parquet(self.folder)
            discard(self.spark, [whole])
        else:
            discard(self.spark, [source])
        return self.read()
