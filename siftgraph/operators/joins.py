"""A join for keys known to be hot."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hot_split_join(
    large: DataFrame, counted: DataFrame, keys: Sequence[str], rows: str, spread_by: str
) -> DataFrame:
    """Inner join of ``large`` with ``counted``, which has one row per key and in ``rows`` the
    number of rows that key has in ``large``.

    A key with more than its fair share of rows (all rows over all shuffle partitions) is split
    into as many salted parts as it has shares. Fewer keys than there are partitions can be over
    the share, which bounds what is broadcast and how far the counted side grows. ``counted`` is
    read three times, so it should be a written table.
    """
    keys = list(keys)
    shares = int(large.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = counted.agg(F.sum(rows)).scalar()
    parts = F.greatest(F.ceil(F.try_divide(F.col(rows) * shares, "_total")), F.lit(1)).cast("int")
    sized = counted.withColumn("_total", total).withColumn("_parts", parts).drop("_total")
    hot = sized.where(F.col("_parts") > 1).select(*keys, "_parts")
    salt = F.pmod(F.xxhash64(spread_by), F.coalesce("_parts", F.lit(1))).cast("int")
    salted = large.join(F.broadcast(hot), keys, "left").withColumn("_salt", salt).drop("_parts")
    spread = sized.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    return salted.join(spread.drop("_parts"), [*keys, "_salt"]).drop("_salt")
