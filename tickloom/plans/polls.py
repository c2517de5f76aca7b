"""The first-poll index: when each trade was polled first.

A base, bucketed by the trade's name, and small tables of changes on top. A
look-up shuffles the trades that are asked for and reads the base in place,
bucket by bucket; neither side of it is a table of ticks. Changes only ever
add a folder, so an interrupted refresh leaves the index as it was; every few
of them a new base takes them in.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tickloom.workspace import children, remove

TRADE = "trade_name_"
FIRST = "first_poll"
POLL = "polled_"
WAS = "was_"
_BASE, _CHANGES = "base", "changes"
_MOST_CHANGES = 16


def trade_name(keys) -> Column:
    """One text for the values of ``keys``, nulls included; no two values share it."""
    each = [F.col(k).cast("string") for k in keys]
    return F.concat_ws("", *[F.coalesce(F.concat(F.length(c), F.lit(":"), c), F.lit("-")) for c in each])


def _versions(spark: SparkSession, path: str, kind: str) -> list[tuple[int, str]]:
    """(version, folder) of the complete tables of a kind, oldest first."""
    found = []
    for name in children(spark, path):
        if name.startswith(f"{kind}-") and "_SUCCESS" in children(spark, f"{path}/{name}"):
            found.append((int(name.split("-")[1]), name))
    return sorted(found)


def write_base(firsts: DataFrame, path: str, version: int = 0, buckets: int | None = None) -> None:
    """Write ``firsts`` (trade name, first poll) as the base of a version.

    ``buckets`` stays with the base; without it, it is the shuffle width.
    """
    spark = firsts.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"tickloom_{uuid.uuid4().hex}"
    target = f"{path}/{_BASE}-{version}-{buckets}"
    remove(spark, target)  # what an interrupted attempt has left
    dealt = firsts.select(TRADE, FIRST).repartition(buckets, TRADE)
    dealt.write.bucketBy(buckets, TRADE).sortBy(TRADE).option("path", target).saveAsTable(name)
    spark.sql(f"DROP TABLE {name}")  # an external table: its files stay


def _base(spark: SparkSession, path: str) -> tuple[int, int, DataFrame]:
    """Version, buckets and rows of the newest base, its bucketing known to the planner."""
    version, folder = _versions(spark, path, _BASE)[-1]
    buckets = int(folder.split("-")[2])
    name = f"tickloom_{uuid.uuid4().hex}"
    spark.sql(
        f"CREATE TABLE {name} ({TRADE} STRING, {FIRST} TIMESTAMP) USING parquet "
        f"CLUSTERED BY ({TRADE}) SORTED BY ({TRADE}) INTO {buckets} BUCKETS LOCATION '{path}/{folder}'"
    )
    rows = spark.table(name)
    rows.schema  # resolved, so the name may go again
    spark.sql(f"DROP TABLE {name}")
    return version, buckets, rows


def _changes(spark: SparkSession, path: str, since: int) -> DataFrame | None:
    """The newest change of every trade after a version; a null poll means none is left."""
    found = [f"{path}/{name}" for version, name in _versions(spark, path, _CHANGES) if version > since]
    if not found:
        return None
    rows = spark.read.schema(f"{TRADE} string, {FIRST} timestamp, version bigint").parquet(*found)
    newest = F.max_by(F.struct(FIRST), "version").alias("newest")
    return rows.groupBy(TRADE).agg(newest).select(TRADE, F.col(f"newest.{FIRST}").alias("changed_to_"), F.lit(True).alias("changed_"))


def looked_up(spark: SparkSession, path: str, polled: DataFrame) -> DataFrame:
    """Every trade of the index or of ``polled`` (trade name, ``polled_``) with its first poll ``was_``.

    The caller filters; trades that are not polled have a null poll.
    """
    version, _, base = _base(spark, path)
    changes = _changes(spark, path, version)
    side = polled.select(TRADE, POLL)
    if changes is None:
        joined = base.join(side, TRADE, "full_outer")
        return joined.select(TRADE, F.col(FIRST).alias(WAS), POLL)
    joined = base.join(side.join(changes, TRADE, "full_outer"), TRADE, "full_outer")
    was = F.when(F.col("changed_"), F.col("changed_to_")).otherwise(F.col(FIRST))
    return joined.select(TRADE, was.alias(WAS), POLL)


def add_changes(changed: DataFrame, path: str, most: int = _MOST_CHANGES) -> None:
    """Add (trade name, first poll or null) as the newest version; fold many of them into a base."""
    spark = changed.sparkSession
    base = _versions(spark, path, _BASE)[-1]
    known = [v for v, _ in _versions(spark, path, _CHANGES)]
    version = max([base[0], *known]) + 1
    rows = changed.select(TRADE, FIRST, F.lit(version).cast("bigint").alias("version"))
    rows.write.mode("overwrite").parquet(f"{path}/{_CHANGES}-{version}")
    if len([v for v in known if v > base[0]]) + 1 >= most:
        none = spark.createDataFrame([], f"{TRADE} string, {POLL} timestamp")
        now = looked_up(spark, path, none).where(f"{WAS} IS NOT NULL").withColumnRenamed(WAS, FIRST)
        write_base(now, path, version, int(base[1].split("-")[2]))
        for kind in (_BASE, _CHANGES):  # a look-up that began before may still read the base it knows
            for old, name in _versions(spark, path, kind):
                if old < (base[0] if kind == _BASE else base[0] + 1):
                    remove(spark, f"{path}/{name}")
