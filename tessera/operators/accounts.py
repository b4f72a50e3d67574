"""Row operations on user, conversation and message tables, as whole-table transformations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.runtime import written


def find(table: DataFrame, **keys: object) -> DataFrame:
    """The row with these column values (nulls match nothing), at most one."""
    condition = F.lit(True)
    for name, value in keys.items():
        condition = condition & (F.col(name) == F.lit(value))
    return table.filter(condition).limit(1)


#: Columns that the store sets itself: both when a row is made, the second when it changes.
CREATED, UPDATED = "created_at", "updated_at"


def stamped(rows: DataFrame, table: DataFrame, now: Column | None, *names: str) -> DataFrame:
    """``rows`` with ``now`` in those of the columns ``names`` that ``table`` has, whatever stood there."""
    return rows if now is None else rows.withColumns({n: now.cast(table.schema[n].dataType) for n in names if n in table.columns})


def resolve(conversations: DataFrame, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations with a row for each (user_id, session_id) of ``asked``, and that row's id for each of them.

    A blank or null session gets an id of its own; new rows are numbered on from the largest id, by user and session.
    """
    blank = F.trim(F.coalesce("session_id", F.lit(""))) == ""
    wanted = asked.select("user_id", F.when(blank, F.uuid()).otherwise(F.col("session_id")).alias("session_id"))
    wanted = written(asked.sparkSession, wanted, "sessions")
    new = wanted.distinct().join(conversations, ["user_id", "session_id"], "left_anti")
    last = conversations.agg(F.coalesce(F.max("id"), F.lit(0)).alias("last"))
    # Ranks inside a share of the users, and the shares before it: no task numbers all new rows.
    share = F.pmod(F.xxhash64("user_id"), F.lit(64))
    ranked = new.withColumn("share", share).withColumn("n", F.row_number().over(Window.partitionBy("share").orderBy("user_id", "session_id")))
    sizes = ranked.groupBy("share").agg(F.count(F.lit(1)).alias("size"))
    before = sizes.withColumn("before", F.sum("size").over(Window.orderBy("share")) - F.col("size")).drop("size")  # 64 rows
    made = ranked.join(F.broadcast(before), "share").crossJoin(F.broadcast(last))
    made = written(asked.sparkSession, made.select((F.col("last") + F.col("before") + F.col("n")).cast("long").alias("id"), "user_id", "session_id"), "conversations")
    table = conversations.unionByName(made, allowMissingColumns=True)
    return table, wanted.join(table.select("id", "user_id", "session_id"), ["user_id", "session_id"])


def insert(table: DataFrame, rows: DataFrame, unique: list[str], now: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """The table with those ``rows`` whose ``unique`` columns are new, and the rows that were refused."""
    rows = stamped(rows, table, now, CREATED, UPDATED)
    first = Window.partitionBy(*unique).orderBy(*[c for c in rows.columns if c not in unique])
    numbered = rows.withColumn("_n", F.row_number().over(first))
    known = numbered.join(table.select(*unique).distinct().withColumn("_known", F.lit(True)), unique, "left")
    fresh = known.filter("_known IS NULL AND _n = 1").select(*rows.columns)
    refused = known.filter("_known IS NOT NULL OR _n > 1").select(*rows.columns)
    return table.unionByName(fresh, allowMissingColumns=True), refused


def update(table: DataFrame, changes: DataFrame, key: str, now: Column | None = None) -> DataFrame:
    """The table with the columns of ``changes`` replaced in rows with the same key."""
    changes = stamped(changes, table, now, UPDATED)
    names = [c for c in changes.columns if c != key]
    marked = changes.select(key, F.lit(True).alias("_hit"), *[F.col(c).alias(f"_new_{c}") for c in names])
    joined = table.join(marked, key, "left")
    pick = lambda c: F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c)
    return joined.select(*[pick(c) if c in names else F.col(c) for c in table.columns])


def delete(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return table.join(keys.select(key).distinct(), key, "left_anti")


def upsert(table: DataFrame, rows: DataFrame, key: str, newest: Column) -> DataFrame:
    """Both tables together, with the newest row of each key."""
    last = Window.partitionBy(key).orderBy(newest.desc())
    return table.unionByName(rows).withColumn("_n", F.row_number().over(last)).filter("_n = 1").drop("_n")


def repeated(table: DataFrame, *unique: str) -> DataFrame:
    """Values of the unique columns that more than one row has."""
    return table.groupBy(*unique).agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")


def profile(users: DataFrame) -> DataFrame:
    """What a user may see of an account."""
    return users.select("id", "mobile", "nickname", "sex")
