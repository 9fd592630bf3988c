"""Changes to row tables as functions of whole tables: what a statement would leave behind."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def insert_missing(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """``table`` and those ``rows`` whose key it lacks; of rows with equal keys the least is taken (by its JSON, so that any columns will do)."""
    own = F.struct(*rows.columns)
    one = rows.groupBy(*keys).agg(F.min_by(own, F.to_json(own)).alias("__row")).select("__row.*")
    return table.unionByName(one.join(table.select(*keys), keys, "left_anti").select(*rows.columns))


def upsert(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``rows`` replace those of equal key."""
    return table.join(rows.select(*keys).distinct(), keys, "left_anti").unionByName(rows)


def update_from(table: DataFrame, values: DataFrame, key: str, column: str) -> DataFrame:
    """``column`` set where ``values`` (one row per key) has the key, even to null."""
    v = values.select(F.col(key).alias("__key"), F.col(column).alias("__new"))
    joined = table.join(v, F.col(key) == F.col("__key"), "left")
    return joined.withColumn(column, F.when(F.col("__key").isNotNull(), F.col("__new")).otherwise(F.col(column))).drop("__key", "__new")


def delete_using(table: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return table.join(keys.select(*on).distinct(), on, "left_anti")


def compare_and_set(table: DataFrame, key: Column, column: str, allowed: list[str], new: str) -> tuple[DataFrame, int]:
    """``column`` set to ``new`` on rows that match and are in an allowed state; how many. 0 says that the race was lost."""
    hit = key & F.col(column).isin(allowed)
    return table.withColumn(column, F.when(hit, new).otherwise(F.col(column))), table.where(hit).count()


def merged_map(old: Column, new: Column) -> Column:
    """Keys of ``new`` win; null counts as empty."""
    none = F.create_map().cast("map<string,string>")
    a, b = F.coalesce(old, none), F.coalesce(new, none)
    return F.map_concat(F.map_filter(a, lambda k, _: ~F.array_contains(F.map_keys(b), k)), b)


def purge(table: DataFrame, expires: str, consumed: str, now: Column) -> DataFrame:
    """Rows that are neither consumed nor expired."""
    return table.where(F.col(consumed).isNull() & (F.col(expires).isNull() | (F.col(expires) > now)))


def released(table: DataFrame, ready: Column, order: list, slots: int) -> DataFrame:
    """The next ``slots`` rows to release."""
    return table.where(ready).orderBy(*order).limit(slots)


def cascade(root: DataFrame, key: str, children: dict[str, tuple[DataFrame, str]]) -> dict[str, DataFrame]:
    """What is left of each child table when the rows of ``root`` go."""
    keys = root.select(key).distinct()
    return {name: df.join(keys.withColumnRenamed(key, column), column, "left_anti") for name, (df, column) in children.items()}
