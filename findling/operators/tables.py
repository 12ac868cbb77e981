"""Table states as functions of older states: upserts, flags, links, get-or-create. Spark has no in-place update of files; each gives the new table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from findling.operators.inventory import running_sum


def differs(columns: list[str], a: str = "o", b: str = "n") -> Column:
    """Whether any of the columns differs, nulls being equal to each other."""
    return ~F.struct(*(F.col(f"{a}.{c}") for c in columns)).eqNullSafe(F.struct(*(F.col(f"{b}.{c}") for c in columns)))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], columns: list[str] | None = None, keep_old_if_null: bool = False) -> DataFrame:
    """Old rows with the new rows' columns, and the new rows. keep_old_if_null: a null never overwrites."""
    columns = columns or [c for c in new.columns if c not in keys]
    n = new.select(*keys, *(F.col(c).alias(f"_n_{c}") for c in columns), F.lit(True).alias("_new"))
    x = old.join(n, keys, "full_outer")
    value = lambda c: F.coalesce(F.col(f"_n_{c}"), F.col(c)) if keep_old_if_null else F.when(F.col("_new"), F.col(f"_n_{c}")).otherwise(F.col(c))
    return x.select(*(value(c).alias(c) if c in columns else F.col(c) for c in old.columns))


def marked(rows: DataFrame, delta: DataFrame, keys: list[str], flag: str, value: bool = True) -> DataFrame:
    """Sets a flag where the keys are in delta (with a version column among the keys: only if it is still the same)."""
    x = rows.join(delta.select(*keys).distinct().withColumn("_hit", F.lit(True)), keys, "left")
    return x.withColumn(flag, F.when(F.col("_hit"), F.lit(value)).otherwise(F.col(flag))).drop("_hit").select(*rows.columns)


def first_true_times(old: DataFrame, new: DataFrame, key: str, flag: str, stamp: str, now: Column) -> DataFrame:
    """New rows whose stamp is set where the flag went from false to true."""
    o = old.select(key, F.col(flag).alias("_was"))
    turned = ~F.coalesce("_was", F.lit(False)) & F.coalesce(F.col(flag), F.lit(False))
    return new.join(o, key, "left").withColumn(stamp, F.when(turned, now).otherwise(F.col(stamp))).select(*new.columns)


def changed(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Keys whose watched columns changed or that are new."""
    x = new.alias("n").join(old.alias("o"), F.col("n." + key) == F.col("o." + key), "left")
    return x.where(F.col("o." + key).isNull() | differs(columns)).select(F.col("n." + key).alias(key))


def versioned(old: DataFrame, new: DataFrame, key: str, digest: str = "digest", version: str = "version") -> DataFrame:
    """(key, digest, version, embedded): the version goes up and the embedding is void where the digest changed."""
    x = new.select(key, digest).alias("n").join(old.alias("o"), key, "left")
    other = ~F.col(f"o.{digest}").eqNullSafe(F.col(f"n.{digest}"))
    known = F.col(f"o.{version}").isNotNull()
    return x.select(key, F.col(f"n.{digest}").alias(digest), F.when(~known, F.lit(1)).otherwise(F.col(f"o.{version}") + other.cast("int")).cast("long").alias(version), (known & ~other & F.coalesce(F.col("o.embedded"), F.lit(False))).alias("embedded"))


def get_or_create(table: DataFrame, names: DataFrame, key: str, name: str) -> DataFrame:
    """(name, key, created) of every wanted name: an existing row by lower-cased name (the smallest key), else a new key counted on from the largest."""
    known = table.groupBy(F.lower(F.trim(name)).alias("_k")).agg(F.min(key).alias("_id"))
    wanted = names.where(F.trim(name) != "").groupBy(F.lower(F.trim(name)).alias("_k")).agg(F.min(F.trim(name)).alias(name)).join(known, "_k", "left")
    top = table.agg(F.coalesce(F.max(key), F.lit(0)).alias("_top"))
    fresh = running_sum(wanted.where("_id is null"), ["_k"], F.lit(1), "_at").crossJoin(F.broadcast(top))
    return wanted.where("_id is not null").select(name, F.col("_id").cast("long").alias(key), F.lit(False).alias("created")).union(fresh.select(name, (F.col("_top") + F.col("_at")).cast("long"), F.lit(True)))


def reconciled(existing: DataFrame, desired: DataFrame, keys: list[str], authoritative: bool = True) -> DataFrame:
    """Links with what to do: add, keep, or (only if the desired set is authoritative) delete."""
    d = desired.select(*keys).distinct().withColumn("_d", F.lit(True))
    e = existing.select(*keys).distinct().withColumn("_e", F.lit(True))
    action = F.when(F.col("_e").isNull(), "add").when(F.col("_d").isNotNull() | F.lit(not authoritative), "keep").otherwise("delete")
    return e.join(d, keys, "full_outer").select(*keys, action.alias("action"))


def by_precedence(rows: DataFrame, table: DataFrame, rules: list[list[str]], key: str) -> DataFrame:
    """Adds the key of the first rule (a list of equal columns) that finds a row; one equi-join for each rule, never a disjunction."""
    out = rows
    for i, columns in enumerate(rules):
        found = table.where(reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in columns))).groupBy(*columns).agg(F.min(key).alias(f"_k{i}"))
        out = out.join(found, columns, "left")
    return out.withColumn(key, F.coalesce(*(f"_k{i}" for i in range(len(rules))))).drop(*(f"_k{i}" for i in range(len(rules))))


def unknown(rows: DataFrame, table: DataFrame, rules: list[list[str]]) -> DataFrame:
    """Rows that no rule finds in the table."""
    for columns in rules:
        rows = rows.join(table.select(*columns).dropna().distinct(), columns, "left_anti")
    return rows


def fill_only(old: str, new: str) -> Column:
    return F.coalesce(F.nullif(F.trim(F.col(old)), F.lit("")), F.col(new))


def fitting(rows: DataFrame, schema: list[str]) -> DataFrame:
    """The columns that the target has; missing ones are null, unknown ones dropped."""
    have = set(rows.columns)
    return rows.select(*(F.col(c) if c in have else F.lit(None).alias(c) for c in schema))


def latest(events: DataFrame, keys: list[str], at: str, value: str) -> DataFrame:
    """The last value of each key in a log of changes."""
    return events.groupBy(*keys).agg(F.max_by(value, F.struct(at, value)).alias(value))


def remapped(rows: DataFrame, mapping: DataFrame, column: str) -> DataFrame:
    """Ids translated by a map (old_id, new_id); unmapped ones stay."""
    m = mapping.select(F.col("old_id").alias(column), F.col("new_id").alias("_new"))
    return rows.join(m, column, "left").withColumn(column, F.coalesce("_new", column)).drop("_new").select(*rows.columns)


def case_collisions(paths: DataFrame, column: str) -> DataFrame:
    """Lower-cased paths that stand for several."""
    return paths.groupBy(F.lower(column).alias("path_key")).agg(F.countDistinct(column).alias("spellings")).where("spellings > 1")
