"""Tables that change shard by shard: written aside, committed by a manifest, unchanged shards left alone, stale ones removed.

A store is a folder of `data/shard=.../identity=...` directories and of manifests, numbered tables of the (shard,
identity) pairs that are the store's state. A commit writes the shards whose identity is new, then the next manifest
aside, and renames it to its number, which fails where another writer has taken that number. Readers see the highest
manifest only, so that a failed or killed job leaves the state as it was; what no manifest names is removed by the next
commit. The driver handles names of directories, never rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce
from operator import and_
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from findling.sources.scratch import cut


class Folder:
    """The few file system calls that a commit needs, by Hadoop's client: any store that Spark reads."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.path = spark._jvm, path.rstrip("/")
        self.fs = self.at().getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def at(self, *names: str):
        return self.jvm.org.apache.hadoop.fs.Path("/".join([self.path, *names]))

    def names(self, *names: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.at(*names))) if self.fs.exists(self.at(*names)) else []

    def rename(self, a: str, b: str) -> bool:
        """False where b is there already."""
        return not self.fs.exists(self.at(b)) and self.fs.rename(self.at(a), self.at(b))

    def remove(self, *names: str) -> None:
        self.fs.delete(self.at(*names), True)


def atomic_write(rows: DataFrame, path: str, write: Callable[[DataFrame, str], None] | None = None) -> None:
    """Write rows as Parquet at path, replacing what is there: written aside, then renamed; a failing job leaves the old table."""
    parent, name = path.rstrip("/").rsplit("/", 1)
    there = Folder(rows.sparkSession, parent)
    aside, old = f".{name}-{uuid.uuid4().hex}", f".{name}-old-{uuid.uuid4().hex}"
    try:
        (write or (lambda df, at: df.write.parquet(at)))(rows, f"{parent}/{aside}")
        had = there.fs.exists(there.at(name))
        if had:
            there.rename(name, old)
        if not there.rename(aside, name):
            if had:
                there.rename(old, name)
            raise FileExistsError(path)
        if had:
            there.remove(old)
    finally:
        there.remove(aside)


def identities(rows: DataFrame, shard: Column, *identity: str) -> DataFrame:
    """(shard, identity): the digest of the named columns of all rows of each shard, whatever their order; nulls differ from ''. A shard's digests are one task's, so shards are to be bounded."""
    each = F.sha2(F.to_json(F.struct(*identity), {"ignoreNullFields": "false"}), 256)
    grouped = rows.select(shard.cast("string").alias("shard"), each.alias("d")).groupBy("shard")
    return grouped.agg(F.sha2(F.array_join(F.array_sort(F.collect_list("d")), ""), 256).alias("identity"))


STATE = "shard string, identity string, version int"


class Store:
    """A sharded table at a path. shard: the shard of a row, never null; identity: the columns that say whether a row has changed."""

    def __init__(self, spark: SparkSession, path: str, shard: Column, identity: tuple[str, ...]):
        self.spark, self.path, self.shard, self.identity = spark, path.rstrip("/"), shard, identity
        self.folder = Folder(spark, path)

    def version(self) -> int:
        return max((int(n) for n in self.folder.names("manifests") if n.isdigit()), default=0)

    def manifest(self) -> DataFrame:
        """(shard, identity, version): the state, and the commit that wrote each shard."""
        now = self.version()
        return self.spark.read.schema(STATE).parquet(f"{self.path}/manifests/{now}") if now else self.spark.createDataFrame([], STATE)

    def read(self) -> DataFrame | None:
        """The rows of the state with shard and version; directories that it does not name are pruned by the join. None where nothing is stored."""
        if not self.folder.names("data"):
            return None
        held = self.spark.read.parquet(f"{self.path}/data")  # names have a letter before them, so that Spark takes them for strings
        held = held.withColumns({"shard": F.substr("shard", F.lit(2)), "identity": F.substr("identity", F.lit(2))})
        return held.join(self.manifest(), ["shard", "identity"]).drop("identity")

    def commit(self, rows: DataFrame, make: Callable[[DataFrame], DataFrame] | None = None) -> int:
        """Make rows the state; returns how many shards were written. make: turns the rows of changed shards (with shard and identity) into what is stored; those of others are not made again."""
        before, had = self.version(), self.manifest()
        wanted = cut(identities(rows, self.shard, *self.identity))
        fresh = wanted.join(had, ["shard", "identity"], "left_anti")
        n = fresh.count()
        if not n and had.join(wanted, ["shard", "identity"], "left_anti").isEmpty():
            return 0
        if n:
            some = rows.withColumn("shard", self.shard.cast("string")).join(fresh, "shard")
            some = (make(some) if make else some).withColumns({c: F.concat(F.lit(c[0]), F.col(c)) for c in ("shard", "identity")})
            some.repartition("shard").write.mode("append").partitionBy("shard", "identity").parquet(f"{self.path}/data")
        state = wanted.join(had, ["shard", "identity"], "left").select("shard", "identity", F.coalesce("version", F.lit(before + 1)).alias("version"))
        aside = f".manifest-{uuid.uuid4().hex}"
        state.write.parquet(f"{self.path}/{aside}")
        self.folder.fs.mkdirs(self.folder.at("manifests"))
        if not self.folder.rename(aside, f"manifests/{before + 1}"):
            self.folder.remove(aside)
            raise RuntimeError(f"another writer has committed {before + 1} to {self.path}")
        self.prune()
        return n

    def prune(self) -> int:
        """Remove directories that the state does not name, and older manifests; returns how many directories went."""
        there = [(unquote(s.partition("=s")[2]), i.partition("=i")[2], s, i) for s in self.folder.names("data") if s.startswith("shard=") for i in self.folder.names("data", s) if i.startswith("identity=")]
        found = self.spark.createDataFrame(there, "shard string, identity string, s string, i string").join(self.manifest(), ["shard", "identity"], "left_anti").collect()  # names of directories
        for row in found:
            self.folder.remove("data", row["s"], row["i"])
        now = self.version()
        for name in self.folder.names("manifests"):
            if name.isdigit() and int(name) < now:
                self.folder.remove("manifests", name)
        return len(found)


def refreshed(store: Store, images: DataFrame, embed: Callable[[DataFrame], DataFrame], id_: str = "file_id", vector: str = "vector") -> int:
    """Bring a store of embeddings up to the images; returns how many shards were written.

    images: (file_id, the store's identity columns, what embed reads). A stored vector is valid while all identity
    columns are the same, null-safe; only the others of changed shards go through embed, which adds the vector. Images
    that are gone leave the store.
    """

    def make(some: DataFrame) -> DataFrame:
        held = store.read()
        columns = [*images.columns, "shard", "identity", vector]
        if held is None:
            return embed(some).select(*columns)
        known = held.select(*(F.col(c).alias(f"_{c}") for c in dict.fromkeys((id_, *store.identity, vector))))
        same = reduce(and_, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in dict.fromkeys((id_, *store.identity))))
        met = some.join(known, same, "left")
        kept = met.where(F.col(f"_{vector}").isNotNull()).withColumn(vector, F.col(f"_{vector}"))
        return kept.select(*columns).union(embed(met.where(F.col(f"_{vector}").isNull()).select(*some.columns)).select(*columns))

    return store.commit(images, make)
