"""What the operators of this subpackage share: tables, lineage cuts, connected components."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress
from functools import wraps

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where it is unset in local mode, as in tests. A cluster must name one."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    if not spark.sparkContext.getCheckpointDir():
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        own = tempfile.TemporaryDirectory(prefix="findling-")
        atexit.register(own.cleanup)
        spark.sparkContext.setCheckpointDir(f"file://{own.name}")
    return spark.sparkContext.getCheckpointDir().rstrip("/")


_scopes = threading.local()  #: each thread's open scopes: the tables cut in them


def cut(df: DataFrame) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: a lineage cut that outlives executors and whose size Spark knows when it plans joins."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/findling-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    if scopes := getattr(_scopes, "open", None):
        scopes[-1].append(path)
    return spark.read.schema(schema).parquet(path)


def tidied(f: Callable[[], DataFrame]) -> DataFrame:
    """f's result, cut, without the tables that f has cut on the way."""
    if not hasattr(_scopes, "open"):
        _scopes.open = []
    _scopes.open.append([])
    try:
        out = f()
    finally:
        own = _scopes.open.pop()
    out = cut(out)
    jvm, conf = out.sparkSession._jvm, out.sparkSession._jsparkSession.sessionState().newHadoopConf()
    for path in own:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)
    return out


def tidy(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    @wraps(f)
    def run(*args, **named) -> DataFrame:
        return tidied(lambda: f(*args, **named))

    return run


def releasing(f: Callable) -> Callable:
    """A task's generator that gives the worker's freed memory back, for workers are kept for later tasks: large blocks are mapped apart, small ones trimmed at the end."""

    @wraps(f)
    def run(*args):
        pa.set_memory_pool(pa.system_memory_pool())
        libc = None
        with suppress(OSError, AttributeError):
            libc = ctypes.CDLL("libc.so.6")
            libc.mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD
        try:
            yield from f(*args)
        finally:
            with suppress(AttributeError):
                libc.malloc_trim(0)

    return run


@contextmanager
def small_batches(spark: SparkSession, rows: int = 512, most: str = "4m") -> Iterator[None]:
    """Arrow batches of at most so many rows and bytes in the jobs run within: whole texts pass through an executor's memory outside the heap, twice for each task."""
    names = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch")
    before = [spark.conf.get(name, None) for name in names]
    for name, value in zip(names, (str(rows), most), strict=True):
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in zip(names, before, strict=True):
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def sized(df: DataFrame, rows: int = 500_000) -> DataFrame:
    """df marked for a broadcast if it has so many short rows at most; beyond that the join shuffles."""
    return F.broadcast(df) if df.count() <= rows else df


@tidy
def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components by alternating large-star and small-star steps.

    edges: pairs of any orderable type; loops and repeats are allowed. Returns (node, root), root being the
    smallest node of the component, one row for each node that some pair names. No pairs: no rows. Every step
    moves a node's neighbours to its smallest one with a grouped minimum and a join, so that no task holds a
    component, and a hub with many neighbours is an ordinary skewed join.
    """
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    now = cut(pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    nodes = now.select(F.col("u").alias("node")).union(now.select("v")).distinct()
    seal = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003)).first()
    mark = seal(now)
    while mark[0]:
        both = now.union(now.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = cut(large.union(low.where("m < u").select("u", F.col("m").alias("v"))).distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = cut(small.union(least.select("u", F.col("m").alias("v"))).distinct())
        before, mark = mark, seal(now)
        if mark == before:
            break
    roots = now.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node")
    return nodes.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
