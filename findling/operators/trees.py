"""Hierarchies: root paths, tree similarity, depth confidence, closure, checks, tree hashes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from findling.sources.scratch import cut

ROOT = "unbekannt"


def root_paths(nodes: DataFrame, name: str = "name", parent: str = "parent") -> DataFrame:
    """(name, path): the path from the node to its root; a cycle ends where it closes. Each round joins every open path with the one that begins where it ends, so that a tree of depth d takes log2(d) rounds; a round is written, since a plan joined with itself doubles."""
    paths = nodes.select(F.col(name).alias("name"), F.array(name).alias("path"), F.col(parent).alias("up"))
    while not paths.where("up is not null").isEmpty():
        x = paths.join(paths.select(F.col("name").alias("_n"), F.col("path").alias("_path"), F.col("up").alias("_up")), F.col("up") == F.col("_n"), "left")
        longer = F.concat("path", F.coalesce("_path", F.array("up")))
        x = x.select("name", F.when(F.col("up").isNull(), F.col("path")).otherwise(F.array_distinct(longer)).alias("path"), F.col("_up"), F.size(longer).alias("_size"))
        paths = cut(x.select("name", "path", F.when(F.size("path") == F.col("_size"), F.col("_up")).alias("up")))
    return paths.select("name", "path")


def shared_edges(path1: Column, path2: Column) -> Column:
    """How many edges two paths share from the root on."""
    a, b = F.reverse(path1), F.reverse(path2)
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    first = F.array_position(same, False)
    nodes = F.when(first == 0, F.least(F.size(a), F.size(b))).otherwise(first - 1)
    return F.greatest(F.lit(0), nodes - 1)


def tree_similarity(name1: Column, path1: Column, name2: Column, path2: Column, root: str = ROOT) -> Column:
    """Shared edges from the root by the union of edges; null if either is the root; 1 for equal names or no edges at all."""
    shared = shared_edges(path1, path2)
    edges = F.greatest(F.size(path1) - 1, F.lit(0)) + F.greatest(F.size(path2) - 1, F.lit(0)) - shared
    at_root = (F.lower(name1) == root.lower()) | (F.lower(name2) == root.lower())
    return F.when(at_root, F.lit(None)).when((name1 == name2) | (edges <= 0), F.lit(1.0)).otherwise(shared / edges)


def similarity_table(paths: DataFrame, root: str = ROOT) -> DataFrame:
    """(a, b, similarity) of all nodes: a dictionary's square, some ten thousand rows, computed once."""
    x, y = (paths.select(F.col("name").alias(n), F.col("path").alias(f"p{n}")) for n in "ab")
    return x.crossJoin(F.broadcast(y)).select("a", "b", tree_similarity(F.col("a"), F.col("pa"), F.col("b"), F.col("pb"), root).alias("similarity"))


def depth_confidence(paths: DataFrame, root: str = ROOT) -> DataFrame:
    """(name, confidence): depth by the deepest node's."""
    deep = paths.agg(F.max(F.size("path") - 1).alias("m"))
    depth = F.size("path") - 1
    return paths.crossJoin(F.broadcast(deep)).select("name", F.when((F.lower("name") == root.lower()) | (F.col("m") <= 0), F.lit(0.0)).otherwise(depth / F.col("m")).alias("confidence"))


def ancestors(starts: DataFrame, nodes: DataFrame, name: str = "name", parent: str = "parent") -> DataFrame:
    """(name): the nodes and everything above them, each once."""
    first = starts.select(F.col(starts.columns[0]).alias("name")).distinct()
    return first.union(root_paths(nodes, name, parent).join(first, "name").select(F.explode("path").alias("name"))).distinct()


def tree_faults(nodes: DataFrame, name: str = "name", parent: str = "parent") -> DataFrame:
    """(name, fault): parents that do not exist, and nodes that no root reaches."""
    missing = nodes.join(nodes.select(F.col(name).alias("_n")), F.col(parent) == F.col("_n"), "left_anti").where(F.col(parent).isNotNull()).select(F.col(name).alias("name"), F.lit("no parent").alias("fault"))
    roots = nodes.where(F.col(parent).isNull()).select(F.col(name).alias("_r"))
    reached = root_paths(nodes, name, parent).join(roots, F.element_at("path", -1) == F.col("_r"), "left_semi").select("name")
    return missing.union(nodes.select(F.col(name).alias("name")).join(reached, "name", "left_anti").join(missing, "name", "left_anti").select("name", F.lit("not reached").alias("fault")))


def tree_hashes(entries: DataFrame, path: str = "path", digest: str = "digest") -> DataFrame:
    """(path, digest, entries) for every file and directory: a directory's digest is that of its sorted entries' names and digests, from the deepest level up."""
    files = entries.select(F.col(path).alias("path"), F.col(digest).alias("digest"), F.lit(1).cast("long").alias("entries"))
    files = files.withColumn("depth", F.size(F.split("path", "/")))
    deepest = files.agg(F.max("depth")).first()[0] or 0
    done = [files]
    level = files.limit(0)
    for depth in range(deepest, 0, -1):
        level = files.where(F.col("depth") == depth).union(level)
        parent = F.array_join(F.slice(F.split("path", "/"), 1, F.lit(depth - 1)), "/") if depth > 1 else F.lit("")
        named = level.select(parent.alias("path"), F.element_at(F.split("path", "/"), -1).alias("name"), "digest", "entries")
        listing = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("name", "digest"))), lambda e: F.concat_ws(":", e["name"], e["digest"])), "\n")
        level = named.groupBy("path").agg(F.sha2(listing, 256).alias("digest"), F.sum("entries").alias("entries")).withColumn("depth", F.lit(depth - 1))
        done.append(level)
    return reduce(DataFrame.union, done).select("path", "digest", "entries")
