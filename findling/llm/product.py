"""Embedding near-duplicates by product quantisation.

A sample of at most `sample` vectors (a parameter, the smallest by a hash of their bytes) gives the coarse
centroids, one for `PER_LIST` vectors, and the codebooks of the residuals' subspaces; every vector is indexed. A vector
is kept in the inverted list of its nearest centroid with its residual's code and the code's error. A query probes the
lists whose bisecting plane with its own list it is within a reach of, and those that a pair of sampled vectors at a
cosine of at least the threshold less `MARGIN` links with its own list. The reach is found on the table itself: the
links of `ASKED` vectors with all rows say how far apart the two lists of a link lie, and the reach is such that all but
`LOST` of them are met from either side. Of these lists two bounds leave out what cannot hold a link: the
angle of a link is at most acos(threshold), so that it reaches a list only if the query's angle to the centroid lies
within that much of the angles of the list's vectors, and only if the plane is no farther than a link. In a list, table
lookups give the asymmetric distance to each code; what that distance less the code's error cannot exclude is compared
exactly, in double precision. Up to `sample` vectors no link is lost. A link that one side finds counts at both ends: a
block adds it to the other end where that side does not ask back.

Equal vectors are one class with a count. Near lists are packed into blocks of about `block` vectors, which a query
reaches once, and a crowded list is dealt out over several, so that it is many tasks; a block returns a count for
each query and a spanning forest of the links that it found, never its pairs.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components link with nothing and are
their own component; vectors of different lengths are not compared; repeated rows link with each other; null ids
are counted but name no component that has another id; an empty table gives no rows; labels and extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from findling.llm.shared import components, cut, table, tidy

SAMPLE, MOST_LISTS, PER_LIST, BLOCK, SUBSPACES, CODES = 16_384, 4_096, 64, 4096, 8, 256
REACH, MARGIN = 0.15, 0.04  #: the least reach; what the sample's pairs may lie below the threshold
ASKED, LOST = 512, 0.001  #: vectors whose links with all rows calibrate the reach, and the part of them that may be missed
SLACK = 1e-6  #: of angles and distances, for rounding


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.concatenate([(x[i : i + 4096] @ c.T - 0.5 * (c * c).sum(1)).argmax(1) for i in range(0, len(x), 4096)])


def kmeans(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    c = x[np.unique(np.linspace(0, len(x) - 1, min(k, len(x))).astype(int))].copy()
    for _ in range(rounds):
        own = nearest(x, c)
        order, n = np.argsort(own, kind="stable"), np.bincount(own, minlength=len(c))
        some = np.flatnonzero(n)
        c[some] = np.add.reduceat(x[order], (np.cumsum(n) - n)[some]) / n[some, None]
    return c


class Index:
    """Coarse centroids and codebooks of unit vectors."""

    def __init__(self, sample: np.ndarray, lists: int, threshold: float = 0.9, subspaces: int = SUBSPACES, codes: int = CODES):
        self.coarse = kmeans(sample, lists)
        norm = np.linalg.norm(self.coarse, axis=1, keepdims=True)
        self.coarse = np.divide(self.coarse, norm, out=self.coarse, where=norm > 0)
        self.parts = np.array_split(np.arange(sample.shape[1]), min(subspaces, sample.shape[1]))
        residuals = sample - self.coarse[nearest(sample, self.coarse)]
        self.books = [kmeans(residuals[:, p], codes) for p in self.parts]
        self.apart = np.sqrt(np.maximum(2 - 2 * self.coarse @ self.coarse.T, 1e-12))
        self.threshold, self.reach, own = threshold, REACH, nearest(sample, self.coarse)
        self.linked = np.eye(len(self.coarse), dtype=bool)  #: lists that the sample's near pairs link
        for i in range(0, len(sample), 1024):
            row, col = np.nonzero(sample[i : i + 1024] @ sample.T >= threshold - MARGIN)
            self.linked[own[i + row], own[col]] = True

    def add(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Lists, codes and the errors of the codes."""
        own = nearest(x, self.coarse)
        residual = x - self.coarse[own]
        codes = np.stack([nearest(residual[:, p], b) for p, b in zip(self.parts, self.books, strict=True)], axis=1).astype(np.uint8)
        left = np.concatenate([residual[:, p] - b[codes[:, j]] for j, (p, b) in enumerate(zip(self.parts, self.books, strict=True))], axis=1)
        return own, codes, np.linalg.norm(left, axis=1)

    def angles(self, x: np.ndarray) -> np.ndarray:
        """From vectors to all centroids."""
        return np.arccos(np.clip(x @ self.coarse.T, -1, 1))

    def probe(self, x: np.ndarray, least: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Which lists are searched for links of each row. least, most: the angles of each list's vectors to its centroid."""
        near = x @ self.coarse.T
        angle, own, link = np.arccos(np.clip(near, -1, 1)), nearest(x, self.coarse), np.arccos(np.clip(self.threshold, -1, 1)) + SLACK
        plane = (near[np.arange(len(x)), own][:, None] - near) / self.apart[own]
        if (self.coarse * self.coarse).sum(1).min() < 0.5:  # a zero centroid: no plane through the origin
            plane[:] = 0
        step = np.sin(link) if link < np.pi / 2 else 2.0
        return (angle >= least - link) & (angle <= most + link) & (plane <= step + SLACK) & ((plane <= self.reach) | self.linked[own])

    def probes(self, x: np.ndarray, own: np.ndarray, to: np.ndarray, least: np.ndarray, most: np.ndarray) -> np.ndarray:
        """What probe says of one list each: whether rows x of the lists own search the lists to."""
        out = own == to
        at = np.flatnonzero(~out)
        x, own, to = x[at], own[at], to[at]
        here, there = ((x * self.coarse[c]).sum(1) for c in (own, to))
        angle, link = np.arccos(np.clip(there, -1, 1)), np.arccos(np.clip(self.threshold, -1, 1)) + SLACK
        plane = np.zeros(len(x)) if (self.coarse * self.coarse).sum(1).min() < 0.5 else (here - there) / self.apart[own, to]
        step = np.sin(link) if link < np.pi / 2 else 2.0
        out[at] = (angle >= least[to] - link) & (angle <= most[to] + link) & (plane <= step + SLACK) & ((plane <= self.reach) | self.linked[own, to])
        return out

    def missed(self, asks: np.ndarray, x: np.ndarray, lists: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For the links of asks with the vectors x of the lists named: the asking row, and the reach in thousandths that either side's probing needs to meet the other, 0 where it needs none."""
        row, col = np.nonzero(asks @ x.T >= self.threshold)
        near, far, own = asks @ self.coarse.T, x @ self.coarse.T, nearest(asks, self.coarse)[row]
        other = lists[col]
        ahead = np.where(self.linked[own, other], 0, (near[row, own] - near[row, other]) / self.apart[own, other])
        back = np.where(self.linked[other, own], 0, (far[col, other] - far[col, own]) / self.apart[own, other])
        need = np.where(own == other, 0, np.maximum(np.minimum(ahead, back), 0))
        return row, np.ceil(need * 1000).astype(np.int64)

    def tables(self, x: np.ndarray) -> np.ndarray:
        """Inner products of queries with all codewords of all subspaces, which are the same for every list."""
        return np.concatenate([x[:, p] @ b.T for p, b in zip(self.parts, self.books, strict=True)], axis=1)

    def distances(self, x: np.ndarray, at: int, codes: np.ndarray, tables: np.ndarray | None = None) -> np.ndarray:
        """From queries to the codes of list `at`: |q - c - r|^2 = |q - c|^2 + |r|^2 + 2 c r - 2 q r, the last looked up for each subspace."""
        tables = self.tables(x) if tables is None else tables
        starts = np.cumsum([0, *(len(b) for b in self.books)])[:-1]
        residual = np.concatenate([b[codes[:, j]] for j, b in enumerate(self.books)], axis=1)
        own = x - self.coarse[at]
        shared = (own * own).sum(1)[:, None] + (residual * residual).sum(1) + 2 * residual @ self.coarse[at]
        told = np.take(tables, (starts + codes).ravel(), axis=1).reshape(len(x), len(codes), -1).sum(2)
        return np.sqrt(np.maximum(shared - 2 * told, 0))


def packed(sizes: np.ndarray, index: Index, block: int) -> tuple[np.ndarray, np.ndarray]:
    """The first block of each list and how many it is dealt over: crowded lists have blocks of their own, others share one with near lists."""
    first, parts, at, filled, left = np.zeros(len(sizes), int), np.ones(len(sizes), int), 0, 0, sizes > 0
    here = 0
    while left.any():
        here = int(np.where(left, index.apart[here], np.inf).argmin())
        left[here] = False
        if sizes[here] > block:
            at += filled > 0
            parts[here] = -(-sizes[here] // block)
            first[here], filled = at, 0
            at += parts[here]
        else:
            if filled + sizes[here] > block:
                at, filled = at + 1, 0
            first[here] = at
            filled += sizes[here]
    return first, parts


def spanning(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest node of each node's component."""
    root = np.arange(n)
    while len(i):
        low = np.minimum(root[i], root[j])
        before = root.copy()
        for end in (i, j):
            np.minimum.at(root, end, low)
            np.minimum.at(root, before[end], low)
        root = root[root]
        if (root == before).all():
            break
    return root


def _unit(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Rows of one length as doubles, and their unit vectors."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)
    largest = np.abs(x).max(1, keepdims=True) if x.size else np.ones((len(x), 1))
    x = x / largest
    return x, x / np.linalg.norm(x, axis=1, keepdims=True)


def classes(rows: DataFrame) -> DataFrame:
    """(vec_id, digest, embedding) of each row; digest and embedding are null where the vector links with nothing."""
    kind, vector = (rows.schema[c].dataType.simpleString() for c in ("vec_id", "embedding"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests = []
            for v in batch.column(1):
                x = np.array(v.values.to_numpy(zero_copy_only=False), np.float64) + 0.0 if v.is_valid else np.zeros(0)
                good = len(x) and not v.values.null_count and np.isfinite(x).all() and x.any()
                digests.append(hashlib.blake2b(x.tobytes(), digest_size=16).digest() if good else None)
            d = pa.array(digests, pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), d, pa.compute.if_else(d.is_valid(), batch.column(1), pa.scalar(None, batch.column(1).type))], ["vec_id", "digest", "embedding"])

    return rows.mapInArrow(run, f"vec_id {kind}, digest binary, embedding {vector}")


@tidy
def near_vectors(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", threshold: float = 0.9, sample: int = SAMPLE, lists: int | None = None, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row. lists: how many (by default one for 64 vectors, at most 4096)."""
    spark = rows.sparkSession
    each = cut(classes(rows.select(F.col(key).alias("vec_id"), F.col(vector).alias("embedding"))))
    found = cut(each.where("digest is not null").groupBy("digest").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("copies"), F.first("embedding").alias("embedding")))
    out = None
    for dims, n in sorted(tuple(r) for r in found.groupBy(F.size("embedding").alias("d")).count().collect()):
        part = _links(spark, found.where(F.size("embedding") == dims), n, threshold, sample, lists or min(MOST_LISTS, max(1, n // PER_LIST)), block)
        out = part if out is None else out.union(part)
    if out is None:
        return each.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").cast("long").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    out = cut(out)
    links = out.where("b is null").groupBy(F.col("a").alias("digest")).agg(F.sum("n").alias("n"))
    roots = components(out.where("b is not null").select("a", "b")).withColumnRenamed("node", "digest")
    named = found.select("digest", "vec_id", "copies").join(links, "digest", "left").join(roots, "digest", "left").withColumn("root", F.coalesce("root", "digest"))
    named = cut(named)
    named = named.join(named.groupBy("root").agg(F.min("vec_id").alias("component_id")), "root")
    named = named.select("digest", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    component = F.when(F.col("digest").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).cast("long")
    return each.select("vec_id", "digest").join(named, "digest", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def _calibrated(spark: SparkSession, index: Index, members: DataFrame, asks: np.ndarray) -> Index:
    """index with the reach at which the links of the asking vectors with all members are found but for LOST of them, of all links and of each vector's on average."""
    sent = spark.sparkContext.broadcast((index, asks))

    def needs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], int] = {}
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                part = batch.slice(i, 1024)
                pairs, n = np.unique(np.stack(sent.value[0].missed(sent.value[1], _unit(part.column(0))[1], part.column(1).to_numpy())), axis=1, return_counts=True)
                for q, need, k in zip(*pairs.tolist(), n.tolist(), strict=True):
                    held[q, need] = held.get((q, need), 0) + k
        yield pa.RecordBatch.from_arrays([pa.array([q for q, _ in held], pa.int32()), pa.array([r for _, r in held], pa.int32()), pa.array(list(held.values()), pa.int64())], ["q", "need", "n"])

    found = members.select("embedding", "list").mapInArrow(needs, "q int, need int, n long").groupBy("q", "need").agg(F.sum("n").alias("n")).collect()  # len(asks) * 1000 rows at most
    if found:
        q, need, n = np.array([tuple(r) for r in found], np.int64).T
        each = n / np.bincount(q, n, len(asks))[q]
        for weights in (n / n.sum(), each / each.sum()):
            order = np.argsort(-need, kind="stable")
            over = np.searchsorted(np.cumsum(weights[order]), LOST, "right")
            index.reach = max(index.reach, (need[order[min(over, len(order) - 1)]] + 1) / 1000)
    return index


def _links(spark: SparkSession, found: DataFrame, n: int, threshold: float, sample: int, lists: int, block: int) -> DataFrame:
    """(a, null, links to other classes) and (a, b, 0) for the edges of spanning forests."""
    few = found.select("digest", "embedding").orderBy(F.xxhash64("digest"), "digest").limit(sample).select("embedding").toArrow()
    _, unit = _unit(few.column(0).combine_chunks())
    index = spark.sparkContext.broadcast(Index(unit, lists, threshold))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 2048):
                part = batch.slice(i, 2048)
                unit = _unit(part.column(1))[1]
                own, codes, errors = index.value.add(unit)
                angles = index.value.angles(unit)[np.arange(len(own)), own]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.array(own, pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(errors), pa.array(angles)], ["digest", "embedding", "copies", "list", "code", "error", "angle"])

    vector = found.schema["embedding"].dataType.simpleString()
    members = cut(found.select("digest", "embedding", "copies").mapInArrow(place, f"digest binary, embedding {vector}, copies long, list int, code binary, error double, angle double"))
    index = spark.sparkContext.broadcast(_calibrated(spark, index.value, members, unit[: ASKED]))
    # one row for each list, of which there are 4096 at most
    size, least, most = (np.zeros(len(index.value.coarse)) for _ in range(3))
    for at, *about in members.groupBy("list").agg(F.count("*"), F.min("angle"), F.max("angle")).collect():
        size[at], least[at], most[at] = about
    least[size == 0] = np.inf
    first, parts = packed(size.astype(int), index.value, block)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                part = batch.slice(i, 1024)
                wanted = index.value.probe(_unit(part.column(1))[1], least, most)
                reached = np.zeros((len(wanted), total), bool)
                for to in np.flatnonzero(wanted.any(0)):
                    reached[:, first[to] : first[to] + parts[to]] |= wanted[:, to, None]
                for lo in range(0, total, 64):
                    at, to = np.nonzero(reached[:, lo : lo + 64])
                    if len(at):
                        yield pa.RecordBatch.from_arrays([*(c.take(pa.array(at)) for c in part.columns), pa.array(to + lo, pa.int32())], ["digest", "embedding", "copies", "at"])

    total = int((first + parts).max())
    queries = found.select("digest", "embedding", "copies").mapInArrow(probe, f"digest binary, embedding {vector}, copies long, at int")
    dealt = lambda m: F.pmod(F.xxhash64("digest"), m)
    where = F.broadcast(spark.createDataFrame([(i, int(f), int(p)) for i, (f, p) in enumerate(zip(first, parts, strict=True))], "list int, first int, parts int"))
    asked = F.broadcast(cut(queries.groupBy("at").agg(F.ceil(F.count("*") / (4 * block)).cast("int").alias("asks"))))
    none = lambda kind: F.lit(None).cast(kind)
    m = members.join(where, "list").withColumn("at", (F.col("first") + dealt(F.col("parts"))).cast("int")).join(asked, "at").select("at", F.explode(F.sequence(F.lit(0), F.col("asks") - 1)).alias("ask"), "digest", "embedding", "list", "copies", "code", "error")
    q = queries.join(asked, "at").select("at", dealt(F.col("asks")).cast("int").alias("ask"), "digest", "embedding", none("int").alias("list"), "copies", none("binary").alias("code"), none("double").alias("error"))
    step = (2 - 2 * threshold) ** 0.5

    def search(group: pa.Table) -> pa.Table:
        stored = group.column("code").is_valid()
        own, asks = group.filter(stored), group.filter(pa.compute.invert(stored))
        empty = pa.table({"a": pa.array([], pa.binary()), "b": pa.array([], pa.binary()), "n": pa.array([], pa.int64())})
        if not own.num_rows or not asks.num_rows:
            return empty
        _, u = _unit(own.column("embedding").combine_chunks())
        _, v = _unit(asks.column("embedding").combine_chunks())
        codes = np.frombuffer(b"".join(own.column("code").to_pylist()), np.uint8).reshape(len(u), -1)
        errors, copies = own.column("error").to_numpy(), own.column("copies").to_numpy()
        names = {d: i for i, d in enumerate(own.column("digest").to_pylist())}
        ids = [names.setdefault(d, len(names)) for d in asks.column("digest").to_pylist()]
        ids, lists, counts, froms, tos = np.array(ids), own.column("list").to_numpy(), np.zeros(len(names), np.int64), [], []
        asking_copies, asking_lists = asks.column("copies").to_numpy(), nearest(v, index.value.coarse)
        inside = [(at, np.flatnonzero(lists == at)) for at in np.unique(lists)]
        for i in range(0, len(v), 1024):
            wanted, tables = index.value.probe(v[i : i + 1024], least, most), index.value.tables(v[i : i + 1024])
            for at, held in inside:
                asking = np.flatnonzero(wanted[:, at])
                if not len(asking):
                    continue
                far = index.value.distances(v[i + asking], at, codes[held], tables[asking])
                row, col = np.nonzero(far <= step + errors[held] + 10 * SLACK)
                for j in range(0, len(row), 65_536):
                    r, c = asking[row[j : j + 65_536]] + i, held[col[j : j + 65_536]]
                    link = (np.einsum("ij,ij->i", v[r], u[c]) >= threshold) & (ids[r] != c)
                    r, c = r[link], c[link]
                    np.add.at(counts, ids[r], copies[c])
                    back = index.value.probes(u[c], lists[c], asking_lists[r], least, most)  # whether the other side asks too, or its count is added here
                    np.add.at(counts, c[~back], asking_copies[r[~back]])
                    froms.append(ids[r])
                    tos.append(c)
        froms, tos = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (froms, tos))
        root, digests = spanning(len(names), froms, tos), list(names)
        joined, some = np.flatnonzero(root != np.arange(len(root))), np.flatnonzero(counts)
        a = [digests[i] for i in some] + [digests[i] for i in joined]
        b = [None] * len(some) + [digests[root[i]] for i in joined]
        return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary()), "n": pa.array([*counts[some], *([0] * len(joined))], pa.int64())})

    return m.union(q).groupBy("at", "ask").applyInArrow(search, "a binary, b binary, n long")


def op9_product_quantisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
