"""Four-byte codes of vectors: product codebooks fitted and applied in exact integer arithmetic.

Components become integers floor(scale * x), vectors are cut into four consecutive parts, and each part position has a
codebook of at most 256 entries: at first those of the smallest ids, then, in every round, the componentwise floor of
the mean of the parts that are nearest to an entry. Nearest entries are screened by a float32 matrix product: for n
components any order of summation errs by at most g |x||c|, g = (n + 2) u / (1 - (n + 2) u), u = 2^-24, so that every
entry whose interval meets that of the best is known. Those are computed again in int64, and ties go to the lower index.

Rounds pass over all vectors. A task adds up its vectors by entry and returns one row for each entry it has used; the
driver sees codebooks only (256 entries of a vector's length, for each length that occurs).

Defined cases: vectors that are null or hold null or non-finite components are dropped, and so are those with
components so large (beyond sqrt(2^61 / length) after scaling) that a squared distance could pass 2^63; vectors of
each length have codebooks of their own; a length that four does not divide is cut at floor(k * length / 4), an empty
vector has code 00000000 and error 0; with fewer than 256 vectors codebooks are smaller; ids and labels may be null
and repeat (ids: nulls last, equal ids by their integers); equal labels are one sum, nulls too, and a sum beyond a long
is null; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from findling.llm.shared import cut, sized, table, tidy

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
UNIT = 2.0**-24  #: rounding of a float32
Books = dict[int, list[np.ndarray]]  #: by length, the entries of each part


def cuts(length: int) -> list[int]:
    return [k * length // PARTS for k in range(PARTS + 1)]


def nearest(x: np.ndarray, book: np.ndarray, block: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """The index of each row's nearest entry and the squared distance to it, both exact; ties go to the lower index."""
    at, far = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    squares = (book.astype(np.float64) ** 2).sum(1)
    longest, n = np.sqrt(squares.max(initial=0)), x.shape[1]
    g = (n + 2) * UNIT / (1 - (n + 2) * UNIT)
    for i in range(0, len(x), block):
        rows = x[i : i + block]
        lengths = np.sqrt((rows.astype(np.float64) ** 2).sum(1))
        told = rows.astype(np.float32) @ book.astype(np.float32).T
        screen = squares - 2.0 * told  # the square of the row itself is the same for all entries
        error = 2 * g * lengths * longest * (1 + 1e-6) + 2.0**-48 * (longest + lengths) ** 2  # of the product; of squares and sums in double
        r, c = np.nonzero(screen <= (screen.min(1) + 2 * error)[:, None])
        exact = ((rows[r] - book[c]) ** 2).sum(1)
        first = np.flatnonzero(np.diff(r, prepend=-1))
        best = np.minimum.reduceat(exact, first)
        far[i : i + block] = best
        at[i : i + block] = np.minimum.reduceat(np.where(exact == best[r], c, len(book)), first)
    return at, far


def integers(rows: DataFrame, key: str, vector: str, label: str, scale: int = SCALE) -> DataFrame:
    """(vec_id, label, v) of the vectors that are kept."""
    most = "floor(sqrt(pow(2D, 61) / greatest(size(embedding), 1))) - 1"
    good = f"embedding is not null and forall(embedding, x -> x is not null and abs(cast(x as double)) * {scale} <= {most})"  # NaN is above all numbers
    named = rows.select(F.col(key).alias("vec_id"), F.col(label).alias("label"), F.col(vector).alias("embedding")).where(good)
    return named.select("vec_id", "label", F.expr(f"transform(embedding, x -> cast(floor(cast(x as double) * {scale}) as bigint))").alias("v"))


def by_length(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Each length, the places of its vectors and the vectors."""
    ends = column.offsets.to_numpy()
    sizes, flat = np.diff(ends), column.values.to_numpy(zero_copy_only=False)
    for d in np.unique(sizes):
        at = np.flatnonzero(sizes == d)
        yield int(d), at, flat[ends[at][:, None] + np.arange(d)]


def first_entries(kept: DataFrame, entries: int = ENTRIES) -> Books:
    """The vectors of the smallest ids. Each task keeps so many of a length, and ties of the last."""
    schema = kept.select("vec_id", "v").schema

    def smallest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for d, at, vectors in by_length(batch.column(1)):
                own = held.setdefault(d, [])
                last = own[-1][:2] if len(own) == entries else None
                own += [(*k, v.tolist()) for i, v in zip(at, vectors, strict=True) if (k := (ids[i] is None, ids[i] if ids[i] is not None else 0)) and (last is None or k <= last)]
                own.sort()
                del own[entries:]
        for own in held.values():
            yield pa.RecordBatch.from_arrays([pa.array([None if none else i for none, i, _ in own], batch_types[0]), pa.array([v for *_, v in own], pa.list_(pa.int64()))], ["vec_id", "v"])

    batch_types = [kept.limit(0).select("vec_id").toArrow().schema.field(0).type]
    few = kept.select("vec_id", "v").mapInArrow(smallest, schema)
    order = Window.partitionBy(F.size("v")).orderBy(F.col("vec_id").asc_nulls_last(), "v")
    found: dict[int, list] = {}
    for (v,) in few.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= entries).orderBy(F.size("v"), "rank").select("v").collect():
        found.setdefault(len(v), []).append(v)
    return {d: [np.array(vs, np.int64).reshape(len(vs), d)[:, a:b] for a, b in zip(cuts(d), cuts(d)[1:], strict=False)] for d, vs in found.items()}


def moved(kept: DataFrame, books: Books) -> Books:
    """The codebooks after one round."""
    sent = kept.sparkSession.sparkContext.broadcast(books)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for d, _, vectors in by_length(batch.column(0)):
                for p, (a, b, book) in enumerate(zip(cuts(d), cuts(d)[1:], sent.value[d], strict=False)):
                    count, total = sums.setdefault((d, p), (np.zeros(len(book), np.int64), np.zeros(book.shape, np.int64)))
                    own, _ = nearest(vectors[:, a:b], book)
                    order = np.argsort(own, kind="stable")
                    used, start, n = np.unique(own[order], return_index=True, return_counts=True)
                    count[used] += n
                    if b > a:
                        total[used] += np.add.reduceat(vectors[order, a:b], start)
        for (d, p), (count, total) in sums.items():
            used = np.flatnonzero(count)
            own = lambda v, kind=pa.int32(), k=len(used): pa.array([v] * k, kind)  # noqa: E731, B008
            yield pa.RecordBatch.from_arrays([own(d), own(p), pa.array(used, pa.int32()), pa.array(count[used]), pa.array(total[used].tolist(), pa.list_(pa.int64()))], ["d", "p", "e", "n", "total"])

    widest = max(b - a for d in books for a, b in zip(cuts(d), cuts(d)[1:], strict=False))
    parts = kept.select("v").mapInArrow(add, "d int, p int, e int, n long, total array<long>")
    sums = [F.sum(F.get("total", F.lit(i)).cast("decimal(38,0)")).alias(f"t{i}") for i in range(widest)]
    out = {d: [book.copy() for book in parts] for d, parts in books.items()}
    for d, p, e, n, *total in parts.groupBy("d", "p", "e").agg(F.sum("n").alias("n"), *sums).collect():  # a codebook's entries
        out[d][p][e] = [int(t) // n for t in total[: out[d][p].shape[1]]]
    sent.unpersist()
    return out


def fit(kept: DataFrame, rounds: int = ROUNDS, entries: int = ENTRIES) -> Books:
    """Codebooks of the integer vectors v of kept."""
    books = first_entries(kept, entries)
    for _ in range(rounds if books else 0):
        books = moved(kept, books)
    return books


def named(books: Books) -> dict[int, str]:
    """The digest of each length's codebooks."""
    return {d: hashlib.sha256(",".join(str(x) for book in parts for x in book.ravel().tolist()).encode()).hexdigest() for d, parts in books.items()}


def encode(kept: DataFrame, books: Books) -> DataFrame:
    """(vec_id, label, code, error, codebooks_sha256): code is four indexes in two hex digits each."""
    sent, digests = kept.sparkSession.sparkContext.broadcast(books), named(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, errors, digest = np.zeros((batch.num_rows, PARTS), np.uint8), np.zeros(batch.num_rows, np.int64), [None] * batch.num_rows
            for d, at, vectors in by_length(batch.column(2)):
                for p, (a, b, book) in enumerate(zip(cuts(d), cuts(d)[1:], sent.value[d], strict=False)):
                    codes[at, p], far = nearest(vectors[:, a:b], book)
                    errors[at] += far
                for i in at:
                    digest[i] = digests[d]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([c.tobytes().hex() for c in codes], pa.string()), pa.array(errors), pa.array(digest, pa.string())], ["vec_id", "label", "code", "error", "codebooks_sha256"])

    key, label = (kept.schema[c].dataType.simpleString() for c in ("vec_id", "label"))
    return kept.mapInArrow(run, f"vec_id {key}, label {label}, code string, error long, codebooks_sha256 string")


def decode(coded: DataFrame, books: Books, scale: int = SCALE) -> DataFrame:
    """coded with `vector`, the approximation that a code and its codebooks stand for: the middle of each entry's step."""
    digests = {digest: d for d, digest in named(books).items()}
    sent = coded.sparkSession.sparkContext.broadcast({digest: books[d] for digest, d in digests.items()})

    @F.pandas_udf("array<double>")
    def vectors(code, digest):
        import pandas as pd

        return pd.Series([np.concatenate([(book[at] + 0.5) / scale for book, at in zip(sent.value[of], bytes.fromhex(c), strict=True)]) for c, of in zip(code, digest, strict=True)], dtype=object)

    return coded.withColumn("vector", vectors("code", "codebooks_sha256"))


@tidy
def compress(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", rounds: int = ROUNDS, entries: int = ENTRIES) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of each vector that is kept."""
    kept = cut(integers(rows, key, vector, label))
    coded = cut(encode(kept, fit(kept, rounds, entries)))
    sums = cut(coded.groupBy(F.col("label").alias("of")).agg(F.try_sum("error").alias("label_error"), F.count("*").alias("n")))
    most = coded.count() // 1000  # labels of more rows than that are at most a thousand: no key of the join below is hot
    hot, rest = F.broadcast(sums.where(F.col("n") > most)), sized(sums.where(F.col("n") <= most))
    wide = coded.join(hot.select("of", F.col("label_error").alias("hot"), F.lit(True).alias("is_hot")), F.col("label").eqNullSafe(F.col("of")), "left").drop("of").withColumn("is_hot", F.coalesce("is_hot", F.lit(False)))
    cold = wide.where(~F.col("is_hot")).join(rest, F.col("label").eqNullSafe(F.col("of")), "left")
    columns = ("vec_id", "code", "error", "label_error", "codebooks_sha256")
    return wide.where("is_hot").withColumn("label_error", F.col("hot")).select(*columns).union(cold.select(*columns))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress(table(spark, sf_dir, "embeddings"))


def _sql() -> str:
    """The same in SQL for vectors of one length; sums of products of doubles are exact below 2^53."""
    steps = [
        """kept as (select vec_id, label, [floor(1024 * x::double) for x in embedding] as v, row_number() over (order by vec_id nulls last) as rid
          from embeddings where embedding is not null and len([x for x in embedding if x is null or isnan(x) or isinf(x)]) = 0)""",
        """x as materialized (select rid, p, v[p * len(v) // 4 + 1:(p + 1) * len(v) // 4] as w, list_inner_product(w, w) as ww from kept, range(4) t(p))""",
        """c0 as materialized (select p, rid - 1 as e, w, ww from x where rid <= 256)""",
    ]
    for k in range(ROUNDS + 1):
        steps.append(f"a{k} as materialized (select x.rid, x.p, min(((x.ww + c.ww - 2 * list_inner_product(x.w, c.w)) * 256 + c.e)::bigint) as best from x join c{k} c on x.p = c.p group by all)")
        if k < ROUNDS:
            steps.append(f"s{k} as (select p, e, i, floor(sum(y) / count(*)) as y from (select a.p, best % 256 as e, unnest(w) as y, unnest(range(len(w))) as i from a{k} a join x on a.rid = x.rid and a.p = x.p) group by all)")
            steps.append(f"m{k} as (select p, e, list(y order by i) as w from s{k} group by all)")
            steps.append(f"c{k + 1} as materialized (select c.p, c.e, coalesce(m.w, c.w) as w, list_inner_product(coalesce(m.w, c.w), coalesce(m.w, c.w)) as ww from c{k} c left join m{k} m on c.p = m.p and c.e = m.e)")
    steps.append(f"coded as (select rid, string_agg(printf('%02x', best % 256), '' order by p) as code, sum(best // 256)::bigint as error from a{ROUNDS} group by rid)")
    steps.append(f"books as (select sha256(string_agg(array_to_string([y::bigint::varchar for y in w], ','), ',' order by p, e)) as codebooks_sha256 from c{ROUNDS})")
    return f"with {', '.join(steps)} select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, codebooks_sha256 from kept join coded using (rid), books"


OP13_SQL = _sql()
