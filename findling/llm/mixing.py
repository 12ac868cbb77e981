"""Mixing sources to target weights by Sainte-Laguë apportionment, with DataFrame operations only.

Sources share a budget by weight, none above `most` times its own size. The budget is dealt out in blocks of
`block` words by highest quotients target / (2 q - 1): first to the sources, then, within a source, to its shards
(seeded hash groups of about `shard_docs` documents). A shard's quota is met by full passes over its blocks and a
seeded, evenly spaced selection for the rest; a document's taken words are those of its blocks.

Both apportionments enumerate only the quotients near the cut: for S parties and N seats the seats at the
divisors T / (N - S/2 - 1) and T / (N + S/2 + 1) bracket the result, and at most 2 S + 3 quotients lie between.

Defined cases: null text has size 0 and is taken 0 times, the null source is one source and comes last, null keys
share a hash, repeated rows are separate documents, an empty table gives no rows, extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from findling.llm.shared import cut, table

WEIGHTS = (5, 2, 1)
SHARE, MOST, BLOCK, SHARD_DOCS, SEED = 1.5, 2, 16, 1024, "mix"
WORD = r"[^\x20\x09-\x0D]+"


def _hash(*parts) -> F.Column:
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 8), 16, 10).cast("long")


def apportion(parties: DataFrame, by: list[str], size: str, seats: str, rank: str) -> DataFrame:
    """Adds `quota`: the seats (a column, equal within by) dealt out to parties by highest quotients size / (2 q - 1), ties to the lower rank."""
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    x = parties.withColumns({"_total": F.sum(size).over(group).cast("double"), "_n": F.count("*").over(group).cast("double")})
    at = lambda d: F.when(F.col("_total") > 0, F.floor(F.col(size) * F.greatest(d, F.lit(0.0)) / F.col("_total") + 0.5)).otherwise(F.lit(0)).cast("long")
    x = x.withColumns({"_low": at(F.col(seats) - F.col("_n") / 2 - 1), "_high": at(F.col(seats) + F.col("_n") / 2 + 1)})
    x = x.withColumn("_left", F.col(seats) - F.sum("_low").over(group))
    near = x.where("_high > _low").select(*by, rank, "_left", F.explode(F.sequence(F.col("_low") + 1, "_high")).alias("_q"), F.col(size).alias("_size"))
    near = near.withColumn("_place", F.row_number().over(group.orderBy(F.desc(F.col("_size") / (2 * F.col("_q") - 1)), rank, "_q")))
    won = near.where("_place <= _left").groupBy(*{*by, rank}).agg(F.count("*").alias("_won"))
    return x.join(won, list({*by, rank}), "left").withColumn("quota", F.col("_low") + F.coalesce("_won", F.lit(0))).drop("_total", "_n", "_low", "_high", "_left", "_won")


def targets(sizes: DataFrame, share: float = SHARE, most: int = MOST, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, rank, n_docs, source_size, budget, target) of (source, size) rows: one row for each source, so the windows without a key see sources, not documents."""
    all_rows = Window.partitionBy(F.lit(0))
    x = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    x = x.withColumn("rank", F.row_number().over(all_rows.orderBy(F.asc_nulls_last("source"))))
    x = x.withColumns({"w": F.element_at(F.array(*map(F.lit, weights)), ((F.col("rank") - 1) % len(weights) + 1).cast("int")).cast("long"), "cap": F.col("source_size") * most, "budget": F.sum("source_size").over(all_rows) * F.lit(float(share))})
    fill = all_rows.orderBy(F.col("cap") / F.col("w"), "rank")
    x = x.withColumns({"before": F.coalesce(F.sum("cap").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "left": F.sum("w").over(fill.rowsBetween(0, Window.unboundedFollowing))})
    x = x.withColumn("full", F.col("w") * (F.col("budget") - F.col("before")) >= F.col("cap") * F.col("left"))
    x = x.withColumns({"spent": F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(all_rows), "open": F.sum(F.when(F.col("full"), 0).otherwise(F.col("w"))).over(all_rows)})
    return x.select("source", "rank", "n_docs", "source_size", "budget", F.when(F.col("full"), F.col("cap").cast("double")).otherwise(F.col("w") * (F.col("budget") - F.col("spent")) / F.col("open")).alias("target"))


def _dealt(docs: DataFrame, key: str, source: str, text: str, keep: tuple[str, ...], block: int, shard_docs: int, seed: str, **shares) -> DataFrame:
    """The rows with their place in their shard's stream (start, stop) and the shard's selection: q blocks in all of n, turned by turn. Columns named in keep come along as `_keep` structs."""
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size")
    whole = docs.select(F.col(key).alias("doc_id"), F.col(source).alias("source"), size, *([F.struct(*keep).alias("_keep")] if keep else []))
    sizes = cut(whole.select("doc_id", "source", "size"))
    sources = targets(sizes, **shares).withColumn("blocks", F.floor(F.col("budget") / block + 0.5).cast("long"))
    sources = cut(apportion(sources, [], "target", "blocks", "rank").drop("blocks", "budget").withColumn("shards", F.ceil(F.col("n_docs") / shard_docs).cast("long")))
    order = F.md5(F.concat_ws(":", F.lit(seed), F.col("doc_id").cast("string")))

    def placed(rows: DataFrame) -> DataFrame:
        rows = rows.withColumn("order", order).join(sources.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")))
        rows = rows.withColumn("shard", F.expr("conv(substring(order, 1, 8), 16, 10) * 1L * shards div 4294967296"))
        return rows.drop("source", "_source", "shards", "n_docs")

    shards = placed(sizes).groupBy("rank", "quota", "shard").agg(F.sum("size").alias("words"))
    shards = apportion(shards.withColumnRenamed("quota", "seats"), ["rank"], "words", "seats", "shard")
    shards = shards.select("rank", "shard", F.expr(f"(words + {block - 1}) div {block}").alias("n"), "quota")
    shards = cut(shards.select("rank", "shard", "n", F.least("quota", F.col("n") * shares.get("most", MOST)).alias("q"), _hash(F.lit(seed), F.col("rank").cast("string"), F.col("shard").cast("string")).alias("turn")))
    rows = placed(whole if keep else sizes).drop("quota")
    rows = rows.withColumn("stop", F.sum("size").over(Window.partitionBy("rank", "shard").orderBy("order", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)))
    return rows.withColumn("start", F.col("stop") - F.col("size")).join(shards, ["rank", "shard"])


def _picked(k: str) -> str:
    """Blocks selected before the k-th, up to a constant."""
    return f"(({k}) + turn % n) * (q % n) div n"


def mix(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", block: int = BLOCK, shard_docs: int = SHARD_DOCS, seed: str = SEED, **shares) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for each row of docs."""
    rows = _dealt(docs, key, source, text, (), block, shard_docs, seed, **shares)
    upto = lambda w: f"(q div n) * {w} + {block} * ({_picked(f'{w} div {block}')}) + ({w} % {block}) * ({_picked(f'{w} div {block} + 1')} - {_picked(f'{w} div {block}')})"
    taken = F.expr(f"case when size = 0 then 0L else {upto('stop')} - ({upto('start')}) end")
    return rows.select("doc_id", "size", "source_size", "target", taken.alias("taken"))


def take(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", chars: str | None = None, block: int = BLOCK, shard_docs: int = SHARD_DOCS, seed: str = SEED, **shares) -> DataFrame:
    """The mix itself, in the columns of docs: each document once for every full pass, and once with the words of its selected blocks (joined by spaces) where those of a partial pass fall on it. chars names a column that then holds the text's length."""
    rows = _dealt(docs, key, source, text, tuple(docs.columns), block, shard_docs, seed, **shares)
    at = f"((start + i) div {block})"
    part = F.expr(f"filter(regexp_extract_all(_keep.`{text}`, '{WORD}', 0), (w, i) -> {_picked(f'{at} + 1')} > {_picked(at)})".replace("\\", "\\\\"))
    copies = F.expr(f"array_repeat(_keep.`{text}`, int(q div n))")
    rows = rows.where("size > 0 and q > 0").select("_keep", copies.alias("_full"), F.when(F.expr("q % n > 0"), part).otherwise(F.array().cast("array<string>")).alias("_part"))
    texts = F.concat("_full", F.when(F.size("_part") > 0, F.array(F.array_join("_part", " "))).otherwise(F.array().cast("array<string>")))
    rows = rows.select("_keep", F.explode(texts).alias("_text"))
    named = {text: F.col("_text")} | ({chars: F.length("_text").cast(docs.schema[chars].dataType)} if chars else {})
    return rows.select(*((named[c] if c in named else F.col(f"_keep.`{c}`")).alias(c) for c in docs.columns))


def op3_sainte_lague(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


#: The same mix the long way: every quotient of every source and shard is ranked.
OP3_SQL = r"""
with sizes as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size, md5(concat_ws(':', 'mix', doc_id::varchar)) as ord from documents),
s0 as (select source, sum(size)::bigint as source_size, count(*) as n_docs from sizes group by source),
s1 as (select *, row_number() over (order by source asc nulls last) as rank from s0),
s2 as (select *, [5, 2, 1][(rank - 1) % 3 + 1] as w, 2 * source_size as cap, (sum(source_size) over ())::bigint * 1.5::double as budget from s1),
s3 as (select *, coalesce(sum(cap) over (order by cap / w, rank rows between unbounded preceding and 1 preceding), 0) as before,
  sum(w) over (order by cap / w, rank rows between current row and unbounded following) as rest from s2),
s4 as (select *, w * (budget - before) >= cap * rest as full_up from s3),
s5 as (select *, case when full_up then cap::double else w * (budget - (sum(case when full_up then cap else 0 end) over ())::bigint) / (sum(case when full_up then 0 else w end) over ())::bigint end as target,
  floor(budget / 16 + 0.5)::bigint as blocks, (n_docs + 1023) // 1024 as shards from s4),
q0 as (select rank, blocks, target / (2 * q - 1) as quotient, q from s5, unnest(range(1, (target / 16)::bigint + 40)) as t(q) where target > 0),
q1 as (select rank, row_number() over (order by quotient desc, rank, q) as place, blocks from q0),
q2 as (select rank, count(*) as quota from q1 where place <= blocks group by rank),
r0 as (select d.doc_id, d.size, d.ord, s.source_size, s.target, s.rank, coalesce(q.quota, 0) as seats, ('0x' || substr(d.ord, 1, 8))::bigint * s.shards // 4294967296 as shard
  from sizes d join s5 s on d.source is not distinct from s.source left join q2 q on q.rank = s.rank),
h0 as (select rank, shard, seats, sum(size)::bigint as words, (sum(size)::bigint + 15) // 16 as n from r0 group by all),
h1 as (select rank, shard, seats, words::double / (2 * q - 1) as quotient, q from h0, unnest(range(1, 2 * n + 40)) as t(q) where words > 0),
h2 as (select rank, shard, seats, row_number() over (partition by rank order by quotient desc, shard, q) as place from h1),
h3 as (select rank, shard, count(*) as quota from h2 where place <= seats group by all),
h4 as (select h0.rank, h0.shard, n, least(coalesce(quota, 0), 2 * n) as quota, ('0x' || substr(md5(concat_ws(':', 'mix', h0.rank::varchar, h0.shard::varchar)), 1, 8))::bigint as turn
  from h0 left join h3 on h0.rank = h3.rank and h0.shard = h3.shard),
r1 as (select *, (sum(size) over (partition by rank, shard order by ord, doc_id, size rows between unbounded preceding and current row))::bigint as stop from r0),
r2 as (select r1.*, stop - size as start, n, quota // n as passes, quota % n as extra, turn % n as turn from r1 join h4 on r1.rank = h4.rank and r1.shard = h4.shard)
select doc_id, size, source_size, target,
  case when size = 0 then 0 else passes * size
    + 16 * ((stop // 16 + turn) * extra // n) + (stop % 16) * ((stop // 16 + 1 + turn) * extra // n - (stop // 16 + turn) * extra // n)
    - 16 * ((start // 16 + turn) * extra // n) - (start % 16) * ((start // 16 + 1 + turn) * extra // n - (start // 16 + turn) * extra // n) end as taken
from r2
"""
