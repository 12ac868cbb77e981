"""Queries over group streams, sharded stores and version checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from findling.operators import rankings, vectors
from findling.plans.registry import query
from findling.sources import readers, shards
from findling.sources.scratch import folder


@query("""with a as (select auction_id // 8 as work_id, count(*) as n, max(metadata_final_score) as best from scores group by 1),
    b as (select auction_id as work_id, string_agg(cast(image_id as varchar), ',' order by image_id) as images from links where processed group by 1)
    select coalesce(a.work_id, b.work_id) as work_id, coalesce(n, 0) as n_scores, best, coalesce(images, '') as images from a full join b on a.work_id = b.work_id""")
def jn16_merged_groups(v):
    scores = v["scores"].select(F.expr("auction_id div 8").alias("work_id"), "metadata_final_score")
    links = v["links"].where("processed").select(F.col("auction_id").alias("work_id"), "image_id")
    met = rankings.merge_groups(scores, links, "work_id")
    best = F.array_max(F.transform("lefts", lambda x: x["metadata_final_score"]))
    return met.select("work_id", F.size("lefts").cast("long").alias("n_scores"), best.alias("best"), F.array_join(F.transform("rights", lambda x: x["image_id"].cast("string")), ",").alias("images"))


def _ranking(v):
    """The links as a candidate ranking."""
    rows = v["lineitem"]
    return rows.select(F.concat(F.lit("a"), "l_orderkey").alias("auction_file_id"), F.concat(F.lit("l"), "l_partkey").alias("lost_file_id"), (F.col("l_orderkey") % 7 + 1).alias("auction_content_version"), F.lit(4).cast("long").alias("lost_content_revision"), F.col("l_linenumber").cast("short").alias("rank"), F.col("l_discount").cast("float").alias("blocking_score"))


@query("""select 'a' || l_orderkey as auction_file_id, 'works/' || l_orderkey as auction_file_path, l_orderkey % 7 + 1 as auction_content_version,
    string_agg(l_linenumber || ':l' || l_partkey || ':' || file_path, ' ' order by l_linenumber, 'l' || l_partkey, file_path) as candidates
    from lineitem join images on image_id = l_partkey group by l_orderkey""")
def jn16_src10_match_candidates(v):
    own = rankings.paths_of(v["orders"].select(F.concat(F.lit(" a"), "o_orderkey").alias("file_id"), F.concat(F.lit("works/"), "o_orderkey").alias("file_path")))
    lost = rankings.paths_of(v["images"].select(F.concat(F.lit("l"), "image_id").alias("file_id"), "file_path"))
    found = rankings.match_candidates(_ranking(v), own, lost)
    each = F.transform("candidates", lambda c: F.concat_ws(":", c["rank"].cast("string"), c["lost_file_id"], c["lost_file_path"]))
    return found.select("auction_file_id", "auction_file_path", "auction_content_version", F.array_join(each, " ").alias("candidates"))


@query("""select 'a' || l_orderkey as auction_file_id, count(*) as n, string_agg('l' || l_partkey, ' ' order by l_linenumber, 'l' || l_partkey) as lost_file_ids from lineitem group by l_orderkey""")
def src9_stored_ranking(v):
    """A ranking is stored in sorted parts and read group by group without a shuffle."""
    rows = _ranking(v)
    at = folder(rows.sparkSession)
    rows.repartitionByRange("auction_file_id").sortWithinPartitions("auction_file_id", "rank", "lost_file_id").write.parquet(at)
    stored = readers.ranking(rows.sparkSession, at).select("auction_file_id", "lost_file_id", "rank")
    groups = rankings.contiguous_groups(stored, "auction_file_id")
    return groups.select("auction_file_id", F.size("items").cast("long").alias("n"), F.array_join(F.transform("items", lambda x: x["lost_file_id"]), " ").alias("lost_file_ids"))


@query("""with r as (select *, o_orderkey // 500 as shard from orders where (o_orderkey // 500) % 7 <> 6)
    select cast(shard as varchar) as shard, case when shard % 5 = 3 then 2 else 1 end as version, count(*) as n_rows, count(*) filter (o_orderstatus = 'X' or shard % 5 = 3) as n_changed from r group by shard""")
def snk10_sharded_store(v):
    """Two commits: the second changes every fifth shard and drops every seventh; the others are not written again."""
    rows = v["orders"].select("o_orderkey", "o_orderstatus")
    number = F.expr("o_orderkey div 500")
    store = shards.Store(rows.sparkSession, folder(rows.sparkSession), number, ("o_orderkey", "o_orderstatus"))
    store.commit(rows)
    store.commit(rows.where(number % 7 != 6).withColumn("o_orderstatus", F.when(number % 5 == 3, "X").otherwise(F.col("o_orderstatus"))))
    return store.read().groupBy("shard", "version").agg(F.count("*").alias("n_rows"), F.count_if(F.col("o_orderstatus") == "X").alias("n_changed"))


@query("select o_orderkey, o_totalprice from orders where o_orderstatus = 'F'")
def snk9_replaced_table(v):
    rows = v["orders"].select("o_orderkey", "o_totalprice", "o_orderstatus")
    at = folder(rows.sparkSession)
    shards.atomic_write(rows, at)
    shards.atomic_write(rows.where("o_orderstatus = 'F'").drop("o_orderstatus"), at)
    return rows.sparkSession.read.parquet(at)


@query("""with s as (select vec_id // 50 as shard, bool_or(label = 0 or vec_id % 11 = 5) as changed from embeddings group by 1)
    select cast(vec_id as varchar) as file_id, cast(vec_id // 50 as varchar) as shard, case when changed then 2 else 1 end as version,
    case when label = 0 then 2 else 1 end as content_version, round(sqrt(list_sum([cast(x as double) * x for x in embedding])), 3) as norm
    from embeddings join s on s.shard = vec_id // 50""")
def src11_embedding_cache(v):
    """A cache is built without some vectors, then brought up to all of them, of which some have a new version: only the shards of these are written."""
    rows = v["embeddings"]
    images = rows.select(F.col("vec_id").cast("string").alias("file_id"), F.sha2(F.to_json(F.struct("embedding")), 256).alias("content_sha256"), F.lit(1).alias("content_version"), "embedding", "label")
    store = shards.Store(rows.sparkSession, folder(rows.sparkSession), F.expr("cast(file_id as bigint) div 50"), ("file_id", "content_sha256", "content_version"))
    embed = lambda some: some.withColumns({"norm": vectors.norm(F.col("embedding")), "vector": vectors.unit(F.col("embedding"))})
    own = lambda some: embed(some).drop("norm")
    shards.refreshed(store, images.where("cast(file_id as bigint) % 11 <> 5"), own)
    shards.refreshed(store, images.withColumn("content_version", F.when(F.col("label") == 0, 2).otherwise(1)), own)
    length = F.aggregate(F.zip_with("vector", "embedding", lambda a, b: a * b.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return store.read().select("file_id", "shard", "version", "content_version", F.round(length, 3).alias("norm"))


@query("select count(*) as n_rows, 0 as unset, 4 as least, 4 as most from lineitem")
def vs5_one_revision(v):
    """A ranking is written while its revision is observed to be one."""
    rows = _ranking(v)
    at = folder(rows.sparkSession)
    parent, name = at.rsplit("/", 1)
    place = shards.Folder(rows.sparkSession, parent)
    found = rankings.checked_write(rows, "lost_content_revision", lambda df: df.write.parquet(at), lambda: place.remove(name))
    written = rows.sparkSession.read.parquet(at).agg(F.count("*").alias("n_rows"))
    return written.select("n_rows", *(F.lit(found[m]).cast("int").alias(m) for m in ("unset", "least", "most")))


@query("""select l_orderkey, l_linenumber, l_partkey, l_partkey % 3 as version from lineitem left join part on p_partkey = l_partkey and p_size <> 7
    where p_partkey is null or l_partkey % 3 <> p_partkey % 3 + case when p_size % 5 = 0 then 1 else 0 end""")
def vs5_stale_versions(v):
    """Results whose image has gone or changed since."""
    results = v["lineitem"].select("l_orderkey", "l_linenumber", "l_partkey", (F.col("l_partkey") % 3).alias("version"))
    images = v["part"].where("p_size <> 7").select(F.col("p_partkey").alias("file_id"), (F.col("p_partkey") % 3 + F.when(F.col("p_size") % 5 == 0, 1).otherwise(0)).alias("content_version"))
    return rankings.stale_versions(results, images, "l_partkey", "version").select("l_orderkey", "l_linenumber", "l_partkey", "version")


@query("""with s as (select a.vec_id as query_id, b.vec_id as candidate_id, list_sum([cast(z[1] as double) * z[2] for z in list_zip(a.embedding, b.embedding)]) / (sqrt(list_sum([cast(x as double) * x for x in a.embedding])) * sqrt(list_sum([cast(x as double) * x for x in b.embedding]))) as score
    from embeddings a cross join embeddings b where a.vec_id % 50 = 0), r as (select *, row_number() over (partition by query_id order by round(score, 9) desc, candidate_id) as rank from s)
    select query_id // 100 as shard, query_id, candidate_id, cast(rank as bigint) as rank, sha256(cast(query_id as varchar)) as query_sha256, sha256(cast(candidate_id as varchar)) as candidate_sha256 from r where rank <= 10""")
def vs3_sharded_candidates(v):
    """The ranking with both sides' identities, in shards of the asking side."""
    rows = v["embeddings"]
    found = vectors.top_k(rows.where("vec_id % 50 = 0"), rows, 10)
    same = lambda side: rows.select(F.col("vec_id").alias(f"{side}_id"), F.sha2(F.col("vec_id").cast("string"), 256).alias(f"{side}_sha256"))
    named = found.join(same("query"), "query_id").join(same("candidate"), "candidate_id")
    return named.select(F.expr("query_id div 100").alias("shard"), "query_id", "candidate_id", F.col("rank").cast("long").alias("rank"), "query_sha256", "candidate_sha256")
