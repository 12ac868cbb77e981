"""The registered queries: each applies one operator to whole tables, with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from findling.functions import dating, jsontext, markup, names, scoring, similarity, values
from findling.operators import blocks, catalogue, images, indexes, inventory, invalidation, matches, pairs, series, tables, trees, vectors
from findling.plans.registry import NOW, QUERIES, SQL, now, query
from findling.plans.standins import views
from findling.streaming import micro

__all__ = ["NOW", "QUERIES", "SQL", "entry", "now", "query"]


# Scans


@query("""select l.lost_id, coalesce(list_sort(list(p.complete_name) filter (where p.artist_id is not null)), []) as artist_names
    from lost l left join people p on p.artist_id = l.artist_a or p.artist_id = l.artist_b group by l.lost_id""")
def src1_works_with_artist_names(v):
    works = v["lost"].select("lost_id", F.array_distinct(F.array("artist_a", "artist_b")).alias("artist_ids"))
    return matches.ordered_names(works, v["people"]).select("lost_id", "artist_names")


@query("""select w.auction_id, exists (select 1 from scores s where s.auction_id = w.auction_id) as scored from works w where not w.processed""")
def src2_pending_by_priority(v):
    hit = v["scores"].select("auction_id").distinct().withColumn("scored", F.lit(True))
    return v["works"].where("not processed").join(hit, "auction_id", "left").select("auction_id", F.coalesce("scored", F.lit(False)).alias("scored")).orderBy(F.desc("scored"), "auction_id")


@query("select count(*) > 0 as pending from works where not processed")
def src3_pending_probe(v):
    return v["works"].where("not processed").select("auction_id").limit(1).agg((F.count("*") > 0).alias("pending"))


@query("select distinct i.image_id, i.file_path from lost l join images i on i.image_id = l.lost_id")
def src4_lost_images(v):
    return v["lost"].join(v["images"], F.col("lost_id") == F.col("image_id")).select("image_id", "file_path").distinct()


@query("""select l.auction_id, i.image_id, i.file_path from links l join images i on i.image_id = l.image_id
    where not i.is_embedded or not l.processed or (not l.error_free and not exists (select 1 from scores s where s.auction_id = l.auction_id * 8 + 1))""")
def src5_images_to_do(v):
    scored = v["scores"].select(F.col("auction_id").alias("k")).distinct().withColumn("scored", F.lit(True))
    x = v["links"].join(v["images"], "image_id").join(scored, F.col("auction_id") * 8 + 1 == F.col("k"), "left")
    return x.where(~F.col("is_embedded") | ~F.col("processed") | (~F.col("error_free") & F.col("scored").isNull())).select("auction_id", "image_id", "file_path")


@query("""select l.auction_id, l.image_id from links l join (select distinct auction_id from links where not processed order by auction_id limit 100) w on w.auction_id = l.auction_id""")
def src6_first_works_all_images(v):
    first = v["links"].where("not processed").groupBy("auction_id").count().orderBy("auction_id").limit(100).select("auction_id")
    return v["links"].join(first, "auction_id", "left_semi").select("auction_id", "image_id")


@query("""select conv_id, turn, trim(text) as text from conversations where role = 'user' and trim(coalesce(text, '')) <> '' order by conv_id, turn limit 100""")
def src12_description_batch(v):
    return v["conversations"].where("role = 'user' and trim(coalesce(text, '')) <> ''").orderBy("conv_id", "turn").limit(100).select("conv_id", "turn", F.trim("text").alias("text"))


@query("select event_id, cast(json_extract_string(props, '$.k') as bigint) as k from events where json_extract_string(props, '$.k') is not null")
def src13_json_records(v):
    return v["events"].select("event_id", F.from_json("props", "k long").alias("p")).where("p.k is not null").select("event_id", "p.k")


@query("select lower(p_name) as key, list_sort(list(distinct p_type)) as names from part group by 1")
def src15_variant_map(v):
    from findling.sources.readers import variants

    return variants(v["part"], "p_type", "p_name")


@query("select name from tree where parent is null order by name limit 1")
def src16_root_name(v):
    return v["tree"].where("parent is null").orderBy("name").limit(1).select("name")


@query("""select lost_id, auction_id, final from (select lost_id, auction_id, metadata_final_score as final from scores) x
    where (lost_id, auction_id) > (100, 5000) order by lost_id, auction_id limit 1000""")
def src19_keyset_page(v):
    rows = v["scores"].select("lost_id", "auction_id", F.col("metadata_final_score").alias("final"))
    return inventory.keyset_page(rows, ["lost_id", "auction_id"], (100, 5000), 1000)


# Similarity and confidence


@query("""select s_suppkey, p_partkey, case when lower(p_name) = lower(q_name) then 1.0 else 1 - levenshtein(lower(p_name), lower(q_name)) / greatest(length(p_name), length(q_name)) end as title_sim
    from supplier join part on p_size = s_suppkey % 50 + 1 join (select p_partkey as q_key, p_name as q_name from part) q on q_key = s_suppkey""")
def sc1_title_similarity(v):
    other = v["part"].select(F.col("p_partkey").alias("s_suppkey"), F.col("p_name").alias("q_name"))
    named = v["supplier"].select("s_suppkey", (F.col("s_suppkey") % 50 + 1).alias("size")).where("size is not null").join(other, "s_suppkey")
    sized = v["part"].where("p_size is not null").select("p_partkey", F.col("p_size").cast("long").alias("size"), "p_name")
    cut = lambda d, key, c: d.select(key, "size", *(x.alias(f"{c[0]}_{k}") for k, x in similarity.title_parts(F.col(c)).items()))
    own, its = ({k: F.col(f"{c}_{k}") for k in ("low", "plain", "stock")} for c in "pq")
    values = ([f"{c}_{k}" for k in own] for c in "pq")
    x = blocks.class_pairs(cut(sized, "p_partkey", "p_name"), cut(named, "s_suppkey", "q_name"), ["size"], ("p_partkey", "s_suppkey"), tuple(values), (v["part"].count(), v["supplier"].count()))
    return blocks.listed(x.select("_left", "_right", similarity.title_similarity_of(own, its).alias("title_sim"))).select("s_suppkey", "p_partkey", "title_sim")


@query("""select c_custkey, s_suppkey, jaro_winkler_similarity(lower(c_name), lower(s_name)) as artist_sim from customer join supplier on c_nationkey = s_nationkey""")
def sc3_artist_similarity(v):
    a = v["customer"].where("c_nationkey is not null").select("c_custkey", F.col("c_nationkey").alias("nation"), similarity.artist_key(F.col("c_name")).alias("c_name"))
    b = v["supplier"].where("s_nationkey is not null").select("s_suppkey", F.col("s_nationkey").alias("nation"), similarity.artist_key(F.col("s_name")).alias("s_name"))
    return blocks.compared(a, b, ["nation"], ("c_custkey", "s_suppkey"), ("c_name", "s_name"), similarity.jaro_winkler_table, "artist_sim", (v["customer"].count(), v["supplier"].count()))


@query("""with each as (select distinct l.lost_id, p.complete_name from lost l join people p on p.artist_id in (l.artist_a, l.artist_b)),
    sims as (select complete_name, auction_id, jaro_winkler_similarity(lower(complete_name), lower(a.artist)) as s from (select distinct complete_name from each) cross join auction a)
    select lost_id, auction_id, max(s) as artist_sim from each join sims using (complete_name) group by lost_id, auction_id""")
def sc4_best_artist(v):
    works = v["lost"].select("lost_id", F.array_distinct(F.array("artist_a", "artist_b")).alias("artist_ids"))
    named = matches.ordered_names(works, v["people"]).where(F.size("artist_names") > 0).select("lost_id", "artist_names")
    auctions = v["auction"].select("auction_id", "artist")
    return blocks.compared(named, auctions, [], ("lost_id", "auction_id"), ("artist_names", "artist"), pairs.best_artists, "artist_sim", (v["lost"].count(), auctions.count()))


_OVERLAP = """case when (l.dating_start is null and l.dating_end is null) or (a.dating_start is null and a.dating_end is null) then null
    when greatest(coalesce(l.dating_start, l.dating_end - 200), coalesce(a.dating_start, a.dating_end - 200)) <= least(coalesce(l.dating_end, least(2026, l.dating_start + 200)), coalesce(a.dating_end, least(2026, a.dating_start + 200))) then 1.0 else 0.0 end"""


@query(f"select l.lost_id, a.auction_id, {_OVERLAP} as dating_sim from lost l cross join auction a")
def sc5_dating_similarity(v):
    a = v["auction"].select("auction_id", F.col("dating_start").alias("s2"), F.col("dating_end").alias("e2"))
    lost = v["lost"].select("lost_id", "dating_start", "dating_end")
    x = blocks.class_pairs(lost, a, [], ("lost_id", "auction_id"), (["dating_start", "dating_end"], ["s2", "e2"]), (lost.count(), a.count()))
    sim = similarity.dating_similarity(*(F.col(c) for c in ("dating_start", "dating_end", "s2", "e2"))).alias("dating_sim")
    return blocks.listed(x.select("_left", "_right", sim)).select("lost_id", "auction_id", "dating_sim")


@query("""select l.lost_id, a.auction_id, case when l.width is null or l.height is null or a.width is null or a.height is null then null else
    (case when l.width > 0 and a.width > 0 and abs(l.width - a.width) <= 0.1 * greatest(l.width, a.width) then 1.0 else 0.0 end
    + case when l.height > 0 and a.height > 0 and abs(l.height - a.height) <= 0.1 * greatest(l.height, a.height) then 1.0 else 0.0 end) / 2 end as dimensions_sim
    from lost l cross join auction a""")
def sc6_dimensions_similarity(v):
    a = v["auction"].select("auction_id", F.col("width").alias("w2"), F.col("height").alias("h2"))
    lost = v["lost"].select("lost_id", "width", "height")
    x = blocks.class_pairs(lost, a, [], ("lost_id", "auction_id"), (["width", "height"], ["w2", "h2"]), (lost.count(), a.count()))
    sim = similarity.dimensions_similarity(*(F.col(c) for c in ("width", "height", "w2", "h2"))).alias("dimensions_sim")
    return blocks.listed(x.select("_left", "_right", sim)).select("lost_id", "auction_id", "dimensions_sim")


_PATHS = "with recursive up as (select name, [name] as path, parent from tree union all select u.name, list_append(u.path, t.name), t.parent from up u join tree t on t.name = u.parent), paths as (select name, path from up where parent is null)"


@query(f"{_PATHS} select name, path from paths")
def sc8_root_paths(v):
    return trees.root_paths(v["tree"])


@query(f"""{_PATHS}, both_ as (select x.name as a, y.name as b, list_reverse(x.path) as p, list_reverse(y.path) as q from paths x cross join paths y),
    shared as (select *, (case when p[1] = q[1] then (case when p[2] = q[2] then (case when p[3] = q[3] then 2 else 1 end) else 0 end) else 0 end) as s from both_)
    select a, b, case when a = 'world' or b = 'world' then null when a = b then 1.0 else s / (len(p) - 1 + len(q) - 1 - s) end as similarity from shared""")
def sc7_tree_similarity(v):
    return trees.similarity_table(trees.root_paths(v["tree"]), root="world")


@query(f"{_PATHS} select name, case when name = 'world' then 0.0 else (len(path) - 1) / (select max(len(path) - 1) from paths) end as confidence from paths")
def sc13_depth_confidence(v):
    return trees.depth_confidence(trees.root_paths(v["tree"]), root="world")


@query("""select lost_id, case when n is null or n <= 1 then 1.0 else ln(t / n) / ln(t) end as title_conf from lost
    join (select title as k, count(*) as n from lost group by 1) on k = title cross join (select count(*) as t from lost where trim(title) <> '')""")
def sc9_title_confidence(v):
    x = v["lost"].select("lost_id", "title")
    return indexes.looked_up(x, indexes.title_index(x), similarity.squeeze(F.col("title")), "title_key", "title_conf").select("lost_id", "title_conf")


@query("""with each as (select distinct l.lost_id, lower(p.complete_name) as k from lost l join people p on p.artist_id in (l.artist_a, l.artist_b)),
    counts as (select k, count(*) as n from each group by k), total as (select count(distinct lost_id) as t from each)
    select k as artist_key, n, case when n <= 1 or t <= 1 then 1.0 else ln(t / n) / ln(t) end as artist_conf from counts cross join total""")
def sc10_artist_confidence(v):
    works = v["lost"].select("lost_id", F.array_distinct(F.array("artist_a", "artist_b")).alias("artist_ids"))
    counts, total = indexes.artist_index(matches.ordered_names(works, v["people"]), "artist_names")
    return counts.crossJoin(F.broadcast(total)).select("artist_key", "n", scoring.rarity(F.col("n"), F.col("total")).alias("artist_conf"))


@query("""with known as (select dating_start as a, dating_end as b from lost where dating_start <= dating_end),
    cover as (select y as year, (select count(*) from known where a <= y and y <= b) as n from (select unnest(range((select min(a) from known), (select max(b) + 1 from known))) as y)),
    conf as (select year, case when n <= 1 then 1.0 else greatest(0.0, least(1.0, ln((select count(*) from known) / n) / ln((select count(*) from known)))) end as v from cover)
    select l.lost_id, case when not (l.dating_start <= l.dating_end) or l.dating_start is null or l.dating_end is null then null
    else least(1.0, greatest(0.0, coalesce((select sum(v) from conf where year between l.dating_start and l.dating_end), 0) / (l.dating_end - l.dating_start + 1))) end as dating_conf from lost l""")
def sc11_dating_confidence(v):
    lost = v["lost"]
    n = lost.where("dating_start <= dating_end").count()
    x = indexes.interval_confidence(lost.select("lost_id", "dating_start", "dating_end"), indexes.year_coverage(lost), n, "dating_start", "dating_end", "dating_conf")
    return x.select("lost_id", "dating_conf")


@query("""with known as (select dating_start as a, dating_end as b from lost where dating_start <= dating_end)
    select cast(y as bigint) as year, (select count(*) from known where a <= y and y <= b) as n from (select unnest(range((select min(a) from known), (select max(b) + 1 from known))) as y)""")
def ag5_year_coverage(v):
    return indexes.year_coverage(v["lost"]).select(F.col("year").cast("long").alias("year"), F.col("n").cast("long").alias("n"))


@query("""with tops as (select quantile_cont(width, 0.99) filter (where width > 0) as w, quantile_cont(height, 0.99) filter (where height > 0) as h from lost),
    kept as (select width, height from lost cross join tops where width > 0 and height > 0 and width <= w and height <= h),
    s as (select count(*) as n, var_samp(width) * power(count(*), -1.0 / 3) as a, covar_samp(width, height) * power(count(*), -1.0 / 3) as b, var_samp(height) * power(count(*), -1.0 / 3) as c from kept),
    pts as (select width, height, count(*) as w from kept group by 1, 2),
    wanted as (select distinct width as x, height as y from lost where width is not null and height is not null),
    dens as (select x, y, sum(p.w * exp(-(c * (x - width) * (x - width) - 2 * b * (x - width) * (y - height) + a * (y - height) * (y - height)) / (2 * (a * c - b * b)))) / (any_value(n) * 2 * pi() * sqrt(any_value(a * c - b * b))) as d from wanted cross join pts p cross join s group by x, y),
    logs as (select x, y, ln(1 / greatest(d, 1e-12)) as l from dens), top as (select max(l) as m from logs join pts on x = width and y = height)
    select lost_id, case when l is not null then round(least(1.0, greatest(0.0, l / m)), 9) end as size_conf from lost left join logs on width = x and height = y cross join top""")
def sc12_dimension_confidence(v):
    lost = v["lost"]
    return indexes.density_confidence(lost.select("lost_id", "width", "height"), indexes.trimmed_sizes(lost), "width", "height", "size_conf").select("lost_id", F.round("size_conf", 9).alias("size_conf"))


@query("select count(*) as n, round(sum(width), 6) as width, round(sum(height), 6) as height from (select l.width, l.height from lost l cross join (select quantile_cont(width, 0.99) filter (where width > 0) as w, quantile_cont(height, 0.99) filter (where height > 0) as h from lost) t where l.width > 0 and l.height > 0 and l.width <= w and l.height <= h)")
def ag6_percentile_trim(v):
    return indexes.trimmed_sizes(v["lost"]).agg(F.count("*").alias("n"), F.round(F.sum("width"), 6).alias("width"), F.round(F.sum("height"), 6).alias("height"))


@query("""with parts as (select lost_id, auction_id, metadata_final_score as a, metadata_confidence_score as b, image_final_score as c from scores)
    select lost_id, auction_id, case when a is null and b is null and c is null then 0.0 else (coalesce(0.35 * a, 0) + coalesce(0.25 * b, 0) + coalesce(0.15 * c, 0)) /
    (case when a is null then 0 else 0.35 end + case when b is null then 0 else 0.25 end + case when c is null then 0 else 0.15 end) end as final_score,
    0.35 * coalesce(a, 0) + 0.25 * coalesce(b, 0) + 0.15 * coalesce(c, 0) as confidence_score from parts""")
def sc14_fusion(v):
    parts = {"title": F.col("metadata_final_score"), "artist": F.col("metadata_confidence_score"), "dating": F.col("image_final_score")}
    parts |= {k: F.lit(None).cast("double") for k in ("dimensions", "material", "technique")}
    return v["scores"].select("lost_id", "auction_id", scoring.fused(parts).alias("final_score"), scoring.trusted(parts).alias("confidence_score"))


@query("select lost_id, auction_id, coalesce(image_matching_confidence * image_blocking_similarity, image_matching_confidence) as final from scores where image_matching_confidence is not null")
def sc15_image_final(v):
    return v["scores"].where("image_matching_confidence is not null").select("lost_id", "auction_id", scoring.image_final(F.col("image_matching_confidence"), F.col("image_blocking_similarity")).alias("final"))


def _linkage(v: dict) -> DataFrame:
    lost, auction = v["lost"], v["auction"]
    named = matches.ordered_names(lost.withColumn("artist_ids", F.array_distinct(F.array("artist_a", "artist_b"))), v["people"])
    region = lambda k: F.array(F.concat(F.lit("NATION_"), (F.col(k) % 25).cast("string")))
    left = named.select("lost_id", F.col("title").alias("lost_title"), F.col("artist_names").alias("lost_artists"), region("lost_id").alias("lost_materials"), region("artist_a").alias("lost_techniques"), *(F.col(c).alias(f"lost_{c}") for c in ("dating_start", "dating_end", "width", "height")))
    right = auction.select("auction_id", F.col("title").alias("auction_title"), F.col("artist").alias("auction_artist"), region("auction_id").alias("auction_materials"), region("platform_id").alias("auction_techniques"), *(F.col(c).alias(f"auction_{c}") for c in ("dating_start", "dating_end", "width", "height")))
    return pairs.score_pairs(left, right, v["tree"], v["tree"])


@query()
def jn1_score_pairs(v):
    return _linkage(v)


# Filters, projections, paging


@query(f"""select lost_id, auction_id from scores where not (metadata_final_score is null and (image_final_score is not null or image_matching_confidence is not null)
    and image_match_date is not null and image_match_date > timestamp '{NOW}' - interval 1 day)""")
def flt1_visible(v):
    return v["scores"].where(scoring.visible(now())).select("lost_id", "auction_id")


_DATE = """case when metadata_final_score is not null and (image_final_score is not null or image_matching_confidence is not null) then greatest(metadata_match_date, image_match_date)
    when image_final_score is not null or image_matching_confidence is not null then image_match_date else metadata_match_date end"""
_FINAL = "case when image_final_score is null and metadata_final_score is null then null else coalesce(image_final_score, 0.0) * 0.6 + coalesce(metadata_final_score, 0.0) * 0.4 end"
_GROUPS = f"""select cast(s.lost_id as varchar) || ':' || cast(s.auction_id as varchar) as match_id, s.lost_id, s.auction_id, l.institution_classification, {_FINAL} as final_score, image_final_score as image_similarity,
    (metadata_final_score + metadata_confidence_score) / 2.0 as metadata_similarity, coalesce(rating, 0) as rating, coalesce(bookmarked, false) as bookmarked, {_DATE} as match_date
    from scores s join lost l on l.lost_id = s.lost_id where not (metadata_final_score is null and (image_final_score is not null or image_matching_confidence is not null) and image_match_date is not null and image_match_date > timestamp '{NOW}' - interval 1 day)"""


def _groups(v: dict) -> DataFrame:
    return matches.groups(v["scores"], v["lost"], now(), 60.0)


@query(f"select match_id, match_date, final_score, metadata_similarity, rating, bookmarked from ({_GROUPS}) g")
def flt2_to_flt5_match_groups(v):
    return _groups(v).select("match_id", "match_date", "final_score", "metadata_similarity", "rating", "bookmarked")


@query(f"select match_id from ({_GROUPS}) g where rating = 0 and not bookmarked and institution_classification = 'Brand#2'")
def flt6_rating_bookmark_source(v):
    return _groups(v).where(scoring.rating_filter("unrated", now(), 0, "false", "Brand#2")).select("match_id")


@query(f"select match_id from ({_GROUPS}) g where match_date < timestamp '{NOW}' - interval 31536000 seconds")
def flt8_expired(v):
    return _groups(v).where(scoring.rating_filter("expired", now(), 31_536_000, "true")).select("match_id")


@query(f"select match_id from ({_GROUPS}) g where exists (select 1 from lost l where l.lost_id = g.lost_id and l.title || ' ' || l.material || ' ' || l.institution_classification ilike '%ring PROMO%')")
def flt7_search(v):
    g = _groups(v)
    texts = g.select("match_id", "lost_id").join(v["lost"], "lost_id")
    return matches.searched(g, texts, ["title", "material", "institution_classification"], "ring PROMO").select("match_id")


@query("select o.l_orderkey, o.l_linenumber from lineitem o where (o.l_tax, o.l_returnflag) is distinct from (o.l_discount, case when l_quantity > 25 then 'A' else null end)")
def flt11_null_safe_difference(v):
    x = v["lineitem"].select("l_orderkey", "l_linenumber", F.struct(F.col("l_tax"), F.col("l_returnflag")).alias("o"), F.struct(F.col("l_discount").alias("l_tax"), F.when(F.col("l_quantity") > 25, "A").alias("l_returnflag")).alias("n"))
    return x.where(~F.col("o").eqNullSafe(F.col("n"))).select("l_orderkey", "l_linenumber")


@query("select page_id, regexp_matches(lower(url), '^https?://[^/]+') as safe from pages")
def flt12_safe_urls(v):
    return v["pages"].select("page_id", values.safe_url(F.col("url")).alias("safe"))


@query("select c_custkey, coalesce(nullif(trim(c_mktsegment), ''), c_name) as label from customer")
def flt14_first_filled(v):
    return v["customer"].select("c_custkey", values.first_filled(F.col("c_mktsegment"), F.col("c_name")).alias("label"))


@query(f"select match_id, final_score, match_date from ({_GROUPS}) g order by final_score desc nulls last, match_date desc nulls last, match_id limit 20 offset 40")
def st1_st2_page_by_similarity(v):
    return matches.page(_groups(v), matches.BEST, 3).select("match_id", "final_score", "match_date")


@query(f"select match_id, match_date from ({_GROUPS}) g order by match_date desc nulls last, match_id limit 20")
def st1_page_newest(v):
    return matches.page(_groups(v), matches.NEW, 1).select("match_id", "match_date")


@query(f"select match_id, match_date from ({_GROUPS}) g order by match_date asc nulls last, match_id limit 20")
def st1_page_oldest(v):
    return matches.page(_groups(v), matches.OLD, 1).select("match_id", "match_date")


@query(f"select count(*) as total, greatest(1, cast(ceil(count(*) / 20) as bigint)) as pages from ({_GROUPS}) g")
def x2_page_count(v):
    return matches.page_count(_groups(v))


@query(f"""select p.match_id, p.final_score, l.title from (select match_id, final_score, lost_id from ({_GROUPS}) g order by final_score desc nulls last, match_date desc nulls last, match_id limit 20) p join lost l on l.lost_id = p.lost_id""")
def st5_page_then_details(v):
    return matches.page(_groups(v), matches.BEST, 1, details=v["lost"].select("lost_id", "title"), on=["lost_id"]).select("match_id", "final_score", "title")


@query(f"""select auction_id, match_id, final_score from (select *, row_number() over (partition by auction_id order by final_score desc nulls last, match_date desc nulls last, match_id) as rn from ({_GROUPS}) g where final_score is not null) x
    where rn = 1 order by final_score desc nulls last, match_date desc nulls last, match_id limit 50""")
def wn1_st3_best_per_auction(v):
    return matches.best_per_auction(_groups(v), 50).select("auction_id", "match_id", "final_score")


_AT = f"(select match_id from ({_GROUPS}) g order by final_score desc nulls last, match_date desc nulls last, match_id limit 1 offset 10)"


def _tenth(v: dict) -> tuple[DataFrame, str]:
    g = _groups(v)
    rows = g.orderBy(*matches.order(matches.BEST)).offset(10).limit(1).select("match_id").collect()
    return g, rows[0][0] if rows else ""


@query(f"""select previous_id, next_id from (select match_id, lag(match_id) over w as previous_id, lead(match_id) over w as next_id from ({_GROUPS}) g window w as (order by final_score desc nulls last, match_date desc nulls last, match_id)) x where match_id = {_AT}""")
def wn2_neighbours(v):
    return matches.neighbours(*_tenth(v), matches.BEST)


@query(f"""select next_id as match_id from (select match_id, lead(match_id) over w as next_id from ({_GROUPS}) g window w as (order by final_score desc nulls last, match_date desc nulls last, match_id)) x where match_id = {_AT}""")
def x4_next_to_label(v):
    return matches.next_to_label(*_tenth(v), matches.BEST)


@query(f"select match_id from ({_GROUPS}) g where match_id = {_AT}")
def x1_match_by_key(v):
    g, key = _tenth(v)
    lost, _, auction = key.partition(":")
    return g.where((F.col("lost_id") == int(lost or 0)) & (F.col("auction_id") == int(auction or 0))).select("match_id")


@query(f"select match_id from ({_GROUPS}) g where rating = 0 and not bookmarked order by match_date desc nulls last, match_id limit 1")
def x5_review_queue(v):
    return _groups(v).where("rating = 0 and not bookmarked").orderBy(*matches.order(matches.NEW)).limit(1).select("match_id")


@query("select distinct institution_classification from lost")
def x3_source_options(v):
    return matches.source_options(v["lost"])


@query(f"""select count(*) as all_count, count(*) filter (where rating = 0 and not bookmarked) as new_count, count(*) filter (where bookmarked) as bookmarked_count, count(*) filter (where rating > 0) as accepted_count,
    count(*) filter (where match_date < timestamp '{NOW}' - interval 2592000 seconds) as expired_count, count(*) filter (where rating < 0) as discarded_count from ({_GROUPS}) g""")
def ag1_directory_counts(v):
    return matches.directory_counts(v["scores"], now(), 2_592_000)


# Joins


@query("select a.lost_id, b.auction_id from lost a join auction b on a.dating_start <= b.dating_end and b.dating_start <= a.dating_end")
def jn2_interval_overlap(v):
    """Each interval is dealt to the fifty-year buckets that it touches; a pair is taken in its first common one. Equal intervals are one class."""
    size = 50
    deal = lambda d, k, s, e: d.where(f"{s} <= {e}").select(k, F.col(s).alias(f"{k}_s"), F.col(e).alias(f"{k}_e"), F.explode(F.sequence(F.floor(F.col(s) / size), F.floor(F.col(e) / size))).alias("bucket"))
    a, b = deal(v["lost"], "lost_id", "dating_start", "dating_end"), deal(v["auction"], "auction_id", "dating_start", "dating_end")
    first = F.greatest("lost_id_s", "auction_id_s")
    x = blocks.class_pairs(a, b, ["bucket"], ("lost_id", "auction_id"), (["lost_id_s", "lost_id_e"], ["auction_id_s", "auction_id_e"]), (v["lost"].count(), v["auction"].count()))
    x = x.where((first <= F.least("lost_id_e", "auction_id_e")) & (F.floor(first / size) == F.col("bucket")))
    return blocks.listed(x.select("_left", "_right")).select("lost_id", "auction_id")


@query("select a.lost_id, b.auction_id from lost a join auction b on a.width > 0 and b.width > 0 and abs(a.width - b.width) <= 0.1 * greatest(a.width, b.width)")
def jn3_tolerance_band(v):
    """Logarithmic buckets of a tolerance's width: equal or neighbouring ones, then the exact test. Equal widths are one class."""
    bucket = lambda c: F.floor(F.log(c) / F.log(F.lit(1 / 0.9)))
    a = v["lost"].where("width > 0").select("lost_id", F.col("width").alias("w1"), F.explode(F.sequence(bucket(F.col("width")) - 1, bucket(F.col("width")) + 1)).alias("k"))
    b = v["auction"].where("width > 0").select("auction_id", F.col("width").alias("w2"), bucket(F.col("width")).alias("k"))
    x = blocks.class_pairs(a, b, ["k"], ("lost_id", "auction_id"), (["w1"], ["w2"]), (v["lost"].count(), v["auction"].count()))
    return blocks.listed(x.where(F.abs(F.col("w1") - F.col("w2")) <= 0.1 * F.greatest("w1", "w2")).select("_left", "_right")).select("lost_id", "auction_id")


@query("select w.auction_id from works w where exists (select 1 from links l where l.auction_id = w.auction_id)")
def jn8_semi(v):
    return v["works"].join(v["links"], "auction_id", "left_semi").select("auction_id")


@query("select w.auction_id from works w where not exists (select 1 from links l where l.auction_id = w.auction_id and not l.processed)")
def jn9_anti(v):
    return v["works"].join(v["links"].where("not processed"), "auction_id", "left_anti").select("auction_id")


@query("select l.lost_id, p.artist_id from lost l join people p on p.artist_id = l.artist_a union select l.lost_id, p.artist_id from lost l join people p on p.artist_id = l.artist_b")
def jn11_array_membership(v):
    return v["lost"].select("lost_id", F.explode(F.array_distinct(F.array("artist_a", "artist_b"))).alias("artist_id")).join(v["people"].select("artist_id"), "artist_id").select("lost_id", "artist_id")


@query("select c_custkey, s_suppkey from customer join supplier on lower(replace(c_name, 'Customer', 'x')) = lower(replace(s_name, 'Supplier', 'X'))")
def jn12_case_insensitive(v):
    a = v["customer"].select("c_custkey", F.lower(F.replace("c_name", F.lit("Customer"), F.lit("x"))).alias("k"))
    return a.join(v["supplier"].select("s_suppkey", F.lower(F.replace("s_name", F.lit("Supplier"), F.lit("X"))).alias("k")), "k").select("c_custkey", "s_suppkey")


@query("""select c_custkey, s_suppkey from (select c_custkey, s_suppkey, row_number() over (partition by c_custkey order by case when s_suppkey = c_custkey then 0 else 1 end, s_suppkey) as rn from customer join supplier on s_nationkey = c_nationkey) x where rn = 1""")
def jn13_preferred_row(v):
    rows = v["customer"].select("c_custkey", F.col("c_nationkey").alias("s_nationkey"))
    return catalogue.preferred_row(rows, v["supplier"], "c_custkey", "s_suppkey", "s_nationkey").select("c_custkey", "s_suppkey")


@query("select o_orderkey from orders where not exists (select 1 from supplier where s_suppkey = o_orderkey or (s_nationkey = o_custkey % 25 and s_suppkey % 10 = o_orderkey % 10))")
def jn14_disjunctive_anti(v):
    rows = v["orders"].select("o_orderkey", F.col("o_orderkey").alias("s_suppkey"), (F.col("o_custkey") % 25).cast("int").alias("s_nationkey"), (F.col("o_orderkey") % 10).alias("tail"))
    known = v["supplier"].select("s_suppkey", "s_nationkey", (F.col("s_suppkey") % 10).alias("tail"))
    return tables.unknown(rows, known, [["s_suppkey"], ["s_nationkey", "tail"]]).select("o_orderkey")


@query("""with recursive up as (select name, parent from tree where name in ('NATION_3', 'NATION_7') union select t.name, t.parent from tree t join up on t.name = up.parent) select distinct name from up""")
def jn18_ancestors(v):
    return trees.ancestors(v["tree"].where("name in ('NATION_3', 'NATION_7')").select("name"), v["tree"])


@query("""with w as (select auction_id, artist_id from works where priority = '1-URGENT'), p as (select artist_id, country_id from people where artist_id in (select artist_id from w)), c as (select n_nationkey, n_regionkey from nation where n_nationkey in (select country_id from p))
    select 'work' as kind, cast(auction_id as varchar) as id from w union select 'artist', cast(artist_id as varchar) from w union select 'country', cast(country_id as varchar) from p union select 'region', cast(n_regionkey as varchar) from c""")
def jn19_reference_closure(v):
    starts = {"work": v["works"].where("priority = '1-URGENT'").select("auction_id")}
    hops = [("work", v["works"], "auction_id", "artist_id", "artist"), ("artist", v["people"], "artist_id", "country_id", "country"), ("country", v["nation"], "n_nationkey", "n_regionkey", "region")]
    return inventory.reference_closure(starts, hops)


# Aggregates


@query("select title, count(*) as n from lost where trim(title) <> '' group by title having count(*) > 1")
def ag3_repeated_titles(v):
    return v["lost"].where("trim(title) <> ''").groupBy("title").agg(F.count("*").alias("n")).where("n > 1")


@query("select k, count(*) as n from (select distinct doc_id, unnest(string_split(lower(text), ' ')) as k from documents) x where k <> '' group by k")
def ag4_document_frequency(v):
    words = v["documents"].select("doc_id", F.explode(F.split(F.lower("text"), " ")).alias("k")).where("k <> ''").distinct()
    return words.groupBy("k").agg(F.count("*").alias("n"))


_DECILES = ", ".join(f"round(quantile_cont(x, 0.{k}), 6) as p{k}0" for k in range(1, 10))


@query(f"""select auction_id, cast(count(*) as double) as n, round(avg(x), 6) as mean, round(var_pop(x) / 1000000, 6) as var, round(stddev_pop(x), 6) as std, min(x) as min, max(x) as max, {_DECILES}, round(sum(x), 6) as sum
    from (select l_orderkey as auction_id, l_extendedprice as x from lineitem) y group by auction_id""")
def ag8_score_statistics(v):
    x = v["lineitem"].groupBy(F.col("l_orderkey").alias("auction_id")).agg(F.collect_list("l_extendedprice").alias("x"))
    s = x.select("auction_id", images.score_statistics(F.col("x")).alias("s")).select("auction_id", "s.*")
    return s.select("auction_id", "n", "min", "max", F.round(F.col("var") / 1000000, 6).alias("var"), *(F.round(c, 6).alias(c) for c in s.columns if c not in ("auction_id", "n", "min", "max", "var")))


@query("""select lost_id, auction_id, image_final_score, image_matching_confidence, image_blocking_similarity, best_image_file_id from (select l_partkey % 100 as lost_id, l_suppkey as auction_id, (1 - l_discount) * (l_quantity / 50) as image_final_score, 1 - l_discount as image_matching_confidence,
    l_quantity / 50 as image_blocking_similarity, l_orderkey as best_image_file_id, row_number() over (partition by l_partkey % 100, l_suppkey order by (1 - l_discount) * (l_quantity / 50) desc, 1 - l_discount desc, l_quantity desc, l_orderkey * 8 + l_linenumber) as rn from lineitem) x where rn = 1""")
def ag9_best_of_pair(v):
    x = v["lineitem"].select((F.col("l_partkey") % 100).alias("lost_id"), F.col("l_suppkey").alias("auction_id"), (1 - F.col("l_discount")).alias("confidence"), (F.col("l_quantity") / 50).alias("blocking_score"), F.col("l_orderkey").alias("auction_file_id"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("position"))
    return images.best_of_pair(x)


@query("select c_nationkey, list_sort(list(c_name)) as members from customer group by 1")
def ag10_ordered_array(v):
    return v["customer"].groupBy("c_nationkey").agg(F.array_sort(F.collect_list("c_name")).alias("members"))


@query("select source, max(run_at) as last_run from runs group by source")
def ag12_last_run(v):
    return v["runs"].groupBy("source").agg(F.max("run_at").alias("last_run"))


@query("select count(*) as n, cast(sum(octet_length(encode(to_json({'c_custkey': c_custkey, 'c_name': c_name})))) as bigint) as bytes from customer")
def ag18_byte_budget(v):
    return inventory.budget(v["customer"].select("c_custkey", "c_name"))


@query("select w.auction_id, coalesce(bool_and(l.processed and l.error_free), true) as complete from works w left join links l on l.auction_id = w.auction_id group by w.auction_id")
def ag19_all_done(v):
    done = v["links"].groupBy("auction_id").agg(F.bool_and(F.col("processed") & F.col("error_free")).alias("complete"))
    return v["works"].select("auction_id").join(done, "auction_id", "left").select("auction_id", F.coalesce("complete", F.lit(True)).alias("complete"))


@query("""select source, run_at, cast(total as bigint) as total, cast(greatest(0, total - coalesce(lag(total) over (partition by source order by run_at), 0)) as bigint) as new_entries from (select source, run_at, sum(total) as total from runs group by 1, 2) r""")
def ag21_run_deltas(v):
    runs = v["runs"].groupBy("source", "run_at").agg(F.sum("total").alias("total"))
    return series.run_deltas(runs, at="run_at")


@query("select label, i as dim, avg(x) as mean, quantile_disc(x, 0.5) as middle, min(x) as least, max(x) as most from (select label, unnest(embedding) as x, unnest(range(0, len(embedding))) as i from embeddings) e group by label, i")
def ag23_pooling(v):
    x = v["embeddings"].select("label", F.posexplode("embedding").alias("dim", "x"))
    return x.groupBy("label", F.col("dim").cast("long").alias("dim")).agg(F.avg("x").alias("mean"), F.expr("percentile_disc(0.5) within group (order by x)").cast("float").alias("middle"), F.min("x").alias("least"), F.max("x").alias("most"))


@query("select sum(auctions)::bigint as auctions, sum(lost)::bigint as lost from (select count(*) as auctions, 0 as lost from works union all select 0, count(*) from lost) x")
def ag2_count_pair(v):
    return v["works"].agg(F.count("*").alias("auctions")).crossJoin(v["lost"].agg(F.count("*").alias("lost")))


# Series


_DAILY = """select bucket, coalesce(sum(n) filter (where kind = 'total'), 0) as total, coalesce(sum(n) filter (where kind = 'image'), 0) as image, coalesce(sum(n) filter (where kind = 'metadata'), 0) as metadata from (
    select cast(created_at as date) as bucket, 'total' as kind, count(*) as n from works group by 1 union all select cast(image_at as date), 'image', count(*) from works where image_at is not null group by 1
    union all select cast(metadata_at as date), 'metadata', count(*) from works where metadata_at is not null group by 1) e group by bucket"""


@query(f"select bucket, cast(sum(total) over w as bigint) as total, cast(sum(image) over w as bigint) as image, cast(sum(metadata) over w as bigint) as metadata from ({_DAILY}) d window w as (order by bucket rows between unbounded preceding and current row)")
def wn3_so1_running_totals(v):
    return series.running_totals(series.daily_events(v["works"], {"total": "created_at", "image": "image_at", "metadata": "metadata_at"}), ["total", "image", "metadata"])


@query(f"""with e as (select 'image' as kind, image_at as at from works where image_at is not null union all select 'metadata', metadata_at from works where metadata_at is not null),
    h as (select unnest(generate_series(timestamp '{NOW}' - interval 23 hours, timestamp '{NOW}', interval 1 hour)) as bucket)
    select h.bucket, count(*) filter (where kind = 'image') as image, count(*) filter (where kind = 'metadata') as metadata from h left join e on date_trunc('hour', e.at) = h.bucket group by h.bucket""")
def so8_hourly(v):
    events = series.unpivoted(v["works"], {"image": "image_at", "metadata": "metadata_at"})
    return series.hourly(events, ["image", "metadata"], now())


@query("select date_trunc('hour', ts) as bucket, event_type, count(*) as n from events group by 1, 2")
def sm10_tumbling_counts(v):
    return micro.tumbling(v["events"], "ts", "event_type")


@query("select auction_id, 'image' as kind, image_at as at from works where image_at is not null union all select auction_id, 'metadata', metadata_at from works where metadata_at is not null")
def so5_unpivot(v):
    return v["works"].select("auction_id", F.expr("stack(2, 'image', image_at, 'metadata', metadata_at) as (kind, at)")).where("at is not null")


@query("select source, run_at, total from (select source, run_at, total, row_number() over (partition by source order by run_at desc, total desc) as rn from runs) x where rn = 1")
def wn5_latest_run(v):
    w = Window.partitionBy("source").orderBy(F.desc("run_at"), F.desc("total"))
    return v["runs"].withColumn("at", F.row_number().over(w)).where("at = 1").select("source", "run_at", "total")


@query("select source, run_at, case when total > 0 then round(least(total / 40, 1.0) * 100, 1) end as percent, round(total / 60, 3) as per_second, cast(round(greatest(0.0, 40 - total) / (total / 60)) as bigint) as seconds_left from runs")
def sm12_progress(v):
    return v["runs"].select("source", "run_at", series.progress(F.col("total"), F.lit(40), F.lit(60)).alias("p")).select("source", "run_at", "p.*")


# Vectors


@query("select vec_id, sqrt(list_sum(list_transform(embedding, lambda x: cast(x as double) * x))) as norm, len(embedding) as dims from embeddings")
def vs1_norms(v):
    return v["embeddings"].select("vec_id", vectors.norm(F.col("embedding")).alias("norm"), F.size("embedding").cast("long").alias("dims"))


@query("""with s as (select a.vec_id as query_id, b.vec_id as candidate_id, list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: cast(z[1] as double) * z[2])) / (sqrt(list_sum(list_transform(a.embedding, lambda x: cast(x as double) * x))) * sqrt(list_sum(list_transform(b.embedding, lambda x: cast(x as double) * x)))) as score
    from embeddings a cross join embeddings b where a.vec_id % 50 = 0), r as (select *, row_number() over (partition by query_id order by round(score, 9) desc, candidate_id) as rank from s) select query_id, candidate_id, cast(rank as bigint) as rank, round(score, 9) as score from r where rank <= 10""")
def vs2_top_k_cosine(v):
    found = vectors.top_k(v["embeddings"].where("vec_id % 50 = 0"), v["embeddings"], 10)
    return found.select("query_id", "candidate_id", F.col("rank").cast("long").alias("rank"), F.round("score", 9).alias("score"))


@query()
def vs4_regrouped_candidates(v):
    return vectors.regrouped(vectors.top_k(v["embeddings"].where("vec_id % 50 = 0"), v["embeddings"], 10))


@query()
def vs6_set_digest(v):
    return vectors.set_digest(v["images"], "image_id", "file_path")


# Table states


@query("select coalesce(n.k, o.p_partkey) as p_partkey, case when n.k is not null then n.size else o.p_size end as p_size, o.p_name from part o full join (select p_partkey + 5 as k, p_size * 2 as size from part where p_partkey % 3 = 0) n on n.k = o.p_partkey")
def snk1_upsert(v):
    old = v["part"].select("p_partkey", "p_size", "p_name")
    new = v["part"].where("p_partkey % 3 = 0").select((F.col("p_partkey") + 5).alias("p_partkey"), (F.col("p_size") * 2).alias("p_size"))
    return tables.upsert(old, new, ["p_partkey"])


@query("""with o as (select p_partkey as lost_id, p_size % 10 / 10.0 as f from part), n as (select p_partkey + 3 as lost_id, p_size % 7 / 10.0 as f from part)
    select coalesce(o.lost_id, n.lost_id) as lost_id, cast(case when o.lost_id is null then n.f when n.lost_id is null then o.f when n.f >= coalesce(o.f, -2) then n.f else o.f end as double) as image_final_score from o full join n on n.lost_id = o.lost_id""")
def snk2_upsert_if_better(v):
    shape = lambda k, f: v["part"].select(k.alias("lost_id"), F.lit(1).alias("auction_id"), f.alias("image_final_score"), F.lit(0.5).alias("image_matching_confidence"), F.lit(0.5).alias("image_blocking_similarity"), F.lit(1).alias("best_image_file_id"), F.lit(True).alias("_there"))
    out = images.upsert_if_better(shape(F.col("p_partkey"), F.col("p_size") % 10 / 10.0), shape(F.col("p_partkey") + 3, F.col("p_size") % 7 / 10.0))
    return out.select("lost_id", F.col("image_final_score").cast("double").alias("image_final_score"))


@query("select o_orderkey, case when exists (select 1 from lineitem where l_orderkey = o_orderkey and l_quantity > 49) then 'F' else o_orderstatus end as status from orders")
def snk3_mark_processed(v):
    rows = v["orders"].select("o_orderkey", "o_orderstatus", (F.col("o_orderstatus") == "F").alias("done"))
    delta = v["lineitem"].where("l_quantity > 49").select(F.col("l_orderkey").alias("o_orderkey"))
    hit = tables.marked(rows.withColumn("done", F.lit(False)), delta, ["o_orderkey"], "done")
    return hit.select("o_orderkey", F.when(F.col("done"), "F").otherwise(F.col("o_orderstatus")).alias("status"))


@query("select i.image_id, coalesce(i.is_embedded or d.v = i.image_id % 3, i.is_embedded) as is_embedded from images i left join (select distinct l_partkey as k, 1 as v from lineitem where l_quantity > 40) d on d.k = i.image_id")
def snk4_version_guarded_mark(v):
    rows = v["images"].select("image_id", (F.col("image_id") % 3).cast("int").alias("version"), "is_embedded")
    delta = v["lineitem"].where("l_quantity > 40").select(F.col("l_partkey").alias("image_id"), F.lit(1).alias("version"))
    return tables.marked(rows, delta, ["image_id", "version"], "is_embedded").select("image_id", "is_embedded")


@query("""select w.auction_id, coalesce(x.n, 0) as links from works w left join (select auction_id, count(*) as n, bool_and((processed and error_free) or image_id % 2 = 0) as ok from links group by 1) x on x.auction_id = w.auction_id where not w.processed and coalesce(x.ok, true)""")
def snk5_completed_works(v):
    return images.completed_works(v["works"], v["links"], v["images"].where("image_id % 2 = 0"))


@query("select trim(c_mktsegment) as segment, min(c_custkey) as id, false as created from customer where c_custkey < 40 group by 1 union all select segment, (select max(c_custkey) from customer where c_custkey < 40) + row_number() over (order by lower(segment)) as id, true from (select distinct trim(c_mktsegment) as segment from customer where lower(trim(c_mktsegment)) not in (select lower(trim(c_mktsegment)) from customer where c_custkey < 40)) x")
def snk13_get_or_create(v):
    known = v["customer"].where("c_custkey < 40").select(F.col("c_custkey").alias("id"), F.trim("c_mktsegment").alias("segment"))
    return tables.get_or_create(known, v["customer"].select(F.trim("c_mktsegment").alias("segment")), "id", "segment").select("segment", "id", "created")


@query("select o_orderkey, coalesce(s.s_suppkey, t.k) as s_suppkey from orders left join supplier s on s.s_suppkey = o_orderkey left join (select s_nationkey, min(s_suppkey) as k from supplier group by 1) t on t.s_nationkey = o_custkey % 25")
def snk14_lookup_by_precedence(v):
    rows = v["orders"].select("o_orderkey", F.col("o_orderkey").alias("a"), (F.col("o_custkey") % 25).cast("int").alias("s_nationkey"))
    table = v["supplier"].select(F.col("s_suppkey").alias("a"), "s_nationkey", "s_suppkey")
    return tables.by_precedence(rows, table, [["a"], ["s_nationkey"]], "s_suppkey").select("o_orderkey", "s_suppkey")


@query("""select coalesce(e.a, d.a) as a, coalesce(e.b, d.b) as b, case when e.a is null then 'add' when d.a is null then 'delete' else 'keep' end as action from (select distinct l_partkey as a, l_suppkey as b from lineitem where l_quantity < 30) e full join (select distinct l_partkey as a, l_suppkey as b from lineitem where l_quantity > 20) d on d.a = e.a and d.b = e.b""")
def snk16_reconcile_links(v):
    x = v["lineitem"].select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b"), "l_quantity")
    return tables.reconciled(x.where("l_quantity < 30"), x.where("l_quantity > 20"), ["a", "b"])


@query("select name, 'no parent' as fault from tree where false")
def snk17_tree_faults(v):
    return trees.tree_faults(v["tree"])


@query("select user_id, arg_max(event_type, (ts, event_type)) as event_type from events group by user_id")
def snk20_latest_review(v):
    return tables.latest(v["events"], ["user_id"], "ts", "event_type")


@query("""select n.k as p_partkey from (select p_partkey as k, case when p_partkey % 4 = 0 then p_size + 1 else p_size end as size, case when p_partkey % 6 = 0 then null else p_name end as name from part) n left join part o on o.p_partkey = n.k where o.p_size is distinct from n.size or o.p_name is distinct from n.name""")
def sm3_changed_inputs(v):
    new = v["part"].select("p_partkey", F.when(F.col("p_partkey") % 4 == 0, F.col("p_size") + 1).otherwise(F.col("p_size")).alias("p_size"), F.when(F.col("p_partkey") % 6 != 0, F.col("p_name")).alias("p_name"))
    return tables.changed(v["part"], new, "p_partkey", ["p_size", "p_name"])


@query("select auction_id, processed and not exists (select 1 from links l where l.auction_id = w.auction_id and not l.processed) as processed from works w")
def sm4_reopened(v):
    return invalidation.requeued(v["works"], v["links"].where("not processed"), ["processed"]).select("auction_id", "processed")


@query("select lost_id, auction_id, cast(null as double) as image_final_score, metadata_final_score from scores where metadata_final_score is not null")
def sm5_corpus_changed(v):
    return invalidation.without_image_scores(v["scores"]).select("lost_id", "auction_id", "image_final_score", "metadata_final_score")


@query("""select lost_id, auction_id, case when auction_id % 8 = 3 then null else image_final_score end as image_final_score from scores where not (auction_id % 8 = 3 and metadata_final_score is null)""")
def sm6_images_changed(v):
    return invalidation.without_image_scores(v["scores"], v["scores"].where("auction_id % 8 = 3")).select("lost_id", "auction_id", "image_final_score")


@query("select p_partkey, cast(p_size + case when p_partkey % 5 = 0 then 1 else 0 end as bigint) as version, p_partkey % 5 <> 0 as embedded from part")
def sm7_content_versions(v):
    old = v["part"].select("p_partkey", F.col("p_name").alias("digest"), F.col("p_size").cast("long").alias("version"), F.lit(True).alias("embedded"))
    new = v["part"].select("p_partkey", F.when(F.col("p_partkey") % 5 == 0, F.lit("new")).otherwise(F.col("p_name")).alias("digest"))
    return tables.versioned(old, new, "p_partkey").select("p_partkey", "version", "embedded")


@query(f"select auction_id, case when not processed and price > 200000 then timestamp '{NOW}' else image_at end as image_at from works")
def sm8_first_true_time(v):
    new = v["works"].withColumn("processed", F.col("processed") | (F.col("price") > 200000))
    return tables.first_true_times(v["works"], new, "auction_id", "processed", "image_at", now()).select("auction_id", "image_at")


# Inventories


@query("""with per as (select l.auction_id, bool_and(l.processed and l.error_free) as done, bool_and(coalesce(i.is_embedded, true)) as emb from links l left join images i on i.image_id = l.image_id group by 1),
    eligible as (select w.auction_id from works w join per on per.auction_id = w.auction_id where w.processed and done and emb and not exists (select 1 from scores s where s.auction_id = w.auction_id))
    select i.image_id, i.file_path, exists (select 1 from links l join eligible e on e.auction_id = l.auction_id where l.image_id = i.image_id) as has_candidate_auction, exists (select 1 from lost x where x.lost_id = i.image_id and x.lost_id % 2 = 0) as has_lost_reference,
    exists (select 1 from links l where l.image_id = i.image_id and l.auction_id not in (select auction_id from eligible)) as has_protected_auction_reference, exists (select 1 from scores s where s.best_image_file_id = i.image_id) as has_direct_score_reference from images i where not i.cleaned and i.file_path is not null""")
def jn10_cleanup_flags(v):
    return inventory.cleanup_flags(v["images"], v["links"], v["works"], v["scores"], v["lost"].where("lost_id % 2 = 0").select(F.col("lost_id").alias("image_id")))


@query("select file_path, bool_or(image_id % 4 = 0) and not bool_or(image_id % 9 = 0) as removable from images group by file_path")
def x9_cleanup_targets(v):
    off = F.lit(False)
    flags = v["images"].select("file_path", (F.col("image_id") % 4 == 0).alias("has_candidate_auction"), (F.col("image_id") % 9 == 0).alias("has_lost_reference"), off.alias("has_protected_auction_reference"), off.alias("has_direct_score_reference"))
    return inventory.cleanup_targets(flags)


@query("select c_custkey, case when c_custkey % 10 = 0 then 'missing' else 'different' end as fault from customer where c_custkey % 10 = 0 or c_custkey % 7 = 0")
def x11_hash_mismatches(v):
    a = v["customer"].select("c_custkey", F.sha2("c_name", 256).alias("hash"))
    b = v["customer"].where("c_custkey % 10 <> 0").select("c_custkey", F.sha2(F.when(F.col("c_custkey") % 7 == 0, "x").otherwise(F.col("c_name")), 256).alias("hash"))
    return inventory.hash_mismatches(a, b, "c_custkey")


@query("select sha256(string_agg(sha256(c_name), '' order by sha256(c_name))) as digest from customer")
def x15_operation_digest(v):
    return inventory.operation_digest(v["customer"].select(F.sha2("c_name", 256).alias("digest")))


@query("select n_name, sha256('{\"n_name\":\"' || n_name || '\",\"n_nationkey\":' || n_nationkey || ',\"n_regionkey\":' || n_regionkey || '}') as hash from nation")
def ag16_entity_hash(v):
    return v["nation"].select("n_name", inventory.entity_hash("n_nationkey", "n_name", "n_regionkey").alias("hash"))


@query("""with f as (select split_part(file_path, '/', 2) as dir, split_part(file_path, '/', 3) as name, sha256(file_path) as d from (select distinct file_path from images)), l2 as (select dir, sha256(string_agg(name || ':' || d, chr(10) order by name)) as d, count(*) as n from f group by dir),
    l1 as (select sha256(string_agg(dir || ':' || d, chr(10) order by dir)) as d, cast(sum(n) as bigint) as n from l2), l0 as (select sha256('img:' || d) as d, n from l1)
    select 'img/' || dir as path, d as digest, n as entries from l2 union all select 'img', d, n from l1 union all select '', d, n from l0""")
def ag17_tree_hashes(v):
    entries = v["images"].select(F.col("file_path").alias("path")).distinct().withColumn("digest", F.sha2("path", 256))
    return trees.tree_hashes(entries).where("path not like '%.jpg'")


@query()
def ag15_ordered_digest(v):
    return inventory.ordered_digest(v["customer"], ["c_custkey"])


@query("select c_custkey, cast(floor(coalesce(sum(b) over (order by c_custkey rows between unbounded preceding and 1 preceding), 0) / 5000) as bigint) as page from (select c_custkey, octet_length(encode(to_json({'c_custkey': c_custkey, 'c_name': c_name}))) as b from customer) x")
def st8_byte_pages(v):
    return inventory.byte_pages(v["customer"].select("c_custkey", "c_name"), ["c_custkey"], 5000).select("c_custkey", "page")


# Text


@query("select p_partkey, list_distinct([lower(p_type), lower(p_name)]) is not null and lower(p_type) <> lower(p_name) as two, lower(p_type) as first_token, lower(p_name) as second_token from part")
def nr19_tokens(v):
    t = values.tokens(F.concat(F.lit(" "), "p_type", F.lit(" und ("), "p_name", F.lit("), "), "p_type"))
    return v["part"].select("p_partkey", (F.size(t) == 2).alias("two"), F.try_element_at(t, F.lit(1)).alias("first_token"), F.try_element_at(t, F.lit(2)).alias("second_token"))


@query("select o_orderkey, cast(o_orderkey % 900 + 1100 as int) as start, cast(o_orderkey % 900 + 1100 as int) as end_year, true as matched from orders")
def nr1_dating_years(v):
    p = dating.parse_dating(F.concat(F.lit(" "), (F.col("o_orderkey") % 900 + 1100).cast("string")))
    return v["orders"].select("o_orderkey", p.alias("p")).select("o_orderkey", F.col("p.start").alias("start"), F.col("p.end").alias("end_year"), F.col("p.matched").alias("matched"))


@query("select o_orderkey, cast((o_orderkey % 20) * 100 as int) as start, cast((o_orderkey % 20) * 100 + 100 as int) as end_year from orders")
def nr1_dating_centuries(v):
    p = dating.parse_dating(F.concat((F.col("o_orderkey") % 20 + 1).cast("string"), F.lit(". Jh.")))
    return v["orders"].select("o_orderkey", p.alias("p")).select("o_orderkey", F.col("p.start").alias("start"), F.col("p.end").alias("end_year"))


@query("select l_orderkey, l_linenumber, round(l_quantity * 2.54, 3) as cm from lineitem")
def nr8_centimetres(v):
    return v["lineitem"].select("l_orderkey", "l_linenumber", values.centimetres(F.concat(F.col("l_quantity").cast("string"), F.lit(" in."))).alias("cm"))


@query("select l_orderkey, l_linenumber, l_extendedprice as amount from lineitem")
def pg2_money(v):
    return v["lineitem"].select("l_orderkey", "l_linenumber", values.money(F.concat(F.lit("USD "), F.format_number("l_extendedprice", 2))).alias("amount"))


@query("select o_orderkey, cast(o_orderdate as date) as day from orders")
def pg4_dates(v):
    return v["orders"].select("o_orderkey", values.any_date(F.date_format("o_orderdate", "dd.MM.yyyy")).alias("day"))


@query("select page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) as title from pages")
def pg1_titles(v):
    return v["pages"].select("page_id", markup.title_of(F.col("html")).alias("title"))


@query("""select page_id, list_sort(list_distinct(regexp_extract_all(html, '(?i)<a\\b[^>]*?\\bhref\\s*=\\s*["'']([^"'']+)["'']', 1))) as links from pages""")
def pg23_links(v):
    return v["pages"].select("page_id", F.array_sort(markup.links(F.col("html"))).alias("links"))


@query()
def pg17_label_values(v):
    return markup.merged_fields(markup.label_values(v["pages"]))


@query()
def pg1_plain_text(v):
    return v["pages"].select("page_id", markup.plain_text(F.col("html")).alias("text"))


@query()
def x29_best_segment(v):
    return v["pages"].select("page_id", markup.best_segment({"the": 1.0, "der": 1.0, "la": 1.0})(F.col("html")).alias("text"))


@query()
def nr12_artist_names(v):
    named = v["people"].select("complete_name").distinct().withColumn("n", names.artist_name(F.col("complete_name")))
    return v["people"].join(named, "complete_name").select("artist_id", "n.*")


@query("select event_id, cast(json_extract_string(props, '$.k') as varchar) as k from events")
def nr9_best_object(v):
    best = jsontext.best_json(("k",))(F.concat(F.lit("reply: {} "), F.col("props"), F.lit(" done")))
    return v["events"].select("event_id", F.get_json_object(best, "$.k").alias("k"))


@query("select l_orderkey, l_linenumber, replace(printf('%.2f%%', l_discount * 100), '.', ',') as percent, printf('%.2f', greatest(0.0, least(l_tax * 1000, 100.0))) as width from lineitem")
def pr1_percent_and_width(v):
    return v["lineitem"].select("l_orderkey", "l_linenumber", scoring.percent(F.col("l_discount")).alias("percent"), scoring.bar_width(F.col("l_tax") * 10).alias("width"))


@query("select c_custkey, case when c_custkey < 1000 then cast(c_custkey as varchar) else cast(c_custkey // 1000 as varchar) || '.' || lpad(cast(c_custkey % 1000 as varchar), 3, '0') end as label from customer")
def pr4_grouped_numbers(v):
    return v["customer"].select("c_custkey", values.grouped(F.col("c_custkey")).alias("label"))


@query("select p_partkey, case when length(p_type || ' ' || p_name) > 12 then rtrim(left(p_type || ' ' || p_name, 11)) || '…' else p_type || ' ' || p_name end as label from part")
def pg25_fitted(v):
    return v["part"].select("p_partkey", values.fitted(F.concat_ws(" ", "p_type", "p_name"), 12).alias("label"))


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: lost works against auction works."""
    return _linkage(views(spark, sf_dir))


# Catalogue states


@query("select artist_a as id from lost union select artist_b from lost union select artist_id from works")
def so2_distinct_ids(v):
    return catalogue.distinct_ids((v["lost"], "artist_a"), (v["lost"], "artist_b"), (v["works"], "artist_id"))


@query("""select 'lost' as kind, lost_id as id, title from lost union all select 'auction', auction_id, title from auction
    union all select 'people', artist_id, null from people union all select 'image', image_id, null from images""")
def so3_tagged_union(v):
    tables_ = {"lost": v["lost"].select(F.col("lost_id").alias("id"), "title"), "auction": v["auction"].select(F.col("auction_id").alias("id"), "title"), "people": v["people"].select(F.col("artist_id").alias("id")), "image": v["images"].select(F.col("image_id").alias("id"))}
    return catalogue.tagged_union(**tables_).select("kind", "id", "title")


@query("select source, list_sort(list(distinct total)) as totals from runs group by source")
def ag11_distinct_array(v):
    return v["runs"].groupBy("source").agg(F.array_sort(F.collect_set("total")).alias("totals"))


@query("select file_path, min(image_id) as image_id from images group by file_path")
def ag13_min_id_by_path(v):
    return v["images"].groupBy("file_path").agg(F.min("image_id").alias("image_id"))


@query("select count(distinct l_linenumber) as parts, count(*) as n_rows, count(distinct l_orderkey) as auctions from lineitem")
def ag14_ranking_summary(v):
    return catalogue.ranking_summary(v["lineitem"], "l_linenumber", "l_orderkey")


@query("""select platform, count(*) as files, sum(size) as bytes from (select distinct n_name as platform, file_path from links join images using (image_id)
    join works using (auction_id) join nation on n_nationkey = artist_id % 25 where file_path is not null) join (select file_path, max(image_id) * 100 as size from images where not cleaned group by file_path) using (file_path) group by platform""")
def ag20_x18_storage_stats(v):
    works = v["works"].select("auction_id", (F.col("artist_id") % 25).alias("platform_id"))
    platforms = v["nation"].select(F.col("n_nationkey").alias("platform_id"), F.col("n_name").alias("platform"))
    files = v["images"].where("not cleaned").groupBy("file_path").agg((F.max("image_id") * 100).alias("bytes"))
    return catalogue.storage_stats(catalogue.storage_paths(v["links"], v["images"], works, platforms), files, "platform")


@query("select 'lost' as source, count(*) as entries from lost union all select cast(platform_id as varchar), count(*) from auction group by platform_id")
def x20_entry_counts(v):
    return catalogue.entry_counts(v["lost"], v["auction"], "platform_id")


@query("select distinct l_partkey as lost_id, l_suppkey as auction_id from lineitem where not exists (select 1 from lineitem a where a.l_quantity > 5 and a.l_partkey = lineitem.l_partkey and a.l_suppkey = lineitem.l_suppkey)")
def x12_x13_not_advertised(v):
    rows = v["lineitem"].select(F.col("l_partkey").alias("lost_id"), F.col("l_suppkey").alias("auction_id"), "l_quantity")
    return catalogue.not_advertised(rows, rows.where("l_quantity > 5"), ["lost_id", "auction_id"])


@query(f"select image_id, case when exists (select 1 from lineitem where l_partkey = image_id and l_quantity > 48) then null else file_path end as file_path, case when exists (select 1 from lineitem where l_partkey = image_id and l_quantity > 48) then timestamp '{NOW}' end as cleaned_at from images")
def x10_cleaned(v):
    done = v["lineitem"].where("l_quantity > 48").select(F.col("l_partkey").alias("image_id"))
    return catalogue.cleaned(v["images"], done, now()).select("image_id", "file_path", "cleaned_at")


@query("select auction_id, platform_id from auction where platform_id is distinct from 3")
def x17_without_platform(v):
    return catalogue.without(v["auction"], "platform_id", 3).select("auction_id", "platform_id")


@query("select lost_id, auction_id from scores where metadata_final_score is null and image_final_score is not null and auction_id in (select o_orderkey * 8 + 4 from orders where o_orderstatus = 'F')")
def x8_image_only_pairs(v):
    batch = v["orders"].where("o_orderstatus = 'F'").select((F.col("o_orderkey") * 8 + 4).alias("auction_id"))
    return catalogue.image_only_pairs(v["scores"], batch)


@query("select auction_id, processed and auction_id not in (select l_orderkey from lineitem where l_quantity > 45) as processed from works")
def snk6_invalidated_metadata(v):
    hit = v["lineitem"].where("l_quantity > 45").select(F.col("l_orderkey").alias("auction_id"))
    return catalogue.invalidated_metadata(v["works"], hit).select("auction_id", "processed")


@query("""with c as (select distinct o_custkey as k, date '2001-06-01' as day from orders where o_orderstatus = 'F')
    select k, day from c union all select c_custkey, date '2001-06-01' from customer where c_custkey not in (select k from c)""")
def snk21_claimed(v):
    day = F.lit("2001-06-01").cast("date")
    claims = v["orders"].where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("k"), day.alias("day")).distinct()
    return catalogue.claimed(claims, day, v["customer"].select(F.col("c_custkey").alias("k")), "k")


@query("select source, run_at, total from runs where source = 2 order by run_at desc, source limit 10")
def st7_history(v):
    return catalogue.history(v["runs"], 10, "2").select("source", "run_at", "total")


@query("""select auction_id, list(image_id order by case when error_free then 0 else 1 end, image_id) as images, first(image_id order by case when error_free then 0 else 1 end, image_id) as primary_image
    from (select auction_id, image_id, bool_or(error_free) as error_free from links group by auction_id, image_id) group by auction_id""")
def st6_x27_primary_first(v):
    each = v["links"].groupBy("auction_id", "image_id").agg(F.bool_or("error_free").alias("is_primary"))
    x = each.groupBy("auction_id").agg(F.collect_list(F.struct("is_primary", F.col("image_id").alias("place"))).alias("own"))
    x = x.withColumn("images", F.transform(catalogue.primary_first(F.col("own")), lambda e: e["place"]))
    return x.select("auction_id", "images", F.element_at("images", 1).alias("primary_image"))


@query("select * exclude rn from (select l_partkey, l_orderkey, l_quantity, row_number() over (partition by l_partkey order by l_quantity desc, l_orderkey, l_linenumber) as rn from lineitem) where rn = 1")
def x22_first_per_key(v):
    return catalogue.first_per_key(v["lineitem"], ["l_partkey"], [F.desc("l_quantity"), F.col("l_orderkey"), F.col("l_linenumber")]).select("l_partkey", "l_orderkey", "l_quantity")


@query("select c_custkey, coalesce(nullif(trim(case when c_custkey % 3 = 0 then ' ' when c_custkey % 3 = 1 then null else c_name end), ''), nullif(trim(case when c_custkey % 2 = 0 then c_mktsegment end), ''), '-') as label from customer")
def pr3_label(v):
    name = F.when(F.col("c_custkey") % 3 == 0, " ").when(F.col("c_custkey") % 3 == 1, F.lit(None)).otherwise(F.col("c_name"))
    return v["customer"].select("c_custkey", catalogue.label_or("-", name, F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment"))).alias("label"))


@query("select o_orderkey, greatest(0.0, least(100.0, coalesce(try_cast(case when o_orderkey % 5 = 0 then 'x' else cast(o_orderkey % 150 - 20 as varchar) end as double), 50.0))) as weight from orders")
def flt16_clamped(v):
    text = F.when(F.col("o_orderkey") % 5 == 0, F.lit("x")).otherwise((F.col("o_orderkey") % 150 - 20).cast("string"))
    return v["orders"].select("o_orderkey", catalogue.clamped(text, 0.0, 100.0, 50.0).alias("weight"))


@query("select p_partkey, [(p_size + 0.5) / (p_size % 4 + 1) - 0.5, (p_partkey + 0.5) / (p_size % 4 + 1) - 0.5] as at from part")
def pr8_rescaled(v):
    return v["part"].select("p_partkey", catalogue.rescaled(F.array(F.col("p_size").cast("double"), F.col("p_partkey").cast("double")), (F.col("p_size") % 4 + 1).cast("double")).alias("at"))


@query("select p_partkey, case when p_partkey % 4 = 1 then '/data/' else 'img/' end || p_partkey as file_path from part")
def flt13_canonical_path(v):
    k = F.col("p_partkey") % 4
    start = F.when(k == 0, "img/").when(k == 1, "/data/").when(k == 2, " ./").otherwise("/store/img/")
    return v["part"].select("p_partkey", values.canonical_path(F.concat(start, "p_partkey"), "/store/img", "img").alias("file_path"))


@query("select p_partkey, case when p_partkey % 3 = 0 then '' else p_name || ' | ' || p_brand end as entries from part")
def nr11_flattened(v):
    some = F.array(F.concat(F.lit("  "), "p_name", F.lit("\n")), F.lit(" "), F.lit(None).cast("string"), F.col("p_brand"))
    return v["part"].select("p_partkey", values.flattened(F.when(F.col("p_partkey") % 3 != 0, some)).alias("entries"))


@query("""select c_custkey, case when c_nationkey % 3 = 2 then [n_name, r_name] else ['unknown'] end as names
    from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey""")
def nr20_dictionary_names(v):
    nations = v["nation"].join(v["region"], F.col("n_regionkey") == F.col("r_regionkey"))
    variants = nations.select(F.lower("n_name").alias("key"), F.array("n_name", "r_name").alias("names"))
    rows = v["customer"].join(v["nation"], F.col("c_nationkey") == F.col("n_nationkey"))
    k = F.col("c_nationkey") % 3
    raw = F.when(k == 1, "no such / word").when(k == 2, F.concat("n_name", F.lit(", no such; "), F.lower("n_name")))
    return catalogue.dictionary_names(rows.select("c_custkey", raw.alias("raw")), "raw", variants, "unknown").select("c_custkey", "names")


@query("select p_partkey, ['b/' || p_partkey, 'd/' || p_partkey] as urls from part")
def pg12_rendition_urls(v):
    def image(*renditions):
        url = lambda name: F.concat(F.lit(name), "p_partkey") if name else F.lit("")
        return F.array(*(F.struct(url(n).alias("url"), F.lit(s).alias("size"), F.lit(w).cast("int").alias("width"), F.col("p_size").alias("height")) for n, s, w in renditions))

    first = image(("a/", "large", 900), ("b/", "Extra_Large", 10), ("c/", "extralarge", None))
    images_ = F.array(first, image(("d/", "small", 1), ("e/", "other", 900)), first, image(("", "large", 1)), F.array().cast("array<struct<url:string,size:string,width:int,height:int>>"))
    return v["part"].select("p_partkey", values.rendition_urls(images_).alias("urls"))


@query("""select o_orderkey, '{' || case when o_orderkey % 3 = 0 then '' else '"lotNumber":"' || o_orderkey || '",' end
    || case when o_orderkey % 4 = 0 then '' else '"estimateLow":' || o_orderkey % 4 || ',' end || '"isUnsold":' || case when o_orderstatus = 'F' then 'true' else 'false' end || '}' as details from orders""")
def flt15_payload(v):
    lot = F.when(F.col("o_orderkey") % 3 == 0, " ").otherwise(F.col("o_orderkey").cast("string"))
    own = {"lotNumber": lot, "saleUrl": F.lit(None).cast("string"), "estimateLow": F.col("o_orderkey") % 4, "isUnsold": F.col("o_orderstatus") == "F"}
    return v["orders"].select("o_orderkey", values.payload(own, ("estimateLow",)).alias("details"))
