"""Queries over what pages show and what loads and look-ups choose."""

from __future__ import annotations

from pyspark.sql import functions as F

from findling.functions import charts
from findling.operators import catalogue
from findling.plans.registry import query


@query("""with c as (select event_type, cast(ts as date) as day, count(*) as n from events group by all), d as (select day, row_number() over (order by day) - 1 as i from (select distinct day from c)), k as (select count(*) as days from d),
    f as (select t.event_type, d.i, coalesce(c.n, 0) as n from (select distinct event_type from c) t cross join d left join c on c.event_type = t.event_type and c.day = d.day), m as (select max(n) as m, pow(10, floor(log10(max(n)))) as size from f),
    s as (select case when size >= m then size when 2 * size >= m then 2 * size when 5 * size >= m then 5 * size else 10 * size end as top from m)
    select event_type, cast(i as int) as place, round(case when days > 1 then 48.0::double + 656.0::double / (days - 1) * i else 376.0::double end, 2) as x, round(216.0::double - n::double / top * 200.0::double, 2) as y, top from f, k, s""")
def pr6_chart_lines(v):
    """Daily counts of each kind of event as lines under one greatest value."""
    days = v["events"].groupBy("event_type", F.col("ts").cast("date").alias("day")).agg(F.count("*").alias("n"))
    calendar = days.select("day").distinct().crossJoin(F.broadcast(days.select("event_type").distinct()))  # days by kinds of events
    full = calendar.join(days, ["day", "event_type"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    series = full.groupBy("event_type").agg(F.transform(F.array_sort(F.collect_list(F.struct("day", "n"))), lambda p: p["n"]).alias("n"))
    top = full.agg(charts.nice_max(F.max("n").cast("double")).alias("top"))
    drawn = series.crossJoin(F.broadcast(top)).select("event_type", "top", F.posexplode(charts.line(F.col("n"), F.col("top"))).alias("place", "p"))
    return drawn.select("event_type", "place", "p.x", "p.y", "top")


@query("select o_orderkey, case when k <= 6 then array_to_string(range(k), ',') else array_to_string([cast(round_even(i * (k - 1) / 5.0::double, 0) as int) for i in range(6)], ',') end as places from (select o_orderkey, o_orderkey % 40 as k from orders)")
def pr6_label_places(v):
    places = charts.label_places((F.col("o_orderkey") % 40).cast("int"))
    return v["orders"].select("o_orderkey", F.array_join(places.cast("array<string>"), ",").alias("places"))


@query("""select p_partkey, case when p_partkey % 5 = 0 then 0 else 2 end as n_matches, case when p_partkey % 5 = 0 then null else p_size + 2.0 end as last_x, case when p_partkey % 5 <> 0 then 0.5 end as first_score, p_partkey % 5 <> 0 and p_partkey % 3 = 0 as second_scored from part""")
def pr7_keypoints(v):
    """Payloads read back: points of both sides by place, scores as far as there are any."""
    number = F.col("p_size").cast("double")
    own, other = (F.array(*(F.array(number + i + shift, F.lit(1.0)) for i in range(3))) for shift in (0, 10))
    pairs = charts.pairs_of_first(F.when(F.col("p_partkey") % 5 == 0, F.array(F.lit(-1), F.lit(-1), F.lit(-1))).otherwise(F.array(F.lit(1), F.lit(-1), F.lit(0))))
    scores = F.when(F.col("p_partkey") % 3 == 0, F.array(F.lit(0.5), F.lit(0.25))).otherwise(F.array(F.lit(0.5)))
    got = v["part"].select("p_partkey", F.from_json(charts.keypoint_payload(own, other, pairs, scores), "match_count int, matches array<struct<auction:array<double>,lost:array<double>,score:double>>").alias("m"))
    return got.select("p_partkey", F.col("m.match_count").alias("n_matches"), F.get(F.get("m.matches", F.lit(1))["auction"], F.lit(0)).alias("last_x"), F.get("m.matches", F.lit(0))["score"].alias("first_score"), F.coalesce(F.get("m.matches", F.lit(1))["score"].isNotNull(), F.lit(False)).alias("second_scored"))


@query("""select o_orderkey, case o_orderkey % 5 when 0 then 'all' when 1 then 'unrated' when 2 then 'expired' when 3 then 'accepted' end as rating, case o_orderkey % 5 when 3 then 'newest' when 4 then 'newest' else 'similarity' end as sort,
    case o_orderkey % 5 when 1 then 'false' when 4 then 'true' when 3 then null else 'all' end as bookmarked, o_orderkey % 5 = 1 as new_matches from orders""")
def x6_list_defaults(v):
    k, none = F.col("o_orderkey") % 5, F.lit(None).cast("string")
    rating = F.when(k == 2, "expired").when(k == 3, "accepted")
    shown = charts.list_defaults(F.when(k == 0, "vase").otherwise(" "), rating, none, F.when(k == 4, "true").when(k == 2, "true"))
    return v["orders"].select("o_orderkey", shown.alias("d")).select("o_orderkey", "d.rating", "d.sort", "d.bookmarked", "d.new_matches")


@query("""select o_orderkey, case when o_orderkey % 3 = 0 then null else cast(o_totalprice as double) end as width, cast(o_custkey as int) as dating_start, case when o_orderkey % 4 = 0 then '' when o_orderkey % 4 = 1 then 'a,b' else '0,1,2,3,4,5,6,7,8,9' end as names from orders""")
def x7_shaped_rows(v):
    k = F.col("o_orderkey") % 4
    rows = v["orders"].select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, "wide").otherwise(F.col("o_totalprice").cast("string")).alias("width"), F.col("o_custkey").cast("string").alias("dating_start"), F.when(k == 1, F.array(F.lit("a"), F.lit("b"))).when(k > 1, F.sequence(F.lit(0), F.lit(14)).cast("array<string>")).alias("names"))
    return catalogue.shaped(rows, {"width": "double", "dating_start": "int", "names": "list"}, most=10).withColumn("names", F.array_join("names", ","))


@query("""select 'lost' as kind, p_partkey as id from part where p_partkey not in (select l_partkey from lineitem where l_quantity > 40) union all select 'auction', s_suppkey from supplier where s_suppkey not in (select l_suppkey from lineitem where l_quantity > 49)""")
def x13_extra_entities(v):
    """Requested works of both sides that the requested matches do not bring with them."""
    wanted = v["part"].select(F.lit("lost").alias("kind"), F.col("p_partkey").alias("id")).union(v["supplier"].select(F.lit("auction"), "s_suppkey"))
    match = lambda least: v["lineitem"].where(F.col("l_quantity") > least)
    return catalogue.extra_entities(wanted, "lost", match(40), "l_partkey").union(catalogue.extra_entities(wanted, "auction", match(49), "l_suppkey"))


@query("select o_orderkey, o_orderdate from orders where o_orderstatus = 'F' order by o_orderkey desc limit 1")
def x14_latest_applied(v):
    return catalogue.latest_applied(v["orders"], "o_orderkey", "o_orderstatus", "F").select("o_orderkey", "o_orderdate")


@query("select l_orderkey, l_linenumber, file_path, (select min(i.image_id) from images i where i.file_path = x.file_path) as image_id from (select l_orderkey, l_linenumber, 'img/Brand#11/' || cast(l_partkey % 700 as varchar) || '.jpg' as file_path from lineitem) x")
def x23_linked_by_path(v):
    rows = v["lineitem"].select("l_orderkey", "l_linenumber", F.concat(F.lit("img/Brand#11/"), (F.col("l_partkey") % 700).cast("string"), F.lit(".jpg")).alias("file_path"))
    return catalogue.linked_by_path(rows, v["images"]).select("l_orderkey", "l_linenumber", "file_path", "image_id")


@query("""select n_name as name, case when n_nationkey % 4 = 0 then 'world' else r_name end as parent, case when n_nationkey % 4 = 0 then 1 else 2 end as step, case when n_nationkey % 5 = 1 then 'insert' else 'update' end as what
    from nation join region on n_regionkey = r_regionkey where n_nationkey % 5 = 1 or n_nationkey % 4 = 0 union all select 'moon', null, 0, 'insert'""")
def snk17_tree_changes(v):
    """A dictionary is loaded over one that lacks every fifth nation and has others elsewhere: only what differs is written, roots first."""
    key = v["nation"].select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("k"))
    tree = v["tree"].join(key, "name", "left")
    old = tree.where("k is null or k % 5 <> 1").select("name", "parent")
    new = tree.select("name", F.when(F.col("k") % 4 == 0, "world").otherwise(F.col("parent")).alias("parent")).union(v["region"].sparkSession.createDataFrame([("moon", None)], "name string, parent string"))
    return catalogue.tree_changes(old, new)
