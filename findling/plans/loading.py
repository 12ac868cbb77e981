"""Queries over dumps and replays, titles as sites print them, broken answers and pages of components."""

from __future__ import annotations

from pyspark.sql import functions as F

from findling.functions import answers, components, tabs, titles
from findling.operators import catalogue, loads, transfer
from findling.plans.registry import query
from findling.sources.scratch import folder

LIVE = "not coalesce(cleaned, false) and file_path is not null"


@query("""select l.auction_id, l.image_id, case when not i.cleaned and i.file_path is not null then false else l.processed end as processed, case when not i.cleaned and i.file_path is not null then false else l.error_free end as error_free
    from links l left join images i on i.image_id = l.image_id""")
def snk7_replayed_links(v):
    return loads.replayed(v["links"], v["images"], v["works"], LIVE)[0]


@query("""select w.auction_id, case when h.auction_id is not null then false else processed end as processed, case when h.auction_id is not null and processed then null else image_at end as image_at
    from works w left join (select distinct auction_id from links l join images i on i.image_id = l.image_id where not i.cleaned and file_path is not null) h on h.auction_id = w.auction_id""")
def snk7_replayed_works(v):
    return loads.replayed(v["links"], v["images"], v["works"], LIVE)[1].select("auction_id", "processed", "image_at")


@query("""select 'country' as name, 0 as place, count(*) as n_rows, 'n_nationkey,n_name,n_regionkey' as columns, sum(n_nationkey) as keys from nation union all select 'artist', 1, count(*), 'artist_id,complete_name,segment,country_id', sum(artist_id) from people
    union all select 'nobody', 2, 0, 'artist_id', null union all select 'lost_work', 3, count(*), 'lost_id,title,material', sum(lost_id) from lost""")
def snk24_whole_dump(v):
    """The lost side's tables are dumped, parents first, and read back."""
    tables = {"country": v["nation"].select("n_nationkey", "n_name", "n_regionkey"), "artist": v["people"], "nobody": v["people"].where("false").select("artist_id"), "lost_work": v["lost"].select("lost_id", "title", "material")}
    spark, at = v["lost"].sparkSession, folder(v["lost"].sparkSession)
    told = loads.dump(tables, at)
    sums = None
    for name, df in loads.dumped(spark, at).items():
        own = df.agg(F.sum(df.columns[0]).cast("long").alias("keys")).select(F.lit(name).alias("name"), "keys")
        sums = own if sums is None else sums.union(own)
    return told.join(sums, "name").select("name", "place", "n_rows", F.array_join("columns", ",").alias("columns"), "keys")


@query("select artist_id, case when segment = 'BUILDING' then complete_name else 'kept' end as complete_name, case when segment = 'BUILDING' then country_id end as country_id from people union all select -1, 'own', null")
def snk24_loaded_over(v):
    """A dump goes over a table that lacks one segment, has a row of its own and other names: only what is missing comes."""
    people, at = v["people"], folder(v["people"].sparkSession)
    loads.dump({"artist": people}, at)
    there = people.where("segment <> 'BUILDING'").select("artist_id", F.lit("kept").alias("complete_name"), F.lit(None).cast("long").alias("country_id"))
    there = there.union(people.sparkSession.createDataFrame([(-1, "own", None)], there.schema))
    return loads.loaded(there, loads.dumped(people.sparkSession, at)["artist"], "artist_id")


@query("""with known as (select file_path, min(image_id) as image_id from images where image_id % 2 = 0 group by 1),
    named as (select distinct p_partkey as lost_id, unnest(['img/' || p_brand || '/' || p_partkey % 700 || '.jpg', 'new/' || p_size || '.jpg', 'new/' || p_size || '.jpg']) as file_path from part where p_partkey % 6 <> 0),
    fresh as (select file_path, (select max(image_id) from known) + row_number() over (order by file_path) as image_id from (select distinct file_path from named where file_path not in (select file_path from known)))
    select lost_id, f.image_id, f.file_path, f.fresh from named join (select *, false as fresh from known union all select *, true from fresh) f on f.file_path = named.file_path""")
def snk24_paths_as_images(v):
    """Works' lists of paths become files, where there are none yet, and links."""
    path = F.concat(F.lit("img/"), "p_brand", F.lit("/"), (F.col("p_partkey") % 700).cast("string"), F.lit(".jpg"))
    other = F.concat(F.lit("new/"), F.col("p_size").cast("string"), F.lit(".jpg"))
    works = v["part"].select(F.col("p_partkey").alias("lost_id"), F.when(F.col("p_partkey") % 6 != 0, F.array(path, other, F.lit(None).cast("string"), other)).alias("img_paths"))
    files = v["images"].where("image_id % 2 = 0").groupBy("file_path").agg(F.min("image_id").alias("image_id"))
    fresh, links = loads.paths_as_images(works, files)
    every = files.select("image_id", "file_path", F.lit(False).alias("fresh")).union(fresh.select("image_id", "file_path", F.lit(True)))
    return links.join(every, "image_id").select("lost_id", "image_id", "file_path", "fresh")


@query("""with t as (select p_partkey, case p_partkey % 8 when 0 then p_name when 5 then p_name || ' (1800-1850)' when 7 then p_brand end as marked, case when p_partkey % 4 < 2 then p_name end as signed, case when p_partkey % 4 = 0 then p_name when p_partkey % 4 = 3 then p_type end as bracketed,
      case p_partkey % 5 when 0 then p_name when 2 then upper(p_name) || ' (verso)' when 3 then p_type end as headline, p_partkey % 8 in (0, 5) and p_partkey % 5 in (0, 2) as same, p_name as shown from part)
    select p_partkey, marked, signed, bracketed, case when marked is not null and not same then headline end as title, same, shown from t""")
def pg16_clean_titles(v):
    """Artists and titles as three kinds of sites print them, over all parts."""
    name, kind, id_ = F.col("p_name"), F.col("p_type"), F.col("p_partkey").cast("string")
    pick = lambda n, *texts: F.get(F.array(*(t if hasattr(t, "alias") else F.lit(t) for t in texts)), F.col("p_partkey").cast("int") % n)
    rows = v["part"].withColumns({
        "marked": titles.marked_artist(pick(8, F.concat(F.lit("  "), name, F.lit("  *+")), "undefined#", F.concat(F.lit("Künstler um "), name), " ANONYM ", "**", F.concat(name, F.lit(" (1800-1850)")), F.lit(None).cast("string"), F.concat(F.col("p_brand"), F.lit("-")))),
        "signed": titles.signed_artist(pick(4, name, F.regexp_replace(name, " ", " \t "), "N/A", F.concat(name, F.lit(", Unidentified Signature")))),
        "bracketed": titles.bracketed_artist(pick(4, F.concat(name, F.lit(" [after] (1700)")), "Unbekannt (Maler)", "[lost]", F.concat(F.lit("(x)"), kind))),
        "headline": pick(5, name, "Ohne Titel", F.concat(F.upper(name), F.lit(" (verso)")), kind, "  "),
        "shown": titles.display_title(F.concat(id_, F.lit("A/12 bis – "), name, F.lit(" ;."))),
    })
    return rows.select("p_partkey", "marked", "signed", "bracketed", titles.title(F.col("headline"), F.col("marked")).alias("title"), titles.same_identity(F.col("headline"), F.col("marked")).alias("same"), "shown")


@query("""select o_orderkey, case o_orderkey % 8 when 1 then 'brackets' when 2 then 'objects' when 7 then null else 'whole' end as way, case when o_orderkey % 8 in (3, 6) then 2 when o_orderkey % 8 = 2 then 3 when o_orderkey % 8 < 7 then 1 end as n,
    case when o_orderkey % 8 < 7 then o_orderkey end as first_id, case when o_orderkey % 8 = 4 then '{"id": ' || o_orderkey || '}' when o_orderkey % 8 = 2 then '{"id": 3, "x": {"y": 4}}' end as last from orders""")
def nr6_recovered_answers(v):
    """Answers with each of the faults, with talk around them, cut short, and without an array."""
    k = F.col("o_orderkey").cast("string")
    forms = ('```json\n[{"id": K, "kind": "year"}]\n```', 'Here: [{"id": K}] done', 'x {"id": K} {"id": 2, "x": {}} ] {oops} {"id": 3, "x": {"y": 4}} [{"id": ', '[{"id": K, "x": [1]), {"id": 2}]', '[{"artist": "x", "artist_birth_year": "1800", "id": K}]', '[{"id": K"}]', '[{"id": K, "x": [1]}}, {"id": 3}]', "none [ here")
    made = F.replace(F.get(F.array(*map(F.lit, forms)), F.col("o_orderkey").cast("int") % 8), F.lit("K"), k)
    got = v["orders"].select("o_orderkey", answers.recovered(made).alias("a"))
    last = F.when((F.col("o_orderkey") % 8).isin(2, 4), F.try_element_at("a.objects", F.lit(-1)))
    return got.select("o_orderkey", "a.way", F.when(F.col("a.objects").isNotNull(), F.size("a.objects")).alias("n"), F.get_json_object(F.get("a.objects", F.lit(0)), "$.id").cast("long").alias("first_id"), last.alias("last"))


PICKS = (
    components.Pick("title", "h1.title"), components.Pick("title", "h1.title-text"), components.Pick("artist", "span.artist"), components.Pick("text", ".body-text", joint="\n"), components.Pick("date", "time[datetime]", "#facts", "datetime"), components.Pick("image", "img", "div.gallery", "src"),
    components.Pick("head", "[slot=header]", "fold-item"), components.Pick("body", ".fold-text", "fold-item", joint="\n"), components.Pick("body", "[slot=content]", "fold-item", joint="\n"),
)

_PAGES = """select p_partkey, '<div class="gallery big"><img alt="x"><img src="/a/' || cast(p_partkey as varchar(9)) || '.jpg"><img src="/b"></div><h1 class="' || case when p_partkey % 3 = 0 then 'title"> <!-- x --> </h1><h1 class="title-text' else 'big title' end || '">' || p_name || ' <em>&amp; co</em></h1>' ||
    case when p_partkey % 2 = 0 then '<span class=artist>' || p_brand || '</span></b>' else '' end || '<p class="body-text">One<br>two <script>three</script></p><table id="facts"><tr><td><time>soon</time><time datetime="2020-01-0' || cast(1 + p_size % 9 as varchar(1)) || '">then</time></table><time datetime="x">' ||
    '<fold-item><div slot="header">Provenance</div><div slot="content">not this</div><div class="fold-text">' || p_type || '<p>then sold</p></div></fold-item><fold-item><b slot="header"> Exhibition </b><div slot="content">' || p_brand || '</div></fold-item><fold-item><b slot=header>Literature</b></fold-item>' as html from part"""


@query("""select p_partkey, 'title' as field, p_name || ' & co' as value from part union all select p_partkey, 'artist', p_brand from part where p_partkey % 2 = 0 union all select p_partkey, 'text', 'One' || chr(10) || 'two' from part union all select p_partkey, 'date', '2020-01-0' || (1 + p_size % 9) from part
    union all select p_partkey, 'image', '/a/' || p_partkey || '.jpg' from part union all select p_partkey, 'provenance', p_type || chr(10) || 'then sold' from part union all select p_partkey, 'exhibited', p_brand from part""")
def pg21_page_details(v):
    """Fields of pages made of all parts: by element and class, in an element, of an attribute, and sections by their heads."""
    pages = v["part"].sparkSession.sql(_PAGES.replace("from part", "from {part}"), part=v["part"])
    found = components.page_values(pages, PICKS, "p_partkey")
    plain = components.fields(found.where("field not in ('head', 'body')"), "p_partkey")
    return plain.union(components.sections(found, "head", "body", {"provenance": "provenance", "literature": "literature", "exhibited": "exhibited", "exhibition": "exhibited"}, "p_partkey"))


@query("""with t as (select o_orderkey as k, o_custkey as c from orders) select k as o_orderkey, case when k % 5 = 0 then 'header' when k % 5 < 3 then 'components' end as source, case when k % 5 < 3 then k end as id,
    case when k % 5 = 0 then 'S' || c when k % 5 = 1 then 'A' || c when k % 5 = 2 then 'own' end as sale_id, case when k % 5 in (1, 2) then 'Paris' end as place from t""")
def pg21_component_lots(v):
    """Lots that scripts of pages assign: with a numbered header, with components only, with an auction that says nothing, with a list where an object is due, and cut short."""
    forms = (
        'var x={}; window.parts = {"lots": 1}; window.parts.lotHeader_12 = {"data": {"lots": [{"id": K, "t": "a };"}], "sale": {"sale_id": "SC"}}};',
        'window.parts = {"lots": {"data": {"lots": [{"id": K, "sale": {"sale_id": "own", "sale_location": "Paris"}}]}}, "auction": {"data": {"sale_id": "AC", "other": 1, "sale_location": ""}}};',
        'window.parts = {"lots": {"data": {"lots": [{"id": K, "sale": {"sale_id": "own", "sale_location": "Paris"}}, {"id": 0}]}}, "auction": [1]};',
        'window.parts.lotHeader_1 = {"data": {"lots": []}}; window.parts = {"lots": {"data": {"lots": ["K"]}}};',
        'window.parts.lotHeader_1 = {"data": {"lots": [{"id": K',
    )
    page = F.replace(F.replace(F.get(F.array(*map(F.lit, forms)), F.col("o_orderkey").cast("int") % 5), F.lit("K"), F.col("o_orderkey").cast("string")), F.lit("C"), F.col("o_custkey").cast("string"))
    pages = v["orders"].select("o_orderkey", F.concat(F.lit("<html><script>"), page, F.lit("</script>")).alias("html"))
    got = components.component_lots(pages, "window.parts", "o_orderkey")
    return got.select("o_orderkey", "source", F.get_json_object("lot", "$.id").cast("long").alias("id"), F.try_element_at("sale", F.lit("sale_id")).alias("sale_id"), F.try_element_at("sale", F.lit("sale_location")).alias("place"))


#: A catalogue whose works name artists, platforms, dictionary entries and lots, and another one that holds part of it under ids of its own.
_WORKS = "select o_orderkey as auction_id, o_custkey as artist_id, cast(o_orderkey % 25 as int) as platform_id, case when o_orderkey % 4 = 3 then null else 'L' || cast(o_orderkey as varchar(20)) end as lot_id, case when o_orderkey % 4 = 3 then 'u/' || cast(o_orderkey as varchar(20)) end as lot_url, 'NATION_' || cast(o_custkey % 5 as varchar(2)) as term from orders"
_PATHS = "select p_partkey as image_id, case p_partkey % 4 when 0 then './' when 1 then '/srv/lots/' when 2 then 'data/images/' else '/other/' end || 'i' || cast(p_partkey % 900 as varchar(9)) as file_path from part"
_SELECTED = f"w as (select * from ({_WORKS}) where auction_id in (select auction_id from scores))"


def _catalogues(v):
    spark, nation = v["orders"].sparkSession, v["nation"].withColumn("n_nationkey", F.col("n_nationkey").cast("int"))
    works = spark.sql(_WORKS.replace("from orders", "from {orders}"), orders=v["orders"])
    works = works.withColumn("names", F.array("term")).drop("term")
    images = spark.sql(_PATHS.replace("from part", "from {part}"), part=v["part"])
    own = {"works": works, "artists": v["people"].select("artist_id", "complete_name"), "platforms": nation.select(F.col("n_nationkey").alias("platform_id"), F.col("n_name").alias("name")), "dictionary": v["tree"], "images": images, "links": v["links"].select("auction_id", "image_id").distinct()}
    shifted = lambda c, when, by: F.when(when, F.col(c) + by).otherwise(F.col(c)).alias(c)
    third, even = F.col("artist_id") % 3, F.col("platform_id") % 2 == 0
    known, other = F.col("auction_id") % 10 < 2, F.col("auction_id") % 10 == 1
    there = {
        "artists": own["artists"].where(third != 2).select(shifted("artist_id", third == 0, 10_000_000), F.when(third == 0, F.upper("complete_name")).otherwise(F.col("complete_name")).alias("complete_name")),
        "platforms": own["platforms"].where(even).select(shifted("platform_id", even, 100), F.lower("name").alias("name")),
        "dictionary": v["tree"].where("parent is null or parent = 'world'"),
        "works": works.where(known).select(shifted("auction_id", other, 50_000_000), shifted("platform_id", even, 100), "lot_id", "lot_url"),
        "images": images.where("image_id % 8 = 2").groupBy("file_path").agg(F.min("image_id").alias("image_id")),
    }
    return own, there


@query(f"""with recursive {_SELECTED}, up(name) as (select distinct term from w union select t.parent from tree t join up on up.name = t.name where t.parent is not null)
    select 'works' as kind, cast(auction_id as varchar) as id from w union all select 'artists', cast(artist_id as varchar) from people where artist_id in (select artist_id from w) union all select 'platforms', cast(n_nationkey as varchar) from nation where n_nationkey in (select platform_id from w)
    union all select 'dictionary', name from tree where name in (select name from up) union all select 'images', cast(image_id as varchar) from ({_PATHS}) where image_id in (select image_id from links where auction_id in (select auction_id from w))
    union all select distinct 'links', auction_id || '-' || image_id from links where auction_id in (select auction_id from w)""")
def snk23_exported(v):
    """What the works that have a score lead to."""
    out = None
    for kind, df in transfer.exported(_catalogues(v)[0], v["scores"], "/srv/lots", "./data/images/").items():
        keys = ["auction_id", "image_id"] if kind == "links" else df.columns[:1]
        own = df.select(F.lit(kind).alias("kind"), F.concat_ws("-", *(F.col(k).cast("string") for k in keys)).alias("id"))
        out = own if out is None else out.union(own)
    return out


def _imported(v):
    own, there = _catalogues(v)
    return transfer.imported(transfer.exported(own, v["scores"], "/srv/lots", "./data/images/"), there)


@query(f"""with {_SELECTED} select auction_id, case when artist_id % 3 = 0 then artist_id + 10000000 else artist_id end as artist_id, case when platform_id % 2 = 0 then platform_id + 100 else platform_id end as platform_id, coalesce(lot_id, lot_url) as lot from w where auction_id % 10 > 1""")
def snk23_imported_works(v):
    """Works that the other catalogue has neither by id nor by lot, with its ids."""
    return _imported(v).works.select("auction_id", "artist_id", "platform_id", F.coalesce("lot_id", "lot_url").alias("lot"))


@query(f"""with {_SELECTED} select 'artist' as kind, cast(artist_id as varchar) as id from people where artist_id % 3 = 2 and artist_id in (select artist_id from w) union all select 'platform', cast(n_nationkey as varchar) from nation where n_nationkey % 2 = 1 and n_nationkey in (select platform_id from w)
    union all select 'dictionary', n_name from nation where n_name in (select term from w)""")
def snk23_imported_names(v):
    new = _imported(v)
    return new.artists.select(F.lit("artist").alias("kind"), F.col("artist_id").cast("string").alias("id")).union(new.platforms.select(F.lit("platform"), F.col("platform_id").cast("string"))).union(new.dictionary.select(F.lit("dictionary"), "name"))


@query(f"""with {_SELECTED}, i as (select image_id, case image_id % 4 when 3 then file_path else 'data/images/' || regexp_replace(file_path, '^.*/', '') end as file_path from ({_PATHS})), known as (select file_path, min(image_id) as image_id from i where image_id % 8 = 2 group by 1),
    x as (select distinct l.auction_id, i.file_path from links l join i on i.image_id = l.image_id where l.auction_id in (select auction_id from w where auction_id % 10 > 1)),
    fresh as (select file_path, (select max(image_id) from known) + row_number() over (order by file_path) as image_id from (select distinct file_path from x where file_path not in (select file_path from known)))
    select auction_id, image_id from x join (select * from known union all select file_path, image_id from fresh) f on f.file_path = x.file_path""")
def snk23_imported_links(v):
    """Links of the works taken over, to files that the other catalogue has by path or gets."""
    return _imported(v).links


_TABS = """select p_partkey, '<div class="ui menu"><a class="item" data-tab="about">About this lot, its makers and the places it has been to</a></div>' || case p_partkey % 3 when 0 then '<div class="ui tab segment" data-tab="about"><p>' || p_name || '</p>' when 1 then '<div data-tab="about">no</div><div class="pane" data-tab="about"><b>' || p_name || '</b>' else '<div data-tab="other">' end ||
    case p_partkey % 4 when 0 then '<br>Provenienz:<br>' || p_brand when 1 then '<p>Provenance: ' || p_brand || '</p><p>PROVENANCE ' || upper(p_brand) || '</p>' when 2 then '<p>Provenance</p>' else '' end || '<p>' || p_type || '</p></div>' as html from part"""


@query("""select p_partkey, case when p_partkey % 3 < 2 then p_name || case when p_partkey % 4 = 2 then '' else chr(10) || p_type end else 'About this lot, its makers and the places it has been to' end as description,
    case when p_partkey % 3 < 2 then case p_partkey % 4 when 0 then p_brand when 1 then p_brand when 2 then p_type end end as provenance from part""")
def x29_tab_segments(v):
    """Pages made of all parts: the segment among buttons and lesser ones of its name, its lines told apart."""
    pages = v["part"].sparkSession.sql(_TABS.replace("from part", "from {part}"), part=v["part"])
    return pages.select("p_partkey", tabs.tab_segment("about")(F.col("html")).alias("t")).select("p_partkey", "t.description", "t.provenance")


@query("""with t as (select p_partkey as image_id, case when p_partkey % 5 = 0 then upper(p_name) else p_name end || p_partkey // 2 as file_path, p_partkey % 3 = 0 as fresh from part) select lower(file_path) as path_key, count(distinct file_path) as spellings from t group by 1 having count(distinct file_path) > 1 and bool_or(fresh)""")
def x28_folded_path_clashes(v):
    """New paths that differ from others in case alone."""
    number = F.col("p_partkey")
    images = v["part"].select(number, F.concat(F.when(number % 5 == 0, F.upper("p_name")).otherwise(F.col("p_name")), F.expr("p_partkey div 2").cast("string")).alias("file_path"))
    return transfer.folded_path_clashes(images.where("p_partkey % 3 = 0"), images.where("p_partkey % 3 <> 0"))


@query("select distinct p_type as name, p_brand as raw from part where p_size % 10 <> 0 and p_partkey % 7 <> 0 and not exists (select 1 from part o where o.p_brand like '%2' and o.p_size > 5 and o.p_type = part.p_type and o.p_brand = part.p_brand)")
def snk18_variants_added(v):
    """Variants of all parts, some without a name or a spelling, over those of some brands' larger parts."""
    part = v["part"]
    new = part.select(F.when(F.col("p_size") % 10 != 0, F.col("p_type")).alias("name"), F.when(F.col("p_partkey") % 7 != 0, F.col("p_brand")).otherwise("").alias("raw"))
    return loads.variants_added(new, part.where("p_brand like '%2' and p_size > 5").select(F.col("p_type").alias("name"), F.col("p_brand").alias("raw")), "name", "raw")


@query("""select c_custkey, case when c_custkey % 4 > 1 then ['own'] when c_nationkey % 3 = 2 then [n_name, r_name] else ['unknown'] end as names
    from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey""")
def snk19_backfilled(v):
    """Dictionary names of all customers' texts, only where their lists are null or empty."""
    nations = v["nation"].join(v["region"], F.col("n_regionkey") == F.col("r_regionkey"))
    variants = nations.select(F.lower("n_name").alias("key"), F.array("n_name", "r_name").alias("names"))
    rows = v["customer"].join(v["nation"], F.col("c_nationkey") == F.col("n_nationkey"))
    raw = F.when(F.col("c_nationkey") % 3 == 2, F.concat("n_name", F.lit("; no such"))).when(F.col("c_nationkey") % 3 == 1, "no such")
    own = F.when(F.col("c_custkey") % 4 > 1, F.array(F.lit("own"))).when(F.col("c_custkey") % 4 == 1, F.array().cast("array<string>"))
    found = catalogue.dictionary_names(rows.select("c_custkey", raw.alias("raw"), own.alias("names")), "raw", variants, "unknown", "found")
    return loads.backfilled(found, "names", "found").select("c_custkey", "names")
