"""Queries over what is read off records, names, pages, stored images and model answers."""

from __future__ import annotations

import struct
import zlib

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from findling.functions import dating, identifiers, imagebytes, lifedates, markup, records
from findling.operators import catalogue, extraction
from findling.plans.registry import query

ORIGIN = "https://lots.example.org"


@query(f"""with j as (select o_orderkey, case when json_valid(body) then body end as body from responses), l as (select o_orderkey, case when json_type(body, '$.data.lot') = 'OBJECT' then json_extract(body, '$.data.lot') end as l from j),
    k as (select o_orderkey, l, case when json_type(l, '$.lotNumber') = 'OBJECT' then l->'$.lotNumber' end as num, case when json_type(l, '$.estimateV2') = 'OBJECT' then l->'$.estimateV2' end as est, case when json_type(l, '$.auction') = 'OBJECT' then l->'$.auction' end as auc from l),
    t as (select o_orderkey, trim(l->>'$.lotId') as lot_id, l->>'$.slug' as path, case when json_type(num, '$.lotNumber') = 'VARCHAR' then trim(num->>'$.lotNumber') end as lot_number, num->>'$.__typename' as lot_number_type,
      case when json_type(est, '$.lowEstimate.amount') = 'VARCHAR' then try_cast(replace(est->>'$.lowEstimate.amount', ',', '') as double) end as estimate_low, case when json_type(est, '$.highEstimate.amount') = 'VARCHAR' then try_cast(est->>'$.highEstimate.amount' as double) end as estimate_high,
      est->>'$.__typename' as estimate_type, auc->>'$.dates.goesLive' as goes_live, auc->>'$.dates.published' as published,
      case when json_type(auc, '$.departmentNames') = 'ARRAY' and json_array_length(auc, '$.departmentNames') > 0 then 'A, B' end as departments, trim(auc->>'$.slug.year') as auction_year,
      trim(regexp_replace(regexp_replace(replace(auc->>'$.slug.name', '&amp;', '&'), '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')) as auction_name from k)
    select *, case lower(lot_number_type) when 'visiblelotnumber' then true when 'hiddenlotnumber' then false else case when lot_number_type is null and lot_number is not null then true end end as lot_number_visible,
      case when estimate_type is not null then lower(estimate_type) = 'estimateuponrequest' when coalesce(estimate_low, estimate_high) is not null then false end as estimate_on_request,
      coalesce(try_cast(substr(goes_live, 1, 10) as date), try_cast(published as date)) as auction_date, '{ORIGIN}/en/buy/auction/' || auction_year || '/' || auction_name || '/' || path as url from t""")
def pg11_lot_fields(v):
    """Responses of which some are broken, hold no lot, or hold text, numbers and lists where objects are due."""
    got = v["responses"].select("o_orderkey", records.lot(records.parsed(F.col("body")), ORIGIN).alias("lot"))
    return got.select("o_orderkey", "lot.path", *(f"lot.{c}" for c in ("lot_id", "lot_number", "lot_number_type", "lot_number_visible", "estimate_low", "estimate_high", "estimate_type", "estimate_on_request", "goes_live", "published", "auction_date", "departments", "auction_year", "auction_name", "url")))


@query("select p_partkey, case when (p_partkey // 9) % 6 < 4 then p_name end as artist from part")
def pg14_artist_names(v):
    """Each of the nine keys in turn, as text, object, object with a display name, and list, behind keys that name nobody; the rest name nobody."""
    keys = records.ARTIST_KEYS
    n, shape = F.col("p_partkey") % len(keys), F.expr("(p_partkey div 9) % 6")
    key = F.get(F.array(*map(F.lit, keys)), n)
    name = F.to_json(F.struct(F.col("p_name").alias("n")))
    text = F.regexp_extract(name, r"^\{\"n\":(.*)\}$", 1)
    value = (
        F.when(shape == 0, text)
        .when(shape == 1, F.concat(F.lit('{"name":'), text, F.lit("}")))
        .when(shape == 2, F.concat(F.lit('{"name":"","displayName":'), text, F.lit("}")))
        .when(shape == 3, F.concat(F.lit('[{"name":null,"displayName":'), text, F.lit('},"other"]')))
        .when(shape == 4, F.lit('[7,"other"]'))
        .otherwise(F.lit('{"name":5,"displayName":"other"}'))
    )
    blanks = ("5", '" "', "[]", "{}", "null")
    before = F.array_join(F.slice(F.array(*(F.lit(f'"{k}":{blanks[i % 5]},') for i, k in enumerate(keys))), F.lit(1), n.cast("int")), "")
    body = F.concat(F.lit("{"), before, F.lit('"'), key, F.lit('":'), value, F.lit("}"))
    return v["part"].select("p_partkey", records.artist_name(records.parsed(body)).alias("artist"))


@query("""select p_partkey, case p_partkey % 4 when 0 then 'u/' || p_partkey || ' d/' || p_partkey || ' 12' when 1 then 'o/' || p_partkey when 2 then '' else '' end as urls from part""")
def pg13_image_urls(v):
    k, id_ = F.col("p_partkey") % 4, F.col("p_partkey").cast("string")
    lists = (
        F.when(k == 0, F.format_string('[{"asset_type":"Image","image_url":"u/%s"},{"type":"video","url":"no","sizes":{"large":"","detail":"d/%s"}},"text",{"imageUrl":12}]', id_, id_))
        .when(k == 1, F.format_string('[{"type":"basic","image_url":"","url":null,"sizes":{"medium":"m","original":"o/%s"}},{"sizes":[]}]', id_))
        .when(k == 2, F.lit('{"image_url":"x"}'))
    )
    record = records.parsed(F.concat(F.lit('{"a":'), lists, F.lit("}")))
    return v["part"].select("p_partkey", F.array_join(records.asset_urls(records.list_at(record, "$.a")), " ").alias("urls"))


@query("""select c_custkey, case c_custkey % 5 when 0 then 'Jan van' when 1 then 'Jan' when 2 then null when 3 then null else null end as first,
    case c_custkey % 5 when 0 then c_mktsegment when 1 then c_mktsegment || ' II' when 2 then c_mktsegment when 3 then '' else c_mktsegment end as last from customer""")
def pg15_person_names(v):
    k, s = F.col("c_custkey") % 5, F.col("c_mktsegment")
    raw = F.when(k == 0, F.concat(F.lit(" Jan  van\t"), s)).when(k == 1, F.concat(s, F.lit(" II , Jan"))).when(k == 2, s).when(k == 3, F.lit("  ")).otherwise(F.concat(s, F.lit(",")))
    return v["customer"].select("c_custkey", records.person_name(raw).alias("n")).select("c_custkey", F.col("n.first").alias("first"), F.col("n.last").alias("last"))


@query("""select s_suppkey, 'Gallery ' || s_nationkey || case when s_suppkey % 4 = 3 then '; Tel' else '' end as name, case s_suppkey % 4 when 0 then 'Am Platz 1; 12345 Ort' when 1 then 'Long Road 5' end as address,
    case when s_suppkey % 4 < 2 then '030 ' || s_suppkey end as phone, case s_suppkey % 4 when 0 then 'a@b.de' when 1 then 'x' || s_suppkey || '@c.org' end as email,
    case s_suppkey % 4 when 0 then 'https://d.de/' || s_suppkey when 2 then 'd.de' end as website from supplier""")
def pg19_contacts(v):
    k, name, id_ = F.col("s_suppkey") % 4, F.concat(F.lit("Gallery "), F.col("s_nationkey").cast("string")), F.col("s_suppkey").cast("string")
    text = (
        F.when(k == 0, F.concat(name, F.lit("; Am Platz 1;12345 Ort ; Tel; 030 "), id_, F.lit(";\n a@b.de; https://d.de/"), id_))
        .when(k == 1, F.concat(F.lit("Telefon\n030 "), id_, F.lit("; "), name, F.lit("; Long Road 5; E-Mail; x"), id_, F.lit("@c.org")))
        .when(k == 2, F.concat(name, F.lit("; Homepage: ; d.de")))
        .otherwise(F.concat(name, F.lit("; Tel")))
    )
    return v["supplier"].select("s_suppkey", records.contact(text).alias("c")).select("s_suppkey", "c.name", "c.address", "c.phone", "c.email", "c.website")


@query("""select p_partkey, case when p_partkey % 3 = 0 then 'a, ' || p_brand else p_type || case when p_type = p_brand then '' else ', ' || p_brand end || ', seized' end as keywords,
    case when p_partkey % 4 = 0 then null else 'seized' end as loss, case when p_partkey % 5 < 4 then make_date(1900 + p_partkey % 100, 1, 1) end as day from part""")
def pg20_registry_fields(v):
    tags = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("a; "), "p_brand", F.lit(";a")))
    loss = F.when(F.col("p_partkey") % 4 == 0, " ").otherwise("seized; sold")
    year = F.when(F.col("p_partkey") % 5 < 4, F.concat(F.lit("before "), (F.col("p_partkey") % 100 + 1900).cast("string"), F.lit("/01"))).otherwise("x 2100")
    words = records.keywords(tags, F.col("p_type"), F.col("p_brand"), F.lit("seized"), parting=r"\s*;\s*")
    return v["part"].select("p_partkey", F.array_join(words, ", ").alias("keywords"), records.first_entry(loss).alias("loss"), records.year_as_date(year).alias("day"))


@query("""select p_partkey, case when p_partkey % 2 = 0 then p_name else 'page ' || p_partkey end as title, case when p_partkey % 3 = 0 then 'page ' || p_brand when p_partkey % 3 = 1 then p_brand end as brand, p_type as kind from part""")
def pg22_sources_put_together(v):
    """A record's fields before those of its page, blank ones passed over."""
    p = F.col("p_partkey")
    own = {"title": F.when(p % 2 == 0, F.col("p_name")).otherwise("  "), "brand": F.when(p % 3 == 1, F.col("p_brand"))}
    page = {"title": F.concat(F.lit("page "), p.cast("string")), "brand": F.when(p % 3 == 0, F.concat(F.lit("page "), "p_brand")).otherwise(""), "kind": F.col("p_type")}
    return v["part"].select("p_partkey", *(c.alias(n) for n, c in records.put_together([own, page]).items()))


@query("select c_custkey, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode('demo:matching_program:' || c_name || ':' || c_nationkey)) as digest from customer")
def x24_program_ids(v):
    """Held against the digest that an id keeps: all but the version and two bits of the variant."""
    id_ = identifiers.program_id("demo", F.col("c_name"), F.col("c_nationkey").cast("string"))
    name = F.concat(F.lit("demo:matching_program:"), "c_name", F.lit(":"), F.col("c_nationkey").cast("string"))
    whole = F.sha1(F.concat(F.unhex(F.lit(identifiers.URL_NAMESPACE.replace("-", ""))), F.encode(name, "UTF-8")))
    bare = F.translate(id_, "-", "")
    same = (F.substring(bare, 1, 12) == F.substring(whole, 1, 12)) & (F.substring(bare, 14, 3) == F.substring(whole, 14, 3)) & (F.substring(bare, 18, 15) == F.substring(whole, 18, 15)) & id_.rlike("^[0-9a-f]{8}-[0-9a-f]{4}-5[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$")
    return v["customer"].select("c_custkey", F.when(same, whole).alias("digest"))


# Datings and lives

_FORMS = {  # text of a year y, and the years that it means
    0: ("y || '-' || (y + 5)", "y", "y + 5"), 1: ("' ' || y || ' – ' || (y + 7) || ' '", "y", "y + 7"), 2: ("y || '/' || lpad(cast((y + 9) % 100 as varchar(9)), 2, '0')", "y", "y + 9"),
    3: ("'dat. ' || y", "y", "y"), 4: ("'[' || (y // 100) || ']' || lpad(cast(y % 100 as varchar(9)), 2, '0')", "y", "y"), 5: ("'(' || (y // 100) || ')' || lpad(cast(y % 100 as varchar(9)), 2, '0')", "y", "y"),
    6: ("lpad(cast(y % 100 as varchar(9)), 2, '0')", "y % 100", "y % 100"), 7: ("(y // 100) || '. Jh.'", "(y // 100) * 100 - 100", "(y // 100) * 100"), 8: ("(y // 100) || 'TH  Century'", "(y // 100) * 100 - 100", "(y // 100) * 100"),
    9: ("(y // 100) || 'ème siècle'", "(y // 100) * 100 - 100", "(y // 100) * 100"), 10: ("y || ' (?)'", "y", "y"), 11: ("'ca. ' || y", "y - 5", "y + 5"), 12: ("'Wohl um ' || y", "y - 5", "y + 5"), 13: ("y || ' (um)'", "y - 5", "y + 5"),
    14: ("cast(y as varchar(9))", "y", "y"), 15: ("'nach ' || y", "null", "null"), 16: ("'ca. ' || y || '-' || (y + 20)", "null", "null"), 17: ("y || 'er Jahre'", "null", "null"), 18: ("'datée ' || y", "y", "y"), 19: ("'vers ' || y || ' (env.)'", "y - 5", "y + 5"),
}


@query(
    "with r as (select o_orderkey, o_orderkey % 900 + 1100 as y from orders) select o_orderkey, "
    + ", ".join(f"cast(case o_orderkey % {len(_FORMS)} {' '.join(f'when {k} then {f[i]}' for k, f in _FORMS.items())} end as int) as {n}" for i, n in ((1, "dating_start"), (2, "dating_end")))
    + f", o_orderkey % {len(_FORMS)} not in (15, 16, 17) as matched from r"
)
def nr1_dating_forms(v):
    """Every form of a dating, and texts that are none."""
    texts = " ".join(f"when {k} then {f[0].replace('//', 'div')}" for k, f in _FORMS.items())
    rows = v["orders"].selectExpr("o_orderkey", "o_orderkey % 900 + 1100 as y").selectExpr("o_orderkey", f"case o_orderkey % {len(_FORMS)} {texts} end as t")
    got = rows.select("o_orderkey", dating.parse_dating(F.col("t")).alias("p"))
    return got.select("o_orderkey", F.col("p.start").alias("dating_start"), F.col("p.end").alias("dating_end"), F.col("p.matched").alias("matched"))


_LIVES = {  # text of a year b and a place p (d = b + 60), and its fields: born, died, where born, where died
    0: ("p || ' ' || b || ' - London ' || d", "b", "d", "p", "'London'"), 1: ("b || ' ' || p || ' – ' || d || ' London'", "b", "d", "p", "'London'"), 2: ("b || ' ' || p || '-' || d", "b", "d", "p", "null"), 3: ("b || ' ' || p", "b", "null", "p", "null"),
    4: ("b || '/31'", "b || '/31'", "null", "null", "null"), 5: ("'fl. ' || b || '-' || d", "null", "null", "null", "null"), 6: ("p || ', ' || b || '-' || d || '?'", "b", "d", "p", "null"), 7: ("p || ' ' || b || ' -'", "b", "null", "p", "null"),
    8: ("p || ' ' || b", "b", "null", "p", "null"), 9: ("b || '-' || d || ', ' || p", "b", "d", "null", "p"), 10: ("b || '/31-' || d", "b || '/31'", "d", "null", "null"), 11: ("b || ' - 8. Dezember ' || d", "b", "d", "null", "null"),
    12: ("'ca. ' || b || ' - um ' || d", "b", "d", "null", "null"), 13: ("b || '-' || d || ', painter in ' || p", "b", "d", "null", "null"), 14: ("b || ' - ?'", "b", "null", "null", "null"), 15: ("'German, b. ' || b", "b", "null", "null", "null"),
    16: ("'Italian, 19th Century'", "null", "null", "null", "null"), 17: ("'born ' || b || ' died ' || d", "b", "d", "null", "null"), 18: ("p || ' around 12 b'", "null", "null", "null", "null"), 19: ("b || ' ' || p || ' - ' || d || ' ebenda'", "b", "d", "p", "p"), 20: ("b || ' to ' || d", "b", "d", "null", "null"), 21: ("'? wohl'", "null", "null", "null", "null"),
}
_LIFE = "select c_custkey, cast(1500 + c_custkey % 300 as varchar(9)) as b, cast(1560 + c_custkey % 300 as varchar(9)) as d, c_mktsegment as p, c_custkey % 22 as form from customer"


def _life_sql(select: str, understood: str = "true") -> str:
    fields = ", ".join(f"case form {' '.join(f'when {k} then {f[i]}' for k, f in _LIVES.items())} end as {n}" for i, n in ((1, "dob"), (2, "dod"), (3, "pob"), (4, "pod")))
    return f"with r as ({_LIFE}) select c_custkey, {select}, {fields} from r where {understood}"


def _life_texts(v):
    return v["customer"].sparkSession.sql(_LIFE.replace("from customer", "from {customer}"), customer=v["customer"]).selectExpr("c_custkey", "form", f"case form {' '.join(f'when {k} then {f[0]}' for k, f in _LIVES.items())} end as t")


@query(_life_sql("form <> 18 as understood"))
def nr13_life_dates(v):
    """Every production of the grammar, and a text that none knows."""
    got = _life_texts(v).select("c_custkey", lifedates.life_dates(F.col("t")).alias("l"))
    return got.select("c_custkey", "l.understood", "l.dob", "l.dod", "l.pob", "l.pod")


@query(_life_sql("case when form % 3 = 0 then 'Oskar Maria Kurz' when form % 3 = 1 then 'Oskar Kurz' else 'O. Meier' end as name", "form not in (0, 6, 7, 8, 15, 16, 17, 18, 21, 5, 12)"))
def nr14_presumed_names(v):
    """Initials filled from a presumed name in parentheses, whose dates count too; a name of somebody else fills nothing."""
    rows = _life_texts(v).where("form not in (0, 6, 7, 8, 15, 16, 17, 18, 21, 5, 12)")
    k = F.col("form") % 3
    raw = F.concat(F.when(k == 0, "O. Kurz (wohl Oskar Maria Kurz ").when(k == 1, "O. K. (wohl Oskar Kurz ").otherwise("O. Meier (wohl Anton Zorn "), "t", F.lit(")"))
    got = rows.select("c_custkey", lifedates.presumed_names(raw).alias("l"))
    return got.select("c_custkey", "l.name", "l.dob", "l.dod", "l.pob", "l.pod")


@query("""select c_custkey, 'Max ' || c_mktsegment as name, cast(1800 + c_custkey % 99 as varchar) as dob, case when c_custkey % 5 in (0, 3) then cast(1870 + c_custkey % 99 as varchar) end as dod,
    case when c_custkey % 5 in (3, 4) then 'Wien' end as pob, case when c_custkey % 5 = 3 then 'Wien' end as pod from customer""")
def nr15_inline_dates(v):
    k, name = F.col("c_custkey") % 5, F.concat(F.lit("Max "), "c_mktsegment")
    b, d = ((F.col("c_custkey") % 99 + y).cast("string") for y in (1800, 1870))
    raw = (
        F.when(k == 0, F.concat(name, F.lit(", "), b, F.lit(" – "), d))
        .when(k == 1, F.concat(name, F.lit(" "), b, F.lit("-")))
        .when(k == 2, F.concat(name, F.lit(" * "), b))
        .when(k == 3, F.concat(name, F.lit(", *"), b, F.lit(" Wien, † "), d, F.lit(" Ebd.")))
        .otherwise(F.concat(name, F.lit(", born "), b, F.lit(" Wien")))
    )
    return v["customer"].select("c_custkey", lifedates.inline_dates(raw).alias("l")).select("c_custkey", "l.name", "l.dob", "l.dod", "l.pob", "l.pod")


# Model answers


@query("""with q as (select l_orderkey, l_linenumber, l_partkey, l_returnflag as t, row_number() over (partition by l_orderkey, l_returnflag order by l_linenumber, l_partkey) as n from lineitem),
    a as (select l_orderkey, t, n2 as answer, row_number() over (partition by l_orderkey, t order by n2, l_partkey) as n from (select l_orderkey, l_linenumber * 10 as n2, l_partkey, case when l_linenumber = 3 then '' else l_returnflag end as t from lineitem where l_linenumber % 4 <> 2))
    select coalesce(q.l_orderkey, a.l_orderkey) as l_orderkey, l_linenumber, answer, case when q.n is null then 'unasked' when a.n is null then 'unanswered' else 'matched' end as state
    from q full join a on q.l_orderkey = a.l_orderkey and q.t = a.t and q.n = a.n""")
def nr7_realigned_answers(v):
    """Texts repeat within an order; every fourth answer is missing and one is to no question."""
    asked = v["lineitem"].select("l_orderkey", F.col("l_returnflag").alias("t"), "l_linenumber", F.struct("l_linenumber", "l_partkey").alias("o"))
    answers = v["lineitem"].where("l_linenumber % 4 <> 2").select("l_orderkey", F.when(F.col("l_linenumber") == 3, F.lit(None)).otherwise(F.concat(F.lit(" "), "l_returnflag")).alias("t"), (F.col("l_linenumber") * 10).alias("answer"), F.struct((F.col("l_linenumber") * 10).alias("a"), "l_partkey").alias("p"))
    return extraction.realigned(asked, answers, "l_orderkey", "t", "o", "p").select("l_orderkey", "l_linenumber", "answer", "state")


def _extracted(v):
    """Orders as a model's answers: some not understood, some without content, fields of all shapes."""
    k, id_ = F.col("o_orderkey"), F.col("o_orderkey").cast("string")
    empty = k % 6 == 1
    fill = lambda c: F.when(~empty, c)
    fields = {
        "title": fill(F.concat(F.lit("  t "), id_)), "author": fill(F.when(k % 4 == 0, F.repeat(F.lit("x"), 300)).otherwise(" ")), "dating_start": F.when(k % 5 == 0, "19x").otherwise((k % 900 + 1000).cast("string")),
        "dim_width": F.when(k % 7 == 0, "wide").otherwise("30.5"), "material": fill(F.lit("oil")), "dict_material_name": F.array(F.lit("oil")),
    }
    rest = {c: F.lit(None).cast("string") for c in extraction.CONTENT if c not in fields}
    return v["orders"].select("o_orderkey", F.when(k % 13 == 0, " ").otherwise(id_).alias("id"), *(c.alias(n) for n, c in (fields | rest).items()), F.when(k % 3 != 2, k % 3 == 0).alias("extraction_parsed"))


@query("""select o_orderkey, case when o_orderkey % 13 = 0 then 'again' when o_orderkey % 3 = 1 or (o_orderkey % 3 = 2 and o_orderkey % 6 = 1) then 'again' when o_orderkey % 6 = 1 then 'empty' else 'filled' end as state from orders""")
def flt10_parsed_and_filled(v):
    good = F.coalesce(extraction.text(F.col("id")).isNotNull() & extraction.was_parsed(), F.lit(False))
    return _extracted(v).select("o_orderkey", F.when(~good, "again").when(extraction.has_payload(), "filled").otherwise("empty").alias("state"))


@query("""with r as (select o_orderkey as k, o_orderkey % 13 <> 0 and not (o_orderkey % 3 = 1 or (o_orderkey % 3 = 2 and o_orderkey % 6 = 1)) as good, o_orderkey % 6 = 1 as bare from orders)
    select cast(k as varchar) as id, case when good and not bare then 't ' || k else 'old' end as title, case when good and not bare then case when k % 4 = 0 then 255 end else 5 end as author_length,
    case when good and not bare and k % 5 <> 0 then cast(k % 900 + 1000 as int) end as dating_start, case when good and not bare and k % 7 <> 0 then 30.5 end as dim_width,
    case when k % 2 = 0 then 'ink' when good and not bare then 'oil' end as material, case when k % 2 = 1 and good and not bare then 'oil' when k % 2 = 0 then 'ink' else '' end as names, good as is_processed from r""")
def snk8_nr22_written_back(v):
    """A batch is written back twice, as after a failure: filled columns overwrite, materials only where there are none."""
    rows = _extracted(v)
    filled, empty, _ = extraction.split(rows)
    even = F.col("o_orderkey") % 2 == 0
    target = v["orders"].select(F.col("o_orderkey").cast("string").alias("id"), F.lit("old").alias("title"), F.lit("known").alias("author"), F.lit(None).cast("int").alias("dating_start"), F.lit(None).cast("double").alias("dim_width"), F.when(even, "ink").otherwise(" ").alias("material"), F.when(even, F.array(F.lit("ink"))).otherwise(F.array().cast("array<string>")).alias("dict_material_name"), F.lit(False).alias("is_processed"))
    fill = ("material", "dict_material_name")
    for _ in range(2):
        target = extraction.written_back(target, filled, empty, fill=fill)
    return target.select("id", "title", F.length("author").alias("author_length"), "dating_start", "dim_width", F.nullif(F.trim("material"), F.lit("")).alias("material"), F.array_join("dict_material_name", ",").alias("names"), "is_processed")


@query("""select p_partkey, case when p_partkey % 3 = 1 then 'own' else 'oil' end as names, p_partkey % 3 <> 1 and p_partkey % 5 <> 0 as changed from part""")
def nr21_filled_names(v):
    """Dictionary names worked out again where there are none; blank entries are nothing."""
    old = F.when(F.col("p_partkey") % 3 == 1, F.array(F.lit("own"))).when(F.col("p_partkey") % 5 == 0, F.array(F.lit("oil"), F.lit(" "))).otherwise(F.array(F.lit(" "), F.lit(None)))
    rows = v["part"].select("p_partkey", old.alias("names"))
    got = extraction.rerun(rows, {"names": F.array(F.lit("oil"))}, overwrite=False)
    return got.select("p_partkey", F.array_join(F.filter("names", lambda x: F.trim(x) != ""), ",").alias("names"), "changed")


def _png(width: int, height: int) -> bytes:
    chunk = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    rows = b"".join(b"\0" + bytes((x * y) % 256 for x in range(width)) for y in range(height))
    return imagebytes.PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def _jpeg(width: int, height: int) -> bytes:
    part = lambda marker, body: b"\xff" + bytes([marker]) + struct.pack(">H", len(body) + 2) + body
    return b"\xff\xd8" + part(0xE0, b"JFIF\0") + part(0xC0, struct.pack(">BHHB", 8, height, width, 1) + b"\1\x11\0") + part(0xDA, b"\1\1\0\0\x3f\0") + b"\x12\xff\0\x34\xff\xd0\x56" + b"\xff\xd9"


@F.pandas_udf(BinaryType())
def _stored(key: pd.Series, size: pd.Series) -> pd.Series:
    """Images as they are stored, whole and spoilt."""

    def made(k: int, n: int) -> bytes:
        png = _png(n, n + 1)
        return (png, png[: 40 + k % 12], png[:42] + bytes([png[42] ^ 1]) + png[43:], _jpeg(n, 7), _jpeg(n, 7)[:-3], b"text", b"")[k % 7]

    return pd.Series([made(k, n) for k, n in zip(key, size, strict=True)])


@query("""select p_partkey, case when p_partkey % 7 < 3 then 'png' when p_partkey % 7 < 5 then 'jpeg' end as format, case when p_partkey % 7 < 5 then p_size end as width, case when p_partkey % 7 < 3 then p_size + 1 when p_partkey % 7 < 5 then 7 end as height,
    case p_partkey % 7 when 1 then 'cut short' when 2 then 'checksum of IDAT' when 4 then 'cut short' when 5 then 'unknown format' when 6 then 'empty' end as fault from part""")
def flt9_decodable(v):
    got = v["part"].select("p_partkey", imagebytes.image_facts(_stored("p_partkey", "p_size")).alias("i"))
    return got.select("p_partkey", "i.format", "i.width", "i.height", "i.fault")


@query("select p_partkey, name, p_size * 2 as twice from part join (values (1, 'oil'), (2, 'ink'), (3, null), (50, 'wax')) t(size, name) on size = p_size")
def src20_src21_inline_rows(v):
    """Parameters as parallel arrays, joined like a table."""
    rows = catalogue.from_arrays(v["part"].sparkSession, "size int, name string", [1, 2, 3, 50], ["oil", "ink", None, "wax"])
    return v["part"].join(F.broadcast(rows), F.col("size") == F.col("p_size")).select("p_partkey", "name", (F.col("p_size") * 2).alias("twice"))  # the parameters' rows


_MARKUP = """select p_partkey, '<html><dl><dt>Title:</dt><dd>' || p_name || ' &amp; co</dd><dt>Kind</dt><dd>' || p_type || '</dd><dd> <b>' || p_brand || '</b> </dd></dl><table><tr><th>Size</th><td>' || cast(p_size as varchar(9)) || '
    cm</td></tr><tr><th>Empty</th><td> </td></tr></table><div class="entry"><span class="label">Kind</span><span class="value">' || p_brand || '</span></div></html>' as html from part"""


@query("""select p_partkey, 'Title' as label, p_name || ' & co' as value from part union all select p_partkey, 'Kind', p_type || '; ' || p_brand || '; ' || p_brand from part union all select p_partkey, 'Size', p_size || ' cm' from part""")
def pg17_pg18_merged_fields(v):
    """Labelled values of pages made of all parts: lists, tables and marked elements, several values of a label joined."""
    pages = v["part"].sparkSession.sql(_MARKUP.replace("from part", "from {part}"), part=v["part"])
    return markup.merged_fields(markup.label_values(pages, "p_partkey"), "p_partkey").select("p_partkey", "label", "value")
