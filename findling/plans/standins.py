"""The record-linkage tables over the star schema: views that play lost works, auction works, scores and images."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

#: Each view's query; it runs in Spark and in DuckDB alike.
VIEWS = {
    "lost": """select p_partkey as lost_id, p_name as title, p_brand as institution_classification, p_type as material,
        cast(p_size as double) as width, case when p_partkey % 11 = 0 then null else p_retailprice / 30 end as height,
        case when p_partkey % 7 = 0 then null else cast(1500 + p_partkey % 400 as int) end as dating_start,
        case when p_partkey % 13 = 0 then null else cast(1500 + p_partkey % 400 + p_size as int) end as dating_end,
        p_partkey % 97 as artist_a, p_partkey % 89 as artist_b from part""",
    "people": "select c_custkey as artist_id, c_name as complete_name, c_mktsegment as segment, c_nationkey as country_id from customer",
    "auction": """select s_suppkey as auction_id, s_name as artist, s_nationkey as platform_id, p_name as title,
        cast(p_size + s_suppkey % 3 as double) as width, p_retailprice / 30 as height,
        case when s_suppkey % 5 = 0 then null else cast(1510 + s_suppkey % 390 as int) end as dating_start,
        case when s_suppkey % 9 = 0 then null else cast(1520 + s_suppkey % 390 as int) end as dating_end, s_acctbal as estimate
        from supplier join part on p_partkey = s_suppkey * 3""",
    "scores": """select l_partkey as lost_id, l_orderkey * 8 + l_linenumber as auction_id,
        case when l_linenumber % 4 = 0 then null else l_discount * 10 end as metadata_final_score,
        case when l_linenumber % 4 = 0 then null else 1 - l_tax * 5 end as metadata_confidence_score,
        case when l_linenumber % 3 = 0 then l_quantity / 50 else null end as image_final_score,
        case when l_linenumber % 3 = 0 then 1 - l_discount else null end as image_matching_confidence,
        case when l_linenumber % 3 = 0 then l_extendedprice / 200000 else null end as image_blocking_similarity,
        case when l_linenumber % 3 = 0 then l_orderkey % 5000 else null end as best_image_file_id,
        case when l_linenumber % 4 = 0 then null else l_shipdate end as metadata_match_date,
        case when l_linenumber % 3 = 0 then l_shipdate + interval 5 hours else null end as image_match_date,
        case l_returnflag when 'A' then 1 when 'R' then -1 else null end as rating,
        case when l_linestatus = 'O' then l_suppkey % 3 = 0 else null end as bookmarked from lineitem""",
    "works": """select o_orderkey as auction_id, o_custkey as artist_id, o_orderstatus = 'F' as processed, o_orderdate as created_at,
        case when o_orderstatus = 'F' then o_orderdate + interval 30 hours else null end as image_at,
        case when o_custkey % 2 = 0 then o_orderdate + interval 7 hours else null end as metadata_at, o_totalprice as price, o_orderpriority as priority from orders""",
    "links": """select l_orderkey as auction_id, l_partkey as image_id, l_returnflag <> 'N' as processed, l_linestatus = 'F' as error_free from lineitem""",
    "images": """select p_partkey as image_id, 'img/' || p_brand || '/' || cast(p_partkey % 700 as varchar(20)) || '.jpg' as file_path, p_size % 5 <> 0 as is_embedded, p_partkey % 17 = 0 as cleaned from part""",
    "runs": "select n_nationkey % 5 as source, o_orderdate as run_at, count(*) as total from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by 1, 2",
    "responses": """select o_orderkey, case o_orderkey % 11 when 0 then '{"data": []}' when 1 then 'cut {' when 2 then '{"data":{"lot":"none"}}' else
        '{"data":{"lot":{"lotId":" L' || cast(o_orderkey as varchar(20)) || ' ","slug":"lot-' || cast(o_orderkey as varchar(20)) || '","lotNumber":' ||
        case o_orderkey % 5 when 0 then '{"lotNumber":"' || cast(o_custkey as varchar(20)) || '","__typename":"VisibleLotNumber"}' when 1 then '{"lotNumber":" 9 ","__typename":"HiddenLotNumber"}' when 2 then '{"lotNumber":"5"}' when 3 then '{"lotNumber":5,"__typename":"Other"}' else '"7"' end
        || ',"estimateV2":' || case o_orderkey % 4 when 0 then '{"__typename":"EstimateUponRequest"}' when 1 then 'null' when 2 then '{"lowEstimate":{"amount":"1,' || cast(100 + o_custkey % 900 as varchar(20)) || '"},"highEstimate":{"amount":"2500.5"}}' else '{"__typename":"LowHigh","lowEstimate":{"amount":12},"highEstimate":"x"}' end
        || ',"auction":' || case o_orderkey % 3 when 0 then '[]' when 1 then '{"dates":{"goesLive":"2021-0' || cast(1 + o_custkey % 9 as varchar(20)) || '-05T23:30:00-07:00","closed":7},"departmentNames":[" A ",7,"","B"],"slug":{"year":2021,"name":"sale"}}'
            else '{"dates":{"goesLive":"soon","published":"2020-02-03"},"departmentNames":[],"slug":{"year":" 2020 ","name":"' || o_orderstatus || ' &amp; <b>co</b>"}}' end || '}}}' end as body from orders""",
    "tree": """select 'world' as name, cast(null as varchar(20)) as parent union all select r_name, 'world' from region
        union all select n_name, r_name from nation join region on n_regionkey = r_regionkey""",
}


def views(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Tables and views of a directory, by name."""
    made = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES}
    for name, query in VIEWS.items():
        used = {t: made[t] for t in TABLES if re.search(rf"\b(?:from|join) {t}\b", query)}
        made[name] = spark.sql(re.sub(r"\b(from|join) (\w+)\b", lambda m: f"{m[1]} {{{m[2]}}}" if m[2] in used else m[0], query.replace("{", "{{").replace("}", "}}")), **used)  # braces of its own are text
    return made


def with_views(query: str) -> str:
    """A query over views as one DuckDB statement."""
    named = [n for n in VIEWS if f" {n} " in query.replace("\n", " ").replace(",", " ").replace(")", " ").replace("(", " ") + " "]
    head = ", ".join(f"{n} as ({VIEWS[n]})" for n in named)
    if not head:
        return query
    if query.startswith("with recursive "):
        return f"with recursive {head}, {query[15:]}"
    return f"with {head}, {query[5:]}" if query.startswith("with ") else f"with {head} {query}"
