"""The engine's input relations over the star-schema tables.

Every relation is one SELECT that Spark and DuckDB both run, so queries and their oracle read the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

VIEWS = {
    "v_countries": ("select n_nationkey as id, n_name as name, r_name as region from nation join region on n_regionkey = r_regionkey", ("nation", "region")),
    "v_merchants": (
        """select s_suppkey as id, s_name as name, lower(s_name) as normalized_name, n_name as country, 'City ' || cast(s_suppkey % 10 as string) as city,
          cast(s_suppkey % 97 as string) || ' Dock Road' as address, -60 + ((s_suppkey * 7919) % 14500) / 100e0 as lat, -180 + ((s_suppkey * 104729) % 36000) / 100e0 as lng,
          case s_suppkey % 3 when 0 then 'found' when 1 then 'no_wine_list' else 'review' end as status, s_suppkey % 11 <> 0 as active,
          case when s_suppkey % 7 = 0 then null else '2026-01-' || lpad(cast(1 + s_suppkey % 28 as string), 2, '0') end as checked_at,
          case when s_suppkey % 5 = 0 then '' else 'https://shop' || cast(s_suppkey as string) || '.example.com' end as website
        from supplier join nation on s_nationkey = n_nationkey""", ("supplier", "nation")),
    "v_products": (
        """select l_orderkey * 10 + l_linenumber as id, l_suppkey as merchant_id, l_partkey as part_id, p_name as name, p_brand as brand, p_type as kind, cast(year(l_shipdate) as string) as vintage,
          cast(floor(l_extendedprice / 10) * 10 as double) as price, l_returnflag as flag, l_linestatus as line_status, l_shipdate as seen_at, l_orderkey as target_id
        from lineitem join part on l_partkey = p_partkey""", ("lineitem", "part")),
    "v_lines": (
        """select l_orderkey * 10 + l_linenumber as id, l_suppkey as venue_id, l_orderkey as list_id, cast(year(l_shipdate) as string) as vintage, p_name as name, p_brand as brand,
          case l_suppkey % 4 when 0 then 'EUR' when 1 then 'USD' when 2 then 'GBP' else 'CHF' end as currency, cast(floor(l_extendedprice / 10) * 10 as bigint) as price,
          cast(year(l_shipdate) as string) || ', ' || p_name || ', ' || p_brand || ', ' || p_type || ', ' || case l_suppkey % 4 when 0 then 'EUR' when 1 then 'USD' when 2 then 'GBP' else 'CHF' end
            || ' ' || cast(cast(floor(l_extendedprice / 10) * 10 as bigint) as string) as text
        from lineitem join part on l_partkey = p_partkey""", ("lineitem", "part")),
    "v_targets": (
        """select c_custkey as id, c_name as name, n_name as country, 'City ' || cast(c_custkey % 10 as string) as city, c_mktsegment as segment,
          case when c_custkey % 6 = 0 then null else -60 + ((c_custkey * 7919) % 14500) / 100e0 end as lat, case when c_custkey % 6 = 0 then null else -180 + ((c_custkey * 104729) % 36000) / 100e0 end as lng,
          case when c_custkey % 4 = 0 then '' else 'https://t' || cast(c_custkey as string) || '.example.com' end as website,
          case c_custkey % 6 when 0 then 'not_checked' when 1 then 'found' when 2 then 'no_wine_list' when 3 then 'review' when 4 then 'error' else 'missing_website' end as status,
          case when c_custkey % 6 = 4 then 'error ' || cast(c_custkey % 13 as string) when c_custkey % 6 = 3 then '' else null end as last_error
        from customer join nation on c_nationkey = n_nationkey""", ("customer", "nation")),
    "v_sources": (
        """select o_orderkey as id, o_custkey as target_id, case when o_orderkey % 9 = 0 then 'https://t' || cast(o_custkey as string) || '.example.com' when o_orderkey % 3 = 0 then 'https://x.example.com/wine/' || cast(o_orderkey as string) else 'https://x.example.com/' || cast(o_orderkey as string) end as url,
          case when o_orderkey % 2 = 0 then 'pdf' else 'html' end as source_type, case o_orderstatus when 'O' then 'found' when 'F' then 'review' else 'candidate' end as status,
          case when o_orderkey % 4 = 0 then null when o_orderstatus = 'F' then 'review' else 'parsed' end as parser_status, cast(o_orderkey % 12 as bigint) as line_count, o_orderdate as checked_at
        from orders""", ("orders",)),
    "v_entries": (
        """select l_orderkey * 10 + l_linenumber as id, o_custkey as target_id, l_orderkey as source_id, year(l_shipdate) as vintage, p_name || ' ' || p_brand as text, l_shipdate as first_seen, l_shipdate as last_seen
        from lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey""", ("lineitem", "orders", "part")),
    "v_offers": ("select event_id as id, user_id as product_id, event_type as status, value as price, ts as seen_at from events", ("events",)),
    "v_samples": ("select event_id as id, event_type as run_id, ts, value from events", ("events",)),
}

#: Watched keywords: a literal relation.
WATCHES = "select * from (values ('red widget', '1998'), ('red widget', ''), ('blue bolt', ''), ('brand 2', ''), ('no such thing', '')) as w(keyword, vintage)"


def base(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(df: DataFrame) -> DataFrame:
    """df over all cores where its files give them too few partitions (small files of one row group each), for work that is
    all CPU. Large inputs have partitions enough and are left as they are, without a shuffle."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < 2 * n else df


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A relation by name, base table or view."""
    if name in BASE:
        return base(spark, sf_dir, name)
    if name == "v_watch":
        return spark.sql(WATCHES)
    sql, tables = VIEWS[name]
    frames = {t: base(spark, sf_dir, t) for t in tables}
    import re

    text = sql
    for t in tables:
        text = re.sub(rf"\b(from|join) {t}\b", rf"\1 {{{t}}} as {t}", text)
    return spark.sql(text, **frames)


def oracle(names: list[str], sql: str) -> str:
    """DuckDB SQL that sees the named views."""
    def body(n: str) -> str:
        return (WATCHES if n == "v_watch" else VIEWS[n][0]).replace(" as string)", " as varchar)")

    bodies = ", ".join(f"{n} as ({body(n)})" for n in names)
    rest = sql.strip()
    if rest.startswith("with recursive "):
        return f"with recursive {bodies}, {rest[15:]}"
    return f"with {bodies}, {rest[5:]}" if rest.startswith("with ") else f"with {bodies} {rest}"
