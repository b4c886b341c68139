"""Merge queries: a base and a delta by key parity."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import misc
from ..operators import merge
from .registry import query

_OLD = "(select p_partkey as id, p_name as name, case when p_partkey % 4 = 0 then '' else p_brand end as brand, p_retailprice as price, false as is_new from part where p_partkey % 3 <> 0)"
_NEW = "(select p_partkey as id, upper(p_name) as name, case when p_partkey % 5 = 0 then '' else 'New ' || p_brand end as brand, p_retailprice * 2 as price, true as is_new from part where p_partkey % 2 = 0)"


def _sides(part):
    old = part.where("p_partkey % 3 <> 0").selectExpr("p_partkey as id", "p_name as name", "case when p_partkey % 4 = 0 then '' else p_brand end as brand", "p_retailprice as price", "false as is_new")
    new = part.where("p_partkey % 2 = 0").selectExpr("p_partkey as id", "upper(p_name) as name", "case when p_partkey % 5 = 0 then '' else 'New ' || p_brand end as brand", "p_retailprice * 2 as price", "true as is_new")
    return old, new


@query(["part"], f"select coalesce(n.id, o.id) as id, case when n.id is null then o.name else n.name end as name, case when n.id is null then o.brand else n.brand end as brand, case when n.id is null then o.price else n.price end as price from {_OLD} o full join {_NEW} n on o.id = n.id")
def u1_incoming_wins(part):
    old, new = _sides(part)
    return merge.upsert(old.drop("is_new"), new.drop("is_new"), ["id"], {})


@query(["part"], f"select coalesce(n.id, o.id) as id, case when n.id is null then o.brand else coalesce(nullif(n.brand, ''), o.brand) end as brand, coalesce(o.price, n.price) as price from {_OLD} o full join {_NEW} n on o.id = n.id")
def u2_non_empty_incoming(part):
    old, new = _sides(part)
    return merge.upsert(old.select("id", "brand", "price"), new.select("id", "brand", "price"), ["id"], {"brand": merge.non_empty_incoming_wins, "price": merge.keep_old})


@query(["part"], f"select coalesce(n.id, o.id) as id, case when n.id is null then o.brand else coalesce(nullif(o.brand, ''), n.brand) end as brand from {_OLD} o full join {_NEW} n on o.id = n.id")
def u3_keep_old(part):
    old, new = _sides(part)
    return merge.upsert(old.select("id", "brand"), new.select("id", "brand"), ["id"], {"brand": merge.keep_old_unless_empty})


@query(["part"], f"""
  with j as (select coalesce(n.id, o.id) as id, o.id is not null and n.id is not null and o.brand is distinct from n.brand as moved, o.price as old_price from {_OLD} o full join {_NEW} n on o.id = n.id)
  select id, case when moved then 'not_checked' else 'kept' end as status, case when moved then null else old_price end as checked_price from j""")
def u4_conditional_reset(part):
    """A changed address resets what was found out about the old one."""
    old, new = _sides(part)
    j = old.alias("o").join(new.alias("n"), F.col("o.id") == F.col("n.id"), "full")
    moved = F.col("o.id").isNotNull() & F.col("n.id").isNotNull() & ~F.col("o.brand").eqNullSafe(F.col("n.brand"))
    return j.select(F.coalesce("n.id", "o.id").alias("id"), F.when(moved, "not_checked").otherwise("kept").alias("status"), F.when(~moved, F.col("o.price")).alias("checked_price"))


@query(["lineitem"], """
  with o as (select l_suppkey as id, list_sort(list(distinct l_returnflag)) as f from lineitem where l_linenumber <= 2 group by 1), n as (select l_suppkey as id, list(distinct l_returnflag) as f from lineitem where l_linenumber > 6 group by 1)
  select coalesce(o.id, n.id) as id, array_to_string(list_sort(list_distinct(list_concat(coalesce(o.f, []), coalesce(n.f, [])))), ',') as flags, len(list_distinct(list_concat(coalesce(o.f, []), coalesce(n.f, [])))) as source_count from o full join n on o.id = n.id""")
def u5_set_merge(lineitem):
    old = lineitem.where("l_linenumber <= 2").groupBy(F.col("l_suppkey").alias("id")).agg(F.sort_array(F.collect_set("l_returnflag")).alias("flag"))
    out = merge.set_merge(old, lineitem.where("l_linenumber > 6").select(F.col("l_suppkey").alias("id"), F.col("l_returnflag").alias("flag")), ["id"], "flag")
    return out.select("id", F.array_join("flag", ",").alias("flags"), F.col("source_count").cast("long").alias("source_count"))


@query(["part"], f"""
  with d as (select n.id, case when o.id is null then 'inserted' when sha256(o.name || chr(31) || o.brand) = sha256(n.name || chr(31) || n.brand) then 'unchanged' else 'updated' end as outcome
    from (select id, lower(name) as name, case when id % 7 = 0 then replace(brand, 'New ', '') else brand end as brand from {_NEW}) n left join {_OLD} o on o.id = n.id)
  select outcome, count(*) as n from d group by 1""")
def u6_change_detection(part):
    old, new = _sides(part)
    digest = misc.content_hash(F.col("name"), F.col("brand"))
    changed = new.withColumns({"name": F.lower("name"), "brand": F.when(F.col("id") % 7 == 0, F.replace("brand", F.lit("New "), F.lit(""))).otherwise(F.col("brand"))})
    return merge.outcomes(old.withColumn("h", digest), changed.withColumn("h", digest), ["id"], "h").groupBy("outcome").agg(F.count("*").alias("n"))


@query(["part"], f"select id, brand from (select id, brand from {_OLD} o union all select id, brand from {_NEW} n where not exists (select 1 from {_OLD} o where o.id = n.id))")
def u13_insert_or_ignore(part):
    old, new = _sides(part)
    return merge.insert_or_ignore(old.select("id", "brand"), new.select("id", "brand"), ["id"])


@query(["part"], f"select id, brand from {_OLD} o where not exists (select 1 from {_NEW} n where n.id = o.id) union all select id, brand from {_NEW}")
def u12_replace_by_key(part):
    old, new = _sides(part)
    return merge.replace_by_key(old.select("id", "brand"), new.select("id", "brand"), ["id"])


@query(["v_merchants", "v_products"], "select m.id, m.active and exists (select 1 from v_products p where p.merchant_id = m.id and p.price > 90000) as active from v_merchants m")
def u8_soft_delete(merchants, products):
    seen = products.where("price > 90000").select(F.col("merchant_id").alias("id"))
    return merge.soft_delete(merchants.select("id", "active"), seen, ["id"])


@query(["v_products", "v_merchants"], """
  with b as (select merchant_id, id as key, price, id % 2 = 0 as active from v_products), i as (select merchant_id, id as key, price + 1 as price from v_products where id % 5 = 0),
  o as (select id as merchant_id, case id % 4 when 0 then 'found' when 1 then 'review' when 2 then 'rejected' end as result from v_merchants where id % 4 < 3),
  s as (select i.* from i join o on i.merchant_id = o.merchant_id and o.result = 'found'),
  r as (select b.merchant_id, b.key, b.price, b.active and (o.result is null or o.result = 'review') as active from b left join o on b.merchant_id = o.merchant_id where not exists (select 1 from s where s.merchant_id = b.merchant_id and s.key = b.key) union all select merchant_id, key, price, true from s)
  select merchant_id, count(*) as n, count(*) filter (where active) as active, sum(price)::double as total from r group by 1""")
def u9_inventory_replace(products, merchants):
    base = products.select("merchant_id", F.col("id").alias("key"), "price", (F.col("id") % 2 == 0).alias("active"))
    incoming = products.where("id % 5 = 0").select("merchant_id", F.col("id").alias("key"), (F.col("price") + 1).alias("price"))
    r = F.col("id") % 4
    outcome = merchants.where("id % 4 < 3").select(F.col("id").alias("merchant_id"), F.when(r == 0, "found").when(r == 1, "review").otherwise("rejected").alias("result"))
    out = merge.inventory_replace(base, incoming, outcome)
    return out.groupBy("merchant_id").agg(F.count("*").alias("n"), F.count_if("active").alias("active"), F.sum("price").alias("total"))


@query(["v_merchants"], """
  with m as (select id, country, lat, lng, case when id % 3 = 0 then lat + 0.5 else lat + 0.001 end as lat2, case when id % 10 = 0 then 'NATION_X' else country end as country2 from v_merchants)
  select id, country <> country2 or 2 * 6371.0088 * asin(least(1.0, sqrt(pow(sin((radians(lat2) - radians(lat)) / 2), 2) + cos(radians(lat)) * cos(radians(lat2)) * pow(sin(0.0), 2)))) > 1.0 as split from m""")
def u10_split(merchants):
    from ..functions.places import haversine_km

    lat2 = F.when(F.col("id") % 3 == 0, F.col("lat") + 0.5).otherwise(F.col("lat") + 0.001)
    country2 = F.when(F.col("id") % 10 == 0, "NATION_X").otherwise(F.col("country"))
    return merchants.select("id", merge.location_split(haversine_km(F.col("lat"), F.col("lng"), lat2, F.col("lng")), F.col("country") == country2).alias("split"))


@query(["v_merchants"], """
  with m as (select id, website as old, case when id % 3 = 0 then website else 'https://new' || id || '.example.com' end as new, id % 4 = 0 as rejected from v_merchants)
  select id, case when (rejected and new <> '' and new is distinct from old) or (not rejected and old = '') then new else old end as website, not rejected or (new <> '' and new is distinct from old) as active from m""")
def u11_rejected(merchants):
    new = F.when(F.col("id") % 3 == 0, F.col("website")).otherwise(F.concat(F.lit("https://new"), F.col("id").cast("string"), F.lit(".example.com")))
    change = merge.website_change(F.col("website"), new, F.col("id") % 4 == 0)
    return merchants.select("id", change["website"].alias("website"), change["active"].alias("active"))


@query(["v_lines"], "select id, price::double as price_value from v_lines where id % 3 = 0")
def u14_backfill(lines):
    """Reparse: rows whose stored price differs from what the line says."""
    from ..functions.money import list_price

    stored = lines.withColumn("stored", F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.col("price").cast("double")))
    parsed = stored.withColumn("price_value", list_price(F.col("text"))["price_value"])
    return parsed.where(~F.col("price_value").eqNullSafe(F.col("stored"))).select("id", "price_value")
