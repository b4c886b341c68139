"""Join and entity-resolution queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import entities, matching
from .registry import query


@query(["v_targets", "v_sources"], """
  with s as (select target_id, count(*) as n from v_sources where status = 'found' group by 1) select t.id, coalesce(s.n, 0) as n from v_targets t left join s on s.target_id = t.id""")
def j3_left_coalesce(targets, sources):
    s = sources.where("status = 'found'").groupBy("target_id").agg(F.count("*").alias("n"))
    return targets.join(s, targets["id"] == s["target_id"], "left").select("id", F.coalesce("n", F.lit(0)).alias("n"))


@query(["v_targets", "v_sources", "v_entries"], """
  select t.id, count(distinct s.id) as lists, count(distinct e.id) as entries, count(e.id) as fanned from v_targets t left join v_sources s on s.target_id = t.id left join v_entries e on e.target_id = t.id group by 1""")
def j4_fanout_counts(targets, sources, entries):
    """Distinct counts over two fanned-out sides, and the product the plain count gives: from pre-aggregates, without the fan-out."""
    s = sources.groupBy("target_id").agg(F.countDistinct("id").alias("lists"))
    e = entries.groupBy("target_id").agg(F.countDistinct("id").alias("entries"), F.count("id").alias("n"))
    t = targets.select("id")
    out = t.join(s, t["id"] == s["target_id"], "left").drop("target_id").join(e, t["id"] == e["target_id"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return out.select("id", zero("lists").alias("lists"), zero("entries").alias("entries"), (zero("n") * F.greatest(zero("lists"), F.lit(1))).alias("fanned"))


@query(["v_merchants", "v_products"], "select id from v_merchants m where m.id in (select merchant_id from v_products where price > 90000)")
def j6_semi(merchants, products):
    return merchants.join(products.where("price > 90000").select(F.col("merchant_id").alias("id")), "id", "left_semi").select("id")


@query(["v_targets", "v_sources", "v_entries"], "select id from v_targets t where not exists (select 1 from v_sources s where s.target_id = t.id and s.status = 'found') and not exists (select 1 from v_entries e where e.target_id = t.id and e.vintage = 1998)")
def j8_double_anti(targets, sources, entries):
    from ..operators.merge import orphans

    found = sources.where("status = 'found'").select(F.col("target_id").alias("id"))
    return orphans(targets, "id", found, entries.where("vintage = 1998").select(F.col("target_id").alias("id"))).select("id")


@query(["v_merchants", "v_products"], "select m.id, (select count(*) from v_products p where p.merchant_id = m.id and p.price > 50000) as n, (select max(price) from v_products p where p.merchant_id = m.id) as top from v_merchants m")
def j9_scalar_subq(merchants, products):
    p = products.groupBy("merchant_id").agg(F.count_if(F.col("price") > 50000).alias("n"), F.max("price").alias("top"))
    return merchants.join(p, merchants["id"] == p["merchant_id"], "left").select("id", F.coalesce("n", F.lit(0)).alias("n"), "top")


_POINTS = "select c_custkey as id, 'Place ' || (c_custkey % 40) as name, 10 + ((c_custkey * 7919 + c_custkey // 40 * 57) % 400) / 10000e0 as lat, 20 + ((c_custkey * 104729 + c_custkey // 40 * 53) % 400) / 10000e0 as lng, case c_custkey % 3 when 0 then '' when 1 then 'FR' else 'DE' end as country, case when c_custkey % 4 = 0 then 'Road ' || (c_custkey % 8) else '' end as address from customer"


def _points(customers):
    return customers.selectExpr("c_custkey as id", "'Place ' || (c_custkey % 40) as name", "10 + ((c_custkey * 7919 + c_custkey div 40 * 57) % 400) / 10000e0 as lat", "20 + ((c_custkey * 104729 + c_custkey div 40 * 53) % 400) / 10000e0 as lng", "case c_custkey % 3 when 0 then '' when 1 then 'FR' else 'DE' end as country", "case when c_custkey % 4 = 0 then 'Road ' || (c_custkey % 8) else '' end as address")


def _halves(p):
    """Two sides that share their names: 40 rows for the one, the next 40 for the other."""
    return p.where("(id div 40) % 2 = 0"), p.where("(id div 40) % 2 = 1")


@query(["customer"], f"""
  with p as ({_POINTS}), j as (select a.id, b.id as match_id, abs(a.lat - b.lat) + abs(a.lng - b.lng) as degrees from p a join p b on a.name = b.name and abs(a.lat - b.lat) <= 0.003 and abs(a.lng - b.lng) <= 0.003 where (a.id // 40) % 2 = 0 and (b.id // 40) % 2 = 1)
  select id, min_by(match_id, (degrees, match_id)) as match_id, round(min(degrees), 9) as degrees from j group by 1""")
def j10_nearest(customers):
    """Nearest row of the same name within a small box, through grid cells."""
    p = _points(customers)
    return matching.nearest_by_name(*_halves(p), "name").withColumn("degrees", F.round("degrees", 9))


@query(["customer"], f"""
  with p as ({_POINTS}), j as (select a.id, b.id as match_id, not (a.country <> '' and b.country <> '' and a.country <> b.country) and ((a.address <> '' and a.address = b.address)
    or 2 * 6371.0088 * asin(least(1.0, sqrt(pow(sin((radians(b.lat) - radians(a.lat)) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin((radians(b.lng) - radians(a.lng)) / 2), 2)))) <= 1.0) as same
    from p a join p b on a.name = b.name where (a.id // 40) % 2 = 0 and (b.id // 40) % 2 = 1)
  select id, min(match_id) as match_id from j where same group by 1""")
def j11_distance(customers):
    """First row of the same name at the same location: countries agree, and address or distance does."""
    p = _points(customers)
    return matching.first_at_location(*_halves(p), ["name"])


_RECORDS = f"select *, case when id % 7 = 0 then 'd' || ((id // 60) % 23) || '.example.com' else '' end as domain from ({_POINTS})"


@query(["customer"], f"""
  with recursive p as ({_RECORDS}), l as (select a.id as a, b.id as b from p a join p b on a.id < b.id and ((a.domain <> '' and a.domain = b.domain) or (a.name = b.name and abs(a.lat - b.lat) <= 0.003 and abs(a.lng - b.lng) <= 0.003))),
  e as (select a, b from l union select b, a from l), c(r, m) as (select id, id from p union select c.r, e.b from c join e on c.m = e.a), k as (select r as id, min(m) as entity from c group by r)
  select id, entity from k""")
def u6_entities(customers):
    """Records of one batch that are one: by website, or by name and place, through all links."""
    p = _points(customers)
    return entities.entities(p.withColumn("domain", F.when(F.col("id") % 7 == 0, F.concat(F.lit("d"), F.expr("(id div 60) % 23"), F.lit(".example.com"))).otherwise(""))).select("id", "entity")


@query(["v_targets"])
def j12_fuzzy_name(targets):
    """Best name of the same country by matching blocks, of every other ten the next ten."""
    side = lambda k: targets.where(f"(id div 10) % 2 = {k}").select("id", "name", "country", "website")
    return matching.best_names(side(0), side(1), "country")


@query(["part"], """
  with n as (select *, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) as name_key from part), r as (select *, row_number() over (partition by name_key order by p_retailprice desc, p_partkey) as rank from n),
  d as (select *, row_number() over (partition by name_key, p_type order by rank) as rn from r where rank <= 8) select name_key, rank, p_partkey from d where rn = 1""")
def j13_variants(part):
    return matching.variants(part, text.normalize_name("p_name"), [F.desc("p_retailprice"), F.col("p_partkey")], ["p_type"]).select("name_key", "rank", "p_partkey")


@query(["v_lines"], """
  with recursive w as (select id, list_id, vintage, price, string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' ') as words from v_lines),
  i as (select *, list_filter(words, lambda t: length(t) >= 3 and t not in ('the', 'and', 'aoc', 'aop', 'auc', 'doc', 'docg', 'cru', 'grand', 'wine', 'list')) as tokens from w where id % 2 = 0), o as (select * from w where id % 2 = 1),
  p as (select i.list_id, i.id, o.id as other_id, len(list_filter(tokens, lambda t: list_contains(o.words, t)))::double / len(tokens) + case when i.vintage = o.vintage then 0.25::double else 0::double end + case when i.price = o.price then 0.2::double else 0::double end as score
    from i join o on i.list_id = o.list_id where len(tokens) > 0 and list_has_any(tokens, o.words)),
  k as (select distinct *, dense_rank() over (partition by list_id order by id) as turn from p where score >= 0.55::double),
  r(list_id, turn, used, id, other_id, score) as (
    select distinct list_id, 0::bigint, []::bigint[], null::bigint, null::bigint, null::double from k
    union all
    select list_id, turn, case when best is null then used else list_append(used, -best.other_id) end, best.id, -best.other_id, best.score from (
      select r.list_id, r.turn + 1 as turn, r.used, max({'score': k.score, 'other_id': -k.other_id, 'id': k.id}) filter (where not list_contains(r.used, k.other_id)) as best from r join k on k.list_id = r.list_id and k.turn = r.turn + 1 group by r.list_id, r.turn, r.used))
  select list_id, id, other_id, score from r where id is not null""", heavy=True)
def j14_greedy_match(lines):
    """Greedy one-to-one reconciliation of two halves of each list."""
    rows = lines.select("id", "list_id", "text", "vintage", "price")
    return matching.reconcile(rows.where("id % 2 = 0"), rows.where("id % 2 = 1"), "list_id")


@query(["v_products", "v_merchants", "v_countries"], """
  select c.region, count(*) as n, sum(p.price)::double as total from v_products p join v_merchants m on p.merchant_id = m.id join v_countries c on c.name = m.country group by 1""")
def j1_region_totals(products, merchants, countries):
    """The star join: dimensions are small at any scale, Spark broadcasts them by size."""
    m = merchants.select(F.col("id").alias("merchant_id"), F.col("country").alias("name"))
    return products.select("merchant_id", "price").join(m, "merchant_id").join(countries.select("name", "region"), "name").groupBy("region").agg(F.count("*").alias("n"), F.sum("price").alias("total"))


@query(["v_countries", "v_merchants"], "select c.name, count(m.id) as n from v_countries c left join v_merchants m on m.country = c.name group by 1")
def j5_left_group_count(countries, merchants):
    m = merchants.groupBy(F.col("country").alias("name")).agg(F.count("id").alias("n"))
    return countries.join(m, "name", "left").select("name", F.coalesce("n", F.lit(0)).alias("n"))
