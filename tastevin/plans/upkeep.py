"""Work lists, filters, maintenance and publishing."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import merge, reviews, selection
from .registry import query

#: Countries as directories write them, and the code that each means in the city beside it.
_WRITTEN = [("France", "Paris", "FR"), ("fr", "Lyon", "FR"), ("프랑스", "", "FR"), ("Greater China", "Taipei", "TW"), ("Hong Kong SAR", "", "HK"), ("greater china", "Hong Kong", "HK"), ("Atlantis", "", ""), ("TW", "", "TW"), ("Frankreich", "", "")]


def _written(rows, key):
    pairs = F.array(*(F.struct(F.lit(a).alias("country"), F.lit(b).alias("city")) for a, b, _ in _WRITTEN))
    return rows.withColumn("x", F.get(pairs, (F.col(key) % len(_WRITTEN)).cast("int"))).withColumns({"country": F.col("x.country"), "city": F.col("x.city")}).drop("x")


@query(["v_targets"], f"select id, w as wanted from (select id, {[c for _, _, c in _WRITTEN]}[(id % {len(_WRITTEN)} + 1)::int] as code from v_targets) join (values ('FR'), ('HK'), ('TW')) t(w) on code = w")
def f1_country(targets):
    """Countries asked for by name, alias and code, whatever the rows write."""
    rows = _written(targets.select("id"), "id")
    out = None
    for wanted, code in (("france", "FR"), ("HK", "HK"), ("대만", "TW")):
        part = selection.in_country(rows, wanted, city="city").select("id", F.lit(code).alias("wanted"))
        out = part if out is None else out.unionByName(part)
    return out


@query(["v_lines", "v_sources"], "select id from v_lines where list_id in (select id from v_sources where status = 'found' and line_count > 5)")
def f4_live_ids(lines, sources):
    return selection.among(lines, sources.where("status = 'found' and line_count > 5").select(F.col("id").alias("list_id")), "list_id").select("id")


@query(["v_merchants", "v_products"], """
  with n as (select m.id, (select count(*) from v_products p where p.merchant_id = m.id) as n from v_merchants m)
  select id, s as status from n, (values ('all', 0), ('found', 1), ('100', 100), ('600', 600)) t(s, least) where n >= least""")
def f6_shop_status(merchants, products):
    parts = [selection.by_products(merchants, products, s).select("id", F.lit(s).alias("status")) for s in ("all", "found", "100", "600")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query(["v_merchants"], "select id, row_number() over (order by coalesce(checked_at, ''), id) as turn from v_merchants where active and website <> '' and (checked_at is null or checked_at < '2026-01-15')")
def f8_work_queue(merchants):
    return selection.queue_turns(merchants, F.lit("2026-01-15")).select("id", "turn")


@query(["v_sources", "v_products"], """
  select 'file' as kind, id from (select id, case when id % 7 = 0 then '' when id % 7 = 1 then null else url end as url from v_sources) where coalesce(trim(url), '') = ''
  union all select 'lines', id from v_sources where line_count is null or line_count = 0 union all select 'price', id from (select id, case id % 11 when 0 then null when 1 then 0 when 2 then -price else price end as price from v_products) where price is null or price <= 0""")
def f9_review(sources, products):
    """Lists without a file or without lines, and prices that are none."""
    files = sources.withColumn("url", F.when(F.col("id") % 7 == 0, "").when(F.col("id") % 7 == 1, F.lit(None)).otherwise(F.col("url")))
    k, price = F.col("id") % 11, F.col("price")
    priced = products.withColumn("price", F.when(k == 0, F.lit(None)).when(k == 1, 0.0).when(k == 2, -price).otherwise(price))
    pick = lambda df, kind: df.where(selection.needs_review(kind)).select(F.lit(kind).alias("kind"), "id")
    return pick(files, "file").unionByName(pick(sources, "lines")).unionByName(pick(priced, "price"))


@query(["v_targets", "v_sources"], """
  with n as (select target_id, count(*) as n from v_sources group by 1), t as (select id, name, city, country, coalesce(n, 0) as matches from v_targets left join n on target_id = id)
  (select 'city' as by, id, row_number() over (order by lower(city), id) as turn from t) union all (select 'matches', id, row_number() over (order by matches desc, id) from t)""")
def l4_sort(targets, sources):
    """The order toggles, as the turn that each gives a row."""
    n = sources.groupBy(F.col("target_id").alias("id")).agg(F.count("*").alias("matches"))
    rows = targets.join(n, "id", "left")
    out = []
    for by, descending in (("city", False), ("matches", True)):
        out.append(selection.turns(rows.select("id", "city", "matches"), by, descending).select(F.lit(by).alias("by"), "id", "turn"))
    return out[0].unionByName(out[1])


@query(["v_targets"], "select distinct c as name from (select ['France', 'France', 'France', 'Taiwan', 'Hong Kong', 'Hong Kong', 'Atlantis', 'Taiwan', 'Frankreich'][(id % 9 + 1)::int] as c from v_targets) where c is not null union select 'South Korea'")
def l9_country_names(targets):
    """One set of display names out of several stores' spellings; the region of several countries goes by the city."""
    rows = _written(targets.select("id"), "id")
    settled = merge.countries_migrated(rows, city="city").select("country")
    return selection.country_names(settled, targets.sparkSession.createDataFrame([("대한민국",), ("",), (None,), ("KR",)], "c string"))


@query(["v_lines", "v_merchants", "v_sources"], """
  select l.id::varchar as id, l.price::double as price, m.id as venue_id, m.country, m.website as venue_url, l.list_id, s.url as list_url from v_lines l join v_merchants m on m.id = l.venue_id join v_sources s on s.id = l.list_id""")
def p1_result_record(lines, merchants, sources):
    """Nested result records, read back field by field."""
    m = merchants.select(F.col("id").alias("venue_id"), F.col("name").alias("venue"), "city", "country", "lat", "lng", "website")
    rows = lines.select("id", "text", "vintage", "price", "currency", "venue_id", "list_id").join(m, "venue_id").join(sources.select(F.col("id").alias("list_id"), F.col("url").alias("list_url")), "list_id")
    r = selection.result_record(rows)
    return r.select("id", F.col("priceValue").alias("price"), F.col("venue.id").alias("venue_id"), F.col("venue.country").alias("country"), F.col("venue.url").alias("venue_url"), F.col("wineList.id").alias("list_id"), F.col("wineList.downloadUrl").alias("list_url"))


@query(["v_targets"], """
  select count(*) as total, count(*) filter (where status = 'found') as found, count(*) filter (where status = 'no_wine_list') as none, count(*) filter (where status = 'review') as review,
    count(*) filter (where status not in ('found', 'no_wine_list', 'review')) as pending from v_targets""")
def p5_progress_counts(targets):
    """A snapshot's counts, its statuses under whichever name it has them."""
    snapshot = targets.select(F.when(F.col("id") % 2 == 0, F.col("status")).alias("status"), F.when(F.col("id") % 2 == 1, F.col("status")).alias("collectionStatus"))
    return selection.progress_counts(selection.snapshot_fallback(snapshot, {"status": ["status", "collectionStatus", "state"]}))


@query(["v_merchants"], """
  with d as (select id::varchar as pid, name, country, id % 4 as k, case when id % 3 = 0 then address else '' end as street, city from v_merchants where id % 4 in (0, 1))
  select pid as provider_place_id, case k when 0 then 'retail_primary_category' else 'retail_name' end as candidate_reason, case k when 0 then 'wine_shop' else 'food' end as primary_category, case when street <> '' then street else city || ', ' || upper(country) end as address from d""")
def x44_candidates(merchants):
    """Directory rows by category or by name; those of other trades, without a name or without evidence are left out."""
    k = F.col("id") % 4
    rows = merchants.select(
        F.col("id").cast("string").alias("id"), F.when(k == 3, " ").when(k == 1, F.concat(F.lit("Fine Wines "), "name")).otherwise(F.concat(F.lit("Wine bar "), "name")).alias("name"), F.when(k == 0, "wine_shop").otherwise("food").alias("old_primary"),
        F.lit(None).cast("string").alias("categories_json"), F.lit(None).cast("string").alias("basic_category"), F.lit(None).cast("string").alias("taxonomy_primary"), F.when(k == 2, "restaurant").alias("taxonomy_json"),
        F.when(F.col("id") % 3 == 0, F.col("address")).alias("address"), "city", F.lit(None).cast("string").alias("region"), F.lit("").alias("postcode"), F.col("country").alias("country_code"), F.col("lat").alias("latitude"), F.col("lng").alias("longitude"))
    return selection.candidate_records(rows).select("provider_place_id", "candidate_reason", "primary_category", "address")


@query(["v_targets"], """
  with t as (select id, lat, lng, id % 5 as k, city from v_targets), c as (select city, min((lat, lng)) as x from t where lat is not null and k = 0 group by 1)
  select t.id, case when t.k = 0 and t.lat is not null then t.lat when t.k = 1 then 1.5 when t.k = 2 then 2.5 else c.x[1] end as lat, t.k not in (1, 2) and not (t.k = 0 and t.lat is not null) and c.x is not null as approximate from t left join c on c.city = t.city""")
def x45_coordinates(targets):
    """Own coordinates, the same place's, the geocoder's, the city's, in this order; the last are approximate."""
    k = F.col("id") % 5
    groups = targets.select("id", F.col("id").alias("place_key"), F.col("city").alias("city_key"), F.when(k == 0, F.col("lat")).when(k == 3, 0.0).alias("lat"), F.when(k == 0, F.col("lng")).when(k == 3, 0.0).alias("lng"))
    exact = targets.where(k == 1).select(F.col("id").alias("place_key"), F.lit(1.5).alias("lat"), F.lit(1.0).alias("lng"))
    geocoded = targets.where(k.isin(1, 2)).select(F.col("id").alias("place_key"), F.lit(2.5).alias("lat"), F.lit(1.0).alias("lng"))
    cities = targets.where(k == 0).select(F.col("city").alias("city_key"), "lat", "lng")
    return selection.with_coordinates(groups, exact, cities, geocoded).select("id", "lat", "approximate")


@query(["v_sources", "v_entries"], "select id from v_entries e where exists (select 1 from v_sources s where s.id = e.source_id and s.status = 'found')")
def j7_with_parent(sources, entries):
    return merge.with_parent(entries, sources.where("status = 'found'"), "source_id").select("id")


@query(["v_targets", "v_sources", "v_entries"], """
  with t as (select id, case when id % 3 <> 0 then 'new ' || name else name end as name, case when id % 3 = 0 then 'kept' when id % 3 = 1 then 'kept' end as raw from v_targets),
  s as (select id from v_sources where id % 2 = 0), e as (select id from v_entries where id % 4 = 0), r as (select g.i as id, case when i in (2, 3, 4) then 'staged' else 'live' end as status from range(0, 6) g(i) where i <= 4)
  select 'targets' as relation, id, coalesce(name || ' ' || coalesce(raw, '-'), '') as value from t union all select 'sources', id, '' from s union all select 'entries', id, '' from e union all select 'runs', id, status from r""")
def u7_staged_publish(targets, sources, entries):
    """Targets inserted and updated column by column (one column isn't staged), sources and entries replaced, runs by id."""
    spark = targets.sparkSession
    live = {
        "targets": targets.where("id % 3 <> 2").select("id", "name", F.lit("kept").alias("country_raw")), "sources": sources.where("id % 5 = 0").select("id"), "entries": entries.where("id % 7 = 0").select("id"),
        "runs": spark.range(0, 4).select("id", F.lit("live").alias("status")),
    }
    staged = {
        "targets": targets.where("id % 3 <> 0").select("id", F.concat(F.lit("new "), "name").alias("name")), "sources": sources.where("id % 2 = 0").select("id"), "entries": entries.where("id % 4 = 0").select("id"),
        "runs": spark.range(2, 5).select("id", F.lit("staged").alias("status")),
    }
    out = merge.staged_publish(live, staged)
    shown = {"targets": F.concat_ws(" ", "name", F.coalesce("country_raw", F.lit("-"))), "sources": F.lit(""), "entries": F.lit(""), "runs": F.col("status")}
    parts = [out[k].select(F.lit(k).alias("relation"), "id", v.alias("value")) for k, v in shown.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query(["v_targets"], f"""
  with w as (select id, {[a for a, _, _ in _WRITTEN]}[(id % 9 + 1)::int] as raw, ['France', 'France', 'France', 'Taiwan', 'Hong Kong', 'Hong Kong', 'Atlantis', 'Taiwan', 'Frankreich'][(id % 9 + 1)::int] as country from v_targets) select id, country, raw as country_raw from w""")
def u15_countries_migrated(targets):
    """Display names, with what was written beside them; a second run changes nothing."""
    once = merge.countries_migrated(_written(targets.select("id"), "id"), city="city")
    return merge.countries_migrated(once, city="city").select("id", "country", "country_raw")


@query(["v_targets", "v_sources"], """
  with t as (select id, case when exists (select 1 from v_sources s where s.target_id = t.id and s.status = 'review') then 'not_checked' else status end as status from v_targets t where id % 4 <> 0 union all select id, status from v_targets where id % 4 = 0)
  select id, status from t""")
def u16_reset(targets, sources):
    """Reset of some targets, restore of those lost, and cached files that a source still needs."""
    lost = targets.where("id % 4 <> 0").select("id", "status")
    back = merge.reset(lost, {"status": F.lit("not_checked")}, sources.where("status = 'review'").select(F.col("target_id").alias("id")))
    return merge.restored(back, targets.select("id", "status"), ["id"])


@query(["v_sources"], "select url from (select distinct url from v_sources) where url in (select url from v_sources where status <> 'candidate')")
def u16_prune(sources):
    return merge.pruned(sources.select("url").distinct(), sources.where("status <> 'candidate'"))


@query(["v_targets", "v_sources"], """
  with t as (select id, website, lat, status, id % 6 as k from v_targets), a as (
    select id, k, (k = 1 and website <> '') or (k = 2 and lat is not null) as changed,
      case when k = 1 then 'https://other.example.org' else website end as site, case when k = 2 and lat is not null then lat + 1 else lat end as lat, status, website from t)
  select id, round(lat, 6) as lat, changed, case when changed then 'not_checked' when k <> 5 and coalesce(site, '') = '' then 'missing_website' else status end as status, (select count(*) from v_sources s where s.target_id = a.id and not a.changed) as lists from a""")
def u17_location_audit(targets, sources):
    """Another host or more than 10 km apart: the target starts anew and loses its lists."""
    k = F.col("id") % 6
    rows = targets.select("id", "website", F.lit("").alias("address"), "lat", "lng", "status", F.lit("2026-01-01").alias("checked_at"), "last_error")
    looked = targets.where(k != 5).select("id", F.when(k == 1, "https://other.example.org").when(k == 3, F.concat("website", F.lit("/"))).otherwise("").alias("website"), F.lit("").alias("address"), F.when(k == 2, F.col("lat") + 1).when(k == 3, F.col("lat")).alias("lat"), F.when(k.isin(2, 3), F.col("lng")).alias("lng"), F.lit("").alias("error"))
    audited = merge.location_audit(rows, looked)
    left = merge.orphaned_by(sources, audited, "target_id").groupBy(F.col("target_id").alias("id")).agg(F.count("*").alias("lists"))
    return audited.join(left, "id", "left").select("id", F.round("lat", 6).alias("lat"), "changed", "status", F.coalesce("lists", F.lit(0)).alias("lists"))


_RUN = "select id as merchant_id, case (id + {k}) % 4 when 0 then 'found' when 1 then 'review' else 'rejected' end as status, case when id % 3 = 0 then '' else 'error ' || (id + {k}) % 5 end as error from v_merchants where (id + {k}) % 4 < 3"
_TIMES = ["2026-02-01 00:00:00", "2026-02-02 00:00:00", "2026-02-03 00:00:00"]


def _cycle(k: int) -> str:
    """SQL of the queue q{k + 1} after run k on q{k}."""
    at = f"timestamp '{_TIMES[k]}'"
    return f"""
  r{k} as ({_RUN.format(k=k)}),
  e{k} as (select merchant_id, 'business_identity_mismatch' as reason, coalesce(nullif(error, ''), 'Official website belongs to a different business.') as detail, true as opens from r{k} where status = 'rejected'
    union all select merchant_id, 'inventory_fetch_failed', coalesce(nullif(error, ''), 'Unknown error'), true from r{k} where status = 'review' union all select merchant_id, 'inventory_fetch_failed', null, false from r{k} where status <> 'review'),
  q{k + 1} as (select * from q{k} where status <> 'open'
    union all select q.merchant_id, q.reason, q.detail, q.opened_at, q.valid_from, case when e.opens is null then q.valid_to else {at} end, case when e.opens is null then 'open' when e.opens then 'refreshed' else 'resolved' end from q{k} q left join e{k} e using (merchant_id, reason) where q.status = 'open'
    union all select e.merchant_id, e.reason, e.detail, coalesce(q.opened_at, {at}), {at}, null, 'open' from e{k} e left join (select * from q{k} where status = 'open') q using (merchant_id, reason) where e.opens)"""


@query(["v_merchants"], f"""
  with q0 as (select 0::bigint as merchant_id, '' as reason, '' as detail, null::timestamp as opened_at, null::timestamp as valid_from, null::timestamp as valid_to, '' as status where false), {_cycle(0)}, {_cycle(1)}, {_cycle(2)}
  select * from q3""")
def u9_review_queue(merchants):
    """Three runs, one after the other: reviews open, are refreshed, resolved and opened again, each with its time."""
    spark = merchants.sparkSession
    queue = spark.createDataFrame([], reviews.SCHEMA)
    for k, at in enumerate(_TIMES):
        results = merchants.selectExpr("id as merchant_id", f"case (id + {k}) % 4 when 0 then 'found' when 1 then 'review' else 'rejected' end as status", f"case when id % 3 = 0 then '' else 'error ' || cast((id + {k}) % 5 as string) end as error").where(f"(merchant_id + {k}) % 4 < 3")
        queue = reviews.after_run(queue, results, F.lit(at).cast("timestamp"))
    return queue
