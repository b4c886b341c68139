"""Dashboard aggregates, windows, grouping, streaming forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import misc, money, places
from ..operators import dashboard, tiles, venues
from ..sources import shared, sinks
from ..streaming import offers as stream
from .registry import query


@query(["v_merchants", "v_products"], """
  select (select count(*) from v_merchants) as merchants, (select count(*) from v_merchants where active) as active, (select count(*) from v_merchants where checked_at is not null) as checked, (select count(*) from v_merchants where website <> '') as with_site,
    (select count(*) from v_products) as products, (select count(*) from v_products where price > 50000) as expensive""")
def a1_store_counts(merchants, products):
    one = merchants.agg(F.count("*").alias("merchants"), F.count_if("active").alias("active"), F.count("checked_at").alias("checked"), F.count_if(F.col("website") != "").alias("with_site"))
    return one.crossJoin(products.agg(F.count("*").alias("products"), F.count_if(F.col("price") > 50000).alias("expensive")))


@query(["v_targets"], """
  select count(*) as total, sum(case when status <> 'not_checked' then 1 else 0 end)::bigint as checked, sum(case when status = 'no_wine_list' then 1 else 0 end)::bigint as no_list, sum(case when status = 'not_checked' then 1 else 0 end)::bigint as pending,
    sum(case when status = 'missing_website' then 1 else 0 end)::bigint as missing_website, sum(case when status in ('review', 'error') then 1 else 0 end)::bigint as needs_review, sum(case when status = 'error' then 1 else 0 end)::bigint as errors,
    sum(case when status <> 'not_checked' and lat is not null and lng is not null then 1 else 0 end)::bigint as mapped, sum(case when status <> 'not_checked' and lat is not null and lng is not null and trim(website) <> '' then 1 else 0 end)::bigint as mapped_with_website
  from v_targets""")
def a2_conditional_counts(targets):
    return dashboard.target_summary(targets)


@query(["v_sources"], "select count(distinct case when status = 'found' and parser_status = 'parsed' and coalesce(line_count, 0) > 0 then target_id end) as found from v_sources")
def a3_distinct_when(sources):
    return sources.agg(F.countDistinct(F.when(dashboard.verified(), F.col("target_id"))).alias("found"))


@query(["v_targets"], "select status, count(*) as n from v_targets group by status order by n desc, status")
def a4_status_counts(targets):
    return targets.groupBy("status").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "status")


@query(["v_sources"], "select coalesce(parser_status, status, 'unknown') as state, count(*) as n from v_sources group by 1")
def a5_group_expr(sources):
    return sources.groupBy(F.coalesce("parser_status", "status", F.lit("unknown")).alias("state")).agg(F.count("*").alias("n"))


@query(["v_targets"], "select coalesce(nullif(last_error, ''), 'Unknown error') as error, count(*) as n from v_targets where last_error is not null and last_error <> '' group by 1 order by n desc, error limit 10")
def a6_top_errors(targets):
    rows = targets.where(F.col("last_error").isNotNull() & (F.col("last_error") != ""))
    return rows.groupBy(F.coalesce(F.nullif("last_error", F.lit("")), F.lit("Unknown error")).alias("error")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "error").limit(10)


@query(["v_targets"], "select count(*) as n from (select distinct country, city from v_targets where city is not null and city <> '')")
def a7_distinct_pairs(targets):
    return targets.where("city is not null and city <> ''").agg(F.countDistinct("country", "city").alias("n"))


@query(["v_countries"], """
  select distinct unnest(case when name = 'NATION_3' then ['China', 'Hong Kong', 'Macau', 'Taiwan'] else [name] end) as name from v_countries""")
def a8_filter_values(countries):
    """Distinct filter values, one of them standing for four."""
    several = F.when(F.col("name") == "NATION_3", F.array(*map(F.lit, ["China", "Hong Kong", "Macau", "Taiwan"]))).otherwise(F.array("name"))
    return countries.select(F.explode(several).alias("name")).distinct()


@query(["v_targets", "v_sources", "v_entries"], """
  with s as (select target_id, count(*) as sources, sum(case when status = 'found' and parser_status = 'parsed' and coalesce(line_count, 0) > 0 then 1 else 0 end)::bigint as verified, sum(case when status = 'review' or parser_status = 'review' then 1 else 0 end)::bigint as review from v_sources group by 1),
  e as (select target_id, count(*) as lines from v_entries group by 1)
  select t.id, t.status, coalesce(sources, 0) as sources, coalesce(verified, 0) as verified, coalesce(review, 0) as review, coalesce(lines, 0) as lines from v_targets t left join s on s.target_id = t.id left join e on e.target_id = t.id
  where t.status <> 'not_checked' and lat is not null and lng is not null and trim(website) <> ''
  order by case when status = 'found' then 0 when status = 'no_wine_list' then 1 when status in ('review', 'error') then 2 else 3 end, name, t.id limit 7000""")
def a9_map_targets(targets, sources, entries):
    return dashboard.map_targets(targets, sources, entries).drop("name", "rank")


@query(["v_products"], """
  with e as (select merchant_id, count(*) as raw, count(distinct name || brand) as uniq from v_products group by 1), a as (select sum(raw)::bigint as raw, sum(uniq)::bigint as source_unique from e), m as (select count(distinct name || brand) as merged_unique from v_products)
  select raw, source_unique, greatest(raw - source_unique, 0) as source_duplicates, merged_unique, greatest(source_unique - merged_unique, 0) as cross_duplicates from a, m""")
def a10_dedupe_stats(products):
    return dashboard.dedupe_ratios(products.withColumn("k", F.concat("name", "brand")), "merchant_id", "k")


@query(["customer"], """
  with p as (select c_custkey as id, -60 + ((c_custkey * 7919) % 14500) / 100e0 as lat, -180 + ((c_custkey * 104729) % 36000) / 100e0 as lng, case c_custkey % 3 when 0 then 'found' when 1 then 'none' else 'pending' end as kind from customer),
  v as (select * from p where lat between -40 and 70 and (lng >= 20 or lng <= 10)), c as (select floor((lat + 90.0) / (180.0 / 64))::bigint as lat_key, floor((lng + 180.0) / (360.0 / 64))::bigint as lng_key, * from v)
  select lat_key, lng_key, count(*) as n, round(avg(lat), 6) as lat, round(avg(lng), 6) as lng, count(*) filter (where kind = 'found') as found, count(*) filter (where kind = 'none') as none, count(*) filter (where kind = 'pending') as pending,
    case when count(distinct kind) = 1 then min(kind) else 'mixed' end as kind, case when count(*) = 1 then min(id) end as point_id from c group by 1, 2""")
def a11_grid_clusters(customers):
    """A view across the antimeridian, clustered without loss."""
    points = customers.selectExpr("c_custkey as id", "-60 + ((c_custkey * 7919) % 14500) / 100e0 as lat", "-180 + ((c_custkey * 104729) % 36000) / 100e0 as lng", "case c_custkey % 3 when 0 then 'found' when 1 then 'no_wine_list' else 'review' end as status")
    seen = points.where(places.in_view(F.col("lat"), F.col("lng"), 20, -40, 10, 70))
    return dashboard.grid_clusters(seen, 3).withColumns({"lat": F.round("lat", 6), "lng": F.round("lng", 6)})


_PLACED = "select c_custkey as id, -60 + ((c_custkey * 7919) % 14500) / 100e0 as lat, -180 + ((c_custkey * 104729) % 36000) / 100e0 as lng, case c_custkey % 3 when 0 then 'found' when 1 then 'no_wine_list' else 'review' end as status from customer"
_TILE = """count(*) as n, round(avg(lat), 6) as lat, round(avg(lng), 6) as lng, count(*) filter (where status = 'found') as found, count(*) filter (where status = 'no_wine_list') as none, count(*) filter (where status = 'review') as pending,
    case when count(distinct status) > 1 then 'mixed' else max(case status when 'found' then 'found' when 'no_wine_list' then 'none' else 'pending' end) end as kind, case when count(*) = 1 then min(id) end as point_id"""


def _placed(customers):
    return customers.selectExpr("c_custkey as id", "-60 + ((c_custkey * 7919) % 14500) / 100e0 as lat", "-180 + ((c_custkey * 104729) % 36000) / 100e0 as lng", "case c_custkey % 3 when 0 then 'found' when 1 then 'no_wine_list' else 'review' end as status")


def _rounded(clusters):
    return clusters.withColumns({"lat": F.round("lat", 6), "lng": F.round("lng", 6)})


@query(["customer"], f"""
  with p as ({_PLACED}), z as (select unnest(range(0, 16)) as zoom), c as (select zoom, floor((lat + 90.0) / (180.0 / (8 * (1 << zoom))))::bigint as lat_key, floor((lng + 180.0) / (360.0 / (8 * (1 << zoom))))::bigint as lng_key, p.* from p, z)
  select zoom, lat_key, lng_key, {_TILE} from c group by 1, 2, 3""")
def a11_tile_pyramid(customers):
    """All zooms rolled up from the finest cells."""
    return _rounded(tiles.clusters(tiles.pyramid(_placed(customers)), "zoom"))


#: name, zoom, west, south, east, north: across the date line, a part of the world, a view of few rows.
_SEEN = [("line", 3, 20, -40, 10, 70), ("part", 5, -30.5, 10.25, 80, 60), ("few", 4, 100, 0, 104, 3)]


@query(["customer"], f"""
  with p as ({_PLACED}), s as (select * from (values {", ".join(f"('{n}', {z}, {w}::double, {s}::double, {e}::double, {t}::double)" for n, z, w, s, e, t in _SEEN)}) v(view, zoom, west, south, east, north)),
  m as (select * from p, s where lat between south and north and (case when west <= east then lng between west and east else lng >= west or lng <= east end)), t as (select view, count(*) as total from m group by 1),
  c as (select m.*, total <= 250 as few, floor((lat + 90.0) / (180.0 / (8 * (1 << zoom))))::bigint as lat_key, floor((lng + 180.0) / (360.0 / (8 * (1 << zoom))))::bigint as lng_key from m join t using (view))
  select view, case when few then null else lat_key end as lat_key, case when few then null else lng_key end as lng_key, {_TILE} from c group by 1, 2, 3, case when few then id end""")
def a11_views(customers):
    """Views read from the pyramid, their rims from the points; few rows are shown as points."""
    points = _placed(customers)
    pyramid = shared.stored(tiles.pyramid(points, 6), "tiles")
    out = None
    for name, *bounds in _SEEN:
        part = _rounded(tiles.view(pyramid, points, *bounds)).withColumn("view", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out

@query(["v_targets"], """
  with r as (select id, country, row_number() over (partition by country order by abs((id * 1103515245 + 12345) % 2147483647), id) as rn from v_targets), s as (select country, count(*) as size from v_targets group by 1),
  t as (select *, count(*) over () as groups, (sum(size) over ())::bigint as total from s), u as (select *, least(200, total) - groups as slots, total - groups as others from t),
  v as (select *, case when slots > 0 and others > 0 then slots * (size - 1) / others else 0.0 end as raw from u), w as (select *, least(size - 1, floor(raw)::bigint) as extra from v),
  x as (select *, greatest(0, slots - (sum(extra) over ())::bigint) as rest, sum(case when size - 1 > extra then 1 else 0 end) over (order by extra - raw, country rows unbounded preceding) as turn from w),
  y as (select country, 1 + extra + case when size - 1 > extra and turn <= rest then 1 else 0 end as alloc from x)
  select id, r.country from r join y on r.country = y.country where rn <= alloc""")
def a12_balanced_sample(targets):
    return dashboard.balanced_sample(targets.select("id", "country"), "country", 200)


@query(["v_lines", "v_merchants"], """
  with r as (select l.id, m.name, m.city, m.country, nullif(m.website, '') as website, l.vintage, m.id % 13 = 0 as needs_review, trim(regexp_replace(lower(m.name), '[^a-z0-9]+', ' ', 'g')) || '|' || trim(regexp_replace(lower(m.city), '[^a-z0-9]+', ' ', 'g')) || '|' || trim(regexp_replace(lower(m.country), '[^a-z0-9]+', ' ', 'g')) as venue_key
    from v_lines l join v_merchants m on l.venue_id = m.id)
  select venue_key, min_by(name, id) as name, min_by(city, id) as city, min_by(country, id) as country, min_by(website, id) filter (where website is not null) as website, bool_or(needs_review) as needs_review, count(*) as lines from r group by 1""")
def a13_venue_groups(lines, merchants):
    m = merchants.select(F.col("id").alias("venue_id"), F.col("name"), "city", "country", "website", (F.col("id") % 13 == 0).alias("needs_review"))
    rows = lines.select("id", "venue_id").join(m, "venue_id")
    return venues.grouped(rows, venues.venue_key(F.col("name"), F.col("city"), F.col("country")), F.col("id"), ["name", "city", "country", "website"])


@query(["v_lines"], """
  with k as (select venue_id, id % 3 as kind, id, price * case currency when 'EUR' then 1705.0 when 'USD' then 1465.0 when 'GBP' then 1945.0 else 1815.0 end as krw from v_lines)
  select venue_id, kind, floor(min(krw) + 0.5)::bigint as krw, min_by(id, (krw, id)) as id from k group by 1, 2""")
def a14_min_krw_offer(lines):
    return venues.cheapest_offers(lines.withColumn("kind", F.col("id") % 3), ["venue_id", "kind"])


@query(["v_sources"], "select target_id, max(checked_at)::date as at, strftime(max(checked_at), '%-d %b %Y') as updated from v_sources group by 1")
def a15_latest(sources):
    rows = sources.withColumn("updated", F.date_format("checked_at", "d MMM yyyy"))
    return venues.latest_updated(rows, "target_id", "updated", misc.parse_updated(F.col("updated")))


@query(["v_lines"], "select id from (select id, row_number() over (partition by lower(trim(text)), vintage, currency, price, venue_id order by id) as rn from v_lines) where rn = 1")
def a16_dedupe5(lines):
    from ..operators.search import distinct_by

    return distinct_by(lines, [F.lower(F.trim("text")), F.col("vintage"), F.col("currency"), F.col("price"), F.col("venue_id")], [F.col("id")]).select("id")


@query(["v_lines"], """
  with s as (select *, case when id % 2 = 0 then 'DB' else 'Live' end as source from v_lines)
  select name, brand, vintage, currency, max(id) as id, case when count(distinct source) > 1 then 'DB + Live' else min(source) end as source from s group by 1, 2, 3, 4""")
def a17_source_merge(lines):
    return venues.merged_sources(lines.withColumn("source", F.when(F.col("id") % 2 == 0, "DB").otherwise("Live")), ["name", "brand", "vintage", "currency"], F.col("id"))


@query(["v_lines", "v_merchants"], """
  with g as (select m.id, m.country, count(*) as lines, bool_or(m.id % 13 = 0) as needs_review from v_lines l join v_merchants m on l.venue_id = m.id group by 1, 2)
  select count(*) as places, sum(lines)::bigint as lines, count(distinct country) as countries, sum(case when needs_review then 1 else 0 end)::bigint as reviews from g""")
def a18_kpis(lines, merchants):
    m = merchants.select(F.col("id").alias("venue_id"), "country", (F.col("id") % 13 == 0).alias("needs_review"))
    groups = lines.select("venue_id").join(m, "venue_id").groupBy("venue_id", "country").agg(F.count("*").alias("lines"), F.bool_or("needs_review").alias("needs_review"))
    return venues.kpis(groups)


@query(["documents", "labels"], """
  select source, count(*) as n, sum(case when coalesce(l.quality, 0) = 1 then 1 else 0 end)::bigint as good, sum(least(len(string_split(coalesce(text, ''), 'the')) - 1, 4))::bigint as evidence, count(distinct lang) as langs
  from documents d left join labels l on d.doc_id = l.doc_id group by 1""")
def a19_evidence_counts(docs, labels):
    """Rows, good rows, evidence and languages of each source; a document's evidence counts 4 at most."""
    the = F.least(F.size(F.split(F.coalesce("text", F.lit("")), "the", -1)) - 1, F.lit(4))
    return docs.join(labels, "doc_id", "left").groupBy("source").agg(
        F.count("*").alias("n"), F.sum(F.when(F.coalesce("quality", F.lit(0)) == 1, 1).otherwise(0)).alias("good"), F.sum(the).alias("evidence"), F.countDistinct("lang").alias("langs"))


@query(["v_offers"], """
  with h as (select distinct product_id, status, price from v_offers where id % 3 = 0)
  select o.product_id, o.status, o.price, min(o.seen_at) as seen_at from v_offers o where not exists (select 1 from h where h.product_id = o.product_id and h.status = o.status and h.price = o.price) group by 1, 2, 3""")
def a20_offer_history(rows):
    from ..operators.merge import append_history

    known = rows.where("id % 3 = 0").groupBy("product_id", "status", "price").agg(F.min("seen_at").alias("seen_at"))
    return append_history(known, rows, ["product_id", "status", "price"], "seen_at")


@query(["v_targets", "v_sources"], """
  with n as (select target_id, count(*) as n from v_sources group by 1) select id, name, coalesce(n, 0) as priority from v_targets t left join n on n.target_id = t.id order by coalesce(n, 0) desc, name, id limit 120""")
def a21_status_export(targets, sources):
    n = sources.groupBy("target_id").agg(F.count("*").alias("n"))
    out = targets.join(n, targets["id"] == n["target_id"], "left").withColumn("priority", F.coalesce("n", F.lit(0)))
    return dashboard.top_targets(out).select("id", "name", "priority")


@query(["v_countries", "v_merchants"], "select 'c' || c.id as code, c.name, count(m.id) as places from v_countries c left join v_merchants m on m.country = c.name and m.id % 2 = 1 group by 1, 2")
def a21_source_places(countries, merchants):
    """Places of every source, of those without too."""
    at = merchants.where("id % 2 = 1").join(countries.select(F.col("id").alias("source_id"), F.col("name").alias("country")), "country")
    return dashboard.source_places(countries.select("id", F.concat(F.lit("c"), "id").alias("code"), "name"), at, "source_id")


@query(["v_entries", "v_targets"], "select e.id, e.text, e.last_seen, t.name, t.city, t.country from (select * from v_entries where target_id in (select id from v_targets) order by last_seen desc, id, text limit 300) e join v_targets t on t.id = e.target_id")
def a21_latest_entries(entries, targets):
    return dashboard.latest_entries(entries, targets).select("id", "text", "last_seen", "name", "city", "country")


@query(["v_samples"], """
  with d as (select run_id, id, ts, row_number() over (partition by run_id order by ts, id) as done from v_samples), a as (select run_id, min(ts) as started, count(*) as all_ from v_samples group by 1),
  k as (select 500 as most union all select 1), l as (select *, row_number() over (partition by most, run_id order by ts desc, id desc) as rn from d, k),
  e as (select most, run_id, max(done) as done, min(done) as least, epoch_us(max(ts)) / 1e6 as u, epoch_us(min(ts)) / 1e6 as s from l where rn <= most group by 1, 2),
  r as (select e.*, coalesce(case when done > least then (done - least) / greatest(0.001, u - s) end, done / floor(epoch_us(timestamp '2030-01-01') / 1e6 - epoch_us(started) / 1e6)) as rate from e join a using (run_id))
  select most, run_id, done, round(rate, 9) as rate, floor((2 * done - done) / rate)::bigint as seconds_left from r""")
def n3_seconds_left(samples):
    """Time left by the last samples' rate, and by the overall rate where one sample alone is looked at."""
    from pyspark.sql import Window as W

    done = samples.withColumn("done", F.row_number().over(W.partitionBy("run_id").orderBy("ts", "id")).cast("long"))
    now = F.lit("2030-01-01").cast("timestamp")
    parts = [dashboard.remaining_seconds(done, "run_id", 2 * F.col("done"), now, most).withColumn("most", F.lit(most)) for most in (500, 1)]
    return parts[0].unionByName(parts[1]).withColumn("rate", F.round("rate", 9))


@query(["v_samples"], """
  with s as (select run_id, count(*) as total, count(*) filter (where value > 50) as processed from v_samples group by 1)
  select run_id, total, processed, greatest(0.0, least(100.0, round_even(100.0 * processed / total, 1)))::double as percent, greatest(0, total - processed) as remaining from s""")
def a22_progress(samples):
    s = samples.groupBy("run_id").agg(F.count("*").alias("total"), F.count_if(F.col("value") > 50).alias("processed"))
    return s.select("run_id", "total", "processed", *dashboard.progress(F.col("total"), F.col("processed")))


@query(["v_targets", "v_sources"], """
  with c as (select target_id, count(*) as n, max(line_count) as most from v_sources group by 1) select id, greatest(n, most) as lines from v_targets t join c on c.target_id = t.id where t.status = 'found' and greatest(n, most) >= 10""")
def a23_map_filter(targets, sources):
    c = sources.groupBy("target_id").agg(F.count("*").alias("n"), F.max("line_count").alias("most"))
    return targets.where("status = 'found'").join(c, targets["id"] == c["target_id"]).select("id", F.greatest("n", "most").alias("lines")).where("lines >= 10")


@query(["v_sources", "v_targets"], """
  with r as (select s.id, s.target_id, row_number() over (partition by s.target_id order by case when s.status = 'found' and s.parser_status = 'parsed' and coalesce(line_count, 0) > 0 then 0 else 1 end, case when website <> '' and s.url = website then 1 else 0 end, case when source_type = 'pdf' then 0 else 1 end,
    case when regexp_matches(lower(url), 'wine|vin|wein|drink|beverage|pdf') then 0 else 1 end, coalesce(line_count, 0) desc, checked_at desc, s.id) as rn from v_sources s join v_targets t on s.target_id = t.id) select id, target_id from r where rn = 1""")
def n1_best_source(sources, targets):
    return dashboard.best_sources(sources, targets).select("id", "target_id")


@query(["v_samples"], """
  with l as (select *, row_number() over (partition by run_id order by ts desc, id desc) as rn from v_samples), s as (select run_id, count(*) as n, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 as span from l where rn <= 500 group by 1)
  select run_id, n, round(case when span > 0 then (n - 1) / span end, 9) as rate from s""")
def n3_rate_eta(samples):
    return dashboard.recent_rate(samples, "run_id").withColumn("rate", F.round("rate", 9))


@query(["v_samples"], """
  with b as (select *, value > 60 as b, sum(case when value > 60 then 0 else 1 end) over (partition by run_id order by ts, id rows unbounded preceding) as island from v_samples), n as (select run_id, island, count(*) as n from b where b group by 1, 2)
  select run_id, max(n) as longest, max(n) >= 3 as opened from n group by 1""")
def n5_circuit(samples):
    return dashboard.blocked_streaks(samples, "run_id", F.col("value") > 60, 3)


@query(["v_samples"], "select id, run_id, floor(greatest(0.0, least(100.0, value - lag(value) over (partition by run_id order by ts, id))) * 10 + 0.5) / 10 as delta from v_samples")
def n7_deltas(samples):
    rows = dashboard.counter_deltas(samples, "run_id")
    return rows.select("id", "run_id", "delta")


@query(["v_offers"], "select product_id, status, price, min(seen_at) as first_seen from v_offers group by 1, 2, 3")
def z1_offer_dedupe(rows):
    return stream.offer_history(rows)


@query(["v_samples"], """
  with g as (select *, case when ts - lag(ts) over (partition by run_id order by ts) >= interval 15 minutes then 1 else 0 end as new from v_samples), s as (select *, sum(new) over (partition by run_id order by ts rows unbounded preceding) as session from g)
  select run_id, min(ts) as started, max(ts) + interval 15 minutes as stalled_at, count(*) as n from s group by run_id, session""")
def z2_stall_sessions(samples):
    return stream.stalls(samples, "run_id", "ts")


@query(["v_samples"], "select run_id, time_bucket(interval '6 hours', ts, timestamp '1970-01-01') as started, count(*) as n, max(value) as peak from v_samples group by 1, 2")
def z4_sample_windows(samples):
    return stream.sample_windows(samples, "run_id", "ts", F.col("value"), "6 hours")


@query(["v_lines"], "select id, text, (row_number() over (order by id, text) - 1) // 50 as chunk from v_lines")
def k1_chunks(lines):
    return sinks.chunked(lines.select("id", "text"), ["id", "text"]).select("id", "text", F.col("chunk").cast("long").alias("chunk"))


@query(["v_targets"], "select id, '{' || concat_ws(',', '\"id\":' || id, '\"name\":\"' || name || '\"', case when website <> '' then '\"website\":\"' || website || '\"' end, case when last_error <> '' then '\"last_error\":\"' || last_error || '\"' end) || '}' as json from v_targets")
def k7_compact(targets):
    return targets.select("id", F.to_json(F.struct("id", "name", F.nullif("website", F.lit("")).alias("website"), F.nullif("last_error", F.lit("")).alias("last_error"))).alias("json"))


@query(["v_lines"], "select currency, count(*) as n, sum(floor(price * case currency when 'EUR' then 1705.0 when 'USD' then 1465.0 when 'GBP' then 1945.0 else 1815.0 end + 0.5)::bigint)::bigint as krw from v_lines group by 1")
def x34_krw(lines):
    return lines.groupBy("currency").agg(F.count("*").alias("n"), F.sum(money.rounded_krw(F.col("price").cast("double"), F.col("currency"))).alias("krw"))
