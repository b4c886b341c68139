"""Search, watch, ranking and limit queries."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text
from ..operators import dashboard, fulltext, search, watch
from ..operators.search import SearchParams
from ..sources import shared
from .registry import query

_FOLD = "strip_accents(replace(lower({c}), 'ß', 'ss'))"


@query(["v_products", "v_merchants"], """
  select p.id, p.name, m.name as merchant, p.price, p.vintage from v_products p join v_merchants m on p.merchant_id = m.id
  where m.active and contains(lower(concat_ws(' ', m.name, p.name, p.brand)), 'red') and contains(lower(concat_ws(' ', m.name, p.name, p.brand)), 'widget')
    and contains(lower(m.city), 'city') order by p.price nulls last, p.seen_at desc, m.name, p.id limit 100""", heavy=True)
def t5_shop_search(products, merchants):
    """All tokens over product and merchant, city filter, cheapest first."""
    return search.shop_search(products, merchants, SearchParams("Red WIDGET", city="city", limit=100)).select("id", "name", "merchant", "price", "vintage")


@query(["documents"], f"""
  with w as (select doc_id, {_FOLD.format(c="text")} as f from documents),
  x as (select doc_id, f, regexp_extract_all(f, '[\\p{{L}}\\p{{N}}_]+') as ws from w)
  select doc_id from x where (contains(f, 'ofthe') or list_has_any(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ws[i + 1]), list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ws[i + 1] || ws[i + 2])),
    ['ofthe', 'fothe', 'otfhe', 'ofhte', 'ofteh'])) and contains(f, 'and')""", heavy=True)
def t3_fuzzy_tokens(docs):
    """Joined words and one swap of neighbours, without a UDF."""
    return docs.where(text.matches_all(["ofthe", "and"], text.fold("text"))).select("doc_id")


@query(["documents"], f"""
  with h as (select source, doc_id, n_chars from documents where contains({_FOLD.format(c="text")}, 'thing')),
  r as (select *, row_number() over (partition by source order by n_chars desc, doc_id) as rn from h)
  select source, doc_id, n_chars from r where rn = 1""", heavy=True)
def t7_first_per_source(docs):
    hits = docs.where(text.matches_all(["thing"], text.fold("text"))).select("source", "doc_id", "n_chars")
    return search.distinct_by(hits, [F.col("source")], [F.desc("n_chars"), F.col("doc_id")])


@query(["v_entries", "v_sources", "v_targets"], """
  with h as (select e.id, t.name, s.id as source_id, t.city, t.country, case when s.id % 4 = 0 then '' when s.id % 4 = 1 then upper(s.url) else s.url end as url from v_entries e join v_sources s on e.source_id = s.id join v_targets t on e.target_id = t.id where s.status = 'found' and contains(lower(e.text), 'blue')),
  k as (select *, case when url <> '' then lower(url) else lower(concat_ws('|', name, city, country)) end as key from h), r as (select *, row_number() over (partition by key order by name, source_id, id) as rn from k)
  select id, name, source_id from r where rn = 1 order by name, source_id, id limit 300""", heavy=True)
def t7_found_lists(entries, sources, targets):
    """Lines of lists that were found, the first of each list's address, or of its place where it has none."""
    k, url = F.col("id") % 4, F.col("url")
    lists = sources.where("status = 'found'").select(F.col("id").alias("source_id"), F.when(k == 0, "").when(k == 1, F.upper(url)).otherwise(url).alias("url"))
    rows = entries.join(lists, "source_id").join(targets.select(F.col("id").alias("target_id"), "name", "city", "country"), "target_id")
    p = SearchParams("blue", limit=300)
    return search.first_per_source(rows, p, search.list_address("url", "name", "city", "country"), ["name", "source_id", "id"], "text").select("id", "name", "source_id")


@query(["v_lines", "v_entries", "v_products"], """
  select * from (
    (select 0 as arm, id, row_number() over (order by price nulls last, id) as rank from v_lines where contains(lower(text), 'blue') and contains(lower(text), 'bolt') order by price nulls last, id limit 50)
    union all (select 1, id, row_number() over (order by id) from v_entries where contains(lower(text), 'blue') and contains(lower(text), 'bolt') order by id limit 50)
    union all (select 2, id, row_number() over (order by price nulls last, id) from v_products where contains(lower(name), 'blue') and contains(lower(name), 'bolt') order by price nulls last, id limit 50))""", heavy=True)
def t8_integrated_union(lines, entries, products):
    """Three arms, each with its own order and limit, one after the other."""
    p = SearchParams("blue bolt")
    arms = [
        (search.filtered(lines.select("id", "text", F.col("price").cast("double").alias("price")), p, F.col("text")), [F.asc_nulls_last("price"), F.col("id")]),
        (search.filtered(entries.select("id", "text"), p, F.col("text")), [F.col("id")]),
        (search.filtered(products.select("id", "name", "price"), p, F.col("name")), [F.asc_nulls_last("price"), F.col("id")]),
    ]
    return search.ranked_union(arms, 50).select("arm", "id", "rank")


@query(["v_lines"], "select id, text from v_lines where contains(lower(text), 'small') and contains(lower(text), 'ring') and contains(lower(text), 'economy') and (vintage = '1999' or contains(text, '1999'))", heavy=True)
def t10_snapshot_search(lines):
    return search.snapshot_search(lines, SearchParams("small-ring ECONOMY", vintage="1999"), F.col("text")).select("id", "text")


@query(["v_lines"], """
  with d as (select *, row_number() over (partition by lower(trim(text)), vintage, currency, price, list_id order by id) as rn from v_lines where regexp_matches(text, '\\b2000\\b'))
  select id, text, price from d where rn = 1 order by price nulls last, id limit 200""")
def t11_hosted_search(lines):
    keys = [F.lower(F.trim("text")), F.col("vintage"), F.col("currency"), F.col("price"), F.col("list_id")]
    return search.hosted_search(lines, SearchParams(vintage="2000", limit=200), keys, [F.col("id")]).select("id", "text", "price")


@query(["v_lines"], """
  with p as (select id, unnest(list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+'))) as term from v_lines)
  select id from p where term in ('red', 'gear') group by id having count(distinct term) = 2""", heavy=True)
def t4_index_search(lines):
    """Whole words through a posting list."""
    return search.index_search(search.index_terms(lines, "id", "text"), ["red", "gear"], "id")


def _indexed(rows, label, runs=True):
    return fulltext.KeptIndex(rows.sparkSession, shared.scratch_path(rows.sparkSession, label), 16, runs=runs)


def _done(index, found):
    """The result by itself; the query's own index goes."""
    out = shared.stored(found, "found")
    shared.removed(index.spark, index.path)
    return out


@query(["documents"], f"""
  with m as (select doc_id, case when lang = 'de' then 'revised ' || replace(text, 'and', 'und') else text end as text from documents where doc_id is not null and lang is distinct from 'fr'),
  w as (select doc_id, regexp_extract_all({_FOLD.format(c="coalesce(text, '')")}, '[\\p{{L}}\\p{{N}}_]+') as ws from m)
  select 'of the' as search, doc_id from w where list_has_all(ws, ['of', 'the']) union all select 'revised und', doc_id from w where list_has_all(ws, ['revised', 'und'])
  union all select 'and or und', doc_id from w where list_has_any(ws, ['and', 'und']) union all select 'compacted', doc_id from w where list_has_all(ws, ['of', 'the'])""", heavy=True)
def t4_kept_index(docs):
    """An index of all documents, then the revision of a language and the end of another, searched before and after compaction."""
    rows = docs.where("doc_id is not null").select("doc_id", "text", "lang")
    index = _indexed(docs, "t4", runs=False).build(rows, "doc_id", "text")
    revised = rows.where("lang = 'de'").withColumn("text", F.concat(F.lit("revised "), F.replace("text", F.lit("and"), F.lit("und"))))
    index.merge(revised, "doc_id", "text", deleted=rows.where("lang = 'fr'"))
    found = [index.search(["of", "the"]).withColumn("search", F.lit("of the")), index.search(["und", "revised"]).withColumn("search", F.lit("revised und")), index.search(["and", "und"], every=False).withColumn("search", F.lit("and or und"))]
    found.append(index.compact().search(["of", "the"]).withColumn("search", F.lit("compacted")))
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    return _done(index, out.select("search", F.col("key").alias("doc_id")))


@query(["documents", "benchmark"], f"""
  with d as (select doc_id, {_FOLD.format(c="coalesce(text, '')")} as f from documents), w as (select doc_id, f, regexp_extract_all(f, '[\\p{{L}}\\p{{N}}_]+') as ws from d),
  q as (select distinct item_id, unnest(regexp_extract_all({_FOLD.format(c="text")}, '[\\p{{L}}\\p{{N}}_]+')) as token from benchmark), k as (select * from q where length(token) >= 2), t as (select distinct token from k),
  v as (select token, unnest(list_concat([token], list_transform(range(1, length(token)), lambda i: token[1:i - 1] || token[i + 1] || token[i] || token[i + 2:]))) as form from t where length(token) >= 5),
  r as (select distinct doc_id, unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ws[i + 1]), list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ws[i + 1] || ws[i + 2]))) as form from w),
  h as (select token, doc_id from t join w on contains(f, token) union select token, doc_id from v join r using (form)), n as (select item_id, count(*) as n from k group by 1)
  select item_id, doc_id from k join h using (token) join n using (item_id) group by item_id, doc_id, n having count(*) = n""")
def t5_query_batch(docs, benchmark):
    """Each benchmark item as a query of all its words, over all documents at once, through the kept index."""
    asked = benchmark.select("item_id", F.explode(F.array_distinct(text.words_of(text.fold("text")))).alias("token")).where(F.length("token") >= 2)
    index = _indexed(docs, "t5").build(docs.where("doc_id is not null"), "doc_id", "text", tokens=asked)
    return _done(index, index.batch(asked, "item_id", "token").withColumnRenamed("key", "doc_id"))


@query(["v_lines", "v_watch"], """
  select l.id, w.keyword, w.vintage as watch_vintage from v_lines l join v_watch w
    on list_bool_and(list_transform(string_split(w.keyword, ' '), lambda t: contains(lower(regexp_replace(l.text, '[^A-Za-z0-9]+', ' ', 'g')), t))) and (w.vintage = '' or contains(l.text, w.vintage))""", heavy=True)
def w1_watch_match(lines, watches):
    return watch.matches(lines, watches).select("id", "keyword", "watch_vintage")


@query(["v_entries", "v_targets", "v_watch"], """
  with e as (select e.*, t.name as restaurant, timestamp '1999-01-01' as checked_at from v_entries e join v_targets t on e.target_id = t.id),
  h as (select e.*, w.keyword, w.vintage as watch_vintage from e join v_watch w on list_bool_and(list_transform(string_split(w.keyword, ' '), lambda t: contains(lower(regexp_replace(e.text, '[^A-Za-z0-9]+', ' ', 'g')), t))) and (w.vintage = '' or contains(e.text, w.vintage))),
  g as (select *, first_seen > timestamp '2000-06-01' as is_new, checked_at >= timestamp '1998-01-01' and last_seen < timestamp '1998-01-01' as is_stale from h)
  select keyword, watch_vintage, count(*) as match_count, count(distinct restaurant) as restaurant_count, count(distinct case when is_new then restaurant end) as new_count, count(distinct case when is_stale then restaurant end) as stale_count,
    array_to_string(coalesce(list_sort(list(distinct restaurant) filter (where is_new))[1:20], []), ';') as new_restaurants, array_to_string(coalesce(list_sort(list(distinct restaurant) filter (where is_stale))[1:20], []), ';') as stale_restaurants
  from g group by 1, 2""", heavy=True)
def w2_watch_report(entries, targets, watches):
    rows = entries.join(targets.select(F.col("id").alias("target_id"), F.col("name").alias("restaurant")), "target_id").withColumn("checked_at", F.lit("1999-01-01").cast("timestamp"))
    return watch.report(watch.matches(rows, watches), F.lit("2000-06-01").cast("timestamp"), F.lit("1998-01-01").cast("timestamp"))


@query(["v_lines", "v_watch"], """
  select distinct w.keyword, w.vintage as watch_vintage, l.text from v_lines l join v_watch w on contains(lower(l.text), w.keyword) and (w.vintage = '' or contains(l.text, w.vintage))""", heavy=True)
def w3_watch_export(lines, watches):
    return watch.matches(lines, watches, how="phrase").select("keyword", "watch_vintage", "text").distinct()


@query(["v_lines", "v_watch"], """
  select l.id, w.keyword, w.vintage as watch_vintage from v_lines l join v_watch w
    on contains(trim(regexp_replace(lower(l.text), '[^a-z0-9]+', ' ', 'g')), w.keyword) and (w.vintage = '' or contains(l.text, w.vintage))""", heavy=True)
def w4_watch_collector(lines, watches):
    return watch.matches(lines, watches, how="plain").select("id", "keyword", "watch_vintage")


@query(["v_products"], "select id, price from v_products where flag = 'R' order by price nulls last, seen_at desc, name, id limit 500")
def l1_price_topk(products):
    return products.where("flag = 'R'").orderBy(*search.price_first(F.desc("seen_at"), F.col("name"), F.col("id"))).limit(500).select("id", "price")


@query(["v_targets"], """
  select id, status, name from v_targets order by case when status = 'found' then 0 when status = 'no_wine_list' then 1 when status in ('review', 'error') then 2 else 3 end, name, id limit 700""")
def l3_status_sort(targets):
    rank = F.when(F.col("status") == "found", 0).when(F.col("status") == "no_wine_list", 1).when(F.col("status").isin("review", "error"), 2).otherwise(3)
    return targets.orderBy(rank, "name", "id").limit(700).select("id", "status", "name")


@query(["v_sources", "v_products"], """
  (select 'list' as kind, id from v_sources where coalesce(line_count, 0) = 0 order by id limit 50) union all (select 'price' as kind, id from v_products where price < 1000 order by id limit 100)""")
def l6_review_union(sources, products):
    a = sources.where(F.coalesce("line_count", F.lit(0)) == 0).orderBy("id").limit(50).select(F.lit("list").alias("kind"), "id")
    return a.unionByName(products.where("price < 1000").orderBy("id").limit(100).select(F.lit("price").alias("kind"), "id"))


@query(["v_merchants"], "select g.i as id from range(0, 500) g(i) where not exists (select 1 from v_merchants m where m.id = g.i)")
def l8_resume_set(merchants):
    """Ids of a range that aren't done yet."""
    return merchants.sparkSession.range(0, 500).join(merchants.select("id"), "id", "left_anti")


@query(["events"], """
  with d as (select cast(ts as date) as day, max(ts) as finished, count(*) as n, count(*) filter (where event_type = 'error') as errors from events group by 1)
  select day, n, errors from d where errors > 0 order by finished desc, day desc limit 1""")
def n2_latest_run(events):
    runs = events.groupBy(F.to_date("ts").alias("day")).agg(F.max("ts").alias("finished"), F.count("*").alias("n"), F.sum(F.when(F.col("event_type") == "error", 1).otherwise(0)).alias("errors"))
    return runs.where("errors > 0").orderBy(F.desc("finished"), F.desc("day")).limit(1).select("day", "n", "errors")


@query(["v_samples"], "select run_id, id from (select *, row_number() over (partition by run_id order by ts desc, id desc) as rn from v_samples) where rn <= 250")
def n6_bounded_history(samples):
    w = W.partitionBy("run_id").orderBy(F.desc("ts"), F.desc("id"))
    return samples.withColumn("rn", F.row_number().over(w)).where("rn <= 250").select("run_id", "id")


@query(["v_samples"], """
  with r as (select run_id, id, row_number() over (partition by run_id order by ts, id) - 1 as k, count(*) over (partition by run_id) as n from v_samples),
  i as (select unnest(range(250)) as i), w as (select distinct run_id, n, case when n <= 250 then null else floor(i * ((n - 1) / 249::double) + 0.5)::bigint end as k from (select distinct run_id, n from r), i)
  select r.run_id, r.id from r left join w on w.run_id = r.run_id and w.k = r.k where r.n <= 250 or w.k is not null""")
def n6_chart(samples):
    """Each run's history at 250 evenly spaced samples."""
    return dashboard.evenly_spaced(samples, "run_id", ["ts", "id"]).select("run_id", "id")
