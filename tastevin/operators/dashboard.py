"""Collection dashboards: counts, choices, clusters, samples, runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import places
from ..sources import shared


def when_sum(test: Column) -> Column:
    """Rows for which the test holds, 0 for none."""
    return F.coalesce(F.sum(F.when(test, 1).otherwise(0)), F.lit(0))


def target_summary(targets: DataFrame) -> DataFrame:
    s, mapped = F.col("status"), (F.col("status") != "not_checked") & F.col("lat").isNotNull() & F.col("lng").isNotNull()
    return targets.agg(
        F.count("*").alias("total"), when_sum(s != "not_checked").alias("checked"), when_sum(s == "no_wine_list").alias("no_list"), when_sum(s == "not_checked").alias("pending"),
        when_sum(s == "missing_website").alias("missing_website"), when_sum(s.isin("review", "error")).alias("needs_review"), when_sum(s == "error").alias("errors"),
        when_sum(mapped).alias("mapped"), when_sum(mapped & (F.trim("website") != "")).alias("mapped_with_website"),
    )


def verified(prefix: str = "") -> Column:
    c = lambda n: F.col(prefix + n)
    return (c("status") == "found") & (c("parser_status") == "parsed") & (F.coalesce(c("line_count"), F.lit(0)) > 0)


def best_sources(sources: DataFrame, targets: DataFrame) -> DataFrame:
    """The source that stands for each target: verified, not the home page, PDF, list-like address, most lines, latest."""
    t = targets.select(F.col("id").alias("target_id"), F.col("website"))
    yes = lambda test: F.when(F.coalesce(test, F.lit(False)), 0).otherwise(1)
    order = [
        yes(verified()), F.when((F.col("website") != "") & (F.col("url") == F.col("website")), 1).otherwise(0), yes(F.col("source_type") == "pdf"),
        yes(F.lower("url").rlike("wine|vin|wein|drink|beverage|pdf")), F.coalesce("line_count", F.lit(0)).desc(), F.col("checked_at").desc(), F.col("id"),
    ]
    return sources.join(t, "target_id").withColumn("rn", F.row_number().over(W.partitionBy("target_id").orderBy(*order))).where("rn = 1").drop("rn", "website")


def grid_clusters(rows: DataFrame, zoom: int, exact_zoom: int = 16) -> DataFrame:
    """Points in cells of the zoom level: count, mean place, counts by kind; a cell of one is a point. Lossless: counts sum to the rows."""
    size = float(2 ** max(0, min(20, zoom)) * 8)
    lng_cell, lat_cell = max(0.00025, 360.0 / size), max(0.00025, 180.0 / size)
    if zoom >= exact_zoom:
        cells = rows.withColumn("lat_key", F.col("id").cast("long")).withColumn("lng_key", F.lit(0).cast("long"))
    else:
        cells = rows.withColumn("lat_key", F.floor((F.col("lat") + 90.0) / lat_cell)).withColumn("lng_key", F.floor((F.col("lng") + 180.0) / lng_cell))
    kind = F.when(F.col("status") == "found", "found").when(F.col("status") == "no_wine_list", "none").otherwise("pending")
    count = lambda k: when_sum(F.col("kind") == k)
    return cells.withColumn("kind", kind).groupBy("lat_key", "lng_key").agg(
        F.count("*").alias("n"), F.avg("lat").alias("lat"), F.avg("lng").alias("lng"), count("found").alias("found"), count("none").alias("none"), count("pending").alias("pending"),
        F.when(F.countDistinct("kind") == 1, F.min("kind")).otherwise("mixed").alias("kind"), F.when(F.count("*") == 1, F.min("id")).alias("point_id"),
    )


def assert_covered(clusters: DataFrame, total: int) -> DataFrame:
    """clusters with a check, made when it runs, that their counts sum to total."""
    checked = F.assert_true(F.sum("n").over(W.partitionBy()) == total, F.lit("clusters lose rows"))
    return clusters.withColumn("_ok", checked).drop("_ok")


def balanced_sample(rows: DataFrame, group: str, limit: int) -> DataFrame:
    """One row of each group, then the rest by the groups' sizes with largest remainders; within a group in a fixed shuffle.

    Groups are a small table; the shuffle's ranks are taken within groups."""
    key = F.abs(F.pmod(F.col("id") * 1103515245 + 12345, F.lit(2147483647)))
    ranked = rows.withColumn("rn", F.row_number().over(W.partitionBy(group).orderBy(key, "id")))
    sizes = rows.groupBy(group).agg(F.count("*").alias("size"))
    whole = W.partitionBy()
    shares = (
        sizes.withColumn("groups", F.count("*").over(whole)).withColumn("total", F.sum("size").over(whole)).withColumn("place", F.row_number().over(W.orderBy(group)))
        .withColumn("slots", F.least(F.lit(limit), F.col("total")) - F.col("groups")).withColumn("others", F.col("total") - F.col("groups"))
        .withColumn("raw", F.when((F.col("slots") > 0) & (F.col("others") > 0), F.col("slots") * (F.col("size") - 1) / F.col("others")).otherwise(0.0))
        .withColumn("extra", F.least(F.col("size") - 1, F.floor("raw")))
    )
    open_ = F.col("size") - 1 > F.col("extra")
    left = shares.withColumn("left", F.greatest(F.lit(0), F.col("slots") - F.sum("extra").over(whole)))
    turn = F.sum(F.when(open_, 1).otherwise(0)).over(W.orderBy((F.col("extra") - F.col("raw")), group).rowsBetween(W.unboundedPreceding, 0))
    alloc = left.withColumn("alloc", F.when(F.lit(limit) <= F.col("groups"), F.when(F.col("place") <= limit, 1).otherwise(0)).otherwise(1 + F.col("extra") + F.when(open_ & (turn <= F.col("left")), 1).otherwise(0)))
    return ranked.join(alloc.select(group, "alloc"), group).where(F.col("rn") <= F.col("alloc")).drop("rn", "alloc")


def map_targets(targets: DataFrame, sources: DataFrame, entries: DataFrame, most: int = 7000) -> DataFrame:
    """Targets on the map with their counts, by status and name: pre-aggregated sides, left joins."""
    s = sources.groupBy("target_id").agg(F.count("*").alias("sources"), when_sum(F.coalesce(verified(), F.lit(False))).alias("verified"), when_sum(F.coalesce((F.col("status") == "review") | (F.col("parser_status") == "review"), F.lit(False))).alias("review"))
    e = entries.groupBy("target_id").agg(F.count("*").alias("lines"))
    rank = F.when(F.col("status") == "found", 0).when(F.col("status") == "no_wine_list", 1).when(F.col("status").isin("review", "error"), 2).otherwise(3)
    fine = targets.where((F.col("status") != "not_checked") & F.col("lat").isNotNull() & F.col("lng").isNotNull() & (F.trim("website") != ""))
    out = fine.join(s, fine["id"] == s["target_id"], "left").drop("target_id").join(e, fine["id"] == e["target_id"], "left").drop("target_id")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return out.select("id", "name", "status", zero("sources"), zero("verified"), zero("review"), zero("lines"), rank.alias("rank")).orderBy("rank", "name", "id").limit(most)


def dedupe_ratios(raw: DataFrame, source: str, key: str) -> DataFrame:
    """Raw rows, distinct in each source and overall, and the duplicates of both kinds."""
    each = raw.groupBy(source).agg(F.count("*").alias("raw"), F.countDistinct(key).alias("uniq"))
    return each.agg(F.sum("raw").alias("raw"), F.sum("uniq").alias("source_unique")).crossJoin(raw.agg(F.countDistinct(key).alias("merged_unique"))).select(
        "raw", "source_unique", F.greatest(F.col("raw") - F.col("source_unique"), F.lit(0)).alias("source_duplicates"), "merged_unique", F.greatest(F.col("source_unique") - F.col("merged_unique"), F.lit(0)).alias("cross_duplicates"))


def progress(total: Column, processed: Column) -> list[Column]:
    """Percent (banker's rounding, clamped) and what remains."""
    percent = F.when(total > 0, F.bround(100.0 * processed / total, 1)).otherwise(F.lit(0.0))
    return [F.greatest(F.lit(0.0), F.least(F.lit(100.0), percent)).alias("percent"), F.greatest(F.lit(0), total - processed).alias("remaining")]


def recent_rate(samples: DataFrame, run: str, most: int = 500) -> DataFrame:
    """Rows a second between the first and last of each run's last samples."""
    w = W.partitionBy(run).orderBy(F.col("ts").desc(), F.col("id").desc())
    last = samples.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= most)
    span = (F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))) / 1e6
    return last.groupBy(run).agg(F.count("*").alias("n"), F.when(span > 0, (F.count("*") - 1) / span).alias("rate"))


def remaining_seconds(samples: DataFrame, run: str, total: Column, now: Column, most: int = 500) -> DataFrame:
    """Rows done, rate a second and whole seconds left of each run: the rate of its last samples, of all its time to now where these
    have none, null where there is none at all. `done` is a sample's count of rows so far."""
    w = W.partitionBy(run).orderBy(F.col("ts").desc(), F.col("id").desc())
    last = samples.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= most)
    seconds = lambda c: F.unix_micros(c.cast("timestamp")) / 1e6
    ends = last.groupBy(run).agg(F.max("done").alias("done"), F.min("done").alias("least"), F.max("ts").alias("to"), F.min("ts").alias("since"))
    rows = ends.join(samples.groupBy(run).agg(F.min("ts").alias("started")), run).withColumn("total", total)
    gained, span, elapsed = F.col("done") - F.col("least"), seconds(F.col("to")) - seconds(F.col("since")), F.floor(seconds(now) - seconds(F.col("started")))
    recent = F.when(gained > 0, gained / F.greatest(F.lit(0.001), span))
    rate = F.coalesce(recent, F.when((F.col("done") > 0) & (elapsed > 0), F.col("done") / elapsed))
    left = F.when(F.col("total") <= 0, None).when(F.col("done") >= F.col("total"), 0).otherwise(F.floor((F.col("total") - F.col("done")) / rate))
    return rows.select(run, "done", rate.alias("rate"), left.cast("long").alias("seconds_left"))


def evenly_spaced(samples: DataFrame, run: str, order: list[str], most: int = 250) -> DataFrame:
    """All samples of runs of up to `most`, of longer ones as many, evenly spaced from the first to the last.

    Places come from one numbering of all samples by run and order; a run's places are its own less those before it."""
    turned = shared.numbered(samples.where(F.col(run).isNotNull()), [run, *order], "_turn")
    spans = turned.groupBy(run).agg(F.min("_turn").alias("_first"), F.count("*").alias("_n"))
    step = (F.col("_n") - 1) / (most - 1)
    wanted = F.when(F.col("_n") <= most, F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)).otherwise(F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.floor(i * step + 0.5)))
    picked = spans.select(run, F.explode(F.transform(wanted, lambda k: k + F.col("_first"))).alias("_turn"))
    return turned.join(picked, [run, "_turn"], "left_semi").drop("_turn")


def source_places(sources: DataFrame, places_: DataFrame, key: str) -> DataFrame:
    """code, name and the number of places of every source, 0 for those without."""
    counts = places_.groupBy(F.col(key).alias("id")).agg(F.count("*").alias("n"))
    return sources.join(counts, "id", "left").select("code", "name", F.coalesce("n", F.lit(0)).alias("places"))


def top_targets(targets: DataFrame, most: int = 120) -> DataFrame:
    return targets.orderBy(F.desc("priority"), "name", "id").limit(most)


def latest_entries(entries: DataFrame, targets: DataFrame, most: int = 300) -> DataFrame:
    """The last seen lines with their target's name and place. The lines are chosen before they meet the targets."""
    known = entries.join(targets.select(F.col("id").alias("target_id")), "target_id", "left_semi")
    last = known.orderBy(F.desc("last_seen"), "id", "text").limit(most)
    return last.join(targets.select(F.col("id").alias("target_id"), "name", "city", "country"), "target_id")


def blocked_streaks(rows: DataFrame, run: str, blocked: Column, limit: int) -> DataFrame:
    """Longest run of consecutive blocked answers, and whether it reaches the limit: gaps and islands."""
    w = W.partitionBy(run).orderBy("ts", "id")
    islands = rows.withColumn("b", blocked).withColumn("island", F.sum(F.when(F.col("b"), 0).otherwise(1)).over(w))
    longest = islands.where("b").groupBy(run, "island").agg(F.count("*").alias("n")).groupBy(run).agg(F.max("n").alias("longest"))
    return longest.withColumn("opened", F.col("longest") >= limit)


def counter_deltas(samples: DataFrame, run: str) -> DataFrame:
    """Differences of consecutive samples, clamped to 0..100, to one decimal."""
    delta = F.col("value") - F.lag("value").over(W.partitionBy(run).orderBy("ts", "id"))
    return samples.withColumn("delta", F.floor(F.greatest(F.lit(0.0), F.least(F.lit(100.0), delta)) * 10 + 0.5) / 10)


def nearby_total(rows: DataFrame, lat: float, lng: float, km: float) -> DataFrame:
    return rows.where(places.haversine_km(F.col("lat"), F.col("lng"), F.lit(lat), F.lit(lng)) <= km).agg(F.count("*").alias("n"))


def stalled(heartbeat: Column, now: Column, minutes: int = 15) -> Column:
    """A run whose last sign of life is older than that."""
    return heartbeat < now - F.make_interval(mins=F.lit(minutes))


def timing(started: Column, now: Column, total: Column, done: Column) -> list[Column]:
    """Elapsed seconds, rate a minute and seconds left at the overall rate."""
    elapsed = F.greatest(F.lit(0.0), (F.unix_micros(now.cast("timestamp")) - F.unix_micros(started.cast("timestamp"))) / 1e6)
    rate = F.when((elapsed > 0) & (done > 0), done / elapsed)
    return [elapsed.alias("elapsed"), (rate * 60).alias("per_minute"), (F.greatest(F.lit(0), total - done) / rate).alias("left")]


def phase_eta(samples: DataFrame, run: str, most: int = 30) -> DataFrame:
    """Seconds left from each run's last samples of its current phase: (ts, processed, total, phase), earliest to latest of them."""
    latest = samples.groupBy(run).agg(F.max_by(F.struct("phase", "processed", "total", "ts"), "ts").alias("now"))
    w = W.partitionBy(run).orderBy(F.desc("ts"))
    near = samples.join(latest, run).where(F.col("phase") == F.col("now.phase")).withColumn("rn", F.row_number().over(w)).where((F.col("rn") <= most) & (F.col("processed") < F.col("now.processed")))
    first = near.groupBy(run).agg(F.min_by(F.struct("processed", "ts"), "ts").alias("then"), F.first("now").alias("now"))
    rate = (F.col("now.processed") - F.col("then.processed")) / ((F.unix_micros(F.col("now.ts").cast("timestamp")) - F.unix_micros(F.col("then.ts").cast("timestamp"))) / 1e6)
    return first.select(run, (rate * 60).alias("per_minute"), (F.greatest(F.lit(0), F.col("now.total") - F.col("now.processed")) / rate).alias("left"))
