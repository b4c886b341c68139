"""Merges as full joins on a key: upsert policies, change detection, histories, soft deletes, versioned publishing.

A merge shuffles both sides once on their key; sides that are bucketed by it need no shuffle. Writing is a new version
directory and a swap of the pointer, as Parquet has no in-place update.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

Policy = Callable[[Column, Column, Column], Column]


def incoming_wins(old: Column, new: Column, both: Column) -> Column:
    return F.when(both, new).otherwise(F.coalesce(new, old))


def non_empty_incoming_wins(old: Column, new: Column, both: Column) -> Column:
    return F.coalesce(F.when(new.cast("string") != "", new), old)


def keep_old_unless_empty(old: Column, new: Column, both: Column) -> Column:
    return F.coalesce(F.when(old.cast("string") != "", old), new)


def keep_old(old: Column, new: Column, both: Column) -> Column:
    return F.coalesce(old, new)


def upsert(old: DataFrame, new: DataFrame, key: list[str], policies: dict[str, Policy], default: Policy = incoming_wins) -> DataFrame:
    """old merged with new on key, each other column by its policy. Rows on one side alone are kept as they are."""
    o, n = old.alias("o"), new.alias("n")
    joined = o.join(n, [F.col(f"o.{k}") == F.col(f"n.{k}") for k in key], "full")
    first = key[0]
    both = F.col(f"o.{first}").isNotNull() & F.col(f"n.{first}").isNotNull()
    only_old = F.col(f"n.{first}").isNull()
    columns = [F.coalesce(F.col(f"n.{k}"), F.col(f"o.{k}")).alias(k) for k in key]
    for c in old.columns:
        if c not in key:
            a, b = F.col(f"o.{c}"), F.col(f"n.{c}") if c in new.columns else F.lit(None)
            columns.append(F.when(only_old, a).otherwise(policies.get(c, default)(a, b, both)).alias(c))
    return joined.select(*columns)


def outcomes(old: DataFrame, new: DataFrame, key: list[str], digest: str) -> DataFrame:
    """key and outcome of every incoming row: inserted, updated (digest differs) or unchanged."""
    o = old.select(*key, F.col(digest).alias("old_digest"), F.lit(True).alias("known"))
    return new.join(o, key, "left").select(*key, F.when(F.col("known").isNull(), "inserted").when(F.col("old_digest").eqNullSafe(F.col(digest)), "unchanged").otherwise("updated").alias("outcome"))


def insert_or_ignore(old: DataFrame, new: DataFrame, key: list[str], order: list[str] | None = None) -> DataFrame:
    """old and the rows of new whose key it lacks, the first of each key."""
    fresh = new.join(old.select(*key), key, "left_anti")
    one = fresh.withColumn("rn", F.row_number().over(W.partitionBy(*key).orderBy(*(order or key)))).where("rn = 1").drop("rn")
    return old.unionByName(one.select(*old.columns))


def replace_by_key(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Delete and insert: rows of new stand for all rows of old with their keys."""
    return old.join(new.select(*key).distinct(), key, "left_anti").unionByName(new.select(*old.columns))


def append_history(history: DataFrame, offers: DataFrame, key: list[str], seen: str) -> DataFrame:
    """Distinct observations that history lacks, each at its first time."""
    first = offers.groupBy(*key).agg(F.min(seen).alias(seen))
    return first.join(history.select(*key), key, "left_anti").select(*history.columns)


def soft_delete(rows: DataFrame, seen: DataFrame, key: list[str], full_run: bool = True) -> DataFrame:
    """active off for rows that a full run did not see; partial runs change nothing."""
    if not full_run:
        return rows
    return rows.join(seen.select(*key, F.lit(True).alias("_seen")).distinct(), key, "left").withColumn("active", F.col("active") & F.coalesce("_seen", F.lit(False))).drop("_seen")


def orphans(parents: DataFrame, key: str, *children: DataFrame) -> DataFrame:
    """Parents that no child relation refers to."""
    out = parents
    for child in children:
        out = out.join(child.select(key).distinct(), key, "left_anti")
    return out


def set_merge(old: DataFrame, new: DataFrame, key: list[str], member: str) -> DataFrame:
    """Set-valued column united; its size and a priority of at least 1 beside it."""
    o = old.select(*key, F.col(member).alias("_old"))
    n = new.groupBy(*key).agg(F.collect_set(member).alias("_new"))
    sets = F.array_sort(F.array_union(F.coalesce("_old", F.array().cast("array<string>")), F.coalesce("_new", F.array().cast("array<string>"))))
    return o.join(n, key, "full").select(*key, sets.alias(member)).withColumn("source_count", F.size(member)).withColumn("priority", F.greatest(F.lit(1), F.size(member)))


def website_change(old_site: Column, new_site: Column, rejected: Column) -> dict[str, Column]:
    """A rejected merchant comes back only with another website."""
    replaced = rejected & (new_site != "") & ~new_site.eqNullSafe(old_site)
    return {"website": F.when(replaced | ~rejected & (F.coalesce(old_site, F.lit("")) == ""), new_site).otherwise(old_site), "active": ~rejected | replaced, "status": F.when(replaced, "discovered")}


def location_split(distance_km: Column, same_country: Column, most_km: float = 1.0) -> Column:
    """The same place id far away or in another country is a merchant of its own."""
    return ~same_country | (F.coalesce(distance_km, F.lit(0.0)) > most_km)


def inventory_replace(products: DataFrame, incoming: DataFrame, outcome: DataFrame) -> DataFrame:
    """products (merchant_id, key, ..., active) after a run with outcome (merchant_id, result): found replaces a merchant's
    inventory, review keeps the last known one, rejected switches everything off."""
    results = outcome.select("merchant_id", "result")
    state = products.join(results, "merchant_id", "left")
    seen = incoming.join(results.where("result = 'found'"), "merchant_id", "left_semi")
    kept = state.join(seen.select("merchant_id", "key"), ["merchant_id", "key"], "left_anti").withColumn("active", F.col("active") & (F.col("result").isNull() | (F.col("result") == "review")))
    return kept.drop("result").unionByName(seen.withColumn("active", F.lit(True)).select(*products.columns))


def staged_publish(live: dict[str, DataFrame], staged: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The live tables after a staged run is taken over: targets that live lacks are added and all others get the staged values
    of the columns that staged has; sources and entries are replaced whole; runs are replaced by id. `publish` writes the
    result as one version."""
    targets = upsert(insert_or_ignore(live["targets"], _widened(staged["targets"], live["targets"]), ["id"]), staged["targets"], ["id"], {c: keep_old for c in live["targets"].columns if c not in staged["targets"].columns})
    return {
        "targets": targets,
        "sources": _widened(staged["sources"], live["sources"]).select(*live["sources"].columns),
        "entries": _widened(staged["entries"], live["entries"]).select(*live["entries"].columns),
        "runs": replace_by_key(live["runs"], _widened(staged["runs"], live["runs"]), ["id"]),
    }


def _widened(df: DataFrame, like: DataFrame) -> DataFrame:
    """df with null for what it lacks of another's columns."""
    return df.select("*", *(F.lit(None).cast(f.dataType).alias(f.name) for f in like.schema if f.name not in df.columns))


def with_parent(children: DataFrame, parents: DataFrame, key: str, parent_key: str = "id") -> DataFrame:
    """Children whose parent exists, in the same database or another: a semi join either way."""
    return children.join(parents.select(F.col(parent_key).alias(key)), key, "left_semi")


def countries_migrated(rows: DataFrame, city: str | None = None) -> DataFrame:
    """country as its display name, and what was written kept in country_raw (which a second run doesn't touch)."""
    from ..functions import places

    raw = F.coalesce("country_raw", "country") if "country_raw" in rows.columns else F.col("country")
    named = places.with_country(rows.withColumn("country_raw", raw), "country_raw", city=city, prefix="_new")
    return named.withColumn("country", F.coalesce(F.nullif("_new_name", F.lit("")), "country")).drop("_new_code", "_new_name")


def reset(rows: DataFrame, values: dict[str, Column], ids: DataFrame | None = None, key: str = "id") -> DataFrame:
    """rows with columns set back to the values; only those of the ids where given."""
    if ids is None:
        return rows.withColumns(values)
    marked = rows.join(ids.select(key, F.lit(True).alias("_hit")).distinct(), key, "left")
    return marked.withColumns({c: F.when(F.col("_hit"), v).otherwise(F.col(c)) for c, v in values.items()}).select(*rows.columns)


def restored(rows: DataFrame, backup: DataFrame, key: list[str]) -> DataFrame:
    """rows and those of the backup that they lack."""
    return insert_or_ignore(rows, backup.select(*rows.columns), key)


def pruned(cache: DataFrame, sources: DataFrame, key: str = "url") -> DataFrame:
    """Cached files that some source still refers to."""
    return cache.join(sources.select(key).distinct(), key, "left_semi")


def location_audit(targets: DataFrame, resolved: DataFrame, most_km: float = 10.0) -> DataFrame:
    """targets (id, website, address, lat, lng, status, checked_at, last_error) after a look-up of their places (the same names;
    error): new values where they aren't blank; changed says that the site's host or the place (by more than most_km) is
    another, which sets the row back and makes its children void (`orphaned_by`)."""
    from ..functions import places, text, web

    r = resolved.select("id", *(F.col(c).alias(f"_{c}") for c in ("website", "address", "lat", "lng", "error")), F.lit(True).alias("_looked"))
    j = targets.join(r, "id", "left")
    old, new = web.domain(F.col("website")), web.domain(F.col("_website"))
    moved = places.haversine_km(F.col("lat"), F.col("lng"), F.col("_lat"), F.col("_lng"))
    changed = F.coalesce((old != "") & (new != "") & (old != new), F.lit(False)) | F.coalesce(moved > most_km, F.lit(False))
    site = text.non_empty(F.col("_website"), F.col("website"))
    looked = F.coalesce("_looked", F.lit(False))
    out = j.withColumn("changed", changed).select(
        "id", F.when(looked, site).otherwise(F.col("website")).alias("website"), text.non_empty(F.col("_address"), F.col("address")).alias("address"), F.coalesce("_lat", "lat").alias("lat"), F.coalesce("_lng", "lng").alias("lng"),
        F.when(F.col("changed"), "not_checked").when(looked & site.isNull(), "missing_website").otherwise(F.col("status")).alias("status"),
        F.when(~F.col("changed"), F.col("checked_at")).alias("checked_at"), F.when(F.col("changed"), F.lit(None)).when(looked, F.nullif("_error", F.lit(""))).otherwise(F.col("last_error")).alias("last_error"), "changed")
    return out


def orphaned_by(children: DataFrame, audited: DataFrame, key: str) -> DataFrame:
    """Children that stay after an audit."""
    return children.join(audited.where("changed").select(F.col("id").alias(key)), key, "left_anti")


def publish(spark: SparkSession, tables: dict[str, DataFrame], root: str, version: str) -> str:
    """All tables written under a new version, then the pointer file is replaced in one rename: readers see all or none."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{root}/{version}/{name}")
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path
    staged, current = path(f"{root}/CURRENT.{version}"), path(f"{root}/CURRENT")
    out = staged.getFileSystem(conf).create(staged, True)
    out.write(bytearray(version.encode()))
    out.close()
    kind = jvm.org.apache.hadoop.fs.Options.Rename
    how = spark.sparkContext._gateway.new_array(kind, 1)
    how[0] = kind.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(staged.getFileSystem(conf).getUri(), conf).rename(staged, current, how)
    return version


def published(spark: SparkSession, root: str, name: str) -> DataFrame:
    version = spark.read.text(f"{root}/CURRENT").first()[0]
    return spark.read.parquet(f"{root}/{version}/{name}")
