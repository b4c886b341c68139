"""The review queue's life cycle: reviews open, are refreshed and resolved by the results of runs, and nothing is forgotten.

A row of the queue is what was known of a review from valid_from to valid_to (null: still): merchant_id, reason, detail, opened_at,
valid_from, valid_to, status (open; refreshed: replaced by a later row; resolved). A run's result opens or refreshes a review of its
own reason and resolves those that it settles; a merchant that the run didn't visit keeps its reviews.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

IDENTITY, FETCH = "business_identity_mismatch", "inventory_fetch_failed"
SCHEMA = "merchant_id long, reason string, detail string, opened_at timestamp, valid_from timestamp, valid_to timestamp, status string"
_DETAILS = {"rejected": "Official website belongs to a different business.", "review": "Unknown error"}
_KEY = ["merchant_id", "reason"]


def events(results: DataFrame) -> DataFrame:
    """(merchant_id, reason, opens, detail) of results (merchant_id, status, error): a rejection opens a review of identity and settles one
    of fetching, a failure opens one of fetching, any other result settles that. Of several results of a merchant the last by status and error counts."""
    one = results.groupBy("merchant_id").agg(F.max(F.struct("status", F.coalesce("error", F.lit("")).alias("error"))).alias("r")).select("merchant_id", "r.*")
    said = lambda kind: F.coalesce(F.nullif(F.trim("error"), F.lit("")), F.lit(_DETAILS[kind]))
    event = lambda reason, opens, detail: F.struct(F.lit(reason).alias("reason"), F.lit(opens).alias("opens"), detail.alias("detail"))
    nothing = F.lit(None).cast("string")
    found = (
        F.when(F.col("status") == "rejected", F.array(event(IDENTITY, True, said("rejected")), event(FETCH, False, nothing)))
        .when(F.col("status") == "review", F.array(event(FETCH, True, said("review")))).otherwise(F.array(event(FETCH, False, nothing)))
    )
    return one.select("merchant_id", F.inline(found))


def after_run(queue: DataFrame, results: DataFrame, now: Column) -> DataFrame:
    """The queue after a run's results, at a time later than all in it."""
    news = events(results).withColumnsRenamed({"detail": "new_detail"})
    joined = queue.where("status = 'open'").join(news, _KEY, "full")
    there, told = F.col("status").isNotNull(), F.col("opens").isNotNull()
    closing = F.when(F.col("opens"), "refreshed").otherwise("resolved")
    old = F.struct("detail", "opened_at", "valid_from", F.when(told, now).alias("valid_to"), F.when(told, closing).otherwise("open").alias("status"))
    new = F.struct(F.col("new_detail").alias("detail"), F.coalesce("opened_at", now).alias("opened_at"), now.alias("valid_from"), F.lit(None).cast("timestamp").alias("valid_to"), F.lit("open").alias("status"))
    rows = F.filter(F.array(F.when(there, old), F.when(F.coalesce("opens", F.lit(False)), new)), lambda r: r.isNotNull())
    moved = joined.select(*_KEY, F.inline(rows))
    return queue.where("status <> 'open'").select(*moved.columns).unionByName(moved)
