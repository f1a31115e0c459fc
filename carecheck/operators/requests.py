"""Requests that meet facts by an id that some of them share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HEAVY = 256  # an id with more than this part of all requests is heavy, so there are fewer such ids than this


def join_facts(requests: DataFrame, facts: DataFrame, key: str = "facility_id") -> DataFrame:
    """Left join of requests with facts, one row of facts per id. Counts the requests per id, a job of its own.

    The facts of heavy ids, at most ``HEAVY`` rows, go to where their requests are; so do requests without an id, which
    have no facts. The others meet by key, where no id holds more than its small share.
    """
    counts = requests.where(F.col(key).isNotNull()).groupBy(key).count()
    limit = requests.count() / HEAVY
    heavy = [r[0] for r in counts.where(F.col("count") > limit).collect()] if limit > 1 else []
    here = F.col(key).isNull() | F.col(key).isin(heavy)
    few = facts.where(F.col(key).isin(heavy))
    return requests.where(here).join(F.broadcast(few), key, "left").unionByName(
        requests.where(~here).join(facts, key, "left"))
