"""Replays of the conditional writes around leadership: versioned transfers and locks with a time to live."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandem.operators.chain import follow
from tandem.operators.scan import HotKeys, Running, find_hot_keys, running

# fixed value: how long a lock lasts without renewal
LOCK_TTL_S = 30

# ids of log rows are 0 or more; the state before the first row is a node of its own
START = -1


def leader_transfers(attempts: DataFrame, leaders: DataFrame) -> DataFrame:
    """Each attempt with ``accepted``: it names the current leader and the current version.

    ``leaders`` (pair_id, app, version) is where each pair starts. If an attempt succeeds, the next one that
    can succeed is the first later attempt from its new leader at the next version.
    """
    hot = find_hot_keys(attempts, ["pair_id"], "seq")
    done = attempts.select(
        "pair_id", F.col("to_app").alias("app"), (F.col("expected_version") + 1).alias("version"), "seq",
        F.lit(False).alias("tries"),
    ).unionByName(leaders.select("pair_id", "app", F.col("version").cast("bigint").alias("version"), F.lit(START).cast("bigint").alias("seq"), F.lit(False).alias("tries")))
    tried = attempts.select("pair_id", F.col("from_app").alias("app"), F.col("expected_version").alias("version"), "seq", F.lit(True).alias("tries"))
    events = done.unionByName(tried).withColumn("_back", -F.col("seq"))
    ahead = Running("next", "last", F.when(F.col("tries"), F.col("seq")))
    keys = ["pair_id", "app", "version"]
    linked = running(events, keys, ["_back"], ahead, hot=hot.finer(keys, "_back")).filter(~F.col("tries"))
    won = follow(linked.select("pair_id", F.col("seq").alias("id"), "next"), "pair_id", hot.finer(["pair_id"], "id"))
    won = won.filter(F.col("id") != START).select("pair_id", F.col("id").alias("seq"), F.lit(True).alias("accepted"))
    return attempts.join(won, ["pair_id", "seq"], "left").fillna(False, ["accepted"])


def current_leaders(transfers: DataFrame, leaders: DataFrame) -> DataFrame:
    """Leader and version per pair after all accepted transfers."""
    rows = transfers.filter("accepted").select("pair_id", F.col("to_app").alias("app"), (F.col("expected_version") + 1).alias("version"))
    both = rows.unionByName(leaders.select("pair_id", "app", F.col("version").cast("bigint").alias("version")))
    last = both.groupBy("pair_id").agg(F.max(F.struct("version", "app")).alias("s"))
    return last.select("pair_id", F.col("s.app").alias("leader"), F.col("s.version").alias("version"))


def hot_locks(ops: DataFrame) -> HotKeys:
    """Found once for a replay and what is read from it, since accepted operations are some of all."""
    return find_hot_keys(ops, ["lock_id"], "seq")


def lease_replay(ops: DataFrame, ttl_s: int = LOCK_TTL_S, hot: HotKeys | None = None) -> DataFrame:
    """Each lock operation with ``accepted``.

    An acquire needs a free or expired lock (expiry strictly before now), a renew or release needs the same
    holder. After a success the state of the lock is known, so the next success is known too: the holder's
    next renew or release, or the first acquire after expiry, whichever comes first; after a release the
    first acquire. ``seq`` orders the log and ``at_s`` never falls along it.
    """
    hot = hot or hot_locks(ops)
    own = ops.withColumn("_back", -F.col("seq"))
    holder = Running("next_own", "last", F.when(F.col("op") != "ACQUIRE", F.col("seq")), before=True)
    keys = ["lock_id", "coordinator_id"]
    own = running(own, keys, ["_back"], holder, hot=hot.finer(keys, "_back"))

    released = F.col("op") == "RELEASE"
    # a probe sees the acquires of later seconds only, or, after a release, all later rows
    probes = own.select(
        "lock_id", "seq", F.when(~released, F.col("next_own")).alias("next_own"), F.lit(0).alias("is_acquire"),
        F.when(released, -F.col("at_s")).otherwise(-(F.col("at_s") + ttl_s)).alias("_time"),
        F.when(released, -F.col("seq")).otherwise(F.lit(-(2**63) + 1)).alias("_place"),
    )
    acquires = ops.filter(F.col("op") == "ACQUIRE").select(
        "lock_id", "seq", F.lit(None).cast("bigint").alias("next_own"), F.lit(1).alias("is_acquire"),
        (-F.col("at_s")).alias("_time"), (-F.col("seq")).alias("_place"),
    )
    ahead = Running("next_acquire", "last", F.when(F.col("is_acquire") == 1, F.col("seq")))
    linked = running(probes.unionByName(acquires), ["lock_id"], ["_time", "_place", "is_acquire"], ahead, hot=hot.finer(["lock_id"], "_time"))
    nodes = linked.filter("is_acquire = 0").select("lock_id", F.col("seq").alias("id"), F.least("next_own", "next_acquire").alias("next"))
    first = ops.groupBy("lock_id").agg(
        F.lit(START).cast("bigint").alias("id"), F.min(F.when(F.col("op") == "ACQUIRE", F.col("seq"))).alias("next")
    )
    won = follow(nodes.unionByName(first), "lock_id", hot.finer(["lock_id"], "id")).filter(F.col("id") != START).select("lock_id", F.col("id").alias("seq"), F.lit(True).alias("accepted"))
    return ops.join(won, ["lock_id", "seq"], "left").fillna(False, ["accepted"])


def lease_intervals(replayed: DataFrame, ttl_s: int = LOCK_TTL_S, hot: HotKeys | None = None) -> DataFrame:
    """Who held each lock and when: from an accepted acquire to its release, or to the expiry of its last renewal."""
    accepted = replayed.filter("accepted")
    start = Running("session", "last", F.when(F.col("op") == "ACQUIRE", F.col("seq")))
    rows = running(accepted, ["lock_id"], ["seq"], start, hot=hot)
    released = F.max(F.when(F.col("op") == "RELEASE", F.col("at_s")))
    expires = F.max(F.when(F.col("op") != "RELEASE", F.col("at_s"))) + ttl_s
    return rows.groupBy("lock_id", "session", "coordinator_id").agg(
        F.min("at_s").alias("from_s"),
        F.coalesce(released, expires).alias("until_s"),
        F.count_if(F.col("op") == "RENEW").alias("renewals"),
        F.when(released.isNotNull(), "RELEASED").otherwise("EXPIRED").alias("ended_by"),
    ).drop("session")


def lock_holders(intervals: DataFrame, now_s: int) -> DataFrame:
    """The holder per lock at a moment; at the very second of expiry nobody holds it."""
    return intervals.filter((F.col("from_s") <= now_s) & (F.col("until_s") > now_s)).select("lock_id", F.col("coordinator_id").alias("holder"))
