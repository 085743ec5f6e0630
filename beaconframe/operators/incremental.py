"""State across runs: carry-over, rolling windows, the hourly run with its ledger, caches, previous source rows."""

from __future__ import annotations

import json
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from beaconframe.operators.filters import retain
from beaconframe.operators.ranking import ranked
from beaconframe.operators.selection import first_wins, select_diverse
from beaconframe.operators.state import Scratch, materialize, small


def partition_by_cache(items: DataFrame, prior: DataFrame, key: str, now: datetime, max_age: timedelta | None = None) -> tuple[DataFrame, DataFrame]:
    """(reused, fresh): items whose key `prior` (key, fetched) has and that were fetched within `max_age` (if told; a missing time is young), and all others."""
    known = prior.groupBy(key).agg(F.max("fetched").alias("_fetched"), F.lit(True).alias("_hit"))
    both = items.join(known, key, "left")
    old = F.lit(False) if max_age is None else F.coalesce(F.col("_fetched") < F.lit(now - max_age), F.lit(False))
    hit = F.coalesce(F.col("_hit"), F.lit(False)) & ~old
    return both.where(hit).select(*items.columns), both.where(~hit).select(*items.columns)


def exclude_enriched(items: DataFrame, enriched: DataFrame, key: str = "link") -> DataFrame:
    """Items whose link no enriched row has."""
    return items.join(enriched.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti").select(*items.columns)


def drop_shadowed(df: DataFrame, other: DataFrame, prefix: str, plain: str, key: str = "id") -> DataFrame:
    """Rows whose id begins with `prefix` go if `other` has the id with `plain` in its place."""
    twin = F.when(F.col(key).startswith(prefix), F.concat(F.lit(plain), F.substring(F.col(key), F.lit(len(prefix) + 1), F.length(key))))
    return df.withColumn("_twin", twin).join(other.select(F.col(key).alias("_twin")).distinct(), "_twin", "left_anti").select(*df.columns)


def previous_source(current: DataFrame, previous: DataFrame) -> DataFrame:
    """Each current row (row, key, dataset, name) with the previous row (same columns and `at`) that fits best: key with dataset and name, else dataset with name, else name. A blank value fits any; of equal ones the first by `row`.

    Returns (row, priority, previous_row, at), null where none fits.
    """
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    p = previous.select(F.col("row").alias("previous_row"), *(F.col(c).alias(f"p_{c}") for c in ("key", "dataset", "name")), "at")
    fits = lambda c: blank(c) | (F.col(c) == F.col(f"p_{c}"))
    exact = current.where(~blank("key")).join(p, F.col("key") == F.col("p_key")).where(fits("dataset") & fits("name")).withColumn("priority", F.lit(1))
    by_dataset = current.where(~blank("dataset")).join(p, F.col("dataset") == F.col("p_dataset")).where(fits("name")).withColumn("priority", F.lit(2))
    by_name = current.where(~blank("name")).join(p, F.col("name") == F.col("p_name")).withColumn("priority", F.lit(3))
    best = exact.union(by_dataset).union(by_name).groupBy("row").agg(F.min(F.struct("priority", "previous_row", "at")).alias("m"))
    return current.select("row").join(best, "row", "left").select("row", "m.priority", "m.previous_row", "m.at")


def merge_source_state(status: DataFrame, events: DataFrame, previous: DataFrame, now: datetime) -> DataFrame:
    """Health of each dataset from this run's status (dataset, ok, skipped, configured, error), its events (dataset, fetched) and the previous state (dataset, last_success, last_attempt, fetched, stale).

    Returns configured, last_success, last_attempt, stale, skipped and error.
    """
    fetched = events.groupBy("dataset").agg(F.max("fetched").alias("_event"))
    p = previous.select("dataset", F.col("last_success").alias("_success"), F.col("last_attempt").alias("_attempt"), F.col("fetched").alias("_fetched"), F.col("stale").alias("_stale"))
    s = status.join(fetched, "dataset", "left").join(p, "dataset", "left")
    ok, configured, skipped = (F.coalesce(F.col(c), F.lit(x)) for c, x in (("ok", False), ("configured", True), ("skipped", False)))
    attempted = ~skipped | ~configured
    before = F.coalesce("_success", F.when(~F.coalesce(F.col("_stale"), F.lit(False)), F.col("_fetched")), "_event")
    return s.select(
        "dataset", configured.alias("configured"), F.when(ok, F.coalesce("_event", F.lit(now))).otherwise(before).alias("last_success"), F.when(attempted, F.lit(now)).otherwise(F.col("_attempt")).alias("last_attempt"),
        F.when(skipped & configured, F.coalesce(F.col("_stale"), F.lit(False))).otherwise(~ok).alias("stale"), (~attempted).alias("skipped"), "error",
    )


def event_freshness(events: DataFrame, sources: DataFrame) -> DataFrame:
    """(n, fresh): by the sources of the event's source name, else of its dataset; stale only if all of them are."""
    flags = lambda c, name: sources.where(F.coalesce(F.col(c), F.lit("")) != "").groupBy(F.col(c).alias(name)).agg(F.bool_and(F.coalesce(F.col("stale"), F.lit(False))).alias(f"_{name}"))
    e = events.select("n", "source_name", "dataset").join(flags("name", "source_name"), "source_name", "left").join(flags("dataset", "dataset"), "dataset", "left")
    return e.select("n", F.when(F.coalesce("_source_name", "_dataset", F.lit(False)), "stale").otherwise("fresh").alias("fresh"))


def domain_sources(domains: DataFrame, sources: DataFrame) -> DataFrame:
    """(key, dataset): sources of a domain's scope whose dataset or category it lists. `domains` is a small table."""
    s, d = sources.alias("s"), small(domains).alias("d")
    hit = (F.col("d.scope") == F.col("s.scope")) & (F.array_contains("d.datasets", F.col("s.dataset")) | F.array_contains("d.categories", F.col("s.category")))
    return s.join(d, hit).select("d.key", "s.dataset")


def feed_label(events: DataFrame, items: DataFrame) -> DataFrame:
    """(n, label): the label of the raw item with the event's link, else the label in its query, else its source's name."""
    known = items.where("link is not null").groupBy("link").agg(F.min("label").alias("_label"))
    told = F.nullif(F.regexp_extract(F.coalesce("query", F.lit("")), r"^(.+?)｜", 1), F.lit(""))
    return events.join(known, "link", "left").select("n", F.coalesce("_label", told, "source_name").alias("label"))


def carry_over(fresh: DataFrame, old: DataFrame, status: DataFrame, by: str = "dataset") -> DataFrame:
    """Of each dataset the fresh rows if its run was ok, none if it was skipped in an exclusive run, else the old rows. `status` has (dataset, ok, exclusive)."""
    s = status.select(by, F.coalesce(F.col("ok"), F.lit(False)).alias("_ok"), F.coalesce(F.col("exclusive"), F.lit(False)).alias("_none"))
    ok, kept = s.where("_ok").select(by), s.where("_ok or _none").select(by)
    return fresh.join(ok, by, "left_semi").unionByName(old.join(kept, by, "left_anti"), allowMissingColumns=True)


def roll_news(fresh: DataFrame, old: DataFrame, now: datetime, keep: Column, key: Column, order: str = "n", days: int = 5, policy: Column | None = None, policies: dict[str, int] | None = None) -> DataFrame:
    """Fresh rows before old ones, the first of each key (rows without one stay), those that pass `keep` and are within their retention."""
    both = fresh.withColumn("_side", F.lit(0)).unionByName(old.withColumn("_side", F.lit(1)), allowMissingColumns=True)
    kept = retain(both.where(keep), now, days, policy, policies).withColumn("_order", F.struct("_side", order))
    return first_wins(kept, key, "_order", keep_empty=True).drop("_side", "_order")


def accumulate(fresh: DataFrame, old: DataFrame, now: datetime, days: int = 5, cap: int = 250, order: str = "n") -> DataFrame:
    """The pool of fresh and old rows: fresh ones win by id; datasets kept as a whole (policy 'stateful') are replaced by a fresh one and neither age nor count; all others age out after `days` and are chosen by `select_diverse`."""
    whole = F.when(F.col("policy") == "stateful", F.col("dataset"))
    replaced = fresh.select(whole.alias("_whole")).where("_whole is not null").distinct()
    rest = old.withColumn("_whole", whole).join(replaced, "_whole", "left_anti").select(*old.columns)
    both = fresh.withColumn("_side", F.lit(0)).unionByName(rest.withColumn("_side", F.lit(1)))
    young = whole.isNotNull() | F.col("ts").isNull() | (F.col("ts") >= F.lit(now - timedelta(days=days)))
    first = first_wins(both.where(young).withColumn("_order", F.struct("_side", order)), "id", "_order").drop("_side", "_order")
    return first.where(whole.isNotNull()).unionByName(select_diverse(first.where(whole.isNull()), cap, order))


def hourly_run(events: DataFrame, ledger: DataFrame, records: DataFrame, hour: str, most: int | None = None, least: int = 200, order: str = "n") -> tuple[DataFrame, DataFrame]:
    """(run, new records) of an hour. `events` has fingerprint and `order`, `ledger` fingerprints of all runs, `records` (hour, fingerprint) those of the runs that are kept.

    An event is a duplicate if its fingerprint is known or came before in the
    run as a new record; new ones beyond `most` for the hour are deferred, with
    all their repeats. The run's row counts fetched, unique, new (also of earlier runs of the hour), duplicate and deferred ones.
    """
    known = ledger.select("fingerprint").union(records.select("fingerprint")).distinct().withColumn("_known", F.lit(True))
    by_print = events.groupBy("fingerprint").agg(F.count("*").alias("k"), F.min(order).alias("first")).join(known, "fingerprint", "left")
    had = records.where(F.col("hour") == hour).select("fingerprint").distinct().count()
    fresh = by_print.where("_known is null")
    taken = fresh if most is None else fresh.orderBy("first").limit(max(0, most - had))
    taken = taken.select("fingerprint", "first", F.lit(True).alias("_new"))
    told = by_print.select("fingerprint", "k", "_known").join(taken, "fingerprint", "left")
    is_new, is_known = F.col("_new").isNotNull(), F.col("_known").isNotNull()
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    run = told.agg(
        total(F.col("k")).alias("fetched"), F.count("*").alias("unique"), (F.count_if(is_new) + had).alias("new"),
        (total(F.when(is_known, F.col("k"))) + total(F.when(is_new, F.col("k") - 1))).alias("duplicate"), total(F.when(~is_known & ~is_new, F.col("k"))).alias("deferred"),
    )
    return run.select(F.lit(hour).alias("hour"), "*", (F.col("new") >= least).alias("enough")), taken.select(F.lit(hour).alias("hour"), "fingerprint", "first")


def merge_runs(old: DataFrame, new: DataFrame) -> DataFrame:
    """Runs by hour: the larger fetched and unique counts, the sum of duplicates, the newest run's new and deferred counts, and the number of attempts. Runs have (hour, at, fetched, unique, new, duplicate, deferred)."""
    both = old.unionByName(new)
    last = F.max_by(F.struct("new", "deferred"), "at")
    return both.groupBy("hour").agg(F.max("at").alias("at"), F.max("fetched").alias("fetched"), F.max("unique").alias("unique"), last.alias("_l"), F.sum("duplicate").alias("duplicate"), F.count("*").alias("attempts")).select("hour", "at", "fetched", "unique", "_l.new", "duplicate", "_l.deferred", "attempts")


def entry_bytes(fingerprint: str) -> Column:
    """Bytes of a fingerprint as a line of a JSON list."""
    return F.octet_length(F.to_json(F.struct(F.col(fingerprint).alias("f")))) - len('{"f":}') + 8


def bound_ledger(ledger: DataFrame, records: DataFrame, most_bytes: int, generated: str | None = None, stretch: int = 65_536) -> DataFrame:
    """(fingerprint, touch): from the most recently touched one on, each fingerprint that still fits the budget; one that does not is skipped and the next is tried.

    `ledger` has (fingerprint, touch), `records` touches of later runs; equal
    touches go by fingerprint. With `generated` the bytes of a list without
    entries count too. Entries get their place in the whole order; sums of
    stretches of places tell in which one the budget is first exceeded, and only
    that one is summed entry by entry. From there on only entries that are no
    larger than what is left can follow, so each further pass adds one at
    least, and there are as many passes as entries of the smallest size fit into the largest one.
    """
    touched = ledger.select("fingerprint", "touch").union(records.select("fingerprint", "touch")).where("fingerprint <> ''").groupBy("fingerprint").agg(F.max("touch").alias("touch"))
    with Scratch(ledger.sparkSession) as table:
        placed = table(ranked(touched.withColumn("size", entry_bytes("fingerprint")), [], [F.desc("touch"), F.asc("fingerprint")], "place", table=table), "placed")
        left = most_bytes - (len(json.dumps({"generatedAt": generated, "seen": []}, indent=2, ensure_ascii=False).encode()) + 1 if generated is not None else 0)
        at, kept = 0, F.lit(False)
        while True:
            fits = (F.col("place") > at) & (F.col("size") <= left)
            some = placed.where(fits)
            sums = some.groupBy(F.floor((F.col("place") - 1) / stretch).alias("part")).agg(F.sum("size").alias("total"))
            before = F.coalesce(F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
            over = sums.withColumn("before", before).where(F.col("before") + F.col("total") > left).orderBy("part").first()
            if over is None:
                kept |= fits
                break
            run = F.sum("size").over(Window.orderBy("place").rowsBetween(Window.unboundedPreceding, 0))
            one = some.where(F.floor((F.col("place") - 1) / stretch) == over["part"]).withColumn("used", run + over["before"])  # `stretch` rows at most
            end = one.where(F.col("used") > left).orderBy("place").first()
            kept |= fits & (F.col("place") < end["place"])
            at, left = end["place"], left - (end["used"] - end["size"])
        return materialize(placed.where(kept).select("fingerprint", "touch"), "ledger")


def refresh_reused(reused: DataFrame, items: DataFrame, key: str = "link") -> DataFrame:
    """Reused rows with the time of the current item of their link, if it has one."""
    now = items.where(F.col(key).isNotNull()).groupBy(key).agg(F.max("ts").alias("_ts"))
    return reused.join(now, key, "left").withColumn("ts", F.coalesce("_ts", "ts")).select(*reused.columns)


def override_category(df: DataFrame, category: Column, basis: Column, region: Column, nowhere: str = "全國") -> DataFrame:
    """The rule's category instead of the model's where a rule decided (basis 'rule:...'), and a region found in the text instead of none."""
    ruled = basis.startswith("rule:")
    return df.withColumns({"category": F.when(ruled, category).otherwise(F.col("category")), "region": F.when((F.col("region") == nowhere) & (region != nowhere), region).otherwise(F.col("region"))})
