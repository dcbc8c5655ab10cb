"""References to records that do not exist at the time of the reference (problem 4).

A key exists at time t if its latest load at or before t is later than its latest removal at or before t. Both are
running maxima, so parts of a key's history can be summed up and carried on.

Plan: references are counted per field, key and period (*cells*), with the first and last time of each; a hot key is
one row per period from then on. Cells meet the histories of their keys, one row a key, in a shuffled anti-join that
drops every cell through which its key exists all along; what remains has all orphans. Only references of these
cells go on, to an exact check by time, as a cell may hold others too.

In that check, keys that hold a large share or number of the references and events are *heavy*. Heavy keys with a
short history are checked against a broadcast table of bounded size (keys x history). All others meet their history in
one shuffle; there a heavy key with a long history is cut into days (each with the maxima carried in from earlier days)
and salts, so that no task gets a key's rows whole. Both results are put together with a union.

Edge cases: blank and null keys are no references; references without a time are left out; null load times count as
no load, null removal times as no removal; repeated rows are each reported under their own ``line_no``; with empty key
tables every reference is missing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltwork.session import stored
from siltwork.sources.tables import id_key, is_blank

#: A key is heavy with at least this share of all rows, or this many: there are at most 1 / share or rows / number of them.
HEAVY_SHARE, HEAVY_ROWS = 1 / 256, 2_000_000
#: Longest history of a heavy key that is broadcast; the broadcast has at most that many keys x 2 x this many times.
BROADCAST_HISTORY = 64
#: Longest history of a key that is one row in the anti-join; cells of other keys all go to the exact check.
JOINED_HISTORY = 1000
#: Parts into which the references of one day of a heavy key with a long history are split.
SALTS = 16

FIELDS = {"doc_id": "docs_file", "query_id": "queries_file"}


def references_of(qrels: DataFrame) -> DataFrame:
    """``(line_no, ref_field, key, at, ref_period)``: every non-blank key named at a known time."""
    both = F.explode(
        F.array(*[F.struct(F.lit(f).alias("ref_field"), F.col(f).alias("raw")) for f in FIELDS])
    ).alias("r")
    return (
        qrels.where(F.col("judged_at").isNotNull())
        .select("line_no", F.col("judged_at").alias("at"), both)
        .where(~is_blank("r.raw"))
        .select(
            "line_no",
            F.col("r.ref_field").alias("ref_field"),
            id_key(F.col("r.raw")).alias("key"),
            "at",
            F.date_format("at", "yyyy-MM").alias("ref_period"),
        )
    )


def events_of(loads: dict[str, DataFrame], removed: DataFrame) -> DataFrame:
    """``(ref_field, key, at, load)`` without repeats; ``load`` is false for a removal."""
    parts = [
        df.select(F.lit(f).alias("ref_field"), id_key(f).alias("key"), F.col("loaded_at").alias("at"), F.lit(True).alias("load"))
        for f, df in loads.items()
    ]
    field = F.lit(None).cast("string")
    for f, name in FIELDS.items():
        field = F.when(F.lower(F.trim("table_name")) == name, f).otherwise(field)
    parts.append(removed.select(field.alias("ref_field"), id_key("key_value").alias("key"), F.col("removed_at").alias("at"), F.lit(False).alias("load")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where("ref_field is not null and key is not null and at is not null").distinct()


def _reason(load, removal, ever) -> F.Column:
    exists = load.isNotNull() & (removal.isNull() | (removal < load))
    return F.when(exists, F.lit(None).cast("string")).when(~ever, "missing").when(load.isNull(), "late").otherwise("removed")


def _histories(events: DataFrame) -> DataFrame:
    """``(ref_field, key, loads, removals)``: the times of a key's events, one row a key."""
    return events.groupBy("ref_field", "key").agg(
        F.collect_list(F.when(F.col("load"), F.col("at"))).alias("loads"), F.collect_list(F.when(~F.col("load"), F.col("at"))).alias("removals")
    )


def open_cells(cells: DataFrame, events: DataFrame) -> DataFrame:
    """The ``cells`` (ref_field, key, ref_period, n_refs, first, last) through which their key does not exist all along.

    A cell is left out if its key was loaded at or before the first reference and not removed between the latest such
    load and the last one, both ends included.
    """
    keys = ["ref_field", "key"]
    long_ = stored(events.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > JOINED_HISTORY), "long-histories")
    h = _histories(events.join(long_, keys, "left_anti")).select(*[F.col(k).alias(f"h_{k}") for k in keys], "loads", "removals")
    load = F.array_max(F.filter("loads", lambda x: x <= F.col("first")))
    covered = load.isNotNull() & ~F.exists("removals", lambda x: (x >= load) & (x <= F.col("last")))
    return cells.join(h, (F.col("ref_field") == F.col("h_ref_field")) & (F.col("key") == F.col("h_key")) & covered, "left_anti")


def orphans(qrels: DataFrame, loads: dict[str, DataFrame], removed: DataFrame) -> DataFrame:
    """``(line_no, ref_field, reason, ref_period)`` of the references whose key does not exist at their time."""
    keys = ["ref_field", "key"]
    refs, events = references_of(qrels), stored(events_of(loads, removed), "events")
    cells = refs.groupBy(*keys, "ref_period").agg(F.count(F.lit(1)).alias("n_refs"), F.min("at").alias("first"), F.max("at").alias("last"))
    open_ = stored(open_cells(cells, events), "cells")
    refs = stored(refs.join(open_.select(*keys, "ref_period"), [*keys, "ref_period"], "left_semi"), "references")
    weights = (
        open_.select(*keys, "n_refs", F.lit(0).cast("long").alias("n_events"))
        .unionByName(events.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_events")).withColumn("n_refs", F.lit(0).cast("long")))
        .groupBy(*keys)
        .agg(F.sum("n_refs").alias("n_refs"), F.sum("n_events").alias("n_events"))
    )
    # row counts come from the file footers; they bound the sum of all weights, and so the number of heavy keys
    total = len(FIELDS) * qrels.count() + sum(df.count() for df in loads.values()) + removed.count()
    least = max(1.0, min(total * HEAVY_SHARE, HEAVY_ROWS))
    heavy_rows = weights.where(F.col("n_refs") + F.col("n_events") >= least).select(*keys, "n_events").collect()
    spark = qrels.sparkSession
    heavy = spark.createDataFrame([(r[0], r[1], r[2] <= BROADCAST_HISTORY) for r in heavy_rows], "ref_field string, key string, short boolean")
    marked_refs = refs.join(F.broadcast(heavy), keys, "left")
    marked_events = events.join(F.broadcast(heavy), keys, "left")

    short = _histories(marked_events.where("short"))
    upto = lambda c: F.array_max(F.filter(F.coalesce(F.col(c), F.array().cast(short.schema[c].dataType)), lambda x: x <= F.col("at")))
    by_broadcast = (
        marked_refs.where("short")
        .join(F.broadcast(short), keys, "left")
        .withColumn("reason", _reason(upto("loads"), upto("removals"), F.coalesce(F.size("loads") > 0, F.lit(False))))
        .select("line_no", "ref_field", "reason", "ref_period")
    )

    # The rest: references and history of a key in one window; long heavy keys by day and salt.
    long_ = F.coalesce(~F.col("short"), F.lit(False))
    day = F.when(long_, F.to_date("at"))
    rest_refs = marked_refs.where("short is null or not short").select(
        *keys, day.alias("day"), F.when(long_, F.pmod(F.hash("line_no"), F.lit(SALTS))).alias("salt"), "at", "line_no", "ref_period"
    )
    plain = marked_events.where("short is null").select(
        *keys, F.lit(None).cast("date").alias("day"), F.lit(None).cast("int").alias("salt"), "at",
        F.when(F.col("load"), F.col("at")).alias("load_at"), F.when(~F.col("load"), F.col("at")).alias("removed_at"), F.col("load").alias("ever"),
    )
    history = plain.unionByName(_by_day(marked_events.where("not short"), rest_refs.where("day is not null"), keys))
    rows = rest_refs.withColumns(
        {"load_at": F.lit(None).cast(history.schema["load_at"].dataType), "removed_at": F.lit(None).cast(history.schema["load_at"].dataType), "ever": F.lit(False)}
    ).unionByName(history.withColumns({"line_no": F.lit(None).cast(rest_refs.schema["line_no"].dataType), "ref_period": F.lit(None).cast("string")}))
    group = Window.partitionBy(*keys, "day", "salt")
    past = group.orderBy("at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    by_shuffle = (
        rows.withColumns({"l": F.max("load_at").over(past), "r": F.max("removed_at").over(past), "e": F.max("ever").over(group)})
        .where("line_no is not null")
        .withColumn("reason", _reason(F.col("l"), F.col("r"), F.coalesce(F.col("e"), F.lit(False))))
        .select("line_no", "ref_field", "reason", "ref_period")
    )
    return by_broadcast.unionByName(by_shuffle).where("reason is not null")


def _by_day(events: DataFrame, refs: DataFrame, keys: list[str]) -> DataFrame:
    """History of long heavy keys for each of their days with references, and for each salt.

    A day has its own events and one row with the maxima of all earlier days. The days of a heavy key are summed up
    before they are put in order, so a window holds one row per key and day.
    """
    daily = events.groupBy(*keys, F.to_date("at").alias("day")).agg(
        F.max(F.when(F.col("load"), F.col("at"))).alias("l"), F.max(F.when(~F.col("load"), F.col("at"))).alias("r"), F.max("load").alias("ever")
    )
    wanted = refs.groupBy(*keys, "day").agg(F.lit(True).alias("wanted"))
    kind = daily.schema["l"].dataType
    days = (
        daily.withColumn("wanted", F.lit(False))
        .unionByName(wanted.withColumns({"l": F.lit(None).cast(kind), "r": F.lit(None).cast(kind), "ever": F.lit(False)}))
        .groupBy(*keys, "day")
        .agg(F.max("l").alias("l"), F.max("r").alias("r"), F.max("ever").alias("ever"), F.max("wanted").alias("wanted"))
    )
    before = Window.partitionBy(*keys).orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        days.withColumns({"load_at": F.max("l").over(before), "removed_at": F.max("r").over(before), "ever": F.max("ever").over(Window.partitionBy(*keys))})
        .where("wanted")
        .select(*keys, "day", F.col("day").cast(kind).alias("at"), "load_at", "removed_at", "ever")
    )
    own = events.select(
        *keys, F.to_date("at").alias("day"), "at", F.when(F.col("load"), F.col("at")).alias("load_at"), F.when(~F.col("load"), F.col("at")).alias("removed_at"), F.col("load").alias("ever")
    )
    return carried.unionByName(own).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def orphan_report(found: DataFrame) -> DataFrame:
    """``(table_name, ref_period, reason, n_refs)`` of orphans: counts per target table, month and reason."""
    name = F.lit(None).cast("string")
    for f, t in FIELDS.items():
        name = F.when(F.col("ref_field") == f, t).otherwise(name)
    return found.groupBy(name.alias("table_name"), "ref_period", "reason").agg(F.count(F.lit(1)).alias("n_refs"))
