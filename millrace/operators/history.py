"""History and change data (INC): SCD1, SCD2, CDC feeds, snapshot differences.

The frame functions compute a new history from an old one and a batch; ``upsert_scd2`` stores the
outcome in a versioned table with one merge.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import InvalidSpec
from ..functions.strings import row_hash
from ..table import VersionedTable
from .windows import collapse_unchanged, latest_per_key

META = ("row_hash", "effective_from", "effective_to", "is_current")


def current_dimension(raw: DataFrame, key: str, labels: Mapping[str, str], order: Sequence[Column]) -> DataFrame:
    """SCD1: the latest row of each trimmed upper-case key, with empty labels named (INC-08)."""
    clean = raw.withColumn(key, F.upper(F.trim(key))).withColumns({c: F.coalesce(F.nullif(F.trim(F.col(c)), F.lit("")), F.lit(v)) for c, v in labels.items()})
    return latest_per_key(clean.where(F.col(key).isNotNull() & (F.col(key) != "")), [key], order)


def build_scd2(changes: DataFrame, keys: Sequence[str], tracked: Sequence[str], at: str) -> DataFrame:
    """A whole history from all changes (INC-06): repeats collapse, each version ends where the next begins.

    Changes of one key must differ in time.
    """
    hashed = changes.select(*keys, *tracked, F.col(at).alias("effective_from"), row_hash(*tracked).alias("row_hash"))
    w = Window.partitionBy(*keys).orderBy("effective_from")
    kept = collapse_unchanged(hashed, keys, [F.col("effective_from")], "row_hash")
    ends = kept.withColumn("effective_to", F.lead("effective_from").over(w))
    return ends.withColumn("is_current", F.col("effective_to").isNull()).select(*keys, *tracked, *META)


def scd2_batch(history: DataFrame, batch: DataFrame, keys: Sequence[str], tracked: Sequence[str], at: str) -> tuple[DataFrame, DataFrame]:
    """(rows to merge, late rows) for a batch of changes against a history (INC-05).

    A change at or before its key's current version is late and is returned, not applied; so the
    same batch again changes nothing.  Changes that repeat the values before them collapse.  The
    rows to merge are the new versions, and with ``__close`` the current version that each key's
    first new one ends.
    """
    now = history.where("is_current").select(*keys, F.col("row_hash").alias("__now_hash"), F.col("effective_from").alias("__now_from"))
    seen = batch.withColumn("row_hash", row_hash(*tracked)).join(now, list(keys), "left")
    is_late = F.coalesce(F.col(at) <= F.col("__now_from"), F.lit(False))
    late = seen.where(is_late).select(*batch.columns)
    fresh = collapse_unchanged(seen.where(~is_late), keys, [F.col(at)], "row_hash", current="__now_hash")
    w = Window.partitionBy(*keys).orderBy(at)
    chain = fresh.withColumns({"effective_to": F.lead(at).over(w), "__first": F.row_number().over(w) == 1})
    versions = chain.select(*keys, *tracked, "row_hash", F.col(at).alias("effective_from"), "effective_to", F.col("effective_to").isNull().alias("is_current"), F.lit(False).alias("__close"))
    closes = chain.where(F.col("__first") & F.col("__now_from").isNotNull()).select(
        *keys, *(F.lit(None).cast(batch.schema[c].dataType).alias(c) for c in tracked), F.lit(None).cast("string").alias("row_hash"), F.col("__now_from").alias("effective_from"), F.col(at).alias("effective_to"), F.lit(False).alias("is_current"), F.lit(True).alias("__close"))
    return closes.unionByName(versions), late


def upsert_scd2(table: VersionedTable, batch: DataFrame, keys: Sequence[str], tracked: Sequence[str], at: str) -> DataFrame:
    """Applies a batch to an SCD2 table with one commit; returns the late rows (pinned to the version they were judged by)."""
    history = table.read()
    rows, late = scd2_batch(history, batch, keys, tracked, at)
    table.merge(
        rows, [*keys, "effective_from"], update={"effective_to": "s.effective_to", "is_current": "false"}, update_if="s.__close AND t.is_current",
        insert={c: f"s.`{c}`" for c in (*keys, *tracked, *META)}, insert_if="NOT s.__close", operation="SCD2")
    return late


def naive_scd2(table: VersionedTable, batch: DataFrame, keys: Sequence[str], tracked: Sequence[str], at: str) -> None:
    """Merges changes on the key alone; raises where a key changes twice in a batch (INC-07).  For contrast."""
    rows = batch.select(*keys, *tracked, row_hash(*tracked).alias("row_hash"), F.col(at).alias("effective_from"), F.lit(None).cast("timestamp").alias("effective_to"), F.lit(True).alias("is_current"))
    table.merge(rows, keys, update={"effective_to": "s.effective_from", "is_current": "false"}, target_if="is_current", insert="*")


def apply_cdc(history: DataFrame | None, feed: DataFrame, keys: Sequence[str], sequence: str, *, deletes: str | None = None, exclude: Sequence[str] = (), ignore_null_updates: bool = False, track: Sequence[str] | None = None, scd: int = 1) -> DataFrame:
    """State after a change feed (INC-09).

    ``deletes``: condition on feed rows that delete; ``exclude``: columns that don't go to the target;
    ``ignore_null_updates``: NULL means "unchanged"; ``track``: columns whose change makes a version.
    SCD 1 gives the latest row of each key; SCD 2 all versions, late changes slotted in: ``history``
    is what an earlier call returned, and keys are rebuilt from both.
    """
    gone = F.coalesce(F.expr(deletes), F.lit(False)) if deletes else F.lit(False)
    columns = [c for c in feed.columns if c not in (*keys, *exclude, sequence)]
    rows = feed.select(*keys, F.col(sequence).alias("__seq"), gone.alias("__gone"), *columns)
    if history is not None:
        old = history.select(*keys, F.col("__start_at" if scd == 2 else sequence).alias("__seq"), F.lit(False).alias("__gone"), *columns)
        if scd == 2:  # a version that ends without a successor was deleted then
            follow = F.lead("__start_at").over(Window.partitionBy(*keys).orderBy("__start_at"))
            ended = history.withColumn("__follow", follow).where(F.col("__end_at").isNotNull() & ~F.col("__end_at").eqNullSafe(F.col("__follow")))
            old = old.unionByName(ended.select(*keys, F.col("__end_at").alias("__seq"), F.lit(True).alias("__gone"), *(F.lit(None).cast(feed.schema[c].dataType).alias(c) for c in columns)))
        rows = old.unionByName(rows)
    rows = rows.dropDuplicates([*keys, "__seq", "__gone", *columns])
    w = Window.partitionBy(*keys).orderBy("__seq")
    if ignore_null_updates:
        life = rows.withColumn("__life", F.sum(F.col("__gone").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
        lived = Window.partitionBy(*keys, "__life").orderBy("__seq").rowsBetween(Window.unboundedPreceding, 0)
        rows = life.withColumns({c: F.when(F.col("__gone"), F.col(c)).otherwise(F.last(c, ignorenulls=True).over(lived)) for c in columns}).drop("__life")
    if scd == 1:
        latest = rows.groupBy(*keys).agg(F.max_by(F.struct("__seq", "__gone", *columns), F.struct("__seq", "__gone")).alias("r"))
        return latest.where("NOT r.__gone").select(*keys, F.col("r.__seq").alias(sequence), *(F.col(f"r.{c}").alias(c) for c in columns))
    if scd != 2:
        raise InvalidSpec(f"scd type {scd}")
    rows = rows.withColumn("__hash", F.when(F.col("__gone"), F.lit("gone")).otherwise(row_hash(*(track or columns))))
    chain = collapse_unchanged(rows, keys, [F.col("__seq")], "__hash").withColumn("__end_at", F.lead("__seq").over(w))
    return chain.where("NOT __gone").select(*keys, *columns, F.col("__seq").alias("__start_at"), "__end_at")


def snapshot_changes(before: DataFrame, after: DataFrame, keys: Sequence[str], at: Column, dedupe: str = "off") -> DataFrame:
    """The change feed between two snapshots, with ``_op`` upsert or delete and ``_at`` (INC-10).

    ``dedupe``: "off", "full_row" (equal rows once) or "keys_only" (one row a key: the smallest).
    """
    columns = [c for c in after.columns if c not in keys]

    def single(df: DataFrame) -> DataFrame:
        if dedupe == "full_row":
            return df.distinct()
        if dedupe == "keys_only":
            return df.groupBy(*keys).agg(F.min(F.struct(*columns)).alias("r")).select(*keys, "r.*")
        if dedupe != "off":
            raise InvalidSpec(f"dedupe mode {dedupe!r}")
        return df

    a = single(before).select(*keys, F.struct(*columns).alias("a"))
    b = single(after).select(*keys, F.struct(*columns).alias("b"))
    both = a.join(b, list(keys), "full").where(~F.col("a").eqNullSafe(F.col("b")))
    return both.select(*keys, *(F.col(f"b.{c}").alias(c) for c in columns), F.when(F.col("b").isNull(), "delete").otherwise("upsert").alias("_op"), at.alias("_at"))


def change_points(histories: Mapping[str, DataFrame], key: str, start: str = "valid_from") -> DataFrame:
    """All moments at which any of some histories changes a key, and each history's version then (INC-11)."""
    from .joins import point_in_time_join

    points = None
    for h in histories.values():
        own = h.select(key, F.col(start).alias("changed_at"))
        points = own if points is None else points.unionByName(own)
    if points is None:
        raise InvalidSpec("no histories")
    out = points.distinct()
    for name, h in histories.items():
        own = h.select(key, *(F.col(c).alias(f"{name}_{c}") for c in h.columns if c != key))
        out = point_in_time_join(out, own, [key], "changed_at", f"{name}_{start}", f"{name}_valid_to")
    return out


def with_unknown_member(dim: DataFrame, surrogate: str, values: Mapping[str, object]) -> DataFrame:
    """Adds the member -1 that facts without a dimension row point to (SET-03, INC-12)."""
    row = dim.sparkSession.range(1).select(*((F.lit(-1) if c == surrogate else F.lit(values.get(c))).cast(dim.schema[c].dataType).alias(c) for c in dim.columns))
    return dim.unionByName(row)


def resolve_surrogate(facts: DataFrame, dim: DataFrame, key: str, surrogate: str) -> DataFrame:
    return facts.join(dim.select(key, surrogate), key, "left").withColumn(surrogate, F.coalesce(F.col(surrogate), F.lit(-1)))


def accumulating_snapshot(events: DataFrame, key: str, stage: str, at: str, stages: Sequence[str]) -> DataFrame:
    """One row for each key with the first time of each stage and the seconds between neighbours (INC-13)."""
    firsts = events.groupBy(key).agg(*(F.min(F.when(F.col(stage) == s, F.col(at).cast("timestamp"))).alias(f"{s}_at") for s in stages))
    return firsts.withColumns({f"{a}_to_{b}_seconds": F.unix_timestamp(f"{b}_at") - F.unix_timestamp(f"{a}_at") for a, b in zip(stages, stages[1:], strict=False)})


def periodic_snapshot(events: DataFrame, keys: Sequence[str], at: str, period: str, measures: Mapping[str, Column]) -> DataFrame:
    """One row for each key and period ("day", "week", "month", ...) with events, with additive measures (INC-13)."""
    return events.groupBy(*keys, F.to_date(F.date_trunc(period, at)).alias("period")).agg(*(m.alias(n) for n, m in measures.items()))


def junk_dimension(df: DataFrame, flags: Sequence[str], key: str = "junk_key") -> DataFrame:
    """The combinations of flags that occur, each with a key made from its values, NULLs told apart (INC-13)."""
    return df.select(*flags).distinct().withColumn(key, row_hash(*flags))


def role_view(dim: DataFrame, role: str) -> DataFrame:
    """A dimension under another role: all columns with its prefix, such as ship_ and order_ for dates (INC-13)."""
    return dim.select(*(F.col(c).alias(f"{role}_{c}") for c in dim.columns))


def factless(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """That something happened: the distinct keys of events, without measures (INC-13)."""
    return df.select(*keys).distinct()
