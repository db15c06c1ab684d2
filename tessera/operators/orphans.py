"""References to records that are missing, removed or late.

References are counted per target key and period before anything is joined, so that a key with very many references travels as a few rows.
The counts of heavy keys are held against a broadcast of bounded size, all others against the target tables by a shuffle join, and both
orphan counts are united. For the single orphans, only keys with something amiss go back to the references, in the same two ways.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.sources.scratch import Scratch
from tessera.sources.tables import current_rows, key_of

#: A key with more than one in so many references is heavy; there are at most so many of them, which bounds the broadcast.
HEAVY_SHARE = 1000


@dataclass(frozen=True)
class Table:
    """A table with its key and the references it makes: (field, target table)."""

    name: str
    key: str
    refers: Sequence[tuple[str, str]] = ()


def _facts(rows: DataFrame, table: Table, removals: DataFrame) -> DataFrame:
    """(k, latest, first, removed, fields...) of the current rows of a table."""
    fields = [key_of(f).alias(f"r{i}") for i, (f, _) in enumerate(table.refers)]
    current = current_rows(rows, table.key, fields, arrival="first").withColumnsRenamed({table.key: "k", "ingested_at": "latest"})
    gone = removals.where(F.col("table_name") == table.name).select(key_of("record_key").alias("g_k"), "removed_at").where("g_k is not null").groupBy("g_k").agg(F.max("removed_at").alias("removed_at"))
    joined = current.join(gone, F.col("k") == F.col("g_k"), "left")
    removed = F.coalesce(F.col("removed_at") >= F.col("latest"), F.lit(False)).alias("removed")
    return joined.select("k", "latest", "first", removed, *[f"r{i}" for i in range(len(fields))])


def _gathered(tables: Sequence[tuple[Table, DataFrame]], removals: DataFrame, scratch: Scratch) -> tuple[DataFrame, dict[str, DataFrame], int]:
    """(references of current rows that aren't removed, facts of every table, the most references there can be)."""
    facts = {t.name: scratch.keep(_facts(rows, t, removals), t.name) for t, rows in tables}
    parts = []
    for t, _ in tables:
        if t.refers:
            made = F.array(*[F.struct(F.lit(f).alias("field_name"), F.lit(target).alias("target_table"), F.col(f"r{i}").alias("target_key")) for i, (f, target) in enumerate(t.refers)])
            made = F.filter(made, lambda r: r["target_key"].isNotNull())
            parts.append(facts[t.name].where("not removed").select(F.lit(t.name).alias("table_name"), F.col("k").alias("record_key"), F.col("latest").alias("referred_at"), F.inline(made)))
    refs = parts[0]
    for p in parts[1:]:
        refs = refs.unionByName(p)
    return refs, facts, sum(facts[t.name].count() * len(t.refers) for t, _ in tables)


def _targets(tables: Sequence[tuple[Table, DataFrame]], facts: dict[str, DataFrame]) -> DataFrame:
    """(t_table, t_key, arrival, gone) of all tables that are referred to."""
    out = None
    for name in dict.fromkeys(target for t, _ in tables for _, target in t.refers):
        there = facts[name].select(F.lit(name).alias("t_table"), F.col("k").alias("t_key"), F.col("first").alias("arrival"), F.col("removed").alias("gone"))
        out = there if out is None else out.unionByName(there)
    return out


def orphan_counts(tables: Sequence[tuple[Table, DataFrame]], removals: DataFrame) -> DataFrame:
    """(table_name, field_name, reason, month, orphans): the orphans that ``orphans`` lists, counted per month of the referring row.

    All follows from counts per key and month with the first and last use in it, except where the target arrived between these two: of such
    groups, at most one a key and field, the single references are looked at. A reference whose row has no time has a null month.
    """
    scratch = Scratch(removals.sparkSession, "counts")
    refs, facts, total = _gathered(tables, removals, scratch)
    group = ["table_name", "field_name", "target_table", "target_key", "month"]
    refs = refs.withColumn("month", F.date_format("referred_at", "yyyy-MM"))
    counted = scratch.keep(refs.groupBy(*group).agg(F.count("*").alias("n"), F.min("referred_at").alias("first_use"), F.max("referred_at").alias("last_use")), "counted")
    targets = _targets(tables, facts)
    on = (F.col("target_table") == F.col("t_table")) & (F.col("target_key") == F.col("t_key"))
    limit = max(1, total // HEAVY_SHARE)
    heavy = scratch.keep(counted.groupBy("target_table", "target_key").agg(F.sum("n").alias("uses")).where(F.col("uses") > limit), "heavy")
    names = F.broadcast(heavy.select(F.col("target_table").alias("h_table"), F.col("target_key").alias("h_key")))  # at most HEAVY_SHARE keys
    of_heavy = targets.join(names, (F.col("t_table") == F.col("h_table")) & (F.col("t_key") == F.col("h_key")), "left_semi")
    mine = (F.col("target_table") == F.col("h_table")) & (F.col("target_key") == F.col("h_key"))
    held = counted.join(names, mine, "left_semi").join(F.broadcast(of_heavy), on, "left")
    held = held.unionByName(counted.join(names, mine, "left_anti").join(targets, on, "left"))
    whole = F.when(F.col("t_key").isNull(), "missing").when(F.col("gone"), "removed").when(F.col("arrival") > F.col("last_use"), "late")
    held = scratch.keep(held.withColumn("reason", whole).where("reason is not null or arrival > first_use"), "held")
    split = held.where("reason is null").select(*[F.col(g).alias(f"s_{g}") for g in group], "arrival")
    same = F.lit(True)
    for g in group:
        same = same & (F.col(g) == F.col(f"s_{g}"))
    late = refs.join(split, same).where("arrival > referred_at").groupBy("table_name", "field_name", "month").agg(F.count("*").alias("orphans")).withColumn("reason", F.lit("late"))
    counts = held.where("reason is not null").groupBy("table_name", "field_name", "reason", "month").agg(F.sum("n").alias("orphans"))
    return counts.unionByName(late).groupBy("table_name", "field_name", "reason", "month").agg(F.sum("orphans").alias("orphans"))


def orphans(tables: Sequence[tuple[Table, DataFrame]], removals: DataFrame) -> DataFrame:
    """Every reference of a current, not removed row whose target is amiss, one row each.

    Result: table_name, field_name, record_key (of the referring row), target_table, target_key, referred_at (its ingested_at), reason:
    ``missing`` (the target has no row), ``removed`` (removals names it at or after its latest row) or ``late`` (its first row came after
    the referring row), the first that holds. A null or blank reference refers to nothing; keys are compared trimmed. Referring rows
    without a key are no records. A target whose time of arrival is null isn't late. Empty tables give an empty result.
    """
    scratch = Scratch(removals.sparkSession, "orphans")
    refs, facts, total = _gathered(tables, removals, scratch)
    counted = refs.groupBy("target_table", "target_key").agg(F.count("*").alias("n"), F.min("referred_at").alias("first_use"))
    held = counted.join(_targets(tables, facts), (F.col("target_table") == F.col("t_table")) & (F.col("target_key") == F.col("t_key")), "left")
    suspects = held.where("t_key is null or gone or arrival > first_use").select("target_table", "target_key", "n", F.col("t_key").isNull().alias("missing"), F.coalesce("gone", F.lit(False)).alias("gone"), "arrival")
    suspects = scratch.keep(suspects, "suspects")
    limit = max(1, total // HEAVY_SHARE)
    suspects = suspects.withColumnsRenamed({"target_table": "s_table", "target_key": "s_key"})
    on = (F.col("target_table") == F.col("s_table")) & (F.col("target_key") == F.col("s_key"))
    heavy = F.broadcast(suspects.where(F.col("n") > limit))
    found = refs.join(heavy, on).unionByName(refs.join(suspects.where(F.col("n") <= limit), on))
    reason = F.when(F.col("missing"), "missing").when(F.col("gone"), "removed").when(F.col("arrival") > F.col("referred_at"), "late")
    return found.select("table_name", "field_name", "record_key", "target_table", "target_key", "referred_at", reason.alias("reason")).where("reason is not null")
