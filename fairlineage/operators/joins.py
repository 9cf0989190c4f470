"""Joins along a declared plan that keep row-level lineage."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, functions as F

from ..plans.registry import JoinPlan, JoinStep
from ..session import cut
from ..sources.tables import ROW_ID, Dataset

OWNERS = "_owners"
_PER_ROW = (ROW_ID, OWNERS)

Resolver = Mapping[str, DataFrame] | Callable[[str], DataFrame]


def _shuffled(right: DataFrame, step: JoinStep) -> DataFrame:
    return right.hint("merge") if step.large else right


def join_along(tables: Resolver, plan: JoinPlan, with_assignment: bool, distinct: bool = False) -> DataFrame:
    """Join the plan's tables in order.

    Right columns that the left side has already get the suffix ``:<table>``; right key columns
    are dropped. With an assignment the left key takes the right key's name (with the suffix, if
    that is taken) and the declared join type counts; without, names stay and every step is an inner join. Duplicate tuples stay unless
    ``distinct`` asks otherwise.
    """
    table = tables if callable(tables) else tables.__getitem__
    left = table(plan.init_table)
    for step in plan.steps:
        right = table(step.table)
        keys = {k: f"_key{i}" for i, k in enumerate(step.right_keys)}
        taken = set(left.columns)
        right = right.select(*[
            F.col(f"`{c}`").alias(keys.get(c, f"{c}:{step.table}" if c in taken else c)) for c in right.columns])
        match = [left[f"`{a}`"] == right[keys[b]] for a, b in zip(step.left_keys, step.right_keys)]
        left = left.join(_shuffled(right, step), match, step.how if with_assignment else "inner").drop(*keys.values())
        if with_assignment:
            names = set(left.columns) - set(step.left_keys)
            left = left.withColumnsRenamed({
                a: f"{b}:{step.table}" if b in names else b for a, b in zip(step.left_keys, step.right_keys)})
    if with_assignment:
        left = left.withColumnsRenamed(
            {c: f"{c}:{plan.init_table}" for c in _PER_ROW if c in left.columns})
    return left.dropDuplicates() if distinct else left


def fold_tail(tables: Mapping[str, DataFrame], plan: JoinPlan) -> tuple[dict[str, DataFrame], JoinPlan]:
    """(tables, plan) of the same tuples: as long as the last step's left keys all come from the table of the step before and
    both join inner, the two tables are joined first. What the earlier steps gathered is then shuffled once, not once per
    step. Columns are told apart as in :func:`join_along`; left keys keep their names.
    """
    ready, steps = dict(tables), list(plan.steps)
    while len(steps) > 1:
        before, last = steps[-2:]
        elsewhere = {c for t in (plan.init_table, *(s.table for s in steps[:-2])) for c in ready[t].columns}
        left, right = ready[before.table], ready[last.table]
        if not (before.how == last.how == "inner" and set(last.left_keys) <= set(left.columns) - elsewhere):
            break
        keys, taken = {k: f"_key{i}" for i, k in enumerate(last.right_keys)}, elsewhere | set(left.columns)
        right = right.select(*[
            F.col(f"`{c}`").alias(keys.get(c, f"{c}:{last.table}" if c in taken else c)) for c in right.columns])
        match = [left[f"`{a}`"] == right[keys[b]] for a, b in zip(last.left_keys, last.right_keys)]
        ready[before.table] = left.join(_shuffled(right, last), match).drop(*keys.values())
        steps.pop()
    return ready, JoinPlan(plan.init_table, tuple(steps))


def per_table_columns(joined: DataFrame, prefix: str = ROW_ID) -> dict[str, str]:
    """table → column, for columns named ``<prefix>:<table>``."""
    return {c.rsplit(":", 1)[1]: c for c in joined.columns if c.startswith(f"{prefix}:")}


def row_ids(joined: DataFrame) -> DataFrame:
    """Only the row ids of a joined tuple; a null row id is an error."""
    return joined.select(*[
        F.when(F.col(f"`{c}`").isNull(), F.raise_error(F.lit(f"null row id in {c}")).cast("bigint"))
        .otherwise(F.col(f"`{c}`")).alias(c)
        for c in per_table_columns(joined).values()])


def melt_row_ids(joined: DataFrame, game_id: str = "game_id") -> DataFrame:
    """(game_id, table, row_id): one row per joined tuple and table."""
    cells = [F.struct(F.lit(t).alias("table"), F.col(f"`{c}`").alias("row_id"))
             for t, c in per_table_columns(joined).items()]
    return joined.select(game_id, F.explode(F.array(*cells)).alias("cell")).select(game_id, "cell.*")


def owner_sets(assignment: DataFrame) -> DataFrame:
    """(table, row_id, owners): owners of a row as a sorted set (as long as the row has copies)."""
    return assignment.groupBy("table", "row_id").agg(
        F.sort_array(F.collect_set("owner_id")).alias("owners"))


def attach_owners(dataset: Dataset) -> dict[str, DataFrame]:
    """Put the owner set of every row beside it *before* the tables are joined.

    Each table is matched once with its own assignment rows; the joins then carry the sets, and
    joined tuples, of which there are far more, need no lookup of their own. A row nobody owns is
    an error. Owners are as many as rows, so they are shuffled, never broadcast.
    """
    ready = {}
    for name, df in dataset.tables.items():
        if OWNERS not in df.columns:
            owned = owner_sets(dataset.assignment.where(F.col("table") == name)).select(
                F.col("row_id").alias("_rid"), F.col("owners").alias(OWNERS))
            df = df.join(owned.hint("merge"), F.col(ROW_ID) == F.col("_rid"), "left").drop("_rid").withColumn(
                OWNERS, F.when(F.col(OWNERS).isNull(),
                               F.raise_error(F.lit(f"a row of {name} has no owner")).cast("array<bigint>"))
                .otherwise(F.col(OWNERS)))
        ready[name] = df
    return ready


HOT_SHARES = 1024  # a row with more than one in so many of all tuples is dealt out; fewer than so many rows can be hot


def row_counts(melted: DataFrame) -> DataFrame:
    """(table, row_id, tuples): how many joined tuples a row is in, counted before the shuffle."""
    return melted.groupBy("table", "row_id").agg(F.count(F.lit(1)).alias("tuples"))


def _known_or_error(matched: DataFrame) -> DataFrame:
    return matched.withColumn("owner_id", F.when(
        F.col("owner_id").isNull(), F.raise_error(F.lit("row id without owner")).cast("bigint")).otherwise(F.col("owner_id")))


def count_owners(melted: DataFrame, assignment: DataFrame, check: bool = True) -> DataFrame:
    """(table, owner_id, tuples): rows are counted first, so owners meet each row once, however many tuples it is in."""
    matched = row_counts(melted).join(assignment.select("table", "row_id", "owner_id"), ["table", "row_id"],
                                      "left" if check else "inner")
    matched = _known_or_error(matched) if check else matched
    return matched.groupBy("table", "owner_id").agg(F.sum("tuples").alias("tuples"))


def lookup_owners(melted: DataFrame, assignment: DataFrame, check: bool = True) -> DataFrame:
    """(game_id, table, owner_id) by an equi join of melted row ids with the assignment.

    With ``check`` a row id the assignment does not know is an error. The tuples of a row of a small
    table would all meet in one task. Rows are therefore counted first; those in more than one in
    ``HOT_SHARES`` of all tuples, which are fewer than ``HOT_SHARES`` and so fit a broadcast, get as many
    copies of their owners as they have such shares, and their tuples are dealt to the copies by game.
    ``melted`` is read twice.
    """
    counts, seen = cut(row_counts(melted), all=F.sum("tuples"))
    share = (seen["all"] or 0) / HOT_SHARES
    hot = F.broadcast(counts.where(F.col("tuples") > share).select(
        "table", "row_id", F.ceil(F.col("tuples") / F.lit(max(share, 1.0))).cast("int").alias("_copies")))
    owned = (
        assignment.select("table", "row_id", "owner_id").join(hot, ["table", "row_id"], "left")
        .select(F.col("table").alias("_t"), F.col("row_id").alias("_r"), "owner_id",
                F.explode(F.sequence(F.lit(0), F.coalesce("_copies", F.lit(1)) - 1)).alias("_c")))
    dealt = melted.join(hot, ["table", "row_id"], "left").select(
        *melted.columns, F.pmod(F.xxhash64("game_id"), F.coalesce("_copies", F.lit(1))).cast("int").alias("_copy"))
    matched = dealt.join(owned, (F.col("table") == F.col("_t")) & (F.col("row_id") == F.col("_r")) & (F.col("_copy") == F.col("_c")),
                         "left" if check else "inner")
    return (_known_or_error(matched) if check else matched).select("game_id", "table", "owner_id")


def unmatched_rows(melted: DataFrame, assignment: DataFrame) -> DataFrame:
    """(table, row_id, tuples): rows of joined tuples that nobody owns, and how many tuples they are in."""
    return row_counts(melted).join(assignment.select("table", "row_id"), ["table", "row_id"], "left_anti")
