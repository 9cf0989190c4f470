"""From joined tuples to games.

A tuple exists if *every* joined row is supplied by *some* owner: an AND over tables of ORs over
owners. Its dual, an OR of ANDs, has the clauses themselves as terms, and a game and its dual have
the same Shapley values; so a tuple's game is solved on its clauses and never multiplied out.
Besides, owners matter only by the role they play: games that differ in names alone share one
*shape*, which is solved once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import sets as S
from ..plans.registry import JoinPlan, plan_for
from ..sources.tables import Dataset
from . import dnf as D
from .joins import OWNERS, attach_owners, fold_tail, join_along, per_table_columns


def lineage(dataset: Dataset, plan: JoinPlan | None = None, texts: bool = False) -> DataFrame:
    """One row per joined tuple with the owner set of every table's row (``_owners:<table>``).

    The joins carry sets as texts, which shuffle in half the bytes; with ``texts`` they stay texts (members by blanks).
    """
    plan = plan or plan_for(dataset.name)
    keys = {k for s in plan.steps for k in (*s.left_keys, *s.right_keys)}
    narrow = {
        t: df.select(*[f"`{c}`" for c in df.columns if c in keys], F.array_join(F.col(OWNERS), " ").alias(OWNERS))
        for t, df in attach_owners(dataset).items()}
    joined = join_along(*fold_tail(narrow, plan), with_assignment=True)
    columns = per_table_columns(joined, OWNERS).values()
    return joined.select(*[F.col(f"`{c}`") if texts else _set_of(F.col(f"`{c}`")).alias(c) for c in columns])


def _set_of(text: Column) -> Column:
    return F.when(text == "", F.array().cast("array<bigint>")).otherwise(F.split(text, " ").cast("array<bigint>"))


def owner_families(lineage: DataFrame) -> DataFrame:
    """The distinct owner sets of a joined tuple, tables forgotten: one cell per tuple. Sets given as texts stay texts."""
    columns = per_table_columns(lineage, OWNERS).values()
    return lineage.select(S.family([F.col(f"`{c}`") for c in columns]).alias("family"))


def _as_sets(families: DataFrame) -> DataFrame:
    """``family`` as sets of numbers, whether given as these or as texts."""
    if families.schema["family"].dataType.simpleString() != "array<string>":
        return families
    return families.withColumn("family", F.transform("family", _set_of))


def counted_families(lineage: DataFrame) -> DataFrame:
    """(family, n): distinct families of owner sets and how many tuples have each; texts are read once per family."""
    return _as_sets(owner_families(lineage).groupBy("family").agg(F.count(F.lit(1)).alias("n")))


def tuple_games(lineage: DataFrame) -> DataFrame:
    """(clauses, tuples): distinct games of the joined tuples and how many tuples share each.

    Tuples are counted by their families first (map-side, cheap functions only), then by their
    absorbed clauses. A tuple with an ownerless row is FALSE and gives no game.
    """
    clauses = counted_families(lineage).select(S.by_size(S.absorb(F.col("family"))).alias("clauses"), "n")
    return _satisfiable(clauses.groupBy("clauses").agg(F.sum("n").alias("tuples")))


def _satisfiable(games: DataFrame) -> DataFrame:
    return games.where(F.size("clauses") > 0).where(F.size(F.element_at("clauses", 1)) > 0)


def name_games(games: DataFrame) -> DataFrame:
    """Add the canonical text of the clauses as ``game_id``."""
    return games.withColumn("game_id", S.text_of_family(F.col("clauses")))


def dual_terms(games: DataFrame) -> DataFrame:
    """(game_id, term) of the dual game: its terms are the clauses."""
    return games.select("game_id", F.explode("clauses").alias("term"))


def tuple_shapes(lineage: DataFrame, count_first: bool = False) -> DataFrame:
    """(game_id, place, owner_id, tuples): how many tuples put an owner at a place of a shape.

    ``game_id`` is the text of the shape. The result is as long as shapes × places × owners,
    whatever the number of tuples, and it is reached without shuffling tuples: each one becomes
    (shape, place, owner) rows that are summed map-side. With ``count_first`` equal games are
    counted before, which pays where few owners make many tuples alike.
    """
    if count_first:
        games = tuple_games(lineage)
    else:
        games = _satisfiable(_as_sets(owner_families(lineage)).select(
            S.by_size(S.absorb(F.col("family"))).alias("clauses"), F.lit(1).cast("bigint").alias("tuples")))
    return game_shapes(games)


def game_shapes(games: DataFrame) -> DataFrame:
    """Shapes of ``games(clauses, tuples)``, see :func:`tuple_shapes`."""
    ranked = games.select(
        "tuples", S.let(F.col("clauses"), lambda fam: S.let(S.owners_by_role(fam), lambda owners: F.struct(
            S.text_of_family(S.relabel(fam, owners)).alias("game_id"), owners.alias("owners")))).alias("shape"))
    return (
        ranked.select("tuples", "shape.game_id", F.posexplode("shape.owners").alias("at", "owner_id"))
        .groupBy("game_id", (F.col("at") + 1).cast("bigint").alias("place"), "owner_id")
        .agg(F.sum("tuples").alias("tuples")))


def shape_terms(shapes: DataFrame) -> DataFrame:
    """(game_id, term) of the distinct shapes, owners being places."""
    return shapes.select("game_id").distinct().select(
        "game_id", F.explode(S.family_of_text(F.col("game_id"))).alias("term"))


def group_games(rows: DataFrame, group: str | Column, owner_columns: Sequence[str],
                wrap_u32: bool = False) -> DataFrame:
    """(game_id, term): one game per group, one term per distinct set of owner cells in a row."""
    key = F.col(f"`{group}`") if isinstance(group, str) else group
    cells = [F.col(f"`{c}`") for c in owner_columns]
    return D.minimise(rows.select(key.alias("game_id"), S.owner_set(*cells, wrap_u32=wrap_u32).alias("term")))


def grouped_lists(rows: DataFrame, group: str, owner_columns: Sequence[str]) -> DataFrame:
    """(game_id, members, copies): the member rows of a group as distinct structs of their owner
    cells with how often each occurs, ordered by nothing; one row per distinct member.

    A list column per group would hold a whole group in one cell; rows hold the same content.
    """
    cells = [F.col(f"`{c}`") for c in owner_columns]
    return rows.groupBy(F.col(f"`{group}`").alias("game_id"), F.array(*cells).alias("members")).agg(
        F.count(F.lit(1)).alias("copies"))


def columns_containing(df: DataFrame, part: str) -> list[str]:
    return [c for c in df.columns if part in c]


# --- the match data set -----------------------------------------------------------------------


def with_winner(matches: DataFrame, home_score: str, away_score: str, home_name: str, away_name: str,
                column: str = "winner", draw: str = "DRAW") -> DataFrame:
    """Name of the side with the higher score; a missing score is below every number, two missing
    scores are a draw; a winning side without a name is an error."""
    low = F.lit(-(1 << 63)).cast("bigint")
    home, away = F.coalesce(F.col(f"`{home_score}`"), low), F.coalesce(F.col(f"`{away_score}`"), low)

    def name_of(c: str) -> Column:
        return F.coalesce(F.col(f"`{c}`"), F.raise_error(F.lit("winning side has no name")).cast("string"))

    return matches.withColumn(
        column, F.when(home > away, name_of(home_name)).when(home < away, name_of(away_name)).otherwise(draw))


def match_games(dataset: Dataset, plan: JoinPlan | None = None, season: str = "2015/2016",
                owner_part: str = "api_id") -> DataFrame:
    """One game per winning team of a season; every column with ``owner_part`` in its name is an
    owner column. The season filter is a plain predicate and reaches the scan."""
    joined = join_along(dataset.tables, plan or plan_for(dataset.name), with_assignment=False)
    won = with_winner(joined, "home_team_goal", "away_team_goal", "team_long_name", "team_long_name:AwayTeam")
    played = won.where((F.col("season") == season) & (F.col("winner") != "DRAW"))
    return group_games(played, "winner", columns_containing(joined, owner_part))


def games_of(dataset: Dataset, plan: JoinPlan | None = None) -> DataFrame:
    """(game_id, term, tuples): tuple games (dual terms) with an assignment, group games without."""
    if not dataset.has_assignment:
        return match_games(dataset, plan).withColumn("tuples", F.lit(1).cast("bigint"))
    return name_games(tuple_games(lineage(dataset, plan, texts=True))).select(
        "game_id", F.explode("clauses").alias("term"), "tuples")

