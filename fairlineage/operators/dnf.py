"""Monotone boolean functions over owners as tables: ``dnf(game_id, term)``, one row per implicant.

``term`` is a sorted owner set. A game with the empty term is TRUE, a game without rows is FALSE.
Sets to evaluate on come as ``sets(game_id, members)``, one row per game. All games of a table
are handled at once, and a game's rows are never gathered.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import sets as S
from ..session import cut
from .listed import least_terms, solved, split_games

KEYS = ["game_id", "term"]


def from_pairs(imp: DataFrame) -> DataFrame:
    """(game_id, imp_id, owner_id) → (game_id, term); the inverse of :func:`to_pairs`."""
    return imp.groupBy("game_id", "imp_id").agg(F.sort_array(F.collect_set("owner_id")).alias("term")).select(*KEYS)


def to_pairs(dnf: DataFrame) -> DataFrame:
    """One row per member of a term; terms are told apart by their text."""
    return dnf.select("game_id", S.text_of_set(F.col("term")).alias("imp_id"),
                      F.explode("term").alias("owner_id"))


def members(dnf: DataFrame) -> DataFrame:
    return dnf.select("game_id", "term", F.explode("term").alias("owner_id"))


def variables(dnf: DataFrame) -> DataFrame:
    """The players of every game."""
    return dnf.select("game_id", F.explode("term").alias("owner_id")).distinct()


def owner_counts(dnf: DataFrame) -> DataFrame:
    """(game_id, owners): the number of players."""
    return variables(dnf).groupBy("game_id").agg(F.count(F.lit(1)).alias("owners"))


def minimal_sets(dnf: DataFrame, condition: Column | None = None) -> DataFrame:
    """The terms as owner sets, optionally only some of them."""
    return dnf if condition is None else dnf.where(condition)


# --- constants and tests ----------------------------------------------------------------------


def constant_true(games: DataFrame) -> DataFrame:
    return games.select("game_id", F.array().cast("array<bigint>").alias("term"))


def constant_false(games: DataFrame) -> DataFrame:
    return constant_true(games).where(F.lit(False))


def single_variable(owned: DataFrame) -> DataFrame:
    """(game_id, owner_id) → the function that is this one owner."""
    return owned.select("game_id", F.array(F.col("owner_id").cast("bigint")).alias("term"))


def kinds(dnf: DataFrame, games: DataFrame) -> DataFrame:
    """(game_id, is_true, is_false, is_variable) for every game of ``games``."""
    shape = dnf.groupBy("game_id").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.size("term")).alias("least"), F.max(F.size("term")).alias("most"))
    return games.select("game_id").distinct().join(shape, "game_id", "left").select(
        "game_id",
        F.coalesce(F.col("least") == 0, F.lit(False)).alias("is_true"),
        F.col("n").isNull().alias("is_false"),
        F.coalesce((F.col("n") == 1) & (F.col("most") == 1), F.lit(False)).alias("is_variable"))


# --- absorption -------------------------------------------------------------------------------


def minimise(dnf: DataFrame) -> DataFrame:
    """Drop every term that has a proper subset among the terms of its game.

    The distinct terms are written once, so that what they come from is worked out once. Games of few owners are then
    worked out row by row, the others by :func:`absorbed`.
    """
    terms = cut(dnf.select(*KEYS).dropDuplicates(KEYS))
    games, rest = split_games(terms)
    least = solved(games, least_terms).select("game_id", F.col("members").alias("term"))
    return least if rest is None else least.unionByName(absorbed(rest))


def absorbed(dnf: DataFrame) -> DataFrame:
    """:func:`minimise` of games of any size; ``dnf`` is read several times."""
    dnf = dnf.dropDuplicates(KEYS)
    least = dnf.groupBy("game_id").agg(F.min(F.size("term")).alias("_least"), F.max(F.size("term")).alias("_most"))
    mixed = least.where("_least < _most")  # terms of one size never absorb each other
    wide = dnf.join(mixed, "game_id").where(F.size("term") > F.col("_least"))
    return dnf.join(_has_subset(wide, dnf), KEYS, "left_anti")


def _has_subset(wide: DataFrame, dnf: DataFrame) -> DataFrame:
    """Terms of ``wide`` with a proper subset: it lies wholly inside, so also its rarest owner does; look it up by that."""
    true_game = wide.where("_least = 0").select(*KEYS)
    wide = wide.where("_least > 0").select(*KEYS)
    pairs = members(dnf.join(wide.select("game_id").distinct(), "game_id", "left_semi"))
    spread = pairs.groupBy("game_id", "owner_id").agg(F.count(F.lit(1)).alias("_n"))
    anchored = pairs.join(spread, ["game_id", "owner_id"]).groupBy(*KEYS).agg(
        F.min(F.struct("_n", "owner_id"))["owner_id"].alias("_anchor"))
    small = anchored.select(F.col("game_id").alias("_g"), F.col("term").alias("_t"), "_anchor")
    hits = members(wide).join(
        small, (F.col("game_id") == F.col("_g")) & (F.col("owner_id") == F.col("_anchor"))
        & (F.size("_t") < F.size("term")) & (F.size(F.array_except("_t", "term")) == 0), "left_semi")
    return hits.select(*KEYS).unionByName(true_game).distinct()


# --- evaluation and restriction ---------------------------------------------------------------


def _with_sets(dnf: DataFrame, sets: DataFrame) -> DataFrame:
    return dnf.join(sets.select("game_id", "members"), "game_id")


def evaluate(dnf: DataFrame, sets: DataFrame, value: bool = True) -> DataFrame:
    """(game_id, result). ``value=True``: only the members are 1; ``False``: only they are 0."""
    inside = S.is_subset(F.col("term"), F.col("members")) if value else ~S.overlaps(
        F.col("term"), F.col("members"))
    return sets.select("game_id", "members").join(dnf, "game_id", "left").groupBy("game_id").agg(
        F.bool_or(F.coalesce(inside, F.lit(False))).alias("result"))


def partial_eval(dnf: DataFrame, sets: DataFrame, value: bool) -> DataFrame:
    """Fix the members to 1 (drop them from the terms) or to 0 (drop the terms they are in)."""
    both = _with_sets(dnf, sets)
    if not value:
        return both.where(~S.overlaps(F.col("term"), F.col("members"))).select(*KEYS)
    return minimise(both.select("game_id", S.difference(F.col("term"), F.col("members")).alias("term")))


def partial_eval_complement(dnf: DataFrame, sets: DataFrame, value: bool) -> DataFrame:
    """Fix everybody but the members to 1 or to 0."""
    both = _with_sets(dnf, sets)
    if not value:
        return both.where(S.is_subset(F.col("term"), F.col("members"))).select(*KEYS)
    return minimise(both.select("game_id", S.intersection(F.col("term"), F.col("members")).alias("term")))


def touching(dnf: DataFrame, sets: DataFrame) -> DataFrame:
    """Terms with at least one member of the set."""
    return _with_sets(dnf, sets).where(S.overlaps(F.col("term"), F.col("members"))).select(*KEYS)


def not_touching(dnf: DataFrame, sets: DataFrame) -> DataFrame:
    return _with_sets(dnf, sets).where(~S.overlaps(F.col("term"), F.col("members"))).select(*KEYS)


def contraction(dnf: DataFrame, sets: DataFrame) -> DataFrame:
    """The sub-function that lives on the set: touching terms, cut down to the set."""
    return partial_eval_complement(touching(dnf, sets), sets, True)


# --- algebra ----------------------------------------------------------------------------------


def conjunction(a: DataFrame, b: DataFrame) -> DataFrame:
    """AND, game by game: the unions of a term of one with a term of the other."""
    other = b.select("game_id", F.col("term").alias("_other"))
    return minimise(a.join(other, "game_id").select(
        "game_id", S.union(F.col("term"), F.col("_other")).alias("term")))


def disjunction(*functions: DataFrame) -> DataFrame:
    """OR, game by game."""
    return minimise(reduce(DataFrame.unionByName, [f.select(*KEYS) for f in functions]))


def rename_variables(dnf: DataFrame, mapping: DataFrame) -> DataFrame:
    """Replace owners by ``mapping(game_id, owner_id, new_id)``; equal images fall together.

    Owners without a mapping keep their id.
    """
    true_terms = dnf.where(F.size("term") == 0)
    renamed = members(dnf).join(mapping, ["game_id", "owner_id"], "left").groupBy(*KEYS).agg(
        F.sort_array(F.collect_set(F.coalesce("new_id", "owner_id"))).alias("_new"))
    return renamed.select("game_id", F.col("_new").alias("term")).unionByName(true_terms).distinct()


def expand_clauses(clauses: DataFrame, column: str = "clauses") -> DataFrame:
    """AND of ORs → terms: pick one owner of every clause. ``clauses(game_id, clauses)``.

    There are as many rounds as the longest list has clauses. A pick that hits the next
    clause already needs no further owner: anything larger would be absorbed. An empty clause
    makes the game FALSE; no clause at all gives no rows.
    """
    clauses, seen = cut(clauses.select("game_id", column), most=F.max(F.size(column)))
    grown = clauses.where(F.size(column) > 0).select(
        "game_id", F.col(column).alias("_c"), F.array().cast("array<bigint>").alias("term"))
    for i in range(seen["most"] or 0):
        grown = grown.select("game_id", "_c", F.explode(F.expr(
            f"""case when size(_c) <= {i} then array(term)
                     when arrays_overlap(term, get(_c, {i})) then array(term)
                     else transform(get(_c, {i}), o -> sort_array(array_append(term, o))) end""")).alias("term"))
    return minimise(grown.select(*KEYS))


def text_form(dnf: DataFrame) -> DataFrame:
    """(game_id, text) like ``1 + 2 3``; for reading and for tests, one cell per game."""
    return dnf.groupBy("game_id").agg(S.text_of_family(F.collect_set("term")).alias("text"))
