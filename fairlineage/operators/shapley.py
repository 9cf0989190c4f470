"""Shapley values of all games of a table: ``(game_id, owner_id, sv)`` from ``dnf(game_id, term)``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import sets as S
from ..session import cut
from . import dnf as D
from .coefficients import union_states

MOST_PLAYERS = 62  # a coalition of the exhaustive listing is one bigint; the other methods have no such bound
LOW_BITS = 10      # coalitions a single task step lists at once: 2^10
DRAWN = 128        # samples of a game that one task draws together


def weight(n: Column, k: Column) -> Column:
    """1 / (n · C(n−1, k)): the share of the orders in which exactly k given players come first."""
    return 1.0 / (n * S.binomial(n - 1, k))


# --- exhaustive -------------------------------------------------------------------------------


def masked_games(dnf: DataFrame, most: int = MOST_PLAYERS) -> DataFrame:
    """(game_id, owners, n, masks): terms as bit masks over the game's own players.

    More than ``most`` players is an error; the bound also bounds both arrays.
    """
    players = D.variables(dnf)
    counted = D.owner_counts(dnf).withColumn("n", F.when(
        F.col("owners") > most, F.raise_error(F.lit(f"a game has more than {most} players; use another method"))
        .cast("bigint")).otherwise(F.col("owners"))).select("game_id", "n")
    roster = players.join(counted, "game_id").groupBy("game_id", "n").agg(
        F.sort_array(F.collect_list("owner_id")).alias("owners"))
    bits = "aggregate(term, 0L, (m, o) -> m | (1L << (array_position(owners, o) - 1)))"
    return dnf.join(roster, "game_id").select("game_id", "n", "owners", F.expr(bits).alias("mask")).groupBy(
        "game_id", "n", "owners").agg(F.collect_set("mask").alias("masks"))


def coalitions(games: DataFrame) -> DataFrame:
    """One row per game and coalition (bit mask ``coalition``); big games are dealt out over tasks
    by the high bits of the mask before the low bits are listed."""
    high = games.withColumn("_high", F.explode(F.expr(f"sequence(0L, (1L << greatest(n - {LOW_BITS}, 0)) - 1)")))
    dealt = high.repartition("game_id", "_high")
    low = dealt.withColumn("_low", F.explode(F.expr(f"sequence(0L, (1L << least(n, {LOW_BITS})) - 1)")))
    return low.withColumn("coalition", F.expr(f"(_high << {LOW_BITS}) | _low")).drop("_high", "_low")


def is_winning(masks: str = "masks", coalition: str = "coalition") -> Column:
    return F.expr(f"exists({masks}, m -> m & {coalition} = m)")


def utilities(dnf: DataFrame, coalition_sets: DataFrame) -> DataFrame:
    """(game_id, members, value): worth of the given coalitions; equal ones are judged once."""
    asked = coalition_sets.select("game_id", "members").distinct()
    return asked.join(dnf, "game_id", "left").groupBy("game_id", "members").agg(
        F.max(F.coalesce(S.is_subset(F.col("term"), F.col("members")), F.lit(False)).cast("int")).alias("value"))


def exhaustive(dnf: DataFrame, most: int = MOST_PLAYERS) -> DataFrame:
    """Every coalition: winning ones with an owner count for it, winning ones without against it."""
    won = coalitions(masked_games(dnf, most)).where(is_winning())
    sides = won.select("game_id", "n", F.expr("bit_count(coalition)").alias("k"), "coalition",
                       F.posexplode("owners").alias("at", "owner_id"))
    counts = sides.groupBy("game_id", "owner_id", "n", "k", F.expr("(coalition >> at) & 1 = 1").alias("inside")).agg(
        F.count(F.lit(1)).alias("wins"))
    share = F.when(F.col("inside"), weight(F.col("n"), F.col("k") - 1)).otherwise(
        -weight(F.col("n"), F.col("k")))
    return counts.groupBy("game_id", "owner_id").agg(F.sum(F.col("wins") * share).alias("sv"))


# --- sampling ---------------------------------------------------------------------------------


def arrival(game: Column, sample: Column, owner: Column, seed: int, portable: bool) -> Column:
    """When an owner comes in a sampled order: a pseudo-random number of (game, sample, owner).

    ``portable`` uses md5, which other engines compute as well; else the faster xxhash64.
    """
    if portable:
        return F.md5(F.concat_ws("|", game.cast("string"), sample.cast("string"), owner.cast("string"),
                                 F.lit(str(seed))))
    return F.xxhash64(game, sample, owner, F.lit(seed))


def permutation(dnf: DataFrame, sample_size: int | None, seed: int = 0, portable: bool = False) -> DataFrame:
    """Mean marginal worth over sampled orders, reproducible by seed; owners without any are 0.

    The owner who makes a sampled order win is the one on whose arrival the first term is
    complete: the earliest, over terms, of the latest arrival in a term. That needs neither ranks
    nor coalition worths. Terms are dealt by game and block of ``DRAWN`` samples before orders are drawn, so what is
    shuffled is a term per block, never one per sample; the same task draws a block and finds its pivots.
    """
    if not sample_size:
        raise ValueError("the permutation method needs a sample size")
    last = F.lit(int(sample_size))
    blocks = dnf.where(F.size("term") > 0).select("game_id", "term", F.explode(F.sequence(F.lit(1), last, F.lit(DRAWN))).alias("_block"))
    orders = blocks.repartition("game_id", "_block").withColumn(
        "_sample", F.explode(F.sequence(F.col("_block"), F.least(F.col("_block") + F.lit(DRAWN - 1), last))))
    complete = F.array_max(F.transform("term", lambda o: F.struct(
        arrival(F.col("game_id"), F.col("_sample"), o, seed, portable).alias("at"), o.alias("owner_id"))))
    # two numbers per sample are summed in a hash table; a least struct would have every drawn row sorted
    latest = orders.select("game_id", "_block", "_sample", complete.alias("_latest"))
    pivots = latest.groupBy("game_id", "_block", "_sample").agg(F.min_by("_latest.owner_id", "_latest.at").alias("owner_id"))
    counted = pivots.groupBy("game_id", "owner_id").agg(
        (F.count(F.lit(1)) / F.lit(float(sample_size))).alias("sv"))
    return D.variables(dnf).join(counted, ["game_id", "owner_id"], "left").select(
        "game_id", "owner_id", F.coalesce("sv", F.lit(0.0)).alias("sv"))


# --- minimal sets -----------------------------------------------------------------------------


def linear_test(dnf: DataFrame) -> DataFrame:
    """(game_id, linear, large, k, singles): at most one term has more than one member."""
    return dnf.groupBy("game_id").agg(
        F.sum((F.size("term") > 1).cast("bigint")).alias("large"),
        F.max(F.size("term")).cast("bigint").alias("_most"),
        F.sum((F.size("term") <= 1).cast("bigint")).alias("singles"),
    ).select("game_id", (F.col("large") <= 1).alias("linear"), "large",
             F.when(F.col("large") > 0, F.col("_most")).otherwise(0).alias("k"), "singles")


def linear(dnf: DataFrame) -> DataFrame:
    """Closed form for games with at most one term of more than one member."""
    test = linear_test(dnf).where("linear").drop("linear")
    total = F.col("k") + F.col("singles")
    of_large = F.when(F.col("large") == 0, 0.0).otherwise(
        F.col("large") / (total * S.binomial(total - 1, F.col("k") - 1)))
    of_single = F.when(F.col("singles") == 0, 0.0).otherwise((1.0 - F.col("k") * of_large) / F.col("singles"))
    return dnf.join(test, "game_id").select(
        "game_id", F.explode("term").alias("owner_id"),
        F.when(F.size("term") == 1, of_single).otherwise(of_large).alias("sv"))


def from_union_states(states: DataFrame) -> DataFrame:
    """An owner's value is Σ coeff/|members| over the union states it is in."""
    return states.select("game_id", F.explode("members").alias("owner_id"),
                         (F.col("coeff") / F.size("members")).alias("_v")).groupBy("game_id", "owner_id").agg(
        F.sum("_v").alias("sv"))


def union_value(states: DataFrame) -> DataFrame:
    """(game_id, value): Σ coeff/|members|, the inclusion–exclusion sum over all unions."""
    return states.groupBy("game_id").agg(F.sum(F.col("coeff") / F.size("members")).alias("value"))


def combination(dnf: DataFrame) -> DataFrame:
    """Inclusion–exclusion over minimal sets; the union states serve all owners of a game."""
    return from_union_states(union_states(dnf))


def lookup(dnf: DataFrame) -> DataFrame:
    """Grow losing coalitions owner by owner and count the owners who turn them into winning ones.

    Every subset of a losing coalition is losing, so only losing ones are grown further; they
    serve all owners of a game at once. A row is one coalition (a sorted owner set), whatever the number of players;
    whether a newcomer makes it win is looked up among the terms with that newcomer.
    """
    players = D.variables(dnf)
    terms = D.members(dnf).select(
        "game_id", F.col("owner_id").alias("_o"),
        S.difference(F.col("term"), F.array("owner_id")).alias("_rest"), F.col("game_id").alias("_g")).drop("game_id")
    # a game that is TRUE has no losing coalition
    frontier = cut(dnf.groupBy("game_id").agg(F.min(F.size("term")).alias("_least")).where("_least > 0").select(
        "game_id", F.array().cast("array<bigint>").alias("members")))
    levels, size, growing = [], 0, True
    while growing:
        asked = frontier.join(players, "game_id").where(~F.array_contains("members", F.col("owner_id")))
        wins = (F.col("game_id") == F.col("_g")) & (F.col("owner_id") == F.col("_o")) & S.is_subset(
            F.col("_rest"), F.col("members"))
        levels.append(cut(
            asked.join(terms, wins, "left_semi").groupBy("game_id", "owner_id").agg(F.count(F.lit(1)).alias("swings"))
            .withColumn("k", F.lit(size).cast("bigint"))))
        frontier, seen = cut(
            asked.where(F.coalesce(F.array_max("members") < F.col("owner_id"), F.lit(True)))
            .join(terms, wins, "left_anti").select("game_id", F.array_append("members", F.col("owner_id")).alias("members")),
            n=F.count(F.lit(1)))
        growing, size = seen["n"] > 0, size + 1
    counts = reduce(DataFrame.unionByName, levels).join(
        D.owner_counts(dnf).select("game_id", F.col("owners").alias("n")), "game_id")
    return counts.groupBy("game_id", "owner_id").agg(
        F.sum(F.col("swings") * weight(F.col("n"), F.col("k"))).alias("sv"))


def form_choice(dnf: DataFrame) -> DataFrame:
    """(game_id, owner_id, form): ``lookup`` where coalitions are fewer than pairs of terms with and
    without the owner, else ``combination``."""
    per_game = dnf.groupBy("game_id").agg(F.count(F.lit(1)).alias("terms")).join(D.owner_counts(dnf), "game_id")
    with_owner = D.members(dnf).groupBy("game_id", "owner_id").agg(F.count(F.lit(1)).alias("with"))
    without = F.col("terms") - F.col("with")
    pairs = F.when(without == 0, F.col("with")).otherwise(F.col("with") * without)
    return with_owner.join(per_game, "game_id").select(
        "game_id", "owner_id", F.when(F.col("owners") <= pairs, "lookup").otherwise("combination").alias("form"))


def minimal_set_method(dnf: DataFrame) -> DataFrame:
    """The closed form for linear games; for the others the cheaper form, owner by owner."""
    test = linear_test(dnf)
    easy = dnf.join(test.where("linear"), "game_id", "left_semi")
    hard = cut(dnf.join(test.where("not linear"), "game_id", "left_semi").select(*D.KEYS))
    choice, seen = cut(form_choice(hard), lookup=F.count_if(F.col("form") == "lookup"),
                       combination=F.count_if(F.col("form") == "combination"))
    results = [linear(easy)]
    for form, solve in (("lookup", lookup), ("combination", combination)):
        wanted = choice.where(F.col("form") == form)
        if not seen[form]:
            continue
        results.append(solve(hard.join(wanted, "game_id", "left_semi")).join(
            wanted, ["game_id", "owner_id"], "left_semi").select("game_id", "owner_id", "sv"))
    out = results[0]
    for r in results[1:]:
        out = out.unionByName(r)
    return out


# --- totals and dispatch ----------------------------------------------------------------------


def total_by_owner(sv: DataFrame, tuples: DataFrame | None = None) -> DataFrame:
    """(owner_id, sv): sum over games, each as often as ``tuples(game_id, tuples)`` says."""
    if tuples is None:
        return sv.groupBy("owner_id").agg(F.sum("sv").alias("sv"))
    return sv.join(tuples, "game_id").groupBy("owner_id").agg(F.sum(F.col("sv") * F.col("tuples")).alias("sv"))


def attribute(dnf: DataFrame, method: str = "rdsv", sample_size: int | None = None, seed: int = 0,
              ablation: str | None = None) -> DataFrame:
    """Values of all games by ``traditional``, ``permutation``, ``iusv`` or ``rdsv``.

    ``ablation`` (``no-horizontal``, ``no-vertical``, ``no-hybrid``) leaves one kind of split out of
    ``rdsv``; other methods ignore it.
    """
    from .synthesis import recursive_method

    if method in ("traditional", "trad"):
        return exhaustive(dnf)
    if method in ("permutation", "perm"):
        return permutation(dnf, sample_size, seed)
    if method == "iusv":
        return minimal_set_method(dnf)
    if method == "rdsv":
        return recursive_method(dnf, ablation)
    raise ValueError(f"unknown method {method!r}")
