"""Modules of monotone functions: sets of owners that act as one variable.

A set A is a module if every way in which terms meet A goes with every way in which they go on
outside A. ``sets(game_id, members, …)`` holds candidate sets; extra columns travel along.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions import sets as S
from ..session import cut
from . import dnf as D


# --- connected components (OR split) ----------------------------------------------------------


def owner_components(dnf: DataFrame) -> DataFrame:
    """(game_id, owner_id, part): owners linked by common terms share the least owner id of their
    component. A term links its first member with the others, so edges are as many as members.

    Each round points every edge at the least neighbour, from both its ends in turn; the number
    of rounds grows with the logarithm of the component size, not with its diameter.
    """
    links = dnf.select("game_id", F.expr("get(term, 0)").alias("v"), F.explode("term").alias("u"))
    edges, seen = cut(links.where("u <> v").distinct(), n=F.count(F.lit(1)), h=_fingerprint("u", "v"))
    while True:
        after, now = cut(_small_star(_large_star(edges)), n=F.count(F.lit(1)), h=_fingerprint("u", "v"))
        if now == seen:
            break
        edges, seen = after, now
    label = after.select("game_id", F.col("u").alias("owner_id"), F.col("v").alias("part"))
    return D.variables(dnf).join(label, ["game_id", "owner_id"], "left").select(
        "game_id", "owner_id", F.coalesce("part", "owner_id").alias("part"))


def _fingerprint(*columns: str):
    return F.bit_xor(F.xxhash64("game_id", *columns))


def _large_star(edges: DataFrame) -> DataFrame:
    """Connect the larger neighbours of every owner to its least neighbour."""
    both = edges.select("game_id", "u", "v").unionByName(edges.select("game_id", F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("game_id", "u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, ["game_id", "u"]).where("v <> m").select(
        "game_id", F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Connect an owner and its smaller neighbours to the least of them."""
    least = edges.groupBy("game_id", "u").agg(F.min("v").alias("m"))
    moved = edges.join(least, ["game_id", "u"]).where("v <> m").select(
        "game_id", F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("game_id", "u", F.col("m").alias("v"))).distinct()


def or_split(dnf: DataFrame) -> DataFrame:
    """(game_id, part, term): the terms by connected component."""
    parts = owner_components(dnf).select("game_id", F.col("owner_id").alias("_o"), "part")
    first = dnf.where(F.size("term") > 0).withColumn("_o", F.expr("get(term, 0)"))
    return first.join(parts, ["game_id", "_o"]).select("game_id", "part", "term")


# --- twins: the AND and OR parts, bottom-up ---------------------------------------------------


def twins(dnf: DataFrame) -> DataFrame:
    """(game_id, kind, rep, child): owners that can be merged into one.

    ``and``: owners in exactly the same terms. ``or``: owners whose terms are the same but for
    themselves. Equal term sets are recognised by count and a 128-bit hash, summed map-side; ``rep``
    is the least owner of its group and one of its children.
    """
    rest = F.array_remove("term", F.col("owner_id"))
    marks = D.members(dnf).groupBy("game_id", "owner_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.bit_xor(F.xxhash64("term")).alias("a1"), F.bit_xor(F.xxhash64(F.lit(7), "term")).alias("a2"),
        F.bit_xor(F.xxhash64(rest)).alias("o1"), F.bit_xor(F.xxhash64(F.lit(7), rest)).alias("o2"))
    both = marks.select("game_id", "owner_id", "n", F.expr(
        "stack(2, 'and', a1, a2, 'or', o1, o2) as (kind, h1, h2)"))
    key = ["game_id", "kind", "n", "h1", "h2"]
    groups = both.groupBy(*key).agg(F.min("owner_id").alias("rep"), F.count(F.lit(1)).alias("_size")).where("_size > 1")
    return both.join(groups, key).select("game_id", "kind", "rep", F.col("owner_id").alias("child"))


def merge_twins(dnf: DataFrame, groups: DataFrame) -> DataFrame:
    """Keep only ``rep`` of every group: other AND twins leave their terms, terms of other OR twins
    leave the game."""
    gone = groups.where("child <> rep").select("game_id", F.col("child").alias("owner_id"), "kind")
    kept = D.members(dnf).join(gone, ["game_id", "owner_id"], "left").groupBy(*D.KEYS).agg(
        F.sort_array(F.collect_list(F.when(F.col("kind").isNull(), F.col("owner_id")))).alias("_t"),
        F.bool_or(F.coalesce(F.col("kind") == "or", F.lit(False))).alias("_drop"))
    return kept.where("not _drop").select("game_id", F.col("_t").alias("term"))


# --- closure ----------------------------------------------------------------------------------


def meetings(dnf: DataFrame, sets: DataFrame) -> DataFrame:
    """Every term that touches a set, split into ``s`` inside and ``t`` outside of it. They meet by the owners they share."""
    asked = sets.select(*sets.columns, F.explode("members").alias("_o"))
    touching = asked.join(D.members(dnf).withColumnRenamed("owner_id", "_o"), ["game_id", "_o"]).select(
        *sets.columns, "term").distinct()
    return touching.select(
        *sets.columns, "term", S.intersection(F.col("term"), F.col("members")).alias("s"),
        S.difference(F.col("term"), F.col("members")).alias("t"))


def module_test(dnf: DataFrame, sets: DataFrame) -> DataFrame:
    """Add ``is_module``: inside and outside parts form a full grid, by counting alone."""
    keys = sets.columns
    return meetings(dnf, sets).groupBy(*keys).agg(
        (F.count(F.lit(1)) == F.count_distinct("s") * F.count_distinct("t")).alias("is_module"))


def _gaps(met: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, s, at, to): runs of the numbered outside parts that do not occur with an inside part.

    Outside parts of a set are numbered by size; an inside part lacks what its own numbers leave out. That takes as many
    rows as there are terms, not one per pair of parts.
    """
    by_set, by_part = ", ".join(keys), ", ".join([*keys, "s"])
    outside = met.select(*keys, "t").distinct().withColumn(
        "_no", F.expr(f"row_number() over (partition by {by_set} order by size(t), t)"))
    many = outside.groupBy(*keys).agg(F.max("_no").alias("_all"))
    have = met.select(*keys, "s", "t").join(outside, [*keys, "t"]).select(*keys, "s", "_no")
    before = have.withColumn("_prev", F.expr(f"coalesce(lag(_no) over (partition by {by_part} order by _no), 0)"))
    inner = before.where("_no > _prev + 1").select(*keys, "s", (F.col("_prev") + 1).alias("at"), (F.col("_no") - 1).alias("to"))
    tail = have.groupBy(*keys, "s").agg(F.max("_no").alias("_last")).join(many, keys).where("_last < _all").select(
        *keys, "s", (F.col("_last") + 1).alias("at"), F.col("_all").alias("to"))
    return inner.unionByName(tail)


def _fitted(pairs: DataFrame, met: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of ``pairs(keys, s, t, …)`` whose union some touching term fits in; such a term is looked up by its rarest owner."""
    terms = met.select(*keys, "term").distinct()
    spread = terms.select(*keys, "term", F.explode("term").alias("_o"))
    rare = spread.groupBy(*keys, "_o").agg(F.count(F.lit(1)).alias("_n"))
    anchored = spread.join(rare, [*keys, "_o"]).groupBy(*keys, "term").agg(F.min(F.struct("_n", "_o"))["_o"].alias("_o"))
    asked = pairs.withColumn("_o", F.explode(S.union(F.col("s"), F.col("t"))))
    return asked.join(anchored, [*keys, "_o"]).where(S.is_subset(F.col("term"), S.union(F.col("s"), F.col("t")))).select(
        *pairs.columns).distinct()


def culprits(met: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Why a set is no module: the smallest pair (s0, t0) of an inside and an outside part that
    occur, but whose union no touching term fits in. ``met`` as from :func:`meetings`.

    Pairs that do not occur are runs of numbers (:func:`_gaps`). The smallest pair of each run is tried; one that a term fits in
    gives way to the next of its run, and runs whose smallest pair is not below the best found are done. Nearly all
    sets are decided by the first try.
    """
    keys = list(keys)
    outside = met.select(*keys, "t").distinct().withColumn(
        "at", F.expr(f"row_number() over (partition by {', '.join(keys)} order by size(t), t)"))
    rank = F.struct((F.size("s") + F.size("t")).alias("n"), "s", "t")
    runs, best = _gaps(met, keys).join(outside, [*keys, "at"]), None
    while True:
        fits = _fitted(runs.select(*keys, "s", "t"), met, keys).withColumn("_fits", F.lit(True))
        tried, seen = cut(runs.join(fits, [*keys, "s", "t"], "left"), again=F.count_if(F.expr("_fits and at < to")))
        found = tried.where("_fits is null").groupBy(*keys).agg(F.min(rank).alias("_p"))
        best = found if best is None else best.unionByName(found).groupBy(*keys).agg(F.min("_p").alias("_p"))
        if not seen["again"]:
            return best.select(*keys, F.col("_p.s").alias("s0"), F.col("_p.t").alias("t0"))
        best = cut(best)
        going = tried.where("_fits and at < to").select(*keys, "s", (F.col("at") + 1).alias("at"), "to").join(outside, [*keys, "at"])
        runs = cut(going.join(best, keys, "left").where(F.col("_p").isNull() | (rank < F.col("_p"))).drop("_p"))


def closure_step(dnf: DataFrame, sets: DataFrame) -> DataFrame:
    """One step towards the least module around each set. Adds ``is_module``; where that is false,
    ``members`` has grown by the smallest remainder of a touching term."""
    keys = sets.columns
    carried = [k for k in keys if k != "members"]
    met = cut(meetings(dnf, sets))
    tested = met.groupBy(*keys).agg(
        (F.count(F.lit(1)) == F.count_distinct("s") * F.count_distinct("t")).alias("is_module"))
    open_met = met.join(tested.where("not is_module"), keys, "left_semi")
    rest = S.difference(F.col("term"), F.array_union("s0", "t0"))
    grown = (
        open_met.join(culprits(open_met, keys), keys)
        .select(*keys, rest.alias("x")).where(~S.overlaps(F.col("x"), F.col("members")))
        .groupBy(*keys).agg(F.min(F.struct(F.size("x").alias("n"), "x"))["x"].alias("x"))
        .select(*carried, S.union(F.col("members"), F.col("x")).alias("members"), F.lit(False).alias("is_module")))
    return tested.where("is_module").select(*carried, "members", "is_module").unionByName(grown)


def closure(dnf: DataFrame, sets: DataFrame) -> DataFrame:
    """The least module around each set of ``sets(game_id, seed, members)``.

    Finished sets leave the loop; equal working sets of one game are worked on once.
    """
    names = sets.columns
    carried = [k for k in names if k != "members"]
    start = sets.select(*names, F.col("members").alias("_start"))
    asked = cut(start)
    open_, done = asked.select("game_id", "_start", "members").distinct(), None
    while True:
        # sets that grew to the same members go on as one
        step, seen = cut(closure_step(dnf, open_.select("game_id", "members").distinct().withColumn(
            "_was", F.col("members"))), left=F.count_if(~F.col("is_module")))
        after = cut(_advance(open_, step))
        finished = after.where("is_module").drop("is_module")
        done = finished if done is None else done.unionByName(finished)
        if not seen["left"]:
            break
        open_ = after.where("not is_module").drop("is_module")
    result = done.select("game_id", "_start", F.col("members").alias("_end"))
    return asked.join(result, ["game_id", "_start"]).select(*carried, F.col("_end").alias("members"))


def _advance(open_: DataFrame, step: DataFrame) -> DataFrame:
    moved = step.select("game_id", "_was", "members", "is_module")
    return open_.withColumnRenamed("members", "_was").join(moved, ["game_id", "_was"]).select(
        "game_id", "_start", "members", "is_module")


def shares(dnf: DataFrame) -> DataFrame:
    """(game_id, owner_id, other, share): in which part of an owner's terms another owner is, for owners that share a term.

    Owners of one module have equal shares of everybody outside of it, as their inside parts go with all outside parts.
    """
    met = dnf.select("game_id", F.explode("term").alias("owner_id"), "term").select(
        "game_id", "owner_id", F.explode("term").alias("other"))
    counts = met.groupBy("game_id", "owner_id", "other").agg(F.count(F.lit(1)).alias("_n"))
    own = counts.where("owner_id = other").select("game_id", "owner_id", F.col("_n").alias("_all"))
    return counts.where("owner_id <> other").join(own, ["game_id", "owner_id"]).select(
        "game_id", "owner_id", "other", (F.col("_n") / F.col("_all")).alias("share"))


_ARENA = ["game_id", "arena"]
_SPLIT = [*_ARENA, "anchor"]


def _refined(parts: DataFrame, known: DataFrame) -> DataFrame:
    """Split the blocks of ``parts(game_id, arena, anchor, owner_id, block)`` until nobody of an arena has
    different shares with the members of a block he is not in. A block is named by its least owner.

    Equality of shares is decided by two 64-bit hashes; a collision leaves a block too large, which costs seeds only.
    """
    seen = None
    while True:
        others = parts.select(*_SPLIT, F.col("owner_id").alias("other"), F.col("block").alias("_there"))
        signs = parts.join(known, ["game_id", "owner_id"]).join(others, [*_SPLIT, "other"]).where("block <> _there").groupBy(
            *_SPLIT, "owner_id").agg(F.bit_xor(F.xxhash64("other", "share")).alias("_a"),
                                     F.bit_xor(F.xxhash64("share", "other", F.lit(1))).alias("_b"))
        zero = F.lit(0).cast("bigint")
        signed = parts.join(signs, [*_SPLIT, "owner_id"], "left").withColumns(
            {"_a": F.coalesce("_a", zero), "_b": F.coalesce("_b", zero)})
        key = [*_SPLIT, "block", "_a", "_b"]
        named = signed.groupBy(*key).agg(F.min("owner_id").alias("_name"))
        parts, now = cut(signed.join(named, key).select(*_SPLIT, "owner_id", F.col("_name").alias("block")),
                         n=F.count_if(F.col("owner_id") == F.col("block")))
        if now["n"] == seen:
            return parts
        seen = now["n"]


def _named(groups: DataFrame, key: list[str]) -> DataFrame:
    """(game_id, arena, owner_id, size): each set of owners once, whichever ways it was found; named by size and 128 bits."""
    named = groups.groupBy(*key).agg(
        F.count(F.lit(1)).alias("size"), F.bit_xor(F.xxhash64("owner_id")).alias("_a"),
        F.bit_xor(F.xxhash64(F.lit(1), "owner_id")).alias("_b")).where("size > 1")
    return groups.join(named, key).select(
        "game_id", F.concat_ws(":", "size", F.hex("_a"), F.hex("_b")).alias("arena"), "owner_id", "size").distinct()


def module_seeds(dnf: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(game_id, members): pairs of owners, at least one inside each least module of a function without twins.

    Of an arena's two least owners a module has both (they are a seed) or lacks one. What lacks an owner lies in one block of
    the coarsest partition of the others in which nobody tells the members of a foreign block apart by his share of their
    terms; such blocks are the next arenas, all games and blocks at once. Mostly blocks are the modules or fall to
    single owners. An arena that neither owner splits is decided by all its pairs that share a term.
    """
    known = cut(shares(dnf)) if known is None else known
    arenas, seeds = cut(_named(D.variables(dnf), ["game_id"])), None
    while True:
        first = arenas.groupBy(*_ARENA).agg(F.min("owner_id").alias("_p"), F.max("owner_id").alias("_q"), F.max("size").alias("size"))
        here = first.select("game_id", F.array("_p", "_q").alias("members"))
        seeds = here if seeds is None else seeds.unionByName(here)
        anchors = first.where("size > 2").select(*_ARENA, F.explode(F.array("_p", "_q")).alias("anchor"))
        rest = arenas.join(anchors, _ARENA).withColumn("_alone", F.col("owner_id") == F.col("anchor"))
        least = rest.groupBy(*_SPLIT, "_alone").agg(F.min("owner_id").alias("block"))
        parts, begun = cut(rest.join(least, [*_SPLIT, "_alone"]).select(*_SPLIT, "owner_id", "block"), n=F.count(F.lit(1)))
        if not begun["n"]:
            return seeds.distinct()
        blocks = _refined(parts, known)
        sizes = blocks.groupBy(*_SPLIT, "block").agg(F.count(F.lit(1)).alias("_n")).groupBy(*_SPLIT).agg(F.max("_n").alias("_n"))
        whole = cut(sizes.groupBy(*_ARENA).agg(F.min("_n").alias("_n")).join(first, _ARENA).where("_n = size - 1").select(*_ARENA))
        stuck = arenas.join(whole, _ARENA, "left_semi").select(*_ARENA, "owner_id")
        pairs = known.where("owner_id < other").join(stuck, ["game_id", "owner_id"]).join(
            stuck.withColumnRenamed("owner_id", "other"), [*_ARENA, "other"])
        seeds = cut(seeds.unionByName(pairs.select("game_id", F.array("owner_id", "other").alias("members"))).distinct())
        arenas = cut(_named(blocks.join(whole, _ARENA, "left_anti"), [*_SPLIT, "block"]))


def _share_closed(seeds: DataFrame, known: DataFrame, everybody: DataFrame) -> DataFrame:
    """(game_id, members): seeds grown by everybody of whom their members have different shares; only those that do not
    grow to all owners. Modules around a seed have all these owners too, and they are found many at a time."""
    work = cut(seeds.select("game_id", F.col("members").alias("seed"), F.explode("members").alias("owner_id")))
    key, done = ["game_id", "seed"], None
    while True:
        size = work.groupBy(*key).agg(F.count(F.lit(1)).alias("_size"))
        told = work.join(known, ["game_id", "owner_id"]).groupBy(*key, F.col("other").alias("owner_id")).agg(
            F.min("share").alias("_lo"), F.max("share").alias("_hi"), F.count(F.lit(1)).alias("_n"))
        split = told.join(size, key).where("_n < _size or _lo < _hi").select(*key, "owner_id")
        new = split.join(work, [*key, "owner_id"], "left_anti").withColumn("_new", F.lit(True))
        after, seen = cut(work.withColumn("_new", F.lit(False)).unionByName(new), n=F.count_if("_new"))
        rows = after.drop("_new")
        if not seen["n"]:
            break
        # seeds that stopped growing wait; those that grew to everybody go
        grew = after.groupBy(*key).agg(F.bool_or("_new").alias("_on"), F.count(F.lit(1)).alias("_size")).join(
            everybody, "game_id").where("_size < _n").select(*key, "_on")
        state = cut(rows.join(grew, key))
        stopped = state.where("not _on").drop("_on")
        done = stopped if done is None else done.unionByName(stopped)
        work = state.where("_on").drop("_on")
    rows = rows if done is None else done.unionByName(rows)
    return rows.groupBy(*key).agg(F.sort_array(F.collect_list("owner_id")).alias("members")).join(everybody, "game_id").where(
        F.size("members") < F.col("_n")).select("game_id", "members").distinct()


def prime_modules(kernel: DataFrame) -> DataFrame:
    """(game_id, members): the modules to merge next in functions without twins.

    A least module with more than one owner is prime there, so any two of its owners have it as their
    closure. Games without such a module are prime themselves: all their owners form the set.
    """
    everybody = kernel.select("game_id", F.explode("term").alias("o")).groupBy("game_id").agg(
        F.count_distinct("o").alias("_n"))
    everybody = cut(everybody)
    known = cut(shares(kernel))
    grown = cut(_share_closed(module_seeds(kernel, known), known, everybody))
    closed = closure(kernel, grown)
    proper = closed.join(everybody, "game_id").where(F.size("members") < F.col("_n")).select(
        "game_id", F.col("members").alias("term"))
    least = cut(D.absorbed(cut(proper))).withColumnRenamed("term", "members")
    whole = D.variables(kernel).join(least, "game_id", "left_anti").groupBy("game_id").agg(
        F.sort_array(F.collect_list("owner_id")).alias("members"))
    return least.unionByName(whole)


def merge_modules(dnf: DataFrame, modules: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Replace every module by its least owner: (groups, quotients, dnf).

    ``groups(game_id, kind, rep, child)`` with kind ``hybrid``; ``quotients(game_id, rep, term)`` is
    the module's own function.
    """
    place = modules.select("game_id", F.array_min("members").alias("rep"), F.explode("members").alias("owner_id"))
    tagged = D.members(dnf).join(place, ["game_id", "owner_id"], "left")
    quotients = tagged.where("rep is not null").groupBy(*D.KEYS, "rep").agg(
        F.sort_array(F.collect_list("owner_id")).alias("_q")).select("game_id", "rep", F.col("_q").alias("term")).distinct()
    merged = tagged.groupBy(*D.KEYS).agg(
        F.sort_array(F.collect_set(F.coalesce("rep", "owner_id"))).alias("_t")).select(
        "game_id", F.col("_t").alias("term")).distinct()
    groups = place.select("game_id", F.lit("hybrid").alias("kind"), "rep", F.col("owner_id").alias("child"))
    return groups, quotients, merged
