"""Values by recursive modular decomposition.

Games are taken apart bottom-up, all at once: owners that can act as one are merged round by
round (AND twins, OR twins, then prime modules) until one variable is left per game. A round is a
:class:`Step`. Values are then computed as functions of t at quadrature nodes: bottom-up the value
of every merged element, top-down its derivative, whose integral is the Shapley value.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import sets as S
from ..functions.quadrature import nodes_for
from ..session import cut
from . import dnf as D
from .coefficients import union_states
from .listed import LISTED, split_games
from .listed_trees import GATHERED, GROUPS, TERM, trees, values as listed_values
from .modules import merge_modules, merge_twins, prime_modules, twins

ABLATIONS = {"no-horizontal": "or", "no-vertical": "and", "no-hybrid": "hybrid"}


SEARCH_ABOVE = 12  # so many terms or owners have at most 2^12 unions: cheaper to solve than to split


@dataclass
class Step:
    """One round of merging: ``groups(game_id, kind, rep, child, born)`` and, for hybrid groups,
    their own functions ``quotients(game_id, rep, term)``. After the round ``rep`` stands for the
    group; ``born`` is the round that made the child, null for an owner."""

    groups: DataFrame
    quotients: DataFrame | None = None


@dataclass
class Decomposition:
    """Games and how they come apart. With ``names(game_id, shape, place, owner_id)`` the steps are those of ``shapes``, the
    games' shapes over places, and ``names`` puts the owners back. ``rows`` has the steps of games of few owners as
    :func:`.listed_trees.trees` gives them; ``wide`` says whether there are other games."""

    dnf: DataFrame
    steps: list[Step]
    shapes: DataFrame | None = None
    names: DataFrame | None = None
    rows: DataFrame | None = None
    wide: bool = True

    @property
    def apart(self) -> DataFrame:
        """The functions that the steps take apart."""
        return self.dnf if self.shapes is None else self.shapes

    def by_owner(self, found: DataFrame) -> DataFrame:
        """``found(game_id, owner_id, …)`` of the functions taken apart, for every game that has them."""
        if self.names is None:
            return found
        return self.names.join(found.withColumnsRenamed({"game_id": "shape", "owner_id": "place"}), ["shape", "place"]).drop("shape", "place")


def _with_born(groups: DataFrame, made: DataFrame | None) -> DataFrame:
    """Add the round that made each child; ``made(game_id, child, born)`` holds the elements made so far."""
    if made is None:
        return groups.withColumn("born", F.lit(None).cast("int"))
    return groups.join(made, ["game_id", "child"], "left").select("game_id", "kind", "rep", "child", "born")


def _made(groups: DataFrame, made: DataFrame | None, round_: int) -> DataFrame:
    """``made`` after a round: its groups' elements replace earlier ones of the same name."""
    new = groups.where("child = rep").select("game_id", F.col("rep").alias("child"), F.lit(round_).alias("born"))
    return cut(new if made is None else made.join(new, ["game_id", "child"], "left_anti").unionByName(new))


def decompose(dnf: DataFrame, search_above: int = 0) -> Decomposition:
    """Take minimised games that are neither TRUE nor FALSE apart until one element is left.

    Twin-free rests (kernels) with at most ``search_above`` terms or elements are not searched for
    modules but taken as one function of their elements; values do not change by that. Games of few owners come apart row
    by row, the others round by round, all at once.
    """
    source = cut(dnf.where(F.size("term") > 0).select(*D.KEYS))
    steps, rows, wide = _come_apart(*split_games(source), search_above)
    return Decomposition(source, steps, rows=rows, wide=wide)


def _come_apart(games: DataFrame, rest: DataFrame | None, search_above: int) -> tuple[list[Step], DataFrame, bool]:
    """(steps, rows, wide) of ``games(game_id, terms)`` of few owners and the terms of the others."""
    shift = f"transform(filter(groups, g -> g.kind = '{TERM}'), g -> 1 << g.step)"
    rows, seen = cut(trees(games, search_above), last=F.max(F.expr("array_max(groups.step)")),
                     prime=F.bit_or(F.expr(f"aggregate({shift}, 0, (a, b) -> a | b)")))
    steps = []
    for i in range((seen["last"] if seen["last"] is not None else -1) + 1):
        here = rows.select("game_id", F.expr(f"inline(filter(groups, g -> g.step = {i}))"))
        steps.append(Step(
            here.where(F.col("kind") != TERM).select("game_id", "kind", "rep", "child", "born"),
            here.where(F.col("kind") == TERM).select("game_id", "rep", "term") if (seen["prime"] >> i) & 1 else None))
    if rest is None:
        return steps, rows, False
    wide = _rounds(cut(rest), search_above)
    for i, step in enumerate(wide):
        if i == len(steps):
            steps.append(step)
            continue
        few, parts = steps[i], [q for q in (steps[i].quotients, step.quotients) if q is not None]
        steps[i] = Step(few.groups.unionByName(step.groups), parts[0].unionByName(parts[1]) if len(parts) > 1 else (parts or [None])[0])
    return steps, rows, True


def _rounds(source: DataFrame, search_above: int) -> list[Step]:
    """The steps of games of any number of owners, all at once."""
    games, rows = source.agg(F.count_distinct("game_id"), F.count(F.lit(1))).first()
    size = {"rows": F.count(F.lit(1)), "widest": F.max(F.size("term"))}
    work, steps, made = source, [], None
    while rows:
        groups, found = cut(_with_born(twins(work), made), n=F.count(F.lit(1)))
        if found["n"]:
            made = _made(groups, made, len(steps))
            steps.append(Step(groups))
            work, now = cut(merge_twins(work, groups), **size)
            if now["rows"] == games and now["widest"] == 1:
                break
            continue
        left = D.members(work).groupBy("game_id").agg(
            F.least(F.count_distinct("term"), F.count_distinct("owner_id")).alias("_n"),
            F.count_distinct("owner_id").alias("_o")).where("_o > 1").drop("_o")
        kernel, found = cut(work.join(left, "game_id"), n=F.count(F.lit(1)), most=F.max("_n"))
        if not found["n"]:
            break
        small = kernel.where(F.col("_n") <= search_above)
        modules = D.variables(small).groupBy("game_id").agg(F.sort_array(F.collect_list("owner_id")).alias("members"))
        if found["most"] > search_above:
            modules = modules.unionByName(prime_modules(cut(kernel.where(F.col("_n") > search_above).select(*D.KEYS))))
        groups, quotients, work = merge_modules(kernel.select(*D.KEYS), cut(modules))
        groups = cut(_with_born(groups, made))
        made = _made(groups, made, len(steps))
        steps.append(Step(groups, cut(quotients)))
        games = kernel.agg(F.count_distinct("game_id")).first()[0]
        work, now = cut(work, **size)
        if now["rows"] == games and now["widest"] == 1:
            break
    return steps


def decompose_shapes(dnf: DataFrame, search_above: int = 0) -> Decomposition:
    """:func:`decompose`, with games that differ in owner names alone taken apart once. How a function comes apart does not
    depend on names, so the rounds work on shapes, whose number does not grow with the games where owners are few.

    Games of few owners are relabelled row by row and share shapes, told apart by a 128-bit hash of their text; any other game
    is a shape of its own, its owners being the places.
    """
    source = cut(dnf.where(F.size("term") > 0).select(*D.KEYS))
    games, rest = split_games(source)
    ranked = games.select("game_id", S.let(F.col("terms"), lambda fam: S.let(S.owners_by_role(fam), lambda owners: F.struct(
        S.text_of_family(S.relabel(fam, owners)).alias("text"), owners.alias("owners")))).alias("s"))
    ranked = cut(ranked.select("game_id", F.md5("s.text").alias("shape"), "s.text", "s.owners"))
    names = ranked.select("game_id", "shape", F.posexplode("owners").alias("at", "owner_id")).select(
        "game_id", "shape", (F.col("at") + 1).cast("bigint").alias("place"), "owner_id")
    games = cut(ranked.groupBy("shape").agg(F.min("text").alias("text")).select(
        F.col("shape").alias("game_id"), S.family_of_text(F.col("text")).alias("terms")))
    shapes = games.select("game_id", F.explode("terms").alias("term"))
    if rest is not None:
        own = cut(rest.withColumn("shape", F.concat(F.lit("game "), F.col("game_id").cast("string"))))
        rest = own.where("shape is not null").select(F.col("shape").alias("game_id"), "term")
        shapes = shapes.unionByName(rest)
        names = names.unionByName(own.select("game_id", "shape", F.explode("term").alias("owner_id")).distinct().select(
            "game_id", "shape", F.col("owner_id").alias("place"), "owner_id"))
    steps, rows, wide = _come_apart(games, rest, search_above)
    return Decomposition(source, steps, shapes, names, rows, wide)


# --- the tree as tables -----------------------------------------------------------------------


def paths(d: Decomposition) -> DataFrame:
    """(game_id, owner_id, path): the nodes above an owner from the root down, as (node, kind).

    A node of the same AND/OR kind as its parent is the parent. Paths are as long as the tree is
    deep.
    """
    start = "cast(array() as array<struct<node:string,kind:string>>)"
    place = D.variables(d.apart).groupBy("game_id").agg(F.min("owner_id").alias("elem")).withColumn("path", F.expr(start))
    for i in reversed(range(len(d.steps))):
        groups = d.steps[i].groups.select("game_id", F.col("rep").alias("elem"), "kind", "child")
        node = F.struct(F.concat(F.lit(f"{i}:"), F.col("elem").cast("string")).alias("node"), F.col("kind").alias("kind"))
        merged = (F.col("kind") != "hybrid") & F.coalesce(F.col("kind") == F.expr("get(path, size(path) - 1).kind"), F.lit(False))
        place = place.join(groups, ["game_id", "elem"], "left").select(
            "game_id", F.coalesce("child", "elem").alias("elem"),
            F.when(F.col("child").isNull() | F.coalesce((F.size("path") > 0) & merged, F.lit(False)), F.col("path"))
            .otherwise(F.concat("path", F.array(node))).alias("path"))
    found = place.withColumnRenamed("elem", "owner_id")
    return found if d.names is None else d.by_owner(cut(found))


def _sums(text: str | Column) -> dict[str, Column]:
    """Four sums of the 32-bit quarters of md5 hashes: a digest of a multiset that needs no order and no list."""
    quarter = lambda k: F.conv(F.substring(F.md5(text), 1 + 8 * k, 8), 16, 10).cast("bigint")
    return {f"_s{k}": F.sum(quarter(k)) for k in range(4)}


def _nodes(p: DataFrame) -> DataFrame:
    """Inner nodes from :func:`paths`: (game_id, node, above, kind, owners, name, print).

    ``name`` is the node's least owner and number of owners, which no other inner node of a game
    shares; ``print`` digests its kind and owners. Both are sums over owners, partial first.
    """
    inner = p.select("game_id", "owner_id", F.posexplode("path").alias("at", "n"), "path").select(
        "game_id", "owner_id", F.col("n.node").alias("node"), F.expr("get(path, at - 1).node").alias("above"),
        F.col("n.kind").alias("kind"))
    summed = inner.groupBy("game_id", "node", "above", "kind").agg(
        F.count(F.lit(1)).alias("owners"), F.min("owner_id").alias("_least"),
        *[c.alias(k) for k, c in _sums(F.col("owner_id").cast("string")).items()])
    return summed.select("game_id", "node", "above", "kind", "owners", F.concat_ws("/", "_least", "owners").alias("name"),
                         F.concat_ws("|", "kind", "owners", *[f"_s{k}" for k in range(4)]).alias("print"))


def tree(d: Decomposition) -> DataFrame:
    """(game_id, node_id, parent_id, kind, owner_id): one row per node; owners are ``var`` nodes.

    Inner nodes are named by their least owner and number of owners, so equal trees have equal rows
    however many rounds it took to find them.
    """
    p = cut(paths(d))
    nodes = cut(_nodes(p))
    names = nodes.select("game_id", F.col("node").alias("above"), F.col("name").alias("parent_id"))
    leaves = p.select(
        "game_id", F.concat(F.lit("owner:"), F.col("owner_id").cast("string")).alias("name"),
        F.expr("get(path, size(path) - 1).node").alias("above"), F.lit("var").alias("kind"), "owner_id")
    inner = nodes.select("game_id", "name", "above", "kind", F.lit(None).cast("bigint").alias("owner_id"))
    return inner.unionByName(leaves).join(names, ["game_id", "above"], "left").select(
        "game_id", F.col("name").alias("node_id"), "parent_id", "kind", "owner_id")


def tree_digests(d: Decomposition) -> DataFrame:
    """(game_id, nodes, digest): equal digests mean equal trees up to the order of children.

    A tree is the set of its nodes' kinds and owners, so the digest sums hashes of these; owners and
    nodes of one game are summed in many tasks and no cell holds a subtree.
    """
    p = cut(paths(d))
    leaves = p.select("game_id", F.concat(F.lit("var|"), F.col("owner_id").cast("string")).alias("print"))
    summed = _nodes(p).select("game_id", "print").unionByName(leaves).groupBy("game_id").agg(
        F.count(F.lit(1)).alias("nodes"), *[c.alias(k) for k, c in _sums("print").items()])
    return summed.select("game_id", "nodes", F.md5(F.concat_ws("|", "nodes", *[f"_s{k}" for k in range(4)])).alias("digest"))


def equal_trees(a: Decomposition, b: Decomposition) -> DataFrame:
    """(game_id, equal) for every game of either; a game the other lacks is not equal."""
    left, right = tree_digests(a), tree_digests(b).withColumnsRenamed({"nodes": "_n", "digest": "_d"})
    return left.join(right, "game_id", "full").select(
        "game_id", F.coalesce((F.col("nodes") == F.col("_n")) & (F.col("digest") == F.col("_d")), F.lit(False)).alias("equal"))


def top_modules(d: Decomposition) -> DataFrame:
    """(game_id, kind, module, owner_id): the maximal disjoint modules of every game; ``kind`` is how
    they are put together (``hybrid`` means prime), ``module`` the least owner of the module."""
    p = paths(d).select("game_id", "owner_id", F.coalesce(F.expr("get(path, 0).kind"), F.lit("var")).alias("kind"),
                        F.coalesce(F.expr("get(path, 1).node"), F.concat(F.lit("owner:"), F.col("owner_id"))).alias("m"))
    p = cut(p)
    least = p.groupBy("game_id", "m").agg(F.min("owner_id").alias("module"))
    return p.join(least, ["game_id", "m"]).select("game_id", "kind", "module", "owner_id")


def split_once(d: Decomposition) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One level of decomposition: (modules, quotient, parts).

    ``modules`` as :func:`top_modules`; ``quotient(game_id, term)`` is the game over modules;
    ``parts(game_id, module, term)`` are the functions inside the modules.
    """
    modules = cut(top_modules(d))
    tagged = D.members(d.dnf).join(modules, ["game_id", "owner_id"])
    quotient = tagged.groupBy(*D.KEYS).agg(F.sort_array(F.collect_set("module")).alias("_q")).select(
        "game_id", F.col("_q").alias("term")).distinct()
    parts = tagged.groupBy(*D.KEYS, "module").agg(F.sort_array(F.collect_list("owner_id")).alias("_p")).select(
        "game_id", "module", F.col("_p").alias("term")).distinct()
    return modules, quotient, parts


def canonical_text(d: Decomposition) -> DataFrame:
    """(game_id, text) of the tree, children in a fixed order, e.g. ``and[or[1, 2], or[3, 4]]``.

    One cell per game, for reading; trees are compared by :func:`tree_digests`.
    """
    t = cut(tree(d).withColumn("text", F.col("owner_id").cast("string")))
    depth = cut(paths(d)).agg(F.max(F.size("path"))).first()[0] or 0
    known = t.where("kind = 'var'").select("game_id", "parent_id", "node_id", "text")
    inner = t.where("kind <> 'var'").select("game_id", "node_id", "parent_id", "kind")
    degree = t.where("parent_id is not null").groupBy("game_id", F.col("parent_id").alias("node_id")).agg(
        F.count(F.lit(1)).alias("_all"))
    for _ in range(depth):
        done = known.where("parent_id is not null").groupBy("game_id", F.col("parent_id").alias("node_id")).agg(
            F.sort_array(F.collect_list("text")).alias("_c"), F.count(F.lit(1)).alias("_n"))
        ready = inner.join(done, ["game_id", "node_id"]).join(degree, ["game_id", "node_id"]).where("_n = _all").select(
            "game_id", "parent_id", "node_id",
            F.concat("kind", F.lit("["), F.array_join("_c", ", "), F.lit("]")).alias("text"))
        known = cut(known.unionByName(ready).distinct())
    return known.where("parent_id is null").select("game_id", "text")


def expand(d: Decomposition) -> DataFrame:
    """Multiply the decomposition out again: the inverse of :func:`decompose`."""
    work = D.variables(d.apart).groupBy("game_id").agg(F.min("owner_id").alias("o")).select(
        "game_id", F.array("o").alias("term"))
    for step in reversed(d.steps):
        choices = step.groups.where("kind = 'or'").select("game_id", "rep", F.array("child").alias("choice"))
        if step.quotients is not None:
            choices = choices.unionByName(step.quotients.select("game_id", "rep", F.col("term").alias("choice")))
        all_of = step.groups.where("kind = 'and'").select("game_id", F.col("rep").alias("owner_id"), "child")
        choosers = choices.select("game_id", F.col("rep").alias("owner_id"), F.lit(True).alias("_choose")).distinct()
        opened = (
            D.members(work).join(all_of, ["game_id", "owner_id"], "left").join(choosers, ["game_id", "owner_id"], "left")
            .groupBy(*D.KEYS).agg(
                F.sort_array(F.collect_set(F.when(F.col("_choose").isNull(), F.coalesce("child", "owner_id")))).alias("_t"),
                F.sort_array(F.collect_set(F.when(F.col("_choose"), F.col("owner_id")))).alias("_reps")))
        opened, seen = cut(opened.select("game_id", F.col("_t").alias("term"), "_reps"), most=F.max(F.size("_reps")))
        for i in range(seen["most"] or 0):
            opened = opened.withColumn("rep", F.get("_reps", F.lit(i))).join(choices, ["game_id", "rep"], "left").select(
                "game_id", F.when(F.col("choice").isNull(), F.col("term")).otherwise(
                    S.union(F.col("term"), F.col("choice"))).alias("term"), "_reps")
        work = opened.select(*D.KEYS).distinct()
    if d.names is None:
        return work
    # one member after the other gets its owner's name
    return d.by_owner(D.members(cut(work)).withColumnRenamed("term", "_places")).groupBy("game_id", "_places").agg(
        F.sort_array(F.collect_list("owner_id")).alias("term")).select(*D.KEYS)


# --- ablation ---------------------------------------------------------------------------------


def ablate(d: Decomposition, ablation: str) -> Decomposition:
    """Undo one kind of split: a node of that kind and all below it become one function of its
    owners, to be solved by inclusion–exclusion."""
    kind = ABLATIONS[ablation]
    where = D.variables(d.apart).groupBy("game_id").agg(F.min("owner_id").alias("elem")).withColumns(
        {"leaf_step": F.lit(None).cast("int"), "leaf_rep": F.lit(None).cast("bigint")})
    for i in reversed(range(len(d.steps))):
        groups = d.steps[i].groups.select("game_id", "kind", F.col("rep").alias("elem"), "child")
        hit = F.col("leaf_step").isNull() & (F.col("kind") == kind)
        where = where.join(groups, ["game_id", "elem"], "left").select(
            "game_id", F.coalesce("child", "elem").alias("elem"),
            F.when(hit, F.lit(i)).otherwise(F.col("leaf_step")).alias("leaf_step"),
            F.when(hit, F.col("elem")).otherwise(F.col("leaf_rep")).alias("leaf_rep"))
    leaves = cut(where.where("leaf_step is not null").select(
        "game_id", F.col("elem").alias("owner_id"), "leaf_step", F.col("leaf_rep").alias("rep")))
    functions = cut(D.members(d.apart).join(leaves, ["game_id", "owner_id"]).groupBy(*D.KEYS, "leaf_step", "rep").agg(
        F.sort_array(F.collect_list("owner_id")).alias("_q")).select(
        "game_id", "leaf_step", "rep", F.col("_q").alias("term")).distinct())
    steps = []
    for i, step in enumerate(d.steps):
        # an element is named by its least owner: what that owner is covered by, covers the element
        inside = leaves.where(F.col("leaf_step") >= i).select("game_id", F.col("owner_id").alias("child"))
        groups = step.groups.join(inside, ["game_id", "child"], "left_anti")
        here = leaves.where(F.col("leaf_step") == i).select(
            "game_id", F.lit("hybrid").alias("kind"), "rep", F.col("owner_id").alias("child"),
            F.lit(None).cast("int").alias("born"))
        terms = functions.where(F.col("leaf_step") == i).select("game_id", "rep", "term")
        if step.quotients is not None:
            hybrid = groups.where("kind = 'hybrid'").select("game_id", "rep").distinct()
            terms = terms.unionByName(step.quotients.join(hybrid, ["game_id", "rep"], "left_semi"))
        groups = cut(groups.select("game_id", "kind", "rep", "child", "born").unionByName(here))
        terms, seen = cut(terms, n=F.count(F.lit(1)))
        steps.append(Step(groups, terms if seen["n"] else None))
    return Decomposition(d.dnf, steps, d.shapes, d.names, wide=d.wide)


# --- values -----------------------------------------------------------------------------------


def _log_complement(log_v: Column) -> Column:
    """ln(1 − v) from ln v, accurate near both ends."""
    return F.coalesce(F.ln(-F.expm1(log_v)), F.lit(-745.0))


def _union_rows(step: Step, values: DataFrame, nodes: DataFrame) -> DataFrame:
    """Hybrid groups at every node: (game_id, rep, q, members, coeff, child, born, lv, _sum)."""
    keyed = step.quotients.select(F.struct("game_id", "rep").alias("game_id"), "term")
    states = union_states(keyed).select("game_id.*", "members", "coeff")
    kids = step.groups.where("kind = 'hybrid'").select("game_id", "rep", "child", "born")
    rows = (
        states.withColumn("child", F.explode("members")).join(kids, ["game_id", "rep", "child"])
        .join(nodes, "game_id")
        .join(values.select("game_id", F.col("elem").alias("child"), F.col("step").alias("born"), "q", "lv"),
              ["game_id", "child", "born", "q"], "left")
        .withColumn("lv", F.coalesce("lv", F.ln("t"))))
    whole = rows.groupBy("game_id", "rep", "members", "coeff", "q").agg(F.sum("lv").alias("_sum"))
    return rows.join(whole, ["game_id", "rep", "members", "coeff", "q"]).select(
        "game_id", "rep", "q", "members", "coeff", "child", "born", "lv", "_sum")


def synthesise(d: Decomposition) -> DataFrame:
    """(game_id, owner_id, sv) from a decomposition; games of one shape share its values."""
    values = _synthesised(d)
    return values if d.names is None else d.by_owner(cut(values)).select("game_id", "owner_id", "sv")


def _gathered(d: Decomposition, few: DataFrame) -> DataFrame:
    """The steps of the functions of ``few(game_id)`` as :func:`.listed_trees.trees` gives them."""
    rows = None
    for i, step in enumerate(d.steps):
        here = step.groups.select("game_id", F.lit(i).alias("step"), "kind", "rep", "child", "born",
                                  F.lit(None).cast("array<bigint>").alias("term"))
        if step.quotients is not None:
            here = here.unionByName(step.quotients.select(
                "game_id", F.lit(i).alias("step"), F.lit(TERM).alias("kind"), "rep", F.lit(None).cast("bigint").alias("child"),
                F.lit(None).cast("int").alias("born"), "term"))
        rows = here if rows is None else rows.unionByName(here)
    owners = D.variables(d.apart).join(few, "game_id", "left_semi").groupBy("game_id").agg(
        F.sort_array(F.collect_list("owner_id")).alias("owners"))
    if rows is None:
        return owners.withColumn("groups", F.expr(f"cast(array() as {GROUPS})"))
    of_game = rows.join(few, "game_id", "left_semi").groupBy("game_id").agg(
        F.collect_list(F.struct("step", "kind", "rep", "child", "born", "term")).alias("groups"))
    return owners.join(of_game, "game_id", "left").select(
        "game_id", "owners", F.coalesce("groups", F.expr(f"cast(array() as {GROUPS})")).alias("groups"))


def _synthesised(d: Decomposition) -> DataFrame:
    """Values of the functions taken apart: row by row where a game's tree fits a row (at most ``GATHERED`` owners, no prime
    group of more than ``LISTED`` elements), the others by :func:`_by_steps`. Node values of a game of n owners are n/2 for
    each element, which is much more than the tree itself; trees are shuffled, node values are not."""
    if d.rows is not None and not d.wide:
        return listed_values(d.rows)
    counted = D.owner_counts(d.apart)
    fits = F.col("owners") <= GATHERED
    prime = [s.groups.where("kind = 'hybrid'").withColumn("_step", F.lit(i)) for i, s in enumerate(d.steps) if s.quotients is not None]
    if prime:
        large = reduce(DataFrame.unionByName, prime).groupBy("game_id", "_step", "rep").agg(F.count(F.lit(1)).alias("_n")).where(
            F.col("_n") > LISTED).select("game_id", F.lit(True).alias("_large")).distinct()
        counted, fits = counted.join(large, "game_id", "left"), fits & F.col("_large").isNull()
    if d.rows is not None:
        counted = counted.where(F.col("owners") > LISTED)
    counted, seen = cut(counted.select("game_id", fits.alias("_fits")), many=F.count_if(~F.col("_fits")))
    found = listed_values(_gathered(d, counted.where("_fits").select("game_id")))
    if d.rows is not None:
        found = found.unionByName(listed_values(d.rows))
    if not seen["many"]:
        return found
    many = counted.where("not _fits").select("game_id")
    steps = [Step(s.groups.join(many, "game_id", "left_semi"), None if s.quotients is None else s.quotients.join(many, "game_id", "left_semi"))
             for s in d.steps]
    return found.unionByName(_by_steps(Decomposition(d.apart.join(many, "game_id", "left_semi"), steps)))


def _by_steps(d: Decomposition) -> DataFrame:
    """Values of functions of any number of owners.

    Only merged elements have rows per node. Owners that are merged by the same AND/OR group share
    one value, computed once for the group and joined back.
    """
    games = D.owner_counts(d.apart).withColumnRenamed("owners", "n")
    nodes = cut(nodes_for(games))
    values = nodes.select("game_id", F.lit(0).cast("bigint").alias("elem"), F.lit(0).alias("step"), "q",
                          F.lit(0.0).alias("lv"), F.lit(0.0).alias("lw")).where(F.lit(False))
    factors, owners = [], []
    for i, step in enumerate(d.steps):
        plain = step.groups.where("kind <> 'hybrid'")
        # owners of an AND/OR group count once, with their number
        single = plain.where("born is null").groupBy("game_id", "kind", "rep").agg(
            F.count(F.lit(1)).alias("c")).join(nodes, "game_id").select(
            "game_id", "kind", "rep", F.lit(None).cast("bigint").alias("child"), "q",
            F.ln("t").alias("lv"), F.ln(1 - F.col("t")).alias("lw"), "c")
        merged = plain.where("born is not null").join(
            values.withColumnsRenamed({"elem": "child", "step": "born"}), ["game_id", "child", "born"]).select(
            "game_id", "kind", "rep", "child", "q", "lv", "lw", F.lit(1).cast("bigint").alias("c"))
        parts = cut(single.unionByName(merged) if i else single)
        total = parts.groupBy("game_id", "kind", "rep", "q").agg(
            F.sum(F.col("c") * F.col("lv")).alias("_v"), F.sum(F.col("c") * F.col("lw")).alias("_w"))
        is_and = F.col("kind") == "and"
        value = total.select(
            "game_id", F.col("rep").alias("elem"), F.lit(i).alias("step"), "q",
            F.when(is_and, F.col("_v")).otherwise(_log_complement(F.col("_w"))).alias("lv"),
            F.when(is_and, _log_complement(F.col("_v"))).otherwise(F.col("_w")).alias("lw"))
        factor = parts.join(total, ["game_id", "kind", "rep", "q"]).select(
            "game_id", F.col("rep").alias("elem"), "q", "child", F.col("rep").alias("cls"),
            F.exp(F.when(is_and, F.col("_v") - F.col("lv")).otherwise(F.col("_w") - F.col("lw"))).alias("f"))
        if step.quotients is not None:
            unions = cut(_union_rows(step, values, nodes))
            one = unions.groupBy("game_id", "rep", "q", "members", "coeff").agg(F.first("_sum").alias("_sum"))
            v = one.groupBy("game_id", F.col("rep").alias("elem"), "q").agg(
                F.sum(F.col("coeff") * F.exp("_sum")).alias("v"))
            value = value.unionByName(v.select(
                "game_id", "elem", F.lit(i).alias("step"), "q",
                F.coalesce(F.ln(F.greatest("v", F.lit(0.0))), F.lit(-745.0)).alias("lv"),
                F.coalesce(F.ln(F.greatest(1 - F.col("v"), F.lit(0.0))), F.lit(-745.0)).alias("lw")))
            factor = factor.unionByName(unions.groupBy("game_id", "rep", "child", "born", "q").agg(
                F.sum(F.col("coeff") * F.exp(F.col("_sum") - F.col("lv"))).alias("f")).select(
                "game_id", F.col("rep").alias("elem"), "q",
                F.when(F.col("born").isNotNull(), F.col("child")).alias("child"), F.col("child").alias("cls"), "f"))
        factors.append(factor)
        owners.append(step.groups.where("born is null").select(
            "game_id", F.lit(i).alias("step"), F.when(F.col("kind") == "hybrid", F.col("child")).otherwise(
                F.col("rep")).alias("cls"), F.col("child").alias("owner_id")))
        values = values.unionByName(value) if i else value
    # top-down: one chain of joins; a row that has reached owners waits with its step and class
    root = D.variables(d.apart).groupBy("game_id").agg(F.min("owner_id").alias("elem"), F.count(F.lit(1)).alias("n"))
    slope = root.where("n > 1").join(nodes, "game_id").select(
        "game_id", "elem", "q", F.lit(1.0).alias("g"), F.lit(None).cast("int").alias("step"),
        F.lit(None).cast("bigint").alias("cls"))
    for i in reversed(range(len(d.steps))):
        down = factors[i].withColumnsRenamed({"cls": "_cls"})
        slope = slope.join(down, ["game_id", "elem", "q"], "left").select(
            "game_id",
            F.when(F.col("f").isNull(), F.col("elem")).otherwise(F.col("child")).alias("elem"), "q",
            (F.col("g") * F.coalesce("f", F.lit(1.0))).alias("g"),
            F.when(F.col("f").isNotNull() & F.col("child").isNull(), F.lit(i)).otherwise(F.col("step")).alias("step"),
            F.when(F.col("f").isNotNull() & F.col("child").isNull(), F.col("_cls")).otherwise(F.col("cls")).alias("cls"))
    lone = root.where("n = 1").select("game_id", F.col("elem").alias("owner_id"), F.lit(1.0).alias("sv"))
    if not owners:
        return lone
    by_class = slope.join(nodes.select("game_id", "q", "w"), ["game_id", "q"]).groupBy("game_id", "step", "cls").agg(
        F.sum(F.col("w") * F.col("g")).alias("sv"))
    everybody = owners[0]
    for o in owners[1:]:
        everybody = everybody.unionByName(o)
    return everybody.join(by_class, ["game_id", "step", "cls"]).select("game_id", "owner_id", "sv").unionByName(lone)


def recursive_method(dnf: DataFrame, ablation: str | None = None) -> DataFrame:
    """Values by decomposition; for an ablation every function is searched for modules, whatever its size."""
    d = decompose_shapes(dnf, 0 if ablation else SEARCH_ABOVE)
    return synthesise(ablate(d, ablation) if ablation else d)
