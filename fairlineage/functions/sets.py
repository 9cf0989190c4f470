"""Owner sets as sorted, distinct ``array<bigint>`` columns.

An owner set is as wide as the join (one member per owner column or per copy of a row), never as
long as a group, so a single cell always holds it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

INTEGERS = ("tinyint", "smallint", "int", "bigint")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times inside one expression."""
    return F.element_at(F.transform(F.array(value), body), 1)


def owner_set(*cells: Column, wrap_u32: bool = False) -> Column:
    """Set of the owner cells of a row; cells that are null or of no integer type are no members.

    ``wrap_u32`` keeps the low 32 bits of an id, as a store with 32-bit owner ids would.
    """
    ids = [F.when(F.typeof(c).isin(*INTEGERS), c.try_cast("bigint")) for c in cells]
    if wrap_u32:
        ids = [F.pmod(c, F.lit(4294967296).cast("bigint")) for c in ids]
    return canonical(F.array(*ids))


def canonical(members: Column) -> Column:
    return F.sort_array(F.array_distinct(F.array_compact(members)))


def union(a: Column, b: Column) -> Column:
    return F.sort_array(F.array_union(a, b))


def intersection(a: Column, b: Column) -> Column:
    return F.sort_array(F.array_intersect(a, b))


def difference(a: Column, b: Column) -> Column:
    return F.sort_array(F.array_except(a, b))


def overlaps(a: Column, b: Column) -> Column:
    return F.arrays_overlap(a, b)


def is_subset(a: Column, b: Column) -> Column:
    """a ⊆ b; the size test is cheap and decides most pairs."""
    return (F.size(a) <= F.size(b)) & (F.size(F.array_except(a, b)) == 0)


def is_superset(a: Column, b: Column) -> Column:
    return is_subset(b, a)


def contains(a: Column, owner: Column) -> Column:
    return F.array_contains(a, owner)


def cardinality(a: Column) -> Column:
    return F.size(a).cast("bigint")


def is_singleton(a: Column) -> Column:
    return F.size(a) == 1


def same_members(a: Column, b: Column) -> Column:
    """Equality of two lists regardless of order, duplicates counting."""
    return F.sort_array(a) == F.sort_array(b)


def binomial(n: Column, k: Column) -> Column:
    """C(n, k) as double; exact while the value fits 53 bits, 0 outside 0 ≤ k ≤ n."""
    small = F.least(k, n - k)
    steps = F.when(small >= 1, F.sequence(F.lit(1).cast("bigint"), small.cast("bigint"))).otherwise(
        F.array().cast("array<bigint>"))
    product = F.aggregate(
        steps, F.lit(1.0), lambda acc, j: F.round(acc * (n - small + j) / j, 0))
    return F.when((k < 0) | (k > n), F.lit(0.0)).otherwise(product)


def binomial_row(n: Column) -> Column:
    """C(n, 0..n) as an array."""
    return F.transform(F.sequence(F.lit(0).cast("bigint"), n.cast("bigint")), lambda k: binomial(n, k))


# --- small families of sets, one family per row (as many sets as the join has tables) ---------


def by_size(family: Column) -> Column:
    """Order a family by (size, members)."""
    ranked = F.sort_array(F.transform(family, lambda s: F.struct(F.size(s).alias("n"), s.alias("s"))))
    return F.transform(ranked, lambda r: r["s"])


def family(sets: list[Column]) -> Column:
    """Distinct sets of a row in a fixed order."""
    return F.sort_array(F.array_distinct(F.array(*sets)))


def is_disjoint(family: Column) -> Column:
    """No owner is in two sets of the family."""
    return let(F.flatten(family), lambda all_: F.size(F.array_distinct(all_)) == F.size(all_))


def absorb(family: Column) -> Column:
    """Drop duplicates and every set that has a proper subset in the family.

    Most sets of a join have one member: they absorb by overlap. Only what is left is compared
    set with set.
    """

    def keep_minimal(sets: Column) -> Column:
        return F.when(F.size(sets) < 2, sets).otherwise(F.filter(sets, lambda s: ~F.exists(
            sets, lambda r: (F.size(r) < F.size(s)) & (F.size(F.array_except(r, s)) == 0))))

    def split(fam: Column) -> Column:
        ones = F.filter(fam, lambda s: F.size(s) <= 1)
        return let(F.flatten(ones), lambda singles: F.concat(ones, let(
            F.filter(fam, lambda s: (F.size(s) > 1) & ~F.arrays_overlap(s, singles)), keep_minimal)))

    return let(F.array_distinct(family), lambda fam: F.when(
        F.exists(fam, lambda s: F.size(s) == 0), F.array(F.array().cast("array<bigint>"))).otherwise(split(fam)))


def text_of_set(s: Column) -> Column:
    return F.when(F.size(s) == 0, F.lit("TRUE")).otherwise(
        F.concat_ws(" ", F.transform(s, lambda o: o.cast("string"))))


def text_of_family(family: Column) -> Column:
    """``1 + 2 3``; no set is FALSE, the empty set is TRUE."""
    return F.when(F.size(family) == 0, F.lit("FALSE")).otherwise(
        F.concat_ws(" + ", F.transform(by_size(family), text_of_set)))


def family_of_text(text: Column) -> Column:
    """Inverse of :func:`text_of_family` for games without constants."""
    return F.transform(
        F.split(text, r" \+ "), lambda s: F.transform(F.split(s, " "), lambda o: o.cast("bigint")))


def owners_by_role(family: Column) -> Column:
    """The owners of a family, ordered by the role they play: how many sets they are in and how
    large those sets are; equal roles are ordered by id. Disjoint sets are taken set by set."""

    def shared(fam: Column) -> Column:
        roles = F.transform(
            F.array_distinct(F.flatten(fam)),
            lambda o: F.struct(
                F.sort_array(F.transform(
                    F.filter(fam, lambda s: F.array_contains(s, o)), lambda s: F.size(s))).alias("role"),
                o.alias("o")))
        return F.transform(F.sort_array(roles), lambda r: r["o"])

    return let(family, lambda fam: F.when(is_disjoint(fam), F.flatten(by_size(fam))).otherwise(shared(fam)))


def relabel(family: Column, owners: Column) -> Column:
    """Replace every owner by its 1-based position in ``owners`` and order the family again."""
    renamed = F.transform(
        family, lambda s: F.sort_array(F.transform(s, lambda o: F.array_position(owners, o).cast("bigint"))))
    return by_size(renamed)
