"""Games of few owners come apart and get their values row by row: their terms are bit masks, so nothing of a round is shuffled.
Trees of more owners that have come apart in rounds get their values row by row as well, as long as no prime group is large.

The rounds are those of :mod:`.synthesis` (AND twins, OR twins, then prime modules); a game goes on to its next round at once,
whatever the others do.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions.quadrature import gauss_legendre
from ..session import ship_package
from .listed import differences

GROUPS = "array<struct<step:int,kind:string,rep:bigint,child:bigint,born:int,term:array<bigint>>>"
_GROUPS = pa.list_(pa.struct([("step", pa.int32()), ("kind", pa.string()), ("rep", pa.int64()), ("child", pa.int64()),
                              ("born", pa.int32()), ("term", pa.list_(pa.int64()))]))
TERM = "term"  # the kind of a row that holds a term of a prime group's own function
AT_ONCE = 64    # games that a task has as Python objects at once
GATHERED = 256  # a tree of so many owners, of which no prime group has more than LISTED elements, is worked out in one row


def _bits(mask: int) -> Iterator[int]:
    while mask:
        low = mask & -mask
        yield low
        mask ^= low


def _union(terms: set[int]) -> int:
    live = 0
    for t in terms:
        live |= t
    return live


def _twins(terms: set[int]) -> list[tuple[str, list[int]]]:
    """(kind, members): owners in the same terms, and owners whose terms are the same but for themselves."""
    marks: dict[tuple, list[int]] = {}
    for b in _bits(_union(terms)):
        mine = [t for t in terms if t & b]
        marks.setdefault(("and", frozenset(mine)), []).append(b)
        marks.setdefault(("or", frozenset(t ^ b for t in mine)), []).append(b)
    return [(kind, members) for (kind, _), members in marks.items() if len(members) > 1]


def _least_modules(terms: set[int], live: int) -> list[int]:
    """The least modules of more than one owner in a function without twins; all owners, if there is no smaller one."""
    found: list[int] = []
    bits = list(_bits(live))
    for size in range(2, len(bits)):
        for members in combinations(bits, size):
            a = sum(members)
            if any(m & a == m for m in found):
                continue
            touching = [t for t in terms if t & a]
            if len({t & a for t in touching}) * len({t & ~a for t in touching}) == len(touching):
                found.append(a)
    return found or [live]


def _apart(terms: set[int], search_above: int) -> Iterator[tuple[int, str, int, int | None, int | None, int | None]]:
    """(step, kind, rep, child, born, term) until one element is left; owners and terms as masks."""
    born: dict[int, int] = {}
    step = 0
    while True:
        live = _union(terms)
        if live & (live - 1) == 0:
            return
        groups, apart = _twins(terms), []
        if groups:
            gone = {kind: sum(b for k, members in groups if k == kind for b in members[1:]) for kind in ("and", "or")}
            terms = {t & ~gone["and"] for t in terms if not t & gone["or"]}
        else:
            modules = [live] if min(len(terms), live.bit_count()) <= search_above else _least_modules(terms, live)
            groups = [("hybrid", list(_bits(m))) for m in modules]
            apart = [(m & -m, t) for m in modules for t in {t & m for t in terms} if t]
            for m in modules:
                terms = {(t & ~m) | (m & -m) if t & m else t for t in terms}
        for kind, members in groups:
            for b in members:
                yield step, kind, members[0], b, born.get(b), None
        for rep, t in apart:
            yield step, TERM, rep, None, None, t
        for _, members in groups:
            born[members[0]] = step
        step += 1


def _tree(terms: list[list[int]], search_above: int) -> tuple[list[int], list[dict]]:
    owners = sorted({o for t in terms for o in t})
    bit = {o: 1 << i for i, o in enumerate(owners)}
    owner = {b: o for o, b in bit.items()}
    rows = _apart({sum(bit[o] for o in set(t)) for t in terms}, search_above)
    return owners, [{"step": s, "kind": k, "rep": owner[r], "child": owner.get(c), "born": b,
                     "term": None if t is None else [owner[x] for x in _bits(t)]} for s, k, r, c, b, t in rows]


def _by_rows(df: DataFrame, columns: list[str], make: Callable[..., list[pa.Array]], schema: str, names: list[str]) -> DataFrame:
    """``make(game ids, columns as Python lists)``, some games at a time."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, AT_ONCE):
                part = batch.slice(start, AT_ONCE)
                yield pa.RecordBatch.from_arrays(make(part.column(0), *[c.to_pylist() for c in part.columns[1:]]), names)

    ship_package(df.sparkSession)
    return df.select("game_id", *columns).mapInArrow(run, schema)


def trees(games: DataFrame, search_above: int = 0) -> DataFrame:
    """(game_id, owners, groups): how every game of ``games(game_id, terms)`` comes apart. ``groups`` are the rows (step, kind, rep,
    child, born) of :class:`.synthesis.Step`, and rows of kind ``TERM`` with the terms of prime groups' own functions.
    """
    def make(game: pa.Array, terms: list) -> list[pa.Array]:
        found = [_tree(t, search_above) for t in terms]
        return [game, pa.array([o for o, _ in found], pa.list_(pa.int64())), pa.array([g for _, g in found], _GROUPS)]

    kind = games.schema["game_id"].dataType.simpleString()
    return _by_rows(games, ["terms"], make, f"game_id {kind}, owners array<bigint>, groups {GROUPS}", ["game_id", "owners", "groups"])


# --- values -----------------------------------------------------------------------------------


def _without_each(v: np.ndarray) -> np.ndarray:
    """For each row the product of all other rows."""
    before, after = np.ones_like(v), np.ones_like(v)
    np.cumprod(v[:-1], axis=0, out=before[1:])
    after[:-1] = np.cumprod(v[:0:-1], axis=0)[::-1]
    return before * after


def _function_at(terms: list[int], v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(value, slope of each element) of a function of the elements' values ``v``, by inclusion–exclusion over its unions."""
    k, q = v.shape
    f = np.zeros((1, 1 << k), np.int64)
    f[0, terms] = 1
    coeff = differences(f, k)[0].astype(float)
    unions = np.ones((1, q))
    for row in v:
        unions = np.concatenate([unions, unions * row])
    slopes = [coeff.reshape(-1, 2, 1 << i)[:, 1].ravel() @ unions.reshape(-1, 2, 1 << i, q)[:, 0].reshape(-1, q) for i in range(k)]
    return coeff @ unions, np.stack(slopes)


@lru_cache
def _rule(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and weights that integrate degree n − 1 exactly."""
    return gauss_legendre(max(1, (n + 1) // 2))


def _owner_values(owners: list[int], rows: list[dict]) -> list[float]:
    """Bottom-up the value of every element at the nodes, top-down its slope, whose integral is an owner's value."""
    t, w = _rule(len(owners))
    groups: dict[tuple[int, int], list] = {}
    for r in rows:
        kids, terms = groups.setdefault((r["step"], r["rep"]), [[], []])
        if r["kind"] == TERM:
            terms.append(r["term"])
        else:
            kids.append((r["child"], r["born"], r["kind"]))
    made, factors = {}, []
    for (step, rep), (kids, terms) in sorted(groups.items()):
        v = np.stack([t if born is None else made[child, born] for child, born, _ in kids])
        kind = kids[0][2]
        if kind == "and":
            value, slope = v.prod(axis=0), _without_each(v)
        elif kind == "or":
            value, slope = 1 - (1 - v).prod(axis=0), _without_each(1 - v)
        else:
            bit = {child: 1 << i for i, (child, _, _) in enumerate(kids)}
            value, slope = _function_at([sum(bit[o] for o in x) for x in terms], v)
        made[rep, step] = value
        factors.append((rep, [child for child, _, _ in kids], slope))
    slopes = {owners[0]: np.ones_like(t)}
    for rep, kids, slope in reversed(factors):
        above = slopes.pop(rep)
        slopes.update(zip(kids, above * slope))
    return [float(w @ slopes[o]) for o in owners]


def values(trees: DataFrame) -> DataFrame:
    """(game_id, owner_id, sv) of games as :func:`trees` gives them."""
    def make(game: pa.Array, owners: list, groups: list) -> list[pa.Array]:
        sv = [_owner_values(o, g) for o, g in zip(owners, groups)]
        at = pa.array(np.repeat(np.arange(len(owners)), [len(o) for o in owners]), pa.int64())
        return [game.take(at), pa.array([x for o in owners for x in o], pa.int64()), pa.array([x for s in sv for x in s], pa.float64())]

    kind = trees.schema["game_id"].dataType.simpleString()
    return _by_rows(trees, ["owners", "groups"], make, f"game_id {kind}, owner_id bigint, sv double", ["game_id", "owner_id", "sv"])
