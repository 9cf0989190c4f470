"""Polynomials in one variable as rows, and the union states of a function.

``poly(…keys, degree, coeff)`` is Σ coeff·t^degree. The value of a polynomial, Σ coeff/degree, is
the integral of Σ coeff·t^(degree-1) over [0, 1], which is how a polynomial becomes a Shapley value.
Coefficients of polynomials are whole numbers of up to 38 digits, ``decimal(38,0)``; one that does not fit is an error, never a
wrong number.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from decimal import Decimal
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import sets as S
from ..session import cut, delete_tables, recorded_tables, ship_package
from .listed import LISTED, differences, solved, split_games

WHOLE = "decimal(38,0)"
BLOCK, MOST = 4, 8    # terms of a block of union_states, wanted and at most: at most 2^8 unions of one block
PARTS, SMALL = 16, 12  # parts that the states of one game are dealt over; a game of few terms has few states and one part


def _whole(c: Column) -> Column:
    return c.cast(WHOLE)


def _fits(number: Column, of: Column) -> Column:
    """``number`` made from the non-null ``of``; null, which is what an overflow leaves where it is no error itself, is an error."""
    return F.when(number.isNull() & of.isNotNull(), F.raise_error(F.lit("a coefficient has more than 38 digits")).cast(WHOLE)).otherwise(number)


def _total(c: Column) -> Column:
    """Exact sum of whole numbers."""
    return _fits(_whole(F.sum(_whole(c))), F.max(c))


def _times(a: Column, b: Column) -> Column:
    """Exact product of whole numbers."""
    return _fits(_whole(_whole(a) * _whole(b)), a + b)


def add(*polys: DataFrame, keys: Sequence[str] = ("game_id",)) -> DataFrame:
    """Sum by degree; zero coefficients vanish."""
    rows = reduce(DataFrame.unionByName, [p.withColumn("coeff", _whole(F.col("coeff"))) for p in polys])
    return rows.groupBy(*keys, "degree").agg(_total(F.col("coeff")).alias("coeff")).where("coeff <> 0")


def scale(poly: DataFrame, sign: int | Column) -> DataFrame:
    return poly.withColumn("coeff", F.col("coeff") * (F.lit(sign) if isinstance(sign, int) else sign))


def subtract(a: DataFrame, b: DataFrame, keys: Sequence[str] = ("game_id",)) -> DataFrame:
    return add(a, scale(b, -1), keys=keys)


def multiply(a: DataFrame, b: DataFrame, keys: Sequence[str] = ("game_id",),
             drop_constant: bool = True) -> DataFrame:
    """Convolution: degrees add, coefficients multiply. Constant terms of the result are dropped
    unless asked for. Both polynomials are shuffled, as either can have a row per game."""
    other = b.select(*keys, F.col("degree").alias("_d"), F.col("coeff").alias("_c"))
    product = a.join(other.hint("merge"), list(keys)).groupBy(*keys, (F.col("degree") + F.col("_d")).alias("degree")).agg(
        _total(_times(F.col("coeff"), F.col("_c"))).alias("coeff")).where("coeff <> 0")
    return product.where("degree <> 0") if drop_constant else product


def vertical(a: DataFrame, b: DataFrame, keys: Sequence[str] = ("game_id",)) -> DataFrame:
    """AND of parts without common owners: a·b; the identity is {0: 1}."""
    return multiply(a, b, keys)


def horizontal(a: DataFrame, b: DataFrame, keys: Sequence[str] = ("game_id",)) -> DataFrame:
    """OR of parts without common owners: a + b − a·b; the identity is no rows."""
    return add(a, b, scale(multiply(a, b, keys), -1), keys=keys)


def value_of(poly: DataFrame, keys: Sequence[str] = ("game_id",), name: str = "value") -> DataFrame:
    """Σ coeff/degree."""
    return poly.groupBy(*keys).agg(F.sum(F.col("coeff").cast("double") / F.col("degree")).alias(name))


def leave_one_out(rows: DataFrame, keys: Sequence[str], value: str, name: str = "others") -> DataFrame:
    """Product of the values of all other rows of the same keys, for every row.

    Two numbers per key, the product of the non-zero values and the count of zeros, answer it for
    any number of rows; they are summed map-side.
    """
    v = F.col(value).cast("double")
    total = rows.groupBy(*keys).agg(
        F.product(F.when(v != 0, v).otherwise(F.lit(1.0))).alias("_p"), F.sum((v == 0).cast("int")).alias("_z"))
    others = F.when(F.col("_z") == 0, F.col("_p") / v).when((F.col("_z") == 1) & (v == 0), F.col("_p")).otherwise(0.0)
    return rows.join(total, list(keys)).withColumn(name, others).drop("_p", "_z")


# --- inclusion–exclusion ----------------------------------------------------------------------


def _blocks(dnf: DataFrame) -> DataFrame:
    """(game_id, owners, parts, last, _b, _terms): the terms of every game in numbered blocks.

    Terms are dealt by hash over as many buckets as blocks are wanted; a bucket that got more than ``MOST`` is cut.
    So no game's terms are numbered in one place. Rounds are as many as the fullest buckets ask for.
    """
    size = dnf.groupBy("game_id").agg(F.count(F.lit(1)).alias("_n")).join(
        dnf.select("game_id", F.explode("term").alias("o")).groupBy("game_id").agg(F.count_distinct("o").alias("owners")), "game_id")
    buckets = F.ceil(F.col("_n") / BLOCK).cast("bigint")
    dealt = dnf.join(size, "game_id").withColumn("_of", buckets).withColumn("_k", F.pmod(F.xxhash64("term"), F.col("_of")))
    ranked = dealt.withColumn("_r", F.expr("row_number() over (partition by game_id, _k order by term) - 1"))
    parts = F.when(F.col("_n") <= SMALL, 1).otherwise(PARTS).alias("parts")
    blocks = ranked.groupBy("game_id", "owners", parts, (F.expr(f"_r div {MOST}") * F.col("_of") + F.col("_k")).alias("_b")).agg(
        F.sort_array(F.collect_list("term")).alias("_terms"))
    last = blocks.groupBy("game_id").agg(F.max("_b").alias("last"))
    return blocks.join(last, "game_id")


def _part(members: Column, parts: Column) -> Column:
    return F.pmod(F.xxhash64(members), parts).cast("int")


def _over_parts(df: DataFrame, parts: Column) -> DataFrame:
    """Every row once for each part."""
    return df.withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1)))


def union_states(dnf: DataFrame, sizes: list[int] | None = None) -> DataFrame:
    """(game_id, members, coeff): the function as Σ coeff·[all members], i.e. inclusion–exclusion
    over all sets of terms with equal unions merged and cancelled.

    Games of at most ``LISTED`` owners, whose states are bounded, are worked out row by row: their terms are shuffled, their
    states are not. The others go through :func:`_multiplied`, as do all games if ``sizes`` is asked for.
    """
    if sizes is not None:
        return _multiplied(dnf, sizes)
    games, rest = split_games(dnf)
    states = solved(games, differences)
    return states if rest is None else states.unionByName(_multiplied(rest))


def _multiplied(dnf: DataFrame, sizes: list[int] | None = None) -> DataFrame:
    """Union states of games of any number of owners.

    1 − f is the product of (1 − term). Terms are multiplied in by blocks; a round is one join and
    one sum by union, for all games at once. States are dealt over parts by a hash of their members, and each part has
    the block's few factors, so the states of one large game are spread over tasks. A state that holds every owner of its game is dropped as
    soon as terms are left: (1 − term) takes it from itself. The number of states can double with every term, as
    in any inclusion–exclusion, so split games before they come here. ``sizes`` gets the number of states after every round.
    """
    chosen = "filter(_terms, (t, i) -> (_m >> i) & 1 = 1)"
    factors = (
        _blocks(dnf).withColumn("_m", F.explode(F.expr("sequence(0, (1 << size(_terms)) - 1)")))
        .select("game_id", "owners", "parts", "last", "_b",
                F.expr(f"cast(sort_array(array_distinct(flatten({chosen}))) as array<bigint>)").alias("_u"),
                F.expr("cast(if(bit_count(_m) % 2 = 0, 1, -1) as bigint)").alias("_c"))
        .groupBy("game_id", "owners", "parts", "last", "_b", "_u").agg(F.sum("_c").alias("_c")).where("_c <> 0"))
    factors, seen = cut(factors, last=F.max("_b"))
    rounds = (seen["last"] if seen["last"] is not None else -1) + 1
    start = factors.groupBy("game_id", "owners", "parts", "last").agg(F.count(F.lit(1))).select(
        "game_id", "owners", "parts", "last", F.array().cast("array<bigint>").alias("members"), F.lit(1).cast("bigint").alias("coeff"))
    states = start
    with recorded_tables() as made:
        for b in range(rounds):
            factor = _over_parts(factors.where(F.col("_b") == b), F.col("parts")).select("game_id", "_part", "_u", "_c")
            going = states.withColumn("_part", _part(F.col("members"), F.col("parts"))).join(
                factor.hint("merge"), ["game_id", "_part"], "left").select(
                "game_id", "owners", "parts", "last",
                F.when(F.col("_u").isNull(), F.col("members")).otherwise(S.union(F.col("members"), F.col("_u")))
                .alias("members"),
                (F.col("coeff") * F.coalesce("_c", F.lit(1).cast("bigint"))).alias("coeff"))
            states = going.groupBy("game_id", "owners", "parts", "last", "members").agg(F.sum("coeff").alias("coeff")).where(
                (F.col("coeff") != 0) & ((F.size("members") < F.col("owners")) | (F.col("last") <= b)))
            if sizes is not None or (b % 3 == 2 and b + 1 < rounds):
                before = made[:]
                states, seen = cut(states, n=F.count(F.lit(1)))
                delete_tables(dnf.sparkSession, before)
                if sizes is not None:
                    sizes.append(seen["n"])
    return states.where(F.size("members") > 0).select("game_id", "members", (-F.col("coeff")).alias("coeff"))


def union_polynomial(states: DataFrame) -> DataFrame:
    """(game_id, degree, coeff) of a function with one variable per owner."""
    return states.groupBy("game_id", F.size("members").cast("bigint").alias("degree")).agg(
        _total(F.col("coeff")).alias("coeff")).where("coeff <> 0")


def _joined_products(states: DataFrame, children: DataFrame) -> DataFrame:
    """:func:`child_products` of games of any size, in as many rounds as the largest state has members."""
    states, seen = cut(states.select("game_id", "members").distinct(), most=F.max(F.size("members")))
    child = children.select("game_id", F.col("child_id").alias("_child"), F.col("degree").alias("_d"),
                            F.col("coeff").alias("_c"))
    grown = states.withColumns(
        {"degree": F.lit(0).cast("bigint"), "coeff": _whole(F.lit(1))})
    for i in range(seen["most"] or 0):
        with_child = grown.withColumn("_child", F.get("members", F.lit(i)))
        grown = (
            with_child.join(child.hint("merge"), ["game_id", "_child"], "left")
            .where(F.col("_child").isNull() | F.col("_c").isNotNull())
            .groupBy("game_id", "members", (F.col("degree") + F.coalesce("_d", F.lit(0))).alias("degree"))
            .agg(_total(_times(F.col("coeff"), F.coalesce("_c", F.lit(1)))).alias("coeff")))
    return grown.where("coeff <> 0")


def _game_products(states: Sequence[Sequence[int]], kids: list[dict]) -> Iterator[tuple[Sequence[int], int, int]]:
    """(members, degree, coeff) of one game; products of equal first members are made once. A state with a member without polynomial has none."""
    poly: dict[int, dict[int, int]] = {}
    for k in kids:
        of = poly.setdefault(k["child"], {})
        of[k["degree"]] = of.get(k["degree"], 0) + int(k["coeff"])
    made = {(): {0: 1}}

    def product(members: tuple[int, ...]) -> dict[int, int]:
        if members not in made:
            out: dict[int, int] = {}
            for d, c in product(members[:-1]).items():
                for e, b in poly.get(members[-1], {}).items():
                    out[d + e] = out.get(d + e, 0) + c * b
            made[members] = out
        return made[members]

    for members in states:
        for d, c in product(tuple(members)).items():
            if c:
                yield members, d, c


def _whole_cells(numbers: Iterable[int]) -> pa.Array:
    return pa.array([Decimal(c) for c in numbers], pa.decimal128(38, 0))


def _listed_products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, 64):
            part = batch.slice(start, 64)
            rows = [(i, *r) for i, (states, kids) in enumerate(zip(part.column(1).to_pylist(), part.column(2).to_pylist()))
                    for r in _game_products([s["members"] for s in states], kids or [])]
            game, members, degree, coeff = zip(*rows) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(pa.array(game, pa.int64())), pa.array(members, pa.list_(pa.int64())), pa.array(degree, pa.int64()),
                 _whole_cells(coeff)], ["game_id", "members", "degree", "coeff"])


def _dict_sum(states: list[list[int]], weights: list[int], kids: list[dict]) -> dict[int, int]:
    """Σ weight · product by degree, in Python's whole numbers."""
    weight: dict[tuple[int, ...], int] = {}
    for members, w in zip(map(tuple, states), weights):
        weight[members] = weight.get(members, 0) + w
    total: dict[int, int] = {}
    for members, d, c in _game_products(list(weight), kids):
        total[d] = total.get(d, 0) + c * weight[members]
    return total


def _game_sum(flat: np.ndarray, lengths: np.ndarray, weights: list[int], kids: list[dict]) -> dict[int, int]:
    """:func:`_dict_sum` by one table of coalitions that halves with every owner put in, where 64 bits surely suffice.
    ``flat`` are the members of all states, ``lengths`` how many each state has."""
    owners, place = np.unique(flat, return_inverse=True)
    poly: dict[int, dict[int, int]] = {o: {} for o in owners.tolist()}
    for k in kids:
        if (of := poly.get(k["child"])) is not None:
            of[k["degree"]] = of.get(k["degree"], 0) + int(k["coeff"])
    bound, most = sum(map(abs, weights)), 0
    for of in poly.values():
        bound *= max(1, sum(map(abs, of.values())))
        most += max(of, default=0)
    if bound >= 1 << 62 or most > 1 << 8 or any(d < 0 for of in poly.values() for d in of):
        ends = np.cumsum(lengths)
        return _dict_sum([flat[e - n:e].tolist() for e, n in zip(ends, lengths)], weights, kids)
    state = np.repeat(np.arange(len(lengths)), lengths)
    masks = np.bincount(state, weights=np.left_shift(1, place.ravel()), minlength=len(lengths)).astype(np.int64)
    table = np.zeros((1 << len(owners), most + 1), np.int64)
    np.add.at(table[:, 0], masks, np.array(weights, np.int64))
    for o in reversed(owners.tolist()):
        without, with_ = np.split(table, 2)
        table = without.copy()
        for d, c in poly[o].items():
            table[:, d:] += c * with_[:, :with_.shape[1] - d]
    return {d: c for d, c in enumerate(table[0].tolist()) if c}


def _listed_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The products of a game times the states' coefficients, summed by degree."""
    for batch in batches:
        for start in range(0, batch.num_rows, 64):
            part, rows = batch.slice(start, 64), []
            of_game = np.diff(part.column(1).offsets.to_numpy())
            states = part.column(1).flatten()
            members, weights = states.field("members"), [int(c) for c in states.field("coeff").to_pylist()]
            lengths, flat = np.diff(members.offsets.to_numpy()), members.flatten().to_numpy(zero_copy_only=False)
            first = np.concatenate([[0], np.cumsum(of_game)])
            cells = np.concatenate([[0], np.cumsum(lengths)])
            for i, kids in enumerate(part.column(2).to_pylist()):
                at, to = first[i], first[i + 1]
                total = _game_sum(flat[cells[at]:cells[to]], lengths[at:to], weights[at:to], kids or [])
                rows += [(i, d, c) for d, c in total.items() if c]
            game, degree, coeff = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(pa.array(game, pa.int64())), pa.array(degree, pa.int64()), _whole_cells(coeff)],
                ["game_id", "degree", "coeff"])


def _split_states(states: DataFrame, children: DataFrame) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """(listed, states, children): ``listed(game_id, states, kids)`` of the games that fit a row; the rest of both, None if there is none.

    Fitting games have at most 2^``LISTED`` states, as many rows of children and at most ``LISTED`` owners in a state. Both sides have a
    row per game at least, so neither is sent through the driver.
    """
    most, cells = 1 << LISTED, [c for c in states.columns if c != "game_id"]
    size = states.groupBy("game_id").agg(F.count(F.lit(1)).alias("_states"), F.max(F.size("members")).alias("_widest"))
    rows = children.groupBy("game_id").agg(F.count(F.lit(1)).alias("_rows"))
    few = (F.col("_states") <= most) & (F.col("_widest") <= LISTED) & (F.coalesce("_rows", F.lit(0)) <= most)
    games, seen = cut(size.where("game_id is not null").join(rows.hint("merge"), "game_id", "left").select("game_id", few.alias("_few")),
                      wide=F.count_if(~F.col("_few")))
    small, wide = (games.where(c).select("game_id").hint("merge") for c in ("_few", "not _few"))
    kids = children.join(small, "game_id", "left_semi").groupBy("game_id").agg(F.collect_list(F.struct(
        F.col("child_id").alias("child"), "degree", F.col("coeff").cast("string").alias("coeff"))).alias("kids"))
    mine = states.join(small, "game_id", "left_semi") if seen["wide"] else states.where("game_id is not null")
    listed = mine.groupBy("game_id").agg(F.collect_list(F.struct(*cells)).alias("states")).join(
        kids.hint("merge"), "game_id", "left").select("game_id", "states", "kids")
    if not seen["wide"]:
        return listed, None, None
    return listed, states.join(wide, "game_id", "left_semi"), children.join(wide, "game_id", "left_semi")


def child_products(states: DataFrame, children: DataFrame) -> DataFrame:
    """(game_id, members, degree, coeff): product of the polynomials ``children(game_id, child_id,
    degree, coeff)`` over the members of each state.

    Games of at most 2^``LISTED`` states and as many rows of children, all of at most ``LISTED`` owners among them, are worked out
    one by one in whole numbers: their states are shuffled by game only. The others are joined member by member.
    """
    ship_package(states.sparkSession)
    kind = states.schema["game_id"].dataType.simpleString()
    listed, rest, kids = _split_states(cut(states.select("game_id", "members").distinct()), children)
    found = listed.mapInArrow(_listed_products, f"game_id {kind}, members array<bigint>, degree bigint, coeff {WHOLE}")
    return found if rest is None else found.unionByName(_joined_products(rest, kids))


def expression_polynomial(states: DataFrame, children: DataFrame) -> DataFrame:
    """(game_id, degree, coeff): the function with the children's polynomials put in.

    The products (see :func:`child_products`) of a game that fits a row are summed up where they are made, so neither they nor the
    states' coefficients are shuffled again.
    """
    ship_package(states.sparkSession)
    kind = states.schema["game_id"].dataType.simpleString()
    states = cut(states.select("game_id", "members", F.col("coeff").cast("string").alias("coeff")))
    listed, rest, kids = _split_states(states, children)
    found = listed.mapInArrow(_listed_sums, f"game_id {kind}, degree bigint, coeff {WHOLE}")
    if rest is None:
        return found
    weight = rest.select("game_id", "members", _whole(F.col("coeff")).alias("_w"))
    return found.unionByName(_joined_products(rest, kids).join(weight.hint("merge"), ["game_id", "members"]).groupBy("game_id", "degree").agg(
        _total(_times(F.col("coeff"), F.col("_w"))).alias("coeff")).where("coeff <> 0"))


def _game_interaction(a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owners, states as masks, coefficients) of the AND of two functions of one game, each given as (members of all states, how many
    each state has, coefficients): values of all coalitions are multiplied, and differences give the coefficients back."""
    owners = np.unique(np.concatenate([a[0], b[0]]))
    product = np.ones(1 << len(owners), np.int64)
    for flat, lengths, coeff in (a, b):
        state = np.repeat(np.arange(len(lengths)), lengths)
        masks = np.bincount(state, weights=np.left_shift(1, np.searchsorted(owners, flat)), minlength=len(lengths)).astype(np.int64)
        table = np.zeros(1 << len(owners), np.int64)
        np.add.at(table, masks, coeff)
        for i in range(len(owners)):
            table.reshape(-1, 2, 1 << i)[:, 1] += table.reshape(-1, 2, 1 << i)[:, 0]
        product *= table
    for i in range(len(owners)):
        product.reshape(-1, 2, 1 << i)[:, 1] -= product.reshape(-1, 2, 1 << i)[:, 0]
    states = np.flatnonzero(product)
    return owners, states, product[states]


def _listed_interactions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, 64):
            part, sides = batch.slice(start, 64), []
            for column in part.columns[1:]:
                states = column.flatten()
                members, ends = states.field("members"), np.concatenate([[0], np.cumsum(np.diff(column.offsets.to_numpy()))])
                lengths = np.diff(members.offsets.to_numpy())
                cells = np.concatenate([[0], np.cumsum(lengths)])
                flat, coeff = members.flatten().to_numpy(zero_copy_only=False), states.field("coeff").to_numpy(zero_copy_only=False)
                sides.append([(flat[cells[i]:cells[j]], lengths[i:j], coeff[i:j]) for i, j in zip(ends[:-1], ends[1:])])
            games, owners, sizes, numbers = [], [], [], []
            for i, (a, b) in enumerate(zip(*sides)):
                who, states, found = _game_interaction(a, b)
                inside, at = np.nonzero((states[:, None] >> np.arange(len(who))) & 1)
                games.append(np.full(len(states), i))
                owners.append(who[at])
                sizes.append(np.bincount(inside, minlength=len(states)))
                numbers.append(found)
            ends = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(pa.array(np.concatenate(games))), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(owners), pa.int64())),
                 pa.array(np.concatenate(numbers), pa.int64())], ["game_id", "members", "coeff"])


def interaction_states(a: DataFrame, b: DataFrame) -> DataFrame:
    """The union states of the AND of two functions.

    Games of at most ``LISTED`` owners in both and of small coefficients are worked out row by row: the states of both are shuffled by
    game, their pairs are not. The others are joined by :func:`_joined_interactions`.
    """
    ship_package(a.sparkSession)
    kind = a.schema["game_id"].dataType.simpleString()
    a, b = (cut(x.where("game_id is not null").select("game_id", "members", _whole(F.col("coeff")).alias("coeff"))) for x in (a, b))
    owners = a.select("game_id", F.explode_outer("members").alias("o")).unionByName(
        b.select("game_id", F.explode_outer("members").alias("o"))).distinct().groupBy("game_id").agg(F.count("o").alias("_owners"))
    # 2^10 coalitions of values below 2^20 · 2^20 stay far below 2^63
    size = owners
    for k, side in (("_a", a), ("_b", b)):
        size = size.join(side.groupBy("game_id").agg(F.sum(F.abs("coeff").cast("double")).alias(k)).hint("merge"), "game_id")
    few = (F.col("_owners") <= LISTED) & (F.col("_a") <= 1 << 20) & (F.col("_b") <= 1 << 20)
    games, seen = cut(size.select("game_id", few.alias("_few")), wide=F.count_if(~F.col("_few")))
    mine, wide = (a, b), None
    if seen["wide"]:
        small, large = (games.where(c).select("game_id").hint("merge") for c in ("_few", "not _few"))
        mine = tuple(x.join(small, "game_id", "left_semi") for x in (a, b))
        wide = _joined_interactions(*(x.join(large, "game_id", "left_semi") for x in (a, b)))
    left, right = (x.groupBy("game_id").agg(F.collect_list(F.struct("members", F.col("coeff").cast("bigint").alias("coeff"))).alias(k))
                   for k, x in zip(("_left", "_right"), mine))
    found = left.join(right.hint("merge"), "game_id").select("game_id", "_left", "_right").mapInArrow(
        _listed_interactions, f"game_id {kind}, members array<bigint>, coeff bigint").withColumn("coeff", _whole(F.col("coeff")))
    return found if wide is None else found.unionByName(wide)


def _joined_interactions(a: DataFrame, b: DataFrame) -> DataFrame:
    """:func:`interaction_states` of games of any size. The states of ``a`` are dealt over parts, each of which has those of ``b``."""
    other = _over_parts(b.select("game_id", F.col("members").alias("_m"), F.col("coeff").alias("_c")), F.lit(PARTS))
    mine = a.withColumn("_part", _part(F.col("members"), F.lit(PARTS)))
    return mine.join(other.hint("merge"), ["game_id", "_part"]).groupBy("game_id", S.union(F.col("members"), F.col("_m")).alias("members")).agg(
        _total(_times(F.col("coeff"), F.col("_c"))).alias("coeff")).where("coeff <> 0")


def interaction_polynomial(a: DataFrame, b: DataFrame, children: DataFrame) -> DataFrame:
    """The polynomial of the AND of two functions, given the union states of both."""
    return expression_polynomial(interaction_states(a, b), children)
