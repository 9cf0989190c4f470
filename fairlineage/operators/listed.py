"""Games of few owners, one row each: all their 2^n coalitions fit an array, so nothing but their terms is shuffled."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import cut, ship_package

LISTED = 10           # a game of so few owners has at most 2^10 states and C(10, 5) terms, which are worked out in one row
CELLS = 1 << 16       # states that a task holds at once of such games


def split_games(dnf: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(games, rest): ``games(game_id, terms)`` of at most ``LISTED`` owners; the terms of all others, None if there are none.

    ``dnf`` is read twice; owners are counted in a table of their own, so that terms are shuffled once, by game.
    """
    owners = dnf.select("game_id", F.explode_outer("term").alias("o")).distinct().groupBy("game_id").agg(F.count("o").alias("_owners"))
    counted, seen = cut(owners, wide=F.count_if(F.col("_owners") > LISTED))
    few, many = dnf.select("game_id", "term"), None
    if seen["wide"]:
        wide = counted.where(F.col("_owners") > LISTED).select(F.col("game_id").alias("_g")).hint("merge")
        few, many = (few.join(wide, F.col("game_id").eqNullSafe(F.col("_g")), how) for how in ("left_anti", "left_semi"))
    return few.groupBy("game_id").agg(F.collect_set("term").alias("terms")), many


def _halves(f: np.ndarray, n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each owner the cells of all coalitions without it and with it."""
    for i in range(n):
        half = f.reshape(len(f), -1, 2, 1 << i)
        yield half[:, :, 0], half[:, :, 1]


def differences(f: np.ndarray, n: int) -> np.ndarray:
    """Coefficients of the function as a sum over unions: f is 1 above a term, and for each owner the value without it is
    taken from the one with it."""
    for without, with_ in _halves(f, n):
        with_ |= without
    for without, with_ in _halves(f, n):
        with_ -= without
    f[:, 0] = 0
    return f


def least_terms(f: np.ndarray, n: int) -> np.ndarray:
    """1 for the terms of which no proper subset is a term: of their subsets only they themselves are terms."""
    subsets = f.copy()
    for without, with_ in _halves(subsets, n):
        with_ += without
    return f * (subsets == 1)


def _batch(batch: pa.RecordBatch, solve: Callable[[np.ndarray, int], np.ndarray]) -> Iterator[pa.RecordBatch]:
    """``solve(terms, n)`` of games (game_id, list of terms): the cells that are not 0, with their coalitions. ``terms``
    has a row per game and a cell per coalition of its n owners, 1 for each term. All in whole numbers."""
    terms = batch.column(1)
    of_term, flat = terms.flatten(), terms.flatten().flatten().to_numpy(zero_copy_only=False)
    term_game = np.repeat(np.arange(batch.num_rows), np.diff(terms.offsets.to_numpy()))
    lengths = np.diff(of_term.offsets.to_numpy())
    value_term = np.repeat(np.arange(len(lengths)), lengths)
    pairs, place = np.unique(np.stack([term_game[value_term], flat]), axis=1, return_inverse=True)
    owners, first = pairs[1], np.searchsorted(pairs[0], np.arange(batch.num_rows + 1))
    local = place.ravel() - first[term_game[value_term]]
    masks = np.bincount(value_term, weights=np.left_shift(1, local), minlength=len(lengths)).astype(np.int64)
    players = np.diff(first)
    for n in np.unique(players):
        every = np.flatnonzero(players == n)
        for start in range(0, len(every), max(1, CELLS >> n)):
            games = every[start:start + max(1, CELLS >> n)]
            row = np.full(batch.num_rows, -1)
            row[games] = np.arange(len(games))
            mine = row[term_game] >= 0
            f = np.zeros((len(games), 1 << n), np.int64)
            f[row[term_game[mine]], masks[mine]] = 1
            f = solve(f, n)
            at, state = np.nonzero(f)
            inside, who = np.nonzero((state[:, None] >> np.arange(n)) & 1)
            ends = np.concatenate([[0], np.cumsum(np.bincount(inside, minlength=len(state)))]).astype(np.int32)
            members = pa.ListArray.from_arrays(pa.array(ends), pa.array(owners[first[games[at[inside]]] + who], pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(games[at])), members, pa.array(f[at, state])], ["game_id", "members", "coeff"])


def solved(games: DataFrame, solve: Callable[[np.ndarray, int], np.ndarray]) -> DataFrame:
    """(game_id, members, coeff): the cells of ``games(game_id, terms)`` that ``solve`` leaves, row by row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                yield from _batch(pa.RecordBatch.from_arrays(
                    [pa.concat_arrays([c.slice(start, 1024)]) for c in batch.columns], names=["game_id", "terms"]), solve)

    ship_package(games.sparkSession)
    kind = games.schema["game_id"].dataType.simpleString()
    return games.select("game_id", "terms").mapInArrow(run, f"game_id {kind}, members array<bigint>, coeff bigint")
