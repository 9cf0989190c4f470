"""Named join plans."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class JoinStep:
    """``large``: both sides grow with the data, so both are shuffled. Small compressed files would have one of them sent through the driver."""

    table: str
    left_keys: tuple[str, ...]
    right_keys: tuple[str, ...]
    how: str = "inner"
    large: bool = False


@dataclass(frozen=True)
class JoinPlan:
    init_table: str
    steps: tuple[JoinStep, ...]

    @property
    def tables(self) -> tuple[str, ...]:
        return (self.init_table, *(s.table for s in self.steps))


def _step(table: str, left: str, right: str, how: str = "inner", large: bool = False) -> JoinStep:
    return JoinStep(table, tuple(left.split()), tuple(right.split()), how, large)


_PLANS: dict[str, JoinPlan] = {}


def register(name: str, plan: JoinPlan) -> JoinPlan:
    _PLANS[name] = plan
    return plan


def plan_for(dataset: str) -> JoinPlan:
    if dataset not in _PLANS:
        raise KeyError(f"no join plan for data set {dataset!r}; known: {sorted(_PLANS)}")
    return _PLANS[dataset]


def plan_names() -> list[str]:
    return sorted(_PLANS)


# The join chains of the two data sets. A left key has the name it carries after the
# earlier steps (a joined left key takes the name of the right key).
register("tpch", JoinPlan("region", (
    _step("nation", "r_regionkey", "n_regionkey"),
    _step("supplier", "n_nationkey", "s_nationkey"),
    _step("partsupp", "s_suppkey", "ps_suppkey", large=True),
    _step("part", "ps_partkey", "p_partkey", large=True),
    _step("lineitem", "p_partkey ps_suppkey", "l_partkey l_suppkey", large=True),
    _step("orders", "l_orderkey", "o_orderkey", large=True),
    _step("customer", "o_custkey", "c_custkey", large=True),
)))
register("soccer", JoinPlan("Match", (
    _step("Country", "country_id", "id"),
    _step("HomeTeam", "home_team_api_id", "team_api_id"),
    _step("AwayTeam", "away_team_api_id", "team_api_id", "left"),
    _step("League", "league_id", "id"),
)))

# The tables that get an owner assignment.
ASSIGNED_TABLES = {
    "tpch": ("customer", "lineitem", "nation", "orders", "part", "partsupp", "region", "supplier"),
}
