"""The registered queries as plain SQL over the same tables, with formulas of their own.

Owner sets are 8-bit masks here and values are sums over all 256 coalitions; terms, splits and
modules are found by listing subsets, so a match is evidence and not the same code twice.
"""

from __future__ import annotations

from ..sources.derived import COUNTRY_SQL, LEAGUE_SQL, MATCH_SQL, TEAM_SQL
from ..sources.samples import OWNERS, ROW_KEYS

SQL: dict[str, str] = {}


def _copies(key: str, salt: int) -> str:
    share = f"((({key}) * 37 + {salt}) % 100)"
    return f"(CASE WHEN {share} < 85 THEN 1 WHEN {share} < 95 THEN 2 WHEN {share} < 98 THEN 3 ELSE 4 END)"


def _owner(key: str, salt: int, j: int, owners: int = OWNERS) -> str:
    return f"((({key}) * 5 + {salt} + 3 * {j}) % {owners})"


def _mask(key: str, salt: int) -> str:
    return "(" + " | ".join(
        f"(CASE WHEN {_copies(key, salt)} > {j} THEN (1::BIGINT << ({_owner(key, salt, j)})::INT) ELSE 0 END)"
        for j in range(4)) + ")"


def _members(mask: str) -> str:
    return f"list_filter(range({OWNERS}), lambda i: (({mask} >> i::INT) & 1) = 1)"


def _text(mask: str) -> str:
    return f"(CASE WHEN {mask} = 0 THEN 'TRUE' ELSE array_to_string({_members(mask)}, ' ') END)"


def _least(mask: str) -> str:
    return f"({_members(mask)})[1]"


PARTSUPP = "partsupp AS (SELECT DISTINCT l_partkey AS ps_partkey, l_suppkey AS ps_suppkey FROM lineitem)"
CHAIN = """region JOIN nation ON r_regionkey = n_regionkey JOIN supplier ON n_nationkey = s_nationkey
 JOIN partsupp ON s_suppkey = ps_suppkey JOIN part ON ps_partkey = p_partkey
 JOIN lineitem ON p_partkey = l_partkey AND ps_suppkey = l_suppkey
 JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey"""
MASKS = ", ".join(f"{_mask(k, s)}" for k, s in ROW_KEYS.values())
FAMILIES = f"""{PARTSUPP},
families AS (SELECT family, count(*) AS n FROM (
  SELECT list_sort(list_distinct([{MASKS}])) AS family FROM {CHAIN}) GROUP BY family)"""
_SORTED = (f"list_sort(list_transform(clauses, lambda m: list_concat([bit_count(m)::BIGINT], {_members('m')})))")
TUPLE_GAMES = f"""{FAMILIES},
absorbed AS (SELECT list_sort(list_filter(family, lambda c: len(list_filter(family,
  lambda d: (d & c) = d AND d <> c)) = 0)) AS clauses, n FROM families),
tuple_games AS (SELECT clauses, array_to_string(list_transform({_SORTED}, lambda t: array_to_string(t[2:], ' ')), ' + ')
  AS game_id, sum(n)::BIGINT AS tuples FROM absorbed GROUP BY clauses),
tuple_dnf AS (SELECT game_id, unnest(clauses) AS m FROM tuple_games)"""



def _pairs(owners: int) -> str:
    return "\nUNION ALL\n".join(
        f"SELECT DISTINCT '{t}' AS table_name, ({k})::BIGINT AS row_id, unnest([{', '.join(_owner(k, s, j, owners) for j in range(4))}]"
        f"[1:{_copies(k, s)}])::BIGINT AS owner_id FROM {t}" for t, (k, s) in ROW_KEYS.items())


ASSIGNMENT = f"{PARTSUPP}, assignment AS ({_pairs(OWNERS)})"


def _bit(expression: str) -> str:
    return f"(1::BIGINT << (({expression}) % 8)::INT)"


TRADE_ROWS = """trade_rows AS (SELECT c_custkey AS game_id, (l_suppkey * 5 + 3) % 8 AS a, (l_partkey * 5 + 5) % 8 AS b,
  (o_orderkey * 5 + 7) % 8 AS c FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey)"""


def _minimal(name: str, raw: str) -> str:
    return (f"{name} AS (SELECT DISTINCT game_id, m FROM {raw} x WHERE NOT EXISTS (SELECT 1 FROM {raw} y "
            "WHERE y.game_id = x.game_id AND y.m <> x.m AND (y.m & x.m) = y.m))")


TRADE = f"""{TRADE_ROWS},
trade_raw AS (SELECT DISTINCT game_id, {_bit('a')} | {_bit('b')} | {_bit('c')} AS m FROM trade_rows),
{_minimal('trade', 'trade_raw')}"""
SETS = f"""sets AS (SELECT c_custkey AS game_id, {_bit('c_custkey')} | {_bit('c_custkey + 1')} | {_bit('c_custkey + 3')} AS s
  FROM customer)"""
OTHER = f"""other AS (SELECT c_custkey AS game_id, {_bit('c_custkey * 5')} AS m FROM customer
  UNION SELECT c_custkey, {_bit('c_custkey + 2')} | {_bit('c_custkey + 5')} FROM customer),
{_minimal('other_min', 'other')}"""


def _worth(dnf: str) -> str:
    return f"""distinct_dnf AS (SELECT DISTINCT game_id, m FROM {dnf}),
worth AS (SELECT game_id, s, max(CASE WHEN (m & s) = m THEN 1 ELSE 0 END) AS v
  FROM distinct_dnf, (SELECT unnest(range(256)) AS s) GROUP BY game_id, s),
players AS (SELECT DISTINCT game_id, i FROM distinct_dnf, (SELECT unnest(range(8)) AS i) WHERE ((m >> i::INT) & 1) = 1)"""


# every owner counts as a player of an 8-player game; those outside the game change nothing
_SV = """SELECT p.game_id, p.i AS owner_id,
  sum(factorial((bit_count(a.s) - 1)::INT)::DOUBLE * factorial((8 - bit_count(a.s))::INT)::DOUBLE
      / factorial(8)::DOUBLE * (a.v - b.v)) AS sv
FROM players p JOIN worth a ON a.game_id = p.game_id AND ((a.s >> p.i::INT) & 1) = 1
JOIN worth b ON b.game_id = a.game_id AND b.s = a.s - (1::BIGINT << p.i::INT) GROUP BY p.game_id, p.i"""


def _shapley(ctes: str, dnf: str) -> str:
    return f"WITH {ctes}, {_worth(dnf)}, sv AS ({_SV}) SELECT game_id, owner_id, round(sv, 6) AS sv FROM sv"


TRADE_SV = _shapley(TRADE, "trade")
TUPLE_SV = _shapley(TUPLE_GAMES, "tuple_dnf")

# totals straight from the families: a coalition wins a tuple if it meets every set of its family
TOTAL = f"""{FAMILIES},
judged AS (SELECT s, sum(n * CASE WHEN len(list_filter(family, lambda m: (m & s) = 0)) = 0 THEN 1 ELSE 0 END)::DOUBLE AS v
  FROM families, (SELECT unnest(range(256)) AS s) GROUP BY s),
total AS (SELECT i AS owner_id, sum(factorial((bit_count(a.s) - 1)::INT)::DOUBLE * factorial((8 - bit_count(a.s))::INT)::DOUBLE
      / factorial(8)::DOUBLE * (a.v - b.v)) AS sv
  FROM (SELECT unnest(range(8)) AS i) JOIN judged a ON ((a.s >> i::INT) & 1) = 1
  JOIN judged b ON b.s = a.s - (1::BIGINT << i::INT) GROUP BY i)"""
TOTAL_SV = f"WITH {TOTAL} SELECT owner_id, round(sv, 4) AS sv FROM total"

MATCHES = f"""matches AS ({MATCH_SQL}), team AS ({TEAM_SQL}), country AS ({COUNTRY_SQL}), league AS ({LEAGUE_SQL}),
clean_team AS (SELECT team_api_id, TRY_CAST(TRY_CAST(team_fifa_api_id AS DOUBLE) AS BIGINT) AS team_fifa_api_id,
  team_long_name FROM team),
star AS (SELECT m.*, h.team_fifa_api_id, h.team_long_name, w.team_fifa_api_id AS away_fifa, w.team_long_name AS away_name,
  c.name, l.name AS league_name
  FROM matches m JOIN country c ON m.country_id = c.id JOIN clean_team h ON home_team_api_id = h.team_api_id
  JOIN clean_team w ON away_team_api_id = w.team_api_id JOIN league l ON league_id = l.id),
won AS (SELECT *, CASE WHEN coalesce(home_team_goal, -99) > coalesce(away_team_goal, -99) THEN team_long_name
  WHEN coalesce(home_team_goal, -99) < coalesce(away_team_goal, -99) THEN away_name ELSE 'DRAW' END AS winner FROM star)"""
MATCH_GAMES = f"""{MATCHES},
match_raw AS (SELECT DISTINCT winner AS game_id, list_sort(list_distinct(list_filter([match_api_id, home_team_api_id,
  away_team_api_id, team_fifa_api_id, away_fifa], lambda x: x IS NOT NULL))) AS t
  FROM won WHERE season = '2015/2016' AND winner <> 'DRAW'),
match_games AS (SELECT game_id, t FROM match_raw x WHERE NOT EXISTS (SELECT 1 FROM match_raw y
  WHERE y.game_id = x.game_id AND len(y.t) < len(x.t) AND list_has_all(x.t, y.t)))"""


def _hash_draw(text: str) -> str:
    return f"(('0x' || substr(md5({text}), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0)"


# --- sources and sinks

SQL["csv_scan"] = "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer"
_COLUMNS = {"region": 2, "nation": 3, "supplier": 4, "customer": 5, "part": 6, "orders": 6, "lineitem": 11, "partsupp": 2}
SQL["folder_scan"] = f"WITH {PARTSUPP} " + " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, count(*) AS rows, {n}::BIGINT AS columns FROM {t}" for t, n in _COLUMNS.items())
SQL["row_index_attach"] = f"WITH {PARTSUPP} " + " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, ({k})::BIGINT AS row_key, ({k})::BIGINT AS row_id FROM {t}" for t, (k, _) in ROW_KEYS.items())
SQL["assignment_json_scan"] = f"WITH {ASSIGNMENT} SELECT DISTINCT * FROM assignment"
SQL["dataset_load_with_assignment"] = f"WITH {PARTSUPP} " + " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, ({k})::BIGINT AS row_id, {_text(_mask(k, s))} AS owners FROM {t}" for t, (k, s) in ROW_KEYS.items())
SQL["dataset_load_without_assignment"] = f"""WITH {PARTSUPP} SELECT r_name, n_name, s_name, p_name, c_name, l_linenumber,
  s_suppkey, ps_partkey, l_orderkey, o_custkey, o_orderpriority, false AS has_assignment FROM {CHAIN}"""
SQL["owner_universe"] = f"WITH {ASSIGNMENT} SELECT DISTINCT owner_id FROM assignment"
SQL["result_json_sink"] = f"""WITH {TOTAL} SELECT 'iusv' AS method, (SELECT count(*) FROM total) AS num_of_owners, owner_id,
  round(sv, 4) AS sv FROM total"""
SQL["assignment_sink"] = f"WITH {ASSIGNMENT} SELECT DISTINCT * FROM assignment"
_CELLS = {
    "region": "r_regionkey, r_name", "nation": "n_nationkey, n_name, n_regionkey",
    "supplier": "s_suppkey, s_name, s_nationkey, #s_acctbal",
    "customer": "c_custkey, c_name, c_nationkey, #c_acctbal, c_mktsegment", "partsupp": "ps_partkey, ps_suppkey",
    "part": "p_partkey, p_name, p_brand, p_type, p_size, #p_retailprice",
    "orders": "o_orderkey, o_custkey, o_orderstatus, #o_totalprice, o_orderdate, o_orderpriority",
    "lineitem": "l_orderkey, l_partkey, l_suppkey, l_linenumber, #l_quantity, #l_extendedprice, #l_discount, #l_tax, "
                "l_returnflag, l_linestatus, l_shipdate"}


def _cell(name: str) -> str:
    return f"round({name[1:]} * 100)::BIGINT::VARCHAR" if name.startswith("#") else f"{name}::VARCHAR"


SQL["delimited_scan"] = f"WITH {PARTSUPP} " + " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, ({k})::BIGINT AS row_key, md5(concat_ws('|', {', '.join(_cell(c) for c in _CELLS[t].split(', '))})) "
    f"AS cells FROM {t}" for t, (k, _) in ROW_KEYS.items())
SQL["text_row_id"] = ("SELECT concat_ws('|', c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment) || '|customer.' || "
                      "row_number() OVER (ORDER BY c_custkey) AS line FROM customer")
SQL["soccer_cleanup"] = f"""WITH {MATCHES} SELECT team_api_id, team_fifa_api_id, team_long_name,
  team_fifa_api_id AS away_fifa_api_id FROM clean_team"""

# --- owner assignment

SQL["zipf_weights"] = ("SELECT s_suppkey AS i, round(pow(s_suppkey, -3.0) / (SELECT sum(pow(s_suppkey, -3.0)) FROM supplier), 9) "
                       "AS weight FROM supplier")
_BUCKETS = """n AS (SELECT count(*) AS n FROM {t}), c AS (SELECT unnest(range(1, 5)) AS copies),
f AS (SELECT copies, floor(n * pow(copies, -3.0) / (SELECT sum(pow(copies, -3.0)) FROM c))::BIGINT AS r, n FROM c, n),
g AS (SELECT copies, CASE WHEN copies = 1 THEN r + n - (SELECT sum(r) FROM f) ELSE r END::BIGINT AS records FROM f),
buckets AS (SELECT copies, records, (sum(records) OVER (ORDER BY copies) - records)::BIGINT AS first,
  (sum(records) OVER (ORDER BY copies))::BIGINT AS last FROM g)"""
SQL["copy_buckets"] = f"WITH {_BUCKETS.format(t='lineitem')} SELECT * FROM buckets"
SQL["copies_per_record"] = (f"WITH {_BUCKETS.format(t='orders')} SELECT copies, records, first AS first_row FROM buckets "
                            "WHERE records > 0")


def _table_owners(quota: str) -> str:
    rows = " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n FROM {t}" for t in ROW_KEYS)
    return f"""WITH {PARTSUPP}, t AS ({rows}), k AS (SELECT count(DISTINCT owner_id) AS k FROM ({_pairs(500)})),
drawn AS (SELECT table_name, n, o AS owner_id, row_number() OVER (PARTITION BY table_name ORDER BY
  {_hash_draw("concat_ws('|', '0', 'owner', table_name, o)")}, o) AS place
  FROM t, (SELECT unnest(range((SELECT k FROM k))) AS o)),
taken AS (SELECT * FROM drawn, k WHERE place <= {quota})
SELECT table_name, place, owner_id, n // count(*) OVER (PARTITION BY table_name) AS records_each FROM taken"""


SQL["owners_of_tables_equal"] = _table_owners("(CASE WHEN table_name IN ('region', 'nation') THEN 5 ELSE k END)")
SQL["owners_of_tables_unequal"] = _table_owners(
    "(CASE WHEN table_name IN ('region', 'nation') THEN 5 WHEN table_name = 'lineitem' THEN k ELSE 10 END)")


def _floyd() -> str:
    """Four draws without repetition, written out."""
    steps, taken = [], []
    for j in range(1, 5):
        end = f"(50 - copies + {j})"
        pick = f"(floor({_hash_draw(f'''concat_ws('|', '1', 'place-part', row_id, {j})''')} * {end})::BIGINT + 1)"
        used = " OR ".join(f"{pick} = p{i}" for i in range(1, j)) or "false"
        steps.append(f"s{j} AS (SELECT *, CASE WHEN copies < {j} THEN NULL WHEN {used} THEN {end} ELSE {pick} END AS p{j} "
                     f"FROM {'s' + str(j - 1)})")
        taken.append(f"p{j}")
    return (f"WITH s0 AS (SELECT p_partkey AS row_id, p_partkey % 4 + 1 AS copies FROM part), {', '.join(steps)} "
            + " UNION ALL ".join(f"SELECT row_id, {p} AS place FROM s4 WHERE {p} IS NOT NULL" for p in taken))


SQL["uniform_record_owners"] = _floyd()


def _weighted() -> str:
    """Up to three draws, each a point on the line of places with those taken cut out."""
    u = lambda j: _hash_draw(f"concat_ws('|', '1', 'weight-part', row_id, {j})")
    at = "JOIN line l{j} ON x{j} >= l{j}.lo AND x{j} < l{j}.top"
    skip = "(CASE WHEN {x} >= {p}.lo THEN ({x} - {p}.lo) + {p}.hi ELSE {x} END)"
    low, high = "least({'lo': a.lo, 'hi': a.hi}, {'lo': b.lo, 'hi': b.hi})", "greatest({'lo': a.lo, 'hi': a.hi}, {'lo': b.lo, 'hi': b.hi})"
    return f"""WITH raw AS (SELECT unnest(range(1, 51)) AS i), w AS (SELECT i, pow(i, -3.0) / (SELECT sum(pow(i, -3.0)) FROM raw) AS weight FROM raw),
cum AS (SELECT i, weight, sum(weight) OVER (ORDER BY i ROWS UNBOUNDED PRECEDING) AS hi FROM w),
line AS (SELECT i, hi - weight AS lo, hi, CASE WHEN i = 50 THEN 2.0 ELSE hi END AS top FROM cum),
records AS (SELECT p_partkey AS row_id, p_partkey % 3 + 1 AS copies FROM part),
one AS (SELECT row_id, copies, {{'lo': l1.lo, 'hi': l1.hi}} AS a, l1.i AS p1 FROM (SELECT *, {u(1)} AS x1 FROM records) {at.format(j=1)}),
two AS (SELECT row_id, copies, a, p1, {{'lo': l2.lo, 'hi': l2.hi}} AS b, l2.i AS p2 FROM (
  SELECT *, {skip.format(x='y', p='a')} AS x2 FROM (SELECT *, {u(2)} * (1 - (a.hi - a.lo)) AS y FROM one WHERE copies >= 2)) {at.format(j=2)}),
three AS (SELECT row_id, l3.i AS p3 FROM (
  SELECT *, {skip.format(x='z', p='q')} AS x3 FROM (SELECT *, {skip.format(x='y', p='p')} AS z FROM (
    SELECT *, {low} AS p, {high} AS q, {u(3)} * (1 - (((a.hi - a.lo) + b.hi) - b.lo)) AS y FROM two WHERE copies >= 3))) {at.format(j=3)})
SELECT row_id, p1 AS place FROM one UNION ALL SELECT row_id, p2 FROM two UNION ALL SELECT row_id, p3 FROM three"""


SQL["weighted_record_owners"] = _weighted()
SQL["starved_owner_repair"] = """WITH pairs AS (SELECT s_suppkey AS row_id, s_suppkey % 3 AS owner_id FROM supplier),
starved AS (SELECT n_nationkey::BIGINT AS new_owner, row_number() OVER (ORDER BY n_nationkey) AS pos FROM nation
  WHERE n_nationkey NOT IN (SELECT owner_id FROM pairs)),
offers AS (SELECT owner_id, row_id, row_number() OVER (ORDER BY r, owner_id) AS pos FROM (
  SELECT owner_id, row_id, row_number() OVER (PARTITION BY owner_id ORDER BY row_id) AS r, count(*) OVER (PARTITION BY owner_id) AS n
  FROM pairs) WHERE r < n)
SELECT p.row_id, coalesce(new_owner, p.owner_id) AS owner_id FROM pairs p LEFT JOIN (
  SELECT row_id, owner_id, new_owner FROM offers JOIN starved USING (pos)) m ON m.row_id = p.row_id AND m.owner_id = p.owner_id"""
SQL["row_id_shuffle"] = f"""SELECT row_number() OVER (ORDER BY {_hash_draw("concat_ws('|', '1', 'shuffle-part', p_partkey)")},
  p_partkey) - 1 AS pos, p_partkey AS row_id FROM part"""
SQL["owner_record_counts"] = f"""WITH {ASSIGNMENT} SELECT table_name, owner_id, count(DISTINCT row_id) AS records
  FROM assignment GROUP BY table_name, owner_id"""
SQL["owners_per_table"] = f"""WITH {ASSIGNMENT} SELECT table_name, count(DISTINCT owner_id) AS owners
  FROM assignment GROUP BY table_name"""

# --- joins

SQL["tpch_chain_join"] = f"""WITH {PARTSUPP} SELECT l_suppkey, l_partkey, o_orderkey, c_custkey, s_nationkey, n_name,
  l_linenumber, l_quantity FROM {CHAIN}"""
SQL["joined_row_ids"] = f"""WITH {PARTSUPP} SELECT {', '.join(f'({k})::BIGINT AS row_{t}' for t, (k, _) in ROW_KEYS.items())}
  FROM {CHAIN}"""
SQL["soccer_star_join"] = f"""WITH {MATCHES} SELECT match_api_id, home_team_api_id, away_team_api_id, name, league_name,
  team_fifa_api_id, away_name, season FROM star"""
SQL["soccer_left_join"] = f"""WITH {MATCHES} SELECT match_api_id, away_team_api_id AS last_team_key,
  h.team_long_name AS team_long_name, w.team_long_name AS away_name
  FROM matches m JOIN country c ON m.country_id = c.id JOIN clean_team h ON home_team_api_id = h.team_api_id
  LEFT JOIN clean_team w ON away_team_api_id = w.team_api_id JOIN league l ON league_id = l.id"""
SQL["joined_tuples_distinct"] = """SELECT DISTINCT l_orderkey AS o_orderkey, l_suppkey, o_custkey AS c_custkey, c_nationkey
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey"""
SQL["lineage_lookup"] = f"WITH {PARTSUPP}, joined AS (SELECT * FROM {CHAIN})" + " UNION ALL ".join(
    f" SELECT '{t}' AS table_name, o AS owner_id, count(*) AS tuples FROM joined, (SELECT unnest(range(8)) AS o) "
    f"WHERE (({_mask(k, s)} >> o::INT) & 1) = 1 GROUP BY o" for t, (k, s) in ROW_KEYS.items())
SQL["lineage_owner_counts"] = SQL["lineage_lookup"]
SQL["unmatched_row_check"] = f"""WITH {PARTSUPP} SELECT 'supplier' AS table_name, s_suppkey AS row_id, count(*) AS tuples
  FROM {CHAIN} WHERE s_suppkey % 10 = 0 GROUP BY s_suppkey"""
SQL["tuple_lineage"] = f"""WITH {FAMILIES} SELECT array_to_string(list_sort(list_transform(family, lambda m: {_text('m')})), ' | ')
  AS family, n AS tuples FROM families"""

# --- columns, predicates, scalar functions

SQL["match_winner"] = f"WITH {MATCHES} SELECT match_api_id, winner FROM won"
SQL["season_filter"] = f"WITH {MATCHES} SELECT match_api_id, season FROM won WHERE season = '2015/2016'"
SQL["season_filter_without_draws"] = f"""WITH {MATCHES} SELECT match_api_id, winner FROM won
  WHERE season = '2015/2016' AND winner <> 'DRAW'"""
SQL["owner_columns_by_name"] = f"""WITH {MATCHES} SELECT match_api_id, concat_ws(',', coalesce(away_team_api_id::VARCHAR, '-'),
  coalesce(home_team_api_id::VARCHAR, '-'), match_api_id::VARCHAR, coalesce(team_fifa_api_id::VARCHAR, '-'),
  coalesce(away_fifa::VARCHAR, '-')) AS owner_cells FROM won"""
SQL["games_in_winner_order"] = f"""WITH {MATCHES} SELECT winner, count(*) AS matches FROM won
  WHERE season = '2015/2016' AND winner <> 'DRAW' GROUP BY winner ORDER BY winner"""
SQL["owner_cell_cast"] = """SELECT s_suppkey, array_to_string(list_sort(list_distinct(list_filter([s_suppkey, s_nationkey::BIGINT,
  CASE WHEN s_suppkey % 2 = 0 THEN (4294967296 - s_suppkey) % 4294967296 END], lambda x: x IS NOT NULL))), ' ') AS owners FROM supplier"""
_SET_PAIRS = f"""p AS (SELECT o_orderkey, {_bit('o_orderkey')} | {_bit('o_orderkey + 3')} | {_bit('o_orderkey * 5 + 1')} AS a,
  {_bit('o_custkey')} | {_bit('o_custkey + 1')} AS b FROM orders)"""
SQL["set_algebra"] = f"""WITH {_SET_PAIRS} SELECT o_orderkey, {_text('(a | b)')} AS set_union,
  array_to_string({_members('(a & b)')}, ' ') AS set_intersection,
  array_to_string({_members('(a & (255 - b))')}, ' ') AS set_difference FROM p"""
SQL["set_predicates"] = f"""WITH {_SET_PAIRS} SELECT o_orderkey, (a & b) <> 0 AS overlaps, (a & b) = b AS is_subset,
  (a & b) = a AS is_superset, (a & 8) <> 0 AS has_three, bit_count(a)::BIGINT AS members, bit_count(b) = 1 AS is_single,
  a = b AS same FROM p"""
SQL["binomials"] = """WITH p AS (SELECT DISTINCT l_quantity::BIGINT AS n, l_linenumber::BIGINT AS k FROM lineitem)
SELECT n, k, CASE WHEN k > n THEN 0 ELSE coalesce((SELECT round(product(greatest(n - k + j, 1)::DOUBLE / j))::BIGINT
  FROM (SELECT unnest(range(1, 60)) AS j) WHERE j <= k), 1) END AS binom FROM p"""
SQL["binomial_rows"] = """SELECT n_nationkey::BIGINT AS n, k, (factorial(n_nationkey::INT) / (factorial(k::INT)
  * factorial((n_nationkey - k)::INT)))::BIGINT AS binom FROM nation, (SELECT unnest(range(40)) AS k) WHERE k <= n_nationkey"""
SQL["game_text"] = f"""WITH {TRADE} SELECT game_id, string_agg({_text('m')}, ' + ' ORDER BY bit_count(m), {_members('m')}) AS text
  FROM trade GROUP BY game_id"""

# --- aggregation

SQL["grouped_owner_lists"] = f"""WITH {TRADE_ROWS} SELECT game_id, concat_ws(',', a, b, c) AS members, count(*) AS copies
  FROM trade_rows GROUP BY game_id, a, b, c"""
SQL["distinct_owner_sets"] = f"WITH {TRADE} SELECT game_id, {_text('m')} AS term FROM trade_raw"
SQL["smallest_term"] = f"""WITH {TRADE}, r AS (SELECT game_id, m, row_number() OVER (PARTITION BY game_id
  ORDER BY bit_count(m), {_members('m')}) AS r FROM trade) SELECT game_id, {_text('m')} AS term FROM r WHERE r = 1"""
SQL["coalition_utility"] = f"""WITH {TRADE}, {SETS} SELECT s.game_id, {_text('s')} AS members,
  coalesce(max(CASE WHEN (m & s) = m THEN 1 ELSE 0 END), 0)::BIGINT AS value
  FROM sets s LEFT JOIN trade t ON s.game_id = t.game_id GROUP BY s.game_id, s"""
SQL["winning_coalitions_by_size"] = f"""WITH {TRADE}, {_worth('trade')}, all_players AS (SELECT game_id, bit_or(m) AS p
  FROM trade GROUP BY game_id)
SELECT w.game_id, bit_count(s)::BIGINT AS k, count(*) AS winning FROM worth w JOIN all_players a ON a.game_id = w.game_id
WHERE v = 1 AND (s & p) = s GROUP BY w.game_id, bit_count(s)"""
SQL["run_summary"] = f"""WITH {TOTAL} SELECT count(*) AS num_of_owners, true AS both_parts_took_time, true AS parts_make_the_total,
  true AS average_is_per_owner FROM total"""
SQL["value_total_check"] = """SELECT 8::BIGINT AS owners, round(count(*)::DOUBLE, 4) AS total, count(*)::BIGINT AS games FROM lineitem
  JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey"""

# --- games

SQL["tuple_game_clauses"] = f"WITH {TUPLE_GAMES} SELECT game_id, tuples FROM tuple_games"
SQL["tuple_game_terms"] = f"""WITH {TUPLE_GAMES}, hits AS (SELECT game_id, s AS m FROM tuple_games,
  (SELECT unnest(range(1, 256)) AS s) WHERE len(list_filter(clauses, lambda c: (c & s) = 0)) = 0)
SELECT game_id, {_text('m')} AS term FROM hits h WHERE NOT EXISTS (SELECT 1 FROM hits o, (SELECT unnest(range(8)) AS i)
  WHERE o.game_id = h.game_id AND ((h.m >> i::INT) & 1) = 1 AND o.m = h.m - (1::BIGINT << i::INT))"""
SQL["group_game_terms"] = f"WITH {TRADE} SELECT game_id, {_text('m')} AS term FROM trade"
SQL["match_game_terms"] = f"WITH {MATCH_GAMES} SELECT game_id, array_to_string(t, ' ') AS term FROM match_games"
SQL["minimised_terms"] = f"""WITH {TRADE_ROWS}, raw AS (SELECT DISTINCT game_id, unnest([{_bit('a')} | {_bit('b')},
  {_bit('a')} | {_bit('b')} | {_bit('c')}]) AS m FROM trade_rows), {_minimal('least_terms', 'raw')}
SELECT game_id, {_text('m')} AS term FROM least_terms"""
SQL["game_players"] = f"WITH {TRADE}, {_worth('trade')} SELECT game_id, i AS owner_id FROM players"
SQL["game_player_counts"] = f"WITH {TRADE} SELECT game_id, bit_count(bit_or(m))::BIGINT AS owners FROM trade GROUP BY game_id"
SQL["minimal_sets_with_owner"] = f"WITH {TRADE} SELECT game_id, {_text('m')} AS term FROM trade WHERE (m & 8) <> 0"
SQL["games_by_mode"] = f"""WITH {TUPLE_GAMES}, {MATCH_GAMES}
SELECT 'tuple' AS mode, d.game_id, {_text('m')} AS term, tuples FROM tuple_dnf d JOIN tuple_games g ON d.game_id = g.game_id
UNION ALL SELECT 'group', game_id, array_to_string(t, ' '), 1::BIGINT FROM match_games"""
SQL["tuple_shapes"] = f"""WITH {TUPLE_GAMES} SELECT o AS owner_id, sum(tuples)::BIGINT AS appearances FROM tuple_games,
  (SELECT unnest(range(8)) AS o) WHERE len(list_filter(clauses, lambda c: ((c >> o::INT) & 1) = 1)) > 0 GROUP BY o"""

# --- DNF algebra


def _restricted(expression: str, condition: str, minimal: bool = True) -> str:
    """Terms as ``expression`` of (m, s) where ``condition`` holds."""
    raw = (f"WITH {TRADE}, {SETS}, res AS (SELECT DISTINCT t.game_id, {expression} AS m FROM trade t JOIN sets s "
           f"ON s.game_id = t.game_id WHERE {condition})")
    if not minimal:
        return f"{raw} SELECT game_id, {_text('m')} AS term FROM res"
    return f"{raw}, {_minimal('fin', 'res')} SELECT game_id, {_text('m')} AS term FROM fin"


SQL["dnf_kinds"] = f"""WITH {TRADE}, {SETS}, res AS (SELECT DISTINCT t.game_id, (m & (255 - s)) AS m FROM trade t JOIN sets s
  ON s.game_id = t.game_id), {_minimal('fin', 'res')}
SELECT c_custkey AS game_id, coalesce(bool_or(m = 0), false) AS is_true, count(m) = 0 AS is_false,
  count(m) = 1 AND coalesce(max(bit_count(m)), 0) = 1 AS is_variable
FROM customer LEFT JOIN fin ON game_id = c_custkey GROUP BY c_custkey"""
SQL["dnf_evaluate_true"] = f"""WITH {TRADE}, {SETS} SELECT s.game_id, coalesce(bool_or((m & s) = m), false) AS result
  FROM sets s LEFT JOIN trade t ON s.game_id = t.game_id GROUP BY s.game_id"""
SQL["dnf_evaluate_false"] = f"""WITH {TRADE}, {SETS} SELECT s.game_id, coalesce(bool_or((m & s) = 0), false) AS result
  FROM sets s LEFT JOIN trade t ON s.game_id = t.game_id GROUP BY s.game_id"""
SQL["dnf_partial_eval_true"] = _restricted("(m & (255 - s))", "true")
SQL["dnf_partial_eval_false"] = _restricted("m", "(m & s) = 0", False)
SQL["dnf_partial_eval_complement_true"] = _restricted("(m & s)", "true")
SQL["dnf_partial_eval_complement_false"] = _restricted("m", "(m & s) = m", False)
SQL["dnf_touching_terms"] = _restricted("m", "(m & s) <> 0", False)
SQL["dnf_not_touching_terms"] = _restricted("m", "(m & s) = 0", False)
SQL["dnf_contraction"] = _restricted("(m & s)", "(m & s) <> 0")


def _pair_function(rule: str) -> str:
    """Least coalitions that win under ``rule`` of the worths a and b of both functions."""
    return f"""WITH {TRADE}, {OTHER}, coalitions AS (SELECT unnest(range(256)) AS s),
wa AS (SELECT game_id, s, bool_or((m & s) = m) AS v FROM trade, coalitions GROUP BY game_id, s),
wb AS (SELECT game_id, s, bool_or((m & s) = m) AS v FROM other, coalitions GROUP BY game_id, s),
winning AS (SELECT game_id, s AS m FROM (SELECT game_id, s, coalesce(wa.v, false) AS a, wb.v AS b FROM wb LEFT JOIN wa
  USING (game_id, s)) WHERE {rule})
SELECT game_id, {_text('m')} AS term FROM winning h WHERE NOT EXISTS (SELECT 1 FROM winning o,
  (SELECT unnest(range(8)) AS i) WHERE o.game_id = h.game_id AND ((h.m >> i::INT) & 1) = 1
  AND o.m = h.m - (1::BIGINT << i::INT))"""


SQL["dnf_conjunction"] = _pair_function("a AND b")
SQL["dnf_disjunction"] = _pair_function("a OR b")
SQL["dnf_rename_variables"] = f"""WITH {TRADE} SELECT DISTINCT game_id, array_to_string(list_sort(list_distinct(
  list_transform({_members('m')}, lambda i: i // 2))), ' ') AS term FROM trade"""

# --- decomposition

# components: merge overlapping masks until nothing changes (8 owners: at most 8 rounds)
_COMPONENTS = "c0 AS (SELECT game_id, m FROM tuple_dnf), " + ", ".join(
    f"c{i} AS (SELECT x.game_id, bit_or(y.m) AS m FROM c{i - 1} x JOIN c{i - 1} y ON x.game_id = y.game_id "
    f"AND (x.m & y.m) <> 0 GROUP BY x.game_id, x.m)" for i in range(1, 9))
SQL["connected_components"] = f"""WITH {TUPLE_GAMES}, {_COMPONENTS} SELECT DISTINCT game_id, i AS owner_id, {_least('m')} AS part
  FROM c8, (SELECT unnest(range(8)) AS i) WHERE ((m >> i::INT) & 1) = 1"""
SQL["or_split"] = f"""WITH {TUPLE_GAMES}, {_COMPONENTS} SELECT DISTINCT t.game_id, {_least('c.m')} AS part, {_text('t.m')} AS term
  FROM tuple_dnf t JOIN c8 c ON c.game_id = t.game_id AND (c.m & t.m) <> 0"""
SQL["module_test"] = f"""WITH {TRADE}, {SETS} SELECT t.game_id, {_text('s')} AS members,
  count(*) = count(DISTINCT m & s) * count(DISTINCT m & (255 - s)) AS is_module
  FROM trade t JOIN sets s ON s.game_id = t.game_id WHERE (m & s) <> 0 GROUP BY t.game_id, s"""
_CULPRITS = f"""met AS (SELECT t.game_id, s, m, (m & s) AS ins, (m & (255 - s)) AS outs FROM trade t JOIN sets s
  ON s.game_id = t.game_id WHERE (m & s) <> 0),
lacking AS (SELECT DISTINCT a.game_id, a.s, a.ins, b.outs FROM met a JOIN met b ON a.game_id = b.game_id AND NOT EXISTS
  (SELECT 1 FROM met c WHERE c.game_id = a.game_id AND (c.m & (a.ins | b.outs)) = c.m)),
culprit AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY game_id ORDER BY bit_count(ins) + bit_count(outs),
  {_members('ins')}, {_members('outs')}) AS r FROM lacking) WHERE r = 1)"""
SQL["module_culprits"] = f"""WITH {TRADE}, {SETS}, {_CULPRITS} SELECT game_id, {_text('ins')} AS inside, {_text('outs')} AS outside
  FROM culprit"""
SQL["module_closure_step"] = f"""WITH {TRADE}, {SETS}, {_CULPRITS},
rest AS (SELECT t.game_id, c.s, (t.m & (255 - (c.ins | c.outs))) AS x FROM met t JOIN culprit c ON c.game_id = t.game_id),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY game_id ORDER BY bit_count(x), {_members('x')}) AS r
  FROM rest WHERE (x & s) = 0) WHERE r = 1),
tested AS (SELECT game_id, s, count(*) = count(DISTINCT ins) * count(DISTINCT outs) AS ok FROM met GROUP BY game_id, s)
SELECT t.game_id, ok AS is_module, CASE WHEN ok THEN {_text('t.s')} ELSE {_text('(t.s | b.x)')} END AS members
FROM tested t LEFT JOIN best b ON b.game_id = t.game_id"""
# all modules of a game by testing all 255 sets of owners
def _modules(dnf: str) -> str:
    return f"""every AS (SELECT game_id, bit_or(m) AS p FROM {dnf} GROUP BY game_id),
tested AS (SELECT game_id, s, max(p) AS p, count(*) = list_unique(list(m & s)) * list_unique(list(m & (255 - s))) AS ok
  FROM (SELECT game_id, m, bit_or(m) OVER (PARTITION BY game_id) AS p FROM {dnf}) CROSS JOIN range(1, 256) r(s)
  WHERE (s & p) = s AND (m & s) <> 0 GROUP BY game_id, s),
modules AS (SELECT game_id, s, p FROM tested WHERE ok),
strong AS (SELECT * FROM modules x WHERE s <> p AND NOT EXISTS (SELECT 1 FROM modules y WHERE y.game_id = x.game_id
  AND (x.s & y.s) <> 0 AND (x.s & y.s) <> x.s AND (x.s & y.s) <> y.s)),
top AS (SELECT * FROM strong x WHERE NOT EXISTS (SELECT 1 FROM strong y WHERE y.game_id = x.game_id AND y.s <> x.s
  AND (x.s & y.s) = x.s)),
alone AS (SELECT game_id, p AS s, p FROM every WHERE bit_count(p) = 1),
parts AS (SELECT t.game_id, t.m, count(*) AS hit, (SELECT count(*) FROM top z WHERE z.game_id = t.game_id) AS n FROM {dnf} t
  JOIN top x ON x.game_id = t.game_id AND (x.s & t.m) <> 0 GROUP BY t.game_id, t.m),
kind AS (SELECT game_id, CASE WHEN max(hit) = 1 THEN 1 WHEN min(hit) = max(n) THEN 2 ELSE 3 END AS code
  FROM parts GROUP BY game_id)"""


ORDERS = f"""order_raw AS (SELECT DISTINCT l_orderkey AS game_id, {_bit('l_suppkey * 5 + 3')} | {_bit('l_partkey * 5 + 5')} AS m
  FROM lineitem),
{_minimal('order_dnf', 'order_raw')}"""
SQL["module_closure"] = f"""WITH {TUPLE_GAMES}, {_modules("tuple_dnf")}, seeds AS (SELECT game_id, (1::BIGINT << ({_least('p')})::INT)
  | (1::BIGINT << (list_last({_members('p')}))::INT) AS a FROM every WHERE bit_count(p) > 1)
SELECT game_id, {_text('s')} AS members FROM (SELECT m.game_id, s, row_number() OVER (PARTITION BY m.game_id
  ORDER BY bit_count(s)) AS r FROM modules m JOIN seeds q ON q.game_id = m.game_id AND (s & a) = a) WHERE r = 1"""
SQL["twin_owners"] = f"""WITH {TUPLE_GAMES}, o AS (SELECT game_id, i, bit_or(0) AS z, list_sort(list(m)) AS a,
  list_sort(list(m - (1::BIGINT << i::INT))) AS b FROM tuple_dnf, (SELECT unnest(range(8)) AS i)
  WHERE ((m >> i::INT) & 1) = 1 GROUP BY game_id, i)
SELECT game_id, kind, rep, child FROM (
  SELECT game_id, 'and' AS kind, min(i) OVER (PARTITION BY game_id, a) AS rep, i AS child,
    count(*) OVER (PARTITION BY game_id, a) AS n FROM o
  UNION ALL SELECT game_id, 'or', min(i) OVER (PARTITION BY game_id, b), i, count(*) OVER (PARTITION BY game_id, b) FROM o)
WHERE n > 1"""
SQL["maximal_modules"] = f"""WITH {ORDERS}, {_modules('order_dnf')}
SELECT t.game_id, ['or', 'and', 'hybrid'][code] AS kind, {_least('s')} AS module, i AS owner_id FROM top t JOIN kind k ON k.game_id = t.game_id,
  (SELECT unnest(range(8)) AS i) WHERE ((s >> i::INT) & 1) = 1
UNION ALL SELECT game_id, 'var', {_least('s')}, {_least('s')} FROM alone"""
SQL["and_split"] = f"""WITH {ORDERS}, {_modules('order_dnf')}, u AS (SELECT t.game_id, max(code) AS code, max(s) AS s FROM top t
  JOIN kind k ON k.game_id = t.game_id GROUP BY t.game_id, s)
SELECT game_id, {_least('s')} AS module, unnest({_members('s')}) AS owner_id FROM u WHERE code = 2"""
SQL["hybrid_quotient"] = f"""WITH {ORDERS}, {_modules('order_dnf')}, q AS (SELECT t.game_id, t.m, bit_or(1::BIGINT << ({_least('s')})::INT)
  AS q FROM order_dnf t JOIN top x ON x.game_id = t.game_id AND (x.s & t.m) <> 0 JOIN kind k ON k.game_id = t.game_id
  AND code = 3 GROUP BY t.game_id, t.m) SELECT DISTINCT game_id, {_text('q')} AS term FROM q"""
SQL["one_level_parts"] = f"""WITH {ORDERS}, {_modules('order_dnf')} SELECT DISTINCT t.game_id, {_least('s')} AS module,
  {_text('(t.m & s)')} AS term FROM order_dnf t JOIN (SELECT * FROM top UNION ALL SELECT * FROM alone) x
  ON x.game_id = t.game_id AND (x.s & t.m) <> 0"""


def _trees(dnf: str) -> str:
    """Nodes are the modules that overlap no other module; a node's children are the greatest of these inside it."""
    return f"""{_modules(dnf)}, nodes AS (SELECT game_id, s FROM strong UNION SELECT game_id, p FROM every),
kids AS (SELECT a.game_id, a.s, b.s AS c FROM nodes a JOIN nodes b ON b.game_id = a.game_id AND b.s <> a.s AND (a.s & b.s) = b.s
  WHERE NOT EXISTS (SELECT 1 FROM nodes z WHERE z.game_id = a.game_id AND z.s <> a.s AND z.s <> b.s AND (z.s & a.s) = z.s
  AND (z.s & b.s) = b.s)),
hits AS (SELECT k.game_id, k.s, t.m, count(*) AS hit FROM kids k JOIN {dnf} t ON t.game_id = k.game_id AND (t.m & k.c) <> 0
  GROUP BY k.game_id, k.s, t.m),
kinds AS (SELECT h.game_id, h.s, CASE WHEN max(hit) = 1 THEN 'or' WHEN min(hit) = max(n) THEN 'and' ELSE 'hybrid' END AS kind
  FROM hits h JOIN (SELECT game_id, s, count(*) AS n FROM kids GROUP BY game_id, s) USING (game_id, s) GROUP BY h.game_id, h.s
  UNION ALL SELECT game_id, s, 'var' FROM nodes WHERE bit_count(s) = 1)"""


def _tree_name(s: str) -> str:
    return f"CASE WHEN bit_count({s}) = 1 THEN concat('owner:', {_least(s)}) ELSE concat({_least(s)}, '/', bit_count({s})) END"


def _quarters(text: str) -> list[str]:
    return [f"sum(('0x' || substr(md5({text}), {1 + 8 * k}, 8))::BIGINT)::VARCHAR" for k in range(4)]


def _digests(dnf: str) -> str:
    return f"""WITH {_trees(dnf)}, prints AS (SELECT game_id, CASE WHEN max(kind) = 'var' THEN concat('var|', max(i))
  ELSE concat_ws('|', max(kind), count(*), {', '.join(_quarters('i::VARCHAR'))}) END AS print
  FROM kinds, (SELECT unnest(range(8)) AS i) WHERE ((s >> i::INT) & 1) = 1 GROUP BY game_id, s)
SELECT game_id, count(*) AS nodes, md5(concat_ws('|', count(*), {', '.join(_quarters('print'))})) AS digest
FROM prints GROUP BY game_id"""


_TEXTS = "t1 AS (SELECT game_id, s, array_to_string(" + _members("s") + ", ' ') AS text FROM nodes WHERE bit_count(s) = 1), " + ", ".join(
    f"""t{i} AS (SELECT * FROM t{i - 1} UNION ALL SELECT k.game_id, k.s, max(kind) || '[' || array_to_string(list_sort(list(text)), ', ')
  || ']' FROM kids k JOIN t{i - 1} t ON t.game_id = k.game_id AND t.s = k.c JOIN kinds n ON n.game_id = k.game_id AND n.s = k.s
  WHERE bit_count(k.s) = {i} GROUP BY k.game_id, k.s)""" for i in range(2, 9))
SQL["recursive_tree"] = f"""WITH {ORDERS}, {_trees('order_dnf')}
SELECT n.game_id, {_tree_name('n.s')} AS node_id, CASE WHEN k.s IS NOT NULL THEN {_tree_name('k.s')} END AS parent_id, kind,
  CASE WHEN kind = 'var' THEN {_least('n.s')} END AS owner_id
FROM kinds n LEFT JOIN kids k ON k.game_id = n.game_id AND k.c = n.s"""
SQL["recursive_tree_text"] = f"""WITH {ORDERS}, {_trees('order_dnf')}, {_TEXTS}
SELECT t.game_id, text FROM t8 t JOIN every e ON e.game_id = t.game_id AND e.p = t.s"""
SQL["recursive_tree_digest"] = f"WITH {ORDERS}, d AS ({_digests('order_dnf')}) SELECT game_id, nodes, digest FROM d"
RETURNS = f"""return_raw AS (SELECT DISTINCT l_orderkey AS game_id, {_bit('l_suppkey * 5 + 3')}
  | {_bit("l_partkey * 5 + 5 + CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END")} AS m FROM lineitem),
{_minimal('return_dnf', 'return_raw')}"""
SQL["recursive_tree_equality"] = f"""WITH {ORDERS}, {RETURNS}, a AS ({_digests('order_dnf')}), b AS ({_digests('return_dnf')})
SELECT game_id, a.digest = b.digest AS equal FROM a JOIN b USING (game_id)"""
SQL["recursive_tree_expanded"] = f"WITH {ORDERS} SELECT game_id, {_text('m')} AS term FROM order_dnf"

# --- Shapley methods

for _name in ("shapley_exhaustive", "shapley_combination", "shapley_lookup", "shapley_iusv", "shapley_rdsv"):
    SQL[_name] = TRADE_SV
SQL["shapley_rdsv_tuples"] = TUPLE_SV
for _name in ("shapley_rdsv_full_tree", "shapley_ablation_no_horizontal", "shapley_ablation_no_vertical",
              "shapley_ablation_no_hybrid"):
    SQL[_name] = _shapley(ORDERS, "order_dnf")
SQL["shapley_linear"] = f"""WITH {TUPLE_GAMES}, easy AS (SELECT game_id FROM tuple_dnf GROUP BY game_id
  HAVING count_if(bit_count(m) > 1) <= 1), few AS (SELECT * FROM tuple_dnf WHERE game_id IN (SELECT game_id FROM easy)),
  {_worth('few')}, sv AS ({_SV}) SELECT game_id, owner_id, round(sv, 6) AS sv FROM sv"""
SQL["shapley_permutation"] = f"""WITH {TUPLE_GAMES}, {_worth('tuple_dnf')},
arrivals AS (SELECT game_id, i, k, md5(concat_ws('|', game_id, k, i, '1')) AS h FROM players,
  (SELECT unnest(range(1, 1001)) AS k)),
ordered AS (SELECT *, sum(1::BIGINT << i::INT) OVER (PARTITION BY game_id, k ORDER BY h)::BIGINT AS s FROM arrivals),
pivots AS (SELECT o.game_id, o.i, count(*) / 1000.0::DOUBLE AS sv FROM ordered o JOIN worth a ON a.game_id = o.game_id AND a.s = o.s
  JOIN worth b ON b.game_id = o.game_id AND b.s = o.s - (1::BIGINT << o.i::INT) WHERE a.v > b.v GROUP BY o.game_id, o.i)
SELECT p.game_id, p.i AS owner_id, round(coalesce(sv, 0.0), 6) AS sv FROM players p LEFT JOIN pivots v
  ON v.game_id = p.game_id AND v.i = p.i"""
SQL["linear_test"] = f"""WITH {TRADE} SELECT game_id, count_if(bit_count(m) > 1) <= 1 AS linear,
  count_if(bit_count(m) > 1)::BIGINT AS large, CASE WHEN max(bit_count(m)) > 1 THEN max(bit_count(m)) ELSE 0 END::BIGINT AS k,
  count_if(bit_count(m) <= 1)::BIGINT AS singles FROM trade GROUP BY game_id"""
SQL["shapley_form_choice"] = f"""WITH {TRADE}, {_worth('trade')},
g AS (SELECT game_id, count(*) AS terms, bit_count(bit_or(m)) AS n FROM trade GROUP BY game_id),
w AS (SELECT t.game_id, i, count(*) AS has FROM trade t, (SELECT unnest(range(8)) AS i) WHERE ((m >> i::INT) & 1) = 1
  GROUP BY t.game_id, i)
SELECT w.game_id, i AS owner_id, CASE WHEN n <= (CASE WHEN terms = has THEN has ELSE has * (terms - has) END)
  THEN 'lookup' ELSE 'combination' END AS form FROM w JOIN g ON g.game_id = w.game_id"""
# c(U) by Möbius inversion of the worths
_MOEBIUS = f"""{TRADE}, {_worth('trade')}, moebius AS (SELECT w.game_id, u, sum(CASE WHEN (bit_count(u) - bit_count(s)) % 2 = 0
  THEN v ELSE -v END)::BIGINT AS c FROM worth w JOIN (SELECT unnest(range(1, 256)) AS u) ON (s & u) = s GROUP BY w.game_id, u),
states AS (SELECT * FROM moebius WHERE c <> 0)"""
SQL["union_states"] = f"WITH {_MOEBIUS} SELECT game_id, {_text('u')} AS members, c AS coeff FROM states"
SQL["union_polynomial"] = f"""WITH {_MOEBIUS} SELECT game_id, bit_count(u)::BIGINT AS degree, sum(c)::BIGINT AS coeff FROM states
  GROUP BY game_id, bit_count(u) HAVING sum(c) <> 0"""
SQL["inclusion_exclusion_value"] = f"""WITH {_MOEBIUS} SELECT game_id, round(sum(c::DOUBLE / bit_count(u)), 6) AS value FROM states
  GROUP BY game_id"""
for _name in ("tpch_attribution_traditional", "tpch_attribution_iusv", "tpch_attribution_rdsv", "tpch_attribution_uncounted",
              "tpch_ablation_no_horizontal", "tpch_ablation_no_vertical", "tpch_ablation_no_hybrid"):
    SQL[_name] = TOTAL_SV
SQL["trade_attribution"] = f"""WITH {TRADE}, {_worth('trade')}, sv AS ({_SV}) SELECT owner_id, round(sum(sv), 4) AS sv
  FROM sv GROUP BY owner_id"""

# --- coefficients


def _poly(name: str, dnf: str) -> str:
    """Coefficients by degree, by Möbius inversion of the worths of all 256 coalitions."""
    return f"""{name}_worth AS (SELECT game_id, s, max(CASE WHEN (m & s) = m THEN 1 ELSE 0 END) AS v
  FROM {dnf}, (SELECT unnest(range(256)) AS s) GROUP BY game_id, s),
{name} AS (SELECT game_id, bit_count(u)::BIGINT AS degree, sum(CASE WHEN (bit_count(u) - bit_count(s)) % 2 = 0 THEN v ELSE -v END)::BIGINT AS coeff
  FROM {name}_worth JOIN (SELECT unnest(range(1, 256)) AS u) ON (s & u) = s GROUP BY game_id, bit_count(u)
  HAVING sum(CASE WHEN (bit_count(u) - bit_count(s)) % 2 = 0 THEN v ELSE -v END) <> 0)"""


def _by_degree(rows: str, polys: str, where: str = "") -> str:
    return (f"WITH {polys}, r AS ({rows}) SELECT game_id, degree, sum(coeff)::BIGINT AS coeff FROM r {where} "
            "GROUP BY game_id, degree HAVING sum(coeff) <> 0")


_AB = f"{TRADE}, {OTHER}, {_poly('a', 'trade')}, {_poly('b', 'other')}"
_ALL = "SELECT game_id, degree, coeff FROM"
_PRODUCT = ("SELECT a.game_id, a.degree + b.degree AS degree, {sign} a.coeff * b.coeff AS coeff FROM a JOIN b "
            "ON a.game_id = b.game_id")
SQL["coefficients_add"] = _by_degree(f"{_ALL} a UNION ALL {_ALL} b", _AB)
SQL["coefficients_subtract"] = _by_degree(f"{_ALL} a UNION ALL SELECT game_id, degree, -coeff FROM b", _AB)
SQL["coefficients_negate"] = f"WITH {_AB} SELECT game_id, degree, -coeff AS coeff FROM a"
SQL["coefficients_multiply"] = _by_degree(_PRODUCT.format(sign=""), _AB, "WHERE degree <> 0")
SQL["coefficients_vertical"] = _by_degree(
    "SELECT a.game_id, a.degree + b.degree + c.degree AS degree, a.coeff * b.coeff * c.coeff AS coeff FROM a JOIN b "
    "ON a.game_id = b.game_id JOIN b c ON a.game_id = c.game_id", _AB)
SQL["coefficients_horizontal"] = _by_degree(
    f"{_ALL} a UNION ALL {_ALL} b UNION ALL {_PRODUCT.format(sign='-')}", _AB)
SQL["coefficients_value"] = (f"WITH {_AB} SELECT game_id, round(sum(coeff::DOUBLE / degree), 6) AS value FROM a GROUP BY game_id")
SQL["leave_one_out_products"] = """WITH r AS (SELECT DISTINCT l_orderkey AS game_id, l_linenumber, l_partkey, l_suppkey,
  (l_partkey + l_suppkey) % 4 AS f FROM lineitem)
SELECT x.game_id, x.l_linenumber, x.l_partkey, x.l_suppkey, round(coalesce(product(y.f), 1.0), 4) AS others FROM r x LEFT JOIN r y
  ON x.game_id = y.game_id AND (x.l_linenumber, x.l_partkey, x.l_suppkey) <> (y.l_linenumber, y.l_partkey, y.l_suppkey)
GROUP BY x.game_id, x.l_linenumber, x.l_partkey, x.l_suppkey"""
# children are t² (even owners) or 2t − t² = t·(2 − t) (odd owners): with e even and o odd members a
# product is t^(2e+o)·(2−t)^o, written out by the binomial theorem
_CHILD = """(2 * bit_count(u & 85) + bit_count(u & 170) + j)::BIGINT AS degree,
  (CASE WHEN j % 2 = 0 THEN 1 ELSE -1 END * pow(2, bit_count(u & 170) - j) * factorial(bit_count(u & 170)::INT)
   / (factorial(j::INT) * factorial((bit_count(u & 170) - j)::INT)))::BIGINT"""
_TIMES = "(SELECT unnest(range(5)) AS j) WHERE j <= bit_count(u & 170)"
SQL["child_product_coefficients"] = f"""WITH {TRADE}, t AS (SELECT game_id, m AS u FROM trade)
SELECT game_id, {_text('u')} AS members, {_CHILD} AS coeff FROM t, {_TIMES}"""
SQL["expression_coefficients"] = f"""WITH {_MOEBIUS}, r AS (SELECT game_id, c, {_CHILD} AS k FROM states, {_TIMES})
SELECT game_id, degree, sum(c * k)::BIGINT AS coeff FROM r GROUP BY game_id, degree HAVING sum(c * k) <> 0"""
_BOTH = f"""{TRADE}, {OTHER}, coalitions AS (SELECT unnest(range(256)) AS s),
wa AS (SELECT game_id, s, bool_or((m & s) = m) AS v FROM trade, coalitions GROUP BY game_id, s),
wb AS (SELECT game_id, s, bool_or((m & s) = m) AS v FROM other, coalitions GROUP BY game_id, s),
worth AS (SELECT game_id, s, CASE WHEN wa.v AND wb.v THEN 1 ELSE 0 END AS v FROM wa JOIN wb USING (game_id, s)),
states AS (SELECT w.game_id, u, sum(CASE WHEN (bit_count(u) - bit_count(s)) % 2 = 0 THEN v ELSE -v END)::BIGINT AS c
  FROM worth w JOIN (SELECT unnest(range(1, 256)) AS u) ON (s & u) = s GROUP BY w.game_id, u)"""
SQL["interaction_union_states"] = f"WITH {_BOTH} SELECT game_id, {_text('u')} AS members, c AS coeff FROM states WHERE c <> 0"
SQL["interaction_coefficients"] = f"""WITH {_BOTH}, r AS (SELECT game_id, c, {_CHILD} AS k FROM states, {_TIMES})
SELECT game_id, degree, sum(c * k)::BIGINT AS coeff FROM r GROUP BY game_id, degree HAVING sum(c * k) <> 0"""


def _assigned(owners_of: dict[str, int], others: int) -> str:
    """Pairs, records and owners of an assignment of all tables: copies are Zipf shares, and every owner has a record."""
    names = ("region", "nation", "supplier", "customer", "part", "orders", "lineitem")
    counts = " UNION ALL ".join(
        [f"SELECT '{t}' AS table_name, count(*) AS n, {owners_of.get(t, others)} AS m FROM {t}" for t in names]
        + [f"SELECT 'partsupp', count(*), {others} FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem)"])
    return f"""WITH t AS ({counts}), w AS (SELECT *, unnest(range(1, least(m, 4) + 1)) AS i FROM t),
s AS (SELECT *, pow(i, -3.0) / sum(pow(i, -3.0)) OVER (PARTITION BY table_name) AS weight FROM w),
r AS (SELECT *, floor(weight * n)::BIGINT AS r FROM s),
f AS (SELECT table_name, n, m, i, CASE WHEN i = 1 THEN r + n - sum(r) OVER (PARTITION BY table_name) ELSE r END AS r FROM r)
SELECT table_name, sum(i * r)::BIGINT AS pairs, any_value(n)::BIGINT AS records,
  least(any_value(m), sum(i * r))::BIGINT AS owners
FROM f GROUP BY table_name"""


SQL["assignment_driver"] = _assigned({"region": 5, "nation": 5}, 20)
SQL["assignment_driver_weighted"] = _assigned({"region": 5, "nation": 5, "lineitem": 20}, 10)
