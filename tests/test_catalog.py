"""A few registered queries against their SQL; ``python -m tests.compare`` runs all of them."""

import pytest

import __spark_entry__ as E

from .compare import compare


@pytest.mark.parametrize("name", ["tpch_attribution_iusv", "tuple_game_terms", "shapley_combination", "or_split",
                                  "shapley_permutation", "owners_of_tables_equal", "joined_row_ids"])
def test_query(spark, sf_dir, name):
    _, ok, why = compare(spark, sf_dir, name, E.queries()[name], E.oracle_sql()[name])
    assert ok, why


def test_names():
    assert set(E.oracle_sql()) <= set(E.queries())
