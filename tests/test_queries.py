"""Every registered query of the library: values against SQL where there is any, else that it runs."""

import pytest

from tests.oracle import rows_of, rows_of_sql
from tidelog.plans import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"
#: Fitted queries take many small jobs; they have tests of their own.
FITTED = {"l10_refit_combination", "l10_held_out", "r15_gap_mixture", "p1_p3_logistic_probe", "p4_p5_median_probe", "p6_p7_pool_against_composed"}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, name):
    assert rows_of(QUERIES[name](spark, FOLDER)) == rows_of_sql(ORACLES[name], FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - ORACLES.keys() - FITTED))
def test_runs(spark, name):
    frame = QUERIES[name](spark, FOLDER)
    assert frame.count() > 0


def test_entry_and_names(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 150
    assert set(entry.oracle_sql()) <= set(entry.queries())
