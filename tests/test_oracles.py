"""Every core query that has SQL, against DuckDB."""

import pytest

from anchorloom.plans import linking, overview, problems, syncing, texts
from oracle import SF, check, connect

MODULES = [texts, linking, overview, syncing, problems]
CASES = {name: (m.QUERIES[name], sql) for m in MODULES for name, sql in m.ORACLES.items()}
PLAIN = {name: f for m in MODULES for name, f in m.QUERIES.items() if name not in m.ORACLES}


@pytest.fixture(scope="module")
def con():
    return connect()


@pytest.mark.parametrize("name", CASES)
def test_query(spark, con, name):
    check(spark, con, *CASES[name])


@pytest.mark.parametrize("name", PLAIN)
def test_runs(spark, name):
    PLAIN[name](spark, SF).write.format("noop").mode("overwrite").save()


def test_figures_agree(spark):
    """Contested phrases are those that the conflict report lists; states add up to the total."""
    q = {n: f for m in MODULES for n, f in m.QUERIES.items()}
    assert q["stats_linking"](spark, SF).first()["contested"] == q["collisions"](spark, SF).count()
    k = q["stats_keywords"](spark, SF).first()
    assert k["total"] == k["auto_active"] + k["pending_review"] + k["approved"] + k["disabled"]


def test_entry_point(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() >= 0
    assert set(e.oracle_sql()) <= set(e.queries())
