"""Every engine query with oracle SQL gives the SQL's rows; the others give rows."""

import sys
from pathlib import Path

import pytest

from lectern import queries as q

sys.path.insert(0, str(Path(__file__).parent))
import oracle  # noqa: E402


@pytest.mark.parametrize("name", sorted(q.queries()))
def test_query(spark, sf, name):
    frame = q.queries()[name](spark, sf).toPandas()
    assert len(frame)
    if name in q.oracle_sql():
        assert oracle.same(frame, sf, q.oracle_sql()[name])


def test_entry_module_works_without_the_optional_subpackage(monkeypatch):
    import importlib.util

    import __spark_entry__ as entry

    real = importlib.util.find_spec
    monkeypatch.setattr(importlib.util, "find_spec", lambda n, *a: None if n in ("lectern.llm", "corpus_pipeline") else real(n, *a))
    assert set(entry.queries()) == set(q.queries())
    assert set(entry.oracle_sql()) == set(q.oracle_sql())
