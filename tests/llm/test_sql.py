"""The operators' queries against their SQL, on the smallest tables."""

import pytest

from gridproof.llm import queries
from tests.test_queries import duck, plain  # noqa: F401


@pytest.mark.parametrize("key", sorted(queries.oracle_sql()))
def test_query(spark, sf_dir, duck, key):  # noqa: F811
    got = queries.queries()[key](spark, sf_dir)
    want = duck.execute(queries.oracle_sql()[key])
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(got.columns)
    assert sorted(tuple(plain(r[c]) for c in names) for r in got.collect()) == sorted(tuple(plain(v) for v in r) for r in want.fetchall())
