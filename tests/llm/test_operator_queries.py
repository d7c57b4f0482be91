"""The operators' queries against their DuckDB SQL, on the smallest of the given data."""

import pytest

from markscale.llm.oracles import ORACLES
from markscale.llm.queries import QUERIES


def comparable(rows):
    return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in row) for row in rows), key=repr)


@pytest.mark.parametrize("name", ORACLES)
def test_query_matches_duckdb(spark, duck, sf_dir, name):
    result = QUERIES[name](spark, sf_dir)
    names = sorted(result.columns)
    expected = duck.execute(ORACLES[name])
    columns = [d[0] for d in expected.description]
    order = [columns.index(c) for c in names]
    assert sorted(columns) == names
    assert comparable(result.select(names).collect()) == comparable([r[i] for i in order] for r in expected.fetchall())
