import pytest

from linkloom import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_same_rows_as_sql(name, same_rows):
    same_rows(queries.QUERIES[name], queries.ORACLE[name])
