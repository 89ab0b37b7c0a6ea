import pytest

from compare import DATA, same
from corpusloom.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows_as_sql(spark, duck, name):
    same(queries.queries()[name](spark, str(DATA)), duck, queries.oracle_sql()[name])
