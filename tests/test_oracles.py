import pytest

import __spark_entry__ as entry
from compare import DATA, same

SQL = {k: v for plan in entry.PLANS for k, v in plan.Q.items()}
NAMES = [f.__name__ for plan in entry.PLANS for f in plan.QUERIES]


@pytest.mark.parametrize("name", NAMES)
def test_same_rows_as_sql(spark, duck, name):
    df = entry.queries()[name](spark, str(DATA))
    if name in SQL:
        same(df, duck, SQL[name])
    else:
        assert df.count() > 0


def test_every_sql_has_a_query():
    assert set(SQL) <= set(NAMES)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
