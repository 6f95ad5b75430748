import pytest
from oracle import assert_same, duck

from contrasta.plans.catalogue import QUERIES, SQL, flagship

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, name):
    assert_same(QUERIES[name](spark, SF), duck(SF), SQL[name])


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - SQL.keys()))
def test_gives_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_flagship(spark):
    out = flagship(spark, SF).toPandas()
    assert len(out) and (out["size"] <= 3).all()
