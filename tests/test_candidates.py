from oracle import assert_same, duck

from contrasta.plans.catalogue import CANDS
from contrasta.sources import tables as T


def test_numbers_that_many_share(spark, tmp_path):
    """More members share a number than a list holds; distances to either side tie; classes of one and two."""
    rows = [(k, k % 2, float(k // 30)) for k in range(1, 400)] + [(k, 2, 5.0 - k % 3 * 0.25) for k in range(400, 440)] + [(900, 3, 1.0), (901, 4, 1.0), (902, 4, 7.0)]
    spark.createDataFrame(rows, "c_custkey long, c_nationkey int, c_acctbal double").coalesce(1).write.parquet(f"{tmp_path}/out")
    next((tmp_path / "out").glob("*.parquet")).rename(tmp_path / "customer.parquet")
    assert_same(T.candidates(spark, str(tmp_path)), duck(tmp_path), "WITH " + CANDS + " SELECT answer, cand, pos, score FROM cands")
