from contrasta.functions.text import strict_bool
from contrasta.operators import contracts as C
from contrasta.operators import lookups as U
from contrasta.operators import ranking as R


def test_identity_takes_the_first_step_that_hits(spark):
    """Its own node beside an alias isn't ambiguous; two aliases are; an answer is sought under the name that it redirects to."""
    hops = spark.createDataFrame([("old", "own"), ("moved", "home"), ("was1", "gone"), ("was2", "gone"), ("lone", "now"), ("former", "now")], "src string, dst string")
    local = spark.createDataFrame([(x,) for x in ("own", "old", "home", "was1", "was2", "former")], "id string")
    answers = spark.createDataFrame([(x,) for x in ("own", "moved", "gone", "lone", "nobody")], "answer string")
    got = {r.answer: (r.status, r.node, r.step) for r in U.identity(answers, hops, local).collect()}
    assert got == {"own": ("RESOLVED", "own", 0), "moved": ("RESOLVED", "home", 1), "gone": ("AMBIGUOUS", None, None), "lone": ("RESOLVED", "former", 2), "nobody": ("NOT_FOUND", None, None)}


def test_precision_of_lists_that_end(spark):
    rows = spark.createDataFrame([(1, 1, 1), (1, 2, 1), (2, 1, 0), (2, 2, 1), (2, 3, 1)], "query int, rank int, hit int")
    got = {r.k: round(r.precision, 9) for r in R.precision_at(rows, 3).collect()}
    assert got == {1: 0.5, 2: 0.75, 3: round(2 / 3 / 2, 9)}


def test_spellings_and_type_maps(spark):
    rows = spark.createDataFrame([("true",), ("false",), ("True",), ("",), (None,)], "x string")
    assert [r[0] for r in rows.select(strict_bool(rows.x)).collect()] == [True, False, None, None, None]
    kinds = spark.createDataFrame([("a", -1), ("b", 0)], "kind string, value int")
    assert tuple(C.type_map(kinds).first()) == (2, 2, 1, True)


def test_retention_blocks(spark):
    chosen = spark.createDataFrame([(1, "strict-l2", 1, 2, 3), (2, "main-l1", 1, 2, 5), (3, "diagnostic-l0", 1, 2, 3)], "answer int, policy string, i int, j int, k int")
    got = {r.block: r for r in C.retention(chosen).collect()}
    assert (got["any"].answers, got["any"].first_three, got["any"].first_three_pct, got["any"].median_rank) == (3, 2, 66.67, 2.0)
    assert (got["shown"].answers, got["shown"].first_three, got["shown"].mean_third, got["shown"].most_rank) == (2, 1, 4.0, 5)


def test_retention_goes_through_the_answers_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for x in batches:
            seen.add(x.num_rows)
            yield x

    chosen = spark.createDataFrame([(i, "diagnostic-l0", 1, 2, 3 + i % 4) for i in range(40)], "answer int, policy string, i int, j int, k int")
    got = C.retention(chosen.mapInArrow(counted, chosen.schema)).collect()
    assert [(r.block, r.answers, r.first_three, r.mean_third, r.median_rank) for r in got] == [("any", 40, 10, 4.5, 2.0)]
    assert seen.value == 40
