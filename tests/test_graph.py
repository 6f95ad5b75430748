import itertools
import random

from contrasta.operators import kernel as K


def test_least_cover_matches_search(spark):
    rng = random.Random(3)
    data, want = [], {}
    for a in range(60):
        masks = [rng.randint(1, 7) for _ in range(rng.randint(1, 5))]
        data += [(a, 1, 2, 3, "k", str(n), m) for n, m in enumerate(masks)]
        want[a] = next((k for k in (1, 2, 3) for c in itertools.combinations(masks, k) if c and __import__("functools").reduce(int.__or__, c) == 7), 4)
    masks = spark.createDataFrame(data, "answer int, i int, j int, k int, key string, value string, mask int")
    sizes = K.cover_size(masks)
    assert {r.answer: r["size"] for r in sizes.collect()} == want
