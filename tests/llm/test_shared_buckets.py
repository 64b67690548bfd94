"""How many buckets linked sets have in common, and that a short passage alone keeps no sets together."""

import numpy as np
from pyspark.sql import functions as F

from tallyspark.llm import jaccard as J


def test_linked_sets_share_what_they_need():
    rng = np.random.default_rng(5)
    draw = lambda k: rng.integers(0, 1 << 64, k, dtype=np.uint64)
    tight = 0
    for percent in (80, 90):
        for n in (1, 3, 8, 20, 60, 200, 700, 2500):
            for turn in range(30):
                d = n * (100 - percent) // percent
                common, gone = draw(n - d), int(rng.integers(0, d + 1)) if turn % 3 else (0, d)[turn % 2]
                a, b = np.unique(np.concatenate((common, draw(gone)))), np.unique(np.concatenate((common, draw(d - gone))))
                both = len(np.intersect1d(a, b))
                if 100 * both < percent * (len(a) + len(b) - both):
                    continue
                heavy = np.sort(rng.choice(common, len(common) // 3, replace=False)) if turn % 2 else None
                (x, p), (y, q) = J.emitted(a, percent, heavy), J.emitted(b, percent, heavy)
                assert len(np.intersect1d(x, y)) >= max(p, q)
                tight += max(p, q) > 1
    assert tight > 100


def test_a_passage_keeps_no_sets_apart(spark):
    """Texts of 400 own words with a passage of 30: they share buckets, but too few to link."""
    passage = " ".join(f"p{i}" for i in range(30))
    texts = [" ".join(f"w{k}_{i}" for i in range(200)) + f" {passage} " + " ".join(f"v{k}_{i}" for i in range(200)) for k in range(40)]
    rows = []
    for k, x in enumerate(texts):
        found, need = J.emitted(J.tokens(x, 5), 80)
        rows += [(k, 426, need, int(i)) for i in found.view(np.int64)]
    df = spark.createDataFrame(rows, "rep long, n long, need int, key long")
    assert df.groupBy("key").count().filter(F.col("count") > 1).count()
    assert J._buckets(df).count() == 0
