"""The global running maximum equals the plain window (brute force in pandas)."""

import numpy as np
from pyspark.sql import functions as F

from eddyline.operators.scan import chunked_running_max


def test_running_max_global_exclusive(spark):
    rng = np.random.default_rng(7)
    v = rng.integers(0, 100, 3000)
    df = spark.createDataFrame([(i, int(x)) for i, x in enumerate(v)], "id long, v long")
    out = chunked_running_max(df, [], ["id"], F.floor(F.col("id") / 97).cast("long"),
                              F.col("v"), "mx").toPandas().sort_values("id")
    best = np.r_[-1, np.maximum.accumulate(v)[:-1]]
    assert np.allclose(out["mx"].astype(float).fillna(-1), best)
