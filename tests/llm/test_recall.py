import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import neighbours


def test_recall_where_candidates_are_few(spark):
    """Two tables and one probe of eight rows give 16 of 12,000 rows: too few, so more must be probed, but not all rows."""
    rng = np.random.default_rng(4)
    x = np.repeat(rng.normal(size=(300, 24)), 40, axis=0) + 0.35 * rng.normal(size=(12_000, 24))
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    score = u[::50] @ u.T
    score[np.arange(240), np.arange(0, 12_000, 50)] = -2
    expected = {(50 * q, int(j)) for q, row in enumerate(np.argsort(-score, axis=1)[:, :5]) for j in row}
    small = {"tables": 2, "probes": 1, "per_bucket": 8}
    found = lambda **more: {(r[0], r[2]) for r in neighbours.search(frame, F.col("vec_id") % 50 == 0, **small, **more).collect()}
    assert len(found() & expected) >= 0.9 * len(expected)
    assert len(found(recall=0.0) & expected) < 0.9 * len(expected)  # the probes as given
    near = u[np.argsort(-score, axis=1)[:, :5]]
    probes = neighbours.probes_for(u[::50], near, 12_000, neighbours.shape_for(12_000, 24, 8), 2, 1, 8, 11, neighbours.RECALL)
    assert 2 * probes * 8 < 0.05 * 12_000
