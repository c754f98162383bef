import math
import random

from pyspark.sql import functions as F

from cohortry.llm.va_search import cell_ends, top_k


def brute(rows, is_query, k):
    """[(query_id, rank, vec_id, score)] by scoring every pair."""
    usable = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            usable.setdefault(i, set()).add(tuple(math.floor(256 * x) for x in v))
    out = []
    for q, queries in usable.items():
        if is_query(q):
            scored = {(-sum(a * b for a, b in zip(x, y)), i) for x in queries for i, ys in usable.items() if i != q for y in ys}
            out += [(q, r, i, -s) for r, (s, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


def found(frame, k=5, **more):
    return sorted(tuple(r) for r in top_k(frame, F.col("vec_id") % 5 == 0, k=k, **more).collect())


def frame(spark, rows, extra=()):
    out = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    for name in extra:
        out = out.withColumn(name, F.lit(1))
    return out


def test_equals_scoring_every_pair(spark):
    rng = random.Random(3)
    rows = [(k, [round(rng.gauss(0, 0.4), 3) for _ in range(8)]) for k in range(150)]
    rows += [(200 + k, rows[0][1]) for k in range(40)] + [rows[5], rows[7]]
    rows += [(300, None), (305, [float("nan")] * 8), (310, [1.0, None] * 4), (315, [float("inf")] + [0.0] * 7), (None, rows[1][1]), (320, []), (325, [0.5, -0.5])]
    rows = [(i, v and [F_(x) for x in v]) for i, v in rows]
    table = frame(spark, rows, ("v", "q", "score", "rank", "query_id", "low", "up", "turn", "bar"))
    wanted = brute(rows, lambda q: q % 5 == 0, 5)
    assert found(table) == wanted
    assert found(table, bits=1, first_reads=1, block_queries=7) == wanted


def F_(x):
    """The value as a 32-bit float."""
    import struct

    return None if x is None else struct.unpack("f", struct.pack("f", x))[0]


def test_fewer_rows_than_asked_for(spark):
    rows = [(0, [1.0]), (1, [2.0]), (2, [2.0])]
    assert found(frame(spark, rows)) == [(0, 1, 1, 256 * 512), (0, 2, 2, 256 * 512)]
    assert found(frame(spark, [(0, [1.0])])) == []
    assert found(frame(spark, [])) == []
    assert found(frame(spark, [(1, [1.0]), (2, [1.0])])) == []


def test_large_components_stay_exact(spark):
    rows = [(k, [float(2**21 + k % 3), float(-(2**20) + k)]) for k in range(30)]
    assert found(frame(spark, rows)) == brute(rows, lambda q: q % 5 == 0, 5)


def test_cells_cover_the_range():
    import numpy as np

    low, high = np.array([-5, 0, 7]), np.array([100, 0, 9])
    for bits in (1, 3, 6):
        first, last = cell_ends(low, high, bits)
        assert (first[:, 0] == low).all() and (last[:, -1] >= high).all() and (last >= first).all()
