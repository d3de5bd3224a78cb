"""Neighbourhood sums against dense numpy."""

import numpy as np
import pytest

from landloom.operators.focal import box_sum, class_share, half_open_sum, ring_sum


def frame(spark, a):
    return spark.createDataFrame([(x, y, int(a[y, x])) for y in range(a.shape[0]) for x in range(a.shape[1])], "x int, y int, v int")


@pytest.mark.parametrize("radius", [0, 1, 2, 9])
def test_boxes(spark, radius):
    a = np.random.default_rng(radius).integers(0, 9, (6, 7))
    df = frame(spark, a)
    h, w = a.shape

    def want(low, high, b=a):
        return {(x, y): int(b[max(0, y + low) : max(0, y + high + 1), max(0, x + low) : max(0, x + high + 1)].sum()) for y in range(h) for x in range(w)}

    full = {(r["x"], r["y"]): r["box_v"] for r in box_sum(df, ["v"], -radius, radius).collect()}
    assert full == want(-radius, radius)
    ring = {(r["x"], r["y"]): r["box_v"] for r in ring_sum(df, ["v"], radius).collect()}
    assert ring == {(x, y): full[x, y] - int(a[y, x]) for x, y in full}
    inner = a.copy()
    inner[0] = inner[:, 0] = 0
    half = {(r["x"], r["y"]): r["box_v"] for r in half_open_sum(df, ["v"], radius).collect()}
    # The same by differences of a summed-area table.
    s = inner.cumsum(0).cumsum(1)
    table = {}
    for x, y in half:
        x0, y0, x1, y1 = max(0, x - radius), max(0, y - radius), min(w - 1, x + radius), min(h - 1, y + radius)
        table[x, y] = int(s[y1, x1] - s[y0, x1] - s[y1, x0] + s[y0, x0])
    assert half == table


def test_share(spark):
    a = np.array([[1, 2], [2, 2]])
    got = {(r["x"], r["y"]): (r["share_1"], r["share_2"]) for r in class_share(frame(spark, a), "v", [1, 2], 3).collect()}
    assert got[0, 0] == (0.0, 0.5) and got[1, 1] == (pytest.approx(1 / 6), pytest.approx(1 / 3))
