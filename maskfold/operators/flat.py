"""Many short lists at once: a batch of rows as flat arrays, with the row of each item."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

#: pairs of items looked at in one go
PAIRS = 1 << 20


def _spread(first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """first[i], first[i] + 1, ... (n[i] of them) for all i, and the i of each."""
    of = np.repeat(np.arange(len(n)), n)
    return np.arange(len(of)) + np.repeat(first - (np.cumsum(n) - n), n), of


def _lists(column: pa.Array) -> tuple[np.ndarray, pa.StructArray]:
    """Lengths of the lists (null: 0) and all their items."""
    return pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64), column.flatten()


def _numbers(items: pa.StructArray, name: str, kind: type) -> np.ndarray:
    return items.field(items.type.get_field_index(name)).to_numpy(zero_copy_only=False).astype(kind)


def _slices(cost: np.ndarray) -> Iterator[slice]:
    """Runs of rows of at most `PAIRS` in all, or one row."""
    upto, lo = np.cumsum(cost), 0
    while lo < len(cost):
        done = upto[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(upto, done + PAIRS, "right")))
        yield slice(lo, hi)
        lo = hi


def union_areas(row: np.ndarray, rows: int, y0: np.ndarray, y1: np.ndarray, x0: np.ndarray, x1: np.ndarray) -> np.ndarray:
    """Pixels under any box of each row: bands between the edges of a row's boxes, and in a band what reaches beyond the boxes before."""
    if not len(row):
        return np.zeros(rows, np.int64)
    high, wide = int(y1.max() - y0.min()) + 1, int(x1.max() - x0.min()) + 1
    top, low, left, right = row * high + (y0 - y0.min()), row * high + (y1 - y0.min()), x0 - x0.min(), x1 - x0.min()
    edges = np.unique(np.concatenate([top, low]))
    first = np.searchsorted(edges, top)
    band, box = _spread(first, np.searchsorted(edges, low) - first)
    order = np.lexsort((left[box], band))
    band, box = band[order], box[order]
    reach = np.maximum.accumulate(right[box] + band * wide)
    before = np.concatenate([[-1], reach[:-1]]) - band * wide
    new = np.maximum(right[box] - np.maximum(left[box], before), 0) * (edges[band + 1] - edges[band])
    total = np.concatenate([[0], np.cumsum(new)])
    return np.diff(total[np.searchsorted(row[box], np.arange(rows + 1))])


def box_areas(models: int):
    """Per model 0, 1, ... of the boxes `ps`, which name theirs in `m`: pixels under the boxes `gs`, under its own and under both."""

    def run(gs: pa.Array, ps: pa.Array) -> pa.Array:
        (gn, g), (pn, p) = _lists(gs), _lists(ps)
        rows, m = len(gn), _numbers(p, "m", np.int64)
        g_row, p_row = np.repeat(np.arange(rows), gn), np.repeat(np.arange(rows), pn)
        g_box, p_box = ([_numbers(items, c, np.int64) for c in ("y0", "y1", "x0", "x1")] for items in (g, p))
        out = np.zeros((3, rows, models), np.int64)
        for s in _slices(2 * (gn + pn) ** 2):
            k = s.stop - s.start
            at = slice(*np.searchsorted(g_row, [s.start, s.stop]))
            rg, cg = g_row[at] - s.start, [c[at] for c in g_box]
            one, (lo, hi) = union_areas(rg, k, *cg), np.searchsorted(p_row, [s.start, s.stop])
            for i in range(models):
                at = lo + np.flatnonzero(m[lo:hi] == i)
                rp, cp = p_row[at] - s.start, [c[at] for c in p_box]
                two = union_areas(rp, k, *cp)
                any_ = union_areas(np.concatenate([rg, rp]), k, *map(np.concatenate, zip(cg, cp)))
                out[:, s, i] = one, two, one + two - any_
        each = pa.StructArray.from_arrays([pa.array(v.ravel()) for v in out], names=["g", "p", "tp"])
        return pa.ListArray.from_arrays(pa.array(np.arange(rows + 1) * models, pa.int32()), each)

    return F.arrow_udf(run, ArrayType(StructType([StructField(c, LongType()) for c in ("g", "p", "tp")])))


def _chain(x: np.ndarray, y: np.ndarray, first: np.ndarray, n: np.ndarray, step: int) -> np.ndarray:
    """Twice the signed area under one side of the hull of each row's points, which lie in (x, y) order from `first` on in steps of `step`.

    All rows take their k-th point together; a point stays while the next ones turn left.
    """
    by_size = np.argsort(-n, kind="stable")
    place = np.cumsum(n) - n
    stack, top = np.zeros(int(n.sum()), np.int64), np.zeros(len(n), np.int64)
    counts = -n[by_size]
    for k in range(int(n.max(initial=0))):
        live = by_size[: np.searchsorted(counts, -k)]
        p = first[live] + k * step
        at = np.arange(len(live))
        while True:
            at = at[top[live[at]] >= 2]
            r = live[at]
            o, a, q = stack[place[r] + top[r] - 2], stack[place[r] + top[r] - 1], p[at]
            at = at[(x[a] - x[o]) * (y[q] - y[o]) - (y[a] - y[o]) * (x[q] - x[o]) <= 0]
            if not len(at):
                break
            top[live[at]] -= 1
        stack[place[live] + top[live]] = p
        top[live] += 1
    i, of = _spread(place, np.maximum(top - 1, 0))
    a, b = stack[i], stack[i + 1]
    return np.bincount(of, x[a] * y[b] - x[b] * y[a], minlength=len(n))


@F.arrow_udf(StructType([StructField(c, DoubleType()) for c in ("area", "perimeter", "hull")]))
def outline_sizes(vertices: pa.Array) -> pa.Array:
    """Area, perimeter and area of the hull of closed outlines; null if the outline or one of its coordinates is."""
    n, items = _lists(vertices)
    rows, start = len(n), np.cumsum(n) - n
    row = np.repeat(np.arange(rows), n)
    xs, ys = (items.flatten()[items.type.get_field_index(c)] for c in "xy")
    gone = pc.or_(xs.is_null(), ys.is_null()).to_numpy(zero_copy_only=False)
    x, y = (c.to_numpy(zero_copy_only=False).astype(float) for c in (xs, ys))
    after = np.arange(len(row)) + 1
    after[(start + n - 1)[n > 0]] = start[n > 0]
    area = np.abs(np.bincount(row, x * y[after] - x[after] * y, minlength=rows)) / 2
    perimeter = np.bincount(row, np.hypot(x[after] - x, y[after] - y), minlength=rows)
    order = np.lexsort((y, x, row))
    x, y, r = x[order], y[order], row[order]
    new = np.ones(len(r), bool)
    new[1:] = (r[1:] != r[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])
    x, y, n = x[new], y[new], np.bincount(r[new], minlength=rows)
    start = np.cumsum(n) - n
    hull = np.abs(_chain(x, y, start, n, 1) + _chain(x, y, start + n - 1, n, -1)) / 2
    null = vertices.is_null().to_numpy(zero_copy_only=False) | (np.bincount(row[gone], minlength=rows) > 0)
    return pa.StructArray.from_arrays([pa.array(v, mask=null) for v in (area, perimeter, hull)], names=["area", "perimeter", "hull"])
