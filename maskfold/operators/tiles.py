"""Tiling, blending, restoring to image size, and polygons to runs."""
from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..functions.raster import tile_starts


def tile_grid(images: DataFrame, tile: int = 256, overlap: float = 0.25) -> DataFrame:
    """All tile positions (tx, ty) of each image; small images get one tile at the origin."""
    return images.withColumn("ty", F.explode(tile_starts(F.col("height"), tile, overlap))).withColumn(
        "tx", F.explode(tile_starts(F.col("width"), tile, overlap))
    )


def tile_place(det: DataFrame, tiles: DataFrame) -> DataFrame:
    """Shift tile-local boxes and blocks to image coordinates and clip them to the image.

    `tiles` has (image_id, tile_id, tx, ty, width, height).
    """
    j = det.join(tiles, ["image_id", "tile_id"])
    def clip(c: Column, top: str) -> Column:
        return F.greatest(F.lit(0), F.least(c, F.col(top)))

    return j.withColumns(
        {
            "x0": clip(F.col("x0") + F.col("tx"), "width"), "x1": clip(F.col("x1") + F.col("tx"), "width"),
            "y0": clip(F.col("y0") + F.col("ty"), "height"), "y1": clip(F.col("y1") + F.col("ty"), "height"),
        }
    ).where("x1 > x0 and y1 > y0").drop("tx", "ty", "width", "height")


#: side of the blocks in which tiles are added up, and how many of them a task holds before it hands them on
BLOCK, HELD = 64, 512
_PARTIAL = "image_id {image}, by int, bx int, y0 int, x0 int, h int, w int, num binary, den binary"


def _hann_window(h: int, w: int) -> np.ndarray:
    """The weights of `hann2d` for a whole tile."""
    def line(n: int) -> np.ndarray:
        return 0.5 - 0.5 * np.cos(2.0 * np.pi * (np.arange(n) + 1) / (n + 1))

    return np.clip(np.outer(line(h), line(w)), 0.001, 1.0)


def _add_tiles(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Cut tiles at block borders and add up what falls into one block; at most `HELD` blocks are held."""
    windows: dict[tuple[int, int], np.ndarray] = {}
    held: dict[tuple, list] = {}

    def flush() -> Iterator[pd.DataFrame]:
        rows = []
        for (image, by, bx), (num, den) in held.items():
            ys, xs = np.flatnonzero(den.any(axis=1)), np.flatnonzero(den.any(axis=0))
            if not len(ys):
                continue
            cut = np.s_[ys[0] : ys[-1] + 1, xs[0] : xs[-1] + 1]
            rows.append((image, by, bx, ys[0], xs[0], *num[cut].shape, num[cut].tobytes(), den[cut].tobytes()))
        held.clear()
        if rows:
            yield pd.DataFrame(rows, columns=["image_id", "by", "bx", "y0", "x0", "h", "w", "num", "den"])

    for pdf in frames:
        for image, tx, ty, w, h, probs in pdf.itertuples(index=False):
            if (h, w) not in windows:
                if len(windows) > 64:
                    windows.clear()
                windows[h, w] = _hann_window(h, w)
            p = np.asarray(probs, dtype="float64").reshape(h, w)
            some = ~np.isnan(p)
            den = windows[h, w] * some
            num = np.where(some, p, 0.0) * den
            for by in range(ty // BLOCK, (ty + h - 1) // BLOCK + 1):
                for bx in range(tx // BLOCK, (tx + w - 1) // BLOCK + 1):
                    y0, y1 = max(ty, by * BLOCK), min(ty + h, (by + 1) * BLOCK)
                    x0, x1 = max(tx, bx * BLOCK), min(tx + w, (bx + 1) * BLOCK)
                    if (image, by, bx) not in held:
                        if len(held) >= HELD:
                            yield from flush()
                        held[image, by, bx] = [np.zeros((BLOCK, BLOCK)), np.zeros((BLOCK, BLOCK))]
                    to = np.s_[y0 - by * BLOCK : y1 - by * BLOCK, x0 - bx * BLOCK : x1 - bx * BLOCK]
                    at = np.s_[y0 - ty : y1 - ty, x0 - tx : x1 - tx]
                    held[image, by, bx][0][to] += num[at]
                    held[image, by, bx][1][to] += den[at]
    yield from flush()


def _blend_blocks(floor: float):
    """Add up the parts of each block; rows come sorted by block, one open block and at most 64 finished ones are held."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, num, den, done = None, None, None, []

        def close() -> None:
            image, by, bx = key
            ys, xs = np.flatnonzero(den.any(axis=1)), np.flatnonzero(den.any(axis=0))
            cut = np.s_[ys[0] : ys[-1] + 1, xs[0] : xs[-1] + 1]
            p = np.where(den[cut] > 0, num[cut] / np.maximum(den[cut], floor), np.nan)  # NaN becomes null
            done.append((image, by * BLOCK + ys[0], bx * BLOCK + xs[0], p.shape[1], p.ravel()))

        def hand_on() -> pd.DataFrame:
            out = pd.DataFrame(done, columns=["image_id", "y0", "x0", "w", "probs"])
            done.clear()
            return out

        for pdf in frames:
            for image, by, bx, y0, x0, h, w, n, d in pdf.itertuples(index=False):
                if key != (image, by, bx):
                    if key is not None:
                        close()
                    if len(done) >= 64:
                        yield hand_on()
                    key, num, den = (image, by, bx), np.zeros((BLOCK, BLOCK)), np.zeros((BLOCK, BLOCK))
                num[y0 : y0 + h, x0 : x0 + w] += np.frombuffer(n).reshape(h, w)
                den[y0 : y0 + h, x0 : x0 + w] += np.frombuffer(d).reshape(h, w)
        if key is not None:
            close()
            yield hand_on()

    return run


def hann_blend_blocks(tiles: DataFrame, floor: float = 1e-6) -> DataFrame:
    """Weighted mean of overlapping tile probabilities as blocks (image_id, y0, x0, w, probs row by row); null where no tile lies.

    `tiles` has (image_id, tx, ty, tile_w, tile_h, probs array, row by row). Tiles are added up in blocks of 64 x 64 pixels
    before the shuffle, so a row of it is a block, not a pixel, and copies of a tile cost nothing there. After it the parts of a
    block follow each other and one block is open, however many tiles overlap. A null or NaN probability carries no weight; tiles
    without an image or without probabilities are left out, an array that does not fit its tile is an error.
    """
    image = dict(tiles.dtypes)["image_id"]
    parts = tiles.where("image_id is not null and probs is not null").select("image_id", "tx", "ty", "tile_w", "tile_h", "probs").mapInPandas(_add_tiles, _PARTIAL.format(image=image))
    keys = ["image_id", "by", "bx"]
    return parts.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(_blend_blocks(floor), f"image_id {image}, y0 int, x0 int, w int, probs array<double>")


def hann_blend(tiles: DataFrame, images: DataFrame, floor: float = 1e-6) -> DataFrame:
    """Weighted mean of overlapping tile probabilities per pixel, cropped to the image; see `hann_blend_blocks`."""
    blocks = hann_blend_blocks(tiles, floor).join(images.select("image_id", "width", "height"), "image_id").where("y0 < height and x0 < width")
    out = blocks.select("image_id", "y0", "x0", "w", "width", "height", F.posexplode("probs").alias("i", "p")).where("p is not null")
    out = out.withColumns({"y": F.col("y0") + F.floor(F.col("i") / F.col("w")).cast("int"), "x": F.col("x0") + F.col("i") % F.col("w")})
    return out.where("x < width and y < height").select("image_id", "y", "x", "p")


def _targets(params: DataFrame) -> DataFrame:
    """Every target pixel of each image with its source position in the letterboxed map."""
    t = params.withColumn("y", F.explode(F.sequence(F.lit(0), F.col("height") - 1))).withColumn("x", F.explode(F.sequence(F.lit(0), F.col("width") - 1)))
    return t


def restore_nearest(pixels: DataFrame, params: DataFrame) -> DataFrame:
    """Undo letterboxing of a sparse mask by nearest neighbour.

    `pixels` lists foreground (image_id, y, x) of the letterboxed mask, `params` has width, height, scaled_w,
    scaled_h, pad_left, pad_top. Instead of opening every target pixel, each source pixel writes the block of
    targets that read it: floor(target * scaled / size) = source.
    """
    p = pixels.join(params, "image_id").withColumns({"sx": F.col("x") - F.col("pad_left"), "sy": F.col("y") - F.col("pad_top")})
    p = p.where("sx >= 0 and sx < scaled_w and sy >= 0 and sy < scaled_h")

    def span(s: str, size: str, scaled: str) -> tuple[Column, Column]:
        lo = F.ceil(F.col(s) * F.col(size) / F.col(scaled))
        hi = F.ceil((F.col(s) + 1) * F.col(size) / F.col(scaled))
        return lo.cast("int"), F.least(hi, F.col(size)).cast("int")

    x0, x1 = span("sx", "width", "scaled_w")
    y0, y1 = span("sy", "height", "scaled_h")
    return p.select("image_id", y0.alias("y0"), y1.alias("y1"), x0.alias("x0"), x1.alias("x1")).where("x1 > x0 and y1 > y0")


def restore_bilinear(pixels: DataFrame, params: DataFrame) -> DataFrame:
    """Undo letterboxing of a probability map, bilinear with half-pixel centres and repeated borders, clipped to [0, 1]."""
    def source(v: str, size: str, scaled: str) -> Column:
        return (F.col(v) + 0.5) * F.col(scaled) / F.col(size) - 0.5

    t = _targets(params).withColumns({"fx": source("x", "width", "scaled_w"), "fy": source("y", "height", "scaled_h")})
    t = t.withColumns({"bx": F.floor("fx"), "by": F.floor("fy")}).withColumns({"ax": F.col("fx") - F.col("bx"), "ay": F.col("fy") - F.col("by")})
    corners = F.array(*[
        F.struct(
            F.least(F.greatest(F.col("by") + dy, F.lit(0)), F.col("scaled_h") - 1).alias("sy"),
            F.least(F.greatest(F.col("bx") + dx, F.lit(0)), F.col("scaled_w") - 1).alias("sx"),
            ((F.col("ax") if dx else 1 - F.col("ax")) * (F.col("ay") if dy else 1 - F.col("ay"))).alias("w"),
        )
        for dy in (0, 1) for dx in (0, 1)
    ])
    t = t.select("image_id", "y", "x", "pad_left", "pad_top", F.explode(corners).alias("c")).select(
        "image_id", "y", "x", (F.col("c.sy") + F.col("pad_top")).cast("int").alias("sy"), (F.col("c.sx") + F.col("pad_left")).cast("int").alias("sx"), F.col("c.w").alias("w")
    )
    src = pixels.select("image_id", F.col("y").alias("sy"), F.col("x").alias("sx"), "p")
    out = t.join(src, ["image_id", "sy", "sx"]).groupBy("image_id", "y", "x").agg(F.sum((F.col("p") * F.col("w")).cast("decimal(28,12)")).cast("double").alias("p"))  # an exact sum in any order
    return out.withColumn("p", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("p"))))


CROSSINGS = 2_000_000


def _offsets(lists: pa.Array) -> np.ndarray:
    return lists.offsets.to_numpy().astype(np.int64)


def _edges(rings: pa.ListArray) -> tuple[np.ndarray, ...]:
    """The edge table of a batch of polygons: polygon, ring, and xa, ya, xb, yb with ya < yb; level edges cross no row."""
    outer, inner = _offsets(rings), rings.values
    polygon_of = np.repeat(np.arange(len(rings)), np.diff(outer))
    inner = inner.slice(int(outer[0]), int(outer[-1] - outer[0]))
    at = _offsets(inner)
    flat = inner.values.to_numpy(zero_copy_only=False).astype(float)
    # a missing ring has an empty stretch here; a missing coordinate is not a number and voids its ring
    n = (np.diff(at) // 2) * inner.is_valid().to_numpy(zero_copy_only=False)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
    n = np.where((n >= 3) & (bad[at[:-1] + 2 * n] == bad[at[:-1]]), n, 0)
    ring = np.repeat(np.arange(len(n)), n)
    i = np.arange(len(ring)) - np.repeat(np.cumsum(n) - n, n)
    first = at[:-1][ring]
    p, q = first + 2 * i, first + 2 * ((i + 1) % np.maximum(n, 1)[ring])
    xa, ya, xb, yb = flat[p], flat[p + 1], flat[q], flat[q + 1]
    keep = ya != yb
    return tuple(x[keep] for x in (polygon_of[ring], ring, xa, ya, xb, yb))


def _fill(edges: tuple[np.ndarray, ...], height: np.ndarray, width: np.ndarray, union: bool) -> tuple[np.ndarray, ...]:
    """Runs (polygon, y, x0, x1): each edge sends its crossing to every row it spans, crossings are sorted and paired by row."""
    polygon, ring, xa, ya, xb, yb = edges
    top = np.maximum(np.ceil(np.minimum(ya, yb) - 0.5), 0).astype(np.int64)
    n = np.maximum(np.minimum(np.ceil(np.maximum(ya, yb) - 0.5), height[polygon]).astype(np.int64) - top, 0)
    e = np.repeat(np.arange(len(n)), n)
    y = np.arange(len(e)) - np.repeat(np.cumsum(n) - n, n) + top[e]
    x = xa[e] + (y + 0.5 - ya[e]) * (xb[e] - xa[e]) / (yb[e] - ya[e])
    part = ring[e] if union else polygon[e]
    order = np.lexsort((x, y, part))
    poly, y, part = polygon[e][order][::2], y[order][::2], part[order][::2]
    ends = np.ceil(x[order] - 0.5)
    x0 = np.maximum(ends[::2], 0).astype(np.int64)
    x1 = np.minimum(ends[1::2], width[poly]).astype(np.int64)
    keep = x1 > x0
    poly, y, x0, x1 = poly[keep], y[keep], x0[keep], x1[keep]
    if union and len(poly):  # rings may overlap: stretches of a row that meet become one
        order = np.lexsort((x0, y, poly))
        poly, y, x0, x1 = poly[order], y[order], x0[order], x1[order]
        row = np.concatenate([[0], np.cumsum((poly[1:] != poly[:-1]) | (y[1:] != y[:-1]))])
        wide = int(x1.max()) + 1
        reach = np.maximum.accumulate(row * wide + x1)
        new = np.concatenate([[True], row[1:] * wide + x0[1:] > reach[:-1]])
        at = np.flatnonzero(new)
        last = np.append(at[1:], len(new)) - 1
        poly, y, x0, x1 = poly[at], y[at], x0[at], reach[last] - row[last] * wide
    return poly, y, x0, x1


def filled(edges: tuple[np.ndarray, ...], height: np.ndarray, width: np.ndarray, union: bool) -> Iterator[tuple[np.ndarray, ...]]:
    """Runs (polygon, y, x0, x1) of polygons beside the size of their image: whole polygons, about CROSSINGS crossings at a time."""
    span = np.ceil(np.abs(edges[5] - edges[3])).astype(np.int64) + 1
    load = np.bincount(edges[0], np.minimum(span, height[edges[0]].astype(np.int64) + 1), len(height))
    cut = np.unique(np.concatenate([[0], np.searchsorted(np.cumsum(load), np.arange(1, load.sum() // CROSSINGS + 1) * CROSSINGS), [len(height)]]))
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        lo, hi = np.searchsorted(edges[0], [a, b])
        yield _fill(tuple(x[lo:hi] for x in edges), height, width, union)


def _rasterise(keys: list[str], union: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            height, width = (batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("height", "width"))
            for poly, y, x0, x1 in filled(_edges(batch.column("rings")), height, width, union):
                rows = pa.array(poly)
                yield pa.RecordBatch.from_arrays([*[batch.column(k).take(rows) for k in keys], *[pa.array(v.astype(np.int32)) for v in (y, x0, x1)]], [*keys, "y", "x0", "x1"])

    return run


def rings_to_runs(polygons: DataFrame, images: DataFrame, keys: Sequence[str], rule: str = "union") -> DataFrame:
    """Fill polygons of several rings into runs: a pixel counts when its centre is inside, clipped to the image.

    `polygons` has the keys and `rings`, a list of flat lists x1, y1, x2, y2, ... By `union` a pixel is in if any ring (even-odd)
    holds it, as annotations of several parts mean it; by `evenodd` rings inside others are holes. Rings with fewer than three points
    or a missing or non-finite coordinate are left out; a polygon without a ring or an image gives no runs. Axis-aligned integer boxes are exact.
    Runs of a row do not overlap. The work is edges and crossings, sorted; nothing is shuffled but for the join with the images.
    """
    if rule not in ("union", "evenodd"):
        raise ValueError(f"unknown fill rule {rule}")
    keys = list(keys)
    known = images.where("width is not null and height is not null").select("image_id", "width", "height")
    base = polygons.where("rings is not null").join(known, "image_id").select(*keys, F.col("rings").cast("array<array<double>>").alias("rings"), "width", "height")
    kinds = StructType([*[base.schema[k] for k in keys], *[StructField(c, IntegerType()) for c in ("y", "x0", "x1")]])
    return base.mapInArrow(_rasterise(keys, rule == "union"), kinds)


def polygon_to_runs(polygons: DataFrame, images: DataFrame, keys: Sequence[str]) -> DataFrame:
    """`rings_to_runs` of single outlines in `ring`, filled even-odd."""
    return rings_to_runs(polygons.select(*keys, F.array("ring").alias("rings")), images, keys, "evenodd")
