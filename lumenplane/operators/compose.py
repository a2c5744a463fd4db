"""Blocks and windows: interval joins over grid cells, and mosaics in which later blocks lie on top."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _cells(df: DataFrame, grid: int, prefix: str) -> DataFrame:
    cell = lambda v, n: F.sequence(F.floor(F.col(v) / grid), F.floor((F.col(v) + F.col(n) - 1) / grid))
    return df.withColumn(f"{prefix}_gx", F.explode(cell("x", "width"))).withColumn(f"{prefix}_gy", F.explode(cell("y", "height")))


def overlapping(tiles: DataFrame, windows: DataFrame, keys: list[str], grid: int = 512) -> DataFrame:
    """Pairs of a tile (tile_seq) and a window (window_id) that meet, with the rectangle they share.

    Both sides are dealt to the grid cells that they touch and equi-joined; a pair is kept in the cell
    of its shared rectangle's corner alone, so that none comes twice.
    """
    t = _cells(tiles.select(*keys, "tile_seq", "x", "y", "width", "height"), grid, "t").alias("t")
    w = _cells(windows.select(*keys, "window_id", "x", "y", "width", "height"), grid, "w").alias("w")
    on = [F.col(f"t.{k}") == F.col(f"w.{k}") for k in keys] + [F.col("t_gx") == F.col("w_gx"), F.col("t_gy") == F.col("w_gy")]
    x0, y0 = F.greatest("t.x", "w.x"), F.greatest("t.y", "w.y")
    x1, y1 = F.least(F.col("t.x") + F.col("t.width"), F.col("w.x") + F.col("w.width")), F.least(F.col("t.y") + F.col("t.height"), F.col("w.y") + F.col("w.height"))
    met = t.join(w, on).where((x0 < x1) & (y0 < y1) & (F.floor(x0 / grid) == F.col("t_gx")) & (F.floor(y0 / grid) == F.col("t_gy")))
    return met.select(*[F.col(f"t.{k}").alias(k) for k in keys], "tile_seq", "window_id", x0.alias("x"), y0.alias("y"), (x1 - x0).alias("width"), (y1 - y0).alias("height"))


def mosaic_blocks(tiles: DataFrame, keys: list[str], grid: int = 512) -> DataFrame:
    """Blocks (keys, x, y, width, height, samples) of a canvas on which tiles (tile_seq, x, y, width, samples) lie: the last tile wins.

    Tiles are cut along a grid in one Arrow pass, pieces are dealt by their cell, and a second pass paints each
    cell: what crosses the network are the tiles' samples, once and as arrays. Places without a tile are null.
    """
    own = [tiles.schema[k] for k in keys]
    place = [T.StructField(n, T.LongType()) for n in ("gx", "gy", "tile_seq", "x", "y", "width")]
    piece = T.StructType([*own, *place, T.StructField("samples", T.ArrayType(T.DoubleType()))])
    rows = tiles.select(*keys, *[F.col(n).cast("bigint").alias(n) for n in ("tile_seq", "x", "y", "width")], F.col("samples").cast("array<double>").alias("samples"))

    def cut(batches):
        for batch in batches:
            source, numbers, samples = [], [], []
            seq, xs, ys, widths = (batch.column(len(keys) + i).to_pylist() for i in range(4))
            for i in range(batch.num_rows):
                values = batch.column(len(keys) + 4)[i].values.to_numpy(zero_copy_only=False)
                image = values.reshape(-1, widths[i])
                x0, y0, y1, x1 = xs[i], ys[i], ys[i] + image.shape[0], xs[i] + widths[i]
                for gy in range(y0 // grid, (y1 - 1) // grid + 1):
                    for gx in range(x0 // grid, (x1 - 1) // grid + 1):
                        left, top, right, bottom = max(x0, gx * grid), max(y0, gy * grid), min(x1, (gx + 1) * grid), min(y1, (gy + 1) * grid)
                        source.append(i)
                        numbers.append((gx, gy, seq[i], left, top, right - left))
                        samples.append(image[top - y0 : bottom - y0, left - x0 : right - x0].ravel())
            if source:
                at = pa.array(source)
                columns = [batch.column(k).take(at) for k in range(len(keys))] + [pa.array(c, pa.int64()) for c in zip(*numbers)]
                yield pa.RecordBatch.from_arrays([*columns, _lists(samples)], names=piece.names)

    cells = rows.mapInArrow(cut, piece).groupBy(*keys, "gx", "gy").agg(F.array_sort(F.collect_list(F.struct("tile_seq", "x", "y", "width", "samples"))).alias("pieces"))
    block = T.StructType([*own, *[T.StructField(n, T.LongType()) for n in ("x", "y", "width", "height")], T.StructField("samples", T.ArrayType(T.DoubleType()))])

    def paint(batches):
        for batch in batches:
            places, samples = [], []
            for i in range(batch.num_rows):
                held = batch.column(len(keys) + 2)[i].values
                xs, ys, widths = (held.field(n).to_numpy() for n in ("x", "y", "width"))
                images = [held.field("samples")[k].values.to_numpy(zero_copy_only=False).reshape(-1, w) for k, w in enumerate(widths.tolist())]
                x0, y0 = int(xs.min()), int(ys.min())
                wide, high = int((xs + widths).max()) - x0, max(int(y) + im.shape[0] for y, im in zip(ys, images)) - y0
                canvas, covered = np.zeros((high, wide)), np.zeros((high, wide), bool)
                for x, y, image in zip((xs - x0).tolist(), (ys - y0).tolist(), images):
                    canvas[y : y + image.shape[0], x : x + image.shape[1]] = image
                    covered[y : y + image.shape[0], x : x + image.shape[1]] = True
                places.append((x0, y0, wide, high))
                samples.append(pa.array(canvas.ravel(), mask=~covered.ravel()))
            if places:
                yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(keys))), *(pa.array(c, pa.int64()) for c in zip(*places)), _lists(samples)], names=block.names)

    return cells.mapInArrow(paint, block)


def _lists(parts: list) -> pa.Array:
    """Arrays as one list array."""
    offsets = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.concat_arrays([p if isinstance(p, pa.Array) else pa.array(p, pa.float64()) for p in parts]))


def mosaic(tiles: DataFrame, keys: list[str]) -> DataFrame:
    """Pixels (keys, y, x, value) of tiles (tile_seq, x, y, width, samples): the last tile wins."""
    px = mosaic_blocks(tiles, keys).select(*keys, "x", "y", "width", F.posexplode("samples").alias("i", "value")).where("value is not null")
    return px.select(*keys, (F.col("y") + F.floor(F.col("i") / F.col("width"))).cast("int").alias("y"), (F.col("x") + F.pmod(F.col("i").cast("bigint"), F.col("width"))).cast("int").alias("x"), "value")


def extents(tiles: DataFrame, keys: list[str]) -> DataFrame:
    """The canvas of each group of tiles."""
    return tiles.groupBy(*keys).agg(F.min("x").alias("min_x"), F.min("y").alias("min_y"), F.max(F.col("x") + F.col("width")).alias("max_x"), F.max(F.col("y") + F.col("height")).alias("max_y"), F.count(F.lit(1)).alias("tiles"))
