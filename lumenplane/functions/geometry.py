"""Plane indexes, windows and layouts as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenplane.sources.model import ORDERS, PIXELS


def _div(a: Column, b: Column) -> Column:
    return F.floor(a / b).cast("bigint")


def plane_coordinates(order: str, index: Column, z: Column, c: Column, t: Column) -> Column:
    """struct<z,c,t> of a plane: the axis named first is the fastest."""
    sizes, rest, out = {"Z": z, "C": c, "T": t}, index, {}
    for axis in order[2:]:
        out[axis] = F.pmod(rest, sizes[axis])
        rest = _div(rest, sizes[axis])
    return F.struct(*[out[a].cast("bigint").alias(a.lower()) for a in "ZCT"])


def plane_index(order: str, sizes: tuple[Column, Column, Column], z: Column, c: Column, t: Column, checked: bool = True) -> Column:
    """The plane's index; null if a coordinate is out of range, if that is checked."""
    size, at = dict(zip("ZCT", sizes)), dict(zip("ZCT", (z, c, t)))
    a, b, d = order[2:]
    index, inside = at[a] + size[a] * (at[b] + size[b] * at[d]), F.lit(True)
    for axis in "ZCT":
        inside = inside & (at[axis] >= 0) & (at[axis] < size[axis])
    return F.when(inside, index) if checked else index


def parse_order(order: Column) -> Column:
    return F.when(order.isin(*ORDERS), order)


def logical_channels(image_count: Column, z: Column, t: Column) -> Column:
    return F.when(F.pmod(image_count, z * t) == 0, _div(image_count, z * t)).otherwise(0)


def byte_length(width: Column, height: Column, samples: Column, pixel_type: Column) -> Column:
    """Bytes of a window; null on overflow or an unknown type."""
    size = F.coalesce(*[F.when(pixel_type == name, int(kind[1])) for name, kind in PIXELS.items()])
    return F.try_multiply(F.try_multiply(F.try_multiply(width.cast("bigint"), height.cast("bigint")), samples.cast("bigint")), size.cast("bigint"))


def window_fits(x: Column, y: Column, width: Column, height: Column, size_x: Column, size_y: Column) -> Column:
    return (width > 0) & (height > 0) & (x >= 0) & (y >= 0) & (x + width <= size_x) & (y + height <= size_y)


def crop(samples: Column, size_x: int, x: Column, y: Column, width: Column, height: Column) -> Column:
    """The window of a plane of one sample per pixel, rows in order."""
    return F.flatten(F.transform(F.sequence(y, y + height - 1), lambda r: F.slice(samples, r * size_x + x + 1, width)))


def components(samples: Column, count: int, component: Column) -> Column:
    """One component of interleaved samples."""
    return F.transform(F.sequence(F.lit(0), F.floor(F.size(samples) / count).cast("int") - 1), lambda i: F.get(samples, i * count + component))


def lookup(indices: Column, table: Column) -> Column:
    """Palette entries; an index out of range gives 0."""
    return F.transform(F.array(table), lambda t: F.transform(indices, lambda i: F.coalesce(F.get(t, i.cast("int")), F.lit(0)))).getItem(0)


def lookup_ramp(peak: Column, entries: int) -> Column:
    """A channel's ramp of 256 or 65536 entries: peak times i / 255, truncated, at most 65535."""
    return F.transform(F.sequence(F.lit(0), F.lit(entries - 1)), lambda i: F.least(F.lit(65535), F.floor(peak.cast("double") * (i / F.lit(255.0))).cast("int")))
