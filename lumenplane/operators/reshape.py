"""Re-indexing and reshaping of planes: composable DataFrame transformations.

Planes are rows (dataset_id, z, c, t, samples array<double>); `df.transform(f)` chains them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenplane.functions import geometry

#: What planes of one merged plane have in common, as far as they bear it.
SAME = ("dataset_id", "series", "resolution", "z", "t", "x", "y", "width", "height", "pixel_type", "little_endian")


def separate_channels(planes: DataFrame, samples: int, interleaved: bool | Column = True, rgb: Column | None = None) -> DataFrame:
    """Each component becomes a plane of its own, behind its channel's earlier ones.

    interleaved: whether a pixel's components lie together, or each component's pixels. rgb: whether a
    plane is RGB and not indexed (all are, without it); others stay as they are.
    """
    rgb, together = F.lit(True) if rgb is None else rgb, F.lit(interleaved) if isinstance(interleaved, bool) else interleaved
    last = F.when(rgb, F.lit(samples - 1)).otherwise(0)
    split = planes.withColumn("component", F.explode(F.sequence(F.lit(0), last)))
    length = F.floor(F.size("samples") / samples).cast("int")
    planar = F.slice("samples", F.col("component") * length + 1, length)
    own = F.when(~rgb, F.col("samples")).when(together, geometry.components(F.col("samples"), samples, F.col("component"))).otherwise(planar)
    c = F.when(rgb, F.col("c") * samples + F.col("component")).otherwise(F.col("c"))
    return split.withColumns({"c": c.cast("int"), "samples": own}).drop("component")


def separated_order(order: str) -> str:
    """The axis order of separated planes: components are the fastest axis."""
    return "XYCZT" if order.index("Z") < order.index("T") else "XYCTZ"


def merge_channels(planes: DataFrame, size_c: Column | None = None) -> DataFrame:
    """The two to four one-sample channels of each Z and T as one planar RGB plane (its c is 0); others stay.

    Planes are one where they agree in series, resolution, window and type. Rows have the columns of SAME
    that planes have, c and samples; a group holds no more planes than there are channels. size_c: how many
    channels a dataset has (without it, those at hand), where planes may be missing: samples of a channel that is
    not there are null, and a further column `channels` tells which are (null for planes that stay).
    """
    keys = [k for k in SAME if k in planes.columns]
    own = F.col("samples_per_pixel") if "samples_per_pixel" in planes.columns else F.lit(1)
    size = F.max(F.lit(None).cast("int") if size_c is None else size_c.cast("int"))
    parts = planes.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("c", "samples"))).alias("parts"), F.max(own).alias("own"), size.alias("size"))
    if size_c is None:
        merged, count, more = F.flatten(F.transform("parts", lambda p: p["samples"])), F.size("parts"), []
    else:
        missing = F.array_repeat(F.lit(None).cast("double"), F.size(F.get("parts", F.lit(0))["samples"]))
        at = lambda i: F.coalesce(F.get(F.filter("parts", lambda p: p["c"] == i), F.lit(0))["samples"], missing)
        merged, count, more = F.flatten(F.transform(F.sequence(F.lit(0), F.col("size") - 1), at)), F.col("size"), ["channels"]
    few = count.between(2, 4) & (F.col("own") == 1)
    one = F.array(F.struct(F.lit(0).alias("c"), merged.alias("samples"), F.transform("parts", lambda p: p["c"]).alias("channels")))
    each = F.transform("parts", lambda p: F.struct(p["c"].alias("c"), p["samples"].alias("samples"), F.lit(None).cast("array<int>").alias("channels")))
    return parts.select(*keys, F.explode(F.when(few, one).otherwise(each)).alias("p")).select(*keys, *[f"p.{n}" for n in ("c", "samples", *more)])


def fill_channels(planes: DataFrame, red: Column, green: Column, blue: Column, interleaved: bool = True) -> DataFrame:
    """Palette indexes become red, green and blue samples; an index out of range gives 0."""
    tables = [geometry.lookup(F.col("samples"), t) for t in (red, green, blue)]
    if interleaved:
        out = F.flatten(F.transform(F.arrays_zip(*[t.alias(n) for t, n in zip(tables, "rgb")]), lambda p: F.array(p["r"], p["g"], p["b"])))
    else:
        out = F.concat(*tables)
    return planes.withColumn("samples", out)


def swap_dimensions(levels: DataFrame, source: str, target: str) -> DataFrame:
    """Relabel the sizes: what lay at an axis of the source order now bears the target's letter there."""
    sizes = {b: F.col(f"size_{a.lower()}") for a, b in zip(source[2:], target[2:])}
    if source.index("C") != target.index("C"):  # the check is part of a size, or it would be pruned
        several = F.raise_error(F.lit("InvalidData: C cannot move with several samples")).cast("int")
        sizes["C"] = F.when(F.col("samples_per_pixel") > 1, several).otherwise(sizes["C"])
    return levels.select(*[c for c in levels.columns if c not in ("size_z", "size_c", "size_t")], *[sizes[a].alias(f"size_{a.lower()}") for a in "ZCT"])


def reorder(planes: DataFrame, order: str, sizes: tuple[Column, Column, Column], checked: bool = True) -> DataFrame:
    """plane_index by another axis order; coordinates and pixels stay. Unless checked, planes beyond the sizes have one, too."""
    return planes.withColumn("plane_index", geometry.plane_index(order, sizes, F.col("z"), F.col("c"), F.col("t"), checked))


def stitch(planes: DataFrame, files: DataFrame) -> DataFrame:
    """Planes of many files as one dataset.

    planes: dataset_id (a file), z, c, t; files: dataset_id, file_z, file_c, file_t and the sizes
    base_z, base_c, base_t of one file. A file's place shifts its planes by whole files.
    """
    moved = planes.join(files, "dataset_id")
    for a in "zct":
        moved = moved.withColumn(a, (F.col(f"file_{a}") * F.col(f"base_{a}") + F.col(a)).cast("int"))
    return moved.drop(*[f"{p}_{a}" for p in ("file", "base") for a in "zct"])


def undo_predictor(planes: DataFrame, width: int, modulus: int) -> DataFrame:
    """Horizontal differences of whole samples summed along rows of `width`, modulo their range, in one Arrow pass."""
    at = planes.columns.index("samples")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            lists = batch.column(at)
            flat = lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            summed = (np.cumsum(flat.astype(np.int64), axis=1) % modulus).ravel()
            offsets = pa.array(np.asarray(lists.offsets) - lists.offsets[0].as_py(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(offsets, pa.array(summed)) if k == at else c for k, c in enumerate(batch.columns)], names=batch.schema.names)

    kinds = ", ".join(f"`{f.name}` {'array<bigint>' if f.name == 'samples' else f.dataType.simpleString()}" for f in planes.schema.fields)
    return planes.mapInArrow(run, kinds)
