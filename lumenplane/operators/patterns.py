"""File patterns such as `image_Z<00-12:2>T<0-9>.tif`: expansion, inference and axis guesses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_BLOCK = "<([^<>]*)>"
_RANGE = "^([+-]?[0-9]+)-([+-]?[0-9]+)(?::([^:]*))?.*$"


def block_values(block: Column) -> Column:
    """The numbers of one block, padded to its widest bound; empty if it ends before it starts."""
    a, b = F.regexp_extract(block, _RANGE, 1), F.regexp_extract(block, _RANGE, 2)
    step = F.greatest(F.coalesce(F.regexp_extract(block, _RANGE, 3).try_cast("int"), F.lit(1)), F.lit(1))
    low, high, width = a.try_cast("int"), b.try_cast("int"), F.greatest(F.length(a), F.length(b))
    return F.when(low <= high, F.transform(F.sequence(low, high, step), lambda v: F.lpad(v.cast("string"), F.greatest(width, F.length(v.cast("string"))), F.lit("0")))).otherwise(F.array().cast("array<string>"))


def expand(patterns: DataFrame, blocks: int, column: str = "pattern") -> DataFrame:
    """Rows (pattern, file_index, file, digits, lengths): the product of the blocks' values, the last fastest.

    digits are the positions of a file's values in their blocks, lengths the blocks' numbers of values.
    `blocks` is the largest number of blocks that a pattern has; one of more is an error.
    """
    literals, inner = F.split(F.col(column), _BLOCK), F.regexp_extract_all(F.col(column), F.lit(_BLOCK), F.lit(1))
    many = F.raise_error(F.concat(F.lit(f"InvalidData: more than {blocks} blocks in "), F.col(column))).cast("array<string>")
    rows = patterns.withColumn("__lit", literals).withColumn("__blk", F.when(F.size(inner) > blocks, many).otherwise(inner))
    name, index = F.get("__lit", F.lit(0)), F.lit(0).cast("bigint")
    for k in range(blocks):
        # a block that a pattern lacks stands for nothing, once
        values = F.when(F.size("__blk") > k, block_values(F.get("__blk", F.lit(k)))).otherwise(F.array(F.lit("")))
        rows = rows.withColumn(f"__n{k}", F.size(values)).select("*", F.posexplode(values).alias(f"__p{k}", f"__v{k}"))
        name = F.concat(name, F.col(f"__v{k}"), F.coalesce(F.get("__lit", F.lit(k + 1)), F.lit("")))
        index = index * F.col(f"__n{k}") + F.col(f"__p{k}")
    each = lambda prefix: F.slice(F.array(*[F.col(f"__{prefix}{k}").cast("int") for k in range(blocks)]).cast("array<int>"), F.lit(1), F.size("__blk"))
    return rows.select(*patterns.columns, index.alias("file_index"), name.alias("file"), each("p").alias("digits"), each("n").alias("lengths"))


def infer(names: DataFrame, column: str = "name") -> DataFrame:
    """Patterns (folder, skeleton, files, pattern) of names in one folder that differ in numbers only; bounds are the least and greatest as text."""
    folder, name = F.regexp_extract(column, "^(.*/)?", 0), F.regexp_extract(column, "([^/]*)$", 1)
    skeleton, digits = F.regexp_replace(name, "[0-9]+", "#"), F.regexp_extract_all(name, F.lit("([0-9]+)"), F.lit(1))
    one = names.select(folder.alias("folder"), skeleton.alias("skeleton"), F.posexplode_outer(digits).alias("k", "n"))
    ends = one.where("k is not null").groupBy("folder", "skeleton", "k").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.count(F.lit(1)).alias("files"))
    block = F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(F.concat(F.lit("<"), "low", F.lit("-"), "high", F.lit(">")))
    parts = ends.groupBy("folder", "skeleton").agg(F.array_sort(F.collect_list(F.struct("k", block.alias("b")))).alias("parts"), F.max("files").alias("files"))
    between = F.split("skeleton", "#")
    filled = F.array_join(F.transform(F.arrays_zip(F.slice(between, F.lit(1), F.size("parts")).alias("s"), F.col("parts.b").alias("b")), lambda p: F.concat(p["s"], p["b"])), "")
    return parts.select("folder", "skeleton", "files", F.concat("folder", filled, F.element_at(between, -1)).alias("pattern"))


def axis_hint(before: Column, after: Column) -> Column:
    """Z, C, T or S by the nearest letter before the block, else behind it; null if neither tells."""
    letter = F.upper(F.coalesce(F.nullif(F.regexp_extract(before, "([A-Za-z])[^A-Za-z]*$", 1), F.lit("")), F.nullif(F.regexp_extract(after, "([A-Za-z])", 1), F.lit(""))))
    return F.when(letter.isin("Z", "C", "T", "S"), letter)


def guess_axes(hints: list[str | None], size_z: int, size_t: int, channels: int) -> list[str | None]:
    """An axis for each block: its hint, else the first of Z, T and C that the files do not use."""
    free = [a for a, ok in (("Z", size_z == 1), ("T", size_t == 1), ("C", channels <= 1)) if ok]
    return [h or (free.pop(0) if free else None) for h in hints]


def file_places(files: DataFrame, axes: list[str | None]) -> DataFrame:
    """file_z, file_c and file_t of expanded files: blocks of one axis count together, the last fastest."""
    for axis in "ZCT":
        place = F.lit(0)
        for k, a in enumerate(axes):
            if a == axis:
                place = place * F.col("lengths").getItem(k) + F.col("digits").getItem(k)
        files = files.withColumn(f"file_{axis.lower()}", place.cast("int"))
    return files
