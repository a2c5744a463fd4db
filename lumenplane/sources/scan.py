"""Image files as DataFrames: format detection, levels, planes and windows of pixels.

Files are rows of a path, listed by Spark's binaryFile source without their contents: headers and blocks
are read by ranges in the tasks that need them, and no file's bytes ever cross a shuffle. Rows that hold
contents (path, content), from any DataFrame, serve as well. Index tables never hold pixels; decoding is
one Arrow pass over datasets joined to the requests for them, and decodes only blocks that meet a window.
"""

from __future__ import annotations

import contextlib
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenplane.sources import czi, nd2, tiff, volumes
from lumenplane.sources.files import RangedFile
from lumenplane.sources.model import ImageError, Level, pixels, plane_coordinates, plane_index

# Formats in the order of detection, with their extensions.
FORMATS = (
    ("tiff", ("tif", "tiff", "tf2", "tf8", "btf", "ome")), ("czi", ("czi",)), ("nd2", ("nd2",)), ("nrrd", ("nrrd", "nhdr")), ("dcimg", ("dcimg",)),
    ("mrc", ("mrc", "mrcs", "map", "st", "ali", "rec", "ccp4")),
)
# Formats by the bytes at a place, in the order of detection; MRC has no such mark.
MARKS = (("tiff", 0, b"II\x2a\x00"), ("tiff", 0, b"MM\x00\x2a"), ("tiff", 0, b"II\x2b\x00"), ("tiff", 0, b"MM\x00\x2b"), ("czi", 0, b"ZISRAWFILE"), ("nd2", 0, nd2.MARK), ("nd2", 4, b"jP  "), ("nrrd", 0, b"NRRD"), ("dcimg", 0, b"DCIMG"))
#: Requests of at most so many bytes are broadcast.
TOLD_BYTES = 32 << 20
#: Bytes that detection looks at.
HEAD = 4096

FILES = "dataset_id string, format string, files array<struct<path:string,content:binary,length:long,modificationTime:timestamp>>"
LEVELS = (
    "dataset_id string, format string, series int, resolution int, resolution_count int, size_x int, size_y int, size_z int, size_c int, size_t int, image_count int, "
    "logical_channels int, pixel_type string, bits_per_pixel int, samples_per_pixel int, dimension_order string, is_rgb boolean, is_interleaved boolean, is_indexed boolean, "
    "is_false_color boolean, is_little_endian boolean, physical_size_x_um double, physical_size_y_um double, physical_size_z_um double, time_increment_seconds double, "
    "acquisition_timestamp string, objective_model string, objective_magnification double, objective_na double, channels string, lookup_table string, metadata string"
)
TILES = "dataset_id string, series int, resolution int, plane_index int, z int, c int, t int, tile_seq int, source int, offset long, length long, codec string, x int, y int, width int, height int"
PLANE_INFO = "dataset_id string, series int, plane_index int, z int, c int, t int, delta_t_seconds double, position_x_um double, position_y_um double, position_z_um double, exposure_seconds double"
PLANES = "dataset_id string, series int, resolution int, plane_index int, z int, c int, t int, x int, y int, width int, height int, pixel_type string, samples_per_pixel int, interleaved boolean, little_endian boolean, data binary, samples array<double>"


def supported_formats(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, n, list(e)) for i, (n, e) in enumerate(FORMATS)], "priority int, format string, extensions array<string>")


def load_files(spark: SparkSession, path: str, glob: str | None = None, content: bool = False) -> DataFrame:
    """path, length and modificationTime of files, and their content only if it is wanted."""
    reader = spark.read.format("binaryFile")
    found = (reader.option("pathGlobFilter", glob) if glob else reader).load(path)
    return found if content else found.drop("content")


def _i32(content: Column, offset: int, little: bool) -> Column:
    digits = F.hex(F.substring(content, offset + 1, 4))
    if little:
        digits = F.concat(*[F.substring(digits, i, 2) for i in (7, 5, 3, 1)])
    value = F.conv(digits, 16, 10).cast("bigint")
    return F.when(value >= 1 << 31, value - (1 << 32)).otherwise(value)


def detect(head: Column, path: Column) -> Column:
    """The format by a file's first bytes, in a fixed order, else by extension; null if neither tells."""
    plausible = F.lit(False)
    for little in (True, False):
        sizes = [_i32(head, o, little) for o in (0, 4, 8)]
        plausible = plausible | (_i32(head, 12, little).isin(*volumes.MRC_MODES) & (_i32(head, 92, little) >= 0) & (F.least(*sizes) > 0))
    extension = F.lower(F.regexp_extract(path, "\\.([^./]+)$", 1))
    by_name = F.coalesce(*[F.when(extension.isin(*e), n) for n, e in FORMATS])
    marked = F.coalesce(*[F.when(F.substring(head, at + 1, len(mark)) == F.lit(bytearray(mark)), n) for n, at, mark in MARKS])
    return F.coalesce(marked, F.when((F.octet_length(head) >= 1024) & plausible, "mrc"), by_name)


def _companions(path: str, data) -> tuple[str | None, str | None]:
    """The data file that an NRRD header names, and the key of an OME set; what cannot be read tells nothing yet."""
    name = path.rpartition("/")[2]
    try:
        if data[:4] == b"NRRD":
            return volumes.nrrd_companion(data), None
        if data[:2] in (b"II", b"MM") or name.lower().endswith(".ome"):
            return None, tiff.ome_group(name, data)
    except ImageError:
        pass
    return None, None


def _with_heads(files: DataFrame) -> DataFrame:
    """path, content (null where it is not given), length, modificationTime, head, wanted (an NRRD header's data file) and ome (the key of an OME set)."""
    listed = "content" not in files.columns
    empty = {"content": "binary", "length": "long", "modificationTime": "timestamp"}
    told = files.select("path", *[F.col(n) if n in files.columns else F.lit(None).cast(kind).alias(n) for n, kind in empty.items()])

    def look(batches):
        for batch in batches:
            heads, wanted, groups = [], [], []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = RangedFile(path) if listed else content.as_py() or b""
                heads.append(data[:HEAD])
                other, group = _companions(path, data)
                wanted.append(other)
                groups.append(group)
                if listed:
                    data.close()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(heads, pa.binary()), pa.array(wanted, pa.string()), pa.array(groups, pa.string())], names=[*batch.schema.names, "head", "wanted", "ome"])

    schema = ", ".join(["path string", *(f"{n} {kind}" for n, kind in empty.items()), "head binary, wanted string, ome string"])
    return (told.dropDuplicates(["path"]) if listed else told).mapInArrow(look, schema)


def datasets(files: DataFrame) -> DataFrame:
    """(dataset_id, format, files): files that belong together, the primary one first.

    Parts of a split CZI and the DCIMG files of a folder are siblings; a detached NRRD data file is the
    named companion of its header, and an error if it is missing; the files of an OME set belong to the
    document that tells of all of them, or to the first of their names. Paths are grouped (a path listed twice
    is one file), and contents only where rows hold them.
    """
    folder, name = F.regexp_extract("path", "^(.*/)?[^/]*$", 1), F.regexp_extract("path", "([^/]*)$", 1)
    told = _with_heads(files).withColumn("format", detect(F.col("head"), F.col("path"))).drop("head").withColumns({"folder": folder, "name": name})
    needed = told.where("wanted is not null").select(F.concat("folder", "wanted").alias("path"), F.col("path").alias("header")).dropDuplicates(["path"])
    joined = told.join(needed, "path", "left")
    part = F.coalesce(F.regexp_extract("name", "\\((\\d+)\\)\\.[cC][zZ][iI]$", 1).try_cast("int"), F.lit(0))
    group = (
        F.when(F.col("header").isNotNull(), F.col("header"))
        .when(F.col("format") == "dcimg", F.concat("folder", F.lit("*.dcimg")))
        .when(F.col("ome").isNotNull(), F.concat("folder", "ome"))
        .when(F.col("format") == "czi", F.concat("folder", F.regexp_replace("name", "(?i) ?\\(\\d+\\)(?=\\.czi$)", "")))
        .otherwise(F.col("path"))
    )
    later = F.col("header").isNotNull() | (F.col("ome").isNotNull() & (F.col("ome") != F.col("name")))
    rank = F.when(later, 1).otherwise(F.when(F.col("format") == "czi", part).otherwise(0))
    known = joined.where(F.col("format").isNotNull() | F.col("header").isNotNull())
    held = F.struct(rank.alias("rank"), "path", "content", "length", "modificationTime", "format")
    grouped = known.groupBy(group.alias("dataset_id")).agg(F.array_sort(F.collect_list(held)).alias("f"))
    return grouped.select("dataset_id", F.get("f", F.lit(0))["format"].alias("format"), F.transform("f", lambda f: F.struct(f["path"].alias("path"), f["content"].alias("content"), f["length"].alias("length"), f["modificationTime"].alias("modificationTime"))).alias("files"))


def _kind(data, path: str) -> str | None:
    """The format of a file that comes without one, by the same marks."""
    marked = next((n for n, at, mark in MARKS if data[at : at + len(mark)] == mark), None)
    extension = path.rpartition(".")[2].lower()
    return marked or ("mrc" if volumes.is_mrc(data) else next((n for n, e in FORMATS if extension in e), None))


def used_files(sets: DataFrame) -> DataFrame:
    """dataset_id and path of every file that a dataset consists of, the primary one first (position 0)."""
    return sets.select("dataset_id", F.posexplode("files.path").alias("position", "path"))


def parse(files: list[tuple], kind: str | None = None) -> tuple[str, list[list[Level]]]:
    """The format and the series of a dataset's files (path, bytes or ranged file); an error after a match is final."""
    (path, data), names = files[0], [p for p, _ in files]
    kind = kind or _kind(data, path)
    if kind == "tiff":
        base = [n.rpartition("/")[2] for n in names]
        series = tiff.tiff(data, dict(zip(base[1:], (d for _, d in files[1:]))), base[0])
    elif kind == "czi":
        series = czi.czi([d for _, d in files])
    elif kind == "nd2":
        series = nd2.nd2(data)
    elif kind == "nrrd":
        if volumes.nrrd_companion(data) is not None and len(files) < 2:
            raise ImageError("Format", "NRRD data file is missing")
        series = volumes.nrrd(data, files[1][1] if len(files) > 1 else None)
    elif kind == "dcimg":
        series = volumes.dcimg(files)
    elif kind == "mrc":
        series = volumes.mrc(data)
    else:
        raise ImageError("Unsupported", path)
    for level in (x for s in series for x in s):
        level.check()
    return kind, series


@contextlib.contextmanager
def _opened(row: dict):
    """A dataset's files, its format and its series; what has been opened by path is closed again."""
    files = [(f["path"], RangedFile(f["path"]) if f["content"] is None else f["content"]) for f in row["files"]]
    try:
        yield [d for _, d in files], *parse(files, row["format"])
    finally:
        for _, d in files:
            if isinstance(d, RangedFile):
                d.close()


def _rows(schema: str, make):
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                rows = list(make(row))
                for i in range(0, len(rows), 64):
                    yield rows[i : i + 64]

    def columns(batches):
        kinds = _arrow(schema)
        for rows in run(batches):
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)

    return columns


def _arrow(schema: str) -> list:
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "binary": pa.binary(), "array<double>": pa.list_(pa.float64())}
    return [kinds[part.split()[1]] for part in schema.split(", ")]


def levels(sets: DataFrame) -> DataFrame:
    """One row per series and resolution."""

    def make(row):
        with _opened(row) as (_, kind, series):
            for s, group in enumerate(series):
                for r, v in enumerate(group):
                    yield (
                        row["dataset_id"], kind, s, r, len(group), v.size_x, v.size_y, v.size_z, v.size_c, v.size_t, v.image_count, v.logical_channels, v.pixel_type, v.bits, v.samples, v.order,
                        v.rgb, v.interleaved, v.indexed, v.false_color, v.little_endian, *v.physical, v.time_step, v.timestamp, *v.objective, json.dumps(v.channels), json.dumps(v.lut), json.dumps(v.extra, default=str),
                    )

    return sets.mapInArrow(_rows(LEVELS, make), LEVELS)


def tiles(sets: DataFrame) -> DataFrame:
    """One row per stored block: where it lies in its plane and in its file."""

    def make(row):
        with _opened(row) as (_, _, series):
            for s, group in enumerate(series):
                for r, v in enumerate(group):
                    for p, blocks in enumerate(v.planes):
                        z, c, t = plane_coordinates(v.order, (v.size_z, v.logical_channels, v.size_t), p)
                        for i, b in enumerate(blocks):
                            yield row["dataset_id"], s, r, p, z, c, t, i, b.source, b.offset, b.length, b.codec, b.x, b.y, b.width, b.height

    return sets.mapInArrow(_rows(TILES, make), TILES)


def planes(sets: DataFrame) -> DataFrame:
    """One row per plane: its coordinates, and the time, place and exposure that its file tells or implies."""

    def make(row):
        with _opened(row) as (_, _, series):
            for s, group in enumerate(series):
                v = group[0]
                for p in range(v.image_count):
                    z, c, t = plane_coordinates(v.order, (v.size_z, v.logical_channels, v.size_t), p)
                    told = v.plane_info[p] if p < len(v.plane_info) else {}
                    delta = told.get("delta_t")
                    yield row["dataset_id"], s, p, z, c, t, delta if delta is not None else None if v.time_step is None else v.time_step * t, *(told.get(f"position_{a}") for a in "xyz"), told.get("exposure")

    return sets.mapInArrow(_rows(PLANE_INFO, make), PLANE_INFO)


def read(sets: DataFrame, requests: DataFrame | None = None, samples: bool = True, everywhere: list[dict] | None = None) -> DataFrame:
    """Pixels of the planes asked for, as bytes and (if wanted) as doubles.

    requests: dataset_id, series, resolution, plane_index or z, c and t, x, y, width, height; a null width
    or height reaches to the edge, a null x or y is 0, a column that is missing is null; byte_len, if given,
    is what the window's bytes must come to, or an error is raised. everywhere: such
    requests as dicts, for every dataset and without a join. Without either every plane of full
    resolution is read. Requests of a small size are told to all tasks instead of moving the datasets.
    """
    names = ("series", "resolution", "plane_index", "z", "c", "t", "x", "y", "width", "height", "byte_len")
    wanted = f"array<struct<{','.join(f'{n}:bigint' for n in names)}>>"
    if everywhere is not None:
        asked = sets.withColumn("wanted", F.array(*[F.struct(*[F.lit(q.get(n)).cast("bigint").alias(n) for n in names]) for q in everywhere]).cast(wanted))
    elif requests is None:
        asked = sets.withColumn("wanted", F.lit(None).cast(wanted))
    else:
        part = F.struct(*[(F.col(n) if n in requests.columns else F.lit(None)).cast("bigint").alias(n) for n in names])
        told = requests.groupBy("dataset_id").agg(F.collect_list(part).alias("wanted"))
        size = int(str(requests._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        asked = sets.join(F.broadcast(told) if size <= TOLD_BYTES else told, "dataset_id")

    def make(row):
        with _opened(row) as (files, _, series):
            todo = row["wanted"]
            if todo is None:
                todo = [{"series": s, "plane_index": p} for s, group in enumerate(series) for p in range(group[0].image_count)]
            for q in todo:
                s, r = q["series"] or 0, q.get("resolution") or 0
                if not 0 <= s < len(series) or not 0 <= r < len(series[s]):
                    raise ImageError("Range", f"series {s}, resolution {r}")
                v, x, y, at = series[s][r], q.get("x") or 0, q.get("y") or 0, q.get("plane_index")
                sizes = v.size_z, v.logical_channels, v.size_t
                if at is None:
                    place = [q.get(a) or 0 for a in "zct"]
                    if not all(0 <= p < n for p, n in zip(place, sizes)):
                        raise ImageError("Range", f"plane at Z, C, T {place}")
                    at = plane_index(v.order, sizes, *place)
                w, h = (n if q.get(k) is None else q[k] for k, n in (("width", v.size_x - x), ("height", v.size_y - y)))
                data = pixels(v, at, files, x, y, w, h)
                if q.get("byte_len") not in (None, len(data)):
                    raise ImageError("Range", f"window of {len(data)} bytes instead of {q['byte_len']}")
                yield row["dataset_id"], s, r, at, *plane_coordinates(v.order, sizes, at), x, y, w, h, v.pixel_type, v.samples, v.interleaved, v.little_endian, data, np.frombuffer(data, v.dtype).astype(np.float64) if samples else None

    return asked.mapInArrow(_rows(PLANES, make), PLANES)


def thumbnails(sets: DataFrame, level_table: DataFrame) -> DataFrame:
    """A centre crop of at most 256 x 256 of each plane, from the smallest level."""
    last = level_table.where("resolution = resolution_count - 1")
    x, y = (F.greatest(F.lit(0), ((F.col(n) - 256) / 2).cast("int")) for n in ("size_x", "size_y"))
    asked = last.select("dataset_id", "series", "resolution", F.explode(F.sequence(F.lit(0), F.col("image_count") - 1)).alias("plane_index"), x.alias("x"), y.alias("y"), F.least("size_x", F.lit(256)).alias("width"), F.least("size_y", F.lit(256)).alias("height"))
    return read(sets, asked)


def flattened(level_table: DataFrame) -> DataFrame:
    """Each level as a series of its own: the levels of earlier series come first."""
    counts = level_table.where("resolution = 0").select("dataset_id", "series", "resolution_count")
    earlier = W.partitionBy("dataset_id").orderBy("series").rowsBetween(W.unboundedPreceding, -1)  # over the series of a dataset
    before = counts.select("dataset_id", "series", F.coalesce(F.sum("resolution_count").over(earlier), F.lit(0)).alias("before"))
    return level_table.join(before, ["dataset_id", "series"]).withColumn("flat_series", (F.col("before") + F.col("resolution")).cast("int")).drop("before")


__all__ = ["datasets", "detect", "flattened", "levels", "load_files", "parse", "planes", "read", "supported_formats", "thumbnails", "tiles", "used_files"]
