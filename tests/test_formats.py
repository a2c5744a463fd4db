"""Parsers, codecs and decoding on generated files with literal expectations."""

import json
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lumenplane.operators import patterns, reshape
from lumenplane.plans import fixtures
from lumenplane.sources import codecs, nd2, scan, tiff, volumes
from lumenplane.sources.model import ORDERS, ImageError, pixels, plane_coordinates, plane_index

RNG = np.random.default_rng(4)


def opened(name, data, *more):
    kind, series = scan.parse([(name, data), *more])
    return kind, series, [data, *(d for _, d in more)]


def whole(level, files, plane=0, window=()):
    data = pixels(level, plane, files, *window)
    return np.frombuffer(data, level.dtype)


@pytest.mark.parametrize("order", ORDERS)
def test_plane_indexes_are_inverse(order):
    sizes = (2, 3, 4)
    assert sorted(plane_index(order, sizes, *plane_coordinates(order, sizes, i)) for i in range(24)) == list(range(24))
    assert plane_index("XYCZT", sizes, 1, 2, 3) == 2 + 3 * (1 + 2 * 3)


def test_tiff_strip_window():
    data = fixtures.tiff(np.array([[[1, 2, 3], [4, 5, 6]]], "u1"), rows=2)
    kind, [[level]], files = opened("a.tif", data)
    assert kind == "tiff" and whole(level, files, 0, (1, 0, 2, 2)).tolist() == [2, 3, 5, 6]


def test_tiff_pages_are_one_time_series_only_if_alike():
    pages = RNG.integers(0, 255, (4, 3, 5)).astype("u1")
    _, series, files = opened("a.tif", fixtures.tiff(pages))
    assert len(series) == 1 and series[0][0].size_t == 4 and np.array_equal(whole(series[0][0], files, 2), pages[2].ravel())
    one, two = fixtures.tiff(pages[:1]), fixtures.tiff(pages[:1, :2])
    shift = len(one) + len(one) % 2
    moved = bytearray(two)  # chain the second file's directory behind the first's
    start = struct.unpack_from("<I", two, 4)[0]
    for i in range(struct.unpack_from("<H", two, start)[0]):
        at = start + 2 + 12 * i
        if struct.unpack_from("<H", two, at)[0] == 273:
            struct.pack_into("<I", moved, at + 8, struct.unpack_from("<I", two, at + 8)[0] + shift)
    both = bytearray(one.ljust(shift, b"\0") + moved)
    struct.pack_into("<I", both, len(one) - 4, start + shift)
    assert len(opened("b.tif", bytes(both))[1]) == 2


def test_imagej_hyperstack():
    pages = np.arange(12, dtype="u1").reshape(12, 1, 1)
    text = "ImageJ=1.53\nimages=12\nchannels=2\nslices=3\nframes=2\nunit=nm\nspacing=1.5\nfinterval=2.5\nslices =9\n"
    _, [[level]], files = opened("a.tif", fixtures.tiff(pages, description=text))
    assert (level.size_c, level.size_z, level.size_t, level.physical[2], level.time_step) == (2, 3, 2, 1.5, 2.5)
    assert whole(level, files, plane_index(level.order, (3, 2, 2), 1, 0, 1)).tolist() == [8]
    _, [[level]], _ = opened("a.tif", fixtures.tiff(pages, description="ImageJ=1\nchannels=5\n"))
    assert (level.size_z, level.size_t) == (1, 12)


def test_ome_tiff():
    pages = np.arange(6, dtype="u2").reshape(6, 1, 1)
    xml = '<?xml version="1.0"?><OME xmlns="o"><Image><AcquisitionDate>2020-01-02T03:04:05</AcquisitionDate><Pixels DimensionOrder="XYZCT" Type="uint16" SizeX="1" SizeY="1" SizeZ="3" SizeC="2" SizeT="1" PhysicalSizeX="250" PhysicalSizeXUnit="nm" SignificantBits="12">%s<TiffData IFD="3" FirstZ="0" PlaneCount="3"/><TiffData FirstC="1" IFD="0" PlaneCount="3"/>%s</Pixels></Image></OME>'
    _, [[level]], files = opened("a.ome.tif", fixtures.tiff(pages, description=xml % ("<Channel ID='c' EmissionWavelength='520'/>" * 2, "<Plane TheZ='1' TheC='0' TheT='0' DeltaT='500' DeltaTUnit='ms'/>")))
    assert (level.size_z, level.size_c, level.bits, level.timestamp) == (3, 2, 12, "2020-01-02T03:04:05")
    assert level.physical[0] == pytest.approx(0.25) and level.channels[0]["emission_nm"] == pytest.approx(520) and level.plane_info[1]["delta_t"] == pytest.approx(0.5)
    assert [whole(level, files, i)[0] for i in range(6)] == [3, 4, 5, 0, 1, 2]
    for wrong in ("<TiffData IFD='0' FirstZ='1'/>", "<Plane TheZ='0' TheC='0' TheT='0' PositionX='1'/>"):
        with pytest.raises(ImageError):
            opened("a.ome.tif", fixtures.tiff(pages, description=xml % ("", wrong)))


@pytest.mark.parametrize("bits", [*range(1, 8), *range(9, 16)])
def test_packed_samples(bits):
    values = RNG.integers(0, 1 << bits, (3, 10))
    rows = np.stack([np.packbits(np.concatenate([[int(b) for b in f"{v:0{bits}b}"] for v in row])) for row in values])
    out = codecs.unpack_bits(rows, 10, bits, np.dtype("u1" if bits < 8 else ">u2"))
    assert np.array_equal(out, values)


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=3000))
def test_lzw_round_trip(data):
    assert codecs.lzw(_lzw(data), len(data)) == data


def _lzw(data):
    table, width, bits, out = {bytes([i]): i for i in range(256)}, 9, [], b""
    size, put = 258, lambda code: bits.append(f"{code:0{width}b}")
    put(256)
    word = b""
    for byte in data:
        nxt = word + bytes([byte])
        if nxt in table:
            word = nxt
            continue
        put(table[word])
        table[nxt], size, word = size, size + 1, bytes([byte])
        width = 9 if size < 512 else 10 if size < 1024 else 11 if size < 2048 else 12
        if size == 4094:
            put(256)
            table, size, width = {bytes([i]): i for i in range(256)}, 258, 9
    if word:
        put(table[word])
        size += 1
        width = 9 if size < 512 else 10 if size < 1024 else 11 if size < 2048 else 12
    put(257)
    text = "".join(bits)
    text += "0" * (-len(text) % 8)
    return out + int(text, 2).to_bytes(len(text) // 8, "big")


def test_codecs_refuse_more_than_expected():
    for codec, data in (("zlib", zlib.compress(bytes(100))), ("packbits", b"\x9d\x07"), ("deflate", zlib.compress(bytes(100), wbits=-15))):
        with pytest.raises(ImageError):
            codecs.decode(codec, data, 50)
    assert codecs.decode("packbits", b"\x02abc\xfe\x07", 6) == b"abc\x07\x07\x07"
    for codec in ("jpegxr", "jpeg2000"):
        with pytest.raises(ImageError, match="Unsupported"):
            codecs.decode(codec, b"", 1)


def test_zstd_with_parted_bytes():
    import zstandard

    body = np.array([1, 2, 3, 4, 5, 6], np.uint8).tobytes()
    assert codecs.zstd_packed(b"\x03\x01\x01" + zstandard.compress(body), 6) == bytes([1, 4, 2, 5, 3, 6])
    assert codecs.zstd_packed(b"\x01" + zstandard.compress(body), 6) == body


def test_nrrd_inline_and_detached(spark):
    data = b"NRRD0004\ntype: uint16\ndimension: 2\nsizes: 2 2\nendian: little\nencoding: raw\n\n" + bytes([1, 0, 2, 0, 3, 0, 4, 0])
    _, [[level]], files = opened("a.nrrd", data)
    assert pixels(level, 0, files) == bytes([1, 0, 2, 0, 3, 0, 4, 0])
    head = b"NRRD0004\ntype: uint8\ndimension: 4\nsizes: 3 2 1 2\nencoding: raw\nbyte skip: 2\ndata file: b.raw\n"
    _, [[level]], files = opened("a.nhdr", head, ("b.raw", b"xx" + bytes(range(1, 13))))
    assert (level.size_c, level.size_x, level.size_y, level.size_z) == (3, 2, 1, 2) and list(pixels(level, 1, files)) == [7, 8, 9, 10, 11, 12]
    rows = spark.createDataFrame([("d/a.nhdr", bytearray(head)), ("d/b.raw", bytearray(b"xx" + bytes(range(1, 13)))), ("d/c.txt", bytearray(b"?"))], "path string, content binary")
    got = scan.read(scan.datasets(rows)).orderBy("plane_index").collect()
    assert [list(r.samples) for r in got] == [[1, 2, 3, 4, 5, 6], [7, 8, 9, 10, 11, 12]]
    for broken in (data.replace(b"endian: little\n", b""), data.replace(b"2 2", b"2 0"), data.replace(b"raw", b"bzip2"), head.replace(b"b.raw", b"LIST")):
        with pytest.raises(ImageError):
            opened("a.nrrd", broken)


def test_mrc_rows_are_turned_and_calibrated():
    data = bytearray(fixtures.mrc(np.array([[[1, 2], [3, 4]]], "i2")))
    struct.pack_into("<3i3f", data, 28, 2, 2, 1, 20000.0, 40000.0, 0.0)
    _, [[level]], files = opened("a.mrc", bytes(data))
    assert whole(level, files).tolist() == [1, 2, 3, 4] and whole(level, files, 0, (0, 1, 2, 1)).tolist() == [3, 4]
    assert level.physical == (1.0, 2.0, None)
    struct.pack_into("<2f", data, 76, 0.0, 40000.0)
    assert opened("a.mrc", bytes(data))[1][0][0].pixel_type == "uint16"
    with pytest.raises(ImageError):
        opened("a.mrc", bytes(data[:-1]))


def test_dcimg_turns_rows_within_the_window_and_corrects_four_pixels():
    frame = np.arange(1, 13, dtype="u1").reshape(1, 3, 4)
    _, [[level]], files = opened("a.dcimg", fixtures.dcimg(frame))
    assert whole(level, files, 0, (1, 0, 2, 2)).tolist() == [6, 7, 2, 3]
    frame = np.arange(1, 25, dtype="u1").reshape(1, 4, 6)
    data = bytearray(fixtures.dcimg(frame, footer=32))
    data[-20:-16] = bytes([101, 102, 103, 104])
    _, [[level]], files = opened("a.dcimg", bytes(data))
    assert whole(level, files).reshape(4, 6)[2].tolist() == [101, 102, 103, 104, 11, 12]
    group = [("z1.dcimg", fixtures.dcimg(frame + 50)), ("z0.dcimg", fixtures.dcimg(frame)), ("x.dcimg", b"no image")]
    level = volumes.dcimg(group)[0][0]
    assert (level.size_z, level.size_t) == (2, 1) and whole(level, [d for _, d in group], 1)[0] == 69
    with pytest.raises(ImageError):
        volumes.dcimg([*group, ("z2.dcimg", fixtures.dcimg(frame[:, :2]))])


def _tile(x, y, value, **more):
    return {"X": x, "Y": y, "width": 4, "height": 4, "data": bytes([value]) * 16, "C": 0, "T": 0} | more


def test_czi_mosaic_pyramid():
    native = [_tile(-4, -8, 1 + 100 * z, Z=z) for z in (0, 1)] + [_tile(2, -8, 2 + 100 * z, Z=z) for z in (0, 1)]
    small = [_tile(-4, -8, 0, Z=z) | {"stored": (2, 2), "data": bytes([21, 22, 121, 122]) if not z else bytes(4)} for z in (0, 1)] + [_tile(2, -8, 0, Z=z) | {"stored": (2, 2), "data": bytes([23, 24, 123, 124]) if not z else bytes(4)} for z in (0, 1)]
    _, [levels], files = opened("a.czi", fixtures.czi(native + small, 0))
    assert [(v.size_x, v.size_y, v.size_z) for v in levels] == [(10, 4, 2), (5, 2, 2)]
    assert whole(levels[1], files).tolist() == [21, 22, 0, 23, 24, 121, 122, 0, 123, 124]
    assert whole(levels[0], files, 1).reshape(4, 10)[0].tolist() == [101] * 4 + [0, 0] + [102] * 4


def test_czi_damaged_neighbour_is_not_read():
    _, [[level]], files = opened("a.czi", fixtures.czi([_tile(0, 0, 5), _tile(4, 0, 6, codec=4)], 0))
    assert set(whole(level, files, 0, (0, 0, 4, 4)).tolist()) == {5}
    with pytest.raises(ImageError):
        whole(level, files)


def test_czi_parts_and_identical_mosaics(spark):
    parts = [("d/a (1).czi", fixtures.czi([_tile(0, 0, 9, Z=1)], 0)), ("d/a.czi", fixtures.czi([_tile(0, 0, 8, Z=0)], 0))]
    got = scan.read(scan.datasets(spark.createDataFrame([(p, bytearray(d)) for p, d in parts], "path string, content binary"))).orderBy("z").collect()
    assert [(r.dataset_id, r.z, r.samples[0]) for r in got] == [("d/a.czi", 0, 8.0), ("d/a.czi", 1, 9.0)]
    _, series, _ = opened("a.czi", fixtures.czi([_tile(0, 0, 1, M=0), _tile(0, 0, 2, M=1)], 0))
    assert len(series) == 2
    bgr = fixtures.czi([{"X": 0, "Y": 0, "width": 1, "height": 1, "data": bytes([1, 2, 3])}], 3)
    _, [[level]], files = opened("a.czi", bgr)
    assert level.rgb and list(pixels(level, 0, files)) == [3, 2, 1]


def test_nd2_chunks_records_and_components():
    planes = RNG.integers(0, 9, (2, 2, 6)).astype("u1")
    data = b"junk\xda\xce" + fixtures.nd2(planes, parts=3, pad=2)
    _, [[level]], files = opened("a.nd2", data)
    assert (level.size_x, level.size_c, level.size_t) == (2, 3, 2)
    assert np.array_equal(whole(level, files, plane_index("XYCZT", (1, 3, 2), 0, 1, 1)), planes[1].reshape(2, 2, 3)[..., 1].ravel())
    name = lambda s: bytes([len(s) + 1]) + (s + "\0").encode("utf-16-le")
    leaf = b"\x03" + name("uiCount") + struct.pack("<I", 4)
    nest = b"\x0b" + name("uLoopPars")
    body = nest + struct.pack("<IQ", 1, len(nest) + 12 + len(leaf)) + leaf + bytes(8) + b"\x08" + name("s") + "hé\0".encode("utf-16-le")
    assert nd2.records(body) == [("uLoopPars", [("uiCount", 4)]), ("s", "hé")]
    with pytest.raises(ImageError):
        opened("a.nd2", data.replace(b"ImageDataSeq|1!", b"ImageDataSeq|5!"))


def test_ranges_are_checked():
    _, [[level]], files = opened("a.tif", fixtures.tiff(np.zeros((1, 3, 3), "u1")))
    for window in ((0, 0, 4, 1), (0, 0, 0, 1), (3, 0, 1, 1), (-1, 0, 1, 1)):
        with pytest.raises(ImageError, match="Range"):
            pixels(level, 0, files, *window)
    with pytest.raises(ImageError, match="Range"):
        pixels(level, 1, files)
    with pytest.raises(ImageError, match="recurs"):
        broken = bytearray(fixtures.tiff(np.zeros((1, 1, 1), "u1")))
        struct.pack_into("<I", broken, len(broken) - 4, struct.unpack_from("<I", broken, 4)[0])
        tiff.File(bytes(broken))


def test_wrappers(spark):
    df = spark.createDataFrame([("d", 0, 0, 0, [10.0, 20.0, 30.0])], "dataset_id string, z int, c int, t int, samples array<double>")
    assert [(r.c, r.samples) for r in reshape.separate_channels(df, 3).orderBy("c").collect()] == [(0, [10.0]), (1, [20.0]), (2, [30.0])]
    assert [r.samples for r in reshape.merge_channels(reshape.separate_channels(df, 3)).collect()] == [[10.0, 20.0, 30.0]]
    assert [reshape.separated_order(o) for o in ORDERS] == ["XYCZT", "XYCTZ", "XYCZT", "XYCZT", "XYCTZ", "XYCTZ"]
    from pyspark.sql import functions as F

    lut = [F.array(*[F.lit(float(v)) for v in p]) for p in ((10, 20), (30, 40), (50, 60))]
    pal = spark.createDataFrame([([0.0, 1.0, 7.0],)], "samples array<double>")
    assert reshape.fill_channels(pal, *lut).first().samples == [10, 30, 50, 20, 40, 60, 0, 0, 0]
    names = patterns.expand(spark.createDataFrame([("sample_Z<0-1>T<0-1>C<0-2>",)], "pattern string"), 3).orderBy("file_index").collect()
    assert len(names) == 12 and (names[0].file, names[-1].file) == ("sample_Z0T0C0", "sample_Z1T1C2")
    assert patterns.expand(spark.createDataFrame([("a<10-9>",)], "pattern string"), 1).count() == 0
    assert patterns.guess_axes([None, "T", None], 1, 5, 1) == ["Z", "T", "C"]


def test_levels_tiles_cache_and_stream(spark, tmp_path):
    from lumenplane.sources import cache
    from lumenplane.streaming import minmax

    for i in range(3):
        (tmp_path / f"{i}.tif").write_bytes(fixtures.tiff(np.full((2, 4, 4), i, "u1")))
    files = scan.load_files(spark, str(tmp_path), "*.tif")
    levels = scan.levels(scan.datasets(files))
    assert {(r.size_t, r.pixel_type) for r in levels.collect()} == {(2, "uint8")} and json.loads(levels.first().channels) == []
    cache.save(levels, files, str(tmp_path / "index"))
    assert cache.load(spark, files, str(tmp_path / "index")).count() == 3
    (tmp_path / "1.tif").write_bytes(fixtures.tiff(np.full((2, 4, 5), 1, "u1")))
    now = scan.load_files(spark, str(tmp_path), "*.tif")
    cached = cache.load(spark, now, str(tmp_path / "index"))
    assert cached.count() == 2 and cache.misses(now, cached).count() == 1
    assert scan.thumbnails(scan.datasets(files), levels).count() == 6
    assert sorted(r.flat_series for r in scan.flattened(levels).collect()) == [0, 0, 0]

    scan.read(scan.datasets(files)).select("dataset_id", "samples").write.parquet(str(tmp_path / "planes"))
    stream = spark.readStream.schema("dataset_id string, samples array<double>").parquet(str(tmp_path / "planes"))
    run = minmax.known_min_max(stream, ["dataset_id"]).writeStream.outputMode("complete").format("memory").queryName("known").trigger(availableNow=True).start()
    run.awaitTermination(60)
    assert sorted((r.known_minimum, r.known_maximum) for r in spark.table("known").collect()) == [(0.0, 0.0), (1.0, 1.0), (2.0, 2.0)]


def test_czi_label_and_preview_are_series():
    label = fixtures.czi([_tile(0, 0, 77)], 0)
    data = fixtures.czi([_tile(0, 0, 5)], 0, attached={"Label": label, "Thumbnail": b"jpg", "SlidePreview": fixtures.czi([_tile(3, 3, 78)], 0)})
    _, series, files = opened("a.czi", data)
    assert [whole(s[0], files)[0] for s in series] == [5, 77, 78] and series[1][0].extra["attachment"] == "Label"
    with pytest.raises(ImageError):
        opened("a.czi", fixtures.czi([_tile(0, 0, 5)], 0, attached={"Label": b"no file"}))


def _experiment(axis, run, count, inner=""):
    return f'<x runtype="RLxExperiment"><eType value="{axis}"/><uLoopPars runtype="{run}"><uiCount value="{count}"/></uLoopPars><ppNextLevelEx>{inner}</ppNextLevelEx></x>'


def test_nd2_loops_and_colours_from_text():
    planes = np.arange(12, dtype="u1").reshape(12, 1, 1)
    text = _experiment(2, "RLxXYPosLoop", 2, _experiment(1, "RLxNETimeLoop", 3, _experiment(4, "RLxZStackLoop", 2)))
    _, series, files = opened("a.nd2", fixtures.nd2(planes, text=text + '<sAChannelColor value="-1"/><sAChannelDyeName value="DAPI"/>'))
    assert len(series) == 2 and (series[1][0].size_z, series[1][0].size_t) == (2, 3)
    assert [whole(series[1][0], files, plane_index("XYCZT", (2, 1, 3), z, 0, t))[0] for t in range(3) for z in range(2)] == [6, 7, 8, 9, 10, 11]
    assert series[0][0].channels == [{"name": "DAPI", "color": 0xFFFFFFFF}] and series[0][0].lut[0][255] == 255
    assert nd2.colour_table(0x0000FF, "uint16")[0][65535] == min(65535, int(255 * (65535 / 255.0)))
    assert opened("a.nd2", fixtures.nd2(planes, text="<broken"))[1][0][0].size_t == 12
    both = _experiment(1, "RLxTimeLoop", 12) + _experiment(4, "RLxZStackLoop", 12)
    with pytest.raises(ImageError):
        opened("a.nd2", fixtures.nd2(planes, text=both))


def test_files_of_a_pattern_are_one_dataset(spark):
    from pyspark.sql import functions as F

    files = patterns.expand(spark.createDataFrame([("m/sample_Z<0-1>T<0-1>C<0-2>.tif",)], "pattern string"), 3).collect()
    content = [(f.file, bytearray(fixtures.tiff(np.array([[[100 * f.digits[0] + 10 * f.digits[1] + f.digits[2]]]], "u1")))) for f in files]
    planes = scan.read(scan.datasets(spark.createDataFrame(content, "path string, content binary")))
    where = patterns.file_places(spark.createDataFrame(files), ["Z", "T", "C"]).select(F.col("file").alias("dataset_id"), "file_z", "file_c", "file_t", F.lit(1).alias("base_z"), F.lit(1).alias("base_c"), F.lit(1).alias("base_t"))
    got = {(r.z, r.c, r.t): r.samples[0] for r in reshape.stitch(planes, where).collect()}
    assert len(got) == 12 and all(v == 100 * z + 10 * t + c for (z, c, t), v in got.items()) and got[1, 2, 1] == 112


def test_relabelling_keeps_c_of_several_samples(spark):
    levels = spark.createDataFrame([(3, 4, 2, 1)], "samples_per_pixel int, size_z int, size_c int, size_t int")
    with pytest.raises(Exception, match="C cannot move"):
        reshape.swap_dimensions(levels, "XYCZT", "XYZCT").collect()


def test_extremes_are_global_once_all_planes_are_read(spark):
    from pyspark.sql import functions as F

    from lumenplane.operators import stats

    rows = spark.createDataFrame([(0, False, [1.0, 2.0]), (0, True, [1.0, 2.0, 3.0, 4.0]), (1, True, [float("nan")] * 4)], "plane_index int, full boolean, samples array<double>")
    part = lambda df: stats.global_min_max(stats.plane_min_max(df).withColumn("c", F.lit(0)), ["c"], 2).first()
    first, last = part(rows.limit(1)), part(rows)
    assert (first.known_minimum, first.known_maximum, first.global_maximum) == (1.0, 2.0, None)
    assert (last.known_minimum, last.global_minimum, last.global_maximum) == (1.0, 1.0, 4.0)
    lone = stats.plane_min_max(rows.where("plane_index = 1")).first()
    assert (lone.minimum, lone.maximum) == (float("inf"), float("-inf"))
    two = spark.createDataFrame([([10.0, 100.0, 20.0, 80.0],)], "samples array<double>")
    assert [(r.minimum, r.maximum) for r in stats.plane_min_max(two, 2).orderBy("component").collect()] == [(10.0, 20.0), (80.0, 100.0)]


def test_files_are_read_by_ranges(spark, tmp_path):
    from lumenplane.sources.files import RangedFile

    planes = np.arange(6 * 300 * 400, dtype="u2").reshape(6, 300, 400)
    (tmp_path / "a.tif").write_bytes(fixtures.tiff(planes, rows=10))
    (tmp_path / "v.mrc").write_bytes(fixtures.mrc(planes))
    (tmp_path / "h.nhdr").write_bytes(b"NRRD0004\ntype: uint8\ndimension: 2\nsizes: 3 2\nencoding: raw\n# " + b"long " * 30000 + b"\ndata file: h.raw\n")
    (tmp_path / "h.raw").write_bytes(bytes(range(6)))
    (tmp_path / "d").mkdir()
    for k in range(2):
        (tmp_path / "d" / f"z{k}.dcimg").write_bytes(fixtures.dcimg(np.full((1, 2, 4), k + 1, "u1")))
    files = scan.load_files(spark, f"{tmp_path}/*").unionAll(scan.load_files(spark, f"{tmp_path}/d"))
    assert "content" not in files.columns
    sets = scan.datasets(files)
    assert sorted((r.dataset_id.rpartition("/")[2], r.format, len(r.files)) for r in sets.collect()) == [("*.dcimg", "dcimg", 2), ("a.tif", "tiff", 1), ("h.nhdr", "nrrd", 2), ("v.mrc", "mrc", 1)]
    assert all(f.content is None for r in sets.collect() for f in r.files)
    got = scan.read(sets.where("format = 'tiff'"), everywhere=[{"plane_index": 4, "x": 7, "y": 205, "width": 3, "height": 2}]).first()
    assert got.samples == planes[4, 205:207, 7:10].ravel().tolist()
    ids = {r.format: r.dataset_id for r in sets.collect()}
    asked = spark.createDataFrame([(ids["mrc"], 0, 3, 0, 0), (ids["dcimg"], 0, 1, 0, 0), (ids["nrrd"], 0, 0, 0, 0)], "dataset_id string, series int, z int, c int, t int")
    samples = {r.dataset_id: r.samples for r in scan.read(sets, asked).collect()}
    assert samples[ids["mrc"]] == planes[3].ravel().tolist() and samples[ids["dcimg"]] == [2.0] * 8 and samples[ids["nrrd"]] == [0, 1, 2, 3, 4, 5]
    for wrong in ({"z": 6}, {"z": 1, "byte_len": 300 * 400 * 2 - 1}):
        with pytest.raises(Exception, match="Range"):
            scan.read(sets.where("format = 'mrc'"), everywhere=[wrong]).collect()
    assert scan.read(sets.where("format = 'mrc'"), everywhere=[{"z": 1, "byte_len": 300 * 400 * 2}]).count() == 1

    file = RangedFile(str(tmp_path / "v.mrc"))
    _, [[level]] = scan.parse([("v.mrc", file)])
    pixels(level, 5, [file], 0, 0, 400, 1)
    assert len(file) > 1_400_000 and file.read_bytes < 400_000  # a header and one plane
    whole_file = (tmp_path / "v.mrc").read_bytes()
    assert file[70_000:200_000] == whole_file[70_000:200_000] and file[65_530:65_540] == whole_file[65_530:65_540] and file.find(whole_file[131_070:131_080], 131_000) == 131_070
    with file.cursor() as cursor:
        assert cursor.seek(-5, 2) == len(whole_file) - 5 and cursor.read() == whole_file[-5:] and cursor.read(1) == b""
        cursor.seek(65_530)
        assert cursor.read(200_000) == whole_file[65_530:265_530] and cursor.tell() == 265_530
    file.close()


def test_objective_and_colours_of_ome():
    xml = '<OME xmlns="o"><Instrument ID="I:0"><Objective ID="O:0" Model="a" LensNA="0.5"/><Objective ID="O:1" Model="b" NominalMagnification="63" LensNA="1.4"/></Instrument><Image><ObjectiveSettings ID="O:1"/><Pixels DimensionOrder="XYZCT" Type="uint8" SizeX="1" SizeY="1" SizeZ="1" SizeC="1" SizeT="1"><Channel Color="-16776961"/><TiffData/></Pixels></Image></OME>'
    _, [[level]], _ = opened("a.ome.tif", fixtures.tiff(np.zeros((1, 1, 1), "u1"), description=xml))
    assert level.objective == ("b", 63.0, 1.4) and level.channels[0]["color"] == 0xFF0000FF


def test_marks_follow_moved_files_and_groups(spark, tmp_path):
    import shutil

    from lumenplane.sources import cache

    for folder in ("one", "two"):
        (tmp_path / folder).mkdir()
    for k in range(3):
        (tmp_path / "one" / f"z{k}.dcimg").write_bytes(fixtures.dcimg(np.full((1, 2, 4), k + 1, "u1")))
    files = scan.load_files(spark, str(tmp_path / "one"))
    index = str(tmp_path / "index")
    assert cache.load(spark, files, index).count() == 0 and cache.misses(files, cache.load(spark, files, index)).count() == 3
    for _ in range(2):
        cache.save(scan.levels(scan.datasets(files)), files, index)
    assert cache.load(spark, files, index).count() == 1 and cache.misses(files, cache.load(spark, files, index)).count() == 0
    for f in (tmp_path / "one").iterdir():
        shutil.move(f, tmp_path / "two" / f.name)
    table, again = scan.levels(scan.datasets(scan.load_files(spark, str(tmp_path / "two")))), cache.load(spark, scan.load_files(spark, str(tmp_path / "two")), index)
    assert cache.agreeing(table, again).count() == 1 and cache.agreeing(table, again.withColumn("size_x", again.size_x + 1)).count() == 0
    assert [r.position for r in scan.used_files(scan.datasets(scan.load_files(spark, str(tmp_path / "two")))).collect()] == [0, 1, 2]
    moved = scan.load_files(spark, str(tmp_path / "two"))
    assert "/two/" in cache.load(spark, moved, index).first().dataset_id
    (tmp_path / "two" / "z1.dcimg").unlink()
    fewer = scan.load_files(spark, str(tmp_path / "two"))
    assert cache.load(spark, fewer, index).count() == 0


def test_imagej_rgb_and_further_text():
    level = lambda rgb, samples: tiff.Level(2, 2, samples=samples, rgb=rgb, size_c=samples)
    for rgb, comment, pages, want in (
        (True, "ImageJ=1\nslices=4", 4, (4, 3, 1)), (True, "ImageJ=1", 5, (1, 3, 5)), (True, "ImageJ=1\nchannels=2\nslices=3", 6, (3, 6, 1)), (True, "ImageJ=1\nchannels=3", 5, (1, 3, 5)),
        (False, "ImageJ=1\nchannels=4294967296", 1, (1, 1, 1)), (False, "ImageJ=1\nchannels=2\nframes=3", 6, (1, 2, 3)),
    ):
        v = level(rgb, 3 if rgb else 1)
        v.size_t = pages
        tiff._imagej(v, comment, pages)
        assert (v.size_z, v.size_c, v.size_t) == want, (rgb, comment)
    assert tiff.plain_lines([73, 0, 109, 9, 103, 133, 120]) == "Im\ng\nx" and tiff.plain_lines("a\r\nb\rc") == "a\nb\nc"


def test_czi_levels_are_powers_of_one_factor():
    entry = lambda size, stored, at=0: _tile(at, 0, 0) | {"width": size[0], "height": size[1], "stored": stored, "data": bytes(stored[0] * stored[1])}
    full = entry((400, 400), (400, 400))
    _, [levels], _ = opened("a.czi", fixtures.czi([full, entry((300, 300), (100, 100)), entry((100, 8), (33, 3), 300)], 0))
    assert [v.extra["scale"] for v in levels] == [1, 3]
    for bad, kind in (([full, entry((100, 100), (50, 25))], "InvalidData"), ([full, entry((100, 100), (20, 20))], "Unsupported"), ([entry((4, 4), (8, 8))], "InvalidData")):
        with pytest.raises(ImageError, match=kind):
            opened("a.czi", fixtures.czi(bad, 0))


def test_zstd_stops_at_its_limit():
    import zstandard

    from lumenplane.sources import codecs

    bomb = zstandard.compress(bytes(1 << 28))
    with pytest.raises(ImageError, match="more than 1000 bytes"):
        codecs.decode("zstd", bomb, 1000)


def test_ome_sets_of_several_files(spark):
    head = '<OME xmlns="http://www.openmicroscopy.org/Schemas/OME/2016-06">'
    pixels_of = lambda n, data: f'<Image ID="Image:0"><Pixels DimensionOrder="XYZCT" Type="uint8" SizeX="2" SizeY="1" SizeZ="{n}" SizeC="1" SizeT="1">{data}</Pixels></Image></OME>'
    entry = lambda z, name: f'<TiffData FirstZ="{z}" IFD="0" PlaneCount="1"><UUID FileName="{name}">urn:uuid:{z}</UUID></TiffData>'
    both = head + pixels_of(2, entry(0, "p.ome.tif") + entry(1, "q.ome.tif"))
    page = lambda v, text: fixtures.tiff(np.array([[[v, v + 1]]], "u1"), description=text)
    alone = head + '<BinaryOnly MetadataFile="set.companion.ome" UUID="urn:uuid:9"/></OME>'
    rows = [
        ("a/q.ome.tif", page(20, both)), ("a/p.ome.tif", page(10, both)),
        ("b/set.companion.ome", (head + pixels_of(2, entry(0, "y.tif") + entry(1, "x.tif"))).encode()), ("b/x.tif", page(30, alone)), ("b/y.tif", page(40, alone)),
        ("c/one.tif", page(50, "")), ("c/two.tif", page(60, "")),
    ]
    df = spark.createDataFrame([(p, bytearray(d)) for p, d in rows], "path string, content binary")
    got = {(r.dataset_id, r.z): r.samples for r in scan.read(scan.datasets(df)).collect()}
    assert got == {("a/p.ome.tif", 0): [10, 11], ("a/p.ome.tif", 1): [20, 21], ("b/set.companion.ome", 0): [40, 41], ("b/set.companion.ome", 1): [30, 31], ("c/one.tif", 0): [50, 51], ("c/two.tif", 0): [60, 61]}
    lost = df.where("path <> 'b/set.companion.ome'")
    with pytest.raises(Exception, match="BinaryOnly"):
        scan.read(scan.datasets(lost.where("path like 'b/%'"))).collect()
    with pytest.raises(Exception, match="missing"):
        scan.read(scan.datasets(df.where("path = 'a/p.ome.tif'"))).collect()


def test_jpeg_round_trips():
    from lumenplane.sources import codecs, jpeg

    rng = np.random.default_rng(4)
    smooth = np.clip(np.add.outer(np.arange(37) * 3, np.arange(53) * 2) + rng.integers(0, 40, (37, 53)), 0, 255)
    for image in (smooth, np.stack((smooth, 255 - smooth, smooth // 2), 2), rng.integers(0, 256, (16, 24))):
        for interval in (0, 2):
            got = jpeg.decode(fixtures.jpeg(image, interval=interval), image.size)
            assert got.shape[:2] == image.shape[:2] and np.abs(got.reshape(image.shape).astype(int) - image).max() <= 1
    flat = np.zeros((20, 36, 3), int) + [90, 140, 110]  # Y, Cb, Cr
    want = [90 + 1.402 * (110 - 128), 90 - 0.344136 * 12 + 0.714136 * 18, 90 + 1.772 * 12]
    assert np.abs(jpeg.decode(fixtures.jpeg(flat, halved=True), flat.size).reshape(-1, 3) - want).max() <= 1
    data = fixtures.jpeg(smooth)
    start = data.index(b"\xff\xc0")
    assert codecs.decode("jpeg", b"\xff\xd8" + data[start:], smooth.size, data[:start] + b"\xff\xd9") == codecs.decode("jpeg", data, smooth.size)
    for bad in (data[: len(data) // 2], data.replace(b"\xff\xc0", b"\xff\xc2"), b"\xff\xd8" + data[start:], data[1:], data[:30]):
        with pytest.raises(ImageError):
            codecs.decode("jpeg", bad, smooth.size)
    with pytest.raises(ImageError, match="more than"):
        codecs.decode("jpeg", data, smooth.size - 1)
    pages = np.repeat(np.arange(3, dtype="u1"), 256).reshape(3, 16, 16) * 40
    _, [[level]], files = opened("a.tif", fixtures.tiff(pages, "jpeg", rows=8))
    assert [whole(level, files, i).tolist() for i in range(3)] == [p.ravel().tolist() for p in pages]


def test_czi_jpeg_tiles_lose_their_padding():
    grey, colour = np.full((5, 5), 90), np.full((5, 5, 3), 0) + [10, 20, 30]
    tile = lambda data: [_tile(0, 0, 0, codec=1) | {"data": data}]
    for image in (grey, grey[:4, :4]):
        _, [[level]], files = opened("a.czi", fixtures.czi(tile(fixtures.jpeg(image)), 0))
        assert whole(level, files).tolist() == [90] * 16
    _, [[level]], files = opened("a.czi", fixtures.czi(tile(fixtures.jpeg(colour)), 3))
    assert list(pixels(level, 0, files))[:3] == [30, 20, 10]
    _, [[level]], files = opened("a.czi", fixtures.czi(tile(fixtures.jpeg(grey[:5, :4])), 0))
    with pytest.raises(ImageError, match="InvalidData"):
        whole(level, files)


def test_gzip_planes_in_order_are_inflated_once(monkeypatch):
    from lumenplane.sources import codecs

    planes = np.random.default_rng(2).integers(0, 60000, (40, 64, 64)).astype("u2")
    monkeypatch.setattr(codecs.Inflated, "CHUNK", 5000)
    _, [[level]], files = opened("a.nrrd", fixtures.nrrd(planes.reshape(40, 64, 64), "gzip"))
    begun = []
    monkeypatch.setattr(codecs.Inflated, "begin", lambda self, begin=codecs.Inflated.begin: (begun.append(1), begin(self))[1])
    for k in range(40):
        assert whole(level, files, k).tolist() == planes[k].ravel().tolist()
    assert len(begun) == 1
    assert whole(level, files, 7, (3, 60, 5, 4)).tolist() == planes[7, 60:, 3:8].ravel().tolist() and len(begun) == 2
    short = fixtures.nrrd(planes, "gzip")
    _, [[level]], files = opened("a.nrrd", short[:-2000])
    with pytest.raises(ImageError, match="Codec"):
        whole(level, files, 39)


def test_mosaics_across_cells(spark):
    from lumenplane.operators import compose

    rng = np.random.default_rng(8)
    tiles, canvas = [], {}
    for seq in range(30):
        w, h, x, y, k = (int(v) for v in (rng.integers(1, 40), rng.integers(1, 40), rng.integers(-20, 60), rng.integers(-20, 60), rng.integers(0, 2)))
        image = rng.random((h, w))
        tiles.append((k, f"c{k}", seq, x, y, w, image.ravel().tolist()))
        canvas |= {(k, f"c{k}", y + j, x + i): image[j, i] for j in range(h) for i in range(w)}
    df = spark.createDataFrame(tiles, "k int, name string, tile_seq int, x int, y int, width int, samples array<double>").repartition(4)
    blocks = compose.mosaic_blocks(df, ["k", "name"], 16).collect()
    got = {(b.k, b.name, b.y + i // b.width, b.x + i % b.width): v for b in blocks for i, v in enumerate(b.samples) if v is not None}
    assert got == canvas and max(b.width for b in blocks) <= 16 and all(len(b.samples) == b.width * b.height for b in blocks)
    assert {(r.k, r.name, r.y, r.x): r.value for r in compose.mosaic(df, ["k", "name"]).collect()} == canvas
    assert compose.mosaic(df.limit(0), ["k", "name"]).collect() == []


def test_extremes_are_told_once_when_all_planes_are_read(spark, tmp_path):
    from lumenplane.streaming import minmax

    schema = "series int, plane_index int, image_count int, full boolean, minimum double, maximum double"
    steps = [
        [(0, 0, 3, True, 1.0, 5.0), (0, 1, 3, False, -9.0, 2.0), (1, 0, 1, True, 7.0, 8.0)], [(0, 1, 3, True, 0.0, 4.0), (0, 0, 3, True, 1.0, 5.0)],
        [(0, 2, 3, True, 2.0, 6.0)], [(0, 2, 3, True, 2.0, 60.0), (1, 0, 1, True, 0.0, 9.0)],
    ]
    for k, rows in enumerate(steps):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = minmax.completed(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), ["series"])
        run = stream.writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        assert run.awaitTermination(60) and run.exception() is None
        told = sorted(map(tuple, spark.read.schema(stream.schema).parquet(str(tmp_path / "out")).collect()))
        assert told == [[(1, 7.0, 8.0)], [(1, 7.0, 8.0)], [(0, -9.0, 6.0), (1, 7.0, 8.0)], [(0, -9.0, 6.0), (1, 7.0, 8.0)]][k]
