"""What a parsed file is: levels of planes, each plane a list of stored blocks.

A parser reads headers only and returns levels; blocks say where samples lie and how they are coded.
One decoder, `pixels`, serves every format: it decodes just the blocks that meet a window.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

import numpy as np

#: Name, bytes of a sample and numpy kind of each pixel type.
PIXELS = {
    "int8": "i1", "uint8": "u1", "int16": "i2", "uint16": "u2", "int32": "i4", "uint32": "u4", "float32": "f4", "float64": "f8",
}
ORDERS = ("XYCZT", "XYCTZ", "XYZCT", "XYZTC", "XYTCZ", "XYTZC")
#: Sides that a thumbnail has at most.
THUMBNAIL = 256


class ImageError(ValueError):
    """A file that cannot be read; kind is one of Format, Unsupported, Codec, InvalidData, Range."""

    def __init__(self, kind: str, text: str):
        super().__init__(f"{kind}: {text}")
        self.kind = kind


@dataclass
class Block:
    """A stored rectangle of a plane, at x, y of the plane."""

    x: int
    y: int
    width: int
    height: int
    offset: int
    length: int
    codec: str = "raw"
    samples: int = 1  # stored per pixel
    first_sample: int = 0  # of the plane's samples, the first that this block holds
    keep: tuple[int, int] | None = None  # (from, count) of the stored samples that count
    row_bytes: int = 0  # with padding; 0: tight
    bits: int = 0  # packed bits of a sample; 0: whole bytes
    predictor: bool = False
    upside_down: bool = False
    swap_rgb: bool = False
    skip: int = 0  # decoded bytes before the rectangle
    source: int = 0  # which of the dataset's files
    extra: bytes = b""  # tables a codec needs


@dataclass
class Level:
    size_x: int
    size_y: int
    size_z: int = 1
    size_c: int = 1
    size_t: int = 1
    pixel_type: str = "uint8"
    bits: int = 0
    samples: int = 1
    order: str = "XYCZT"
    rgb: bool = False
    interleaved: bool = False
    indexed: bool = False
    false_color: bool = True
    little_endian: bool = True
    fill: int = 0
    window_flip: bool = False  # rows are reversed within the window asked for
    patch: tuple[int, int, int] | None = None  # (output row, offset, source): its first four pixels lie elsewhere
    physical: tuple = (None, None, None)  # micrometres
    time_step: float | None = None
    timestamp: str | None = None
    objective: tuple = (None, None, None)  # model, magnification, aperture
    lut: tuple | None = None
    channels: list = field(default_factory=list)  # dicts
    plane_info: list = field(default_factory=list)  # dicts by plane
    extra: dict = field(default_factory=dict)
    planes: list = field(default_factory=list)  # of lists of Block
    streams: dict = field(default_factory=dict, repr=False)  # of files that are being inflated, by source and offset

    @property
    def image_count(self) -> int:
        return len(self.planes)

    def check(self) -> None:
        if min(self.size_x, self.size_y, self.size_z, self.size_c, self.size_t, len(self.planes), self.samples) < 1:
            raise ImageError("InvalidData", "a size is zero")
        zt = self.size_z * self.size_t
        if len(self.planes) % zt:
            raise ImageError("InvalidData", f"{len(self.planes)} planes are no multiple of {zt}")
        if self.rgb and self.size_c != len(self.planes) // zt * self.samples:
            raise ImageError("InvalidData", "channels do not match samples")
        self.bits = self.bits or 8 * self.sample_bytes
        if not 0 < self.bits <= 8 * self.sample_bytes or self.order not in ORDERS:
            raise ImageError("InvalidData", "precision or axis order")

    @property
    def sample_bytes(self) -> int:
        return int(PIXELS[self.pixel_type][1])

    @property
    def dtype(self) -> np.dtype:
        return np.dtype(("<" if self.little_endian else ">") + PIXELS[self.pixel_type])

    @property
    def logical_channels(self) -> int:
        zt = self.size_z * self.size_t
        return len(self.planes) // zt if zt and len(self.planes) % zt == 0 else 0


def axis_sizes(order: str, z: int, c: int, t: int) -> list[tuple[str, int]]:
    """Axes from the fastest, with their sizes."""
    return [(a, {"Z": z, "C": c, "T": t}[a]) for a in order[2:]]


def plane_index(order: str, sizes: tuple[int, int, int], z: int, c: int, t: int) -> int:
    at, step = 0, 1
    for axis, size in axis_sizes(order, *sizes):
        at += {"Z": z, "C": c, "T": t}[axis] * step
        step *= size
    return at


def plane_coordinates(order: str, sizes: tuple[int, int, int], index: int) -> tuple[int, int, int]:
    at = {"Z": 0, "C": 0, "T": 0}
    for axis, size in axis_sizes(order, *sizes):
        if size:
            index, at[axis] = divmod(index, size)
    return at["Z"], at["C"], at["T"]


class Bytes:
    """Checked reads of a file's bytes, or of a file that is cut like bytes."""

    def __init__(self, data: bytes, order: str = "<"):
        self.data, self.order = data, order

    def __len__(self) -> int:
        return len(self.data)

    def at(self, offset: int, size: int) -> bytes:
        if offset < 0 or size < 0 or offset + size > len(self.data):
            raise ImageError("Format", f"{size} bytes at {offset} lie outside {len(self.data)}")
        return self.data[offset : offset + size]

    def get(self, kinds: str, offset: int):
        values = struct.unpack(self.order + kinds, self.at(offset, struct.calcsize(self.order + kinds)))
        return values[0] if len(values) == 1 else values


def _samples(level: Level, block: Block, files: list[bytes]) -> np.ndarray:
    """A block's samples as (height, width, samples kept)."""
    from lumenplane.sources import codecs

    from_stream = block.codec == "gzip"
    raw = b"" if from_stream else Bytes(files[block.source]).at(block.offset, block.length)
    width_bytes = block.width * block.samples * level.sample_bytes if not block.bits else (block.width * block.samples * block.bits + 7) // 8
    row = block.row_bytes or width_bytes
    skip = 0 if from_stream else block.skip
    need = skip + row * (block.height - 1) + width_bytes
    if from_stream:
        key = block.source, block.offset
        if key not in level.streams or level.streams[key].data is not files[block.source]:
            level.streams[key] = codecs.Inflated(files[block.source], block.offset, block.length)
        raw = level.streams[key].at(block.skip, need)
    elif block.codec == "jpeg-padded":
        raw = codecs.padded_jpeg(raw, block.width, block.height, block.samples)
    else:
        raw = codecs.decode(block.codec, raw, skip + row * block.height, block.extra)
    if len(raw) < need:
        raise ImageError("Codec", f"{block.codec} gave {len(raw)} of {need} bytes")
    rows = np.lib.stride_tricks.as_strided(np.frombuffer(raw, np.uint8)[skip:], (block.height, width_bytes), (row, 1), writeable=False)
    if block.bits:
        out = codecs.unpack_bits(rows, block.width * block.samples, block.bits, level.dtype)
    else:
        out = np.ascontiguousarray(rows).view(level.dtype)
    out = out.reshape(block.height, block.width, block.samples)
    if block.predictor:
        out = codecs.undo_predictor(out)
    if block.upside_down:
        out = out[::-1]
    if block.swap_rgb and block.samples >= 3:
        out = out[..., [2, 1, 0, *range(3, block.samples)]]
    if block.keep:
        out = out[..., block.keep[0] : block.keep[0] + block.keep[1]]
    return out


def pixels(level: Level, plane: int, files: list[bytes], x: int = 0, y: int = 0, width: int | None = None, height: int | None = None) -> bytes:
    """The window's samples in the layout of the level (interleaved or planar), rows tight."""
    width, height = level.size_x - x if width is None else width, level.size_y - y if height is None else height
    if not 0 <= plane < len(level.planes):
        raise ImageError("Range", f"plane {plane} of {len(level.planes)}")
    if width < 1 or height < 1 or x < 0 or y < 0 or x + width > level.size_x or y + height > level.size_y:
        raise ImageError("Range", f"window {x},{y} {width}x{height} in {level.size_x}x{level.size_y}")
    out = np.full((height, width, level.samples), level.fill, level.dtype)
    for b in level.planes[plane]:  # in stored order: later blocks lie on top
        x0, y0, x1, y1 = max(x, b.x), max(y, b.y), min(x + width, b.x + b.width), min(y + height, b.y + b.height)
        if x0 < x1 and y0 < y1:
            got = _samples(level, b, files)
            out[y0 - y : y1 - y, x0 - x : x1 - x, b.first_sample : b.first_sample + got.shape[2]] = got[y0 - b.y : y1 - b.y, x0 - b.x : x1 - b.x]
    if level.window_flip:
        out = out[::-1].copy()
    if level.patch and level.patch[0] < height and x < 4:
        n = min(width, 4 - x)
        data = Bytes(files[level.patch[2]]).at(level.patch[1] + x * level.sample_bytes, n * level.sample_bytes)
        out[level.patch[0], :n, 0] = np.frombuffer(data, level.dtype)
    return (out if level.interleaved else np.moveaxis(out, 2, 0)).tobytes()


def thumbnail_window(size_x: int, size_y: int) -> tuple[int, int, int, int]:
    """The centre crop of at most 256 x 256."""
    w, h = min(size_x, THUMBNAIL), min(size_y, THUMBNAIL)
    return (size_x - w) // 2, (size_y - h) // 2, w, h
