"""Headers of MRC, NRRD and DCIMG volumes."""

from __future__ import annotations

import math


from lumenplane.sources.model import Block, Bytes, ImageError, Level

# MRC mode -> pixel type and samples.
MRC_MODES = {0: ("uint8", 1), 1: ("int16", 1), 2: ("float32", 1), 3: ("uint32", 1), 4: ("float64", 1), 6: ("uint16", 1), 16: ("uint8", 3)}
IMOD_STAMP = 1146047817


def _text(raw: bytes) -> str:
    return raw.split(b"\0", 1)[0].decode("utf-8", "replace").strip()


def _mrc_header(data: bytes, order: str, length: int | None):
    """Width, height, planes, mode, type, samples and data offset; None if they are not plausible."""
    b = Bytes(data, order)
    nx, ny, nz, mode = b.get("4i", 0)
    ext = b.get("i", 92)
    kind = MRC_MODES.get(mode)
    if kind is None or min(nx, ny, nz) < 1 or ext < 0:
        return None
    if mode == 0 and b.get("i", 152) == IMOD_STAMP and b.get("i", 156) & 1:
        kind = ("int8", 1)
    from lumenplane.sources.model import PIXELS

    size = nx * ny * nz * kind[1] * int(PIXELS[kind[0]][1])
    if length is not None and 1024 + ext + size > length:
        return None
    return nx, ny, nz, mode, *kind, 1024 + ext


def mrc_orders(data: bytes) -> str:
    return "><" if data[212:213] == b"\x11" else "<>"


def is_mrc(prefix: bytes) -> bool:
    return len(prefix) >= 1024 and any(_mrc_header(prefix[:1024], o, None) for o in mrc_orders(prefix))


def mrc(data: bytes) -> list[list[Level]]:
    if len(data) < 1024:
        raise ImageError("Format", "MRC header is cut off")
    order, found = next(((o, h) for o in mrc_orders(data) if (h := _mrc_header(data, o, len(data)))), (None, None))
    if not found:
        if any(b.get("i", 12) not in MRC_MODES and min(b.get("3i", 0)) > 0 for b in (Bytes(data, o) for o in "<>")):
            raise ImageError("Unsupported", "MRC mode")
        raise ImageError("Format", "MRC sizes")
    nx, ny, nz, mode, kind, samples, start = found
    b = Bytes(data, order)
    low, high, mean = b.get("3f", 76)
    if kind == "int16" and (high > 32767.5 or low < -32767.5):
        kind = "uint16"
    agar = _text(data[104:108]) == "AGAR"
    grid, cell = b.get("3i", 28), b.get("3f", 40)

    def micrometres(length: float, n: int):
        ok = n > 0 and math.isfinite(length) and length > 0
        value = length / n / (1 if agar else 10_000) if ok else 0.0
        return value if math.isfinite(value) and value > 0 else None

    level = Level(nx, ny, nz, samples, 1, kind, samples=samples, order="XYCZT" if samples > 1 else "XYZTC", rgb=samples > 1, interleaved=True, false_color=False, little_endian=order == "<")
    level.physical = tuple(micrometres(c, g) for c, g in zip(cell, grid))
    level.extra = {"mode": mode, "grid": list(grid), "cell": list(cell), "angles": list(b.get("3f", 52)), "minimum": low, "maximum": high, "mean": mean, "labels": [_text(data[224 + 80 * i : 304 + 80 * i]) for i in range(max(0, min(10, b.get("i", 220))))]}
    row = nx * samples * level.sample_bytes
    level.planes = [[Block(0, 0, nx, ny, start + z * ny * row, ny * row, samples=samples, upside_down=True)] for z in range(nz)]
    return [[level]]


# NRRD type names; signed integers are read as unsigned ones.
NRRD_TYPES = {
    "uint8": "char, signed char, int8, int8_t, uchar, unsigned char, uint8, uint8_t",
    "uint16": "short, short int, signed short, signed short int, int16, int16_t, ushort, unsigned short, unsigned short int, uint16, uint16_t",
    "uint32": "int, signed int, int32, int32_t, uint, unsigned int, uint32, uint32_t",
    "float32": "float",
    "float64": "double",
}


def nrrd_fields(data: bytes) -> tuple[dict[str, str], int]:
    """The header's fields by lower-case name, and the bytes up to the data."""
    if not data.startswith(b"NRRD"):
        raise ImageError("Unsupported", "no NRRD")
    at, fields, ended, first = 0, {}, False, True
    while at < len(data):
        end = data.find(b"\n", at)
        stop = len(data) if end < 0 else end + 1
        line, at = data[at:stop].decode("utf-8", "replace").strip(), stop
        if first:
            if len(line) < 8:
                raise ImageError("InvalidData", "NRRD version line")
            first = False
        elif not line:
            ended = True
            break
        elif not line.startswith("#"):
            key, colon, value = line.partition(":")
            if not colon:
                raise ImageError("InvalidData", f"NRRD line {line}")
            fields[key.strip().lower()] = value.strip().lstrip("=").strip()
    if not ended and not ({"data file", "datafile"} & set(fields)):
        raise ImageError("InvalidData", "NRRD header has no end")
    return fields, at


def nrrd_companion(data: bytes) -> str | None:
    """The name of the file that holds the data, if it is another."""
    fields, _ = nrrd_fields(data)
    name = fields.get("data file", fields.get("datafile"))
    if name is not None:
        name = name.strip('"')
        if name.lower() == "list" or name.lower().startswith("list "):
            raise ImageError("Unsupported", "NRRD LIST files")
    return name


def _positive(name: str, text: str) -> int:
    if not (text.isascii() and text.lstrip("+").isdigit()) or not int(text):
        raise ImageError("InvalidData", f"NRRD {name} {text}")
    return int(text)


def nrrd(data: bytes, other: bytes | None = None) -> list[list[Level]]:
    fields, header = nrrd_fields(data)
    detached = nrrd_companion(data) is not None
    for name in ("type", "dimension", "sizes", "encoding"):
        if name not in fields:
            raise ImageError("InvalidData", f"NRRD has no {name}")
    kind = next((k for k, names in NRRD_TYPES.items() if fields["type"].lower() in names.split(", ")), None)
    if kind is None:
        raise ImageError("Unsupported", f"NRRD type {fields['type']}")
    coding = {"raw": "raw", "gzip": "gzip", "gz": "gzip"}.get(fields["encoding"].lower())
    if coding is None:
        raise ImageError("Codec", f"NRRD encoding {fields['encoding']}")
    sizes = [_positive("size", s) for s in fields["sizes"].split()]
    if _positive("dimension", fields["dimension"]) != len(sizes):
        raise ImageError("InvalidData", "NRRD dimension and sizes differ")
    if len(sizes) > 5:
        raise ImageError("Unsupported", f"NRRD dimension {len(sizes)}")
    vector = len(sizes) >= 3 and 2 <= sizes[0] <= 16
    c, rest = (sizes[0], sizes[1:]) if vector else (1, sizes)
    if len(rest) > 4:
        raise ImageError("Unsupported", "NRRD has more axes than X, Y, Z, T")
    x, y, z, t = rest + [1] * (4 - len(rest))
    endian = fields.get("endian", "").lower()
    if endian not in ("little", "big") and ("endian" in fields or kind != "uint8"):
        raise ImageError("InvalidData", "NRRD endian")
    skip = fields.get("byte skip", fields.get("byteskip", "0"))
    if not skip.isdigit():
        raise ImageError("InvalidData", f"NRRD byte skip {skip}")
    level = Level(x, y, z, c, t, kind, samples=c, order="XYCZT", rgb=c > 1, interleaved=True, false_color=False, little_endian=endian != "big")
    level.extra = dict(fields)
    start = (0 if detached else header) + int(skip)
    size, source = x * y * c * level.sample_bytes, 1 if detached else 0
    whole = len(data if not detached else other or b"") - start
    if coding == "raw":
        level.planes = [[Block(0, 0, x, y, start + i * size, size, samples=c, source=source)] for i in range(z * t)]
    else:
        level.planes = [[Block(0, 0, x, y, start, max(0, whole), "gzip", samples=c, skip=i * size, source=source)] for i in range(z * t)]
    return [[level]]


def dcimg_header(data: bytes) -> dict:
    b = Bytes(data)
    if not data.startswith(b"DCIMG"):
        raise ImageError("Format", "no DCIMG")
    version, head = b.get("I", 8), b.get("I", 40)
    if b.get("I", 48) != b.get("I", 64):
        raise ImageError("InvalidData", "DCIMG file sizes differ")
    if version == 0x7:
        b.at(head, 80)
        frames, kind = b.get("2i", head + 32)
        width, row, height, size = b.get("iIiI", head + 44)
        start, footer = head + b.get("i", head + 68), 0
    elif version == 0x01000000:
        frames, kind = b.get("2i", head + 60)
        width, height = b.get("2i", head + 72)
        size, start, footer = b.get("I", head + 84), head + b.get("q", head + 96), b.get("I", head + 124)
        row = 0
    else:
        raise ImageError("Unsupported", f"DCIMG version {version:#x}")
    types = {1: "uint8", 2: "uint16"}
    if kind not in types:
        raise ImageError("Unsupported", f"DCIMG pixel type {kind}")
    wide = kind
    if min(frames, width, height) < 1 or start < head or size < width * height * wide:
        raise ImageError("InvalidData", "DCIMG sizes")
    b.at(start, (size + footer) * frames)
    patch = None
    if version == 0x7:
        at = head + b.get("q", head + 72)
        if b.get("I", at) != version:
            raise ImageError("InvalidData", "DCIMG footer version")
        second = at + b.get("q", at + 8)
        offset, place, count = b.get("q", second + 88), b.get("I", second + 100), b.get("q", second + 104)
        if count < 0 or count and (row == 0 or place // row + 1 >= height or count < min(width, 4) * wide):
            raise ImageError("InvalidData", "DCIMG four-pixel correction")
        if count:
            b.at(at + offset, min(width, 4) * wide)
            patch = (place // row + 1, at + offset)
    elif footer == 32 or footer >= 512:
        patch = ((height + 1) // 2, start + size + 12)
        b.at(patch[1], min(width, 4) * wide)
    return {"version": version, "width": width, "height": height, "frames": frames, "type": types[kind], "start": start, "stride": size + footer, "patch": patch}


def dcimg(files: list[tuple[str, bytes]]) -> list[list[Level]]:
    """A group of files, in order of name: files are Z, frames T. Siblings that are no DCIMG are left out."""
    heads = []
    for k, (name, data) in enumerate(files):
        if data.startswith(b"DCIMG"):
            heads.append((name, k, dcimg_header(data)))
    heads.sort(key=lambda h: h[0])
    if not heads:
        raise ImageError("Format", "no DCIMG")
    first = heads[0][2]
    same = ("version", "width", "height", "frames", "type")
    if any(h[k] != first[k] for _, _, h in heads for k in same):
        raise ImageError("InvalidData", "DCIMG files of a group differ")
    level = Level(first["width"], first["height"], len(heads), 1, first["frames"], first["type"], order="XYZCT", false_color=False, window_flip=True)
    size = level.size_x * level.size_y * level.sample_bytes
    level.planes = [[Block(0, 0, level.size_x, level.size_y, h["start"] + t * h["stride"], size, source=k)] for t in range(first["frames"]) for _, k, h in heads]
    if first["patch"]:
        level.patch = (*first["patch"], heads[0][1])
    return [[level]]


