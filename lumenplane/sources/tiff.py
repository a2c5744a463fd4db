"""TIFF and BigTIFF: directories, layouts, ImageJ comments, OME-XML and sub-resolution pyramids."""

from __future__ import annotations

import re
import unicodedata
import xml.etree.ElementTree as ET

from lumenplane.functions import units
from lumenplane.sources.model import Block, Bytes, ImageError, Level, plane_index

# TIFF field types and their struct letters.
FIELDS = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 7: "s", 8: "h", 9: "i", 10: "ii", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}
# Compression codes.
CODECS = {1: "raw", 5: "lzw", 6: "jpeg", 7: "jpeg", 8: "zlib", 32773: "packbits", 32946: "zlib", 50000: "zstd", 33003: "jpeg2000", 33005: "jpeg2000", 34712: "jpeg2000", 34892: "jpeg"}
# OME pixel types.
OME_TYPES = {"int8": "int8", "uint8": "uint8", "int16": "int16", "uint16": "uint16", "int32": "int32", "uint32": "uint32", "float": "float32", "double": "float64"}


class File:
    """All directories of one file (or only the first), main chain and sub-directories."""

    def __init__(self, data: bytes, only_first: bool = False):
        mark = data[:4]
        order = {b"II": "<", b"MM": ">"}.get(mark[:2])
        if order is None:
            raise ImageError("Format", "no TIFF byte order")
        self.bytes = Bytes(data, order)
        magic = self.bytes.get("H", 2)
        if magic not in (42, 43):
            raise ImageError("Format", f"TIFF magic {magic}")
        self.big = magic == 43
        if self.big and self.bytes.get("2H", 4) != (8, 0):
            raise ImageError("Format", "BigTIFF offset size")
        self.seen: set[int] = set()
        self.chain = []
        at = self.bytes.get("Q", 8) if self.big else self.bytes.get("I", 4)
        while at:
            tags, at = self.directory(at)
            self.chain.append(tags)
            at = 0 if only_first else at
        if not self.chain:
            raise ImageError("Format", "TIFF without directories")

    def directory(self, at: int) -> tuple[dict, int]:
        if at in self.seen:
            raise ImageError("Format", f"TIFF directory at {at} recurs")
        self.seen.add(at)
        count, start = (self.bytes.get("Q", at), at + 8) if self.big else (self.bytes.get("H", at), at + 2)
        step, inline = (20, 8) if self.big else (12, 4)
        self.bytes.at(start, count * step)
        tags = {}
        for i in range(count):
            place = start + i * step
            tag, kind = self.bytes.get("2H", place)
            number = self.bytes.get("Q" if self.big else "I", place + 4)
            if kind not in FIELDS:
                continue
            unit = FIELDS[kind]
            size = number * {"B": 1, "s": 1, "b": 1, "H": 2, "h": 2, "I": 4, "i": 4, "f": 4, "II": 8, "ii": 8}.get(unit, 8)
            where = place + step - inline
            if size > inline:
                where = self.bytes.get("Q" if self.big else "I", where)
            raw = self.bytes.at(where, size)
            if unit == "s":
                tags[tag] = raw.split(b"\0")[0].decode("utf-8", "replace") if kind == 2 else raw
            else:
                values = self.bytes.get(f"{number * len(unit)}{unit[0]}", where) if number else ()
                values = values if isinstance(values, tuple) else (values,)
                tags[tag] = [*zip(values[::2], values[1::2])] if len(unit) == 2 else list(values)
        following = self.bytes.get("Q" if self.big else "I", start + count * step)
        return tags, following


def _ints(tags: dict, tag: int, default=None, limit: int = 1 << 64):
    """A vector of whole numbers; present but empty, or of another type, is an error."""
    if tag not in tags:
        return default
    value = tags[tag]
    if not isinstance(value, list) or not value or not all(isinstance(v, int) and 0 <= v < limit for v in value):
        raise ImageError("Format", f"TIFF tag {tag}")
    return value


def _int(tags: dict, tag: int, default=None):
    value = _ints(tags, tag)
    return default if value is None else value[0]


def _sample_type(bits: int, form: int) -> str:
    if form == 3 and bits in (32, 64):
        return f"float{bits}"
    if form == 2 and bits in (8, 16, 32):
        return f"int{bits}"
    if form in (1, 4) and (1 <= bits <= 16 or bits == 32):
        return "uint8" if bits <= 8 else "uint16" if bits <= 16 else "uint32"
    raise ImageError("Unsupported", f"TIFF samples of {bits} bits, format {form}")


class Page:
    """A directory's layout and blocks."""

    def __init__(self, tags: dict, order: str):
        self.tags = tags
        self.width, self.height = _int(tags, 256), _int(tags, 257)
        if not self.width or not self.height:
            raise ImageError("Format", "TIFF image without size")
        self.samples = _int(tags, 277, 1)
        bits, forms = _ints(tags, 258, [1]), _ints(tags, 339, [1])
        if not self.samples or any(len(set(v)) > 1 or len(v) > 1 and len(v) != self.samples for v in (bits, forms)):
            raise ImageError("Unsupported", "TIFF samples differ")
        self.bits, self.type = bits[0], _sample_type(bits[0], forms[0])
        self.photometric, code = _int(tags, 262, 1), _int(tags, 259, 1)
        self.codec, self.planar, predictor = CODECS.get(code, f"tiff{code}"), _int(tags, 284, 1), _int(tags, 317, 1)
        if self.planar not in (1, 2) or _int(tags, 266, 1) != 1 or predictor not in (1, 2) or predictor == 2 and self.bits not in (8, 16):
            raise ImageError("Unsupported", "TIFF planar configuration, fill order or predictor")
        if self.bits % 8 and self.codec == "jpeg" or self.photometric not in (1, 2, 3) and not (self.photometric == 6 and self.codec == "jpeg"):
            raise ImageError("Unsupported", f"TIFF photometric interpretation {self.photometric}")
        self.predictor = predictor == 2
        self.lut = None
        if self.photometric == 3 and (table := _ints(tags, 320, limit=1 << 16)) is not None:
            if len(table) != 3 << self.bits:
                raise ImageError("InvalidData", "TIFF colour map length")
            n = 1 << self.bits
            self.lut = (table[:n], table[n : 2 * n], table[2 * n :])
        self.rgb = self.photometric in (2, 6) and self.samples >= 3
        self.order = order

    @property
    def layout(self) -> tuple:
        return self.type, self.bits, self.samples, self.planar, self.photometric, self.width, self.height, self.lut and tuple(map(tuple, self.lut))

    def blocks(self) -> list[Block]:
        t, planes = self.tags, self.samples if self.planar == 2 else 1
        each = 1 if self.planar == 2 else self.samples
        tiled = 324 in t
        offsets, counts = _ints(t, 324 if tiled else 273), _ints(t, 325 if tiled else 279)
        w, h = (_int(t, 322, 0), _int(t, 323, 0)) if tiled else (self.width, min(_int(t, 278, self.height), self.height))
        if not w or not h or offsets is None:
            raise ImageError("Format", "TIFF strips or tiles")
        across, down = -(-self.width // w), -(-self.height // h)
        if counts is None and not tiled and self.codec == "raw":
            counts = [(self.width * each * self.bits + 7) // 8 * min(h, self.height - i % down * h) for i in range(down * planes)]
        if counts is None or len(offsets) < across * down * planes or len(counts) < across * down * planes:
            raise ImageError("Format", "TIFF has too few strips or tiles")
        out = []
        for p in range(planes):
            for j in range(down):
                for i in range(across):
                    n = (p * down + j) * across + i
                    rows = h if tiled else min(h, self.height - j * h)
                    out.append(Block(i * w, j * h, w, rows, offsets[n], counts[n], self.codec, samples=each, first_sample=p, bits=self.bits if self.bits % 8 else 0, predictor=self.predictor, extra=t.get(347, b"")))
        return out

    def level(self, planes: list[list[Block]]) -> Level:
        level = Level(self.width, self.height, pixel_type=self.type, bits=self.bits, samples=self.samples, rgb=self.rgb, interleaved=self.planar == 1, indexed=self.lut is not None, false_color=False, little_endian=self.order == "<", lut=self.lut)
        level.size_c = self.samples
        level.planes = planes
        level.rgb = self.rgb
        return level


def _ratio(tags: dict, tag: int):
    value = tags.get(tag)
    return value[0][0] / value[0][1] if value and value[0][1] else None


def calibration(tags: dict) -> tuple:
    """Micrometres of a pixel in x and y, by the directory's own unit and comment."""
    unit, comment = _int(tags, 296, 1), tags.get(270)
    factor = {2: 25400.0, 3: 10000.0}.get(unit, 1.0)
    words = re.findall(r"unit=([A-Za-z0-9_]+)", comment) if isinstance(comment, str) else []
    named = units.comment_factor(words[-1]) if words and unit != 3 else None
    ratios = [_ratio(tags, tag) for tag in (282, 283)]
    return tuple(factor / r * (named or 1.0) if r and r > 0 else None for r in ratios)


def plain_lines(value) -> str | None:
    """A comment's text: as it is, or written as numbers, of which NUL goes and control characters part lines."""
    if isinstance(value, str):
        return value.replace("\r\n", "\n").replace("\r", "\n")
    if isinstance(value, list) and all(isinstance(v, int) for v in value):
        letters = [chr(v & 0xFFFF) for v in value if v and not 0xD800 <= v & 0xFFFF < 0xE000]
        return "".join("\n" if unicodedata.category(c) == "Cc" else c for c in letters)
    return None


def imagej_comment(pages: list[Page]) -> str | None:
    """The ImageJ comment of a series: its first page's, else its last one's, and the first page's further text."""
    for page in (pages[0], pages[-1]):
        own = page.tags.get(270)
        if isinstance(own, str) and own.startswith("ImageJ="):
            more = plain_lines(pages[0].tags.get(50839))
            return plain_lines(own) + ("\n" + more if more else "")
    return None


def _count(text: str) -> int:
    """A whole number of 32 bits, else 0."""
    return int(text) if re.fullmatch(r"\+?[0-9]+", text) and int(text) < 1 << 32 else 0


def _real(text: str) -> float:
    try:
        return 0.0 if "_" in text else float(text.strip())
    except ValueError:
        return 0.0


def _imagej(level: Level, comment: str, pages: int) -> None:
    """Sizes, calibration and further fields that a comment tells; C is the fastest axis, then Z and T."""
    sizes, names = {"channels": level.size_c, "slices": 1, "frames": 1}, {"mode": "Color mode", "unit": "Unit", "ImageJ": "ImageJ"}
    for k, line in enumerate(comment.splitlines()):
        key, found, value = line.partition("=")
        if not found or key == "images" or key == "ImageJ" and k:
            continue
        if key in sizes:
            sizes[key] = _count(value)
        elif key == "finterval":
            level.time_step = level.extra["Frame Interval"] = _real(value)
        elif key == "spacing":
            level.extra["Spacing"] = _real(value)
            size = abs(_real(value))
            level.physical = (*level.physical[:2], size if 0 < size < float("inf") else None)
        elif key in ("xorigin", "yorigin"):
            whole = int(value) if re.fullmatch(r"[+-]?[0-9]+", value) else 0
            level.extra[f"{key[0].upper()} Origin"] = whole if -(1 << 31) <= whole < 1 << 31 else 0
        elif key.strip():
            level.extra[names.get(key, key.strip())] = value.strip()
    c, z, t = sizes["channels"], sizes["slices"], sizes["frames"]
    level.order = "XYCZT"
    # an RGB page holds its samples; `channels` may count them, or pages of them
    if level.rgb and z * c * t == c:
        t = pages
    if z * t * (1 if level.rgb else c) == pages:
        level.size_z, level.size_t, level.size_c = z, t, level.size_c if level.rgb else c
    elif level.rgb and z * c * t == pages:
        level.size_z, level.size_t, level.size_c = z, t, level.size_c * c


def _pyramid(file: File, pages: list[Page], first: Level) -> list[Level]:
    """Levels from sub-directories: as many as every plane has; layouts match the full image."""
    levels, counts = [first], [len(p.tags.get(330, [])) for p in pages]
    for k in range(min(counts)):
        subs = [Page(file.directory(p.tags[330][k])[0], file.bytes.order) for p in pages]
        if any((s.type, s.bits, s.samples, s.planar, s.photometric) != (p.type, p.bits, p.samples, p.planar, p.photometric) or s.layout != subs[0].layout for s, p in zip(subs, pages)):
            raise ImageError("Unsupported", "TIFF sub-resolutions differ from their image")
        level = subs[0].level([s.blocks() for s in subs])
        for name in ("size_z", "size_c", "size_t", "order", "time_step", "extra"):
            setattr(level, name, getattr(first, name))
        levels.append(level)
    return levels


def generic(file: File) -> list[list[Level]]:
    """All pages as one time series if they are alike, else each page as a series."""
    pages = [Page(t, file.bytes.order) for t in file.chain]
    if len(pages) > 1:
        pages = [p for p in pages if _int(p.tags, 254, 0) != 1] or pages
    groups = [pages] if len({p.layout for p in pages}) == 1 else [[p] for p in pages]
    series = []
    for group in groups:
        level = group[0].level([p.blocks() for p in group])
        level.size_t = len(group)
        level.physical = (*calibration(group[0].tags), None)
        if comment := imagej_comment(group):
            _imagej(level, comment, len(group))
        date = group[0].tags.get(306)
        level.timestamp = date if isinstance(date, str) else None
        series.append(_pyramid(file, group, level))
    return series


def ome_xml(data) -> str | None:
    """The OME document of a file: of its first directory, or the file itself."""
    if not isinstance(data, File):
        if data[:2] not in (b"II", b"MM"):
            text = data[: len(data)].decode("utf-8", "replace")
            return text if "<OME" in text else None
        data = File(data, only_first=True)
    text = data.chain[0].get(270)
    return text if isinstance(text, str) and (text.lstrip().startswith(("<?xml", "<OME")) or "<OME " in text) else None


def ome_group(name: str, data) -> str | None:
    """What the files of an OME set have in common: the name of the file that tells of all, or the least of their names."""
    xml = ome_xml(data)
    if xml is None:
        return None
    if other := re.search(r"<(?:\w+:)?BinaryOnly\b[^>]*\bMetadataFile=\"([^\"]+)\"", xml):
        return other[1]
    names = set(re.findall(r"\bFileName=\"([^\"]+)\"", xml))
    return name if data[:2] not in (b"II", b"MM") else min({name, *names})


def _quantity(node, name: str, unit: str, default: str, table: dict) -> float | None:
    value = node.get(name)
    if value is None:
        return None
    factor = table.get(node.get(unit, default))
    try:
        number = float(value) * factor
    except (TypeError, ValueError) as error:
        raise ImageError("InvalidData", f"OME {name} {value}") from error
    if number != number or abs(number) == float("inf"):
        raise ImageError("InvalidData", f"OME {name} {value}")
    return number


def _whole(node, name: str, default: int | None = None, least: int = 0) -> int:
    text = node.get(name)
    if text is None and default is not None:
        return default
    if text is None or not re.fullmatch(r"\+?\d+", text) or int(text) < least:
        raise ImageError("InvalidData", f"OME {name} {text}")
    return int(text)


def ome(xml: str, files: dict[str, File], first: str, places: dict[str, int]) -> list[list[Level]]:
    """Series of an OME document; files by name, `first` for planes that name none; places: which of the dataset's files each is."""
    try:
        root = ET.fromstring(xml)
    except ET.ParseError as error:
        raise ImageError("InvalidData", f"OME-XML: {error}") from error
    tag = lambda e: e.tag.rpartition("}")[2]
    series = []
    for image in (e for e in root.iter() if tag(e) == "Image"):
        px = next((e for e in image if tag(e) == "Pixels"), None)
        if px is None:
            raise ImageError("InvalidData", "OME image without pixels")
        kind = OME_TYPES.get(px.get("Type", px.get("PixelType", "")).lower())
        order = px.get("DimensionOrder", "XYZCT")
        z, c, t = (_whole(px, f"Size{a}", least=1) for a in "ZCT")
        channels = [e for e in px if tag(e) == "Channel"]
        samples = _whole(channels[0], "SamplesPerPixel", 1, 1) if channels else 1
        if kind is None or c % samples:
            raise ImageError("InvalidData", "OME pixel type or channels")
        logical = c // samples
        count = z * logical * t
        place: list = [None] * count
        data = [e for e in px if tag(e) == "TiffData"]
        for d in data:
            uuid = next((e for e in d if tag(e) == "UUID"), None)
            name = uuid.get("FileName", first) if uuid is not None else first
            if name not in files:
                raise ImageError("InvalidData", f"OME file {name} is missing")
            bare = d.get("IFD") is None and d.get("PlaneCount") is None
            many = _whole(d, "PlaneCount", min(len(files[name].chain), count) if bare else 1)
            at = plane_index(order, (z, logical, t), _whole(d, "FirstZ", 0), _whole(d, "FirstC", 0) // samples, _whole(d, "FirstT", 0))
            for i in range(many):
                ifd = _whole(d, "IFD", 0) + i
                if at + i >= count or ifd >= len(files[name].chain) or place[at + i] is not None:
                    raise ImageError("InvalidData", "OME planes overlap or are out of range")
                place[at + i] = name, ifd
        if not data:
            place = [(first, i) for i in range(count)]
        if None in place or any(i >= len(files[n].chain) for n, i in place):
            raise ImageError("InvalidData", "OME planes are missing")
        pages = [Page(files[n].chain[i], files[n].bytes.order) for n, i in place]
        if len({p.layout for p in pages}) > 1 or pages[0].type != kind or (pages[0].width, pages[0].height) != (_whole(px, "SizeX"), _whole(px, "SizeY")):
            raise ImageError("InvalidData", "OME pixels differ from their TIFF")
        level = pages[0].level([[_at(b, places[n]) for b in p.blocks()] for p, (n, _) in zip(pages, place)])
        level.size_z, level.size_c, level.size_t, level.order = z, c, t, order
        level.bits = _whole(px, "SignificantBits", level.bits)
        level.physical = tuple(_quantity(px, f"PhysicalSize{a}", f"PhysicalSize{a}Unit", "µm", units.LENGTHS) for a in "XYZ")
        level.time_step = _quantity(px, "TimeIncrement", "TimeIncrementUnit", "s", units.TIMES)
        date = next((e for e in image if tag(e) == "AcquisitionDate"), None)
        level.timestamp = date.text if date is not None else None
        lens = _objective(root, image)
        if lens is not None:
            level.objective = lens.get("Model"), *(None if lens.get(k) is None else _real(lens.get(k)) for k in ("NominalMagnification", "LensNA"))
        level.channels = [{"name": e.get("Name"), "color": _colour(e.get("Color")), "excitation_nm": _quantity(e, "ExcitationWavelength", "ExcitationWavelengthUnit", "nm", units.NANOMETRES), "emission_nm": _quantity(e, "EmissionWavelength", "EmissionWavelengthUnit", "nm", units.NANOMETRES)} for e in channels]
        level.plane_info = [{} for _ in range(count)]
        for e in (e for e in px if tag(e) == "Plane"):
            at = plane_index(order, (z, logical, t), _whole(e, "TheZ"), _whole(e, "TheC") // samples, _whole(e, "TheT"))
            if at >= count:
                raise ImageError("InvalidData", "OME plane out of range")
            level.plane_info[at] = {"exposure": _quantity(e, "ExposureTime", "ExposureTimeUnit", "s", units.TIMES), "delta_t": _quantity(e, "DeltaT", "DeltaTUnit", "s", units.TIMES), **{f"position_{a.lower()}": _quantity(e, f"Position{a}", f"Position{a}Unit", "reference frame", units.LENGTHS) for a in "XYZ"}}
        series.append(_pyramid(files[first], pages, level) if len(files) == 1 else [level])
    if not series:
        raise ImageError("InvalidData", "OME document without images")
    return series


def _objective(root, image):
    """The objective that an image's settings name, else the only one there is."""
    tag = lambda e: e.tag.rpartition("}")[2]
    found = [e for e in root.iter() if tag(e) == "Objective"]
    named = next((e.get("ID") for e in image if tag(e) in ("ObjectiveSettings", "ObjectiveRef")), None)
    return next((e for e in found if e.get("ID") == named), found[0] if named is None and len(found) == 1 else None)


def _colour(text: str | None) -> int | None:
    """A signed or unsigned colour of 32 bits as an unsigned one."""
    if text is None or not re.fullmatch(r"[+-]?[0-9]+", text) or not -(1 << 31) <= int(text) < 1 << 32:
        return None
    return int(text) & 0xFFFFFFFF


def _at(block: Block, source: int) -> Block:
    block.source = source
    return block


def tiff(data, companions: dict | None = None, name: str = "") -> list[list[Level]]:
    """Series of a TIFF, of an OME set, or of a document that tells of TIFFs beside it."""
    others = {n: File(d) for n, d in (companions or {}).items() if d[:2] in (b"II", b"MM")}
    places = {n: k for k, n in enumerate([name, *(companions or {})])}
    if data[:2] not in (b"II", b"MM"):
        xml = ome_xml(data)
        if xml is None or not others:
            raise ImageError("Format", "an OME document without its TIFFs")
        return ome(xml, others, min(others), places)
    file = File(data)
    xml = ome_xml(file)
    if xml is not None and "BinaryOnly" in xml:
        xml = next((x for d in (companions or {}).values() if d[:2] not in (b"II", b"MM") and (x := ome_xml(d))), None)
        if xml is None:
            raise ImageError("InvalidData", "the OME document of a BinaryOnly file is missing")
    return generic(file) if xml is None else ome(xml, {name: file, **others}, name, places)
