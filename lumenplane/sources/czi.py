"""CZI: segments, sub-block directory, scenes, mosaics and pyramids."""

from __future__ import annotations

import xml.etree.ElementTree as ET

from lumenplane.sources.model import Block, Bytes, ImageError, Level, plane_index

# Pixel type code -> type, samples (three or four: blue first).
TYPES = {0: ("uint8", 1), 1: ("uint16", 1), 2: ("float32", 1), 3: ("uint8", 3), 4: ("uint16", 3), 8: ("float32", 3), 9: ("uint8", 4), 12: ("uint32", 1), 13: ("float64", 1)}
# Compression codes.
CODECS = {0: "raw", 1: "jpeg-padded", 2: "lzw", 4: "jpegxr", 5: "zstd", 6: "zstd1"}


def _segment(b: Bytes, at: int, name: str) -> int:
    """The bytes that a segment uses, checked against the file."""
    if not b.at(at, 16).startswith(name.encode()):
        raise ImageError("InvalidData", f"no {name} segment at {at}")
    allocated, used = b.get("2q", at + 16)
    b.at(at + 32, used or allocated)
    return used or allocated


class Entry:
    def __init__(self, b: Bytes, at: int):
        self.type, self.position = b.get("i", at + 2), b.get("q", at + 6)
        self.codec, count = b.get("i", at + 18), b.get("i", at + 28)
        if count < 0:
            raise ImageError("InvalidData", "CZI dimension count")
        self.size, self.start, self.extent, self.stored = 32 + 20 * count, {}, {}, {}
        for i in range(count):
            o = at + 32 + 20 * i
            name = b.at(o, 4).split(b"\0")[0].decode("ascii", "replace").strip()
            start, size = b.get("2i", o + 4)
            if name:
                if size <= 0 or name in "ZCT" and start < 0 or name in "XY" and b.get("i", o + 16) <= 0:
                    raise ImageError("InvalidData", f"CZI dimension {name}")
                self.start[name], self.extent[name], self.stored[name] = start, size, b.get("i", o + 16)
        if not {"X", "Y"} <= set(self.start):
            raise ImageError("InvalidData", "CZI sub-block without X or Y")
        for name in "RIH":
            if self.start.get(name, 0) or self.extent.get(name, 1) > 1:
                raise ImageError("Unsupported", f"CZI dimension {name}")
        if any(self.extent.get(n, 1) > 1 for n in "ZCTSBVM"):
            raise ImageError("Unsupported", "CZI sub-block of several planes")
        self.part = 0

    def at(self, name: str) -> int:
        return self.start.get(name, 0)

    @property
    def native(self) -> bool:
        return all(self.stored[n] == self.extent[n] for n in "XY")

    def fits(self, scale: int) -> bool:
        """Whether the stored sizes are the full ones over scale, rounded either way."""
        return all(max(1, self.extent[n] // scale) <= self.stored[n] <= max(1, -(-self.extent[n] // scale)) for n in "XY")

    def own_scale(self) -> int:
        """The scale that the sizes tell: both axes alike, or that of the longer one if it fits both."""
        told = {}
        for n in "XY":
            if self.extent[n] < self.stored[n]:
                raise ImageError("InvalidData", f"CZI sub-block is stored larger than it is in {n}")
            told[n] = (self.extent[n] + self.stored[n] // 2) // self.stored[n]
        if told["X"] == told["Y"]:
            return told["X"]
        longer = "X" if self.extent["X"] > self.extent["Y"] else "Y"
        if self.extent["X"] == self.extent["Y"] or not self.fits(told[longer]):
            raise ImageError("InvalidData", f"CZI scales differ in X ({told['X']}) and Y ({told['Y']})")
        return told[longer]

    def block(self, b: Bytes) -> tuple[int, int]:
        """Offset and length of the sub-block's data."""
        _segment(b, self.position, "ZISRAWSUBBLOCK")
        meta, _, size = b.get("iiq", self.position + 32)
        offset = self.position + 32 + max(256, 16 + self.size) + meta
        b.at(offset, size)
        return offset, size


def entries(data: bytes) -> tuple[list[Entry], str]:
    b = Bytes(data)
    _segment(b, 0, "ZISRAWFILE")
    directory, meta = b.get("2q", 32 + 52)
    xml, found = "", []
    if meta > 0:
        used = _segment(b, meta, "ZISRAWMETADATA")
        size = b.get("i", meta + 32)
        if size < 0 or 256 + size > used:
            raise ImageError("InvalidData", "CZI metadata size")
        xml = b.at(meta + 288, size).decode("utf-8")
    if directory > 0:
        used = _segment(b, directory, "ZISRAWDIRECTORY")
        count, at = b.get("i", directory + 32), directory + 160
        for _ in range(count):
            found.append(Entry(b, at))
            at += found[-1].size
            if at > directory + 32 + used:
                raise ImageError("InvalidData", "CZI directory size")
    return found, xml


def attachments(data: bytes) -> list[tuple[str, int, int]]:
    """(name, offset, length) of the first label and the first slide preview, by place in the file."""
    b = Bytes(data)
    part, directory = b.get("i", 32 + 48), b.get("q", 32 + 72)
    if directory <= 0:
        return []
    used, count = _segment(b, directory, "ZISRAWATTDIR"), b.get("i", directory + 32)
    if count < 0 or 256 + 128 * count > used:
        raise ImageError("InvalidData", "CZI attachment directory size")
    text = lambda at, n: b.at(at, n).split(b"\0")[0].decode("utf-8", "replace").strip()
    listed = []
    for at in (directory + 288 + 128 * i for i in range(count)):
        name = text(at + 48, 80)
        if name in ("Label", "SlidePreview") and b.get("i", at + 20) == part:
            listed.append((b.get("q", at + 12), name, text(at + 40, 8)))
    found: dict[str, tuple[str, int, int]] = {}
    for position, name, kind in sorted(listed):
        if name in found:
            continue
        if kind != "CZI":
            raise ImageError("InvalidData", f"CZI {name} is {kind}")
        used, size = _segment(b, position, "ZISRAWATTACH"), b.get("i", position + 32)
        if size < 0 or 256 + size > used:
            raise ImageError("InvalidData", f"CZI {name} size")
        found[name] = name, position + 288, size
    return list(found.values())


def metadata(xml: str) -> dict:
    """Precision, micrometres, time step, objective and channels."""
    out: dict = {"physical": [None] * 3, "channels": []}
    if not xml.strip():
        return out
    try:
        root = ET.fromstring(xml)
    except ET.ParseError as error:
        raise ImageError("InvalidData", f"CZI XML: {error}") from error
    number = lambda text: float(text) if text and text.strip() else None
    for d in root.iter("Distance"):
        k = "XYZ".find(d.get("Id", "?"))
        value = number(d.findtext("Value"))
        if k >= 0 and value and value > 0:
            out["physical"][k] = value * 1e6
    bits = root.find(".//ComponentBitCount")
    out["bits"] = int(bits.text) if bits is not None and bits.text else None
    step = root.find(".//Increment")
    out["time_step"] = number(step.text) if step is not None else None
    lens = root.find(".//Objective")
    if lens is not None:
        out["objective"] = lens.findtext(".//Model") or lens.get("Name"), number(lens.findtext("NominalMagnification")), number(lens.findtext("LensNA"))
    out["channels"] = [{"name": c.get("Name") or c.get("Id")} for c in root.findall(".//Dimensions/Channels/Channel")]
    return out


def czi(files: list[bytes], inner: bool = True) -> list[list[Level]]:
    """Series by scene, block and view, then labels and previews; levels by the scale of their sub-blocks; files are parts in order."""
    found, xml = [], ""
    for part, data in enumerate(files):
        own, text = entries(data)
        for e in own:
            e.part = part
        found, xml = [*found, *own], xml or text
    if not found:
        raise ImageError("InvalidData", "CZI without sub-blocks")
    info, series = metadata(xml), []
    for scene in sorted({tuple(e.at(n) for n in "SBV") for e in found}):
        group = [e for e in found if tuple(e.at(n) for n in "SBV") == scene]
        if len({e.type for e in group}) > 1:
            raise ImageError("Unsupported", "CZI pixel types differ")
        native = [e for e in group if e.native]
        mosaics = sorted({e.at("M") for e in group})
        layout = lambda m: sorted((*(e.at(n) for n in "ZCTXY"), e.extent["X"], e.extent["Y"]) for e in native if e.at("M") == m)  # noqa: B023, E731
        split = len(mosaics) > 1 and all(layout(m) == layout(mosaics[0]) for m in mosaics)
        for part in [[e for e in group if e.at("M") == m] for m in mosaics] if split else [group]:
            series.append(_levels(part, files, info))
    for source, data in enumerate(files if inner else []):
        for name, offset, size in attachments(data):
            own = czi([data[offset : offset + size]], inner=False)
            if len(own) != 1 or len(own[0]) != 1 or own[0][0].image_count != 1:
                raise ImageError("Unsupported", f"CZI {name} is no single plane")
            own[0][0].extra |= {"attachment": name, "thumbnail": True}
            for block in own[0][0].planes[0]:  # places count from the start of the file that holds it
                block.offset, block.source = block.offset + offset, source
            series.append(own[0])
    return series


def _base(scale: int) -> int | None:
    """2 or 3 if scale is a power of it (beyond 1)."""
    for factor in (2, 3):
        left = scale
        while left > 1 and left % factor == 0:
            left //= factor
        if left == 1 and scale > 1:
            return factor
    return None


def by_scale(group: list[Entry]) -> dict[int, list[Entry]]:
    """Sub-blocks of a series by their scale, all powers of one factor.

    The largest reduced block tells the factor; small blocks at an edge, whose ratios are rounded, belong
    to the one level that fits both their axes.
    """
    found: dict[int, list[Entry]] = {1: [e for e in group if e.native]}
    if any(e.own_scale() != 1 for e in found[1]):
        raise ImageError("InvalidData", "CZI full-size sub-block of a reduced scale")
    reduced = [(e, e.own_scale()) for e in group if not e.native]
    told = [(e.stored["X"] * e.stored["Y"], max(e.stored["X"], e.stored["Y"]), k, _base(s)) for k, (e, s) in enumerate(reduced) if _base(s)]
    if reduced and not told:
        raise ImageError("Unsupported", "CZI levels are no powers of 2 or 3")
    scales = sorted({s for _, s in reduced if _base(s) == max(told)[3]}) if told else []
    for e, scale in reduced:
        fit = [s for s in scales if e.fits(s)]
        if not fit:
            raise ImageError("InvalidData", f"CZI sub-block of scale {scale} fits no level")
        if len(fit) > 1:
            raise ImageError("Unsupported", f"CZI sub-block of scale {scale} fits several levels")
        found.setdefault(fit[0], []).append(e)
    return found


def _levels(group: list[Entry], files: list[bytes], info: dict) -> list[Level]:
    if group[0].type not in TYPES:
        raise ImageError("Unsupported", f"CZI pixel type {group[0].type}")
    kind, samples = TYPES[group[0].type]
    size = {n: max(e.at(n) + e.extent.get(n, 1) for e in group) for n in "ZCT"}
    held = by_scale(group)
    native = held[1]
    if not native:
        raise ImageError("InvalidData", "CZI without full resolution")
    x0, y0 = min(e.at("X") for e in native), min(e.at("Y") for e in native)
    wide, high = max(e.at("X") + e.extent["X"] for e in native) - x0, max(e.at("Y") + e.extent["Y"] for e in native) - y0
    scales = sorted(held)
    rgb, out = samples > 1, []
    for scale in scales:
        level = Level(wide // scale, high // scale, size["Z"], size["C"] * samples, size["T"], kind, samples=samples, order="XYCZT", rgb=rgb, interleaved=rgb, false_color=False)
        level.fill = 255 if rgb and len(scales) > 1 else 0
        level.bits = info.get("bits") or 0
        level.physical = tuple(None if v is None else v * (scale if k < 2 else 1) for k, v in enumerate(info["physical"]))
        level.time_step, level.objective, level.channels = info.get("time_step"), info.get("objective", (None, None, None)), info["channels"]
        level.extra = {"scale": scale, "subblocks": len(held[scale])}
        level.planes = [[] for _ in range(size["Z"] * size["C"] * size["T"])]
        for e in held[scale]:
            offset, length = e.block(Bytes(files[e.part]))
            at = plane_index("XYCZT", (size["Z"], size["C"], size["T"]), e.at("Z"), e.at("C"), e.at("T"))
            level.planes[at].append(Block((e.at("X") - x0) // scale, (e.at("Y") - y0) // scale, e.stored["X"], e.stored["Y"], offset, length, CODECS.get(e.codec, f"czi{e.codec}"), samples=samples, swap_rgb=rgb, source=e.part))
        out.append(level)
    return out
