"""ND2: chunks found by their mark, metadata in binary records or XML, planes in a sequence."""

from __future__ import annotations

import math
import re
import struct
import xml.etree.ElementTree as ET

from lumenplane.sources.codecs import looks_like_zlib
from lumenplane.sources.model import Block, ImageError, Level, plane_index

MARK = b"\xda\xce\xbe\x0a"
NAME_LIMIT, DEPTH_LIMIT = 1 << 20, 64
# Experiment type -> axis.
AXES = {1: "T", 8: "T", 2: "S", 4: "Z"}


def chunks(data: bytes) -> list[tuple[str, int, int]]:
    """(name, offset, length) of every chunk; what is no chunk is passed over byte by byte."""
    out, at = [], data.find(MARK)
    while at >= 0 and at + 16 <= len(data):
        name_size, size = struct.unpack("<IQ", data[at + 4 : at + 16])
        start = at + 16 + name_size
        name = data[at + 16 : start].split(b"\0")[0]
        good = 0 < name_size <= NAME_LIMIT and start + size <= len(data) and name and all(32 <= c < 127 for c in name)
        if good:
            out.append((name.decode("ascii"), start, size))
        at = data.find(MARK, start + size if good else at + 1)
    return out


def records(data: bytes, at: int = 0, stop: int | None = None, depth: int = 0) -> list[tuple[str, object]]:
    """(name, value) of binary records, nested ones (lists) in place; a malformed record ends its level."""
    out: list[tuple[str, object]] = []
    stop = len(data) if stop is None else stop
    while depth <= DEPTH_LIMIT and at + 2 <= stop:
        begin, kind, units = at, data[at], data[at + 1]
        at += 2 + 2 * units
        if not 1 <= kind <= 11 or not units or at > stop:
            break
        name = data[begin + 2 : at].decode("utf-16-le", "replace").rstrip("\0")
        form = {1: "<?", 2: "<i", 3: "<I", 4: "<q", 5: "<Q", 6: "<d", 7: "<Q"}.get(kind)
        if form:
            if at + struct.calcsize(form) > stop:
                break
            out.append((name, struct.unpack_from(form, data, at)[0]))
            at += struct.calcsize(form)
        elif kind == 8:
            end = next((i for i in range(at, stop - 1, 2) if data[i : i + 2] == b"\0\0"), None)
            if end is None:
                break
            out.append((name, data[at:end].decode("utf-16-le", "replace")))
            at = end + 2
        elif kind == 9:
            if at + 8 > stop:
                break
            at += 8 + struct.unpack_from("<Q", data, at)[0]
        elif kind == 11:
            if at + 12 > stop:
                break
            count, size = struct.unpack_from("<IQ", data, at)
            end = begin + size
            if end < at + 12 or end + 8 * count > stop:
                break
            out.append((name, records(data, at + 12, end, depth + 1)))
            at = end + 8 * count
        else:
            break
    return out


def _flat(values) -> list[tuple[str, object]]:
    return [x for name, v in values for x in (_flat(v) if isinstance(v, list) else [(name, v)])]


def _xml_values(text: str) -> list[tuple[str, object]]:
    """(name, value) of elements in document order; malformed text has none."""
    try:
        root = ET.fromstring("<root>" + re.sub(r"<\?xml.*?\?>", "", text) + "</root>")
    except ET.ParseError:
        return []
    out = []
    for e in root.iter():
        value = (e.get("value") or e.text or "").strip()
        if value:
            out.append((e.tag, value))
    return out


def _number(value) -> int | None:
    if isinstance(value, str):
        return int(value) if re.fullmatch(r"\d+", value) else None
    return int(value) if isinstance(value, (int, float)) and value >= 0 else None


def _loops(values) -> list[tuple[str, int]]:
    """Axes and counts of an experiment, outermost first."""
    axes, now = [], dict(v for v in values if not isinstance(v[1], list))
    kind, pars = AXES.get(_number(now.get("eType"))), next((dict(_flat(v)) for n, v in values if n in ("uLoopPars", "LoopPars") and isinstance(v, list)), now)
    count = _number(pars.get("uiCount"))
    if kind and count:
        axes.append((kind, count))
    for n, v in values:
        if n in ("ppNextLevelEx", "uiNextLevelEx") and isinstance(v, list):
            inner = next((x for _, x in v if isinstance(x, list)), v)
            axes += _loops(inner)
    return axes


# The end of a loop's run-time type -> axis.
LOOPS = (("ZStackLoop", "Z"), ("TimeLoop", "T"), ("XYPosLoop", "S"))


def _parsed(text: str) -> ET.Element | None:
    try:
        return ET.fromstring("<root>" + re.sub(r"<\?xml.*?\?>", "", text) + "</root>")
    except ET.ParseError:
        return None


def xml_loops(text: str) -> list[list[list[tuple[str, int]]]]:
    """For each outermost experiment of the text, every way its loops may count: axes, outermost first."""
    root = _parsed(text)
    if root is None:
        return []
    value = lambda e: (e.get("value") or e.text or "").strip() if e is not None else ""
    kind = lambda e: next((a for end, a in LOOPS if (e.get("runtype") or "").endswith(end)), None)
    tops, stack = [], [root]
    while stack:
        e = stack.pop(0)
        if e.get("runtype") == "RLxExperiment":
            tops.append(e)
        else:
            stack += list(e)
    found = []
    for e in tops:
        ways: list[list[tuple[str, int]]] = [[]]
        for _ in range(16):
            pars = e.find("uLoopPars")
            inner = list(pars.iter()) if pars is not None else []
            axis = AXES.get(_number(value(e.find("eType"))) or 0) or next((kind(n) for n in inner if kind(n)), None)
            counts = dict.fromkeys(n for p in inner if kind(p) == axis and (n := _number(value(p.find("uiCount")))))
            if axis and all(axis != a for a, _ in ways[0]):
                ways = [[*w, (axis, n)] for w in ways for n in counts or [1]]
            below = e.find("ppNextLevelEx")
            e = next((n for n in below.iter() if n.get("runtype") == "RLxExperiment"), None) if below is not None else None
            if e is None:
                break
        if ways[0]:
            found.append(ways)
    return found


def colours(text: str) -> dict[str, int]:
    """A channel's colour (32 bits) by its dye's name; both share the prefix of their element names."""
    root, shades, dyes = _parsed(text), {}, {}
    for e in root.iter() if root is not None else ():
        value = (e.get("value") or e.text or "").strip()
        if e.tag.endswith("ChannelColor") and re.fullmatch(r"[+-]?\d+", value) and -(1 << 31) <= int(value) < 1 << 32:
            shades[e.tag[: e.tag.index("Channel")]] = int(value) & 0xFFFFFFFF
        elif e.tag.endswith("DyeName") and value:
            dyes[e.tag[: max(0, e.tag.find("Channel"))]] = value
    return {dyes.get(k, k): v for k, v in shades.items()}


def colour_table(colour: int, pixel_type: str) -> tuple | None:
    """Red, green and blue ramps: peak times i / 255, truncated, at most 65535."""
    entries = {"uint8": 256, "uint16": 65536}.get(pixel_type)
    if not colour or entries is None:
        return None
    return tuple([min(65535, int((colour >> s & 255) * (i / 255.0))) for i in range(entries)] for s in (0, 8, 16))


def nd2(data: bytes) -> list[list[Level]]:
    found = chunks(data)
    images = sorted((int(m[1]), at, size) for n, at, size in found if (m := re.fullmatch(r"ImageDataSeq\|(\d+)!", n)))
    if not images:
        raise ImageError("Unsupported", "ND2 without modern image chunks" if data.startswith(MARK) else "legacy ND2 (JPEG 2000)")
    if images[0][0] > 1 or any(b[0] != a[0] + 1 for a, b in zip(images, images[1:])):
        raise ImageError("InvalidData", "ND2 image sequence has gaps")
    values: dict = {}
    attributes: dict = {}
    experiments, texts, shades = [], [], {}
    for name, at, size in found:
        low = name.lower()
        if name.startswith("ImageDataSeq") or not any(w in low for w in ("metadata", "attrib", "text", "calibra", "customdata")):
            continue
        body = data[at : at + size]
        tree = [] if body.lstrip()[:1] == b"<" else records(body)
        flat = _xml_values(body.decode("utf-8", "replace")) if body.lstrip()[:1] == b"<" else _flat(tree)
        target = attributes if name.startswith("ImageAttributes") else values
        for k, v in flat:
            target.setdefault(k, v)
        if not tree:
            texts += xml_loops(body.decode("utf-8", "replace"))
            shades |= colours(body.decode("utf-8", "replace"))
        experiments += [v for n, v in tree if n in ("SLxExperiment", "RLxExperiment") and isinstance(v, list)]
    get = lambda key: _number(attributes.get(key, values.get(key)))
    width, height, parts = get("uiWidth"), get("uiHeight"), get("uiComp") or 1
    memory, bits = get("uiBpcInMemory") or 8, get("uiBpcSignificant") or 0
    kind = {8: "uint8", 16: "uint16"}.get(memory)
    if not width or not height or kind is None:
        raise ImageError("InvalidData", "ND2 image attributes")
    # the one experiment whose counts give the planes stored; binary records come before XML
    fits: list[list[tuple[str, int]]] = []
    for ways in ([[_loops(e)] for e in experiments], texts):
        for loops in (w for group in ways for w in group):
            if loops and math.prod(n for _, n in loops) == len(images) and loops not in fits:
                fits.append(loops)
        if fits:
            break
    if len(fits) > 1:
        raise ImageError("InvalidData", "ND2 experiments are ambiguous")
    loops = fits[0] if fits else [("T", len(images))]
    size = {a: max([n for b, n in loops if b == a], default=1) for a in "TSZ"}
    sample = {"uint8": 1, "uint16": 2}[kind]
    tight = width * parts * sample
    row = max(get("uiWidthBytes") or 0, tight)
    series = []
    for s in range(size["S"]):
        level = Level(width, height, size["Z"], parts, size["T"], kind, bits=bits, order="XYCZT", false_color=False)
        level.planes = [[] for _ in range(size["Z"] * parts * size["T"])]
        step = _real(values.get("dCalibration"))
        level.physical = (step, step, _real(values.get("dZStep")))
        level.extra = {k: v for k, v in values.items() if isinstance(v, (str, int, float))}
        level.channels = [{"name": n, "color": v} for n, v in list(shades.items())[:parts]]
        if parts == 1 and shades:
            level.lut = colour_table(next(iter(shades.values())), kind)
        series.append([level])
    for i, (_, at, length) in enumerate(images):
        place, rest = {"T": 0, "S": 0, "Z": 0}, i
        for axis, n in reversed(loops):  # the last loop is the fastest
            rest, place[axis] = divmod(rest, n)
        body = data[at + 8 : at + length]
        if body[:4] == b"\xff\x4f\xff\x51" or body[4:8] == b"jP  ":
            codec = "jpeg2000"
        else:
            codec = "zlib" if get("eCompression") == 0 or looks_like_zlib(body) else "raw"
        if codec == "raw" and len(body) not in (row * height, tight * height):
            raise ImageError("Format", f"ND2 plane of {len(body)} bytes")
        level = series[place["S"]][0]
        for c in range(parts):
            k = plane_index("XYCZT", (size["Z"], parts, size["T"]), place["Z"], c, place["T"])
            level.planes[k] = [Block(0, 0, width, height, at + 8, length - 8, codec, samples=parts, keep=(c, 1), row_bytes=tight if codec == "raw" and len(body) == tight * height else row)]
    return series


def _real(value) -> float | None:
    try:
        number = float(value)
    except (TypeError, ValueError):
        return None
    return number if number > 0 and number != float("inf") else None
