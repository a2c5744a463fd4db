"""Bytes of small image files, for round trips through the scans."""

from __future__ import annotations

import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def mrc(planes: np.ndarray, order: str = "<") -> bytes:
    z, y, x = planes.shape
    modes = {"i2": 1, "f4": 2, "u2": 6, "u1": 0}
    head = bytearray(1024)
    struct.pack_into(order + "4i", head, 0, x, y, z, modes[planes.dtype.str[1:]])
    head[212] = 68 if order == "<" else 17
    return bytes(head) + np.ascontiguousarray(planes[:, ::-1]).astype(planes.dtype.newbyteorder(order)).tobytes()


def nrrd(planes: np.ndarray, coding: str = "raw") -> bytes:
    z, y, x = planes.shape
    names = {"f4": "float", "u2": "uint16", "u1": "uint8"}
    body = planes.tobytes()
    head = f"NRRD0004\ntype: {names[planes.dtype.str[1:]]}\ndimension: 3\nsizes: {x} {y} {z}\nendian: little\nencoding: {coding}\n\n"
    return head.encode() + (zlib.compress(body, wbits=31) if coding == "gzip" else body)


def dcimg(frames: np.ndarray, footer: int = 0) -> bytes:
    """Version 1; rows are stored as they are given."""
    t, y, x = frames.shape
    wide = frames.dtype.itemsize
    head = bytearray(256)
    head[:5] = b"DCIMG"
    struct.pack_into("<I", head, 8, 0x01000000)
    struct.pack_into("<I", head, 40, 128)
    struct.pack_into("<2i", head, 128 + 60, t, wide)
    struct.pack_into("<2i", head, 128 + 72, x, y)
    struct.pack_into("<I", head, 128 + 84, x * y * wide)
    struct.pack_into("<q", head, 128 + 96, 128)
    struct.pack_into("<I", head, 128 + 124, footer)
    return bytes(head) + b"".join(f.tobytes() + bytes(footer) for f in frames)


# The usual Huffman table of luminance DC differences (T.81, K.3), as counts by length and symbols.
_DC = bytes((0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0)), bytes(range(12))


def jpeg(image: np.ndarray, quantiser: int = 1, interval: int = 0, halved: bool = False) -> bytes:
    """A baseline JPEG of (height, width[, 3]) bytes; AC codes are all eight bits long; halved: the second and third component are sub-sampled by two."""
    from lumenplane.sources.jpeg import _COSINES, ZIGZAG

    image = image.reshape(*image.shape[:2], -1).astype(np.int64)
    symbols = [0x00, 0xF0, *(r << 4 | s for r in range(16) for s in range(1, 11))]
    codes = {0: {}, 1: {s: (k, 8) for k, s in enumerate(symbols)}}
    code, at = 0, 0
    for bits, count in enumerate(_DC[0], 1):
        for _ in range(count):
            codes[0][_DC[1][at]] = (code, bits)
            code, at = code + 1, at + 1
        code <<= 1
    parts = image.shape[2]
    scale = [2 if halved and k else 1 for k in range(parts)]
    most = max(scale)
    high, wide = (-(-n // (8 * most)) * 8 * most for n in image.shape[:2])
    padded = np.pad(image, ((0, high - image.shape[0]), (0, wide - image.shape[1]), (0, 0)), mode="edge")
    planes = [padded[:: scale[k], :: scale[k], k] for k in range(parts)]
    blocks = [np.rint(_COSINES.T @ (p.reshape(p.shape[0] // 8, 8, p.shape[1] // 8, 8).swapaxes(1, 2) - 128.0) @ _COSINES / quantiser).astype(int) for p in planes]
    body, text, last, done = b"", [], [0] * parts, 0

    def flush() -> bytes:
        bits = "".join(text)
        bits += "1" * (-len(bits) % 8)
        return int(bits or "0", 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\x00")

    def put(table: int, symbol: int, value: int = 0, size: int = 0) -> None:
        code, bits = codes[table][symbol]
        text.append(f"{code:0{bits}b}" + (f"{value if value >= 0 else value + (1 << size) - 1:0{size}b}" if size else ""))

    for y in range(high // (8 * most)):
        for x in range(wide // (8 * most)):
            if interval and done and done % interval == 0:
                body += flush() + bytes([0xFF, 0xD0 + (done // interval - 1) % 8])
                text, last = [], [0] * parts
            done += 1
            for k in range(parts):
                n = most // scale[k]
                for j in range(n):
                    for i in range(n):
                        block = blocks[k][y * n + j, x * n + i].ravel()[list(ZIGZAG)]
                        difference, last[k] = int(block[0]) - last[k], int(block[0])
                        put(0, abs(difference).bit_length(), difference, abs(difference).bit_length())
                        run = 0
                        for v in map(int, np.trim_zeros(block[1:], "b")):
                            if v == 0:
                                run += 1
                                continue
                            while run > 15:
                                put(1, 0xF0)
                                run -= 16
                            put(1, run << 4 | abs(v).bit_length(), v, abs(v).bit_length())
                            run = 0
                        if not block[63]:
                            put(1, 0)
    body += flush()
    segment = lambda mark, content: bytes([0xFF, mark]) + struct.pack(">H", len(content) + 2) + content
    ids = [82, 71, 66] if parts == 3 and not halved else list(range(1, parts + 1))
    out = b"\xff\xd8" + segment(0xDB, bytes([0]) + bytes([quantiser]) * 64) + segment(0xC4, bytes([0]) + _DC[0] + _DC[1]) + segment(0xC4, bytes([16]) + bytes([0] * 7 + [len(symbols)] + [0] * 8) + bytes(symbols))
    out += segment(0xDD, struct.pack(">H", interval)) if interval else b""
    out += segment(0xC0, struct.pack(">BHHB", 8, *image.shape[:2], parts) + b"".join(bytes([ids[k], (most // scale[k]) * 17, 0]) for k in range(parts)))
    return out + segment(0xDA, bytes([parts]) + b"".join(bytes([n, 0]) for n in ids) + bytes([0, 63, 0])) + body + b"\xff\xd9"


def tiff(pages: np.ndarray, coding: str = "raw", rows: int = 3, order: str = "<", predictor: bool = False, tile: int = 0, description: str = "", first: tuple = ()) -> bytes:
    """Pages of one sample per pixel in strips of `rows` or tiles of side `tile`; `first`: further (tag, field type, values) of the first page."""
    n, y, x = pages.shape
    kind = {"f": 3, "i": 2, "u": 1}[pages.dtype.kind]
    codes = {"raw": 1, "jpeg": 7, "zlib": 8, "packbits": 32773, "zstd": 50000}
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 0))
    link = 4
    for page in pages.astype(pages.dtype.newbyteorder(order)):
        if tile:
            parts = [np.pad(page[j : j + tile, i : i + tile], ((0, max(0, j + tile - y)), (0, max(0, i + tile - x)))) for j in range(0, y, tile) for i in range(0, x, tile)]
        else:
            parts = [page[j : j + rows] for j in range(0, y, rows)]
        offsets, counts = [], []
        for part in parts:
            if predictor:
                native = part.astype(part.dtype.newbyteorder("="))
                part = np.diff(native, axis=1, prepend=native.dtype.type(0)).astype(part.dtype)
            raw = part.tobytes()
            if coding == "jpeg":
                raw = jpeg(part)
            elif coding == "zlib":
                raw = zlib.compress(raw)
            elif coding == "zstd":
                import zstandard

                raw = zstandard.compress(raw)
            elif coding == "packbits":
                raw = b"".join(bytes([len(raw[i : i + 128]) - 1]) + raw[i : i + 128] for i in range(0, len(raw), 128))
            offsets.append(len(out))
            counts.append(len(raw))
            out += raw
        tags = [(256, "I", [x]), (257, "I", [y]), (258, "H", [8 * page.dtype.itemsize]), (259, "H", [codes[coding]]), (262, "H", [1]), (277, "H", [1]), (339, "H", [kind])]
        tags += [(322, "I", [tile]), (323, "I", [tile]), (324, "I", offsets), (325, "I", counts)] if tile else [(273, "I", offsets), (278, "I", [rows]), (279, "I", counts)]
        tags += [(317, "H", [2])] if predictor else []
        if description:
            tags.append((270, "s", description.encode() + b"\0"))
            description = ""
        tags, first = [*tags, *first], ()
        entries = b""
        for tag, unit, values in sorted(tags):
            raw = values if unit == "s" else struct.pack(f"{order}{len(values)}{unit.replace('R', 'I')}", *values)
            if len(raw) > 4:
                place = struct.pack(order + "I", len(out))
                out += raw
            else:
                place = raw.ljust(4, b"\0")
            entries += struct.pack(order + "HHI", tag, {"s": 2, "H": 3, "I": 4, "R": 5}[unit], len(values) // (2 if unit == "R" else 1)) + place
        out += bytes(len(out) % 2)
        struct.pack_into(order + "I", out, link, len(out))
        link = len(out) + 2 + len(entries)
        out += struct.pack(order + "H", len(tags)) + entries + bytes(4)
    return bytes(out)


def _dimension(name: str, start: int, size: int, stored: int) -> bytes:
    return name.encode().ljust(4, b"\0") + struct.pack("<2ifi", start, size, 0.0, stored)


def _segment(name: bytes, body: bytes) -> bytes:
    return name.ljust(16, b"\0") + struct.pack("<2q", len(body), len(body)) + body


def czi(tiles: list[dict], kind: int, xml: str = "", attached: dict[str, bytes] | None = None) -> bytes:
    """Attached files by name, and sub-blocks {X, Y, width, height, stored, data, codec, Z, C, T, ...} behind a file header."""
    out = bytearray(_segment(b"ZISRAWFILE", bytes(512)))
    directory = b""
    for t in tiles:
        stored = t.get("stored", (t["width"], t["height"]))
        dims = [_dimension("X", t["X"], t["width"], stored[0]), _dimension("Y", t["Y"], t["height"], stored[1])]
        dims += [_dimension(n, t[n], 1, 1) for n in "ZCTSBVM" if n in t]
        entry = b"DV" + struct.pack("<iq", kind, len(out)) + struct.pack("<ii", 0, t.get("codec", 0)) + bytes(6) + struct.pack("<i", len(dims)) + b"".join(dims)
        head = struct.pack("<iiq", 0, 0, len(t["data"])) + entry
        out += _segment(b"ZISRAWSUBBLOCK", head.ljust(max(256, len(head)), b"\0") + t["data"])
        directory += entry
    struct.pack_into("<q", out, 32 + 52, len(out))
    out += _segment(b"ZISRAWDIRECTORY", struct.pack("<i", len(tiles)).ljust(128, b"\0") + directory)
    if attached:
        entries = []
        for name, body in attached.items():
            entries.append(b"A1".ljust(12, b"\0") + struct.pack("<qi", len(out), 0) + bytes(16) + b"CZI".ljust(8, b"\0") + name.encode().ljust(80, b"\0"))
            head = struct.pack("<i", len(body)).ljust(16, b"\0") + entries[-1]
            out += _segment(b"ZISRAWATTACH", head.ljust(256, b"\0") + body)
        struct.pack_into("<q", out, 32 + 72, len(out))
        out += _segment(b"ZISRAWATTDIR", struct.pack("<i", len(entries)).ljust(256, b"\0") + b"".join(entries))
    if xml:
        struct.pack_into("<q", out, 32 + 60, len(out))
        out += _segment(b"ZISRAWMETADATA", struct.pack("<i", len(xml.encode())).ljust(256, b"\0") + xml.encode())
    return bytes(out)


def nd2(planes: np.ndarray, parts: int = 1, packed: bool = False, pad: int = 0, text: str = "") -> bytes:
    """A sequence of interleaved planes (n, height, width * parts)."""
    n, y, x = planes.shape
    wide = planes.dtype.itemsize
    values = {"uiWidth": x // parts, "uiHeight": y, "uiWidthBytes": x * wide + pad, "uiComp": parts, "uiBpcInMemory": 8 * wide, "uiBpcSignificant": 8 * wide}
    chunk = lambda name, body: b"\xda\xce\xbe\x0a" + struct.pack("<IQ", len(name), len(body)) + name.encode() + body
    out = chunk("ImageAttributes!", ("<variant>" + "".join(f'<{k} value="{v}"/>' for k, v in values.items()) + "</variant>").encode())
    if text:
        out += chunk("ImageTextInfo!", text.encode())
    for i, p in enumerate(planes):
        raw = b"".join(row.tobytes() + bytes(pad) for row in p)
        out += chunk(f"ImageDataSeq|{i}!", bytes(8) + (zlib.compress(raw) if packed else raw))
    return out


def build(planes: DataFrame, folder: str, extension: str, make, dtype: str, by_t: bool = False, whole: int = 0) -> DataFrame:
    """Files (path, content) of 8 x 8 planes: one for each t (which make gets, too, if by_t), its planes in order of c and z.

    whole: how many planes a file has, each at its place (vec_id modulo whole); those that are not there are blank.
    """
    import pyarrow as pa

    of = F.array_sort(F.collect_list(F.struct("vec_id", "samples")))
    places = F.transform(of, lambda p: (p["vec_id"] % whole).cast("int")) if whole else F.lit(None).cast("array<int>")
    grouped = planes.groupBy("t").agg(F.transform(of, lambda p: p["samples"]).alias("planes"), places.alias("places"))

    def run(batches):
        for batch in batches:
            paths, contents = [], []
            for row in batch.to_pylist():
                paths.append(f"{folder}/{row['t']}.{extension}")
                made = np.array(row["planes"], np.float64).reshape(len(row["planes"]), 8, 8).astype(dtype)
                if whole:
                    there, made = made, np.zeros((whole, 8, 8), dtype)
                    made[row["places"]] = there
                contents.append(make(made, row["t"]) if by_t else make(made))
            yield pa.RecordBatch.from_pydict({"path": paths, "content": contents})

    return grouped.mapInArrow(run, "path string, content binary")
