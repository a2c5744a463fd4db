"""Sequential Huffman JPEG of 8 bits, after ITU-T T.81; blocks are transformed together in numpy."""

from __future__ import annotations

import struct

import numpy as np

from lumenplane.sources.model import ImageError

# Fixed value: where each coefficient of the stream stands in its 8 x 8 block.
ZIGZAG = (
    0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32, 25, 18, 11, 4, 5, 12, 19, 26, 33, 40, 48, 41, 34, 27, 20, 13, 6, 7, 14, 21, 28,
    35, 42, 49, 56, 57, 50, 43, 36, 29, 22, 15, 23, 30, 37, 44, 51, 58, 59, 52, 45, 38, 31, 39, 46, 53, 60, 61, 54, 47, 55, 62, 63,
)
_COSINES = np.array([[(np.sqrt(0.125) if u == 0 else 0.5) * np.cos((2 * x + 1) * u * np.pi / 16) for u in range(8)] for x in range(8)])


def _lengths(counts: bytes, symbols: bytes) -> list[tuple[int, int]]:
    """(bits, symbol) by the next sixteen bits of the stream; (0, 0) where no code begins so."""
    table, at, code = [(0, 0)] * 65536, 0, 0
    for bits, count in enumerate(counts, 1):
        for _ in range(count):
            first, many = code << (16 - bits), 1 << (16 - bits)
            if first + many > 65536 or at >= len(symbols):
                raise ImageError("Codec", "JPEG Huffman table")
            table[first : first + many] = [(bits, symbols[at])] * many
            at, code = at + 1, code + 1
        code <<= 1
    return table


class _Part:
    """A colour component: sampling factors, tables and coefficients of its blocks."""

    def __init__(self, number: int, sampling: int, table: int):
        self.number, self.across, self.down, self.quantiser = number, sampling >> 4, sampling & 15, table
        self.last = 0


class _Stream:
    """Markers of a stream, behind those of `tables` if there are any."""

    def __init__(self):
        self.quantisers, self.codes, self.interval, self.parts, self.size = {}, {}, 0, [], None
        self.jfif, self.transform = False, None

    def read(self, data: bytes, limit: int) -> None:
        if data[:2] != b"\xff\xd8":
            raise ImageError("Codec", "no JPEG")
        at = 2
        while at + 4 <= len(data):
            if data[at] != 0xFF:
                raise ImageError("Codec", "JPEG marker expected")
            mark = data[at + 1]
            if mark in (0xFF, 0x01) or 0xD0 <= mark <= 0xD7:
                at += 1 if mark == 0xFF else 2
                continue
            if mark == 0xD9:
                return
            size = struct.unpack_from(">H", data, at + 2)[0]
            body = data[at + 4 : at + 2 + size]
            if size < 2 or len(body) != size - 2:
                raise ImageError("Codec", "JPEG segment is cut off")
            at += 2 + size
            if mark == 0xDB:
                self._quantisers(body)
            elif mark == 0xC4:
                self._codes(body)
            elif mark == 0xDD:
                self.interval = struct.unpack(">H", body[:2])[0]
            elif mark == 0xE0 and body[:5] == b"JFIF\0":
                self.jfif = True
            elif mark == 0xEE and body[:5] == b"Adobe" and len(body) >= 12:
                self.transform = body[11]
            elif mark in (0xC0, 0xC1):
                self._frame(body, limit)
            elif 0xC2 <= mark <= 0xCF:
                raise ImageError("Unsupported", f"JPEG process {mark:#x}")
            elif mark == 0xDA:
                at = self._scan(data, body, at)

    def _quantisers(self, body: bytes) -> None:
        while body:
            wide = body[0] >> 4
            values = struct.unpack_from(">64H" if wide else "64B", body, 1)
            table = np.zeros(64)
            table[list(ZIGZAG)] = values
            self.quantisers[body[0] & 15] = table
            body = body[1 + 64 * (1 + wide) :]

    def _codes(self, body: bytes) -> None:
        while len(body) >= 17:
            many = sum(body[1:17])
            self.codes[body[0]] = _lengths(body[1:17], body[17 : 17 + many])
            body = body[17 + many :]

    def _frame(self, body: bytes, limit: int) -> None:
        bits, height, width, count = struct.unpack(">BHHB", body[:6])
        if bits != 8 or not height or not width or count not in (1, 3, 4) or len(body) < 6 + 3 * count:
            raise ImageError("Unsupported", "JPEG frame")
        if width * height * count > limit:
            raise ImageError("Codec", f"JPEG of more than {limit} bytes")
        self.size = width, height
        self.parts = [_Part(*body[6 + 3 * i : 9 + 3 * i]) for i in range(count)]
        if any(not 1 <= n <= 4 for p in self.parts for n in (p.across, p.down)):
            raise ImageError("Codec", "JPEG sampling factors")
        self.most = max(p.across for p in self.parts), max(p.down for p in self.parts)
        units = -(-width // (8 * self.most[0])), -(-height // (8 * self.most[1]))
        for p in self.parts:
            p.own = -(-(-(-width * p.across // self.most[0])) // 8), -(-(-(-height * p.down // self.most[1])) // 8)
            p.grid = units[0] * p.across, units[1] * p.down
            p.blocks = np.zeros((p.grid[1] * p.grid[0], 64), np.int32)
        self.units = units

    def _scan(self, data: bytes, head: bytes, at: int) -> int:
        """Decode a scan's blocks; returns where its data end."""
        named = [(next((p for p in self.parts if p.number == head[1 + 2 * i]), None), head[2 + 2 * i]) for i in range(head[0])]
        try:
            chosen = [(p, self.codes[t >> 4], self.codes[16 | t & 15]) for p, t in named]
        except KeyError as error:
            raise ImageError("Codec", "JPEG Huffman table is missing") from error
        if not chosen or any(p is None for p, _, _ in chosen):
            raise ImageError("Codec", "JPEG scan without a frame")
        stop = at  # the next marker that is no restart
        while (stop := data.find(b"\xff", stop)) >= 0 and stop + 1 < len(data) and (data[stop + 1] == 0 or 0xD0 <= data[stop + 1] <= 0xD7):
            stop += 2
        stop = len(data) if stop < 0 else stop
        pieces, begin, i = [], at, at
        while (i := data.find(b"\xff", i, stop)) >= 0 and i + 1 < stop:
            if data[i + 1]:
                pieces.append(data[begin:i])
                begin = i + 2
            i += 2
        pieces = [p.replace(b"\xff\x00", b"\xff") for p in [*pieces, data[begin:stop]]]
        if len(chosen) == 1:  # a scan of one component goes by its own blocks
            p = chosen[0][0]
            order = [[(0, y * p.grid[0] + x)] for y in range(p.own[1]) for x in range(p.own[0])]
        else:
            order = [
                [(k, (y * p.down + j) * p.grid[0] + x * p.across + i) for k, (p, _, _) in enumerate(chosen) for j in range(p.down) for i in range(p.across)]
                for y in range(self.units[1]) for x in range(self.units[0])
            ]
        each = self.interval or len(order)
        for n, piece in enumerate(pieces):
            units = order[n * each : (n + 1) * each]
            if units:
                _decode(piece, units, chosen)
        if len(pieces) * each < len(order):
            raise ImageError("Codec", "JPEG scan is cut off")
        return stop

    def image(self) -> np.ndarray:
        if self.size is None:
            raise ImageError("Codec", "JPEG without a frame")
        width, height = self.size
        planes = []
        for p in self.parts:
            if p.quantiser not in self.quantisers:
                raise ImageError("Codec", "JPEG quantiser is missing")
            values = (p.blocks * self.quantisers[p.quantiser]).reshape(-1, 8, 8)
            pixels = np.clip(np.floor(_COSINES @ values @ _COSINES.T + 128.5), 0, 255).astype(np.int32)
            plane = pixels.reshape(p.grid[1], p.grid[0], 8, 8).swapaxes(1, 2).reshape(p.grid[1] * 8, p.grid[0] * 8)
            plane = plane[: -(-height * p.down // self.most[1]), : -(-width * p.across // self.most[0])]
            planes.append(_widened(plane, self.most[0] // p.across, self.most[1] // p.down)[:height, :width])
        out = np.stack(planes, 2)
        plain = self.transform == 0 or self.transform is None and not self.jfif and [p.number for p in self.parts] == [82, 71, 66]
        if len(planes) == 3 and not plain:
            y, b, r = out[..., 0], out[..., 1] - 128.0, out[..., 2] - 128.0
            out = np.clip(np.floor(np.stack((y + 1.402 * r, y - 0.344136286 * b - 0.714136286 * r, y + 1.772 * b), 2) + 0.5), 0, 255)
        return out.astype(np.uint8)


def _decode(data: bytes, units: list, chosen: list) -> None:
    """Coefficients of the units' blocks from one stretch of bits; differences begin anew."""
    hold = count = at = 0
    size = len(data)
    last = [0] * len(chosen)
    for unit in units:
        for k, block in unit:
            part, dc, ac = chosen[k]
            out = part.blocks[block]
            i, table = 0, dc
            while i < 64:
                while count < 32:
                    hold, at, count = (hold << 8 | (data[at] if at < size else 0)) & 0xFFFFFFFFFFFF, at + 1, count + 8
                bits, symbol = table[hold >> (count - 16) & 0xFFFF]
                if not bits or at > size + 8:
                    raise ImageError("Codec", "JPEG code")
                count -= bits
                if table is ac:
                    run, symbol = symbol >> 4, symbol & 15
                    if not symbol:
                        if run < 15:
                            break
                        i += 16
                        continue
                    i += run
                    if i > 63:
                        raise ImageError("Codec", "JPEG run")
                value = 0
                if symbol:
                    count -= symbol
                    value = hold >> count & ((1 << symbol) - 1)
                    if value < 1 << (symbol - 1):
                        value -= (1 << symbol) - 1
                if i == 0 and table is dc:
                    last[k] += value
                    out[0], table = last[k], ac
                else:
                    out[ZIGZAG[i]] = value
                i += 1


def _widened(plane: np.ndarray, across: int, down: int) -> np.ndarray:
    """A sub-sampled component at full size: by twos with weights 3 and 1 of the nearest two, else repeated."""
    for axis, times in ((1, across), (0, down)):
        if times == 2 and plane.shape[axis] > 1:
            before, after = np.roll(plane, 1, axis), np.roll(plane, -1, axis)
            ends = [slice(None)] * 2
            ends[axis] = 0
            before[tuple(ends)] = plane[tuple(ends)]
            ends[axis] = -1
            after[tuple(ends)] = plane[tuple(ends)]
            plane = np.stack((3 * plane + before + 2 >> 2, 3 * plane + after + 2 >> 2), axis + 1).reshape([n * (2 if k == axis else 1) for k, n in enumerate(plane.shape)])
        elif times > 1:
            plane = np.repeat(plane, times, axis)
    return plane


def decode(data: bytes, limit: int, tables: bytes = b"") -> np.ndarray:
    """Pixels (height, width, components) of a stream whose tables may stand in another."""
    stream = _Stream()
    try:
        if tables:
            stream.read(tables, limit)
        stream.read(data, limit)
    except (IndexError, struct.error, ValueError) as error:
        if isinstance(error, ImageError):
            raise
        raise ImageError("Codec", f"JPEG: {error}") from error
    return stream.image()
