"""Codecs: bytes to bytes, never beyond the length expected; numpy where samples are meant."""

from __future__ import annotations

import zlib

import numpy as np

from lumenplane.sources.model import ImageError


def inflate(data: bytes, limit: int, wbits: int) -> bytes:
    try:
        out = zlib.decompressobj(wbits).decompress(data, limit + 1)
    except zlib.error as error:
        raise ImageError("Codec", str(error)) from error
    return _bounded(out, limit)


def _bounded(out: bytes, limit: int) -> bytes:
    if len(out) > limit:
        raise ImageError("Codec", f"more than {limit} bytes decoded")
    return out


def lzw(data: bytes, limit: int) -> bytes:
    """LZW of TIFF: most significant bit first, code width grows one code early."""
    single = [bytes([i]) for i in range(256)]
    table, width, out, size, last = [*single, b"", b""], 9, [], 0, None
    hold = bits = 0
    for byte in data:
        hold, bits = hold << 8 | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code, hold = hold >> bits, hold & ((1 << bits) - 1)
        if code == 257:
            break
        if code == 256:
            table, width, last = [*single, b"", b""], 9, None
            continue
        if last is None:
            entry = table[code] if code < 256 else None
        else:
            entry = table[code] if code < len(table) else last + last[:1] if code == len(table) else None
            if entry is not None and len(table) < 4096:
                table.append(last + entry[:1])
        if entry is None:
            raise ImageError("Codec", f"LZW code {code} is not defined")
        out.append(entry)
        size, last = size + len(entry), entry
        if size > limit:
            raise ImageError("Codec", f"more than {limit} bytes decoded")
        width = 9 if len(table) < 511 else 10 if len(table) < 1023 else 11 if len(table) < 2047 else 12
    return b"".join(out)


def packbits(data: bytes, limit: int) -> bytes:
    out, i = bytearray(), 0
    while i < len(data) and len(out) < limit:
        n = data[i]
        i += 1
        if n < 128:
            if i + n + 1 > len(data):
                raise ImageError("Codec", "PackBits literal is cut off")
            out += data[i : i + n + 1]
            i += n + 1
        elif n > 128:
            if i >= len(data):
                raise ImageError("Codec", "PackBits run is cut off")
            out += data[i : i + 1] * (257 - n)
            i += 1
    return _bounded(bytes(out), limit)


def zstd(data: bytes, limit: int) -> bytes:
    import zstandard

    try:
        with zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True) as stream:
            out = stream.read(limit + 1)
    except zstandard.ZstdError as error:
        raise ImageError("Codec", str(error)) from error
    return _bounded(out, limit)


def zstd_packed(data: bytes, limit: int) -> bytes:
    """Zstandard behind a header of its own: its length, then chunks; chunk 1 tells of parted bytes."""
    size, at = _varint(data, 0)
    if size < at or size > len(data):
        raise ImageError("Codec", "header length")
    parted = False
    while at < size:
        kind, at = _varint(data, at)
        if kind != 1 or at >= size:
            raise ImageError("Codec", f"header chunk {kind}")
        parted, at = bool(data[at] & 1), at + 1
    out = zstd(data[size:], limit)
    if parted:  # all low bytes, then all high bytes
        if len(out) % 2:
            raise ImageError("Codec", "parted bytes of odd length")
        out = np.frombuffer(out, np.uint8).reshape(2, -1).T.tobytes()
    return out


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while at < len(data) and shift < 63:
        value |= (data[at] & 127) << shift
        at += 1
        if data[at - 1] < 128:
            return value, at
        shift += 7
    raise ImageError("Codec", "varint")


def looks_like_zlib(data: bytes) -> bool:
    return len(data) >= 2 and data[0] & 15 == 8 and data[0] >> 4 <= 7 and (data[0] << 8 | data[1]) % 31 == 0 and not data[1] & 32


def decode(codec: str, data: bytes, need: int, extra: bytes = b"") -> bytes:
    """need: the bytes that the block must give; raw data may be longer, coded data may not."""
    if codec == "raw":
        return data
    if codec == "lzw":
        return lzw(data, need)
    if codec == "zlib":
        return inflate(data, need, 15)
    if codec == "deflate":
        return inflate(data, need, -15)
    if codec == "packbits":
        return packbits(data, need)
    if codec == "zstd":
        return zstd(data, need)
    if codec == "zstd1":
        return zstd_packed(data, need)
    if codec == "jpeg":
        from lumenplane.sources import jpeg

        return jpeg.decode(data, need, extra).tobytes()
    if codec == "jpeg-padded":
        raise ImageError("Unsupported", "padded JPEG without the sizes of its block")
    if codec == "gzip":  # of which the first `need` bytes are wanted
        return Inflated(data, 0, len(data)).at(0, need)
    raise ImageError("Unsupported", f"codec {codec}")


def padded_jpeg(data: bytes, width: int, height: int, samples: int) -> bytes:
    """A JPEG of these sizes, or of one column and one row more, which are cut off."""
    from lumenplane.sources import jpeg

    image = jpeg.decode(data, (width + 1) * (height + 1) * samples)
    if image.shape not in ((height, width, samples), (height + 1, width + 1, samples)):
        raise ImageError("InvalidData", f"JPEG of {image.shape[1]}x{image.shape[0]}, {image.shape[2]} samples, in a block of {width}x{height}, {samples}")
    return image[:height, :width].tobytes()


class Inflated:
    """A gzip stream within a file, read forward: places in order cost one pass, an earlier place begins anew."""

    CHUNK = 1 << 20

    def __init__(self, data, offset: int, length: int):
        self.data, self.offset, self.length = data, offset, length
        self.begin()

    def begin(self) -> None:
        self.inflate, self.taken, self.place, self.held = zlib.decompressobj(31), 0, 0, b""

    def _more(self) -> bytes:
        raw = self.inflate.unconsumed_tail
        if not raw and self.taken < self.length and not self.inflate.eof:
            raw = self.data[self.offset + self.taken : self.offset + min(self.length, self.taken + self.CHUNK)]
            self.taken += len(raw)
        try:
            return self.inflate.decompress(raw, self.CHUNK) if raw else b""
        except zlib.error as error:
            raise ImageError("Codec", str(error)) from error

    def at(self, start: int, size: int) -> bytes:
        """size bytes from start on; fewer if the stream ends."""
        if start < self.place:
            self.begin()
        out = []
        while size > 0:
            if start < self.place + len(self.held):
                part = self.held[start - self.place : start - self.place + size]
                out.append(part)
                start, size = start + len(part), size - len(part)
                continue
            self.place += len(self.held)
            self.held = self._more()
            if not self.held and (self.inflate.eof or self.taken >= self.length and not self.inflate.unconsumed_tail):
                break
        return b"".join(out)


def undo_predictor(samples: np.ndarray) -> np.ndarray:
    """Horizontal differences summed up along each row, modulo the sample's range."""
    if samples.dtype.itemsize > 2 or samples.dtype.kind == "f":
        raise ImageError("Unsupported", "predictor of samples wider than 16 bits")
    native = samples.astype(samples.dtype.newbyteorder("="))
    return np.cumsum(native, axis=1, dtype=native.dtype).astype(samples.dtype)


def unpack_bits(rows: np.ndarray, count: int, bits: int, dtype: np.dtype) -> np.ndarray:
    """Packed samples, most significant bit first, rows whole bytes, values unscaled."""
    flat = np.unpackbits(np.ascontiguousarray(rows), axis=1)[:, : count * bits].reshape(rows.shape[0], count, bits)
    weights = (1 << np.arange(bits - 1, -1, -1)).astype(np.uint32)
    return (flat * weights).sum(2).astype(dtype)
