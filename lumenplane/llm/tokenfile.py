"""Token ids as seekable binary files.

Documents are dealt by ranges of doc_id and sorted; each range becomes one file of independent zstandard
frames. A frame holds whole documents (about FRAME_TOKENS ids): their number, doc_ids, numbers of ids
and ids, little-endian. The last frame is a skippable one with a table of each frame's place, sizes,
XXH64 checksum and first doc_id, and a footer; a reader takes the footer, the table and only the frames
that it wants, and a checksum that differs raises an error. Between frames stands an empty skippable
frame, so any zstandard reader takes a file for one stream.

Files are written by Spark's own text writer (a frame is a row, the empty frame its line end), so they
go to any file system that Spark knows, are committed as a whole, and a lost executor leaves none behind.

Defined results: null text counts as empty and gives the end id alone. A null doc_id comes first and is
told from every integer. Rows alike in doc_id are ordered by their first KEY_CHARS characters, then by a
hash of the text, so that one id shared by many rows is dealt to many files; equal rows all stay. Extra
columns are ignored. Strings of added tokens in a text are these tokens, as in a plain call of the library.
"""

from __future__ import annotations

import itertools
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenplane.llm.common import partitions_for, settings, work_dir, written

FRAME_TOKENS = 1 << 16
#: Bytes of input (as the catalogue estimates them) to a file, about.
FILE_BYTES = 32 << 20
#: Runs whose ids a worker keeps; beyond them it starts anew. Texts are encoded in groups of about so many bytes.
CACHE, GROUP_BYTES = 500_000, 4 << 20
#: Rows of an Arrow batch: whole texts are large.
BATCH_ROWS = "2000"
KEY_CHARS = 64
SKIPPABLE, FOOTER = 0x184D2A5E, b"LPTKFIL2"
#: An empty skippable frame, all ASCII.
BETWEEN = struct.pack("<II", 0x184D2A50, 0)
_ENTRY = struct.Struct("<QIIQq")  # offset, packed size, ids, checksum, first doc_id
#: White space in front of a combining mark (its first byte is one of two): the library may see it otherwise.
_BEFORE_MARK, _MARK_LEAD = re.compile("\\s(?=[\u0300-\u036f])"), 0xCC
_PLAIN = re.compile("[a-zà-öø-ÿ]+|[0-9]|[!-&(-/:-@\\[-`{-~]+").fullmatch
_BLANK, _LETTER, _DIGIT, _MARKS, _ODD = range(5)
_KIND = np.full(256, _ODD, np.uint8)
_KIND[[9, 10, 13, 32]] = _BLANK
_KIND[[*range(65, 91), *range(97, 123), 0xC3]] = _LETTER
_KIND[48:58] = _DIGIT
_KIND[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'"]] = _MARKS
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Encoder:
    """Ids of texts by the tokenizers library, which sees every distinct run once.

    The tokenizer lowers letters, drops white space and parts plain letters, marks and digits from each
    other; it never joins what it parts, so a text's ids are those of its runs in turn. numpy cuts runs
    out of the bytes of many texts, Arrow numbers the distinct ones, numpy gathers their ids. Whatever
    holds anything else is a run up to the next white space; the few texts where the library might see
    white space otherwise are given to it whole.
    """

    def __init__(self, definition: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.last = np.zeros(max(vocabulary.values()) + 3, bool)
        self.last[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.runs = _Ids()

    def whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, runs: list[str]) -> None:
        plain, other = [], []
        for run in runs:
            (plain if _PLAIN(run) else other).append(run)
        for i in range(0, len(plain), 10_000):  # each run is one word to the tokenizer, whose last id is of a kind of its own
            ids = np.array(self.whole([" ".join(plain[i : i + 10_000])])[0], np.uint32)
            stop = np.flatnonzero(self.last[ids]) + 1
            if len(stop) != len(plain[i : i + 10_000]):
                raise ValueError("the tokenizer does not part words as expected")
            self.runs.add(plain[i : i + 10_000], np.diff(stop, prepend=0), ids)
        for i in range(0, len(other), 10_000):
            ids = self.whole(other[i : i + 10_000])
            self.runs.add(other[i : i + 10_000], np.fromiter(map(len, ids), np.int64, len(ids)), np.fromiter(itertools.chain.from_iterable(ids), np.uint32))

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text (a string array without nulls)."""
        bounds = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
        bounds -= bounds[0]
        if (raw >> 1 == _MARK_LEAD >> 1).any():
            odd = np.array([_BEFORE_MARK.search(t) is not None for t in texts.to_pylist()], bool)
            if odd.any():
                rest = texts.filter(pa.array(~odd))
                plain, whole = iter(self.encode(pa.concat_arrays([rest])) if len(rest) else ()), iter(self.whole(texts.filter(pa.array(odd)).to_pylist()))
                return [np.array(next(whole), np.uint32) if o else next(plain) for o in odd]
        starts, runs = _runs(raw, bounds)
        numbered = runs.dictionary_encode()
        distinct = numbered.dictionary.to_pylist()
        if len(self.runs.place) > CACHE:
            self.runs = _Ids()
        known = self.runs.place
        self.learn([r for r in distinct if r not in known])
        place = np.fromiter(map(known.__getitem__, distinct), np.int64, len(distinct))
        ids, stop = self.runs.gather(place[numbered.indices.to_numpy()])
        ends = np.concatenate(([0], stop))[np.searchsorted(starts, bounds)].tolist()
        return [ids[a:b] for a, b in zip(ends, ends[1:])]


def _runs(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Where the runs of texts begin in their bytes, and the runs, in lower case as far as they are plain."""
    kind, low = _KIND[raw], _LOWER[raw]
    latin = np.flatnonzero(raw[:-1] == 0xC3) + 1  # letters from À to ÿ, but for two signs
    second = raw[latin]
    kind[latin] = np.where((second == 0x97) | (second == 0xB7), _ODD, _LETTER)
    low[latin] = np.where((second >= 0x80) & (second <= 0x9E), second | 0x20, second)
    angle = np.flatnonzero(raw[:-1] == ord("<"))
    kind[angle[raw[angle + 1] == ord("|")]] = _ODD  # may begin an added token
    inside = kind != _BLANK
    change = np.ones(len(raw), bool)
    change[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    own = bounds[:-1][bounds[:-1] < len(raw)]  # a text's first byte begins a run
    change[own] = True
    first[own] = inside[own]
    odd = np.flatnonzero(kind == _ODD)
    if len(odd):  # no cut within what holds anything odd, and its letters as they are
        piece = np.cumsum(first, dtype=np.int32)
        strange = np.zeros(int(piece[-1]) + 1, bool)
        strange[piece[odd]] = True
        held = strange[piece] & inside
        change &= ~held | first
        low[held] = raw[held]
    starts = np.flatnonzero(change & inside)
    place = np.cumsum(inside, dtype=np.int32)
    offsets = np.append(place[starts] - 1, place[-1] if len(place) else 0).astype(np.int32)
    return starts, pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(low[inside]))


_ENCODERS: dict[int, Encoder] = {}


def encoder(definition: str) -> Encoder:
    """The worker's encoder, kept from task to task."""
    mark = zlib.crc32(definition.encode())
    if mark not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[mark] = Encoder(definition)
    return _ENCODERS[mark]


class _Ids:
    """Strings, each with its ids, one behind the other in arrays that double as they fill."""

    def __init__(self):
        self.place: dict[str, int] = {}
        self.flat, self.ends, self.used = np.zeros(1 << 16, np.uint32), np.zeros(1 << 14, np.int64), 0

    def add(self, strings: list[str], sizes: np.ndarray, ids: np.ndarray) -> None:
        known = len(self.place)
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate((self.flat, np.zeros_like(self.flat)))
        while known + len(strings) >= len(self.ends):
            self.ends = np.concatenate((self.ends, np.zeros_like(self.ends)))
        self.flat[self.used : self.used + len(ids)] = ids
        self.ends[known + 1 : known + 1 + len(strings)] = self.used + np.cumsum(sizes)
        self.used += len(ids)
        self.place.update(zip(strings, range(known, known + len(strings))))

    def gather(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of strings in a row, and where each one's end."""
        begin = self.ends[places]
        size = self.ends[places + 1] - begin
        stop = np.cumsum(size)
        at = np.repeat(begin - (stop - size), size)
        at += np.arange(len(at))
        return self.flat[at], stop


_ENCODERS: dict[int, Encoder] = {}


def encoder(definition: str) -> Encoder:
    """The worker's encoder, kept from task to task."""
    mark = zlib.crc32(definition.encode())
    if mark not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[mark] = Encoder(definition)
    return _ENCODERS[mark]


class Writer:
    """The frames of one token file; documents come in order."""

    def __init__(self):
        self.offset, self.table, self.pack = 0, [], zstandard.ZstdCompressor(level=3).compress
        self.docs, self.count = [], 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> bytes | None:
        """The frame that this document fills, if it does."""
        self.docs.append((doc_id, ids))
        self.count += len(ids)
        return self.frame() if self.count >= FRAME_TOKENS else None

    def frame(self) -> bytes:
        ids = [d for d, _ in self.docs]
        none = np.array([d is None for d in ids], np.uint8)
        body = struct.pack("<I", len(ids)) + none.tobytes() + np.array([d or 0 for d in ids], "<i8").tobytes() + np.array([len(x) for _, x in self.docs], "<u4").tobytes()
        body += np.concatenate([x for _, x in self.docs]).astype("<u4", copy=False).tobytes()
        packed = self.pack(body)
        self.table.append((self.offset, len(packed), self.count, xxhash.xxh64_intdigest(body), -(1 << 63) if none[0] else ids[0]))
        self.offset, self.docs, self.count = self.offset + len(packed) + len(BETWEEN), [], 0
        return packed

    def end(self) -> list[bytes]:
        """What is left: the last frame, if any, and the table."""
        left = [self.frame()] if self.docs else []
        body = b"".join(_ENTRY.pack(*e) for e in self.table) + struct.pack("<I", len(self.table)) + FOOTER
        return [*left, struct.pack("<II", SKIPPABLE, len(body)) + body]


class Reader:
    """Random access to a token file by any stream that seeks: the table first, then only the frames asked for."""

    def __init__(self, stream):
        self.stream = stream
        behind = stream.seek(0, 2) - len(BETWEEN)  # the writer ends every row, the table too
        stream.seek(max(0, behind - 12))
        tail = stream.read(12)
        if behind < 12 or tail[4:] != FOOTER:
            raise ValueError("not a token file")
        n = struct.unpack("<I", tail[:4])[0]
        stream.seek(behind - 12 - n * _ENTRY.size)
        raw = stream.read(n * _ENTRY.size)
        self.table = [_ENTRY.unpack_from(raw, i * _ENTRY.size) for i in range(n)]

    def frame(self, k: int) -> list[tuple[int | None, np.ndarray]]:
        offset, size, _, check, _ = self.table[k]
        self.stream.seek(offset)
        body = zstandard.ZstdDecompressor().decompress(self.stream.read(size))
        if xxhash.xxh64_intdigest(body) != check:
            raise ValueError(f"frame {k} is damaged")
        n = struct.unpack_from("<I", body)[0]
        none = np.frombuffer(body, np.uint8, n, 4)
        doc_ids = np.frombuffer(body, "<i8", n, 4 + n)
        ends = np.cumsum(np.frombuffer(body, "<u4", n, 4 + 9 * n), dtype=np.int64)
        ids = np.frombuffer(body, "<u4", offset=4 + 13 * n)
        return [(None if z else int(d), ids[e - s : e]) for z, d, e, s in zip(none, doc_ids, ends, np.diff(ends, prepend=0))]

    def document(self, doc_id: int) -> list[np.ndarray]:
        """The ids of every document of that id, from the frames that can hold it."""
        found = []
        for k, entry in enumerate(self.table):
            last = k + 1 < len(self.table) and self.table[k + 1][4] < doc_id
            if k == 0 or entry[4] <= doc_id and not last:
                found += [ids for d, ids in self.frame(k) if d == doc_id]
        return found


def write(docs: DataFrame, tokenizer: str, folder: str, end_id: int, text: str = "text", key: str = "doc_id") -> None:
    """Write the files under folder; their names are in ascending order of doc_id."""
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("long").alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    order = [F.col("k").asc_nulls_first(), F.substring("t", 1, KEY_CHARS), F.xxhash64("t")]
    ordered = rows.repartitionByRange(partitions_for(docs, FILE_BYTES), *order, F.monotonically_increasing_id()).sortWithinPartitions(*order, "t")
    end = np.array([end_id], np.uint32)
    with open(tokenizer, encoding="utf-8") as file:  # on the driver: executors need not have the file
        definition = spark.sparkContext.broadcast(file.read())

    def put(batches):
        coder, writer = encoder(definition.value), None
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1)
            sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)
            i = 0
            while i < len(keys):
                j = max(i + 1, int(np.searchsorted(sizes, (sizes[i - 1] if i else 0) + GROUP_BYTES, "right")))
                for k, ids in zip(keys[i:j], coder.encode(texts.slice(i, j - i))):
                    writer = writer or Writer()
                    full = writer.add(k, np.concatenate((ids, end)))
                    if full:
                        yield pa.RecordBatch.from_pydict({"frame": [full]})
                i = j
        for left in writer.end() if writer else ():
            yield pa.RecordBatch.from_pydict({"frame": [left]})

    with settings(spark, spark__sql__execution__arrow__maxRecordsPerBatch=BATCH_ROWS):
        ordered.mapInArrow(put, "frame binary").select(F.col("frame").cast("string").alias("value")).write.option("lineSep", BETWEEN.decode()).text(folder)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens and ids_crc32, from the files under folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).where("length > 0")
    files = files.select(F.regexp_extract("path", "part-(\\d+)", 1).cast("int").alias("file"), "content")

    def get(batches):
        import io

        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                reader, start = Reader(io.BytesIO(content)), 0
                for k in range(len(reader.table)):
                    docs = reader.frame(k)
                    sizes = np.array([len(ids) for _, ids in docs], np.int64)
                    starts = start + np.cumsum(sizes) - sizes
                    start += int(sizes.sum())
                    yield pa.RecordBatch.from_pydict({
                        "file": pa.array([file] * len(docs), pa.int32()), "doc_id": pa.array([d for d, _ in docs], pa.int64()), "start": pa.array(starts), "n_tokens": pa.array(sizes),
                        "ids_crc32": pa.array([zlib.crc32(ids.tobytes()) for _, ids in docs], pa.int64()),
                    })

    found = written(files.mapInArrow(get, "file int, doc_id long, start long, n_tokens long, ids_crc32 long"), f"{work_dir(spark)}/found")
    # one row a file, no more than there are partitions: where each file's ids begin
    totals = sorted(map(tuple, found.groupBy("file").agg(F.sum("n_tokens")).collect()))
    bases = spark.createDataFrame(list(zip([f for f, _ in totals], itertools.accumulate([0, *(n for _, n in totals)]))), "file int, base long")
    return found.join(F.broadcast(bases), "file").select("doc_id", (F.col("start") + F.col("base")).alias("start"), "n_tokens", "ids_crc32")
