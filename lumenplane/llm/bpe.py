"""Byte-level BPE encoding and decoding.

Encoding folds ranked merges with Spark higher-order functions. A word starts as the array of its
bytes; `aggregate` then merges the leftmost adjacent pair of least rank again and again. Tokens and
ranks are cells of three bytes (one character each), so that an array of them is one binary that native
functions cut, search and join. Ranks are a literal: bytes laid out as a two-way (cuckoo) hash map from
a pair of cells to the merged cell, so one lookup reads one or two slots, however large the vocabulary.

Only distinct words are folded. A text never shuffles: one Arrow pass splits texts and lists the words
that are new in its block, the JVM folds those, and a second Arrow pass over the same partition looks
every word up. A block ends after BLOCK_WORDS distinct words, which bounds memory; nothing is
collected, and only the tables of the vocabulary are broadcast.

Defined results: null text counts as empty and has no ids; a text's ids equal what the tiktoken library
gives without special tokens; repeated rows stay. Extra columns pass through; one that bears the name of
the result, in any case, gets `_given` added to its name.
"""

from __future__ import annotations

import base64
import functools
import heapq
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenplane.llm.common import beside, give_back, tidily

#: Documents of a task, about: the longer its partition, the fewer words are folded in several.
TASK_DOCS = 20_000
#: A block's dictionary starts anew beyond so many words.
BLOCK_WORDS = 600_000
#: Folding costs the square of a word's bytes (4,096: half a second); longer words are merged with a heap, to the same ids.
LONG_WORD = 4096
#: Texts that are split together and handed on together hold about so many bytes: larger groups take less time and more memory.
GROUP_BYTES = 6 << 20

_BITS = 17
_MASK = (1 << _BITS) - 1
#: Cells are characters from here on, three bytes each and below the surrogates.
_FIRST, _CELL = 0x800, 3
_SLOT = 3 * _CELL + 1
_EDGE, _NONE = "￾", "￿"
#: Fixed value: the pattern whose matches are cut out of bytes; by any other, texts are split whole.
RUNS_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space beyond ASCII.
_WIDE_BLANK = r"[\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_BLANK, _LETTER, _DIGIT, _MARK, _ODD = range(5)
_KIND = np.full(256, _ODD, np.uint8)
_KIND[[9, 10, 11, 12, 13, 32]] = _BLANK
_KIND[[*range(65, 91), *range(97, 123), 0xC3]] = _LETTER
_KIND[48:58] = _DIGIT
_KIND[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'"]] = _MARK


def load_ranks(spark: SparkSession, path: str) -> dict[bytes, int]:
    """Ranks of a tiktoken file, by a path that the driver can read."""
    lines = open(path, "rb").read().splitlines()
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line)}


def pair_ranks(ranks: dict[bytes, int]) -> dict[tuple[int, int], int]:
    """The merged id of every pair of tokens whose concatenation is a token."""
    pairs = {}
    for token, rank in ranks.items():
        for i in range(1, len(token)):
            a, b = ranks.get(token[:i]), ranks.get(token[i:])
            if a is not None and b is not None:
                pairs[a, b] = rank
    return pairs


def cell_ids(ranks: dict[bytes, int]) -> list[int]:
    """The id of each cell: single bytes in their order, then longer tokens by rank."""
    if len(ranks) > 0xD800 - _FIRST:
        raise ValueError("a vocabulary of more tokens than there are cells")
    return [ranks[bytes([i])] for i in range(256)] + sorted(r for t, r in ranks.items() if len(t) > 1)


def cells(ids: list[int]) -> bytes:
    """Cell numbers as cells."""
    return "".join(chr(_FIRST + i) for i in ids).encode("utf-8")


def cuckoo(ranks: dict[bytes, int]) -> bytes:
    """Two tables, one after the other. A slot holds both cells of a pair, the merged cell, and whether a
    pair whose first place this is stands in the second table."""
    cell = {rank: i for i, rank in enumerate(cell_ids(ranks))}
    table: list[bytes | None] = [None] * (2 * (_MASK + 1))
    places = {}
    for (a, b), rank in pair_ranks(ranks).items():
        entry, side = cells([cell[a], cell[b], cell[rank]]), 0
        for _ in range(1000):
            crc = zlib.crc32(entry[: 2 * _CELL])
            place = places[entry] = crc & _MASK, (_MASK + 1) + (crc >> 32 - _BITS)
            entry, table[place[side]] = table[place[side]], entry
            if entry is None:
                break
            side ^= 1
        else:
            raise ValueError("the rank map does not fit its table")
    more = {first for entry, (first, second) in places.items() if table[second] == entry}
    return b"".join((e or b"\xff" * (_SLOT - 1)) + (b"+" if i in more else b"-") for i, e in enumerate(table))


@functools.lru_cache(maxsize=1)
def _vocabulary(path: str) -> tuple[dict[bytes, int], bytes, np.ndarray]:
    """Ranks, the rank map and the ids of cells of a file, kept by the driver: building them takes memory many times theirs."""
    ranks = load_ranks(None, path)
    made = ranks, cuckoo(ranks), np.array(cell_ids(ranks), np.int32)
    give_back()
    return made


def _let(value: Column, body) -> Column:
    """body(value) with value evaluated once, and not copied."""
    return F.aggregate(F.array().cast("array<int>"), value, lambda kept, _: kept, body)


def _if(condition: Column, yes: Column, no: Column) -> Column:
    return F.call_function("if", condition, yes, no)


def fold_word(word: Column, slots: Column) -> Column:
    """The cells of a word (binary), by folding ranked merges over its bytes.

    The state is the word's cells p behind an edge that pairs with nothing, the ranks r of each cell with
    the next one, and the least rank b, which a cell that is no token ends. The leftmost b in r tells where
    to merge; only the ranks beside it are looked up anew.
    """
    cut, rest, none = F.substring, F.lit(1 << 30), F.lit(_NONE)

    def rank(pair: Column) -> Column:
        def probe(key: Column, place: Column, otherwise) -> Column:
            hit = lambda slot: _if(cut(slot, F.lit(1), F.lit(2 * _CELL)) == key, cut(slot, F.lit(2 * _CELL + 1), F.lit(_CELL)).cast("string"), otherwise(slot))
            return _let(cut(slots, (place * _SLOT + 1).cast("int"), F.lit(_SLOT)), hit)

        def look(key: Column) -> Column:
            second = probe(key, F.shiftright(F.crc32(key), 32 - _BITS) + (_MASK + 1), lambda _: none)
            return probe(key, F.crc32(key).bitwiseAND(_MASK), lambda slot: _if(cut(slot, F.lit(_SLOT), F.lit(1)) == F.lit(bytearray(b"+")), second, none))

        return _let(pair, look)

    def state(p: Column, ranks: Column) -> Column:
        return _let(ranks, lambda r: F.struct(p.alias("p"), r.cast("binary").alias("r"), F.array_min(F.split(r, "")).alias("b")))

    def step(now: Column, _) -> Column:
        def merge(end: Column) -> Column:  # the last byte of the pair's first cell
            def beside(q: Column) -> Column:
                left = _if(end > 2 * _CELL, rank(cut(q, end - 5, F.lit(2 * _CELL))), none)
                right = _if(F.octet_length(q) > end, rank(cut(q, end - 2, F.lit(2 * _CELL))), none)
                return F.concat(cut(now["r"], F.lit(1), end - 2 * _CELL).cast("string"), left, right, cut(now["r"], end + 4, rest).cast("string"))

            return _let(F.concat(cut(now["p"], F.lit(1), end - _CELL), now["b"].cast("binary"), cut(now["p"], end + 4, rest)), lambda q: state(q, beside(q)))

        return _if(now["b"] == none, now, _let(F.instr(now["r"].cast("string"), now["b"]) * _CELL, merge))

    size = F.octet_length(word)
    every = "".join(map(chr, range(256)))
    start = F.concat(F.lit(_EDGE), F.translate(F.decode(word, "ISO-8859-1"), every, "".join(chr(_FIRST + i) for i in range(256)))).cast("binary")
    inner = lambda p: F.array_join(F.transform(F.sequence(F.lit(2), size), lambda i: rank(cut(p, _CELL * i - 2, F.lit(2 * _CELL)))), "")
    begin = _let(start, lambda p: state(p, F.concat(none, _if(size > 1, inner(p), F.lit("")), none)))
    return cut(F.aggregate(F.sequence(F.lit(1), F.greatest(size - 1, F.lit(1))), begin, step)["p"], F.lit(_CELL + 1), rest)


def merge_long(word: bytes, ranks: dict[bytes, int], pairs: dict[tuple[int, int], int]) -> list[int]:
    """The same merges for one long word, with a heap of pairs."""
    ids = [ranks[word[i : i + 1]] for i in range(len(word))]
    after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
    heap = [(pairs[p], i, *p) for i, p in enumerate(zip(ids, ids[1:])) if p in pairs]
    heapq.heapify(heap)
    while heap:
        rank, i, a, b = heapq.heappop(heap)
        j = after[i]
        if ids[i] != a or j >= len(ids) or ids[j] != b:
            continue
        ids[i], ids[j], after[i] = rank, -1, after[j]
        if after[j] < len(ids):
            before[after[j]] = i
        for left in ([before[i]] if before[i] >= 0 else []) + [i]:
            right = after[left]
            if right < len(ids) and (p := (ids[left], ids[right])) in pairs:
                heapq.heappush(heap, (pairs[p], left, *p))
    return [x for x in ids if x >= 0]


def _pieces(raw: np.ndarray, bounds: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where texts may be cut by RUNS_PATTERN in their bytes, and whether each piece needs the pattern itself.

    A piece is a run of plain letters, digits or marks with the blank in front of it, or white space; what
    holds anything else goes up to the next white space. Texts that are `whole` are not cut.
    """
    kind = _KIND[raw]
    latin = np.flatnonzero(raw[:-1] == 0xC3) + 1  # letters from À to ÿ, but for two signs
    kind[latin] = np.where((raw[latin] == 0x97) | (raw[latin] == 0xB7), _ODD, _LETTER)
    inside = kind != _BLANK
    own = bounds[:-1][bounds[:-1] < len(raw)]
    begins = np.zeros(len(raw), bool)
    begins[own] = True
    after = np.zeros(len(raw), bool)  # in a text's white space or run, behind its first byte
    after[1:] = inside[1:] == inside[:-1]
    after &= ~begins
    first = inside & ~after
    odd = kind == _ODD
    for i in np.flatnonzero(whole):
        odd[bounds[i] : bounds[i + 1]] = True
    strange = np.flatnonzero(odd & inside)
    piece = np.cumsum(first, dtype=np.int32)
    has_odd = np.zeros(int(piece[-1]) + 1 if len(raw) else 1, bool)
    has_odd[piece[strange]] = True
    cut = begins | (~inside & ~after)
    change = np.zeros(len(raw), bool)
    change[1:] = after[1:] & inside[1:] & (kind[1:] != kind[:-1])
    at = np.flatnonzero(change)
    cut[at[~has_odd[piece[at]]]] = True
    head = np.flatnonzero(first & ~begins)  # behind white space: its last character stands alone or, a blank, with the run
    cut[head - 1] = True
    cut[head[raw[head - 1] != 32]] = True
    for i in np.flatnonzero(whole):
        cut[bounds[i] + 1 : bounds[i + 1]] = False
    starts = np.flatnonzero(cut)
    ends = np.append(starts[1:], len(raw))
    needs = np.zeros(len(starts), bool)
    marked = np.flatnonzero(odd)
    needs[np.searchsorted(starts, marked, "right") - 1] = True
    return starts, needs & (ends > starts)


class _Splitter:
    """Texts to word numbers; words get numbers as they first occur in a block.

    numpy cuts pieces out of the bytes of many texts and Arrow numbers the distinct ones; most are words,
    the others are split by the pattern.
    """

    class _Words(dict):
        def __missing__(self, word: str) -> int:
            self[word] = n = len(self)
            self.new.append(word)
            return n

    def __init__(self, pattern: str):
        import regex

        self.words_of, self.cuts = regex.compile(pattern).findall, pattern == RUNS_PATTERN
        self.begin()

    def begin(self) -> None:
        self.words = self._Words()
        self.words.new = []

    def take(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """The word numbers of texts (a string array without nulls), where each text's begin (and the last's end), and the words that are new."""
        self.words.new = []
        bounds = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
        bounds -= bounds[0]
        whole = pc.match_substring_regex(texts, _WIDE_BLANK).to_numpy(zero_copy_only=False) if self.cuts else np.ones(len(texts), bool)
        starts, needs = _pieces(raw, bounds, whole)
        pieces = pa.StringArray.from_buffers(len(starts), pa.py_buffer(np.append(starts, len(raw)).astype(np.int32)), pa.py_buffer(raw))
        numbered = pieces.dictionary_encode()
        distinct, code = numbered.dictionary.to_pylist(), numbered.indices.to_numpy()
        split = np.zeros(len(distinct), bool)
        split[code[needs]] = True
        number, more = self.words.__getitem__, []
        size, first = np.ones(len(distinct), np.int64), np.zeros(len(distinct), np.int64)
        flat = np.zeros(len(distinct), np.int32)
        plain = np.flatnonzero(~split)
        flat[plain] = np.fromiter((number(distinct[i]) for i in plain.tolist()), np.int32, len(plain))
        first[plain] = plain
        for i in np.flatnonzero(split).tolist():
            own = [*map(number, self.words_of(distinct[i]))]
            size[i], first[i] = len(own), len(distinct) + len(more)
            more += own
        flat = np.concatenate((flat, np.array(more, np.int32)))
        each = size[code]
        stop = np.concatenate(([0], np.cumsum(each)))
        at = np.repeat(first[code] - stop[:-1], each)
        at += np.arange(len(at))
        return flat[at], stop[np.searchsorted(starts, bounds)], self.words.new


class _Dictionary:
    """The ids of a block's words, one behind the other, in arrays that double as they fill."""

    def __init__(self, ids_of: np.ndarray):
        self.ids_of = ids_of
        self.begin()

    def begin(self) -> None:
        self.flat, self.ends, self.used, self.words = np.zeros(1 << 16, np.int32), np.zeros(1 << 14, np.int64), 0, 0

    def add(self, sizes: np.ndarray, raw: np.ndarray) -> None:
        """Words as cells: bytes of each, and all of them."""
        cell = raw.reshape(-1, _CELL).astype(np.int32)
        ids = self.ids_of[((cell[:, 0] & 15) << 12 | (cell[:, 1] & 63) << 6 | cell[:, 2] & 63) - _FIRST]
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate((self.flat, np.zeros_like(self.flat)))
        while self.words + len(sizes) >= len(self.ends):
            self.ends = np.concatenate((self.ends, np.zeros_like(self.ends)))
        self.flat[self.used : self.used + len(ids)] = ids
        self.ends[self.words + 1 : self.words + 1 + len(sizes)] = self.used + np.cumsum(sizes // _CELL)
        self.used, self.words = self.used + len(ids), self.words + len(sizes)

    def look_up(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words in a row, and where each word's ids end."""
        begin = self.ends[numbers]
        size = self.ends[numbers + 1] - begin
        stop = np.cumsum(size)
        at = np.repeat(begin - (stop - size), size)
        at += np.arange(len(at))
        return self.flat[at], stop


def encode(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", out: str = "ids", keep: list[str] | None = None, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """docs (its columns `keep`, if given) with a column of token ids (array<int>)."""
    spark = docs.sparkSession
    ranks, slots, ids_of = _vocabulary(ranks_path)
    vocabulary = spark.sparkContext.broadcast((ranks, ids_of))
    carried = beside(docs.select(*[F.col(f"`{c}`") for c in (docs.columns if keep is None else keep)]), out)
    # private names, the text last: any column may be carried, and the text need not be
    n = len(carried.columns)
    rows = docs.select(*[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(docs.columns if keep is None else keep)], F.col(f"`{text}`").alias("_text"))
    fields = [T.StructField(f"_{i}", f.dataType) for i, f in enumerate(carried.schema.fields)]
    names = [f.name for f in fields]
    word = T.StructType([T.StructField("word", T.BinaryType()), T.StructField("cells", T.BinaryType())])
    split_schema = T.StructType([*fields, T.StructField("_numbers", T.BinaryType()), T.StructField("_new", T.ArrayType(word)), T.StructField("_begins", T.BooleanType())])

    def split(batches):
        splitter, begins, pairs, cell_of = _Splitter(pattern), True, None, None
        for batch in batches:
            texts = batch.column(n)
            sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
            i = 0
            while i < len(texts):
                j = max(i + 1, int(np.searchsorted(sizes, (sizes[i - 1] if i else 0) + group_bytes, "right")))
                if len(splitter.words) > BLOCK_WORDS:
                    splitter.begin()
                    begins = True
                numbers, ends, words = splitter.take(pc.fill_null(texts.slice(i, j - i), ""))
                raw = [w.encode("utf-8") for w in words]
                merged = [None] * len(raw)
                for k in [k for k, w in enumerate(raw) if len(w) > LONG_WORD]:
                    if pairs is None:
                        pairs, cell_of = pair_ranks(vocabulary.value[0]), {int(r): c for c, r in enumerate(vocabulary.value[1])}
                    merged[k], raw[k] = cells([cell_of[r] for r in merge_long(raw[k], vocabulary.value[0], pairs)]), None
                new = pa.StructArray.from_arrays([pa.array(raw, pa.binary()), pa.array(merged, pa.binary())], names=["word", "cells"])
                held = pa.array([0] + [len(raw)] * (j - i), pa.int32())  # the first text of a group bears its new words
                told = pa.BinaryArray.from_buffers(pa.binary(), j - i, [None, pa.py_buffer((4 * ends).astype(np.int32)), pa.py_buffer(numbers)])
                marks = np.zeros(j - i, bool)
                marks[0], begins = begins, False
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(i, j - i) for k in range(n)), told, pa.ListArray.from_arrays(held, new), pa.array(marks)], names=split_schema.names)
                i = j

    def assemble(batches):
        """Looks words up; keeps the dictionary of its block, whose rows come in split's order."""
        known = _Dictionary(vocabulary.value[1])
        for batch in batches:
            numbers, words, begins = (batch.column(batch.schema.get_field_index(c)) for c in ("_numbers", "_words", "_begins"))
            marks = begins.to_numpy(zero_copy_only=False)
            edges = sorted({0, *np.flatnonzero(marks).tolist(), len(marks)})
            for a, b in zip(edges, edges[1:]):
                for i, j in _groups(numbers, a, b, group_bytes // 4):
                    if marks[i]:
                        known.begin()
                    new = words.slice(i, j - i).flatten().to_pylist()
                    known.add(np.fromiter(map(len, new), np.int64, len(new)), np.frombuffer(b"".join(new), np.uint8))
                    own = numbers.slice(i, j - i).to_pylist()
                    lengths = np.cumsum([0, *(len(x) // 4 for x in own)])
                    ids, stop = known.look_up(np.frombuffer(b"".join(own), np.int32))
                    offsets = np.concatenate(([0], stop))[lengths].astype(np.int32)
                    yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(i, j - i) for k in range(n)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))], names=[*names, "_ids"])

    total = docs.count()
    tasks = max(2 * spark.sparkContext.defaultParallelism, total // TASK_DOCS)
    folded = _let(F.lit(bytearray(slots)), lambda s: F.transform("_new", lambda w: _if(w["cells"].isNull(), fold_word(w["word"], s), w["cells"])))
    with_words = rows.coalesce(tasks).mapInArrow(tidily(split), split_schema).select(*names, "_numbers", "_begins", folded.alias("_words"))
    return with_words.mapInArrow(tidily(assemble), T.StructType([*fields, T.StructField("_ids", T.ArrayType(T.IntegerType()))])).toDF(*carried.columns, out)


def _groups(numbers, a: int, b: int, words: int):
    """Rows a to b in groups of about so many words."""
    sizes = np.diff(np.frombuffer(numbers.buffers()[1], np.int32)[numbers.offset : numbers.offset + len(numbers) + 1])
    i = a
    while i < b:
        j, size = i + 1, int(sizes[i]) // 4
        while j < b and size + int(sizes[j]) // 4 <= words:
            size += int(sizes[j]) // 4
            j += 1
        yield i, j
        i = j


def decode(df: DataFrame, ranks_path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """df with the bytes (binary) that the ids stand for: their pieces, concatenated as hexadecimal text."""
    ranks = load_ranks(df.sparkSession, ranks_path)
    pieces = {rank: token.hex() for token, rank in ranks.items()}
    literal = F.split(F.lit(",".join(pieces.get(i, "") for i in range(max(pieces) + 1))), ",")
    return df.withColumn(out, F.unhex(F.array_join(F.transform(F.col(ids), lambda i: F.get(literal, i)), "")))
