"""Language identification by compression.

A text is encoded with one zstandard raw-content dictionary per language; the language whose
dictionary gives the fewest bytes is its language. Whole texts count: letters are lower-cased, other
characters become single blanks, and the bytes are compressed in blocks of BLOCK bytes, so that a
text's own history does not drown the dictionaries.

Dictionaries are learned from at most SAMPLE_DOCS distinct texts for each language, those of the
least hashes; copies of a text count once. Each text is cut, as a whole, into pieces of about PIECE
bytes, and a dictionary takes one piece of every text, then a second one and so on, in the order of
their hashes, until it is full: any place of a text counts alike, and only what is taken reaches the
driver, at most DICTIONARY_BYTES for each language.

Defined results: null texts and texts without a letter are `und`, score 0 and rejected. Equal sizes
take the language learned from most documents, with score 0. Without any learned language all texts
are `und`. Repeated rows stay. Extra columns pass through; one that bears the name of a result, in any
case, gets `_given` added to its name.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenplane.llm.common import beside, tidily

#: Texts a language is learned from, at most, and bytes of a dictionary.
SAMPLE_DOCS = 400
DICTIONARY_BYTES = 112_640
PIECE = 256
BLOCK = 4096
#: Below this share of bytes saved against the second language a text is rejected.
MARGIN = 0.004
LEVEL = 5

_OTHER = re.compile(r"[\W\d_]+")


def normalised(text: str | None) -> bytes:
    """Lower-cased letters, single blanks between; empty if the text has no letter."""
    kept = _OTHER.sub(" ", (text or "").lower()).strip()
    return kept.encode("utf-8", "replace") if any(map(str.isalpha, kept)) else b""


def fit(docs: DataFrame, text: str = "text", lang: str = "lang") -> dict[str, bytes]:
    """A dictionary for each language of docs, which must hold training rows only."""
    rows = docs.select(F.col(text).alias("t"), F.col(lang).alias("l")).where("l is not null and t rlike '\\\\p{L}'").withColumn("h", F.xxhash64("t"))
    texts = rows.groupBy("l", "h").agg(F.count(F.lit(1)).alias("n"))
    counts, share = {}, []
    for l, n, distinct in texts.groupBy("l").agg(F.sum("n"), F.count(F.lit(1))).collect():
        counts[l] = n
        share += [F.lit(l), F.lit(min(1.0, 2 * SAMPLE_DOCS / distinct))]
    if not counts:
        return {}
    # a first draw of about 2 * SAMPLE_DOCS texts, so that ranking never meets a whole language
    drawn = F.shiftrightunsigned("h", 11) / float(1 << 53)
    near = rows.select("l", "h").where(drawn < F.try_element_at(F.create_map(*share), F.col("l"))).distinct()
    rank = F.row_number().over(W.partitionBy("l").orderBy(F.shiftrightunsigned("h", 11), "h"))
    least = near.withColumn("rank", rank).where(F.col("rank") <= SAMPLE_DOCS).select("l", "h")
    chosen = rows.join(F.broadcast(least), ["l", "h"]).groupBy("l", "h").agg(F.min("t").alias("t"))
    order = W.partitionBy("l").orderBy("turn", "h", "piece")  # of a sample of bounded size
    full = F.sum(F.octet_length("piece") + 1).over(order.rowsBetween(W.unboundedPreceding, 0))
    taken = chosen.mapInArrow(_cut, "l string, h long, turn int, piece binary").withColumn("used", full).where(F.col("used") <= DICTIONARY_BYTES + 1)
    sample: dict[str, list] = {l: [] for l in counts}
    for l, h, turn, piece in taken.select("l", "h", "turn", "piece").collect():
        sample[l].append((turn, h, bytes(piece)))
    return {l: b" ".join(p for *_, p in sorted(sample[l])) or b" " for l in sorted(sample, key=lambda l: (-counts[l], l))}


def pieces(data: bytes) -> list[bytes]:
    """Normalised text in pieces of about PIECE bytes, in the order of their hashes."""
    out, at = [], 0
    while at < len(data):
        stop = at + PIECE
        if stop < len(data):
            blank = data.rfind(b" ", at + 1, stop + 1)
            stop = blank if blank > 0 else stop
            while blank <= 0 and stop < len(data) and data[stop] & 0xC0 == 0x80:  # no cut within a letter
                stop += 1
        out.append(data[at:stop].strip(b" "))
        at = stop
    return sorted({p for p in out if p}, key=lambda p: (xxhash.xxh64_intdigest(p), p))


def _cut(batches):
    for batch in batches:
        rows = [(l, h, k, p) for l, h, t in zip(*(c.to_pylist() for c in batch.columns)) for k, p in enumerate(pieces(normalised(t))[: DICTIONARY_BYTES // PIECE + 1])]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.string(), pa.int64(), pa.int32(), pa.binary()))], names=["l", "h", "turn", "piece"])


def compressors(learned: dict[str, bytes]) -> list:
    made = []
    for content in learned.values():
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=LEVEL)
        made.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False).compress)
    return made


def sizes(data: bytes, made: list) -> list[int]:
    blocks = [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)]
    return [sum(len(c(b)) for b in blocks) for c in made]


def predict(docs: DataFrame, learned: dict[str, bytes], text: str = "text") -> DataFrame:
    """docs with lang_pred (string), score (double, 0 to 1) and rejected (boolean)."""
    new = ("lang_pred", "score", "rejected")
    at = docs.columns.index(text)
    carried = beside(docs, *new)
    fields = carried.schema.fields
    langs, shared = list(learned), docs.sparkSession.sparkContext.broadcast(learned)

    def run(batches):
        made = compressors(shared.value)
        for batch in batches:
            pred, score, rejected = [], [], []
            for value in batch.column(at).to_pylist():
                data = normalised(value)
                if not data or not made:
                    pred.append("und"), score.append(0.0), rejected.append(True)
                    continue
                size = np.array(sizes(data, made))
                best = int(size.argmin())
                second = int(np.delete(size, best).min()) if len(size) > 1 else size[best] * 2
                margin = float(second - size[best]) / float(second)
                pred.append(langs[best]), score.append(margin / (margin + 0.01)), rejected.append(margin < MARGIN)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], names=[*(f.name for f in fields), *new])

    schema = T.StructType([*fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])
    return carried.mapInArrow(tidily(run), schema)
