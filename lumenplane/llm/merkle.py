"""Document fingerprints: Merkle trees over phrases, paragraphs and sections.

A text's lines are its paragraphs, and a paragraph is cut into phrases behind marks and words in `d`
that a blank follows, and behind common characters of scripts without blanks. Phrases are the leaves: a
leaf is the SHA-256 of its phrase, a paragraph's node that of its leaves, a section's node that of its
paragraphs' nodes, the root that of all sections' nodes. Consecutive paragraphs form a section that ends
behind a paragraph whose node begins with 0, 1, 2 or 3, and every cut depends on what stands in front of
it alone, so an edit moves no boundary but its own. Equal roots mean equal texts; of two trees only
branches that differ need a look, and they locate an edit. The likeness of two trees is the share of
distinct leaves in common (of 64-bit hashes of the leaves).

Defined results: null counts as empty; an empty text has one empty paragraph of one empty phrase; two
empty texts have likeness 1.0. An unbroken run without any such character is one phrase. Rows that share
a doc_id are told apart by their text; repeated rows all stay, and are one document for the order; a null
doc_id is the least. Extra columns are ignored. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenplane.llm.common import beside, partitions_for, work_dir, written

_SECTION_END = "(?<=(?:^| )[0-3][0-9a-f]{63}) "
#: A phrase ends behind one of these, and behind the separator itself: as patterns that both Java and RE2 know.
MARKED, WIDE = "[.,;:!?|#%$&*d][ \\t]", "[、。，．！？；：」』）的了是在不一有人这和のはをにがとでたして다는이을에고의가นรกา]"
SEPARATOR = "\x1e"
#: Bytes of input to a partition, about.
PART_BYTES = 32 << 20


def leaves(text: Column) -> Column:
    """The digests of the phrases of each line of the text, in order."""
    cut = F.regexp_replace(text, f"({MARKED})", f"$1{SEPARATOR}")
    cut = F.when(text.rlike("[\u0e00-\uffff]"), F.regexp_replace(cut, f"({WIDE})", f"$1{SEPARATOR}")).otherwise(cut)
    return F.transform(F.split(cut, "\n"), lambda p: F.transform(F.split(p, SEPARATOR), lambda x: F.sha2(x, 256)))


def paragraphs(leaf_digests: Column) -> Column:
    """The nodes of the text's lines, in order."""
    return F.transform(leaf_digests, lambda x: F.sha2(F.array_join(x, " "), 256))


def sections(paragraph_digests: Column) -> Column:
    """The nodes of the text's sections, in order."""
    return F.transform(F.split(F.array_join(paragraph_digests, " "), _SECTION_END), lambda s: F.sha2(s, 256))


def root(section_digests: Column) -> Column:
    return F.sha2(F.array_join(section_digests, " "), 256)


def marks(leaf_digests: Column) -> Column:
    """64-bit hashes of the distinct leaves."""
    return F.array_distinct(F.transform(F.flatten(leaf_digests), lambda d: F.xxhash64(d)))


def likeness(a: Column, b: Column) -> Column:
    """The share of leaves in common, 0 to 1."""
    both = F.size(F.array_intersect(a, b)).cast("double")
    return both / (F.size(a) + F.size(b) - both)


def tree(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with leaves, paragraphs, sections and fingerprint."""
    out = beside(docs, "leaves", "paragraphs", "sections", "fingerprint")
    own = F.coalesce(F.col(f"`{out.columns[docs.columns.index(text)]}`"), F.lit(""))
    return out.withColumn("leaves", leaves(own)).withColumn("paragraphs", paragraphs(F.col("leaves"))).withColumn("sections", sections(F.col("paragraphs"))).withColumn("fingerprint", root(F.col("sections")))


def differing(a: Column, b: Column) -> Column:
    """a's branches that b lacks, each once, in order: where a was edited."""
    return F.array_except(a, b)


def successors(docs: DataFrame, parts: int) -> DataFrame:
    """For each row (k, h, n, c) the row next in descending order, wrapping round: (k, h, n, c, next_k, next_h).

    Only keys move. They are dealt by range and written; each range finds its own neighbours, and one
    row of each range, at most `parts` of them, links the ranges.
    """
    spark = docs.sparkSession
    ranged = docs.repartitionByRange(parts, "k", "h").select("k", "h", "n", "c", F.spark_partition_id().alias("p"))
    ranged = written(ranged, f"{work_dir(spark)}/ranges")
    inner = W.partitionBy("p").orderBy("k", "h")
    before = ranged.select("k", "h", "n", "c", "p", F.lag(F.struct("k", "h")).over(inner).alias("next"))
    tops = ranged.groupBy("p").agg(F.max(F.struct("k", "h")).alias("top"))
    edges = tops.select("p", F.lag("top").over(W.orderBy("p")).alias("below"), F.max("top").over(W.partitionBy(F.lit(1))).alias("largest"))
    edges = edges.select("p", F.coalesce("below", "largest").alias("below"))
    linked = before.join(F.broadcast(edges), "p").withColumn("next", F.coalesce("next", "below"))
    return linked.select("k", "h", "n", "c", F.col("next.k").alias("next_k"), F.col("next.h").alias("next_h"))


def compare_edits(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Each text against its edited text and the next document, by fingerprint.

    Texts are dealt by key once and used from both sides; to its neighbour a document sends only the
    beginning that is needed and its leaves' marks.
    """
    parts = partitions_for(docs, PART_BYTES)
    base = docs.select(F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(-(1 << 63))).alias("k"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("t")).withColumn("h", F.xxhash64("t"))
    keys = base.groupBy("k", "h").agg(F.max(F.char_length("t")).cast("long").alias("n"), F.count(F.lit(1)).cast("int").alias("c"))
    links = successors(keys, parts)
    texts = base.repartition(parts, "k", "h").dropDuplicates(["k", "h"])
    sent = texts.join(links.select(F.col("next_k").alias("k"), F.col("next_h").alias("h"), F.col("k").alias("to_k"), F.col("h").alias("to_h"), "n", "c").hint("shuffle_hash"), ["k", "h"])
    sent = sent.select(F.col("to_k").alias("k"), F.col("to_h").alias("h"), F.substring("t", F.lit(1), F.floor(F.col("n") / 3).cast("int")).alias("head"), marks(leaves(F.col("t"))).alias("next_marks"), "n", "c")
    cut = F.floor(F.col("n") / 3).cast("int")
    both = texts.join(sent, ["k", "h"]).withColumn("edited", F.concat(F.substring("t", F.lit(1), F.col("n").cast("int") - cut), "head"))
    both = both.withColumn("own", leaves(F.col("t"))).withColumn("other", leaves(F.col("edited"))).withColumn("p", paragraphs(F.col("own"))).withColumn("q", paragraphs(F.col("other")))
    told = both.select(
        F.nullif(F.col("k"), F.lit(-(1 << 63))).alias(key), F.col("n").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        root(sections(F.col("p"))).alias("fingerprint"), root(sections(F.col("q"))).alias("edited_fingerprint"),
        likeness(marks(F.col("own")), marks(F.col("other"))).alias("near_edited"), likeness(marks(F.col("own")), F.col("next_marks")).alias("near_next"),
        differing(F.col("p"), F.col("q")).alias("lost"), "p", "c",
    )
    told = told.withColumn("n_differing", F.size("lost")).withColumn("first_differing", (F.array_position("p", F.get("lost", F.lit(0))) - 1).cast("int")).drop("lost", "p")
    return told.withColumn("c", F.explode(F.array_repeat(F.lit(1), F.col("c")))).drop("c")
