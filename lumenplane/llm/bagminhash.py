"""Near-duplicate detection by BagMinHash.

A document is a bag of word 5-shingles, weighted by how often each occurs. Weights are discretised at
0, 1, 2, 4, 8 ...; every shingle has, in every interval below its weight, a Poisson process whose rate
is the interval's width. A point has a time, one of the M components and a level within its interval,
all hashed from the shingle; points above the shingle's weight are thinned out. A component's value is
that of its earliest point, and two bags agree in a component with a probability that equals their
weighted Jaccard similarity (without bias). Processes are followed up to the time by which every
component has a point, so a text of any length costs about M log M points beyond its shingles.

Bags that are equal collapse to one representative. Signatures are cut into BANDS bands of ROWS
components; documents that share a band are candidates, and every link is verified by the exact
multiset overlap of the two texts (of 64-bit shingle hashes). Within a band's bucket the pairs are never
listed. In each of ROUNDS rounds every document meets one hub, the one of its buckets' hubs with which it
shares most buckets; a class that is linked joins the other's. The classes that still share a bucket are
then compared in full, block by block, so no link is lost to the choice of hubs; a task keeps its classes
in a union-find and returns a forest, not all links.

Buckets that hold many documents are dealt by bucket and a salt that follows their size.

Defined results: null and empty texts, and texts without a word, are alone in their class; a text of
fewer than five words is one shingle of all its words. Rows that share a doc_id are told apart by
their text. A row whose doc_id is null belongs to the class of its text, whose class_id is the least
doc_id that is not null (null if there is none). Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenplane.llm.common import mix, tidily, word_hashes, work_dir, written

N = 5
LEAST = 0.8
BANDS, ROWS = 32, 5
M = BANDS * ROWS
ROUNDS = 2
#: So many wanted texts at most are told to all tasks (some 24 bytes each); more are joined by a shuffle.
TOLD_ROWS = 500_000
#: Bags in a row where classes are compared in full.
BLOCK = 128
#: Shingles that are compared at once there.
COLUMNS = 4096
#: Documents of a bucket that are dealt together.
SALT_EACH = 500
GROUP_BYTES = 6 << 20
#: What equal bags have in common.
EQUAL = ["d1", "d2", "size"]
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)
_U64 = np.uint64


def shingles(hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every five words in a row, and each one's document; one for a shorter document."""
    size = np.diff(bounds)
    if not len(hashes):
        return np.zeros(0, _U64), np.zeros(0, np.int64)
    padded = np.concatenate((hashes, np.zeros(N, _U64)))
    doc = np.repeat(np.arange(len(size)), size)
    left = np.repeat(bounds[1:], size) - np.arange(len(hashes))
    total = np.zeros(len(hashes), _U64)
    for k in range(N):
        total += np.where(left > k, padded[k : k + len(hashes)] * _ODD[k], _U64(0))
    first = np.arange(len(hashes)) == np.repeat(bounds[:-1], size)
    keep = (left >= N) | (first & (np.repeat(size, size) < N))
    return mix(total[keep]), doc[keep]


def bags(texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each document in order, their document and how often they occur."""
    hashes, bounds, _, _ = word_hashes(texts)
    grams, doc = shingles(hashes, bounds)
    order = np.lexsort((grams, doc))
    grams, doc = grams[order], doc[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    return grams[at], doc[at], np.diff(np.append(at, len(grams)))


def signatures(grams: np.ndarray, doc: np.ndarray, weight: np.ndarray, docs: int) -> np.ndarray:
    """docs x M values; documents without a shingle have zeros."""
    total = np.bincount(doc, weights=weight, minlength=docs)
    best = np.full(docs * M, np.iinfo(np.uint64).max, np.uint64)
    # a process for each interval (lower, upper] that begins below the weight
    elements, owners, lowers, widths, weights = [grams], [doc], [np.zeros(len(grams), np.int64)], [np.ones(len(grams), np.int64)], [weight]
    lower = 1
    while (more := np.flatnonzero(weight > lower)).size:
        elements.append(mix(grams[more] + _U64(lower)))
        owners.append(doc[more])
        lowers.append(np.full(len(more), lower))
        widths.append(np.full(len(more), lower))
        weights.append(weight[more])
        lower *= 2
    element, owner, low, width, most = map(np.concatenate, (elements, owners, lowers, widths, weights))
    until = M * (np.log(M) + 3.0) / np.maximum(total, 1)
    todo = np.ones(docs, bool)
    while True:
        live = np.flatnonzero(todo[owner])
        e, d, lo, wd, mx = element[live], owner[live], low[live], width[live], most[live]
        end, time, r = until[d], np.zeros(len(live)), 0
        plain = len(widths) == 1
        while len(e):
            r += 1
            u = mix(e + np.multiply(_ODD[:1], _U64(r)))
            time = time - np.log(((u >> _U64(11)).astype(np.float64) + 0.5) / float(1 << 53)) / wd
            on = time <= end
            e, d, wd, end, time, u = e[on], d[on], wd[on], end[on], time[on], u[on]
            v = mix(u)
            part = ((v >> _U64(40)) * _U64(M) >> _U64(24)).astype(np.int64)
            entry = (time.astype(np.float32).view(np.uint32).astype(np.uint64) << _U64(32)) | (v & _U64(0xFFFFFFFF))
            slot = d * M + part
            if not plain:
                lo, mx = lo[on], mx[on]
                level = lo + 1 + ((mix(v) >> _U64(32)) * wd.astype(_U64) >> _U64(32)).astype(np.int64)
                good = level <= mx
                slot, entry = slot[good], entry[good]
            np.minimum.at(best, slot, entry)
        full = (best.reshape(docs, M) != np.iinfo(np.uint64).max).all(1) | (total == 0)
        todo &= ~full
        if not todo.any():
            break
        until = until * 2
    # a value is the point's hash and not its time, which nothing else could equal by chance
    out = (best & _U64(0xFFFFFFFF)).reshape(docs, M)
    out[total == 0] = 0
    return out


def _signed(rows: np.ndarray) -> pa.Array:
    return pa.array(rows.view(np.int64))


def sign(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """k, h (hash of the text), d1 and d2 (digests of the bag), size (shingles) and bands (hashes of the bands)."""
    rows = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t"), F.xxhash64(text).alias("h"))

    def run(batches):
        for batch in batches:
            texts, i = batch.column(1).to_pylist(), 0
            while i < len(texts):
                j, size = i, 0
                while j < len(texts) and (j == i or size + len(texts[j] or "") <= GROUP_BYTES):
                    size += len(texts[j] or "")
                    j += 1
                grams, doc, weight = bags(texts[i:j])
                n = j - i
                weighed = mix(grams * _ODD[1] + weight.astype(_U64))
                d1, d2 = np.zeros(n, _U64), np.zeros(n, _U64)
                if len(grams):
                    starts = np.flatnonzero(np.diff(doc, prepend=-1))
                    d1[doc[starts]] = np.add.reduceat(weighed, starts)
                    d2[doc[starts]] = np.add.reduceat(mix(weighed ^ _ODD[2]), starts)
                parts = signatures(grams, doc, weight, n).reshape(n, BANDS, ROWS)
                band = np.tile(np.arange(1, BANDS + 1, dtype=_U64), (n, 1))
                for k in range(ROWS):
                    band = mix(band * _ODD[3] + parts[:, :, k])
                total = np.bincount(doc, weights=weight, minlength=n).astype(np.int64)
                bands = pa.ListArray.from_arrays(pa.array(np.arange(0, n * BANDS + 1, BANDS, dtype=np.int32)), _signed(band.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, n), batch.column(2).slice(i, n), _signed(d1), _signed(d2), pa.array(total), bands], names=["k", "h", "d1", "d2", "size", "bands"])
                i = j

    return rows.mapInArrow(tidily(run), "k long, h long, d1 long, d2 long, size long, bands array<long>")


def _doc(key: str):
    """A key to join by: null is the least."""
    return F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63))).alias("doc")


def _bags_of(docs: DataFrame, wanted: DataFrame, text: str, key: str) -> DataFrame:
    """k and bag (binary: sorted 64-bit shingle hashes, with repeats) of the bags wanted (k, doc, h)."""
    told = F.broadcast(wanted) if wanted.limit(TOLD_ROWS + 1).count() <= TOLD_ROWS else wanted
    rows = docs.select(_doc(key), F.xxhash64(text).alias("h"), F.col(text).alias("t")).join(told, ["doc", "h"]).select("k", "t").dropDuplicates(["k"])

    def run(batches):
        for batch in batches:
            keys, out = batch.column(0), []
            for t in batch.column(1).to_pylist():
                hashes, bounds, _, _ = word_hashes([t])
                out.append(np.sort(shingles(hashes, bounds)[0]).tobytes())
            yield pa.RecordBatch.from_arrays([keys, pa.array(out, pa.binary())], names=["k", "bag"])

    return rows.mapInArrow(tidily(run), "k long, bag binary")


class _Bags:
    """Many bags side by side, ready for the overlap of each with one other."""

    def __init__(self, raw: list[bytes]):
        flat = np.frombuffer(b"".join(raw), _U64)
        self.size = np.fromiter((len(r) // 8 for r in raw), np.int64, len(raw))
        owner = np.repeat(np.arange(len(raw)), self.size)
        new = np.ones(len(flat), bool)
        new[1:] = (flat[1:] != flat[:-1]) | (owner[1:] != owner[:-1])
        at = np.flatnonzero(new)
        self.count = np.diff(np.append(at, len(flat)))
        self.values, self.code = np.unique(flat[at], return_inverse=True)
        self.owner = owner[at]

    def one(self, i: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Values, counts and size of bag i."""
        own = slice(*np.searchsorted(self.owner, [i, i + 1]))
        return self.values[self.code[own]], self.count[own], int(self.size[i])

    def near(self, values: np.ndarray, counts: np.ndarray, size: int, least: float) -> np.ndarray:
        """Whether the weighted Jaccard similarity of each bag with this one reaches `least`."""
        place = np.searchsorted(self.values, values)
        place[place == len(self.values)] = 0
        hit = self.values[place] == values
        weight = np.zeros(len(self.values), np.int64)
        weight[place[hit]] = counts[hit]
        both = np.bincount(self.owner, weights=np.minimum(self.count, weight[self.code]), minlength=len(self.size))
        return (both > 0) & (both >= least * (self.size + size - both))


def verify(pairs: DataFrame, bag: DataFrame, least: float) -> DataFrame:
    """la and lb of the pairs (a, b, la, lb, salts) whose multiset overlap reaches `least`. The side with hubs is joined by key and salt."""
    left = pairs.join(bag.select(F.col("k").alias("a"), F.col("bag").alias("bag_a")), "a").withColumn("salt", F.pmod(F.xxhash64("a"), F.col("salts")).cast("int"))
    hubs = pairs.groupBy("b").agg(F.max("salts").alias("salts"))
    right = bag.select(F.col("k").alias("b"), F.col("bag").alias("bag_b")).join(hubs, "b").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    both = left.join(right, ["b", "salt"]).select("b", "la", "lb", "bag_a", "bag_b")

    def run(batches):
        for batch in batches:
            b = batch.column(0).to_numpy()
            order = np.argsort(b, kind="stable")
            good = []
            for part in np.split(order, np.flatnonzero(np.diff(b[order])) + 1) if len(order) else ():
                hub = _Bags([batch.column(4)[int(part[0])].as_py()]).one(0)
                near = _Bags(batch.column(3).take(pa.array(part)).to_pylist()).near(*hub, least)
                good += part[near].tolist()
            kept = pa.array(sorted(good), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(1).take(kept), batch.column(2).take(kept)], names=["la", "lb"])

    return both.mapInArrow(tidily(run), "la long, lb long")


def _elements(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bags as sets: each shingle with the number of its occurrence as one hash, its bag, and the bags' sizes."""
    flat, size = np.frombuffer(b"".join(raw), _U64), np.fromiter((len(r) // 8 for r in raw), np.int64, len(raw))
    owner = np.repeat(np.arange(len(raw)), size)
    new = np.ones(len(flat), bool)
    new[1:] = (flat[1:] != flat[:-1]) | (owner[1:] != owner[:-1])
    nth = np.arange(len(flat)) - np.repeat(np.flatnonzero(new), np.diff(np.append(np.flatnonzero(new), len(flat))))
    return np.where(nth > 0, mix(flat + nth.astype(_U64) * _ODD[4]), flat), owner, size


def overlaps(ours: list[bytes], theirs: list[bytes], least: float) -> np.ndarray:
    """Which pairs of bags (ours x theirs) reach a weighted Jaccard similarity of `least`, by products of their tables of elements."""
    (x, own_x, size_x), (y, own_y, size_y) = _elements(ours), _elements(theirs)
    common = np.intersect1d(x, y)  # what only one side holds adds nothing
    both = np.zeros((len(ours), len(theirs)), np.float64)
    for i in range(0, len(common), COLUMNS):
        part, tables = common[i : i + COLUMNS], []
        for values, owner, n in ((x, own_x, len(ours)), (y, own_y, len(theirs))):
            at = np.searchsorted(part, values)
            at[at == len(part)] = 0
            hit = part[at] == values
            table = np.zeros((n, len(part)), np.float32)
            table[owner[hit], at[hit]] = 1
            tables.append(table)
        both += tables[0] @ tables[1].T
    return (both > 0) & (both >= least * (size_x[:, None] + size_y[None, :] - both))


class _Classes:
    """Which labels have become one, by union-find."""

    def __init__(self, labels):
        self.head = {x: x for x in labels}

    def find(self, x: int) -> int:
        while self.head[x] != x:
            self.head[x] = x = self.head[self.head[x]]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = sorted((self.find(x), self.find(y)))
        self.head[y] = x
        return x != y


def verify_classes(open_members: DataFrame, bag: DataFrame, least: float, folder: str) -> DataFrame:
    """la and lb of classes that still share a bucket and are linked, compared in full.

    A document's home is the fullest bucket that it is still in; the documents of a home stand in rows
    of about BLOCK bags, those of its largest class apart from the others. Homes whose documents share a
    bucket meet block by block, unless both blocks are of one class.
    """
    sizes = open_members.groupBy("bucket").agg(F.count(F.lit(1)).alias("c"))
    homes = open_members.select("bucket", "k", "label").join(sizes, "bucket").groupBy("k").agg(F.max(F.struct("c", "bucket")).alias("top"), F.first("label").alias("label")).select("k", "label", F.col("top.bucket").alias("home"))
    main = homes.groupBy("home", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("home").agg(F.max(F.struct("n", "label")).alias("m")).select("home", F.col("m.label").alias("main"))
    homes = written(homes.join(main, "home").withColumn("own", F.col("label") == F.col("main")).drop("main"), f"{folder}/homes")
    counts = homes.groupBy("home", "own").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    placed = homes.join(counts, ["home", "own"]).withColumn("block", F.pmod(F.xxhash64("k"), F.col("blocks")) * 2 + F.col("own").cast("int"))
    blocks = placed.join(bag, "k").groupBy("home", "block").agg(F.collect_list(F.struct("label", "bag")).alias("held"), F.min("label").alias("lo"), F.max("label").alias("hi"))

    present = open_members.select("k", "bucket").join(homes.select("k", "home"), "k").select("bucket", "home").distinct()
    other = present.select("bucket", F.col("home").alias("home_b"))
    meets = present.join(other, "bucket").where("home <= home_b").select("home", "home_b").distinct()
    right = blocks.select(F.col("home").alias("home_b"), F.col("block").alias("block_b"), F.col("held").alias("held_b"), F.col("lo").alias("lo_b"), F.col("hi").alias("hi_b"))
    rows = meets.join(blocks, "home").join(right, "home_b").where("(home <> home_b or block <= block_b) and not (lo = hi and lo_b = hi_b and lo = lo_b)").select("held", "held_b")

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                ours, theirs = batch.column(0)[i].values, batch.column(1)[i].values
                x, y = ours.field("label").to_numpy(), theirs.field("label").to_numpy()
                near = overlaps(ours.field("bag").to_pylist(), theirs.field("bag").to_pylist(), least) & (x[:, None] != y[None, :])
                a, b = np.nonzero(near)
                known = _Classes({*x.tolist(), *y.tolist()})
                found = [(p, q) for p, q in np.unique(np.stack((x[a], y[b]), 1), axis=0).tolist() if known.join(p, q)]
                yield pa.RecordBatch.from_pydict({"la": pa.array([x for x, _ in found], pa.int64()), "lb": pa.array([x for _, x in found], pa.int64())})

    return rows.mapInArrow(tidily(run), "la long, lb long")


def components(edges: DataFrame, folder: str) -> DataFrame:
    """label and head (the least label of its component) of all labels that edges (la, lb) join, by label propagation with pointer jumping."""
    both = written(edges.select(F.col("la").alias("a"), F.col("lb").alias("b")).unionAll(edges.select(F.col("lb").alias("a"), F.col("la").alias("b"))).distinct(), f"{folder}/both")
    labels = written(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("head")).withColumnRenamed("a", "label"), f"{folder}/labels0")
    step = 0
    while True:
        step += 1
        seen = both.join(labels, both["b"] == labels["label"]).groupBy("a").agg(F.min("head").alias("near"))
        nearer = labels.join(seen, labels["label"] == seen["a"]).select("label", "head", F.least("head", "near").alias("next"))
        up = labels.select(F.col("label").alias("next"), F.col("head").alias("above"))
        moved = nearer.join(up, "next").select("label", F.least("next", "above").alias("head"), (F.least("next", "above") != F.col("head")).alias("changed"))
        moved = written(moved, f"{folder}/labels{step}")
        labels = moved.select("label", "head")
        if moved.where("changed").isEmpty():
            return labels


def pointed(edges: DataFrame, folder: str) -> DataFrame:
    """label and head of classes that join another: each points to the least of those before it, and pointers are followed to their end."""
    up = edges.groupBy(F.greatest("la", "lb").alias("label")).agg(F.min(F.least("la", "lb")).alias("head"))
    moved, step = written(up, f"{folder}/0"), 0
    while True:
        step += 1
        above = moved.select(F.col("label").alias("head"), F.col("head").alias("above"))
        jumped = moved.join(above, "head", "left").select("label", F.coalesce("above", "head").alias("head"), F.col("above").isNotNull().alias("changed"))
        jumped = written(jumped, f"{folder}/{step}")
        moved = jumped.select("label", "head")
        if jumped.where("changed").isEmpty():
            return moved


def classes(docs: DataFrame, least: float = LEAST, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key and class_id (the least key of the class) of every document."""
    signed, bags = _labelled(docs, least, text, key)
    heads = bags.groupBy("label").agg(F.min("rep").alias("rep")).select("label", F.col("rep.k").alias("class_id"))
    of_bag = bags.join(heads, "label").select(*EQUAL, "class_id")
    return signed.select("k", *EQUAL).join(of_bag, EQUAL, "left").select(F.col("k").alias(key), F.coalesce("class_id", "k").alias("class_id"))


def representatives(docs: DataFrame, least: float = LEAST, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One document of each class as it is in docs: that of the least key, null last; texts without words stay."""
    signed, bags = _labelled(docs, least, text, key)
    kept = bags.groupBy("label").agg(F.min("rep").alias("rep")).select("rep.k", "rep.h").unionAll(signed.where("size = 0").select("k", "h")).select(_doc("k"), "h").distinct()
    return docs.withColumns({"__doc": _doc(key), "__h": F.xxhash64(text)}).join(kept.toDF("__doc", "__h"), ["__doc", "__h"], "left_semi").dropDuplicates(["__doc", "__h"]).select(*docs.columns)


def _labelled(docs: DataFrame, least: float, text: str, key: str) -> tuple[DataFrame, DataFrame]:
    """Signatures of all rows; and of each distinct bag its digest, rep (the row that stands for it) and label (its class).

    A bag's k is a number of its own, so that keys that are repeated or null stand for nothing.
    """
    folder = work_dir(docs.sparkSession)
    signed = written(sign(docs, text, key), f"{folder}/signed")
    row = F.struct(F.col("k").isNull().alias("none"), "k", "h", "bands")
    found = signed.where("size > 0").groupBy(*EQUAL).agg(F.min(row).alias("rep"))
    heads = written(found.withColumn("id", F.monotonically_increasing_id()), f"{folder}/heads")

    banded = heads.select(F.col("id").alias("k"), F.explode("rep.bands").alias("bucket"))
    shared = banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    sized = banded.join(shared, "bucket")
    weight = F.sum("c").over(W.partitionBy("k"))  # over a document's buckets, of which there are BANDS
    salt = F.pmod(F.xxhash64("k"), _salts(F.col("c"))).cast("int")
    open_members = written(sized.withColumn("weight", weight).withColumn("salt", salt).withColumn("label", F.col("k")), f"{folder}/open")
    if open_members.isEmpty():
        return signed, heads.withColumn("label", F.col("id"))
    reps = heads.select(F.col("id").alias("k"), _doc("rep.k"), F.col("rep.h").alias("h"))
    bag = written(_bags_of(docs, reps.join(open_members.select("k").distinct(), "k", "left_semi"), text, key), f"{folder}/bags")

    maps = []
    for step in range(ROUNDS + 1):
        at = f"{folder}/round{step}"
        if step < ROUNDS:  # hubs of the first round are central: the documents that share most buckets with most others
            draw = F.struct(-F.col("weight"), "k") if step == 0 else F.struct(F.xxhash64("k", F.lit(step)), "k")
            hub = _to_salts(open_members.groupBy("bucket").agg(F.min(F.struct(draw.alias("draw"), "k", "label")).alias("hub"), F.max("c").alias("c")).select("bucket", "c", F.col("hub.k").alias("b"), F.col("hub.label").alias("lb")))
            met = open_members.join(hub, ["bucket", "salt"]).where("label <> lb").select("k", "b", "label", "lb", "c").repartition("k")
            met = met.groupBy("k", "b").agg(F.count(F.lit(1)).alias("n"), F.first("label").alias("la"), F.first("lb").alias("lb"), F.max("c").alias("c"))
            pairs = met.groupBy("k").agg(F.max(F.struct("n", -F.col("b"), "b", "la", "lb", "c")).alias("m")).select(F.col("k").alias("a"), "m.b", "m.la", "m.lb", _salts(F.col("m.c")).alias("salts"))
            edges = written(verify(written(pairs, f"{at}/pairs"), bag, least), f"{at}/edges")
        else:
            edges = written(verify_classes(open_members, bag, least, at), f"{at}/edges")
        if not edges.isEmpty():
            maps.append(pointed(edges, f"{at}/classes") if step < ROUNDS else components(edges, f"{at}/classes"))
            open_members = open_members.join(maps[-1], "label", "left").withColumn("label", F.coalesce("head", "label")).drop("head")
        if step == ROUNDS:
            break
        mixed = _to_salts(open_members.groupBy("bucket").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.max("c").alias("c")).where("x <> y").select("bucket", "c"))
        open_members = written(open_members.join(mixed, ["bucket", "salt"], "left_semi").select("bucket", "k", "c", "weight", "salt", "label"), f"{at}/open")
        if open_members.isEmpty():
            break
    labels = heads.withColumn("label", F.col("id"))
    for moved in maps:
        labels = labels.join(moved, "label", "left").withColumn("label", F.coalesce("head", "label")).drop("head")
    return signed, labels


def _salts(size):
    """Into how many parts a bucket of this many documents is dealt."""
    return F.ceil(size / SALT_EACH).cast("int")


def _to_salts(buckets: DataFrame) -> DataFrame:
    """A row of each bucket (with its size c) for every part of it."""
    return buckets.withColumn("salt", F.explode(F.sequence(F.lit(0), _salts(F.col("c")) - 1))).drop("c")
