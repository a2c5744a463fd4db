"""BPE against the tiktoken library, classifiers on rows held out, and the pipeline against brute force."""

import re
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
import zstandard

import corpus_pipeline
from lumenplane.llm import bpe, decontaminate, langid, queries, toxicity
from lumenplane.llm.common import BATCH_BYTES, columns_of, frugally, word_hashes, words
from tests.llm.test_search import _classes, _score

RANKS = P.path("byte_bpe_multi_50k.tiktoken")
SF = "/root/testdata/sf0.01"
ODD = ["", None, "a", "  a  b \n c\t\td ", "x" * 1000 + " " + "ab" * 700, "don't we'll \x1c!\x1c! 　  x", "日本語テキスト 🙂🙂 é ñ", "\n\n\n", " lead", "trail ", " ", "a\r\n b", "wort " * 5000, "nul \0byte\0\0", "pq" * 3000 + " zz" + "é" * 2500]


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(None, RANKS), special_tokens={})


def test_ids_are_those_of_the_library(spark, library, monkeypatch):
    texts = [*ODD, *(r.text for r in spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 60").collect())]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)] + [(0, "", "clash")], "doc_id long, text string, ids string").repartition(3)
    for block in (500_000, 50):  # with a dictionary that starts anew all the time, too
        monkeypatch.setattr(bpe, "BLOCK_WORDS", block)
        rows = bpe.decode(bpe.encode(df, RANKS, P.PATTERN), RANKS).collect()
        assert len(rows) == len(texts) + 1
        for r in rows:
            assert r.ids == library.encode_ordinary(r.text or "") and bytes(r.decoded) == (r.text or "").encode()
    assert bpe.encode(df.limit(0), RANKS, P.PATTERN).collect() == []


def test_other_patterns_and_clashing_names(spark):
    pattern = r" ?[^\s\p{L}\p{N}]+[\r\n]*|\p{L}+|\p{N}|\s+"
    other = tiktoken.Encoding("other", pat_str=pattern, mergeable_ranks=bpe.load_ranks(None, RANKS), special_tokens={})
    texts = ["a !\n\nb 12", " ?!\r\n x", "plain words here", "!\n"]
    df = spark.createDataFrame([(t, "a", 7, True) for t in texts], "text string, IDS string, _text int, _0 boolean")
    rows = bpe.encode(df, RANKS, pattern)
    assert rows.columns == ["text", "IDS_given", "_text", "_0", "ids"]
    assert sorted((r.text, r.IDS_given, r._text, r._0, r.ids) for r in rows.collect()) == sorted((t, "a", 7, True, other.encode_ordinary(t)) for t in texts)
    assert bpe.encode(df, RANKS, pattern, keep=["_0"]).columns == ["_0", "ids"]


def test_long_words_are_merged_alike(library):
    ranks = bpe.load_ranks(None, RANKS)
    pairs = bpe.pair_ranks(ranks)
    for word in (b"ab" * 300, b"thethethe" * 50, bytes(range(97, 123)) * 20, b"x"):
        assert bpe.merge_long(word, ranks, pairs) == library._encode_single_piece(word)


def _bounds(df):
    """What the session that runs df allows an Arrow batch: bytes, and the records of a Parquet batch."""
    conf = df._jdf.sparkSession().conf()
    return [conf.get(f"spark.sql.{k}") for k in ("execution.arrow.maxBytesPerBatch", "parquet.columnarReaderBatchSize")]


def _measured(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], names=["n", "size"])


def test_texts_reach_workers_in_small_batches(spark):
    before = _bounds(spark.range(1))
    wide = spark.range(0, 400, 1, 2).selectExpr("id", "repeat('abcdefghij', 5000) as text")
    sizes = frugally(wide).mapInArrow(_measured, "n long, size long").collect()
    assert sum(r.n for r in sizes) == 400 and max(r.size for r in sizes) < 1.1 * BATCH_BYTES
    found = queries.op1_bpe(spark, SF)
    assert int(_bounds(found)[0]) == BATCH_BYTES and int(_bounds(found)[1]) < int(before[1])
    assert _bounds(spark.range(1)) == before and _bounds(wide) == before


def test_stages_begin_with_the_drivers_free_memory_given_back(spark):
    jvm = spark._jvm
    held = lambda: int(re.search(r"\nPss_Anon:\s+(\d+)", Path(f"/proc/{jvm.java.lang.ProcessHandle.current().pid()}/smaps_rollup").read_text())[1]) / 1024
    stage, docs = corpus_pipeline._small(lambda spark, docs, sf_dir: docs), spark.range(1)
    assert all(f.__wrapped__ for _, f in corpus_pipeline.STAGES)
    stage(spark, docs, SF)
    packers = [jvm.java.util.zip.Deflater() for _ in range(600)]  # each takes some 100 KB outside the heap
    for p in packers[:-1]:  # the last one keeps glibc from giving the rest back by itself
        p.end()
    before = held()
    stage(spark, docs, SF)
    assert held() < before - 30
    packers[-1].end()


def _out(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def test_languages_of_held_out_documents(spark):
    got = {r.doc_id: r for r in queries.op6_langid(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(got) == len(docs) and all(got[d.doc_id].held_out == _out(d.doc_id) for d in docs)
    held = [d for d in docs if _out(d.doc_id)]
    assert np.mean([got[d.doc_id].lang_pred == d.lang for d in held]) > 0.95
    assert np.mean([got[d.doc_id].rejected for d in docs]) < 0.03


def test_copies_are_learned_from_once(spark, monkeypatch):
    monkeypatch.setattr(langid, "SAMPLE_DOCS", 20)
    rows = [(f"text {'abcdefghij'[i // 10]}{'abcdefghij'[i % 10]} of many", "en") for i in range(100)]
    copies = [(f"copied {'abcdefghij'[i]} text", "en") for i in range(10) for _ in range(300)]
    learned = langid.fit(spark.createDataFrame(rows + copies + [("einer", "de")] * 50, "text string, lang string").repartition(6))
    assert list(learned) == ["en", "de"] and learned["de"] == b"einer"
    once = langid.fit(spark.createDataFrame([*rows, *sorted(set(copies)), ("einer", "de")], "text string, lang string"))
    assert learned == once
    assert learned["en"].count(b"text") == 20 and max(learned["en"].count(f"copied {c} text".encode()) for c in "abcdefghij") <= 1


def test_language_of_odd_texts(spark):
    learned = {"en": b"the cat and the dog sat on the mat with another " * 40, "de": b"der hund und die katze sassen auf einer matte " * 40}
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(["the dog and the cat", "der hund und die katze", None, "", "123 ... !", "a"])], "doc_id long, text string, score string")
    got = {r.doc_id: r for r in langid.predict(df, learned).collect()}
    assert [got[i].lang_pred for i in range(5)] == ["en", "de", "und", "und", "und"] and got[5].lang_pred in learned
    assert [got[i].rejected for i in range(5)] == [False, False, True, True, True] and all(0 <= r.score <= 1 for r in got.values())
    assert {r.lang_pred for r in langid.predict(df, {}).collect()} == {"und"}
    assert langid.fit(df.selectExpr("text", "cast(null as string) as lang")) == {}


def test_toxicity_of_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    got = {r.doc_id: r for r in queries.op2_toxicity(spark, sf).collect()}
    labels = [r for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if _out(r.doc_id)]
    hit = [(got[r.doc_id].predicted, r.toxic) for r in labels]
    assert np.mean([a == b for a, b in hit]) > 0.95
    assert all((r.score >= 0.3) == r.predicted and 0 <= r.score <= 1 for r in got.values())


def test_toxicity_of_odd_texts(spark):
    texts = [f"plain words number {i} here and there" for i in range(60)] + [f"plain words number {i} you awful here" for i in range(60)]
    model = toxicity.train(texts, np.repeat([0, 1], 60), ["en"] * 120)
    df = spark.createDataFrame([(0, None, "x"), (1, "", "x"), (2, "...", "x"), (3, "plain words, you awful lot", "x"), (4, "wort " * 40000, "x"), (4, "wort " * 40000, "x")], "doc_id long, text string, score string")
    got = sorted((r.doc_id, r.score, r.predicted) for r in toxicity.score(df, model).collect())
    assert [g[1:] for g in got[:3]] == [(0.0, 0)] * 3 and got[3][2] == 1 and got[4] == got[5]
    assert {r.score for r in toxicity.score(df, None).collect()} == {0.0}
    assert toxicity.train(texts[:60], np.zeros(60), ["en"] * 60) is None


def test_scores_against_plain_loops(spark):
    rng = np.random.default_rng(3)
    vocabulary = [f"w{k}" for k in range(60)]
    texts = [" ".join(rng.choice(vocabulary, rng.integers(1, 40))) + (" you awful lot" if k % 2 else " kind and good") for k in range(400)]
    langs = ["en" if k % 3 else "de" for k in range(400)]
    texts = [t + (" der die das" if l == "de" else " the and of") for t, l in zip(texts, langs)]
    model = toxicity.train(texts, np.arange(400) % 2, langs)
    odd = [*texts[:40], "one", "two words", "unknown things entirely here", "awful", "you awful lot " * 500, "", None, "...", "Ünïcode wörds you AWFUL lot"]
    got = {r.doc_id: (r.score, r.predicted) for r in toxicity.score(spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string"), model).collect()}
    for k, text in enumerate(odd):
        rows = [int(model.index[int(word_hashes([w])[0][0]) & (toxicity.BUCKETS - 1)]) for w in words(text)]
        logit = float(model.offset)
        for j, width in enumerate(toxicity.WIDTHS):
            for f in range(toxicity.FILTERS):
                best = None
                for at in range(len(rows) - width + 1):
                    value = sum(float(model.tables[width][step][rows[at + step]][f]) for step in range(width))
                    best = value if best is None or value > best else best
                pooled = max(0.0, best + float(model.bias[width][f])) if best is not None else 0.0
                logit += pooled * float(model.weights[j * toxicity.FILTERS + f])
        votes = [sum(float(model.lang_logp[r][l]) for r in rows) for l in range(model.lang_logp.shape[1])]
        logit += float(model.shifts[votes.index(max(votes))])
        want = 1 / (1 + np.exp(-min(30, max(-30, logit)))) if rows else 0.0
        assert got[k][0] == pytest.approx(want, abs=1e-4) and got[k][1] == (got[k][0] >= toxicity.CUT)
    assert toxicity.score(spark.createDataFrame([], "doc_id long, text string"), model).collect() == []


def test_languages_against_plain_compression(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    learned = langid.fit(docs.where("crc32(cast(doc_id as string)) % 4 <> 2"))
    assert all(len(d) <= langid.DICTIONARY_BYTES for d in learned.values())
    some = docs.where("doc_id % 9 = 0")
    got = {r.doc_id: r for r in langid.predict(some, learned).collect()}
    for d in some.collect():
        data, sizes = langid.normalised(d.text), {}
        for lang, content in learned.items():
            held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            pack = zstandard.ZstdCompressor(level=langid.LEVEL, dict_data=held, write_checksum=False, write_content_size=False, write_dict_id=False)
            sizes[lang] = sum(len(pack.compress(data[i : i + langid.BLOCK])) for i in range(0, len(data), langid.BLOCK))
        r, (first, second) = got[d.doc_id], sorted(sizes.values())[:2]
        if not data:
            assert (r.lang_pred, r.score, r.rejected) == ("und", 0.0, True)
            continue
        margin = (second - first) / second
        assert r.lang_pred == next(lang for lang in learned if sizes[lang] == first)
        assert r.score == pytest.approx(margin / (margin + 0.01)) and r.rejected == (margin < langid.MARGIN)
    tied = langid.predict(spark.createDataFrame([(1, "words of any kind")], "doc_id long, text string"), {"b": b"same", "a": b"same"}).first()
    assert (tied.lang_pred, tied.score, tied.rejected) == ("b", 0.0, True)
    assert langid.predict(docs.limit(0), learned).collect() == []


def test_dictionaries_take_any_place_of_a_text():
    text = " ".join("word" + "".join("abcdefghij"[int(d)] for d in f"{k:04}") for k in range(3000)).encode()
    cut = langid.pieces(text)
    places = [text.index(p) / len(text) for p in cut[:20]]
    assert min(places) < 0.3 and max(places) > 0.7
    assert sorted(b" ".join(cut).split()) == sorted(text.split()) and max(map(len, cut)) <= langid.PIECE


def test_columns_that_bear_a_results_name(spark, library):
    rows = [(1, "the dog and the cat", 0.5, "a", 7, True, "x"), (None, None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, SCORE double, Predicted string, lang_pred int, Contaminated boolean, Rejected string")
    learned = {"en": b"the cat and the dog sat on the mat with another " * 40, "de": b"der hund und die katze sassen auf einer matte " * 40}
    items = spark.createDataFrame([(1, "the dog and")], "item_id long, text string")
    for out, names in (
        (toxicity.score(df, None), ["doc_id", "text", "SCORE_given", "Predicted_given", "lang_pred", "Contaminated", "Rejected", "score", "predicted"]),
        (langid.predict(df, learned), ["doc_id", "text", "SCORE_given", "Predicted", "lang_pred_given", "Contaminated", "Rejected_given", "lang_pred", "score", "rejected"]),
        (decontaminate.flag(df, items), ["doc_id", "text", "SCORE", "Predicted", "lang_pred", "Contaminated_given", "Rejected", "contaminated"]),
    ):
        assert out.columns == names
        assert sorted((tuple(r)[:7] for r in out.collect()), key=repr) == sorted(rows, key=repr)
        assert columns_of(out, df).columns == df.columns


def test_stages_run_in_small_batches(spark):
    sf, before = "/root/testdata/sf0.001", _bounds(spark.range(1))
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert int(_bounds(stage(spark, docs, sf))[0]) == BATCH_BYTES
    assert _bounds(spark.range(1)) == before


def test_pipeline_against_brute_force(spark, library):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {r.doc_id: r for r in docs.collect()}
    train = docs.where("crc32(cast(doc_id as string)) % 4 <> 2")
    model = toxicity.fit(train, spark.read.parquet(f"{sf}/labels.parquet").where("crc32(cast(doc_id as string)) % 4 <> 2"))
    scores = model.score([r.text for r in kept.values()])
    kept = {k: r for (k, r), s in zip(kept.items(), scores) if s < 0.3}
    learned = langid.fit(spark.createDataFrame([r for r in kept.values() if not _out(r.doc_id)], docs.schema))
    made = langid.compressors(learned)

    def clear(text):
        data = langid.normalised(text)
        size = sorted(langid.sizes(data, made)) if data else [0, 0]
        return bool(data) and (size[1] - size[0]) / size[1] >= langid.MARGIN

    kept = {k: r for k, r in kept.items() if clear(r.text)}
    classes = _classes([(k, r.text) for k, r in kept.items()])
    kept = {k: r for k, r in kept.items() if classes[k] == k}
    items = [words(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    grams = [{tuple(w[i : i + 3]) for i in range(len(w) - 2)} for w in items]

    def copied(text):
        w = words(text)
        own = {tuple(w[i : i + 3]) for i in range(len(w) - 2)}
        return any(g & own and _score(i, w) >= 0.5 for i, g in zip(items, grams))

    kept = {k: r for k, r in kept.items() if not copied(r.text)}
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, sf).collect()}
    assert set(got) == set(kept)
    for k, r in kept.items():
        assert got[k].ids == library.encode_ordinary(r.text) and got[k].n_tokens == len(got[k].ids)
