"""Archive, token files, Merkle trees and licences against brute force on small tables."""

import base64
import hashlib
import io
import random
import re
import textwrap
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

from lumenplane.llm import common, licenses, merkle, tokenfile, warc
from lumenplane.llm.common import work_dir

DOCS = "doc_id long, text string, lang string, score double"
ODD = [(5, "Same text, here.\nAnd more of it.", "en", 0.5), (3, None, None, None), (9, "", "en", 1.0), (7, "Same text, here.\nAnd more of it.", "en", 0.5), (7, "Same text, here.\nAnd more of it.", "en", 0.5), (None, "é 🙂 naïve  café\x1c!", "fr", 0.1), (12, "wort " * 4000, "de", 0.2), (1, "I'll <|endoftext|> don't　x", "en", 0.0)]


@pytest.mark.parametrize("hot", [100_000, 1])
def test_archive_against_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(common, "HOT_ROWS", hot)
    pages = [(1, "http://a", "<p>x"), (2, "http://b", "<p>x"), (3, "http://c", None), (4, "http://d", ""), (5, "http://e\r\n", "é" * 9), (5, "http://e\r\n", "é" * 9), (6, None, "<p>x"), (7, "u", "long " * 20000), (None, "n", "<p>x"), (8, "two", "one of"), (8, "two", "two of")]
    df = spark.createDataFrame([(*p, "clash", 1) for p in pages], "page_id long, url string, html string, digest string, Payload int")
    for least in (0, 5):
        path = f"{work_dir(spark)}/a"
        warc.write_archive(df, path, least)
        got = Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, r.verified) for r in warc.read_records(spark, path).collect())
        want = Counter()
        for i, _, html in pages:
            raw = (html or "").encode()
            same = [j for j, _, h in pages if (h or "").encode() == raw and j is not None]
            first = max(same) if len(raw) >= least else i
            want[i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if i == first else "revisit", None if i == first else first, True] += 1
        assert got == want
        assert spark.read.parquet(f"{path}/payloads").count() == 6
        records = [bytes(r.record) for r in warc.reconstruct(spark, path).collect()]
        assert len(records) == len(pages) and all(x.startswith(b"WARC/1.1\r\n") and x.endswith(b"\r\n\r\n") for x in records)
        assert any(x.partition(b"\r\n\r\n")[2] == b"long " * 20000 + b"\r\n\r\n" for x in records)


def test_damaged_payload_is_an_error(spark):
    path = f"{work_dir(spark)}/a"
    spark.createDataFrame([("0" * 64, bytearray(b"x"))], "digest string, payload binary").write.parquet(f"{path}/payloads")
    spark.createDataFrame([("0" * 64, bytearray(b"WARC/1.1\r\n\r\n"))], "digest string, header binary").write.parquet(f"{path}/headers")
    with pytest.raises(Exception, match="damaged payload"):
        warc.reconstruct(spark, path).collect()


def test_empty_tables(spark):
    path = f"{work_dir(spark)}/a"
    warc.write_archive(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.read_records(spark, path).collect() == []
    none = spark.createDataFrame([], DOCS)
    assert merkle.compare_edits(none).collect() == []
    assert licenses.scan(none).collect() == []
    folder = f"{work_dir(spark)}/t"
    tokenfile.write(none, P.path("word_bpe_49k.json"), folder, 1)
    assert tokenfile.read(spark, folder).collect() == []


def test_token_files_round_trip(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    odd = [(4, "an <|endoftext|> and<|startoftext|>x", "en", 0.0), (4, "v\x0bt\x0cf\x1cs\x85n\u00a0b\u3000i", "en", 0.0), (4, "e \u0301 a\u0308 o\n\u0308", "en", 0.0), (-(1 << 63), "least", "en", 0.0)]
    for rows in (ODD, [*ODD, *odd]):
        folder = f"{work_dir(spark)}/t"
        tokenfile.write(spark.createDataFrame(rows, DOCS), P.path("word_bpe_49k.json"), folder, 1)
        got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in tokenfile.read(spark, folder).collect())
        start, want = 0, []
        for i, text, *_ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
            ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
            want.append((start, i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            start += len(ids)
        assert got == want
    assert t.encode("<|endoftext|>", add_special_tokens=False).ids == [49407]


def test_pieces_are_encoded_as_the_library_encodes_texts():
    from tokenizers import Tokenizer

    definition = Path(P.path("word_bpe_49k.json")).read_text("utf-8")
    coder, t, rng = tokenfile.Encoder(definition), Tokenizer.from_str(definition), random.Random(12)
    letters = "ab C'sé\u0301\u0308\u1100\u1161ßİ日本\n\t\x0b\x0c\x1c\x85\xa0\u2009\u3000.,!0123 ' 're <|endoftext|>🙂\0"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(40))) for _ in range(3000)]
    got = coder.encode(pa.array(texts))
    for text, ids in zip(texts, got):
        assert ids.tolist() == t.encode(text, add_special_tokens=False).ids, repr(text)


def test_one_id_of_many_rows_is_dealt_to_many_files(spark):
    df = spark.range(4000).selectExpr("cast(null as long) as doc_id", "concat('text ', id % 900) as text").repartition(4)
    folder = f"{work_dir(spark)}/t"
    tokenfile.write(df, P.path("word_bpe_49k.json"), folder, 1)
    files = spark.read.format("binaryFile").load(folder).where("length > 0").collect()
    assert len(files) > 8
    read = [[i for k in range(len(r.table)) for i, _ in r.frame(k)] for r in (tokenfile.Reader(io.BytesIO(f.content)) for f in files)]
    assert sum(map(len, read)) == 4000 and max(map(len, read)) < 1000 and {i for ids in read for i in ids} == {None}


def test_reader_takes_only_the_frames_asked_for(monkeypatch):
    monkeypatch.setattr(tokenfile, "FRAME_TOKENS", 8)
    writer = tokenfile.Writer()
    docs = [(i // 2 if i else None, np.arange(i % 5 + 1, dtype="<u4")) for i in range(40)]
    frames = [f for i, ids in docs if (f := writer.add(i, ids))] + writer.end()
    out = io.BytesIO(b"".join(f + tokenfile.BETWEEN for f in frames))
    reader = tokenfile.Reader(out)
    assert len(reader.table) > 5
    for i in range(20):
        assert [x.tolist() for x in reader.document(i)] == [ids.tolist() for d, ids in docs if d == i]
    whole = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(out.getvalue()), read_across_frames=True).read()
    assert len(whole) == sum(4 + 13 * len(reader.frame(k)) + 4 * reader.table[k][2] for k in range(len(reader.table)))
    broken = bytearray(out.getvalue())
    broken[reader.table[1][0] + 12] ^= 0xFF
    reader = tokenfile.Reader(io.BytesIO(bytes(broken)))
    assert reader.frame(0)
    with pytest.raises(Exception):
        reader.frame(1)


def test_licences_wrapped_anywhere(spark):
    mit = dict(licenses.KNOWN[:1])["MIT"]
    apache = (Path(licenses.__file__).parent / "texts" / "Apache-2.0.txt").read_text()
    docs = [(w, "Copyright 2019-2021 A. Body and others\n" + textwrap.fill(mit, w)) for w in range(40, 130)]
    docs += [(1000 + w, "\n\n".join(textwrap.fill(" ".join(p.split()), w) for p in apache.split("\n\n"))) for w in (60, 78, 100)]
    docs += [(2000, "Released under the MIT licence licence."), (2001, "© 2020 B\nReleased under the\tMIT -- Licence"), (2002, "released under the mit license")] * 2
    rows = licenses.scan(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    got = {r.doc_id: (r.license, r.line_licenses) for r in rows}
    assert len(rows) == len(docs)
    assert {got[w][0] for w in range(40, 130)} == {"MIT"} and {got[1000 + w][0] for w in (60, 78, 100)} == {"Apache-2.0"}
    assert got[2000] == (None, "") and got[2001] == ("MIT", "MIT") and got[2002] == ("MIT", "MIT")


def test_every_known_text_holds_a_needle(spark):
    words = licenses.needles(licenses.KNOWN)
    assert len(words) < 20 and all(any(w in text.lower() for w in words) for _, text in licenses.KNOWN)
    for old, new in licenses.SPELLINGS:
        assert all(any(w in text.lower().replace(new, old) for w in words) for _, text in licenses.KNOWN)


def _sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def _leaves(text):
    return [[_sha(x) for x in re.split(f"(?<=[.,;:!?|#%$&*d][ \t])|(?<={merkle.WIDE})|\x1e", line)] for line in text.split("\n")]


def _nodes(text):
    return [_sha(" ".join(x)) for x in _leaves(text)]


def _fingerprint(text):
    groups, now = [], []
    for p in _nodes(text):
        now.append(p)
        if p[0] in "0123":
            groups.append(now)
            now = []
    groups += [now] if now else []
    return _sha(" ".join(_sha(" ".join(g)) for g in groups))


def _likeness(a, b):
    a, b = ({x for line in _leaves(t) for x in line} for t in (a, b))
    return len(a & b) / len(a | b)


def test_merkle_against_brute_force(spark):
    chinese = "".join("天地玄黄宇宙洪荒日月盈昃辰宿列张寒来暑往秋收冬藏的了是在不一有人这和"[(7 * i * i + i) % 34] for i in range(900))
    docs = [*ODD, *((100 + i, "\n".join(f"Line {j * (i % 3)}, of {i}. Word and word" for j in range(i)), "en", 0.0) for i in range(30)), (200, chinese, "zh", 0.0), (199, chinese[:450] + "改" + chinese[450:], "zh", 0.0), (198, "x" * 3000, "", 0.0), (197, "a. b  d c,\td \u3002d d d x, y", "", 0.0), (196, "a plain line of words without an end of any phrase", "", 0.0)]
    extra = spark.createDataFrame([(*d, "clash", 1) for d in docs], DOCS + ", fingerprint string, H int")
    found = merkle.compare_edits(extra).collect()
    rows = {(r.doc_id, r.n_chars, r.fingerprint): r for r in found}
    texts = {i: t or "" for i, t, *_ in docs}
    order = sorted(texts, key=lambda i: -1 if i is None else i, reverse=True)
    assert len(rows) == len(order) and len(found) == len(docs)
    for i, j in zip(order, [*order[1:], order[0]]):
        text, n = texts[i], len(texts[i])
        edited = text[: n - n // 3] + texts[j][: n // 3]
        r = rows[i, n, _fingerprint(text)]
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and r.edited_fingerprint == _fingerprint(edited)
        assert (r.near_next, r.near_edited) == (_likeness(text, texts[j]), _likeness(text, edited))
        assert (r.near_next == 1.0) >= (text == texts[j])
        assert (r.fingerprint == r.edited_fingerprint) == (text == edited)
        nodes, after = _nodes(text), set(_nodes(edited))
        lost = [k for k, x in enumerate(nodes) if x not in after]
        assert (r.n_differing, r.first_differing) == (len({nodes[k] for k in lost}), lost[0] if lost else None)
        assert texts[i] != chinese or r.near_edited > 0.3 and r.near_next > 0.8


def test_differing_branches(spark):
    a, b = "one\ntwo\nthree\nfour", "one\ntwo!\nthree\nfour"
    nodes = lambda c: merkle.paragraphs(merkle.leaves(F.col(c)))
    row = spark.createDataFrame([(a, b)], "a string, b string").select(merkle.differing(nodes("a"), nodes("b")).alias("d"), nodes("a").alias("all")).first()
    assert row.d == [row.all[1]]
    spaces = spark.createDataFrame([("a, b",), ("a,  b",), ("a,\tb",), ("a, \x1eb",), ("a,\x1e b",)], "text string")
    assert merkle.tree(spaces).select("fingerprint").distinct().count() == 5
    assert merkle.tree(spark.createDataFrame([("plain words only",)], "text string")).first().leaves == [[_sha("plain words only")]]


def test_licences(spark):
    mit = dict(licenses.KNOWN[:1])["MIT"]
    docs = [(1, "Copyright (c) 2020 A. Body\n" + mit.lower().replace("license", "licence"), "en", 0.0), (2, "Some words.\nReleased under the MIT Licence.\nLicensed under CC-BY-NC 4.0", "en", 0.0), (3, None, None, None), (4, " ... ", "", 0.0), (5, "released under the mit license", "en", 0.0), (5, "released under the mit license", "en", 0.0), (6, "not released under the mit license", "en", 0.0), (None, "word " * 30000, "en", 0.0)]
    got = sorted(((r.doc_id or 0, r.license, r.line_licenses, r.text_digest is None) for r in licenses.scan(spark.createDataFrame(docs, DOCS)).collect()))
    assert got == [(0, None, "", False), (1, "MIT", "MIT", False), (2, None, "CC-BY-NC-4.0,MIT", False), (3, None, "", True), (4, None, "", True), (5, "MIT", "MIT", False), (5, "MIT", "MIT", False), (6, None, "", False)]


def test_licence_files(spark):
    notice = "Copyright (c) 2021 A. Body\n"
    folder = Path(licenses.__file__).parent / "texts"
    text = lambda name: (folder / f"{name}.txt").read_text()
    mit, isc = (dict(licenses.KNOWN[:2])[k] for k in ("MIT", "ISC"))
    wtfpl = "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE\nVersion 2, December 2004\n\nCopyright (C) 2004 Sam Hocevar <sam@hocevar.net>\n\nEveryone is permitted to copy and distribute verbatim or modified\ncopies of this license document, and changing it is allowed as long\nas the name is changed.\n\nDO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE\nTERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION\n\n0. You just DO WHAT THE FUCK YOU WANT TO.\n"
    files = [("MIT", f"MIT License\n\n{notice}\n{textwrap.fill(mit, 78)}\n"), ("ISC", f"ISC License\n\n{notice}\n{textwrap.fill(isc, 70)}\n"), ("WTFPL", wtfpl)]
    files += [(f"BSD-{n}-Clause", f"BSD {n}-Clause License\n\n{notice}All rights reserved.\n\n" + text(f"BSD-{n}-Clause")) for n in (2, 3)]
    titles = {"Apache-2.0": "Apache License\nVersion 2.0, January 2004\nhttp://www.apache.org/licenses/", "GPL-2.0-only": "GNU GENERAL PUBLIC LICENSE\nVersion 2, June 1991", "GPL-3.0-only": "GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007", "LGPL-2.1-only": "GNU LESSER GENERAL PUBLIC LICENSE\nVersion 2.1, February 1999", "LGPL-3.0-only": "GNU LESSER GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007", "MPL-2.0": "Mozilla Public License Version 2.0\n====", "CC0-1.0": "Creative Commons Legal Code\n\nCC0 1.0 Universal"}
    files += [(name, f"    {title}\n\n{text(name)}") for name, title in titles.items()]
    files += [(name, text(name)) for name in (*titles, "Unlicense")]
    files += [(name, t[: t.index("END OF TERMS AND CONDITIONS") + 28]) for name in ("Apache-2.0", "GPL-2.0-only", "GPL-3.0-only") for t in [text(name)]]
    got = {r.doc_id: r.license for r in licenses.scan(spark.createDataFrame(list(enumerate(t for _, t in files)), "doc_id long, text string")).collect()}
    assert [got[i] for i in range(len(files))] == [name for name, _ in files]
    parts = licenses.known(spark).collect()
    assert len({r.digest for r in parts}) == len(parts)  # no text of two licences
