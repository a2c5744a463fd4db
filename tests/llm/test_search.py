"""Near duplicates, decontamination and chat linking against brute force on small tables."""

import json
import random
from collections import Counter

import numpy as np

from lumenplane.llm import bagminhash, chat, decontaminate
from lumenplane.llm.common import word_hashes, words

DOCS = "doc_id long, text string, k string"


def test_word_hashes_are_those_of_the_words():
    texts = ["Hello, wOrld! é1 x", "", None, "a" * 100 + " b " + "ñ" * 70, "...", "one two one", "x" * 64 + " " + "x" * 65]
    hashes, bounds, first, last = word_hashes(texts)
    seen = {}
    for i, text in enumerate(texts):
        raw = (text or "").lower().encode()
        assert [raw[a:b].decode() for a, b in zip(first[bounds[i] : bounds[i + 1]], last[bounds[i] : bounds[i + 1]])] == words(text)
        for j, word in enumerate(words(text)):
            assert seen.setdefault(word, hashes[bounds[i] + j]) == hashes[bounds[i] + j]
    assert len(set(seen.values())) == len(seen)


def _bag(text):
    w = words(text)
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def _similarity(a, b):
    both = sum((a & b).values())
    return both / max(1, sum(a.values()) + sum(b.values()) - both)


def _classes(rows):
    head = {k: k for k, _ in rows}

    def find(k):
        while head[k] != k:
            k = head[k]
        return k

    bags = {k: _bag(t) for k, t in rows}
    for k in bags:
        for j in bags:
            if j < k and _similarity(bags[k], bags[j]) >= 0.8:
                a, b = sorted((find(k), find(j)))
                head[b] = a
    return {k: find(k) for k in bags}


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(3000)}"
    rows, base = [], [word() for _ in range(200)]
    shared = [word() for _ in range(60)]
    for i in range(60):  # copies of one text whose edits differ: only some pairs are near
        copy = list(base)
        for _ in range(rng.randrange(12)):
            copy[rng.randrange(200)] = word()
        rows.append((i, " ".join(copy)))
    for i in range(60, 100):  # one passage in many texts
        rows.append((i, " ".join([word() for _ in range(120)] + shared)))
    rows += [(i, "again and again " * 300 + "x" * (i % 3)) for i in range(100, 106)]
    rows += [(106, ""), (107, None), (108, "..."), (109, "two words"), (110, "Two, words!"), (111, "one two three four five"), (112, "word " * 20000)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], DOCS).repartition(7)
    got = dict(map(tuple, bagminhash.classes(df).collect()))
    assert got == _classes(rows)
    doubled = bagminhash.classes(df.unionAll(df).unionAll(spark.createDataFrame([(None, "two words", "")], DOCS))).collect()
    assert Counter((r.doc_id, r.class_id) for r in doubled if r.doc_id is not None) == Counter({p: 2 for p in got.items()})
    assert bagminhash.classes(df.limit(0)).collect() == []


def test_near_duplicates_with_repeated_and_null_ids(spark):
    rng = random.Random(6)
    texts, bases = [], [[f"w{rng.randrange(3000)}" for _ in range(150)] for _ in range(8)]
    for base in bases:
        for i in range(4):
            copy = list(base)
            copy[i * 30] = "edited"
            texts.append(" ".join(copy))
    ids = [None if i % 4 == 3 or i < 4 else i % 5 for i in range(len(texts))]  # five ids for many texts, and none
    rows = [(k, t, "clash") for k, t in zip(ids, texts)] + [(0, "", ""), (0, None, ""), (7, "", "")]
    df = spark.createDataFrame(rows + rows[3:9], DOCS).repartition(5)
    groups = [range(4 * g, 4 * g + 4) for g in range(len(bases))]
    assert all(_similarity(_bag(texts[g[0]]), _bag(texts[j])) >= 0.8 for g in groups for j in g)
    want = Counter((ids[i], min((ids[j] for j in g if ids[j] is not None), default=None)) for g in groups for i in g for _ in range(2 if 3 <= i < 9 else 1))
    got = Counter((r.doc_id, r.class_id) for r in bagminhash.classes(df).collect())
    assert got == want + Counter({(0, 0): 2, (7, 7): 1})
    kept = bagminhash.representatives(df)
    assert kept.columns == df.columns
    kept = [(r.doc_id, r.text) for r in kept.collect()]
    assert Counter(texts.index(t) // 4 for _, t in kept if t) == Counter(range(len(bases)))
    for k, t in kept:
        assert not t or k == min((ids[j] for j in groups[texts.index(t) // 4] if ids[j] is not None), default=None)
    assert sorted(map(repr, (x for x in kept if not x[1]))) == sorted(map(repr, [(0, ""), (0, None), (7, "")]))


def test_values_agree_as_often_as_bags_overlap():
    rng, errors = random.Random(5), []
    for n, times, edits in ((60, 1, 5), (300, 1, 30), (8, 40, 40), (5, 3, 1)):
        for _ in range(6):
            a = [f"w{rng.randrange(10**6)}" for _ in range(n)] * times
            b = list(a)
            for _ in range(edits):
                b[rng.randrange(len(b))] = f"x{rng.randrange(10**6)}"
            bags = bagminhash.bags([" ".join(a), " ".join(b)])
            values = bagminhash.signatures(*bags, 2)
            errors.append((values[0] == values[1]).mean() - _similarity(_bag(" ".join(a)), _bag(" ".join(b))))
    assert abs(np.mean(errors)) < 0.03 and max(map(abs, errors)) < 0.2


def _score(item, passage):
    rows, best = [0] * (len(passage) + 1), 0
    for x in item:
        new = [0]
        for j, y in enumerate(passage):
            new.append(max(0, rows[j] + (2 if x == y else -1), rows[j + 1] - 1, new[j] - 1))
        rows, best = new, max(best, *new)
    return best / (2 * len(item))


def test_decontamination_against_brute_force(spark):
    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(2000)}"
    items = [(i, " ".join(word() for _ in range(20 + i))) for i in range(25)] + [(40, "short one"), (41, ""), (42, None), (43, "short one")]
    docs = []
    for i in range(60):
        text = [word() for _ in range(rng.randrange(150))]
        for _ in range(rng.randrange(3)):
            copy = words(items[rng.randrange(25)][1])
            for _ in range(rng.randrange(5)):
                copy[rng.randrange(len(copy))] = word()
            if rng.random() < 0.3:
                del copy[7:9]
            text[len(text) // 2 : len(text) // 2] = copy
        docs.append((i, " ".join(text)))
    docs += [(60, None), (61, ""), (62, "a short one, here"), (63, " ".join(word() for _ in range(40000)) + " " + items[3][1])]
    frame = spark.createDataFrame([(*d, "clash") for d in docs], DOCS).repartition(5)
    got = {(r.doc_id, r.item_id): round(r.score, 9) for r in decontaminate.contaminated(frame, spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = {}
    for d, text in docs[:-1]:
        for i, item in items:
            if words(item) and words(text) and (s := _score(words(item), words(text))) >= 0.5:
                want[d, i] = round(s, 9)
    assert got.pop((63, 3)) == 1.0
    assert {k: v for k, v in got.items() if k[0] != 63} == want
    assert decontaminate.contaminated(frame.limit(0), spark.createDataFrame(items, "item_id long, text string")).collect() == []
    assert decontaminate.contaminated(frame, spark.createDataFrame([], "item_id long, text string")).collect() == []


def test_decontamination_by_a_small_benchmark(spark):
    rng = random.Random(9)
    items = [(i, " ".join(f"w{60 * i + k}" for k in range(36))) for i in range(3)]
    common = [(3, " ".join(f"w{rng.randrange(6)}" for _ in range(40)))]  # common words only
    other = lambda n: [f"x{rng.randrange(500)}" for _ in range(n)]
    docs = [(i, " ".join([*other(50), *words(text)[len(words(text)) // 3 :], *other(50)])) for i, text in items + common]
    spread = [w for k, word in enumerate(words(items[0][1])) for w in ((word,) if k < 3 else (f"y{k}", word))]
    docs += [(10, " ".join(other(20) + spread + other(20))), (11, " ".join(other(150)))]  # a word put in behind each but three
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    for asked in (items, items + common):
        got = {(r.doc_id, r.item_id): round(r.score, 9) for r in decontaminate.contaminated(frame, spark.createDataFrame(asked, "item_id long, text string")).collect()}
        want = {(d, i): round(s, 9) for d, text in docs for i, item in asked if (s := _score(words(item), words(text))) >= 0.5}
        assert got == want and len(got) == len(asked) + 1


def test_decontamination_by_edit_rate(spark):
    """Of the pairs that reach 0.5 by a full alignment, nine in ten are found at any rate of edits (words replaced, left out, put in)."""
    rng = random.Random(21)
    word = lambda: f"w{rng.randrange(3000)}"
    items = [(i, " ".join(word() for _ in range(30))) for i in range(12)]
    docs, rates = [], (0.0, 0.1, 0.2, 0.3, 0.4)
    for r, rate in enumerate(rates):
        for k in range(48):
            copy = []
            for w in words(items[k % 12][1]):
                x = rng.random()
                copy += [w] if x >= rate else [[word()], [], [word(), w]][rng.randrange(3)]
            docs.append((r * 100 + k, " ".join([*(word() for _ in range(20)), *copy, *(word() for _ in range(20))])))
    found = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    for r, rate in enumerate(rates):
        want = {(d, i) for d, text in docs if d // 100 == r for i, item in items if _score(words(item), words(text)) >= 0.5}
        assert len(want) >= (48 if rate <= 0.2 else 1) and len(found & want) >= 0.9 * len(want), (rate, len(want), len(found & want))
    assert found <= {(d, i) for d, text in docs for i, item in items if _score(words(item), words(text)) >= 0.5}


def test_decontamination_of_odd_rows_and_in_blocks(spark, monkeypatch):
    items = spark.createDataFrame([(k, f"alpha beta gamma delta item{k} and its end", 1) for k in range(5)] + [(None, "lone words of no id", 1)], "item_id long, text string, score int")
    rows = [(None, "say alpha beta gamma delta item3 and its end now"), (7, "alpha beta gamma delta item1 and its end, alpha beta gamma delta item1 and its end"), (7, "alpha beta gamma delta item1 and its end, alpha beta gamma delta item1 and its end"), (8, "lone words of no id")]
    df = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, Score double")
    whole = sorted(map(tuple, decontaminate.contaminated(df, items, 0.9).collect()), key=repr)
    assert [r[:3] for r in whole] == [(7, 1, 1.0), (7, 1, 1.0), (8, None, 1.0), (None, 3, 1.0)] and whole[0][3] == 8  # the first on a tie
    flags = sorted((r.text, r.contaminated) for r in decontaminate.flag(df, items, 0.9).collect())
    assert [f for _, f in flags] == [True] * 4
    monkeypatch.setattr(decontaminate, "BLOCK_ITEMS", 2)
    assert sorted(map(tuple, decontaminate.contaminated(df, items, 0.9).collect()), key=repr) == whole
    assert sorted((r.text, r.contaminated) for r in decontaminate.flag(df, items, 0.9).collect()) == flags


def test_tool_calls_are_linked(spark):
    call = lambda *calls: json.dumps({"content": "let me see", "tool_calls": [{"id": i, "name": n, "arguments": a} for i, n, a in calls]})
    answer = lambda i, c: json.dumps({"tool_call_id": i, "content": c})
    rows = [
        (1, 0, "user", 'quote " and \\ \n line', 0), (1, 1, "tool", answer("a", "early"), 0), (1, 2, "assistant", call(("a", "search", {"query": "x", "limit": 3}), ("b", "weather", {"celsius": True})), 0),
        (1, 3, "tool", answer("b", "rain"), 0), (1, 4, "tool", answer("zz", "lost"), 0), (1, 5, "assistant", call(("c", "search", {"query": "q", "limit": "many"}), ("d", "fly", {})), 0),
        (2, 0, None, None, 0), (2, 1, "assistant", "{not json", 0), (2, 1, "assistant", "{not json", 0), (None, None, "user", "", 0), (3, 0, "user", "word " * 30000, 0),
    ]
    got = {(r.conv_id, r.turn): r for r in chat.link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, m int")).collect()}
    assert len(got) == 10
    for r in got.values():
        m = json.loads(r.message)
        assert r.message == json.dumps(m, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    assert json.loads(got[1, 0].message) == {"content": 'quote " and \\ \n line', "role": "user"}
    assert (got[1, 1].order_turn, got[1, 1].order_step, got[1, 1].call_turn, got[1, 1].valid) == (2, 1, 2, True)
    assert (got[1, 2].n_calls, got[1, 2].valid, got[1, 2].problem) == (2, False, "missing argument of weather")
    assert json.loads(got[1, 2].message)["tool_calls"][0] == {"arguments": {"limit": 3, "query": "x"}, "id": "a", "name": "search"}
    assert (got[1, 3].order_turn, got[1, 3].order_step) == (3, 0) and got[1, 4].problem == "result without a call"
    assert got[1, 5].problem == "unknown tool fly; wrong argument of search"
    assert json.loads(got[2, 1].message)["content"] == "{not json" and json.loads(got[2, 0].message) == {"content": "", "role": ""}


def _problem(calls):
    fields = {"search": {"query": str, "limit": int}, "weather": {"city": str, "celsius": bool}, "calculate": {"expression": str}}
    needed, found = {"search": "query", "weather": "city", "calculate": "expression"}, set()
    for c in calls:
        name, args = c.get("name"), c.get("arguments") or {}
        if c.get("id") is None:
            found.add("call without an id")
        if name not in fields:
            found.add(f"unknown tool {name or ''}")
        elif args.get(needed[name]) is None:
            found.add(f"missing argument of {name}")
        elif any(type(v) is not fields[name].get(k) or v == "" for k, v in args.items()):
            found.add(f"wrong argument of {name}")
    return "; ".join(sorted(found))


def test_calls_are_checked_against_brute_force(spark):
    values = ["x", "3", "true", "", "2020-01-01", 3, -4, 10**25, 2.5, 3.0, True, False, None, [1], [], {"a": 1}, {}]
    asked = [("search", lambda v: {"query": v}), ("search", lambda v: {"query": "q", "limit": v}), ("weather", lambda v: {"city": "c", "celsius": v}), ("calculate", lambda v: {"expression": "1", "other": v})]
    made = [[{"id": f"{k}", "name": name, "arguments": f(v)}] for k, v in enumerate(values) for name, f in asked]
    bare = {"id": None, "name": "search", "arguments": {"query": "lost"}}
    made += [[bare], [{"name": "calculate", "arguments": {"expression": "1+1"}}], [bare, {"id": "z", "name": "weather", "arguments": {"city": "c"}}], [{"id": None, "name": "fly"}, bare], [{"id": "y", "name": "search"}]]
    rows = [(k, 0, "assistant", json.dumps({"content": "", "tool_calls": calls})) for k, calls in enumerate(made)]
    rows.append((len(made) - 5, 1, "tool", json.dumps({"tool_call_id": None, "content": "nothing"})))
    got = {(r.conv_id, r.turn): r for r in chat.link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    for k, calls in enumerate(made):
        r = got[k, 0]
        assert (r.n_calls, r.problem, r.valid) == (len(calls), _problem(calls), not _problem(calls)), calls
        sent = json.loads(r.message)["tool_calls"]
        assert [(c["id"], c["name"], c["arguments"]) for c in sent] == [(c.get("id"), c["name"], c.get("arguments", {})) for c in calls]
        assert all(type(c["arguments"][k]) is type(v) or v == 3 for c, d in zip(sent, calls) for k, v in d.get("arguments", {}).items())
    assert got[len(made) - 5, 1].call_turn is None and len(got) == len(rows)


def test_schemas_of_nested_arguments(spark):
    schemas = {"book": {"type": "object", "required": ["seats"], "additionalProperties": False, "properties": {
        "seats": {"type": "array", "items": {"type": "object", "required": ["row"], "properties": {"row": {"type": "integer", "minimum": 1, "maximum": 40}, "side": {"enum": ["left", "right", None]}}}},
        "note": {"type": ["string", "null"], "maxLength": 3, "pattern": "^a"}, "price": {"type": "number", "minimum": 0},
    }}}
    good = [{"seats": []}, {"seats": [{"row": 3, "side": "left"}, {"row": 40, "x": [1]}]}, {"seats": [{"row": 1, "side": None}], "note": "abc", "price": 0.5}, {"seats": [], "note": None, "price": 3}]
    bad = [{"seats": [{"row": 0}]}, {"seats": [{"row": 3}, {}]}, {"seats": [{"row": "3"}]}, {"seats": [{"row": 2.0}]}, {"seats": {}}, {"seats": [1]}, {"seats": [{"row": 2, "side": "up"}]}, {"seats": [], "note": "abcd"}, {"seats": [], "note": "b"}, {"seats": [], "price": -1}, {"seats": [], "other": 1}, "text", [1]]
    rows = [(k, 0, "assistant", json.dumps({"tool_calls": [{"id": "i", "name": "book", "arguments": a}]})) for k, a in enumerate(good + bad)]
    rows += [(100, 0, "assistant", '{"tool_calls": [{"id": 7, "name": "book", "arguments": {"seats": [{"row": 1, "k": "q\\u001f\\u000B\\\\u000B \\u00e9\\/"}]}}]}'), (101, 0, "assistant", '{"content": "a", "content": "b"}'), (102, 0, "assistant", '{"tool_calls": 3}')]
    got = {r.conv_id: r for r in chat.link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), schemas).collect()}
    assert [got[k].problem for k in range(len(good + bad))] == [""] * len(good) + ["wrong argument of book"] * len(bad)
    for r in got.values():
        assert r.message == json.dumps(json.loads(r.message), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    assert json.loads(got[100].message)["tool_calls"][0] == {"id": "7", "name": "book", "arguments": {"seats": [{"row": 1, "k": "q\x1f\x0b\\u000B é/"}]}}
    assert json.loads(got[101].message)["content"] == '{"content": "a", "content": "b"}' and got[102].n_calls == 0


def test_order_of_results_and_ties(spark):
    call = lambda i: json.dumps({"tool_calls": [{"id": i, "name": "calculate", "arguments": {"expression": "1"}}]})
    rows = [(1, 0, "tool", json.dumps({"tool_call_id": "a", "content": str(k)})) if k < 0 else (1, k, "tool", json.dumps({"tool_call_id": "a", "content": str(k)})) for k in range(3)]
    rows += [(1, 5, "assistant", call("a")), (1, 7, "assistant", call("a")), (1, 8, "tool", json.dumps({"tool_call_id": "a", "content": "8"})), (None, 1, "assistant", call("a")), (None, 2, "tool", json.dumps({"tool_call_id": "a", "content": "x"}))]
    df = spark.createDataFrame([(*r, 1, "clash") for r in rows], "conv_id long, turn long, role string, text string, n_calls int, Message string")
    got = sorted((r.order_turn, r.order_step, r.turn, r.call_turn) for r in chat.link(df).where("conv_id = 1").collect())
    assert got == [(5, 0, 5, None), (5, 1, 0, 5), (5, 1, 1, 5), (5, 1, 2, 5), (7, 0, 7, None), (8, 0, 8, 5)]
    lone = {r.turn: r for r in chat.link(df).where("conv_id is null").collect()}
    assert lone[2].problem == "result without a call" and lone[1].valid
    assert chat.link(df.unionAll(df)).count() == 2 * len(rows)
    assert chat.link(df.limit(0)).collect() == []


def test_classes_compared_in_full_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(bagminhash, "ROUNDS", 0)  # no hubs: blocks find every link
    monkeypatch.setattr(bagminhash, "BLOCK", 8)
    rng = random.Random(4)
    word = lambda: f"w{rng.randrange(3000)}"
    base, rows = [word() for _ in range(200)], []
    for i in range(50):
        copy = list(base)
        for _ in range(rng.randrange(12)):
            copy[rng.randrange(200)] = word()
        rows.append((i, " ".join(copy)))
    got = dict(map(tuple, bagminhash.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert got == _classes(rows)
