"""The registered queries of the training-data operators, thin over their operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenplane.llm import bagminhash, bpe, chat, decontaminate, langid, licenses, merkle, tokenfile, toxicity, warc
from lumenplane.llm.common import frugal, held_out, table, work_dir

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    path = P.path("byte_bpe_multi_50k.tiktoken")
    docs = table(frugal(spark), sf_dir, "documents").select("doc_id", "text")
    encoded = bpe.encode(docs, path, P.PATTERN, keep=["doc_id"])
    return bpe.decode(encoded, path).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


@query
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").where(~held_out())
    model = toxicity.fit(docs.where(~held_out()), labels)
    scored = toxicity.score(docs.select("doc_id", "text", held_out().alias("held_out")), model)
    return scored.select("doc_id", "held_out", "score", "predicted")


@query
def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    learned = langid.fit(docs.where(~held_out()))
    found = langid.predict(docs.select("doc_id", "text", held_out().alias("held_out")), learned)
    return found.select("doc_id", "held_out", "lang_pred", "score", "rejected")


@query
def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{work_dir(spark)}/archive"
    warc.write_archive(table(spark, sf_dir, "pages"), path)
    return warc.read_records(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "verified")


@query
def op4_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.compare_edits(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op9_tokenfile(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    folder = f"{work_dir(spark)}/tokens"
    tokenfile.write(docs, P.path("word_bpe_49k.json"), folder, end_id=1)
    return tokenfile.read(spark, folder)


def with_tool_traffic(conversations: DataFrame) -> DataFrame:
    """conversations, and a twin of each (its id counted down from -1) that talks to tools.

    The table itself holds no call. In a twin every assistant's message becomes calls (tool and arguments
    by conversation and turn, some of them faulty, some without an id) and every user's message the result
    of the call a turn later or earlier; others stay.
    """
    turn, n, h = F.col("turn"), F.char_length(F.coalesce("text", F.lit(""))).cast("string"), F.md5(F.coalesce("text", F.lit("")))
    kind = F.pmod(F.col("conv_id") + turn, F.lit(6))
    q = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    asked = (
        F.when(kind == 0, q('"search","arguments":{"query":"', h, '","limit":', n, "}")).when(kind == 1, q('"search","arguments":{"query":"', h, '","limit":"', n, '"}'))
        .when(kind == 2, q('"weather","arguments":{"city":"', h, '","celsius":true}')).when(kind == 3, q('"weather","arguments":{"celsius":false}'))
        .when(kind == 4, q('"calculate","arguments":{"expression":"', h, '","depth":{"a":null,"b":[', n, ",1.5]}}")).otherwise(q('"fly","arguments":{}'))
    )
    more = F.when(turn % 5 == 3, q(',{"id":null,"name":"calculate","arguments":{"expression":"', h, '"}}')).otherwise("")
    call = q('{"tool_calls":[{"id":"c', turn.cast("string"), '","name":', asked, "}", more, '],"content":"', h, '"}')
    answer = q('{"tool_call_id":"c', (turn + F.when(F.col("conv_id") % 2 == 0, 1).otherwise(-1)).cast("string"), '","content":"', h, '"}')
    role = F.col("role")
    twin = conversations.select((-1 - F.col("conv_id")).alias("conv_id"), "turn", F.when(role == "user", "tool").otherwise(role).alias("role"), F.when(role == "assistant", call).when(role == "user", answer).otherwise(F.col("text")).alias("text"))
    return conversations.select("conv_id", "turn", "role", "text").unionAll(twin)


@query
def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.link(with_tool_traffic(table(spark, sf_dir, "conversations")))


@query
def op8_bagminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bagminhash.classes(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark")
    return decontaminate.contaminated(docs, items)


# --- SQL of the queries that SQL can express ---------------------------------------------------


def _base32_sql(digest: str) -> str:
    parts = " || ".join(f"lpad(to_base(CAST('0x' || substr({digest}, {i}, 5) AS BIGINT), 32), 4, '0')" for i in range(1, 41, 5))
    return f"translate({parts}, '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567')"


ORACLES["op3_warc"] = (
    "WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), f AS (SELECT page_id, h, max(page_id) OVER (PARTITION BY h) AS r, sha1(h) AS s FROM p) "
    f"SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes, {_base32_sql('s')} AS payload_digest, CASE WHEN page_id = r THEN 'response' ELSE 'revisit' END AS record_type, "
    "CASE WHEN page_id <> r THEN r END AS refers_to, true AS verified FROM f"
)


def _canonical_sql(text: str) -> str:
    out = f"' ' || trim(regexp_replace(regexp_replace(lower({text}), '{licenses._COPYRIGHT}', '', 'g'), '[^a-z0-9]+', '  ', 'g')) || ' '"
    for old, new in licenses.SPELLINGS:
        old, new = old.replace(" ", "  "), new.replace(" ", "  ")
        out = f"replace({out}, ' {old} ', ' {new} ')"
    return f"nullif(trim(replace({out}, '  ', ' ')), '')"


_KNOWN_SQL = ", ".join("('{}', '{}')".format(name, text.replace("'", "''")) for name, text in licenses.KNOWN)
ORACLES["op5_licenses"] = (
    f"WITH known AS (SELECT DISTINCT sha256({_canonical_sql('t')}) AS d, l FROM (VALUES {_KNOWN_SQL}) AS v(l, t)), docs AS (SELECT doc_id, text FROM documents), each AS (SELECT DISTINCT doc_id, text FROM documents), "
    f"lines AS (SELECT doc_id, text, sha256({_canonical_sql('line')}) AS d FROM (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line FROM each)), "
    "hits AS (SELECT doc_id, text, string_agg(DISTINCT l, ',' ORDER BY l) AS line_licenses FROM lines JOIN known USING (d) GROUP BY ALL) "
    f"SELECT docs.doc_id, sha256({_canonical_sql('docs.text')}) AS text_digest, known.l AS license, coalesce(hits.line_licenses, '') AS line_licenses FROM docs LEFT JOIN known ON known.d = sha256({_canonical_sql('docs.text')}) LEFT JOIN hits ON hits.doc_id = docs.doc_id AND hits.text = docs.text"
)

def _tree_sql(name: str, source: str) -> str:
    """Leaves, paragraphs' nodes, root and distinct leaves of a text, beside what `source` has."""
    cut = f"string_split(regexp_replace(p, '({merkle.MARKED}|{merkle.WIDE})', '\\1' || chr(30), 'g'), chr(30))"
    return (
        f"{name}_a AS (SELECT *, list_transform(string_split({source}, chr(10)), lambda p: list_transform({cut}, lambda x: sha256(x))) AS leaves FROM {{before}}), "
        f"{name}_b AS (SELECT *, list_transform(leaves, lambda x: sha256(array_to_string(x, ' '))) AS nodes FROM {name}_a), "
        f"{name}_c AS (SELECT *, list_transform(string_split(regexp_replace(array_to_string(nodes, ' ') || ' ', '((?:^|\\b)[0-3][0-9a-f]{{{{63}}}}) ', '\\1|', 'g'), '|'), lambda s: trim(s)) AS parts FROM {name}_b), "
        f"{name} AS (SELECT * EXCLUDE (leaves, nodes, parts), nodes AS {name}_nodes, list_distinct(flatten(leaves)) AS {name}_leaves, sha256(array_to_string(list_transform(list_filter(parts, lambda s: s <> ''), lambda s: sha256(s)), ' ')) AS {name}_root FROM {name}_c)"
    )


_LIKE_SQL = "len(list_intersect({a}, {b})) / CAST(len({a}) + len({b}) - len(list_intersect({a}, {b})) AS DOUBLE)"
ORACLES["op4_merkle"] = (
    "WITH base AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), "
    "near AS (SELECT doc_id, t, CAST(length(t) AS BIGINT) AS n, coalesce(lag(t) OVER (ORDER BY doc_id), last_value(t) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS other FROM base), "
    "edits AS (SELECT *, substr(t, 1, n - n // 3) || substr(other, 1, n // 3) AS edited FROM near), "
    + ", ".join(_tree_sql(name, source).format(before=before) for name, source, before in (("own", "t", "edits"), ("after", "edited", "own"), ("following", "other", "after")))
    + " SELECT doc_id, n AS n_chars, sha256(edited) AS edited_sha256, own_root AS fingerprint, after_root AS edited_fingerprint, "
    + _LIKE_SQL.format(a="own_leaves", b="after_leaves") + " AS near_edited, " + _LIKE_SQL.format(a="own_leaves", b="following_leaves") + " AS near_next, "
    "CAST(len(list_filter(list_distinct(own_nodes), lambda x: NOT list_contains(after_nodes, x))) AS INTEGER) AS n_differing, "
    "CAST(list_position(own_nodes, list_filter(own_nodes, lambda x: NOT list_contains(after_nodes, x))[1]) - 1 AS INTEGER) AS first_differing FROM following"
)


_TRAFFIC_SQL = (
    "base AS (SELECT conv_id, turn, role, text, CAST(length(coalesce(text, '')) AS VARCHAR) AS n, md5(coalesce(text, '')) AS h, (conv_id + turn) % 6 AS kind FROM conversations), "
    "rows AS (SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT -1 - conv_id, turn, CASE role WHEN 'user' THEN 'tool' ELSE role END, CASE role WHEN 'assistant' THEN "
    "'{\"tool_calls\":[{\"id\":\"c' || turn || '\",\"name\":' || CASE kind WHEN 0 THEN '\"search\",\"arguments\":{\"query\":\"' || h || '\",\"limit\":' || n || '}' WHEN 1 THEN '\"search\",\"arguments\":{\"query\":\"' || h || '\",\"limit\":\"' || n || '\"}' "
    "WHEN 2 THEN '\"weather\",\"arguments\":{\"city\":\"' || h || '\",\"celsius\":true}' WHEN 3 THEN '\"weather\",\"arguments\":{\"celsius\":false}' WHEN 4 THEN '\"calculate\",\"arguments\":{\"expression\":\"' || h || '\",\"depth\":{\"a\":null,\"b\":[' || n || ',1.5]}}' ELSE '\"fly\",\"arguments\":{}' END "
    "|| '}' || CASE WHEN turn % 5 = 3 THEN ',{\"id\":null,\"name\":\"calculate\",\"arguments\":{\"expression\":\"' || h || '\"}}' ELSE '' END || '],\"content\":\"' || h || '\"}' "
    "WHEN 'user' THEN '{\"tool_call_id\":\"c' || (turn + CASE WHEN conv_id % 2 = 0 THEN 1 ELSE -1 END) || '\",\"content\":\"' || h || '\"}' ELSE text END FROM base)"
)
_OWN = {"search": ("query", "limit"), "weather": ("city", "celsius"), "calculate": ("expression",)}
_FAULT_SQL = " ".join(
    f"WHEN c.name = '{tool}' AND coalesce(json_type(c.a, '$.{fields[0]}'), 'NULL') = 'NULL' THEN 'missing argument of {tool}' "
    f"WHEN c.name = '{tool}' AND (NOT list_has_all({list(fields)}, json_keys(c.a)) OR json_type(c.a, '$.{fields[0]}') <> 'VARCHAR' OR json_extract_string(c.a, '$.{fields[0]}') = '' OR {more}) THEN 'wrong argument of {tool}'"
    for (tool, fields), more in zip(_OWN.items(), ("coalesce(json_type(c.a, '$.limit') NOT IN ('UBIGINT', 'BIGINT', 'HUGEINT'), false)", "coalesce(json_type(c.a, '$.celsius') <> 'BOOLEAN', false)", "false"))
)
ORACLES["op7_chat"] = (
    f"WITH {_TRAFFIC_SQL}, told AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, CASE WHEN role IN ('assistant', 'tool') AND regexp_matches(text, '^\\s*\\{{') AND json_valid(text) THEN CAST(text AS JSON) END AS j, row_number() OVER () AS id FROM rows), "
    "made AS (SELECT id, conv_id, turn, CASE WHEN role = 'assistant' AND json_type(j, '$.tool_calls') = 'ARRAY' THEN json_extract(j, '$.tool_calls[*]') ELSE [] END AS calls, CASE WHEN role = 'tool' THEN json_extract_string(j, '$.tool_call_id') END AS call_id FROM told), "
    "each AS (SELECT id, conv_id, turn, k, json_extract_string(v, '$.id') AS cid, json_extract_string(v, '$.name') AS name, coalesce(json_extract(v, '$.arguments'), CAST('{}' AS JSON)) AS a FROM (SELECT id, conv_id, turn, unnest(calls) AS v, generate_subscripts(calls, 1) AS k FROM made)), "
    "firsts AS (SELECT conv_id, cid, min(turn) AS call_turn FROM each WHERE cid IS NOT NULL GROUP BY ALL), "
    f"checked AS (SELECT id, CASE WHEN cid IS NULL THEN 'call without an id' END AS nameless, CASE WHEN coalesce(c.name, '') NOT IN ('search', 'weather', 'calculate') THEN 'unknown tool ' || coalesce(c.name, '') {_FAULT_SQL} END AS fault FROM each c), "
    "problems AS (SELECT id, string_agg(DISTINCT p, '; ' ORDER BY p) AS problem FROM (SELECT id, nameless AS p FROM checked UNION ALL SELECT id, fault FROM checked) WHERE p IS NOT NULL GROUP BY id), "
    "written AS (SELECT id, string_agg('{\"arguments\":{' || array_to_string(list_transform(list_sort(json_keys(a)), lambda x: to_json(x) || ':' || json_extract(a, '$.\"' || x || '\"')), ',') || '},\"id\":' || coalesce(CAST(to_json(cid) AS VARCHAR), 'null') || ',\"name\":' || to_json(coalesce(name, '')) || '}', ',' ORDER BY k) AS calls FROM each GROUP BY id), "
    "linked AS (SELECT t.*, len(m.calls) AS n, m.call_id, f.call_turn, p.problem AS fault, w.calls FROM told t JOIN made m USING (id) LEFT JOIN firsts f ON f.conv_id = t.conv_id AND f.cid = m.call_id LEFT JOIN problems p ON p.id = t.id LEFT JOIN written w ON w.id = t.id) "
    "SELECT conv_id, turn, CASE WHEN call_turn >= turn THEN call_turn ELSE turn END AS order_turn, CAST(CASE WHEN call_turn >= turn THEN 1 ELSE 0 END AS INTEGER) AS order_step, role, CAST(n AS INTEGER) AS n_calls, call_turn, "
    "CASE WHEN call_id IS NOT NULL AND call_turn IS NULL THEN 'result without a call' ELSE coalesce(fault, '') END AS problem, CASE WHEN call_id IS NOT NULL AND call_turn IS NULL THEN false ELSE fault IS NULL END AS valid, "
    "'{\"content\":' || to_json(CASE WHEN n > 0 OR call_id IS NOT NULL THEN coalesce(json_extract_string(j, '$.content'), '') ELSE text END) || ',\"role\":' || to_json(role) || CASE WHEN call_id IS NOT NULL THEN ',\"tool_call_id\":' || to_json(call_id) ELSE '' END || CASE WHEN n > 0 THEN ',\"tool_calls\":[' || calls || ']' ELSE '' END || '}' AS message FROM linked"
)


# exact: every pair of texts that share a shingle, and classes as the closure of the links
ORACLES["op8_bagminhash"] = (
    "WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[0-9a-z\\x{80}-\\x{10ffff}]+') AS w FROM documents), "
    "bags AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END AS b FROM d), "
    "told AS (SELECT doc_id, b, md5(array_to_string(list_sort(b), '|')) AS h FROM bags), reps AS (SELECT h, min(doc_id) AS rep FROM told WHERE len(b) > 0 GROUP BY h), "
    "s AS (SELECT rep, x, count(*) AS c FROM (SELECT rep, unnest(b) AS x FROM reps JOIN told ON told.doc_id = reps.rep) GROUP BY ALL), n AS (SELECT rep, sum(c) AS n FROM s GROUP BY rep), "
    "pairs AS (SELECT a.rep AS a, b.rep AS b, sum(least(a.c, b.c)) AS shared FROM s a JOIN s b ON a.x = b.x AND a.rep < b.rep GROUP BY ALL), "
    "near AS (SELECT a, b FROM pairs JOIN n x ON x.rep = a JOIN n y ON y.rep = b WHERE shared >= 0.8::DOUBLE * (x.n + y.n - shared)), links AS (SELECT a, b FROM near UNION SELECT b, a FROM near), "
    "reach(a, b) AS (SELECT rep, rep FROM reps UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a), classes AS (SELECT a AS rep, min(b) AS class_id FROM reach GROUP BY a) "
    "SELECT told.doc_id, coalesce(class_id, told.doc_id) AS class_id FROM told LEFT JOIN reps USING (h) LEFT JOIN classes USING (rep)"
)
