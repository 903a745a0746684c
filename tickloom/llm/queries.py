"""One query for each operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm import decontaminate, dialogue, packing, phrases, placement, quality, repeats, secrets, simhash, templates, tokens, topk, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Shards of op5.
SHARDS = [f"shard-{i:03d}" for i in range(256)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def register(build):
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


@query("op1_simhash")
def op1(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


@query(
    "op2_decontaminate",
    f"""
WITH items AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
windows AS (
    SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS win
    FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM items WHERE len(w) > 0)
),
docs AS (SELECT row_number() OVER () AS row, doc_id, {_WORDS} AS w FROM documents),
lengths AS (SELECT DISTINCT n FROM windows),
own AS (
    SELECT row, i, n, array_to_string(w[i : i + n - 1], ' ') AS win
    FROM (SELECT row, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, lengths WHERE len(w) >= n)
),
hits AS (SELECT row, i, n, item_id FROM own JOIN windows USING (n, win)),
marked AS (SELECT row, count(DISTINCT p) AS n_hit FROM (SELECT row, unnest(range(i, i + n)) AS p FROM hits) GROUP BY row),
named AS (SELECT row, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM hits GROUP BY row)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN marked USING (row) LEFT JOIN named USING (row)
""",
)
def op2(spark, sf_dir):
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op3_quality")
def op3(spark, sf_dir):
    return quality.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


@query(
    "op4_top_k",
    """
WITH v AS (
    SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS x FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
pairs AS (
    SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.x, c.x), lambda p: p[1] * p[2]))::BIGINT AS score
    FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
),
ranked AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM pairs)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM ranked WHERE rank <= 20
""",
)
def op4(spark, sf_dir):
    return topk.top_k(table(spark, sf_dir, "embeddings"))


@query("op5_sharding")
def op5(spark, sf_dir):
    return placement.placed(table(spark, sf_dir, "documents"), SHARDS)


_DIGIT = "instr('0123456789abcdef', hex[{i}]) - 1"


def _base32() -> str:
    """SQL for the base32 of the hex digits in ``hex``: five digits make four letters."""
    letters = []
    for k in range(8):
        value = "(" + " + ".join(f"({_DIGIT.format(i=5 * k + j + 1)}) * {16 ** (4 - j)}" for j in range(5)) + ")"
        letters += [f"'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[({value} // {32 ** (3 - j)}) % 32 + 1]" for j in range(4)]
    return " || ".join(letters)


@query(
    "op6_warc",
    f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
d AS (SELECT page_id, octet_length(encode(payload)) AS payload_bytes, payload, sha1(payload) AS hex FROM p),
m AS (SELECT payload, max(page_id) AS best FROM p GROUP BY payload)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, {_base32()} AS payload_digest,
       CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> best THEN best END AS refers_to
FROM d JOIN m USING (payload)
""",
)
def op6(spark, sf_dir):
    return warc.round_trip(table(spark, sf_dir, "pages"))


@query("op7_token_counts")
def op7(spark, sf_dir):
    return tokens.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query("op8_secrets")
def op8(spark, sf_dir):
    found = secrets.secrets(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, secrets.KINDS), F.sha2("listed_base", 256).alias("base_sha256"), F.col("listed_spans").alias("spans"))


@query("op9_packing")
def op9(spark, sf_dir):
    return packing.packed(
        table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    )


@query(
    "op10_substring_dedup",
    r"""
WITH docs AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (
    SELECT row, i, sha256(array_to_string(w[i : i + 34], ' ')) AS win
    FROM (SELECT row, w, unnest(range(1, len(w) - 33)) AS i FROM docs WHERE len(w) >= 35)
),
repeated AS (SELECT win FROM windows GROUP BY win HAVING count(*) > 1),
gone AS (SELECT DISTINCT row, p FROM (SELECT row, unnest(range(i, i + 35)) AS p FROM windows SEMI JOIN repeated USING (win))),
removed AS (SELECT row, list(p) AS ps, count(*) AS n FROM gone GROUP BY row),
left_over AS (
    SELECT row, string_agg(word, ' ' ORDER BY p) AS kept
    FROM (SELECT row, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS word FROM docs) ANTI JOIN gone USING (row, p) GROUP BY row
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM docs LEFT JOIN removed USING (row) LEFT JOIN left_over USING (row)
""",
)
def op10(spark, sf_dir):
    return repeats.without_repeats(table(spark, sf_dir, "documents")).drop("kept")


#: SQL for the CRC-32 of the ASCII text ``key``, bit by bit.
_CRC = """xor(4294967295, list_reduce([4294967295]::BIGINT[] || list_transform(range(1, length(key) + 1), lambda i: ascii(substr(key, i::INT, 1))::BIGINT),
             lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda x, y: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END))))"""


def _step(name: str) -> str:
    """SQL for one message: the states after it from those before it, each a struct of cost, audit and repaired text."""
    put = "CASE WHEN {x}.r = '' THEN '' ELSE chr(10) END"
    ins = lambda x, role: f"{{'c': {x}.c + 3, 'a': {x}.a || 'I', 'r': {x}.r || {put.format(x=x)} || '{role}:'}}"
    if name == "insert":
        least = f"list_min([xu, {ins('x0', 'user')}, {ins('xs', 'user')}, {ins('xa', 'user')}])"
        return f"x0 AS y0, xs AS ys, {least} AS yu, list_min([xa, {ins(least, 'assistant')}]) AS ya"
    own = lambda x, cost, letter, role: (
        f"{{'c': {x}.c + {cost} + CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END, 'a': {x}.a || '{letter}', 'r': {x}.r || {put.format(x=x)} || {role} || ':' || text}}"
    )
    free = "fault IS NULL OR fault = 'truncated'"
    none = "{'c': 1000000, 'a': '', 'r': ''}"
    gone = lambda x: f"{{'c': {x}.c + 4, 'a': {x}.a || 'D', 'r': {x}.r}}"
    keep = lambda c, x: f"CASE WHEN initial = '{c}' AND ({free}) THEN {own(x, 0, 'K', 'role')} ELSE {none} END"
    role = lambda name, x: f"CASE WHEN {free} THEN {own(x, 3, 'R', repr(name))} ELSE {none} END"
    any_ = "list_min([y0, ys, ya])"
    return f"""{gone('y0')} AS x0, list_min([{gone('ys')}, {keep('s', 'y0')}]) AS xs,
        list_min([{gone('yu')}, {keep('u', any_)}, {role('user', any_)}]) AS xu, list_min([{gone('ya')}, {keep('a', 'yu')}, {role('assistant', 'yu')}]) AS xa"""


@query(
    "op11_conversation_repair",
    f"""
WITH RECURSIVE keyed AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
           {_CRC} % 20 AS d
    FROM (SELECT *, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations)
),
hurt AS (
    SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role, CASE d WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
           unnest(CASE WHEN d = 3 THEN [1, 2] ELSE [1] END) AS copy
    FROM keyed WHERE d <> 0
),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i FROM hurt),
seen AS (
    SELECT *, left(role, 1) AS initial, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body,
           lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS nth
    FROM placed
),
marked AS (
    SELECT *, CASE WHEN body = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 'truncated' END AS fault
    FROM seen
),
states AS (
    SELECT DISTINCT conv_id, 0::BIGINT AS i, {{'c': 0, 'a': '', 'r': ''}} AS x0, {{'c': 1000000, 'a': '', 'r': ''}} AS xs,
           {{'c': 1000000, 'a': '', 'r': ''}} AS xu, {{'c': 1000000, 'a': '', 'r': ''}} AS xa
    FROM marked
    UNION ALL
    SELECT conv_id, i, {_step("row")}
    FROM (
        SELECT conv_id, marked.i, role, text, initial, fault, {_step("insert")}
        FROM states JOIN marked USING (conv_id) WHERE marked.i = states.i + 1
    )
),
totals AS (
    SELECT conv_id, max(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
           count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
           count(*) FILTER (i > 1 AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal
    FROM marked GROUP BY conv_id
),
best AS (
    SELECT conv_id, list_min([y0, ya]) AS b
    FROM (SELECT conv_id, {_step("insert")} FROM states JOIN totals USING (conv_id) WHERE states.i = totals.n)
)
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
       coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(b.c, 0)::BIGINT AS cost,
       coalesce(b.a, '') AS audit, sha256(coalesce(b.r, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) LEFT JOIN totals USING (conv_id) LEFT JOIN best USING (conv_id)
""",
)
def op11(spark, sf_dir):
    conversations = table(spark, sf_dir, "conversations")
    found = dialogue.reports(dialogue.damaged(conversations), conversations.select(F.col("conv_id").alias("id")))
    return found.withColumnRenamed("id", "conv_id")


@query("op12_main_text")
def op12(spark, sf_dir):
    return templates.extracted(table(spark, sf_dir, "pages"))


@query(
    "op13_collocations",
    r"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang,
           unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents
),
words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM words GROUP BY lang),
found AS (
    SELECT lang, length, array_to_string(w[i : i + length - 1], ' ') AS phrase
    FROM (SELECT lang, w, length, unnest(range(1, len(w) - length + 2)) AS i FROM words, (SELECT unnest([1, 2, 3, 4, 5]) AS length) WHERE len(w) >= length)
),
known AS (SELECT lang, length, phrase, count(*)::BIGINT AS f FROM found GROUP BY ALL HAVING count(*) >= 100),
parts AS (SELECT *, string_split(phrase, ' ') AS w FROM known WHERE length > 1),
inside AS (
    SELECT lang, array_to_string(part, ' ') AS phrase, max(f) AS more
    FROM (SELECT lang, f, unnest([w[1 : length - 1], w[2 : length]]) AS part FROM parts) GROUP BY ALL
),
kept AS (SELECT parts.* FROM parts LEFT JOIN inside USING (lang, phrase) WHERE more IS NULL OR 100 * more < 100 * f),
cuts AS (SELECT *, array_to_string(w[1 : k], ' ') AS head, array_to_string(w[k + 1 : length], ' ') AS tail FROM (SELECT *, unnest(range(1, length)) AS k FROM kept)),
scored AS (
    SELECT c.lang, c.phrase, c.f AS a, h.f AS l, t.f AS r, n, k, (1000::HUGEINT * c.f * n // (h.f::HUGEINT * t.f))::BIGINT AS score
    FROM cuts c JOIN known h ON c.lang = h.lang AND c.head = h.phrase JOIN known t ON c.lang = t.lang AND c.tail = t.phrase JOIN totals ON c.lang = totals.lang
),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS nth FROM scored) WHERE nth = 1),
ranked AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM best)
SELECT * FROM ranked WHERE rank <= 2000
""",
)
def op13(spark, sf_dir):
    return phrases.collocations(table(spark, sf_dir, "documents"))
