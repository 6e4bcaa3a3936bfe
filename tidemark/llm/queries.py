"""Queries of the training-data operators, each over whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, chat_repair, contamination, embedding_dup, lang_id, mixing, near_dup, pitman_yor, secrets, spelling, token_store, toxicity, url_filter


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of ``embeddings``."""
    return embedding_dup.near_duplicates(_t(spark, sf_dir, "embeddings"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``documents``, learned from ``labels``."""
    return toxicity.classify(_t(spark, sf_dir, "documents"), _t(spark, sf_dir, "labels"))


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, item_id, n_shared, n_item, containment of every benchmark item that a document holds."""
    return contamination.contaminated(_t(spark, sf_dir, "documents"), _t(spark, sf_dir, "benchmark"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of ``documents``."""
    return lang_id.identify(_t(spark, sf_dir, "documents"))


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document."""
    return near_dup.near_duplicates(_t(spark, sf_dir, "documents"))


def op6_pitman_yor_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of ``documents``."""
    return pitman_yor.score(_t(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken, source, copies, first position of every row of ``documents``."""
    out = mixing.assign(_t(spark, sf_dir, "documents")).withColumn("position", F.try_element_at("positions", F.lit(1)))
    return out.select("doc_id", "size", "source_size", "target", "taken", "source", "copies", "position").orderBy(F.col("position").asc_nulls_last(), "doc_id")


def op8_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, verified of every row of ``documents``, from the written store."""
    return token_store.tokenize(_t(spark, sf_dir, "documents"))


#: host, path, verdict
URL_RULES = (
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
)


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, host, path, rule, verdict, template, n_labelled, purity of every row of ``pages``."""
    rules = spark.createDataFrame(list(URL_RULES), "host string, path string, verdict string")
    # A page counts as bad when the label of its id says low quality.
    labels = _t(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), (1 - F.col("quality")).alias("bad"))
    return url_filter.judge(_t(spark, sf_dir, "pages"), rules, labels)


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digests of every conversation, read back from what was written."""
    says = r"\### Assistant: </turn> ok"
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(says).alias("text"))
    rows = _t(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return chat.digest(chat.written_chats(rows))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, counts of faults, cost, audit and digest of the repaired turns of every conversation, after damage."""
    return chat_repair.digest(chat_repair.repair(chat_repair.damage(_t(spark, sf_dir, "conversations")), "copies"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of ``documents``, after damage."""
    return spelling.spelling_variants(_t(spark, sf_dir, "documents"))


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every row of ``documents``."""
    return secrets.scan(_t(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_embedding_near_dedup,
        op2_toxicity,
        op3_benchmark_decontamination,
        op4_language_id,
        op5_minhash_near_dedup,
        op6_pitman_yor_lm,
        op7_mixing,
        op8_token_store,
        op9_url_filter,
        op10_chat_formatting,
        op11_conversation_repair,
        op12_spelling_variants,
        op13_secret_scan,
    )
}


def _shingles(table: str, ident: str, name: str) -> str:
    """Definition of ``name``: the distinct five-word shingles of a table's texts, as in near_dup."""
    low = f"translate(text, '{url_filter.UPPER}', '{url_filter.LOWER}')"
    return f"""{name}w AS (SELECT {ident} AS id, regexp_extract_all(coalesce({low}, ''), '[^\x20\x09-\x0D]+') AS w FROM {table}),
    {name} AS (SELECT DISTINCT id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM {name}w)"""


#: Links (a, b) in both directions to the smallest id that each reaches.
_REACHED = "reached AS (SELECT id, id AS root FROM ids UNION SELECT l.a AS id, r.root FROM reached r JOIN links l ON l.b = r.id WHERE r.root < l.a), best AS (SELECT id, min(root) AS component_id FROM reached GROUP BY 1)"

#: What each conversation's turns come to, written without the formatter: every one of three characters takes two in the output.
_TURNS = rf"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
    o AS (SELECT *, row_number() OVER w AS i, lag(role) OVER w IS DISTINCT FROM role AS opens FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
    z AS (SELECT *, length(text) + length(regexp_replace(text, '[^\\<#]', '', 'g')) AS size, length(role) + length(regexp_replace(role, '[^\\<#]', '', 'g')) AS named FROM o)
    SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (role = '{chat.LEARNED_ROLE}'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = '{chat.LEARNED_ROLE}'), '')) AS loss_sha256,
    CAST(sum(size + CASE WHEN opens THEN named + {len(chat.OPEN + chat.SAYS + chat.CLOSE)} ELSE {len(chat.NEXT)} END) AS BIGINT) AS formatted_chars FROM z GROUP BY 1"""

#: crc32 of a text of ASCII characters, bit by bit.
_CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, len({0}) + 1), lambda i: ascii(substr({0}, i, 1))::BIGINT)), lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"


def _edit(letter: str, cost: str | int, rest: str) -> str:
    """Cost in eight digits and audit, with one more edit before them."""
    return f"(printf('%08d', CAST(left({rest}, 8) AS INTEGER) + {cost}) || '{letter}' || substr({rest}, 9))"


def _kept(char: str, then: str) -> str:
    late = f"{chat_repair.TRUNCATED} * late"
    rerole = f"least({_edit('R', f'{chat_repair.REROLE} + {late}', then)}, {_edit('K', late, then)})" if char != "s" else _edit("K", late, then)
    return f"CASE WHEN must THEN '99999999' WHEN initial = '{char}' THEN {rerole} ELSE {_edit('R', f'{chat_repair.REROLE} + {late}', then) if char != 's' else "'99999999'"} END"


_GONE = lambda q: _edit("D", chat_repair.DELETE, f"n{q}")
_PUT = lambda q: _edit("I", chat_repair.INSERT, q)

#: Shortest way through an automaton of the grammar (0 start, 1 after s, 2 after u, 3 after a), from the last turn to the
#: first: n are the values behind a turn, c those with the turn's own edit, v those with insertions before it.
_REPAIR = rf"""WITH RECURSIVE k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce('=' || conv_id, '') AS g, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
    h AS (SELECT *, {_CRC.format('k')} % 20 AS h FROM k),
    d AS (SELECT g, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role, CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE h WHEN 0 THEN [] WHEN 3 THEN [1, 2] ELSE [1] END) AS copy FROM h),
    o AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY turn NULLS FIRST, role, text, copy) AS i, row_number() OVER (PARTITION BY g, role, text ORDER BY turn NULLS FIRST, copy) AS seen, left(role, 1) AS initial,
      regexp_extract(text, '([^ 	-
])[ 	-
]*$', 1) AS last FROM d),
    f AS (SELECT *, last = '' AS blank, last <> '' AND seen > 1 AS duplicate, last <> '' AND seen = 1 AND last NOT IN ('.', '!', '?') AS truncated, lead(initial) OVER (PARTITION BY g ORDER BY i) AS next FROM o),
    t AS (SELECT g, i, role, text, initial, blank OR duplicate AS must, truncated::INTEGER AS late FROM f),
    s AS (SELECT g, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (truncated) AS truncated,
      count(*) FILTER (next IS NOT NULL AND initial || next NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY 1),
    r AS (SELECT g, n + 1 AS i, '00000000' AS n0, '00000006II' AS n1, '00000003I' AS n2, '00000000' AS n3 FROM s
      UNION ALL SELECT g, i, least(c0, {_PUT('c2')}, {_PUT(_PUT('c3'))}), least(c1, {_PUT('c2')}, {_PUT(_PUT('c3'))}), least(c2, {_PUT('c3')}), least(c3, {_PUT('c2')}) FROM (
        SELECT t.g, t.i, least({_GONE(0)}, {_kept('s', 'n1')}, {_kept('u', 'n2')}) AS c0, least({_GONE(1)}, {_kept('u', 'n2')}) AS c1, least({_GONE(2)}, {_kept('a', 'n3')}) AS c2, least({_GONE(3)}, {_kept('u', 'n2')}) AS c3
        FROM r JOIN t ON t.g = r.g AND t.i = r.i - 1)),
    b AS (SELECT g, CAST(left(n0, 8) AS BIGINT) AS cost, substr(n0, 9) AS audit FROM r WHERE i = 1),
    e AS (SELECT g, unnest(string_split(audit, '')) AS e, unnest(range(len(audit))) AS p, len(replace(audit, 'D', '')) AS made FROM b WHERE audit <> ''),
    w AS (SELECT *, count(*) FILTER (e <> 'I') OVER x AS i, made - count(*) FILTER (e <> 'D') OVER x AS left_over FROM e WINDOW x AS (PARTITION BY g ORDER BY p)),
    y AS (SELECT w.g, string_agg(CASE WHEN e = 'K' THEN t.role WHEN left_over % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN e = 'I' THEN '' ELSE t.text END, chr(10) ORDER BY p) AS said FROM w LEFT JOIN t ON t.g = w.g AND t.i = w.i WHERE e <> 'D' GROUP BY 1)
    SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(said, '')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id, g FROM k) a LEFT JOIN s ON s.g = a.g LEFT JOIN b ON b.g = a.g LEFT JOIN y ON y.g = a.g"""

ORACLE_SQL: dict[str, str] = {
    "op1_embedding_near_dedup": f"""WITH RECURSIVE ids AS (SELECT vec_id AS id FROM embeddings), v AS (SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings WHERE label IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
    links AS (SELECT p.id AS a, q.id AS b FROM v p JOIN v q ON p.label = q.label AND p.id <> q.id AND len(p.x) = len(q.x) WHERE list_cosine_similarity(p.x, q.x) >= {embedding_dup.COSINE}::DOUBLE), {_REACHED},
    n AS (SELECT a AS id, count(*) AS n FROM links GROUP BY 1)
    SELECT b.id AS vec_id, coalesce(n.n, 0) AS n_links, b.component_id, b.id = b.component_id AS kept FROM best b LEFT JOIN n ON n.id = b.id""",
    "op3_benchmark_decontamination": f"""WITH {_shingles('documents', 'doc_id', 'd')}, {_shingles('benchmark', 'item_id', 'i')}, n AS (SELECT id, count(*) AS n FROM i GROUP BY 1), met AS (SELECT d.id AS doc_id, i.id AS item_id, count(*) AS k FROM d JOIN i ON d.s = i.s GROUP BY 1, 2)
    SELECT doc_id, item_id, k AS n_shared, n AS n_item, k / n AS containment FROM met JOIN n ON n.id = item_id WHERE 100 * k >= 75 * n""",
    "op5_minhash_near_dedup": f"""WITH RECURSIVE ids AS (SELECT doc_id AS id FROM documents), {_shingles('documents', 'doc_id', 'd')}, n AS (SELECT id, count(*) AS n FROM d GROUP BY 1),
    met AS (SELECT x.id AS a, y.id AS b, count(*) AS k FROM d x JOIN d y ON x.s = y.s AND x.id <> y.id GROUP BY 1, 2),
    links AS (SELECT a, b FROM met JOIN n p ON p.id = a JOIN n q ON q.id = b WHERE 100 * k >= 75 * (p.n + q.n - k)), {_REACHED}
    SELECT b.id AS doc_id, coalesce(n.n, 0) AS n_shingles, b.component_id, b.id = b.component_id AS kept FROM best b LEFT JOIN n ON n.id = b.id""",
    "op10_chat_formatting": _TURNS,
    "op11_conversation_repair": _REPAIR,
}
