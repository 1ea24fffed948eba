"""The registered queries of this subpackage, each over its whole table, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import chat, decontaminate, embdedup, extract, langid, linededup, minhash, packing, pii, warc

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), percent=85)


OP8_SQL = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^ \t\n\x0b\f\r]+') AS w FROM documents),
g AS (
  SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) END) AS g FROM w),
s AS (SELECT DISTINCT doc_id, hash(g) AS h, md5(g) AS g FROM g),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY k) AS node, k FROM (SELECT doc_id, md5(string_agg(g, '' ORDER BY g)) AS k FROM s GROUP BY doc_id)),
r AS (SELECT s.* FROM s SEMI JOIN (SELECT DISTINCT node FROM c) q ON s.doc_id = q.node),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS x FROM r a JOIN r b ON a.h = b.h AND a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * x >= 85 * (na.n + nb.n - x)
  UNION SELECT doc_id, node FROM c WHERE doc_id <> node),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
t AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT t.a, e.b FROM t JOIN e ON t.b = e.a),
m AS (SELECT a AS doc_id, min(b) AS component_id FROM t GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.component_id, d.doc_id = m.component_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)
"""


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return linededup.strip_lines(docs, counts=("n_lines", "n_dropped")).select("doc_id", "n_lines", "n_dropped", "text")


OP1_SQL = r"""
WITH d AS (SELECT doc_id, text, coalesce('=' || source, '') AS host, row_number() OVER () AS page FROM documents),
t AS (SELECT host, count(*) AS host_pages FROM d GROUP BY host),
l AS (SELECT DISTINCT host, page, trim(line, E' \t\r') AS line FROM (SELECT host, page, unnest(string_split(text, chr(10))) AS line FROM d)),
b AS (SELECT host, line FROM (SELECT host, line, count(*) AS pages FROM l WHERE line <> '' GROUP BY ALL) JOIN t USING (host)
  WHERE pages >= 2 AND pages > 0.05::DOUBLE * host_pages),
h AS (SELECT host, list(line) AS drop FROM b GROUP BY host),
k AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines,
  list_filter(string_split(text, chr(10)), lambda x: NOT list_contains(coalesce(h.drop, []), trim(x, E' \t\r'))) AS kept FROM d LEFT JOIN h USING (host))
SELECT doc_id, coalesce(len(lines), 0)::BIGINT AS n_lines, coalesce(len(lines) - len(kept), 0)::BIGINT AS n_dropped,
  CASE WHEN text IS NOT NULL THEN array_to_string(kept, chr(10)) END AS text FROM k
"""


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(pii.find(table(spark, sf_dir, "documents")))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.main_texts(table(spark, sf_dir, "pages"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload_ok")


_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_QUINTET = " || ".join(f"substr('{_BASE32}', ((v >> {s}) & 31)::INT + 1, 1)" for s in (15, 10, 5, 0))
OP4_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
c AS (SELECT h, max(page_id) AS response, count(*) AS n FROM p GROUP BY h)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(0, 8), lambda i: list_transform([('0x' || substr(h, (5 * i + 1)::INT, 5))::BIGINT], lambda v: {_QUINTET})[1]), '') AS payload_digest,
  CASE WHEN n > 1 AND page_id IS DISTINCT FROM response THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n > 1 AND page_id IS DISTINCT FROM response THEN response END AS refers_to, true AS payload_ok
FROM p JOIN c USING (h)
"""


def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embdedup.near_vectors(table(spark, sf_dir, "embeddings"))


OP5_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL),
n AS (SELECT vec_id, label, e, sqrt(list_inner_product(e, e)) AS z FROM v),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_inner_product(a.e, b.e) / (a.z * b.z) >= 0.98),
t AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT t.a, l.b FROM t JOIN l ON t.b = l.a),
m AS (SELECT a AS vec_id, min(b) AS component_id FROM t GROUP BY a),
k AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM m LEFT JOIN k USING (vec_id)
"""


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP6_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item, least(len(w), 10) AS n, unnest(list_transform(range(1, greatest(len(w) - 9, 1) + 1), lambda i: array_to_string(w[i:i+least(len(w), 10)-1], ' '))) AS g
  FROM b WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS i, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i+n-1], ' '))) AS g
  FROM d, sizes WHERE len(w) >= n),
hit AS (SELECT dw.doc_id, dw.i, dw.n, bw.item FROM dw JOIN bw ON dw.n = bw.n AND dw.g = bw.g),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM hit)) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -1, whose texts look like the template."""
    planted = spark.sql("SELECT -1L AS conv_id, turn, role, '</s>[INST] ok [/INST]' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(planted)
    return chat.digests(chat.examples(rows))


_ESCAPE = r"""'([<\[])(\\*)((?:/?s>)|(?:/?INST\]))', '\1\\\2\3', 'g'"""
OP9_SQL = rf"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
o AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
e AS (SELECT *, 13 + length(regexp_replace(role, {_ESCAPE})) + length(regexp_replace(text, {_ESCAPE})) AS size,
  sum(CASE WHEN role = 'assistant' OR i = n THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY i DESC) AS times FROM o)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(size * times)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.train(docs))


_QUERIES = [op1_line_dedup, op2_pii, op3_html_extraction, op4_warc, op5_embedding_near_dedup, op6_decontamination, op7_packing, op8_minhash_near_dedup, op9_chat_formatting, op10_language_id]


def queries() -> dict:
    return {f.__name__: f for f in _QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"op1_line_dedup": OP1_SQL, "op4_warc": OP4_SQL, "op5_embedding_near_dedup": OP5_SQL, "op6_decontamination": OP6_SQL, "op8_minhash_near_dedup": OP8_SQL, "op9_chat_formatting": OP9_SQL}
