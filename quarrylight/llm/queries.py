"""The registered queries of this subpackage: one for each operator, with
production parameters, over the whole of its table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.llm.bpe import encode_documents
from quarrylight.llm.chat import format_conversations
from quarrylight.llm.classifier import quality_scores
from quarrylight.llm.common import table
from quarrylight.llm.cover_tree import quantised, top_k
from quarrylight.llm.language import languages
from quarrylight.llm.line_dedup import drop_boilerplate
from quarrylight.llm.packing import pack_documents
from quarrylight.llm.phrases import collocations
from quarrylight.llm.pii import BASE, find_spans, span_text
from quarrylight.llm.quality_rules import apply_rules
from quarrylight.llm.sharding import feistel_shards
from quarrylight.llm.simhash import simhash_components
from quarrylight.llm.whitening import whiten


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_simhash_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"), threshold=2, shingle=3)


def op2_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_conversations(table(spark, sf_dir, "conversations"))


OP2_SQL = """
WITH RECURSIVE
c AS (SELECT conv_id, turn, 'turn-' || turn AS call_id, min(text) AS text, count(*) AS n FROM conversations WHERE role = 'user' GROUP BY conv_id, turn),
r AS (SELECT conv_id, 'turn-' || (turn - 1) AS call_id, min(text) AS content, min(turn) AS turn, count(*) AS n FROM conversations WHERE role = 'assistant' GROUP BY conv_id, turn),
l AS (SELECT conv_id, turn, 0 AS level FROM c WHERE NOT EXISTS (SELECT 1 FROM c b WHERE b.conv_id = c.conv_id AND b.turn = c.turn - 2)
      UNION ALL SELECT c.conv_id, c.turn, l.level + 1 FROM l JOIN c ON c.conv_id = l.conv_id AND c.turn = l.turn + 2),
j AS (SELECT coalesce(c.conv_id, r.conv_id) AS conv_id, coalesce(c.call_id, r.call_id) AS call_id, coalesce(c.turn, r.turn) AS turn, l.level AS level,
             coalesce(c.n, 0) AS n_calls, coalesce(r.n, 0) AS n_results, c.text AS text, c.turn AS asked, r.content AS content,
             CASE WHEN c.n IS NULL THEN 'no call' WHEN r.n IS NULL THEN 'no result' ELSE '' END AS errors
      FROM c LEFT JOIN l ON c.conv_id = l.conv_id AND c.turn = l.turn FULL JOIN r ON c.conv_id = r.conv_id AND c.call_id = r.call_id)
SELECT conv_id, call_id, turn, CAST(level AS INTEGER) AS level, n_calls, n_results, errors,
       '{"arguments":' || CASE WHEN asked IS NULL THEN 'null' ELSE '{"text":' || to_json(text)::VARCHAR || ',"turn":' || asked || '}' END
       || ',"call_id":' || to_json(call_id)::VARCHAR || ',"content":' || coalesce(to_json(content)::VARCHAR, 'null')
       || ',"errors":' || CASE WHEN errors = '' THEN '[]' ELSE '["' || errors || '"]' END
       || ',"level":' || coalesce(CAST(level AS VARCHAR), 'null') || ',"name":' || CASE WHEN asked IS NULL THEN 'null' ELSE '"reply"' END || '}' AS json
FROM j
"""


def op3_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", quantised(F.col("embedding")).alias("v"))
    return top_k(rows, rows.filter("vec_id % 50 = 0"), k=5)


OP3_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


def op4_kk_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path(), checksum=True)


def op5_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = apply_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_site_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_boilerplate(table(spark, sf_dir, "documents"), host_col="source", ratio=0.05, least_pages=5).select("doc_id", "n_lines", "n_dropped", "text")


OP6_SQL = r"""
WITH p AS (SELECT DISTINCT coalesce(source, '') AS host, text FROM documents WHERE text IS NOT NULL),
totals AS (SELECT host, count(*) AS pages FROM p GROUP BY host),
x AS (SELECT DISTINCT host, text, unnest(string_split(text, chr(10))) AS line FROM p),
seen AS (SELECT host, line, count(*) AS n FROM x WHERE regexp_matches(line, '[^ 	-
]') GROUP BY host, line),
often AS (SELECT seen.host, list(line) AS drops FROM seen JOIN totals ON seen.host = totals.host
          WHERE n >= 5 AND n > CAST(0.05 AS DOUBLE) * pages GROUP BY seen.host),
d AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines, coalesce(drops, []) AS drops
      FROM documents LEFT JOIN often ON coalesce(source, '') = host),
k AS (SELECT doc_id, text, lines, list_filter(lines, lambda z: NOT list_contains(drops, z)) AS kept FROM d)
SELECT doc_id, CAST(coalesce(len(lines), 0) AS BIGINT) AS n_lines,
       CAST(coalesce(len(lines) - len(kept), 0) AS BIGINT) AS n_dropped,
       CASE WHEN text IS NULL THEN NULL ELSE array_to_string(kept, chr(10)) END AS text
FROM k
"""


def op7_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = feistel_shards(table(spark, sf_dir, "documents"), shards=40)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_forced_boundary_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = encode_documents(table(spark, sf_dir, "documents"), tokenizer_path(), as_text=True)
    return encoded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("id_text", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op9_boosted_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_spans(table(spark, sf_dir, "documents"))

    def number(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = map(number, BASE)
    return found.select("doc_id", *counts, F.sha2(span_text(F.col("base")), 256).alias("base_sha256"), span_text(F.col("spans")).alias("spans"))


def held_out():
    """A fifth of the documents, by id; a row without an id is not one of them."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def op10_random_indexing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = quality_scores(docs, labels.filter(~held_out()))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op11_language_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = languages(docs, docs.filter(~held_out()))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op12_spectrum_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"), most=32, scale=64, shift=1_000_000)


def op13_son_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"), least=100, most=2000)


OP13_SQL = r"""
WITH p AS (SELECT doc_id, coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
g AS (SELECT lang, k, unnest(list_transform(range(1, CAST(len(w) AS BIGINT) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase
      FROM w, (SELECT unnest(range(1, 6)) AS k) WHERE len(w) >= k),
f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY lang, k, phrase HAVING count(*) >= 100),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
inside AS (SELECT DISTINCT c.lang, array_to_string(c.w[i:i + j - 1], ' ') AS phrase, a FROM c, (SELECT unnest(range(1, 5)) AS i), (SELECT unnest(range(2, 5)) AS j)
           WHERE j < c.k AND i + j - 1 <= c.k),
kept AS (SELECT c.* FROM c WHERE NOT EXISTS (SELECT 1 FROM inside x WHERE x.lang = c.lang AND x.phrase = c.phrase AND 100 * x.a >= 100 * c.a)),
cuts AS (SELECT c.lang, c.phrase, c.a, t.n, j, l.f AS l, r.f AS r, CAST(CAST(1000 AS HUGEINT) * c.a * t.n // (CAST(l.f AS HUGEINT) * r.f) AS BIGINT) AS score
         FROM kept c JOIN (SELECT unnest(range(1, 5)) AS j) ON j < c.k JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1:j], ' ')
         JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[j + 1:], ' ') JOIN totals t ON t.lang = c.lang),
low AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
ranked AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM low)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= 2000
"""


QUERIES = {
    "op1_simhash_anchors": op1_simhash_anchors,
    "op2_tool_calls": op2_tool_calls,
    "op3_cover_tree": op3_cover_tree,
    "op4_kk_packing": op4_kk_packing,
    "op5_decision_list": op5_decision_list,
    "op6_site_lines": op6_site_lines,
    "op7_feistel_shards": op7_feistel_shards,
    "op8_forced_boundary_bpe": op8_forced_boundary_bpe,
    "op9_boosted_pii": op9_boosted_pii,
    "op10_random_indexing": op10_random_indexing,
    "op11_language_families": op11_language_families,
    "op12_spectrum_whitening": op12_spectrum_whitening,
    "op13_son_phrases": op13_son_phrases,
}
ORACLE_SQL: dict[str, str] = {"op2_tool_calls": OP2_SQL, "op3_cover_tree": OP3_SQL, "op6_site_lines": OP6_SQL, "op13_son_phrases": OP13_SQL}
