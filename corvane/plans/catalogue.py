"""Registered queries of the engine and the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane import streaming
from corvane.functions import legal
from corvane.functions import scores as S
from corvane.functions import text as T
from corvane.operators import audit, corpus, encode, evaluate, experiments, retrieve, verify
from corvane.plans import fixtures
from corvane.plans.api import Engine
from corvane.sources import table
from corvane.sources.store import materialise

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def registered(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


# ---------------------------------------------------------------- SQL pieces

def _tokens(text: str) -> str:
    return f"list_transform(list_filter(string_split_regex({text}, '\\s+'), lambda w: w <> '' AND (length(w) > 1 OR regexp_full_match(w, '[\\p{{L}}\\p{{N}}]'))), lambda w: lower(w))"


_WORDS = "list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')"
_BM25 = f"""
tok AS MATERIALIZED (SELECT doc_id AS key, {_tokens('text')} AS t FROM documents),
len AS (SELECT key, len(t) AS dl FROM tok),
post AS MATERIALIZED (SELECT term, key, count(*) AS tf FROM (SELECT key, unnest(t) AS term FROM tok) GROUP BY 1, 2),
tot AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM len),
df AS MATERIALIZED (SELECT term, count(*) AS df FROM post GROUP BY 1),
raw AS MATERIALIZED (SELECT term, df, ln(n - df + 0.5) - ln(df + 0.5) AS r FROM df, tot),
floor_ AS MATERIALIZED (SELECT 0.25 * avg(r) AS low FROM raw),
idf AS MATERIALIZED (SELECT term, df, CASE WHEN r < 0 THEN low ELSE r END AS idf FROM raw, floor_)
"""


def _bm25_hits(source: str) -> str:
    return f"""
asked AS (SELECT query, term, count(*) AS times FROM (SELECT query, unnest({_tokens('qtext')}) AS term FROM ({source})) GROUP BY 1, 2),
scored AS (SELECT query, post.key, round(sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
  FROM asked JOIN idf USING (term) JOIN post USING (term) JOIN len ON len.key = post.key, tot GROUP BY 1, 2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, key) AS rank FROM scored)
"""


# ---------------------------------------------------------------- text

@registered(f"SELECT doc_id, {_tokens('text')} AS tokens FROM documents")
def bm25_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", T.bm25_tokens(F.col("text")).alias("tokens"))


_CLAIMS = r"""
c0 AS (SELECT conv_id, turn, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM conversations WHERE role = 'assistant'),
c1 AS (SELECT conv_id, turn, string_split(regexp_replace(t, '([.!?])\s+([A-Z0-9"''])', '\1' || chr(1) || '\2', 'g'), chr(1)) AS ss FROM c0),
c2 AS (SELECT conv_id, turn, unnest(range(1, len(ss) + 1)) AS s, unnest(ss) AS source_sentence FROM c1),
c3 AS (SELECT conv_id, turn, s, source_sentence, list_filter(list_transform(string_split_regex(source_sentence, '(?i);|\b(?:and|but|whereas|furthermore|moreover)\b'), lambda x: trim(x)), lambda x: x <> '') AS ps FROM c2 WHERE source_sentence <> ''),
c4 AS (SELECT conv_id, turn, s, source_sentence, CASE WHEN len(ps) > 0 THEN ps ELSE [source_sentence] END AS ps FROM c3),
c5 AS (SELECT conv_id, turn, s, source_sentence, unnest(range(1, len(ps) + 1)) AS p, unnest(ps) AS c FROM c4),
c6 AS (SELECT conv_id, turn, s, p, source_sentence, upper(c[1]) || c[2:] AS c FROM c5),
c7 AS (SELECT conv_id, turn, s, p, source_sentence, CASE WHEN regexp_matches(c, '[.!?]$') THEN c ELSE c || '.' END AS claim_text FROM c6),
claims AS (SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id, turn ORDER BY s, p) AS INTEGER) AS claim_index, claim_text, source_sentence FROM c7 WHERE len(string_split_regex(claim_text, '\s+')) >= 3)
"""


def _claims(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "conversations").where("role = 'assistant'").select("conv_id", "turn", "text")
    return T.decompose_claims(rows, "text", "conv_id", "turn")


@registered(f"WITH {_CLAIMS} SELECT *, 'rule_based' AS method FROM claims")
def decompose_claims(spark: SparkSession, sf: str) -> DataFrame:
    return _claims(spark, sf)


@registered()
def sentence_units(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", T.sentences(F.col("text")).alias("sentences"))


@registered(f"SELECT doc_id, array_to_string({_WORDS}[1:15], ' ') AS evidence FROM documents")
def truncate_evidence(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", T.first_words(F.col("text")).alias("evidence"))


@registered("SELECT doc_id, CASE WHEN length(text) > 200 THEN text[1:200] || '...' ELSE text END AS snippet, length(text) - length(replace(text, ' ', '')) + 1 AS approx_tokens FROM documents")
def snippets(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", T.snippet(F.col("text")).alias("snippet"), T.approx_tokens(F.col("text")).cast("long").alias("approx_tokens"))


def _values(rows: list[tuple], names: str) -> str:
    def lit(x) -> str:
        return "NULL" if x is None else "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)

    return "(VALUES " + ", ".join("(" + ", ".join(lit(x) for x in r) + ")" for r in rows) + f") AS v({names})"


_REPLIES = [(1, '["One claim here.", " Two claims here. ", ""]'), (2, '```json\n["Fenced."]\n```'), (3, "no list at all"), (4, '{"a": 1}')]


@registered(f"""SELECT id, CASE WHEN json_valid(b) AND json_type(b) = 'ARRAY' THEN list_filter(list_transform(CAST(json(b) AS VARCHAR[]), lambda x: trim(x)), lambda x: x <> '') END AS claims
FROM (SELECT id, trim(regexp_replace(reply, '^```(json)?\\s*|\\s*```$', '', 'g')) AS b FROM {_values(_REPLIES, 'id, reply')})""")
def llm_json_parse(spark: SparkSession, sf: str) -> DataFrame:
    return spark.createDataFrame(_REPLIES, "id int, reply string").select("id", T.parse_claim_list(F.col("reply")).alias("claims"))


# ---------------------------------------------------------------- retrieval

@registered(f"WITH {_BM25} SELECT term, df, round(idf, 6) AS idf FROM idf")
def bm25_index(spark: SparkSession, sf: str) -> DataFrame:
    return retrieve.bm25_index(table(spark, sf, "documents"), "doc_id", "text").terms.select("term", "df", F.round("idf", 6).alias("idf"))


def _bm25(spark: SparkSession, sf: str, k: int = 5) -> DataFrame:
    index = retrieve.bm25_index(table(spark, sf, "documents"), "doc_id", "text")
    return retrieve.bm25_search(index, table(spark, sf, "benchmark"), "item_id", "text", k)


_ITEMS = "SELECT item_id AS query, text AS qtext FROM benchmark"


@registered(f"WITH {_BM25}, {_bm25_hits(_ITEMS)} SELECT query AS item_id, key AS doc_id, score, rank FROM ranked WHERE rank <= 5")
def bm25_topk(spark: SparkSession, sf: str) -> DataFrame:
    return _bm25(spark, sf).select(F.col("query").alias("item_id"), F.col("key").alias("doc_id"), "score", F.col("rank").cast("long").alias("rank"))


@registered(f"WITH {_BM25}, {_bm25_hits(_ITEMS)} SELECT query AS item_id, d.doc_id, d.lang, rank FROM ranked JOIN documents d ON d.doc_id = key AND d.lang <> 'en' WHERE rank <= 20")
def bm25_meta_align(spark: SparkSession, sf: str) -> DataFrame:
    meta = table(spark, sf, "documents").where("lang <> 'en'").select("doc_id", "lang")
    return retrieve.with_metadata(_bm25(spark, sf, 20), meta, "doc_id").select(F.col("query").alias("item_id"), F.col("key").alias("doc_id"), "lang", F.col("rank").cast("long").alias("rank"))


_DENSE = """
q AS (SELECT vec_id AS query, label AS qlabel, CAST(embedding AS DOUBLE[]) AS qv FROM embeddings WHERE vec_id % 50 = 0),
s AS (SELECT query, vec_id AS key, label, qlabel, round(list_dot_product(qv, CAST(embedding AS DOUBLE[])), 6) AS score FROM q, embeddings)
"""
_DENSE_TOP = "SELECT query, key, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, key) AS rank FROM s {}) WHERE rank <= {}"


def _dense(spark: SparkSession, sf: str, k: int, scoped: bool = False) -> DataFrame:
    vectors = table(spark, sf, "embeddings")
    asked = vectors.where("vec_id % 50 = 0")
    options = {"docket": "label", "query_docket": "label"} if scoped else {}
    return retrieve.dense_search(asked, vectors, "vec_id", "embedding", "vec_id", "embedding", k, **options)


@registered(f"WITH {_DENSE} {_DENSE_TOP.format('', 5)}")
def dense_topk(spark: SparkSession, sf: str) -> DataFrame:
    return _dense(spark, sf, 5).withColumn("rank", F.col("rank").cast("long"))


@registered(f"WITH {_DENSE} {_DENSE_TOP.format('WHERE label = qlabel', 5)}")
def dense_scoped_topk(spark: SparkSession, sf: str) -> DataFrame:
    return _dense(spark, sf, 5, scoped=True).withColumn("rank", F.col("rank").cast("long"))


def _vector(text: str) -> str:
    """SQL of encode.hashed_vector."""
    counts = f"list_transform(range({encode.DIMENSIONS}), lambda i: len(list_filter(list_transform({_tokens(text)}, lambda t: CAST('0x' || md5(t)[1:6] AS BIGINT) % {encode.DIMENSIONS}), lambda x: x = i))::DOUBLE)"
    return f"(SELECT CASE WHEN list_sum(c) > 0 THEN list_transform(c, lambda x: x / sqrt(list_sum(list_transform(c, lambda y: y * y)))) ELSE c END FROM (SELECT {counts} AS c))"


_ENCODED = f"""
dv AS MATERIALIZED (SELECT doc_id AS key, {_vector('text')} AS v FROM documents), qv AS MATERIALIZED (SELECT item_id AS query, {_vector('text')} AS q FROM benchmark),
dr AS (SELECT query, key, round(list_dot_product(q, v), 6) AS score FROM qv, dv),
dense AS (SELECT query, key, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, key) AS rank FROM dr) WHERE rank <= 10)
"""


def _dense_text(spark: SparkSession, sf: str, k: int = 10) -> DataFrame:
    items, docs = (encode.encode(table(spark, sf, name).select(key, "text"), "text") for name, key in (("benchmark", "item_id"), ("documents", "doc_id")))
    return retrieve.dense_search(items, docs, "item_id", "vector", "doc_id", "vector", k)


@registered(f"SELECT doc_id, list_transform({_vector('text')}, lambda x: round(x, 6)) AS vector FROM documents")
def encode_documents(spark: SparkSession, sf: str) -> DataFrame:
    return encode.encode(table(spark, sf, "documents").select("doc_id", "text"), "text").select("doc_id", F.transform("vector", lambda x: F.round(x, 6)).alias("vector"))


@registered(f"WITH {_ENCODED} SELECT query AS item_id, key AS doc_id, score, rank FROM dense")
def dense_text_topk(spark: SparkSession, sf: str) -> DataFrame:
    return _dense_text(spark, sf).select(F.col("query").alias("item_id"), F.col("key").alias("doc_id"), "score", F.col("rank").cast("long").alias("rank"))


@registered(f"""WITH {_BM25}, {_bm25_hits(_ITEMS)}, {_ENCODED},
u AS (SELECT query, key, rank, 0 AS list FROM dense UNION ALL SELECT query, key, rank, 1 AS list FROM ranked WHERE rank <= 10),
f AS (SELECT query, key, sum(1.0::DOUBLE / (60 + rank)) AS score, min(list * 1000000 + rank) AS first FROM u GROUP BY 1, 2)
SELECT query, key, round(score, 6) AS score, rank, 'hybrid_rrf' AS method FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 12) DESC, first, key) AS rank FROM f) WHERE rank <= 10""")
def hybrid_rrf(spark: SparkSession, sf: str) -> DataFrame:
    """Dense hits and BM25 hits of the same texts."""
    return retrieve.reciprocal_rank_fusion(_dense_text(spark, sf), _bm25(spark, sf, 10), 10).withColumn("rank", F.col("rank").cast("long"))


# ---------------------------------------------------------------- verification

_KEYED = "SELECT conv_id || '#' || turn || '#' || claim_index AS query, claim_text AS qtext FROM claims"
_FLAGSHIP = f"""WITH {_BM25}, {_CLAIMS}, {_bm25_hits(_KEYED)},
h AS (SELECT query, key, rank FROM ranked WHERE rank <= 5),
hits AS (SELECT * FROM h QUALIFY key = first_value(key) OVER (PARTITION BY query ORDER BY rank)),
pairs AS (SELECT query, rank, key, list_distinct({_tokens('qtext')}) AS c, {_tokens('text')} AS t FROM hits JOIN ({_KEYED}) USING (query) JOIN documents ON doc_id = key),
sc AS (SELECT query, rank, key, round(CASE WHEN len(c) = 0 THEN 0 ELSE len(list_filter(c, lambda x: list_contains(t, x))) / len(c) END, 6) AS sup FROM pairs),
v AS (SELECT query, sup, CASE WHEN sup >= 0.7 THEN 'SUPPORTED' ELSE 'UNSUPPORTED' END AS verdict, CASE WHEN sup >= 0.7 THEN sup ELSE round(1 - sup, 6) END AS confidence, key FROM sc),
a AS (SELECT c.conv_id, coalesce(v.verdict, 'UNSUPPORTED') AS verdict, coalesce(v.confidence, 1.0) AS confidence FROM claims c LEFT JOIN v ON v.query = c.conv_id || '#' || c.turn || '#' || c.claim_index)
SELECT conv_id, round(greatest(0.0, least(1.0, sum(CASE WHEN verdict = 'SUPPORTED' THEN confidence ELSE 0 END) / count(*))), 4) AS trust_score, count(*) AS total_claims,
count(*) FILTER (verdict = 'SUPPORTED') AS n_supported, count(*) FILTER (verdict = 'CONTRADICTED') AS n_contradicted, count(*) FILTER (verdict = 'UNSUPPORTED') AS n_unsupported FROM a GROUP BY 1"""


@registered(_FLAGSHIP)
def verify_flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Assistant turns to claims, BM25 evidence, verdicts and trust per conversation."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), "doc_id", "text")
    claims = _claims(spark, sf).withColumn("response", F.concat_ws("#", "conv_id", "turn"))
    engine = Engine(docs)
    verdicts = engine.verdicts(claims, "response").select("conv_id", "verdict", "confidence")
    return verify.trust(verdicts, "conv_id").select("conv_id", "trust_score", "total_claims", "n_supported", "n_contradicted", "n_unsupported")


_TOP20 = f"WITH {_DENSE} {_DENSE_TOP.format('', 20)}"


@registered(f"""SELECT claim, rank, doc_id, anchor FROM (SELECT *, first_value(doc_id IGNORE NULLS) OVER (PARTITION BY claim ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS anchor
FROM (SELECT query AS claim, rank, CASE WHEN key % 4 <> 0 THEN CAST(key % 3 AS VARCHAR) END AS doc_id FROM ({_TOP20}))) WHERE anchor IS NULL OR doc_id = anchor""")
def docket_anchor(spark: SparkSession, sf: str) -> DataFrame:
    hits = _dense(spark, sf, 20).select(F.col("query").alias("claim"), F.col("rank").cast("long").alias("rank"), F.when(F.col("key") % 4 != 0, (F.col("key") % 3).cast("string")).alias("doc_id"))
    return verify.anchored(hits, "claim")


_JUDGED = f"""(SELECT query AS claim, rank, 'c' || key AS chunk_id, CASE key % 3 WHEN 0 THEN 'SUPPORTED' WHEN 1 THEN 'CONTRADICTED' ELSE 'UNSUPPORTED' END AS verdict, (key % 97) / 100 AS confidence, (key % 89) / 100 AS neutral,
key % 7 AS d, key % 5 AS h FROM ({_TOP20}) WHERE key % 3 <> 1 OR query % 200 = 0)"""


def _judged(spark: SparkSession, sf: str) -> DataFrame:
    """Dense hits as scored passages: verdicts, confidences and flags by key, with few contradictions so that all verdicts occur."""
    key = F.col("key")
    rows = _dense(spark, sf, 20).where((key % 3 != 1) | (F.col("query") % 200 == 0))
    verdict = F.when(key % 3 == 0, "SUPPORTED").when(key % 3 == 1, "CONTRADICTED").otherwise("UNSUPPORTED")
    return rows.select(F.col("query").alias("claim"), F.col("rank").cast("long").alias("rank"), F.concat(F.lit("c"), key).alias("chunk_id"), verdict.alias("verdict"), (key % 97 / 100).alias("confidence"), (key % 89 / 100).alias("p_unsupported"), (key % 7 == 1).alias("deterministic"), (key % 5 == 1).alias("high_flag"))


def _verdicts(spark: SparkSession, sf: str) -> DataFrame:
    return verify.synthesize(_judged(spark, sf), "claim")


_VERDICTS = f"""SELECT claim, CASE WHEN con THEN 'CONTRADICTED' WHEN sup THEN 'SUPPORTED' ELSE 'UNSUPPORTED' END AS verdict,
CAST(CASE WHEN con THEN greatest(con_conf, CASE WHEN high THEN 0.85 ELSE 0.70 END) WHEN sup THEN sup_conf ELSE neutral END AS DOUBLE) AS confidence,
CASE WHEN con THEN con_chunk WHEN sup THEN sup_chunk ELSE first END AS evidence_id FROM (SELECT claim, bool_or(c) AS con, bool_or(s) AS sup, max(confidence) FILTER (c) AS con_conf, max(confidence) FILTER (s) AS sup_conf,
arg_max(chunk_id, confidence * 100000 - rank) FILTER (c AND confidence > 0) AS con_chunk, arg_max(chunk_id, confidence * 100000 - rank) FILTER (s) AS sup_chunk, arg_min(chunk_id, rank) AS first, max(neutral) AS neutral, bool_or(h = 1) AS high
FROM (SELECT *, d = 1 OR verdict = 'CONTRADICTED' AS c, verdict = 'SUPPORTED' AND confidence > 0 AS s FROM {_JUDGED}) GROUP BY 1)"""


@registered(_VERDICTS)
def verdict_synthesis(spark: SparkSession, sf: str) -> DataFrame:
    return _verdicts(spark, sf)


@registered(f"""SELECT round(greatest(0, least(1, (sum(CASE WHEN verdict = 'SUPPORTED' THEN confidence ELSE 0 END) - sum(CASE WHEN verdict = 'CONTRADICTED' THEN confidence ELSE 0 END)) / count(*))), 4) AS trust_score,
count(*) AS total_claims, round(100 * count(*) FILTER (verdict = 'SUPPORTED') / count(*), 2) AS pct_supported FROM ({_VERDICTS})""")
def trust_score(spark: SparkSession, sf: str) -> DataFrame:
    return verify.trust(_verdicts(spark, sf)).select("trust_score", "total_claims", "pct_supported")


@registered(f"SELECT claim AS citation_index, verdict, evidence_id AS chunk_id FROM ({_VERDICTS}) WHERE evidence_id IS NOT NULL")
def citations(spark: SparkSession, sf: str) -> DataFrame:
    rows = _verdicts(spark, sf).withColumns({"claim_index": F.col("claim"), "claim_text": F.lit("")})
    passages = table(spark, sf, "embeddings").select(F.concat(F.lit("c"), "vec_id").alias("chunk_id"), F.col("label").cast("string").alias("doc_id"), F.lit("text").alias("text"), F.lit(0).alias("char_start"), F.lit(4).alias("char_end"))
    return verify.citations(rows, passages, "claim").select("citation_index", "verdict", "chunk_id")


@registered()
def report(spark: SparkSession, sf: str) -> DataFrame:
    rows = _verdicts(spark, sf).withColumns({"one": F.lit(1), "claim_index": F.col("claim"), "claim_text": F.lit("A claim."), "reason": F.lit(None).cast("string"), "evidence_text": F.col("evidence_id")})
    return verify.report(rows, verify.trust(rows, "one"), "one")


@registered("""SELECT vec_id, round(exp(a - m) / z, 6) AS p_supported, round(exp(b - m) / z, 6) AS p_contradicted, CASE WHEN exp(a - m) / z >= 0.7 THEN 'SUPPORTED' WHEN exp(b - m) / z >= 0.7 THEN 'CONTRADICTED' ELSE 'UNSUPPORTED' END AS verdict,
round(CASE WHEN exp(a - m) / z >= 0.7 THEN exp(a - m) / z WHEN exp(b - m) / z >= 0.7 THEN exp(b - m) / z ELSE exp(c - m) / z END, 6) AS confidence
FROM (SELECT *, exp(a - m) + exp(b - m) + exp(c - m) AS z FROM (SELECT *, greatest(a, b, c) AS m FROM (SELECT vec_id, 8 * embedding[1]::DOUBLE AS a, 8 * embedding[2]::DOUBLE AS b, 8 * embedding[3]::DOUBLE AS c FROM embeddings)))""")
def nli_decide(spark: SparkSession, sf: str) -> DataFrame:
    """Numbers of the vectors as logits."""
    rows = table(spark, sf, "embeddings").select("vec_id", S.softmax(F.transform(F.slice("embedding", 1, 3), lambda x: 8 * x.cast("double"))).alias("p"))
    p = [F.col("p")[i] for i in range(3)]
    return rows.select("vec_id", F.round(p[0], 6).alias("p_supported"), F.round(p[1], 6).alias("p_contradicted"), S.nli_verdict(p[0], p[1]).alias("verdict"), F.round(S.nli_confidence(*p), 6).alias("confidence"))


def _legal_sql(kind: str, text: str) -> str:
    return "list_sort(list_distinct(list_transform(" + " || ".join(f"regexp_extract_all({text}, '{p}', 0, 'i')" for p in legal.PATTERNS[kind]) + ", lambda x: trim(x))))"


@registered(f"SELECT id, {', '.join(_legal_sql(k, 'claim') + f' AS {k}' for k in legal.PATTERNS)} FROM {_values(fixtures.LEGAL_PAIRS, 'id, claim, evidence')}")
def extract_entities(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.createDataFrame(fixtures.LEGAL_PAIRS, "id int, claim string, evidence string")
    return rows.select("id", *[legal.references(F.col("claim"), k).alias(k) for k in legal.PATTERNS])


def _mismatch(k: str) -> str:
    return f"(len(c_{k}) > 0 AND len(e_{k}) > 0 AND len(list_filter(c_{k}, lambda x: NOT list_contains(e_{k}, x))) > 0)"


@registered(f"""SELECT id, {_mismatch('provisions')} AS provision_flag, {_mismatch('citations')} AS citation_flag, {_mismatch('dates')} AS date_flag,
{_mismatch('citations')} OR ({_mismatch('provisions')} AND len(c_provisions) = 1 AND len(e_provisions) = 1) AS deterministic
FROM (SELECT id, {', '.join(_legal_sql(k, t) + f' AS {t[0]}_{k}' for k in ('provisions', 'citations', 'dates') for t in ('claim', 'evidence'))} FROM {_values(fixtures.LEGAL_PAIRS, 'id, claim, evidence')})""")
def legal_flags(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.createDataFrame(fixtures.LEGAL_PAIRS, "id int, claim_text string, text string")
    rows = verify.with_legal_checks(rows)
    has = lambda kind: F.exists("legal_flags", lambda f: f["type"] == kind)
    return rows.select("id", has("PROVISION_MISMATCH").alias("provision_flag"), has("CITATION_MISMATCH").alias("citation_flag"), has("DATE_MISMATCH").alias("date_flag"), "deterministic")


_PAIR = f"SELECT b.item_id, d.doc_id, b.text AS claim, d.text AS passage FROM ranked JOIN benchmark b ON b.item_id = query JOIN documents d ON d.doc_id = key WHERE rank <= 5"
_TF = "len(list_filter(t, lambda x: x = w))"


@registered(f"""WITH {_BM25}, {_bm25_hits(_ITEMS)} SELECT item_id, doc_id, score, 'UNSUPPORTED' AS verdict FROM (SELECT item_id, doc_id, CASE WHEN len(c) > 0 AND len(t) > 0 THEN round(coalesce(list_sum(list_transform(c, lambda w: (ln(0.5) - ln(1.5)) * 0.25 * {_TF} * 2.5 / ({_TF} + 1.5))), 0), 6) ELSE 0 END AS score
FROM (SELECT item_id, doc_id, {_tokens('claim')} AS c, {_tokens('passage')} AS t FROM ({_PAIR})))""")
def bm25_verifier(spark: SparkSession, sf: str) -> DataFrame:
    """Each item against its five best BM25 documents."""
    items = table(spark, sf, "benchmark").select("item_id", T.bm25_tokens(F.col("text")).alias("claim_tokens"))
    docs = table(spark, sf, "documents").select("doc_id", T.bm25_tokens(F.col("text")).alias("passage_tokens"))
    hits = _bm25(spark, sf).select(F.col("query").alias("item_id"), F.col("key").alias("doc_id"))
    return verify.bm25_verifier(hits.join(items, "item_id").join(docs, "doc_id"), 2.5).select("item_id", "doc_id", "score", "verdict")


@registered(f"""WITH {_BM25}, {_bm25_hits(_ITEMS)} SELECT item_id, doc_id, score, CASE WHEN score >= 0.55 THEN 'SUPPORTED' ELSE 'UNSUPPORTED' END AS verdict
FROM (SELECT item_id, doc_id, round(list_dot_product({_vector('claim')}, {_vector('passage')}), 6) AS score FROM ({_PAIR}))""")
def cosine_verifier(spark: SparkSession, sf: str) -> DataFrame:
    """Each item against its five best BM25 documents, both encoded."""
    items, docs = table(spark, sf, "benchmark").select("item_id", F.col("text").alias("claim")), table(spark, sf, "documents").select("doc_id", "text")
    hits = _bm25(spark, sf).select(F.col("query").alias("item_id"), F.col("key").alias("doc_id"))
    pairs = encode.encode(encode.encode(hits.join(items, "item_id").join(docs, "doc_id"), "claim", "a"), "text", "b")
    return verify.cosine_verifier(pairs, "a", "b", 0.55).select("item_id", "doc_id", "score", "verdict")


# ---------------------------------------------------------------- evaluation

_PAIRS_SQL = "(SELECT l.doc_id, CASE WHEN quality = 1 THEN 'SUP' WHEN toxic = 1 THEN 'CON' ELSE 'NEI' END AS t, CASE WHEN n_chars % 3 = 0 THEN 'SUPPORTED' WHEN n_chars % 3 = 1 THEN 'CONTRADICTED' ELSE 'UNSUPPORTED' END AS p, CASE WHEN n_chars % 2 = 0 THEN 'a' ELSE 'b' END AS system, (n_chars % 100) / 100.0 AS c FROM labels l JOIN documents USING (doc_id))"
_CANON = f"(SELECT doc_id, system, c, CASE t WHEN 'SUP' THEN 'SUPPORTED' WHEN 'CON' THEN 'CONTRADICTED' ELSE 'UNSUPPORTED' END AS t, p FROM {_PAIRS_SQL})"


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id")
    n = F.col("n_chars")
    truth = F.when(F.col("quality") == 1, "SUP").when(F.col("toxic") == 1, "CON").otherwise("NEI")
    guess = F.element_at(F.array(*[F.lit(x) for x in S.LABELS]), (n % 3 + 1).cast("int"))
    rows = rows.select("doc_id", truth.alias("truth"), guess.alias("guess"), F.when(n % 2 == 0, "a").otherwise("b").alias("system"), ((n % 100) / 100).alias("c"))
    return evaluate.labelled(rows, "truth", "guess", "doc_id", "system", "c")


_NAMES = [(1, " sup "), (2, "CON"), (3, "nei"), (4, "Supported"), (5, "what"), (6, "CONTRADICTED")]


@registered(f"SELECT id, CASE WHEN upper(trim(x)) IN ('SUP', 'SUPPORTED') THEN 'SUPPORTED' WHEN upper(trim(x)) IN ('CON', 'CONTRADICTED') THEN 'CONTRADICTED' ELSE 'UNSUPPORTED' END AS label FROM {_values(_NAMES, 'id, x')}")
def normalize_label(spark: SparkSession, sf: str) -> DataFrame:
    return spark.createDataFrame(_NAMES, "id int, x string").select("id", S.normalize_label(F.col("x")).alias("label"))


@registered("SELECT l.label, " + ", ".join(f"count(*) FILTER (t = l.label AND p = '{x}') AS pred_{x.lower()}" for x in S.LABELS) + f" FROM (VALUES ('SUPPORTED'), ('CONTRADICTED'), ('UNSUPPORTED')) l(label) LEFT JOIN {_CANON} ON true GROUP BY 1")
def confusion_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.confusion_matrix(_pairs(spark, sf))


_CLASS_SQL = f"""SELECT system, label, count(*) FILTER (t = label AND p = label) AS tp, count(*) FILTER (p = label) AS pp, count(*) FILTER (t = label) AS support FROM {_CANON}, (VALUES ('SUPPORTED'), ('CONTRADICTED'), ('UNSUPPORTED')) l(label) GROUP BY 1, 2"""
_PRF_SQL = f"SELECT *, CASE WHEN pr + re = 0 THEN 0 ELSE 2 * pr * re / (pr + re) END AS f FROM (SELECT *, CASE WHEN pp = 0 THEN 0 ELSE tp / pp END AS pr, CASE WHEN support = 0 THEN 0 ELSE tp / support END AS re FROM ({_CLASS_SQL}))"


@registered(f"SELECT system, label, round(pr, 4) AS precision, round(re, 4) AS recall, round(f, 4) AS f1, support FROM ({_PRF_SQL})")
def per_class_prf(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.per_class(_pairs(spark, sf), "system").select("system", "label", "precision", "recall", "f1", "support")


_METRICS_SQL = f"""SELECT a.system, accuracy, fsr, n, macro_f1 FROM (SELECT system, round(avg(CASE WHEN t = p THEN 1.0 ELSE 0.0 END), 4) AS accuracy, round(count(*) FILTER (t <> 'SUPPORTED' AND p = 'SUPPORTED') / count(*) FILTER (t <> 'SUPPORTED'), 4) AS fsr, count(*) AS n FROM {_CANON} GROUP BY 1) a
JOIN (SELECT system, round(avg(f), 4) AS macro_f1 FROM ({_PRF_SQL}) GROUP BY 1) b USING (system)"""


@registered(_METRICS_SQL)
def ablation_grid(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.metrics(_pairs(spark, sf), "system").select("system", "accuracy", "fsr", "n", "macro_f1")


@registered(f"SELECT round(count(*) FILTER (t <> 'SUPPORTED' AND p = 'SUPPORTED') / count(*) FILTER (t <> 'SUPPORTED'), 4) AS fsr FROM {_CANON}")
def fsr(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.metrics(_pairs(spark, sf)).select("fsr")


@registered(f"SELECT p AS label, system, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY system), 4) AS share FROM {_CANON} GROUP BY 1, 2")
def label_distribution(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.label_distribution(_pairs(spark, sf), "p", "system")


@registered(f"SELECT threshold, count(*) FILTER (c >= threshold) AS kept, round(count(*) FILTER (c >= threshold) / count(*), 4) AS coverage, round(coalesce(count(*) FILTER (c >= threshold AND t = p) / nullif(count(*) FILTER (c >= threshold), 0), 0), 4) AS precision FROM {_CANON}, (VALUES (0.5), (0.7), (0.8), (0.9), (0.95)) v(threshold) GROUP BY 1")
def confidence_sweep(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.confidence_sweep(_pairs(spark, sf), "c", F.col("t") == F.col("p"), [0.5, 0.7, 0.8, 0.9, 0.95]).withColumn("threshold", F.col("threshold").cast("decimal(3,2)"))


@registered(f"SELECT doc_id, CASE WHEN c < 0.2 THEN 'CONTRADICTED' ELSE p END AS verdict FROM {_CANON}")
def hybrid_override(spark: SparkSession, sf: str) -> DataFrame:
    return _pairs(spark, sf).select("doc_id", verify.hybrid_override(F.col("p"), F.col("c") < 0.2).alias("verdict"))


@registered(f"SELECT system, count(*) AS n FROM {_CANON} WHERE t IN ('CONTRADICTED', 'UNSUPPORTED') GROUP BY 1")
def expb_subset(spark: SparkSession, sf: str) -> DataFrame:
    return _pairs(spark, sf).where(F.col("t").isin("CONTRADICTED", "UNSUPPORTED")).groupBy("system").agg(F.count("*").alias("n"))


@registered("""WITH p AS (SELECT doc_id, lang, row_number() OVER (ORDER BY doc_id) - 1 AS pos, count(*) OVER () AS n FROM documents)
SELECT a.doc_id, b.doc_id AS other_doc_id, b.lang AS rotated FROM p a JOIN p b ON b.pos = (a.pos + 45) % a.n""")
def evidence_rotation(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.rotate_evidence(table(spark, sf, "documents"), "doc_id", "lang")


@registered("SELECT doc_id, CASE (row_number() OVER (ORDER BY doc_id) - 1) % 3 WHEN 0 THEN 'SUP' WHEN 1 THEN 'CON' ELSE 'NEI' END AS gold_label FROM documents")
def balanced_labels(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.numbered(table(spark, sf, "documents").select("doc_id"), "doc_id").select("doc_id", evaluate.balanced_label(F.col("pos")).alias("gold_label"))


_MUTATED = "CASE " + " ".join(f"WHEN regexp_matches(c, '(?i){p}') THEN regexp_replace(c, '(?i){p}', '{r}')" for p, r in T.MUTATIONS) + " ELSE replace(replace('It was conclusively held that ' || lower(c[1]) || c[2:], 'is', 'is not'), 'was', 'was not') END"


@registered(f"WITH {_CLAIMS} SELECT conv_id, turn, claim_index, {_MUTATED} AS claim FROM (SELECT *, claim_text AS c FROM claims)")
def mutate_claim(spark: SparkSession, sf: str) -> DataFrame:
    return _claims(spark, sf).select("conv_id", "turn", "claim_index", T.mutate_claim(F.col("claim_text")).alias("claim"))


_SPLIT = "CASE WHEN CAST('0x' || md5(doc_id || ':split')[1:6] AS BIGINT) % 10000 < 3500 THEN 'dev' ELSE 'test' END"


@registered(f"SELECT split, lang, count(*) AS n, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, lang, {_SPLIT} AS split FROM documents) GROUP BY GROUPING SETS ((split, lang), (split))")
def split_summary(spark: SparkSession, sf: str) -> DataFrame:
    rows = evaluate.split_by_document(table(spark, sf, "documents").select("doc_id", "lang"))
    return rows.groupingSets([["split", "lang"], ["split"]], "split", "lang").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("docs"))


@registered("SELECT doc_id FROM documents WHERE 1 = 0")
def leakage_check(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.leaked(evaluate.split_by_document(table(spark, sf, "documents").select("doc_id")))


@registered()
def nei_pairing(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", F.col("doc_id").alias("chunk_id"), "text")
    return evaluate.build_triples(docs).select("example_id", "doc_id", "chunk_id", "claim", "gold_label", "claim_type", "is_perturbed")


@registered("""SELECT doc_id, source, lang FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY md5(source || ':' || doc_id), doc_id) AS n FROM documents) WHERE n <= 10""")
def per_class_sample(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.per_class_sample(table(spark, sf, "documents").select("doc_id", "source", "lang"), "source", "doc_id", per_class_rows=10)


def _triples(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", F.col("doc_id").alias("chunk_id"), "text")
    return materialise(evaluate.build_triples(docs), "triples")


@registered()
def experiment_baselines(spark: SparkSession, sf: str) -> DataFrame:
    """Four verifiers on built triples."""
    return evaluate.metrics(experiments.baselines(experiments.verdicts(_triples(spark, sf))), "system")


@registered()
def experiment_legal_checks(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.metrics(experiments.legal_check_grid(experiments.verdicts(_triples(spark, sf))), "system")


@registered()
def experiment_ablations(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.metrics(experiments.ablations(experiments.verdicts(_triples(spark, sf))), "system")


@registered()
def experiment_robustness(spark: SparkSession, sf: str) -> DataFrame:
    return experiments.robustness(experiments.verdicts(experiments.degraded(_triples(spark, sf))))


@registered()
def experiment_report(spark: SparkSession, sf: str) -> DataFrame:
    return experiments.metrics_report(experiments.baselines(experiments.verdicts(_triples(spark, sf))))


# ---------------------------------------------------------------- corpus

@registered("SELECT text, arg_min(doc_id, doc_id) AS doc_id, arg_min(lang, doc_id) AS lang FROM documents GROUP BY 1")
def dedup_first(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.keep_first(table(spark, sf, "documents").select("text", "doc_id", "lang"), "text", "doc_id")


@registered("SELECT text, count(DISTINCT lang) AS n_lang FROM documents GROUP BY 1 HAVING count(DISTINCT lang) > 1")
def dedup_assert(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.conflicting(table(spark, sf, "documents"), "text", "lang")


@registered("SELECT lang AS label, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 4) AS share FROM (SELECT text, arg_min(lang, doc_id) AS lang FROM documents GROUP BY 1) GROUP BY 1")
def label_dist_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.label_distribution(dedup_first(spark, sf), "lang")


def _chunks(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.chunk_documents(table(spark, sf, "documents"), "doc_id", "text")


@registered()
def chunk_corpus(spark: SparkSession, sf: str) -> DataFrame:
    return _chunks(spark, sf)


@registered()
def chunk_stats(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.chunk_stats(_chunks(spark, sf))


@registered()
def chunk_filter(spark: SparkSession, sf: str) -> DataFrame:
    return _chunks(spark, sf).where("word_count >= 150").select("chunk_id", "word_count")


@registered("SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS docnum FROM documents")
def chunk_docnum(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.numbered(table(spark, sf, "documents").select("doc_id"), "doc_id").select("doc_id", (F.col("pos") + 1).alias("docnum"))


_CORRUPTED = "replace(replace(text, 'th', 'number'), 'con', 'company')"
_CORRUPT_SQL = r"list_filter(regexp_extract_all(text, '[\p{L}\p{N}_]+'), lambda x: regexp_full_match(x, '(?i)[A-Z]*(?:company|number)[A-Z]*'))"


def _corrupted(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.expr(_CORRUPTED).alias("text"))


@registered(f"SELECT doc_id, token, count(*) AS n FROM (SELECT doc_id, unnest({_CORRUPT_SQL}) AS token FROM (SELECT doc_id, {_CORRUPTED} AS text FROM documents)) GROUP BY 1, 2")
def corrupt_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.corrupt_tokens(_corrupted(spark, sf), "doc_id", "text")


def _resolved(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Tokens of the broken documents, and their resolutions by the words of the whole ones."""
    found = materialise(corpus.corrupt_tokens(_corrupted(spark, sf), "doc_id", "text"), "corrupt-tokens")
    return found, materialise(corpus.resolve_tokens(found, corpus.vocabulary(table(spark, sf, "documents"), "text")), "resolved-tokens")


@registered()
def repair_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return _resolved(spark, sf)[1]


@registered()
def fix_counts(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.fix_counts(*_resolved(spark, sf))


@registered()
def low_confidence_tokens(spark: SparkSession, sf: str) -> DataFrame:
    found, resolved = _resolved(spark, sf)
    return audit.low_confidence(resolved, found)


@registered()
def repair_documents(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.repair_texts(_corrupted(spark, sf), "doc_id", "text", corpus.vocabulary(table(spark, sf, "documents"), "text"))


@registered(f"SELECT * FROM {_values(fixtures.MENDED, 'doc_id, text')}")
def repair_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.repair_texts(spark.createDataFrame(fixtures.BROKEN, "doc_id int, text string"), "doc_id", "text", spark.createDataFrame(fixtures.DICTIONARY, "word string, freq double"))


@registered(f"SELECT * FROM {_values([(i, after) for i, _, after in fixtures.STANDALONE], 'id, text')}")
def standalone_number(spark: SparkSession, sf: str) -> DataFrame:
    return spark.createDataFrame([x[:2] for x in fixtures.STANDALONE], "id int, text string").select("id", T.repair_standalone_number(F.col("text")).alias("text"))


_PHRASES_SQL = " + ".join(f"len(regexp_extract_all(text, '\\b{p}\\b', 0, 'i'))" for p in T.NUMBER_PHRASES)


_NUMBERED = "replace(replace(text, ' the ', ' the number of '), ' in ', ' and number be ')"
_LOST = "replace(replace(text, ' the ', ' the not of '), ' in ', ' and number be ')"


@registered(f"SELECT doc_id, {_PHRASES_SQL} AS n FROM (SELECT doc_id, {_NUMBERED} AS text FROM documents)")
def legit_counts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", T.legit_number_count(F.expr(_NUMBERED)).alias("n"))


_DETERMINED = rf"(?i)\b(?:{'|'.join(audit.DETERMINERS)})\s+number\b"


@registered(rf"""SELECT doc_id, len(regexp_extract_all(text, '(?i)\bnumber\b')) - len(regexp_extract_all(text, '{_DETERMINED}')) - len(regexp_extract_all(text, '(?i)\bnumber\s+of\b')) + len(regexp_extract_all(text, '{_DETERMINED[:-2]}\s+of\b')) AS n
FROM (SELECT doc_id, {_NUMBERED} AS text FROM documents)""")
def standalone_numbers(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", audit.standalone_number_count(F.expr(_NUMBERED)).alias("n"))


def _cleaning(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Documents with noun phrases, and the same after a cleaning that spoiled some in odd documents."""
    docs = table(spark, sf, "documents")
    return docs.select("doc_id", F.expr(_NUMBERED).alias("text")), docs.select("doc_id", F.when(F.col("doc_id") % 2 == 1, F.expr(_LOST)).otherwise(F.expr(_NUMBERED)).alias("text"))


_BOTH = f"(SELECT doc_id, {_PHRASES_SQL.replace('text', 'raw')} AS b, {_PHRASES_SQL.replace('text', 'clean')} AS a FROM (SELECT doc_id, {_NUMBERED} AS raw, CASE WHEN doc_id % 2 = 1 THEN {_LOST} ELSE {_NUMBERED} END AS clean FROM documents))"


@registered(f"SELECT doc_id, b AS before, a AS after FROM {_BOTH} WHERE b > a")
def altered_phrases(spark: SparkSession, sf: str) -> DataFrame:
    return audit.altered_phrases(*_cleaning(spark, sf), "doc_id", "text")


@registered(f"SELECT CAST(sum(b) AS BIGINT) AS before, CAST(sum(a) AS BIGINT) AS after, round(100 * sum(a) / sum(b), 4) AS rate FROM {_BOTH}")
def preservation_rate(spark: SparkSession, sf: str) -> DataFrame:
    return audit.preservation(*_cleaning(spark, sf), "doc_id", "text")


@registered()
def phrase_examples(spark: SparkSession, sf: str) -> DataFrame:
    """A report of 20 examples, as the audit shows them."""
    return audit.phrase_examples(_cleaning(spark, sf)[0], "doc_id", "text")


@registered(f"SELECT lower(w) AS word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, 'company[a-z]+', 0, 'i')) AS w FROM {_values(fixtures.BROKEN, 'doc_id, text')}) GROUP BY 1")
def residual_scan(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.createDataFrame(fixtures.BROKEN, "doc_id int, text string").select(F.explode(F.regexp_extract_all("text", F.lit("(?i)company[a-z]+"), F.lit(0))).alias("w"))
    kept = spark.createDataFrame([(w,) for w in corpus.KEPT["company"]], "kept string")
    return rows.select(F.lower("w").alias("word")).join(F.broadcast(kept), F.col("word") == F.col("kept"), "left_anti").groupBy("word").agg(F.count("*").alias("n"))


_BEFORE, _AFTER = ["a", "the", "in", "case", "any"], ["only", "less", "more", "exceeding", "later", "earlier", "having", "being", "to", "be", "been", "available", "permissible", "entitled", "necessary"]
_PAIR_RE = rf"(?i)\b({'|'.join(_BEFORE)})\s+number\s+({'|'.join(_AFTER)})\b"


@registered(f"""WITH hit AS (SELECT lower(m.b) AS b, lower(m.a) AS a FROM (SELECT regexp_extract(x, '{_PAIR_RE}', ['b', 'a']) AS m FROM (SELECT unnest(regexp_extract_all(text, '{_PAIR_RE}', 0)) AS x FROM {_values([x[:2] for x in fixtures.STANDALONE], 'id, text')})))
SELECT b.x AS before, a.x AS after, count(hit.a) AS n FROM (SELECT unnest({_BEFORE}) AS x) b CROSS JOIN (SELECT unnest({_AFTER}) AS x) a LEFT JOIN hit ON hit.b = b.x AND hit.a = a.x GROUP BY 1, 2""")
def pair_residuals(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.createDataFrame([x[:2] for x in fixtures.STANDALONE], "id int, text string").select(F.explode(F.regexp_extract_all("text", F.lit(_PAIR_RE), F.lit(0))).alias("x"))
    hits = rows.groupBy(F.lower(F.regexp_extract("x", _PAIR_RE, 1)).alias("before"), F.lower(F.regexp_extract("x", _PAIR_RE, 2)).alias("after")).agg(F.count("*").alias("n"))
    grid = spark.createDataFrame([(b, a) for b in _BEFORE for a in _AFTER], "before string, after string")
    return grid.join(hits, ["before", "after"], "left").na.fill(0, ["n"])


@registered("SELECT source, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents) WHERE n <= 3")
def examples_per_group(spark: SparkSession, sf: str) -> DataFrame:
    return retrieve.top_k(table(spark, sf, "documents").select("source", "doc_id", F.lit(0).alias("score")), "source", "doc_id", 3).select("source", "doc_id")


_RIGHT_SQL = _values(fixtures.RIGHT_CONTEXTS, "occ_id, right_ctx")
_ROMAN = "(?:i|ii|iii|iv|v|vi|vii|viii|ix|x)"


@registered(f"SELECT occ_id, CASE WHEN regexp_matches(right_ctx, '^\\s*[-–—]\\s*[a-zA-Z]') THEN 'non' WHEN regexp_matches(right_ctx, '(?i)^\\s*(?:\\d+\\b|{_ROMAN}\\b|\\.\\s*\\d+)') THEN 'KEEP_NUMBER' END AS rule FROM {_RIGHT_SQL}")
def negation_rules(spark: SparkSession, sf: str) -> DataFrame:
    return spark.createDataFrame(fixtures.RIGHT_CONTEXTS, "occ_id int, right_ctx string").select("occ_id", T.negation_rule(F.col("right_ctx")).alias("rule"))


@registered(f"""SELECT kind, roman, count(*) AS n FROM (SELECT CASE WHEN regexp_matches(right_ctx, '^\\s*\\.\\s*\\d+') THEN 'dot_digit' WHEN regexp_matches(right_ctx, '^\\s*\\d+\\b') THEN 'digit' WHEN regexp_matches(right_ctx, '(?i)^\\s*{_ROMAN}\\b') THEN 'roman_numeral' END AS kind,
nullif(lower(regexp_extract(right_ctx, '(?i)^\\s*({_ROMAN})\\b', 1)), '') AS roman FROM {_RIGHT_SQL}) WHERE kind IS NOT NULL GROUP BY ROLLUP (kind, roman)""")
def trigger_rollup(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.createDataFrame(fixtures.RIGHT_CONTEXTS, "occ_id int, right_ctx string").select(T.number_trigger(F.col("right_ctx")).alias("kind"), T.roman_of(F.col("right_ctx")).alias("roman"))
    return rows.where("kind IS NOT NULL").rollup("kind", "roman").agg(F.count("*").alias("n"))


_PROBS = ["p_not", "p_nor", "p_now", "p_non", "p_no", "p_number"]


_WORDS_SQL = ", ".join(f"abs(embedding[{i + 1}]::DOUBLE) AS {p}" for i, p in enumerate(_PROBS))


@registered(f"SELECT vec_id, CASE greatest({', '.join(_PROBS)}) " + " ".join(f"WHEN {p} THEN '{p[2:]}'" for p in _PROBS) + f" END AS top1, greatest({', '.join(_PROBS)}) AS top1_p FROM (SELECT vec_id, {_WORDS_SQL} FROM embeddings)")
def negation_argmax(spark: SparkSession, sf: str) -> DataFrame:
    """Numbers of the vectors as probabilities of the six words."""
    rows = table(spark, sf, "embeddings").select("vec_id", *[F.abs(F.col("embedding")[i].cast("double")).alias(p) for i, p in enumerate(_PROBS)])
    return rows.select("vec_id", S.first_largest(_PROBS).alias("top1"), F.greatest(*_PROBS).alias("top1_p"))


_OCCURRENCES = "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN ' ' || n_chars || ' x' WHEN 1 THEN text[1:30] WHEN 2 THEN ' xi. ' || lang ELSE '.' || n_chars END AS after FROM documents"
_THIRD_SQL = audit._THIRD.replace("'", "''")
_ROUTED = f"(SELECT doc_id, fired, CASE WHEN fired OR doc_id % 6 = 5 THEN 'number' ELSE ['not', 'nor', 'now', 'non', 'no', 'number'][doc_id % 6 + 1] END AS guess, CASE WHEN fired THEN 1.0 ELSE (doc_id % 10) / 10 END::DOUBLE AS confidence FROM (SELECT doc_id, regexp_matches(after, '{_THIRD_SQL}') AS fired FROM ({_OCCURRENCES})))"
_CATEGORY = "CASE WHEN guess = 'number' THEN 'GENUINE_NOUN' ELSE 'MISSED_NEGATION' END"


def _routed(spark: SparkSession, sf: str) -> DataFrame:
    docs, k = table(spark, sf, "documents"), F.col("doc_id") % 4
    after = F.when(k == 0, F.concat(F.lit(" "), "n_chars", F.lit(" x"))).when(k == 1, F.substring("text", 1, 30)).when(k == 2, F.concat(F.lit(" xi. "), "lang")).otherwise(F.concat(F.lit("."), "n_chars"))
    scores = docs.select("doc_id", F.get(F.array(*[F.lit(w) for w in audit.NEGATIONS]), (F.col("doc_id") % 6).cast("int")).alias("guess"), (F.col("doc_id") % 10 / 10).alias("confidence"))
    return audit.routed(docs.select("doc_id", after.alias("after")), scores, "doc_id", "after")


@registered(f"SELECT doc_id, fired AS rule_fired, guess, confidence, {_CATEGORY} AS category FROM {_ROUTED}")
def routed_negations(spark: SparkSession, sf: str) -> DataFrame:
    return _routed(spark, sf).select("doc_id", "rule_fired", "guess", "confidence", "category")


_AUDITED = "CASE WHEN doc_id % 5 < 3 THEN 'GENUINE_NOUN' ELSE 'MISSED_NEGATION' END"


@registered(f"SELECT count(*) AS n, count(*) FILTER ({_CATEGORY} = {_AUDITED}) AS agreements, round(count(*) FILTER ({_CATEGORY} = {_AUDITED}) / count(*), 4) AS share FROM {_ROUTED}")
def audit_agreement(spark: SparkSession, sf: str) -> DataFrame:
    audited = table(spark, sf, "documents").select("doc_id", F.when(F.col("doc_id") % 5 < 3, "GENUINE_NOUN").otherwise("MISSED_NEGATION").alias("label"))
    return audit.agreement(_routed(spark, sf), audited, "doc_id", "label")


@registered(f"""SELECT word, tp, support, round(pr, 4) AS precision, round(re, 4) AS recall, round(CASE WHEN pr + re = 0 THEN 0 ELSE 2 * pr * re / (pr + re) END, 4) AS f1 FROM (SELECT *, coalesce(tp / nullif(pp, 0), 0) AS pr, coalesce(tp / nullif(support, 0), 0) AS re
FROM (SELECT word, count(*) FILTER (t = word AND guess = word) AS tp, count(*) FILTER (guess = word) AS pp, count(*) FILTER (t = word) AS support FROM (SELECT guess, {audit.NEGATIONS}[doc_id % 6 + 1] AS t FROM {_ROUTED}), (SELECT unnest({audit.NEGATIONS}) AS word) GROUP BY 1))""")
def negation_classes(spark: SparkSession, sf: str) -> DataFrame:
    truth = F.get(F.array(*[F.lit(w) for w in audit.NEGATIONS]), (F.col("doc_id") % 6).cast("int"))
    return audit.word_classes(_routed(spark, sf).withColumn("truth", truth), "truth", "guess")


@registered()
def rouge_l(spark: SparkSession, sf: str) -> DataFrame:
    from corvane.functions.rouge import rouge_l_f1

    items, docs = table(spark, sf, "benchmark").select("item_id", "text"), table(spark, sf, "documents").select("doc_id", "text")
    hits = Engine(docs.select(F.col("doc_id").alias("chunk_id"), "doc_id", "text")).search(items, "item_id", "text")
    pairs = hits.select(F.col("query").alias("item_id"), F.col("key").alias("doc_id")).join(docs, "doc_id").join(items.withColumnRenamed("text", "claim"), "item_id")
    f1 = F.round(rouge_l_f1(F.col("text"), F.col("claim")), 6)
    return pairs.select("item_id", "doc_id", f1.alias("f1")).withColumn("verdict", F.when(F.col("f1") >= 0.35, "SUPPORTED").otherwise("UNSUPPORTED"))


# ---------------------------------------------------------------- extension

@registered("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def event_windows(spark: SparkSession, sf: str) -> DataFrame:
    return streaming.windowed_counts(table(spark, sf, "events"), "ts", "event_type")
