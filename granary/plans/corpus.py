"""The driver's tables as a document corpus, in Spark and, for checks, as SQL of the same meaning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions import text as T

AS_OF = "2024-06-30"

SPACES = r"[\s\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
WORDS = r"[\p{L}\p{N}_]+"


#: Tables of texts by their key, and how much of one a core has before its scan alone keeps all cores busy.
TEXTS = {"documents": "doc_id", "pages": "page_id"}
BYTES_A_CORE = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; a small one of texts is dealt to all cores, as a file of one row group is read by one task however it is split."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if name in TEXTS and int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < cores * BYTES_A_CORE:
        df = df.repartition(cores, TEXTS[name])
    return df


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chunk for each document, with metadata derived from its id, label and copies."""
    d = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    i = F.col("doc_id")
    rows = d.join(labels, "doc_id", "left").withColumn("hash", F.md5("text"))
    # Only hashes that several documents have are joined back, so texts needn't be shuffled where those are few.
    shared = d.groupBy(F.md5("text").alias("hash")).agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("same")).where("same > 1")
    rows = rows.join(shared, "hash", "left")
    canonical = F.when(F.col("first").isNotNull(), F.col("doc_id") == F.col("first"))
    pick = lambda m, *names: F.element_at(F.array(*map(F.lit, names)), (F.pmod(i, F.lit(m)) + 1).cast("int"))
    return rows.select(
        i.alias("id"), "text", "lang", "hash", F.col("source").alias("folder"), F.concat_ws("/", "source", i.cast("string")).alias("source"), T.normalize_for_search(F.col("text")).alias("search_text"),
        F.when(F.col("quality") == 1, "measured").when(F.col("quality") == 0, "tutorial").otherwise("pending").alias("trust"),
        pick(5, "note", "doc", "error_faq", "defect_log", "tutorial").alias("kind"), F.concat(F.lit("2.4.0."), F.pmod(i, F.lit(3)).cast("string")).alias("framework_version"),
        pick(4, "general", "AMR", "AGV", "general").alias("model_scope"), (F.lit(20240101) + F.pmod(i, F.lit(6)) * 100 + F.pmod(i, F.lit(28))).cast("int").alias("doc_date"),
        (F.pmod(i, F.lit(7)) == 0).alias("date_inferred"), canonical.alias("is_canonical"), T.is_toc(F.col("text")).alias("is_toc"), F.array().cast("array<string>").alias("image_refs"), "n_chars",
    )


CORPUS = rf"""
labels1 AS (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id),
corpus AS (
  SELECT d.doc_id AS id, d.text, d.lang, md5(d.text) AS hash, d.source AS folder, d.source || '/' || d.doc_id AS source,
    trim(regexp_replace(regexp_replace(d.text, '["''“”‘’`]|\\+', ' ', 'g'), '{SPACES}+', ' ', 'g')) AS search_text,
    CASE l.quality WHEN 1 THEN 'measured' WHEN 0 THEN 'tutorial' ELSE 'pending' END AS trust,
    CASE d.doc_id % 5 WHEN 0 THEN 'note' WHEN 1 THEN 'doc' WHEN 2 THEN 'error_faq' WHEN 3 THEN 'defect_log' ELSE 'tutorial' END AS kind,
    '2.4.0.' || (d.doc_id % 3) AS framework_version,
    CASE d.doc_id % 4 WHEN 1 THEN 'AMR' WHEN 2 THEN 'AGV' ELSE 'general' END AS model_scope,
    CAST(20240101 + (d.doc_id % 6) * 100 + d.doc_id % 28 AS INTEGER) AS doc_date, d.doc_id % 7 = 0 AS date_inferred,
    CASE WHEN count(*) OVER (PARTITION BY md5(d.text)) > 1 THEN d.doc_id = min(d.doc_id) OVER (PARTITION BY md5(d.text)) END AS is_canonical, d.n_chars
  FROM documents d LEFT JOIN labels1 l ON l.doc_id = d.doc_id
)"""


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each benchmark passage as a query, with the vector of the same number."""
    b, e = table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "embeddings")
    return b.join(e, b.item_id == e.vec_id).select(F.col("item_id").alias("qid"), F.col("text").alias("query"), F.col("embedding").alias("qvec"), F.col("text").alias("sparse_query"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of the documents that have one."""
    d = table(spark, sf_dir, "documents").select("doc_id")
    return table(spark, sf_dir, "embeddings").join(d, F.col("vec_id") == F.col("doc_id"), "left_semi").select(F.col("vec_id").alias("id"), F.col("embedding").alias("dense"))


SEARCH = rf"""
q AS (SELECT b.item_id AS qid, b.text AS query, CAST(e.embedding AS DOUBLE[]) AS qvec,
        trim(regexp_replace(regexp_replace(b.text, '["''“”‘’`]|\\+', ' ', 'g'), '{SPACES}+', ' ', 'g')) AS needle
      FROM benchmark b JOIN embeddings e ON e.vec_id = b.item_id),
vec AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents)),
sim AS (SELECT q.qid, v.id, round(list_dot_product(q.qvec, v.x) / (sqrt(list_dot_product(q.qvec, q.qvec)) * sqrt(list_dot_product(v.x, v.x))), 6) AS score FROM q, vec v),
post AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(regexp_extract_all(lower(search_text), '{WORDS}')) AS term FROM corpus) GROUP BY id, term),
dense AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM sim WHERE score >= 0.55) WHERE rank <= 15),
qterm AS (SELECT qid, term, count(*) AS qtf FROM (SELECT qid, unnest(regexp_extract_all(lower(query), '{WORDS}')) AS term FROM q) GROUP BY qid, term),
idf AS (SELECT term, ln(1 + ((SELECT count(*) FROM corpus) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM post GROUP BY term),
sparse AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM (
    SELECT t.qid, p.id, round(sum(t.qtf * p.tf * i.idf), 6) AS score FROM qterm t JOIN post p ON p.term = t.term JOIN idf i ON i.term = t.term GROUP BY t.qid, p.id)) WHERE rank <= 15),
words AS (SELECT qid, unnest(string_split(needle, ' ')) AS t, generate_subscripts(string_split(needle, ' '), 1) AS pos FROM q),
terms AS (SELECT qid, t, row_number() OVER (PARTITION BY qid ORDER BY length(t) DESC, min(pos)) AS n FROM words
  WHERE length(t) >= 3 AND lower(t) NOT IN ('the','a','an','of','to','is','are','and','or','in','on','for','with','as','by','at','be','it','this','that','from','if','when','must','not','no','do','does','was','were','you','your','can')
  GROUP BY qid, t),
probe AS (SELECT DISTINCT qid, tier, unnest(regexp_extract_all(lower(t), '{WORDS}')) AS term FROM (SELECT qid, t, 1 AS tier FROM terms WHERE n <= 3 UNION ALL SELECT qid, t, 2 FROM terms WHERE n = 1)),
met AS (SELECT p.qid, p.tier, x.id FROM probe p JOIN post x ON x.term = p.term GROUP BY p.qid, p.tier, x.id
  HAVING count(DISTINCT p.term) = (SELECT count(*) FROM probe o WHERE o.qid = p.qid AND o.tier = p.tier)),
near AS (SELECT * FROM (SELECT m.qid, m.id, s.score, row_number() OVER (PARTITION BY m.qid ORDER BY s.score DESC, m.id) AS r
  FROM met m JOIN sim s ON s.qid = m.qid AND s.id = m.id WHERE m.tier = (SELECT min(tier) FROM met o WHERE o.qid = m.qid)) WHERE r <= 15),
exact AS (SELECT n.qid, n.id, n.score, row_number() OVER (PARTITION BY n.qid ORDER BY n.score DESC, n.id) AS rank
  FROM near n JOIN q ON q.qid = n.qid JOIN corpus c ON c.id = n.id WHERE contains(c.search_text, q.needle)),
anchor_all AS (SELECT qid, unnest(regexp_extract_all(query, '[A-Za-z_][A-Za-z0-9_.]{{2,}}')) AS t, generate_subscripts(regexp_extract_all(query, '[A-Za-z_][A-Za-z0-9_.]{{2,}}'), 1) AS pos FROM q),
anchors AS (SELECT qid, rtrim(t, '.') AS a, min(pos) AS pos FROM anchor_all WHERE regexp_matches(substr(t, 2), '[A-Z]') OR contains(t, '_') OR contains(t, '.') GROUP BY qid, rtrim(t, '.')),
aprobe AS (SELECT DISTINCT qid, pos, unnest(regexp_extract_all(lower(a), '{WORDS}')) AS term FROM anchors),
amet AS (SELECT p.qid, p.pos, x.id FROM aprobe p JOIN post x ON x.term = p.term GROUP BY p.qid, p.pos, x.id
  HAVING count(DISTINCT p.term) = (SELECT count(*) FROM aprobe o WHERE o.qid = p.qid AND o.pos = p.pos)),
arare AS (SELECT qid, pos, row_number() OVER (PARTITION BY qid ORDER BY pos) AS nth FROM amet GROUP BY qid, pos HAVING count(*) <= 60),
ahits AS (SELECT DISTINCT m.qid, m.id FROM amet m JOIN arare r ON r.qid = m.qid AND r.pos = m.pos WHERE r.nth <= 3),
anchor AS (SELECT * FROM (SELECT h.qid, h.id, s.score, row_number() OVER (PARTITION BY h.qid ORDER BY s.score DESC, h.id) AS rank FROM ahits h JOIN sim s ON s.qid = h.qid AND s.id = h.id) WHERE rank <= 15),
every AS (SELECT qid, id, 'dense' AS channel, rank, score AS raw FROM dense UNION ALL SELECT qid, id, 'sparse', rank, score FROM sparse
  UNION ALL SELECT qid, id, 'exact', rank, score FROM exact UNION ALL SELECT qid, id, 'anchor', rank, score FROM anchor),
fused AS (SELECT qid, id,
    round(coalesce(max(CASE WHEN channel = 'dense' THEN 0.7::DOUBLE / (1 + rank) END), 0.0) + coalesce(max(CASE WHEN channel = 'sparse' THEN 0.3::DOUBLE / (1 + rank) END), 0.0)
      + coalesce(max(CASE WHEN channel = 'exact' THEN 1.0::DOUBLE / (1 + rank) END), 0.0) + coalesce(max(CASE WHEN channel = 'anchor' THEN 1.0::DOUBLE / (1 + rank) END), 0.0), 6) AS score,
    string_agg(channel, ',' ORDER BY channel) AS channels, max(raw) AS best FROM every GROUP BY qid, id)"""

AGE = f"date_diff('day', strptime(CAST(doc_date AS VARCHAR), '%Y%m%d')::DATE, DATE '{AS_OF}')"
RECENCY = f"CASE WHEN kind IN ('note','defect_log','error_faq','model_fact_card','version_matrix') AND NOT date_inferred AND {AGE} > 0 THEN greatest(0.85::DOUBLE, 1 - (1 - 0.85::DOUBLE) * {AGE} / 182.5::DOUBLE) ELSE 1.0::DOUBLE END"
TRUST = "CASE trust WHEN 'measured' THEN 1.0::DOUBLE WHEN 'tutorial' THEN 0.9::DOUBLE WHEN 'pending' THEN 0.75::DOUBLE ELSE 1.0::DOUBLE END"
BARE = rf"length(regexp_replace(regexp_replace(search_text, '&#?[\p{{L}}\p{{N}}_]+;', '', 'g'), '{SPACES}+', '', 'g'))"

RERANK = rf"""
item AS (SELECT f.qid, f.id, c.folder AS source, f.channels, {BARE} < 20 AS low,
    round(f.score * (1.0::DOUBLE * CASE WHEN {BARE} < 20 THEN 0.6::DOUBLE ELSE 1.0::DOUBLE END * ({TRUST}) * ({RECENCY})), 6) AS adj FROM fused f JOIN corpus c ON c.id = f.id),
pos AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY adj DESC, id) AS pos FROM item),
nrk AS (SELECT *, row_number() OVER (PARTITION BY qid, source, low ORDER BY pos) AS nrk FROM pos),
def AS (SELECT *, low AND coalesce(sum(CASE WHEN NOT low AND nrk <= 2 THEN 1 ELSE 0 END) OVER (PARTITION BY qid ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 3 AS deferred FROM nrk),
srk AS (SELECT *, row_number() OVER (PARTITION BY qid, source ORDER BY deferred, pos) AS srk FROM def),
taken AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY deferred, pos) AS rank FROM srk WHERE srk <= 2)"""
