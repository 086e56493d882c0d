"""Queries over the engine's own operators, with SQL of the same result wherever SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscan.functions import literature as L
from folioscan.functions import scoring as S
from folioscan.functions import text as X
from folioscan.functions.fold import clean_tag
from folioscan.operators import corpus as C
from folioscan.operators import evaluation as V
from folioscan.operators import graph as G
from folioscan.operators.incremental import epoch_seconds
from folioscan.operators.lexical import apply_changes, bm25, build_index
from folioscan.operators.merging import merge_by_key, ranked_items
from folioscan.operators.ranking import fuse, keep_last, top_k
from folioscan.operators.vector import densify, embed, hash_vectors, vector_top_k
from folioscan.plans.hybrid import HybridParameters, SearchIndex, Stages, hybrid_search, search_stages
from folioscan.plans.tuning import evaluate, with_embeddings
from folioscan.session import cut, scratch_path, table
from folioscan.streaming.upserts import windowed_counts

NOW, NOW_YEAR = 1_735_689_600, 2025
ASKED = ["flat descent", "theorem on coherent sheaf", "How to prove the lemma on proper morphism", "definition of a noetherian scheme", "3.45 locally free hull", "概形 平坦", "what is a smooth divisor", "proposition about kernels", "WA4H", "remark cohomology derived stacks", "weather and movie", "quasi compact covering"]



def _sql_list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def asked(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(ASKED)), "qid int, query string")


SQL_ASKED = f"asked AS (SELECT (i - 1)::INT AS qid, {_sql_list(ASKED)}[i] AS query FROM range(1, {len(ASKED) + 1}) r(i))"


def current_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest row of each clean tag."""
    rows = table(spark, sf_dir, "corpus").withColumns({"tag": clean_tag(F.col("tag")), "f": epoch_seconds(F.col("fetched_at_utc"))})
    text = ["full_label", "chapter_key", "env_type", "reference", "title", "statement_text", "proof_text", "normalized_text", "statement_html", "full_html"]
    rows = rows.select("tag", *[X.text(F.col(c)).alias(c) for c in text], F.coalesce("outgoing_refs", F.array().cast("array<string>")).alias("outgoing_refs"), "f", "loaded_at")
    return keep_last(rows, "tag", F.struct("f", "loaded_at", *text, "outgoing_refs")).withColumn("id", F.col("tag"))


_CLEAN = r"nullif(upper(regexp_replace({0}, '(?i)^(?:[\s\p{{Z}}\p{{C}}]+|/tag/|#)+|[\s\p{{Z}}\p{{C}}]+$', '', 'g')), '')"
SQL_CUR = f"""cur AS (SELECT tag AS id, r.* FROM (SELECT tag, arg_max({{'full_label': full_label, 'chapter_key': chapter_key, 'env_type': env_type, 'reference': reference, 'title': title, 'statement_text': statement_text, 'proof_text': proof_text, 'normalized_text': normalized_text, 'statement_html': statement_html, 'full_html': full_html, 'refs': refs}}, (f, loaded_at, full_label, chapter_key, env_type, reference, title, statement_text, proof_text, normalized_text)) AS r
  FROM (SELECT {_CLEAN.format('tag')} AS tag, coalesce(full_label, '') AS full_label, coalesce(chapter_key, '') AS chapter_key, coalesce(env_type, '') AS env_type, coalesce(reference, '') AS reference, coalesce(title, '') AS title, coalesce(statement_text, '') AS statement_text, coalesce(proof_text, '') AS proof_text, coalesce(normalized_text, '') AS normalized_text, coalesce(statement_html, '') AS statement_html, coalesce(full_html, '') AS full_html, coalesce(outgoing_refs, []) AS refs, coalesce(CASE WHEN abs(fetched_at_utc) >= 100000000000 THEN fetched_at_utc // 1000 ELSE fetched_at_utc END, 0) AS f, loaded_at FROM corpus)
  WHERE tag IS NOT NULL GROUP BY tag))"""


def current_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "docs_fts").select("id", *[X.text(F.col(c)).alias(c) for c in ("chapter_key", "env_type", "title", "content", "content_hash")], "indexed_at")
    return keep_last(rows, "id", F.struct("indexed_at", "title", "content", "content_hash", "chapter_key", "env_type")).drop("indexed_at")


SQL_DOCS = "docs AS (SELECT id, r.* FROM (SELECT id, arg_max({'chapter_key': coalesce(chapter_key, ''), 'env_type': coalesce(env_type, ''), 'title': coalesce(title, ''), 'content': coalesce(content, ''), 'content_hash': coalesce(content_hash, '')}, (indexed_at, coalesce(title, ''), coalesce(content, ''))) AS r FROM docs_fts WHERE id IS NOT NULL GROUP BY id))"
_UNI = r"regexp_extract_all(regexp_replace(strip_accents(lower({0})), '\p{{M}}+', '', 'g'), '[\p{{L}}\p{{N}}\p{{Co}}]+')"

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


# --- vectors


def _vector_queries(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, sf_dir, "embeddings")
    return rows, rows.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), "embedding")


_PAIRS = "q AS (SELECT vec_id AS qid, embedding AS e, label AS ql FROM embeddings WHERE vec_id % 20 = 0), s AS (SELECT qid, ql, vec_id AS id, label, round(list_dot_product(e::DOUBLE[], embedding::DOUBLE[]), 9) AS score FROM q, embeddings)"


@query(f"WITH {_PAIRS} SELECT qid, id, round(score, 6) AS score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= 5")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, asked_ = _vector_queries(spark, sf_dir)
    return vector_top_k(rows, asked_, 5, "vec_id").withColumn("score", F.round("score", 6))


@query(f"WITH {_PAIRS} SELECT qid, id, round(score, 6) AS score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM s WHERE label = 3) WHERE rank <= 5")
def vector_topk_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, asked_ = _vector_queries(spark, sf_dir)
    return vector_top_k(rows, asked_, 5, "vec_id", keep=F.col("label") == 3).withColumn("score", F.round("score", 6))


@query(
    f"""WITH {_PAIRS}, v AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS r FROM s) WHERE r <= 50),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS r FROM s WHERE label % 2 = 0) WHERE r <= 50),
vn AS (SELECT qid, id, CASE WHEN max(score) OVER w - min(score) OVER w <= 1e-12 THEN 1.0 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS vs FROM v WINDOW w AS (PARTITION BY qid)),
bn AS (SELECT qid, id, CASE WHEN max(score) OVER w - min(score) OVER w <= 1e-12 THEN 1.0 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS bs FROM b WINDOW w AS (PARTITION BY qid))
SELECT qid, id, round(0.55 * coalesce(vs, 0) + 0.45 * coalesce(bs, 0), 6) AS score FROM vn FULL JOIN bn USING (qid, id)"""
)
def minmax_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, asked_ = _vector_queries(spark, sf_dir)
    one, two = vector_top_k(rows, asked_, 50, "vec_id"), vector_top_k(rows, asked_, 50, "vec_id", keep=F.col("label") % 2 == 0)
    return fuse(one, two).select("qid", "id", F.round("score", 6).alias("score"))


def _label_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, asked_ = _vector_queries(spark, sf_dir)
    ranking = vector_top_k(rows, asked_, 11, "vec_id").filter("qid <> id")
    ranking = top_k(ranking.drop("rank"), 10, ["qid"], "score")
    labels = rows.select(F.col("vec_id").alias("id"), "label")
    wanted = asked_.select("qid").join(labels.select(F.col("id").alias("qid"), "label"), "qid").join(labels, "label").filter("qid <> id")
    return V.query_metrics(ranking, wanted, [1, 5, 10]).join(labels.select(F.col("id").alias("qid"), "label"), "qid")


_METRICS = f"""{_PAIRS}, k AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM s WHERE qid <> id),
m AS (SELECT qid, any_value(ql) AS label, {', '.join(f"count(*) FILTER (rank <= {k} AND label = ql) / (count(*) FILTER (label = ql))::DOUBLE AS \"recall@{k}\", coalesce(1.0 / min(rank) FILTER (rank <= {k} AND label = ql), 0) AS \"mrr@{k}\"" for k in (1, 5, 10))} FROM k GROUP BY qid HAVING count(*) FILTER (label = ql) > 0)"""
_NAMES = [f"{m}@{k}" for k in (1, 5, 10) for m in ("recall", "mrr")]


@query(f"WITH {_METRICS} SELECT qid, {', '.join(f'round(\"{n}\", 9) AS \"{n}\"' for n in _NAMES)} FROM m")
def recall_mrr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _label_metrics(spark, sf_dir).select("qid", *[F.round(F.col(f"`{n}`").cast("double"), 9).alias(n) for n in _NAMES])


@query(f"WITH {_METRICS} SELECT CASE WHEN grouping(label) = 1 THEN '(all)' ELSE label::VARCHAR END AS category, {', '.join(f'round(avg(\"{n}\"), 9) AS \"{n}\"' for n in _NAMES)}, count(*) AS query_count FROM m GROUP BY GROUPING SETS ((), (label))")
def metrics_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = V.aggregate_metrics(_label_metrics(spark, sf_dir), "label")
    return got.select("category", *[F.round(F.col(f"`{n}`").cast("double"), 9).alias(n) for n in _NAMES], "query_count")


_BASE = [("mrr@10", 0.99), ("recall@10", 0.0), ("mrr@1", 2.0), ("ndcg@10", 0.5)]


@query(f"WITH {_METRICS}, a AS (SELECT {', '.join(f'avg(\"{n}\") AS \"{n}\"' for n in _NAMES)} FROM m), c AS (UNPIVOT a ON {', '.join(f'\"{n}\"' for n in _NAMES)} INTO NAME metric VALUE v) SELECT metric, round(v, 9) AS current, b AS baseline FROM c JOIN (VALUES {', '.join(f"('{k}', {v}::DOUBLE)" for k, v in _BASE)}) t(k, b) ON k = metric WHERE v < b")
def regression_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = V.aggregate_metrics(_label_metrics(spark, sf_dir))
    now = whole.select(F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(f"`{n}`").cast("double").alias("value")) for n in _NAMES])).alias("x")).select("x.*")
    return V.regressions(now, spark.createDataFrame(_BASE, "metric string, value double")).select("metric", F.round("current", 9).alias("current"), "baseline")


@query(
    """WITH m AS (SELECT c, r, cat, (((c * 7 + r * 3 + length(cat)) % 10) / 10.0)::DOUBLE AS mrr, (((c * 3 + r * 5 + length(cat)) % 10) / 10.0)::DOUBLE AS rec FROM range(3) a(c), range(4) b(r), (VALUES ('(all)'), ('proof'), ('definition'), ('theorem')) t(cat)),
x AS (SELECT c, r, avg(mrr) FILTER (cat = '(all)') AS m, avg(rec) FILTER (cat = '(all)') AS k, avg(mrr) FILTER (cat = 'proof') AS p, avg(mrr) FILTER (cat IN ('definition', 'theorem', 'chapter_filter')) AS n FROM m GROUP BY c, r)
SELECT c::INT AS cand_idx, r::INT AS route_idx, round(0.45 * m + 0.25 * k + 0.20 * p + 0.10 * n - 0.05 * abs(p - n), 6) AS objective FROM x"""
)
def route_grid_objective(spark: SparkSession, sf_dir: str) -> DataFrame:
    cats = ["(all)", "proof", "definition", "theorem"]
    rows = [(c, r, k, ((c * 7 + r * 3 + len(k)) % 10) / 10.0, ((c * 3 + r * 5 + len(k)) % 10) / 10.0) for c in range(3) for r in range(4) for k in cats]
    board = V.leaderboard(spark.createDataFrame([(c, f"c{c}") for c in range(3)], "cand_idx int, candidate string"), spark.createDataFrame([(r, f"r{r}") for r in range(4)], "route_idx int, route string"), spark.createDataFrame(rows, "cand_idx int, route_idx int, category string, mrr10 double, recall10 double"))
    return board.select("cand_idx", "route_idx", F.round("objective", 6).alias("objective"))


# --- texts


@query(r"SELECT doc_id, count(t) AS n_tokens, count(DISTINCT t) AS n_distinct FROM (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[A-Za-z0-9_]+')) AS t FROM documents UNION ALL SELECT doc_id, NULL FROM documents) GROUP BY doc_id")
def tokenize_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", X.tokenize(F.col("text")).alias("t"))
    return rows.select("doc_id", F.size("t").cast("bigint").alias("n_tokens"), F.size(F.array_distinct("t")).cast("bigint").alias("n_distinct"))


@query(f"WITH {SQL_DOCS} SELECT id, len(w)::BIGINT AS n_tokens, len(list_distinct(w))::BIGINT AS n_distinct FROM (SELECT id, {_UNI.format('content')} AS w FROM docs)")
def unicode_token_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = current_docs(spark, sf_dir).select("id", X.unicode_tokens(F.col("content")).alias("t"))
    return rows.select("id", F.size("t").cast("bigint").alias("n_tokens"), F.size(F.array_distinct("t")).cast("bigint").alias("n_distinct"))


_MATH = "coalesce(statement_text, '')"
for _a, _b in ((r"\\math(?:cal|bf)\{([A-Za-z])\}", r"\1"), (r"\\to", " to "), (r"\\mapsto", " mapsto "), (r"\\Spec", " Spec "), (r"\\Hom", " Hom ")):
    _MATH = f"regexp_replace({_MATH}, '{_a}', '{_b}', 'g')"
_MATH = f"regexp_replace(translate({_MATH}, '${{}}^_', '     '), '\\\\([A-Za-z]+)', ' \\1 ', 'g')"
_MATH = f"trim(regexp_replace({_MATH}, '[\\s\\p{{Z}}]+', ' ', 'g'))"


@query(f"WITH {SQL_CUR} SELECT id, {_MATH} AS normalized FROM cur")
def normalize_math(spark: SparkSession, sf_dir: str) -> DataFrame:
    return current_corpus(spark, sf_dir).select("id", X.normalize_math(F.col("statement_text")).alias("normalized"))


@query(f"WITH {SQL_CUR} SELECT id, sha256(concat_ws(chr(10), statement_text, proof_text, full_html, statement_html, full_label)) AS content_hash, sha256(concat_ws(chr(10), statement_html, full_html)) AS payload_hash FROM cur")
def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = [F.col(c) for c in ("statement_text", "proof_text", "full_html", "statement_html", "full_label")]
    return current_corpus(spark, sf_dir).select("id", X.content_hash(*cols).alias("content_hash"), X.content_hash(F.col("statement_html"), F.col("full_html")).alias("payload_hash"))


@query(f"WITH {SQL_CUR} SELECT id, coalesce(nullif(lower(regexp_extract(statement_html, 'class=\"env-([a-zA-Z0-9\\-]+)\"', 1)), ''), 'unknown') AS env_type, regexp_extract(statement_html, 'data-tag=\"[0-9A-Z]{{4}}\">([^<]+)</span>', 1) AS reference, regexp_extract(statement_html, '(?is)<h[1-6][^>]*>(.*?)</h[1-6]>', 1) AS heading FROM cur")
def page_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.col("statement_html")
    return current_corpus(spark, sf_dir).select("id", X.env_type(h, F.lit("")).alias("env_type"), X.reference_number(h).alias("reference"), X.heading(h).alias("heading"))


@query(f"WITH {SQL_CUR}, x AS (SELECT id, unnest(r) AS ref, generate_subscripts(r, 1) AS p FROM (SELECT id, regexp_extract_all(full_html, '/tag/([0-9A-Z]{{4}})', 1) AS r FROM cur)), d AS (SELECT id, ref, min(p) AS p FROM x GROUP BY ALL) SELECT id, ref, (row_number() OVER (PARTITION BY id ORDER BY p) - 1)::INT AS pos FROM d")
def page_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return current_corpus(spark, sf_dir).select("id", F.posexplode(X.tag_refs(F.col("full_html"))).alias("pos", "ref"))


_TAGS = r"""</?[A-Za-z][^<>"]*(?:"[^"]*"[^<>"]*)*>"""
_LINES = f"regexp_replace(full_html, '(?i)</?(?:p|div|li|br|tr|h[1-6])(?:[\\s/][^<>]*)?>', chr(10), 'g')"
_TEXT = f"regexp_replace(regexp_replace(regexp_replace({_LINES}, '{_TAGS}', '', 'g'), '[ \\t\\f\\v]+', ' ', 'g'), '\\n\\s*\\n+', chr(10) || chr(10), 'g')"


@query(f"WITH {SQL_CUR} SELECT id, regexp_replace({_TEXT}, '^\\s+|\\s+$', '', 'g') AS text FROM cur")
def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return current_corpus(spark, sf_dir).select("id", X.html_to_text("full_html").alias("text"))


@query(f"WITH {SQL_CUR} SELECT id, CASE WHEN trim(f) = '' THEN '' WHEN trim(s) <> '' AND starts_with(trim(f), trim(s)) THEN trim(substr(trim(f), length(trim(s)) + 1)) WHEN trim(f) <> trim(s) THEN trim(f) ELSE '' END AS proof FROM (SELECT id, statement_text AS s, concat_ws(' ', statement_text, nullif(proof_text, '')) AS f FROM cur)")
def split_proof(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = F.concat_ws(" ", "statement_text", F.nullif("proof_text", F.lit("")))
    return current_corpus(spark, sf_dir).select("id", X.split_proof(F.col("statement_text"), whole).alias("proof"))


@query(
    f"""WITH {SQL_CUR}, k AS (SELECT DISTINCT chapter_key AS k FROM cur WHERE chapter_key <> ''), l AS (SELECT DISTINCT full_label AS l FROM cur WHERE full_label <> ''),
b AS (SELECT l, coalesce(arg_max(k, length(k)), CASE WHEN contains(l, '-') THEN split_part(l, '-', 1) ELSE 'unknown' END) AS c FROM l LEFT JOIN k ON starts_with(l, k || '-') GROUP BY l)
SELECT l AS full_label, c AS chapter_key, split_part(CASE WHEN starts_with(l, c || '-') THEN substr(l, length(c) + 2) ELSE l END, '-', 1) AS env_hint FROM b"""
)
def longest_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = current_corpus(spark, sf_dir)
    labels = rows.filter("full_label <> ''").select("full_label").distinct()
    placed = C.longest_prefix(labels, rows.filter("chapter_key <> ''").select("chapter_key").distinct())
    return placed.select("full_label", "chapter_key", X.env_hint(F.col("full_label"), F.col("chapter_key")).alias("env_hint"))


@query(f"WITH {SQL_CUR} SELECT id, CASE WHEN length(t) > 260 THEN substr(t, 1, 257) || '...' ELSE t END AS snippet, concat_ws(', ', '[S1]', 'Tag ' || id, nullif(reference, ''), nullif(title, ''), 'x/tag/' || id) AS line FROM (SELECT id, reference, title, trim(replace(statement_text, chr(10), ' ')) AS t FROM cur)")
def citation_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return current_corpus(spark, sf_dir).select("id", X.snippet(F.col("statement_text"), 260).alias("snippet"), L.local_citation(F.lit("S1"), F.col("id"), F.col("title"), F.col("reference"), F.concat(F.lit("x/tag/"), "id")).alias("line"))


@query("SELECT event_id, (props::JSON ->> '$.k')::BIGINT AS k FROM events")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint").alias("k"))


# --- intents


@query(f"WITH {SQL_ASKED} SELECT qid, CASE WHEN length(e) > 0 THEN query || ' ' || e ELSE query END AS expanded FROM (SELECT qid, query, array_to_string(list_filter([{', '.join(f"CASE WHEN contains(query, '{k}') THEN '{v}' END" for k, v in X.QUERY_EXPANSIONS)}], lambda x: x IS NOT NULL), ' ') AS e FROM asked)")
def query_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asked(spark).select("qid", X.expand_query(F.col("query")).alias("expanded"))


def _sql_any(column: str, terms: list[str]) -> str:
    return "(" + " OR ".join(f"contains({column}, '{t}')" for t in terms) + ")"


_INTENT = f"""intent AS (SELECT qid, query, CASE WHEN regexp_full_match(upper(trim(query)), '[0-9A-Z]{{4}}') THEN upper(trim(query)) ELSE '' END AS tag_hint,
CASE {' '.join(f"WHEN {_sql_any('lower(query)', t)} THEN '{e}'" for e, t in S.ENV_HINTS)} ELSE '' END AS prefer_env, {_sql_any('lower(query)', S.PROOF_HINTS)} AS wants_proof, regexp_extract(query, '\\b\\d+\\.\\d+(?:\\.\\d+)?\\b') AS reference_hint FROM asked)"""


@query(f"WITH {SQL_ASKED}, {_INTENT} SELECT qid, tag_hint, prefer_env, wants_proof, reference_hint FROM intent")
def intent_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("query")
    return asked(spark).select("qid", S.tag_hint(q).alias("tag_hint"), S.prefer_env(q).alias("prefer_env"), S.wants_proof(q).alias("wants_proof"), S.reference_hint(q).alias("reference_hint"))


@query(
    f"""WITH {SQL_CUR}, {SQL_ASKED}, {_INTENT}, t AS (SELECT *, list_distinct(regexp_extract_all(lower(query), '[A-Za-z0-9_]+')) AS w FROM intent)
SELECT id, qid, round((CASE WHEN tag_hint <> '' AND id = tag_hint THEN 10 ELSE 0 END) + (CASE WHEN prefer_env <> '' AND env_type = prefer_env THEN 0.75 ELSE 0 END)
+ (CASE WHEN wants_proof THEN (CASE WHEN trim(proof_text) <> '' THEN 0.45 WHEN env_type IN ('theorem', 'lemma', 'proposition') THEN 0.10 ELSE 0 END) + (CASE WHEN trim(statement_text) <> '' THEN 0.05 ELSE 0 END)
ELSE (CASE WHEN trim(statement_text) <> '' THEN 0.12 ELSE 0 END) - (CASE WHEN trim(proof_text) <> '' THEN 0.08 ELSE 0 END) END)
+ (CASE WHEN reference_hint <> '' AND reference = reference_hint THEN 0.6 ELSE 0 END) + (CASE WHEN contains(lower(query), lower(chapter_key)) OR contains(translate(lower(query), '_-', '  '), replace(lower(chapter_key), '-', ' ')) THEN 0.35 ELSE 0 END)
+ least(0.05 * len(list_filter(w, lambda x: length(x) >= 3 AND contains(replace(lower(title || ' ' || full_label), '-', ' '), x))), 0.35), 6)::DOUBLE AS boost FROM cur, t"""
)
def intent_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document under a dozen stated queries: they ride along as an array, so there is no join."""
    rows = current_corpus(spark, sf_dir).select("id", "env_type", "reference", "chapter_key", "statement_text", "proof_text", "title", "full_label", F.explode(F.array(*[F.struct(F.lit(i).alias("qid"), F.lit(q).alias("query")) for i, q in enumerate(ASKED)])).alias("a"))
    q = F.col("a.query")
    intent = {"tag_hint": S.tag_hint(q), "prefer_env": S.prefer_env(q), "wants_proof": S.wants_proof(q), "reference_hint": S.reference_hint(q), "chapter_hit": S.names_chapter(q, F.col("chapter_key"))}
    doc = {c: F.col(c) for c in ("id", "env_type", "reference", "chapter_key", "statement_text", "proof_text", "title", "full_label")}
    return rows.select("id", F.col("a.qid").alias("qid"), F.round(S.intent_boost(doc, intent, X.tokenize(q), S.Routes()), 6).alias("boost"))


_REL = f"""r AS (SELECT item_id, q, w, {' + '.join(f"(CASE WHEN contains(q, '{k}') THEN 1 ELSE 0 END)" for k in S.KEYWORDS)} + {' + '.join(f"(CASE WHEN list_contains(w, '{a}') AND list_contains(w, '{b}') THEN 1 ELSE 0 END)" for a, b in S.KEYWORD_PAIRS)} AS k, {' + '.join(f"(CASE WHEN contains(q, '{n}') THEN 1 ELSE 0 END)" for n in S.NEGATIVE)} AS n FROM (SELECT item_id, q, regexp_extract_all(q, '[a-zA-Z0-9\\-\\+]+') AS w FROM (SELECT DISTINCT item_id, lower(coalesce(title, '')) AS q FROM retrieve_papers)))"""


@query(f"WITH {_REL} SELECT item_id, CASE WHEN k >= 2 AND n = 0 THEN 'high' WHEN k >= 1 AND n <= 1 THEN 'medium' ELSE 'low' END AS label, k::INT AS keyword_hits, n::INT AS negative_hits FROM r")
def relevance_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "retrieve_papers").select("item_id", F.lower(X.text(F.col("title"))).alias("title")).distinct()
    return rows.select("item_id", S.relevance(F.col("title")).alias("r")).select("item_id", "r.*")


# --- lexical


@query(
    f"""WITH {SQL_DOCS}, {SQL_ASKED}, d AS (SELECT id, {_UNI.format('title')} AS t, {_UNI.format('content')} AS c FROM docs), w AS (SELECT id, unnest(list_concat(t, c)) AS term FROM d), tf AS (SELECT id, term, count(*) AS tf FROM w GROUP BY ALL), dl AS (SELECT id, len(t) + len(c) AS dl FROM d),
n AS (SELECT count(*)::DOUBLE AS n, avg(dl) AS a FROM dl), q AS (SELECT qid, unnest(regexp_extract_all(lower(query), '[A-Za-z0-9_]+')) AS term FROM asked), qn AS (SELECT qid, count(*) AS m FROM q GROUP BY qid), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
s AS (SELECT qid, id, count(*) AS got, round(sum(greatest(CASE WHEN ln((n - df + .5) / (df + .5)) > 0 THEN ln((n - df + .5) / (df + .5)) ELSE 1e-6 END, 0) * tf * 2.2 / (tf + 1.2 * (.25 + .75 * dl / a))), 9) AS score FROM q JOIN tf USING (term) JOIN df USING (term) JOIN dl USING (id), n GROUP BY qid, id)
SELECT qid, id, round(score, 6) AS score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM s JOIN qn USING (qid) WHERE got = m) WHERE rank <= 20"""
)
def bm25_and(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bm25(build_index(current_docs(spark, sf_dir)), asked(spark), 20)
    return found.withColumn("score", F.round("score", 6))


SQL["bm25_or"] = SQL["bm25_and"].replace(" WHERE got = m", "")
SQL["bm25_filtered"] = SQL["bm25_or"].replace("SELECT qid, id, round(score, 6) AS score, rank::INT AS rank FROM", "SELECT qid, id, round(score, 6) AS score, r2::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS r2 FROM") .replace("WHERE rank <= 20", "WHERE rank <= 80 AND id IN (SELECT id FROM docs WHERE env_type = 'lemma')) WHERE r2 <= 20")


@query(SQL["bm25_or"])
def bm25_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bm25(build_index(current_docs(spark, sf_dir)), asked(spark), 20, mode="or")
    return found.withColumn("score", F.round("score", 6))


@query(SQL["bm25_filtered"])
def bm25_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bm25(build_index(current_docs(spark, sf_dir)), asked(spark), 20, env="lemma", mode="or")
    return found.withColumn("score", F.round("score", 6))


def _split_docs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, sf_dir, "docs_fts").select("id", *[X.text(F.col(c)).alias(c) for c in ("title", "content", "content_hash")], "indexed_at")
    order = F.struct("indexed_at", "title", "content", "content_hash")
    old = keep_last(rows.filter("indexed_at < timestamp_ntz'2024-07-01'"), "id", order)
    return old, keep_last(rows, "id", order)


_UP = "o AS (SELECT id, arg_max({'t': coalesce(title, ''), 'c': coalesce(content, '')}, (indexed_at, coalesce(title, ''), coalesce(content, ''))) AS r FROM docs_fts WHERE id IS NOT NULL AND indexed_at {0} GROUP BY id)"


@query("WITH " + _UP.replace("{0}", "< '2030-01-01'") + f" SELECT term, count(*) AS df, sum(tf)::BIGINT AS tf FROM (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(list_concat({_UNI.format('r.t')}, {_UNI.format('r.c')})) AS term FROM o) GROUP BY ALL) GROUP BY term")
def incremental_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index of the first half year, brought up to date; the same as built anew."""
    old, new = _split_docs(spark, sf_dir)
    changed = new.join(old.select("id", "content_hash", F.col("title").alias("t"), F.col("content").alias("c")), ["id"], "left").filter("NOT (title <=> t AND content <=> c)").select("id")
    index = apply_changes(build_index(old), new, changed)
    return index.postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum(F.size("positions")).alias("tf"))


@query("SELECT count(*) AS kept, count(*) FILTER (id NOT IN (SELECT id FROM docs_fts WHERE indexed_at >= '2024-07-01' AND id IS NOT NULL)) AS old_only FROM (SELECT DISTINCT id FROM docs_fts WHERE id IN (SELECT " + _CLEAN.format("tag") + " FROM corpus))")
def prune_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index rows of ids that the corpus lacks are removed."""
    _, new = _split_docs(spark, sf_dir)
    kept = apply_changes(build_index(new), new.join(table(spark, sf_dir, "corpus").select(clean_tag(F.col("tag")).alias("id")), "id", "left_semi"), new.select("id").limit(0), prune=True)
    late = table(spark, sf_dir, "docs_fts").filter("indexed_at >= timestamp_ntz'2024-07-01'").select("id", F.lit(True).alias("late")).distinct()
    return kept.docs.select("id").distinct().join(late, "id", "left").agg(F.count(F.lit(1)).alias("kept"), F.count_if(F.col("late").isNull()).alias("old_only"))


# --- graph


def _graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    nodes = table(spark, sf_dir, "corpus").select(clean_tag(F.col("tag")).alias("id")).filter("id IS NOT NULL").distinct()
    edges = table(spark, sf_dir, "ref_edges").select(clean_tag(F.col("source_tag")).alias("source_tag"), clean_tag(F.col("target_tag")).alias("target_tag"))
    return nodes, G.clean_edges(nodes, edges)


_GRAPH = f"n AS (SELECT DISTINCT {_CLEAN.format('tag')} AS id FROM corpus), e AS (SELECT DISTINCT src, dst FROM (SELECT {_CLEAN.format('source_tag')} AS src, {_CLEAN.format('target_tag')} AS dst FROM ref_edges) WHERE src <> dst AND src IN (SELECT id FROM n) AND dst IN (SELECT id FROM n)), o AS (SELECT src AS id, count(*) AS c FROM e GROUP BY 1), i AS (SELECT dst AS id, count(*) AS c FROM e GROUP BY 1)"


@query(f"WITH {SQL_CUR} SELECT source_tag, target_tag, 'refers_to' AS edge_type FROM (SELECT id AS source_tag, unnest(refs) AS target_tag FROM cur)")
def ref_edges_of_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.reference_edges(current_corpus(spark, sf_dir))


@query(f"WITH {_GRAPH} SELECT n.id, coalesce(i.c, 0)::BIGINT AS n_in, coalesce(o.c, 0)::BIGINT AS n_out, round(ln(1 + coalesce(i.c, 0)) + 0.35 * ln(1 + coalesce(o.c, 0)), 6) AS centrality FROM n LEFT JOIN i USING (id) LEFT JOIN o USING (id) WHERE n.id IS NOT NULL")
def degree_centrality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.degrees(*_graph(spark, sf_dir)).withColumn("centrality", F.round("centrality", 6))


_ARCS = "a AS (SELECT src AS node, dst AS t, 1.0 / sqrt(o.c) AS w FROM e JOIN o ON o.id = src UNION ALL SELECT dst, src, 0.65 / sqrt(i.c) FROM e JOIN i ON i.id = dst)"


@query(
    f"""WITH {_GRAPH}, {_ARCS}, seeds AS (SELECT id, 1.0 / (1 + 0.2 * (r - 1)) AS s FROM (SELECT id, row_number() OVER (ORDER BY c DESC, id) AS r FROM i) WHERE r <= 20),
h1 AS (SELECT t AS id, sum(s * w) AS s FROM seeds JOIN a ON node = seeds.id GROUP BY t), f1 AS (SELECT id, s FROM (SELECT *, row_number() OVER (ORDER BY round(s, 12) DESC, id) AS r FROM h1) WHERE r <= 160),
h2 AS (SELECT t AS id, sum(s * w * 0.55) AS s FROM f1 JOIN a ON node = f1.id GROUP BY t)
SELECT id, round(sum(s), 6) AS graph_score FROM (SELECT * FROM h1 UNION ALL SELECT * FROM h2) GROUP BY id"""
)
def graph_expand_2hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = _graph(spark, sf_dir)
    edges = cut(edges, "edges")
    best = top_k(edges.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).cast("double").alias("score")).withColumn("qid", F.lit(0)), 20, ["qid"], "score")
    seeds = best.select("qid", "id", (1.0 / (1 + 0.2 * (F.col("rank") - 1))).alias("signal"))
    return G.expand(seeds, G.GraphIndex.build(nodes, edges)).select("id", F.round("graph_score", 6).alias("graph_score"))


# --- hybrid search


DIM = 1536  # the default of the hash embeddings, as in the reference's build
BUILT: dict[tuple, SearchIndex] = {}  # search indexes built in this session, by application, folder and kind of vectors


def _given_vectors(spark: SparkSession, sf_dir: str, keys: DataFrame, key: str) -> DataFrame:
    """Vectors of the table of embeddings for any keys: a key's digest picks the row."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    digest = F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 7), 16, 10).cast("bigint")
    return keys.select(key, F.pmod(digest, F.lit(rows.count())).alias("vec_id")).join(rows, "vec_id").select(key, "embedding")


def search_index(spark: SparkSession, sf_dir: str, kind: str) -> SearchIndex:
    """Builds all that searches read and stores it: current corpus, lexical index, graph, and vectors that are given or hashed."""
    from folioscan.plans.pipeline import lexical_input

    corpus = cut(current_corpus(spark, sf_dir).withColumn("content_hash", X.sha256(F.col("statement_text"))), "corpus")
    if kind == "hash":
        vectors = embed(corpus, "id", X.lines(F.col("statement_text"), F.col("normalized_text")), "hash", dim=DIM)
    else:
        vectors = _given_vectors(spark, sf_dir, corpus, "id")
    edges = cut(G.clean_edges(corpus, G.reference_edges(corpus)), "edges")
    path = scratch_path(spark, "search")
    SearchIndex(corpus, build_index(lexical_input(corpus)), vectors, G.GraphIndex.build(corpus, edges)).write(path)
    return SearchIndex.read(spark, path)


def _stored(spark: SparkSession, sf_dir: str, kind: str) -> SearchIndex:
    """The index of this session's first search over the folder; later ones read it."""
    key = spark.sparkContext.applicationId, sf_dir, kind
    if key not in BUILT:
        BUILT[key] = search_index(spark, sf_dir, kind)
    return BUILT[key]


def _given_stages(spark: SparkSession, sf_dir: str) -> Stages:
    queries = asked(spark)
    return search_stages(queries.join(_given_vectors(spark, sf_dir, queries, "qid"), "qid"), _stored(spark, sf_dir, "given"))


_VECTOR_OF = "embeddings JOIN (SELECT count(*) AS n FROM embeddings) c ON vec_id = ('0x' || substr(md5({0}::VARCHAR), 1, 7))::BIGINT % n"
_NORM = "CASE WHEN max({0}) OVER w - min({0}) OVER w <= 1e-12 THEN 1.0 ELSE ({0} - min({0}) OVER w) / (max({0}) OVER w - min({0}) OVER w) END"
_BOOST = """(CASE WHEN tag_hint <> '' AND cur.id = tag_hint THEN 10 ELSE 0 END) + (CASE WHEN prefer_env <> '' AND env_type = prefer_env THEN 0.75 ELSE 0 END)
+ (CASE WHEN wants_proof THEN (CASE WHEN trim(proof_text) <> '' THEN 0.45 WHEN env_type IN ('theorem', 'lemma', 'proposition') THEN 0.10 ELSE 0 END) + (CASE WHEN trim(statement_text) <> '' THEN 0.05 ELSE 0 END)
ELSE (CASE WHEN trim(statement_text) <> '' THEN 0.12 ELSE 0 END) - (CASE WHEN trim(proof_text) <> '' THEN 0.08 ELSE 0 END) END)
+ (CASE WHEN reference_hint <> '' AND reference = reference_hint THEN 0.6 ELSE 0 END)
+ (CASE WHEN chapter_key <> '' AND (contains(lower(query), lower(chapter_key)) OR contains(translate(lower(query), '_-', '  '), replace(lower(chapter_key), '-', ' '))) THEN 0.35 ELSE 0 END)
+ least(0.05 * len(list_filter(list_distinct(tokens), lambda x: length(x) >= 3 AND contains(replace(lower(title || ' ' || full_label), '-', ' '), x))), 0.35)"""
_EXPANDED = f"concat_ws(' ', query, nullif(array_to_string(list_filter([{', '.join(f"CASE WHEN contains(query, '{k}') THEN '{v}' END" for k, v in X.QUERY_EXPANSIONS)}], lambda x: x IS NOT NULL), ' '), ''))"
_SEARCH = f"""WITH RECURSIVE {SQL_CUR}, {SQL_ASKED}, {{intent}},
ask AS MATERIALIZED (SELECT *, regexp_extract_all(lower({_EXPANDED}), '[A-Za-z0-9_]+') AS tokens FROM intent),
qv AS (SELECT qid, embedding AS e FROM asked JOIN ({{q}}) USING (qid)),
dv AS (SELECT id, embedding AS d FROM cur JOIN ({{d}}) USING (id)),
v0 AS MATERIALIZED (SELECT qid, id, round(list_dot_product(e::DOUBLE[], d::DOUBLE[]), 9) AS s FROM qv, dv),
v AS (SELECT qid, id, s FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY s DESC, id) AS r FROM v0) WHERE r <= 120),
lex AS (SELECT id, {_UNI.format('title')} AS t, {_UNI.format("concat_ws(chr(10), nullif(title, ''), nullif(statement_text, ''), nullif(proof_text, ''), nullif(normalized_text, ''))")} AS c FROM cur),
tf AS MATERIALIZED (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(list_concat(t, c)) AS term FROM lex) GROUP BY ALL), dl AS (SELECT id, len(t) + len(c) AS dl FROM lex),
n AS (SELECT count(*)::DOUBLE AS n, avg(dl) AS a FROM dl), q AS (SELECT qid, unnest(tokens) AS term FROM ask), qn AS (SELECT qid, count(*) AS m FROM q GROUP BY qid), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
b0 AS MATERIALIZED (SELECT qid, id, count(*) AS got, round(sum(greatest(CASE WHEN ln((n - df + .5) / (df + .5)) > 0 THEN ln((n - df + .5) / (df + .5)) ELSE 1e-6 END, 0) * tf * 2.2 / (tf + 1.2 * (.25 + .75 * dl / a))), 9) AS s FROM q JOIN tf USING (term) JOIN df USING (term) JOIN dl USING (id), n GROUP BY qid, id),
b AS (SELECT qid, id, s FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY s DESC, id) AS r FROM b0 JOIN qn USING (qid) WHERE got = m) WHERE r <= 120),
pool AS MATERIALIZED (SELECT qid, id, max(vs) AS vs, max(bs) AS bs FROM (
  SELECT qid, id, coalesce(vs, 0) AS vs, coalesce(bs, 0) AS bs FROM (SELECT qid, id, {_NORM.format('s')} AS vs FROM v WINDOW w AS (PARTITION BY qid)) FULL JOIN (SELECT qid, id, {_NORM.format('s')} AS bs FROM b WINDOW w AS (PARTITION BY qid)) USING (qid, id)
  UNION ALL SELECT qid, tag_hint, 0, 0 FROM ask WHERE tag_hint IN (SELECT id FROM cur)) GROUP BY qid, id),
base AS MATERIALIZED (SELECT qid, id, vs, bs, round(0.55 * vs + 0.45 * bs + {_BOOST}, 9)::DOUBLE AS score FROM pool JOIN cur USING (id) JOIN ask USING (qid)),
hints AS (SELECT qid, tag_hint AS id, 0 AS o FROM ask WHERE tag_hint IN (SELECT id FROM cur) UNION ALL SELECT qid, cur.id, 1 FROM ask JOIN cur ON reference = reference_hint WHERE reference_hint <> ''),
listed AS (SELECT qid, id, r AS place FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS r FROM base) WHERE r <= 20
  UNION ALL SELECT h.qid, h.id, coalesce(k, 0) + row_number() OVER (PARTITION BY h.qid ORDER BY o, h.id) FROM hints h LEFT JOIN (SELECT qid, least(count(*), 20) AS k FROM base GROUP BY qid) USING (qid)),
seeds AS MATERIALIZED (SELECT qid, id, greatest(coalesce(score, 0), 0.05) / (1 + 0.2 * (place - 1)) AS signal FROM (SELECT qid, id, min(place) AS place FROM listed GROUP BY ALL) LEFT JOIN base USING (qid, id)),
e AS MATERIALIZED (SELECT DISTINCT src, dst FROM (SELECT id AS src, upper(trim(unnest(refs))) AS dst FROM cur) WHERE dst IN (SELECT id FROM cur) AND src <> dst),
o AS (SELECT src AS id, count(*) AS c FROM e GROUP BY 1), i AS (SELECT dst AS id, count(*) AS c FROM e GROUP BY 1),
a AS MATERIALIZED (SELECT src AS node, dst AS t, 1.0 / sqrt(o.c) AS w FROM e JOIN o ON o.id = src UNION ALL SELECT dst, src, 0.65 / sqrt(i.c) FROM e JOIN i ON i.id = dst),
h1 AS MATERIALIZED (SELECT qid, t AS id, sum(signal * w) AS s FROM seeds JOIN a ON node = seeds.id GROUP BY ALL),
f1 AS (SELECT qid, id, s FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(s, 12) DESC, id) AS r FROM h1) WHERE r <= 160),
h2 AS (SELECT qid, t AS id, sum(s * w * 0.55) AS s FROM f1 JOIN a ON node = f1.id GROUP BY ALL),
g AS MATERIALIZED (SELECT qid, id, sum(s) AS g FROM (SELECT * FROM h1 UNION ALL SELECT * FROM h2) GROUP BY ALL),
added AS (SELECT qid, id FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(g, 12) DESC, id) AS r FROM g) WHERE r <= 80),
everyone AS MATERIALIZED (SELECT * FROM base UNION ALL SELECT qid, cur.id, 0, 0, round({_BOOST}, 9)::DOUBLE FROM added x JOIN cur ON cur.id = x.id JOIN ask USING (qid) WHERE NOT EXISTS (SELECT 1 FROM base WHERE base.qid = x.qid AND base.id = x.id)),
central AS (SELECT qid, id, {_NORM.format('c')} AS c FROM (SELECT qid, x.id, ln(1 + coalesce(i.c, 0)) + 0.35 * ln(1 + coalesce(o.c, 0)) AS c FROM everyone x LEFT JOIN i ON i.id = x.id LEFT JOIN o ON o.id = x.id) WINDOW w AS (PARTITION BY qid)),
gn AS (SELECT qid, id, {_NORM.format('g')} AS g FROM g WINDOW w AS (PARTITION BY qid)) """.replace("{intent}", _INTENT).replace("{q}", "SELECT qid, embedding FROM asked, LATERAL (SELECT embedding FROM " + _VECTOR_OF.format("qid") + ")").replace("{d}", "SELECT id, embedding FROM cur, LATERAL (SELECT embedding FROM " + _VECTOR_OF.format("id") + ")")


@query(_SEARCH + "SELECT qid, id, round(score, 6) AS score, round(vs, 6) AS vs, round(bs, 6) AS bs FROM base")
def hybrid_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base scores of all candidates, before the graph: vectors and BM25 (all terms) fused, and intents."""
    found = _given_stages(spark, sf_dir).base
    return found.select("qid", "id", *[F.round(c, 6).alias(c) for c in ("score", "vs", "bs")])


@query(_SEARCH + "SELECT qid, id, round(signal + 1e-7, 5) AS signal FROM seeds")
def hybrid_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents from which each query spreads over the graph, with their signals."""
    # Off the exact halves, which engines round differently.
    return _given_stages(spark, sf_dir).seeds.select("qid", "id", F.round(F.col("signal") + 1e-7, 5).alias("signal"))


@query(_SEARCH + "SELECT qid, id, round(score + 0.35 * coalesce(g, 0) + 0.10 * c, 6) AS score, round(vs, 6) AS vs, round(bs, 6) AS bs FROM everyone JOIN central USING (qid, id) LEFT JOIN gn USING (qid, id)")
def hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: all stated queries, ranked over the current corpus by given vectors, BM25 (all terms), intents and graph."""
    found = _given_stages(spark, sf_dir).final
    return found.select("qid", "id", *[F.round(c, 6).alias(c) for c in ("score", "vs", "bs")])


@query()
def hybrid_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same on hash embeddings of the texts, which SQL cannot compute."""
    return hybrid_search(with_embeddings(asked(spark), dim=DIM), _stored(spark, sf_dir, "hash"))


@query()
def hybrid_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall and MRR by category of finding every titled tag of the corpus by its own kind and title, on hash embeddings."""
    index = _stored(spark, sf_dir, "hash")
    rows = cut(evaluation_rows(index.corpus), "eval")
    return evaluate(rows, index, HybridParameters(lexical_mode="or"), provider="hash", dim=DIM)[1]


def evaluation_rows(corpus: DataFrame) -> DataFrame:
    """``id, query, relevant_tags, category``: each titled tag is asked for by its kind and title."""
    return corpus.filter("title <> ''").select("id", F.concat_ws(" ", "env_type", "title").alias("query"), F.array("id").alias("relevant_tags"), F.col("env_type").alias("category"))


@query()
def hash_embedding_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    made = hash_vectors(docs, "doc_id", F.col("text"), DIM)
    dense = cut(made.select("doc_id", densify(F.col("indices"), F.col("values"), DIM).alias("embedding")), "hashed")
    return vector_top_k(dense, dense.filter("doc_id % 20 = 0").select(F.col("doc_id").alias("qid"), "embedding"), 5, "doc_id")


# --- literature


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.lower(F.regexp_replace(X.text(F.col("source")), r"(?U)[\s\p{Z}]+", ""))
    rows = table(spark, sf_dir, "retrieve_papers").select("item_id", *[X.text(F.col(c)).alias(c) for c in ("title", "authors", "year", "summary", "url", "doi", "arxiv_id")], F.when(key == "mathstackexchange", "mathse").otherwise(key).alias("source_key"))
    return rows.distinct()


_LIT = r"lit AS (SELECT DISTINCT item_id, coalesce(title, '') AS title, coalesce(authors, '') AS authors, coalesce(year, '') AS year, coalesce(summary, '') AS summary, coalesce(url, '') AS url, coalesce(doi, '') AS doi, coalesce(arxiv_id, '') AS arxiv_id, CASE WHEN lower(regexp_replace(coalesce(source, ''), '[\s\p{Z}]+', '', 'g')) = 'mathstackexchange' THEN 'mathse' ELSE lower(regexp_replace(coalesce(source, ''), '[\s\p{Z}]+', '', 'g')) END AS k FROM retrieve_papers)"
_STRIP = r"regexp_replace({0}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"
_DOI = r"lower(regexp_extract({0}, '(?i)10\.\d{{4,9}}/[-._;()/:A-Z0-9]+'))"
_ARX = r"lower(regexp_extract({0}, '(?i)(?:arxiv\.org/(?:abs|pdf)/|^)(\d{{4}}\.\d{{4,5}}(?:v\d+)?)', 1))"
_TITLE = r"trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'))"
_KEYS = f"keyed AS (SELECT *, coalesce('doi:' || nullif(d, ''), 'arxiv:' || nullif(a, ''), 'title:' || nullif({_TITLE.format('title')}, ''), 'url:' || nullif(lower(u), ''), '') AS key FROM (SELECT *, coalesce(nullif(lower({_STRIP.format('doi')}), ''), {_DOI.format('u')}) AS d, coalesce(nullif(lower({_STRIP.format('arxiv_id')}), ''), {_ARX.format('u')}) AS a FROM (SELECT *, {_STRIP.format('url')} AS u FROM lit)))"


@query(f"WITH {_LIT} SELECT item_id, {_TITLE.format('title')} AS title_key, {_DOI.format('doi')} AS doi_key, {_ARX.format(_STRIP.format('arxiv_id'))} AS arxiv_key, regexp_extract(year, '((?:19|20)\\d{{2}})', 1) AS year FROM lit")
def literature_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _items(spark, sf_dir).select("item_id", L.title_key(F.col("title")).alias("title_key"), L.doi_in(F.col("doi")).alias("doi_key"), L.arxiv_in(F.col("arxiv_id")).alias("arxiv_key"), L.year_of(F.col("year")).alias("year"))


_W = "CASE k " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in L.WEIGHTS.items()) + " ELSE 0.5 END"
_PLACE = "CASE k " + " ".join(f"WHEN '{k}' THEN {n}" for n, k in enumerate(L.SOURCES, 1)) + " ELSE 0 END"
_LABEL = "CASE k " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in L.LABELS.items()) + " ELSE k END"


@query(
    f"""WITH {_LIT}, {_KEYS}, c AS (SELECT key, {_STRIP.format('title')} AS title, {_STRIP.format('year')} AS year, {_STRIP.format('summary')} AS summary, {_LABEL} AS src, ({_PLACE}, item_id) AS o, {_W} / (1 + 0.12 * greatest(0, item_id - 1)) AS sig FROM keyed WHERE key <> ''),
p AS (SELECT key, string_agg(src, ' + ' ORDER BY o) AS provenance FROM (SELECT key, src, min(o) AS o FROM c GROUP BY ALL) GROUP BY key)
SELECT key, coalesce(arg_min(title, o) FILTER (title <> ''), '') AS title, coalesce(arg_min(year, o) FILTER (year <> ''), '') AS year, arg_min(summary, (-length(summary), o)) AS summary, round(max(sig), 9) AS rank_signal, any_value(provenance) AS provenance FROM c JOIN p USING (key) GROUP BY key"""
)
def dedupe_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = merge_by_key(ranked_items(_items(spark, sf_dir).withColumn("rank", F.col("item_id"))))
    return merged.select("key", "title", "year", "summary", F.round("rank_signal", 9).alias("rank_signal"), F.array_join("provenance", " + ").alias("provenance"))


_REC = f"CASE WHEN y IS NULL OR y <= 1900 OR y > {NOW_YEAR + 1} THEN 0 WHEN greatest({NOW_YEAR} - y, 0) <= 1 THEN 1 WHEN {NOW_YEAR} - y <= 3 THEN 0.8 WHEN {NOW_YEAR} - y <= 6 THEN 0.55 WHEN {NOW_YEAR} - y <= 10 THEN 0.3 ELSE 0.12 END"


@query(f"WITH {_LIT}, t AS (SELECT *, try_cast(regexp_extract(year, '((?:19|20)\\d{{2}})', 1) AS INT) AS y, list_filter(['flat', 'descent', 'coherent', 'sheaf'], lambda x: contains(lower(title || ' ' || summary), x)) AS h FROM lit) SELECT item_id, round({_W} / (1 + 0.12 * greatest(0, item_id - 1)), 9)::DOUBLE AS rank_score, ({_REC})::DOUBLE AS recency, round(len(h) / 4.0, 9)::DOUBLE AS overlap FROM t")
def literature_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = F.array(*[F.lit(t) for t in ("flat", "descent", "coherent", "sheaf")])
    return _items(spark, sf_dir).select("item_id", F.round(L.source_rank_score(F.col("source_key"), F.col("item_id")), 9).alias("rank_score"), L.recency(L.year_of(F.col("year")), NOW_YEAR).alias("recency"), F.round(L.overlap(F.col("title"), F.col("summary"), tokens), 9).alias("overlap"))


# --- refresh, routes


_REFRESH = f"""h AS (SELECT {_CLEAN.format('tag')} AS tag, full_label, loaded_at, fetched_at_utc, coalesce(statement_html, '') <> '' AS s, coalesce(full_html, '') <> '' AS f FROM corpus),
first_ AS (SELECT tag, arg_min({{'l': full_label, 's': s, 'f': f, 'at': fetched_at_utc}}, (loaded_at, full_label, coalesce(fetched_at_utc, 0), s, f)) AS c FROM h WHERE tag IS NOT NULL AND loaded_at < '2024-10-01' GROUP BY tag),
tags AS (SELECT tag, max(full_label) AS full_label FROM h WHERE tag IS NOT NULL GROUP BY tag),
plan AS (SELECT tag, CASE WHEN c IS NULL THEN 'missing_or_forced' WHEN c.l IS DISTINCT FROM full_label THEN 'full_label_changed' WHEN NOT c.s OR NOT c.f THEN 'previous_failure' WHEN coalesce(c.at, 0) <= 0 THEN 'missing_timestamp' WHEN ({NOW} - c.at) / 3600.0 >= 4000 THEN 'cache_expired' ELSE 'cache_valid' END AS reason FROM tags LEFT JOIN first_ USING (tag))"""


def _refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "corpus").select(clean_tag(F.col("tag")).alias("tag"), "full_label", "loaded_at", "fetched_at_utc", (X.text(F.col("statement_html")) != "").alias("s"), (X.text(F.col("full_html")) != "").alias("f")).filter("tag IS NOT NULL")
    first = rows.filter("loaded_at < timestamp_ntz'2024-10-01'").groupBy("tag").agg(F.min_by(F.struct("full_label", F.col("s").alias("statement_ok"), F.col("f").alias("full_ok"), "fetched_at_utc"), F.struct("loaded_at", "full_label", F.coalesce("fetched_at_utc", F.lit(0)), "s", "f")).alias("c")).select("tag", "c.*")
    return C.refresh_plan(rows.groupBy("tag").agg(F.max("full_label").alias("full_label")), first, NOW, 4000.0)


@query(f"WITH {_REFRESH} SELECT tag, reason FROM plan")
def refresh_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _refresh(spark, sf_dir).select("tag", "reason")


@query(f"WITH {_REFRESH} SELECT reason, count(*) AS n FROM plan GROUP BY reason")
def skip_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _refresh(spark, sf_dir).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


_CONF = "(CASE WHEN l > 0 THEN 0.45 + least(0.25, 0.025 * least(l, 10)) ELSE 0 END) + (CASE WHEN p > 0 THEN 0.25 + least(0.2, 0.03 * least(p, 10)) + 0.05 * 0.5 ELSE 0 END) - (CASE WHEN (l > 0) <> (p > 0) THEN 0.1 ELSE 0 END)"


@query(
    f"""WITH g AS (SELECT l, p, f FROM range(0, 13) a(l), range(0, 13) b(p), range(0, 2) c(f)), r AS (SELECT *, CASE WHEN l > 0 AND p > 0 THEN 'ag_retrieval' WHEN l > 0 THEN 'stacks_only_degraded' WHEN p > 0 THEN 'papers_only_degraded' ELSE 'retrieval_unavailable' END AS route, {_CONF} AS s FROM g),
s AS (SELECT l, p, f, route, round(greatest(0, least(1, (CASE WHEN route = 'retrieval_unavailable' THEN least(s, 0.05) ELSE s END) + (CASE WHEN l + p > 0 THEN 0.06 ELSE 0 END) - f * 0.08)), 4) AS c FROM r)
SELECT l::INT AS n_local, p::INT AS n_papers, f::INT AS timeouts, route, c::DOUBLE AS confidence, CASE WHEN c >= 0.75 THEN 'high' WHEN c >= 0.45 THEN 'medium' ELSE 'low' END AS quality FROM s"""
)
def route_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(a, b, f) for a in range(13) for b in range(13) for f in range(2)], "n_local int, n_papers int, timeouts int")
    rows = rows.withColumn("route", S.route(F.lit("high"), F.col("n_local"), F.col("n_papers")))
    reasons = F.when(F.col("timeouts") > 0, F.array(F.lit("timeout"))).otherwise(F.array().cast("array<string>"))
    rows = rows.withColumn("confidence", S.source_confidence(F.col("route"), F.col("n_local"), F.col("n_papers"), F.lit(False), F.lit(0.5), F.col("n_local") + F.col("n_papers"), reasons))
    return rows.withColumn("quality", S.quality_band(F.col("confidence")))


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def hourly_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = windowed_counts(table(spark, sf_dir, "events"))
    return got.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 6).alias("total"))
