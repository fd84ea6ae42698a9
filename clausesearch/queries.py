"""Registered queries of the core and their SQL. All run over whole tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausesearch.functions.extraction import html_text
from clausesearch.functions.metadata import parse_file_name
from clausesearch.functions.text import chunk_id, citation_label, normalize_text, snippet, words
from clausesearch.operators import answering, chunking, corpus, dedup, embedding, evaluate, fulltext, fusion, golden, vectors
from clausesearch.runtime import materialize, read_table, shared_dir
from clausesearch.sources import files
from clausesearch.sources.store import ChunkStore, pending
from clausesearch.streaming.ingest import ingest_stream

QUERIES = {}
SQL = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _new_folder(spark: SparkSession, name: str) -> str:
    import uuid

    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, chunked and ranked for one query."""
    documents = read_table(spark, sf_dir, "documents").select("doc_id", "country", "norm_id", "text")
    chunks = materialize(chunking.chunk_texts(documents, "hybrid").withColumn("chunk", F.concat_ws("#", "doc_id", "idx")), "chunks")
    question = spark.createDataFrame([(0, "autoridad vigilancia")], "qid long, qtext string")
    hits = fulltext.search_lexical(chunks, question, k=10, id_col="chunk")
    return hits.join(chunks.select(F.col("chunk").alias("id"), "country", "norm_id", "article", "text"), "id").orderBy("rank")


# Texts

W = r"[\s\x{000b}\x{0085}\x{001c}-\x{001f}\pZ]"
NORMAL = rf"""array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '{W}+', ' ', 'g'))),
  lambda x: x <> '' AND NOT contains(x, '....')), chr(10))"""


@query(r"""WITH p AS (SELECT file_id, string_split(regexp_replace(file_name, '\.[^.]*$', ''), '_') AS p FROM source_files)
SELECT file_id, CASE WHEN len(p) >= 3 THEN p[1] END AS country, CASE WHEN len(p) >= 3 THEN p[2] END AS agency, CASE WHEN len(p) >= 3 THEN p[3] END AS norm_id,
  CASE WHEN len(p) >= 3 THEN nullif(array_to_string(p[4:], '_'), '') END AS variant,
  CASE WHEN len(p) >= 3 THEN TRY_CAST(list_extract(regexp_extract_all(p[3], '(?:19|20)\d{2}'), -1) AS INT) END AS year, coalesce(len(p) >= 3, false) AS ok FROM p""")
def parse_source_filename(spark, sf_dir):
    names = read_table(spark, sf_dir, "source_files").select("file_id", "file_name")
    return parse_file_name(names).select("file_id", "country", "agency", "norm_id", "variant", "year", F.col("error").isNull().alias("ok"))


@query(f"SELECT doc_id, CASE WHEN text IS NOT NULL THEN {NORMAL} END AS text FROM documents")
def normalized_texts(spark, sf_dir):
    return read_table(spark, sf_dir, "documents").select("doc_id", normalize_text(F.col("text")).alias("text"))


@query(f"SELECT doc_id, {NORMAL} AS text FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)")
def html_main_text(spark, sf_dir):
    """The documents, put into pages with menus and scripts, come out again."""
    escaped = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.concat(F.lit("<p>"), F.replace(F.replace(F.replace(x, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit("</p>")))
    page = F.concat(F.lit('<html><head><script>var x = "</p>";</script></head><body><nav><a href="/">Inicio</a></nav><div>'), F.array_join(escaped, ""), F.lit("</div><footer>&copy; Sitio</footer></body></html>"))
    return read_table(spark, sf_dir, "documents").select("doc_id", html_text(page).alias("text"))


@query(f"SELECT doc_id, {NORMAL} AS text FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)")
def html_page_shapes(spark, sf_dir):
    """The documents in pages of five shapes: tags of their own for the site's parts, or nothing but div and table, with lists of links before, beside and after."""
    escaped = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.concat(F.lit("<p>"), F.replace(F.replace(F.replace(x, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit("</p>")))
    body = F.array_join(escaped, "")
    links = "".join(f'<div><a href="/{i}">{x}</a></div>' for i, x in enumerate(("Inicio", "Trámites", "Normativa vigente", "Ediciones anteriores", "Búsqueda avanzada")))
    news = '<div><div>Lo último</div><div><a href="/n">Se publicó la nueva guía de trámites para la certificación de productos de la agencia</a></div></div>'
    wrap = lambda a, z: F.concat(F.lit(f"<html><body>{a}"), body, F.lit(f"{z}</body></html>"))
    plain = wrap(f"<header>Agencia</header><nav>{links}</nav><div>", "</div><aside>Lo último</aside><footer>&copy; Sitio</footer>")
    shapes = [
        wrap(f"<div><div>Ir al contenido</div><div>{links}</div></div><div>", "</div><div><div>Mapa del sitio</div><div>Redes</div></div>"),
        wrap(f"<div><div>{links}</div><div>", f"</div><div>{news}</div></div>"),
        wrap(f"<table><tr><td><div>{links}</div></td><td><div>", "</div></td></tr></table>"),
        wrap(f"{news}<div><div><div>", f"</div></div></div><div>{links}{news}</div><div>Términos de uso</div>"),
    ]
    # Without running text there is no main part to find, and all that is no tag of the site stays.
    running = F.exists(F.split("text", "\n"), lambda x: F.length(F.trim(x)) >= 200)
    page = reduce(lambda c, i: F.when(running & (F.pmod("doc_id", F.lit(5)) == i), shapes[i]).otherwise(c), range(4), plain)
    return read_table(spark, sf_dir, "documents").select("doc_id", html_text(page).alias("text"))


HEAD = rf"[ \t]*(?:ART[ÍI]CULO|ART\.){W}*\d+{W}*[°º]?{W}*[.\-–]"
SPANS = rf"""
parts AS (SELECT doc_id, string_split(regexp_replace(text, '(?im)(^{HEAD})', chr(1) || '\1', 'g'), chr(1)) AS l FROM documents WHERE text IS NOT NULL),
each AS (SELECT doc_id, unnest(l) AS x, generate_subscripts(l, 1) AS i FROM parts),
spans AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS span, nullif(regexp_extract(x, '(?i)^[ \t]*(?:ART[ÍI]CULO|ART\.){W}*(\d+){W}*[°º]?{W}*[.\-–]', 1), '') AS article, body
  FROM (SELECT *, regexp_replace(x, '^{W}+|{W}+$', '', 'g') AS body FROM each) WHERE body <> '')"""


def _windows_sql(source: str) -> str:
    """Greedy windows of (doc_id, span, article, body) rows by a recursive query over word offsets."""
    return rf"""
w AS (SELECT doc_id, span, article, list_filter(regexp_split_to_array(body, '{W}+'), lambda x: x <> '') AS w FROM {source}),
u AS (SELECT doc_id, span, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM w),
c AS (SELECT doc_id, span, list(c ORDER BY i) AS c FROM (SELECT doc_id, span, i, (sum(length(x) + 1) OVER (PARTITION BY doc_id, span ORDER BY i))::INT AS c FROM u) GROUP BY doc_id, span),
r AS (SELECT doc_id, span, c, 0 AS s, greatest(1, len(list_filter(c, lambda x: x - 1 <= 1200))) AS e FROM c
  UNION ALL SELECT doc_id, span, c, n, greatest(n + 1, len(list_filter(c, lambda x: x - c[n] - 1 <= 1200))) FROM (
    SELECT doc_id, span, c, greatest(s + 1, len(list_filter(list_prepend(0, c), lambda x: c[e] - x > 200))) AS n FROM r WHERE e < len(c))),
windows AS (SELECT r.doc_id, r.span, w.article, r.s, array_to_string(w.w[r.s + 1:r.e], ' ') AS text FROM r JOIN w USING (doc_id, span))"""


@query(f"WITH {SPANS} SELECT doc_id, article, span::INT AS idx, body AS text, length(body)::INT AS n_chars FROM spans")
def chunk_article(spark, sf_dir):
    return chunking.chunk_texts(read_table(spark, sf_dir, "documents").select("doc_id", "text"), "article")


@query(f"""WITH RECURSIVE whole AS (SELECT doc_id, 0 AS span, NULL AS article, text AS body FROM documents WHERE text IS NOT NULL), {_windows_sql('whole')}
SELECT doc_id, article::VARCHAR AS article, (row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1)::INT AS idx, text, length(text)::INT AS n_chars FROM windows""")
def chunk_fixed(spark, sf_dir):
    return chunking.chunk_texts(read_table(spark, sf_dir, "documents").select("doc_id", "text"), "fixed")


@query(f"""WITH RECURSIVE {SPANS}, long AS (SELECT * FROM spans WHERE length(body) > 1200), {_windows_sql('long')},
every AS (SELECT doc_id, span, article, 0 AS s, body AS text FROM spans WHERE length(body) <= 1200 UNION ALL SELECT * FROM windows)
SELECT doc_id, article, (row_number() OVER (PARTITION BY doc_id ORDER BY span, s) - 1)::INT AS idx, text, length(text)::INT AS n_chars FROM every""")
def chunk_hybrid(spark, sf_dir):
    return chunking.chunk_texts(read_table(spark, sf_dir, "documents").select("doc_id", "text"), "hybrid")


@query("SELECT row_id, country || '_' || agency || '_' || norm_id || coalesce('_' || nullif(variant, ''), '') || '#' || strategy || '#' || idx AS chunk_id FROM chunks")
def chunk_record_ids(spark, sf_dir):
    names = ("country", "agency", "norm_id", "variant", "strategy", "idx")
    return read_table(spark, sf_dir, "chunks").select("row_id", chunk_id(*(F.col(c) for c in names)).alias("chunk_id"))


@query("""SELECT strategy, count(*) AS n_chunks, floor(median(length(text)))::BIGINT AS median, list_sort(list(length(text)))[greatest((count(*) * 95) // 100, 1)]::INT AS p95, max(length(text))::INT AS longest,
  count(*) FILTER (article <> '') AS with_article, (count(*) FILTER (article <> '') * 100) // count(*) AS percent FROM chunks GROUP BY strategy""")
def chunk_statistics(spark, sf_dir):
    return dedup.chunk_statistics(read_table(spark, sf_dir, "chunks"))


@query(rf"""SELECT row_id, norm_id, n_sources FROM (SELECT row_id, norm_id, row_number() OVER (PARTITION BY norm_id, t ORDER BY loaded_at, row_id) AS r, count(*) OVER (PARTITION BY norm_id, t) AS n_sources
  FROM (SELECT *, trim(regexp_replace(text, '{W}+', ' ', 'g')) AS t FROM chunks)) WHERE r = 1""")
def dedup_chunks(spark, sf_dir):
    chunks = read_table(spark, sf_dir, "chunks").select("row_id", "norm_id", "text", "loaded_at")
    return dedup.dedup_chunks(chunks, ["loaded_at", "row_id"]).select("row_id", "norm_id", "n_sources")


@query(rf"SELECT row_id, country || ' ' || norm_id || coalesce(' art. ' || nullif(article, ''), '') AS label, left(trim(regexp_replace(text, '{W}+', ' ', 'g')), 200) AS snippet FROM chunks")
def citation_labels(spark, sf_dir):
    chunks = read_table(spark, sf_dir, "chunks")
    return chunks.select("row_id", citation_label(F.col("country"), F.col("norm_id"), F.col("article")).alias("label"), snippet(F.col("text")).alias("snippet"))


# Search. Queries are the rows whose id is divisible by 20 (all rows where a query says so), against all rows.

USABLE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x <> 0)) > 0"


def _dense_sql(k: int, where: str = "true", name: str = "dense") -> str:
    return f"""{name} AS (SELECT qid, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM (
  SELECT q.row_id AS qid, c.row_id AS id, round(least(list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 1.0), 9) AS score
  FROM (SELECT * FROM chunks WHERE row_id % 20 = 0 AND {USABLE}) q, (SELECT * FROM chunks WHERE {where} AND {USABLE}) c)) WHERE rank <= {k})"""


def vector_queries(chunks: DataFrame) -> DataFrame:
    """Chunks whose id is divisible by 20 as queries, as ``every_chunk`` has them."""
    return every_chunk(chunks).where(F.col("qid") % 20 == 0)


def every_chunk(chunks: DataFrame) -> DataFrame:
    """All chunks as queries: the first code of the text, and the embedding."""
    code = F.regexp_extract("text", evaluate.CODE, 1)
    return chunks.select(F.col("row_id").alias("qid"), code.alias("qtext"), F.col("embedding").alias("qvec"), code.alias("needle"))


@query(f"WITH {_dense_sql(10)} SELECT qid, id, round(score, 6) AS score, rank::INT AS rank FROM dense")
def dense_topk(spark, sf_dir):
    chunks = read_table(spark, sf_dir, "chunks")
    return vectors.dense_topk(chunks, vector_queries(chunks)).withColumn("score", F.round("score", 6))


_AR = "country = 'AR'"


@query(f"WITH {_dense_sql(10, _AR)} SELECT qid, id, round(score, 6) AS score, rank::INT AS rank FROM dense")
def dense_topk_country(spark, sf_dir):
    chunks = read_table(spark, sf_dir, "chunks")
    return vectors.dense_topk(chunks, vector_queries(chunks), country="AR").withColumn("score", F.round("score", 6))


@query(f"WITH {_dense_sql(10)} SELECT qid, id, round(score, 6) AS score, rank::INT AS rank FROM dense")
def ann_all_lists(spark, sf_dir):
    """The partitioned index with every list probed gives the exact result."""
    chunks = read_table(spark, sf_dir, "chunks")
    index = vectors.IvfIndex(chunks)
    return index.search(vector_queries(chunks), probes=len(index.centres)).withColumn("score", F.round("score", 6))


@query()
def ann_topk(spark, sf_dir):
    chunks = read_table(spark, sf_dir, "chunks")
    return vectors.IvfIndex(chunks).search(vector_queries(chunks))


@query(f"WITH {_dense_sql(10)} SELECT qid, id, round(score, 6) AS score, rank::INT AS rank FROM dense")
def dense_gated(spark, sf_dir):
    """By the exact scan below 50,000 rows, by the index above."""
    chunks = read_table(spark, sf_dir, "chunks")
    return vectors.gated_topk(chunks, vector_queries(chunks)).withColumn("score", F.round("score", 6))


@query("SELECT count(*) AS n_rows, count(*) >= 50000 AS build, greatest(1, count(*) // 1000) AS lists FROM chunks")
def ann_gate(spark, sf_dir):
    n = read_table(spark, sf_dir, "chunks").agg(F.count("*").alias("n_rows"))
    return n.select("n_rows", (F.col("n_rows") >= vectors.ANN_ROWS).alias("build"), F.greatest(F.lit(1), F.floor(F.col("n_rows") / 1000)).cast("long").alias("lists"))


_CODES = "array_to_string(regexp_extract_all(question, '[A-Z]{2}-\\d+'), ' ')"
GOLDEN_Q = f"SELECT pair_id AS qid, {_CODES} AS qtext FROM golden_questions WHERE pair_id % 20 = 0"
CHUNK_Q = "SELECT row_id AS qid, regexp_extract(text, '[A-Z]{2}-\\d+') AS qtext FROM chunks WHERE row_id % 20 = 0"


def _lexical_sql(questions: str, k: int, mode: str = "and", where: str = "true") -> str:
    having = "count(DISTINCT lexeme) = n" if mode == "and" else "true"
    alone = f"SELECT h.qid, h.id, sum(0.1 / (j * j) / {fulltext.ZETA2}) / any_value(m.n) AS score FROM h JOIN m USING (qid, id) {{}} GROUP BY h.qid, h.id"
    near = f"""SELECT a.qid, a.id, 1 - exp(sum(CASE WHEN a.pos = b.pos THEN 0 ELSE ln(1 - sqrt(0.01 * CASE WHEN abs(a.pos - b.pos) > 100 THEN 1e-30 ELSE 1 / (1.005 + 0.05 * exp(abs(a.pos - b.pos) / 1.5 - 2)) END)) END)) AS score
  FROM h a JOIN h b ON a.qid = b.qid AND a.id = b.id AND a.lexeme < b.lexeme JOIN m ON m.qid = a.qid AND m.id = a.id GROUP BY a.qid, a.id"""
    scored = alone.format("") if mode == "or" else f"{alone.format('WHERE m.n = 1')} UNION ALL {near}"
    return rf"""questions AS ({questions}),
ql AS (SELECT DISTINCT qid, unnest(regexp_extract_all(lower(qtext), '[\pL\pN]+')) AS lexeme FROM questions),
qn AS (SELECT qid, count(*) AS n FROM ql GROUP BY qid),
tok AS (SELECT id, unnest(l) AS lexeme, generate_subscripts(l, 1) AS pos FROM (SELECT row_id AS id, regexp_extract_all(lower(text), '[\pL\pN]+') AS l FROM chunks WHERE {where})),
pos AS (SELECT tok.*, row_number() OVER (PARTITION BY id, lexeme ORDER BY pos) AS j FROM tok WHERE lexeme IN (SELECT lexeme FROM ql)),
h AS (SELECT qid, id, lexeme, pos, j FROM pos JOIN ql USING (lexeme) WHERE j <= 256),
m AS (SELECT qid, id, n FROM h JOIN qn USING (qid) GROUP BY qid, id, n HAVING {having}),
scored AS ({scored}),
lexical AS (SELECT qid, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, id) AS rank FROM scored) WHERE rank <= {k})"""


def golden_queries(spark, sf_dir) -> DataFrame:
    """The codes in a question, as a query text."""
    codes = F.array_join(F.regexp_extract_all("question", F.lit(evaluate.CODE), 1), " ")
    return read_table(spark, sf_dir, "golden_questions").where(F.col("pair_id") % 20 == 0).select(F.col("pair_id").alias("qid"), codes.alias("qtext"))


QUESTION_Q = "SELECT pair_id AS qid, question AS qtext FROM golden_questions WHERE pair_id % 20 = 0"


EVERY_QUESTION_Q = "SELECT pair_id AS qid, question AS qtext FROM golden_questions"


def question_queries(spark, sf_dir) -> DataFrame:
    """The texts of the questions whose id is divisible by 20, as ``every_question`` has them."""
    return every_question(spark, sf_dir).where(F.col("qid") % 20 == 0)


def every_question(spark, sf_dir) -> DataFrame:
    """The whole texts of all questions. No model of the chunks' vectors is at hand, so they have no vector."""
    asked = read_table(spark, sf_dir, "golden_questions")
    return asked.select(F.col("pair_id").alias("qid"), F.col("question").alias("qtext"), F.lit(None).cast("array<float>").alias("qvec"))


_HITS = "SELECT qid, id, round(score, 6) AS score, rank::INT AS rank FROM lexical"


@query(f"WITH {_lexical_sql(GOLDEN_Q, 10)} {_HITS}")
def lexical_rank_and(spark, sf_dir):
    hits = fulltext.search_lexical(read_table(spark, sf_dir, "chunks"), golden_queries(spark, sf_dir))
    return hits.withColumn("score", F.round("score", 6))


@query(f"WITH {_lexical_sql(GOLDEN_Q, 10, 'or')} {_HITS}")
def lexical_rank_or(spark, sf_dir):
    hits = fulltext.search_lexical(read_table(spark, sf_dir, "chunks"), golden_queries(spark, sf_dir), mode="or")
    return hits.withColumn("score", F.round("score", 6))


@query(f"WITH {_lexical_sql(GOLDEN_Q, 10, where=_AR)} {_HITS}")
def lexical_rank_country(spark, sf_dir):
    hits = fulltext.search_lexical(read_table(spark, sf_dir, "chunks"), golden_queries(spark, sf_dir), country="AR")
    return hits.withColumn("score", F.round("score", 6))


@query(f"WITH {_lexical_sql(GOLDEN_Q, 10)} SELECT qid, id FROM m")
def lexical_match(spark, sf_dir):
    lexemes = fulltext.query_lexemes(golden_queries(spark, sf_dir))
    found = fulltext.lexical_match(fulltext.postings(read_table(spark, sf_dir, "chunks"), only=lexemes.select("lexeme").distinct()), lexemes)
    return found.select("qid", "id")


@query()
def lexical_spanish(spark, sf_dir):
    """Titles of all documents as queries, with stop words and stems."""
    titles = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("qid"), F.col("title").alias("qtext"))
    return fulltext.search_lexical(read_table(spark, sf_dir, "chunks"), titles, config="spanish")


_WEB = r"""WITH t AS (SELECT row_id AS id, regexp_extract_all(lower(text), '[\pL\pN]+') AS l FROM chunks),
m AS (SELECT *, ' ' || array_to_string(l, ' ') || ' ' AS s FROM t WHERE contains(' ' || array_to_string(l, ' ') || ' ', ' por mil ')),
h AS (SELECT id, unnest(l) AS lexeme, generate_subscripts(l, 1) AS pos FROM m WHERE contains(s, ' tolerancia ') AND NOT contains(s, ' cuna ')),
p AS (SELECT * FROM h WHERE lexeme IN ('por', 'mil', 'tolerancia')),
r AS (SELECT a.id, 1 - exp(sum(ln(1 - sqrt(0.01 * CASE WHEN abs(a.pos - b.pos) > 100 THEN 1e-30 ELSE 1 / (1.005 + 0.05 * exp(abs(a.pos - b.pos) / 1.5 - 2)) END)))) AS score FROM p a JOIN p b ON a.id = b.id AND a.lexeme < b.lexeme GROUP BY a.id)
SELECT id, round(score, 6) AS score FROM r"""


@query(_WEB)
def lexical_web(spark, sf_dir):
    """A phrase, a word and an excluded word."""
    return fulltext.search_web(read_table(spark, sf_dir, "chunks"), 'tolerancia "por mil" -cuna', k=2**31 - 1).withColumn("score", F.round("score", 6))


WEB_Q = f"SELECT * FROM ({CHUNK_Q}) WHERE qtext <> ''"
_TOKENS = "regexp_extract_all(lower(text), '[\\pL\\pN]+')"
_NO_CUNA = f"NOT list_contains({_TOKENS}, 'cuna')"


def _phrase_sql(questions: str, where: str) -> str:
    """Hits whose words stand one after another in the text."""
    return f"""WITH {_lexical_sql(questions, 10, where=where)},
ph AS (SELECT qid, ' ' || array_to_string(regexp_extract_all(lower(qtext), '[\\pL\\pN]+'), ' ') || ' ' AS p FROM questions), t AS (SELECT row_id AS id, ' ' || array_to_string({_TOKENS}, ' ') || ' ' AS s FROM chunks),
web AS (SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, id) AS rank FROM scored JOIN ph USING (qid) JOIN t USING (id) WHERE contains(s, p))
SELECT qid, id, round(score, 6) AS score, rank::INT AS rank FROM web WHERE rank <= 10"""


@query(_phrase_sql(WEB_Q, _NO_CUNA))
def lexical_web_batch(spark, sf_dir):
    """Many web-style queries at once: a phrase and an excluded word each."""
    chunks = read_table(spark, sf_dir, "chunks")
    asked = vector_queries(chunks).where("qtext <> ''").select("qid", F.concat(F.lit('"'), "qtext", F.lit('" -cuna')).alias("qtext"))
    return fulltext.search_lexical(chunks, asked, mode="web").withColumn("score", F.round("score", 6))


FUSED = """, pooled AS (SELECT qid, id, rank FROM dense UNION ALL SELECT qid, id, rank FROM lexical),
fused AS (SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM (SELECT qid, id, round(sum(1.0::DOUBLE / (60 + rank)), 12) AS score FROM pooled GROUP BY qid, id))"""
HYBRID = f"{_dense_sql(50)}, {_lexical_sql(CHUNK_Q, 50)}{FUSED}"


@query(f"WITH {HYBRID} SELECT qid, id, round(score, 9) AS score, rank::INT AS rank FROM fused WHERE rank <= 10")
def hybrid_search(spark, sf_dir):
    chunks = read_table(spark, sf_dir, "chunks")
    return fusion.search_hybrid(chunks, vector_queries(chunks)).withColumn("score", F.round("score", 9))


@query("""WITH a AS (SELECT norm_id AS qid, row_id AS id, row_number() OVER (PARTITION BY norm_id ORDER BY length(text) DESC, row_id) AS rank FROM chunks),
b AS (SELECT norm_id AS qid, row_id AS id, row_number() OVER (PARTITION BY norm_id ORDER BY loaded_at, row_id) AS rank FROM chunks),
s AS (SELECT qid, id, round(sum(1.0::DOUBLE / (60 + rank)), 12) AS score FROM (FROM a UNION ALL FROM b) GROUP BY qid, id)
SELECT qid, id, round(score, 9) AS score, (row_number() OVER (PARTITION BY qid ORDER BY score DESC, id))::INT AS rank FROM s""")
def rrf_fuse(spark, sf_dir):
    from pyspark.sql import Window

    chunks = read_table(spark, sf_dir, "chunks").select(F.col("norm_id").alias("qid"), F.col("row_id").alias("id"), F.char_length("text").alias("n"), "loaded_at")
    orders = ([F.desc("n"), "id"], ["loaded_at", "id"])
    rankings = [chunks.select("qid", "id", F.row_number().over(Window.partitionBy("qid").orderBy(*o)).alias("rank")) for o in orders]
    return fusion.reciprocal_rank_fusion(rankings).withColumn("score", F.round("score", 9))


@query(f"""WITH {HYBRID}, dense10 AS (SELECT qid, id FROM dense WHERE rank <= 10), lexical10 AS (SELECT qid, id FROM lexical WHERE rank <= 10), hybrid10 AS (SELECT qid, id FROM fused WHERE rank <= 10),
truth AS (SELECT DISTINCT q.qid, c.id FROM questions q JOIN (SELECT row_id AS id, unnest(regexp_extract_all(text, '[A-Z]{{2}}-\\d+')) AS code FROM chunks) c ON c.code = q.qtext),
got AS (SELECT 'dense' AS retriever, * FROM dense10 UNION ALL SELECT 'lexical', * FROM lexical10 UNION ALL SELECT 'hybrid', * FROM hybrid10)
SELECT retriever, (SELECT count(DISTINCT qid) FROM truth) AS probes, count(DISTINCT got.qid) AS hits FROM got JOIN truth USING (qid, id) GROUP BY retriever""")
def recall_at_10(spark, sf_dir):
    chunks = read_table(spark, sf_dir, "chunks")
    probes = vector_queries(chunks)
    pools = {"dense": vectors.dense_topk(chunks, probes, 50), "lexical": fulltext.search_lexical(chunks, probes, 50)}
    pools = {k: materialize(v, f"recall-{k}") for k, v in pools.items()}
    got = {k: v.where("rank <= 10") for k, v in pools.items()} | {"hybrid": fusion.reciprocal_rank_fusion(list(pools.values()), limit=10)}
    return evaluate.recall_at_k(evaluate.code_truth(chunks, probes.where("needle <> ''")), got)


@query()
def recall_by_kind(spark, sf_dir):
    """Identifiers, phrases and paraphrases: codes of all chunks, runs of three of their words, and all questions without the code they are about."""
    chunks = read_table(spark, sf_dir, "chunks")
    n = chunks.count()
    vector = chunks.select(F.col("row_id").alias("qid"), F.col("embedding").alias("qvec"))
    codes = every_chunk(chunks).where("needle <> ''").select("qid", "qtext", "needle")
    phrases = evaluate.phrase_probes(chunks).select("qid", F.concat(F.lit('"'), "needle", F.lit('"')).alias("qtext"), "needle")
    asked = read_table(spark, sf_dir, "golden_questions").select(F.col("pair_id").alias("qid"), F.regexp_extract("question", evaluate.CODE, 1).alias("needle"), F.regexp_replace("question", evaluate.CODE, " ").alias("qtext"))
    paraphrases = asked.where("needle <> ''")
    named = lambda df, kind: df.select(F.lit(kind).alias("kind"), "*")
    # The index is fitted on all vectors.
    index = vectors.IvfIndex(chunks, sample=n) if n >= vectors.ANN_ROWS else None
    dense = materialize(vectors.gated_topk(chunks, vector, 50, index=index), "recall-dense")
    lexical = {"identifiers": fulltext.search_lexical(chunks, codes, 50), "phrases": fulltext.search_lexical(chunks, phrases, 50, mode="web"), "paraphrases": fulltext.search_lexical(chunks, paraphrases, 50, mode="or")}
    lexical = {kind: materialize(hits, f"recall-{kind}") for kind, hits in lexical.items()}
    pools = {kind: [dense.join(probes.select("qid"), "qid", "left_semi"), lexical[kind]] for kind, probes in (("identifiers", codes), ("phrases", phrases))} | {"paraphrases": [lexical["paraphrases"]]}
    every = lambda f: reduce(DataFrame.unionByName, (named(f(kind).select("qid", "id"), kind) for kind in pools))
    none = dense.limit(0)
    got = {
        "dense": every(lambda kind: (pools[kind][0] if len(pools[kind]) > 1 else none).where("rank <= 10")), "lexical": every(lambda kind: lexical[kind].where("rank <= 10")),
        "hybrid": every(lambda kind: fusion.reciprocal_rank_fusion(pools[kind], limit=10)),
    }
    got = {name: materialize(hits, f"recall-got-{name}") for name, hits in got.items()}
    # A code or phrase of a row is in the row itself, so every probe has a true row; of the others only those retrieved matter.
    kept = lambda kind, probes: reduce(DataFrame.unionByName, (hits.where(F.col("kind") == kind).select("qid", "id") for hits in got.values())).unionByName(probes.select("qid", F.col("qid").alias("id"))).distinct()
    truth = [
        named(evaluate.code_truth(chunks, codes, among=kept("identifiers", codes)), "identifiers"),
        named(evaluate.phrase_truth(chunks, phrases, among=kept("phrases", phrases)), "phrases"), named(evaluate.code_truth(chunks, paraphrases), "paraphrases"),
    ]
    return evaluate.recall_by_kind(materialize(reduce(DataFrame.unionByName, truth), "recall-truth"), got)


@query("SELECT row_id AS id FROM chunks WHERE text ILIKE '%por mil%'")
def containing(spark, sf_dir):
    return evaluate.containing(read_table(spark, sf_dir, "chunks"), "por mil")


_CONTEXTS = """, blocks AS (SELECT qid, rank, '<fragmento country="' || country || '" norm_id="' || norm_id || '" article="' || coalesce(article, 'sin artículo') || '">' || chr(10) || text || chr(10) || '</fragmento>' AS block
  FROM lexical JOIN chunks ON row_id = id), made AS (SELECT qid, string_agg(block, chr(10) || chr(10) ORDER BY rank) AS context FROM blocks GROUP BY qid)
SELECT qid, coalesce(context, '(no se recuperó ningún fragmento del corpus)') AS context FROM questions LEFT JOIN made USING (qid)"""


@query(f"WITH {_lexical_sql(GOLDEN_Q, 3)}{_CONTEXTS}")
def answer_contexts(spark, sf_dir):
    chunks, asked = read_table(spark, sf_dir, "chunks"), golden_queries(spark, sf_dir)
    hits = fulltext.search_lexical(chunks, asked, 3)
    return answering.format_contexts(fusion.attach(hits, chunks), asked)


@query(f"WITH {_lexical_sql(EVERY_QUESTION_Q, 10, 'or')} {_HITS}")
def question_rank_or(spark, sf_dir):
    """All questions whole, any of their words."""
    hits = fulltext.search_lexical(read_table(spark, sf_dir, "chunks"), every_question(spark, sf_dir), mode="or", digits=15)
    return hits.withColumn("score", F.round("score", 6))


@query(f"WITH {_lexical_sql(QUESTION_Q, 8, 'or')}{_CONTEXTS}")
def question_contexts(spark, sf_dir):
    """Whole questions through hybrid search, eight hits each."""
    chunks, asked = read_table(spark, sf_dir, "chunks"), question_queries(spark, sf_dir)
    return answering.grouped_contexts(fusion.search_hybrid(chunks, asked, 8, mode="or"), chunks, asked.select("qid").distinct())


_CITED = "SELECT pair_id, unnest(citations) AS c, generate_subscripts(citations, 1) - 1 AS place FROM golden_questions"
_UNSUPPORTED = f""", seen AS (SELECT DISTINCT qid, country, norm_id, article FROM lexical JOIN chunks ON row_id = id), cited AS ({_CITED})
SELECT pair_id AS qid, c.country AS country, c.norm_id AS norm_id, c.article AS article FROM cited WHERE pair_id % 20 = 0 AND NOT EXISTS (
  SELECT 1 FROM seen s WHERE s.qid = pair_id AND s.country IS NOT DISTINCT FROM c.country AND s.norm_id IS NOT DISTINCT FROM c.norm_id AND s.article IS NOT DISTINCT FROM c.article)"""


@query(f"WITH {_lexical_sql(EVERY_QUESTION_Q, 10, 'or')}{_UNSUPPORTED.replace('pair_id % 20 = 0 AND ', '')}")
def question_citations_unsupported(spark, sf_dir):
    """Citations of all questions that are in none of the ten best hits of the whole question."""
    chunks = read_table(spark, sf_dir, "chunks")
    hits = fusion.attach(fusion.search_hybrid(chunks, every_question(spark, sf_dir), mode="or"), chunks)
    given = read_table(spark, sf_dir, "golden_questions").select(F.col("pair_id").alias("qid"), "citations")
    return answering.unsupported_citations(given, hits)


@query()
def answers(spark, sf_dir):
    """The whole path with the offline model for all questions, on contexts made as those of ``question_contexts``."""
    chunks, asked = read_table(spark, sf_dir, "chunks"), every_question(spark, sf_dir)
    hits = fusion.search_hybrid(chunks, asked, 8, mode="or")
    return answering.answer_rows(answering.grouped_contexts(hits, chunks, asked.select("qid", F.col("qtext").alias("question"))))


@query(f"WITH {_lexical_sql(GOLDEN_Q, 10)}{_UNSUPPORTED}")
def citations_unsupported(spark, sf_dir):
    chunks = read_table(spark, sf_dir, "chunks")
    hits = fusion.attach(fulltext.search_lexical(chunks, golden_queries(spark, sf_dir)), chunks)
    given = read_table(spark, sf_dir, "golden_questions").where(F.col("pair_id") % 20 == 0).select(F.col("pair_id").alias("qid"), "citations")
    return answering.unsupported_citations(given, hits)


# Question sets


@query(f"""WITH cited AS ({_CITED}) SELECT pair_id, place::INT AS place, c.country AS country, c.norm_id AS norm_id, c.article AS article FROM cited WHERE NOT EXISTS (
  SELECT 1 FROM (SELECT DISTINCT country, norm_id, article FROM chunks) s WHERE s.country IS NOT DISTINCT FROM c.country AND s.norm_id IS NOT DISTINCT FROM c.norm_id AND s.article IS NOT DISTINCT FROM c.article)""")
def citations_unknown(spark, sf_dir):
    return golden.unknown_citations(read_table(spark, sf_dir, "golden_questions"), read_table(spark, sf_dir, "chunks"), "pair_id")


@query(rf"""SELECT pair_id, list_filter([CASE WHEN question IS NULL OR regexp_matches(question, '^{W}*$') THEN 'blank_question' END, CASE WHEN expected_answer IS NULL OR regexp_matches(expected_answer, '^{W}*$') THEN 'blank_answer' END,
  CASE WHEN kind IS NULL OR kind NOT IN ('factual', 'synthesis', 'trap') THEN 'unknown_kind' END, CASE WHEN status IS NULL OR status NOT IN ('draft', 'reviewed') THEN 'unknown_status' END,
  CASE WHEN kind = 'trap' AND answerable THEN 'answerable_trap' END, CASE WHEN answerable AND coalesce(len(citations), 0) = 0 THEN 'uncited' END,
  CASE WHEN NOT coalesce(answerable, false) AND coalesce(len(citations), 0) > 0 THEN 'cited_unanswerable' END], lambda x: x IS NOT NULL) AS violations FROM golden_questions""")
def golden_violations(spark, sf_dir):
    return golden.violations(read_table(spark, sf_dir, "golden_questions")).select("pair_id", "violations")


@query("SELECT kind, count(*) AS total, count(*) FILTER (status = 'reviewed') AS reviewed FROM golden_questions GROUP BY kind")
def golden_counts(spark, sf_dir):
    return golden.counts(read_table(spark, sf_dir, "golden_questions"))


@query("SELECT id, count(*) AS n FROM golden_questions GROUP BY id HAVING count(*) > 1")
def golden_duplicate_ids(spark, sf_dir):
    return golden.duplicate_ids(read_table(spark, sf_dir, "golden_questions"))


@query(r"""SELECT prefix, max(number::BIGINT) + 1 AS next_number FROM (SELECT regexp_extract(id, '^(.*)-(\d+)$', 1) AS prefix, regexp_extract(id, '^(.*)-(\d+)$', 2) AS number FROM golden_questions) WHERE number <> '' GROUP BY prefix""")
def golden_next_numbers(spark, sf_dir):
    return golden.next_numbers(read_table(spark, sf_dir, "golden_questions"))


@query("SELECT pair_id FROM golden_questions WHERE status = 'reviewed'")
def golden_reviewed(spark, sf_dir):
    return golden.reviewed(read_table(spark, sf_dir, "golden_questions")).select("pair_id")


@query("SELECT pair_id FROM golden_questions WHERE status = 'draft' AND kind = 'trap'")
def golden_drafts(spark, sf_dir):
    return golden.drafts(read_table(spark, sf_dir, "golden_questions"), "trap").select("pair_id")


@query(f"""WITH cited AS ({_CITED}), unknown AS (SELECT count(*) AS unknown FROM cited WHERE NOT EXISTS (
  SELECT 1 FROM (SELECT DISTINCT country, norm_id, article FROM chunks) s WHERE s.country IS NOT DISTINCT FROM c.country AND s.norm_id IS NOT DISTINCT FROM c.norm_id AND s.article IS NOT DISTINCT FROM c.article))
SELECT (SELECT count(*) FROM golden_questions) AS entries, (SELECT count(*) FROM golden_questions WHERE status = 'reviewed') AS reviewed, (SELECT count(*) FROM cited) AS citations, unknown, (unknown > 0)::INT AS exit_code FROM unknown""")
def golden_status(spark, sf_dir):
    return golden.status_report(read_table(spark, sf_dir, "golden_questions"), read_table(spark, sf_dir, "chunks"))


@query(f"""WITH cited AS ({_CITED}), ranked AS (SELECT *, row_number() OVER (PARTITION BY country, norm_id, article ORDER BY idx, row_id) AS r FROM chunks),
bodies AS (SELECT country, norm_id, article, string_agg(text, chr(10) || chr(10) ORDER BY r) AS body FROM ranked WHERE r <= 3 GROUP BY ALL)
SELECT pair_id, place::INT AS place, c.country AS country, c.norm_id AS norm_id, c.article AS article, coalesce(b.body, '(no text)') AS body FROM cited LEFT JOIN bodies b
  ON b.country IS NOT DISTINCT FROM c.country AND b.norm_id IS NOT DISTINCT FROM c.norm_id AND b.article IS NOT DISTINCT FROM c.article""")
def cited_texts(spark, sf_dir):
    return golden.cited_texts(read_table(spark, sf_dir, "golden_questions"), read_table(spark, sf_dir, "chunks"), "pair_id")


# Corpus


@query("SELECT country, norm_id, count(*) AS n_chunks FROM chunks GROUP BY ALL")
def corpus_summary(spark, sf_dir):
    return corpus.summary(read_table(spark, sf_dir, "chunks"))


@query("SELECT count(*) AS n_chunks, count(DISTINCT norm_id) AS n_norms FROM chunks")
def corpus_totals(spark, sf_dir):
    return corpus.totals(read_table(spark, sf_dir, "chunks"))


@query("SELECT DISTINCT country, norm_id, article FROM chunks")
def distinct_citations(spark, sf_dir):
    return corpus.citable(read_table(spark, sf_dir, "chunks"))


_LONGEST = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY country, norm_id, article ORDER BY n_chars DESC, row_id) AS r FROM chunks WHERE article IS NOT NULL AND n_chars > {}) WHERE r = 1"


@query(f"SELECT country, norm_id, article, row_id, n_chars FROM ({_LONGEST.format(400)})")
def longest_articles(spark, sf_dir):
    return corpus.longest_articles(read_table(spark, sf_dir, "chunks")).select("country", "norm_id", "article", "row_id", "n_chars")


@query(f"""SELECT row_id, country FROM (SELECT row_id, country, row_number() OVER (PARTITION BY country ORDER BY md5('7:' || row_id), row_id) AS k FROM ({_LONGEST.format(400)})) ORDER BY k, country LIMIT 50""")
def round_robin_sample(spark, sf_dir):
    return corpus.round_robin(corpus.longest_articles(read_table(spark, sf_dir, "chunks")), 50).select("row_id", "country")


@query(f"""WITH a AS (SELECT * FROM ({_LONGEST.format(600)}) WHERE {USABLE}),
p AS (SELECT a.row_id AS a, b.row_id AS b, a.country AS country_a, a.norm_id AS norm_a, b.country AS country_b, b.norm_id AS norm_b, round(least(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 1.0), 9) AS score
  FROM a JOIN a b ON a.country < b.country ORDER BY score DESC, a, b LIMIT 40)
SELECT a, b, country_a, norm_a, country_b, norm_b, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY country_a, norm_a, country_b, norm_b ORDER BY score DESC, a, b) AS r FROM p) WHERE r = 1 ORDER BY score DESC, a, b LIMIT 10""")
def cross_country_pairs(spark, sf_dir):
    return corpus.cross_country_pairs(read_table(spark, sf_dir, "chunks")).withColumn("score", F.round("score", 6))


# Store, files and streams

_CUT = "(SELECT (epoch_us(max(loaded_at)) + epoch_us(min(loaded_at))) // 2 FROM chunks)"
_LATEST = "SELECT chunk_id, row_id, text, tokens FROM (SELECT chunk_id, row_id, text, len(regexp_extract_all(lower(text), '[\\pL\\pN]+')) AS tokens, row_number() OVER (PARTITION BY chunk_id ORDER BY loaded_at DESC, row_id DESC) AS r FROM chunks) WHERE r = 1"


def _old_and_new(spark, sf_dir):
    chunks = read_table(spark, sf_dir, "chunks").select("chunk_id", "row_id", "text", "loaded_at")
    cut = chunks.agg(F.expr("(max(unix_micros(loaded_at)) + min(unix_micros(loaded_at))) div 2").alias("c")).first().c
    late = F.unix_micros("loaded_at") > F.lit(cut)
    return chunks.where(~late), chunks.where(late)


@query(_LATEST)
def upsert_merge(spark, sf_dir):
    """A store of the older half of the time, upserted with the rows of the later half."""
    old, new = _old_and_new(spark, sf_dir)
    store = ChunkStore(spark, _new_folder(spark, "store"))
    store.upsert(old, ["loaded_at", "row_id"])
    store.upsert(new, ["loaded_at", "row_id"])
    return store.read().select("chunk_id", "row_id", "text", F.size("tokens").cast("long").alias("tokens"))


@query(f"SELECT *, length(text)::INT AS n_text FROM ({_LATEST})")
def store_derived(spark, sf_dir):
    """A store that gets a further derived column between two upserts."""
    old, new = _old_and_new(spark, sf_dir)
    store = ChunkStore(spark, _new_folder(spark, "store"))
    store.upsert(old, ["loaded_at", "row_id"])
    store.add_derived("n_text", "char_length(text)")
    store.upsert(new, ["loaded_at", "row_id"])
    return store.read().select("chunk_id", "row_id", "text", F.size("tokens").cast("long").alias("tokens"), "n_text")


@query(f"WITH {_lexical_sql(GOLDEN_Q, 10, where=f'row_id IN (SELECT row_id FROM ({_LATEST}))')} {_HITS}")
def lexical_stored(spark, sf_dir):
    """Search in the postings that a store has written; no text is read."""
    store = ChunkStore(spark, _new_folder(spark, "store"))
    store.upsert(read_table(spark, sf_dir, "chunks").select("chunk_id", "row_id", "text", "loaded_at"), ["loaded_at", "row_id"])
    hits = fulltext.search_lexical(store.read(), golden_queries(spark, sf_dir), stored=store.write_postings(id_col="row_id"))
    return hits.withColumn("score", F.round("score", 6))


@query(f"SELECT chunk_id, row_id FROM chunks WHERE chunk_id NOT IN (SELECT chunk_id FROM chunks WHERE epoch_us(loaded_at) <= {_CUT})")
def pending_rows(spark, sf_dir):
    old, new = _old_and_new(spark, sf_dir)
    return pending(new, old).select("chunk_id", "row_id")


@query(_LATEST)
def stream_upsert(spark, sf_dir):
    """The chunk files as a stream into a store."""
    folder = _new_folder(spark, "stream")
    table = ingest_stream(spark, f"{sf_dir}/chunks.parquet*", f"{folder}/store", f"{folder}/progress", ["loaded_at", "row_id"])
    return table.select("chunk_id", "row_id", "text", F.size("tokens").cast("long").alias("tokens"))


@query("SELECT chunk_id, text, country, agency, norm_id, variant, year, article, strategy, idx, n_chars, n_sources::BIGINT AS n_sources FROM chunks")
def jsonl_round_trip(spark, sf_dir):
    folder = _new_folder(spark, "jsonl")
    chunks = read_table(spark, sf_dir, "chunks")
    files.write_jsonl(chunks.select("chunk_id", "text", "country", "agency", "norm_id", "variant", "year", "article", "strategy", "idx", "n_chars", "n_sources"), folder)
    return files.read_jsonl(spark, folder)


@query("""WITH RECURSIVE t AS (SELECT row_id, row_id // 1000 AS segment, coalesce(length(text), 0) / 3.5::DOUBLE AS tokens, row_number() OVER (PARTITION BY row_id // 1000 ORDER BY row_id) AS i FROM chunks),
r AS (SELECT row_id, segment, i, tokens AS used, 0 AS batch FROM t WHERE i = 1
  UNION ALL SELECT t.row_id, t.segment, t.i, CASE WHEN r.used + t.tokens > 9500 THEN t.tokens ELSE r.used + t.tokens END, CASE WHEN r.used + t.tokens > 9500 THEN r.batch + 1 ELSE r.batch END FROM r JOIN t ON t.segment = r.segment AND t.i = r.i + 1)
SELECT row_id, segment, batch FROM r""")
def token_batches(spark, sf_dir):
    return embedding.token_batches(read_table(spark, sf_dir, "chunks"))


@query()
def embedded_texts(spark, sf_dir):
    return embedding.embed_texts(read_table(spark, sf_dir, "chunks"))


@query()
def stems(spark, sf_dir):
    tokens = read_table(spark, sf_dir, "documents").select(F.explode(words(F.col("text"))).alias("token")).distinct()
    return fulltext.stems(tokens)
