"""Registered queries of this package, over whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import functions as F

from clausesearch.llm import p1_split, p2_pages, p3_pairs, p4_vectors, p5_near, p6_lines, p7_copies, p8_encode, p9_leaks, p10_spans
from clausesearch.runtime import read_table

QUERIES = {}
SQL = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


@query("SELECT row_id FROM chunks WHERE length(text) > 1200")
def p1_found(spark, sf_dir):
    pieces = p1_split.split_oversized(read_table(spark, sf_dir, "chunks"))
    return pieces.where("piece_no = 1").select("row_id")


@query()
def p1_pieces(spark, sf_dir):
    return p1_split.split_oversized(read_table(spark, sf_dir, "chunks"))


@query("SELECT row_id, text, true AS fits FROM chunks WHERE length(text) > 1200")
def p1_rebuilt(spark, sf_dir):
    """The texts put together again from their pieces, and whether these keep to the limit and the overlap."""
    pieces = p1_split.split_oversized(read_table(spark, sf_dir, "chunks"))
    rows = pieces.groupBy("row_id").agg(F.array_sort(F.collect_list(F.struct("start", "end", "piece"))).alias("p"))
    following = lambda i: F.coalesce(F.get("p", i + 1)["start"], F.get("p", i)["end"])
    text = F.array_join(F.transform("p", lambda x, i: F.substring(x["piece"], F.lit(1), following(i) - x["start"])), "")
    fits = F.forall("p", lambda x: (F.char_length(x["piece"]) <= 1200) & (F.char_length(x["piece"]) == x["end"] - x["start"])) & F.forall(F.sequence(F.lit(0), F.size("p") - 1), lambda i: (following(i) > F.get("p", i)["start"]) & (F.get("p", i)["end"] - following(i) <= 200))
    return rows.select("row_id", text.alias("text"), fits.alias("fits"))


LINES_SQL = r"""
WITH l AS (SELECT row_id, agency, norm_id, text, loaded_at, unnest(string_split(text, chr(10))) AS line,
             generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM chunks WHERE agency IS NOT NULL AND norm_id IS NOT NULL),
n AS (SELECT *, trim(regexp_replace(lower(line), '[\s\x{0085}\x{001c}-\x{001f}\pZ]+', ' ', 'g')) AS m FROM l)"""


@query(LINES_SQL + """, k AS (SELECT agency, m FROM n WHERE m <> '' GROUP BY agency, m HAVING count(DISTINCT norm_id) >= 4)
SELECT row_id, line_no::INT AS line_no FROM n JOIN k USING (agency, m)""")
def p6_found(spark, sf_dir):
    return p6_lines.repeated_lines(read_table(spark, sf_dir, "chunks"))


@query(LINES_SQL + r"""
SELECT agency AS source, n_keys, n_clusters, n_days, n_lines, count(*) AS n_distinct_lines FROM (
  SELECT agency, m, count(DISTINCT norm_id) AS n_keys,
    count(DISTINCT trim(regexp_replace(lower(text), '[\s\x{0085}\x{001c}-\x{001f}\pZ]+', ' ', 'g'))) AS n_clusters,
    count(DISTINCT (loaded_at AT TIME ZONE 'UTC')::DATE) AS n_days, count(*) AS n_lines FROM n WHERE m <> '' GROUP BY agency, m) GROUP BY ALL""")
def p6_line_statistics(spark, sf_dir):
    stats = p6_lines.line_statistics(read_table(spark, sf_dir, "chunks"))
    return stats.groupBy("source", "n_keys", "n_clusters", "n_days", "n_lines").agg(F.count("*").alias("n_distinct_lines"))


@query(LINES_SQL + """, k AS (SELECT agency, m FROM n WHERE m <> '' GROUP BY agency, m HAVING count(DISTINCT norm_id) >= 4),
g AS (SELECT n.row_id, string_agg(line, chr(10) ORDER BY line_no) FILTER (WHERE k.m IS NULL) AS text FROM n LEFT JOIN k ON n.agency = k.agency AND n.m = k.m GROUP BY n.row_id)
SELECT row_id, coalesce(text, '') AS text FROM g""")
def p6_cleaned(spark, sf_dir):
    chunks = read_table(spark, sf_dir, "chunks")
    return p6_lines.remove_lines(chunks, p6_lines.repeated_lines(chunks))


@query(LINES_SQL + r""", k AS (SELECT agency, m FROM n WHERE m <> '' GROUP BY agency, m HAVING
  count(DISTINCT trim(regexp_replace(lower(text), '[\s\x{0085}\x{001c}-\x{001f}\pZ]+', ' ', 'g'))) >= 4 AND count(DISTINCT (loaded_at AT TIME ZONE 'UTC')::DATE) >= 2)
SELECT row_id, line_no::INT AS line_no FROM n JOIN k USING (agency, m)""")
def p6_boilerplate(spark, sf_dir):
    """By distinct documents and dates, whatever their keys."""
    return p6_lines.repeated_lines(read_table(spark, sf_dir, "chunks"), min_keys=1, min_clusters=4, min_days=2)


WORDS_SQL = r"WITH w AS (SELECT row_id, norm_id, list_sort(regexp_extract_all(lower(text), '[\pL\pN]+')) AS w FROM chunks WHERE norm_id IS NOT NULL)"


@query(WORDS_SQL + " SELECT r AS row_id_a, row_id AS row_id_b FROM (SELECT row_id, min(row_id) OVER (PARTITION BY norm_id, w) AS r FROM w) WHERE r <> row_id")
def p7_found(spark, sf_dir):
    members = p7_copies.copy_members(read_table(spark, sf_dir, "chunks"), "row_id", ["norm_id"], ["text"])
    return members.select(F.col("rep").alias("row_id_a"), F.col("member").alias("row_id_b"))


@query(WORDS_SQL + " SELECT norm_id, min(row_id) AS row_id, count(*) AS n_copies FROM w GROUP BY norm_id, w")
def p7_distinct(spark, sf_dir):
    return p7_copies.collapse_copies(read_table(spark, sf_dir, "chunks"), "row_id", ["norm_id"], ["text"])


@query()
def p3_found(spark, sf_dir):
    return p3_pairs.defective_pairs(read_table(spark, sf_dir, "golden_questions"))


@query()
def p8_ids(spark, sf_dir):
    return p8_encode.encode(read_table(spark, sf_dir, "documents"))


@query("SELECT doc_id, coalesce(text, '') AS text FROM documents")
def p8_decoded(spark, sf_dir):
    return p8_encode.decode(p8_encode.encode(read_table(spark, sf_dir, "documents")))


@query(r"""WITH d AS (SELECT doc_id, regexp_extract_all(lower(strip_accents(text)), '[\pL\pN]+') AS w FROM documents), e AS (SELECT item_id, regexp_extract_all(lower(strip_accents(text)), '[\pL\pN]+') AS w FROM eval_items),
x AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 11], ' ') AS g FROM d, unnest(range(1, len(w) - 10)) AS u(i)), y AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 11], ' ') AS g FROM e, unnest(range(1, len(w) - 10)) AS u(i))
SELECT DISTINCT doc_id, item_id FROM x JOIN y USING (g)""")
def p9_found(spark, sf_dir):
    return p9_leaks.contained_items(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "eval_items"))


@query(r"""WITH d AS (SELECT doc_id, regexp_extract_all(lower(strip_accents(text)), '[\pL\pN]+') AS w FROM documents), e AS (SELECT item_id, regexp_extract_all(lower(strip_accents(text)), '[\pL\pN]+') AS w FROM eval_items),
x AS (SELECT doc_id, i - 1 AS word, array_to_string(w[i:i + 11], ' ') AS g FROM d, unnest(range(1, len(w) - 10)) AS u(i)), y AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 11], ' ') AS g FROM e, unnest(range(1, len(w) - 10)) AS u(i)),
m AS (SELECT doc_id, item_id, word, coalesce(word > lag(word) OVER (PARTITION BY doc_id, item_id ORDER BY word) + 12, true)::INT AS new FROM x JOIN y USING (g)),
k AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, item_id ORDER BY word) AS k FROM m)
SELECT doc_id, item_id, min(word)::INT AS first_word, (max(word) + 11)::INT AS last_word FROM k GROUP BY doc_id, item_id, k""")
def p9_spans(spark, sf_dir):
    return p9_leaks.leaked_spans(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "eval_items"))


@query()
def p9_cleaned(spark, sf_dir):
    return p9_leaks.remove_leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "eval_items"))


WINDOWS_SQL = """WITH g AS (SELECT doc_id, i AS pos, md5(substr(text, i, 240)) AS g FROM documents, unnest(range(1, length(text) - 238)) AS u(i)),
s AS (SELECT g FROM g GROUP BY g HAVING count(DISTINCT doc_id) > 1), m AS (SELECT doc_id, pos, g FROM g SEMI JOIN s USING (g))"""


@query(WINDOWS_SQL + " SELECT DISTINCT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM m a JOIN m b ON a.g = b.g AND a.doc_id < b.doc_id")
def p10_found(spark, sf_dir):
    pairs = p10_spans.sharing_pairs(read_table(spark, sf_dir, "documents"))
    return pairs.select(F.col("a").alias("doc_id_a"), F.col("b").alias("doc_id_b"))


@query(WINDOWS_SQL + """, c AS (SELECT doc_id, pos, coalesce(pos > lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) + 240, true)::INT AS new FROM m), k AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY pos) AS k FROM c)
SELECT doc_id, (min(pos) - 1)::INT AS start, (max(pos) + 239)::INT AS "end" FROM k GROUP BY doc_id, k""")
def p10_spans_shared(spark, sf_dir):
    return p10_spans.shared_spans(read_table(spark, sf_dir, "documents"))


@query(WINDOWS_SQL + """, c AS (SELECT doc_id, sum(least(240, coalesce(next - pos, 240)))::BIGINT AS n FROM (SELECT doc_id, pos, lead(pos) OVER (PARTITION BY doc_id ORDER BY pos) AS next FROM m) GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS shared_chars FROM documents LEFT JOIN c USING (doc_id)""")
def p10_amounts(spark, sf_dir):
    return p10_spans.shared_amounts(read_table(spark, sf_dir, "documents"))


@query(r"""WITH w AS (SELECT row_id, regexp_extract_all(lower(text), '[\pL\pN]+') AS w FROM chunks),
g AS (SELECT DISTINCT row_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM w, unnest(range(1, len(w) - 1)) AS u(i)),
n AS (SELECT row_id, count(*) AS n FROM g GROUP BY row_id), p AS (SELECT a.row_id AS a, b.row_id AS b, count(*) AS k FROM g a JOIN g b ON a.g = b.g AND a.row_id < b.row_id GROUP BY ALL)
SELECT a AS row_id_a, b AS row_id_b FROM p JOIN n x ON x.row_id = a JOIN n y ON y.row_id = b JOIN w s ON s.row_id = a JOIN w t ON t.row_id = b
WHERE k * 5 >= (x.n + y.n - k) * 3 AND list_sort(s.w) <> list_sort(t.w)""")
def p5_found(spark, sf_dir):
    pairs = p5_near.near_pairs(read_table(spark, sf_dir, "chunks"), width=3, threshold=(3, 5))
    return pairs.select(F.col("a").alias("row_id_a"), F.col("b").alias("row_id_b"))


@query(r"""WITH RECURSIVE w AS (SELECT row_id, w, min(row_id) OVER (PARTITION BY w) AS rep FROM (SELECT row_id, regexp_extract_all(lower(text), '[\pL\pN]+') AS w FROM chunks) WHERE len(w) >= 5),
g AS (SELECT DISTINCT rep, array_to_string(w[i:i + 4], ' ') AS g FROM w, unnest(range(1, len(w) - 3)) AS u(i) WHERE row_id = rep),
n AS (SELECT rep, count(*) AS n FROM g GROUP BY rep), k AS (SELECT a.rep AS a, b.rep AS b, count(*) AS k FROM g a JOIN g b ON a.g = b.g AND a.rep <> b.rep GROUP BY ALL),
p AS (SELECT a, b FROM k JOIN n x ON x.rep = a JOIN n y ON y.rep = b WHERE k * 5 >= (x.n + y.n - k) * 4),
r AS (SELECT a, b FROM p UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a),
o AS (SELECT a AS rep, least(a, min(b)) AS root FROM r GROUP BY a), l AS (SELECT a AS rep, count(*) AS n_links FROM p GROUP BY a)
SELECT c.row_id, coalesce(o.root, w.rep, c.row_id) AS "group", coalesce(l.n_links, 0) AS n_links FROM chunks c LEFT JOIN w ON w.row_id = c.row_id LEFT JOIN o ON o.rep = w.rep LEFT JOIN l ON l.rep = w.rep""")
def p5_groups(spark, sf_dir):
    return p5_near.near_groups(read_table(spark, sf_dir, "chunks"))


@query()
def p4_found(spark, sf_dir):
    pairs = p4_vectors.neighbour_pairs(read_table(spark, sf_dir, "chunks"))
    return pairs.select(F.col("a").alias("row_id_a"), F.col("b").alias("row_id_b"))


@query()
def p4_neighbours(spark, sf_dir):
    return p4_vectors.neighbours(read_table(spark, sf_dir, "chunks"))


PAGES = "variant IN ('portal', 'web', 'html')"


@query()
def p2_found(spark, sf_dir):
    return p2_pages.page_lines(read_table(spark, sf_dir, "chunks"), PAGES)


@query()
def p2_main_text(spark, sf_dir):
    return p2_pages.main_text(read_table(spark, sf_dir, "chunks"), PAGES)
