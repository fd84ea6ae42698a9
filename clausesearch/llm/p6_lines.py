"""Problem 6: lines repeated across the documents of one source.

Lines are compared in lower case with white space collapsed. Duplicate documents collapse first: rows of
one source whose texts are equal line by line are one document, cut into lines once, with the keys and
publication dates it stands under. Each line is then counted over the distinct documents: the keys and dates
of all documents that hold it, and its clusters, which are the documents whose texts are equal but for line
ends. With ``min_clusters`` or ``min_days`` a republished article is so not mistaken for boilerplate; with
``min_keys`` alone a document under several keys counts once for each of them, as the definition says.
Distinct counting is done in two steps with map-side aggregation, so a line that occurs in a third of all
rows is a handful of counters per task, never one group of rows.

Defined cases: blank lines and null texts have no lines; a null source or key takes no part; ties
do not arise; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausesearch.runtime import materialize

BLANKS = r"(?U)[\s\x1c-\x1f]+"
BLANKS_IN_LINE = r"(?U)[\s\x1c-\x1f&&[^\n]]+"


def normal_lines(text: Column) -> Column:
    """The text in lower case, each line without outer blanks and with inner runs of white space as one blank."""
    flat = F.regexp_replace(F.lower(text), BLANKS_IN_LINE, " ")
    return F.regexp_replace(F.regexp_replace(flat, " ?\n ?", "\n"), "^ | $", "")


#: The hashes of a document (its source and its text, line by line) and of a line of a source.
DOCUMENT, LINE = ["source", "d1", "d2"], ["source", "h1", "h2"]


def _rows(df: DataFrame, id_col: str, text_col: str, source: str, key: str, date: str | None) -> DataFrame:
    """id, source, key, day, d1, d2, cluster and the hashes of the lines (null for blank ones) of every row."""
    day = F.to_date(F.col(date)) if date else F.lit(None).cast("date")
    base = df.dropna(subset=[source, key, text_col]).select(F.col(id_col).alias("id"), F.col(source).alias("source"), F.col(key).alias("key"), day.alias("day"), normal_lines(F.col(text_col)).alias("t"))
    lines = F.transform(F.split("t", "\n"), lambda x: F.when(x != "", F.struct(F.xxhash64(x).alias("h1"), F.xxhash64(F.lit(1), x).alias("h2"))))
    cluster = F.xxhash64(F.trim(F.regexp_replace("t", r"[\n ]+", " ")))
    hashed = base.select("id", "source", "key", "day", F.xxhash64("t").alias("d1"), F.xxhash64(F.lit(1), "t").alias("d2"), cluster.alias("cluster"), lines.alias("lines"))
    return materialize(hashed, "p6-rows")


def _documents(rows: DataFrame) -> DataFrame:
    """DOCUMENT, cluster, h1, h2 and m (times it occurs) of each line of each distinct document."""
    once = rows.groupBy(*DOCUMENT).agg(F.first("cluster").alias("cluster"), F.first("lines").alias("lines"))
    each = once.select(*DOCUMENT, "cluster", F.explode(F.filter("lines", lambda x: x.isNotNull())).alias("l"))
    return each.groupBy(*DOCUMENT, "cluster", F.col("l.h1").alias("h1"), F.col("l.h2").alias("h2")).agg(F.count("*").alias("m"))


def _statistics(rows: DataFrame) -> DataFrame:
    places = rows.groupBy(*DOCUMENT, "key", "day").agg(F.count("*").alias("n"))
    return _documents(rows).join(places, DOCUMENT).groupBy(*LINE).agg(
        F.count_distinct("key").alias("n_keys"), F.count_distinct("cluster").alias("n_clusters"), F.count_distinct("day").alias("n_days"), F.sum(F.col("m") * F.col("n")).alias("n_lines")
    )


def repeated_lines(
    df: DataFrame, id_col: str = "row_id", text_col: str = "text", source: str = "agency", key: str = "norm_id", date: str | None = "loaded_at", min_keys: int = 4, min_clusters: int = 1, min_days: int = 1
) -> DataFrame:
    """(id, line_no) of every line that its source repeats.

    A line must stand under ``min_keys`` different keys of the source, in ``min_clusters`` distinct documents and
    on ``min_days`` publication dates.
    """
    rows = _rows(df, id_col, text_col, source, key, date)
    if min_clusters > 1 or min_days > 1:
        found = _statistics(rows).where((F.col("n_keys") >= min_keys) & (F.col("n_clusters") >= min_clusters) & (F.col("n_days") >= min_days)).select(LINE)
    else:
        keys = _documents(rows).join(rows.select(*DOCUMENT, "key").distinct(), DOCUMENT).select(*LINE, "key").distinct()
        found = keys.groupBy(*LINE).count().where(F.col("count") >= min_keys).select(*LINE)
    lines = rows.select("id", "source", F.posexplode("lines").alias("at", "l")).where("l IS NOT NULL")
    lines = lines.select("id", (F.col("at") + 1).cast("int").alias("line_no"), "source", "l.h1", "l.h2")
    return lines.join(found, LINE, "left_semi").select(F.col("id").alias(id_col), "line_no")


def line_statistics(df: DataFrame, id_col: str = "row_id", text_col: str = "text", source: str = "agency", key: str = "norm_id", date: str | None = "loaded_at") -> DataFrame:
    """Per source and line: keys, distinct document clusters, publication dates and occurrences."""
    return _statistics(_rows(df, id_col, text_col, source, key, date))


def remove_lines(df: DataFrame, marked: DataFrame, id_col: str = "row_id", text_col: str = "text") -> DataFrame:
    """(id, text) without the marked (id, line_no) lines; other lines stay in order, unbroken."""
    gone = marked.groupBy(id_col).agg(F.collect_set("line_no").alias("gone"))
    joined = df.select(id_col, text_col).join(gone, id_col, "left")
    kept = F.filter(F.split(F.col(text_col), "\n"), lambda x, i: ~F.array_contains(F.coalesce(F.col("gone"), F.array().cast("array<int>")), (i + 1).cast("int")))
    return joined.select(id_col, F.array_join(kept, "\n").alias(text_col))
