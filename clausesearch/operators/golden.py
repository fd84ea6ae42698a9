"""Question sets: validation, counts, and citations against the corpus."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clausesearch.functions.text import strip

KINDS, STATUSES = ("factual", "synthesis", "trap"), ("draft", "reviewed")
ENTRY = "id string, question string, kind string, answerable boolean, expected_answer string, citations array<struct<country:string,norm_id:string,article:string>>, status string, notes string"
KEY = ("country", "norm_id", "article")


def load(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a JSON file {"questions": [...]}; status defaults to draft, notes to an empty text."""
    entries = spark.read.option("multiLine", True).schema(f"questions array<struct<{ENTRY.replace(' ', ':').replace(',:', ',')}>>").json(path)
    return entries.select(F.explode("questions").alias("q")).select("q.*").withColumns({"status": F.coalesce("status", F.lit("draft")), "notes": F.coalesce("notes", F.lit(""))})


def save(entries: DataFrame, path: str) -> None:
    """Writes a set for editing by hand, a file of bounded size: parents are made, indent 2, newline at the end."""
    where = Path(path)
    where.parent.mkdir(parents=True, exist_ok=True)
    rows = [r.asDict(recursive=True) for r in entries.toLocalIterator()]
    where.write_text(json.dumps({"questions": rows}, ensure_ascii=False, indent=2) + "\n", encoding="utf-8")


def _blank(c: Column) -> Column:
    return c.isNull() | (strip(c) == "")


def violations(df: DataFrame) -> DataFrame:
    """All columns, and violations: the names of the rules that an entry breaks, in fixed order."""
    n, able = F.coalesce(F.size("citations"), F.lit(0)), F.coalesce("answerable", F.lit(False))
    n = F.greatest(n, F.lit(0))
    rules = {
        "blank_question": _blank(F.col("question")), "blank_answer": _blank(F.col("expected_answer")),
        "unknown_kind": ~F.coalesce(F.col("kind").isin(*KINDS), F.lit(False)), "unknown_status": ~F.coalesce(F.col("status").isin(*STATUSES), F.lit(False)),
        "answerable_trap": F.coalesce((F.col("kind") == "trap"), F.lit(False)) & able, "uncited": able & (n == 0), "cited_unanswerable": ~able & (n > 0),
    }
    return df.withColumn("violations", F.filter(F.array(*(F.when(c, F.lit(r)) for r, c in rules.items())), lambda x: x.isNotNull()))


def validate(df: DataFrame) -> DataFrame:
    """The entries, unless one breaks a rule or an id is repeated: then ValueError names the first few."""
    bad = violations(df).where(F.size("violations") > 0).select("id", "violations").limit(5).collect()
    again = duplicate_ids(df).limit(5).collect()
    if bad or again:
        raise ValueError(f"invalid entries: {[(r.id, r.violations) for r in bad]}; repeated ids: {[r.id for r in again]}")
    return df


def duplicate_ids(df: DataFrame) -> DataFrame:
    """id, n of ids that occur more than once."""
    return df.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").orderBy("id")


def counts(df: DataFrame) -> DataFrame:
    """kind, total, reviewed."""
    return df.groupBy("kind").agg(F.count("*").alias("total"), F.count_if(F.col("status") == "reviewed").alias("reviewed"))


def reviewed(df: DataFrame) -> DataFrame:
    return df.where(F.col("status") == "reviewed")


def drafts(df: DataFrame, kind: str | None = None) -> DataFrame:
    found = df.where(F.col("status") == "draft")
    return found if kind is None else found.where(F.col("kind") == kind)


def next_numbers(df: DataFrame, separator: str = "-") -> DataFrame:
    """prefix, next_number: the greatest numeric suffix of each id prefix plus one."""
    parts = df.select(F.regexp_extract("id", rf"^(.*){separator}(\d+)$", 1).alias("prefix"), F.regexp_extract("id", rf"^(.*){separator}(\d+)$", 2).alias("number")).where("number <> ''")
    return parts.groupBy("prefix").agg((F.max(F.col("number").cast("long")) + 1).alias("next_number"))


def next_id(df: DataFrame, prefix: str) -> int:
    """The next number for a prefix, 1 if it has none."""
    row = next_numbers(df).where(F.col("prefix") == prefix).first()
    return row.next_number if row else 1


def citations(df: DataFrame, *keep: str) -> DataFrame:
    """One row per citation, duplicates kept, with its place."""
    return df.select(*keep, F.posexplode("citations").alias("place", "c")).select(*keep, "place", *(F.col(f"c.{k}") for k in KEY))


def absent(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of left whose (country, norm_id, article) is not in right; a null article equals a null article. Keeps duplicates."""
    r = right.select(*(F.col(k).alias(f"_{k}") for k in KEY)).distinct()
    condition = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in KEY]
    return left.join(r, condition, "left_anti")


def unknown_citations(golden: DataFrame, corpus: DataFrame, *keep: str) -> DataFrame:
    """Citations of the entries that no chunk has."""
    return absent(citations(golden, *keep), corpus)


def status_report(golden: DataFrame, corpus: DataFrame) -> DataFrame:
    """One row: entries, reviewed entries, citations, unknown citations, and exit_code (1 if any is unknown)."""
    totals = golden.agg(F.count("*").alias("entries"), F.count_if(F.col("status") == "reviewed").alias("reviewed"), F.coalesce(F.sum(F.greatest(F.size("citations"), F.lit(0))), F.lit(0)).alias("citations"))
    unknown = unknown_citations(golden, corpus, "id").agg(F.count("*").alias("unknown"))
    return totals.crossJoin(unknown).withColumn("exit_code", (F.col("unknown") > 0).cast("int"))  # one row by one row


def cited_texts(golden: DataFrame, corpus: DataFrame, *keep: str, most: int = 3, order: tuple[str, ...] = ("idx", "row_id"), missing: str = "(no text)") -> DataFrame:
    """kept columns, place and body of each citation: its first chunks in order, joined by blank lines, or a placeholder."""
    from pyspark.sql import Window

    cited = citations(golden, *keep)
    wanted = cited.select(*KEY).distinct()
    named = corpus.select(*(F.col(k).alias(f"_{k}") for k in KEY), *order, "text")
    found = wanted.join(named, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in KEY])
    place = F.row_number().over(Window.partitionBy(*KEY).orderBy(*order))
    body = found.withColumn("r", place).where(F.col("r") <= most).groupBy(*KEY).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "text"))), lambda x: x["text"]), "\n\n").alias("body"))
    named = body.select(*(F.col(k).alias(f"_{k}") for k in KEY), "body")
    joined = cited.join(named, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in KEY], "left")
    return joined.select(*keep, "place", *KEY, F.coalesce("body", F.lit(missing)).alias("body"))
