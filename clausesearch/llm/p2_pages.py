"""Problem 2: the main body of web pages, without what the site shows around it.

Lines are normalised (case, blanks, the page's own key and host masked, free-standing numbers masked, codes
kept) and cut into words and signs. Runs are found in three steps, from pages alone; rows that are no pages
are not looked at.

* Whole lines and parts of menus. For every host, in blocks of bounded size, the token streams of its pages
  are concatenated and a suffix array is built; its intervals whose common run covers a line, or a part of a
  line of at least three separated parts, are the repeated runs. Each block sends every run with the number
  of keys it stands under there. A key lies in one block (the parts of a key too large for a block are told
  apart by their key), so the numbers add up exactly, whatever the blocks. A run belongs to the site when it
  stands under ``least_keys`` keys, at least two of them of one host. A line of parts that all are such runs
  is covered, and a page's last line that breaks off counts as the known line of its host that it begins.
* Lists under a run. Entries of side boxes repeat only at their edges (up to ``FRAME_WORDS`` words, codes
  masked). An edge run is an entry's when nearly all of its lines (``CLOSED``) stand in unbroken lists under
  site lines that have lines with that edge directly below under ``least_keys`` keys each. A text's own
  lines also begin pages and follow each other.
* Lines of the footer, with the same edges, lie between site lines: nearly all are followed by one or end the
  page, at least half are followed by one and a quarter come after one; at least ``FOOTER_LINES`` such lines are needed.
  An edge run of either kind is kept as text when in more than a tenth of its pages nothing else would be left.

Unique runs and everything else stay. Defined cases: null and empty texts have no lines; blank lines are never
marked; a null host is a host of its own; a null key counts as a key of its own row; repeated rows are pages
of one key and give each other no support; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clausesearch.llm.p6_lines import BLANKS, remove_lines
from clausesearch.llm.p9_leaks import suffix_array
from clausesearch.runtime import materialize

BLOCK_CHARS = 4_000_000
CODE = r"(?<![\p{L}\p{N}])\p{L}{1,4}(-\d+)+(/\d+)?"
NUMBER = r"(?<![\p{L}\p{N}-])\d[\d.,/:-]*"
FRAME_WORDS = 3
MENU = r"\s*[|>»·/•]\s*|\s+[-–—]\s+|(?U)\s*\t\s*|(?U)\s{2,}"
LEAST_PARTS = 3
LEAST_WORDS = 3  # of a last line that breaks off
CLOSED, FOOTER_LINES = 0.99, 24


def _spaced(m: Column) -> Column:
    """The words and signs of a line with one blank between."""
    return F.trim(F.regexp_replace(F.regexp_replace(m, r"([^\p{L}\p{N}\s¤-])", " $1 "), r"(?U)\s+", " "))


def _lines(df: DataFrame, id_col: str, text_col: str, host: str, key: str) -> DataFrame:
    """id, host, key, line_no, last, m (words and signs), w (hash of m) and parts (hashes of a menu's parts) of every line that isn't blank."""
    cut = df.select(
        F.col(id_col).alias("id"), F.coalesce(F.lower(host), F.lit("")).alias("host"), F.coalesce(F.lower(key), F.concat(F.lit("#"), F.col(id_col).cast("string"))).alias("key"), F.split(text_col, "\n").alias("l")
    )
    each = cut.select("id", "host", "key", F.size("l").alias("n"), F.posexplode("l").alias("at", "line")).where(~F.col("line").rlike(r"(?U)^[\s\x1c-\x1f]*$"))
    low = F.lower("line")
    low = F.when(F.length("host") > 0, F.replace(low, F.col("host"), F.lit("¤h"))).otherwise(low)
    low = F.regexp_replace(F.replace(low, F.col("key"), F.lit("¤k")), NUMBER, "0")
    low = F.regexp_replace(low, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")
    parts = F.filter(F.split("low", MENU), lambda x: x != "")
    known = each.select("id", "host", "key", (F.col("at") + 1).alias("line_no"), (F.col("at") + 1 == F.col("n")).alias("last"), low.alias("low"))
    known = known.withColumns({"m": _spaced(F.regexp_replace("low", BLANKS, " ")), "parts": parts})
    hashed = F.when(F.size("parts") >= LEAST_PARTS, F.transform("parts", lambda x: F.struct(F.xxhash64(_spaced(x)).alias("w"), _spaced(x).alias("m"))))
    return known.select("id", "host", "key", "line_no", "last", "m", F.xxhash64("m").alias("w"), hashed.alias("parts"))


def _common_run(s: np.ndarray, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Length of the common run of the suffixes at a and b, up to ``most``."""
    out = np.zeros(len(a), np.int64)
    active = np.arange(len(a))
    for t in range(most):
        active = active[(a[active] + t < len(s)) & (b[active] + t < len(s))]
        active = active[s[a[active] + t] == s[b[active] + t]]
        if not len(active):
            break
        out[active] = t + 1
    return out


RUNS = T.StructType([T.StructField("host", T.StringType()), T.StructField("w", T.LongType()), T.StructField("keys", T.LongType()), T.StructField("part_of", T.StringType())])


def block_runs(table: pa.Table) -> pa.Table:
    """host, w, keys, part_of: every run that covers a line or a menu's part, with its number of keys, by the block's suffix array.

    ``part_of`` is the key of a block that holds but a part of one key.
    """
    host, large = table.column("host")[0].as_py(), table.column("large")[0].as_py()
    text, w = table.column("m").combine_chunks(), table.column("w").to_numpy()
    key = table.column("key").combine_chunks().dictionary_encode().indices.to_numpy()
    parts = table.column("parts").combine_chunks()
    inner = parts.flatten()
    of = np.repeat(np.arange(len(parts)), np.asarray(pc.fill_null(pc.list_value_length(parts), 0)))
    text = pa.concat_arrays([text, inner.field("m")])
    w, key = np.concatenate([w, inner.field("w").to_numpy()]), np.concatenate([key, key[of]]).astype(np.int64)
    lists = pc.split_pattern(text, " ")
    flat, offsets = lists.flatten().dictionary_encode(), lists.offsets.to_numpy().astype(np.int64)
    offsets = offsets - offsets[0]
    words, size = flat.indices.to_numpy().astype(np.int64) + 2, np.diff(offsets)
    # The stream: the words of each unit, then a mark.
    start = offsets[:-1] + np.arange(len(size))
    s = np.ones(len(words) + len(size), np.int64)
    s[np.repeat(start - offsets[:-1], size) + np.arange(len(words))] = words
    order = suffix_array(s, int(s.max()).bit_length())
    rank = np.empty(len(s), np.int64)
    rank[order] = np.arange(len(s))
    units = np.argsort(rank[start])  # beginnings of units in suffix order: equal units stand together
    common = _common_run(s, start[units[:-1]], start[units[1:]], int(size.max()) + 1)
    group = np.concatenate([[0], np.cumsum(common < size[units[1:]] + 1)])
    pairs = np.unique(group * (int(key.max()) + 1) + key[units]) // (int(key.max()) + 1)
    keys = np.bincount(pairs, minlength=group[-1] + 1)
    first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    n = len(first)
    return pa.table([pa.array([host] * n, pa.string()), pa.array(w[units[first]]), pa.array(keys.astype(np.int64)), pa.array([large] * n, pa.string())], names=RUNS.names)


def _broken_lines(web: DataFrame, known: DataFrame) -> DataFrame:
    """id and line_no of last lines whose words but the last begin a line of ``known`` (host, m) that is not shorter."""
    words = lambda lines: lines.withColumn("p", F.split("m", " ")).where(F.size("p") >= LEAST_WORDS)
    beginning = lambda n: F.xxhash64(F.array_join(F.slice("p", 1, n), " "))
    begun = words(known).select("host", F.explode(F.transform(F.sequence(F.lit(LEAST_WORDS - 1), F.size("p") - 1), beginning)).alias("f")).distinct()
    return words(web.where("last")).withColumn("f", beginning(F.size("p") - 1)).join(begun, ["host", "f"], "left_semi").select("id", "line_no")


def _blocked(web: DataFrame) -> DataFrame:
    """The lines with their host's block; ``large`` names the key that has the block to itself."""
    sizes = web.groupBy("host", "key").agg(F.sum(F.length("m")).alias("n"))
    large = sizes.where(F.col("n") > BLOCK_CHARS).select("host", "key", F.ceil(F.col("n") / BLOCK_CHARS).cast("int").alias("pieces"))
    hosts = sizes.where(F.col("n") <= BLOCK_CHARS).groupBy("host").agg(F.ceil(F.sum("n") / BLOCK_CHARS).cast("int").alias("blocks"))
    placed = web.join(hosts, "host", "left").join(large, ["host", "key"], "left")
    block = F.when(F.col("pieces").isNull(), F.pmod(F.xxhash64("key"), F.coalesce("blocks", F.lit(1)))).otherwise(F.pmod(F.xxhash64("id"), F.col("pieces")))
    return placed.select("host", "key", "m", "w", "parts", block.alias("block"), F.when(F.col("pieces").isNotNull(), F.col("key")).alias("large"))


def _edges(m: Column) -> Column:
    """Hashes of each beginning and ending of one to three words and signs, codes masked; a sign alone is none."""
    run = lambda n: F.substring_index(m, " ", n)
    edges = [F.xxhash64(F.lit(sign * k), run(sign * k)) for k in range(1, FRAME_WORDS + 1) for sign in (1, -1)]
    words = [F.when(run(sign).rlike(r"[\p{L}\p{N}¤]"), edge) for sign, edge in zip((1, -1), edges[:2], strict=True)]
    return F.array_compact(F.array(*words, *edges[2:]))


def _entries(lines: DataFrame, least_keys: int) -> DataFrame:
    """id, line_no of the lines that are not site runs as a whole (id, key, line_no, w, f, sure) but belong to boxes and footers."""
    page = Window.partitionBy("id").orderBy("line_no")
    before = page.rowsBetween(Window.unboundedPreceding, -1)
    placed = lines.withColumns({
        "head": F.last(F.when(F.col("sure"), F.col("w")), ignorenulls=True).over(before), "list": F.sum(F.col("sure").cast("int")).over(page),
        "below": F.coalesce(F.lag("sure").over(page), F.lit(False)), "above": F.lead("sure").over(page),
    })
    own = materialize(placed.where("NOT sure").select("id", "key", "line_no", "list", "head", "below", "above", F.array_distinct("f").alias("f")), "p2-own")
    edges = own.select("id", "key", "line_no", "list", "head", "below", "above", F.explode("f").alias("f"))
    heads = edges.where("below").select("head", "f", "key").distinct().groupBy("head", "f").count().where(F.col("count") >= least_keys).select("head", "f")
    under = materialize(edges.join(heads, ["head", "f"], "left_semi").select("id", "line_no", "f"), "p2-under")
    # A list breaks at the first line that has no such edge.
    listed = own.select("id", "line_no", "list").join(under.select("id", "line_no", F.lit(1).alias("ok")).distinct(), ["id", "line_no"], "left")
    whole = F.min(F.coalesce("ok", F.lit(0))).over(Window.partitionBy("id", "list").orderBy("line_no"))
    unbroken = listed.withColumn("whole", whole).where("whole = 1").select("id", "line_no")
    explained = under.join(unbroken, ["id", "line_no"], "left_semi")
    per_key = edges.groupBy("f", "key").agg(F.count("*").alias("n"), F.count_if("above").alias("above"), F.count_if(F.col("above").isNull()).alias("end"), F.count_if("below").alias("below"))
    total = per_key.groupBy("f").agg(F.count("*").alias("keys"), *(F.sum(c).alias(c) for c in ("n", "above", "end", "below"))).where(F.col("keys") >= least_keys)
    lists = explained.groupBy("f").agg(F.count("*").alias("e")).join(total, "f").where(F.col("e") >= CLOSED * F.col("n")).select("f")
    footer = (F.col("above") + F.col("end") >= CLOSED * F.col("n")) & (F.col("above") * 2 >= F.col("n")) & (F.col("below") * 4 >= F.col("n")) & (F.col("n") >= FOOTER_LINES)
    chosen = explained.join(lists, "f", "left_semi").unionByName(edges.join(total.where(footer).select("f"), "f", "left_semi").select("id", "line_no", "f"))
    chosen = materialize(chosen, "p2-chosen")
    # What would be left of each page, and so of the pages of each edge.
    marked = chosen.select("id", "line_no").distinct().groupBy("id").agg(F.count("*").alias("gone"))
    left = own.groupBy("id").agg(F.count("*").alias("all")).join(marked, "id").select("id", (F.col("all") > F.col("gone")).cast("int").alias("left"))
    sound = chosen.select("id", "f").distinct().join(left, "id").groupBy("f").agg(F.avg("left").alias("left")).where("left >= 0.9").select("f")
    return chosen.join(sound, "f", "left_semi").select("id", "line_no")


def page_lines(df: DataFrame, is_page, id_col: str = "row_id", text_col: str = "text", host: str = "agency", key: str = "norm_id", least_keys: int = 4) -> DataFrame:
    """(id, line_no) of every line of a page that belongs to the site and not to the text. Ids are whole numbers.

    ``is_page``: the condition that a row is a web page; other rows take no part.
    """
    condition = F.coalesce(F.expr(is_page) if isinstance(is_page, str) else is_page, F.lit(False))
    web = materialize(_lines(df.where(condition).withColumn(id_col, F.col(id_col).cast("long")), id_col, text_col, host, key), "p2-lines")

    runs = _blocked(web).groupBy("host", "block", "large").applyInArrow(lambda k, t: block_runs(t), RUNS)
    in_host = runs.groupBy("host", "w", "part_of").agg(F.when(F.col("part_of").isNull(), F.sum("keys")).otherwise(F.lit(1)).alias("keys")).groupBy("host", "w").agg(F.sum("keys").alias("keys"))
    known = in_host.groupBy("w").agg(F.sum("keys").alias("keys"), F.max("keys").alias("most")).where((F.col("keys") >= least_keys) & (F.col("most") >= 2))
    known = materialize(known.select("w"), "p2-runs")

    found = materialize(web.join(known, "w", "left_semi").select("id", "host", "line_no", "m"), "p2-whole")
    parts = web.where("parts IS NOT NULL").select("id", "line_no", F.size("parts").alias("n"), F.explode("parts.w").alias("w"))
    menus = parts.join(known, "w", "left_semi").groupBy("id", "line_no", "n").count().where("count = n").select("id", "line_no")
    broken = _broken_lines(web, found.select("host", "m").distinct())
    sure = materialize(found.select("id", "line_no").unionByName(menus).unionByName(broken).distinct(), "p2-sure")

    edges = _edges(_spaced(F.regexp_replace(F.regexp_replace("m", r" ?(/) ?", "$1"), CODE, "¤c")))
    lines = web.select("id", "key", "line_no", "w", edges.alias("f")).join(sure.withColumn("s", F.lit(True)), ["id", "line_no"], "left").withColumn("sure", F.col("s").isNotNull()).drop("s")
    every = sure.unionByName(_entries(lines, least_keys)).distinct()
    return every.select(F.col("id").cast(df.schema[id_col].dataType).alias(id_col), F.col("line_no").cast("int").alias("line_no"))


def main_text(df: DataFrame, is_page, id_col: str = "row_id", text_col: str = "text", **options) -> DataFrame:
    """(id, text) of every page without the site's lines, the text's own lines unbroken and in order."""
    condition = F.coalesce(F.expr(is_page) if isinstance(is_page, str) else is_page, F.lit(False))
    return remove_lines(df.where(condition), page_lines(df, condition, id_col, text_col, **options), id_col, text_col)
