"""Contexts for an answering model, and whether its citations stand in them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausesearch.operators.golden import KEY

#: Fixed values of the format; the attributes of a block are fixed too, as a model gives them back.
NO_ARTICLE, NO_HITS = "sin artículo", "(no se recuperó ningún fragmento del corpus)"
ANSWER = "answerable boolean, answer string, citations array<struct<country:string,norm_id:string,article:string>>, confidence string"
SYSTEM = "Responda solo con los fragmentos dados y cite cada norma; si no alcanzan, diga que no puede responderse."


GROUP = 256  # queries whose contexts are put together; a text goes there once however many of them it is a hit of


def _block() -> Column:
    return F.format_string('<fragmento country="%s" norm_id="%s" article="%s">\n%s\n</fragmento>', F.col("country"), F.col("norm_id"), F.coalesce("article", F.lit(NO_ARTICLE)), F.coalesce("text", F.lit("")))


def grouped_contexts(hits: DataFrame, df: DataFrame, queries: DataFrame, id_col: str = "row_id") -> DataFrame:
    """The rows of queries (qid and others) with their context, as ``format_contexts`` makes it of the hits (qid, id, rank) in ``df``.

    Queries go into groups of about ``GROUP`` by a hash; a hit's text is joined and sent once for each group that it is a hit in.
    """
    groups = max(1, -(-queries.count() // GROUP))
    group = F.pmod(F.xxhash64("qid"), F.lit(groups)).alias("group")
    wanted = hits.select(group, "id", F.struct("qid", "rank").alias("hit")).groupBy("group", "id").agg(F.collect_list("hit").alias("for"))
    cited = df.select(F.col(id_col).alias("id"), "country", "norm_id", "article", "text")
    texts = wanted.join(cited, "id").select("group", "for", _block().alias("block"))
    rank = hits.schema["rank"].dataType
    own = queries.select(group, F.array(F.struct("qid", F.lit(0).cast(rank).alias("rank"))).alias("for"), F.struct(*queries.columns).alias("query"))
    # A number of partitions that is not changed later, so that a task makes the contexts of few groups.
    placed = texts.unionByName(own, allowMissingColumns=True).repartition(2 * groups, "group")
    each = placed.select("group", F.explode("for").alias("hit"), "block", "query").select("group", "hit.qid", "hit.rank", "block", "query")
    # The group is part of the key, so what is there by group stays where it is.
    made = each.groupBy("group", "qid").agg(F.array_sort(F.collect_list(F.when(F.col("block").isNotNull(), F.struct("rank", "block")))).alias("blocks"), F.collect_list("query").alias("queries"))
    context = F.when(F.size("blocks") == 0, F.lit(NO_HITS)).otherwise(F.array_join(F.transform("blocks", lambda x: x["block"]), "\n\n"))
    return made.select(context.alias("context"), F.explode("queries").alias("query")).select("query.*", "context")


def format_contexts(hits: DataFrame, queries: DataFrame | None = None) -> DataFrame:
    """qid, context: one tagged block per hit in rank order; queries (qid) without hits get a fixed text. Texts are not escaped."""
    made = hits.withColumn("block", _block()).groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "block"))), lambda x: x["block"]), "\n\n").alias("context"))
    if queries is None:
        return made
    return queries.select("qid").distinct().join(made, "qid", "left").select("qid", F.coalesce("context", F.lit(NO_HITS)).alias("context"))


def unsupported_citations(answers: DataFrame, hits: DataFrame) -> DataFrame:
    """qid and citation of answers (qid, citations) that are in none of the query's hits; null articles are equal."""
    cited = answers.select("qid", F.explode("citations").alias("c")).select("qid", *(F.col(f"c.{k}").alias(k) for k in KEY))
    seen = hits.select(F.col("qid").alias("_qid"), *(F.col(k).alias(f"_{k}") for k in KEY)).distinct()
    return cited.join(seen, [F.col("qid") == F.col("_qid"), *(F.col(k).eqNullSafe(F.col(f"_{k}")) for k in KEY)], "left_anti")


def messages(context: str, question: str) -> list[dict]:
    """System and user message for a model."""
    return [{"role": "system", "content": SYSTEM}, {"role": "user", "content": f"{context}\n\nPregunta: {question}"}]


def offline_answer(messages_: list[dict]) -> dict:
    """Stands in where no model is given: declines."""
    return {"answerable": False, "answer": "", "citations": [], "confidence": "baja"}


def answer_questions(questions: DataFrame, contexts: DataFrame, answerer: Callable[[list[dict]], dict] = offline_answer) -> DataFrame:
    """qid and answer of questions (qid, question) with their contexts; ``answerer`` runs in the tasks."""
    return answer_rows(questions.join(contexts, "qid"), answerer)


def answer_rows(rows: DataFrame, answerer: Callable[[list[dict]], dict] = offline_answer) -> DataFrame:
    """qid and answer of rows (qid, question, context)."""

    def run(batches):
        for batch in batches:
            out = batch[["qid"]].copy()
            answers = [answerer(messages(c, q)) for c, q in zip(batch["context"], batch["question"], strict=True)]
            for name in ("answerable", "answer", "citations", "confidence"):
                out[name] = [a[name] for a in answers]
            yield out

    return rows.mapInPandas(run, f"qid {rows.schema['qid'].dataType.simpleString()}, {ANSWER}")
