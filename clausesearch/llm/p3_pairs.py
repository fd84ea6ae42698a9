"""Problem 3: defective question-answer pairs, each with its kinds of defect.

Ordered rules as column expressions: empty answers and placeholders, refusals in several languages,
copies of the question, answers in another language (function words, or another script), and answers
that break off (unclosed delimiters, dangling separators and function words, abrupt endings). Every rule
that applies is emitted. What an abrupt ending is, is learnt from all answers: a last word breaks off where
its kind hardly ever closes a phrase, and a last sentence without a comma or colon breaks off where
complete sentences with its first word hardly ever lack one. An ending that the question has too is no
sign, and two noun phrases alone ("the importer and the authority") are a sound short answer.

Defined cases: a null, blank or wordless answer is ``empty``, and nothing else, as it has no sentence to break
off; a null question is never copied and has no language; repeated rows each get their rows; an empty table
gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausesearch.runtime import materialize

# What stands in for an answer.
PLACEHOLDERS = ["", "n a", "n d", "s d", "s r", "na", "nan", "nil", "none", "null", "undefined", "tbd", "todo", "pendiente", "pendente", "pending", "sin respuesta", "sem resposta", "no answer", "respuesta", "resposta", "answer", "xxx"]
LEADS = r"^((respuesta|resposta|answer|pregunta|pergunta|question) )+"
# How an answer declines, as words in lower case with one blank between.
REFUSALS = [
    # Spanish
    "no (puedo|podemos|podría) (responder|contestar|ayudar|atender|opinar|brindar|proporcionar|ofrecer)", "no estoy (en condiciones|autorizad[oa]|facultad[oa]|habilitad[oa]|capacitad[oa])",
    "no me (es posible|está permitido|corresponde)", "prefiero (no|abstenerme)", "(mis|nuestros) (lineamientos|políticas|normas|directrices) (me|nos) (impiden|prohíben)", "(excede|supera) lo que (estoy|tengo|puedo)",
    "debo (abstenerme|declinar|rechazar)", "carezco de (facultades|autorización|atribuciones)", "me abstengo de", "no tengo (permitido|permiso|autorización)", "como (asistente|modelo|sistema) (automático|virtual)",
    # Portuguese
    "não (posso|podemos|poderia) (responder|ajudar|atender|opinar|fornecer|comentar|tratar)", "não (tenho permissão|tenho autorização|estou autorizad[oa]|estou em condições|me é possível|me é permitido|me cabe)", "prefiro não", "(minhas|nossas) (diretrizes|políticas|normas) (me|nos) impedem",
    "(minhas|nossas) (diretrizes|políticas|normas) não permitem", "(excede|ultrapassa) o que (estou|posso|tenho)", "devo (me abster|abster)", "careço de", "como (assistente|modelo|sistema) (automático|virtual)",
    # English
    "i (cannot|can not|can t|could not|am unable to|am not able to|am not allowed to|am not permitted to|must decline|have to decline|must refrain|won t|will not)", "i would (rather|prefer) not", "i d rather not", "beyond what i (am|can|may)", "my guidelines (prevent|do not)",
    "i (m|am) not (authori[sz]ed|in a position|able|allowed|permitted)", "as an? (automated|ai|virtual) (assistant|model|system)",
]
# Function words that tell the three languages apart.
WORDS = {
    "es": "el los las del al y con en una un lo su sus según si cuando hasta dentro ante no qué que cuándo quién cómo sí es está o desde sobre días hábiles fijas".split(),
    "pt": "o os das dos do da ao aos à às e com em uma um não são sob no na nos nas pelo pela segundo se quando até mais que quem quais como sim é ou dias úteis sobre".split(),
    "en": "the of and for shall must with to is in by not whenever under within before may has have this that what who when does be are or an following above means working days fine".split(),
}
SHARED = sorted(set(WORDS["es"]) & set(WORDS["pt"]) | set(WORDS["es"]) & set(WORDS["en"]) | set(WORDS["pt"]) & set(WORDS["en"]))
# Words that cannot end a statement.
OPEN_ENDS = (
    "a al ante bajo con contra cuando de del desde durante e el en entre hacia hasta la las lo los mediante ni no o para pero por que se según si sin sobre su sus tras un una unas unos y cada "
    "ao aos às à as os da das do dos em na nas no nos com como num numa ou pelo pela pelos pelas sem sob até nem mas mais quando "
    "an and are at before by for from has have in is must nor of on or shall that the to under when whenever which with within above may not".split()
)
MARKS = ".,;:()[]{}«»“”\"'¿?¡!…–—-"
# Two noun phrases joined by a conjunction, each after an article.
ARTICLE = "(el|la|los|las|o|a|os|as|the)"
NOUNS = rf"(?!{ARTICLE} )\p{{L}}+"
COORDINATED = rf"^{ARTICLE} {NOUNS}( {NOUNS}){{0,3}} (y|e|and|ou|or) {ARTICLE} {NOUNS}( {NOUNS}){{0,3}}$"
SALT = 16  # parts of a word's statistics, as one kind of word may end a third of all answers
QUOTED = "\"[^\"]*\"|“[^”]*”|«[^»]*»"


def _refusal() -> str:
    """One pattern of all refusals that tries each first word once."""
    rest: dict[str, list[str]] = {}
    for pattern in REFUSALS:
        first, _, more = (pattern, "", "") if pattern.startswith("(") else pattern.partition(" ")
        rest.setdefault(first, []).append(more)
    return " (?:" + "|".join(f"{first} (?:{'|'.join(more)})" if more != [""] else first for first, more in rest.items()) + ") "


def _words(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}\p{N}]+)"), 1)


def _among(words: Column, listed: list[str]) -> Column:
    return F.size(F.filter(words, lambda w: w.isin(listed)))


def _scores(prefix: str, words: Column) -> dict[str, Column]:
    return {f"{prefix}_{k}": _among(words, sorted(set(v) - set(SHARED))) for k, v in WORDS.items()}


def _language(prefix: str) -> Column:
    """The language with the most telltale words, if it has twice as many as any other; else null."""
    score = {k: F.col(f"{prefix}_{k}") for k in WORDS}
    best = F.greatest(*score.values())
    rest = {k: F.greatest(*(s for o, s in score.items() if o != k)) for k in score}
    return reduce(lambda c, k: c.when((score[k] == best) & (best >= 2) & (best >= 2 * rest[k]), k), ["pt", "en"], F.when((score["es"] == best) & (best >= 2) & (best >= 2 * rest["es"]), "es"))


def _shape(token: Column) -> Column:
    """A token without outer marks: codes and numbers as patterns, names as one class, else lower case."""
    bare = F.translate(F.btrim(token, F.lit(MARKS)), "123456789", "000000000")
    first = F.substring(bare, 1, 1)
    return F.when(bare.contains("0"), F.regexp_replace(bare, r"\p{L}", "a")).when(first != F.lower(first), "Xx").otherwise(F.lower(bare))


def _clean(answer: str) -> Column:
    """The answer without tags, white space collapsed; null is an empty text."""
    a = F.regexp_replace(F.coalesce(F.col(answer), F.lit("")), r"<[^<>]{0,20}>", " ")
    return F.regexp_replace(F.regexp_replace(a, r"(?U)[\s\x1c-\x1f​﻿]+", " "), "^ | $", "")


def _sentences(a: Column) -> Column:
    return F.split(a, r"(?<=[.;]) ")


def _opener(sentence: Column) -> Column:
    return F.lower(F.substring_index(sentence, " ", 1))


def _salted(counts: DataFrame) -> DataFrame:
    return counts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))


def ending_shares(cleaned: DataFrame) -> DataFrame:
    """shape, share: how often a token of that shape closes a phrase, over all answers (a)."""
    tokens = cleaned.select(F.explode(F.split(F.translate("a", "123456789", "000000000"), " ")).alias("t")).groupBy("t").agg(F.count("*").alias("n"))
    closed = F.when(F.col("t").rlike(r"[.,;:)\]]$"), F.col("n")).otherwise(0)
    counted = tokens.select(_shape(F.col("t")).alias("shape"), "n", closed.alias("c")).groupBy("shape").agg(F.sum("n").alias("n"), F.sum("c").alias("c"))
    return counted.select("shape", (F.col("c") / F.col("n")).alias("share"))


def opener_shares(cleaned: DataFrame, least: int = 20) -> DataFrame:
    """opener, plain, over all answers (a): of the first words of at least ``least`` complete sentences, the share without comma and colon."""
    each = cleaned.select(F.explode(_sentences(F.col("a"))).alias("s")).where(F.col("s").rlike(r"[.;]$"))
    plain = F.count_if(~F.col("s").rlike("[,:]"))
    counted = each.groupBy(_opener(F.col("s")).alias("opener")).agg(F.count("*").alias("n"), plain.alias("p"))
    return counted.where(F.col("n") >= least).select("opener", (F.col("p") / F.col("n")).alias("plain"))


def defective_pairs(df: DataFrame, id_col: str = "pair_id", question: str = "question", answer: str = "expected_answer", least_share: float = 0.02) -> DataFrame:
    """(id, defect): every defect of every defective pair."""
    cleaned = materialize(df.select(F.col(id_col), F.coalesce(F.col(question), F.lit("")).alias("q"), _clean(answer).alias("a")), "p3-clean")
    base = cleaned.withColumns({"aw": _words(F.col("a")), "qw": _words(F.col("q"))})
    base = base.withColumns({"at": F.array_join("aw", " "), "qt": F.array_join("qw", " ")})
    unquoted = F.when(F.col("a").rlike('["“«]'), _words(F.regexp_replace("a", QUOTED, " "))).otherwise(F.col("aw"))
    base = base.withColumns({"told": F.regexp_replace("at", LEADS, ""), "end": F.substring_index("a", " ", -1)} | _scores("q", F.col("qw")) | _scores("a", unquoted))

    empty = F.col("at").isin(PLACEHOLDERS)
    refusal = ~empty & F.concat(F.lit(" "), "at", F.lit(" ")).rlike(_refusal())
    copy = ~empty & (F.length("qt") > 0) & (
        (F.trim(F.replace(F.col("told"), F.col("qt"), F.lit(""))) == "") | (F.startswith(F.col("qt"), F.col("told")) & (F.size("aw") >= 5) & (F.length("told") * 2 >= F.length("qt")))
    )
    mostly = lambda c: F.length(F.regexp_replace(c, r"[^\p{L}]|\p{IsLatin}", "")) * 2 > F.length(F.regexp_replace(c, r"[^\p{L}]", ""))
    foreign = F.when(F.col("a").rlike(r"[\p{L}&&[^\p{IsLatin}]]"), mostly("a") & ~mostly("q")).otherwise(F.lit(False))
    other = ~empty & (F.coalesce(_language("a") != _language("q"), F.lit(False)) | foreign)

    count = lambda mark: F.length("a") - F.length(F.replace(F.col("a"), F.lit(mark), F.lit("")))
    unclosed = (count("(") > count(")")) | (count("[") > count("]")) | (count("«") > count("»")) | (count("“") > count("”")) | (count('"') % 2 == 1)
    stopped = F.col("end").rlike(r"[.!?»”\"')\]]$") & ~F.col("end").rlike(r"(\.\.|…)$")
    dangling = F.col("end").rlike(r"(\.\.|…|[,;:/(\[«“–—-])$") | F.lower("end").rlike(r"\b(art|inc|arts|núm|pág)\.$") | F.col("a").rlike(r"[:;,]\s*[\p{L}\p{N}]{1,3}\)$")
    last = F.lower(F.regexp_replace("end", r"^[^\p{L}\p{N}]+", ""))
    long = F.size("aw") > 4
    asked = F.slice("aw", -2, 2) == F.slice("qw", -2, 2)
    asked = (F.size("aw") >= 2) & (F.size("qw") >= 2) & F.coalesce(asked, F.lit(False))
    open_end = ~stopped & (last.isin(OPEN_ENDS) & (F.size("aw") > 1) | long & last.rlike(r"^\d[\d.,]*$"))
    truncated = ~empty & (unclosed | dangling | open_end & ~asked)

    kinds = {"empty": empty, "refusal": refusal, "copy": copy, "other_language": other, "truncated": truncated}
    found = F.filter(F.array(*(F.when(c, F.lit(k)) for k, c in kinds.items())), lambda x: x.isNotNull())
    sentence = F.element_at(_sentences(F.col("a")), -1)
    doubtful = ~empty & ~asked & ~truncated & ~stopped & long & ~F.col("at").rlike(COORDINATED)
    rules = base.select(
        F.col(id_col).alias("id"), found.alias("found"), F.when(doubtful, _shape(F.col("end"))).alias("shape"), F.when(doubtful & ~sentence.rlike("[,:]"), _opener(sentence)).alias("opener"),
        F.pmod(F.xxhash64(F.col(id_col)), F.lit(SALT)).cast("int").alias("salt"),
    )
    rules = materialize(rules, "p3-rules")
    open_question = rules.where("shape IS NOT NULL").select("id", "shape", "opener", "salt").join(_salted(ending_shares(cleaned)), ["shape", "salt"], "left")
    open_question = open_question.select("id", "share", "opener", "salt").join(_salted(opener_shares(cleaned)), ["opener", "salt"], "left")
    abrupt = open_question.where((F.coalesce("share", F.lit(0.0)) < least_share) | (F.coalesce("plain", F.lit(1.0)) < least_share))
    every = rules.select("id", F.explode("found").alias("defect")).unionByName(abrupt.select("id", F.lit("truncated").alias("defect")))
    return every.select(F.col("id").alias(id_col), "defect")
