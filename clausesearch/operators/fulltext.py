"""Full-text match and rank for a table of queries: an inverted index, exact term positions, ts_rank weights.

A token is a run of letters and digits in lower case. Configuration ``simple`` keeps every token;
``spanish`` drops stop words and stems (distinct words only, then joined back).
"""

from __future__ import annotations

import re
from functools import reduce
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clausesearch.functions.stem_es import stem
from clausesearch.functions.text import words
from clausesearch.runtime import materialize

MOST_POSITIONS, LAST_POSITION = 256, 16383
WEIGHT = 0.1
ZETA2 = 1.64493406685  # fixed value: the limit of the sum of 1/j^2
# Spanish function words that a query need not contain.
STOP_WORDS = (
    "a al algo algunas algunos ante antes como con contra cual cuando de del desde donde durante e el ella ellas ellos en entre era eran es esa esas ese eso esos esta están estas este esto estos fue fueron ha haber había han has hasta hay "
    "la las le les lo los más me mi mis mucho muchos muy nada ni no nos nosotros o os otra otras otro otros para pero poco por porque que qué quien quienes se sea sean ser si sí sido sin sobre son su sus también tanto te tiene tienen todo todos "
    "tu tus un una uno unos unas y ya yo"
).split()


def stems(vocabulary: DataFrame) -> DataFrame:
    """token, lexeme of a table of distinct tokens (token), by the Spanish stemmer."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("token"), pa.array([stem(t) for t in batch.column("token").to_pylist()], pa.string())], names=["token", "lexeme"])

    return vocabulary.select("token").mapInArrow(run, "token string, lexeme string")


def postings(df: DataFrame, id_col: str = "row_id", text_col: str = "text", config: str = "simple", only: DataFrame | None = None) -> DataFrame:
    """lexeme, id and positions (from 1, stop words counted) of every text; at most 256 positions a lexeme.

    ``only`` (lexeme) keeps the lexemes that are asked for, before anything is grouped.
    """
    tokens = df.select(F.col(id_col).alias("id"), F.posexplode(words(F.col(text_col))).alias("at", "token"))
    tokens = tokens.withColumn("at", F.least(F.col("at") + 1, F.lit(LAST_POSITION)))
    tokens = _lexemes(tokens, config)
    if only is not None:
        tokens = tokens.join(only, "lexeme", "left_semi")
    listed = tokens.groupBy("id", "lexeme").agg(F.array_sort(F.collect_set("at")).alias("positions"))
    return listed.select("lexeme", "id", F.slice("positions", 1, MOST_POSITIONS).alias("positions"))


def _lexemes(tokens: DataFrame, config: str) -> DataFrame:
    if config == "simple":
        return tokens.withColumnRenamed("token", "lexeme")
    if config != "spanish":
        raise ValueError(f"unknown configuration: {config}")
    tokens = tokens.where(~F.col("token").isin(STOP_WORDS))
    return tokens.join(stems(tokens.select("token").distinct()), "token").drop("token")


def query_lexemes(queries: DataFrame, config: str = "simple") -> DataFrame:
    """qid, lexeme (distinct) of queries (qid, qtext); a blank query has none and so finds nothing."""
    tokens = queries.select("qid", F.explode(F.array_distinct(words(F.col("qtext")))).alias("token"))
    return _lexemes(tokens, config).distinct()


def lexical_match(postings_: DataFrame, lexemes: DataFrame, mode: str = "and") -> DataFrame:
    """qid, id and hits (lexeme, positions) of every text that has all (or, for ``or``, any) of a query's lexemes.

    The join starts from each query's rarest lexeme, so a query pays for the rows of that lexeme and
    not for those of its common words.
    """
    wanted = lexemes.groupBy("qid").agg(F.count("*").alias("n_lexemes"))
    if mode == "or":
        found = postings_.join(lexemes, "lexeme")
    else:
        frequency = postings_.join(lexemes.select("lexeme").distinct(), "lexeme", "left_semi").groupBy("lexeme").agg(F.count("*").alias("df"))
        ranked = lexemes.join(frequency, "lexeme", "left").withColumn("df", F.coalesce("df", F.lit(0)))
        rarest = ranked.groupBy("qid").agg(F.min_by("lexeme", F.struct("df", "lexeme")).alias("lexeme"))
        candidates = postings_.join(rarest, "lexeme").select("qid", "id")
        found = candidates.join(lexemes, "qid").join(postings_, ["lexeme", "id"])
    hits = found.groupBy("qid", "id").agg(F.array_sort(F.collect_list(F.struct("lexeme", "positions"))).alias("hits"))
    joined = hits.join(wanted, "qid")
    return joined if mode == "or" else joined.where(F.size("hits") == F.col("n_lexemes"))


def top_k(scored: DataFrame, k: int = 10) -> DataFrame:
    """qid, id, score, rank: the k best of each query; ties fall to the smaller id."""
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("qid", "id", "score", "rank")


FEW_LEXEMES = 1_000  # so many are looked up in stored postings by a filter of the scan


def _stored_postings(stored: DataFrame, lexemes: DataFrame, ids: DataFrame | None) -> DataFrame:
    """The stored postings (lexeme, id, positions) of the lexemes that are asked for, of the given rows."""
    few = [r.lexeme for r in lexemes.limit(FEW_LEXEMES + 1).collect()]
    listed = stored.where(F.col("lexeme").isin(few)) if len(few) <= FEW_LEXEMES else stored.join(lexemes, "lexeme", "left_semi")
    return listed if ids is None else listed.join(ids, "id", "left_semi")


BLOCK = 32_768  # texts that are searched together
MOST_GROUPS = 64  # groups of blocks; each gives its k best of every query
HITS, HELD = 1 << 20, 1 << 23  # hits that are merged at once, and that a task holds for one part of the queries
FREQUENT = 32  # a lexeme of more than one text in so many is frequent
SPAN, TEXTS = 15, 26  # bits of a position and of a text's place in its block, in one number after the lexeme
SQUARES = np.cumsum(1.0 / np.arange(1, MOST_POSITIONS + 1, dtype=np.float64) ** 2)


def near_best(own: np.ndarray, k: int, slack: float) -> np.ndarray:
    """Places of every value that may be among the k best: none that is less than the k-th best by ``slack`` or less is left out."""
    width = min(64, len(own) // max(1, 2 * k))
    if width < 2:
        return np.arange(len(own))
    # The k-th best of the best of each group is no more than the k-th best of all.
    groups = len(own) // width
    tops = own[: groups * width].reshape(groups, width).max(axis=1)
    return np.flatnonzero(own >= np.partition(tops, groups - k)[groups - k] - slack)


class _Block:
    """Inverted index of one block's texts for the lexemes that are asked for: (lexeme, text, position) as sorted numbers."""

    def __init__(self, ids: pa.Array, row: np.ndarray, word: pa.Array, at: np.ndarray, lexemes: list[str], fold) -> None:
        unique = ids.unique()
        self.ids = unique.take(pc.sort_indices(unique, null_placement="at_start"))
        place = pc.index_in(ids, self.ids).to_numpy().astype(np.int64)
        self.number = {x: i for i, x in enumerate(lexemes)}
        coded = word.dictionary_encode()
        known = np.array([self.number.get(fold(w), -1) for w in coded.dictionary.to_pylist()] + [-1], np.int64)
        lexeme = known[coded.indices.to_numpy(zero_copy_only=False)]
        held = np.flatnonzero(lexeme >= 0)
        key = np.unique((lexeme[held] << (SPAN + TEXTS)) | (place[row[held]] << SPAN) | np.minimum(at[held], LAST_POSITION))
        one = key >> SPAN
        first = np.flatnonzero(np.append(True, one[1:] != one[:-1])) if len(key) else np.zeros(0, np.int64)
        within = np.arange(len(key)) - np.repeat(first, np.diff(np.append(first, len(key))))
        key = key[within < MOST_POSITIONS]
        one = key >> SPAN
        self.first = np.flatnonzero(np.append(True, one[1:] != one[:-1])) if len(key) else np.zeros(0, np.int64)
        self.count = np.diff(np.append(self.first, len(key)))
        self.at, self.key = (key & ((1 << SPAN) - 1)).astype(np.int32), key & ((1 << (SPAN + TEXTS)) - 1)
        self.text = (one[self.first] & ((1 << TEXTS) - 1)) if len(key) else np.zeros(0, np.int64)
        self.part = WEIGHT * SQUARES[self.count - 1] / ZETA2
        self.cut = np.searchsorted(one[self.first] >> TEXTS if len(key) else one, np.arange(len(lexemes) + 1))
        self.dense: dict[int, np.ndarray] = {}

    def postings(self, lexeme: int) -> slice:
        return slice(self.cut[lexeme], self.cut[lexeme + 1])

    def _row(self, lexeme: int) -> np.ndarray | None:
        """A frequent lexeme's part of the score of every text."""
        if (found := self.dense.get(lexeme)) is None and (self.cut[lexeme + 1] - self.cut[lexeme]) * 8 >= len(self.ids):
            found = self.dense[lexeme] = np.zeros(len(self.ids))
            own = self.postings(lexeme)
            found[self.text[own]] = self.part[own]
        return found

    def find(self, lexeme: int, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each text has the lexeme, and the place of its posting."""
        own = self.postings(lexeme)
        listed = self.text[own]
        if not len(listed):
            return np.zeros(len(texts), bool), np.zeros(len(texts), np.int64)
        where = np.minimum(np.searchsorted(listed, texts), len(listed) - 1)
        return listed[where] == texts, where + own.start

    def having(self, lexemes: list[int], texts: np.ndarray | None = None) -> np.ndarray:
        """Texts (of those given) that have all of the lexemes, from the rarest on."""
        for lexeme in sorted(lexemes, key=lambda x: self.cut[x + 1] - self.cut[x]):
            texts = self.text[self.postings(lexeme)] if texts is None else texts[self.find(lexeme, texts)[0]]
            if not len(texts):
                break
        return texts

    def any_of(self, lexemes: list[int]) -> np.ndarray:
        return np.unique(np.concatenate([self.text[self.postings(x)] for x in lexemes]))

    def phrase(self, lexemes: list[int], texts: np.ndarray) -> np.ndarray:
        """Texts of those given that have the lexemes one after another."""
        texts = self.having(lexemes, texts)
        if len(lexemes) < 2 or not len(texts):
            return texts
        _, where = self.find(lexemes[0], texts)
        n = self.count[where]
        start = self.key[np.repeat(self.first[where] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        for i, lexeme in enumerate(lexemes[1:], 1):
            own = self.postings(lexeme)
            low, high = self.first[own.start], self.first[own.stop - 1] + self.count[own.stop - 1]
            listed = self.key[low:high]
            start = start[listed[np.minimum(np.searchsorted(listed, start + i), len(listed) - 1)] == start + i]
        return np.unique(start >> SPAN)

    def mean(self, lexemes: list[int], n: int, texts: np.ndarray) -> np.ndarray:
        total = np.zeros(len(texts))
        for lexeme in lexemes:
            has, where = self.find(lexeme, texts)
            total[has] += self.part[where[has]]
        return total / n

    def nearness(self, lexemes: list[int], texts: np.ndarray) -> np.ndarray:
        """By the distances of all pairs of occurrences of two lexemes; every text has all of them."""
        places = [self.find(x, texts)[1] for x in lexemes]
        total = np.zeros(len(texts))
        for i, a in enumerate(places):
            for b in places[i + 1 :]:
                n = self.count[a] * self.count[b]
                row = np.repeat(np.arange(len(texts)), n)
                inner = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                x, y = self.at[self.first[a][row] + inner // self.count[b][row]], self.at[self.first[b][row] + inner % self.count[b][row]]
                d = np.abs(x - y).astype(np.float64)
                w = np.where(d > 100, np.sqrt(WEIGHT * WEIGHT * 1e-30), np.sqrt(WEIGHT * WEIGHT / (1.005 + 0.05 * np.exp(np.minimum(d, 100) / 1.5 - 2.0))))
                total += np.bincount(row, np.where(d == 0, 0.0, np.log1p(-w)), minlength=len(texts))
        return -np.expm1(total)

    def either(self, who: np.ndarray, lexeme: np.ndarray, least: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Texts and scores of the k best of every query that has any of its lexemes: pairs of a query and a lexeme, sorted by query.

        A query's frequent lexemes give every text a sum, and queries come in an order in which those sums are shared. A
        query's own work is with the texts of its rare lexemes: of the others, only the k best by that sum can be among its best,
        as a rare lexeme only adds. Texts below ``least``, the k-th best score of other blocks, are left out.
        """
        m, sums, shared, base = len(least), [np.zeros(len(self.ids))], (), None
        size = np.diff(self.cut)[lexeme]
        wanted = np.bincount(who, minlength=m).tolist()
        held = np.flatnonzero(size)
        held = held[np.lexsort((lexeme[held], -size[held], who[held]))]
        often = size[held] * FREQUENT >= len(self.ids)
        stop = np.cumsum(np.bincount(who[held], minlength=m))
        few = (stop - np.bincount(who[held], ~often, minlength=m).astype(np.int64)).tolist()
        listed, stop = lexeme[held].tolist(), stop.tolist()
        split = sorted((tuple(listed[low:middle]), n, i) for i, (low, middle, n) in enumerate(zip([0, *stop[:-1]], few, wanted, strict=True)))
        nothing = np.zeros(0, np.int64)
        out: list = [(nothing, np.zeros(0))] * m
        for frequent, n, i in split:
            rare = listed[few[i] : stop[i]]
            if not frequent and not rare:
                continue
            if frequent != shared or base is None:
                same = next((j for j, (x, y) in enumerate(zip(frequent, shared, strict=False)) if x != y), min(len(frequent), len(shared)))
                del sums[same + 1 :]
                for x in frequent[same:]:
                    row = self._row(x)
                    if row is not None:
                        sums.append(sums[-1] + row)
                    else:
                        own = slice(self.cut[x], self.cut[x + 1])
                        sums.append(sums[-1].copy())
                        sums[-1][self.text[own]] += self.part[own]
                shared, base, highest = frequent, (None, nothing, 0.0), sums[-1].max(initial=0.0)
            total, low = sums[-1], (least[i] - 4e-9) * n
            best = nothing
            if highest >= low and highest > 0:
                if base[0] != n:
                    base = (n, *self._best_by(total, n, k))
                best, low = base[1], max(low, base[2])
            if rare:
                owned = [slice(self.cut[x], self.cut[x + 1]) for x in rare]
                texts = [self.text[own] for own in owned]
                touched = np.concatenate(texts) if len(texts) > 1 else texts[0]
                before = total[touched]
                for own, at in zip(owned, texts, strict=True):
                    total[at] += self.part[own]
                after = total[touched]
                touched_best = touched[after >= low]
                best = np.unique(np.concatenate([best, touched_best])) if len(touched_best) else best
                scores = total[best] / n
                total[touched] = before
            else:
                scores = total[best] / n
            order = np.lexsort((best, -np.round(scores, 9)))[:k]
            out[i] = best[order], scores[order]
        return out

    @staticmethod
    def _best_by(total: np.ndarray, n: int, k: int) -> tuple[np.ndarray, float]:
        """The k best texts by a sum, and the least sum that can be among the k best."""
        texts = near_best(total, k, 4e-9 * n)
        texts = texts[total[texts] > 0]
        if len(texts) <= k:
            return texts, 0.0 if len(texts) < k else total[texts].min() - 4e-9 * n
        score = np.round(total[texts] / n, 9)
        last = np.partition(score, len(score) - k)[len(score) - k]
        above = texts[score > last]
        return np.concatenate([above, texts[score == last][: k - len(above)]]), (last - 4e-9) * n

    def search(self, parts: list[tuple[str, list[str]]], k: int) -> tuple[np.ndarray, np.ndarray]:
        """Texts (places of ids) and scores of the k best of one query; parts as in ``web_query``."""
        wanted = sorted({w for kind, tokens in parts if kind != "not" for w in tokens})
        n, lexemes = len(wanted), [self.number[w] for w in wanted]
        either = any(kind == "or" for kind, _ in parts)
        parts = [(kind, [self.number[w] for w in tokens]) for kind, tokens in parts]
        needed = sorted({x for kind, tokens in parts if kind in ("and", "phrase") for x in tokens})
        texts = self.having(needed) if needed else None
        for kind, tokens in parts:
            if kind == "or":
                some = self.any_of(tokens)
                texts = some if texts is None else np.intersect1d(texts, some)
        for kind, tokens in parts:
            if kind == "phrase":
                texts = self.phrase(tokens, texts)
            elif kind == "not":
                texts = np.setdiff1d(texts, self.phrase(tokens, texts), assume_unique=True)
        scores = self.mean(lexemes, n, texts) if either or n < 2 else self.nearness(lexemes, texts)
        order = np.lexsort((texts, -np.round(scores, 9)))[:k]
        return texts[order], scores[order]


def _index(texts: pa.Table, lexemes: list[str], config: str) -> _Block:
    """The index of one block: of texts as words, or of stored postings."""
    if "words" in texts.column_names:
        stop = frozenset(STOP_WORDS)
        split = pc.split_pattern(texts.column("words").combine_chunks(), " ")
        word, fold = split.flatten(), (lambda w: w) if config == "simple" else (lambda w: None if w in stop else stem(w))
    else:
        split, fold = texts.column("positions").combine_chunks(), lambda w: w
        word = texts.column("lexeme").combine_chunks().take(pc.list_parent_indices(split))
    row = pc.list_parent_indices(split).to_numpy().astype(np.int64)
    first = np.append(0, np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False)))[:-1]
    at = np.arange(len(row)) - first[row] + 1 if "words" in texts.column_names else split.flatten().to_numpy().astype(np.int64)
    return _Block(texts.column("id").combine_chunks(), row, word, at.astype(np.int64), lexemes, fold)


class _Asked:
    """Some queries (qid, parts), and their best hits so far."""

    def __init__(self, queries: pa.Table, lexemes: pa.Array, mode: str) -> None:
        self.qid, self.mode, self.best = queries.column("qid").combine_chunks(), mode, None
        self.least = np.zeros(len(self.qid))
        parts = queries.column("parts").combine_chunks()
        if mode == "or":
            words = parts.flatten().field("words")
            of = pc.list_parent_indices(parts).to_numpy()[pc.list_parent_indices(words).to_numpy()].astype(np.int64)
            pair = np.unique((of << 32) | pc.index_in(words.flatten(), lexemes).to_numpy().astype(np.int64))
            self.who, self.lexeme = pair >> 32, pair & ((1 << 32) - 1)
        else:
            self.rows = [[(p["kind"], p["words"]) for p in row] for row in parts.to_pylist()]

    def found(self, index: _Block, k: int) -> pa.Table:
        """The k best of every query within one block; where k hits are known, only those that can be among the best of all."""
        found = index.either(self.who, self.lexeme, self.least, k) if self.mode == "or" else [index.search(row, k) for row in self.rows]
        who = np.repeat(np.arange(len(found)), [len(t) for t, _ in found])
        place, score = (np.concatenate([f[i] for f in found] or [np.zeros(0)]) for i in (0, 1))
        return pa.table({"qid": self.qid.take(pa.array(who, pa.int64())), "id": index.ids.take(pa.array(place.astype(np.int64))), "score": pa.array(score.astype(np.float64))})

    def add(self, found: pa.Table, k: int) -> None:
        self.best = found if self.best is None else _best_of(pa.concat_tables([self.best, found]), k)
        if self.mode != "or":
            return
        at = pc.index_in(self.best.column("qid").combine_chunks(), self.qid).to_numpy()
        full = np.bincount(at, minlength=len(self.qid)) >= k
        self.least[:] = np.inf
        np.minimum.at(self.least, at, np.round(self.best.column("score").to_numpy(), 9))
        self.least[~full] = 0.0


def _best_of(found: pa.Table, k: int) -> pa.Table:
    """The k best of each query of hits of several blocks."""
    keyed = found.append_column("rounded", pa.array(np.round(found.column("score").to_numpy(), 9)))
    order = [("qid", "ascending"), ("rounded", "descending"), ("id", "ascending")]
    found = found.take(pc.sort_indices(keyed, sort_keys=order, null_placement="at_start"))
    qid = found.column("qid").to_numpy()
    first = np.flatnonzero(np.append(True, qid[1:] != qid[:-1])) if len(qid) else np.zeros(0, np.int64)
    return found.filter(pa.array(np.arange(len(qid)) - np.repeat(first, np.diff(np.append(first, len(qid)))) < k)).combine_chunks()


def _queries_of(files: list[str], part: int, parts: int) -> pa.Table:
    """qid and parts of one part of the queries, from the files of their table."""
    batches = []
    for file in files:
        system, path = fs.FileSystem.from_uri(file)
        with system.open_input_file(path) as opened:
            for batch in pq.ParquetFile(opened).iter_batches(1 << 16, columns=["qid", "parts"], use_threads=False):
                batches.append(batch.filter(pa.array(batch.column("qid").to_numpy() % parts == part)))
    return pa.Table.from_batches(batches) if batches else pa.table({"qid": pa.array([], pa.int64()), "parts": pa.array([], pa.list_(pa.null()))})


def _group_search(files: list[str], part: int, parts: int, mode: str, config: str, k: int):
    """The k best of every query of one part within a group of blocks, which come one after another."""

    def run(batches):
        asked = _queries_of(files, part, parts)
        if not asked.num_rows:
            return
        lexemes = asked.column("parts").combine_chunks().flatten().field("words").flatten().unique()
        lexemes = lexemes.take(pc.sort_indices(lexemes))
        step = max(1, HITS // k)
        some = [_Asked(asked.slice(at, step), lexemes, mode) for at in range(0, asked.num_rows, step)]
        listed = lexemes.to_pylist()

        def search(texts: pa.Table):
            index = _index(texts, listed, config)
            for queries in some:
                found = queries.found(index, k)
                if k > HITS:
                    yield from found.combine_chunks().to_batches()
                else:
                    queries.add(found, k)

        block, held = None, []
        for batch in batches:
            of = batch.column("block").to_numpy()
            cuts = [0, *(np.flatnonzero(of[1:] != of[:-1]) + 1).tolist(), len(of)] if len(of) else []
            for low, high in pairwise(cuts):
                if held and of[low] != block:
                    yield from search(pa.Table.from_batches(held))
                    held = []
                block = of[low]
                held.append(batch.slice(low, high - low))
        if held:
            yield from search(pa.Table.from_batches(held))
        for queries in some:
            if queries.best is not None:
                yield from queries.best.combine_chunks().to_batches()

    return run


def search_lexical(df: DataFrame, queries: DataFrame, k: int = 10, country: str | None = None, config: str = "simple", mode: str = "and", id_col: str = "row_id", stored: DataFrame | None = None, digits: int = 9) -> DataFrame:
    """qid, id, score, rank of the best texts for each query (qid, qtext). The country filter comes before ranking.

    Ranks are by scores of nine decimals; ``digits`` are those of the scores given, for a caller that rounds them again.

    ``mode`` is "and", "or" or "web" (phrases in quotes, ``or``, ``-``). With ``stored`` postings of the table and
    configuration no text is read. Each text goes to one block, and each group of blocks is searched by one task, block after
    block, for all distinct queries, which it reads in the shared folder (through ``pyarrow.fs``). A group gives the k best of each
    query, and there are as many groups as cores however many blocks, so no table has a row for each pair of a query and a text
    that it matches, or of a query and a block.
    """
    if config not in ("simple", "spanish"):
        raise ValueError(f"unknown configuration: {config}")
    rows = df if country is None else df.where(F.col("country") == country)
    if mode == "web":
        asked = materialize(web_parts(queries, config).where(F.exists("parts", lambda p: p["kind"] != "not")), "web-parts")
    else:
        grouped = query_lexemes(queries, config).groupBy("qid").agg(F.array_sort(F.collect_set("lexeme")).alias("words"))
        asked = materialize(grouped.select("qid", F.transform("words", lambda w: F.struct(F.lit("and").alias("kind"), F.array(w).alias("words"))).alias("parts")), "asked")
    if stored is None:
        texts = rows.select(F.col(id_col).alias("id"), F.array_join(words(F.col("text")), " ").alias("words")).where("words <> ''")
    else:
        lexemes = asked.select(F.explode(F.flatten(F.transform("parts", lambda p: p["words"]))).alias("lexeme")).distinct()
        texts = _stored_postings(stored, lexemes, None if country is None else rows.select(F.col(id_col).alias("id"))).select("id", "lexeme", "positions")
    distinct = materialize(asked.select("parts").distinct().select(F.monotonically_increasing_id().alias("qid"), "parts"), "asked-distinct")
    n, m, files = rows.count(), distinct.count(), distinct.inputFiles()
    groups = max(4, min(MOST_GROUPS, df.sparkSession.sparkContext.defaultParallelism))
    each = -(-n // (groups * BLOCK))
    blocks = groups * each if each > 1 else max(1, min(groups, n // 4_096))
    held = texts.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).repartitionById(blocks, F.col("block"))
    schema = T.StructType([T.StructField("qid", T.LongType()), T.StructField("id", texts.schema["id"].dataType), T.StructField("score", T.DoubleType())])
    parts = max(1, min(m, -(-m * min(k, n) // HELD)))
    # Every part of the queries reads the same exchange of texts.
    found = reduce(DataFrame.unionByName, (held.coalesce(groups).mapInArrow(_group_search(files, i, parts, mode, config, k), schema) for i in range(parts)))
    if digits == 9:
        hits = top_k(found.withColumn("score", F.round("score", 9)), k)
    else:
        # The score given goes behind the id, where it decides no place: an id is in one block.
        placed = found.select("qid", F.struct("id", F.round("score", digits).alias("given")).alias("id"), F.round("score", 9).alias("score"))
        hits = top_k(placed, k).select("qid", "id.id", F.col("id.given").alias("score"), "rank")
    hits = hits.withColumnRenamed("qid", "asked")
    named = asked.join(distinct.withColumnRenamed("qid", "asked"), "parts").select("qid", "asked")
    hits = hits.join(named, "asked").select("qid", "id", "score", "rank")
    return top_k(hits, k) if mode == "web" else hits  # a repeated qid has one ranking


def web_query(text: str) -> list[tuple[str, list[str]]]:
    """Parts of a web-style query: ("and" | "phrase" | "not", words); words joined by ``or`` make an "or" part."""
    parts: list[tuple[str, list[str]]] = []
    join_next = False
    for minus, quoted, bare in re.findall(r'(-?)(?:"([^"]*)"|([^\s"]+))', text):
        tokens = re.findall(r"[^\W_]+", (quoted or bare).lower())
        if bare.lower() == "or" and parts:
            join_next = True
            continue
        if not tokens:
            continue
        kind = "not" if minus else "phrase" if len(tokens) > 1 else "and"
        if join_next and kind == "and" and parts[-1][0] in ("and", "or"):
            parts[-1] = ("or", parts[-1][1] + tokens)
        else:
            parts.append((kind, tokens))
        join_next = False
    return parts


PART = "array<struct<kind:string,words:array<string>>>"


def web_parts(queries: DataFrame, config: str = "simple") -> DataFrame:
    """qid and parts (kind, lexemes in order) of web-style queries (qid, qtext); stop words and empty parts are left out."""
    fold, drop = ((lambda w: w), frozenset()) if config == "simple" else (stem, frozenset(STOP_WORDS))

    def run(batches):
        for batch in batches:
            parts = []
            for text in batch.column("qtext").to_pylist():
                kept = [(kind, [fold(w) for w in tokens if w not in drop]) for kind, tokens in web_query(text or "")]
                parts.append([{"kind": kind, "words": tokens} for kind, tokens in kept if tokens])
            kind = pa.list_(pa.struct([("kind", pa.string()), ("words", pa.list_(pa.string()))]))
            yield pa.RecordBatch.from_arrays([batch.column("qid"), pa.array(parts, kind)], names=["qid", "parts"])

    return queries.select("qid", "qtext").mapInArrow(run, f"qid {queries.schema['qid'].dataType.simpleString()}, parts {PART}")


def search_web(df: DataFrame, text: str, k: int = 10, id_col: str = "row_id", config: str = "simple") -> DataFrame:
    """id, score of one web-style query: bare words and phrases are all required, ``or`` alternatives, ``-`` excludes.

    Punctuation alone, stop words alone and blank queries find nothing and raise nothing.
    """
    query = df.sparkSession.createDataFrame([(0, text)], "qid int, qtext string")
    return search_lexical(df, query, k, config=config, mode="web", id_col=id_col).select("id", "score").orderBy(F.desc("score"), "id")
