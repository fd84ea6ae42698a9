"""Full text, vectors, fusion and evaluation."""

import math

import pytest
from pyspark.sql import functions as F

from clausesearch.functions.stem_es import stem
from clausesearch.operators import corpus, evaluate, fulltext, fusion, vectors

TEXTS = [
    (1, "AR", "La norma IEC 60364 rige las instalaciones eléctricas"), (2, "CL", "La norma IEC 60335 rige los aparatos"), (3, "AR", "aparatos, aparatos y más aparatos"), (4, "AR", None), (5, "CL", ""),
]


@pytest.fixture
def texts(spark):
    return spark.createDataFrame(TEXTS, "row_id long, country string, text string")


def ask(spark, *queries):
    return spark.createDataFrame(list(enumerate(queries)), "qid long, qtext string")


def found(df):
    return [(r.qid, r.id) for r in df.orderBy("qid", "rank").collect()]


def test_terms_are_all_required(spark, texts):
    assert found(fulltext.search_lexical(texts, ask(spark, "IEC 60364", "iec", "60364 aparatos", "", " ¡!", "nada"))) == [(0, 1), (1, 1), (1, 2)]
    assert found(fulltext.search_lexical(texts, ask(spark, "60364 aparatos"), mode="or")) == [(0, 3), (0, 1), (0, 2)]


def test_country_and_limit(spark, texts):
    assert found(fulltext.search_lexical(texts, ask(spark, "iec"), country="CL")) == [(0, 2)]
    assert len(found(fulltext.search_lexical(texts, ask(spark, "norma"), k=1))) == 1


def test_more_occurrences_rank_higher(spark, texts):
    assert found(fulltext.search_lexical(texts, ask(spark, "aparatos")))[0] == (0, 3)


def test_spanish(spark, texts):
    assert found(fulltext.search_lexical(texts, ask(spark, "el aparato", "instalación de la norma", "de la"), config="spanish")) == [(0, 3), (0, 2), (1, 1)]
    with pytest.raises(ValueError):
        fulltext.search_lexical(texts, ask(spark, "x"), config="klingon")


def test_rank_values(spark):
    df = spark.createDataFrame([(1, "alfa beta"), (2, "alfa alfa")], "row_id long, text string")
    got = {(r.qid, r.id): r.score for r in fulltext.search_lexical(df, ask(spark, "alfa", "alfa beta")).collect()}
    assert got[0, 1] == pytest.approx(0.0607927, abs=1e-7) and got[1, 1] == pytest.approx(0.0991032, abs=1e-7) and got[0, 2] == pytest.approx(0.1 * 1.25 / 1.64493406685, abs=1e-8)


def test_web_queries(spark, texts):
    run = lambda q, **o: [r.id for r in fulltext.search_web(texts, q, **o).collect()]
    assert run('"norma iec" -aparatos') == [1] and run("60364 or 60335") == [1, 2] and run('"iec norma"') == [] and run(" - ¡") == [] and run("") == [] and run("-aparatos") == []
    assert sorted(run("aparato", config="spanish")) == [2, 3]


@pytest.mark.parametrize("word,want", [("normas", "norm"), ("certificaciones", "certif"), ("rápidamente", "rapid"), ("comprándolo", "compr"), ("habilidades", "habil"), ("eléctrica", "electr"), ("logías", "log"), ("contribuyeron", "contribu"), ("a", "a"), ("", ""), ("60364", "60364")])
def test_stems(word, want):
    assert stem(word) == want


VECTORS = [(1, "AR", [1.0, 0.0, 0.0, 0.0]), (2, "AR", [0.0, 1.0, 0.0, 0.0]), (3, "CL", [1.0, 1.0, 0.0, 0.0]), (4, "CL", None), (5, "CL", [0.0] * 4), (6, "CL", [2.0, 2.0, 0.0, 0.0])]


@pytest.fixture
def embedded(spark):
    return spark.createDataFrame(VECTORS, "row_id long, country string, embedding array<float>")


def test_dense(spark, embedded):
    got = vectors.search_dense(embedded, [1.0, 0.0, 0.0, 0.0]).collect()
    assert [r.id for r in got] == [1, 3, 6, 2, 5] and got[0].score == 1.0 and got[1].score == pytest.approx(math.sqrt(0.5)) and got[-1].score is None
    assert [r.id for r in vectors.search_dense(embedded, [1.0, 0.0, 0.0, 0.0], k=1, country="CL").collect()] == [3]
    queries = spark.createDataFrame([(7, [1.0, 0.0, 0.0, 0.0]), (8, None), (9, [0.0] * 4)], "qid long, qvec array<float>")
    assert [(r.qid, r.id, round(r.score, 6)) for r in vectors.dense_topk(embedded, queries, 3).orderBy("rank").collect()] == [(7, 1, 1.0), (7, 3, 0.707107), (7, 6, 0.707107)]
    assert vectors.dense_topk(embedded.limit(0), queries).collect() == []


def test_dense_with_more_ties_than_candidates(spark):
    rows = [(i, "AR", [1.0, 1.0, 0.0, 0.0] if i % 3 else [0.0, 1.0, 0.0, float(i)]) for i in range(600, 0, -1)]
    df = spark.createDataFrame(rows, "row_id long, country string, embedding array<float>")
    queries = spark.createDataFrame([(7, [1.0, 0.5, 0.0, 0.0])], "qid long, qvec array<float>")
    assert [r.id for r in vectors.dense_topk(df, queries, 5).orderBy("rank").collect()] == [1, 2, 4, 5, 7]


def test_partitioned_index(spark, embedded):
    queries = spark.createDataFrame([(7, [1.0, 0.1, 0.0, 0.0])], "qid long, qvec array<float>")
    index = vectors.IvfIndex(embedded, lists=2)
    assert [r.id for r in index.search(queries, 2, probes=2).orderBy("rank").collect()] == [1, 3]
    assert vectors.ann_plan(49_999) == {"build": False, "lists": 49} and vectors.ann_plan(50_000)["build"] and vectors.ann_plan(10)["lists"] == 1


def ranking(spark, *ids, qid=0):
    return spark.createDataFrame([(qid, i, n) for n, i in enumerate(ids, 1)], "qid int, id string, rank int")


def test_fusion(spark):
    got = fusion.reciprocal_rank_fusion([ranking(spark, "a", "b", "a", "c"), ranking(spark, "c", "b")]).orderBy("rank").collect()
    assert [r.id for r in got] == ["c", "b", "a"]
    want = {"a": 1 / 61, "b": 1 / 62 + 1 / 62, "c": 1 / 63 + 1 / 61}
    assert all(r.score == pytest.approx(want[r.id]) for r in got)
    assert [r.id for r in fusion.reciprocal_rank_fusion([ranking(spark, "b"), ranking(spark, "a")], limit=1).collect()] == ["a"]
    assert fusion.reciprocal_rank_fusion([spark.createDataFrame([], "qid int, id string, rank int")]).collect() == []
    with pytest.raises(ValueError):
        fusion.reciprocal_rank_fusion([])


def test_hybrid(spark):
    df = spark.createDataFrame([(i, "AR", f"texto {w}", v) for i, w, v in ((1, "alfa", [1.0, 0.0]), (2, "beta", [0.9, 0.1]), (3, "alfa", [0.0, 1.0]))], "row_id long, country string, text string, embedding array<float>")
    queries = spark.createDataFrame([(0, "alfa", [1.0, 0.0]), (1, " ", [0.0, 1.0])], "qid long, qtext string, qvec array<float>")
    got = fusion.search_hybrid(df, queries, limit=2).orderBy("qid", "rank").collect()
    assert [(r.qid, r.id) for r in got] == [(0, 1), (0, 3), (1, 3), (1, 2)] and got[0].score == pytest.approx(2 / 61)


def test_a_question_without_a_code_has_a_context(spark, tmp_path):
    from clausesearch import queries

    chunks = [(i, f"c{i}", f"el importador verificará la bota {i}", "AR", "A", "n", "web", 2020, str(i), [1.0, float(i)]) for i in range(12)]
    schema = "row_id long, chunk_id string, text string, country string, agency string, norm_id string, variant string, year int, article string, embedding array<float>"
    spark.createDataFrame(chunks, schema).write.parquet(f"{tmp_path}/chunks.parquet")
    golden = [(20, "¿Quién verificará la bota 7?", [("AR", "n", "7")]), (40, "¿?", [("AR", "n", "1")])]
    spark.createDataFrame(golden, "pair_id long, question string, citations array<struct<country:string,norm_id:string,article:string>>").write.parquet(f"{tmp_path}/golden_questions.parquet")
    got = {r.qid: r.context for r in queries.question_contexts(spark, str(tmp_path)).collect()}
    assert got[20].count("<fragmento") == 8 and 'article="7"' in got[20].split("\n")[0] and got[40] == "(no se recuperó ningún fragmento del corpus)"
    assert [r.qid for r in queries.question_citations_unsupported(spark, str(tmp_path)).collect()] == [40]
    assert {r.qid for r in queries.answers(spark, str(tmp_path)).collect()} == {20, 40}


def test_recall(spark):
    df = spark.createDataFrame([(1, "código AB-1234 aquí"), (2, "nada"), (3, "AB-1234 y ZZ-9")], "row_id long, text string")
    probes = spark.createDataFrame([(0, "AB-1234"), (1, "ZZ-9"), (2, "QQ-1")], "qid long, needle string")
    truth = evaluate.code_truth(df, probes)
    hits = spark.createDataFrame([(0, 3), (1, 2), (2, 1)], "qid long, id long")
    assert [tuple(r) for r in evaluate.recall_at_k(truth, {"x": hits}).collect()] == [("x", 2, 1)]
    assert [r.id for r in evaluate.containing(df, "ab-12").orderBy("id").collect()] == [1, 3] and [r.id for r in evaluate.containing(df, "c_digo").collect()] == [1]


def test_cross_country_pairs(spark):
    rows = [(i, c, n, "1", 700, v) for i, c, n, v in ((1, "AR", "a", [1.0, 0.0]), (2, "CL", "b", [1.0, 0.1]), (3, "CL", "c", [0.0, 1.0]), (4, "AR", "a2", [0.1, 1.0]), (5, "AR", "z", None))] + [(6, "CL", "b", "2", 100, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "row_id long, country string, norm_id string, article string, n_chars int, embedding array<float>")
    got = [(r.a, r.b) for r in corpus.cross_country_pairs(df, 2).collect()]
    assert set(got) == {(1, 2), (4, 3)}
    assert [r.country for r in corpus.round_robin(df, 3).collect()] == ["AR", "CL", "AR"]
    assert [tuple(r) for r in corpus.longest_articles(df, 600).where(F.col("norm_id") == "b").select("row_id").collect()] == [(2,)]


def test_web_queries_in_batches(spark, texts):
    asked = ask(spark, '"norma iec" -aparatos', "60364 or 60335", '"iec norma"', " - ¡", None, "aparatos -norma", '"aparatos y más" aparatos')
    assert found(fulltext.search_lexical(texts, asked, mode="web")) == [(0, 1), (1, 1), (1, 2), (5, 3), (6, 3)]
    assert found(fulltext.search_lexical(texts, asked, mode="web", country="CL")) == [(1, 2)]


def test_stored_postings_give_the_same_hits(spark, texts, monkeypatch):
    stored = fulltext.postings(texts)
    asked = ask(spark, "IEC 60364", "iec", "aparatos", "nada")
    for few in (1_000, 1):
        monkeypatch.setattr(fulltext, "FEW_LEXEMES", few)
        for options in ({}, {"country": "CL"}, {"mode": "or"}, {"mode": "web"}):
            want = [tuple(r) for r in fulltext.search_lexical(texts, asked, **options).orderBy("qid", "rank").collect()]
            assert [tuple(r) for r in fulltext.search_lexical(texts, asked, stored=stored, **options).orderBy("qid", "rank").collect()] == want


def test_the_gate_decides_between_scan_and_index(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(4)
    x = rng.normal(size=(200, 6)).round(3)
    df = spark.createDataFrame([(i, "AR" if i % 2 else "CL", [float(v) for v in r]) for i, r in enumerate(x)], "row_id long, country string, embedding array<float>")
    asked = spark.createDataFrame([(0, [1.0, 0.0, 0.0, 0.0, 0.0, 0.0]), (1, None), (2, [0.0] * 6), (3, [0.0, 1.0, 1.0, 0.0, 0.0, 0.0])], "qid long, qvec array<float>")
    exact = found(vectors.gated_topk(df, asked, 5))
    assert exact == found(vectors.dense_topk(df, asked, 5)) and {q for q, _ in exact} == {0, 3}
    monkeypatch.setattr(vectors, "ROW_BLOCK", 30)
    index = vectors.IvfIndex(df, lists=4)
    assert found(index.search(asked, 5, probes=4)) == exact
    assert {i % 2 for _, i in found(vectors.gated_topk(df, asked, 5, country="AR", index=index))} == {1}
    assert len(found(vectors.gated_topk(df, asked, 5, least_rows=100))) == 10


def test_recall_by_kind_of_probe(spark, texts):
    probes = evaluate.phrase_probes(texts, first=2, n=3)
    assert {tuple(r) for r in probes.collect()} == {(1, "norma iec 60364"), (2, "norma iec 60335"), (3, "aparatos y más")}
    truth = evaluate.phrase_truth(texts, probes.unionByName(spark.createDataFrame([(9, "rige los aparatos")], "qid long, needle string")))
    assert {tuple(r) for r in truth.collect()} == {(1, 1), (2, 2), (3, 3), (9, 2)}
    named = truth.select(F.lit("phrases").alias("kind"), "*")
    got = spark.createDataFrame([("phrases", 1, 1), ("phrases", 2, 1), ("phrases", 9, 2), ("codes", 1, 1)], "kind string, qid long, id long")
    assert {tuple(r) for r in evaluate.recall_by_kind(named, {"a": got, "b": got.limit(0)}).collect()} == {("phrases", "a", 4, 2), ("phrases", "b", 4, 0)}


@pytest.mark.parametrize("block", [16_384, 3])
def test_pairs_of_countries_are_exact(spark, block):
    import numpy as np

    rng = np.random.default_rng(5)
    rows = [(i, "ABC"[i % 3], f"n{i}", str(i), 900, [float(v) for v in rng.normal(size=4)]) for i in range(40)] + [(90, None, "x", "1", 900, [1.0, 0.0, 0.0, 0.0]), (91, "A", "y", "1", 900, None)]
    df = spark.createDataFrame(rows, "row_id long, country string, norm_id string, article string, n_chars int, embedding array<float>")
    want = []
    for a in rows[:40]:
        for b in rows[:40]:
            if a[1] < b[1]:
                x, y = np.array(a[5], np.float32).astype(float), np.array(b[5], np.float32).astype(float)
                want.append((-round(float(x @ y / np.linalg.norm(x) / np.linalg.norm(y)), 9), a[0], b[0]))
    got = [(r.a, r.b) for r in corpus.cross_country_pairs(df, rows_of_block=block).collect()]
    assert got == [(a, b) for _, a, b in sorted(want)[:10]]
    assert corpus.cross_country_pairs(df.limit(0)).collect() == []


def scored_rows(monkeypatch, search):
    """Rows that a search ranks, and its result."""
    seen = []
    keep = fulltext.top_k
    monkeypatch.setattr(fulltext, "top_k", lambda scored, k=10: (seen.append(scored), keep(scored, k))[1])
    return found(search()), seen[0].count()


@pytest.mark.parametrize("block", [32_768, 70])
def test_questions_of_common_words_form_no_pairs(spark, monkeypatch, block):
    import random

    monkeypatch.setattr(fulltext, "BLOCK", block, raising=False)
    rng = random.Random(3)
    texts = [(i, " ".join(["de", "la"] * rng.randint(1, 4) + rng.choices(["bota", "llave", "horno", "cinta"], k=6))) for i in range(300)]
    df = spark.createDataFrame(texts, "row_id long, text string")
    asked = [f"de la {rng.choice(['bota', 'llave'])} horno {i}" for i in range(60)]
    got, rows = scored_rows(monkeypatch, lambda: fulltext.search_lexical(df, ask(spark, *asked), 3, mode="or"))
    want = []
    for q, text in enumerate(asked):
        score = {i: sum(0.1 * sum(1 / j**2 for j in range(1, t.split().count(w) + 1)) / fulltext.ZETA2 for w in sorted(set(text.split()))) / 5 for i, t in texts}
        want += [(q, i) for i in sorted(score, key=lambda i: (-round(score[i], 9), i))[:3]]
    assert got == want and rows <= 60 * 3 * -(-300 // block)


def test_phrases_with_common_words_form_no_pairs(spark, monkeypatch):
    texts = [(i, f"de la bota de {i} la cuna" if i % 3 else f"la de bota de la {i}") for i in range(300)]
    df = spark.createDataFrame(texts, "row_id long, text string")
    asked = ask(spark, *(f'"la {i}" -cuna' for i in range(60)), *(f'"de la" {i} -"bota de la"' for i in range(60)))
    monkeypatch.setattr(fulltext, "BLOCK", 70, raising=False)
    got, rows = scored_rows(monkeypatch, lambda: fulltext.search_lexical(df, asked, mode="web"))
    assert got == [(i, i) for i in range(0, 60, 3)] + [(60 + i, i) for i in range(60) if i % 3] and rows == len(got)
    got, rows = scored_rows(monkeypatch, lambda: fulltext.search_lexical(df, ask(spark, *['"de la" or bota'] * 40), 2, mode="web"))
    assert len(got) == 80 and rows <= 40 * 2 * 5


def test_rows_are_sent_once_for_thousands_of_vector_queries(spark, monkeypatch):
    import pyarrow as pa

    df = spark.range(300).selectExpr("id AS row_id", "array(1.0f, cast(id AS float)) AS embedding")
    asked = spark.range(2_100).selectExpr("id AS qid", "array(1.0f, cast(id AS float)) AS qvec")
    monkeypatch.setattr(vectors, "_best", lambda t, k: pa.table({"qid": pa.array([0], pa.int64()), "id": pa.array([0], pa.int64()), "score": [float(t.num_rows)]}))
    assert sum(r.score for r in vectors.dense_topk(df, asked).collect()) == 300 + 2_100


def test_truth_among_retrieved_pairs(spark, texts):
    among = spark.createDataFrame([(1, 1), (1, 3), (9, 2), (9, 1), (8, 3)], "qid long, id long")
    probes = spark.createDataFrame([(1, "norma iec 60364"), (9, "rige los aparatos"), (7, "la norma iec"), (8, "aparatos y má")], "qid long, needle string")
    assert {tuple(r) for r in evaluate.phrase_truth(texts, probes, among=among).collect()} == {(1, 1), (9, 2)}
    coded = spark.createDataFrame([(1, "AB-12 y AB-12"), (2, "AB-123")], "row_id long, text string")
    asked = spark.createDataFrame([(1, "AB-12"), (9, "AB-123")], "qid long, needle string")
    assert [tuple(r) for r in evaluate.code_truth(coded, asked, among=among).collect()] == [(1, 1), (9, 2)]


def test_words_of_texts_are_stemmed_in_their_block(spark, texts, monkeypatch):
    calls = []
    keep = fulltext.stems
    monkeypatch.setattr(fulltext, "stems", lambda v: (calls.append(sorted(r.token for r in v.collect())), keep(v))[1])
    assert found(fulltext.search_lexical(texts, ask(spark, "el aparato", "instalación"), config="spanish")) == [(0, 3), (0, 2), (1, 1)]
    assert calls == [["aparato", "instalación"]]


def test_codes_with_a_common_part_form_no_pairs(spark, monkeypatch):
    df = spark.createDataFrame([(i, f"AB-{i} AB-{i + 1}") for i in range(300)], "row_id long, text string")
    got, rows = scored_rows(monkeypatch, lambda: fulltext.search_lexical(df, ask(spark, *(f"AB-{i}" for i in range(1, 61))), 4, mode="or"))
    assert got[:4] == [(0, 0), (0, 1), (0, 2), (0, 3)] and got[-4:] == [(59, 59), (59, 60), (59, 0), (59, 1)] and rows <= 60 * 4


@pytest.mark.parametrize("name", ["question_contexts", "question_citations_unsupported", "answers"])
def test_questions_of_common_words_form_no_pairs_behind_contexts(spark, tmp_path, monkeypatch, name):
    from clausesearch import queries

    schema = "row_id long, chunk_id string, text string, country string, agency string, norm_id string, variant string, year int, article string, embedding array<float>"
    spark.createDataFrame([(i, f"c{i}", f"el de la bota {i}", "AR", "A", "n", "web", 2020, str(i), [1.0, float(i)]) for i in range(200)], schema).write.parquet(f"{tmp_path}/chunks.parquet")
    golden = [(20 * i, f"el de la bota {i}", [("AR", "n", str(i))]) for i in range(40)]
    spark.createDataFrame(golden, "pair_id long, question string, citations array<struct<country:string,norm_id:string,article:string>>").write.parquet(f"{tmp_path}/golden_questions.parquet")
    seen, keep = [], fulltext.top_k
    monkeypatch.setattr(fulltext, "top_k", lambda scored, k=10: (seen.append(scored), keep(scored, k))[1])
    got = queries.QUERIES[name](spark, str(tmp_path)).collect()
    assert len(got) == (0 if name == "question_citations_unsupported" else 40) and seen[0].count() <= 40 * 50


def test_queries_without_a_vector_move_no_row(spark):
    df = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(50)], "row_id long, embedding array<float>")
    asked = spark.createDataFrame([(1, None), (2, [0.0, 0.0])], "qid long, qvec array<float>")
    got = vectors.dense_topk(df, asked)
    assert got.collect() == [] and got.columns == ["qid", "id", "score", "rank"]
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()


def test_groups_of_blocks_give_the_best_of_each_distinct_query_once(spark, monkeypatch):
    import random

    rng = random.Random(8)
    df = spark.createDataFrame([(i // 2, " ".join(rng.choices(["de", "la", "bota", "llave", "horno", f"w{i % 7}"], k=9))) for i in range(400)], "row_id long, text string")
    queries = ask(spark, *([f"de la bota w{i % 7}" for i in range(30)] + [f'"de la" -w{i % 7}' for i in range(30)]))
    for mode in ("or", "and", "web"):
        want = [tuple(r) for r in fulltext.search_lexical(df, queries, 5, mode=mode).orderBy("qid", "rank").collect()]
        with monkeypatch.context() as m:
            m.setattr(fulltext, "BLOCK", 9)
            for hits, held in ((1 << 20, 1 << 23), (20, 25), (2, 1 << 23)):
                m.setattr(fulltext, "HITS", hits, raising=False)
                m.setattr(fulltext, "HELD", held, raising=False)
                seen, keep = [], fulltext.top_k
                with m.context() as n:
                    n.setattr(fulltext, "top_k", lambda scored, k=10, seen=seen, keep=keep: (seen.append(scored), keep(scored, k))[1])
                    got = [tuple(r) for r in fulltext.search_lexical(df, queries, 5, mode=mode).orderBy("qid", "rank").collect()]
                # 14 distinct queries, 4 groups of 12 blocks; 60 queries and 45 blocks gave up to 13,500 rows.
                assert got == want and (hits == 2 or seen[0].count() <= 14 * 5 * 4)


def test_a_text_is_sent_once_to_a_group_of_contexts(spark, tmp_path, monkeypatch):
    from clausesearch import queries
    from clausesearch.operators import answering

    schema = "row_id long, text string, country string, agency string, chunk_id string, norm_id string, variant string, year int, article string, embedding array<float>"
    rows = [(i, f"el de la bota {i}" + " relleno" * 500, "AR", "A", f"c{i}", "n", "web", 2020, str(i) if i else None, None) for i in range(10)]
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/chunks.parquet")
    golden = [(20 * i, "de la bota" if i % 5 else "nada") for i in range(400)] + [(20, "bota 3"), (7, "bota")]
    spark.createDataFrame(golden, "pair_id long, question string").write.parquet(f"{tmp_path}/golden_questions.parquet")
    chunks, asked = spark.read.parquet(f"{tmp_path}/chunks.parquet"), queries.question_queries(spark, str(tmp_path))
    hits = fusion.search_hybrid(chunks, asked, 8, mode="or")
    want = {tuple(r) for r in answering.format_contexts(fusion.attach(hits, chunks), asked).collect()}
    for group in (512, 30):
        monkeypatch.setattr(answering, "GROUP", group, raising=False)
        made = queries.question_contexts(spark, str(tmp_path))
        got = [tuple(r) for r in made.collect()]
        assert len(got) == 400 and set(got) == want and sum(c == answering.NO_HITS for _, c in got) == 80
    # 400 questions of eight hits each and ten texts: a text goes once to each of 14 groups, and no context goes through an exchange.
    plan = queries.QUERIES["answers"](spark, str(tmp_path))
    answered = plan.collect()
    assert sorted(r.qid for r in answered) == sorted(p for p, _ in golden if p % 20 == 0)
    moved = {}

    def walk(node):
        if node.nodeName() == "AdaptiveSparkPlan":
            return walk(node.executedPlan())
        if "QueryStage" in node.nodeName():
            return walk(node.plan())
        if node.nodeName() == "Exchange":
            names = node.output().mkString(",")
            if "block#" in names and "query#" in names or "context#" in names or "buf#" in names and "group#" in names and "qid#" in names:
                moved[names] = node.metrics().apply("shuffleRecordsWritten").value()
        children = node.children()
        for i in range(children.size()):
            walk(children.apply(i))

    walk(plan._jdf.queryExecution().executedPlan())
    assert len(moved) == 1 and sum(moved.values()) <= 401 + 14 * 10


@pytest.mark.parametrize(("text", "options"), [('"la norma" -cuna', {"mode": "web"}), ("norma aparatos", {"mode": "or"}), ("la norma de los aparatos", {"config": "spanish"})])
def test_a_repeated_query_is_searched_once(spark, monkeypatch, text, options):
    df = spark.createDataFrame([(i, f"la norma AB-{i} rige los aparatos") for i in range(300)], "row_id long, text string")
    got, rows = scored_rows(monkeypatch, lambda: fulltext.search_lexical(df, ask(spark, *[text] * 50, "nada"), 3, **options))
    assert got == [(q, i) for q in range(50) for i in range(3)] and rows <= 3 * 4


QUESTION_CHUNK = "row_id long, chunk_id string, text string, country string, agency string, norm_id string, variant string, year int, article string, embedding array<float>"


def whole_tables(spark, folder):
    """Chunks and questions with ids that are and are not divisible by 20."""
    chunks = [(i, f"c{i}", f"el importador verificará la bota AB-{i}", "AR", "A", "n", "web", 2020, str(i), [1.0, float(i)]) for i in range(12)]
    spark.createDataFrame(chunks, QUESTION_CHUNK).write.parquet(f"{folder}/chunks.parquet")
    golden = [(i, f"¿Quién verificará la bota AB-{i % 12}?", [("AR", "n", str(i % 12)), ("CL", "n", "1")]) for i in range(25)]
    spark.createDataFrame(golden, "pair_id long, question string, citations array<struct<country:string,norm_id:string,article:string>>").write.parquet(f"{folder}/golden_questions.parquet")
    return str(folder)


def test_every_question_is_ranked(spark, tmp_path):
    from clausesearch import queries

    got = queries.question_rank_or(spark, whole_tables(spark, tmp_path)).where("rank = 1").collect()
    assert sorted((r.qid, r.id) for r in got) == [(i, i % 12) for i in range(25)]
    assert "% 20" not in queries.SQL["question_rank_or"]


@pytest.mark.parametrize("block", [32_768, 9])
def test_shared_sums_give_the_best_of_any_words(spark, monkeypatch, block):
    import random

    monkeypatch.setattr(fulltext, "BLOCK", block)
    rng = random.Random(11)
    texts = [(i, " ".join(rng.choices(["de", "la", "bota", "llave"], k=8) + rng.choices([f"w{j}" for j in range(200)], k=3))) for i in range(300)]
    df = spark.createDataFrame(texts, "row_id long, text string")
    asked = [" ".join(rng.sample(["de", "la", "bota", "llave", "nada"], rng.randint(0, 5)) + rng.sample([f"w{j}" for j in range(220)], rng.randint(1, 4))) for _ in range(80)]
    want = []
    for q, text in enumerate(asked):
        words = set(text.split())
        score = {i: sum(0.1 * sum(1 / j**2 for j in range(1, t.split().count(w) + 1)) / fulltext.ZETA2 for w in sorted(words)) / len(words) for i, t in texts}
        want += [(q, i) for i in sorted((i for i in score if score[i] > 0), key=lambda i: (-round(score[i], 9), i))[:7]]
    assert found(fulltext.search_lexical(df, ask(spark, *asked), 7, mode="or")) == want


def test_every_question_is_answered(spark, tmp_path):
    from clausesearch import queries

    assert sorted(r.qid for r in queries.answers(spark, whole_tables(spark, tmp_path)).collect()) == list(range(25))


def test_queries_without_a_vector_rank_no_more_than_they_give(spark, monkeypatch):
    df = spark.createDataFrame([(i, f"la norma AB-{i} rige", [1.0, float(i)]) for i in range(300)], "row_id long, text string, embedding array<float>")
    asked = ask(spark, *(f"la norma {i}" for i in range(20))).withColumn("qvec", F.lit(None).cast("array<float>"))
    got, rows = scored_rows(monkeypatch, lambda: fusion.search_hybrid(df, asked, 4, mode="or"))
    monkeypatch.undo()
    pooled = fusion.reciprocal_rank_fusion([fulltext.search_lexical(df, asked, 20, mode="or")], limit=4)
    assert got == found(pooled) and rows <= 20 * 4 * 4


def test_every_title_is_searched(spark, tmp_path):
    from clausesearch import queries

    folder = whole_tables(spark, tmp_path)
    spark.createDataFrame([(i, f"Las botas AB-{i % 12}") for i in range(25)] + [(25, None)], "doc_id long, title string").write.parquet(f"{folder}/documents.parquet")
    assert sorted((r.qid, r.id) for r in queries.lexical_spanish(spark, folder).where("rank = 1").collect()) == [(i, i % 12) for i in range(25)]


def test_citations_of_every_question_are_looked_up(spark, tmp_path):
    from clausesearch import queries

    got = queries.question_citations_unsupported(spark, whole_tables(spark, tmp_path)).collect()
    assert sorted((r.qid, r.country) for r in got) == [(i, "CL") for i in range(25)]
    assert "% 20" not in queries.SQL["question_citations_unsupported"] and "% 20" in queries.SQL["citations_unsupported"]


def test_recall_counts_every_probe(spark, tmp_path, monkeypatch):
    from clausesearch import queries

    fitted, keep = [], vectors.IvfIndex.__init__

    def fit(self, df, lists=None, **options):
        fitted.append(options.get("sample"))
        keep(self, df, 2, **options)

    folder = whole_tables(spark, tmp_path)
    counts = lambda: {(r.kind, r.retriever): r.probes for r in queries.recall_by_kind(spark, folder).collect()}
    want = {(kind, name): n for kind, n in (("identifiers", 12), ("phrases", 12), ("paraphrases", 25)) for name in ("dense", "lexical", "hybrid")}
    assert counts() == want
    monkeypatch.setattr(vectors, "ANN_ROWS", 10)
    monkeypatch.setattr(vectors.IvfIndex, "__init__", fit)
    assert counts() == want and fitted == [12]


def test_a_score_is_not_rounded_twice(spark):
    df = spark.createDataFrame([(i, "alfa beta" if i % 2 else "alfa") for i in range(6)], "row_id long, text string")
    asked = ask(spark, "alfa beta gama", "beta")
    nine, more = (fulltext.search_lexical(df, asked, 4, mode="or", **o).orderBy("qid", "rank").collect() for o in ({}, {"digits": 15}))
    assert [(r.qid, r.id, r.rank) for r in nine] == [(r.qid, r.id, r.rank) for r in more]
    assert more[0].score == pytest.approx(0.2 / fulltext.ZETA2 / 3, abs=1e-14) and nine[0].score == round(more[0].score, 9) != more[0].score
