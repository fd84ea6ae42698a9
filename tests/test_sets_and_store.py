"""Question sets, answers, embedding, store, files and streams."""

import json

import pytest
from pyspark.sql import functions as F

from clausesearch.operators import answering, dedup, embedding, golden
from clausesearch.sources import files
from clausesearch.sources.store import ChunkStore
from clausesearch.streaming.ingest import ingest_stream

CITE = "array<struct<country:string,norm_id:string,article:string>>"


def entries(spark, *rows):
    base = dict(id="q-1", question="¿Qué?", kind="factual", answerable=True, expected_answer="Algo", citations=[("AR", "res-1", "3")], status="draft", notes="")
    full = [base | r for r in rows]
    return spark.createDataFrame([tuple(r.values()) for r in full], f"id string, question string, kind string, answerable boolean, expected_answer string, citations {CITE}, status string, notes string")


@pytest.mark.parametrize(
    "change,want",
    [
        ({}, []), ({"question": "  "}, ["blank_question"]), ({"expected_answer": None}, ["blank_answer"]), ({"kind": "otra"}, ["unknown_kind"]), ({"status": None}, ["unknown_status"]), ({"kind": "trap"}, ["answerable_trap"]),
        ({"citations": []}, ["uncited"]), ({"citations": None}, ["uncited"]), ({"kind": "trap", "answerable": False, "citations": []}, []), ({"kind": "trap", "answerable": False}, ["cited_unanswerable"]),
    ],
)
def test_rules(spark, change, want):
    df = entries(spark, change)
    assert golden.violations(df).first().violations == want
    if want:
        with pytest.raises(ValueError, match=want[0]):
            golden.validate(df)
    else:
        assert golden.validate(df).count() == 1


def test_set_level(spark):
    df = entries(spark, {}, {"status": "reviewed"}, {"id": "t-7", "kind": "trap"}, {"id": "sin numero"})
    assert [tuple(r) for r in golden.duplicate_ids(df).collect()] == [("q-1", 2)]
    with pytest.raises(ValueError, match="q-1"):
        golden.validate(df.where("kind <> 'trap'"))
    assert golden.next_id(df, "q") == 2 and golden.next_id(df, "t") == 8 and golden.next_id(df, "nuevo") == 1
    assert {tuple(r) for r in golden.counts(df).collect()} == {("factual", 3, 1), ("trap", 1, 0)}
    assert golden.reviewed(df).count() == 1 and golden.drafts(df, "trap").count() == 1 and golden.drafts(df).count() == 3


def test_citations(spark):
    df = entries(spark, {"citations": [("AR", "res-1", "3"), ("AR", "res-1", None), ("AR", "res-9", "1"), ("AR", "res-9", "1")]})
    corpus = spark.createDataFrame([("AR", "res-1", "3", 1, 1, "dos"), ("AR", "res-1", "3", 0, 2, "uno"), ("AR", "res-1", None, 0, 3, "pre")], "country string, norm_id string, article string, idx int, row_id long, text string")
    assert [tuple(r) for r in golden.unknown_citations(df, corpus, "id").orderBy("place").collect()] == [("q-1", 2, "AR", "res-9", "1"), ("q-1", 3, "AR", "res-9", "1")]
    assert golden.status_report(df, corpus).first().asDict() == {"entries": 1, "reviewed": 0, "citations": 4, "unknown": 2, "exit_code": 1}
    assert [r.body for r in golden.cited_texts(df, corpus, "id").orderBy("place").collect()] == ["uno\n\ndos", "pre", "(no text)", "(no text)"]


def test_golden_file(spark, tmp_path):
    path = tmp_path / "a" / "set.json"
    golden.save(entries(spark, {"question": "¿Cuándo?"}), str(path))
    assert path.read_text(encoding="utf-8").endswith("}\n") and "¿Cuándo?" in path.read_text(encoding="utf-8")
    path.write_text(json.dumps({"questions": [{"id": "x", "question": "q", "kind": "trap", "answerable": False, "expected_answer": "a", "citations": []}]}), encoding="utf-8")
    row = golden.load(spark, str(path)).first()
    assert (row.id, row.status, row.notes) == ("x", "draft", "")


def test_answers(spark):
    hits = spark.createDataFrame([(0, 2, "b", "AR", "res-1", None), (0, 1, "a < b", "AR", "res-1", "3")], "qid long, rank int, text string, country string, norm_id string, article string")
    asked = spark.createDataFrame([(0, "¿?"), (1, "¿?")], "qid long, question string")
    contexts = answering.format_contexts(hits, asked)
    got = {r.qid: r.context for r in contexts.collect()}
    assert got[1] == answering.NO_HITS and got[0].index("a < b") < got[0].index(answering.NO_ARTICLE)
    given = spark.createDataFrame([(0, [("AR", "res-1", None), ("AR", "res-1", "4")]), (1, [("AR", "res-1", "3")])], f"qid long, citations {CITE}")
    assert {tuple(r) for r in answering.unsupported_citations(given, hits).collect()} == {(0, "AR", "res-1", "4"), (1, "AR", "res-1", "3")}
    assert {r.confidence for r in answering.answer_questions(asked, contexts).collect()} == {"baja"}


def test_batches_and_retries(spark):
    assert embedding.budget_batches([5, 5, 1, 20, 1], 10) == [0, 0, 1, 2, 3] and embedding.budget_batches([], 10) == []
    waits, calls = [], []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise embedding.RateLimited
        return "ok"

    assert embedding.with_retries(flaky, sleep=waits.append) == "ok" and waits == [15.0, 22.5]
    with pytest.raises(KeyError):
        embedding.with_retries(lambda: {}["x"], sleep=waits.append)
    assert embedding.pause_for(500, 1000) == 30
    df = spark.createDataFrame([(i, f"texto {i}") for i in range(300)] + [(999, None)], "row_id long, text string")

    def factory():
        inner = embedding.hashing_client(4)

        def client(texts, kind):
            assert 0 < len(texts) <= 128 and kind == "document"
            return inner(texts, kind)

        return client

    got = {r.row_id: list(r.embedding) for r in embedding.embed_texts(df, factory).collect()}
    assert len(got) == 300 and got[7] == pytest.approx(embedding.embed_query("texto 7", embedding.hashing_client(4)))


CHUNK = "chunk_id string, text string, country string, n int"


def test_store(spark, tmp_path):
    store = ChunkStore(spark, str(tmp_path / "s"))
    df = spark.createDataFrame([("a", "Uno dos", "AR", 1), ("a", "Uno tres", "AR", 2), ("b", "x", "CL", 1)], CHUNK)
    assert store.upsert(df.limit(0), ["n"]) == 0 and not store.exists() and store.pending(df).count() == 3
    assert store.upsert(df, ["n"]) == 3
    assert {(r.chunk_id, tuple(r.tokens)) for r in store.read().collect()} == {("a", ("uno", "tres")), ("b", ("x",))}
    more = spark.createDataFrame([("b", "nuevo", "CL", 9, "m"), ("c", "z", "CL", 1, "m")], CHUNK + ", article string")
    assert [r.chunk_id for r in store.pending(more).collect()] == ["c"] and store.upsert(more, ["n"]) == 2
    assert {(r.chunk_id, r.text, r.article) for r in store.read().collect()} == {("a", "Uno tres", None), ("b", "nuevo", "m"), ("c", "z", "m")}
    assert store.keys().count() == 3 and {r.lexeme for r in store.write_postings().collect()} == {"uno", "tres", "nuevo", "z"}
    vectors = spark.createDataFrame([("b", [1.0])], "chunk_id string, embedding array<float>")
    with pytest.raises(ValueError, match="embeddings"):
        store.upsert(more, ["n"], vectors)
    assert store.upsert(more.where("chunk_id = 'b'"), ["n"], vectors) == 1 and store.read().where("embedding IS NOT NULL").count() == 1


def test_stream(spark, tmp_path):
    source = str(tmp_path / "in")
    write = lambda rows: spark.createDataFrame(rows, CHUNK).coalesce(1).write.mode("append").parquet(source)
    write([("a", "x", "AR", 1), ("b", "y", "AR", 1)])
    run = lambda: {(r.chunk_id, r.text) for r in ingest_stream(spark, source, str(tmp_path / "t"), str(tmp_path / "c"), ["n"], 1).collect()}
    assert run() == {("a", "x"), ("b", "y")}
    write([("a", "x2", "AR", 2)])
    assert run() == {("a", "x2"), ("b", "y")} == run()


def test_jsonl(spark, tmp_path):
    df = spark.createDataFrame([("ñ#1", "línea\n2", None, 3)], "chunk_id string, text string, variant string, idx int")
    files.write_jsonl(df, str(tmp_path / "j"))
    line = "".join(p.read_text(encoding="utf-8") for p in (tmp_path / "j").iterdir() if p.suffix == ".json").strip()
    assert json.loads(line) == {"chunk_id": "ñ#1", "text": "línea\n2", "variant": None, "index": 3} and "ñ" in line
    row = files.read_jsonl(spark, str(tmp_path / "j")).first()
    assert (row.chunk_id, row.idx, row.n_sources) == ("ñ#1", 3, None)


def test_dedup_and_statistics(spark):
    rows = [(1, "n", "a  b", "1", "s"), (2, "n", " a b", None, "s"), (3, "m", "a b", "", "s"), (4, "n", "c" * 10, "2", "s"), (5, None, "a b", "1", "t"), (6, "n", None, None, "t"), (7, "n", None, None, "t")]
    df = spark.createDataFrame(rows, "row_id long, norm_id string, text string, article string, strategy string")
    assert {(r.row_id, r.n_sources) for r in dedup.dedup_chunks(df, ["row_id"]).collect()} == {(1, 2), (3, 1), (4, 1), (5, 1), (6, 2)}
    got = dedup.chunk_statistics(df.where("text IS NOT NULL")).where("strategy = 's'").first()
    assert (got.n_chunks, got.median, got.p95, got.longest, got.with_article, got.percent) == (4, 4, 4, 10, 2, 50)
    assert dedup.chunk_statistics(df.limit(0)).collect() == [] and dedup.chunk_statistics(df.where("row_id = 5")).first().p95 == 3


def test_an_upsert_writes_only_the_parts_it_touches(spark, tmp_path):
    store = ChunkStore(spark, str(tmp_path / "s"), parts=8)
    df = spark.createDataFrame([(f"c{i}", f"texto {i}", "AR", i) for i in range(100)], CHUNK)
    store.upsert(df, ["n"])
    before = store._state()
    assert len(before["folders"]) == 8 and len(set(before["folders"].values())) == 1
    store.upsert(df.where("chunk_id = 'c7'").withColumn("text", F.lit("otro")), ["n"])
    after = store._state()
    assert sum(before["folders"][p] != after["folders"][p] for p in after["folders"]) == 1
    assert {(r.chunk_id, r.text) for r in store.read().collect()} == {(f"c{i}", "otro" if i == 7 else f"texto {i}") for i in range(100)}
    with pytest.raises(Exception, match="(?i)exist"):  # a second writer that started from the same state
        store._move(before)


def test_a_derived_column_reaches_older_rows(spark, tmp_path):
    store = ChunkStore(spark, str(tmp_path / "s"))
    store.upsert(spark.createDataFrame([("a", "uno dos", "AR", 1), ("b", "x", "AR", 1)], CHUNK), ["n"])
    store.add_derived("length", "char_length(text)")
    assert {(r.chunk_id, r.length) for r in store.read().collect()} == {("a", 7), ("b", 1)}
    store.upsert(spark.createDataFrame([("b", "xyz", "AR", 2)], CHUNK), ["n"])
    assert {(r.chunk_id, r.length, len(r.tokens)) for r in ChunkStore(spark, str(tmp_path / "s")).read().collect()} == {("a", 7, 2), ("b", 3, 1)}


def test_no_shared_folder_on_a_cluster_is_an_error():
    from types import SimpleNamespace

    from clausesearch import runtime

    none = SimpleNamespace(isDefined=lambda: False)
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        context = SimpleNamespace(master=master, _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: none)))
        with pytest.raises(ValueError, match="checkpoint"):
            runtime.shared_dir(SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda name, default: default)))
