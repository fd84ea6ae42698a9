"""File names, extraction, normalisation and chunking."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from clausesearch.functions import extraction, metadata, text
from clausesearch.operators import chunking


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "t string").select(f(F.col("t")).alias("x")).first().x


@pytest.mark.parametrize(
    "name,want",
    [
        ("AR_SIC_res-16-2025.pdf", ("AR", "SIC", "res-16-2025", None, 2025)), ("CL_X_ley-1.html", ("CL", "X", "ley-1", None, None)), ("AR_SIC_res-1998-2003_texto_ordenado.html", ("AR", "SIC", "res-1998-2003", "texto_ordenado", 2003)),
        ("AR_S_res-120199.pdf", ("AR", "S", "res-120199", None, 2019)), ("AR_S_n_.pdf", ("AR", "S", "n", None, None)), ("AR_S_v1.2_a.pdf", ("AR", "S", "v1.2", "a", None)),
    ],
)
def test_file_names(spark, name, want):
    row = metadata.parse_file_name(spark.createDataFrame([(name,)], "file_name string")).first()
    assert (row.country, row.agency, row.norm_id, row.variant, row.year) == want and row.error is None


def test_bad_file_names(spark):
    names = spark.createDataFrame([("AR_SIC.pdf",), ("",), (None,)], "file_name string")
    rows = metadata.parse_file_name(names).collect()
    assert all(r.country is None and "naming convention" in r.error for r in rows)
    with pytest.raises(Exception, match="naming convention"):
        metadata.parse_file_name(names, strict=True).collect()


def test_normal_text(spark):
    raw = " uno  dos \r\n\n\x1c tres\u0085cuatro\t\nindice .... 4\ntres puntos... quedan\n   "
    assert one(spark, raw, text.normalize_text) == "uno dos\ntres cuatro\ntres puntos... quedan"
    assert one(spark, None, text.normalize_text) is None and one(spark, "", text.normalize_text) == ""


def test_labels(spark):
    row = spark.createDataFrame([("AR", "res-1", None, "a"), ("AR", "res-1", "3", "")], "c string, n string, a string, v string").select(
        text.citation_label(F.col("c"), F.col("n"), F.col("a")).alias("l"), text.chunk_id(F.col("c"), F.lit("S"), F.col("n"), F.col("v"), F.lit("hybrid"), F.lit(2)).alias("i")
    )
    assert [tuple(r) for r in row.collect()] == [("AR res-1", "AR_S_res-1_a#hybrid#2"), ("AR res-1 art. 3", "AR_S_res-1#hybrid#2")]
    assert one(spark, "  a\n b   c ", lambda c: text.snippet(c, 3)) == "a b"


def test_html_without_chrome(spark):
    page = "<html><head><style>p{}</style></head><body><header>Cabecera</header><nav><a>Menu</a></nav><p>Texto&nbsp;principal &amp; valido</p><script>var s='</p>'</script><aside>lado</aside><footer>pie</footer></body></html>"
    assert one(spark, page, extraction.html_text) == "Texto principal & valido"
    assert one(spark, None, extraction.html_text) is None and one(spark, "", extraction.html_text) == ""


def test_html_portal_page(spark):
    articles = "".join(f"<p>ARTICULO {i}.- El fabricante numero {i} presentara la documentacion tecnica del equipo dentro de los {i} dias habiles siguientes.</p>" for i in range(1, 9))
    page = f"<body><div><div><a>Inicio</a> <a>Tramites</a></div><div>Suscribase</div></div><div>{articles}</div><div><div>Mapa del sitio</div><a>Redes sociales del organismo</a></div></body>"
    got = one(spark, page, extraction.html_text)
    assert [line.split(".-")[0] for line in got.split("\n")] == [f"ARTICULO {i}" for i in range(1, 9)]


def test_files_are_dispatched(spark, tmp_path):
    from clausesearch.plans.pipeline import ingest

    (tmp_path / "AR_SIC_res-1-2020.html").write_bytes("<p>ARTICULO 1.- Uno</p><p>ARTICULO 2.- Dos \xff</p>".encode("latin-1"))
    (tmp_path / "AR_SIC_res-2-2020_texto.HTML").write_text("<p>Sin articulos</p>", encoding="utf-8")
    (tmp_path / "AR_SIC_res-3.pdf").write_bytes(b"uno\fdos")
    (tmp_path / "sinformato.html").write_text("<p>x</p>")
    (tmp_path / "nota.docx").write_bytes(b"z")
    chunks, failures = ingest(spark, str(tmp_path), pdf=lambda b: "\n".join(b.decode().split("\f")))
    got = {(r.chunk_id, r.article, r.text) for r in chunks.collect() if r.strategy != "fixed"}
    assert ("AR_SIC_res-1-2020#article#1", "2", "ARTICULO 2.- Dos") in got and ("AR_SIC_res-2-2020_texto#hybrid#0", None, "Sin articulos") in got and ("AR_SIC_res-3#hybrid#0", None, "uno\ndos") in got
    assert [r.path.rsplit("/", 1)[1] for r in failures.collect()] == ["sinformato.html"]
    assert "unsupported type: docx" in extraction.extract_files(spark.createDataFrame([("a/b.docx", b"")], "path string, content binary")).first().error
    assert "unsupported" in extraction.extract_files(spark.createDataFrame([("x.pdf", b"")], "path string, content binary")).first().error


@pytest.mark.parametrize("header", ["ARTÍCULO 3.- ", "ARTICULO 3° - ", "Art. 3º.- ", "  artículo 3 – ", "ARTICULO 3.", "ART. 3\u00a0.-"])
def test_header_spellings(spark, header):
    body = f"Considerando algo\n{header}Queda sujeto al artículo 9 de la ley.\nSegunda línea"
    spans = one(spark, body, chunking.article_spans)
    assert [(s.article, s.body) for s in spans] == [(None, "Considerando algo"), ("3", body.split("\n", 1)[1].strip())]


def test_spans_without_header(spark):
    assert [tuple(s) for s in one(spark, " solo texto \n", chunking.article_spans)] == [(None, "solo texto")]
    assert one(spark, "  \n ", chunking.article_spans) == [] and one(spark, "ARTICULO 1.- a", chunking.article_spans)[0].article == "1"


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("abcdefghij", min_size=1, max_size=30), max_size=60), st.integers(8, 60), st.integers(0, 7))
def test_windows_lose_and_cut_no_word(words, size, overlap):
    windows = [w.split(" ") for w in chunking._cut(words, size, overlap)]
    assert all(len(" ".join(w)) <= size or len(w) == 1 for w in windows)
    rebuilt, at = [], 0
    for w in windows:
        starts = [i for i in range(at, len(rebuilt) + 1) if words[i : i + len(w)] == w]
        assert starts
        back = len(rebuilt) - starts[-1]
        assert sum(len(x) + 1 for x in rebuilt[len(rebuilt) - back :]) <= max(overlap, 0) or back == 0
        rebuilt[starts[-1] :] = w
        at = starts[-1]
    assert rebuilt == words


def test_chunk_strategies(spark):
    body = "Preámbulo\nARTÍCULO 1.- corto\ncon salto\nARTÍCULO 2.- " + " ".join(f"palabra{i}" for i in range(60))
    df = spark.createDataFrame([(1, body, "extra"), (2, None, "e"), (3, " ", "e")], "doc_id int, text string, s string")
    hybrid = chunking.chunk_texts(df, "hybrid", size=200, overlap=40).orderBy("idx").collect()
    assert [r.article for r in hybrid[:2]] == [None, "1"] and hybrid[1].text == "ARTÍCULO 1.- corto\ncon salto" and {r.article for r in hybrid[2:]} == {"2"} and len(hybrid) > 4
    assert [r.idx for r in hybrid] == list(range(len(hybrid))) and all(r.n_chars == len(r.text) <= 200 and r.s == "extra" for r in hybrid)
    assert [r.article for r in chunking.chunk_texts(df, "article").orderBy("idx").collect()] == [None, "1", "2"]
    assert all(r.article is None for r in chunking.chunk_texts(df, "fixed", size=200, overlap=40).collect())
    for bad in (lambda: chunking.chunk_texts(df, "other"), lambda: chunking.chunk_texts(df, "fixed", size=10, overlap=10), lambda: chunking.chunk_texts(df, "hybrid", size=10, overlap=20)):
        with pytest.raises(ValueError):
            bad()


def test_a_header_may_be_broken_over_lines(spark):
    spans = one(spark, "previo\nARTÍCULO\n4\u00a0º\n.- Texto del artículo\n4 y más\nArtículo\tsiguiente", chunking.article_spans)
    assert [(s.article, s.body) for s in spans] == [(None, "previo"), ("4", "ARTÍCULO\n4\u00a0º\n.- Texto del artículo\n4 y más\nArtículo\tsiguiente")]


@pytest.mark.parametrize("size,overlap", [(10, 0), (10, 9), (12, 5), (3, 2), (40, 13)])
def test_windows_step_back_over_whole_words(size, overlap):
    import random

    rng = random.Random(size * 100 + overlap)
    for _ in range(50):
        words = ["x" * rng.randrange(1, 9) for _ in range(rng.randrange(30))]
        want, start = [], 0
        while start < len(words):
            fit = [e for e in range(start + 1, len(words) + 1) if len(" ".join(words[start:e])) <= size]
            end = max(fit, default=start + 1)
            want.append(" ".join(words[start:end]))
            if end == len(words):
                break
            start = min(b for b in range(start + 1, end + 1) if sum(len(w) + 1 for w in words[b:end]) <= overlap)
        assert chunking._cut(words, size, overlap) == want
