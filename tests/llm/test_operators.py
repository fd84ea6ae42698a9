"""Each operator against a plain version of its definition on small tables."""

import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from conftest_llm import CHUNKS, DOCUMENTS, GOLDEN, bag, words

from clausesearch.llm import p1_split, p2_pages, p3_pairs, p4_vectors, p5_near, p6_lines, p7_copies, p8_encode, p9_leaks, p10_spans


# 1


def check_pieces(text, limit, overlap):
    pieces = p1_split.cut_points(text, limit, overlap)
    assert pieces[0][0] == 0 and pieces[-1][1] == len(text)
    for (a, b), (c, d) in zip(pieces, pieces[1:]):
        assert b - a <= limit and d - c <= limit and a < c <= b and b - c <= overlap and d > b
    return pieces


def test_split_keeps_everything(sentence):
    for text in (sentence(700), "x" * 5000, ("é" * 1199 + " ") * 4, "a b\n" * 900, "línea\n\n" * 600):
        check_pieces(text, 1200, 200)


def test_split_prefers_articles_then_lines_then_sentences():
    text = "ARTÍCULO 1.- " + "uno dos. " * 90 + "\nARTÍCULO 2.- " + "tres cuatro. " * 80
    pieces = check_pieces(text, 1200, 200)
    assert pieces[0][1] == text.index("ARTÍCULO 2")
    text = "frase corta. " * 70 + "sin punto " * 60
    assert text[: check_pieces(text, 1200, 200)[0][1]].endswith(". ")


def test_split_hard_cut_is_exact():
    assert p1_split.cut_points("x" * 2500, 1200, 200) == [(0, 1200), (1000, 2200), (2000, 2500)]


def test_split_rejects_a_large_overlap(make):
    with pytest.raises(ValueError):
        p1_split.split_oversized(make(CHUNKS, []), overlap=600)


# 2


def test_page_lines(make):
    rng = random.Random(2)
    rows, page = [], set()
    for k in range(12):
        own = [f"Artículo {k}.- Obligación {''.join(rng.choices('abcdefgh', k=9))} del equipo QX-{rng.randrange(10_000, 99_999)} en serie {''.join(rng.choices('mnopqrs', k=8))}" for _ in range(3)]
        site = ["Inicio | Normas | Contacto", f"Usted está en: SITIO / Archivo / res-{k}", f"Publicado el {k + 1}/08/2022 - Lecturas: {rng.randrange(999)}"]
        box = ["Lo más leído", f"Aviso ZZ-{rng.randrange(10_000, 99_999)} - {''.join(rng.choices('tuvwxyz', k=7))} nuevo"]
        foot = ["© SITIO. Todos los derechos reservados."]
        lines = [*site, own[0], *box, own[1], "", own[2], *foot]
        rows.append({"row_id": k, "text": "\n".join(lines), "agency": "SITIO", "norm_id": f"res-{k}", "variant": "web"})
        page |= {(k, i) for i, line in enumerate(lines, 1) if line in site + box + foot}
        rows.append({"row_id": 100 + k, "text": "\n".join(own), "agency": "SITIO", "norm_id": f"res-{k}", "variant": "pdf"})
    table = make(CHUNKS, rows)
    assert {tuple(r) for r in p2_pages.page_lines(table, "variant = 'web'").collect()} == page
    texts = {r.row_id: r.text for r in p2_pages.main_text(table, "variant = 'web'").collect()}
    assert texts[3].replace("\n\n", "\n") == rows[7]["text"]


def test_page_lines_in_blocks_of_a_host(make, monkeypatch):
    monkeypatch.setattr(p2_pages, "BLOCK_CHARS", 300)
    rows = [{"row_id": k, "text": f"Menú del sitio\ncontenido propio número {k}{k} zz{k}\nVolver arriba", "agency": "S", "norm_id": f"n-{k}", "variant": "web"} for k in range(30)]
    found = {tuple(r) for r in p2_pages.page_lines(make(CHUNKS, rows), "variant = 'web'").collect()}
    assert {(k, i) for k in range(30) for i in (1, 3)} <= found


def test_page_lines_do_not_depend_on_the_blocks(make, monkeypatch):
    line = "Consulte la guía oficial de trámites aquí"
    rows = [{"row_id": k, "text": f"zz{k} texto{k} propio{k}\n{line}\nqq{k} final{k} ww{k}", "agency": "S", "norm_id": f"n-{k}", "variant": "web"} for k in range(4)]
    rows += [{"row_id": 4, "text": "kk4 texto4 propio4\nConsulte la guía oficial de trám", "agency": "S", "norm_id": "n-4", "variant": "web"}]
    # The frames of the line stand in a rendering that is no page, so only the line as a whole shows.
    rows += [{"row_id": 5, "text": "Consulte la guía propia\notros de trámites aquí", "agency": "S", "norm_id": "n-9", "variant": "pdf"}]
    for size in (4_000_000, 1):
        monkeypatch.setattr(p2_pages, "BLOCK_CHARS", size)
        assert {tuple(r) for r in p2_pages.page_lines(make(CHUNKS, rows), "variant = 'web'").collect()} == {(k, 2) for k in range(5)}


def made_site(seed=11, keys=60):
    """Pages of one site with menus, side boxes, a footer line of neighbours and broken ends; (rows, page lines)."""
    rng, rows, page = random.Random(seed), [], set()
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=7))
    items = ["Inicio", "Normas", "Contacto", "Prensa", "Agenda"]
    boxes = ["Lo más leído", "También puede interesarle"]
    entries = [lambda: f"Aviso ZZ-{rng.randrange(10_000, 99_999)} - {word()}", lambda: f"Leer más: {word()} {word()}", lambda: f"{word()} {word()}: nueva consulta QQ-{rng.randrange(10_000, 99_999)}"]
    for k in range(keys):
        own = [f"Producto: {word()} {word()} QX-{rng.randrange(10_000, 99_999)}", f"Artículo {k}.- {word()} {word()} {word()} del equipo {word()}", f"Que {word()} {word()} {word()}"]
        own = own[: 1 + rng.randrange(3)]
        head = [f"Usted está en: SITIO / Archivo / res-{k}", rng.choice([" | ", "  ", " > "]).join(rng.sample(items, 4))][: rng.randrange(3)]
        box = [rng.choice(boxes), *(rng.choice(entries)() for _ in range(1 + rng.randrange(2)))] if rng.random() < 0.8 else []
        foot = rng.sample(["Volver arriba", "© SITIO. Todos los derechos reservados.", f"« Anterior: {word()}  Siguiente: {word()} »"], rng.randrange(4))
        lines = [*((x, True) for x in head), (own[0], False), *((x, True) for x in box), *((x, False) for x in own[1:]), *((x, True) for x in foot)]
        rows.append({"row_id": k, "text": "\n".join(x for x, _ in lines), "agency": "SITIO", "norm_id": f"res-{k}", "variant": "web"})
        page |= {(k, i) for i, (_, p) in enumerate(lines, 1) if p}
        rows.append({"row_id": 1000 + k, "text": "\n".join(own), "agency": "SITIO", "norm_id": f"res-{k}", "variant": "pdf"})
    return rows, page


def test_pages_are_judged_by_pages_alone_whatever_the_blocks(make, monkeypatch):
    rows, page = made_site()
    found = []
    for size, kept in ((4_000_000, rows), (4_000_000, [r for r in rows if r["variant"] == "web"]), (1_500, rows), (150, rows)):
        monkeypatch.setattr(p2_pages, "BLOCK_CHARS", size)
        found.append({tuple(r) for r in p2_pages.page_lines(make(CHUNKS, kept), "variant = 'web'").collect()})
    assert found[0] == found[1] == found[2] == found[3]
    assert not found[0] - page and len(found[0]) >= 0.9 * len(page)


def test_pages_without_a_site_keep_their_text(make, sentence):
    rows = [{"row_id": k, "text": f"Producto: {sentence(3)}\nExpediente: {sentence(2)} QX-{10_000 + k}\nQue {sentence(9)}", "agency": "S", "norm_id": f"n-{k}", "variant": "web"} for k in range(40)]
    table = make(CHUNKS, rows)
    assert p2_pages.page_lines(table, "variant = 'web'").collect() == []
    assert {r.row_id: r.text for r in p2_pages.main_text(table, "variant = 'web'").collect()} == {r["row_id"]: r["text"] for r in rows}

# 3

PAIRS = [
    ("¿Qué exige el artículo 3 sobre la bota médica AB-12345?", None, {"empty"}), ("¿Qué exige el artículo 3?", " ​", {"empty"}), ("¿Qué exige el artículo 3?", "N/A", {"empty"}), ("¿Qué exige el artículo 3?", "<p></p>", {"empty"}),
    ("¿Qué exige el artículo 3?", "Lo siento, pero no puedo responder esa pregunta.", {"refusal"}), ("What does it require?", "I'm sorry, but I cannot answer this question.", {"refusal"}), ("O que exige o artigo 3?", "Não tenho permissão para tratar deste assunto.", {"refusal"}),
    ("¿Qué exige el artículo 3 sobre la bota?", "¿QUÉ EXIGE EL ARTÍCULO 3 SOBRE LA BOTA?", {"copy"}), ("¿Qué exige el artículo 3 sobre la bota?", "Respuesta: ¿Qué exige el artículo 3 sobre la bota?", {"copy"}),
    ("¿Qué exige el artículo 3 sobre la bota de la fábrica en el taller?", "The importer shall inspect the boots under penalty of a fine within the period set by law.", {"other_language"}),
    ("¿Qué exige el artículo 3 sobre la bota?", "Импортёр обязан проверить изделие до отправки со склада.", {"other_language"}),
    ("¿Qué exige el artículo 3 sobre la bota?", "El importador verificará la bota antes de la", {"truncated"}), ("¿Qué exige el artículo 3 sobre la bota?", "El importador verificará la bota (según", {"truncated"}), ("¿Qué exige el artículo 3 sobre la bota?", "El importador verificará la bota,", {"truncated"}), ("¿Quién responde?", "El importador y la autoridad del despacho", set()),
    ("¿Qué exige el artículo 3 sobre la bota?", "El importador verificará la bota antes del despacho.", set()), ("¿Qué exige el artículo 3 sobre la bota?", "El importador verificará la bota antes del despacho", set()), ("¿Qué plazo fija?", "86 días hábiles", set()), ("¿Es obligatorio?", "No", set()),
    ("¿Qué exige el artículo 3 sobre la bota?", "La norma no contiene disposiciones sobre la bota.", set()), ('¿Qué rótulo lleva la bota en el envase del taller?', 'El rótulo en inglés "keep away from the heat and out of the reach of the children" se admite junto al español.', set()),
]


def test_defects(make):
    rows = [{"pair_id": i, "question": q, "expected_answer": a} for i, (q, a, _) in enumerate(PAIRS)]
    filler = [{"pair_id": 1000 + i, "question": "¿Qué plazo?", "expected_answer": f"El fabricante verificará la pieza {i} antes del despacho. El plazo es de {i} días hábiles."} for i in range(30)]
    found = defaultdict(set)
    for pair, defect in p3_pairs.defective_pairs(make(GOLDEN, rows + filler)).collect():
        found[pair].add(defect)
    assert {i: found[i] for i in range(len(PAIRS))} == {i: d for i, (_, _, d) in enumerate(PAIRS)}
    assert not any(found[1000 + i] for i in range(30))


def test_endings_and_openers_are_learnt_from_the_answers(make):
    stock = [f"Sobre la tela número {i}, quien teje avisa al taller. La tela azul llega al taller. Quien teje la tela roja {i} cobra" + (" antes." if i % 2 else ".") for i in range(40)]
    odd = ["La tela azul llega al taller. Sobre la tela verde del taller", "La tela azul llega al taller. Quien teje la tela", "La tela azul llega al taller. Quien teje la tela verde cobra", "(a La tela azul llega al taller."]
    rows = [{"pair_id": i, "question": "¿Qué dice la norma?", "expected_answer": a} for i, a in enumerate(stock + odd)]
    assert {tuple(r) for r in p3_pairs.defective_pairs(make(GOLDEN, rows)).collect()} == {(40, "truncated"), (41, "truncated"), (43, "truncated")}


def test_every_triggered_defect_is_emitted(make):
    rows = [{"pair_id": 1, "question": "¿Qué exige el artículo 3 sobre la bota de la fábrica?", "expected_answer": "I cannot answer this question, as the rules of the manufacturer and (the"}, {"pair_id": 2, "question": "¿Qué exige el artículo 3 sobre la bota?", "expected_answer": "¿Qué exige el artículo 3 sobre la"}]
    assert {tuple(r) for r in p3_pairs.defective_pairs(make(GOLDEN, rows)).collect()} == {(1, "refusal"), (1, "other_language"), (1, "truncated"), (2, "copy"), (2, "truncated")}


# 4


def nearest(x, ids, k):
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    score = unit @ unit.T
    np.fill_diagonal(score, -2)
    return {int(ids[i]): [int(ids[j]) for j in np.argsort(-score[i])[:k]] for i in range(len(x))}


def test_neighbours_recall(make):
    rng = np.random.default_rng(1)
    x = np.repeat(rng.normal(size=(40, 16)), 30, axis=0) + 0.2 * rng.normal(size=(1200, 16))
    rows = [{"row_id": i, "embedding": [float(v) for v in r]} for i, r in enumerate(x)] + [{"row_id": 5000, "embedding": [0.0] * 16}, {"row_id": 5001}, {"row_id": 5002, "embedding": [1.0, 2.0]}, {"row_id": 5003, "embedding": [float("nan")] * 16}]
    got = defaultdict(set)
    for r in p4_vectors.neighbours(make(CHUNKS, rows)).collect():
        got[r.id].add(r.neighbour)
    true = nearest(x.astype(np.float32).astype(float), np.arange(1200), 5)
    assert set(got) == set(range(1200)) and all(len(v) == 5 and i not in v for i, v in got.items())
    assert sum(len(got[i] & set(t)) for i, t in true.items()) >= 0.9 * 5 * 1200


def test_crowded_cells_are_scanned_in_blocks(make, monkeypatch):
    monkeypatch.setattr(p4_vectors, "BLOCK", 50)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 8)).astype(np.float32)
    got = defaultdict(set)
    for r in p4_vectors.neighbours(make(CHUNKS, [{"row_id": i, "embedding": [float(v) for v in r]} for i, r in enumerate(x)]), rerank=500, probes=8).collect():
        got[r.id].add(r.neighbour)
    assert all(got[i] == set(t) for i, t in nearest(x.astype(float), np.arange(400), 5).items())


def test_a_dense_cell_is_split_on_both_sides(make, monkeypatch):
    monkeypatch.setattr(p4_vectors, "BLOCK", 40)
    monkeypatch.setattr(p4_vectors, "CELL", 10_000)
    rng = np.random.default_rng(6)
    x = (np.ones(8) + 0.05 * rng.normal(size=(300, 8))).astype(np.float32)
    got = defaultdict(list)
    for r in p4_vectors.neighbours(make(CHUNKS, [{"row_id": i, "embedding": [float(v) for v in r]} for i, r in enumerate(x)]), rerank=500).collect():
        got[r.id].append((r.place, r.neighbour))
    true = nearest(x.astype(float), np.arange(300), 5)
    assert all(len(got[i]) == 5 and {n for _, n in got[i]} == set(t) for i, t in true.items())


def test_vectors_of_each_length_are_a_collection(make):
    rng = np.random.default_rng(7)
    rows = [{"row_id": i, "embedding": [float(v) for v in rng.normal(size=4 if i % 3 else 6)]} for i in range(60)]
    got = defaultdict(set)
    for r in p4_vectors.neighbours(make(CHUNKS, rows), rerank=500).collect():
        got[r.id].add(r.neighbour)
    for chosen in ([i for i in range(60) if i % 3], [i for i in range(60) if not i % 3]):
        true = nearest(np.array([rows[i]["embedding"] for i in chosen], np.float32).astype(float), np.array(chosen), 5)
        assert all(got[i] == set(t) for i, t in true.items())


def test_neighbours_of_equal_vectors(make):
    rows = [{"row_id": i, "embedding": [1.0, 0.5, 0.0, 2.0]} for i in range(300)] + [{"row_id": 900, "embedding": [0.0, 1.0, 0.0, 0.0]}]
    got = defaultdict(list)
    for r in p4_vectors.neighbours(make(CHUNKS, rows)).collect():
        got[r.id].append((r.place, r.neighbour))
    assert sorted(got[200]) == [(1, 0), (2, 1), (3, 2), (4, 3), (5, 4)] and sorted(got[2]) == [(1, 0), (2, 1), (3, 3), (4, 4), (5, 5)]
    assert len(got[900]) == 5


def test_scores_are_quantised_towards_the_direction_of_the_vector():
    rng = np.random.default_rng(3)
    unit = rng.normal(size=(500, 16)).astype(np.float32)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    books = p4_vectors.codebooks(unit, unit, 4.0)
    errors = []
    for weight in (1.0, 4.0):
        codes = p4_vectors.encode(unit, unit, books, weight)
        e = unit - books[np.arange(16), codes]
        errors.append(np.abs((e * unit).sum(axis=1)).mean())
    assert errors[1] < errors[0]


# 5


def similar(rows, width, num, den):
    sets = {i: {tuple(w[j : j + width]) for j in range(len(w) - width + 1)} for i, w in ((i, words(t)) for i, t in rows.items())}
    ids = sorted(sets)
    return {
        (a, b) for n, a in enumerate(ids) for b in ids[n + 1 :]
        if sets[a] | sets[b] and len(sets[a] & sets[b]) * den >= num * len(sets[a] | sets[b]) and bag(rows[a]) != bag(rows[b])
    }


@pytest.mark.parametrize("hot", [4096, 4])
@pytest.mark.parametrize("width,num,den", [(3, 3, 5), (5, 4, 5)])
def test_near_pairs_are_exact(make, sentence, monkeypatch, hot, width, num, den):
    monkeypatch.setattr(p5_near, "RARE", 3)
    rng, rows = random.Random(7), {}
    for base in range(12):
        text = sentence(rng.choice([4, 9, 25, 60, 130])).split()
        for _ in range(8):
            edited = list(text)
            for _ in range(rng.randrange(0, max(2, len(text) // 12))):
                at = rng.randrange(len(edited))
                edited[at : at + 1] = rng.choice([[], ["nuevo"], [edited[at], "extra"]])
            rows[len(rows)] = " ".join(edited)
    rows |= {900: "uno dos", 901: "a a a", 902: "a a a a", 903: None, 904: rows[0].upper()}
    table = make(CHUNKS, [{"row_id": i, "text": t} for i, t in rows.items()])
    got = [tuple(r) for r in p5_near.near_pairs(table, width=width, threshold=(num, den), hot=hot).collect()]
    assert len(got) == len(set(got)) and set(got) == similar(rows, width, num, den)


def test_near_pairs_through_many_buckets_and_hot_keys(make, sentence, monkeypatch):
    rng, rows = random.Random(8), {}
    base = sentence(60).split()
    for i in range(120):  # all texts share most of their shingles
        edited = list(base)
        for _ in range(rng.randrange(12)):
            edited[rng.randrange(60)] = f"otro{rng.randrange(50)}"
        rows[i] = " ".join(edited)
    rows |= {200 + i: sentence(rng.randrange(5, 60)) for i in range(40)}
    table = make(CHUNKS, [{"row_id": i, "text": t} for i, t in rows.items()])
    want = similar(rows, 3, 3, 5)
    for spread, together, places, hot in ((512, 2_000_000, 3_000_000, 20), (3, 50, 100, 4096), (2, 1, 30, 10)):
        monkeypatch.setattr(p5_near, "SPREAD", spread)
        monkeypatch.setattr(p5_near, "TOGETHER", together)
        monkeypatch.setattr(p5_near, "PLACES", places)
        got = [tuple(r) for r in p5_near.near_pairs(table, width=3, threshold=(3, 5), hot=hot).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_near_keys_take_no_more_room_in_many_buckets(sentence):
    import types

    from clausesearch.llm.text import split_words

    texts = pa.RecordBatch.from_pydict({"rid": pa.array(range(5, 1_005), pa.int64()), "t": [sentence(60) for _ in range(1_000)]})
    _, grams = p5_near._distinct(*split_words(pa.array(texts.column("t").to_pylist() * 2)), 3)
    sketch = np.minimum(np.bincount((grams & np.uint64(p5_near.SLOTS - 1)).astype(np.int64), minlength=p5_near.SLOTS), 65_535).astype(np.uint16)
    sent, none = types.SimpleNamespace(value=sketch.tobytes()), types.SimpleNamespace(value=np.zeros(p5_near.SLOTS, np.uint32).tobytes())
    for buckets in (4, 400):
        rows = [r for batch in p5_near._pack(sent, none, 3, 3, 5, 4096, buckets, 1)(iter([texts])) for r in batch.to_pylist()]
        keys = sum(len(r["keys"]) // 4 for r in rows)
        assert keys > 5_000 and sum(len(v) for r in rows for v in r.values() if isinstance(v, bytes)) <= 6 * keys + 16 * len(rows)


def test_maps_of_texts_are_found_in_any_order_of_the_files(tmp_path):
    import pyarrow.parquet as pq

    rng = np.random.default_rng(3)
    rids = rng.permutation(np.concatenate([np.arange(700), (1 << 33) + np.arange(300)]))
    maps = rng.integers(0, 256, (1_000, p5_near.BITS // 8)).astype(np.uint8)
    for i in range(2):
        part = slice(i * 500, i * 500 + 500)
        table = pa.table({"rid": pa.array([*rids[part].tolist(), None]), "n": pa.array([*range(i * 500, i * 500 + 500), None], pa.int32()), "bits": pa.array([*(m.tobytes() for m in maps[part]), None], pa.binary())})
        pq.write_table(table, tmp_path / f"{i}.parquet")
    files = [f"file://{tmp_path}/{i}.parquet" for i in range(2)]
    wanted = np.sort(rids[::7])
    n, bits = p5_near._maps_of(files, wanted)
    assert (rids[n] == wanted).all() and (bits.view(np.uint8) == maps[n]).all()
    with pytest.raises(RuntimeError):
        p5_near._maps_of(files, np.array([5, 1_000_000]))


def test_near_pairs_reject_a_low_threshold(make):
    with pytest.raises(ValueError):
        p5_near.near_pairs(make(CHUNKS, []), threshold=(1, 2))


def test_near_groups(make, sentence):
    text = sentence(80)
    rows = [text, text + " otro", text + " otro mas", sentence(80), text.upper()]
    got = {r.row_id: (r.group, r.n_links) for r in p5_near.near_groups(make(CHUNKS, [{"row_id": i, "text": t} for i, t in enumerate(rows)])).collect()}
    assert got == {0: (0, 2), 1: (0, 2), 2: (0, 2), 3: (3, 0), 4: (0, 2)}


def test_near_groups_link_reordered_texts(make, sentence):
    lines = [sentence(40), sentence(40), sentence(40)]
    texts = ["\n".join(lines), "\n".join(lines[i] for i in (1, 2, 0)), sentence(80)]
    table = make(CHUNKS, [{"row_id": i, "text": t} for i, t in enumerate(texts)])
    assert {r.row_id: (r.group, r.n_links) for r in p5_near.near_groups(table).collect()} == {0: (0, 1), 1: (0, 1), 2: (2, 0)}
    assert p5_near.near_pairs(table).collect() == []


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    assert {tuple(r) for r in p5_near.components(edges).collect()} == {(i, 0) for i in range(41)} | {(100, 100), (101, 100)}


def test_components_that_do_not_settle_are_an_error(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    with pytest.raises(RuntimeError):
        p5_near.components(edges, rounds=1)


# 6


def test_repeated_lines_count_keys_and_not_copies(make):
    rows = [{"row_id": i, "agency": "A", "norm_id": f"n{i % 5}", "text": f"  Aviso  LEGAL \r\ncontenido {i}\n\naviso legal"} for i in range(10)]
    rows += [{"row_id": 50 + i, "agency": "A", "norm_id": f"n{i % 3}", "text": "republicado tres veces"} for i in range(30)] + [{"row_id": 90, "agency": "B", "norm_id": "n0", "text": "aviso legal"}]
    table = make(CHUNKS, rows)
    found = {tuple(r) for r in p6_lines.repeated_lines(table).collect()}
    assert found == {(i, n) for i in range(10) for n in (1, 4)}
    stats = {(r.source, r.n_keys, r.n_clusters, r.n_lines) for r in p6_lines.line_statistics(table).collect()}
    assert ("A", 3, 1, 30) in stats and ("A", 5, 10, 20) in stats
    assert not {r.row_id for r in p6_lines.repeated_lines(table, min_keys=1, min_clusters=2, date=None).collect()} & set(range(50, 90))
    assert p6_lines.repeated_lines(table, min_days=2).collect() == []
    cleaned = {r.row_id: r.text for r in p6_lines.remove_lines(table, p6_lines.repeated_lines(table)).collect()}
    assert cleaned[3] == "contenido 3\n" and cleaned[60] == "republicado tres veces"


# 7


def test_copies_have_the_same_words_in_any_order(make):
    texts = ["Lote: A\nUso: casa", "uso CASA lote a", "lote a uso casa casa", "", " ", None, "uso; casa. lote - a"]
    rows = [{"row_id": i, "norm_id": n, "text": t} for n, base in (("x", 0), ("y", 100)) for i, t in enumerate(texts, base)] + [{"row_id": 300, "text": "sin norma"}, {"row_id": 301, "text": "sin norma"}]
    got = {tuple(r) for r in p7_copies.copy_members(make(CHUNKS, rows), "row_id", ["norm_id"], ["text"]).collect()}
    assert got == {(0, 1), (0, 6), (3, 4), (3, 5), (100, 101), (100, 106), (103, 104), (103, 105)}
    counts = {r.row_id: r.n_copies for r in p7_copies.collapse_copies(make(CHUNKS, rows), "row_id", ["norm_id"], ["text"]).collect()}
    assert counts == {0: 3, 2: 1, 3: 3, 100: 3, 102: 1, 103: 3}


def test_a_chance_meeting_of_fingerprints_is_no_copy(make, monkeypatch):
    monkeypatch.setattr(p7_copies, "mix", lambda x: x * np.uint64(0))
    rows = [{"row_id": i, "norm_id": "x", "text": t} for i, t in enumerate(["a b", "c d", "b a", "d c", "c e"])]
    got = {tuple(r) for r in p7_copies.copy_members(make(CHUNKS, rows), "row_id", ["norm_id"], ["text"]).collect()}
    assert got == {(0, 2), (1, 3)}


# 8

ODD = ["hola mundo", "", None, "  dos  blancos \n\n fin ", "don't I'LL we've", "<|endoftext|> texto", "niño İstanbul ﬁ ǅ 👩‍🔧 🙂🏽", "a b c\u0085d\x1c\x07", "x" * 3000, "123 4567 ½ ²", "мир سلام 漢字", "\t\t\n"]


def test_ids_equal_the_tokenizer(make):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(f"{p8_encode.TOKENIZERS}/byte_bpe_50k.json")
    tokenizer.encode_special_tokens = True
    table = make(DOCUMENTS, [{"doc_id": i, "text": t} for i, t in enumerate(ODD)] * 1)
    want = {i: tokenizer.encode(t, add_special_tokens=False).ids if t else [] for i, t in enumerate(ODD)}
    for hot in (1 << 17, 3, 0):
        assert {r.doc_id: list(r.ids) for r in p8_encode.encode(table, hot_words=hot).collect()} == want
    assert {r.doc_id: r.text for r in p8_encode.decode(p8_encode.encode(table)).collect()} == {i: t or "" for i, t in enumerate(ODD)}


# 9


def test_suffix_array_and_search():
    rng = np.random.default_rng(0)
    s = rng.integers(0, 5, 400)
    order = p9_leaks.suffix_array(s, 3)
    assert [tuple(s[i:]) for i in order] == sorted(tuple(s[i:]) for i in range(len(s)))
    index = p9_leaks.FMIndex(s, 3)
    wanted = np.array([[1, 2], [3, 3], [4, 0], [7, 7]])
    low, high = index.search(wanted)
    for phrase, a, b in zip(wanted, low, high):
        assert sorted(index.locate(np.arange(a, b))) == [i for i in range(len(s) - 1) if tuple(s[i : i + 2]) == tuple(phrase)]


def test_leaks(make, spark, sentence):
    item = "Calcule la multa de Tapémel según el párrafo octavo de la presente norma vigente hoy"
    other = sentence(20)
    items = spark.createDataFrame([(1, item), (2, other), (3, item.upper()), (4, "corto"), (5, None)], "item_id long, text string")
    inside = item.replace(" ", ",  ").replace("é", "e").upper()
    docs = {0: f"{sentence(50)} {inside} {sentence(9)}", 1: " ".join(item.split()[:11]), 2: None, 3: " ".join(other.split()[4:16]), 4: other + " " + item, 5: item.split()[0], 6: f"{other} y {other}"}
    table = make(DOCUMENTS, [{"doc_id": i, "text": t} for i, t in docs.items()])
    for shard in (1_000_000, 5):
        got = {tuple(r) for r in p9_leaks.contained_items(table, items, shard_words=shard).collect()}
        assert got == {(0, 1), (0, 3), (3, 2), (4, 1), (4, 2), (4, 3), (6, 2)}
    spans = {(r.doc_id, r.item_id): (r.first_word, r.last_word) for r in p9_leaks.leaked_spans(table, items, block=1).collect() if r.doc_id == 4}
    assert spans == {(4, 2): (0, 19), (4, 1): (20, 34), (4, 3): (20, 34)}


def test_leaks_are_removed(make, spark, sentence):
    one, two = sentence(14), "Acción médica según el párrafo octavo de la norma común vigente hoy aquí"
    items = spark.createDataFrame([(1, one), (2, " ".join([*one.split()[2:], "cola"])), (3, two)], "item_id long, text string")
    docs = {0: f"¡Antes, {one}! Después.", 1: f"«{two.upper()}» fin", 2: None, 3: "nada", 4: f"a e\u0301a {two.replace('ó', 'o' + chr(769))}\u0301, b", 5: f"{one} {two}", 6: one.rsplit(" ", 3)[0]}
    rows = [{"doc_id": i, "text": t} for i, t in docs.items()] + [{"doc_id": 0, "text": "otro texto de ese número"}]
    got = sorted((r.doc_id, r.text or "") for r in p9_leaks.remove_leaks(make(DOCUMENTS, rows), items).collect())
    assert got == [(0, "otro texto de ese número"), (0, "¡Antes, ! Después."), (1, "«» fin"), (2, ""), (3, "nada"), (4, "a e\u0301a , b"), (5, ""), (6, docs[6])]


def test_many_items_take_one_pass(make, spark, sentence):
    texts = [sentence(30) for _ in range(300)]
    items = spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")
    table = make(DOCUMENTS, [{"doc_id": i, "text": f"{sentence(20)} {texts[i * 7]} {sentence(5)}"} for i in range(40)])
    spans = p9_leaks.leaked_spans(table, items)
    assert spans._jdf.queryExecution().executedPlan().toString().count("Scan ExistingRDD") <= 1
    assert {(r.doc_id, r.item_id, r.first_word, r.last_word) for r in spans.collect()} == {(i, i * 7, 20, 49) for i in range(40)}


# 10


def shared(docs, length):
    grams = defaultdict(set)
    for i, t in docs.items():
        for j in range(len(t or "") - length + 1):
            grams[t[j : j + length]].add(i)
    pairs, inside = set(), Counter()
    for s in grams.values():
        pairs |= {(a, b) for a in s for b in s if a < b}
    for i, t in docs.items():
        marks = bytearray(len(t or ""))
        for j in range(len(t or "") - length + 1):
            if len(grams[t[j : j + length]]) > 1:
                marks[j : j + length] = b"\1" * length
        inside[i] = sum(marks)
    return pairs, dict(inside)


def test_shared_spans(make, sentence):
    passage, near = sentence(60)[:300], sentence(60)[:239]
    docs = {0: sentence(40) + passage + sentence(30), 1: passage[:250] + sentence(20), 2: near + sentence(10), 3: sentence(12) + "¡" + near, 4: None, 5: "corto", 6: sentence(50) + passage[60:], 7: passage + "é" + passage}
    docs |= {10: "ab" * 400, 11: "z" + "ba" * 200 + sentence(9), 12: "x" * 900, 13: sentence(5) + "x" * 241, 14: sentence(30) + "x" * 239 + "y", 15: docs[0], 16: "abc" * 90 + "ab" * 130}
    pairs, inside = shared(docs, 240)
    table = make(DOCUMENTS, [{"doc_id": i, "text": t} for i, t in docs.items()])
    for batches in (1, 4):
        assert {tuple(r) for r in p10_spans.sharing_pairs(table, batches=batches).collect()} == pairs
    assert {r.doc_id: r.shared_chars for r in p10_spans.shared_amounts(table).collect()} == inside


def test_a_list_of_like_clauses_is_quoted_from_its_middle(make, sentence):
    docs = {}
    for n in range(6):
        fixed = sentence(40)[:200]
        clauses = [fixed + sentence(9)[:40] for _ in range(9)]
        docs |= {100 * n: "".join(clauses)} | {100 * n + i: sentence(8) + clauses[i] + sentence(8) for i in range(3, 6)}
    fixed = sentence(40)[:200]
    docs |= {20: "".join((fixed + "uvwxyz" * 7)[:239] for _ in range(9)), 21: "ab" * 400, 22: "x" * 900, 23: sentence(8) + ("-" * 130 + sentence(9)[:20]) * 5, 24: sentence(8)}
    docs |= {25: docs[23][-300:], 26: docs[20][500:800] + sentence(8), 27: "ba" * 130, 28: "x" * 240}
    pairs, _ = shared(docs, 240)
    assert {(100 * n, 100 * n + i) for n in range(6) for i in range(3, 6)} <= pairs
    table = make(DOCUMENTS, [{"doc_id": i, "text": t} for i, t in docs.items()])
    assert {tuple(r) for r in p10_spans.sharing_pairs(table).collect()} == pairs


def test_an_index_is_reopened_and_takes_new_batches(make, spark, sentence, tmp_path, monkeypatch):
    passages = [sentence(60)[:300] for _ in range(6)]
    rng = random.Random(9)
    docs = {i: sentence(rng.randrange(1, 40)) + "".join(rng.sample(passages, rng.randrange(3))) + sentence(20) for i in range(60)}
    docs |= {100: "ab" * 900, 101: "ab" * 300}
    pairs, inside = shared(docs, 240)
    table = make(DOCUMENTS, [{"doc_id": i, "text": t} for i, t in docs.items()])
    for hot in (2_000, 1):  # with every hash but the first of a task in the spread part
        monkeypatch.setattr(p10_spans, "HOT", hot)
        monkeypatch.setattr(p10_spans, "PART", hot)
        found, folder = set(), str(tmp_path / f"index{hot}")
        for i in range(5):
            index = p10_spans.FingerprintIndex(spark, folder, buckets=4, fanout=2)  # opened anew each time
            batch, seen = table.where(f"doc_id % 5 = {i}"), table.where(f"doc_id % 5 <= {i}")
            new = {tuple(r) for r in p10_spans.new_pairs(index, batch, seen).collect()}
            assert new == {(a, b) for a, b in pairs if max(a % 5, b % 5) == i}
            found |= new
            index.close()
        assert found == pairs and len(index.runs) < 5 and not [t for t in spark.catalog.listTables() if t.name.startswith("run_")]
        assert {tuple(r) for r in p10_spans.sharing_pairs(table).collect()} == pairs
        assert {r.doc_id: r.shared_chars for r in p10_spans.shared_amounts(table).collect()} == inside


def test_every_long_match_keeps_a_common_window(sentence):
    rng = random.Random(4)
    for _ in range(30):
        core = sentence(60)[:240]
        texts = [sentence(rng.randrange(1, 60)) + core + sentence(rng.randrange(1, 60)) for _ in range(2)]
        number, _, h = p10_spans.winnow(texts, 120, 240)
        assert set(h[number == 0]) & set(h[number == 1])
