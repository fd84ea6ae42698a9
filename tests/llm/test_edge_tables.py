"""Every operator on empty tables, null columns, repeated rows and clashing column names."""

import pytest
from conftest_llm import CHUNKS, DOCUMENTS, GOLDEN

from clausesearch.llm import p1_split, p2_pages, p3_pairs, p4_vectors, p5_near, p6_lines, p7_copies, p8_encode, p9_leaks, p10_spans

PAGES = "variant = 'web'"
OPERATORS = {
    "p1": (CHUNKS, lambda d, s: p1_split.split_oversized(d)),
    "p2": (CHUNKS, lambda d, s: p2_pages.page_lines(d, PAGES)),
    "p2_text": (CHUNKS, lambda d, s: p2_pages.main_text(d, PAGES)),
    "p3": (GOLDEN, lambda d, s: p3_pairs.defective_pairs(d)),
    "p4": (CHUNKS, lambda d, s: p4_vectors.neighbours(d)),
    "p5": (CHUNKS, lambda d, s: p5_near.near_pairs(d, width=3, threshold=(3, 5))),
    "p5_groups": (CHUNKS, lambda d, s: p5_near.near_groups(d)),
    "p6": (CHUNKS, lambda d, s: p6_lines.repeated_lines(d)),
    "p6_stats": (CHUNKS, lambda d, s: p6_lines.line_statistics(d)),
    "p7": (CHUNKS, lambda d, s: p7_copies.copy_members(d, "row_id", ["norm_id"], ["text"])),
    "p7_distinct": (CHUNKS, lambda d, s: p7_copies.collapse_copies(d, "row_id", ["norm_id"], ["text"])),
    "p8": (DOCUMENTS, lambda d, s: p8_encode.encode(d)),
    "p9": (DOCUMENTS, lambda d, s: p9_leaks.contained_items(d, s.createDataFrame([(1, " ".join(f"w{i}" for i in range(12))), (2, None), (3, "")], "item_id long, text string"))),
    "p10": (DOCUMENTS, lambda d, s: p10_spans.sharing_pairs(d)),
    "p10_amounts": (DOCUMENTS, lambda d, s: p10_spans.shared_amounts(d)),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, make, name):
    schema, f = OPERATORS[name]
    assert f(make(schema, []), spark).collect() == []


@pytest.mark.parametrize("name", OPERATORS)
def test_null_columns_repeated_rows_and_clashing_names(spark, make, name):
    schema, f = OPERATORS[name]
    key = "doc_id" if "doc_id" in schema else "pair_id" if "pair_id" in schema else "row_id"
    long = " ".join(f"w{i}" for i in range(3000))
    rows = [{key: i} for i in range(1, 4)] + [{key: 10, "text": ""}, {key: 11, "text": " \n\t"}, {key: 12, "text": long}, {key: 12, "text": long}, {key: 13, "text": "x" * 3000, "norm_id": "n", "agency": "g", "variant": "web"}]
    f(make(schema, rows, extra=True), spark).collect()


def test_no_items(spark, make):
    none = spark.createDataFrame([], "item_id long, text string")
    assert p9_leaks.contained_items(make(DOCUMENTS, [{"doc_id": 1, "text": "uno dos"}]), none).collect() == []
