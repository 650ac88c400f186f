import pytest

from corpusloom.operators import geometry

BOX = "doc_id int, page int, idx int, ch string, left double, bottom double, right double, top double"


def _write(page, entries):
    """Characters of (text, left, bottom): each five points wide and ten high."""
    out, idx = [], 0
    for text, left, bottom in entries:
        for k, c in enumerate(text + " "):
            out.append((1, page, idx, c, left + 5.0 * k, bottom, left + 5.0 * k + 5, bottom + 10.0))
            idx += 1
    return out


def _rows(entries, top=700.0):
    return [(text, x, top - 20 * k) for k, row in enumerate(entries) for text, x in row]


TABLE = [[(f"name{k}", 10.0), (f"{k}{k}", 120.0), (f"v{k}", 200.0)] for k in range(5)]


@pytest.fixture
def pages(spark):
    # 1: a drawn grid; 2: two outer rules; 3: one rule and a caption; 4: the same without a caption; 5: prose in a band; 6: prose.
    prose = [(w * 9, 10.0, 700.0 - 20 * k) for k, w in enumerate(("the words ", "of a page ", "run along ", "every line "))]
    chars = [c for page in (2, 3, 4) for c in _write(page, _rows(TABLE))] + [c for page in (5, 6) for c in _write(page, prose)]
    chars += _write(1, [("a", 10.0, 90.0), ("b", 60.0, 90.0), ("c", 10.0, 70.0), ("ed", 40.0, 70.0), ("out", 300.0, 70.0)])
    rules = [(1, 1, y) for y in (65.0, 85.0, 86.0, 105.0)] + [(1, 2, 610.0), (1, 2, 720.0), (1, 3, 715.0), (1, 4, 715.0), (1, 5, 600.0), (1, 5, 650.0), (1, 5, 720.0)]
    sheets = [(1, p, 400.0, 800.0, p == 3) for p in range(1, 7)]
    return (
        spark.createDataFrame(chars, BOX), spark.createDataFrame(rules, "doc_id int, page int, y double"), spark.createDataFrame([(1, 1, x) for x in (5.0, 47.0, 100.0)], "doc_id int, page int, x double"),
        spark.createDataFrame(sheets, "doc_id int, page int, width double, height double, announced boolean"),
    )


def test_the_surest_way_gives_the_table(pages):
    found = {r["page"]: (r["way"], r["markdown"].split("\n")) for r in geometry.find_tables(*pages).collect()}
    assert set(found) == {1, 2, 3}
    # The middle of d is right of the rule, that of e left of it. The text far right is outside.
    assert found[1] == ("grid", ["| a | b |", "|---|---|", "| c e | d |"])
    assert found[2] == ("band", ["| name0 | 00 | v0 |", "|---|---|---|", *[f"| name{k} | {k}{k} | v{k} |" for k in range(1, 5)]])
    assert found[3] == ("caption", found[2][1])


def test_words_stay_whole_in_a_grid_that_is_only_near(spark, pages):
    chars = pages[0].filter("page = 1")
    rows = spark.createDataFrame([(1, 1, y) for y in (65.0, 85.0, 105.0)], "doc_id int, page int, y double")
    words = geometry.words(chars)
    cells = {(r["row"], r["col"]): r["text"] for r in geometry.grid_cells(words, rows, pages[2], order="word", text="text", between=" ").collect()}
    assert cells == {(0, 0): "a", (0, 1): "b", (1, 0): "c ed"}


def test_letters_out_of_order_are_no_table(spark, pages):
    chars, rules, verticals, sheets = pages
    second = chars.filter("page = 2")
    swapped = second.selectExpr("doc_id", "page", "IF(ch = 'v', -1, idx) AS idx", "ch", "left", "bottom", "right", "top")
    assert {r["page"] for r in geometry.find_tables(swapped, rules, verticals, sheets).collect()} == set()


def test_pages_become_a_document(spark, pages):
    chars, rules, verticals, sheets = pages
    tables = geometry.find_tables(*pages)
    lines = [(1, 1, 1, "short"), (1, 2, 1, "p" * 1000), (1, 2, 2, "end"), (1, 6, 1, "prose")]
    texts = geometry.page_texts(sheets, spark.createDataFrame(lines, "doc_id int, page int, paragraph int, text string"), tables, rules)
    rows = {r["page"]: r for r in texts.collect()}
    assert rows[1]["text"].startswith("| a | b |") and "short" not in rows[1]["text"]
    assert rows[2]["text"].startswith("ppp") and "\n\nend\n\n| name0" in rows[2]["text"]
    assert [p for p, r in sorted(rows.items()) if r["unresolved"]] == [5] and rows[4]["text"] == "" and rows[6]["text"] == "prose"
    whole = geometry.document_texts(texts).first()
    assert whole["tables"] == 3 and whole["unresolved"] == [5] and whole["markdown"].endswith("<!-- page 6 -->\n\nprose")
