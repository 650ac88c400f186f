import io
import random
import re
import zipfile

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import compact, geometry, planning, verify
from corpusloom.plans.convert import convert_folder
from corpusloom.plans.search import Corpus, search_packages, tool_document, tool_info, tool_search
from corpusloom.sources import readers, store
from corpusloom.streaming import ingest

TEXTS = [(1, "pump", "@/Sent/pump.md", "SENT", "The pump moves water through the pipe.\n\nA pump needs a valve and a pipe."), (2, "cell", "@/Received/cell.md", "RECEIVED", "Photosynthesis turns light into sugar in the leaf.\n\nThe leaf is green."), (3, "mix", "@/x/mix.md", "OTHER", "Water in the leaf and water in the pipe.")]
DOCS = "doc_id long, name string, pseudopath string, source string, text string"


@pytest.fixture(scope="module")
def corpus(spark):
    return Corpus(spark.createDataFrame(TEXTS, DOCS), language="en")


def test_ranking(corpus):
    rows = corpus.rank_passages("water pipe pump", limit=5).collect()
    assert rows[0]["doc_id"] in (1, 3) and all(len(r["terms"]) >= 2 for r in rows)
    assert {r["doc_id"] for r in corpus.rank_passages("water pipe pump", only="sent").collect()} == {1}
    assert "\n\n" in next(r for r in rows if r["doc_id"] == 1)["context"]


def test_literal_first(corpus):
    rows = corpus.search("Photosynthesis turns light into sugar", limit=4).collect()
    assert rows[0]["doc_id"] == 2 and rows[0]["engine"] == 0
    assert corpus.lexical("water in the leaf and water", 3).first()["doc_id"] == 3
    assert corpus.search_literal("").count() == 0


@pytest.mark.parametrize("query", ["", "?", "the and of", "*" * 50, "😀"])
def test_hostile(corpus, query):
    assert isinstance(corpus.query(query).collect(), list)


def test_modes(spark, corpus):
    assert corpus.query("leaf", mode="semantic").count() == 0
    with pytest.raises(ValueError):
        corpus.query("leaf", mode="other")
    encode = lambda texts: [[1.0, 0.0] if "leaf" in t.lower() else [0.0, 1.0] for t in texts]
    parts = corpus.passages.select("doc_id", "position", "text").collect()
    vectors = spark.createDataFrame([(r["doc_id"], r["position"], encode([r["text"]])[0]) for r in parts], "doc_id long, position int, vector array<double>")
    both = Corpus(corpus.documents, corpus.passages, vectors, encode, "en")
    found = both.query("leaf sugar", 3).collect()
    assert found[0]["doc_id"] == 2 and [r["position"] for r in found] == sorted(r["position"] for r in found)
    assert both.query("leaf", 2, "received").first()["source"] == "RECEIVED"  # a direction in any case
    assert {r["package"] for r in search_packages({"a": both, "b": both}, "leaf sugar", 6).collect()} == {"a", "b"}


def test_tools(corpus):
    answer = tool_search({"p": corpus}, "leaf sugar", 99)
    assert answer["found"] and "hint" not in answer
    assert "hint" in tool_search({"p": corpus}, "Zwiebelkuchen und der Wein ist nicht im Haus")
    assert tool_info({"p": corpus})["documents"] == 3 and tool_document({"p": corpus}, "@/x/mix.md")["text"].startswith("Water")
    assert "error" in tool_document({"p": corpus}, "none")


def test_bundle(spark):
    docs = spark.createDataFrame([(i, n, p, s, "x", t) for i, n, p, s, t in TEXTS], "doc_id long, name string, pseudopath string, source string, folder string, text string")
    private, public = store.generate_signing_key(spark)
    bundle = store.pack(docs, "secret", "me", signing=(private, public))
    header = store.read_header(bundle)
    assert header["intact"] and header["signed"] and header["documents"] == 3 and store.verify_signature(spark, bundle, public)
    _, package = store.open_bundle(spark, bundle, "secret")
    assert {r["path"]: r["text"] for r in store.export(package).collect()}["Sent/pump.md"] == TEXTS[0][4] + "\n"
    for bad in (bundle[:-1] + b"x", bundle[:-5]):
        assert not store.read_header(bad)["intact"] and not store.verify_signature(spark, bad)
        with pytest.raises(ValueError):
            store.open_bundle(spark, bad, "secret")
    with pytest.raises(ValueError):
        store.open_bundle(spark, bundle, "wrong")
    with pytest.raises(ValueError):
        store.read_header(b"PK whatever")
    with pytest.raises(ValueError):
        store.pack(docs.limit(0), "k")
    assert not store.verify_signature(spark, bundle, store.generate_signing_key(spark)[1])


def test_folder_and_package(spark, tmp_path):
    root = tmp_path / "corpus"
    for name, text in {"Sent/a b.md": "---\nsource_format: pdf\n---\n\nHello pump", "Received/é.md": "leaf", "_x/no.md": "no", "00_INDEX.md": "no", "Other/00_x.md": "no"}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text, encoding="utf-8")
    docs = store.load_documents(spark, str(root))
    rows = {r["pseudopath"]: r for r in docs.collect()}
    assert set(rows) == {"@/Sent/a b.md", "@/Received/é.md"} and rows["@/Sent/a b.md"]["source"] == "SENT" and rows["@/Sent/a b.md"]["text"].strip() == "Hello pump"
    store.write_package(docs, str(tmp_path / "package"))
    package = store.read_package(spark, str(tmp_path / "package"))
    assert store.describe(package).first()["documents"] == 2 and store.document(package, "é").first()["text"] == "leaf\n"


def test_document_returns_every_one_of_a_name(spark):
    docs = spark.range(2500).selectExpr("id AS doc_id", "IF(id < 1500, 'README', 'other') AS name", "concat('@/Sent/', id, '/x.md') AS pseudopath")
    package = {"document": docs, "passage": spark.range(2500).selectExpr("id AS doc_id", "0 AS position", "concat('text ', id) AS text")}
    assert {(r["doc_id"], r["text"]) for r in store.document(package, "README").collect()} == {(k, f"text {k}\n") for k in range(1500)}
    assert store.document(package, "@/Sent/7/x.md").count() == 1


def _compare(spark, reference, markdown):
    return verify.compare(spark.createDataFrame([(1, reference, markdown)], "doc_id long, reference string, markdown string")).first()


def test_coverage(spark):
    assert _compare(spark, "a b c d", "| a | b |\n|---|---|\n| c | d |")["status"] == "ok"
    r = _compare(spark, "w " * 200 + "77 88", "w " * 200 + "77")
    assert r["status"] == "warn" and r["numeric_coverage"] == 0.5 and r["missing_sample"] == ["88"] and r["missing_tokens"] == 1
    r = _compare(spark, "", "some words")
    assert r["status"] == "no-reference" and not r["measurable"] and r["md_tokens"] == 2
    lines, rest = verify.recovered("alpha beta\ngamma delta\nzeta", "alpha beta gamma")
    assert lines == ["gamma delta", "zeta"] and rest == []


SAMPLES = ["", "plain\n", '---\ntitle: "x"\nsource: "a.pdf"\nsha256_origen: 1\n---\n\nbody\n', "|  a  |   |  b |\n|-----|---|----|\n| 1 |  | 2 |\n", "<!-- image -->\ntext\n\n\n\nmore   \n", "| a | b |\nbroken\n", "|   |   |\n|---|---|\n|   |   |\n"]


def test_compaction_keeps_words_and_is_idempotent(spark):
    once = lambda texts: [r["c"] for r in sorted(spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", compact.compact(F.col("t"))["text"].alias("c")).collect(), key=lambda r: r["i"])]
    first = once(SAMPLES)
    assert once(first) == first
    assert first[3] == "| a | b |\n|---|---|\n| 1 | 2 |\n" and first[2] == '---\nsource: "a.pdf"\n---\n\nbody\n' and first[4] == "text\n\nmore\n"
    for before, after in zip(SAMPLES, first):
        body = before.split("---", 2)[-1] if before.startswith("---") else before
        assert sorted(re.findall(r"\w+", re.sub("<!--.*?-->", "", body))) == sorted(re.findall(r"\w+", after.split("---", 2)[-1] if after.startswith("---") else after))


def test_chapters(spark):
    docs = spark.createDataFrame([(1, 59), (2, 60)], "doc_id long, pages long")
    assert [tuple(r)[1:] for r in planning.block_chapters(docs, F.col("pages")).orderBy("chapter").collect()] == [(1, 1, 25), (2, 26, 50), (3, 51, 60)]
    outline = [(1, 100, 1, "Whole", 3, 1), (1, 100, 2, "A", 5, 2), (1, 100, 2, "B", 5, 3), (1, 100, 2, "C", 40, 4)]
    found = planning.toc_chapters(spark.createDataFrame(outline, "doc_id long, pages long, level int, title string, page long, entry long"))
    assert [(r["title"], r["first_page"], r["last_page"]) for r in found.orderBy("chapter").collect()] == [("Front matter", 1, 4), ("B", 5, 39), ("C", 40, 100)]
    parts = planning.refined_chapters(found).orderBy("chapter").collect()
    assert [(r["title"], r["first_page"], r["last_page"]) for r in parts][-3:] == [("C", 40, 69), ("C (cont. 2)", 70, 99), ("C (cont. 3)", 100, 100)]


def test_manifest_partitions_documents(spark):
    rows = [(True, "ok", True, 1.0, 10, 0), (False, "fail", True, 0.5, 10, 5), (False, "no-reference", False, None, 0, 0), (False, "unread", False, None, 0, 0), (True, "only-ocr", False, None, 0, 0)]
    r = planning.manifest(spark.createDataFrame(rows, "ok boolean, status string, measurable boolean, coverage double, ref_tokens long, missing_tokens long")).first()
    assert (r["documents"], r["converted_ok"], r["unverifiable"], r["with_findings"], r["global_token_coverage"]) == (5, 2, 2, 1, 0.75)


def test_geometry(spark):
    values = spark.createDataFrame([(1, v) for v in (100.0, 101.5, 300.0)], "page int, v double")
    assert [r["centre"] for r in geometry.cluster(values, ("page",), "v").orderBy("island").collect()] == [100.75, 300.0]
    text = spark.createDataFrame([(i, 1, 1, c, 4.0 * i, 0.0, 4.0 * i + 4, 8.0) for i, c in enumerate("ab cd")], "idx int, doc_id int, page int, ch string, left double, bottom double, right double, top double")
    assert [(r["text"], r["left"], r["right"]) for r in geometry.words(text).orderBy("word").collect()] == [("ab", 0.0, 8.0), ("cd", 12.0, 20.0)]
    x = spark.createDataFrame([(1, 1, v) for v in (0.0, 10.0, 20.0)], "doc_id int, page int, x double")
    y = spark.createDataFrame([(1, 1, v) for v in (0.0, 8.0)], "doc_id int, page int, y double")
    assert {(r["row"], r["col"], r["text"]) for r in geometry.grid_cells(text, y, x).collect()} == {(0, 0, "ab"), (0, 1, "cd")}
    blocks = spark.createDataFrame([(1, 1, "a", 0.0, 100.0), (1, 1, "b", 50.0, 99.0), (1, 1, "c", 0.0, 90.0), (1, 1, "d", 0.0, 60.0)], "doc_id int, page int, text string, left double, top double")
    assert [r["text"] for r in geometry.paragraphs(blocks).orderBy("paragraph").collect()] == ["a b\nc", "d"]


@pytest.mark.parametrize(("line", "is_caption"), [("Table 3.1: x", True), ("Tabla 2 - x", True), ("Tabelle 4. x", True), ("see Table 3 for more", False), ("Tables are", False)])
def test_captions(spark, line, is_caption):
    assert spark.range(1).select(geometry.announces_table(F.lit(line)).alias("c")).first()["c"] is is_caption


def _zip(**files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in files.items():
            z.writestr(name, text)
    return out.getvalue()


W = 'xmlns:w="http://w"'
DOCX = _zip(**{"[Content_Types].xml": "<x/>", "word/document.xml": f'<w:document {W}><w:body><w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:r><w:t>Title</w:t></w:r></w:p><w:p><w:r><w:t>Text</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>cell</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'})
XLSX = _zip(**{"xl/workbook.xml": '<workbook><sheets><sheet name="S"/></sheets></workbook>', "xl/sharedStrings.xml": "<sst><si><t>head</t></si></sst>", "xl/worksheets/sheet1.xml": '<worksheet><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1"><v>7</v></c></row><row/></sheetData></worksheet>'})
EPUB = _zip(mimetype="application/epub+zip", **{"OEBPS/content.opf": '<package><manifest><item id="b" href="2.xhtml"/><item id="a" href="1.xhtml"/></manifest><spine><itemref idref="b"/><itemref idref="a"/></spine></package>', "OEBPS/1.xhtml": "<html><head><title>no</title></head><body>one</body></html>", "OEBPS/2.xhtml": "<p>two &amp; more</p>", "OEBPS/3.xhtml": "three"})


def test_readers():
    assert readers.docx_text(DOCX) == "Title\nText\ncell" and readers.docx_markdown(DOCX) == "## Title\n\nText\n\n| cell |\n|---|"
    assert readers.xlsx_text(XLSX) == "S\nhead\n7" and readers.xlsx_markdown(XLSX) == "## Sheet: S\n\n| head |  | 7 |\n|---|---|---|"
    assert readers.epub_text(EPUB) == "two & more\n\none\n\nthree"
    assert [readers.archive_format(c) for c in (DOCX, XLSX, EPUB, b"PK\x03\x04bad")] == ["docx", "xlsx", "epub", None]
    assert readers.decode("é".encode()) == "é" and readers.decode(b"\xe9") == "é"


def test_conversion(spark, tmp_path):
    for name, content in {"a.docx": DOCX, "wrong.txt": EPUB, "b.txt": b"plain words", "c.pdf": b"%PDF-1", "x.docx": b"PK\x03\x04bad", "skip.zip": b"no"}.items():
        (tmp_path / name).write_bytes(content)
    rows = {r["path"].rsplit("/", 1)[-1]: r for r in convert_folder(spark, str(tmp_path)).collect()}
    assert set(rows) == {"a.docx", "wrong.txt", "b.txt", "c.pdf", "x.docx"}
    assert rows["a.docx"]["ok"] and rows["wrong.txt"]["kind"] == "epub" and rows["b.txt"]["coverage"] == 1.0
    assert rows["c.pdf"]["status"] == "error" and "no reader" in rows["c.pdf"]["error"] and not rows["x.docx"]["ok"]
    again = convert_folder(spark, str(tmp_path), previous=spark.createDataFrame([(rows["a.docx"]["digest"],)], "digest string"))
    assert "a.docx" not in {r["path"].rsplit("/", 1)[-1] for r in again.collect()}


def test_stream(spark, tmp_path):
    spark.createDataFrame([(1, "s", "one pump\n\ntwo"), (2, "s", "three")], "doc_id long, source string, text string").write.parquet(str(tmp_path / "in"))
    run = ingest.ingest(ingest.document_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "check"), once=True)
    run.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3


def test_rank_fusion_ignores_payload_order(spark):
    from corpusloom.operators import fuse

    rows = [(0, 1, "a"), (0, 2, "b"), (1, 1, "b"), (1, 2, "c")]
    random.Random(1).shuffle(rows)
    found = fuse.fuse(spark.createDataFrame(rows, "list_id int, place int, key string"), ("key",)).orderBy("position").collect()
    assert [r["key"] for r in found] == ["b", "a", "c"] and found[0]["score"] == round(1 / 62 + 1 / 61, 9)


def test_table_in_a_band(spark):
    rows = [(1, 1, k, w, x, x + 30.0, 100.0 - 12 * k) for k in range(4) for w, x in ((f"name{k}", 10.0), (f"{k}", 120.0))]
    words = spark.createDataFrame(rows, "doc_id int, page int, line int, text string, left double, right double, top double")
    boxes = words.selectExpr("doc_id", "page", "left", "right", "top - 10 AS bottom", "top", "200.0 AS width")
    found = geometry.band_tables(words, boxes).first()["markdown"]
    assert found.split("\n")[:3] == ["| name0 | 0 |", "|---|---|", "| name1 | 1 |"]
    prose = words.withColumn("right", F.when(F.col("left") < 50, 125.0).otherwise(F.col("right")))
    assert geometry.band_tables(prose, boxes).count() == 0
    rules = spark.createDataFrame([(1, 1, 100.0, 800.0), (1, 1, 400.0, 800.0), (1, 2, 100.0, 800.0), (1, 2, 110.0, 800.0)], "doc_id int, page int, y double, height double")
    assert [(r["page"], r["low"], r["high"]) for r in geometry.bands(rules).collect()] == [(1, 100.0, 400.0)]


def test_encoding(spark):
    import numpy as np

    from corpusloom.operators import encode

    for lengths in ([10] * 500 + [2000], [90_000], [5] * 5000):
        made = list(encode.batches(lengths))
        assert sorted(i for b in made for i in b) == list(range(len(lengths)))
        assert all(len(b) == 1 or len(b) * max(lengths[i] for i in b) <= encode.BUDGET and len(b) <= encode.MAX_ROWS for b in made)
    make = lambda: lambda texts: np.array([[len(t), 1.0] for t in texts])
    parts = spark.createDataFrame([(1, "aaa"), (2, "b")], "passage_id long, text string")
    first = encode.encode_incrementally(parts, None, make, "m").cache()
    assert abs(first.filter("passage_id = 1").first()["vector"][0] - 3 / 10**0.5) < 1e-6
    again = encode.encode_incrementally(parts.union(spark.createDataFrame([(3, "aaa")], parts.schema)), first, make, "m", "m")
    assert again.count() == 3


def test_planning_rules(spark):
    row = spark.range(1).select(
        planning.engine_order(F.lit("pdf"), F.lit(True), F.lit(False)).alias("scan"), planning.engine_order(F.lit("pdf"), F.lit(False), planning.is_drawing(F.lit("pdf"), F.lit(1), F.lit(2))).alias("drawing"),
        planning.slug(F.lit(3), F.lit(' a/b: "c" '), F.lit(1), F.lit(9)).alias("slug"), planning.slug(F.lit(3), F.lit("??"), F.lit(1), F.lit(9)).alias("bare"),
    ).first()
    assert row["scan"] == ["layout-ocr", "native"] and row["drawing"] == ["native"] and row["slug"] == "03 - a b c" and row["bare"] == "03 - Paginas 1-9"
    pages = spark.createDataFrame([(1, 1, "x" * 30, 0), (1, 2, " a ", 1)], "doc_id int, page int, text string, images int")
    assert planning.page_summary(pages).first()["needs_ocr"]
    chapters = spark.createDataFrame([(1, 1, 1, 1), (1, 2, 2, 5)], "doc_id int, chapter int, first_page int, last_page int")
    assert [(r["page"], r["chapter"]) for r in planning.page_ranges(pages, chapters).orderBy("page").collect()] == [(1, 1), (2, 2)]
