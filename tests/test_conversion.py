import json

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import planning, verify
from corpusloom.plans import report
from corpusloom.plans.convert import convert_folder
from corpusloom.sources import readers


def _fails(content):
    raise RuntimeError("no device")


SIX = "one two three four five six"


def test_engines_run_in_order_until_one_is_good_enough():
    ran = []

    def engine(name, made):
        return name, lambda content: ran.append(name) or made

    found = readers.attempted(b"", SIX, [engine("native", (SIX, {"unresolved": [1]})), engine("hybrid", f"# one\n\n{SIX[4:]}"), engine("layout", "never run")])
    assert ran == ["native", "hybrid"] and found["engine"] == "hybrid" and [a["status"] for a in found["attempts"]] == ["ok", "ok"]
    ran.clear()
    found = readers.attempted(b"", SIX, [engine("native", ("# " + SIX, {"unresolved": [], "sidecar": {"a": 1}})), engine("hybrid", "x")])
    assert ran == ["native"] and json.loads(found["sidecar"]) == {"a": 1}
    found = readers.attempted(b"", SIX, [("native", _fails), engine("layout", SIX[:13])])
    assert found["engine"] == "layout" and found["error"] is None and found["attempts"][0]["error"] == "RuntimeError: no device"
    found = readers.attempted(b"", SIX, [("native", _fails)])
    assert found["engine"] == "none" and "no device" in found["error"]
    # A text with structure that lost most words isn't usable, however structured.
    assert readers.attempted(b"", SIX, [engine("native", SIX), engine("layout", "# one\n\n- two")])["engine"] == "native"


@pytest.mark.parametrize(("reference", "markdown"), [("", ""), ("", "words"), (SIX, SIX), ("w " * 200 + "77 88", "w " * 200 + "77"), ("a b c", "a"), ("a b", "| a | b |\n|---|---|\n")])
def test_verdict_in_a_task_is_the_engine_verdict(spark, reference, markdown):
    here = verify.judged(reference, markdown)
    there = verify.compare(spark.createDataFrame([(1, reference, markdown)], "doc_id long, reference string, markdown string")).first()
    assert (here["status"], here["coverage"]) == (there["status"], there["coverage"])
    assert here["structured"] == spark.range(1).select(verify.structure(F.lit(markdown)).alias("s")).first()["s"]


@pytest.fixture
def folder(tmp_path):
    source = tmp_path / "in"
    for name, content in {
        "a b+c.txt": b"plain words", "Sub/a.HTML": b"<h1>T</h1><p>text</p>", "Sub/a.txt": b"other", "Sub/scan.pdf": b"%PDF-1\n", "Sub/book.pdf": b"%PDF-1\n" + SIX.encode(), "x.docx": b"PK\x03\x04bad", "skip.zip": b"no",
    }.items():
        (source / name).parent.mkdir(parents=True, exist_ok=True)
        (source / name).write_bytes(content)
    return source


def _convert(spark, folder, **options):
    def fails(content):  # functions of a test module can't be imported by a worker
        raise RuntimeError("no device")

    words = lambda content: content.decode("latin-1").removeprefix("%PDF-1\n")
    engines = {"native": lambda c: (words(c)[:13], {"unresolved": [1], "pages": 2}), "layout": lambda c: (f"# {words(c)}", {"sidecar": {"n": len(c)}}), "layout-ocr": fails, "hybrid": fails}
    return convert_folder(spark, str(folder), extractors=readers.EXTRACTORS | {"pdf": words}, converters=readers.CONVERTERS | {"pdf": engines}, **options)


def test_tree_and_reports(spark, folder, tmp_path):
    records = _convert(spark, folder)
    rows = {r["rel"]: r for r in records.collect()}
    assert set(rows) == {"a b+c.txt", "Sub/a.HTML", "Sub/a.txt", "Sub/scan.pdf", "Sub/book.pdf", "x.docx"}
    book, scan = rows["Sub/book.pdf"], rows["Sub/scan.pdf"]
    assert book["engine"] == "layout" and book["failed_engines"] == ["hybrid"] and book["ok"] and [a["engine"] for a in book["attempts"]] == ["native", "hybrid", "layout"]
    assert [a["engine"] for a in scan["attempts"]] == ["layout-ocr", "native"] and scan["status"] == "unread" and not scan["ok"]
    assert {rows["Sub/a.HTML"]["target"], rows["Sub/a.txt"]["target"]} == {"Sub/a__html.md", "Sub/a__txt.md"}
    target = tmp_path / "out"
    skipped = spark.createDataFrame([("skip.zip",)], "rel string")
    totals = report.write_tree(records, str(target), skipped)
    assert totals["documents"] == 6 and totals["written"] == 5 and totals["sidecar_errors"] == 0 and totals["engines"] == ["hybrid", "layout-ocr", "native"]
    assert {p.relative_to(target).as_posix() for p in target.rglob("*") if p.is_file()} == {
        "00_INDEX.md", "_manifest.json", "results.txt", "a b+c.md", "Sub/a__html.md", "Sub/a__txt.md", "Sub/scan.md", "Sub/book.md", "_structure/Sub/book.json",
    }
    text = (target / "a b+c.md").read_text()
    assert text.startswith('---\nsource: "a b+c.txt"\n') and text.endswith("---\n\n# a b+c\n\nplain words\n")
    manifest = json.loads((target / "_manifest.json").read_text())
    assert [d["rel"] for d in manifest["documents"]] == sorted(rows) and manifest["summary"]["with_failed_engines"] == 3
    index = (target / "00_INDEX.md").read_text()
    assert "[a b+c.md](a%20b%2Bc.md)" in index and "- `" not in index and "- @/skip.zip" in index
    assert index.index("@/a b+c.txt") < index.index("## To look at") < index.index("- @/skip.zip")
    results = (target / "results.txt").read_text()
    assert results.index("To look at") < results.index("@/x.docx") < results.index("Conforming\n") < results.index("@/Sub/book.pdf")


def test_progress_of_an_interrupted_run(spark, folder, tmp_path):
    target = str(tmp_path / "out")
    assert report.finished(spark, target).count() == 0
    records = _convert(spark, folder)
    report.write_files(report.documents(records.filter("kind = 'text'")), target).count()
    with open(next((tmp_path / "out" / "_progress").glob("*.jsonl")), "a") as f:
        f.write('{"target": "cut')
    done = report.finished(spark, target)
    assert {r["target"] for r in done.collect()} == {"a b+c.md", "Sub/a__txt.md"}
    assert {r["kind"] for r in _convert(spark, folder, previous=done.select("digest")).collect()} == {"html", "pdf", "docx"}
    with pytest.raises(Exception, match="outside the target folder"):
        report.write_files(spark.createDataFrame([("../x.md", "t", "d", None)], "target string, text string, digest string, sidecar string"), target).count()


def test_only_and_limit(spark, folder):
    assert {r["rel"] for r in _convert(spark, folder, only="*.html").collect()} == {"Sub/a.HTML"}
    assert {r["rel"] for r in _convert(spark, folder, only="[ab]*.TXT", limit=1).collect()} == {"Sub/a.txt"}


def test_document_index(spark):
    schema = "target string, source string, chapter int, title string, chapter_target string, first_page long, last_page long, ok boolean, status string, coverage double, ref_tokens long, missing_tokens long"
    rows = [("A/b.md", "b", 2, "x | y", "A/b/02 - x.md", 11, 12, False, "fail", 0.5, 10, 5), ("A/b.md", "b", 1, "One", "A/b/01 - One.md", 1, 10, True, "ok", 1.0, 90, 0)]
    text = report.document_indexes(spark.createDataFrame(rows, schema)).first()["text"]
    assert "Pages: 12. Chapters: 2, conforming: 1. Fidelity: 95.00%" in text
    assert text.endswith("| 1 | [One](b/01%20-%20One.md) | 1-10 | 100.00% | conforming |\n| 2 | [x \\| y](b/02%20-%20x.md) | 11-12 | 50.00% | incomplete |\n")


def test_links_targets_and_glossary(spark, tmp_path):
    cases = [(".", "a b.md", "a%20b.md"), ("A", "A/x.md", "x.md"), ("A/B", "A/C/x.md", "../C/x.md"), ("A", "x.md", "../x.md"), (".", "A/é+.md", "A/%C3%A9%2B.md")]
    made = spark.createDataFrame(cases, "folder string, target string, want string").select("want", T.relative_link(F.col("folder"), F.col("target")).alias("got"))
    assert all(r["want"] == r["got"] for r in made.collect())
    jobs = spark.createDataFrame([("é.txt",), ("É.pdf",), ("f.txt",)], "path string")
    assert sorted(r["target"] for r in planning.targets(jobs).collect()) == sorted(["é__txt.md", "É__pdf.md", "f.md"])
    file = tmp_path / "g.json"
    file.write_text('{"Pump": ["motor"], "of": []}')
    assert T.load_glossary(str(file)) == {"pump": ["motor"], "of": []}
    for bad in ("[]", '{"a": "b"}'):
        file.write_text(bad)
        with pytest.raises(ValueError):
            T.load_glossary(str(file))
