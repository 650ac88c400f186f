"""The pipeline against its stages in plain Python, and the registered SQL against the queries."""

import os
import re
import zlib
from collections import defaultdict

import brute
import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from corpusloom.llm import queries, secrets
from corpusloom.llm.components import local_roots

SF = "/root/testdata/sf0.001"


def test_every_operator_is_registered():
    names = {n.split("_")[0] for n in queries.QUERIES}
    assert names == {f"op{k}" for k in range(1, 11)} and "pipeline" in __spark_entry__.queries()


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(queries.ORACLE_SQL[name])
    columns = sorted(want.columns)
    got = queries.QUERIES[name](spark, SF).select(*columns).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want.select(", ".join(columns)).fetchall()))


def _brute_pipeline(docs):
    """What is left of (doc_id, text, source) rows before packing."""
    worded = lambda t: [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    key = lambda x: re.sub("[0-9]", "0", re.sub(r"[\x20\x09-\x0D]+", " ", x.lower())).strip(" ")
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t)
    held = defaultdict(set)
    for _, text, host in docs:
        for x in worded(text):
            held[host, key(x)].add(text)
    often = {k for k, texts in held.items() if len(texts) > 30}
    marked = {host for host, _ in often}
    kept = []
    for doc_id, text, host in docs:
        n, left = len(words(text)), sum(len(words(x)) for x in worded(text) if (host, key(x)) not in often)
        if n < 10 or 100 * brute.repeated_words(words(text)) > 20 * n or host in marked and (left < 10 or left < 0.3 * n):
            continue
        kept.append((doc_id, "\n".join(x for x in text.split("\n") if (host, key(x)) not in often)))
    shorter = sorted(brute.thinned(dict(kept)).items())
    prints = np.array([brute.fingerprint(t) for _, t in shorter], np.uint64)
    a, b = np.nonzero(np.triu(np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 3, 1))
    roots = local_roots(len(shorter), a, b)
    return [(i, secrets.redacted(t)) for k, (i, t) in enumerate(shorter) if roots[k] == k]


def test_pipeline_against_brute_force(spark):
    rows = [(r["doc_id"], r["text"], r["source"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = set()
    for doc_id, text in _brute_pipeline(rows):
        ids = [*library.encode(text, add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), 2048):
            want.add((doc_id, k // 2048, k, len(ids[k : k + 2048]), zlib.crc32(np.array(ids[k : k + 2048], "<u4").tobytes())))
    got = corpus_pipeline.run(spark, SF).collect()
    assert {tuple(r)[:5] for r in got} == want and len(got) == len(want)
    places = defaultdict(list)
    for r in got:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(places) <= 1.02 * -(-sum(r["length"] for r in got) // 2048) + 1


def test_stages_return_documents(spark, tmp_path):
    kept = spark.read.parquet(f"{SF}/documents.parquet")
    columns = kept.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        was = {r["doc_id"] for r in kept.select("doc_id").collect()}
        stage(spark, kept, SF).write.parquet(f"{tmp_path}/{name}")
        kept = spark.read.parquet(f"{tmp_path}/{name}")
        ids = {r["doc_id"] for r in kept.select("doc_id").collect()}
        assert kept.columns == columns and ids <= was and (name not in ("line_dedup", "secret_scan") or ids == was)


def test_stages_on_odd_rows(spark, tmp_path):
    prose = "\n".join(" ".join(f"w{j}x{k}" for k in range(12)) for j in range(6))
    other = prose.replace("w5x", "v5x")
    rows = [(1, None, "en", None, 0), (2, "", None, "a", 0), (3, prose, "en", "a", 0), (3, prose, "en", "a", 0), (3, prose.replace("w", "u"), "en", "a", 0), (None, prose, "en", "a", 0), (4, other, None, None, None), (5, "long words here " * 30000, "en", "a", 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    clashing = ("_id", "_gone", "_out", "_host", "_frequent", "gone", "of_id", "of_text", "quality", "fp", "n_lines", "hash")
    for with_rows in (rows, []):
        kept = spark.createDataFrame(with_rows, schema)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            wide = kept.select("*", *[F.lit(name).alias(c) for c in clashing])
            stage(spark, wide, SF).write.parquet(f"{tmp_path}/{len(with_rows)}-{name}")
            kept = spark.read.schema(schema).parquet(f"{tmp_path}/{len(with_rows)}-{name}")
            assert kept.columns == schema.replace(",", "").split()[::2]
        left = kept.collect()
        packed = corpus_pipeline.STAGES[-1][1](spark, kept, SF).collect()
        assert len(packed) >= len(left)
        if with_rows:  # both texts of id 3 stay, each once; a null id is never a copy of another
            assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in left if r["doc_id"] != 4) == [(False, 3), (False, 3), (True, 0)]
            assert {r["text"] for r in left if r["doc_id"] == 3} == {prose, prose.replace("w", "u")}


@pytest.mark.parametrize("dropped", [(), ("corpus_pipeline.py",)])
def test_entry_survives_without_the_operators(tmp_path, dropped):
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.abspath(__spark_entry__.__file__))
    shutil.copytree(root, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", *dropped))
    code = "import __spark_entry__ as e; assert e.queries() and not any(n.startswith('op') or n == 'pipeline' for n in e.queries())"
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r").returncode == 0
