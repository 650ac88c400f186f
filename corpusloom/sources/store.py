"""Corpus folders and packages: Markdown in, Parquet tables inside, one encrypted file out.

A package at work is a folder of Parquet tables (document, passage, term,
statistics). The bundle is the same content as a single file for exchange: a
clear header, and a body that is compressed and encrypted with AES-GCM under
a key derived by scrypt. A bundle is bounded by what one machine can hold; the
folder isn't.
"""

from __future__ import annotations

import hashlib
import json
import lzma
import os
import struct
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import index
from . import readers

MAGIC = b"CLOM"
SCRYPT = {"n": 1 << 15, "r": 8, "p": 1}
TABLES = ("document", "passage", "term", "statistics")


def load_documents(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, name, pseudopath, source, folder, text) of a folder's Markdown files.

    Files named 00_* and folders named _* are not documents; a front matter is left out of text.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").load(folder)
    found = files.select(readers.relative(spark, folder).alias("rel"), F.decode("content", "UTF-8").alias("whole"))
    found = found.filter(~F.col("rel").startswith("_") & ~F.col("rel").rlike(r"(^|/)00_[^/]*$"))
    second = F.locate("---", F.col("whole"), 4)
    text = F.when(F.col("whole").startswith("---") & (second > 0), F.substring("whole", second + 3, F.length("whole"))).otherwise(F.col("whole"))
    name = F.regexp_replace(F.regexp_extract("rel", r"([^/]*)$", 1), r"\.md$", "")
    parent = F.when(F.col("rel").contains("/"), F.regexp_extract("rel", r"^(.*)/[^/]*$", 1)).otherwise(".")
    return found.select(F.xxhash64("rel").alias("doc_id"), name.alias("name"), T.to_pseudopath(F.col("rel")).alias("pseudopath"), T.direction(F.split_part("rel", F.lit("/"), F.lit(1))).alias("source"), parent.alias("folder"), text.alias("text"))


def tables(docs: DataFrame, splitter: str = "block") -> dict[str, DataFrame]:
    """The package's tables as DataFrames."""
    tokens = index.tokenized(index.passages(docs.select("doc_id", "text"), splitter))
    return {"document": docs, "passage": tokens.select("doc_id", "position", "text", "norm", "tokens", "length"), "term": index.term_frequencies(tokens), "statistics": index.statistics(tokens)}


def write_package(docs: DataFrame, folder: str, splitter: str = "block") -> None:
    """The tables as Parquet; terms sorted, so that a query's terms prune row groups. An empty corpus is refused."""
    if docs.isEmpty():
        raise ValueError("there are no documents to pack")
    spark = docs.sparkSession
    docs.write.mode("overwrite").parquet(f"{folder}/document")
    tokens = index.tokenized(index.passages(spark.read.parquet(f"{folder}/document").select("doc_id", "text"), splitter))
    tokens.select("doc_id", "position", "text", "norm", "tokens", "length").write.mode("overwrite").parquet(f"{folder}/passage")
    stored = spark.read.parquet(f"{folder}/passage")
    index.term_frequencies(stored).sortWithinPartitions("term").write.mode("overwrite").parquet(f"{folder}/term")
    index.statistics(stored).write.mode("overwrite").parquet(f"{folder}/statistics")


def read_package(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{folder}/{name}") for name in TABLES}


def joined(parts: DataFrame) -> DataFrame:
    """(doc_id, text): passages in order, blank lines between, a newline at the end."""
    ordered = F.sort_array(F.collect_list(F.struct("position", "text")))
    return parts.groupBy("doc_id").agg(F.concat(F.array_join(F.transform(ordered, lambda x: x["text"]), "\n\n"), F.lit("\n")).alias("text"))


def describe(package: dict[str, DataFrame]) -> DataFrame:
    """One row: documents, passages, terms."""
    count = lambda name: package[name].agg(F.count("*").alias(f"{name}s"))
    return count("document").crossJoin(count("passage")).crossJoin(count("term"))  # one row each


def document(package: dict[str, DataFrame], name: str) -> DataFrame:
    """(doc_id, text) of the documents of this name or pseudopath."""
    wanted = package["document"].filter((F.col("name") == name) | (F.col("pseudopath") == name)).select("doc_id")
    return joined(package["passage"].join(wanted, "doc_id", "left_semi"))


# --- bundles ----------------------------------------------------------------------------------


def derive_key(secret: str, salt: bytes) -> bytes:
    return hashlib.scrypt(secret.encode(), salt=salt, dklen=32, maxmem=1 << 27, **SCRYPT)


def _cipher(spark: SparkSession, mode: int, key: bytes, nonce: bytes, data: bytes) -> bytes:
    """AES-256-GCM by the JVM's own provider."""
    jvm = spark._jvm
    cipher = jvm.javax.crypto.Cipher.getInstance("AES/GCM/NoPadding")
    cipher.init(mode, jvm.javax.crypto.spec.SecretKeySpec(key, "AES"), jvm.javax.crypto.spec.GCMParameterSpec(128, nonce))
    return bytes(cipher.doFinal(data))


def generate_signing_key(spark: SparkSession) -> tuple[str, str]:
    """(private, public) Ed25519 keys, base64."""
    import base64

    jvm = spark._jvm
    pair, factory = jvm.java.security.KeyPairGenerator.getInstance("Ed25519").generateKeyPair(), jvm.java.security.KeyFactory.getInstance("Ed25519")
    kinds = ((pair.getPrivate(), "PKCS8EncodedKeySpec"), (pair.getPublic(), "X509EncodedKeySpec"))  # the keys' own classes aren't public
    return tuple(base64.b64encode(bytes(factory.getKeySpec(k, jvm.java.lang.Class.forName(f"java.security.spec.{spec}")).getEncoded())).decode() for k, spec in kinds)


def _signature(spark: SparkSession, digest: str, private: str) -> str:
    import base64

    jvm = spark._jvm
    key = jvm.java.security.KeyFactory.getInstance("Ed25519").generatePrivate(jvm.java.security.spec.PKCS8EncodedKeySpec(base64.b64decode(private)))
    signer = jvm.java.security.Signature.getInstance("Ed25519")
    signer.initSign(key)
    signer.update(digest.encode())
    return base64.b64encode(bytes(signer.sign())).decode()


def pack(docs: DataFrame, key: str, issuer: str = "", splitter: str = "block", signing: tuple[str, str] | None = None) -> bytes:
    """The bundle of a corpus that fits one machine."""
    spark = docs.sparkSession
    made = tables(docs, splitter)
    content = {name: [r.asDict(recursive=True) for r in made[name].collect()] for name in ("document", "passage")}  # a bundle is one file, hence one machine's
    if not content["document"]:
        raise ValueError("there are no documents to pack")
    salt, nonce = os.urandom(16), os.urandom(12)
    body = _cipher(spark, 1, derive_key(key, salt), nonce, lzma.compress(json.dumps(content).encode(), preset=6))
    digest = hashlib.sha256(body).hexdigest()
    language, confidence = T.detect_language_of(" ".join(d["text"][:4000] for d in content["document"][:40]))
    header = {
        "file_format": 1, "issuer": issuer, "created_utc": datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ"), "documents": len(content["document"]), "passages": len(content["passage"]),
        "language": language, "language_confidence": round(confidence, 3), "encryption": "AES-256-GCM", "key_derivation": {"alg": "scrypt", **SCRYPT}, "compression": "lzma", "salt": salt.hex(), "nonce": nonce.hex(), "body_digest": digest,
    }
    if signing:
        header |= {"signature": _signature(spark, digest, signing[0]), "public_key": signing[1]}
    head = json.dumps(header).encode()
    return MAGIC + struct.pack("<I", len(head)) + head + body


def read_header(bundle: bytes) -> dict:
    """The clear header, with intact, signed and body_bytes. Other files raise ValueError."""
    if bundle[:4] != MAGIC or len(bundle) < 8:
        raise ValueError("this is no corpus bundle")
    (size,) = struct.unpack("<I", bundle[4:8])
    try:
        header = json.loads(bundle[8 : 8 + size])
    except ValueError as e:
        raise ValueError("the bundle's header is damaged") from e
    body = bundle[8 + size :]
    return header | {"intact": hashlib.sha256(body).hexdigest() == header.get("body_digest"), "signed": bool(header.get("signature")), "body_bytes": len(body)}


def open_bundle(spark: SparkSession, bundle: bytes, key: str) -> tuple[dict, dict[str, DataFrame]]:
    """(header, document and passage tables). A wrong key or a changed body raises ValueError."""
    header = read_header(bundle)
    if not header["intact"]:
        raise ValueError("the bundle was changed after it was packed")
    (size,) = struct.unpack("<I", bundle[4:8])
    try:
        raw = _cipher(spark, 2, derive_key(key, bytes.fromhex(header["salt"])), bytes.fromhex(header["nonce"]), bundle[8 + size :])
    except Exception as e:
        raise ValueError("the key doesn't open this bundle") from e
    content = json.loads(lzma.decompress(raw))
    schemas = {"document": "doc_id long, name string, pseudopath string, source string, folder string, text string", "passage": "doc_id long, position int, text string, norm string, tokens array<string>, length int"}
    order = lambda schema: [c.split()[0] for c in schema.split(", ")]
    return header, {name: spark.createDataFrame([tuple(row.get(c) for c in order(s)) for row in content[name]], s) for name, s in schemas.items()}


def verify_signature(spark: SparkSession, bundle: bytes, public: str | None = None) -> bool:
    """Whether the body is intact and its digest is signed by the public key (the header's own if none is given)."""
    import base64

    header = read_header(bundle)
    if not (header["intact"] and header["signed"]):
        return False
    jvm = spark._jvm
    try:
        key = jvm.java.security.KeyFactory.getInstance("Ed25519").generatePublic(jvm.java.security.spec.X509EncodedKeySpec(base64.b64decode(public or header["public_key"])))
        checker = jvm.java.security.Signature.getInstance("Ed25519")
        checker.initVerify(key)
        checker.update(header["body_digest"].encode())
        return bool(checker.verify(base64.b64decode(header["signature"])))
    except Exception:  # a key or signature that can't be read verifies nothing
        return False


def export(package: dict[str, DataFrame]) -> DataFrame:
    """(path, text): the Markdown files of a package."""
    path = F.concat(T.from_pseudopath(F.col("pseudopath")))
    return joined(package["passage"]).join(package["document"].select("doc_id", path.alias("path")), "doc_id").select("path", "text")


