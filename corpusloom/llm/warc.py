"""WARC archives: written with an index, read back by coalesced byte ranges.

Writing. Equal payloads of at least `MIN_REVISIT` bytes are stored once, in the
record with the largest id; the others become revisit records that refer to
it. Each task writes archives of its own (one gzip member a record, a new file
after `ROLL_BYTES`) and returns the index: file, offset, length, URL, digest.
File names are unique to the attempt, and only the index rows of attempts that
succeed are committed, so a lost executor leaves at most files that no index
row names.

Reading. The index comes first: select its rows, sort them by file and offset,
merge neighbours into ranges (gaps up to `GAP_BYTES`, ranges up to
`RANGE_BYTES`), and fetch each range with one read; records are cut out of it
and parsed. Nothing scans an archive.

Files are reached through pyarrow's file systems, by URI, so the folder may lie
in any store that driver and executors share.

Rows: null html is an empty payload, a null url an empty target. A null id is
never referred to unless all ids of a group are null. Repeated rows each get a
record. An empty table gives an empty index. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_path, sized_broadcast, staged

MIN_REVISIT = 1000
ROLL_BYTES = 1 << 30
GAP_BYTES = 64 << 10
RANGE_BYTES = 8 << 20
DATE = "2000-01-01T00:00:00Z"
_SPACE = uuid.UUID("3f0c2b8e-6a55-4f0e-9d7a-5d6a0b3c9e11")

INDEX = "page_id long, url string, file string, offset long, length long, payload_digest string, record_type string, refers_to long"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _qualified(spark: SparkSession, path: str) -> str:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    whole = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(hadoop).toString()
    return whole.replace("file:/", "file:///", 1) if whole.startswith("file:/") and not whole.startswith("file://") else whole


def _name(page_id: int | None, url: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{page_id} {url}')}>"


def _one_line(value: str) -> str:
    return value.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A") if "\r" in value or "\n" in value else value


def record_bytes(page_id: int | None, url: str, payload: bytes, record_type: str, refers_to: int | None, date: str = DATE) -> bytes:
    """One record as a gzip member."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if record_type == "response" else b"")
    fields = [
        ("WARC-Type", record_type),
        ("WARC-Record-ID", _name(page_id, url)),
        ("WARC-Date", date),
        ("WARC-Target-URI", _one_line(url)),
        ("Content-Type", "application/http;msgtype=response"),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("X-Page-Id", "" if page_id is None else str(page_id)),
    ]
    if record_type == "revisit":
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("X-Refers-To-Page-Id", "" if refers_to is None else str(refers_to))]
    fields.append(("Content-Length", str(len(block))))
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    pack = zlib.compressobj(3, wbits=31)
    return pack.compress(head.encode() + block + b"\r\n\r\n") + pack.flush()


def parse_record(raw: bytes) -> dict:
    """The fields and payload of one gzip member; a revisit's payload is None. Damage raises ValueError."""
    whole = zlib.decompress(raw, wbits=31)
    head, _, rest = whole.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("no WARC record at this offset")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines)
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(line.split(b":")[1]) for line in http.split(b"\r\n") if line.lower().startswith(b"content-length:"))
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    response = fields["WARC-Type"] == "response"
    if response and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError("the payload doesn't match its digest")
    number = lambda k: int(fields[k]) if fields.get(k) else None
    url = fields["WARC-Target-URI"]
    url = url.replace("%0D", "\r").replace("%0A", "\n").replace("%25", "%") if "%0D" in url or "%0A" in url else url
    return {"page_id": number("X-Page-Id"), "url": url, "payload_bytes": size, "payload_digest": digest, "record_type": fields["WARC-Type"], "refers_to": number("X-Refers-To-Page-Id"), "payload": payload if response else None}


def with_revisits(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, html, record_type, refers_to."""
    body = F.encode(F.coalesce(F.col(f"`{html_col}`"), F.lit("")), "UTF-8")
    rows = pages.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").alias("url"), F.col(f"`{html_col}`").alias("html"), F.when(F.length(body) >= MIN_REVISIT, F.sha2(body, 256)).alias("key"))
    shared = rows.filter("key IS NOT NULL").groupBy("key").agg(F.max("page_id").alias("keeper"), F.count("*").alias("n")).filter("n > 1").select("key", "keeper")
    # Small payloads have no key; they would all meet in one partition of a shuffled join.
    found = rows.filter("key IS NOT NULL").join(sized_broadcast(staged(shared, "shared-payloads")), "key", "left")
    again = F.col("keeper").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keeper"))
    found = found.select("page_id", "url", "html", F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("keeper")).alias("refers_to"))
    small = rows.filter("key IS NULL").select("page_id", "url", "html", F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to"))
    return found.unionByName(small)


def write(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write the archives and return their committed index."""
    spark = pages.sparkSession
    uri = _qualified(spark, folder or shared_path(spark, "warc"))

    def store(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = _filesystem(uri)
        fs.create_dir(base, recursive=True)
        attempt, part, out, at = uuid.uuid4().hex, 0, None, 0
        try:
            for pdf in batches:
                rows = []
                for page_id, url, page, kind, refers in pdf.itertuples(index=False):
                    if out is None or at >= ROLL_BYTES:
                        if out is not None:
                            out.close()
                        name = f"part-{attempt}-{part:05d}.warc.gz"
                        out, at, part = fs.open_output_stream(f"{base}/{name}", compression=None), 0, part + 1
                    page_id, refers = (None if pd.isna(x) else int(x) for x in (page_id, refers))
                    payload = (page or "").encode()
                    raw = record_bytes(page_id, url or "", payload, kind, refers)
                    out.write(raw)
                    rows.append((page_id, url, name, at, len(raw), hashlib.sha1(payload).hexdigest(), kind, refers))
                    at += len(raw)
                yield pd.DataFrame(rows, columns=["page_id", "url", "file", "offset", "length", "payload_digest", "record_type", "refers_to"]).astype({"page_id": "Int64", "refers_to": "Int64"})
        finally:
            if out is not None:
                out.close()

    index = with_revisits(pages, id_col, url_col, html_col).mapInPandas(store, INDEX)
    return staged(index.withColumn("file", F.concat(F.lit(f"{uri}/"), "file")), "warc-index")


def ranges(index: DataFrame, gap: int = GAP_BYTES, most: int = RANGE_BYTES) -> DataFrame:
    """(file, start, end, records): the selected records as coalesced byte ranges."""
    order = Window.partitionBy("file").orderBy("offset")
    before = F.lag(F.col("offset") + F.col("length")).over(order)
    block = F.floor(F.col("offset") / most)
    opens = before.isNull() | (F.col("offset") - before > gap) | (block != F.lag(block).over(order))
    numbered = index.select("file", "offset", "length", opens.cast("long").alias("opens"))
    numbered = numbered.withColumn("range", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("file", "range").agg(
        F.min("offset").alias("start"), F.max(F.col("offset") + F.col("length")).alias("end"), F.sort_array(F.collect_list(F.struct("offset", "length"))).alias("records")
    )


def read(index: DataFrame, payloads: bool = True) -> DataFrame:
    """The selected records. A revisit has the size and digest of the payload that it stands for, but no payload."""

    def fetch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for file, start, end, records in pdf.itertuples(index=False):
                fs, path = _filesystem(file)
                with fs.open_input_file(path) as f:
                    f.seek(int(start))
                    data = f.read(int(end - start))
                rows = [parse_record(data[r["offset"] - start : r["offset"] - start + r["length"]]) for r in records]
                out = pd.DataFrame(rows).astype({"page_id": "Int64", "refers_to": "Int64"})
                if not payloads:
                    out["payload"] = None
                yield out

    parts = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Ranges are small rows that stand for much reading; a fixed number of partitions keeps them from being put together.
    dealt = ranges(index).select("file", "start", "end", "records").repartition(parts, "file", "start")
    return dealt.mapInPandas(fetch, RECORD)


def resolve(index: DataFrame, payload_index: DataFrame) -> DataFrame:
    """Records of index with payloads: those of revisits come from the responses that they refer to, found in payload_index."""
    own = read(index)
    kept = read(payload_index.filter("record_type = 'response'")).select(F.col("page_id").alias("kept_id"), F.col("payload").alias("kept_payload"))
    found = own.join(kept, F.col("refers_to") == F.col("kept_id"), "left")
    return found.withColumn("payload", F.coalesce("payload", "kept_payload")).drop("kept_id", "kept_payload")
