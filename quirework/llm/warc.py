"""WARC archives with a two-level capture index.

Writing: one record per page, assembled by SQL functions and written by the
text writer with the record separator as line separator, so archives go to any
file system Spark writes to. A payload that several records share is stored
once, on the record of the largest page id; the others are revisits of it.

Index: reading the archives gives one entry per record (file, offset, length,
digest), keyed by the URL with its host reversed. Entries are range-sorted by
key and cut into compressed blocks, each with its first and last key: the sparse
directory, which stays a table. Of its rows, every so many-th is held in memory,
DIRECTORY at most whatever the index's size; they cut the directory into ranges.
A look-up binary-searches these, then the directory rows of its range, unpacks
the blocks that may hold the key, and then reads the records by byte range. Many
look-ups at once meet the ranges' blocks in a join by range.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlsplit

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirework.llm.common import materialize, scratch_path

END = "\r\n\r\n"
RECORDS_PER_FILE = 1000
#: Bytes of an archive: files hold fewer records where pages are long, since an archive is read as one value.
FILE_BYTES = 256 << 20
#: Directory rows held in memory.
DIRECTORY = 4096
ENTRIES_PER_BLOCK = 1000
DATE = "2026-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

ENTRY = (
    "key string, page_id long, file string, offset long, length long, record_type string, "
    "payload_bytes long, payload_digest string, refers_to long"
)
BLOCKS = "first_key string, last_key string, entries int, data binary, part int, no int"


def base32_sha1(payload):
    """Upper-case base32 of a binary column's SHA-1: four groups of 40 bits, eight digits each."""
    digest = F.sha1(payload)
    digits = [F.lpad(F.conv(F.substring(digest, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*digits), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _uuid(*parts):
    h = F.md5(F.concat_ws("\n", *parts).cast("binary"))
    cut = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in cut]), F.lit(">"))


def written_url(url):
    """A URL as it stands in records: white space and control characters as %20, null as empty."""
    return F.regexp_replace(F.coalesce(url.cast("string"), F.lit("")), r"[\x00-\x20\x7F]", "%20")


def archive_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """``value``: each page's WARC record without its closing blank lines.

    Payloads of fewer than ``min_bytes`` bytes are never revisits. Null pages
    have an empty payload. Rows that repeat the largest page id of a payload are
    responses too; null ids are largest only among themselves.
    """
    payload = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"),
        written_url(F.col(url_col)).alias("url"),
        payload.alias("html"), base32_sha1(payload.cast("binary")).alias("digest"),
        F.octet_length(payload).cast("long").alias("n"),
    )
    shared = (
        rows.where(F.col("n") >= min_bytes).groupBy("digest")
        .agg(F.count("*").alias("copies"), F.max("page_id").alias("keeper")).where("copies > 1")
    )
    # only payloads that repeat; written, so that the planner sees whether it may send them to all executors
    shared = materialize(shared.select(F.col("digest").alias("d"), "keeper"), "shared")
    joined = rows.join(shared, F.col("digest") == F.col("d"), "left")
    revisit = F.col("keeper").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keeper"))
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n").cast("string"), F.lit(END)
    )
    block = F.concat(http, F.when(revisit, F.lit("")).otherwise(F.col("html")))
    number = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), _uuid(number(F.col("page_id")), F.col("url"), F.col("digest"))),
        F.lit(f"WARC-Date: {DATE}"),
        F.concat(F.lit("WARC-Target-URI: "), F.col("url")),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
        F.concat(F.lit("X-Page-Id: "), number(F.col("page_id"))),
        F.when(revisit, F.concat(F.lit(f"WARC-Profile: {PROFILE}\r\nX-Refers-To-Page-Id: "), number(F.col("keeper")))),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    ]
    return joined.select(F.concat(F.concat_ws("\r\n", *lines), F.lit(END), block).alias("value"))


def write_archives(pages: DataFrame, path: str, records_per_file: int = RECORDS_PER_FILE, html_col: str = "html", **columns) -> None:
    largest = pages.agg(F.max(F.octet_length(F.col(html_col).cast("string")))).first()[0] or 0
    most = max(1, min(records_per_file, FILE_BYTES // (largest + 2000)))
    archive_records(pages, html_col=html_col, **columns).write.option("lineSep", END).option("maxRecordsPerFile", most).text(path)


def url_key(url: str) -> str:
    """Sort key of a URL: host reversed by labels, port, then path and query, lower case up to the host's end."""
    try:
        u = urlsplit(url)
        host, port = u.hostname or "", u.port
    except ValueError:
        return ")" + url
    host = re.sub(r"^www\d*\.", "", host)
    head = ",".join(reversed(host.split("."))) + (f":{port}" if port else "")
    return head + ")" + (u.path or "/") + (f"?{u.query}" if u.query else "")


def parse_records(data: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """``(offset, length, headers, block)`` of each record; blocks are cut by Content-Length, never by content."""
    at = 0
    while at < len(data):
        head = data.index(b"\r\n\r\n", at)
        headers = {}
        for line in data[at:head].decode("utf-8").split("\r\n")[1:]:
            name, _, value = line.partition(":")
            headers[name.lower()] = value.strip()
        start = head + 4
        end = start + int(headers["content-length"])
        yield at, end + 4 - at, headers, data[start:end]
        at = end + 4


def _entry(path: str, offset: int, length: int, headers: dict[str, str], block: bytes) -> tuple:
    http, _, body = block.partition(b"\r\n\r\n")
    kind = headers["warc-type"]
    digest = headers["warc-payload-digest"].removeprefix("sha1:")
    if kind == "response":
        size = len(body)
        got = base64.b32encode(hashlib.sha1(body).digest()).decode()
        if got != digest:
            raise ValueError(f"{path} at {offset}: payload digest is {got}, its header says {digest}")
    else:
        size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    page, refers = headers.get("x-page-id"), headers.get("x-refers-to-page-id")
    return (
        url_key(headers["warc-target-uri"]), int(page) if page else None, path, offset, length, kind, size, digest,
        int(refers) if refers else None,
    )


def read_entries(spark: SparkSession, path: str) -> DataFrame:
    """One index entry per record of the archives under ``path``; response payloads are checked against their digests."""
    names = [c.split()[0] for c in ENTRY.split(", ")]

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for file, content in zip(pdf["path"], pdf["content"]):
                rows = [_entry(file, *r) for r in parse_records(bytes(content))]
                out = pd.DataFrame(rows, columns=names)
                yield out.astype({"page_id": "Int64", "refers_to": "Int64"})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(parse, ENTRY)


def build_index(entries: DataFrame, path: str, per_block: int = ENTRIES_PER_BLOCK) -> None:
    """Write the compressed blocks of range-sorted entries to ``path``; each part file is in key order."""
    spark = entries.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    names = [c.split()[0] for c in ENTRY.split(", ")]

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[list] = []
        part, no = TaskContext.get().partitionId(), 0

        def block(rows: list[list]) -> pd.DataFrame:
            nonlocal no
            body = "\n".join(json.dumps(r, ensure_ascii=False) for r in rows).encode()
            no += 1
            return pd.DataFrame(
                [(rows[0][0], rows[-1][0], len(rows), zlib.compress(body), part, no - 1)], columns=[c.split()[0] for c in BLOCKS.split(", ")]
            )

        for pdf in batches:
            held += pdf[names].astype(object).where(pdf[names].notna(), None).values.tolist()
            while len(held) >= per_block:
                yield block(held[:per_block])
                held = held[per_block:]
        if held:
            yield block(held)

    ordered = entries.repartitionByRange(n, "key", "page_id", "file", "offset").sortWithinPartitions(
        "key", "page_id", "file", "offset"
    )
    ordered.mapInPandas(pack, BLOCKS).write.parquet(path)


def unpack(data: bytes) -> list[list]:
    return [json.loads(line) for line in zlib.decompress(data).decode().split("\n")]


def ranges(blocks: DataFrame, most: int = DIRECTORY) -> tuple[DataFrame, list[str]]:
    """``blocks`` with their range of the directory as ``range``, and the first key of each range, in order.

    The driver holds a count for each part and ``most`` keys.
    """
    spark = blocks.sparkSession
    counts = blocks.groupBy("part").count().orderBy("part").collect()
    before, total = [], 0
    for r in counts:
        before.append((r.part, total))
        total += r["count"]
    stride = max(1, -(-total // most))
    ranked = blocks.join(F.broadcast(spark.createDataFrame(before, "part int, before long")), "part").withColumn("rank", F.col("before") + F.col("no"))
    ranked = ranked.withColumn("range", F.floor(F.col("rank") / stride).cast("int"))
    firsts = ranked.where(F.col("rank") % stride == 0).select("range", "first_key").orderBy("range").collect()
    return ranked.drop("before", "rank"), [r.first_key for r in firsts]


def _in_ranges(firsts: list[str], key: str) -> range:
    """The ranges that may hold a key: that before the first to begin with it, and all that begin with it."""
    return range(max(bisect.bisect_left(firsts, key) - 1, 0), bisect.bisect_right(firsts, key))


def _matching(firsts: list[str], lasts: list[str], key: str) -> range:
    """The blocks, in key order, whose range of keys holds a key."""
    return range(bisect.bisect_left(lasts, key), bisect.bisect_right(firsts, key))


def look_up_all(blocks: DataFrame, keys: DataFrame) -> DataFrame:
    """Index entries of all ``key`` rows, each entry once, found through directory and blocks.

    Keys are made distinct first; a key that fills many blocks is looked up in each of their ranges.
    """
    names = [c.split()[0] for c in ENTRY.split(", ")]
    ranked, firsts = ranges(blocks)
    if not firsts:
        return blocks.sparkSession.createDataFrame([], ENTRY)
    shared = blocks.sparkSession.sparkContext.broadcast(firsts)

    @F.pandas_udf("array<int>")
    def places(s: pd.Series) -> pd.Series:
        return pd.Series([list(_in_ranges(shared.value, k)) for k in s])

    def find(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left = left.sort_values(["part", "no"])
        begin, end, wanted = left["first_key"].tolist(), left["last_key"].tolist(), set(right["key"])
        some = sorted({i for k in wanted for i in _matching(begin, end, k)})
        rows = [e for i in some for e in unpack(bytes(left["data"].iloc[i])) if e[0] in wanted]
        return pd.DataFrame(rows, columns=names).astype({"page_id": "Int64", "refers_to": "Int64"})

    asked = keys.select("key").distinct().withColumn("range", F.explode(places("key")))
    return ranked.groupBy("range").cogroup(asked.groupBy("range")).applyInPandas(find, ENTRY)


@dataclass
class CaptureIndex:
    """An index on disk; of its directory only the ranges' first keys are held."""

    spark: SparkSession
    path: str

    def __post_init__(self) -> None:
        self.blocks, self.firsts = ranges(self.spark.read.schema(BLOCKS).parquet(self.path))

    def lookup(self, url: str) -> list[dict]:
        """Entries of one URL: the blocks whose key range may hold it are found by binary search, then read."""
        key = url_key(url)
        places = _in_ranges(self.firsts, key)
        if not places:
            return []
        near = self.blocks.where(F.col("range").between(places[0], places[-1])).select("part", "no", "first_key", "last_key").orderBy("part", "no").collect()
        hits = [near[i] for i in _matching([r.first_key for r in near], [r.last_key for r in near], key)]
        names = [c.split()[0] for c in ENTRY.split(", ")]
        found = []
        for hit in hits:
            for r in self.blocks.where((F.col("part") == hit.part) & (F.col("no") == hit.no)).select("data").collect():
                found += [dict(zip(names, e)) for e in unpack(bytes(r.data)) if e[0] == key]
        return sorted(found, key=lambda e: (e["page_id"] is None, e["page_id"] or 0, e["file"], e["offset"]))

    def read(self, entry: dict) -> tuple[dict[str, str], bytes]:
        """Headers and payload of an entry's record, by a range read of its archive; a revisit's payload is that referred to."""
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(entry["file"])
        stream = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).open(path)
        try:
            stream.seek(entry["offset"])
            data = bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream, entry["length"]))
        finally:
            stream.close()
        _, _, headers, block = next(parse_records(data))
        return headers, block.partition(b"\r\n\r\n")[2]


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Archives the pages, reads the archives back, indexes them, and looks every page's URL up in the index.

    ``page_id, payload_bytes, payload_digest, record_type, refers_to, url_key,
    file, offset, length``: a row per row of ``pages``, repeated rows included;
    an empty table gives no rows; other columns are ignored.
    """
    spark = pages.sparkSession
    archives, index = scratch_path(spark, "warc"), scratch_path(spark, "capture-index")
    write_archives(pages, archives, id_col=id_col, url_col=url_col, html_col=html_col)
    build_index(materialize(read_entries(spark, archives), "entries"), index)

    @F.pandas_udf("string")
    def keys(s: pd.Series) -> pd.Series:
        return pd.Series([url_key(u) for u in s], dtype=object)

    asked = pages.select(keys(written_url(F.col(url_col))).alias("key"))
    found = look_up_all(spark.read.schema(BLOCKS).parquet(index), asked)
    return found.select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", F.col("key").alias("url_key"), "file",
        "offset", "length",
    )
