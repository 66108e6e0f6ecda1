"""WARC archives with a two-level capture index.

Writing: each task writes its pages as gzip members of one ``.warc.gz`` file in the shared folder
and returns where each record lies. A file counts only through the committed rows that name it, so
a task that is run again leaves at most an unused file.

Index: captures are range-partitioned and sorted by reversed-host key. Each shard is one file of
compressed blocks of ``BLOCK`` captures, followed by its sparse directory (first key, offset and
length of every block). The list of shards (first key and file) is as long as there are partitions.

Lookup: binary search for the shard, then in its directory for the block, then inside the block
read by its byte range; the record itself is read by its byte range from the archive.

Defined results: null html is an empty payload, a null url has the key of an empty one. Among
records with equal payloads the largest page_id is the response, the others revisit it. Repeated
page_ids are separate records; of the rows with the largest page_id, all are responses.
Other columns are ignored; an empty table gives an empty result. A null page_id is written as the
smallest long (``ABSENT``), sorts before every other and is read back as null; so is that number itself.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import json
import re
import uuid
import zlib
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, new_dir, partitions, prepare, stage

#: Captures in a block.
BLOCK = 512
#: Smallest payload, in bytes, of which copies become revisits.
LEAST = 0
#: Stands for a null page_id in archives and index.
ABSENT = -(1 << 63)
DATE = "2024-01-01T00:00:00Z"


def filesystem(uri: str):
    """(file system, path) for a folder that executors share."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("/") else re.sub("^file:/", "file:///", uri))


def reversed_host_key(url: str | None) -> str:
    """``http://www.a.example/p?q`` -> ``example,a)/p?q``: captures of a site are neighbours."""
    try:
        u = urlsplit((url or "").strip())
        host = (u.hostname or "").lower()
        port = f":{u.port}" if u.port and u.port not in (80, 443) else ""
    except ValueError:
        return f"){url}"
    host = re.sub(r"^www\d*\.", "", host)
    path = (u.path or "/").lower() + (f"?{u.query.lower()}" if u.query else "")
    return f"{','.join(reversed(host.split('.')))}{port}){path}"


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC/1.1 record; a revisit names the response and keeps the full payload's length and digest."""
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {re.sub(r'[\r\n]+', ' ', url or '')}",
        f"WARC-Payload-Digest: sha1:{sha1_base32(payload)}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if refers_to is not None:
        head += [
            f"WARC-Refers-To: <urn:page:{refers_to}>",
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
        ]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    body = http + (payload if refers_to is None else b"")
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """Headers and payload of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    body = rest[: int(fields["Content-Length"])]
    return {"headers": fields, "payload": body.partition(b"\r\n\r\n")[2]}


def decisions(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """digest, keeper: of each payload that several pages share the largest page_id."""
    payload = F.coalesce("html", F.lit(""))
    digests = pages.select("page_id", F.unhex(F.sha1(payload)).alias("digest"), F.octet_length(payload).alias("n"))
    return stage(
        digests.filter(F.col("n") >= least)
        .groupBy("digest")
        .agg(F.max("page_id").alias("keeper"), F.count("*").alias("n"))
        .filter("n > 1")
        .select("digest", "keeper"),
        "repeats",
    )


def write_archives(pages: DataFrame, root: str, least: int = LEAST) -> DataFrame:
    """Write every page; returns the captures (page_id, key, file, at, length)."""
    digest = F.unhex(F.sha1(F.coalesce("html", F.lit(""))))
    rows = pages.withColumn("digest", digest).join(decisions(pages, least), "digest", "left")
    # Only the response carries the payload past here; its copies are written as revisits.
    def write(it):
        fs, base = filesystem(root)
        fs.create_dir(base, recursive=True)
        name = f"{uuid.uuid4().hex}.warc.gz"
        at, out = 0, None
        try:
            for pdf in it:
                found = []
                for i, url, html, keeper in zip(pdf["page_id"], pdf["url"], pdf["html"], pdf["keeper"], strict=True):
                    if out is None:
                        out = fs.open_output_stream(f"{base}/{name}", compression=None)
                    to = None if pd.isna(keeper) or keeper == i else int(keeper)
                    data = gzip.compress((record(i, url, (html or "").encode("utf-8", "surrogatepass"), to)), 6, mtime=0)
                    out.write(data)
                    found.append((i, reversed_host_key(url), name, at, len(data)))
                    at += len(data)
                if found:
                    yield pd.DataFrame(found, columns=["page_id", "key", "file", "at", "length"])
        finally:
            if out is not None:
                out.close()

    captures = "page_id long, key string, file string, at long, length long"
    return stage(rows.select("page_id", "url", "html", "keeper").mapInPandas(write, captures), "captures")


class CaptureIndex:
    """Sorted shards of compressed capture blocks with sparse directories."""

    def __init__(self, root: str, shards: list[tuple[str, str]]):
        #: (first key, file) of each shard in key order: one for each range partition.
        self.root, self.shards = root, shards

    @staticmethod
    def build(captures: DataFrame, root: str, block: int = BLOCK) -> CaptureIndex:
        spark = captures.sparkSession

        def write(it):
            fs, base = filesystem(root)
            fs.create_dir(base, recursive=True)
            name, first, directory, at, held = f"{uuid.uuid4().hex}.cdx", None, [], 0, []
            out = None

            def flush():
                nonlocal at
                data = zlib.compress("\n".join(map(json.dumps, held)).encode(), 6)
                out.write(data)
                directory.append((held[0][:2], at, len(data)))
                at += len(data)
                held.clear()

            for pdf in it:
                for key, page, file, pos, n in zip(pdf["key"], pdf["page_id"], pdf["file"], pdf["at"], pdf["length"], strict=True):
                    if out is None:
                        out, first = fs.open_output_stream(f"{base}/{name}", compression=None), (key, int(page))
                    held.append((key, int(page), file, int(pos), int(n)))
                    if len(held) >= block:
                        flush()
            if out is not None:
                if held:
                    flush()
                data = zlib.compress(json.dumps(directory).encode(), 6)
                out.write(data + len(data).to_bytes(8, "big"))
                out.close()
                yield pd.DataFrame([(*first, name)], columns=["key", "page_id", "file"])

        order = ["key", "page_id"]
        dealt = captures.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
        made = stage(dealt.mapInPandas(write, "key string, page_id long, file string"), "shards")
        return CaptureIndex(root, sorted(((r["key"], r["page_id"]), r["file"]) for r in made.collect()))

    def reader(self):
        return IndexReader(self.root, self.shards)


class IndexReader:
    """Looks captures up; keeps the last directory and block, so sorted lookups read each once."""

    def __init__(self, root: str, shards: list):
        self.fs, self.base = filesystem(root)
        self.firsts, self.files = [s[0] for s in shards], [s[1] for s in shards]
        self.shard = self.block = None

    def _range(self, name: str, at: int, n: int) -> bytes:
        with self.fs.open_input_file(f"{self.base}/{name}") as f:
            return f.read_at(n, at)

    def _directory(self, name: str) -> list:
        with self.fs.open_input_file(f"{self.base}/{name}") as f:
            size = f.size()
            n = int.from_bytes(f.read_at(8, size - 8), "big")
            return json.loads(zlib.decompress(f.read_at(n, size - 8 - n)))

    def find(self, key: str, page_id: int | None = None) -> list[tuple]:
        """All captures of a key (of one page, if given): (key, page_id, file, at, length)."""
        want = (key, -(1 << 63) if page_id is None else page_id)
        s = max(0, bisect.bisect_left(self.firsts, want) - 1)
        found = []
        while s < len(self.files) and (self.firsts[s][0] <= key):
            if self.shard is None or self.shard[0] != s:
                d = self._directory(self.files[s])
                self.shard = (s, [tuple(x[0]) for x in d], d)
            b = max(0, bisect.bisect_left(self.shard[1], want) - 1)
            while b < len(self.shard[1]) and self.shard[1][b][0] <= key:
                if self.block is None or self.block[0] != (s, b):
                    _, at, n = self.shard[2][b]
                    rows = [tuple(json.loads(x)) for x in zlib.decompress(self._range(self.files[s], at, n)).split(b"\n")]
                    self.block = ((s, b), [x[:2] for x in rows], rows)
                i = bisect.bisect_left(self.block[1], want)
                while i < len(self.block[2]) and self.block[1][i][0] == key and page_id in (None, self.block[1][i][1]):
                    found.append(self.block[2][i])
                    i += 1
                if i < len(self.block[2]):
                    return found
                b += 1
            s += 1
        return found

    def fetch(self, capture: tuple) -> dict:
        """The record of a capture, by its byte range."""
        return parse(gzip.decompress(self._range(*capture[2:5])))


def look_up(index: CaptureIndex, wanted: DataFrame) -> DataFrame:
    """Captures (page_id, file, at, length) of wanted (key, page_id), each found through the index."""
    root, shards = index.root, index.shards

    def find(it):
        reader = IndexReader(root, shards)
        last = None
        for pdf in it:
            rows = []
            for k, p in zip(pdf["key"], pdf["page_id"], strict=True):
                if (k, p) != last:  # a repeated page finds all its captures at once
                    rows += [(c[1], *c[2:]) for c in reader.find(k, int(p))]
                last = (k, p)
            if rows:
                yield pd.DataFrame(rows, columns=["page_id", "file", "at", "length"])

    dealt = wanted.repartitionByRange(partitions(wanted.sparkSession), "key", "page_id").sortWithinPartitions("key", "page_id")
    return stage(dealt.mapInPandas(find, "page_id long, file string, at long, length long"), "found")


def read_records(found: DataFrame, root: str) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to read from the archives."""

    def read(it):
        fs, base = filesystem(root)
        name = f = None
        for pdf in it:
            rows = []
            for file, at, n in zip(pdf["file"], pdf["at"], pdf["length"], strict=True):
                if file != name:
                    if f is not None:
                        f.close()
                    name, f = file, fs.open_input_file(f"{base}/{file}")
                r = parse(gzip.decompress(f.read_at(n, at)))
                h, kind = r["headers"], r["headers"]["WARC-Type"]
                digest, size = h["WARC-Payload-Digest"].removeprefix("sha1:"), int(h["X-Payload-Length"])
                if kind == "response" and (sha1_base32(r["payload"]) != digest or len(r["payload"]) != size):
                    raise ValueError(f"{file} at {at}: the payload does not match its digest")
                ident = lambda x: int(re.search(r"urn:page:(-?\d+)", x)[1])
                to = ident(h["WARC-Refers-To"]) if kind == "revisit" else None
                rows.append((ident(h["WARC-Record-ID"]), h["WARC-Target-URI"], size, digest, kind, to))
            out = pd.DataFrame(rows, columns=["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"])
            yield out.astype({"refers_to": "Int64"})

    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
    dealt = found.repartitionByRange(partitions(found.sparkSession), "file", "at").sortWithinPartitions("file", "at")
    return dealt.mapInPandas(read, schema)


def archive_round_trip(spark: SparkSession, pages: DataFrame, root: str | None = None) -> DataFrame:
    """Write pages as WARC, index the captures, look every page up and read it back."""
    prepare(spark)
    root = root or new_dir(spark, "warc")
    pages = fresh(pages, "page_id", "url", "html").withColumn("page_id", F.coalesce(F.col("page_id").cast("long"), F.lit(ABSENT)))
    captures = write_archives(pages, root)
    index = CaptureIndex.build(captures, root)
    keys = F.pandas_udf(lambda s: s.map(lambda u: reversed_host_key(u if isinstance(u, str) else None)).astype(object), "string")
    wanted = pages.select(keys("url").alias("key"), "page_id")
    known = F.when(F.col("page_id") != ABSENT, F.col("page_id"))
    return read_records(look_up(index, wanted), root).withColumn("page_id", known)


_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages)
, h AS (SELECT page_id, strlen(body) AS n, sha1(body) AS hex FROM p)
, b AS (
  SELECT *, array_to_string(list_transform(range(1, 41), lambda i: substr('0000000100100011010001010110011110001001101010111100110111101111',
      4 * strpos('0123456789abcdef', substr(hex, i, 1)) - 3, 4)), '') AS bits FROM h)
, d AS (
  SELECT page_id, n, array_to_string(list_transform(range(0, 32), lambda i: substr('{_ALPHABET}', 1
      + 16 * substr(bits, 5 * i + 1, 1)::INT + 8 * substr(bits, 5 * i + 2, 1)::INT + 4 * substr(bits, 5 * i + 3, 1)::INT
      + 2 * substr(bits, 5 * i + 4, 1)::INT + substr(bits, 5 * i + 5, 1)::INT, 1)), '') AS digest FROM b)
SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest,
  CASE WHEN page_id = max(page_id) OVER (PARTITION BY digest) THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = max(page_id) OVER (PARTITION BY digest) THEN NULL ELSE max(page_id) OVER (PARTITION BY digest) END AS refers_to
FROM d
"""
