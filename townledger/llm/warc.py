"""WARC archives with dictionary compression: every record is a Zstandard frame of its own, the dictionary leads each file.

The dictionary is built from the first records of a file and stored in a skippable frame at its start, so that a reader needs
nothing but the file. Records with equal payloads are stored once; the others are revisits that name the stored one.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from itertools import chain
from urllib.parse import unquote

import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, flag_ids, id_filter, scratch

# Fixed values of the format: magic number of the skippable frame that holds a dictionary, version line, profile of revisits.
DICTIONARY_FRAME = 0x184D2A5D
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ARCHIVED_AT = "1970-01-01T00:00:00Z"
# Records sampled for the dictionary of one file, at most so many bytes of them, and the size of the dictionary.
SAMPLE_BYTES = 4 << 20
DICTIONARY_BYTES = 64 << 10
LEVEL = 6
READ_BYTES = 1 << 18


def file_system(uri: str):
    """File system and path of a folder in any store that Arrow knows (file, hdfs, s3, …)."""
    from pyarrow import fs
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, name: str, url: str | None, payload: bytes, payload_digest: str, n_bytes: int, refers_to: str | None) -> bytes:
    """One WARC record: response with its payload, or revisit with the HTTP head only."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode()
    block = head + payload if kind == "response" else head
    # characters a header line can't hold are escaped
    target = "".join(c if " " < c < "\x7f" and c != "%" else "".join(f"%{b:02X}" for b in c.encode()) for c in url or "")
    lines = [f"WARC-Type: {kind}", f"WARC-Record-ID: <{name}>", f"WARC-Date: {ARCHIVED_AT}", f"WARC-Target-URI: {target}",
             f"WARC-Payload-Digest: sha1:{payload_digest}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    if kind == "revisit":
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <{refers_to}>"]
    return VERSION + b"\r\n" + "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def build_dictionary(samples: list[bytes]) -> zstandard.ZstdCompressionDict | None:
    """A trained dictionary; where the samples are too few to train on, they are the dictionary themselves."""
    if not samples:
        return None
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, max(1024, sum(map(len, samples)) // 8)), samples)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(samples)[:DICTIONARY_BYTES], dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def write_file(out, records: Iterator[bytes]) -> int:
    """Dictionary frame, then one frame per record; keeps only the sampled records in memory."""
    first, size = [], 0
    for r in records:
        first.append(r)
        size += len(r)
        if size >= SAMPLE_BYTES:
            break
    made = build_dictionary([r[:128 << 10] for r in first])
    data = made.as_bytes() if made else b""
    out.write(struct.pack("<II", DICTIONARY_FRAME, len(data)) + data)
    # read back by its bytes: with the magic number of trained dictionaries, or as raw content
    packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(data) if data else None)
    n = 0
    for r in chain(first, records):
        out.write(packer.compress(r))
        n += 1
    return n


def read_frames(source) -> Iterator[bytes]:
    """The records of a file, one after the other."""
    magic, n = struct.unpack("<II", source.read(8))
    if magic != DICTIONARY_FRAME:
        raise ValueError("the file does not start with a dictionary frame")
    data = source.read(n)
    unpacker = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data) if data else None)
    rest, work, out = b"", None, []
    while True:
        if not rest:
            rest = source.read(READ_BYTES)
            if not rest:
                break
        work = work or unpacker.decompressobj()
        out.append(work.decompress(rest))
        rest = b""
        if work.eof:
            rest, work = work.unused_data, None
            yield b"".join(out)
            out = []
    if work is not None:
        raise ValueError("the file ends within a record")


def parse(raw: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """Header fields, HTTP head and payload of a record; lengths are checked."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if version.encode() != VERSION:
        raise ValueError(f"unknown version {version}")
    fields = dict(x.split(": ", 1) for x in lines)
    n = int(fields["Content-Length"])
    if len(rest) != n + 4 or not rest.endswith(b"\r\n\r\n"):
        raise ValueError("length of a record does not fit")
    http, _, payload = rest[:n].partition(b"\r\n\r\n")
    return fields, http, payload


def _name(page_id: str | None) -> str:
    return f"urn:x-page:{'none' if page_id is None else page_id}"


def plan(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """(id, url, payload, sha, n_bytes, refers_to): what is to be written; refers_to is set for revisits only.

    Only rows whose payload may occur more than once are joined; all others stay where they are read. The group
    table lies stored, so that both sides of the join are plain exchanges and adaptive execution can split a payload with many
    copies.
    """
    df = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8").alias("payload"))
    df = df.withColumn("n_bytes", F.octet_length("payload").cast("long")).withColumn("sha", F.sha1("payload"))
    groups = cut_lineage(df.filter(F.col("n_bytes") >= min_bytes).groupBy("sha", "n_bytes").agg(F.max("id").alias("refers_to"), F.count("*").alias("n"))
                         .filter("n > 1").select("sha", "n_bytes", "refers_to"))
    df = flag_ids(df, id_filter(groups, F.col("sha")), F.col("sha"))
    single = df.filter(~F.col("_maybe")).withColumn("refers_to", F.lit(None).cast(df.schema["id"].dataType))
    several = df.filter("_maybe").join(groups, ["sha", "n_bytes"], "left")
    cols = ["id", "url", "payload", "sha", "n_bytes", "refers_to"]
    return single.select(cols).unionByName(several.select(cols))


def write(records: DataFrame, folder: str) -> DataFrame:
    """Writes the planned records, one file per partition, and returns (path, n_records) of the finished files.

    A file appears under its final name only when it is complete, so a task that is repeated replaces it by the same records.
    """
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def lines():
            for pdf in parts:
                for i, url, payload, refers_to, first in zip(pdf["id"], pdf["url"], pdf["payload"], pdf["refers_to"], pdf["is_first"]):
                    payload = bytes(payload)
                    kind = "response" if first else "revisit"
                    yield record(kind, _name(i), url, payload, digest(payload), len(payload), None if first else _name(refers_to))
        rows = lines()
        start = next(rows, None)
        if start is None:
            return
        store, path = file_system(folder)
        final = f"{path}/part-{TaskContext.get().partitionId():05d}.warc.zst"
        part = f"{final}.{uuid.uuid4().hex}.tmp"
        with store.open_output_stream(part, compression=None) as out:
            n = write_file(out, chain([start], rows))
        store.move(part, final)
        yield pd.DataFrame({"path": [final], "n_records": [n]})

    first = F.col("refers_to").isNull() | F.col("id").eqNullSafe(F.col("refers_to"))
    df = records.select(F.col("id").cast("string").alias("id"), "url", "payload", F.col("refers_to").cast("string").alias("refers_to"), first.alias("is_first"))
    store, path = file_system(folder)
    store.create_dir(path, recursive=True)
    return cut_lineage(df.mapInPandas(run, "path string, n_records long"))


def read(files: DataFrame, folder: str) -> DataFrame:
    """(name, kind, url, payload_bytes, payload_digest, refers_to, payload): records of the given files; each is streamed by one task.

    Digests of stored payloads are worked out anew and compared. ``payload`` is null for revisits.
    """
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, _ = file_system(folder)
        for pdf in parts:
            for path in pdf["path"]:
                rows, size = [], 0
                with store.open_input_stream(path, compression=None) as source:
                    for raw in read_frames(source):
                        fields, http, payload = parse(raw)
                        told = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                        n = int(next(x for x in http.decode().split("\r\n") if x.startswith("Content-Length: "))[16:])
                        stored = fields["WARC-Type"] == "response"
                        if stored and (digest(payload) != told or len(payload) != n):
                            raise ValueError(f"payload of {fields['WARC-Record-ID']} is damaged")
                        rows.append((fields["WARC-Record-ID"].strip("<>"), fields["WARC-Type"], unquote(fields["WARC-Target-URI"]), n, told,
                                     fields.get("WARC-Refers-To", "").strip("<>") or None, payload if stored else None))
                        size += len(raw)
                        if size > 8 << 20:
                            yield pd.DataFrame(rows, columns=COLUMNS)
                            rows, size = [], 0
                if rows:
                    yield pd.DataFrame(rows, columns=COLUMNS)

    n = max(1, files.count())
    return files.select("path").repartition(n, "path").mapInPandas(run, "name string, kind string, url string, payload_bytes long, payload_digest string, refers_to string, payload binary")


COLUMNS = ["name", "kind", "url", "payload_bytes", "payload_digest", "refers_to", "payload"]


def archive(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """Writes all pages and reads them back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    A null payload is empty, a null url an empty target. Of records with equal payloads of at least ``min_bytes`` bytes the one
    with the largest id is stored, the others revisit it; with repeated ids all rows of the largest id are stored. If all ids
    of a group are null, every row is stored. Extra columns are not read; an empty table gives no file and no rows. Files lie
    in ``folder``, by default a new one below the shared checkpoint folder.
    """
    folder = folder or scratch(pages.sparkSession, "warc")
    kind = pages.schema[id_col].dataType
    rows = read(write(plan(pages, id_col, url_col, html_col, min_bytes), folder), folder)

    def number(name: str):
        return F.when(F.col(name) != "urn:x-page:none", F.expr(f"substring({name}, 12)")).cast(kind)

    return rows.select(number("name").alias("page_id"), "payload_bytes", "payload_digest", F.col("kind").alias("record_type"), number("refers_to").alias("refers_to"))


SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS x, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY x) AS top FROM p),
b AS (SELECT *, list_reduce(list_transform(range(0, 8), lambda i: list_reduce(list_transform(range(0, 4), lambda j:
      substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(h, 1 + 5 * CAST(i AS INT), 5) AS BIGINT) >> CAST(15 - 5 * j AS INT)) & 31 AS INT) + 1, 1)),
      lambda a, c: a || c)), lambda a, c: a || c) AS payload_digest FROM m)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> top THEN top END AS refers_to FROM b
"""
