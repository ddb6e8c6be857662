"""WARC archives: an index of every record, and reads of byte ranges.

Writing: each task writes its rows as WARC records, one gzip member each, to a
file of its own name under the given folder (any file system that pyarrow
opens), and gives an index row for each record: file, offset, length, url and
digest.  The index is written as a table first; a file of a task that was lost
is in no index row, so that it's never read.

Payloads that are equal and at least REVISIT_BYTES long are written once, by
the row with the smallest id (every row that has that id, if ids repeat); the
others are revisit records.

Reading: index rows are dealt by file and stretch of file, sorted by offset,
and neighbours no more than GAP bytes apart are read at once, up to READ bytes.

A null in any column, an empty or very long payload and repeated rows are
written like any other; clashing columns don't matter, as three are taken.

Defined results: a null payload is empty; a null url is written as an empty
one.  Rows with a null id are revisits of a row that has one, else responses.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import materialise, scratch_path, slices

REVISIT_BYTES = 100
FILE_BYTES = 256 << 20
#: payloads that several pages have, for a broadcast (about 200 bytes each)
BROADCAST_DIGESTS = 500_000
GAP = 64 << 10
READ = 8 << 20
STRETCH = 64 << 20
_DATE = "2024-01-01T00:00:00Z"
_INDEX = "page_id long, file string, offset long, length int, url string, digest string"


def open_store(folder: str):
    """A pyarrow file system and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder) if "://" in folder else fs.FileSystem.from_uri(f"file://{folder.removeprefix('file:')}")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, size: int, refers_to: int | None, revisit: bool) -> bytes:
    """The bytes of a record; a revisit has no payload of its own, but its length (size) and digest."""
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"{page_id} {url}")
    body = b"" if revisit else payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:uuid:{name}>", f"WARC-Date: {_DATE}", f"WARC-Target-URI: {(url or '').replace(chr(13), '%0D').replace(chr(10), '%0A')}"]
    head += [f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {size}", "Content-Type: text/html"]
    head += [f"X-Page-ID: {page_id}"] if page_id is not None else []
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"] + ([f"X-Refers-To-Page-ID: {refers_to}"] if refers_to is not None else [])
    head.append(f"Content-Length: {len(body)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names) and body."""
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    body = rest[: int(headers["content-length"])]
    if len(body) != int(headers["content-length"]) or rest[len(body) :] != b"\r\n\r\n":
        raise ValueError("a WARC record is cut short")
    return headers, body


def _write(folder: str, file_bytes: int, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    store, path = open_store(folder)
    store.create_dir(path, recursive=True)
    out, name, offset = None, "", 0
    try:
        for batch in slices(batches, "html", 8 << 20):
            rows = []
            for has_id, page_id, url, html, digest, size, ref, revisit in zip(*(batch[c] for c in ("has_id", "page_id", "url", "html", "digest", "size", "refers_to", "revisit")), strict=True):
                if out is None or offset >= file_bytes:
                    if out is not None:
                        out.close()
                    name, offset = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = store.open_output_stream(f"{path}/{name}", compression=None)
                data = gzip.compress(record(int(page_id) if has_id else None, url, (html or "").encode("utf-8", "replace"), digest, int(size), int(ref) if revisit else None, revisit), 1, mtime=0)
                out.write(data)
                rows.append((page_id, name, offset, len(data), url, digest, has_id))
                offset += len(data)
            frame = pd.DataFrame(rows, columns=["page_id", "file", "offset", "length", "url", "digest", "has_id"])
            frame["page_id"] = frame["page_id"].astype("Int64").mask(~frame["has_id"].astype(bool))
            yield frame.drop(columns="has_id")
    finally:
        if out is not None:
            out.close()


def write(pages: DataFrame, folder: str, file_bytes: int = FILE_BYTES, broadcast_digests: int = BROADCAST_DIGESTS) -> DataFrame:
    """Writes a record for each row (page_id, url, html) and gives the index, a written table.

    The pages themselves aren't shuffled while there are no more than broadcast_digests payloads that several
    have; beyond it they are joined with the decisions by page and digest, so that no payload is one key.
    """
    text = F.coalesce("html", F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", F.sha2(text.cast("binary"), 256).alias("digest"), F.octet_length(text).cast("long").alias("size"))
    shared = rows.where(F.col("size") >= REVISIT_BYTES).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select(F.col("digest").alias("_digest"), "first")
    shared = materialise(shared, "warc-shared")
    if shared.count() <= broadcast_digests:
        rows = rows.join(F.broadcast(shared), F.col("digest") == F.col("_digest"), "left")
    else:
        decided = rows.select(F.col("page_id").alias("_page"), F.col("digest").alias("_digest")).distinct().join(shared, "_digest")
        rows = rows.join(decided, F.col("page_id").eqNullSafe(F.col("_page")) & (F.col("digest") == F.col("_digest")), "left")
    revisit = F.coalesce(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.lit(False))
    rows = rows.select(
        F.col("page_id").isNotNull().alias("has_id"), F.coalesce("page_id", F.lit(0)).alias("page_id"), "url", F.when(~revisit, F.col("html")).alias("html"), "digest", "size",
        revisit.alias("revisit"), F.coalesce("first", F.lit(0)).alias("refers_to"),
    )
    return materialise(rows.mapInPandas(lambda b: _write(folder, file_bytes, b), _INDEX), "warc-index")


def _read(folder: str, bodies: bool, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    store, path = open_store(folder)
    source, opened = None, None
    for batch in batches:
        rows = []
        files, offsets, lengths = (batch[c].to_numpy() for c in ("file", "offset", "length"))
        at = 0
        while at < len(batch):
            stop, end = at + 1, offsets[at] + lengths[at]
            while stop < len(batch) and files[stop] == files[at] and offsets[stop] - end <= GAP and offsets[stop] + lengths[stop] - offsets[at] <= READ:
                end = max(end, offsets[stop] + lengths[stop])
                stop += 1
            if opened != files[at]:
                if source is not None:
                    source.close()
                source, opened = store.open_input_file(f"{path}/{files[at]}"), files[at]
            data = source.read_at(int(end - offsets[at]), int(offsets[at]))
            for i in range(at, stop):
                lo = int(offsets[i] - offsets[at])
                headers, body = parse(zlib.decompress(data[lo : lo + int(lengths[i])], 31))
                kind, digest = headers["warc-type"], headers["warc-payload-digest"].removeprefix("sha256:")
                size = int(headers["x-payload-length"])
                if kind == "response" and (hashlib.sha256(body).hexdigest() != digest or len(body) != size):
                    raise ValueError(f"{files[i]} at {offsets[i]}: the payload isn't that of its digest")
                rows.append((headers.get("x-page-id"), headers["warc-target-uri"], size, digest, kind, headers.get("x-refers-to-page-id"), body if bodies else b""))
            at = stop
        out = pd.DataFrame(rows, columns=["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "body"])
        for c in ("page_id", "refers_to"):
            out[c] = pd.array([None if v is None else int(v) for v in out[c]], "Int64")
        yield out
    if source is not None:
        source.close()


def read(index: DataFrame, folder: str, bodies: bool = True) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to and body (empty for revisits, or if not wanted) of the records of these index rows."""
    order = ["file", "stretch", "offset"]
    rows = index.select("file", "offset", "length", F.floor(F.col("offset") / STRETCH).alias("stretch"))
    rows = rows.repartition("file", "stretch").sortWithinPartitions(*order)
    return rows.mapInPandas(lambda b: _read(folder, bodies, b), "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, body binary")


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes all pages into a new folder beside the checkpoints, and reads every record back."""
    folder = scratch_path(pages.sparkSession, "warc")
    return read(write(pages, folder), folder, bodies=False).drop("body", "url")
