"""WARC archives with an index first: records are found by (file, offset, length), then read in sorted, coalesced ranges.

Writing tasks put one archive each into the shared folder, under a name of their own attempt,
and return its index rows; what a lost attempt leaves behind is in no index. Reading tasks
take the selected index rows of one file region, sort them by offset, join ranges that lie
close together into one read, and parse the records from it.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, scratch_path

LEAST_SHARED = 1000
#: ranges with at most so many bytes between them are read at once, up to so many bytes a read
GAP, READ = 64 << 10, 8 << 20
REGION = 32 << 20
#: each record is a gzip member of its own, so that any one can be read alone
LEVEL = 1
DATE = "2024-01-01T00:00:00Z"
INDEX = "page_id long, url string, payload_digest string, record_type string, refers_to long, file string, offset long, length long"


def plan_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", least: int = LEAST_SHARED) -> DataFrame:
    """(page_id, url, html, record_type, refers_to): which pages are responses and which revisit one.

    Of equal payloads of at least ``least`` bytes the largest page_id is the response; if it
    occurs more than once with that payload, so is each of its rows. Null payloads are empty, so
    they are responses, as all smaller ones are. A null page_id is less than any other. Rows of
    one page_id are judged by their own payloads. Extra columns are ignored, whatever their
    names; an empty table gives an empty result. Digests are grouped and joined without their
    payloads; only payloads that occur again are looked at twice.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(body_col), F.lit("")).alias("html"))
    mark = {"digest": F.when(F.octet_length("html") >= least, F.sha1(F.encode("html", "UTF-8"))), "bytes": F.octet_length("html")}
    marks = rows.select("page_id", *[c.alias(k) for k, c in mark.items()]).filter("digest is not null")
    tops = marks.groupBy("digest", "bytes").agg(F.max("page_id").alias("top"), F.count("*").alias("n")).filter("n > 1").drop("n")
    again = marks.join(tops, ["digest", "bytes"]).filter("not (page_id <=> top)").select(*[F.col(c).alias(f"m_{c}") for c in ("page_id", "digest", "bytes")], F.col("top").alias("refers_to")).distinct()
    rows = rows.withColumns(mark).join(again, F.expr("page_id <=> m_page_id and digest = m_digest and bytes = m_bytes"), "left")
    return rows.select("page_id", "url", "html", F.when(F.col("refers_to").isNull(), "response").otherwise("revisit").alias("record_type"), "refers_to")


def _record(page: int | None, url: str | None, body: bytes, kind: str, refers: int | None) -> tuple[bytes, str]:
    digest = hashlib.sha1(body).hexdigest()
    name = lambda p: f"<urn:page:{'' if p is None else p}>"
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + (body if kind == "response" else b"")
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {name(page)}", f"WARC-Date: {DATE}", *([] if url is None else ["WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A")]),
        f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(body)}",
        *(["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {name(refers)}"] if kind == "revisit" else []),
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", digest


def _writer(folder: str):
    def run(batches):
        store, path = fs.FileSystem.from_uri(folder)
        name, out, at = f"{uuid.uuid4().hex}.warc.gz", None, 0
        try:
            for batch in batches:
                rows = []
                for r in batch.to_pylist():
                    if out is None:
                        store.create_dir(path, recursive=True)
                        out = store.open_output_stream(f"{path}/{name}", compression=None)  # not by the name
                    data, digest = _record(r["page_id"], r["url"], r["html"].encode(), r["record_type"], r["refers_to"])
                    data = gzip.compress(data, LEVEL, mtime=0)
                    out.write(data)
                    rows.append({"page_id": r["page_id"], "url": r["url"], "payload_digest": digest, "record_type": r["record_type"], "refers_to": r["refers_to"], "file": f"{folder}/{name}", "offset": at, "length": len(data)})
                    at += len(data)
                yield pa.RecordBatch.from_pylist(rows, _INDEX)
        finally:
            if out is not None:
                out.close()

    return run


_INDEX = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])
_READ = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])


def write(pages: DataFrame, folder: str | None = None, **columns) -> DataFrame:
    """Write every page as a record and return the index (written out itself): a row a record."""
    folder = folder or scratch_path(pages.sparkSession, "warc")
    if "://" not in folder:
        folder = f"file://{folder}" if folder.startswith("/") else folder.replace("file:/", "file:///", 1)
    return materialize(plan_records(pages, **columns).mapInArrow(_writer(folder), INDEX), "index")


def parse(data: bytes) -> dict:
    """One compressed record's fields; the payload is what follows its HTTP headers."""
    head, _, rest = gzip.decompress(data).partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    payload = block.partition(b"\r\n\r\n")[2]
    number = lambda k: int(fields[k][10:-1]) if k in fields and fields[k] != "<urn:page:>" else None
    found = {"page_id": number("WARC-Record-ID"), "url": fields.get("WARC-Target-URI"), "record_type": fields["WARC-Type"], "refers_to": number("WARC-Refers-To")}
    if found["record_type"] == "response":
        return found | {"payload_bytes": len(payload), "payload_digest": hashlib.sha1(payload).hexdigest(), "payload": payload}
    return found | {"payload_bytes": int(fields["X-Payload-Length"]), "payload_digest": fields["WARC-Payload-Digest"][5:], "payload": b""}


def _reader(with_payload: bool):
    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans = sorted((o, n) for b in batches for o, n in zip(b.column("offset").to_pylist(), b.column("length").to_pylist(), strict=True))
        store, path = fs.FileSystem.from_uri(key[0].as_py())
        schema = _READ if with_payload else pa.schema(list(_READ)[:-1])
        with store.open_input_file(path) as f:
            i = 0
            while i < len(spans):
                lo, hi, j = spans[i][0], sum(spans[i]), i + 1
                while j < len(spans) and spans[j][0] <= hi + GAP and sum(spans[j]) - lo <= READ:
                    hi, j = max(hi, sum(spans[j])), j + 1
                data = f.read_at(hi - lo, lo)
                rows = [parse(data[o - lo : o - lo + n]) for o, n in spans[i:j]]
                yield pa.RecordBatch.from_pylist([{k: r[k] for k in schema.names} for r in rows], schema)
                i = j

    return run


def read(selected: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records that the rows of an index (or of a part of one) point to, a row each."""
    out = ", ".join(["page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string", *["payload binary"] * with_payload])
    rows = selected.select("file", "offset", "length", F.expr(f"offset div {REGION}").alias("region"))
    return rows.groupBy("file", "region").applyInArrow(_reader(with_payload), out)
