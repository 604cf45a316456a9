"""WARC archives of pages, with an index written first and coalesced ranged reads.

Executors write gzip members (one per record) through pyarrow's file systems into the shared folder, each attempt of
a task under a name of its own, and return one index row per record: file, offset, length, URL and digest. Only
files that the committed index names count, so lost or repeated attempts leave no trace in results. Reading sorts the
selected records by file and offset and fetches runs of neighbours as one range of bounded size.

Among pages of equal payload of at least ``least`` bytes the largest id is the response and others revisit it.

Defined results: a null page is an empty payload; null URLs are written as empty; rows that repeat an id and a
payload are each written, and where they hold the largest id all are responses; an empty table gives no record; other
columns are not read.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch, few

LEAST, FILE_BYTES, RANGE_BYTES, GAP_BYTES = 1000, 64 << 20, 4 << 20, 16 << 10
DATE = "2024-01-01T00:00:00Z"
INDEX = "file string, offset long, length long, url string, digest string, page_id long"


def open_store(folder: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI (file, hdfs, s3, gs, …) or of a plain path."""
    return fs.FileSystem.from_uri(folder if "://" in folder else "file://" + folder.removeprefix("file:"))


def record(page_id, url: str, payload: bytes, digest: str, refers_to) -> bytes:
    """One record; a revisit keeps the digest and full length of the payload it leaves out."""
    revisit = refers_to is not None
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + (b"" if revisit else payload)
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'keyfold:page:{page_id}')}>",
        f"WARC-Target-URI: {url}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Page-Id: {'' if page_id is None else page_id}",
        f"X-Full-Payload-Length: {len(payload)}",
    ]
    if revisit:
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        head.append(f"WARC-Refers-To: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'keyfold:page:{refers_to}')}>")
        head.append(f"X-Refers-To-Page-Id: {refers_to}")
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """(header fields in lower case, payload) of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    return fields, rest[: int(fields["content-length"])].partition(b"\r\n\r\n")[2]


def gzip_member(raw: bytes) -> bytes:
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


def _write(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = open_store(folder)
        out, name, at = None, "", 0
        for batch in batches:
            rows = []
            for page_id, url, html, refers_to in zip(*[batch.column(k) for k in ("page_id", "url", "html", "refers_to")], strict=True):
                payload = (html.as_py() or "").encode()
                link = " ".join((url.as_py() or "").split())
                digest = hashlib.sha1(payload).hexdigest()
                if out is None or at >= FILE_BYTES:
                    if out is not None:
                        out.close()
                    name, at = f"part-{uuid.uuid4().hex}.warc.gz", 0
                    out = store.open_output_stream(f"{path}/{name}", compression=None)
                member = gzip_member(record(page_id.as_py(), link, payload, digest, refers_to.as_py()))
                out.write(member)
                rows.append((name, at, len(member), link, digest, page_id.as_py()))
                at += len(member)
            cols = list(zip(*rows, strict=True)) or [[]] * 6
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["file", "offset", "length", "url", "digest", "page_id"])
        if out is not None:
            out.close()

    return run


def revisits(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """page_id, url, html and refers_to (null for responses). Only ids and digests meet by digest, so a popular payload
    moves no text; pages meet what they refer to by id and digest."""
    scratch = Scratch(pages.sparkSession, "revisits")
    digest = F.when(F.octet_length("html") >= least, F.sha2(F.col("html").cast("binary"), 256)).alias("kf_digest")
    known = scratch.write(pages.select("page_id", digest).where("kf_digest is not null"), "digests")
    groups = known.groupBy("kf_digest").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    links = known.join(groups, "kf_digest").where(~F.col("page_id").eqNullSafe(F.col("refers_to"))).distinct()
    links = links.select(F.col("page_id").alias("kf_page"), F.col("kf_digest").alias("kf_same"), "refers_to")
    links = scratch.write(links, "links")
    scratch.drop("digests")
    scratch.release()
    on = F.col("page_id").eqNullSafe(F.col("kf_page")) & (F.col("kf_digest") == F.col("kf_same"))
    return pages.select("page_id", "url", "html", digest).join(few(links), on, "left").select("page_id", "url", "html", "refers_to")


def write_archives(pages: DataFrame, folder: str, least: int = LEAST) -> DataFrame:
    """Writes the archives below ``folder`` and returns their index (not yet run: store it before use)."""
    store, path = open_store(folder)
    store.create_dir(path, recursive=True)
    return revisits(pages, least).mapInArrow(_write(folder), INDEX)


def _ranges(rows: list[tuple[str, int, int]]) -> Iterator[tuple[str, int, int, list[int]]]:
    """(file, begin, end, positions of records) of runs of neighbours, each within ``RANGE_BYTES`` or one record."""
    run: list[int] = []
    file, begin, end = "", 0, 0
    for i, (f, at, size) in enumerate(rows):
        if run and (f != file or at - end > GAP_BYTES or at + size - begin > RANGE_BYTES):
            yield file, begin, end, run
            run = []
        if not run:
            file, begin = f, at
        run.append(i)
        end = at + size
    if run:
        yield file, begin, end, run


def _read(folder: str, with_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = open_store(folder)
        handle, name = None, None
        for batch in batches:
            index = list(zip(*[batch.column(k).to_pylist() for k in ("file", "offset", "length")], strict=True))
            for file, begin, end, run_of in _ranges(index):
                if file != name:
                    if handle is not None:
                        handle.close()
                    handle, name = store.open_input_file(f"{path}/{file}"), file
                raw, rows = handle.read_at(end - begin, begin), []
                for i in run_of:
                    at = index[i][1] - begin
                    fields, payload = parse(zlib.decompress(raw[at : at + index[i][2]], 31))
                    kind, digest = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha1:")
                    size = int(fields["x-full-payload-length"])
                    if kind == "response" and (hashlib.sha1(payload).hexdigest() != digest or len(payload) != size):
                        raise ValueError(f"record at {file}:{index[i][1]} does not match its digest")
                    whole = lambda k: int(fields[k]) if fields.get(k) else None
                    rows.append((whole("x-page-id"), size, digest, kind, whole("x-refers-to-page-id"), fields["warc-target-uri"], payload if kind == "response" else None))
                cols = list(zip(*rows, strict=True))
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
                names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload"]
                n = 7 if with_payload else 6
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols[:n], kinds[:n], strict=True)], names[:n])
        if handle is not None:
            handle.close()

    return run


def read_archives(index: DataFrame, folder: str, with_payload: bool = False) -> DataFrame:
    """The records that ``index`` (or any selection of it) names."""
    ordered = index.select("file", "offset", "length").repartitionByRange("file", "offset").sortWithinPartitions("file", "offset")
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string" + ", payload binary" * with_payload
    return ordered.mapInArrow(_read(folder, with_payload), schema)


def archive_round_trip(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """Writes every page and reads the archives back through the index."""
    scratch = Scratch(pages.sparkSession, "warc")
    folder = f"{scratch.path}/archives"
    index = scratch.write(write_archives(pages.select("page_id", "url", "html"), folder, least), "index")
    return read_archives(index, folder).drop("url")
