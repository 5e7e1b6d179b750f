"""Operator 12: WARC archives with an index that is written first and read first.

Writing: each task compresses its records as gzip members of their own, one after the other, into an archive in the shared
folder, and yields one index row a record: archive, offset, length, target URL, payload digest, record type. The index is
a table that Spark commits; it names only archives of tasks that ended, so what a lost or repeated task wrote is never
read. Reading: the selected rows of the index are put in order of archive and offset; a task reads ranges that lie
together in one request, cuts the members out of it and checks each payload's digest.

Of records with equal payloads of at least ``least`` bytes that with the largest page_id holds the payload (response); the
others are revisit records, which name it and hold only the HTTP head, with the payload's length and digest, as the
format has it. Only digests that occur twice are joined to the pages, from a written table: where it is small Spark sends
it to all tasks, else the join's exchanges are plain and a frequent digest is split.

Null html is an empty payload; a null page_id counts below all others, and where no copy has one each is a response. Rows
that repeat payload and largest page_id are the same page: each of them is a response. A null url gives a record without
target. Pages of any length are read whole. Extra columns are ignored. An empty table gives an empty index.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import materialize, partitions, shared_dir, small_batches, table

LEAST = 1000  # bytes of a payload that is worth a revisit record
ROLL = 512 << 20  # bytes of an archive, after which a task starts another
GAP, REQUEST = 64 << 10, 8 << 20  # ranges this near are read together, up to so many bytes at once
DATE = "2000-01-01T00:00:00Z"  # the pages have no date
INDEX = "archive string, offset long, length long, url string, digest string, page_id long, record_type string"


def typed(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """page_id, url, html (binary), digest, record_type, refers_to."""
    html = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html")).withColumn("digest", F.sha1("html"))
    twice = rows.where(F.octet_length("html") >= least).groupBy("digest").agg(F.max("page_id").alias("holder"), F.count("*").alias("copies")).where("copies > 1")
    out = rows.join(materialize(twice, "copies"), "digest", "left")
    revisit = F.col("copies").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("holder"))
    return out.select("page_id", "url", "html", "digest", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("holder")).alias("refers_to"))


def _name(page) -> str:
    return f"<urn:page:{'' if page is None else page}>"


def _page(name: str) -> int | None:
    got = name.removeprefix("<urn:page:").removesuffix(">")
    return int(got) if got else None


def record(page, url, html: bytes, digest: str, kind: str, refers) -> bytes:
    """One record: its head, a block and two line ends. The block is the HTTP head, and of a response the payload too."""
    label = base64.b32encode(bytes.fromhex(digest)).decode()
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(html)}\r\n\r\n".encode()
    if kind == "response":
        block += html
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_name(page)}", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{label}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if kind == "revisit":
        head += [f"WARC-Refers-To: {_name(refers)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def write(pages: DataFrame, folder: str, least: int = LEAST, roll: int = ROLL) -> DataFrame:
    """Archives of all pages in ``folder``, and their index as a written table."""
    small_batches(pages.sparkSession)

    def run(batches):
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        out, at, path = None, 0, None
        try:
            for batch in batches:
                rows = []
                for page, url, html, digest, kind, refers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if out is None or at >= roll:
                        if out is not None:
                            out.close()
                        path, at = f"{root}/{uuid.uuid4().hex}.warc.gz", 0
                        out = store.open_output_stream(path, compression=None)
                    member = gzip.compress(record(page, url, html, digest, kind, refers), 6, mtime=0)
                    out.write(member)
                    rows.append((path.removeprefix(root + "/"), at, len(member), url, digest, page, kind))
                    at += len(member)
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
        finally:
            if out is not None:
                out.close()

    names = [c.split()[0] for c in INDEX.split(", ")]
    types = [pa.int64() if c.endswith("long") else pa.string() for c in INDEX.split(", ")]
    rows = typed(pages, least).select("page_id", "url", "html", "digest", "record_type", "refers_to")
    return materialize(rows.mapInArrow(run, INDEX), "warc-index")


def parse(data: bytes) -> dict:
    """Heads and payload of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    sent = dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])
    return {
        "page_id": _page(fields["WARC-Record-ID"]), "url": fields.get("WARC-Target-URI"), "record_type": fields["WARC-Type"], "payload": payload,
        "bytes": int(sent["Content-Length"]), "digest": base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex(), "refers_to": _page(fields["WARC-Refers-To"]) if "WARC-Refers-To" in fields else None,
    }


def ranges(rows: list[tuple[str, int, int]], gap: int = GAP, most: int = REQUEST):
    """(archive, offset, length) in this order: lists of rows that one request serves."""
    now: list = []
    for row in rows:
        if now and (row[0] != now[0][0] or row[1] - (now[-1][1] + now[-1][2]) > gap or row[1] + row[2] - now[0][1] > most):
            yield now
            now = []
        now.append(row)
    if now:
        yield now


def read(index: DataFrame, folder: str, payload: bool = False) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to (and the payload of responses) of the records in ``index``,
    which may be any selection of the index of ``write``. Length and digest of a response are those of the bytes that were read; bytes
    that differ from the record's digest are an error."""

    def run(batches):
        store, root = fs.FileSystem.from_uri(folder)
        opened = (None, None)
        for batch in batches:
            for group in ranges(list(zip(*(c.to_pylist() for c in batch.columns), strict=True))):
                name, first = group[0][0], group[0][1]
                if opened[0] != name:
                    if opened[1] is not None:
                        opened[1].close()
                    opened = (name, store.open_input_file(f"{root}/{name}"))
                data = opened[1].read_at(group[-1][1] + group[-1][2] - first, first)
                rows = []
                for _, offset, length in group:
                    got = parse(zlib.decompress(data[offset - first : offset - first + length], 31))
                    if got["record_type"] == "response":
                        size, digest = len(got["payload"]), hashlib.sha1(got["payload"]).hexdigest()
                        if (size, digest) != (got["bytes"], got["digest"]):
                            raise ValueError(f"record at {offset} of {name} has another payload than it says")
                    rows.append((got["page_id"], got["url"], got["bytes"], got["digest"], got["record_type"], got["refers_to"], got["payload"]))
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=False)], names=names)
        if opened[1] is not None:
            opened[1].close()

    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + (", payload binary" if payload else "")
    names = [c.split()[0] for c in schema.split(", ")]
    types = [{"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[c.split()[1]] for c in schema.split(", ")]
    spot = index.select("archive", "offset", "length")
    ordered = spot.repartitionByRange(partitions(index.sparkSession), "archive", "offset").sortWithinPartitions("archive", "offset")
    return ordered.mapInArrow(run, schema)


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages, written and read back."""
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    index = write(table(spark, sf_dir, "pages"), folder)
    return read(index, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
