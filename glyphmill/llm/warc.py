"""WARC (1): archives in the shared folder, an index first, and coalesced byte-range reads of selected records.

write(pages) writes one gzip-per-record archive per task and returns the index: record_id, url, digest, record_type, file,
offset, length. Which record of equal payloads is the response is settled before, from digests alone; the payloads are
not shuffled unless the repeated digests exceed a counted bound. File names are new for each attempt of a task and the
index is stored, so a task that runs again leaves at most an unused file.

read(index rows) deals the selected records by file and stretch of CHUNK bytes, sorts them by offset and joins neighbours
with gaps of up to GAP bytes into one range read of at most RANGE bytes, each record is unzipped and parsed, digests are computed
anew. Any store that Arrow opens by URI will do.

Cases. Null html: an empty payload. Null url: no target header. Null page_id: a response with a null id, no revisit refers to it.
Repeated rows: rows with the response's page_id are all responses. Equal payloads shorter than least_bytes: all responses.
Empty table: an empty index. Very long payloads: a record is held whole in one task and must be under Arrow's 2 GB a value.
Other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.common import BROADCAST_IDS, new_path, over_batches, stored

CHUNK, GAP, RANGE, LEVEL = 16 << 20, 64 << 10, 8 << 20, 1
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
URN = "urn:page:"
INDEX = "page_id long, url string, digest string, record_type string, refers_to long, file string, `offset` long, length long"


def base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def clean(url: str) -> str:
    """A header's value: control characters as percent escapes."""
    return "".join(c if ord(c) > 32 and ord(c) != 127 else "".join(f"%{b:02X}" for b in c.encode()) for c in url)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> tuple[bytes, str]:
    """A record and its payload's digest."""
    digest = base32(payload)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{URN}{page_id}>" if page_id is not None else f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{url}{digest}')}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {clean(url)}")
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{URN}{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", digest


def parsed(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and payload of an unzipped record; the payload of a revisit is empty."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = rest[: int(headers["content-length"])]
    if headers.get("content-type", "").startswith("application/http"):
        block = block.partition(b"\r\n\r\n")[2]
    return headers, block


def page_of(urn: str | None) -> int | None:
    name = (urn or "").strip("<>")
    return int(name.removeprefix(URN)) if name.startswith(URN) else None


def write(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """Writes the archives now and returns their index."""
    spark = pages.sparkSession
    payload = F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload")).withColumn("d", F.unhex(F.sha1("payload")))
    several = stored(rows.where(f"length(payload) >= {int(least_bytes)}").groupBy("d").agg(F.max("page_id").alias("response"), F.count("*").alias("n")).where("n > 1 and response is not null").select("d", "response"), "digests")
    small = several.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    rows = rows.join(F.broadcast(several) if small else several, "d", "left").select("page_id", "url", "payload", "response")
    folder = new_path(spark, "warc")
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = fs.FileSystem.from_uri(folder)
        out, at, name = None, 0, f"{uuid.uuid4().hex}.warc.gz"
        try:
            for b in batches:
                index = []
                for page_id, url, payload, response in zip(*(c.to_pylist() for c in b.columns)):
                    revisit = page_id is not None and response is not None and page_id != response
                    raw, digest = record(page_id, url, payload, response, revisit)
                    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                    raw = z.compress(raw) + z.flush()
                    if out is None:
                        store.create_dir(path, recursive=True)
                        out = store.open_output_stream(f"{path}/{name}", compression=None)
                    out.write(raw)
                    index.append((page_id, url, digest, "revisit" if revisit else "response", response if revisit else None, name, at, len(raw)))
                    at += len(raw)
                if index:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*index), schema)], schema=schema)
        finally:
            if out is not None:
                out.close()

    index = over_batches(rows, work, INDEX)
    return stored(index.withColumn("file", F.concat(F.lit(f"{folder}/"), "file")), "cdx")


def read(index: DataFrame, payloads: bool = True) -> DataFrame:
    """page_id, url, record_type, refers_to, payload_digest, payload_bytes, payload of the records that index rows name.

    A revisit has its header's digest, null payload and null payload_bytes (see resolved); payloads=False leaves payload null."""
    n = max(12, int(index.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = index.select("file", "offset", "length").withColumn("chunk", F.floor(F.col("offset") / CHUNK)).repartition(n, "file", "chunk").sortWithinPartitions("file", "offset").select("file", "offset", "length")
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, handle = None, None

        def ranges() -> Iterator[tuple[str, list[tuple[int, int]]]]:
            now, held = None, []
            for b in batches:
                for file, offset, length in zip(*(c.to_pylist() for c in b.columns)):
                    if held and (file != now or offset - sum(held[-1]) > GAP or offset + length - held[0][0] > RANGE):
                        yield now, held
                        held = []
                    now = file
                    held.append((offset, length))
            if held:
                yield now, held

        for file, spans in ranges():
            if file != name:
                store, path = fs.FileSystem.from_uri(file)
                if handle is not None:
                    handle.close()
                name, handle = file, store.open_input_file(path)
            begin = spans[0][0]
            data = handle.read_at(max(a + k for a, k in spans) - begin, begin)
            rows = []
            for a, k in spans:
                h, payload = parsed(zlib.decompress(data[a - begin : a - begin + k], 31))
                revisit = h["warc-type"] == "revisit"
                rows.append((page_of(h["warc-record-id"]), h.get("warc-target-uri"), h["warc-type"], page_of(h.get("warc-refers-to")), h["warc-payload-digest"].removeprefix("sha1:") if revisit else base32(payload), None if revisit else len(payload), payload if payloads and not revisit else None))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
        if handle is not None:
            handle.close()

    return over_batches(dealt, work, "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary")


def resolved(records: DataFrame) -> DataFrame:
    """Gives revisits the payload_bytes and the digest of the response they refer to."""
    records = stored(records.drop("payload"), "records")
    own, again = records.where("record_type <> 'revisit'"), records.where("record_type = 'revisit'")
    of = own.where("page_id is not null").groupBy(F.col("page_id").alias("refers_to"), "payload_digest").agg(F.max("payload_bytes").alias("payload_bytes"))
    again = again.drop("payload_bytes").join(of, ["refers_to", "payload_digest"], "left").select(records.columns)
    return own.unionByName(again)
