"""Dictionary-compressed WARC archives.

Each task writes its records to archives of its own in the shared folder: a leading skippable
frame holds the Zstandard dictionary, then every record is a frame of its own, so that a reader
can start anywhere. A manifest table names the finished archives; a lost task's half-written file
is in no manifest. Payloads move between executors only if the table of repeated digests is too
large to send to all of them, and then by digest with skewed digests split.
"""

from __future__ import annotations

import base64
import hashlib
import math
import re
import struct
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickwright.session import materialize, scratch_path

SKIPPABLE = 0x184D2A5D
DICTIONARY_BYTES = 64 << 10
SHORTEST = 8  # bytes of a segment worth a place in the dictionary
MATERIAL_BYTES = 1 << 19
RECORDS_MADE = 256
ARCHIVE_BYTES = 64 << 20
READ_BYTES = 1 << 20
DATE = "2000-01-01T00:00:00Z"
SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the URL name space


def record_type(pages: DataFrame, id_col: str, url_col: str, html_col: str, min_bytes: int) -> DataFrame:
    """(id, url, html, digest, n_bytes, target): target is the response's id for revisits, else null.

    Of equal payloads the largest id answers; a null id answers only where all are null. Rows that
    repeat the answering id are responses, too.
    """
    html = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), html.alias("html"))
    rows = rows.withColumn("digest", F.sha1("html")).withColumn("n_bytes", F.octet_length("html").cast("long"))
    large = rows.where(F.col("n_bytes") >= min_bytes)
    heads = large.groupBy("digest").agg(F.max("id").alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "head")
    heads = materialize(heads, "repeated-payloads")  # its exact size decides how it is joined
    revisit = F.col("head").isNotNull() & ~F.col("id").eqNullSafe(F.col("head"))
    return rows.join(heads, "digest", "left").select("id", "url", "html", "digest", "n_bytes", F.when(revisit, F.col("head")).alias("target"))


def record(page_id, url: str | None, html: bytes, digest: str, target, unique: str) -> bytes:
    """One WARC record; ``digest`` is lower-case hex."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(html)}\r\n\r\n".encode()
    block = head + (html if target is None else b"")
    kind = "response" if target is None else "revisit"
    own = uuid.uuid5(SPACE, f"page:{page_id}" if target is None else f"revisit:{page_id}:{unique}")
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{own}>", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    lines.append("WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(digest)).decode())
    if page_id is not None:
        lines.append(f"X-Page-Id: {page_id}")
    if target is not None:
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        lines.append(f"WARC-Refers-To: <urn:uuid:{uuid.uuid5(SPACE, f'page:{target}')}>")
        lines.append(f"X-Refers-To-Page-Id: {target}")
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """Fields of a record and, for responses, the payload; a wrong digest is an error."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"\r\nContent-Length: (\d+)", http)[1])
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    if fields["WARC-Type"] == "response":
        if len(payload) != size or hashlib.sha1(payload).hexdigest() != digest:
            raise ValueError(f"record {fields['WARC-Record-ID']} does not match its digest")
    else:
        payload = None
    return {"fields": fields, "payload": payload, "n_bytes": size, "digest": digest}


def segments(html: Column) -> Column:
    """A page cut behind every tag and line."""
    return F.explode(F.split(html, "(?<=>)|(?<=\n)"))


def dictionary_of(rows: DataFrame) -> bytes:
    """A Zstandard dictionary of the segments that save most, counted over all responses.

    A segment saves its bytes each time it occurs again. A histogram of the savings finds the best
    that have about ``MATERIAL_BYTES`` together; only these reach the driver.
    The library trains on made-up records that hold a segment the oftener the more it occurs; where
    there is too little to train on, the segments themselves are the dictionary.
    """
    import zstandard

    pages = rows.where(F.col("target").isNull() & (F.col("n_bytes") > 0)).select(segments(F.col("html")).alias("s"))
    pages = pages.select("s", F.xxhash64("s").alias("h"), F.octet_length("s").alias("n_bytes")).where(F.col("n_bytes").between(SHORTEST, DICTIONARY_BYTES // 4))
    counted = pages.groupBy("h", "n_bytes").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    # classes of nearly equal savings; of the class that does not fit whole, a share by hash
    step = F.floor(F.log2((F.col("n") - 1) * F.col("n_bytes")) * 8)
    counted = materialize(counted.withColumn("step", step), "segment-counts")
    room, least, share = MATERIAL_BYTES, math.inf, 0.0
    for r in counted.groupBy("step").agg(F.sum("n_bytes").alias("size")).orderBy(F.desc("step")).collect():
        if r["size"] > room:
            least, share = r["step"], room / r["size"]
            break
        room, least, share = room - r["size"], r["step"], 1.0
    taken = (F.col("step") > F.lit(float(least))) | ((F.col("step") == F.lit(float(least))) & (F.pmod("h", F.lit(1 << 20)) < int(share * (1 << 20))))
    rows_taken = counted.where(taken).orderBy(F.desc("step"), "h", "n_bytes").collect()
    chosen = [(i, r["h"], r["n_bytes"], r["n"]) for i, r in enumerate(rows_taken)]
    head = record(None, "", b"", hashlib.sha1(b"").hexdigest(), None, "")
    if not chosen:
        return head
    wanted = F.broadcast(rows.sparkSession.createDataFrame(chosen, "rank int, h bigint, n_bytes int, n bigint"))
    found = pages.join(wanted, ["h", "n_bytes"]).groupBy("rank").agg(F.min("s").alias("s"), F.min("n").alias("n")).orderBy("rank").collect()
    parts: list[list[bytes]] = [[head] for _ in range(RECORDS_MADE)]
    most = max(r["n"] for r in found)
    for r in found:
        times = max(1, round(RECORDS_MADE * r["n"] / most))
        for k in range(times):
            parts[(r["rank"] + k * RECORDS_MADE // times) % RECORDS_MADE].append(r["s"].encode())
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, [b"".join(p) for p in parts]).as_bytes()
    except zstandard.ZstdError:
        return b"".join([head, *[r["s"].encode() for r in found]])[:DICTIONARY_BYTES]


def compressor(dictionary: bytes):
    import zstandard

    return zstandard.ZstdCompressor(level=3, write_checksum=True, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)


def open_shared(path: str):
    """(file system, path in it) of a location in the shared folder."""
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(path)


def write_archives(rows: DataFrame, folder: str) -> DataFrame:
    """Writes the typed rows of ``record_type``; returns the manifest (path, records, bytes).

    Every archive begins with the same dictionary, see ``dictionary_of``.
    """
    dictionary = dictionary_of(rows)

    def write(batches):
        import pyarrow as pa

        press = compressor(dictionary)
        out, path, count, size = None, "", 0, 0
        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    path = f"{folder}/{uuid.uuid4().hex}.warc.zst"
                    fs, place = open_shared(path)
                    fs.create_dir(place.rpartition("/")[0], recursive=True)
                    out, count = fs.open_output_stream(place), 0
                    size = out.write(struct.pack("<II", SKIPPABLE, len(dictionary)) + dictionary)
                size += out.write(press.compress(record(row["id"], row["url"], row["html"].encode(), row["digest"], row["target"], f"{path}:{count}")))
                count += 1
                if size >= ARCHIVE_BYTES:
                    out.close()
                    out = None
                    yield pa.RecordBatch.from_pylist([{"path": path, "records": count, "bytes": size}])
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pylist([{"path": path, "records": count, "bytes": size}])

    return materialize(rows.select("id", "url", "html", "digest", "target").mapInArrow(write, "path string, records bigint, bytes bigint"), "warc-manifest")


def records_of(stream):
    """Decompressed records of an archive stream, one at a time."""
    import zstandard

    magic, size = struct.unpack("<II", stream.read(8))
    if magic != SKIPPABLE:
        raise ValueError("the archive has no dictionary frame")
    dictionary = stream.read(size)
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
    held = stream.read(READ_BYTES)
    while held:
        frame, parts = reader.decompressobj(), []
        while not frame.eof:
            if not held:
                raise ValueError("the archive ends inside a record")
            parts.append(frame.decompress(held))
            held = frame.unused_data if frame.eof else stream.read(READ_BYTES)
        yield b"".join(parts)
        held = held or stream.read(READ_BYTES)


def read_archives(manifest: DataFrame, id_type: str = "bigint", payloads: bool = True) -> DataFrame:
    """(id, url, payload, payload_bytes, payload_digest, record_type, refers_to) of all records."""
    n = max(1, manifest.count())

    def read(batches):
        import pyarrow as pa

        kinds = [pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.string()]
        names = ["id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"]

        def table(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, place = open_shared(path)
                with fs.open_input_stream(place) as stream:
                    rows, held = [], 0
                    for raw in records_of(stream):
                        r = parse(raw)
                        f = r["fields"]
                        payload = r["payload"] if payloads else None
                        rows.append((f.get("X-Page-Id"), f.get("WARC-Target-URI"), payload, r["n_bytes"], r["digest"], f["WARC-Type"], f.get("X-Refers-To-Page-Id")))
                        held += len(payload or b"") + 200
                        if held >= READ_BYTES * 4:
                            yield table(rows)
                            rows, held = [], 0
                    if rows:
                        yield table(rows)

    schema = "id string, url string, payload binary, payload_bytes bigint, payload_digest string, record_type string, refers_to string"
    out = manifest.select("path").repartition(n).mapInArrow(read, schema)
    return out.withColumns({c: F.col(c).cast(id_type) for c in ("id", "refers_to")})


def archive_pages(
    pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 1000
) -> DataFrame:
    """Archives every row of ``pages`` and returns the manifest. Null payloads are empty records,
    null urls leave their header out, other columns are not read; no row gives no archive."""
    folder = folder or scratch_path(pages.sparkSession, "warc")
    return write_archives(record_type(pages, id_col, url_col, html_col, min_bytes), folder)
