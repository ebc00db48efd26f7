"""WARC archives in Zstandard, one frame per record, with a shared dictionary.

An archive begins with a skippable frame that holds the dictionary. Every record
after it is a frame of its own, so a reader decodes one record at a time and
checks its headers and lengths before it goes on.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, hash_sample, shared_dir, small_batches, table

#: Fixed values of the formats: the dictionary's frame, a Zstandard frame, a Zstandard dictionary.
DICTIONARY_FRAME, FRAME, DICTIONARY = 0x184D2A5D, 0xFD2FB528, 0xEC30A437
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
#: Rows that a dictionary is trained on at most, bytes of each, and its size.
SAMPLE_ROWS, SAMPLE_BYTES, DICTIONARY_BYTES = 512, 16_384, 32_768
LEVEL, CHUNK = 3, 1 << 15
PAYLOAD_START = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "

RECORD_SCHEMA = "archive string, record_id string, record_type string, page_id long, target_uri string, refers_to long, payload_bytes long, payload_digest string, payload binary, error string"


def open_uri(uri: str) -> tuple[fs.FileSystem, str]:
    """A file system and a path; Hadoop writes file: with one slash, Arrow with three."""
    return fs.FileSystem.from_uri("file://" + uri[5:] if uri.startswith("file:/") and not uri.startswith("file://") else uri)


def digest(payload: bytes) -> str:
    """SHA-1 in upper-case base32 without a prefix."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def train_dictionary(pages: DataFrame, payload: str = "html", rows: int = SAMPLE_ROWS) -> bytes:
    """A dictionary from the ``rows`` different payloads with the smallest hashes; empty if they are too few."""
    starts = pages.filter(F.length(payload) > 0).select(F.xxhash64(F.substring(payload, 1, SAMPLE_BYTES)).alias("h"), F.substring(payload, 1, SAMPLE_BYTES).alias("p"))
    different = starts.agg(F.approx_count_distinct("h")).first()[0]
    sample = hash_sample(starts, F.col("h"), rows, different, distinct=True).collect()
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, [r.p.encode()[:SAMPLE_BYTES] for r in sample]).as_bytes()
    except zstandard.ZstdError:
        return b""


def _urn(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def format_record(page_id: int | None, uri: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record. A revisit keeps the HTTP header, and so the payload's length, but not the payload."""
    block = PAYLOAD_START + b"%d\r\n\r\n" % len(payload) + (b"" if revisit else payload)
    # a line break inside a header value would end the header
    safe = (uri or "").replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_urn(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {safe}",
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
        *([f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_urn(refers_to)}", f"X-Refers-To-Page: {refers_to}"] if revisit else []),
        *([f"X-Page-ID: {page_id}"] if page_id is not None else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """The fields of one record; ``error`` says what is wrong with its headers, lengths or digest."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    out = {"record_id": fields.get("warc-record-id"), "record_type": fields.get("warc-type"), "target_uri": (fields.get("warc-target-uri") or "").replace("%0D", "\r").replace("%0A", "\n").replace("%25", "%")}
    out |= {name: int(fields[key]) if fields.get(key, "").lstrip("-").isdigit() else None for name, key in (("page_id", "x-page-id"), ("refers_to", "x-refers-to-page"))}
    out["error"] = _fault(lines, fields, gap, rest)
    if out["error"] is None:
        http, _, payload = rest[:-4].partition(b"\r\n\r\n")
        said = [x.split(b":")[1].strip() for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
        out |= {"payload_bytes": int(said[0]) if said and said[0].isdigit() else None, "payload_digest": fields["warc-payload-digest"].removeprefix("sha1:"), "payload": payload}
        if out["payload_bytes"] is None:
            out["error"] = "no payload length"
        elif out["record_type"] == "response" and (len(payload), digest(payload)) != (out["payload_bytes"], out["payload_digest"]):
            out["error"] = "payload differs from its length or digest"
    return out


def _fault(lines: list[str], fields: dict[str, str], gap: bytes, rest: bytes) -> str | None:
    if lines[0] not in ("WARC/1.0", "WARC/1.1") or not gap:
        return "no WARC header"
    if missing := [k for k in ("warc-type", "warc-record-id", "warc-date", "content-length", "warc-payload-digest") if k not in fields]:
        return f"no {missing[0]}"
    if fields["warc-type"] not in ("response", "revisit"):
        return "unknown record type"
    if not fields["content-length"].isdigit() or int(fields["content-length"]) + 4 != len(rest) or not rest.endswith(b"\r\n\r\n"):
        return "length differs from Content-Length"
    return None


def dictionary_frame(dictionary: bytes) -> bytes:
    packed = zstandard.ZstdCompressor(level=LEVEL).compress(dictionary)
    return struct.pack("<II", DICTIONARY_FRAME, len(packed)) + packed


def read_archive(stream) -> Iterator[bytes]:
    """Records of one open archive, decoded one frame after the other in constant memory."""
    head = stream.read(8)
    dictionary = None
    if len(head) == 8 and struct.unpack("<I", head[:4])[0] == DICTIONARY_FRAME:
        size = struct.unpack("<I", head[4:])[0]
        raw = stream.read(size)
        if len(raw) != size:
            raise ValueError("the dictionary's frame is cut short")
        if raw[:4] == struct.pack("<I", FRAME):
            raw = zstandard.ZstdDecompressor().decompress(raw)
        if raw[:4] != struct.pack("<I", DICTIONARY):
            raise ValueError("the leading frame holds no dictionary")
        dictionary, head = zstandard.ZstdCompressionDict(raw), b""
    decoder = zstandard.ZstdDecompressor(dict_data=dictionary) if dictionary else zstandard.ZstdDecompressor()
    frame, parts, data, begun = decoder.decompressobj(), [], head, False
    while data or (data := stream.read(CHUNK)):
        parts.append(frame.decompress(data))
        data, begun = b"", True
        if frame.eof:
            yield b"".join(parts)
            data, frame, parts, begun = frame.unused_data, decoder.decompressobj(), [], False
    if begun:
        raise ValueError("the last frame is cut short")


def write_warc(pages: DataFrame, folder: str, dictionary: bytes, key: str = "page_id", uri: str = "url", payload: str = "html") -> DataFrame:
    """Write an archive per partition below ``folder``, a URI that all executors reach; returns (archive, records).

    ``pages`` also has ``refers_to`` and ``revisit``. An archive gets a name of
    its own for every attempt, and only the names returned count: a lost
    executor's half-written file is never read. The result is written out, so
    that no later action writes archives again.
    """
    small_batches(pages.sparkSession)
    shared = pages.sparkSession.sparkContext.broadcast(dictionary)  # DICTIONARY_BYTES at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = (b for b in batches if b.num_rows)
        if (first := next(batches, None)) is None:
            return
        files, path = open_uri(folder)
        files.create_dir(path, recursive=True)
        name = f"{uuid.uuid4().hex}.warc.zst"
        held = zstandard.ZstdCompressionDict(shared.value) if shared.value else None
        packer, count = zstandard.ZstdCompressor(level=LEVEL, dict_data=held), 0
        with files.open_output_stream(f"{path}/{name}") as out:
            if held:
                out.write(dictionary_frame(shared.value))
            while first is not None:
                for p, u, body, r, again in zip(*(first.column(k).to_pylist() for k in range(5)), strict=True):
                    out.write(packer.compress(format_record(p, u, (body or "").encode(), r, again)))
                count += first.num_rows
                first = next(batches, None)
        yield pa.RecordBatch.from_pydict({"archive": [f"{folder}/{name}"], "records": [count]})

    return cut(pages.select(F.col(key).cast("long"), F.col(uri).cast("string"), F.col(payload).cast("string"), F.col("refers_to").cast("long"), "revisit").mapInArrow(run, "archive string, records long"))


def read_warc(archives: DataFrame, payloads: bool = True, rows: int = 256) -> DataFrame:
    """The records of the archives that column ``archive`` names, as ``RECORD_SCHEMA``.

    ``target_uri`` has its line breaks back. A record that fails a check has its
    ``error``, and no payload; an archive that can't be decoded further ends
    with a row that has only the archive and the error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in RECORD_SCHEMA.split(", ")]
        kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
        schema = pa.schema([(n, kinds[x.split()[1]]) for n, x in zip(names, RECORD_SCHEMA.split(", "), strict=True)])

        def records(archive: str) -> Iterator[dict]:
            files, path = open_uri(archive)
            try:
                with files.open_input_stream(path) as stream:
                    for data in read_archive(stream):
                        yield {"archive": archive, **parse_record(data)}
            except (zstandard.ZstdError, ValueError) as e:
                yield {"archive": archive, "error": str(e)}

        block: list[dict] = []
        for b in batches:
            for archive in b.column(0).to_pylist():
                for record in records(archive):
                    block.append(record if payloads else record | {"payload": None})
                    if len(block) == rows:
                        yield pa.RecordBatch.from_pylist(block, schema)
                        block = []
        if block:
            yield pa.RecordBatch.from_pylist(block, schema)

    # one task deals out the names in turn, so that each reading task gets one archive
    names = archives.select("archive").distinct().coalesce(1)
    return names.repartition(max(1, archives.count())).mapInArrow(run, RECORD_SCHEMA)


def with_revisits(pages: DataFrame, key: str = "page_id", payload: str = "html") -> DataFrame:
    """``pages`` with ``revisit`` and ``refers_to``, which replace columns of that name.

    Of the rows with equal payloads (null: empty) those with the smallest key
    are responses, the others revisit it; a null key comes last. Only keys and
    digests are grouped, and only revisits are joined back, by key and digest:
    a payload that very many rows hold meets in no task.
    """
    # a row travels as one column, so that none of its own can clash with those added
    kept = F.struct(*(F.col(f"`{c}`") for c in pages.columns if c not in ("revisit", "refers_to"))).alias("row")
    rows = pages.select(kept, F.col(f"`{key}`").alias("key"), F.sha1(F.coalesce(F.col(f"`{payload}`"), F.lit("")).cast("binary")).alias("digest"))
    keyed = rows.select("key", "digest")
    least = keyed.groupBy("digest").agg(F.min("key").alias("least"), F.count("*").alias("n")).filter("n > 1").drop("n")
    again = keyed.join(least, "digest").filter(~F.col("key").eqNullSafe(F.col("least"))).distinct().withColumnsRenamed({"key": "again", "digest": "same"})
    placed = rows.join(again, F.col("key").eqNullSafe(F.col("again")) & (F.col("digest") == F.col("same")), "left")
    return placed.select("row.*", F.col("same").isNotNull().alias("revisit"), F.col("least").alias("refers_to"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written as a record and read back from the archives; a row for each, in no order.

    A null html is an empty payload. Of equal payloads the smallest page_id is
    the response. A record that fails a check of the reader ends the query.
    """
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    archives = write_warc(with_revisits(pages), folder, train_dictionary(pages))
    records = read_warc(archives, payloads=False)
    checked = F.when(F.col("error").isNull(), F.col("record_type")).otherwise(F.raise_error(F.concat_ws(": ", "archive", "error")))
    return records.select("page_id", "payload_bytes", "payload_digest", checked.alias("record_type"), "refers_to")


OP2_SQL = r"""
WITH hashed AS (
  SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, unhex(sha1(coalesce(html, ''))) AS bytes
  FROM pages),
bits AS (
  SELECT page_id, payload_bytes, bytes, replace(bytes::BIT::VARCHAR, ' ', '') AS b FROM hashed),
coded AS (
  SELECT page_id, payload_bytes,
    list_aggregate([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (substr(b, 1 + 5 * k::INT, 5)::BIT::INT) + 1, 1) FOR k IN range(32)], 'string_agg', '') AS payload_digest
  FROM bits),
least AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS first_id FROM coded)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM least
"""
