"""Web archives (WARC 1.1) in Zstandard files, a frame for each record and a dictionary in front.

An archive begins with a skippable frame that holds its dictionary, as the public WARC-Zstandard
form lays down; then comes one frame for each record.  Archives go to a folder that driver and executors share.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ..plans.sizing import broadcast_if_small
from .common import in_batches, optional, settled

SKIPPABLE = 0x184D2A5D  # fixed value: magic number of the frame that holds the dictionary
DICTIONARY_MAGIC = b"\x37\xa4\x30\xec"  # fixed value: begins a Zstandard dictionary
FRAME_MAGIC = b"\x28\xb5\x2f\xfd"  # fixed value: begins a Zstandard frame
LEAST_REVISIT = 100  # bytes of a payload from which equal ones are stored once
ARCHIVE_BYTES = 64 << 20  # of records before compression, after which the next archive begins
SAMPLE_BYTES = 1 << 20  # of records of the archive that its dictionary is made from
DICTIONARY_BYTES = 32 << 10
CHUNK = 1 << 20
URN = "urn:page:"
ARCHIVES = "path string, records long, bytes long"
RECORDS = (
    "path string, record long, record_id string, target_uri string, page_id long, record_type string, "
    "refers_to long, payload_bytes long, payload_digest string, payload binary, error string"
)


# --- writing --------------------------------------------------------------------------------------


def mark_revisits(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html") -> DataFrame:
    """``page_id, url, payload, payload_digest, first_id``: first_id is null for a response.

    Of equal payloads of ``LEAST_REVISIT`` bytes or more, rows with the smallest id are responses
    and others revisit it; a row without an id revisits if any of its copies has one.
    """
    payload = F.coalesce(optional(pages, body_col, "string"), F.lit("")).cast("binary")
    rows = pages.select(
        optional(pages, id_col, "long").alias("page_id"), optional(pages, url_col, "string").alias("url"), payload.alias("payload")
    ).withColumn("payload_digest", F.sha2("payload", 256))
    large = rows.filter(F.octet_length("payload") >= LEAST_REVISIT)
    counted = large.groupBy("payload_digest").agg(F.count(F.lit(1)).alias("n"), F.min("page_id").alias("first_id"))
    # beyond a broadcast, adaptive execution splits the partition of a payload that many pages share
    firsts = broadcast_if_small(settled(counted.filter("n > 1 AND first_id IS NOT NULL").drop("n")))
    joined = rows.join(firsts, "payload_digest", "left")
    revisits = F.when(~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id"))
    return joined.select("page_id", "url", "payload", "payload_digest", revisits.alias("first_id"))


def write_archives(pages: DataFrame, folder: str, date: str | None = None) -> DataFrame:
    """Write marked pages as archives below a shared folder; ``path, records, bytes`` of each archive.

    Names hold the task attempt, and only archives of attempts that Spark committed are in the table, so what a
    lost attempt leaves is never read.
    """
    date = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    schema = pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        name = f"{folder}/part-{task.partitionId():05d}-{task.taskAttemptId()}"
        records = (
            _record(row, date, f"{name}/{i}")
            for i, row in enumerate(r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        )
        yield from in_batches(_write(records, name), schema)

    return settled(pages.mapInArrow(run, ARCHIVES))


def _write(records: Iterator[bytes], name: str) -> Iterator[tuple[str, int, int]]:
    number, held, size, last = 0, [], 0, False
    while not last:
        while size < SAMPLE_BYTES and not last:
            record = next(records, None)
            last = record is None
            if record is not None:
                held.append(record)
                size += len(record)
        if held:
            path = f"{name}-{number:04d}.warc.zst"
            files, place = pyarrow.fs.FileSystem.from_uri(path)
            files.create_dir(place.rpartition("/")[0], recursive=True)
            with files.open_output_stream(place, compression=None) as out:
                n, written, last = _write_archive(out, held, records)
            yield path, n, written
        number, held, size = number + 1, [], 0


def _write_archive(out: pa.NativeFile, held: list[bytes], records: Iterator[bytes]) -> tuple[int, int, bool]:
    dictionary = make_dictionary(held)
    written = 0
    if dictionary is not None:
        data = dictionary.as_bytes()
        out.write(struct.pack("<II", SKIPPABLE, len(data)) + data)
        written = 8 + len(data)
    compressor = zstandard.ZstdCompressor(3, dict_data=dictionary, write_checksum=True, write_content_size=True)
    n = size = 0
    while True:
        record = held[n] if n < len(held) else next(records, None)
        if record is None:
            return n, written, True
        frame = compressor.compress(record)
        out.write(frame)
        n, size, written = n + 1, size + len(record), written + len(frame)
        if n >= len(held) and size >= ARCHIVE_BYTES:
            return n, written, False


def make_dictionary(sample: list[bytes]) -> zstandard.ZstdCompressionDict | None:
    """A dictionary made from the first records of an archive, or None where they are too few for one."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, [x[:8192] for x in sample], k=512, d=8)
    except zstandard.ZstdError:
        return None


def _record(row: tuple, date: str, unique: str) -> bytes:
    page_id, url, payload, digest, first_id = row
    own = f"{URN}{page_id}" if page_id is not None else f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, unique)}"
    target = "".join(c if 32 < ord(c) < 127 else "".join(f"%{b:02X}" for b in c.encode()) for c in url or "") or own
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head if first_id is not None else head + payload
    fields = {
        "WARC-Type": "response" if first_id is None else "revisit",
        "WARC-Record-ID": f"<{own}>",
        "WARC-Date": date,
        "WARC-Target-URI": target,
        "Content-Type": "application/http; msgtype=response",
        "WARC-Block-Digest": f"sha256:{hashlib.sha256(block).hexdigest()}",
        "WARC-Payload-Digest": f"sha256:{digest}",
    }
    if first_id is not None:
        fields["WARC-Refers-To"] = f"<{URN}{first_id}>"
        fields["WARC-Profile"] = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
    fields["Content-Length"] = str(len(block))
    lines = "".join(f"{k}: {v}\r\n" for k, v in fields.items())
    return f"WARC/1.1\r\n{lines}\r\n".encode() + block + b"\r\n\r\n"


# --- reading --------------------------------------------------------------------------------------


class BadRecord(ValueError):
    """What is wrong with a record or an archive."""


def read_archives(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """``RECORDS`` of the archives in the column ``path``; a row with ``error`` for what is not valid.

    Frames are decoded one by one as the file is read.  After a bad frame the rest of its archive cannot be
    found and counts as one error; after a bad record reading goes on.  A null path has no records, and a path
    without a file that may be read is one error; other failures of the file system end the task, which is tried again.
    payload_bytes and payload_digest are of the full payload, also for revisits, whose payload is not
    there.  ``payloads=False`` checks the payloads and leaves them out.
    """
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    schema = pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in RECORDS.split(", ")])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                number = -1
                try:
                    for number, data in enumerate(frames(path) if path is not None else ()):
                        try:
                            found = parse(data)
                        except BadRecord as e:
                            yield (path, number, *[None] * 8, str(e))
                        else:
                            yield (path, number, *found[:-1], found[-1] if payloads else None, None)
                except (BadRecord, zstandard.ZstdError, pa.ArrowInvalid, FileNotFoundError, PermissionError) as e:
                    yield (path, number + 1, *[None] * 8, str(e))

    paths = archives.select("path").repartition(max(1, archives.count()))
    return paths.mapInArrow(lambda b: in_batches(rows(b), schema, 256), RECORDS)


def frames(path: str) -> Iterator[bytes]:
    """The content of each frame of an archive, with its dictionary if it begins with one."""
    files, place = pyarrow.fs.FileSystem.from_uri(path)
    if files.get_file_info(place).type != pyarrow.fs.FileType.File:
        raise BadRecord("there is no such file")
    with files.open_input_stream(place, compression=None) as stream:
        data = stream.read(8)
        dictionary = None
        if len(data) == 8 and struct.unpack("<I", data[:4])[0] == SKIPPABLE:
            length = struct.unpack("<I", data[4:])[0]
            raw = stream.read(length)
            if len(raw) < length:
                raise BadRecord("the dictionary frame is cut off")
            if raw[:4] == FRAME_MAGIC:
                raw = zstandard.ZstdDecompressor().decompress(raw, max_output_size=64 << 20)
            if raw[:4] != DICTIONARY_MAGIC:
                raise BadRecord("the leading frame holds no dictionary")
            dictionary, data = zstandard.ZstdCompressionDict(raw), b""
        decoder = zstandard.ZstdDecompressor(dict_data=dictionary) if dictionary else zstandard.ZstdDecompressor()
        while True:
            data = data or stream.read(CHUNK)
            if not data:
                return
            frame, parts = decoder.decompressobj(), []
            while True:
                parts.append(frame.decompress(data))
                if frame.eof:
                    data = frame.unused_data
                    break
                data = stream.read(CHUNK)
                if not data:
                    raise BadRecord("the last frame is cut off")
            yield b"".join(parts)


def parse(data: bytes) -> tuple:
    """Record id, target, page id, type, the page referred to, bytes and digest of the payload, and the payload."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.split(b"\r\n")
    if not gap or version not in (b"WARC/1.0", b"WARC/1.1"):
        raise BadRecord("no WARC header")
    fields = _fields(lines)
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in fields:
            raise BadRecord(f"{name} is missing")
    length = _number(fields["content-length"])
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise BadRecord(f"content-length is {length}, the block has {len(rest) - 4} bytes")
    block = rest[:length]
    _check_digest("block", block, fields.get("warc-block-digest"))
    kind, record_id = fields["warc-type"], fields["warc-record-id"]
    http, gap, payload = block.partition(b"\r\n\r\n")
    stated = None
    if fields.get("content-type", "").startswith("application/http"):
        if not gap or not http.startswith(b"HTTP/"):
            raise BadRecord("no HTTP header")
        stated = _fields(http.split(b"\r\n")[1:]).get("content-length")
    else:
        payload = block
    digest = fields.get("warc-payload-digest")
    if kind == "revisit":
        refers = _page(fields.get("warc-refers-to"))
        if digest is None or stated is None:
            raise BadRecord("a revisit without digest or length of its payload")
        return record_id, fields.get("warc-target-uri"), _page(record_id), kind, refers, _number(stated), digest.partition(":")[2], None
    if stated is not None and _number(stated) != len(payload):
        raise BadRecord(f"the HTTP length is {stated}, the payload has {len(payload)} bytes")
    _check_digest("payload", payload, digest)
    own = hashlib.sha256(payload).hexdigest()
    return record_id, fields.get("warc-target-uri"), _page(record_id), kind, None, len(payload), own, payload


def _fields(lines: list[bytes]) -> dict[str, str]:
    out = {}
    for line in lines:
        name, colon, value = line.partition(b":")
        if not colon or not name.strip():
            raise BadRecord("a header line without a name")
        out[name.strip().lower().decode("utf-8", "replace")] = value.strip().decode("utf-8", "replace")
    return out


def _number(text: str) -> int:
    if not (text.isascii() and text.isdigit()):
        raise BadRecord(f"no length: {text[:40]}")
    return int(text)


def _check_digest(what: str, data: bytes, digest: str | None) -> None:
    if digest and digest.startswith("sha256:") and hashlib.sha256(data).hexdigest() != digest[7:]:
        raise BadRecord(f"the {what} does not have the digest of its header")


def _page(record_id: str | None) -> int | None:
    text = (record_id or "").strip("<>")
    number = text.removeprefix(URN)
    return int(number) if text.startswith(URN) and number.lstrip("-").isdigit() else None
