"""WARC archives compressed record by record with a Zstandard dictionary.

File layout (the public "Zstandard WARC" convention): a skippable frame, magic 0x184D2A5D, that holds the dictionary;
then one Zstandard frame for each WARC/1.1 record, with its content size, made with that dictionary. The dictionary is
trained in one executor task on a bounded sample of the records (`sample` rows, those with the smallest hash of page_id, each
cut to `sample_bytes` for the training only), so it does not grow with the input; every record is archived whole.

Copies: of pages with equal payloads of at least `min_bytes`, that with the largest page_id is written as `response`, the
others as `revisit` that names its record; smaller ones are all `response`. Equality is SHA-1 and length, grouped by a
partial aggregate; the largest id comes back by an equi-join which Spark splits where one payload has very many pages.

Executors write through `pyarrow.fs` to the folder named by its URI (file, hdfs, s3, gs ...) under a name of their own
attempt, and the manifest lists only files of attempts that succeeded: a lost or repeated task leaves an unlisted file.

Defined results: a null or empty html has payload length 0 and is grouped like any other; a null url is written as
`urn:page:<id>`; a page without page_id gets a record with a random name and reads back with a null page_id, it revisits a
copy that has an id and is a response where none has; line ends in a url are percent-encoded; repeated rows are written once
each; an empty table gives no archive and an empty result; other columns are never read.
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
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm.common import materialize, new_path, partitions, pieces
from parlance.llm.samples import fitted

SKIPPABLE = 0x184D2A5D
FILE_BYTES = 64_000_000
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"  # pages carry no time
MANIFEST = "path string, records long, bytes long"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"
_SPACE_ID = uuid.UUID("9c3c0a52-3a0e-4d1c-0000-000000000000").int


def record_id(page_id: int | None) -> str:
    """A record's name: a UUID whose low 64 bits are the page's id; a random one without id."""
    return f"<urn:uuid:{uuid.uuid4() if page_id is None else uuid.UUID(int=_SPACE_ID | (page_id & 0xFFFFFFFFFFFFFFFF))}>"


def page_of(name: str) -> int | None:
    whole = uuid.UUID(name.strip("<>").rpartition(":")[2]).int
    low = whole & 0xFFFFFFFFFFFFFFFF
    return None if whole - low != _SPACE_ID else low - (1 << 64) if low >> 63 else low


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def render(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, digest: str | None = None, n_bytes: int | None = None) -> bytes:
    """A record's bytes. A revisit keeps the payload's digest and length, not the payload."""
    target = (url or f"urn:page:{'' if page_id is None else page_id}").replace("\r", "%0D").replace("\n", "%0A")
    block = HTTP if refers_to is not None else HTTP + payload
    head = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": record_id(page_id),
        "WARC-Date": DATE,
        "WARC-Target-URI": target,
        "WARC-Payload-Digest": f"sha1:{digest or base32_sha1(payload)}",
        "X-Payload-Length": str(len(payload) if n_bytes is None else n_bytes),
    }
    if refers_to is not None:
        head |= {"WARC-Refers-To": record_id(refers_to), "WARC-Profile": PROFILE}
    head |= {"Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block))}
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse(record: bytes) -> dict:
    """The columns of RECORDS from a record's bytes; a response's payload must have the digest and length it names."""
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("no WARC/1.1 record")
    at = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(at["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError(f"record {at['WARC-Record-ID']} has a wrong length")
    kind, digest = at["WARC-Type"], at["WARC-Payload-Digest"].removeprefix("sha1:")
    payload = block.partition(b"\r\n\r\n")[2] if kind == "response" else None
    if payload is not None and (base32_sha1(payload), len(payload)) != (digest, int(at["X-Payload-Length"])):
        raise ValueError(f"record {at['WARC-Record-ID']} has a wrong payload")
    to = at.get("WARC-Refers-To")
    return {"page_id": page_of(at["WARC-Record-ID"]), "payload_bytes": int(at["X-Payload-Length"]), "payload_digest": digest, "record_type": kind, "refers_to": page_of(to) if to else None, "url": at["WARC-Target-URI"], "payload": payload}


def train(records: list[bytes], size: int = 65_536) -> bytes:
    """A Zstandard dictionary's bytes; of few or small records, raw content for one."""
    try:
        return zstandard.train_dictionary(size, records).as_bytes()
    except zstandard.ZstdError:
        return b"".join(records)[-size:]


def _dictionary(content: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(content) if content else None


def header_frame(dictionary: bytes) -> bytes:
    return struct.pack("<II", SKIPPABLE, len(dictionary)) + dictionary


def read_archive(stream) -> Iterator[bytes]:
    """The records of an open archive, one at a time."""
    magic, size = struct.unpack("<II", stream.read(8))
    if magic != SKIPPABLE:
        raise ValueError("the archive has no dictionary in front")
    content = _dictionary(stream.read(size))
    decoder = zstandard.ZstdDecompressor(dict_data=content) if content else zstandard.ZstdDecompressor()
    held = b""
    unit = None
    while chunk := held or stream.read(1 << 16):
        held = b""
        if unit is None:
            unit, parts = decoder.decompressobj(), []
        parts.append(unit.decompress(chunk))
        if unit.eof:
            held = unit.unused_data
            unit = None
            yield b"".join(parts)
    if unit is not None:
        raise ValueError("the archive ends within a record")


def link_copies(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, url, html, _digest (hex), _bytes and refers_to (null: a response)."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", "html", F.sha1(payload).alias("_digest"), F.octet_length(payload).cast("long").alias("_bytes"))
    last = materialize(rows.groupBy("_digest", "_bytes").agg(F.max("page_id").alias("_last"), F.count(F.lit(1)).alias("_n")).where((F.col("_n") > 1) & (F.col("_bytes") >= min_bytes)).drop("_n"), "warc-copies")
    return rows.join(last, ["_digest", "_bytes"], "left").select("page_id", "url", "html", "_digest", "_bytes", F.when(~F.col("_last").eqNullSafe(F.col("page_id")), F.col("_last")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0, level: int = 3, sample: int = 1_000, sample_bytes: int = 16_384, seed: int = 0) -> DataFrame:
    """Write `pages` (page_id, url, html) as archives in `folder`; returns the written manifest (path, records, bytes)."""
    chosen = pages.select("page_id").where("page_id is not null").distinct().orderBy(F.xxhash64("page_id", F.lit(seed)), "page_id").limit(sample)
    heads = pages.select("page_id", "url", F.substring(F.col("html"), 1, sample_bytes).alias("html")).join(F.broadcast(chosen), "page_id")  # `sample` ids
    heads = heads.groupBy(F.col("page_id").alias("doc_id")).agg(F.min(F.struct("url", "html")).alias("r")).select("doc_id", "r.*")

    def learn(batches: Iterator[pa.RecordBatch]) -> bytes:
        return train([render(r["doc_id"], r["url"], (r["html"] or "").encode()[:sample_bytes], None) for batch in batches for r in batch.to_pylist()])

    dictionary = fitted(heads, learn) or b""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        content = _dictionary(dictionary)
        encoder = zstandard.ZstdCompressor(level=level, dict_data=content) if content else zstandard.ZstdCompressor(level=level)
        where, base = fs.FileSystem.from_uri(folder)
        where.create_dir(base, recursive=True)
        done, out = [], None
        for batch in batches:
            for part in pieces([batch], "html"):
                for r in part.to_pylist():
                    if out is None:
                        done.append([f"{base}/{uuid.uuid4().hex}.warc.zst", 0, 0])
                        out = where.open_output_stream(done[-1][0], compression=None)
                        out.write(header_frame(dictionary))
                    payload = (r["html"] or "").encode()
                    digest = base64.b32encode(bytes.fromhex(r["_digest"])).decode()
                    out.write(encoder.compress(render(r["page_id"], r["url"], payload, r["refers_to"], digest, r["_bytes"])))
                    done[-1][1] += 1
                    if out.tell() >= FILE_BYTES:
                        done[-1][2] = out.tell()
                        out.close()
                        out = None
        if out is not None:
            done[-1][2] = out.tell()
            out.close()
        scheme = folder[: folder.index(base)] if base in folder else ""
        if done:
            yield pa.RecordBatch.from_pydict({"path": [scheme + p for p, _, _ in done], "records": [n for _, n, _ in done], "bytes": [n for _, _, n in done]})

    return materialize(link_copies(pages, min_bytes).mapInArrow(run, MANIFEST), "warc-manifest")


def read_archives(manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of the manifest's archives, one file after another in each task; `payloads=False` leaves their bytes out."""
    names = [x.split()[0] for x in RECORDS.split(", ")][: None if payloads else -1]
    schema = RECORDS if payloads else RECORDS.rpartition(",")[0]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()][: len(names)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                where, name = fs.FileSystem.from_uri(path)
                rows, size = [], 0
                with where.open_input_stream(name, compression=None) as stream:
                    for record in read_archive(stream):
                        rows.append(parse(record))
                        if not payloads:
                            rows[-1].pop("payload")
                        size += len(record) if payloads else 200
                        if size >= 8_000_000:
                            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in zip(names, types, strict=True)], names)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in zip(names, types, strict=True)], names)

    # A hash of a random name deals single files out evenly, whatever their number.
    return manifest.select("path").repartition(partitions(manifest), F.xxhash64("path")).mapInArrow(run, schema)


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write `pages` to a new folder in the shared one and read all records' heads and digests back."""
    folder = new_path(pages.sparkSession, "warc")
    return read_archives(write_archives(pages, folder, min_bytes), payloads=False)
