"""WARC: pages to archives, and a normaliser of archives that were compressed as one gzip stream.

``write_archives`` writes one response or revisit record per page into whole-file gzip streams. ``normalise`` inflates each
stream once, piece by piece, rewrites every record as a gzip member of its own, and writes a sidecar index of offsets, so that
single records can be read by place. ``read_records`` reads normalised archives back.

Archives are files in the shared folder, reached through the store that its address names (a local or mounted path, HDFS, an
object store). Each is written under a temporary name and renamed, so a task that runs again leaves whole files only. A task's
memory holds one piece of a stream and one record.

Results for odd input: a null page counts as empty, its record has no payload; records of equal payloads below ``least_bytes``
are all responses; equal payloads above it: the largest page id responds, the others revisit it, however many they are; rows
that repeat a page id are written each; an empty table gives no archives and an empty index; other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendaudit.llm.common import on_workers
from spendaudit.session import materialize, work_folder

LEAST_BYTES = 1000
PIECE = 1 << 18
LEVEL = 5
#: Every archive has this date: the tables have none, and equal input must give equal files.
DATE = "2000-01-01T00:00:00Z"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record: headers, an empty line, the block, two line ends. A null page id is written as nothing."""
    headers = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}", f"WARC-Target-URI: {' '.join((url or '').split())}", f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: text/html; charset=utf-8", f"X-Payload-Length: {len(payload)}",
    ]
    if refers_to is not None:
        headers += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    block = payload if refers_to is None else b""
    return "\r\n".join([*headers, f"Content-Length: {len(block)}", "", ""]).encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def parse_headers(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"no record begins here: {lines[0][:40]!r}")
    return {name.lower(): value.strip() for name, _, value in (line.partition(":") for line in lines[1:] if line)}


def inflate(file: BinaryIO) -> Iterator[bytes]:
    """The content of a gzip file of one or more members, in pieces of bounded size."""
    inflater, data = zlib.decompressobj(31), b""
    while True:
        data = data or file.read(PIECE)
        if not data:
            if not inflater.eof:
                raise ValueError("the gzip stream ends early")
            return
        if inflater.eof:
            inflater = zlib.decompressobj(31)
        yield inflater.decompress(data, 4 * PIECE)
        while inflater.unconsumed_tail:
            yield inflater.decompress(inflater.unconsumed_tail, 4 * PIECE)
        data = inflater.unused_data


def split_records(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes, bytes]]:
    """(headers, block, whole record) of each record of a stream; holds one record and one piece at a time."""
    buffer, ended = bytearray(), False

    def more() -> bool:
        nonlocal ended
        piece = next(pieces, None)
        ended = piece is None
        buffer.extend(piece or b"")
        return not ended

    while True:
        while (at := buffer.find(b"\r\n\r\n")) < 0:
            if not more():
                if buffer.strip():
                    raise ValueError("a record is cut off")
                return
        headers = parse_headers(bytes(buffer[:at]))
        size = int(headers["content-length"])
        end = at + 4 + size + 4
        while len(buffer) < end:
            if not more():
                raise ValueError("a record is cut off")
        whole = bytes(buffer[:end])
        yield headers, whole[at + 4 : at + 4 + size], whole
        del buffer[:end]


def _store(folder: str):
    """File system and path of a folder's address."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


def _put(store, path: str, write) -> None:
    """Write a file under a temporary name, then rename it."""
    partial = f"{path}.{uuid.uuid4().hex[:8]}.partial"
    with store.open_output_stream(partial, compression=None) as out:
        write(out)
    store.move(partial, path)


def revisits(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """page_id, digest, refers_to of the pages that revisit another. Narrow rows only: one digest may be that of a third of all pages."""
    rows = pages.filter(F.col("size") >= least_bytes).select("page_id", "digest")
    shared = rows.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.min("page_id").alias("least")).filter("least < refers_to")
    found = rows.join(materialize(shared.select("digest", "refers_to"), "shared-payloads"), "digest").filter("page_id < refers_to")
    return found.select("page_id", "digest", "refers_to").distinct()


def write_archives(pages: DataFrame, folder: str, least_bytes: int = LEAST_BYTES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write every page's record into monolithic archives, one for each Arrow batch of a task; returns their names and counts.

    The result is written as a table: a task that runs again writes archives of other names, and only those of the attempts
    that count are in it. Revisits are found on narrow rows and joined by page and digest.
    """
    html = F.col(f"`{html_col}`").cast("string")
    payload = F.coalesce(html, F.lit("")).cast("binary")
    texts = on_workers(pages).select(
        F.col(f"`{id_col}`").cast("long").alias("page_id"), F.sha1(payload).alias("digest"), F.octet_length(payload).alias("size"),
        F.col(f"`{url_col}`").cast("string").alias("url"), html.alias("html"),
    )
    rows = texts.join(revisits(texts, least_bytes), ["page_id", "digest"], "left").select("page_id", "digest", "url", "html", "refers_to")

    def run(batches):
        store, base = _store(folder)
        for batch in batches:
            if not batch.num_rows:
                continue
            name = uuid.uuid4().hex

            def write(out, batch=batch):
                packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                for at in range(batch.num_rows):
                    page_id, digest, url, html, refers_to = (c[at].as_py() for c in batch.columns)
                    payload = (html or "").encode("utf-8", "surrogatepass")
                    out.write(packer.compress(record(page_id, url, payload, digest, refers_to)))
                out.write(packer.flush())

            _put(store, f"{base}/{name}.warc.gz", write)
            yield pa.RecordBatch.from_pydict({"archive": [name], "records": pa.array([batch.num_rows], pa.int64())})

    _make_folder(folder)
    return materialize(rows.mapInArrow(run, "archive string, records long"), "archives")


def dealt(archives: DataFrame) -> DataFrame:
    """The names of the archives, dealt over the cluster: a task should have one or a few."""
    on_workers(archives)
    at_most = 20 * archives.sparkSession.sparkContext.defaultParallelism
    return archives.select("archive").repartition(max(1, min(archives.count(), at_most)))


def _make_folder(folder: str) -> None:
    store, base = _store(folder)
    store.create_dir(base, recursive=True)


INDEX = "archive string, offset long, length long, page_id long, record_type string, refers_to long, payload_bytes long, payload_digest string"


def _entry(archive: str, offset: int, length: int, headers: dict[str, str]) -> dict:
    def page(name: str) -> int | None:
        number = headers.get(name, "")[len("<urn:page:") : -1]
        return int(number) if number else None

    return {
        "archive": archive, "offset": offset, "length": length, "page_id": page("warc-record-id"), "record_type": headers["warc-type"],
        "refers_to": page("warc-refers-to"), "payload_bytes": int(headers["x-payload-length"]),
        "payload_digest": headers["warc-payload-digest"].removeprefix("sha1:"),
    }


def normalise(archives: DataFrame, source: str, target: str, remove_source: bool = False) -> DataFrame:
    """Rewrite every archive of the table (column archive) with one gzip member per record, and a sidecar ``.idx`` of JSON lines.

    An archive that is already there as a whole, sidecar included, is not made again. Returns the names, written as a table.
    """

    def run(batches):
        from pyarrow import fs

        (store, base), (new_store, new_base) = _store(source), _store(target)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                done = f"{new_base}/{name}.idx"
                if new_store.get_file_info(done).type == fs.FileType.NotFound:
                    sidecar: list[dict] = []

                    def write(out, name=name, sidecar=sidecar):
                        offset = 0
                        with store.open_input_stream(f"{base}/{name}.warc.gz", compression=None) as file:
                            for headers, _, whole in split_records(inflate(file)):
                                packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                                member = packer.compress(whole) + packer.flush()
                                out.write(member)
                                sidecar.append(_entry(name, offset, len(member), headers))
                                offset += len(member)

                    _put(new_store, f"{new_base}/{name}.warc.gz", write)
                    lines = "".join(json.dumps(entry) + "\n" for entry in sidecar).encode()
                    _put(new_store, done, lambda out, lines=lines: out.write(lines))
                if remove_source and store.get_file_info(f"{base}/{name}.warc.gz").type != fs.FileType.NotFound:
                    store.delete_file(f"{base}/{name}.warc.gz")
            yield pa.RecordBatch.from_pydict({"archive": batch.column(0)})

    _make_folder(target)
    return materialize(dealt(archives).mapInArrow(run, "archive string"), "normalised")


def read_index(archives: DataFrame, folder: str) -> DataFrame:
    """The sidecar entries of the archives."""

    def run(batches):
        store, base = _store(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with store.open_input_stream(f"{base}/{name}.idx", compression=None) as file:
                    entries = [json.loads(line) for line in file.read().splitlines()]
                yield pa.RecordBatch.from_pylist(entries, _index_schema())

    return dealt(archives).mapInArrow(run, INDEX)


def _index_schema() -> pa.Schema:
    types = {"long": pa.int64(), "string": pa.string()}
    return pa.schema([(name, types[kind]) for name, kind in (part.split() for part in INDEX.split(", "))])


def read_records(archives: DataFrame, folder: str) -> DataFrame:
    """Every record of normalised archives, read member by member at the places that the sidecars give.

    The payload's digest is computed anew and held against the record's header; a difference raises an error.
    """

    def run(batches):
        store, base = _store(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with store.open_input_stream(f"{base}/{name}.idx", compression=None) as file:
                    entries = [json.loads(line) for line in file.read().splitlines()]
                rows, held = [], 0
                with store.open_input_file(f"{base}/{name}.warc.gz") as file:
                    for entry in entries:
                        file.seek(entry["offset"])
                        whole = zlib.decompress(file.read(entry["length"]), 31)
                        headers, block, _ = next(split_records(iter([whole])))
                        found = _entry(name, entry["offset"], entry["length"], headers)
                        if found != entry or found["record_type"] == "response" and hashlib.sha1(block).hexdigest() != found["payload_digest"]:
                            raise ValueError(f"{name} at {entry['offset']}: record, sidecar and payload differ")
                        rows.append({**found, "url": headers["warc-target-uri"], "html": block.decode("utf-8", "surrogatepass")})
                        held += len(block)
                        if held > 16 * PIECE:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    schema = _index_schema().append(pa.field("url", pa.string())).append(pa.field("html", pa.string()))
    return dealt(archives).mapInArrow(run, INDEX + ", url string, html string")


def shared_folder(spark: SparkSession, name: str) -> str:
    return f"{work_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"
