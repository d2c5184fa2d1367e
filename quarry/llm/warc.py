"""WARC archives as a chunked record table.

Payloads travel as rows of (record, chunk number, bytes of at most
``CHUNK_BYTES``), never as whole records. The writer streams a record's chunks
into an archive file, the reader streams archive files back into chunk rows;
each row carries the SHA-1 of the payload up to its end, so that the last row's
digest is the record's and a consumer can check or resume at any chunk.

Archives are ordinary WARC 1.1 files, each record a gzip member of its own, in
the shared folder. A task writes under a name of its own and lists the files it
finished in a manifest table; only listed files are read, so that the leavings
of lost or repeated tasks are never seen.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._util import fresh_path, materialize, small_batches

CHUNK_BYTES = 1 << 18
#: A new archive file is begun after this many compressed bytes.
ARCHIVE_BYTES = 1 << 30
LEAST_SHARED = 1000
RECORD = (
    "record_id string, page_id {kind}, record_type string, refers_to {kind}, chunk_no int, is_last boolean, "
    "chunk binary, payload_bytes long, running_sha1 string"
)


def open_folder(path: str) -> tuple[fs.FileSystem, str]:
    """The file system and the path in it; a plain path is a local one."""
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


#: Shared digests that are sent to all tasks at most, and tasks that the pages of one are dealt to where there are more.
SENT_DIGESTS, SALTS = 200_000, 16


def decide(pages: DataFrame, id_col: str, payload_col: str, least: int = LEAST_SHARED) -> DataFrame:
    """The pages with page_id, payload, its length and SHA-1, record_type and refers_to.

    Only digests and ids of payloads that may be shared are grouped; a digest
    of very many pages is one row for each map task that meets it.
    """
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).alias("page_id"), payload.alias("_payload")).select(
        "page_id", "_payload", F.octet_length("_payload").cast("long").alias("_bytes"), F.sha1("_payload").alias("_sha1")
    )
    shared = rows.where(F.col("_bytes") >= least).groupBy(F.col("_sha1").alias("_digest")).agg(F.count(F.lit(1)).alias("_n"), F.max("page_id").alias("_last"))
    shared = materialize(shared.where("_n > 1").select("_digest", "_last"), "digests")
    if shared.count() <= SENT_DIGESTS:
        found = rows.join(F.broadcast(shared), (F.col("_sha1") == F.col("_digest")) & (F.col("_bytes") >= least), "left")
    else:
        # Small payloads stay where they are.
        large = rows.where(F.col("_bytes") >= least).withColumn("_salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)))
        salted = shared.select("_digest", "_last", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("_part"))
        found = large.join(salted, (F.col("_sha1") == F.col("_digest")) & (F.col("_salt") == F.col("_part")), "left").drop("_salt", "_part")
        found = found.unionByName(rows.where(F.col("_bytes") < least), allowMissingColumns=True)
    revisit = F.col("_last").isNotNull() & ~F.col("_last").eqNullSafe(F.col("page_id"))
    return found.select(
        "page_id", F.when(revisit, F.lit(b"")).otherwise(F.col("_payload")).alias("_payload"), "_bytes", "_sha1",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("_last")).alias("refers_to"),
    )


def header(record_id: str, page_id, kind: str, refers_to, payload_bytes: int, sha1: str) -> bytes:
    """The head of a record; a revisit has no body and tells its payload's length and digest."""
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: urn:page:{'' if page_id is None else page_id}", "Content-Type: text/html; charset=utf-8",
        f"WARC-Payload-Digest: sha1:{sha1}", f"X-Payload-Bytes: {payload_bytes}",
    ]
    if kind == "revisit":
        lines += [f"WARC-Refers-To-Target-URI: urn:page:{refers_to}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines.append(f"Content-Length: {0 if kind == 'revisit' else payload_bytes}")
    return ("\r\n".join(lines) + "\r\n\r\n").encode()


def write(decided: DataFrame, folder: str, chunk_bytes: int = CHUNK_BYTES, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write the records into archives in ``folder``, chunk by chunk; a manifest row (path, records, bytes) per archive."""

    def run(batches):
        disk, top = open_folder(folder)
        name = out = None
        records = size = 0

        def put(data: bytes) -> None:
            nonlocal size
            if data:
                out.write(data)
                size += len(data)

        def done():
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([records], pa.int64()), pa.array([size], pa.int64())], names=["path", "records", "bytes"])

        for batch in batches:
            head = batch.drop_columns(["_payload"])
            for i in range(batch.num_rows):
                row = {c: head.column(c)[i].as_py() for c in head.schema.names}
                if out is not None and size >= archive_bytes:
                    yield done()
                    out = None
                if out is None:
                    name = f"part-{uuid.uuid4().hex}.warc.gz"
                    out, records, size = disk.open_output_stream(f"{top}/{name}", compression=None), 0, 0
                # The id follows from the archive and the place in it.
                record = uuid.uuid5(uuid.NAMESPACE_URL, f"{name}/{records}").urn
                member, digest = zlib.compressobj(6, zlib.DEFLATED, 31), hashlib.sha1()
                put(member.compress(header(record, row["page_id"], row["record_type"], row["refers_to"], row["_bytes"], row["_sha1"])))
                # Chunks are views of the batch's own memory.
                payload = memoryview(batch.column("_payload")[i].as_buffer())
                for a in range(0, len(payload), chunk_bytes):
                    piece = payload[a : a + chunk_bytes]
                    digest.update(piece)
                    put(member.compress(piece))
                if row["record_type"] == "response" and digest.hexdigest() != row["_sha1"]:
                    raise ValueError(f"the chunks of page {row['page_id']} do not add up to its payload")
                put(member.compress(b"\r\n\r\n") + member.flush())
                records += 1
        if out is not None:
            yield done()

    return decided.mapInArrow(run, "path string, records long, bytes long")


def records_of(stream, chunk_bytes: int):
    """(head as a dict, iterator of its payload's chunks) of each record of an archive; chunks must be read up first."""
    buffer = bytearray()
    unzip, begun = zlib.decompressobj(31), False

    def more() -> bool:
        nonlocal unzip, begun
        while True:
            if unzip.eof:
                rest = unzip.unused_data
                unzip, begun = zlib.decompressobj(31), False
                raw = rest or stream.read(1 << 16)
            else:
                raw = unzip.unconsumed_tail or stream.read(1 << 16)
            if not raw:
                if begun:
                    raise ValueError("the archive ends within a record")
                return False
            begun = True
            got = unzip.decompress(raw, 1 << 18)
            if got:
                buffer.extend(got)
                return True

    while True:
        while (end := buffer.find(b"\r\n\r\n")) < 0:
            if not more():
                if buffer:
                    raise ValueError("the archive ends within a record")
                return
        lines = bytes(buffer[:end]).decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("not a WARC record")
        del buffer[: end + 4]
        head = dict(line.split(": ", 1) for line in lines[1:])
        left = int(head["Content-Length"])

        def payload(left=left):
            while True:
                want = min(left, chunk_bytes)
                while len(buffer) < want:
                    if not more():
                        raise ValueError("the archive ends within a payload")
                piece = bytes(buffer[:want])
                del buffer[:want]
                left -= want
                yield piece, left == 0
                if not left:
                    break

        yield head, payload()
        while len(buffer) < 4:
            if not more():
                raise ValueError("the archive ends within a record")
        del buffer[:4]


def read(manifest: DataFrame, folder: str, kind: str = "bigint", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The chunked record table of the archives that the manifest lists."""
    page_type = {"bigint": int, "int": int, "smallint": int, "tinyint": int}.get(kind, str)
    number = lambda uri: page_type(uri.removeprefix("urn:page:")) if uri and uri != "urn:page:" else None
    schema = RECORD.format(kind=kind)
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches):
        disk, top = open_folder(folder)
        for batch in batches:
            arrow_kind = {"bigint": pa.int64(), "int": pa.int32(), "smallint": pa.int16(), "tinyint": pa.int8()}.get(kind, pa.string())
            types = [pa.string(), arrow_kind, pa.string(), arrow_kind, pa.int32(), pa.bool_(), pa.binary(), pa.int64(), pa.string()]
            rows, size = [], 0

            def flush():
                columns = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)]
                rows.clear()
                return pa.RecordBatch.from_arrays(columns, names=names)

            for path in batch.column("path").to_pylist():
                with disk.open_input_stream(f"{top}/{path}", compression=None) as stream:
                    for head, pieces in records_of(stream, chunk_bytes):
                        digest = hashlib.sha1()
                        own = (head["WARC-Record-ID"].strip("<>"), number(head["WARC-Target-URI"]), head["WARC-Type"], number(head.get("WARC-Refers-To-Target-URI")))
                        for n, (piece, last) in enumerate(pieces):
                            digest.update(piece)
                            # A revisit's payload is its response's: length and digest are from its head.
                            sha1 = head["WARC-Payload-Digest"].removeprefix("sha1:") if own[2] == "revisit" else digest.hexdigest()
                            if last and sha1 != head["WARC-Payload-Digest"].removeprefix("sha1:"):
                                raise ValueError(f"a payload in {path} is damaged")
                            rows.append((*own, n, last, piece, int(head["X-Payload-Bytes"]), sha1))
                            size += len(piece) + 200
                            if size >= 4 << 20:
                                yield flush()
                                size = 0
            if rows:
                yield flush()

    files = manifest.select("path")
    return files.repartition(max(1, min(manifest.count(), 1 << 14)), "path").mapInArrow(run, schema)


def round_trip(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html", chunk_bytes: int = CHUNK_BYTES, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write a record per page and read the archives back, as a chunked record table.

    Of pages with equal payloads of at least 1000 bytes, those with the largest
    page_id are responses and the others revisits that refer to it; all other
    pages are responses. A null payload is empty: one chunk without bytes. Null
    ids count as smaller than any; repeated rows are records of their own. An
    empty table gives no rows. Further columns are not read.
    """
    spark = pages.sparkSession
    folder = fresh_path(spark, "warc")
    disk, top = open_folder(folder)
    disk.create_dir(top, recursive=True)
    with small_batches(spark):  # a batch holds whole payloads
        manifest = materialize(write(decide(pages, id_col, payload_col), folder, chunk_bytes, archive_bytes), "manifest")
    return read(manifest, folder, pages.schema[id_col].dataType.simpleString(), chunk_bytes)
