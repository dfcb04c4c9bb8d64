"""WARC archives: write, normalise to one gzip member a record with an offset index, read back by offset.

Pages are dealt into blocks of about ``BLOCK_BYTES`` by a hash; each block is written as one monolithic archive (a single gzip stream, as a careless crawler would) to the shared
folder. The normaliser inflates such a stream once, from start to end, in bounded chunks, writes every record as its own member, and a sidecar
index of offsets. Records are then read by offset alone.

Of records with equal payloads of at least ``least_bytes`` bytes the one with the largest id is the response; the others are revisits of it and hold
headers only. Digests are aggregated before they meet, so a payload that a third of all pages share costs a row a task.

Archives are named by block and content never depends on when or where a task runs: a task that runs again writes
the same bytes under a name of its own attempt and moves them to the same name.

Null html: empty payload. Rows without an id are records like others, named by their digest, block and number: they revisit a row with an id if one has their
payload, and are responses if none has. Repeated ids are each written and each read back: records are told apart by id and digest, repeated ones by their number, and rows that are
equal in both and have the largest id are all responses. A very long payload is one record, held whole
by one task at a time. Other columns, whatever their names, are not read. An empty table writes nothing and gives an empty result. Urls are percent-encoded where they hold white space or control characters.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbside.llm.common import check_name, materialise, new_folder, shuffle_partitions, slices, utf8

CHUNK = 1 << 18
LEVEL = 1
#: Written into every record; a re-run must give the same bytes.
DATE = "1970-01-01T00:00:00Z"
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # fixed value: the name space of URLs
#: Payload bytes of a block, about.
BLOCK_BYTES = 64 << 20
#: Rows of a block at once in a task.
ROWS_AT_ONCE = 200


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, sha1: str, number: str = "") -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'page:{page_id}:{sha1}{number}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, number: str = "") -> bytes:
    """One WARC record; the block is an HTTP response, or its headers alone for a revisit. number tells records of one id and payload apart."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block, sha1 = http if refers_to is not None else http + payload, digest(payload)
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page_id, sha1, number)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {quote(url or '', safe=chr(33) + '#$%&()*+,/:;=?@[]~' + chr(39))}",
        f"WARC-Payload-Digest: sha1:{sha1}",
        f"X-Page-ID: {'' if page_id is None else page_id}",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: {record_id(refers_to, sha1)}", f"X-Refers-To-Page-ID: {refers_to}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _number(text: str | None) -> int | None:
    return int(text) if text else None


def fields(head: bytes) -> dict[str, str]:
    return dict(line.split(": ", 1) for line in head.decode("utf-8", "replace").split("\r\n")[1:] if ": " in line)


def records(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """Whole records out of an inflated stream, of which one record and a chunk are held at a time."""
    held = bytearray()
    for chunk in chunks:
        held += chunk
        while (end := held.find(b"\r\n\r\n")) >= 0:
            size = end + 4 + int(fields(bytes(held[:end]))["Content-Length"]) + 4
            if len(held) < size:
                break
            yield bytes(held[:size])
            del held[:size]
    if held.strip():
        raise ValueError("the archive ends within a record")


def inflated(stream, chunk: int = CHUNK) -> Iterator[bytes]:
    """The bytes of a gzip file of any number of members, inflated once."""
    unzip = zlib.decompressobj(31)
    while data := stream.read(chunk):
        while data:
            if part := unzip.decompress(data, 4 * chunk):
                yield part
            if unzip.eof:
                data = unzip.unused_data
                unzip = zlib.decompressobj(31)
            else:
                data = unzip.unconsumed_tail
    if part := unzip.flush():
        yield part


def gzipped(data: bytes) -> bytes:
    deflate = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return deflate.compress(data) + deflate.flush()


def _files(folder: str):
    """The folder's file system and its path there."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder) if urlsplit(folder).scheme else (fs.LocalFileSystem(), folder)


def _own(name: str) -> str:
    """A name that no other attempt of the task writes to."""
    return f"{name}.part-{TaskContext.get().taskAttemptId()}"


def _moved(files, temporary: str, final: str) -> None:
    """Replaces what an earlier try of the same task left; both have the same bytes."""
    try:
        files.move(temporary, final)
    except OSError:  # a file system that doesn't move onto a file
        files.delete_file(final)
        files.move(temporary, final)


def archived(pages: DataFrame, folder: str) -> DataFrame:
    """Write pages (block, id, url, payload, refers_to, sha) as one gzip stream a block; (block, archive, n_records)."""

    def write(batches):
        files, root = _files(folder)
        files.create_dir(root, recursive=True)
        now, n, out, deflate, name, last, again = None, 0, None, None, "", None, 0

        def close():
            out.write(deflate.flush())
            out.close()
            _moved(files, _own(f"{root}/{name}"), f"{root}/{name}")
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([name]), pa.array([n], pa.int64())], names=["block", "archive", "n_records"])

        for batch in batches:
            for part in slices(batch, ROWS_AT_ONCE):
                blocks, ids, urls, refers, shas = (part.column(i).to_pylist() for i in (0, 1, 2, 4, 5))
                for block, key, url, payload, to, sha in zip(blocks, ids, urls, utf8(part.column(3)).to_pylist(), refers, shas):
                    again = again + 1 if last == (block, key, sha) else 0
                    last = (block, key, sha)
                    number = f":{block}" if key is None else ""
                    if block != now:
                        if out is not None:
                            yield close()
                        now, n, name = block, 0, f"block-{block:06d}.warc.gz"
                        out = files.open_output_stream(_own(f"{root}/{name}"))
                        deflate = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                    out.write(deflate.compress(record(key, url, payload or b"", to, number + (f":{again}" if again else ""))))
                    n += 1
        if out is not None:
            yield close()

    return pages.mapInArrow(write, "block int, archive string, n_records long")


def normalised(archives: DataFrame, source: str, target: str) -> DataFrame:
    """Rewrite each archive (column ``archive``) with a member for each record and a sidecar index; the index rows: archive, offset, length, page_id, record_type."""

    def rewrite(batches):
        files, root = _files(source)
        there, out_root = _files(target)
        there.create_dir(out_root, recursive=True)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                offset = 0
                index: list[tuple] = []
                with files.open_input_stream(f"{root}/{name}", compression=None) as stream, there.open_output_stream(_own(f"{out_root}/{name}"), compression=None) as out:
                    for one in records(inflated(stream)):
                        member, known = gzipped(one), fields(one[: one.index(b"\r\n\r\n")])
                        out.write(member)
                        index.append((name, offset, len(member), _number(known["X-Page-ID"]), known["WARC-Type"]))
                        offset += len(member)
                _moved(there, _own(f"{out_root}/{name}"), f"{out_root}/{name}")
                with there.open_output_stream(_own(f"{out_root}/{name}.cdx"), compression=None) as out:
                    out.write("".join(f"{'-' if row[3] is None else row[3]} {row[4]} {row[1]} {row[2]} {row[0]}\n" for row in index).encode())
                _moved(there, _own(f"{out_root}/{name}.cdx"), f"{out_root}/{name}.cdx")
                if index:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*index), (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()))], names=["archive", "offset", "length", "page_id", "record_type"])

    return archives.select("archive").mapInArrow(rewrite, "archive string, offset long, length long, page_id long, record_type string")


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """Read every record of the index by its offset: page_id, record_type, refers_to, declared_bytes, declared_digest, block_digest (of a response's payload), url."""
    schema = "page_id long, record_type string, refers_to long, declared_bytes long, declared_digest string, payload_bytes long, payload_digest string, url string"

    def read(batches):
        files, root = _files(folder)
        now, stream = None, None
        for batch in batches:
            out: list[tuple] = []
            for name, offset, length in zip(*(batch.column(k).to_pylist() for k in (0, 1, 2))):
                if name != now:
                    if stream is not None:
                        stream.close()
                    now, stream = name, files.open_input_file(f"{root}/{name}")
                one = zlib.decompress(stream.read_at(length, offset), 31)
                head, _, block = one[:-4].partition(b"\r\n\r\n")
                http, _, payload = block.partition(b"\r\n\r\n")
                known, inner = fields(head), fields(http)
                response = known["WARC-Type"] == "response"
                to = known.get("X-Refers-To-Page-ID")
                out.append((_number(known["X-Page-ID"]), known["WARC-Type"], _number(to), int(inner["Content-Length"]), known["WARC-Payload-Digest"].removeprefix("sha1:"), len(payload) if response else None, digest(payload) if response else None, known["WARC-Target-URI"]))
            if out:
                types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=[f.split()[0] for f in schema.split(", ")])
        if stream is not None:
            stream.close()

    return index.select("archive", "offset", "length").mapInArrow(read, schema)


def placed(pages: DataFrame, id_col: str, url_col: str, payload_col: str, least_bytes: int, blocks: int) -> DataFrame:
    """(block, id, url, payload, refers_to, sha): which pages revisit which."""
    one = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.coalesce(payload_col, F.lit("")).alias("payload"))
    one = one.withColumn("sha", F.unhex(F.sha1(F.col("payload").cast("binary"))))
    sized = one.select("id", "sha", F.octet_length("payload").alias("bytes")).filter(F.col("bytes") >= least_bytes)
    groups = sized.groupBy("sha").agg(F.max("id").alias("response"), F.count("*").alias("times")).filter("times > 1 and response is not null")
    # only shared payloads are joined; written, so that Spark knows the size of both sides
    shared = materialise(groups.select("sha", "response"), "warc-shared")
    copies = sized.join(shared, "sha").select(F.col("id").alias("copy"), F.col("sha").alias("copied"), "response").filter("copy is null or copy <> response").distinct()
    copies = materialise(copies, "warc-revisits")
    marked = one.join(copies, one["id"].eqNullSafe(copies["copy"]) & (one["sha"] == copies["copied"]), "left").select("id", "sha", "url", "payload", F.col("response").alias("refers_to"))
    apart = F.when(F.col("id").isNull(), F.xxhash64("url"))  # rows without an id may be many
    dealt = marked.repartition(blocks, "id", "sha", apart).sortWithinPartitions("id", "sha", "url")
    return dealt.select(F.spark_partition_id().alias("block"), "id", "url", "payload", "refers_to", "sha")


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 0, folder: str | None = None) -> DataFrame:
    """Write, normalise and read back; a row for each page: id, payload_bytes, payload_digest, record_type, refers_to.

    A revisit's figures are those of the response it refers to.
    """
    check_name(id_col)
    spark = pages.sparkSession
    folder = folder or new_folder(spark, "warc")
    size = pages.agg(F.sum(F.octet_length(payload_col))).first()[0] or 0
    blocks = max(shuffle_partitions(spark), -(-size // BLOCK_BYTES))
    archives = materialise(archived(placed(pages, id_col, url_col, payload_col, least_bytes, blocks), f"{folder}/raw"), "warc-archives")
    index = materialise(normalised(archives.repartition(blocks), f"{folder}/raw", f"{folder}/records"), "warc-index")
    found = materialise(read_records(index.repartition(blocks, "archive").sortWithinPartitions("archive", "offset"), f"{folder}/records"), "warc-read")
    columns = [F.col("page_id").alias(id_col), "payload_bytes", "payload_digest", "record_type", "refers_to"]
    responses = found.filter("record_type = 'response'")
    own = responses.groupBy(F.col("page_id").alias("response"), "payload_digest").agg(F.first("payload_bytes").alias("payload_bytes"))
    revisits = found.filter("record_type = 'revisit'").drop("payload_bytes", "payload_digest")  # apart: all responses refer to nothing, one hot key
    referred = (F.col("refers_to") == F.col("response")) & (F.col("declared_digest") == F.col("payload_digest"))
    return responses.select(*columns).unionByName(revisits.join(own, referred, "left").select(*columns))
