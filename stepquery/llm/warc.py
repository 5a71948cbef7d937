"""WARC archives with Zstandard dictionaries.

Each archive starts with a skippable frame (magic 0x184D2A5D) that holds a dictionary trained on the archive's own first
records, followed by one frame per record, each compressed with that dictionary. Of records with an equal payload the
one with the smallest page_id is written as a response, the others as revisits that refer to it.

Executors write to the shared folder under names of their own attempt; the table of archives that `write` returns holds
those of committed attempts only, so a lost executor costs a repeated task, never a doubled or missing record.

Defined results: a null html is the empty payload, and empty payloads are a group like any other; rows that repeat the
smallest page_id of a group are all responses; a null page_id is never the smallest, unless the group has no other, when
its rows are responses; line breaks in a url become spaces; an empty table gives no archives and no rows.
"""

from __future__ import annotations

import base64
import hashlib
import io
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, materialize, shared_path, small_batches, whole_number

MAGIC = 0x184D2A5D
#: An archive is closed beyond so many bytes of records.
ARCHIVE_BYTES = 256 << 20
#: The dictionary's size, and the bytes of an archive's first records that it is trained on.
DICTIONARY, SAMPLE = 32 << 10, 2 << 20
LEVEL = 3
DATE = "2024-01-01T00:00:00Z"
#: What an HTTP response starts with in a response or revisit record.
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def bare_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{page}/{digest}')}>"


def record(page: int | None, url: str | None, payload: bytes, first: int | None, revisit: bool) -> bytes:
    """One WARC record; a revisit carries the headers of the response and no payload."""
    digest = bare_digest(payload)
    block = HTTP if revisit else HTTP + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page, digest)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {' '.join((url or 'about:blank').split())}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if page is not None:
        lines.append(f"X-Page-ID: {page}")
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(first, digest)}", f"X-Refers-To-Page-ID: {first}"]
    return "\r\n".join(lines).encode("utf-8", "replace") + b"\r\n\r\n" + block + b"\r\n\r\n"


def dictionary(samples: list[bytes]):
    """A trained dictionary, or the samples themselves as one where they are too few to train on."""
    import zstandard as z

    try:
        if len(samples) >= 8:
            return z.train_dictionary(DICTIONARY, samples, k=256, d=8)
    except z.ZstdError:
        pass
    return z.ZstdCompressionDict(b"".join(samples)[-DICTIONARY:] or HTTP, dict_type=z.DICT_TYPE_RAWCONTENT)


def skippable(content: bytes) -> bytes:
    return MAGIC.to_bytes(4, "little") + len(content).to_bytes(4, "little") + content


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class Archive:
    """One archive being written: holds its first records back until there is a dictionary."""

    def __init__(self, uri: str):
        self.uri, self.records, self.size, self.held, self.held_size = uri, 0, 0, [], 0
        self.fs, self.path = _open(uri)
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.out, self.pack = self.fs.open_output_stream(self.path, compression=None), None

    def add(self, data: bytes) -> None:
        self.records += 1
        self.size += len(data)
        if self.pack:
            self.out.write(self.pack.compress(data))
            return
        self.held.append(data)
        self.held_size += len(data)
        if self.held_size >= SAMPLE:
            self._start()

    def _start(self) -> None:
        import zstandard as z

        d = dictionary([x[: SAMPLE // 4] for x in self.held])
        self.out.write(skippable(d.as_bytes()))
        self.pack = z.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=True)
        for x in self.held:
            self.out.write(self.pack.compress(x))
        self.held = []

    def close(self) -> tuple[str, int, int]:
        if not self.pack:
            self._start()
        self.out.close()
        return self.uri, self.records, self.size


def marked(pages: DataFrame, key: str = "page_id", html: str = "html", url: str = "url") -> DataFrame:
    """(page_id, url, html, first): first is the smallest page_id with an equal payload.

    The group sizes are folded before they are shuffled; the join's large partitions, where a payload has very many
    copies, are split by adaptive execution.
    """
    digest = F.sha2(F.coalesce(F.col(html), F.lit("")), 256)
    page_id = whole_number(pages, key).alias("page_id")
    rows = pages.select(page_id, F.col(url).alias("url"), F.col(html).alias("html"), digest.alias("digest"))
    first = pages.select(page_id, digest.alias("digest")).groupBy("digest").agg(F.min("page_id").alias("first"))
    return rows.join(first, "digest").drop("digest")


def write(pages: DataFrame, uri: str | None = None, key: str = "page_id", html: str = "html", url: str = "url", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write all rows; gives (archive, records, bytes) of the archives."""
    uri = uri or shared_path(pages.sparkSession, "warc")

    def run(batches):
        from pyspark import TaskContext

        c = TaskContext.get()
        name, n, archive, done = f"{uri}/part-{c.partitionId():06d}-{c.taskAttemptId()}", 0, None, []
        for batch in small_batches(batches, 64):
            for page, link, payload, first in zip(batch["page_id"].to_pylist(), batch["url"].to_pylist(), as_bytes(batch["html"]), batch["first"].to_pylist(), strict=True):
                archive = archive or Archive(f"{name}-{n:04d}.warc.zst")
                archive.add(record(page, link, payload, first, first is not None and page != first))
                if archive.size >= archive_bytes:
                    done.append(archive.close())
                    archive, n = None, n + 1
        if archive:
            done.append(archive.close())
        yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64()))], names=["archive", "records", "bytes"])

    return materialize(marked(pages, key, html, url).mapInArrow(run, "archive string, records long, bytes long"), "warc-archives")


def records(uri: str) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of every record of an archive, in order, read as a stream."""
    import zstandard as z

    fs, path = _open(uri)
    with fs.open_input_stream(path, compression=None) as raw:
        head = raw.read(8)
        assert int.from_bytes(head[:4], "little") == MAGIC, f"{uri} has no dictionary frame"
        d = z.ZstdCompressionDict(raw.read(int.from_bytes(head[4:], "little")))
        with z.ZstdDecompressor(dict_data=d).stream_reader(raw, read_across_frames=True, closefd=False) as stream:
            data = io.BufferedReader(stream, 1 << 20)
            while version := data.readline():
                assert version == b"WARC/1.1\r\n", f"{uri} is damaged"
                headers = {}
                while (line := data.readline()) != b"\r\n":
                    name, _, value = line.decode("utf-8").rstrip("\r\n").partition(": ")
                    headers[name] = value
                block = data.read(int(headers["Content-Length"]))
                assert data.read(4) == b"\r\n\r\n", f"{uri} is damaged"
                yield headers, block


FIELDS = [("page_id", pa.int64(), "long"), ("url", pa.string(), "string"), ("payload_bytes", pa.int64(), "long"), ("payload_digest", pa.string(), "string"), ("record_type", pa.string(), "string"), ("refers_to", pa.int64(), "long"), ("payload", pa.binary(), "binary")]


def read(archives: DataFrame, payload: bool = True) -> DataFrame:
    """A row per record, each archive read by a task of its own. A response's length and digest are computed from what was
    read, and must be those it names."""
    fields = FIELDS if payload else FIELDS[:-1]

    def rows(uri: str):
        number = lambda x: None if x is None else int(x)
        for h, block in records(uri):
            revisit, body = h["WARC-Type"] == "revisit", block.partition(b"\r\n\r\n")[2]
            size, digest = int(h["X-Payload-Length"]), h["WARC-Payload-Digest"].removeprefix("sha1:")
            assert revisit or (len(body), bare_digest(body)) == (size, digest), f"{uri}: a payload is damaged"
            yield number(h.get("X-Page-ID")), h["WARC-Target-URI"], size, digest, h["WARC-Type"], number(h.get("X-Refers-To-Page-ID")), body

    def pack(made):
        return pa.RecordBatch.from_arrays([pa.array([m[k] for m in made], f[1]) for k, f in enumerate(fields)], names=[f[0] for f in fields])

    def run(batches):
        for batch in batches:
            for uri in batch["archive"].to_pylist():
                made, size = [], 0
                for row in rows(uri):
                    made.append(row)
                    size += len(row[-1])
                    if size > 8 << 20 or len(made) >= 2000:
                        yield pack(made)
                        made, size = [], 0
                yield pack(made)

    # the list of archives is short, a row for ARCHIVE_BYTES of records: numbered in one task, then dealt one by one
    numbered = archives.select("archive").coalesce(1).withColumn("no", F.monotonically_increasing_id().cast("int"))
    dealt = numbered.repartitionById(max(1, archives.count()), F.col("no"))
    return dealt.mapInArrow(run, ", ".join(f"{n} {ddl}" for n, _, ddl in fields))
