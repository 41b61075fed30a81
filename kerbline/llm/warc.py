"""WARC archives: write pages as whole-file gzip streams, normalise them to a member per record, read back.

Archives are written and read by the executors straight on the shared file system: a file:// folder
through Python's own files, any other scheme through pyarrow's file systems. Every file is first written
under a name of the task attempt's own and then renamed, so repeated attempts leave one whole file.
"""

from __future__ import annotations

import base64
import json
import zlib
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path
from urllib.parse import unquote, urlparse
from uuid import uuid4

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbline.llm.common import saved, scratch_path, tidy

_CHUNK = 1 << 20
_BATCH = 8 << 20  # bytes of payload that a batch of read records holds, or one record


class Store:
    """Opening and renaming files below a root URI."""

    def __init__(self, root: str):
        parsed = urlparse(root)
        self.local = parsed.scheme in ("", "file")
        if self.local:
            self.root = unquote(parsed.path)
            Path(self.root).mkdir(parents=True, exist_ok=True)
        else:
            from pyarrow import fs

            self.fs, self.root = fs.FileSystem.from_uri(root)
            self.fs.create_dir(self.root, recursive=True)

    def read(self, name: str):
        path = f"{self.root}/{name}"
        return open(path, "rb") if self.local else self.fs.open_input_file(path)

    @contextmanager
    def write(self, name: str):
        hidden = f"{self.root}/.{name}.{uuid4().hex}"
        with open(hidden, "wb") if self.local else self.fs.open_output_stream(hidden) as f:
            yield f
        if self.local:
            Path(hidden).replace(f"{self.root}/{name}")
        else:
            self.fs.move(hidden, f"{self.root}/{name}")

    def delete(self, name: str) -> None:
        if self.local:
            Path(f"{self.root}/{name}").unlink(missing_ok=True)
        elif self.fs.get_file_info(f"{self.root}/{name}").is_file:
            self.fs.delete_file(f"{self.root}/{name}")


def record_bytes(page_id, url, html: bytes | None, length: int, sha1: bytes, refers_to, date: str) -> bytes:
    """A WARC/1.1 response, or a revisit if refers_to is given: then html is left out, its length and digest stay."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    body = http + (b"" if refers_to is not None else html)
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_urn(page_id, sha1)}", f"WARC-Date: {date}",
        f"WARC-Target-URI: {_one_line(url)}", "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{base64.b32encode(sha1).decode()}",
    ]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_urn(refers_to, sha1)}"]
    head += [f"Content-Length: {len(body)}", "", ""]
    return "\r\n".join(head).encode() + body + b"\r\n\r\n"


def _urn(page_id, sha1: bytes) -> str:
    """A record's id, by page and payload: a revisit has its response's payload, so it can name it."""
    return f"<urn:page:{page_id}:{sha1.hex()}>"


def _one_line(url) -> str:
    """A url for a header line: null is empty, line breaks are percent-coded."""
    return ("" if url is None else str(url)).replace("\r", "%0D").replace("\n", "%0A")


def parse_records(chunks: Iterator[bytes]) -> Iterator[tuple[dict, bytes, bytes]]:
    """(headers, block, whole record) of a WARC stream; holds one record at a time. Raises ValueError on a broken stream."""
    buffer, ended = bytearray(), False

    def fill(n: int) -> bool:
        nonlocal ended
        while len(buffer) < n and not ended:
            chunk = next(chunks, None)
            if chunk is None:
                ended = True
            else:
                buffer.extend(chunk)
        return len(buffer) >= n

    while fill(1):
        end, seen = -1, 0
        while (end := buffer.find(b"\r\n\r\n", max(0, seen - 3))) < 0:
            seen = len(buffer)
            if not fill(seen + 1):
                raise ValueError("the stream ends within a record's header")
        lines = buffer[:end].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record starts with {lines[0][:40]!r}")
        headers = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
        start, size = end + 4, int(headers["content-length"])
        if not fill(start + size + 4):
            raise ValueError("the stream ends within a record's block")
        yield headers, bytes(buffer[start : start + size]), bytes(buffer[: start + size + 4])
        del buffer[: start + size + 4]


def inflate(f) -> Iterator[bytes]:
    """The plain bytes of a gzip file of one or more members, each read once from start to end."""
    unzip = zlib.decompressobj(31)
    while chunk := f.read(_CHUNK):
        while chunk:
            if unzip.eof:
                unzip = zlib.decompressobj(31)
            if out := unzip.decompress(chunk):
                yield out
            chunk = unzip.unused_data
    if not unzip.eof:
        raise ValueError("the gzip stream is cut short")


def decide(pages: DataFrame, least: int = 1000, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, digest, refers_to): the rows that revisit another; of equal payloads of at least `least` bytes the largest id responds.

    Counts are pre-aggregated by digest; only digests that occur more than once meet their rows again.
    """
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    keys = pages.select(F.col(id_col).alias("id"), F.octet_length(payload).alias("n"), F.sha1(payload).alias("digest")).where((F.col("n") >= least) & F.col("id").isNotNull())
    keys = saved(keys.select("id", "digest"), "digests")
    shared = keys.groupBy("digest").agg(F.max("id").alias("refers_to"), F.min("id").alias("low")).where("low < refers_to")
    return keys.join(shared.select("digest", "refers_to"), "digest").where("id < refers_to").select("id", "digest", "refers_to").distinct()


def write_archives(pages: DataFrame, root: str, least: int = 1000, date: str = "2020-01-01T00:00:00Z", level: int = 6, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write a record per row into whole-file gzip streams below root, one file a task; returns their names (name, records).

    Null html is an empty payload, null urls an empty target. Rows without an id are written with the
    id None and never revisit. Rows that repeat an id are records of their own, each judged by its payload;
    those that repeat id and payload have one record id, too. Extra columns are ignored.
    """
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    payload = F.col("html").cast("binary")
    rows = rows.withColumn("digest", F.sha1(payload)).join(decide(pages, least, id_col, html_col), ["id", "digest"], "left")
    rows = rows.select(
        F.col("id").cast("string").alias("id"), "url", F.when(F.col("refers_to").isNull(), payload).alias("html"), F.octet_length(payload).cast("long").alias("n"),
        F.unhex("digest").alias("sha1"), F.col("refers_to").cast("string").alias("refers_to"),
    )

    def work(frames):
        from pyspark import TaskContext

        store, name, count = Store(root), f"part-{TaskContext.get().partitionId():06d}.warc.gz", 0
        with store.write(name) as f:
            zipped = zlib.compressobj(level, zlib.DEFLATED, 31)
            for frame in frames:
                for row in frame.itertuples(index=False):
                    f.write(zipped.compress(record_bytes(row.id, row.url, row.html, row.n, bytes(row.sha1), row.refers_to, date)))
                    count += 1
            f.write(zipped.flush())
        yield pd.DataFrame({"name": [name], "records": [count]})

    return saved(rows.mapInPandas(tidy(work), "name string, records long"), "archives")


def normalise(archives: DataFrame, root: str, to: str, level: int = 6, keep: bool = True) -> DataFrame:
    """Rewrite each monolithic archive with a gzip member per record, and a sidecar index beside it.

    Each file is inflated once as one stream; a record at a time is in memory. The index `<name>.idx` has
    a JSON line per record: offset, length (of its member) and record id. Returns (name, records). keep:
    whether the monolithic files stay. Empty archives give empty files.
    """

    def work(frames):
        source, store = Store(root), Store(to)
        for frame in frames:
            for name in frame["name"]:
                offset = count = 0
                with source.read(name) as f, store.write(name) as out, store.write(name + ".idx") as index:
                    for headers, _, whole in parse_records(inflate(f)):
                        zipped = zlib.compressobj(level, zlib.DEFLATED, 31)
                        member = zipped.compress(whole) + zipped.flush()
                        out.write(member)
                        line = {"offset": offset, "length": len(member), "id": headers["warc-record-id"]}
                        index.write(json.dumps(line).encode() + b"\n")
                        offset, count = offset + len(member), count + 1
                yield pd.DataFrame({"name": [name], "records": [count]})

    done = saved(_spread(archives).mapInPandas(tidy(work), "name string, records long"), "normal")
    if not keep:

        def drop(frames):
            store = Store(root)
            for frame in frames:
                for name in frame["name"]:
                    store.delete(name)
                yield frame

        done.mapInPandas(drop, done.schema).write.format("noop").mode("overwrite").save()
    return done


def _spread(archives: DataFrame) -> DataFrame:
    """(name), one archive a partition: names dealt in turn from a single short list, not by hash."""
    return archives.select("name").coalesce(1).repartition(max(1, archives.count()))


def read_records(archives: DataFrame, root: str, payloads: bool = True) -> DataFrame:
    """(name, offset, id, type, url, payload_bytes, payload_digest, refers_to, payload) of normalised archives.

    payloads: whether payloads are returned, else they are null.

    Each record is fetched by its sidecar entry and inflated alone. A response's payload is hashed and
    held against its header (ValueError if they differ); a revisit's length and digest are its headers'.
    """

    def work(frames):
        import hashlib

        store = Store(root)
        for frame in frames:
            for name in frame["name"]:
                rows, held = [], 0
                with store.read(name + ".idx") as index, store.read(name) as f:
                    for line in index.read().splitlines():
                        at = json.loads(line)
                        f.seek(at["offset"])
                        headers, block, _ = next(parse_records(iter([zlib.decompress(f.read(at["length"]), 31)])))
                        head, _, payload = block.partition(b"\r\n\r\n")
                        digest = base64.b32decode(headers["warc-payload-digest"].removeprefix("sha1:")).hex()
                        length = next(int(x.split(b":")[1]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:"))
                        if headers["warc-type"] == "response" and (len(payload) != length or hashlib.sha1(payload).hexdigest() != digest):
                            raise ValueError(f"{name} at {at['offset']}: the payload differs from its header")
                        refers = headers.get("warc-refers-to")
                        names = (_id(headers["warc-record-id"]), headers["warc-type"], headers["warc-target-uri"])
                        rows.append((name, at["offset"], *names, length, digest, _id(refers) if refers else None, payload if payloads else None))
                        held += len(payload)
                        if len(rows) == 2000 or held >= _BATCH:
                            yield pd.DataFrame(rows, columns=columns)
                            rows, held = [], 0
                yield pd.DataFrame(rows, columns=columns)

    schema = "name string, offset long, id string, type string, url string, payload_bytes long, payload_digest string, refers_to string, payload binary"
    columns = [x.split()[0] for x in schema.split(", ")]
    return _spread(archives).mapInPandas(tidy(work), schema)


def _id(urn: str) -> str:
    return urn.removeprefix("<urn:page:").rpartition(":")[0]


def round_trip(pages: DataFrame, least: int = 1000, keep: bool = False, payloads: bool = True) -> DataFrame:
    """Pages as read back from normalised archives in the shared scratch folder; see read_records()."""
    whole, single = scratch_path(pages.sparkSession, "warc"), scratch_path(pages.sparkSession, "warc-members")
    return read_records(normalise(write_archives(pages, whole, least), whole, single, keep=keep), single, payloads)
