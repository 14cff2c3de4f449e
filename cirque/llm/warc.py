"""WARC archives: writing monolithic gzip files, normalising them to one member per
record with a sidecar offset index, and reading records back by the index.

Archives live in the shared folder. A file's name is fixed by the content's partition
and gets its final name by a rename, so a task that runs again writes the same file again.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import fresh_path, joinable, materialise, small_batches, table

CHUNK = 1 << 18
#: Fixed values of the WARC 1.1 format.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


@dataclass(frozen=True)
class WarcParams:
    """min_bytes: payloads from this size are kept once. level: of gzip. date: of all records."""

    min_bytes: int = 0
    level: int = 6
    date: str = "2020-01-01T00:00:00Z"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _fs(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


class Target:
    """A file that appears under its name only when it is complete."""

    def __init__(self, path: str):
        self.fs, self.path = _fs(path)
        self.part = f"{self.path}.{uuid.uuid4().hex}.part"
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)

    def __enter__(self):
        self.out = self.fs.open_output_stream(self.part, compression=None)
        return self.out

    def __exit__(self, kind, *_):
        self.out.close()
        if kind is None:
            self.fs.move(self.part, self.path)
        else:
            self.fs.delete_file(self.part)


def record(page_id, url: str | None, payload: bytes, sha: str, refers_to, params: WarcParams) -> bytes:
    """A response record, or a revisit (no payload) if refers_to isn't null."""
    kind = "response" if refers_to is None else "revisit"
    body = payload if refers_to is None else b""
    clean = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {params.date}",
        f"WARC-Target-URI: {clean}", f"WARC-Payload-Digest: sha1:{sha}", f"X-Payload-Length: {len(payload)}",
        "Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + body + b"\r\n\r\n"


class Reader:
    """Bytes of a gzip file of any number of members, inflated in chunks."""

    def __init__(self, stream):
        self.stream, self.buffer, self.raw = stream, bytearray(), b""
        self.z, self.inside = zlib.decompressobj(31), False  # inside: a member has begun and not ended

    def more(self) -> bool:
        """Inflate a chunk; False at the end."""
        while True:
            self.raw = self.raw or self.stream.read(CHUNK)
            if not self.raw:
                if self.inside:
                    raise ValueError("the gzip stream ends early")
                return False
            out, self.inside = self.z.decompress(self.raw, CHUNK), True
            self.raw = self.z.unconsumed_tail
            if self.z.eof:
                self.raw, self.z, self.inside = self.z.unused_data, zlib.decompressobj(31), False
            if out:
                self.buffer += out
                return True

    def take(self, n: int) -> bytes:
        while len(self.buffer) < n:
            if not self.more():
                raise ValueError("a record ends early")
        out = bytes(self.buffer[:n])
        del self.buffer[:n]
        return out

    def head(self) -> bytes | None:
        """The next record's header with its blank line; None at the end."""
        at = 0
        while (k := self.buffer.find(b"\r\n\r\n", max(0, at - 3))) < 0:
            at = len(self.buffer)
            if not self.more():
                if self.buffer.strip():
                    raise ValueError("a header ends early")
                return None
        return self.take(k + 4)


def fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    return {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:] if x)}


def normalise(source: str, target: str, level: int = 6) -> list[dict]:
    """Inflate `source` (one gzip stream or several) once, write every record as a member of its own to
    `target`, and the index, one JSON line per record, to `target`.idx. Returns the index."""
    index, at = [], 0
    fs, path = _fs(source)
    with fs.open_input_stream(path, compression=None) as stream, Target(target) as out:
        reader = Reader(stream)
        while (head := reader.head()) is not None:
            f = fields(head)
            body = reader.take(int(f["content-length"]) + 4)
            z = zlib.compressobj(level, zlib.DEFLATED, 31)
            member = z.compress(head + body) + z.flush()
            out.write(member)
            index.append({"offset": at, "length": len(member), "type": f["warc-type"], "id": f["warc-record-id"]})
            at += len(member)
    with Target(f"{target}.idx") as out:
        out.write("".join(json.dumps(x) + "\n" for x in index).encode())
    return index


def read_at(handle, offset: int, length: int) -> tuple[dict[str, str], bytes]:
    """The record whose member lies there: (header fields, body)."""
    handle.seek(offset)
    data = zlib.decompress(handle.read(length), 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    f = fields(head)
    n = int(f["content-length"])
    if len(rest) != n + 4:
        raise ValueError("the body's length isn't the header's")
    return f, rest[:n]


def referred(pages: DataFrame, params: WarcParams) -> DataFrame:
    """page_id, url, html, refers_to: the smallest page_id of equal payloads, for all but that page.

    Only digests are grouped (partial aggregation); digests that occur once aren't joined at all, and
    the join of the others splits skewed keys.
    """
    size = F.coalesce(F.octet_length("html"), F.lit(0))
    keyed = small_batches(pages).select(
        F.col("page_id").cast("long").alias("page_id"), "url", "html",
        F.when(size >= params.min_bytes, F.sha1(F.encode(F.coalesce("html", F.lit("")), "UTF-8"))).alias("sha"),
    )
    first = keyed.where("sha is not null").groupBy("sha").agg(F.count("*").alias("n"), F.min("page_id").alias("first")).where("n > 1").drop("n")
    joined = keyed.join(joinable(first, "warc-first"), "sha", "left")
    return joined.select("page_id", "url", "html", F.when(F.col("page_id").isNull() | (F.col("first") < F.col("page_id")), F.col("first")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, params: WarcParams = WarcParams()) -> DataFrame:
    """Write one archive per partition, each a single gzip stream. Returns (archive, records)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        name, n = f"{folder}/raw/{TaskContext.get().partitionId():06d}.warc.gz", 0

        def rest():
            yield first
            yield from batches

        with Target(name) as out:
            z = zlib.compressobj(params.level, zlib.DEFLATED, 31)
            for b in rest():
                for page_id, url, html, refers in zip(*(b.column(k).to_pylist() for k in range(4))):
                    payload = (html or "").encode("utf-8", "surrogatepass")
                    out.write(z.compress(record(page_id, url, payload, digest(payload), refers, params)))
                    n += 1
            out.write(z.flush())
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n])], ["archive", "records"])

    return materialise(referred(pages, params).mapInArrow(run, "archive string, records long"), "warc-raw")


def normalise_archives(archives: DataFrame, folder: str, params: WarcParams = WarcParams()) -> DataFrame:
    """Normalise each archive in a task of its own. Returns (archive, records) of the new ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for source in b.column(0).to_pylist():
                target = f"{folder}/members/{source.rpartition('/')[2]}"
                n = len(normalise(source, target, params.level))
                yield pa.RecordBatch.from_arrays([pa.array([target]), pa.array([n])], ["archive", "records"])

    return materialise(_spread(archives).mapInArrow(run, "archive string, records long"), "warc-members")


def _spread(archives: DataFrame) -> DataFrame:
    """A few archives to a task, whichever task wrote them."""
    n = int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return archives.select("archive").repartition(4 * n, "archive")


def read_archives(archives: DataFrame) -> DataFrame:
    """One row per record, read through the sidecar index: page_id, payload_bytes, payload_digest,
    record_type, refers_to, archive, offset. A response's length and digest are those of the payload
    that was read; a payload that doesn't have its header's digest is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = lambda v: int(x) if (x := v[len("<urn:page:") : -1]) else None
        for b in batches:
            for archive in b.column(0).to_pylist():
                fs, path = _fs(archive)
                with fs.open_input_stream(f"{path}.idx", compression=None) as s:
                    index = [json.loads(x) for x in s.read().splitlines()]
                rows = []
                with fs.open_input_file(path) as handle:
                    for x in index:
                        f, body = read_at(handle, x["offset"], x["length"])
                        sha, n = f["warc-payload-digest"].partition(":")[2], int(f["x-payload-length"])
                        if f["warc-type"] == "response" and (digest(body) != sha or len(body) != n):
                            raise ValueError(f"{archive} at {x['offset']}: the payload isn't what the header says")
                        refers = number(f["warc-refers-to"]) if "warc-refers-to" in f else None
                        rows.append((number(f["warc-record-id"]), n, sha, f["warc-type"], refers, archive, x["offset"]))
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(list(zip(*rows)) or [()] * 7, kinds)],
                    ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "archive", "offset"],
                )

    return _spread(archives).mapInArrow(
        run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, offset long"
    )


def round_trip(pages: DataFrame, params: WarcParams = WarcParams()) -> DataFrame:
    """Write, normalise and read back all rows of pages.

    Null html is an empty payload, a null url an empty target. A null page_id is written
    without a number and comes back null; it is never referred to. Equal rows: those with the
    smallest page_id of equal payloads are responses, each. An empty table gives an empty result.
    """
    folder = fresh_path(pages.sparkSession, "warc")
    return read_archives(normalise_archives(write_archives(pages, folder, params), folder, params))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
