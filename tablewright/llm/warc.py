"""WARC archives: one gzip member for each record, and a sequential reader that trusts nothing.

Writing: a task streams its records to one archive in the shared folder and reports it in
a manifest; only archives in the manifest count, so a task that is run again leaves no
double records. Reading: a task streams an archive and inflates it member by member
with zlib, frames each record by its Content-Length and verifies block and payload
digests. Payload digests are SHA-1, in base32 in the headers as the format has it.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.llm.common import bound_batches, cut, new_folder, open_fs

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
STEP = 1 << 16
SALTS = 16


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(kind: str, record_id: str, uri: str, payload: bytes, payload_digest: str | None = None, refers_to: str | None = None, date: str = "2020-01-01T00:00:00Z", level: int = 3) -> bytes:
    """One gzip member. A revisit stores the response's HTTP headers without its payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if kind == "revisit" else http + payload
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {date}"]
    if uri:
        head.append(f"WARC-Target-URI: {uri}")
    head += ["Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: {payload_digest or digest(payload)}", f"WARC-Block-Digest: {digest(block)}"]
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{refers_to}>"]
    head.append(f"Content-Length: {len(block)}")
    deflate = zlib.compressobj(level, zlib.DEFLATED, 31)
    return deflate.compress("\r\n".join(head).encode() + b"\r\n\r\n") + deflate.compress(block) + deflate.compress(b"\r\n\r\n") + deflate.flush()


@dataclass
class Record:
    headers: dict[str, str]
    http: dict[str, str]
    payload: bytes
    payload_bytes: int
    offset: int


class BrokenArchive(ValueError):
    """Bad framing, a cut-off member or a digest that doesn't hold."""


def members(stream) -> Iterator[tuple[int, bytes]]:
    """(offset, inflated bytes) of each gzip member; the stream is read once, in steps."""
    held, start, ended = b"", 0, False
    while True:
        inflate, out, used = zlib.decompressobj(31), [], 0
        while not inflate.eof:
            if not held:
                held = stream.read(STEP)
                if not held:
                    if used:
                        raise BrokenArchive(f"member at {start} is cut off")
                    ended = True
                    break
            try:
                out.append(inflate.decompress(held))
            except zlib.error as e:
                raise BrokenArchive(f"member at {start}: {e}") from e
            used += len(held) - len(inflate.unused_data)
            held = inflate.unused_data
        if ended:
            return
        yield start, b"".join(out)
        start += used


def _headers(lines: bytes) -> dict[str, str]:
    out = {}
    for line in lines.split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon:
            raise BrokenArchive(f"no header: {line[:60]!r}")
        out[name.strip().lower().decode()] = value.strip().decode("utf-8", "replace")
    return out


def records(stream) -> Iterator[Record]:
    for offset, data in members(stream):
        version, _, rest = data.partition(b"\r\n")
        head, gap, rest = rest.partition(b"\r\n\r\n")
        if not version.startswith(b"WARC/1.") or not gap:
            raise BrokenArchive(f"record at {offset} has no WARC header")
        headers = _headers(head)
        size = int(headers.get("content-length", -1))
        block, tail = rest[:size], rest[size:]
        if size < 0 or len(block) != size or tail != b"\r\n\r\n":
            raise BrokenArchive(f"record at {offset} isn't framed by its length")
        if headers.get("warc-block-digest", digest(block)) != digest(block):
            raise BrokenArchive(f"record at {offset}: block digest")
        top, _, payload = block.partition(b"\r\n\r\n")
        http = _headers(top.partition(b"\r\n")[2])
        if headers["warc-type"] == "response" and headers["warc-payload-digest"] != digest(payload):
            raise BrokenArchive(f"record at {offset}: payload digest")
        yield Record(headers, http, payload, int(http.get("content-length", len(payload))), offset)


def with_revisits(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = 1000) -> DataFrame:
    """_id, _url, _html, _sha1 and _refers (null for responses). Of equal payloads of at least
    ``least_bytes`` the largest page_id is the response; rows that tie on it are all responses, as
    are rows with a null id. What a digest has to send is one number for each task; only pages that may be
    revisits are shuffled, and those of one digest go to several tasks."""
    full = pages.select(F.col(page_id).alias("_id"), F.col(url).alias("_url"), F.coalesce(F.col(html), F.lit("")).alias("_html"))
    full = full.withColumn("_sha1", F.sha1(F.col("_html").cast("binary")))
    may_revisit = (F.octet_length("_html") >= least_bytes) & F.col("_id").isNotNull()
    last = full.where(may_revisit).groupBy("_sha1").agg(F.max("_id").alias("_last"), F.min("_id").alias("_first")).where("_first < _last").select("_sha1", "_last")
    # pages of one digest are dealt to SALTS tasks, to each of which the digest's one row goes
    last = last.select("_sha1", "_last", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    large = full.where(may_revisit).withColumn("_salt", F.pmod(F.xxhash64("_id"), F.lit(SALTS)).cast("int")).join(last, ["_sha1", "_salt"], "left")
    columns = ("_id", "_url", "_html", "_sha1")
    decided = large.select(*columns, F.when(F.col("_id") < F.col("_last"), F.col("_last")).alias("_refers"))
    # small payloads, the empty one above all, are never revisits and stay where they are
    return decided.unionByName(full.where(~may_revisit).select(*columns, F.lit(None).cast(dict(full.dtypes)["_id"]).alias("_refers")))


def write(decided: DataFrame, folder: str) -> DataFrame:
    """Archives of the rows of ``with_revisits``; the manifest (path, n) of those that count."""
    bound_batches(decided.sparkSession)

    def run(batches):
        fs, at = open_fs(folder)
        fs.create_dir(at, recursive=True)
        name, n, out = f"part-{uuid.uuid4().hex}.warc.gz", 0, None
        for batch in batches:
            for i, u, h, sha, ref in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    out = fs.open_output_stream(f"{at}/{name}", compression=None)
                payload = h.encode("utf-8", "surrogatepass")
                mark = "sha1:" + base64.b32encode(bytes.fromhex(sha)).decode()
                out.write(record("response" if ref is None else "revisit", _urn(i), " ".join((u or "").split()), payload, mark, None if ref is None else _urn(ref)))
                n += 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "n": [n]})

    return cut(decided.mapInArrow(run, "path string, n bigint"))


def _urn(i) -> str:
    return "urn:page:" + ("" if i is None else str(i))


def _page(urn: str | None) -> int | None:
    i = (urn or "").strip("<>").rpartition(":")[2]
    return int(i) if i else None


def read(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """A row for each record of the archives, in the order of each archive."""
    def run(batches):
        for batch in batches:
            for path, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                fs, at = open_fs(path)
                rows, seen, size = [], 0, 0
                with fs.open_input_stream(at, compression=None) as stream:
                    for r in records(stream):
                        sha = base64.b32decode(r.headers["warc-payload-digest"].partition(":")[2]).hex()
                        rows.append((_page(r.headers["warc-record-id"]), r.headers.get("warc-target-uri"), r.payload_bytes, sha, r.headers["warc-type"], _page(r.headers.get("warc-refers-to")), r.payload))
                        seen, size = seen + 1, size + len(r.payload)
                        if size > 16 << 20:
                            yield _batch(rows)
                            rows, size = [], 0
                if seen != n:
                    raise BrokenArchive(f"{path}: {seen} records of {n}")
                if rows:
                    yield _batch(rows)

    files = manifest.repartition(max(1, min(manifest.count(), spark.sparkContext.defaultParallelism * 4)))
    return files.mapInArrow(run, "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, payload binary")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
    names = ("page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload")
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=list(names))


def round_trip(pages: DataFrame, least_bytes: int = 1000) -> DataFrame:
    """Write every page to archives and read them back: page_id, url, payload_bytes,
    payload_digest (bare hex SHA-1), record_type, refers_to, payload (empty for revisits).

    A null html is an empty payload and a null url an absent target; a null page_id stays
    null. Repeated rows are records of their own. Other columns are dropped.
    """
    spark = pages.sparkSession
    return read(spark, write(with_revisits(pages, least_bytes=least_bytes), new_folder(spark, "warc")))
