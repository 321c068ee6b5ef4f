"""Token-id files: range-coded ones with an index of their documents, and flat ones without.

Range-coded: documents in ascending order of their id, each with an end id, in files of at
most ``file_ids`` ids. Body: see rangecoder; after it the documents' ids and lengths,
compressed and checksummed. Flat: nothing but ids of 16 or 32 bits, each document followed
by a separator that no text can give; where documents begin is found by scanning.

Files go to the shared folder under names of their own; only those that a finished task has
put into its manifest count, so tasks that are run again leave no double documents.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablewright.llm import rangecoder
from tablewright.llm.bpe import Coder
from tablewright.llm.common import bound_batches, cut, map_rows, new_folder, open_fs, release


def pack(doc_ids: list, lengths: np.ndarray, ids: np.ndarray) -> bytes:
    body = rangecoder.encode(ids)
    known = np.array([i is not None for i in doc_ids], np.uint8)
    index = zlib.compress(known.tobytes() + np.array([i or 0 for i in doc_ids], "<i8").tobytes() + np.asarray(lengths, "<u8").tobytes(), 6)
    return struct.pack("<8sQQQI", b"TWFILE\x01\n", len(body), len(doc_ids), len(index), zlib.crc32(index)) + body + index


def unpack(data: bytes) -> tuple[list, np.ndarray, np.ndarray]:
    """Document ids, lengths and ids; CorruptFile where anything doesn't fit."""
    head = struct.calcsize("<8sQQQI")
    if len(data) < head or data[:8] != b"TWFILE\x01\n":
        raise rangecoder.CorruptFile("not a token file")
    _, body, n, size, crc = struct.unpack("<8sQQQI", data[:head])
    index = data[head + body :]
    if len(index) != size or zlib.crc32(index) != crc:
        raise rangecoder.CorruptFile("index")
    index = zlib.decompress(index)
    known, docs, lengths = np.frombuffer(index, np.uint8, n), np.frombuffer(index, "<i8", n, n), np.frombuffer(index, "<u8", n, 9 * n)
    ids = rangecoder.decode(data[head : head + body])
    if int(lengths.sum()) != len(ids):
        raise rangecoder.CorruptFile("lengths")
    return [int(d) if k else None for k, d in zip(known, docs, strict=True)], lengths.astype(np.int64), ids


def joined(batches, most: int = 12 << 20):
    """Ids and texts of some batches at a time, until they have ``most`` bytes: words are looked up once for each."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= most:
            yield tuple(pa.concat_arrays([b.column(k) for b in held]) for k in range(2))
            held, size = [], 0
    if held:
        yield tuple(pa.concat_arrays([b.column(k) for b in held]) for k in range(2))


def write_coded(df: DataFrame, tokenizer: str, end_id: int = 2, doc_id: str = "doc_id", text: str = "text", file_ids: int = 4 << 20, folder: str | None = None) -> DataFrame:
    """The manifest (part, seq, path, n_docs, n_ids) of the files that count. Documents are in ascending
    order of id, nulls first; rows that share an id are ordered by text, null texts (empty) first. Ids must
    cast to bigint."""
    folder = folder or new_folder(df.sparkSession, "tokens")
    bound_batches(df.sparkSession)

    def run(batches):
        part, seq, coder = TaskContext.get().partitionId(), 0, Coder.of(tokenizer, "library")
        fs, at = open_fs(folder)
        docs, lengths, held, size = [], [], [], 0

        def flush():
            name = f"part-{part:08d}-{seq:06d}-{uuid.uuid4().hex}.tok"
            fs.create_dir(at, recursive=True)
            with fs.open_output_stream(f"{at}/{name}", compression=None) as out:
                out.write(pack(docs, np.concatenate(lengths), np.concatenate(held)))
            return pa.RecordBatch.from_pydict({"part": [part], "seq": [seq], "path": [f"{folder}/{name}"], "n_docs": [len(docs)], "n_ids": [size]}, schema=schema)

        schema = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])
        for doc_ids, texts in joined(batches):
            keys = doc_ids.to_pylist()
            ids, n = coder.in_one(texts, end_id)
            ends, done, used = np.cumsum(n), 0, 0
            while done < len(keys):  # up to the document that fills the file
                stop = min(len(keys), int(np.searchsorted(ends, used + file_ids - size)) + 1)
                to = int(ends[stop - 1])
                docs += keys[done:stop]
                lengths.append(n[done:stop])
                held.append(ids[used:to])
                size, done, used = size + to - used, stop, to
                if size >= file_ids:
                    yield flush()
                    seq, docs, lengths, held, size = seq + 1, [], [], [], 0
        if docs:
            yield flush()
        coder.forget()
        release()

    rows = df.select(F.col(doc_id).cast("bigint").alias("_id"), F.col(text).alias("_text"))
    ordered = rows.repartitionByRange("_id").sortWithinPartitions("_id", "_text")
    return cut(ordered.mapInArrow(run, "part int, seq int, path string, n_docs bigint, n_ids bigint"))


def with_starts(manifest: DataFrame) -> DataFrame:
    """Ids before each file. Sums are taken within parts first, so what meets in one task is one
    row for each part."""
    parts = manifest.groupBy("part").agg(F.sum("n_ids").alias("n"))
    parts = parts.select("part", (F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))).alias("_before"))
    within = F.sum("n_ids").over(Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    return manifest.withColumn("_within", within).join(parts, "part").select("path", "n_docs", (F.coalesce("_before", F.lit(0)) + F.coalesce("_within", F.lit(0))).alias("start"))


def read_coded(spark: SparkSession, manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and ids, little-endian 32-bit) of each document, from the files."""

    def run(batches):
        for batch in batches:
            for path, n_docs, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                fs, at = open_fs(path)
                with fs.open_input_stream(at, compression=None) as f:
                    docs, lengths, ids = unpack(f.read())
                if len(docs) != n_docs:
                    raise rangecoder.CorruptFile(f"{path}: {len(docs)} documents of {n_docs}")
                ends = np.cumsum(lengths)
                raw = memoryview(ids.astype("<u4").tobytes())
                slices = [raw[4 * (e - n) : 4 * e] for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                columns = [pa.array(docs, pa.int64()), pa.array(start + ends - lengths, pa.int64()), pa.array(lengths, pa.int64()), pa.array([zlib.crc32(s) for s in slices], pa.int64())]
                if with_ids:
                    columns.append(pa.array([bytes(s) for s in slices], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(columns)])

    files = with_starts(manifest).select("path", "n_docs", "start")
    files = files.repartition(max(1, min(manifest.count(), 4 * spark.sparkContext.defaultParallelism)))
    return files.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids binary" * with_ids)


#: Documents whose ids stand in one row of a flat file's manifest.
RANKS = 4096


def write_flat(df: DataFrame, tokenizer: str, separator: int | None = None, doc_id: str = "doc_id", text: str = "text", folder: str | None = None) -> DataFrame:
    """The manifest of flat files, one for each task, documents in the order in which the task got them:
    (path, chunk, doc_ids) for each RANKS documents of a file and (path, n_bytes) for the file itself.
    The separator is the first id beyond the vocabulary. Ids of documents must cast to bigint."""
    folder = folder or new_folder(df.sparkSession, "flat")
    bound_batches(df.sparkSession)
    schema = pa.schema([("path", pa.string()), ("n_bytes", pa.int64()), ("chunk", pa.int64()), ("doc_ids", pa.list_(pa.int64()))])

    def run(batches):
        coder = Coder.of(tokenizer)
        sep = len(coder.bytes_of) if separator is None else separator
        kind = "<u2" if sep < 1 << 16 else "<u4"
        end = np.array([sep], kind).tobytes()
        fs, at = open_fs(folder)
        name, out, docs, chunk, size = f"{uuid.uuid4().hex}.ids", None, [], 0, 0
        path = f"{folder}/{name}"
        row = lambda n_bytes, k, ids: pa.RecordBatch.from_pydict({"path": [path], "n_bytes": [n_bytes], "chunk": [k], "doc_ids": [ids]}, schema=schema)
        try:
            for batch in batches:
                keys, texts = (c.to_pylist() for c in batch.columns)
                for i in range(0, len(keys), 128):
                    if out is None:
                        fs.create_dir(at, recursive=True)
                        out = fs.open_output_stream(f"{at}/{name}", compression=None)
                    data = b"".join(x for ids in coder.encode(texts[i : i + 128]) for x in (np.frombuffer(ids, "<u4").astype(kind).tobytes(), end))
                    out.write(data)
                    size += len(data)
                docs += keys
                while len(docs) >= RANKS:
                    yield row(None, chunk, docs[:RANKS])
                    docs, chunk = docs[RANKS:], chunk + 1
            if out is not None:
                out.close()
                if docs:
                    yield row(None, chunk, docs)
                yield row(size, None, None)
        finally:
            coder.forget()
            release()

    rows = df.select(F.col(doc_id).cast("bigint").alias("_id"), F.col(text).alias("_text"))
    return cut(rows.mapInArrow(run, "path string, n_bytes bigint, chunk bigint, doc_ids array<bigint>"))


def separators(files: DataFrame, separator: int, block_bytes: int = 8 << 20) -> DataFrame:
    """path, block, n_ids and the positions in the file of the separators of each block."""
    width = 2 if separator < 1 << 16 else 4

    def make():
        def work(columns):
            found = []
            for path, block, size in zip(*columns, strict=True):
                fs, at = open_fs(path)
                start = block * block_bytes
                with fs.open_input_file(at) as f:
                    data = f.read_at(min(block_bytes, size - start), start)
                found.append(np.flatnonzero(np.frombuffer(data, f"<u{width}") == separator) + start // width)
            return [columns[0], columns[1], [p.tolist() for p in found]]

        return work

    # blocks never cut an id, as their size is a multiple of its width
    blocks = files.where("n_bytes > 0").select("path", F.explode(F.sequence(F.lit(0), F.expr(f"cast((n_bytes - 1) div {block_bytes} as int)"))).alias("block"), "n_bytes")
    # dealt by (path, block) to as many tasks as Spark sees fit
    return map_rows(blocks.repartition("path", "block"), "path string, block int, positions array<bigint>", make)


def counts(manifest: DataFrame, separator: int, block_bytes: int = 8 << 20) -> DataFrame:
    """doc_id and n_tokens (without the separator) of each document of flat files; null ids stay null, repeated
    ones are rows of their own, an empty or null text has 0.

    Each block says how many separators it has and where the last is; a running count and a
    running last position over the blocks of a file (a prefix scan) tell each block which
    document it begins in and where that one began, so documents may span any number of blocks.
    """
    found = cut(separators(manifest, separator, block_bytes))
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    scanned = found.select(
        "path", "positions",
        F.coalesce(F.sum(F.size("positions")).over(before), F.lit(0)).cast("bigint").alias("rank"),
        F.coalesce(F.last(F.element_at(F.when(F.size("positions") > 0, F.col("positions")), -1), ignorenulls=True).over(before), F.lit(-1)).alias("carry"),
    ).where(F.size("positions") > 0)
    ends = F.transform("positions", lambda p, i: p - F.coalesce(F.get("positions", i - 1), F.col("carry")) - 1)
    scanned = scanned.select("path", "rank", ends.alias("ends"))
    # a block's documents, cut where chunks of document ids are, so that either side of the join is read once
    chunks = F.sequence(F.expr(f"rank div {RANKS}"), F.expr(f"(rank + size(ends) - 1) div {RANKS}"))
    cuts = scanned.select("path", "rank", "ends", F.explode(chunks).alias("chunk")).select("path", "chunk", F.greatest(F.col("rank"), F.col("chunk") * RANKS).alias("first"), "rank", "ends")
    cuts = cuts.select("path", "chunk", (F.col("first") - F.col("chunk") * RANKS).cast("int").alias("at"), F.slice("ends", (F.col("first") - F.col("rank") + 1).cast("int"), ((F.col("chunk") + 1) * RANKS - F.col("first")).cast("int")).alias("n_tokens"))
    mine = cuts.join(manifest.where("chunk is not null").select("path", "chunk", "doc_ids"), ["path", "chunk"]).select(F.slice("doc_ids", F.col("at") + 1, F.size("n_tokens")).alias("doc_id"), "n_tokens")
    return mine.select(F.explode(F.arrays_zip("doc_id", "n_tokens")).alias("x")).select("x.doc_id", "x.n_tokens")
