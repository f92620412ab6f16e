"""Operator 3: token ids as length-delimited binary records with a separate offset index.

A record file holds, for each document: its payload's length (8 bytes), that length's masked
CRC-32C (4), the payload, and the payload's masked CRC-32C (4), all little-endian. A payload is
the doc_id (8 bytes, the least integer for a null), the bytes that an id takes (2), and the ids,
of 2 bytes where the vocabulary has no more than 65,536 and of 4 elsewhere. The index beside it
has 24 bytes for a record: doc_id, the record's place in the file, and its number of ids; so a
reader can take records in any order.

Documents are sorted by doc_id over range partitions, one file each. A null text is an empty one
(it still has the end id); a null doc_id comes first; rows that repeat a doc_id follow each other.
Very long texts are one record each. An empty table gives an index without rows; other columns play
no part.
"""

from __future__ import annotations

import os
import random
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakframe.llm.common import by_bytes, prepare, shared_dir
from cloakframe.llm.crc32c import crc32c, masked
from cloakframe.llm.tokens import encoder

NO_ID = -(1 << 63)
INDEX = np.dtype([("doc_id", "<i8"), ("offset", "<u8"), ("n", "<u4"), ("width", "<u4")])
FRAME = 16
HEAD = 10  # of a payload
MANIFEST = "part int, file string, n_records long, n_tokens long"
ROWS = "doc_id long, start long, n_tokens long, ids_crc32 long"


def frame(payloads: list[bytes]) -> list[bytes]:
    """The payloads as records."""
    lengths = [len(x).to_bytes(8, "little") for x in payloads]
    heads, bodies = masked(crc32c(lengths)).astype("<u4").tobytes(), masked(crc32c(payloads)).astype("<u4").tobytes()
    return [b"".join((n, heads[4 * i : 4 * i + 4], x, bodies[4 * i : 4 * i + 4])) for i, (n, x) in enumerate(zip(lengths, payloads, strict=True))]


def unframe(records: list[bytes]) -> list[bytes]:
    """The payloads of whole records; ValueError if a length or a checksum is wrong."""
    payloads = [x[12:-4] for x in records]
    heads, bodies = masked(crc32c([x[:8] for x in records])), masked(crc32c(payloads))
    for x, payload, head, body in zip(records, payloads, heads.tolist(), bodies.tolist(), strict=True):
        if int.from_bytes(x[:8], "little") != len(payload) or int.from_bytes(x[8:12], "little") != head or int.from_bytes(x[-4:], "little") != body:
            raise ValueError("a record is damaged")
    return payloads


def _put(files: fs.FileSystem, source: str, target: str) -> None:
    """Gives a finished file its name; a second attempt of the task replaces it by the same bytes."""
    try:
        files.move(source, target)
    except OSError:
        files.delete_file(target)
        files.move(source, target)


def write_records(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0) -> list[tuple[int, str, int, int]]:
    """Writes docs (doc_id, text) below path; returns the manifest, a row for each file in order.

    The manifest has one small row for a partition; nothing else reaches the driver.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = fs.FileSystem.from_uri(path)
        files.create_dir(root, recursive=True)
        task = TaskContext.get()
        name, attempt = f"part-{task.partitionId():06d}", task.taskAttemptId()
        encode, width, end = encoder(tokenizer).encode, encoder(tokenizer).width, end_id.to_bytes(4, "little")
        kind, mark = f"<u{width}", width.to_bytes(2, "little")
        index, place, tokens, out = [], 0, 0, None
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in by_bytes(texts, 4 << 20):
                payloads = [(NO_ID if d is None else d).to_bytes(8, "little", signed=True) + mark + np.frombuffer(x + end, "<u4").astype(kind).tobytes() for d, x in zip(ids[a:b], encode(texts[a:b]), strict=True)]
                records = frame(payloads)
                out = out or files.open_output_stream(f"{root}/{name}.rec.{attempt}")
                out.write(b"".join(records))
                rows = np.empty(b - a, INDEX)
                rows["doc_id"] = [NO_ID if d is None else d for d in ids[a:b]]
                sizes = np.array([len(x) for x in records])
                rows["offset"] = place + np.cumsum(sizes) - sizes
                rows["n"], rows["width"] = (sizes - FRAME - HEAD) // width, width
                place, tokens = place + int(sizes.sum()), tokens + int(rows["n"].sum(dtype=np.int64))
                index.append(rows)
        if out is None:
            return
        out.close()
        with files.open_output_stream(f"{root}/{name}.idx.{attempt}") as f:
            for rows in index:
                f.write(rows.tobytes())
        _put(files, f"{root}/{name}.idx.{attempt}", f"{root}/{name}.idx")
        _put(files, f"{root}/{name}.rec.{attempt}", f"{root}/{name}.rec")
        yield pa.RecordBatch.from_pydict({"part": pa.array([task.partitionId()], pa.int32()), "file": [name], "n_records": [sum(map(len, index))], "n_tokens": [tokens]})

    # The text's hash keeps partitions even where one doc_id has many rows.
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("tie"))
    ordered = keyed.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    return sorted(tuple(r) for r in ordered.mapInArrow(write, MANIFEST).collect())


def read_index(path: str, name: str) -> np.ndarray:
    files, root = fs.FileSystem.from_uri(path)
    with files.open_input_file(f"{root}/{name}.idx") as f:
        return np.frombuffer(f.read(), INDEX)


def read_payloads(path: str, name: str, index: np.ndarray, limit: int = 8 << 20) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    """Runs of the index with their checked payloads; rows that follow each other are read at once."""
    files, root = fs.FileSystem.from_uri(path)
    with files.open_input_file(f"{root}/{name}.rec") as f:
        sizes = index["n"].astype(np.int64) * index["width"] + HEAD + FRAME
        a = 0
        while a < len(index):
            b, total = a + 1, int(sizes[a])
            while b < len(index) and total + int(sizes[b]) <= limit and index["offset"][b] == index["offset"][b - 1] + np.uint64(sizes[b - 1]):
                total += int(sizes[b])
                b += 1
            f.seek(int(index["offset"][a]))
            data, at = f.read(total), np.concatenate(([0], np.cumsum(sizes[a:b])))
            yield index[a:b], unframe([data[at[i] : at[i + 1]] for i in range(b - a)])
            a = b


def ids_of(payload: bytes) -> np.ndarray:
    return np.frombuffer(payload, f"<u{payload[8]}", offset=HEAD)


def shuffled(path: str, name: str, seed: int) -> Iterator[tuple[int | None, np.ndarray]]:
    """A file's documents (doc_id, ids) in an order that the seed decides, read through the index."""
    index = read_index(path, name)
    order = list(range(len(index)))
    random.Random(seed).shuffle(order)
    for i in order:
        for rows, payloads in read_payloads(path, name, index[i : i + 1]):
            doc = int(rows["doc_id"][0])
            yield None if doc == NO_ID else doc, ids_of(payloads[0])


def read_records(spark: SparkSession, path: str, manifest: list[tuple[int, str, int, int]]) -> DataFrame:
    """A row for each record in the files: doc_id, start, n_tokens and ids_crc32."""
    starts, base = [], 0
    for _, name, _, tokens in manifest:
        starts.append((name, base))
        base += tokens

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column(0).to_pylist():
                name, at = starts[k]
                for rows, payloads in read_payloads(path, name, read_index(path, name)):
                    n = rows["n"].astype(np.int64)
                    docs = [int.from_bytes(x[:8], "little", signed=True) for x in payloads]
                    ids = [ids_of(x) for x in payloads]
                    yield pa.RecordBatch.from_pydict(
                        {
                            "doc_id": pa.array([None if d == NO_ID else d for d in docs], pa.int64()),
                            "start": pa.array(at + np.cumsum(n) - n, pa.int64()),
                            "n_tokens": pa.array([len(x) for x in ids], pa.int64()),
                            "ids_crc32": pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64()),
                        }
                    )
                    at += int(n.sum())

    n = len(starts)
    return spark.range(0, n, 1, max(n, 1)).mapInArrow(read, ROWS)


def op3_token_records(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    """Contract query: byte-level ids of every document, end id 0, written and read back."""
    import public_tokenizers

    prepare(spark)
    path = shared_dir(spark, "records")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    manifest = write_records(docs, path, tokenizer or os.path.abspath(public_tokenizers.path("byte_bpe_50k.json")))
    return read_records(spark, path, manifest)
