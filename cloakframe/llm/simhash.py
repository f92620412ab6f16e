"""Operator 4: SimHash fingerprints, their Hamming self-join over a binary trie, and components.

A null text is an empty one: it has no words, so its fingerprint is zero, and all such rows are
one group. A null doc_id never is a component's id unless all its ids are null. Repeated rows are
members of the same group. Very long texts are read whole; a bit that exactly half of the shingles
have is 0. An empty table gives an empty one; columns besides doc_id and text play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakframe.llm.common import by_bytes, discard, hot_join, prepare, stored
from cloakframe.llm.trie import components, links

SEED = 42


def words(text: str | None) -> list[bytes]:
    """Words between ASCII white space, with A-Z in lower case, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingle_digests(w: list[bytes], size: int, seed: int = SEED) -> bytes:
    """The XXH64 of each run of size words, big-endian; of the whole sequence if that is shorter."""
    if len(w) <= size:
        return xxhash.xxh64_digest(b" ".join(w), seed) if w else b""
    digest, join = xxhash.xxh64_digest, b" ".join
    return b"".join([digest(join(t), seed) for t in zip(*(w[k:] for k in range(size)), strict=False)])


def majority(digests: list[bytes]) -> np.ndarray:
    """For each run of hashes the 64 bits that over half of them have set."""
    counts = np.array([len(x) // 8 for x in digests])
    out = np.zeros(len(digests), np.uint64)
    on = np.flatnonzero(counts)
    if len(on):
        bits = np.unpackbits(np.frombuffer(b"".join(digests), np.uint8).reshape(-1, 8), axis=1)
        starts = np.cumsum(counts[on]) - counts[on]
        sums = np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
        out[on] = np.packbits(2 * sums > counts[on][:, None], axis=1).view(">u8").ravel()
    return out


def fingerprints(docs: DataFrame, shingle_words: int = 3) -> DataFrame:
    """docs (doc_id, text): (doc_id, fp), fp the 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            got = [majority([shingle_digests(words(x), shingle_words) for x in texts[a:b]]) for a, b in by_bytes(texts)]
            if got:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(got).view(np.int64))], names=["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def near_groups(docs: DataFrame, shingle_words: int = 3, budget: int = 3) -> DataFrame:
    """(doc_id, fp, component_id): groups of docs whose fingerprints link at budget bits or fewer."""
    marked = stored(fingerprints(docs, shingle_words), "marked")
    classes = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "classes")
    edges = stored(links(classes.select(F.lit(0).alias("view"), "fp"), budget), "links")
    found = components(edges)
    discard(edges)
    linked = classes.join(found.withColumnRenamed("node", "fp"), "fp")
    least = linked.groupBy("root").agg(F.min("first_id").alias("component_id"))
    known = linked.join(least, "root").select("fp", "component_id")
    named = classes.join(known, "fp", "left").select("fp", F.coalesce("component_id", "first_id").alias("component_id"))
    # A fingerprint may be that of a third of all rows.
    return hot_join(marked, named, "fp").select("doc_id", "fp", "component_id")


def op4_simhash_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: 3-word shingles, links at 3 bits, one row for each document."""
    prepare(spark)
    groups = near_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
