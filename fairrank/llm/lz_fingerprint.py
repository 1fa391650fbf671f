"""Document fingerprints from Lempel-Ziv phrases.

A text's UTF-8 bytes are parsed into dictionary phrases (LZ78: the shortest run that is not a
phrase yet becomes one).  Every phrase is hashed (XXH3); the fingerprint is the ``KEPT`` smallest
32-bit hashes of the phrase set.  Two fingerprints are compared by the share of common hashes
among the smallest of both: an estimate of the Jaccard similarity of the phrase sets, exact for
sets of up to ``KEPT`` phrases.  Texts that compress each other share phrases.

``fingerprint_documents`` is one pass without a shuffle.  ``compare_with_neighbours`` looks at
every document next to the following one (by falling id) and to an edited text made of both.
Documents are dealt by ranges of (id, text hash, row number), each range with the text that
follows it, so that texts are shuffled once, a worker holds two texts at a time, and no task sees
all of them.  Only the ranges' borders, one row a range, reach the driver.  A document and its
edited text have the same beginning, which is parsed once.

Defined results: null text is empty; an empty text has an empty fingerprint; two empty ones are
alike (1.0), an empty and another one are not (0.0); documents go by falling id, null last, ties
by text hash, then by where the row is read (rows equal in id and text are interchangeable); a
single document follows itself; extra columns are not read, whatever their names; an empty table
gives an empty table.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairrank.llm.common import pick, small_batches, staged

KEPT = 128
#: Bytes of text per range of documents.
RANGE_BYTES = 8 << 20
MAX_RANGES = 1 << 15


def extend(data: bytes, start: int, end: int, phrases: set[bytes]) -> tuple[int, list[bytes]]:
    """Parse on from a phrase that began at ``start`` and has been read up to ``end``: where the
    unfinished phrase begins, and the new phrases (added to ``phrases``)."""
    new = []
    for stop in range(end + 1, len(data) + 1):
        p = data[start:stop]
        if p not in phrases:
            phrases.add(p)
            new.append(p)
            start = stop
    return start, new


def signature(phrases: list[bytes], other: np.ndarray | None = None) -> np.ndarray:
    """The smallest hashes of phrases, and of the set that has the signature ``other``."""
    h = np.array([xxhash.xxh3_64_intdigest(p) >> 32 for p in phrases], np.uint32)
    if other is not None:
        h = np.concatenate((h, other))
    return np.unique(h)[:KEPT]


def fingerprint(sig: np.ndarray) -> str:
    return sig.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    both = np.union1d(a, b)
    if max(len(a), len(b)) == KEPT:  # a full one knows nothing beyond its last hash
        both = both[:KEPT]
    if not len(both):
        return 1.0
    return float(np.mean(np.isin(both, a, assume_unique=True) & np.isin(both, b, assume_unique=True)))


class Parsed:
    """A text with its signature, and its parse up to the last half."""

    def __init__(self, text: str):
        self.n = len(text)
        self.kept = text[:self.n - self.n // 2]
        data, half = text.encode(), self.kept.encode()
        self.phrases: set[bytes] = set()
        self.start, new = extend(half, 0, 0, self.phrases)
        self.half, self.half_signature = half, signature(new)
        rest = self.phrases.copy()
        self.signature = signature(extend(data, self.start, len(half), rest)[1], self.half_signature)
        self.text = text

    def edited(self, following: str) -> tuple[str, np.ndarray]:
        """SHA-256 and signature of the text whose last half is replaced by the following text's
        beginning; ends the use of the parse."""
        data = self.half + following[:self.n // 2].encode()
        new = extend(data, self.start, len(self.half), self.phrases)[1]
        return hashlib.sha256(data).hexdigest(), signature(new, self.half_signature)


def fingerprint_documents(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, fingerprint) per document, in one pass."""
    small_batches(documents.sparkSession)
    docs = pick(documents, [id_col, text_col]).toDF("doc_id", "text").withColumn("text", F.coalesce("text", F.lit("")))

    def run(batches):
        for b in batches:
            texts = b.column(1).to_pylist()
            prints = [fingerprint(signature(extend(t.encode(), 0, 0, set())[1])) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(map(len, texts)), pa.int64()), pa.array(prints)],
                                             ["doc_id", "n_chars", "fingerprint"])

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_chars bigint, fingerprint string")


def compare_fingerprints(pairs: DataFrame, a: str, b: str, out: str = "likeness") -> DataFrame:
    """The rows of ``pairs`` with the likeness of two fingerprint columns at the end; null if one is null."""
    flat = pairs.toDF(*[f"_c{i}" for i in range(len(pairs.columns))])
    at = [pairs.columns.index(c) for c in (a, b)]

    def read(text):
        return np.frombuffer(bytes.fromhex(text), ">u4").astype(np.uint32)

    def run(batches):
        for batch in batches:
            got = [None if x is None or y is None else likeness(read(x), read(y))
                   for x, y in zip(*[batch.column(i).to_pylist() for i in at])]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, pa.float64())], [*batch.schema.names, "_l"])

    schema = flat.withColumn("_l", F.lit(0.0).cast("double")).schema
    return flat.mapInArrow(run, schema).toDF(*pairs.columns, out)


def _ranges(docs: DataFrame) -> tuple[DataFrame, DataFrame] | None:
    """(bounds, heads): one row with the least key of every range, in order, and the row number of
    every range's first text (by falling key) with the range that it follows."""
    spark = docs.sparkSession
    keys = staged(docs.select("key", F.octet_length("text").alias("size")), "keys")
    size = keys.agg(F.sum("size")).first()[0]
    if size is None:
        return None
    n = min(MAX_RANGES, max(1, size // RANGE_BYTES, spark.sparkContext.defaultParallelism))
    ends = (keys.repartitionByRange(int(n), "key").groupBy(F.spark_partition_id().alias("part"))
            .agg(F.min("key").alias("low"), F.max("key").alias("high")))
    ends = staged(ends, "range-ends")  # one row a range
    bounds = ends.agg(F.array_sort(F.collect_list("low")).alias("bounds"))
    highs = [r[0] for r in ends.orderBy("low").select("high.row").collect()]
    # what comes after range i is the first text of range i - 1, and of the last one after the first
    after = [(row, (i + 1) % len(highs) + 1) for i, row in enumerate(highs)]
    return bounds, spark.createDataFrame(after, "row bigint, bucket int")


COLUMNS = "n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compare_with_neighbours(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next):
    every document against its edited text and against the next document."""
    spark = documents.sparkSession
    small_batches(spark)
    docs = pick(documents, [id_col, text_col]).toDF("doc_id", "text").withColumn("text", F.coalesce("text", F.lit("")))
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {COLUMNS}"
    docs = docs.select("text", F.struct("doc_id", F.xxhash64("text").alias("th"), F.monotonically_increasing_id().alias("row")).alias("key"))
    ranges = _ranges(docs)
    if ranges is None:
        return spark.createDataFrame([], schema)
    bounds, heads = ranges
    # binary search: how many ranges begin at or before the key
    steps = F.array(*[F.lit(1 << s) for s in reversed(range(MAX_RANGES.bit_length()))])
    place = F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get("bounds", at + step - 1) <= F.col("key"), at + step).otherwise(at))
    mine = docs.crossJoin(F.broadcast(bounds)).select(place.alias("bucket"), F.lit(0).alias("after"), "key", "text")
    follow = (docs.join(F.broadcast(heads), F.col("key.row") == F.col("row"))
              .select("bucket", F.lit(1).alias("after"), "key", "text"))
    rows = mine.union(follow).repartition("bucket").sortWithinPartitions("bucket", "after", F.desc("key"))
    rows = rows.select("after", "key.doc_id", "text")

    def run(batches):
        def stream(batch):
            nonlocal held
            for after, doc_id, text in zip(*[c.to_pylist() for c in batch.columns]):
                now = Parsed(text)
                if held is not None:
                    sha, sig = held[1].edited(text)
                    yield (held[0], held[1].n, sha, fingerprint(held[1].signature), fingerprint(sig),
                           likeness(held[1].signature, sig), likeness(held[1].signature, now.signature))
                held = None if after else (doc_id, now)

        held = None
        for batch in batches:
            if out := list(stream(batch)):
                kinds = [batch.schema.field(1).type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    names = [f.split()[0] for f in schema.split(", ")]
    return rows.mapInArrow(run, schema)
