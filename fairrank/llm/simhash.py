"""SimHash near-duplicates, filtered by the pigeonring principle.

A document's fingerprint has 64 bits; bit b is set if over half of its shingles' hashes have it.
Equal fingerprints are grouped first, so exact copies, however many, are one node.

Links (at most ``MAX_BITS`` = 2 differing bits) between distinct fingerprints come from the
pigeonring filter: the 64 bits lie on a ring of five segments, and for any linked pair some
start has a chain of segments whose cumulative differences stay within l * 2/5 for every chain
length l, that is at most 0, 0, 1, 1, 2.  So the first two segments agree and of the next two at
least one agrees, which gives ten join keys of 38 or 39 bits.  Candidates that share a key must
pass the whole chain from that start and then the full Hamming check.

Keys shared by more than ``BUCKET`` fingerprints would make pairs quadratic.  The members of
such buckets take an exact linear way: two fingerprints differ in at most two bits exactly if
some 64-bit value is within one bit of both, so members sharing such a value link to the
smallest of them.  No pair is lost and none is listed inside a hot group.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fairrank.llm.common import pick, positional, small_batches, staged
from fairrank.llm.graph import connected_components

SHINGLE = 3
MAX_BITS = 2
SEGMENTS = (13, 13, 13, 13, 12)
#: Members of a key's bucket that are compared pair by pair.
BUCKET = 32
SEED = 42
UPPER_TO_LOWER = bytes(i + 32 if 65 <= i <= 90 else i for i in range(256))


def shingle_hashes(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """XXH64 (seed 42) of every word shingle; of the whole sequence if it has fewer words."""
    # bytes.split() cuts at exactly the six ASCII white space characters
    words = text.encode("utf-8", "replace").translate(UPPER_TO_LOWER).split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= size:
        return np.array([digest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-size])).tolist()
    stops = (ends[size - 1:] - 1).tolist()
    return np.fromiter((digest(joined[a:z], SEED) for a, z in zip(starts, stops)), np.uint64, len(starts))


def fingerprint(hashes: np.ndarray) -> int:
    """Bit b is set if it is set in over half of the hashes; zero without hashes."""
    n = len(hashes)
    if not n:
        return 0
    low = np.uint64(0x0101010101010101)
    cuts = np.arange(0, n, 255)  # a byte lane counts to 255
    out = 0
    for k in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(k)) & low, cuts)
        counts = lanes.view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)  # lane j: bit 8 j + k
        for j in range(8):
            if 2 * int(counts[j]) > n:
                out |= 1 << (8 * j + k)
    return out


def fingerprints(documents: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """(doc_id, th, fp): th, a hash of the text, tells rows of one id apart; fp as signed long."""
    small_batches(documents.sparkSession)
    docs = pick(documents, [id_col, text_col]).toDF("doc_id", "text")
    docs = docs.select("doc_id", F.xxhash64("text").alias("th"), "text")
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            fps = np.array([fingerprint(shingle_hashes(t, size)) for t in b.column(2).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps.view(np.int64))],
                                             ["doc_id", "th", "fp"])

    return docs.mapInArrow(run, f"doc_id {id_type}, th bigint, fp bigint")


def _segment_masks() -> list[int]:
    masks, at = [], 0
    for width in SEGMENTS:
        masks.append(((1 << width) - 1) << at)
        at += width
    return masks


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _chain_passes(start: Column, xor: Column) -> Column:
    """Cumulative differences of the segments from ``start`` on stay within l * MAX_BITS / 5."""
    masks, n = _segment_masks(), len(SEGMENTS)
    checks = None
    for s in range(n):
        ok, mask = F.lit(True), 0
        for length in range(1, n + 1):
            mask |= masks[(s + length - 1) % n]
            ok = ok & (F.bit_count(xor.bitwiseAND(F.lit(_signed(mask)))) <= length * MAX_BITS // n)
        checks = F.when(start == s, ok) if checks is None else checks.when(start == s, ok)
    return checks


def _keys() -> list[tuple[int, int]]:
    """(start, mask of the segments that agree): the two first, and either of the next two."""
    masks, n = _segment_masks(), len(SEGMENTS)
    return [(s, masks[s] | masks[(s + 1) % n] | masks[(s + far) % n]) for s in range(n) for far in (2, 3)]


def links(fps: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Edges (u, v) whose components are those of all pairs at most MAX_BITS bits apart.
    ``fps``: one column fp, distinct."""
    keys = F.array(*[F.struct(F.lit(i).alias("k"), F.lit(s).alias("s"),
                              F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("part"))
                     for i, (s, m) in enumerate(_keys())])
    rows = fps.select("fp", F.explode(keys).alias("x")).select("fp", "x.k", "x.s", "x.part")
    shared = rows.groupBy("k", "part").agg(F.count("*").alias("n")).where("n > 1")
    rows = staged(rows.join(shared, ["k", "part"]), "shared-keys")
    small = rows.where(F.col("n") <= bucket)
    # within a bounded bucket: every member with the members above it
    members = small.groupBy("k", "part").agg(F.first("s").alias("s"), F.sort_array(F.collect_list("fp")).alias("m"))
    pairs = (members.select("s", "m", F.posexplode("m").alias("i", "u"))
             .select("s", "u", F.explode(F.expr("slice(m, i + 2, size(m))")).alias("v")))
    xor = F.col("u").bitwiseXOR(F.col("v"))
    near = pairs.where(_chain_passes(F.col("s"), xor) & (F.bit_count(xor) <= MAX_BITS)).select("u", "v")
    # hot buckets: the values within one bit, each linking its members to the smallest
    hot = rows.where(F.col("n") > bucket).select("fp").distinct()
    flips = F.array(*[F.col("fp").bitwiseXOR(F.lit(_signed(b))) for b in [0, *(1 << i for i in range(64))]])
    mids = hot.select("fp", F.explode(flips).alias("mid"))
    low = mids.groupBy("mid").agg(F.min("fp").alias("u"), F.count("*").alias("n")).where("n > 1")
    stars = mids.join(low, "mid").select("u", F.col("fp").alias("v")).where("u != v")
    stars = stars.where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= MAX_BITS)
    return near.union(stars).distinct()


def classify(documents: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """(doc_id, th, fp, root, component_id) per document row; root: the component's smallest fp."""
    sigs = staged(fingerprints(documents, id_col, text_col, size), "fingerprints")
    # one node per fingerprint; copies are counted map-side, whatever their number
    nodes = staged(sigs.groupBy("fp").agg(F.min("doc_id").alias("low")), "nodes")
    roots = connected_components(links(nodes.select("fp")))
    nodes = nodes.join(roots.select(F.col("u").alias("fp"), "root"), "fp", "left")
    nodes = nodes.select("fp", "low", F.coalesce("root", "fp").alias("root"))
    lows = nodes.groupBy("root").agg(F.min("low").alias("component_id"))
    classes = staged(nodes.join(lows, "root").select("fp", "root", "component_id"), "classes")
    return sigs.join(classes, "fp")


def near_duplicates(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    size: int = SHINGLE) -> DataFrame:
    """(doc_id, fingerprint, component_id) per document row.

    component_id is the smallest id among the documents reachable over links (null if none has
    an id).  Null, empty and wordless texts have fingerprint zero and link like any other.
    Repeated rows get equal rows each.
    """
    return classify(documents, id_col, text_col, size).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                         size: int = SHINGLE) -> DataFrame:
    """All columns of the documents; of each component one document stays, the one with the
    smallest id (null ids last), of rows with that id the one with the smallest text hash."""
    sigs = staged(classify(documents, id_col, text_col, size).select("doc_id", "th", "root"), "classified")
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("th"))
    kept = sigs.groupBy("root").agg(F.min(order).alias("o"), F.count("*").alias("n"))
    kept = kept.select(F.col("o.doc_id").alias("_k"), F.col("o.th").alias("_h"))
    repeated = sigs.groupBy("doc_id", "th").agg(F.count("*").alias("n")).where("n > 1").limit(1).count()
    flat, at = positional(documents)
    flat = flat.withColumn("_th", F.xxhash64(at[text_col]))
    out = flat.join(kept, F.col(at[id_col]).eqNullSafe(F.col("_k")) & (F.col("_th") == F.col("_h")), "left_semi")
    if repeated:  # of fully repeated rows one stays
        out = out.dropDuplicates([at[id_col], "_th"])
    return out.drop("_th").toDF(*documents.columns)
