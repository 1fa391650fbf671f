"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

A window is 13 consecutive words of a benchmark item (an item of fewer words is one window).
Per window length there is one table: a block shift table says how far a search position may
jump when the last two words under it end no window part, a bucket per suffix block holds the
windows to test, and a direct comparison of all words confirms an occurrence.  Text that shares
nothing with the benchmark is read at one lookup per twelve words.

Windows are made distinct on Spark.  If there are at most ``block_windows`` (item, window) pairs, one
broadcast holds them and documents are read once, without a shuffle.  Above that, distinct windows
are numbered, and blocks of ``block_windows`` of them are collected and broadcast one after the
other, one pass over the documents each; a pass writes what it finds per text, and its broadcast
goes before the next one comes.  Items are joined to the sets of windows that texts hold, each set
once; a window of many items is one window in its block.

Defined results: null or wordless text has no words (0, 0, 0, the hash of nothing, False); null,
wordless and repeated items: wordless items match nothing, equal item ids count once, an item
without id is never listed but its windows still hit; repeated documents each get their row.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fairrank.llm.common import pick, small_batches, staged

WINDOW = 13
BLOCK_WINDOWS = 200_000
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

OUT = "doc_id {id}, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean"


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.translate(LOWER)) if text else []


def item_windows(words: list[str], window: int = WINDOW) -> list[tuple[str, ...]]:
    if not words:
        return []
    if len(words) <= window:
        return [tuple(words)]
    return [tuple(words[i:i + window]) for i in range(len(words) - window + 1)]


class WuManber:
    """Shift table and suffix buckets for windows of one length."""

    def __init__(self, windows: dict[tuple[str, ...], list], length: int):
        self.m, self.b = length, min(2, length)
        self.far = self.m - self.b + 1
        self.shift: dict = {}
        self.bucket: dict = {}
        for w, ids in windows.items():
            for j in range(self.b, self.m + 1):
                block, jump = w[j - self.b:j], self.m - j
                if jump < self.shift.get(block, self.far):
                    self.shift[block] = jump
            # within a suffix bucket windows are told apart by their first block
            self.bucket.setdefault(w[-self.b:], {}).setdefault(w[:self.b], []).append((w, ids))

    def search(self, words: list[str]) -> Iterator[tuple[int, list]]:
        """(start, item ids) of every occurrence, by ascending start."""
        m, b, far, shift, bucket = self.m, self.b, self.far, self.shift, self.bucket
        end, n = m, len(words)
        while end <= n:
            block = tuple(words[end - b:end])
            jump = shift.get(block, far)
            if jump:
                end += jump
                continue
            start = end - m
            for w, ids in bucket.get(block, {}).get(tuple(words[start:start + b]), ()):
                if tuple(words[start:end]) == w:
                    yield start, ids
            end += 1


def build_tables(items: list[tuple]) -> list[WuManber]:
    """Tables from (item id, window words) rows."""
    by_length: dict[int, dict] = {}
    for item_id, w in items:
        ids = by_length.setdefault(len(w), {}).setdefault(tuple(w), [])
        if item_id not in ids:
            ids.append(item_id)
    return [WuManber(ws, n) for n, ws in sorted(by_length.items())]


def scan(words: list[str], tables: list[WuManber]) -> tuple[list[tuple[int, int]], set]:
    """(start, end) of every occurrence, ids of the items that occur."""
    spans, found = [], set()
    for t in tables:
        for start, ids in t.search(words):
            spans.append((start, start + t.m))
            found.update(ids)
    return spans, found


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The same words as disjoint spans, ascending."""
    out: list[tuple[int, int]] = []
    for a, z in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(z, out[-1][1]))
        else:
            out.append((a, z))
    return out


def covered(spans: list[tuple[int, int]]) -> int:
    """Words inside any span."""
    return sum(z - a for a, z in merged(spans))


def is_contaminated(n_hit: int, n_words: int) -> bool:
    return n_hit > 0 and 20 * n_hit >= n_words


def _windows(benchmark: DataFrame, window: int) -> DataFrame:
    """The benchmark's distinct (item, w); the item's id as a string."""
    def cut(batches):
        for batch in batches:
            ids, ws = [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for w in item_windows(words_of(text), window):
                    ids.append(None if i is None else str(i))
                    ws.append(list(w))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(ws, pa.list_(pa.string()))],
                                             ["item", "w"])

    small_batches(benchmark.sparkSession)
    items = pick(benchmark, ["item_id", "text"])
    return staged(items.mapInArrow(cut, "item string, w array<string>").distinct(), "windows")


def _numbered(windows: DataFrame) -> DataFrame:
    """(wid, w) of the distinct windows, numbered from 0 without gaps."""
    rows = staged(windows.select("w").distinct().withColumn("row", F.monotonically_increasing_id()), "distinct-windows")
    # the row number is the task's in the upper bits, the row's within the task in the lower 33
    rows = rows.withColumn("task", F.shiftright("row", 33))
    before = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    first = rows.groupBy("task").agg(F.count("*").alias("n")).select(
        "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    wid = F.col("first") + F.col("row").bitwiseAND(F.lit((1 << 33) - 1))
    return staged(rows.join(first, "task").select(wid.alias("wid"), "w"), "numbered-windows")


def _found_in_blocks(text: DataFrame, windows: DataFrame, block_windows: int) -> DataFrame:
    """(k, n_words, n_hit, wids) per distinct text that holds a window; k is the text's SHA-256.
    One pass over ``text`` (k, text) per block of windows (wid, w)."""
    spark = text.sparkSession
    n, found = windows.count(), None
    for low in range(0, n, block_windows):
        rows = windows.where((F.col("wid") >= low) & (F.col("wid") < low + block_windows)).collect()
        block = spark.sparkContext.broadcast([(r[0], r[1]) for r in rows])

        def run(batches, block=block):
            tables = build_tables(block.value)
            for batch in batches:
                at, n_words, starts, ends, wids = [], [], [], [], []
                for i, x in enumerate(batch.column(1).to_pylist()):
                    words = words_of(x)
                    spans, ids = scan(words, tables)
                    if ids:
                        at.append(i)
                        n_words.append(len(words))
                        spans = merged(spans)
                        starts.append([a for a, _ in spans])
                        ends.append([z for _, z in spans])
                        wids.append(sorted(ids))
                longs = pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(at, pa.int64())), pa.array(n_words, pa.int64()),
                     pa.array(starts, longs), pa.array(ends, longs), pa.array(wids, longs)],
                    ["k", "n_words", "starts", "ends", "wids"])

        # equal texts give equal rows
        part = staged(text.mapInArrow(run, "k string, n_words bigint, starts array<bigint>, ends array<bigint>, "
                                           "wids array<bigint>").distinct(), f"found-{low}")
        block.destroy()
        found = part if found is None else found.union(part)

    def count(batches):
        for batch in batches:
            hit = [covered(list(zip(a, z))) for a, z in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(hit, pa.int64()), batch.column(4)],
                                             ["k", "n_words", "n_hit", "wids"])

    per_text = found.groupBy("k").agg(F.first("n_words").alias("n_words"), *[
        F.flatten(F.collect_list(c)).alias(c) for c in ("starts", "ends", "wids")])
    per_text = per_text.withColumn("wids", F.array_sort("wids"))
    return staged(per_text.mapInArrow(count, "k string, n_words bigint, n_hit bigint, wids array<bigint>"), "found")


def _hits_in_blocks(docs: DataFrame, pairs: DataFrame, block_windows: int) -> DataFrame:
    """``hits`` of documents (doc_id, text) for a benchmark of any size."""
    windows = _numbered(pairs)
    keyed = docs.withColumn("k", F.sha2("text", 256))
    found = _found_in_blocks(keyed.select("k", "text"), windows, block_windows)
    found = found.withColumn("s", F.sha2(F.array_join(F.col("wids").cast("array<string>"), ","), 256))
    sets = found.select("s", "wids").distinct().select("s", F.explode("wids").alias("wid"))
    items = pairs.where("item is not null").join(windows, "w").select("wid", "item")
    # an item takes part in a set once, however many of its windows do
    names = staged(sets.join(items, "wid").select("s", "item").distinct().groupBy("s").agg(
        F.count("*").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(F.collect_list("item")), ","), 256).alias("items_sha256")), "item-sets")

    def count(batches):
        for batch in batches:
            n = [len(words_of(x)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64())],
                                             ["doc_id", "k", "n_words"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    every = keyed.mapInArrow(count, f"doc_id {id_type}, k string, n_words bigint")
    out = every.join(found.select("k", "n_hit", "s"), "k", "left").join(names, "s", "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("bigint"))
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0).cast("bigint")).alias("n_items"),
                      F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"),
                      ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"))


def hits(documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
         window: int = WINDOW, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """One row per document: its words, the words inside benchmark windows, the items found."""
    spark = documents.sparkSession
    docs = pick(documents, [id_col, text_col]).toDF("doc_id", "text")
    id_type = docs.schema["doc_id"].dataType.simpleString()
    pairs = _windows(benchmark, window)
    if pairs.count() > block_windows:
        return _hits_in_blocks(docs, pairs, block_windows)
    block = spark.sparkContext.broadcast([(r[0], r[1]) for r in pairs.collect()])

    def run(batches):
        tables = build_tables(block.value)
        for batch in batches:
            words = [words_of(x) for x in batch.column(1).to_pylist()]
            spans, found = zip(*[scan(w, tables) for w in words]) if words else ((), ())
            n_hit = [covered(s) for s in spans]
            names = [sorted(x for x in f if x is not None) for f in found]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([len(w) for w in words], pa.int64()), pa.array(n_hit, pa.int64()),
                pa.array([len(x) for x in names], pa.int64()),
                pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in names], pa.string()),
                pa.array([is_contaminated(h, len(w)) for h, w in zip(n_hit, words)], pa.bool_())],
                ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

    return docs.mapInArrow(run, OUT.format(id=id_type))


def drop_contaminated(documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id",
                      text_col: str = "text", block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """The documents that the rule leaves: all columns, texts unchanged; items do not matter here."""
    spark = documents.sparkSession
    windows = _windows(benchmark, WINDOW).select("w").distinct()
    # by position, so that repeated or clashing names survive
    flat = documents.toDF(*[f"_c{i}" for i in range(len(documents.columns))])
    at = documents.columns.index(text_col)
    if windows.count() > block_windows:
        key = F.sha2(f"_c{at}", 256)
        found = _found_in_blocks(flat.select(key.alias("k"), F.col(f"_c{at}").alias("text")), _numbered(windows), block_windows)
        bad = found.where("n_hit > 0 and 20 * n_hit >= n_words").select(F.col("k").alias("_bad"))
        return flat.join(bad, key == F.col("_bad"), "left_anti").toDF(*documents.columns)
    block = spark.sparkContext.broadcast([(0, r[0]) for r in windows.collect()])
    small_batches(spark)

    def run(batches):
        tables = build_tables(block.value)
        for batch in batches:
            words = [words_of(x) for x in batch.column(at).to_pylist()]
            keep = [not is_contaminated(covered(scan(w, tables)[0]), len(w)) for w in words]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return flat.mapInArrow(run, flat.schema).toDF(*documents.columns)
