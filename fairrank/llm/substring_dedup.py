"""Substring dedup by sliding sentence spans.

A text is cut into sentences (at ``.``, ``!`` or ``?`` before white space, and at line feeds), and
sentences into pieces where their content says so: after a word whose hash, taken with the word
before it, is the least within ``REACH`` words of the sentence on both sides.  Such cuts move with
the words, so a passage that stands at any place of a long sentence, or behind an unfinished one,
has the same pieces but for those at its edges.  A piece of more than ``MAX_WORDS`` words (periodic
text has no least hashes) is cut at every ``MAX_WORDS``-th.

A run is ``SPAN`` consecutive pieces, or as many more as it takes to have ``MIN_WORDS`` words.  Every
run is hashed (96 bits of XXH3 over its words: chance equality of two among 10^10 is below 10^-8).  Runs are joined globally by hash; every piece
covered by an occurrence other than the first, by (document id, null last; text hash; position),
is removed.

Counts of a hash are pre-aggregated map-side, so a run shared by a third of the documents is one
row per task; a document's own list of positions is the only thing gathered.

Defined results: null text stays null, empty text stays empty; a text of fewer than ``SPAN``
pieces, but at least two, is one run if it has ``MIN_WORDS`` words; rows equal in id and text are
one document (each gets the same result); white space after a removed piece goes with it; an empty
table gives an empty table; other columns pass through, whatever their names.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from fairrank.llm.common import positional, small_batches, staged

SPAN = 3
REACH = 3
MAX_WORDS = 24
MIN_WORDS = 16
_TOKEN = re.compile(r"[ \t-\r]*[^ \t-\r]+[ \t-\r]*")
_ENDS = tuple(e.encode() for c in ".!?" for e in (c, *(c + q for q in "\"')]»”")))
#: Words whose hash a worker remembers.
_REMEMBERED = 1 << 19


class Cutter:
    """Cuts texts into pieces; remembers the hashes of words (and whether they end a sentence)."""

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def _look_up(self, words: list[bytes]) -> np.ndarray:
        """Twice the hash of each word, odd if it ends a sentence."""
        marks = list(map(self.known.get, words))
        if None in marks:
            if len(self.known) >= _REMEMBERED:
                self.known.clear()
            for i, (w, m) in enumerate(zip(words, marks)):
                if m is None:
                    m = self.known[w] = 2 * int(hashlib.md5(w).hexdigest()[:7], 16) + w.endswith(_ENDS)
                    marks[i] = m
        return np.array(marks, np.int64)

    def cut(self, text: str) -> tuple[list[bytes], np.ndarray]:
        """The words of a text, and after how many words each piece ends."""
        words, line_ends = [], []
        for line in text.encode().split(b"\n"):
            words += line.split()  # bytes are split at ASCII white space
            line_ends.append(len(words))
        n = len(words)
        if not n:
            return words, np.zeros(0, np.int64)
        marks = self._look_up(words)
        last = (marks & 1).astype(bool)
        ends = np.array(line_ends)
        last[ends[ends > 0] - 1] = True
        # a word with the one before it in its sentence; none at the first word
        first = np.concatenate(([True], last[:-1]))
        h = marks >> 1
        h[1:] = (h[1:] + h[:-1] * 1000003) % 2147483647
        sentence = np.cumsum(first)
        low = ~first
        for d in range(1, min(REACH, n - 1) + 1):
            same = sentence[d:] == sentence[:-d]
            low[d:] &= ~(same & ~first[:-d]) | (h[d:] < h[:-d])
            low[:-d] &= ~same | (h[:-d] <= h[d:])
        stops = np.flatnonzero(low | last) + 1
        if (np.diff(stops, prepend=0) > MAX_WORDS).any():
            starts = [0, *stops[:-1].tolist()]
            stops = np.array([x for a, b in zip(starts, stops.tolist()) for x in (*range(a + MAX_WORDS, b, MAX_WORDS), b)])
        return words, stops

    def pieces(self, text: str) -> list[tuple[str, int]]:
        """(raw text with its white space, words); the raw texts join to the whole text, unless it
        has no words."""
        tokens, stops = _TOKEN.findall(text), self.cut(text)[1].tolist()
        return [("".join(tokens[a:b]), b - a) for a, b in zip([0, *stops], stops)]


def run_ends(stops: np.ndarray) -> np.ndarray:
    """For the run that begins at each piece, the piece after its last; short of those that don't fit."""
    n = len(stops)
    if n < 2:
        return np.zeros(0, np.int64)
    starts = np.concatenate(([0], stops[:-1]))
    ends = np.maximum(np.searchsorted(stops, starts + MIN_WORDS) + 1, np.arange(n) + min(SPAN, n))
    return ends[ends <= n]


def runs(words: list[bytes], stops: np.ndarray) -> list[bytes]:
    """128-bit hashes of the runs that begin at the first piece, the second and so on."""
    ends = run_ends(stops)
    if not len(ends):
        return []
    whole = b" ".join(words)
    after = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    at = np.concatenate(([0], after[stops - 1]))  # where pieces begin
    return [xxhash.xxh3_128_digest(whole[a:b]) for a, b in zip(at[:len(ends)].tolist(), (at[ends] - 1).tolist())]


def dedup_substrings(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents' columns with repeated passages removed from the text, and at the end
    pieces_removed and words_removed (bigint)."""
    small_batches(documents.sparkSession)
    flat, at = positional(documents)
    # what tells documents of one id apart; a constant, which takes no room, where ids alone do
    ids = flat.groupBy(at[id_col]).agg(F.count("*").alias("n")).where((F.col("n") > 1) | F.col(at[id_col]).isNull())
    th = F.lit(0).cast("bigint") if ids.isEmpty() else F.xxhash64(at[text_col])
    flat = flat.withColumn("_th", th)
    id_type = flat.schema[at[id_col]].dataType.simpleString()

    def emit(batches):
        cutter = Cutter()
        for b in batches:
            counts, digests = [], []
            for text in b.column(2).to_pylist():
                mine = runs(*cutter.cut(text)) if text else []
                counts.append(len(mine))
                digests += mine
            h = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            h2 = (h[:, 1] & 0xFFFFFFFF).astype(np.uint32).view(np.int32)
            rows = pa.array(np.repeat(np.arange(len(counts)), counts))
            starts = np.concatenate([np.zeros(0, np.int32), *[np.arange(c, dtype=np.int32) for c in counts]])
            yield pa.RecordBatch.from_arrays([
                b.column(0).take(rows), b.column(1).take(rows), pa.array(starts, pa.int32()),
                pa.array(np.ascontiguousarray(h[:, 0])), pa.array(h2)],
                ["_id", "_th", "_pos", "_h", "_h2"])

    spans = flat.select(at[id_col], "_th", at[text_col]).mapInArrow(
        emit, f"_id {id_type}, _th bigint, _pos int, _h bigint, _h2 int")
    spans = staged(spans, "spans")
    # first the hashes that repeat at all, a few bytes a run, then only their occurrences
    # (a written table next to a join lets Spark split a hot hash; an aggregate there does not)
    shared = staged(spans.groupBy("_h").agg(F.count("*").alias("n")).where("n > 1").select("_h"), "shared")
    spans = staged(spans.join(shared, "_h", "left_semi"), "shared-spans")
    place = F.struct(F.col("_id").isNull().alias("z"), F.col("_id").alias("id"), F.col("_th").alias("th"),
                     F.col("_pos").alias("pos"))
    firsts = spans.groupBy("_h", "_h2").agg(F.min(place).alias("a"), F.max(place).alias("b")).where("a != b")
    firsts = staged(firsts.select("_h", "_h2", "a"), "firsts")
    later = spans.join(firsts, ["_h", "_h2"]).where(place != F.col("a"))
    drops = later.groupBy(F.col("_id").alias("_did"), F.col("_th").alias("_dth")).agg(
        F.collect_set("_pos").alias("_drop"))

    joined = flat.join(drops, F.col(at[id_col]).eqNullSafe(F.col("_did")) & (F.col("_th") == F.col("_dth")), "left")
    joined = joined.drop("_did", "_dth", "_th")
    text_at = joined.columns.index(at[text_col])
    schema = flat.drop("_th").schema

    def cut(batches):
        cutter = Cutter()
        for b in batches:
            texts, n_pieces, n_words = [], [], []
            for text, starts in zip(b.column(text_at).to_pylist(), b.column(b.num_columns - 1).to_pylist()):
                gone_words, covered = 0, set()
                if starts:
                    units = cutter.pieces(text)
                    ends = run_ends(np.cumsum([u[1] for u in units])).tolist()
                    covered = {p for s in starts for p in range(s, ends[s])}
                    gone_words = sum(units[p][1] for p in covered)
                    text = "".join(u[0] for p, u in enumerate(units) if p not in covered)
                texts.append(text)
                n_pieces.append(len(covered))
                n_words.append(gone_words)
            cols = [pa.array(texts, b.schema.field(i).type) if i == text_at else b.column(i)
                    for i in range(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(n_pieces, pa.int64()), pa.array(n_words, pa.int64())],
                                             [*schema.names, "_p", "_w"])

    out = StructType([*schema.fields, StructField("_p", LongType()), StructField("_w", LongType())])
    return joined.mapInArrow(cut, out).toDF(*documents.columns, "pieces_removed", "words_removed")
