"""Quality classifier: a generalised additive model with pairwise interactions on text features.

The model (see ``gam``) is fitted on a sample of labelled documents, bounded by
``MAX_TRAINING_ROWS`` and chosen by hash, whose id has crc32 mod 4 other than 2; the rest is held
out.  Only the text is an input: labels, language, source and id are not.  Every document is
then scored in one pass: features, bins, sums of table entries.  No shuffle of texts; what is
broadcast or shipped (the sampled labels, the model's tables) has a fixed bound.

Defined results: null, empty and wordless texts are scored by their features (all zero); labels
that are null count as missing; a document with several labels enters once with each; without
any label the score is 0.5; an empty table gives an empty table.
"""

from __future__ import annotations

from collections import Counter
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairrank.llm.common import pick, small_batches
from fairrank.llm.gam import GAM

MAX_TRAINING_ROWS = 20_000
KEEP_AT = 0.7
FOLDS, HELD_OUT = 4, 2
FEATURES = ("log_words", "log_chars", "word_length", "upper", "symbols", "marks", "pipes", "digits", "distinct",
            "top_word", "repeats", "shouted", "lines_per_word", "distinct_lines", "stops", "commas", "short_words",
            "long_words", "odd_words", "symbol_words")
_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_DIGITS = b"0123456789"
_SYMBOLS = b"#$%&*+/<=>@[\\]^_`{}~"


def features(text: str | None) -> list[float]:
    """Shape, repetition and mark-up of one text; all zero without words."""
    words = text.split() if text else []
    if not words:
        return [0.0] * len(FEATURES)
    raw = text.encode("utf-8", "replace")
    size, n = len(raw), len(words)

    def share(chars: bytes) -> float:
        return (size - len(raw.translate(None, chars))) / size

    upper, lower = share(_UPPER), share(_LOWER)
    counts = Counter(words)
    lines = [x for x in text.split("\n") if x]
    lengths = [len(w) for w in words]
    marks = sum(c for w, c in counts.items() if not w[0].isalpha() and not w[0].isdigit())
    tails = sum(c for w, c in counts.items() if len(w) > 2 and not w[-2].isalnum() and not w[-1].isalnum())
    return [float(np.log1p(n)), float(np.log1p(size)), sum(lengths) / n, upper / (upper + lower + 1e-9), share(_SYMBOLS),
            share(b"!?"), share(b"|"), share(_DIGITS), len(counts) / n, counts.most_common(1)[0][1] / n,
            sum(map(eq, words, words[1:])) / n, sum(c for w, c in counts.items() if len(w) > 1 and w.isupper()) / n,
            len(lines) / n, len(set(lines)) / max(1, len(lines)), share(b".") * size / n, share(b",;:") * size / n,
            sum(x <= 2 for x in lengths) / n, sum(x >= 12 for x in lengths) / n, marks / n, tails / n]


def _held_out(id_col: str):
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS)) == HELD_OUT


def fit(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "quality", max_rows: int = MAX_TRAINING_ROWS) -> GAM:
    """The model, from at most ``max_rows`` labelled documents outside the held-out fold."""
    small_batches(documents.sparkSession)
    y = pick(labels, [id_col, label_col]).toDF("doc_id", "y").where("doc_id is not null and y in (0, 1)").distinct()
    y = y.where(~_held_out("doc_id")).orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(max_rows)
    docs = pick(documents, [id_col, text_col]).toDF("doc_id", "text")

    def run(batches):
        for b in batches:
            x = [features(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), b.column(0), b.column(2)], ["x", "y", "h"])

    # at most max_rows small rows are broadcast
    chosen = docs.join(F.broadcast(y), "doc_id").select(F.col("y").cast("int").alias("y"), "text", F.xxhash64("doc_id", "text", "y").alias("h"))
    rows = chosen.mapInArrow(run, "x array<double>, y int, h bigint")
    rows = rows.orderBy("h", "y", "x").limit(max_rows).collect()  # by hash, where ids repeat in the documents
    rows.sort(key=lambda r: (r[1], r[0]))  # sums in one order: reruns give the same model
    return GAM().fit(np.array([r[0] for r in rows], float).reshape(len(rows), len(FEATURES)),
                     np.array([r[1] for r in rows], float))


def score_documents(documents: DataFrame, model: GAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) per document."""
    small_batches(documents.sparkSession)
    docs = pick(documents, [id_col, text_col]).toDF("doc_id", "text").select("doc_id", _held_out("doc_id"), "text")
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            s = model.score(np.array([features(t) for t in b.column(2).to_pylist()], float).reshape(-1, len(FEATURES)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s), pa.array((s >= KEEP_AT).astype(np.int32))],
                                             ["doc_id", "held_out", "score", "predicted"])

    return docs.mapInArrow(run, f"doc_id {id_type}, held_out boolean, score double, predicted int")


def keep_good(documents: DataFrame, model: GAM, text_col: str = "text") -> DataFrame:
    """The documents that the classifier accepts: all columns, one pass, no shuffle."""
    small_batches(documents.sparkSession)
    at = documents.columns.index(text_col)

    def run(batches):
        for b in batches:
            x = np.array([features(t) for t in b.column(at).to_pylist()], float).reshape(-1, len(FEATURES))
            yield b.filter(pa.array(model.score(x) >= KEEP_AT))

    flat = documents.toDF(*[f"_c{i}" for i in range(len(documents.columns))])
    return flat.mapInArrow(run, flat.schema).toDF(*documents.columns)
