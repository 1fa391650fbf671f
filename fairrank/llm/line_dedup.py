"""Line dedup by content-defined chunks of lines; DataFrame and SQL functions only.

Every line is hashed; a rolling polynomial hash covers each line and the line before it; a chunk
ends at a line whose rolling hash is a strict local minimum among its neighbours.  Cuts depend
on a few lines only, so past an insertion or deletion the same cuts come back, and inner chunks
have two lines at least.  Multi-line chunks whose text occurs elsewhere (in any document, or
earlier in the same one) are removed, all but the first occurrence by (document id, null last;
text hash; position), after their bytes were compared with the first occurrence's.

Data flow: chunk signatures without texts are grouped globally (pre-aggregated, so a chunk held
by a third of the documents is one row per task); only chunks that repeat meet the text of
their first occurrence; each document then gets its own list of removals.  Documents are
shuffled once, never gathered; a skewed side of any join can be split by AQE.

Defined results: null text stays null, empty text stays empty; rows equal in id and text are
one document (each gets the same result, nothing is removed only because the row repeats);
blank chunks, single lines and documents of one line are left alone; a text of which every
chunk is removed becomes empty and its row stays; an empty table gives an empty table; other
columns pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fairrank.llm.common import positional, staged

#: Base and modulus of the rolling hash: products stay below 2^63.
BASE = 1_000_003
MODULUS = 2_147_483_647
MIN_LINES = 2
#: Occurrences of one chunk that may meet its text in one place.
HOT_ROWS = 50_000

# transform(array(value), name -> ...)[0] binds a value that is used many times
_CHUNKS = r"""
transform(array(split({text}, '\n', -1)), lines ->
transform(array(transform(lines, x -> cast(conv(substr(md5(cast(x as binary)), 1, 7), 16, 10) as bigint))), h ->
transform(array(transform(h, (x, i) -> (x + if(i >= 1, get(h, i - 1) * {base}, 0)) % {modulus})), r ->
transform(array(filter(sequence(0, size(r) - 1), i ->
    i = 0 or (i >= 2 and get(r, i - 1) < get(r, i - 2) and get(r, i - 1) < get(r, i)))), s ->
transform(s, (a, k) -> named_struct(
    'n', coalesce(get(s, k + 1), size(lines)) - a,
    's', array_join(slice(lines, a + 1, coalesce(get(s, k + 1), size(lines)) - a), '\n')))
)[0])[0])[0])[0]
"""


def chunks_sql(text: str) -> str:
    """SQL for array<struct<n int, s string>>: the chunks of column ``text`` in order, with their
    numbers of lines; joined by line feeds they give the text back."""
    return _CHUNKS.format(text=text, base=BASE, modulus=MODULUS)


def _same_document(id_a: str, th_a: str, id_b: str, th_b: str) -> Column:
    return F.col(id_a).eqNullSafe(F.col(id_b)) & (F.col(th_a) == F.col(th_b))


def dedup_lines(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents' columns with repeated multi-line chunks removed from the text, and at the
    end lines_removed and chunks_removed (int)."""
    flat, at = positional(documents)
    id_at, text = at[id_col], at[text_col]
    flat = flat.withColumn("_th", F.xxhash64(text))
    own = flat.where(F.col(text).isNotNull()).select(F.col(id_at).alias("_id"), "_th", F.col(text).alias("_t"))

    chunks = own.select("_id", "_th", F.posexplode(F.expr(chunks_sql("_t"))).alias("_pos", "_x"))
    chunks = chunks.where((F.col("_x.n") >= MIN_LINES) & F.col("_x.s").rlike(r"[^\x20\x09-\x0D]"))
    sig = staged(chunks.select("_id", "_th", "_pos", F.xxhash64("_x.s").alias("_h"), F.hash("_x.s").alias("_h2")),
                 "chunk-signatures")
    place = F.struct(F.col("_id").isNull().alias("z"), F.col("_id").alias("id"), F.col("_th").alias("th"),
                     F.col("_pos").alias("pos"))
    firsts = (sig.groupBy("_h", "_h2").agg(F.min(place).alias("a"), F.max(place).alias("b"), F.count("*").alias("n"))
              .where("a != b").select("_h", "_h2", F.col("a.id").alias("_fid"), F.col("a.th").alias("_fth"),
                                      F.col("a.pos").alias("_fpos"), F.ceil(F.col("n") / HOT_ROWS).cast("int").alias("_salts")))
    firsts = staged(firsts, "first-places")
    is_first = _same_document("_id", "_th", "_fid", "_fth") & (F.col("_pos") == F.col("_fpos"))
    # all other occurrences; those of a hot chunk are spread over salts
    later = staged(sig.join(firsts, ["_h", "_h2"]).where(~is_first).select(
        "_id", "_th", "_pos", "_h", "_h2", F.pmod(F.hash("_id", "_th", "_pos"), "_salts").alias("_salt")), "later-places")

    # the text of each first occurrence: a document's list is bounded by its own chunks.  Both
    # joins with documents read all columns (_all), so that Spark shuffles documents once and
    # reuses that exchange
    wanted = firsts.groupBy("_fid", "_fth").agg(F.collect_list(F.struct("_h", "_h2", "_fpos", "_salts")).alias("_w"))
    found = flat.join(wanted, _same_document(id_at, "_th", "_fid", "_fth")).select(
        F.xxhash64(*flat.columns).alias("_all"), F.explode(F.expr(
            f"transform(array({chunks_sql(text)}), c -> transform(_w, w -> named_struct("
            "'h', w._h, 'h2', w._h2, 'n', w._salts, 's', get(c, w._fpos).s)))[0]")).alias("_f"))
    texts = found.groupBy(F.col("_f.h").alias("_h"), F.col("_f.h2").alias("_h2")).agg(
        F.first("_f.s").alias("_s"), F.first("_f.n").alias("_n"), F.max("_all").alias("_all")).where("_all is not null")
    texts = texts.select("_h", "_h2", "_s", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("_salt"))

    # every other occurrence gets the bytes it must equal
    drops = later.join(texts, ["_h", "_h2", "_salt"]).groupBy(F.col("_id").alias("_did"), F.col("_th").alias("_dth")).agg(
        F.map_from_entries(F.collect_set(F.struct("_pos", "_s"))).alias("_drop"))

    joined = flat.join(drops, _same_document(id_at, "_th", "_did", "_dth"), "left")
    done = joined.withColumn("_r", F.expr(f"""
        if(_drop is null, null, transform(array({chunks_sql(text)}), c ->
        transform(array(filter(c, (x, i) -> not coalesce(_drop[i] = x.s, false))), k -> named_struct(
            's', array_join(transform(k, x -> x.s), '\\n'),
            'lines', aggregate(c, 0, (n, x) -> n + x.n) - aggregate(k, 0, (n, x) -> n + x.n),
            'chunks', size(c) - size(k)))[0])[0])"""))
    cols = [F.coalesce("_r.s", text) if c == text else F.col(c) for c in flat.columns if c != "_th"]
    return done.select(*cols, F.coalesce("_r.lines", F.lit(0)), F.coalesce("_r.chunks", F.lit(0))).toDF(
        *documents.columns, "lines_removed", "chunks_removed")
