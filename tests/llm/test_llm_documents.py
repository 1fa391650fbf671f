"""Document operators on a small fixture with every odd case, against DuckDB SQL or brute force."""

import math
import os

import duckdb
import numpy as np
import pytest
import xxhash
from oracle_compare import TABLES, compare
from pyspark.sql import functions as F

from fairrank.llm import decontaminate, line_dedup, mixing, quality, queries, simhash, substring_dedup
from fairrank.llm.oracle import ORACLE

SF = "/root/testdata/sf0.001"
LONG = "\n".join(f"line {i} of a long text with words number {i * 7} and {i * 13}." for i in range(2500))
PASSAGE = "\n".join(f"Shared passage sentence {i} has these words in it {'abc' * (i + 1)}." for i in range(9))
BENCH = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
ROWS = [
    (0, "Alpha beta.\n" + PASSAGE + "\nThe end here.", "en", "b", 1), (1, "Other start of it.\nMore.\n" + PASSAGE, "en", "b", 1),
    (2, None, None, None, None), (3, "", "en", "a", 0), (4, " \n\t\n ", "en", "a", 5), (None, "No id " + PASSAGE, "en", None, 3),
    (5, LONG, "en", "a", 1), (6, LONG, "en", "a", 1), (7, LONG + "\nextra tail.", "en", "c", 1), (8, "word", "en", "zero", 4),
    (9, "x y\nx y\nx y\nx y\nx y", "en", "c", 1), (9, "x y\nx y\nx y\nx y\nx y", "en", "c", 1), (9, "other text of the same id", "en", "c", 1),
    (10, "pre " + BENCH.upper() + " post", "en", "b", 1), (11, "Short Item! again; short-item", "en", "b", 1), (12, "é" * 50 + " ünïcode wörds", "de", "é", 1),
    (13, "only one two three four five six seven eight nine ten eleven twelve", "en", "b", 1), (14, "tie words here now", "en", "c", 1),
    (15, "tie words here now", "en", "c", 1), (16, "Sentence one is here now. Sentence two follows it! Third one?", "en", "c", 1),
]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
ITEMS = [(1, BENCH), (2, "short item"), (3, None), (4, "!!!"), (2, "short item"), (10, BENCH)]
CLASH = ["TEXT", "_th", "score", "_id", "size", "copies", "component_id", "Doc_Id"]


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    top = str(tmp_path_factory.mktemp("docs"))
    spark.createDataFrame(ROWS, SCHEMA).coalesce(1).write.parquet(f"{top}/s/documents")
    spark.createDataFrame(ITEMS, "item_id bigint, text string").coalesce(1).write.parquet(f"{top}/s/benchmark")
    for t in ("documents", "benchmark"):
        part = next(f for f in os.listdir(f"{top}/s/{t}") if f.endswith(".parquet"))
        os.link(f"{top}/s/{t}/{part}", f"{top}/{t}.parquet")
    return top


def clashing(df):
    """The same rows with more columns, some of whose names clash but for their case."""
    return df.select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASH)])


@pytest.mark.parametrize("name", ["op2_substring_dedup", "op4_source_mixing", "op8_line_dedup", "op10_decontamination"])
def test_odd_rows_match_sql(spark, small, name):
    ok, msg = compare(queries.queries()[name](spark, small), ORACLE[name], small)
    assert ok, msg


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")
@pytest.mark.parametrize("name", sorted(ORACLE))
def test_driver_tables_match_sql(spark, name):
    ok, msg = compare(queries.queries()[name](spark, SF), ORACLE[name], SF)
    assert ok, msg


def test_substring_sql_in_bounded_memory(small):
    con = duckdb.connect(config={"memory_limit": "2GB", "temp_directory": ""})
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{small}/documents.parquet')")
    assert len(con.execute(ORACLE["op2_substring_dedup"]).fetchall()) == len(ROWS)


def test_pieces_move_with_the_words():
    r = np.random.default_rng(8)
    vocab = [f"w{i}" for i in range(5000)]
    cutter = substring_dedup.Cutter()
    for size in (60, 200):
        passage = [str(x) for x in r.choice(vocab, size)]
        want = [p[0].strip() for p in cutter.pieces(" ".join(passage))][1:-1]  # pieces at the edges depend on what is around
        for before in range(0, 30):
            text = " ".join([*map(str, r.choice(vocab, before)), *passage, *map(str, r.choice(vocab, 9))])
            got = [p[0].strip() for p in cutter.pieces(text)]
            inner = [p for p in want[1:-1]]
            at = got.index(inner[0])
            assert got[at:at + len(inner)] == inner
    assert [p[1] for p in cutter.pieces("a " * 100)] == [2, 24, 24, 24, 24, 2]
    for text in ("", " \n", "\n\na b\n\nc. d", "x", "One. Two! (Three?) four\tfive \x0b"):
        assert "".join(p[0] for p in cutter.pieces(text)) == (text if text.strip() else "")


def planted(r, kind):
    """(passage of 60 words, what stands before it and after it)"""
    words = [f"v{i}" for i in r.integers(0, 4000, 60)]
    if kind == "lines":
        return "".join(f"{a} {b}\n" for a, b in zip(words[::2], words[1::2])), ""
    if kind == "sentences":
        return "".join(" ".join(words[i:i + 10]) + ". " for i in range(0, 60, 10)), "unfinished start of it "
    return " ".join(words) + " ", ""


@pytest.mark.parametrize("kind", ["middle", "sentences", "lines"])
def test_planted_passages_go_at_every_offset(spark, kind):
    r = np.random.default_rng(len(kind))
    docs, want = [], {}
    for k in range(10):
        passage, lead = planted(r, kind)
        mine = [f"v{i}" for i in r.integers(5000, 9000, 80)]
        docs.append((1000 + k, " ".join(mine[:40]) + ("\n" if kind != "middle" else " ") + passage + " ".join(mine[40:])))
        other = [f"v{i}" for i in r.integers(9000, 13000, 60 + k)]
        cut = " ".join(other[:20 + k]) + (" " if kind == "middle" else "\n" if kind == "lines" else ". ") + lead
        docs.append((2000 + k, cut + passage + " ".join(other[20 + k:])))
        want[2000 + k] = (passage.split(), other)
    got = {x.doc_id: x for x in substring_dedup.dedup_substrings(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    for k in range(10):
        assert got[1000 + k].pieces_removed == 0
        passage, other = want[2000 + k]
        left = got[2000 + k].text.split()
        # all inner words go; pieces at the edges may hold words of both
        edge = {"middle": 14, "sentences": 10, "lines": 0}[kind]
        assert not set(passage[edge:60 - edge]) & (set(left) - set(passage[:edge]) - set(passage[60 - edge:]))
        assert set(other) - {w for w in other if w not in left} == {w for w in other if w in left} and sum(w in left for w in other) >= len(other) - 16


def test_every_oracle_reads_known_tables():
    assert set(ORACLE) <= set(queries.queries()) and all(any(t in sql for t in TABLES) for sql in ORACLE.values())
    assert duckdb.sql("select 1").fetchall() == [(1,)]


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_extra_columns_and_empty_tables(spark, small):
    docs, bench = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/benchmark.parquet")
    wide, none = clashing(docs), clashing(docs).where("false")
    for f in (line_dedup.dedup_lines, substring_dedup.dedup_substrings, simhash.drop_near_duplicates,
              lambda d: decontaminate.drop_contaminated(d, bench)):
        plain, more, empty = f(docs), f(wide), f(none)
        n = len(docs.columns)
        assert more.columns[:n] == docs.columns and more.columns[n:n + len(CLASH)] == CLASH
        flat = more.toDF(*[f"c{i}" for i in range(len(more.columns))])
        assert rows(flat.select(*[f"c{i}" for i in range(n)])) == rows(plain.select(*docs.columns))
        assert empty.count() == 0
    for f in (mixing.mix_sources, simhash.near_duplicates, lambda d: decontaminate.hits(d, bench)):
        assert rows(f(wide)) == rows(f(docs)) and f(none).count() == 0
    assert rows(decontaminate.hits(docs, bench.where("false")).agg(F.sum("n_hit"))) == [(0,)]


def test_line_dedup_keeps_first_and_bytes(spark, small):
    out = {(r.doc_id, r.n_chars): r for r in line_dedup.dedup_lines(spark.read.parquet(f"{small}/documents.parquet")).collect()}
    assert out[5, 1].text == LONG and len(out[6, 1].text) < 200 and len(out[7, 1].text) < 200
    assert out[2, None].text is None and out[3, 0].text == "" and out[8, 4].text == "word"
    assert "sentence 4" in out[0, 1].text and "sentence 4" not in out[1, 1].text


def test_hot_chunks_use_salts(spark, small, monkeypatch):
    docs = spark.range(60).selectExpr("id doc_id", "cast(id as string) text")
    docs = docs.withColumn("text", F.concat(F.lit("start "), "text", F.lit("\n" + PASSAGE)))
    want = rows(line_dedup.dedup_lines(docs))
    monkeypatch.setattr(line_dedup, "HOT_ROWS", 7)
    assert rows(line_dedup.dedup_lines(docs)) == want


def test_benchmark_in_blocks(spark, small):
    docs, bench = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/benchmark.parquet")
    assert rows(decontaminate.hits(docs, bench, block_windows=2)) == rows(decontaminate.hits(docs, bench))


def test_window_of_more_items_than_a_block(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    docs = docs.union(docs.where("doc_id in (10, 11)")).union(docs.where("doc_id = 10").selectExpr("null", "text", "lang", "source", "n_chars"))
    bench = spark.createDataFrame([*ITEMS, (None, "short item"), *[(i, "Word") for i in range(100, 120)], (200, None)], "item_id bigint, text string")
    want = rows(decontaminate.hits(docs, bench))
    assert [r[1:4] for r in want if r[0] == 8] == [(1, 1, 20)]
    left = rows(decontaminate.drop_contaminated(docs, bench))
    for n in (1, 2, 3):
        assert rows(decontaminate.hits(docs, bench, block_windows=n)) == want
        assert rows(decontaminate.drop_contaminated(docs, bench, block_windows=n)) == left


def test_wu_manber_against_every_position():
    r = np.random.default_rng(0)
    for _ in range(200):
        m = int(r.integers(1, 6))
        wins = {tuple(r.choice(list("ab"), m)): [i] for i in range(6)}
        text = list(r.choice(list("abc"), 60))
        found = [s for s, _ in decontaminate.WuManber(wins, m).search(text)]
        assert found == [s for s in range(60 - m + 1) if tuple(text[s:s + m]) in wins]


# SimHash ---------------------------------------------------------------------------------------

def brute_fingerprint(text):
    words = [w.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
             for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in text or "").split(" ") if w]
    grams = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(fps):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 2:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(fps))]


def test_simhash_against_all_pairs(spark, small):
    got = rows(simhash.near_duplicates(spark.read.parquet(f"{small}/documents.parquet")))
    fps = [brute_fingerprint(r[1]) for r in ROWS]
    comp = brute_components(fps)
    low = {c: min([r[0] for r, k in zip(ROWS, comp) if k == c and r[0] is not None], default=None) for c in comp}
    assert got == sorted([(r[0], f"{f:016x}", low[c]) for r, f, c in zip(ROWS, fps, comp)], key=repr)


@pytest.mark.parametrize("bucket", [2, 32])
def test_links_of_dense_and_sparse_fingerprints(spark, bucket):
    r = np.random.default_rng(bucket)
    fps = set()
    for base in r.integers(0, 2**63, 12):
        for _ in range(25):  # clusters around a value: many pairs near the limit, long chains
            x = int(base)
            for b in r.integers(0, 64, r.integers(0, 5)):
                x ^= 1 << int(b)
            fps.add(x)
    fps = sorted(fps)
    df = spark.createDataFrame([(simhash._signed(f),) for f in fps], "fp bigint")
    from fairrank.llm.graph import connected_components
    roots = {x.u: x.root for x in connected_components(simhash.links(df, bucket)).collect()}
    comp = brute_components(fps)
    mine = [roots.get(simhash._signed(f), simhash._signed(f)) for f in fps]
    assert len(set(zip(comp, mine))) == len(set(comp)) == len(set(mine))


def test_one_document_stays_of_each_group(spark, small):
    kept = simhash.drop_near_duplicates(spark.read.parquet(f"{small}/documents.parquet")).collect()
    comp = brute_components([brute_fingerprint(r[1]) for r in ROWS])
    of = {(r[0], r[1]): c for r, c in zip(ROWS, comp)}
    assert sorted(of[r.doc_id, r.text] for r in kept) == sorted(set(comp))


# Mixing and quality ----------------------------------------------------------------------------

def test_mixing_cuts_by_histogram_like_by_order(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RANK_BITS", 24)  # four histograms instead of ten
    docs = spark.range(3000).selectExpr("id doc_id", "repeat('w ', cast(1 + id % 40 as int)) text", "if(id % 3 = 0, 'hot', concat('s', id % 7)) source")
    docs = docs.union(docs.where("doc_id = 9")).union(docs.where("doc_id = 9"))
    want = rows(mixing.mix_sources(docs))
    monkeypatch.setattr(mixing, "FEW_ROWS", 20)
    assert rows(mixing.mix_sources(docs)) == want
    by = mixing.mix_sources(docs).groupBy("source").agg(F.sum("taken").alias("t"), F.max("target").alias("w"), F.max("copies").alias("c"))
    assert all(abs(x.t - x.w) <= 20 and x.c <= 3 for x in by.collect())


def test_mix_repeats_whole_rows(spark):
    docs = spark.range(300).selectExpr("if(id % 5 = 0, null, id % 40) doc_id", "repeat(concat('w', id % 7, ' '), cast(1 + id % 9 as int)) text",
                                       "concat('s', id % 6) source", "id n")
    wide = clashing(docs.union(docs.where("n < 30")).union(docs.where("n < 30").withColumn("text", F.lit(None).cast("string"))))
    plan = mixing.mix_sources(wide, carry=("n",)).collect()
    want = sorted(((r.doc_id, r.source, r.n) for r in plan for _ in range(r.copies)), key=repr)
    assert {r.copies for r in plan} >= {0, 1, 2} and any(r.doc_id is None and r.copies for r in plan)
    mix = mixing.mix_documents(wide)
    assert mix.columns == wide.columns
    got = mix.toDF(*[f"c{i}" for i in range(len(mix.columns))]).select("c0", "c1", "c2", "c3")
    assert rows(got.select("c0", "c2", "c3")) == want
    assert set(rows(got)) <= set(rows(wide.toDF(*[f"c{i}" for i in range(len(wide.columns))]).select("c0", "c1", "c2", "c3")))
    assert mixing.mix_documents(wide.where("false")).count() == 0


def test_inclusion_follows_the_probabilities(spark):
    # 2,001 sources with the same 300 documents: every source is one draw
    sizes = [1, 2, 3, 5, 8, 13, 20, 30, 40, 50, 60, 75, 90, 110, 130] * 20
    docs = spark.range(2001).crossJoin(spark.createDataFrame(list(enumerate(sizes)), "i int, n int")).selectExpr(
        "id * 1000 + i as doc_id", "repeat('w ', n) as text", "format_string('s%04d', id) as source", "i", "n", "id")
    got = mixing.mix_sources(docs, carry=("i", "id")).toPandas()
    total, squares = sum(sizes), sum(n * n for n in sizes)
    for nth, weight in enumerate((5, 2, 1)):
        mine = got[got["id"] % 3 == nth]
        target = total * 3 * weight / 8
        assert np.allclose(mine["target"], target)
        per, large = target / squares, set()
        while more := {n for n in sizes if per * n >= 3} - large:  # those have three copies
            large |= more
            per = (target - 3 * sum(n for n in sizes if n in large)) / sum(n * n for n in sizes if n not in large)
        want = np.array([3.0 if n in large else per * n for n in sizes])
        mean = mine.groupby("i")["copies"].mean().to_numpy()
        # the words of documents with equal sizes are drawn as often as they should be; the gap is closed by one document
        for n in set(sizes):
            at = [i for i, s in enumerate(sizes) if s == n]
            assert abs(mean[at].mean() - want[at].mean()) < 0.06, (weight, n, mean[at].mean(), want[at].mean())
        words = mine.groupby("id")["taken"].sum()
        assert abs(words - target).max() <= 20 and mine["copies"].max() <= 3


def test_mixing_caps_and_reshares(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 0), (None, 90)], "source string, source_size bigint")
    got = {r.source: r.target for r in mixing.targets(sizes).collect()}
    # a (weight 5) is capped at 30, c (1) at 0; b (2) and null (5) share 1070, null capped at 270
    assert got == {"a": 30.0, "b": 800.0, "c": 0.0, None: 270.0}


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="driver test data not present")
def test_quality_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.fit(docs, labels)
    s = quality.score_documents(docs, model)
    seen = s.join(labels, "doc_id").where("held_out").select("quality", "predicted", "score").collect()
    assert np.mean([r.quality == r.predicted for r in seen]) > 0.93
    good = {r.doc_id for r in s.where("predicted = 1").select("doc_id").collect()}
    assert {r.doc_id for r in quality.keep_good(docs, model).select("doc_id").collect()} == good
    odd = spark.createDataFrame(ROWS, SCHEMA)
    got = quality.score_documents(clashing(odd), model).collect()
    assert len(got) == len(ROWS) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    assert quality.fit(docs, labels.where("false")).score(np.zeros((1, len(quality.FEATURES)))).tolist() == [0.5]


def plain_fit(x, y, gam):
    """The tables of single features by loops over rows, bins and cuts."""
    n, width = x.shape
    f = [math.log((sum(y) + 0.5) / (n + 1.0) / (1 - (sum(y) + 0.5) / (n + 1.0)))] * n
    edges = [sorted({float(np.quantile(x[:, j], i / gam.BINS)) for i in range(1, gam.BINS)}) for j in range(width)]
    spot = [[sum(e <= v for e in edges[j]) for v in x[:, j]] for j in range(width)]
    tables = [[0.0] * (len(e) + 1) for e in edges]

    def gain(g, h):
        return g * g / (h + gam.RIDGE)

    for _ in range(gam.ROUNDS):
        for j in range(width):
            p = [1 / (1 + math.exp(-v)) for v in f]
            cells = [[0.0, 0.0, 0] for _ in tables[j]]
            for i in range(n):
                c = cells[spot[j][i]]
                c[0], c[1], c[2] = c[0] + p[i] - y[i], c[1] + p[i] * (1 - p[i]), c[2] + 1

            def sums(a, z):
                return [sum(c[k] for c in cells[a:z]) for k in range(3)]
            pieces = [(0, len(cells))]
            for _ in range(2):
                options = []
                for a, z in pieces:
                    g, h, m = sums(a, z)
                    for k in range(a + 1, z):
                        left = sums(a, k)
                        if left[2] >= gam.MIN_ROWS and m - left[2] >= gam.MIN_ROWS:
                            options.append((gain(*left[:2]) + gain(g - left[0], h - left[1]) - gain(g, h), a, k, z))
                best = max(options, key=lambda o: o[0], default=(0,))
                if best[0] <= 1e-9:
                    break
                pieces = [q for q in pieces if q != (best[1], best[3])] + [(best[1], best[2]), (best[2], best[3])]
            for a, z in pieces:
                g, h, _ = sums(a, z)
                for k in range(a, z):
                    tables[j][k] += gam.STEP * -g / (h + gam.RIDGE)
                for i in range(n):
                    if a <= spot[j][i] < z:
                        f[i] += gam.STEP * -g / (h + gam.RIDGE)
    return edges, tables


def test_boosted_tables_against_plain_loops(monkeypatch):
    from fairrank.llm import gam
    monkeypatch.setattr(gam, "ROUNDS", 4)
    monkeypatch.setattr(gam, "BINS", 9)
    r = np.random.default_rng(6)
    x = np.column_stack((r.normal(size=400), r.integers(0, 5, 400), r.exponential(size=400)))
    y = (x[:, 0] + (x[:, 1] == 3) + 0.3 * r.normal(size=400) > 0.4).astype(float)
    model = gam.GAM().fit(x, y)
    edges, tables = plain_fit(x, y, gam)
    for j in range(3):
        assert np.allclose(model.edges[j], edges[j]) and np.allclose(model.tables[j], tables[j], atol=1e-9)
    # a score is the base and one entry of every table, looked up by hand
    for row, score in zip(x[:50], model.score(x[:50])):
        total = model.base + sum(t[sum(e <= v for e in es)] for v, es, t in zip(row, model.edges, model.tables))
        total += sum(t[sum(e <= row[a] for e in model.coarse[a])][sum(e <= row[b] for e in model.coarse[b])] for a, b, t in model.pairs)
        assert score == pytest.approx(1 / (1 + math.exp(-total)), abs=1e-12)
    assert model.pairs


def test_quality_of_empty_tables_and_repeated_rows(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    labels = spark.createDataFrame([(i, i % 2) for i in range(12)] + [(None, 1), (5, None)], "doc_id bigint, quality int")
    model = quality.fit(docs, labels)
    for f in (lambda d: quality.score_documents(d, model), lambda d: quality.keep_good(d, model)):
        assert f(docs.where("false")).count() == 0
    twice = docs.union(docs)
    one, two = (sorted(map(tuple, quality.score_documents(d, model).collect()), key=repr) for d in (docs, twice))
    assert two == sorted(one + one, key=repr)
    assert quality.keep_good(twice, model).count() == 2 * quality.keep_good(docs, model).count()
    # ids that repeat in the documents: the bound holds, and the order of the rows doesn't matter
    many = docs.union(docs).union(docs)
    a, b = (quality.fit(d, labels, max_rows=10) for d in (many, many.repartition(5)))
    assert a.base == b.base and all(np.array_equal(s, t) for s, t in zip(a.tables, b.tables))
