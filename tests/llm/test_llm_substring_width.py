"""op2's runs carry a text hash only where ids don't tell documents apart."""

from fairrank.llm import substring_dedup

PASSAGE = " ".join(f"word{i}" for i in range(60)) + "."


def texts(n):
    return [" ".join(f"own{k}x{i}" for i in range(40)) + ". " + PASSAGE for k in range(n)]


def deduped(spark, monkeypatch, ids):
    written = {}

    def staged(df, name):
        written[name] = df.localCheckpoint() if name == "spans" else df
        return written[name]
    monkeypatch.setattr(substring_dedup, "staged", staged)
    rows = list(zip(ids, texts(len(ids))))
    got = substring_dedup.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    spans = written["spans"]
    return got, spans, spans.select("_th").distinct().count()


def test_unique_ids_need_no_text_hash(spark, monkeypatch):
    got, spans, hashes = deduped(spark, monkeypatch, [3, 1, 2])
    assert hashes == 1 and dict(spans.dtypes)["_h2"] == "int"
    assert {r.doc_id: r.words_removed > 0 for r in got} == {1: False, 2: True, 3: True}


def test_repeated_and_null_ids_are_told_apart(spark, monkeypatch):
    for ids in ([1, 1, 2], [1, None, 2]):
        got, _, hashes = deduped(spark, monkeypatch, ids)
        assert hashes == 3
        assert sum(r.words_removed > 0 for r in got) == 2
