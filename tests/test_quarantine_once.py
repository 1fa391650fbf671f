"""A quarantined file is coerced once, and keeps values, violations and text."""

from fairrank.sources import contracts


def test_values_are_coerced_once(spark, tmp_path, monkeypatch):
    calls, real = [], contracts._coercions
    monkeypatch.setattr(contracts, "_coercions", lambda df, contract: calls.append(1) or real(df, contract))
    raw = spark.createDataFrame([(" 1 ", "2.0", "2024-01-02 03:04:05", "7", "x", "nan"), (None, "3", "no date", "7", "2", "1.5"),
                                 ("4", "5", "2024-01-02", "8", "", "2")],
                                "ClientID string, ProductID string, SaleTransactionDate string, StoreID string, Quantity string, SalesNetAmountEuro string")
    valid, rejected, counts = contracts.ingest_with_quarantine(raw, contracts.CONTRACTS["transactions"], str(tmp_path / "q"))
    assert len(calls) == 1 and counts == {"rows": 3, "rejected": 2}
    assert [tuple(r)[:2] + tuple(r)[3:] for r in valid.collect()] == [(4, 5, 8, None, 2.0)]
    assert {tuple(r.violations) for r in rejected.collect()} == {("Quantity: not a int64",),
                                                                  ("ClientID: missing", "SaleTransactionDate: not a datetime64[ns]")}
    assert {r.ClientID: r.as_read for r in rejected.collect()}[1].startswith('{"ClientID":" 1 ","ProductID":"2.0"')
