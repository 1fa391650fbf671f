from pyspark.sql import functions as F

from fairrank.sources.contracts import CONTRACTS, coerce_bool, coerce_int64, coerce_to_contract, contract_errors


def test_int_coercion(spark):
    df = spark.createDataFrame([("3",), (" 4 ",), ("3.0",), ("3.5",), ("x",), (None,)], "v string")
    assert [r[0] for r in df.select(coerce_int64(F.col("v"))).collect()] == [3, 4, 3, None, None, None]


def test_bool_coercion(spark):
    df = spark.createDataFrame([("yes",), ("N",), ("1",), ("TRUE",), (None,)], "v string")
    assert [r[0] for r in df.select(coerce_bool(F.col("v"))).collect()] == [True, False, True, None, None]


def test_contract_normalises_and_validates(spark, tmp_path):
    p = tmp_path / "clients.csv"
    p.write_text("ClientID,ClientGender,Age,Extra\n1, M ,30.5,a\n2,female,x,b\n2,U,,c\n")
    raw = spark.read.option("header", True).csv(str(p))
    out = coerce_to_contract(raw, CONTRACTS["clients"])
    rows = out.orderBy("ClientID", "ClientGender").collect()
    assert [r.ClientGender for r in rows] == ["Male", "Female", "U"]
    assert rows[0].Age == 30.5 and rows[1].Age is None
    assert rows[0].Extra == "a"
    errs = [r.error for r in contract_errors(out, CONTRACTS["clients"]).collect()]
    assert any("duplicate" in e for e in errs)
