"""Conversation repair: the grammar against exhaustive search, odd rows and split conversations against SQL."""

import hashlib
import itertools
import re

import numpy as np
import pytest
from oracle_compare import compare

from fairrank.llm import queries, repair
from fairrank.llm.oracle import ORACLE

ODD = [(1, 0, "system", "Be good."), (1, 1, "user", "Hi there."), (1, 2, "assistant", "Hello."), (1, 3, "user", "and then"), (1, 3, "user", "and then"),
       (2, 0, "assistant", "First!"), (2, 1, "assistant", "First!"), (2, 5, "tool", "out?"), (2, None, "user", "No turn."), (2, None, None, None),
       (None, 0, "user", "Hi there."), (None, 0, "user", "Hi there."), (None, None, "assistant", ""), (None, 7, "", "No role."), (None, 8, "system", "Late one."),
       (3, 0, None, None), (4, 0, "user", " \n\t"), (5, 9, "superuser", "Kept as s. \n"), (5, 10, "User", "Upper case."), (5, 12, "user", "é" * 30 + "."),
       (6, 0, "user", "long " * 30000 + "end."), (6, 1, "assistant", "line\n" * 9 + "x"), (7, -3, "user", "a."), (7, 2**40, "assistant", "b.")]
ODD += [(100 + i % 40, i // 40, ("user", "assistant", "system")[(i * 7 // 5) % 3], f"Text {i % 11}{'.' if i % 4 else ''}") for i in range(400)]
ODD += [(50, i, "user" if i % 2 else "assistant", f"Turn {i % 300}{'.' if i % 9 else ''}") for i in range(600)]


def exhaustive(rows):
    """The least (cost, audit, repaired) over all edits with at most three inserted rows."""
    best = None
    seen = set()
    ways = []
    for role, text in rows:
        words = re.sub(r"[^\x20\x09-\x0D]", "", text) != text
        fixed = not words or (role, text) in seen
        seen.add((role, text))
        late = 5 if words and text.rstrip()[-1] not in ".!?" else 0
        ways.append([("D", 2, None)] + ([] if fixed else [("K", late, (role, text))] + [("R", 1 + late, (r, text)) for r in ("user", "assistant")]))
    for combo in itertools.product(*ways):
        for n in range(4):
            for slots in itertools.combinations_with_replacement(range(len(rows) + 1), n):
                for roles in itertools.product(("user", "assistant"), repeat=n):
                    audit, cost, out = "", 0, []
                    for i in range(len(rows) + 1):
                        for s, r in zip(slots, roles):
                            if s == i:
                                audit, cost, out = audit + "I", cost + 5, [*out, (r, "")]
                        if i < len(rows):
                            e, c, row = combo[i]
                            audit, cost, out = audit + e, cost + c, out + ([row] if row else [])
                    if re.fullmatch("(s?(ua)+)?", "".join(r[0][:1] or "-" for r in out)) and (best is None or (cost, audit) < best[:2]):
                        best = (cost, audit, out)
    return best


def test_cells_against_exhaustive_search():
    r = np.random.default_rng(3)
    parser = repair.Parser()
    for _ in range(60):
        rows = [(str(r.choice(["user", "assistant", "system", "x", ""])), str(r.choice(["A.", "B.", "C", "D.", " "]))) for _ in range(r.integers(0, 4))]
        seen, kinds = set(), ""
        for role, text in rows:
            kinds += repair.kind_of(role, text, (role, text) in seen)[0]
            seen.add((role, text))
        cost, audit = parser.solve(kinds)
        want = exhaustive(rows)
        assert (cost, audit) == want[:2]
        assert list(repair.repaired(rows, audit)) == want[2]


def test_every_split_of_a_span_gives_the_same_cells():
    r = np.random.default_rng(4)
    parser = repair.Parser()
    for _ in range(20):
        kinds = "".join(r.choice(list("suaxSUAXd"), 9))
        whole = parser.parse(kinds)
        for cut in range(1, 9):
            assert repair.combine(parser.parse(kinds[:cut]), parser.parse(kinds[cut:])) == whole


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    import pandas as pd
    top = tmp_path_factory.mktemp("conversations")
    pd.DataFrame(ODD, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"}).to_parquet(top / "conversations.parquet")
    return str(top)


@pytest.mark.parametrize("ranges", [1, 40])
def test_odd_rows_and_split_conversations_match_sql(spark, odd, ranges):
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", ranges)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        ok, msg = compare(queries.op13_conversation_repair(spark, odd), ORACLE["op13_conversation_repair"], odd)
        assert ok, msg
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_repaired_turns_are_what_the_digest_covers(spark, odd):
    rows = repair.damage(spark.read.parquet(f"{odd}/conversations.parquet"))
    reports = {r.conv_id: r for r in repair.repair(rows, gone_col="gone").collect()}
    turns = {}
    for r in sorted(repair.repaired_turns(rows, gone_col="gone").collect(), key=lambda r: r.position):
        assert r.position == len(turns.setdefault(r.conv_id, []))
        turns[r.conv_id].append(r)
    assert set(reports) == {r[0] for r in ODD} and set(turns) <= set(reports)
    for c, r in reports.items():
        mine = turns.get(c, [])
        assert re.fullmatch("(s?(ua)+)?", "".join(t.role[:1] for t in mine))
        assert r.repaired_sha256 == hashlib.sha256("\n".join(f"{t.role}:{t.text}" for t in mine).encode()).hexdigest()


def test_extra_columns_and_empty_table(spark, odd):
    from pyspark.sql import functions as F
    rows = spark.read.parquet(f"{odd}/conversations.parquet")
    wide = rows.select("*", F.lit(1).alias("TURN"), F.lit(2).alias("pos"), F.lit("z").alias("Role"))
    assert sorted(map(str, repair.repair(wide).collect())) == sorted(map(str, repair.repair(rows).collect()))
    assert repair.repair(wide.where("false")).count() == 0 and repair.repaired_turns(wide.where("false")).count() == 0
