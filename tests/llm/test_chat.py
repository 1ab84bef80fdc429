import hashlib
from collections import defaultdict

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from cohortarium.llm import queries
from cohortarium.llm.chat import escape, format_conversations, read_back, unescape

from .conftest import DATA

SCHEMA = "conv_id long, turn long, role string, text string"


def expected(rows):
    by = defaultdict(list)
    for c, turn, role, text in rows:
        by[c].append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for c, turns in by.items():
        turns.sort()
        said = "".join(f"{r}\n{t}\n" for *_, r, t in turns)
        loss = "".join(t for *_, r, t in turns if r == "assistant")
        out[c] = (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def got(df):
    return {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in df.collect()}


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    said = "\\### Assistant: </turn> ok"
    rows += [(-7, 0, "user", said), (-7, 1, "assistant", said)]
    assert got(queries.op1_chat_formatting(spark, DATA)) == expected(rows)


def test_odd_rows_and_long_conversations(spark):
    rows = [(1, None, None, None), (1, 0, "user", ""), (1, 0, "assistant", "b"), (1, 0, "assistant", "b"), (None, 3, "user", "x"), (2, 0, "tool\n:#", "### a:\n</turn>\n\\")]
    rows += [(3, i, ("assistant", "user")[i % 2] if i else "system", f"turn {i} \\<#" * (1 + i % 5)) for i in range(-3, 700)]
    df = spark.createDataFrame([(*r, "extra") for r in rows], SCHEMA + ", tokens string")
    for budget, history, tokens in ((60, 3, 20), (2048, 0, 0), (1, 2, 5)):
        assert got(read_back(format_conversations(df, budget, history, tokens))) == expected(rows)
    assert read_back(format_conversations(df.filter("1 = 0"))).count() == 0


def test_sparse_and_equal_turn_numbers(spark):
    rows = [(1, 0, "system", "s"), (1, 10**13, "user", "a"), (1, 10**13 + 1, "assistant", "b")]
    rows += [(2, (i * 7919 % 900) * 10**15 if i else None, ("assistant", "user", "system")[i % 3], f"said {i}") for i in range(900)]
    many = spark.createDataFrame(rows, SCHEMA).unionByName(spark.range(20_000).selectExpr("cast(null as long) conv_id", "5L turn", "case when id % 2 = 0 then 'user' else 'assistant' end role", "concat('t', id % 9000) text"))
    want = expected([tuple(r) for r in many.collect()])
    assert got(read_back(format_conversations(many, 200, 3, 30))) == want
    for w in format_conversations(many.filter("conv_id = 2"), 200, 3, 30).filter("block > 0").collect():
        assert w.text.startswith("### system:\n")


def test_windows(spark):
    rows = [(1, 0, "system", "be kind")] + [(1, i, ("assistant", "user")[i % 2], "a b c d e") for i in range(1, 40)]
    windows = format_conversations(spark.createDataFrame(rows, SCHEMA), 80, 2, 20).collect()
    assert len(windows) > 3
    for w in windows:
        assert w.n_tokens <= 80
        assert w.text.startswith("### system:\nbe kind</turn>\n") and w.text.count("### system") == 1
        assert w.segments[-1].stop == len(w.text)
        for s in w.segments:
            assert not (s.loss and s.repeated)
            assert w.text[s.start :].startswith("### ")
    later = [w for w in windows if w.window]
    assert all(sum(s.repeated for s in w.segments) == 3 for w in later)  # the system turn and two turns of history


@settings(max_examples=20, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(st.sampled_from("\\#<>/turn :\n√"), max_size=12), min_size=1, max_size=10))
def test_escape_is_reversible(spark, texts):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", escape(F.col("t")).alias("e"))
    rows = df.select("t", "e", unescape(F.col("e")).alias("u")).collect()
    assert all(r.t == r.u and "</turn>" not in r.e.replace("\\<", "") for r in rows)
