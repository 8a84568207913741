import random

from pyspark.sql import functions as F

from tidemark.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"
PIECES = [*chat.MARKS, *chat.ENTITIES.values(), "&", "<", "[", "]", ">", "/", "a", "INST]", "s>", "\n", "é", "日", "&amp", "<<", "", "=]"]


def frame(spark, rows, clash=True):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return df.selectExpr("*", "'x' AS formatted", "'x' AS level", "'x' AS Role", "1 AS t") if clash else df


def hard_rows(n=400):
    random.seed(7)
    text = lambda: "".join(random.choice(PIECES) for _ in range(random.randint(0, 9)))
    roles = ["user", "assistant", "system", "tool", "", None, "User"]
    return [(i % 37, i // 37, random.choice(roles) if i % 5 else text(), text() if i % 11 else None) for i in range(n)]


def test_round_trip_of_awkward_texts(spark):
    rows = hard_rows() + [(None, 1, "user", "a"), (None, None, "assistant", "b"), (50, 0, "assistant", "x"), (50, 0, "assistant", "x")]
    got = {r.conv_id: r for r in chat.read_back(chat.format_conversations(frame(spark, rows))).collect()}
    want = {}
    for r in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        want.setdefault(r[0], []).append((r[2] or "", r[3] or ""))
    assert set(got) == set(want)
    for conv, turns in want.items():
        assert got[conv].n_turns == len(turns)
        assert got[conv].turns == "".join(f"{a}\n{b}\n" for a, b in turns)
        assert got[conv].loss == "".join(b for a, b in turns if a == "assistant")


def test_marks_never_stand_in_a_text(spark):
    for r in chat.format_turns(frame(spark, hard_rows())).collect():
        start, end = chat.ROLE_MARKS.get(r.role, (chat.NAMED, chat.NAMED_END))
        assert r.formatted.startswith(start) and r.formatted.endswith(end)
        inside = r.formatted[len(start) : len(r.formatted) - len(end)]
        if r.role not in chat.ROLE_MARKS:
            assert inside.count(chat.NAME_END) == 1
            inside = inside.replace(chat.NAME_END, "")
        assert not any(m in inside for m in chat.MARKS)
        if r.role in chat.ROLE_MARKS:
            assert r.level or inside == r.text
        if r.role == "assistant":
            assert r.formatted[r.loss_start : r.loss_start + r.loss_length] == inside
        else:
            assert r.loss_length == 0


def test_clean_texts_stay_as_they_are(spark):
    rows = [(1, 0, "user", "a < b & c[0] = d"), (1, 1, "assistant", "R&D <b>x</b> &nbsp;")]
    r = chat.format_conversations(frame(spark, rows)).first()
    assert r.formatted == "[INST]a < b & c[0] = d[/INST]<s>R&D <b>x</b> &nbsp;</s>"


def test_empty_and_long(spark):
    assert chat.read_back(chat.format_conversations(frame(spark, []))).count() == 0
    long = "<word> [x] &lt; " * 200_000
    rows = [(1, 0, "user", long), (1, 1, "assistant", long)] + [(2, i, "assistant", f"{i} <s>") for i in range(500)]
    got = {r.conv_id: r for r in chat.read_back(chat.format_conversations(frame(spark, rows))).collect()}
    assert got[1].loss == long
    assert got[2].n_turns == 500 and got[2].loss == "".join(f"{i} <s>" for i in range(500))


def test_no_python_worker(spark):
    plan = chat.read_back(chat.format_conversations(frame(spark, hard_rows(10), clash=False)))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text and "Arrow" not in text and "Pandas" not in text
    assert plan.agg(F.count(F.lit(1))).first()[0] > 0
