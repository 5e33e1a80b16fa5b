import random

from pyspark.sql import functions as F

from monthwise.llm.chat import format_chats, reparsed, unescaped

SCHEMA = "conv_id long, turn long, role string, text string, extra string"


def test_round_trip_of_conflicting_texts(spark):
    texts = ["", None, "plain", "a</turn>\n### user: b", "</turn>", "### x", "\\e \\c \\h", "\\### Assistant: </turn> ok", "######", "\\", "x: y", "</turn", "é😀" * 5000, "<\\t/turn>"]
    roles = ["user", "assistant", None, "sys: tem", "a\\c", "### ", "</turn>"]
    rows = [(i, t, roles[(i + t) % len(roles)], texts[(i * 5 + t) % len(texts)], "z") for i in range(40) for t in range(1 + i % 6)]
    rows += [(None, 0, "user", "no id", "z"), (99, 1, "user", "same", "z"), (99, 1, "user", "same", "z"), (99, None, "user", "first", "z")]
    out = format_chats(spark.createDataFrame(rows, SCHEMA)).withColumn("back", reparsed(F.col("formatted"))).collect()
    want = {}
    for conv, turn, role, text, _ in rows:
        want.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    assert {r.conv_id: [(t.role, t.text) for t in r.back] for r in out} == {k: [x[2:] for x in sorted(v)] for k, v in want.items()}
    for r in out:
        loss = [x[3] for x in sorted(want[r.conv_id]) if x[2] == "assistant"]
        raw = [r.formatted[s.start : s.start + s.length] for s in r.loss_spans]
        assert len(raw) == len(loss)
        assert [x.replace("<\\t/turn>", "</turn>").replace("#\\h ", "# ").replace("\\c", ":").replace("\\e", "\\") for x in raw] == loss


def test_escapes_only_what_conflicts(spark):
    rows = [(1, 0, "user", "a \\ b ## c", ""), (2, 0, "user", "a ### b", ""), (3, 0, "user", "\\e</turn>", "")]
    out = {r.conv_id: r for r in format_chats(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert [out[i].escape_level for i in (1, 2, 3)] == [0, 1, 2]
    assert out[1].formatted == "### user: a \\ b ## c</turn>\n"


def test_empty_table(spark):
    assert format_chats(spark.createDataFrame([], SCHEMA)).count() == 0
    assert spark.range(1).select(unescaped(F.lit("x"))).first()[0] == "x"


def back_of(spark, rows):
    out = format_chats(spark.createDataFrame(rows, SCHEMA)).withColumn("back", reparsed(F.col("formatted"))).collect()
    return {r.conv_id: [(t.role, t.text) for t in r.back] for r in out}


def test_hash_runs_around_every_control_string(spark):
    pieces = []
    for n in range(1, 41):
        run = "#" * n
        for control in ("### ", ": ", "</turn>", "</turn>\n### ", "\\h ", "\\e", "\\"):
            pieces += [run + " ", run + control, control + run, control[:2] + run + control[2:], run + control + run + " "]
    rows = [(i, 0, "user", p, "") for i, p in enumerate(pieces)] + [(len(pieces) + i, 0, p, "x", "") for i, p in enumerate(pieces)]
    assert back_of(spark, rows) == {r[0]: [(r[2], r[3])] for r in rows}


def test_generated_texts(spark):
    rng = random.Random(11)
    draw = lambda: "".join(rng.choice("##\\</turnhec: \n") if rng.random() < 0.9 else rng.choice(["</turn>", "### "]) for _ in range(rng.randrange(30)))
    rows = [(i, t, draw(), draw(), "") for i in range(5000) for t in range(2)]
    want = {}
    for conv, _, role, text, _ in rows:
        want.setdefault(conv, []).append((role, text))
    assert back_of(spark, rows) == want
