import hashlib

from pyspark.sql import functions as F

from tests.rows import of_duck, of_spark
from trellis.llm import chat_format as C

ROWS = [
    (1, 2, "assistant", "back \\h \\\\ #### </turn></turn> \\l"), (1, 0, "system", None), (1, 1, "user", "###### \\"), (1, 3, "assistant", ""), (1, 3, "user", "same turn"),
    (2, None, None, "null role and turn"), (2, 5, "role=x: \n", ": \n"), (3, 1, "user", "only a user"), (None, 0, "assistant", "null id"), (4, 0, "assistant", C.HOSTILE), (4, 0, "assistant", C.HOSTILE),
    *((9, t, "assistant" if t % 2 else "user", f"### {t} </turn>") for t in range(150)),
]
SCHEMA = "conv_id long, turn long, role string, text string"


def made(spark):
    return C.segments(spark.createDataFrame([(*r, "more") for r in ROWS], SCHEMA + ", segment string"))


def ordered(conv):
    key = lambda r: ((r[1] is not None, r[1]) if r[1] is not None else (False, 0), r[2] or "", r[3] or "")
    return sorted((r for r in ROWS if r[0] == conv), key=key)


def test_digests_are_those_of_the_input(spark):
    got = {r.conv_id: r for r in C.digests(made(spark)).collect()}
    assert set(got) == {r[0] for r in ROWS}
    for conv, r in got.items():
        rows = [(a or "", b or "") for _, _, a, b in ordered(conv)]
        loss = "".join(t for a, t in rows if a == "assistant")
        assert r.n_turns == len(rows) and r.loss_chars == len(loss)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{t}\n" for a, t in rows).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()


def test_examples_have_all_before_them_and_one_trained_reply(spark):
    streams, whole = {}, made(spark).orderBy("turn_no").collect()
    for r in whole:
        streams[r.conv_id] = streams.get(r.conv_id, "") + r.segment
    examples = C.rendered(made(spark)).collect()
    assert len(examples) == sum(r[2] == "assistant" for r in ROWS)
    for e in examples:
        assert streams[e.conv_id].startswith(e.text) and e.text.endswith(C.CLOSE)
        assert e.text[e.loss_end :] == C.CLOSE and e.text[: e.loss_start].endswith("### Assistant: ")
        body = e.text[e.loss_start : e.loss_end]
        assert "###" not in body and "</turn>" not in body


def test_a_wrong_mask_shows_in_the_digests(spark):
    """What is trained on is read through the examples' masks: shift one, and only the loss digests change."""
    right, wrong = (({r.conv_id: r for r in C.digests(m).collect()}) for m in (made(spark), made(spark).withColumn("text_start", F.col("text_start") - 1)))
    for conv, r in right.items():
        assert r.turns_sha256 == wrong[conv].turns_sha256
        assert (r.loss_sha256 == wrong[conv].loss_sha256) == (not r.n_examples)
    none = C.prefix_targets(made(spark)).where("NOT (last_start <= loss_start AND loss_start <= loss_end AND loss_end < example_end AND example_end = last_start + length(last))")
    assert none.count() == 0


def test_every_example_holds_its_whole_context(spark):
    """Each is written out, and all its turns are read back from its own text."""
    rows = C.prefix_targets(made(spark)).withColumn("turns", C.read_back(F.col("text"))).collect()
    assert len(rows) == sum(r[2] == "assistant" for r in ROWS)
    for e in rows:
        assert [(t.role, t.text) for t in e.turns] == [(a or "", b or "") for _, _, a, b in ordered(e.conv_id)[: e.turn_no + 1]]
        assert len(e.text) == e.example_end and e.text[e.last_start :] == e.last


def test_a_wrong_context_shows_in_the_digests(spark, monkeypatch):
    right, kept = {r.conv_id: r for r in C.digests(made(spark)).collect()}, C.expanded
    cut = F.when(F.col("turn_no") > 0, F.regexp_replace("text", r"(?s)^### .*? </turn>\n", "")).otherwise(F.col("text"))
    monkeypatch.setattr(C, "expanded", lambda m: kept(m).withColumn("text", cut))
    for r in C.digests(made(spark)).collect():
        same = r.turns_sha256 == right[r.conv_id].turns_sha256 and r.example_chars == right[r.conv_id].example_chars
        assert same == (r.conv_id in (2, 3, None))  # no context before a reply


def test_a_conversation_of_the_added_id(spark):
    df = spark.createDataFrame([(-7, 0, "assistant", "its own"), (None, 0, "user", "x")], SCHEMA)
    assert sorted((str(r.conv_id), r.n_turns) for r in C.digests(C.segments(C.with_hostile(df))).collect()) == [("-7", 2), ("None", 1)]


def test_sql_and_the_hostile_conversation(spark, sf, duck):
    source = C.with_hostile(spark.read.parquet(f"{sf}/conversations.parquet"))
    df = C.digests(C.segments(source))
    assert of_spark(df) == of_duck(duck, C.sql())
    row = df.where("conv_id = -7").first()
    assert (row.n_turns, row.loss_chars, row.loss_sha256) == (2, len(C.HOSTILE), hashlib.sha256(C.HOSTILE.encode()).hexdigest())


def test_empty_table(spark):
    assert C.digests(C.segments(spark.createDataFrame([], SCHEMA))).count() == 0


def test_main_path_is_native(spark):
    plan = C.digests(made(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "InArrow" not in plan
