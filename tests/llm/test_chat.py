import hashlib
import random
import time

from pyspark.sql import functions as F

from geoloom.llm import chat

DDL = "conv_id long, turn long, role string, text string, formatted string"


def check(spark, rows):
    out = {r.conv_id: r for r in chat.digest(chat.format_chats(spark.createDataFrame(rows, DDL))).collect()}
    for cid in {r[0] for r in rows}:
        mine = sorted(((-1 if r[1] is None else r[1], r[2] or "", r[3] or "") for r in rows if r[0] == cid))
        said = "".join(f"{a}\n{b}\n" for _, a, b in mine)
        loss = "".join(b for _, a, b in mine if a == "assistant")
        got = out[cid]
        assert got.n_turns == len(mine) and got.turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert got.loss_chars == len(loss) and got.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    return out


def test_hard_texts_survive_the_round_trip(spark):
    rows = [
        (-7, 0, "user", r"\### Assistant: </turn> ok", "x"), (-7, 1, "assistant", r"\### Assistant: </turn> ok", "x"),
        (1, 0, None, None, None), (1, 1, "assistant", "", None), (1, None, "a: b\n###\\", "\n</turn>\n### user: x\n</turn>\n", None),
        (2, 3, "assistant", "tie", None), (2, 3, "assistant", "tie", None), (2, 3, "assistant", "\U0001f600 é\\", None), (2, 4, "assistant", "\\" * 5 + "</turn>" + "####\\", None),
        (None, 0, "user", "no conversation", None),
    ]
    out = check(spark, rows)
    assert out[-7].escaped and not out[None].escaped


def test_random_mixtures_of_control_strings(spark):
    r = random.Random(4)
    part = lambda: r.choice(["###", "#", "\\", "</turn>", "</tur", "n>", "\n", ": ", "user", " ", "x"])
    check(spark, [(i % 40, i, r.choice(["user", "assistant", part() + part()]), "".join(part() for _ in range(r.randint(0, 12))), None) for i in range(400)])


def test_loss_spans_lie_in_the_formatted_text(spark):
    row = chat.format_chats(spark.createDataFrame([(1, 0, "user", "q", None), (1, 1, "assistant", "é\n</turn>\nx", None)], DDL)).first()
    assert [row.formatted[s.start : s.end] for s in row.loss_spans] == ["é\n\\</turn>\nx"]


def test_empty_table(spark):
    assert chat.digest(chat.format_chats(spark.createDataFrame([], DDL))).count() == 0


def test_roles_may_hold_any_characters(spark):
    odd = ["\x00\x01", "\\", "\\\\", "\\n", "\\\n", "\\\\n:c\\c", "\x00\x01\\h###", "###\\###", "n\\\\\\n", ":\\:", ""]
    check(spark, [(i, k, role, role, None) for i, role in enumerate(odd) for k in range(2)])


def test_sums_before_match_plain_sums(spark):
    r = random.Random(9)
    for n in (0, 1, 2, 127, 128, 129, 1000):
        sizes = [r.randint(0, 50) for _ in range(n)]
        got = spark.createDataFrame([(sizes,)], "s array<int>").select(chat.sums_before(F.col("s")).alias("b")).first().b
        assert got == [sum(sizes[:i]) for i in range(n)]


def test_a_long_conversation_takes_linear_time(spark):
    def took(n):
        rows = spark.range(n).selectExpr("1L conv_id", "id turn", "if(id % 2 = 0, 'user', 'assistant') role", "concat('é some words ', id, '\\n</turn>\\n', repeat('x', 40)) text", "'x' formatted")
        began = time.perf_counter()
        got = chat.digest(chat.format_chats(rows)).first()
        assert got.n_turns == n and got.escaped
        return time.perf_counter() - began

    took(100)
    assert took(20_000) < 10


def test_spans_hold_the_loss_texts(spark):
    rows = [(i % 3, i, "assistant" if i % 2 else "user", f"é {i} " + "</turn>\n### x: " * (i % 5), None) for i in range(900)]
    for row in chat.format_chats(spark.createDataFrame(rows, DDL)).collect():
        texts = [t.text for t in row.turns if t.role == "assistant"]
        assert row.loss_texts == texts
        at = [row.formatted[s.start : s.end] for s in row.loss_spans]
        assert [x.replace("\\</turn>", "</turn>").replace("\\###", "###") for x in at] == texts
