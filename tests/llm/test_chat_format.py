import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cantata.llm import chat_format, oracles, queries

PIECES = ["\\", "<turn:", "</turn>", "</turn>\n", ">", "\n", "### Assistant:", "ok", "<", "é😀", " ", "assistant", "turn:", "\\<turn:user>\n"]


def plain(turns):
    """conv_id to its digests, from (conv_id, role, text) in order."""
    out = {}
    for c, role, text in turns:
        out.setdefault(c, []).append((role or "", text or ""))
    rendered = {c: "".join(chat_format.render(r, t)[0] for r, t in v) for c, v in out.items()}
    said = {c: "".join(t for r, t in v if r == "assistant") for c, v in out.items()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return {c: (len(v), sha("".join(f"{r}\n{t}\n" for r, t in v)), len(said[c]), sha(said[c]), len(rendered[c])) for c, v in out.items()}


def digests(turns):
    out = chat_format.digest(chat_format.read_back(chat_format.format_chats(chat_format.log(turns)))).collect()
    assert len({r.conv_id for r in out}) == len(out)
    return {r.conv_id: tuple(r)[1:] for r in out}


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.lists(st.sampled_from(PIECES), max_size=4).map("".join), st.one_of(st.text(max_size=8), st.lists(st.sampled_from(PIECES), max_size=6).map("".join))), max_size=4))
def test_rendering_is_reversible(turns):
    text, at = "", []
    for role, said in turns:
        turn, start, end = chat_format.render(role, said)
        at.append((len(text) + start, len(text) + end))
        text += turn
    assert chat_format.parse(text) == turns
    assert [chat_format.unescape(text[a:b]) for a, b in at] == [t for _, t in turns]


def test_control_strings_stay_inside_texts():
    turn, start, end = chat_format.render("user", queries.MARKS_TEXT)
    assert turn.count("</turn>\n") == 1 and turn[start:end] == "\\\\### Assistant: \\</turn> ok"


def test_edits_and_regenerations(spark):
    rows = [
        (1, 0, 0, "open", "user", None), (1, 0, 1, "delta", None, "helo"), (1, 0, 2, "edit", None, "hello"), (1, 0, 3, "delta", None, " there"),
        (1, 1, 0, "open", "assistant", None), (1, 1, 1, "delta", None, "bad"), (1, 1, 2, "regenerate", None, None), (1, 1, 3, "delta", None, "good"), (1, 1, 4, "delta", None, None), (1, 1, 5, "wave", None, "x"),
        (2, 0, 1, "delta", None, "no role"), (2, 1, 0, "open", "system", None), (2, 1, 1, "open", "assistant", None), (2, 2, 0, "regenerate", None, None), (None, None, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, "conv_id bigint, message int, seq bigint, kind string, role string, text string").withColumn("part", F.lit(1)).withColumn("loss", F.lit("x")).orderBy(F.desc("seq"))
    segments = chat_format.format_chats(df)
    out = {}
    for r in chat_format.read_back(segments).orderBy("part").collect():
        out.setdefault(r.conv_id, []).extend(map(tuple, r.turns))
    assert out == {None: [("", "")], 1: [("user", "hello there"), ("assistant", "good")], 2: [("", "no role"), ("assistant", ""), ("", "")]}


def test_against_plain(spark, monkeypatch):
    rng = random.Random(11)
    rows = [(c, t, rng.choice(["user", "assistant", "system", "", None]), rng.choice([None, "", "".join(rng.choices(PIECES, k=rng.randrange(40)))])) for c in [*range(60), None] for t in range(rng.randrange(1, 9))]
    rows += [(500, None, "user", "null turns come first"), (500, 0, "assistant", "x" * 300_000 + "</turn>"), (500, 1, "assistant", "\\" * 1001)]
    rows += [(1000, t, "assistant" if t % 2 else "user", f"{t} " * 40) for t in range(4000)]  # half of the rows
    rows += [(2000, 5, "user", "same")] * 5
    schema = "conv_id bigint, turn bigint, role string, text string"
    df = spark.createDataFrame(rows, schema).withColumn("message", F.lit(1)).withColumn("id", F.lit("x"))
    want = plain([(c, r, x) for c, _, r, x in rows])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert digests(df.repartition(7)) == want
        assert digests(df.where("conv_id = 1000").repartition(3)) == {1000: want[1000]}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert digests(df) == want
    assert digests(df.where("false")) == {}


def test_query(spark):
    duckdb = pytest.importorskip("duckdb")
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{sf}/conversations.parquet')")
    rows = con.execute("SELECT conv_id, role, text FROM conversations ORDER BY conv_id, turn").fetchall()
    want = plain([(-7, "user", queries.MARKS_TEXT), (-7, "assistant", queries.MARKS_TEXT), *rows])
    out = queries.op13_chat_format(spark, sf)
    assert {r.conv_id: tuple(r)[1:] for r in out.collect()} == want
    sql = con.execute(f"SELECT {', '.join(out.columns)} FROM ({oracles.CHATS})").fetchall()
    assert {r[0]: tuple(r[1:]) for r in sql} == want
