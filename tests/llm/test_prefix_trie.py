import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from cantata.llm import oracles, prefix_trie, queries

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain(rows):
    """The nodes by sets of whole prefixes."""
    own = {}
    key = lambda r: (r[1] is not None, r[1] or 0, hashlib.md5(f"{len(r[2] or '')}:{r[2] or ''}{r[3] or ''}".encode()).hexdigest())
    for r in sorted((r for r in rows if r[0] is not None), key=key):
        own.setdefault(r[0], []).append((r[2] or "", r[3] or ""))
    made = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        made[c] = tuple(own.get(base, [])[:h] + turns[h:])
    members = {}
    for c, turns in made.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
    children = {}
    for p in members:
        if p:
            children.setdefault(p[:-1], []).append(p)
    words = lambda p: len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
    below = {}
    for p in sorted(members, key=len, reverse=True):
        kids = children.get(p, [])
        below[p] = (sum(below[k][0] for k in kids) if kids else 1, (len(members[p]) - 1) * words(p) + sum(below[k][1] for k in kids))
    sha = lambda ids: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    return {(min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children.get(p, [])), *below[p], sha([c for c in m if len(made[c]) == len(p)])) for p, m in members.items()}


def nodes(df):
    out = prefix_trie.build(df)
    assert out.columns == COLUMNS
    rows = [tuple(r) for r in out.collect()]
    assert len(set(rows)) == len(rows)
    return set(rows)


def some(seed, convs, longest, texts):
    rng = random.Random(seed)
    return [(c, t, rng.choice(["user", "assistant", None, ""]), rng.choice(texts)) for c in convs for t in range(rng.randrange(1, longest))]


def deep():
    """Chains that hang on chains: conversation 20 * k shares k turns with the one before; all bring their own heads."""
    return [(20 * k, t, "user", "same words" if t < k else f"own {k} {t}") for k in range(40) for t in range(40)]


CASES = {
    "few texts": some(1, range(-45, 120), 7, ["a b", "a", "", None]),
    "many texts": some(2, range(300), 5, [f"t {i}" for i in range(40)]),
    "deep": deep(),
    "copies": [(c, t, "user", f"turn {t}") for c in range(0, 4000, 20) for t in range(5)],
    "ties": [(c, t, r, x) for c in range(30) for t, r, x in ((None, "user", "n"), (None, None, "n"), (0, "user", "z"), (0, "user", "a"), (0, "user", "a"), (0, "us", "era"), (7, "user", "é 😀 \t x" * 50))],
    "no id": [(None, 0, "user", "x"), (3, 0, "user", None), (4, 0, None, "")],
    "turnless": [(c, 0, "user", "only turn") for c in range(21, 60)],
}


@pytest.mark.parametrize("name", CASES)
def test_against_sets_of_prefixes(spark, name):
    df = spark.createDataFrame(CASES[name], SCHEMA).withColumn("c", F.lit("x")).withColumn("d", F.lit(1)).withColumn("owner", F.lit(2))
    assert nodes(df.repartition(5)) == plain(CASES[name])


def test_long_conversations_and_large_tables(spark, monkeypatch):
    """Blocks of five turns, packs of three ids, and joins as for tables too large to broadcast."""
    rows = some(4, range(0, 60), 40, ["a", "b c"]) + [(100, t, "user", f"{t % 7}") for t in range(700)] + [(c, t, "user", "same") for c in range(200, 240) for t in range(12)] + [(c, t, "user", f"{t % 7}") for c in (101, 120) for t in range(300 + c)] + deep()
    rows = list({r[:2]: r for r in rows}.values())
    monkeypatch.setattr(prefix_trie, "BLOCK", 5)
    monkeypatch.setattr(prefix_trie, "PACK", 3)
    df = spark.createDataFrame(rows, SCHEMA)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        want = plain(rows)
        assert nodes(df) == want
        monkeypatch.setattr(prefix_trie, "SMALL", 0)
        monkeypatch.setattr(prefix_trie, "FREQUENT", 50)
        assert nodes(df.repartition(3)) == want
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_no_rows(spark):
    assert nodes(spark.createDataFrame([], SCHEMA)) == set()
    assert nodes(spark.createDataFrame([(None, 1, "a", "b")], SCHEMA)) == set()


def test_query_against_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{sf}/conversations.parquet')")
    out = queries.op12_prefix_trie(spark, sf)
    assert {tuple(r) for r in out.collect()} == set(con.execute(f"SELECT {', '.join(out.columns)} FROM ({oracles.PREFIX_TRIE})").fetchall())
