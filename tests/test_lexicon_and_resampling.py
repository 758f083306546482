import http.server
import random
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from cantata.operators import joins, lexicon, resampling
from cantata.sources import files


def plain_left(word, scores):
    """A walk over all left parts with a dictionary."""
    if len(word) <= 2:
        return len(word)
    return max((scores.get(word[:k], 0.0), k) for k in range(2, len(word) + 1))[1]


def test_trie_against_a_dictionary():
    rng = random.Random(1)
    for alphabet in ("ab", "abc가나다\U0001f600"):
        scores = {"".join(rng.choices(alphabet, k=rng.randrange(1, 6))): rng.choice([0.5, 1.0, -1.0, 0.0]) for _ in range(60)}
        trie = lexicon.Trie(list(scores), list(scores.values()))
        words = ["".join(rng.choices(alphabet, k=rng.randrange(0, 12))) for _ in range(2000)]
        assert trie.left_sizes(words).tolist() == [plain_left(w, scores) for w in words]
    empty = lexicon.Trie([], [])
    assert empty.left_sizes(["", "a", "abc"]).tolist() == [0, 1, 3] and lexicon.Trie(["ab"], [1.0]).left_sizes([]).tolist() == []


def test_words_by_trie_and_by_join(spark, monkeypatch):
    known = spark.createDataFrame([("학교", 1.0), ("학교에", 0.4), ("먹", 1.0), ("친구", 1.0), ("친구", 0.1), ("친구들", 1.0), ("", 9.0), (None, 9.0), ("x", None)], "word string, score double")
    rows = [(1, "학교에서 먹다 친구들과"), (2, None), (3, "  "), (4, "모르는말 ab 학교"), (4, "학교에서! don't"), (5, "친구는 " * 300)]
    df = spark.createDataFrame(rows, "id int, text string").withColumn("size", F.lit("kept")).withColumn("score", F.lit(1))
    want = [(1, ["학교", "에서", "먹다", "친구들", "과"]), (2, []), (3, []), (4, ["모르는말", "ab", "학교"]), (4, ["학교", "에서", "don't"]), (5, ["친구", "는"] * 300)]
    got = lexicon.words_by_lexicon(df, "text", known, score="score")
    assert got.columns == [*df.columns, "words"] and sorted((r.id, r.words) for r in got.collect()) == sorted(want)
    for limit, small in ((-1, joins.SMALL), (-1, 0)):
        monkeypatch.setattr(lexicon, "MOST_CHARS", limit)
        monkeypatch.setattr(joins, "SMALL", small)
        assert sorted((r.id, r.words) for r in lexicon.words_by_lexicon(df, "text", known, score="score").collect()) == sorted(want)
    assert lexicon.words_by_lexicon(df.where("false"), "text", known).count() == 0
    monkeypatch.undo()
    assert lexicon.words_by_lexicon(df.where("id = 1"), "text", known.where("false")).first().words == ["학교에서", "먹다", "친구들과"]


def test_all_part_names(spark):
    parts = spark.read.parquet("/root/testdata/sf0.01/part.parquet")
    names = [r.p_name.replace(" ", "") for r in parts.collect()]
    scores = {n[: 3 + len(n) % 4]: (len(n) % 3) / 2 for n in names}
    assert lexicon.Trie(list(scores), list(scores.values())).left_sizes(names).tolist() == [plain_left(n, scores) for n in names]


def direct(x, rate, target, zeros=resampling.ZEROS):
    """Each new sample as a sum over all old ones."""
    cutoff = resampling.BAND * min(1, target / rate)
    reach = int(np.ceil(zeros / cutoff))
    out = []
    for m in range(-(-len(x) * target // rate)):
        at = m * rate / target
        k = np.arange(int(at) - reach - 2, int(at) + reach + 3)
        h = resampling.kernel(k - at, cutoff, zeros)
        inside = (k >= 0) & (k < len(x))
        out.append((h[inside] * np.asarray(x, float)[k[inside]]).sum() / h.sum())
    return np.array(out)


@pytest.mark.parametrize("rate,target", [(44_100, 16_000), (48_000, 16_000), (8_000, 16_000), (22_050, 16_000), (11_025, 16_000), (16_000, 44_100), (7, 3), (96_000, 16_000)])
def test_resampling_is_the_direct_sum(rate, target):
    rng = np.random.default_rng(2)
    for n in (1, 2, 50, 700):
        x = rng.normal(size=n).astype(np.float32)
        got, want = resampling.resample(x, rate, target), direct(x, rate, target)
        assert len(got) == len(want) == -(-n * target // rate) and np.allclose(got, want, atol=1e-5)


def test_tones_pass_or_vanish():
    t = np.arange(48_000) / 48_000
    low, high = np.sin(2 * np.pi * 1000 * t), np.sin(2 * np.pi * 11_000 * t)
    got = resampling.resample(low, 48_000, 16_000)[500:-500]
    assert np.abs(got - np.sin(2 * np.pi * 1000 * np.arange(16_000) / 16_000)[500:-500]).max() < 1e-3
    assert np.abs(resampling.resample(high, 48_000, 16_000)[500:-500]).max() < 1e-3
    assert np.allclose(resampling.resample(np.ones(5000, np.float32), 44_100, 16_000)[50:-50], 1.0, atol=1e-6)
    assert resampling.resample([], 8000, 16_000).tolist() == [] and resampling.resample([1.0], 8, 8).tolist() == [1.0]


def test_rows(spark):
    df = spark.createDataFrame([(1, [0.5] * 400, 8000, "x"), (2, None, 8000, "x"), (3, [], 44_100, "x"), (4, [1.0, None], 16_000, "x"), (5, [1.0], None, "x")], "id int, wave array<double>, sr int, samples string")
    out = {r.id: r for r in resampling.resample_rows(df, "wave", "sr", 16_000).collect()}
    assert len(out[1].wave) == 800 and abs(out[1].wave[400] - 0.5) < 1e-4 and out[2].wave is None and out[3].wave == [] and out[4].wave == [1.0, 0.0] and out[5].wave is None
    assert {r.sr for r in out.values()} == {16_000} and out[1].samples == "x"


def test_fetching_urls():
    asked = []

    class Replies(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            asked.append(self.path)
            self.send_response(200 if self.path != "/none" else 404)
            self.end_headers()
            self.wfile.write(b"body" + self.path.encode())

        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Replies)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        base = f"http://127.0.0.1:{server.server_port}"
        assert files.http_fetch([f"{base}/a", f"{base}/none", f"{base}/b", f"{base}/a", "file:///etc/hosts", "http://127.0.0.1:1/x", "http://"]) == [b"body/a", None, b"body/b", b"body/a", None, None, None]
        assert sorted(asked) == ["/a", "/b", "/none"] and files.http_fetch([]) == []
    finally:
        server.shutdown()
