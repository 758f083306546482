import re

import numpy as np
import pytest

import corpus_pipeline
from cantata.llm import secrets, toxicity
from cantata.llm.queries import vocabulary_path
from tests.llm import brute

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def mask(text):
    found = [(int(a), int(b)) for a, b in (x.split(":")[1:] for x in brute.secrets(text)[1].split(",") if x)]
    out, at, last = "", 0, -1
    for a, b in sorted(found):
        if a > last:
            out += text[at:a] + corpus_pipeline.MASK
        last = max(last, b)
        at = max(at, b)
    return out + text[at:]


def test_against_brute_force(spark):
    tiktoken = pytest.importorskip("tiktoken")
    from cantata.llm.bpe import Codec, read_vocabulary
    import public_tokenizers as P

    encoding = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=Codec(read_vocabulary(vocabulary_path())).ranks, special_tokens={})
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    toxic = {r.doc_id for r in toxicity.classify(docs, spark.read.parquet(f"{SF}/labels.parquet")).where("predicted = 1").collect()}
    rows = [(r.doc_id, r.text) for r in docs.orderBy("doc_id").collect() if r.doc_id not in toxic]
    stay = {d for d, _, _, kept in brute.near_duplicates(rows, 5) if kept}
    rows = [r for r in rows if r[0] in stay]
    hit = brute.contamination(rows, [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()])
    rows = [r for r in rows if not hit[r[0]][4]]
    assert not any(all(re.search(c, m[0]) for c in secrets.MIXED) for _, t in rows for m in re.finditer(secrets.OPAQUE[1], t))
    want = {d: encoding.encode_ordinary(mask(t)) for d, t in rows}
    out = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id: list(r.ids) for r in out} == want and len(out) == len(want)
    assert {r.doc_id: r.ids_sha256 for r in out} == {d: brute.sha(np.array(x, "<u4").tobytes()) for d, x in want.items()}


def test_stages_handle_odd_rows(spark):
    odd = [(None, None, None, None, None), (1, "", "en", "s", 0), (2, 'a token = "abcdefghij" b secret: zzzzzzzzz', "en", None, 7), (2, 'a token = "abcdefghij" b secret: zzzzzzzzz', "en", None, 7), (3, "plain text of some words", None, "s", None)]
    docs = spark.createDataFrame(odd, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == COLUMNS and out.schema["n_chars"].dataType == docs.schema["n_chars"].dataType, name
        assert len(out.collect()) == 5, name
        assert stage(spark, docs.where("false"), SF).count() == 0
    masked = corpus_pipeline.mask_secrets(spark, docs, SF).where("doc_id = 2").first()
    assert masked.text == mask(odd[2][1]) and masked.n_chars == len(masked.text)


def left(stage, spark, rows):
    docs = spark.createDataFrame([(d, t, "en", "s", 0) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return sorted(((r.doc_id, r.text) for r in stage(spark, docs, SF).collect()), key=str)


def test_rejected_rows_take_no_others_with_their_id(spark):
    x, y, z, w = (" ".join(f"{c}{i}" for i in range(40)) for c in "xyzw")
    item = next(r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() if len(r.text.split()) > 10)
    assert left(corpus_pipeline.drop_contaminated, spark, [(None, item), (None, x), (7, item), (7, y), (None, z)]) == sorted([(None, x), (None, z), (7, y)], key=str)
    rows = [(5, x), (5, y), (3, y), (None, y), (None, z), (None, z), (None, z + " more"), (None, w), (None, ""), (None, "")]
    got = left(corpus_pipeline.drop_near_duplicates, spark, rows)
    one = [r for r in got if (r[1] or "").startswith("z0")]
    assert len(one) == 1 and [r for r in got if r not in one] == sorted([(5, x), (3, y), (None, w), (None, ""), (None, "")], key=str)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    judged = {r.doc_id: r.predicted for r in toxicity.classify(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect()}
    rows = [(r.doc_id, r.text) for r in docs.orderBy("doc_id").collect()]
    bad, good = (next(t for d, t in rows if judged[d] == k) for k in (1, 0))
    got = left(corpus_pipeline.drop_toxic, spark, rows + [(None, bad), (None, good), (None, None)])
    assert {t for d, t in got if d is None} == {good, None}


def test_long_texts_and_columns_of_any_name(spark):
    """A text of 300,000 words, nulls, and columns named as those that the operators make."""
    sf = "/root/testdata/sf0.001"
    base = spark.read.parquet(f"{sf}/documents.parquet").limit(20)
    long = " ".join(f"w{i % 997}" for i in range(300_000))
    rows = [(10**6, long, "en", "x", len(long)), (10**6 + 1, None, None, None, None)]
    docs = base.unionByName(spark.createDataFrame(rows, base.schema)).selectExpr("*", "1 AS score", "'h' AS hash", "2 AS row", "3 AS found", "'i' AS ids")
    for some in (docs, docs.where("false")):
        columns, now = some.columns, some
        for name, stage in corpus_pipeline.STAGES[:-1]:
            now = stage(spark, now, sf)
            assert now.columns == columns, name
            kept = {r.doc_id: r.text for r in now.collect()}
            assert (kept[10**6], kept[10**6 + 1]) == (long, None) if some is docs else not kept
        out = {r.doc_id: r.n_tokens for r in corpus_pipeline.encode(spark, now, sf).collect()}
        assert not out if some is not docs else out[10**6] > 300_000 and out[10**6 + 1] == 0
