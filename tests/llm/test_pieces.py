import hashlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from semgraph.llm import pieces

TEXTS = ["", None, " ", "  ", "a", " a", "a ", "Hello  world.\nNew line\t tab ", "▁x ▁", "naïve façade 東京 ﬁ 🙂🙂",
         "<s> </s> <0x0A>", "aaaaaaaaaaaaaaaaaaa", "x" * 3000, "\n\n\r\n", "a\x00b", " " * 40 + "z", "Straße 12.34 e-mail@x.org",
         "hellohello   nbsp", "▁" * 5, "The the THE theatre theory there"]


@pytest.fixture(scope="module")
def library():
    import sentencepiece
    return sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_ids_and_decoded_text_are_the_librarys(spark, library):
    rows = frame(spark, TEXTS).withColumn("ids", pieces.encode(F.col("text"))).withColumn(
        "back", pieces.decode(F.col("ids"))).collect()
    for row in rows:
        ids = library.encode(row.text or "", add_eos=True)
        assert row.ids == ids, row.text
        assert row.back == library.decode(ids), row.text


def test_every_prefix_count_is_the_librarys(spark, library):
    texts = [t for t in TEXTS if t is None or len(t) < 200] + [
        "Of haenneed tionthe, unbelievably internationalization\nre-entrant", "ououerthanthntndre éauouètion"]
    for row in frame(spark, texts).withColumn("c", pieces.prefix_counts(F.col("text"))).collect():
        text = row.text or ""
        assert row.c == [len(library.encode(text[:k])) for k in range(len(text) + 1)], text


def test_budget(spark, library):
    rows = frame(spark, TEXTS).withColumn("t", pieces.token_count(F.col("text"), 5)).collect()
    for row in rows:
        text = row.text or ""
        counts = [len(library.encode(text[:k])) for k in range(len(text) + 1)]
        assert row.t.n_tokens == counts[-1]
        assert row.t.fit_chars == max(k for k, c in enumerate(counts) if c <= 5)


def test_queries_against_the_library(spark, library, small_sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{small_sf}/documents.parquet").collect()}
    coded = pieces.op4(spark, small_sf).collect()
    assert len(coded) == len(docs)
    for r in coded:
        ids = library.encode(docs[r.doc_id] or "", add_eos=True)
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
    for r in pieces.op7(spark, small_sf).collect():
        n = len(library.encode(docs[r.doc_id] or ""))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((docs[r.doc_id] or "").encode()), n, n > 4096)


def test_empty_table_and_clashing_columns(spark):
    docs = frame(spark, ["a b"]).withColumn("ids", F.lit("own")).withColumn("n_tokens", F.lit(7))
    out = pieces.encode_documents(docs)
    row = out.first()
    assert row.ids == "own" and row.n_tokens == 7 and row["_n_tokens"] == len(row["_ids"]) == 3
    assert pieces.encode_documents(docs.limit(0)).count() == 0
    assert frame(spark, ["q"]).limit(0).select(pieces.token_count(F.col("text"), 3)).count() == 0


@pytest.mark.parametrize("operator", [pieces.encode, pieces.round_trip])
def test_results_go_back_portion_by_portion(monkeypatch, library, operator):
    made, real = [], F.arrow_udf
    monkeypatch.setattr(pieces.F, "arrow_udf", lambda kind: lambda f: made.append(f) or real(kind)(f))
    monkeypatch.setattr(pieces, "PORTION", 100)
    operator(F.col("text"))
    parts = list(made[0](iter([pa.array([], pa.string()), pa.array(TEXTS), pa.array(["q"])])))
    assert len(parts) > 3 and max(map(len, parts)) < len(TEXTS)
    want = [library.encode(text or "", add_eos=True) for text in [*TEXTS, "q"]]
    got = [row for part in parts for row in part.to_pylist()]
    assert [row["ids"] if isinstance(row, dict) else row for row in got] == want
    assert all(row["decoded"] == library.decode(ids) for row, ids in zip(got, want) if isinstance(row, dict))
