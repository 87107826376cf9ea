"""The stages on a small table next to plain versions of each."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from semgraph.llm import pieces, quality
from tests.llm.test_dedup import brute


@pytest.fixture(scope="module")
def kept(spark, sf_of_copies):
    """Rows after each stage, by name."""
    docs, rows = spark.read.parquet(f"{sf_of_copies}/documents.parquet"), {}
    rows["documents"] = [tuple(r) for r in docs.collect()]
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_of_copies)
        docs.write.mode("overwrite").parquet(f"{sf_of_copies}/{name}")
        docs = spark.read.parquet(f"{sf_of_copies}/{name}")
        rows[name] = [tuple(r) for r in docs.collect()]
    rows["columns"] = docs.columns
    return rows


@pytest.fixture(scope="module")
def sf_of_copies(spark, small_sf, tmp_path_factory):
    """The small tables with near copies, an empty and a null text added."""
    to = str(tmp_path_factory.mktemp("sf"))
    docs = spark.read.parquet(f"{small_sf}/documents.parquet")
    near = docs.filter("doc_id % 7 = 0 AND n_chars > 900").withColumn("doc_id", F.col("doc_id") + 10_000).withColumn(
        "text", F.regexp_replace("text", "^(\\S+ \\S+ \\S+) \\S+", "$1 altered"))
    odd = docs.limit(2).withColumn("doc_id", F.col("doc_id") + 20_000).withColumn(
        "text", F.when(F.col("doc_id") == 20_000, "").otherwise(F.lit(None)))
    docs.unionByName(near).unionByName(odd).write.parquet(f"{to}/documents.parquet")
    spark.read.parquet(f"{small_sf}/benchmark.parquet").write.parquet(f"{to}/benchmark.parquet")
    return to


def test_quality_stage_drops_what_the_query_rejects(spark, sf_of_copies, kept):
    judged = {r.doc_id for r in quality.op8(spark, sf_of_copies).collect() if r.kept}
    assert {r[0] for r in kept["quality_rules"]} == judged
    assert set(kept["quality_rules"]) <= set(kept["documents"])


def test_line_stage(kept):
    def key(line):
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\f\r"))
    holders = Counter()
    largest = {}
    for doc, text, *_ in kept["quality_rules"]:
        for k in {key(x) for x in text.split("\n")}:
            holders[k] += 1
            largest[k] = max(doc, largest.get(k, doc))
    want = set()
    for doc, text, lang, source, _ in kept["quality_rules"]:
        left = "\n".join(x for x in text.split("\n")
                         if not (len(key(x)) >= 20 and holders[key(x)] >= 3 and largest[key(x)] != doc))
        want.add((doc, left, lang, source, len(left)))
    assert set(kept["line_dedup"]) == want and len(kept["line_dedup"]) == len(want)


def test_near_duplicate_stage(kept):
    def shingles(text):
        words = re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
        return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
    rows = sorted((r[0], shingles(r[1])) for r in kept["line_dedup"])
    root = {d: d for d, _ in rows}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d
    for i, (a, x) in enumerate(rows):
        for b, y in rows[:i]:
            if len(x & y) >= 0.8 * len(x | y):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    want = {d for d, _ in rows if find(d) == d}
    assert any(find(d) != d for d, _ in rows)
    assert {r[0] for r in kept["simhash_dedup"]} == want
    assert set(kept["simhash_dedup"]) <= set(kept["line_dedup"])


def test_decontamination_stage(spark, sf_of_copies, kept):
    items = [tuple(r) for r in spark.read.parquet(f"{sf_of_copies}/benchmark.parquet").collect()]
    found = brute([r[:2] for r in kept["simhash_dedup"]], items, 10)
    assert any(hits for _, hits, _ in found.values())
    assert set(kept["decontamination"]) == {r for r in kept["simhash_dedup"] if not found[r[0]][1]}


def test_sentencepiece_stage(kept):
    import sentencepiece
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    assert kept["columns"][-3:] == ["ids", "n_tokens", "decoded"]
    assert len(kept["sentencepiece"]) == len(kept["decontamination"]) > 0
    for *_, text, lang, source, n_chars, ids, n_tokens, decoded in kept["sentencepiece"]:
        want = library.encode(text, add_eos=True)
        assert (ids, n_tokens, decoded) == (want, len(want), library.decode(want))


def test_run_is_the_stages(spark, sf_of_copies, kept):
    assert {r.doc_id for r in corpus_pipeline.run(spark, sf_of_copies).collect()} == {r[0] for r in kept["sentencepiece"]}


def test_empty_table_nulls_and_extra_columns(spark, sf_of_copies, tmp_path):
    docs = spark.read.parquet(f"{sf_of_copies}/documents.parquet")
    none = F.lit(None).cast("string")
    odd = docs.limit(0).unionByName(spark.createDataFrame(
        [(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, "word " * 50_000, "en", "s", 250_000)],
        docs.schema))
    odd = odd.withColumns({"signals": none, "body": none, "ids": none, "gone": none, "found": none, "drop": none})
    for rows, least in ((odd.limit(0), 0), (odd, 0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, rows, sf_of_copies)
            assert out.count() >= least
            if name != "sentencepiece":
                assert out.columns == rows.columns
