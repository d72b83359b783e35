"""The registered queries against their SQL, and the pipeline against plain Python."""

from collections import Counter
from pathlib import Path

import pytest

import corpus_pipeline
from quarrystone.llm.quality_rules import STOP_WORDS
from quarrystone.llm.queries import QUERIES, SQL
from tests.compare import assert_same, duck

from . import brute

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="the driver's tables aren't here")


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, name):
    assert_same(QUERIES[name](spark, SF).toPandas(), duck(SF, SQL[name]))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_other_queries_cover_the_table(spark, name):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert sorted(r.doc_id for r in QUERIES[name](spark, SF).collect()) == sorted(r.doc_id for r in docs.collect())


def test_pipeline(spark):
    """Each stage as plain Python has it: which documents come out, and how often; sharding by its law."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    rows = [r for r in rows if brute.judged(r[1], STOP_WORDS)]
    alone = brute.near([r[:2] for r in rows], 5)
    rows = [r for r in rows if alone[r[0]][2]]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    dirty = [x[1] > 0 for x in brute.contamination([r[1] for r in rows], items)]
    rows = [r for r, d in zip(rows, dirty, strict=True) if not d]
    want = {r[0]: n for r, n in zip(rows, brute.mixed(rows)[0], strict=True) if n}

    out = corpus_pipeline.run(spark, SF).collect()
    assert Counter(r.doc_id for r in out) == want and len(want) > 20
    n = Counter(r.shard for r in out)
    assert max(n.values()) - min(n.values()) <= 1
    for s in n:
        assert sorted(r.slot for r in out if r.shard == s) == list(range(n[s]))
    texts = {r[0]: r[1] for r in rows}
    assert all(r.size == len(texts[r.doc_id].encode()) + 1 for r in out)


def test_a_short_passage_in_a_long_document(spark, tmp_path):
    """A passage of the benchmark condemns a document of any length."""
    words = [f"w{i}" for i in range(2000)]
    docs = spark.createDataFrame([(1, " ".join(words[:1000] + ["x", *(f"q{i}" for i in range(13)), "y"] + words[1000:]), "en", "s", 1), (2, " ".join(words), "en", "s", 1), (3, " ".join(f"q{i}" for i in range(12)), "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(7, " ".join(f"q{i}" for i in range(20)))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert sorted(r.doc_id for r in corpus_pipeline.benchmark_decontamination(spark, docs, str(tmp_path)).collect()) == [2, 3]


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_on_odd_rows(spark, name, stage):
    """Nulls in any column, empty texts, repeated rows and ids, an empty table."""
    form = "doc_id long, text string, lang string, source string, n_chars long"
    text = "the cat sat on the mat and looked at a bird that was far away in one of the tall old trees near the river"
    rows = [(1, text, "en", "a", 1), (1, text, "en", "a", 1), (1, "the " + text.replace("cat", "dog"), "en", None, 1), (None, text, None, None, None), (None, None, None, None, None), (2, "", "en", "b", 0), (3, text + " once more", "en", "b", 1)]
    docs = spark.createDataFrame(rows, form)
    got = stage(spark, docs, SF).collect()
    assert stage(spark, docs.limit(0), SF).collect() == []
    texts = [r.text for r in got] if name != "sharding" else None
    if name == "quality_rules":
        assert len(got) == 5 and all(texts)
    elif name == "minhash_near_dedup":  # copies go, whatever their ids; texts without words stay
        assert sorted(t or "" for t in texts if not t or t == text) == ["", "", text]
    elif name == "benchmark_decontamination":
        assert len(got) == 7
    elif name == "mixing_to_targets":
        assert Counter(texts).keys() <= {r[1] for r in rows if r[1]}
    else:
        assert len(got) == 7 and Counter(r.shard for r in got) == Counter(range(7))
