"""Every query of the engine runs at sf0.001 and gives what its SQL gives."""

from pathlib import Path

import numpy as np
import pandas as pd
import pytest

from quarrystone import catalogue
from quarrystone.operators import search
from quarrystone.plans import budget
from quarrystone.queries.vectors import circle
from tests.compare import assert_same, duck

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="the driver's tables aren't here")


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_matches_sql(spark, name):
    assert_same(catalogue.queries()[name](spark, SF).toPandas(), duck(SF, catalogue.oracle_sql()[name]))


@pytest.mark.parametrize("name", ["ann_recall", "ann_recall_generated"])
def test_recall(spark, name):
    """Of every row whose number is divisible by 50, against brute force."""
    rows = catalogue.queries()[name](spark, SF).collect()
    assert sum(r.recall for r in rows) / len(rows) >= 0.9
    assert name == "ann_recall" or len(rows) == 416


def test_auto_is_exact_beyond_the_small_limit(spark, tmp_path):
    """A table of more vectors than are searched exactly by default."""
    v = np.random.default_rng(0).normal(size=(budget.SMALL + 400, 64))
    e = pd.DataFrame({"vec_id": range(len(v)), "embedding": list(v.astype("float32")), "label": 1})
    e.to_parquet(tmp_path / "embeddings.parquet")
    assert_same(catalogue.queries()["vec_auto_small_corpus"](spark, str(tmp_path)).toPandas(), duck(str(tmp_path), catalogue.oracle_sql()["vec_auto_small_corpus"]))


def test_filtered_candidates_are_widened(spark):
    rows = catalogue.queries()["ann_filtered_generated"](spark, SF).collect()
    assert len(rows) == 10 and {r.cohort for r in rows} == {"b"}
    r = circle(spark).filter("cohort = 'b'")
    true = search.exact(r, list(circle(spark).filter("i = 7300").first()["values"]), 10).collect()
    assert len({x.id for x in rows} & {x.id for x in true}) >= 9


def test_every_query_has_sql_or_is_listed(spark):
    assert set(catalogue.queries()) - set(catalogue.oracle_sql()) == {"ann_large", "exact_large", "ann_recall", "ann_recall_generated", "ann_filtered_generated"}
