"""Texts are cut once, by as many tasks as their bytes need."""

import re

from loomset.functions import text
from loomset.plans import catalog
from tests.oracle import assert_same, connection


def test_texts_are_dealt_to_tasks_before_they_are_cut(spark, sf, monkeypatch):
    monkeypatch.setattr(text, "TASK", 64 << 10)
    for name in ("str2_rebuilt", "str2_treebank"):
        df = catalog.QUERIES[name](spark, sf)
        assert df.rdd.getNumPartitions() >= 4
    assert_same(df, connection(sf), catalog.SQL[name])


def test_no_filter_cuts_texts_again(spark, sf):
    for name in ("str2_words_of_sentences", "str2_sentences"):
        plan = catalog.QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
        assert not [x for x in plan.splitlines() if re.match(r"\W*Filter", x) and "array_join" in x]
