"""The registered queries against their SQL."""

import pytest
from compare import compare, connect

import corpus_pipeline
from lanewise.llm import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_query_as_its_sql(spark, sf, name):
    assert compare(spark, connect(sf), catalogue.QUERIES[name], catalogue.ORACLE[name], sf) is None


def test_names():
    assert [n.split("_")[0] for n in catalogue.QUERIES] == [f"op{k}" for k in range(1, 14)]
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "language_id", "exact_dedup", "near_dedup", "decontamination", "bpe"]
