"""Flags of similar pairs come from what the join carries: texts are parsed once, and no pair is sent for its words."""

import pytest

from plaintide.plans import records


@pytest.mark.parametrize("name", ["join_strong", "join_subject", "join_subject_sets"])
def test_texts_are_not_parsed_again(spark, name):
    plan = getattr(records, name)(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "regexp_extract_all" not in plan and "documents" not in plan
