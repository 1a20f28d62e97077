"""What the plans of the queries must and must not hold."""

import re

import pytest

from paragrid.plans import queries as _registered  # noqa: F401
from paragrid.plans.catalog import QUERIES

SF = "/root/testdata/sf0.001"
#: Nearest places, the automaton of source words, and parts of markup are looked at in Python, row by row.
PYTHON = {"nearest_match", "queue_match", "source_remnants", "written_back", "post_processed_parts", "side_parts_back"}


def plan(spark, name):
    return QUERIES[name](spark, SF)._jdf.queryExecution().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_plan(spark, name):
    text = plan(spark, name)
    assert "CartesianProduct" not in text
    assert bool(re.search(r"Python|Pandas|Arrow", text)) == (name in PYTHON), "Python where columns would do, or none where it is needed"
    if "BroadcastNestedLoopJoin" in text:
        assert name in {"forbidden_phrases", "counts_by_check"}  # rule tables, of a checked size


@pytest.mark.parametrize("name, column", [("severity_rollup", "n_chars"), ("rule_counts", "source"), ("tokens_per_doc", "lang"), ("exact_duplicates", "source"), ("detect_language", "source"), ("part_text", "url")])
def test_only_needed_columns_are_read(spark, name, column):
    schemas = re.findall(r"ReadSchema: (\S+)", plan(spark, name))
    assert schemas and not any(column in s for s in schemas)
