"""The registered queries of the subpackage."""

import __spark_entry__ as entry
import corpus_pipeline
from dwell.llm import oracle, queries


def test_registered():
    found = entry.queries()
    names = [f"op{n}_" for n in range(1, 14)]
    assert all(sum(q.startswith(n) for q in found) == 1 for n in names) and "pipeline" in found
    assert set(queries.all_queries()) <= set(found) and set(oracle.all_sql()) <= set(entry.oracle_sql())
    assert len(corpus_pipeline.STAGES) == 5
