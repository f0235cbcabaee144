"""The entry module without the parts that may be missing."""

import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("missing", ["public_tokenizers", "dwell.llm", "corpus_pipeline"])
def test_core_queries_load_without(missing):
    code = f"""
import sys
sys.modules[{missing!r}] = None
import __spark_entry__ as entry
names = entry.queries()
assert len(names) >= 84 and "ses_build" in names and set(entry.oracle_sql()) <= set(names)
assert not any(n.startswith("op") or n == "pipeline" for n in names)
"""
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
