"""The registry with and without the subpackage for texts."""

import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("missing", ["tablescout.llm", "xxhash", "corpus_pipeline"])
def test_other_queries_stay_if_the_texts_cannot_be_imported(missing):
    code = f"import sys; sys.modules[{missing!r}] = None; import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), any(q.startswith('op1') for q in e.queries()), 'pipeline' in e.queries())"
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr[-2000:]
    queries, oracles, texts, pipeline = done.stdout.split()
    assert int(queries) > 200 and int(oracles) > 190 and (texts, pipeline) == ("False", "False")
