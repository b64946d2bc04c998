"""The driver contract without the optional part, or a library that it needs."""

from __future__ import annotations

import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("name", ["ahocorasick", "regex", "tokenizers", "inspectkit.llm", "corpus_pipeline"])
def test_entry_survives_what_is_missing(name):
    code = f"import sys; sys.modules[{name!r}] = None; import __spark_entry__ as e; q = e.queries(); print(len(q), any(k.startswith('op1_') for k in q), set(e.oracle_sql()) <= set(q))"
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)
    count, corpus, subset = done.stdout.split()[-3:]
    assert int(count) >= 75 and (corpus, subset) == ("False", "True"), done.stderr[-500:]
