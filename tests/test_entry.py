"""The entry points without the optional part."""
import subprocess
import sys

import pytest


@pytest.mark.parametrize("missing", ["regex", "corpus_pipeline", "setloom.llm"])
def test_the_rest_stays_when_the_text_part_cannot_be_imported(missing):
    code = (f"import sys; sys.modules[{missing!r}] = None\n"
            "import __spark_entry__ as e\n"
            "names = set(e.queries())\n"
            "assert len(names) > 125 and not any(n.startswith('op1') or n == 'pipeline' for n in names), sorted(names)\n"
            "assert set(e.oracle_sql()) <= names\n")
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    assert "text operators are left out" in done.stderr


def test_every_twin_belongs_to_a_query():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
