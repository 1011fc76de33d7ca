"""The transforms stand alone: without the training-data subpackage everything else is still registered."""

import subprocess
import sys
from pathlib import Path

CODE = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name.startswith("chirpsieve.llm") or name == "corpus_pipeline":
            raise ModuleNotFoundError(name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
assert not [q for q in e.queries() if q.startswith("op") or q == "pipeline"], list(e.queries())
assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 20
import chirpsieve.api, chirpsieve.streaming.blocks, chirpsieve.sources.reports
"""


def test_without_llm():
    out = subprocess.run([sys.executable, "-c", CODE], cwd=Path(__file__).resolve().parents[1], capture_output=True, text=True)
    assert out.returncode == 0, out.stderr[-800:]
