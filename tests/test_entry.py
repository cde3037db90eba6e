"""The entry module without the training-data subpackage: everything else is there."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

GONE = """
import importlib.abc, sys

class Gone(importlib.abc.MetaPathFinder):
    def find_spec(self, name, path=None, target=None):
        if name == "corpus_pipeline" or name == "tabulant.llm" or name.startswith("tabulant.llm."):
            raise ModuleNotFoundError(f"No module named {name!r}", name=name)

sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
from tabulant.plans.catalog import QUERIES
assert set(e.queries()) == set(QUERIES) == set(e.oracle_sql()), sorted(e.queries())
print("fine")
"""


def test_entry_without_the_subpackage():
    out = subprocess.run([sys.executable, "-c", GONE], cwd=ROOT, capture_output=True, text=True)
    assert out.stdout.strip() == "fine", out.stderr
