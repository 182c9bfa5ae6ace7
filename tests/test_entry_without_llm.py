"""The entry and the deal queries work where the training-data package is not installed."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
BLOCKED = """
import sys
class Blocked:
    def find_spec(self, name, path=None, target=None):
        if name in {names!r} or any(name.startswith(n + ".") for n in {names!r}):
            raise ModuleNotFoundError(f"No module named {{name!r}}", name=name)
sys.meta_path.insert(0, Blocked())
import __spark_entry__ as e
print(len(e.queries()), len(e.oracle_sql()), "pipeline" in e.queries(), any(q.startswith("op") for q in e.queries()))
"""


def names(*blocked):
    run = subprocess.run([sys.executable, "-c", BLOCKED.format(names=blocked)], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert run.returncode == 0, run.stderr
    return run.stdout.split()[2:]


def test_without_the_package_or_the_pipeline():
    assert names("dealflow.llm", "corpus_pipeline") == ["False", "False"]
    assert names("dealflow.llm") == ["False", "False"]
    assert names("corpus_pipeline")[0] == "False"


def test_other_missing_modules_are_not_hidden():
    run = subprocess.run([sys.executable, "-c", BLOCKED.format(names=("dealflow.functions.loan",))], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert run.returncode != 0 and "dealflow.functions.loan" in run.stderr
