"""The driver's entry points without the training-data subpackage."""

import subprocess
import sys

PROGRAM = """
import sys
class Missing:
    def find_spec(self, name, path=None, target=None):
        if name == {name!r}:
            raise ModuleNotFoundError(f"No module named {{name!r}}", name=name)
sys.meta_path.insert(0, Missing())
import __spark_entry__ as api
names = set(api.queries())
assert "req_extract" in names and not [n for n in names if n[:2] == "op" and n[2].isdigit() or n == "pipeline"]
assert set(api.oracle_sql()) <= names
"""


def test_without_the_subpackage_or_a_library_of_its_own():
    for name in ("clauseloom.llm", "xxhash"):
        done = subprocess.run([sys.executable, "-c", PROGRAM.format(name=name)], capture_output=True, text=True, timeout=120)
        assert done.returncode == 0, done.stderr
