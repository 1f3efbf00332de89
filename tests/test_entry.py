"""The driver's contract, with and without the optional subpackage."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent

WITHOUT = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name.startswith("sourcegrain.llm") or name == "corpus_pipeline":
            raise ModuleNotFoundError(name, name=name)  # as the import system raises it
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
assert e.queries() and e.oracle_sql() and not any(n.startswith("op") and n[2].isdigit() for n in e.queries()) and "pipeline" not in e.queries()
"""


def test_entry_imports_without_the_subpackage():
    subprocess.run([sys.executable, "-c", WITHOUT], cwd=ROOT, check=True)


def test_sql_belongs_to_queries():
    sys.path.insert(0, str(ROOT))
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_entry_gives_rows(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.columns == ["claim_id", "passage_id", "rank", "score"] and df.count() > 0


def test_nothing_outside_imports_the_subpackage():
    for path in (ROOT / "sourcegrain").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert "sourcegrain.llm" not in path.read_text(), path
