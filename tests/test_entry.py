import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_entry_runs(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.columns == ["doc_id", "n_spans", "masked_text"]
    assert df.count() == 200
    assert set(e.oracle_sql()) <= set(e.queries())


def test_works_without_the_subpackage(tmp_path):
    """A copy without brakta/llm and the pipeline still imports and lists the other queries."""
    import shutil

    shutil.copytree(ROOT / "brakta", tmp_path / "brakta", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'mask_documents' in q and 'pipeline' not in q and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})


def test_nothing_else_imports_the_subpackage():
    for f in (ROOT / "brakta").rglob("*.py"):
        if "llm" not in f.relative_to(ROOT).parts:
            assert "brakta.llm" not in f.read_text(), f
