import re
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_entry_returns_rows(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_entry_works_without_the_training_data_package():
    code = (
        "import sys\n"
        "class No:\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name in ('tidelog.llm', 'corpus_pipeline'): raise ModuleNotFoundError(name)\n"
        "sys.meta_path.insert(0, No())\n"
        "import __spark_entry__ as e\n"
        "q = e.queries(); assert 'fct_payment' in q and not any(n.startswith('op') for n in q), list(q)\n"
    )
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


def test_nothing_else_imports_the_training_data_package():
    for p in (ROOT / "tidelog").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT).parts:
            assert not re.search(r"^\s*(from|import)\b.*\bllm\b", p.read_text(), re.M), p


def test_errors_inside_the_training_data_package_are_raised(tmp_path):
    (tmp_path / "corpus_pipeline.py").write_text("import no_such_module\n")
    (tmp_path / "__spark_entry__.py").write_text((ROOT / "__spark_entry__.py").read_text())
    code = f"import sys; sys.path.insert(0, {str(ROOT)!r}); sys.path.insert(0, {str(tmp_path)!r}); import __spark_entry__"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True)
    there = (ROOT / "tidelog" / "llm").exists()
    assert (done.returncode != 0 and "no_such_module" in done.stderr) if there else done.returncode == 0
