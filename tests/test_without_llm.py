"""The library without its llm folders."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_imports_without_llm(tmp_path):
    shutil.copytree(os.path.join(ROOT, "folioscan"), tmp_path / "folioscan", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'pipeline' not in q and not any(x.startswith('op') for x in q) and len(q) > 30; assert set(e.oracle_sql()) <= set(q)"
    for pipeline in (False, True):  # its file may go or stay
        if pipeline and os.path.exists(os.path.join(ROOT, "corpus_pipeline.py")):
            shutil.copy(os.path.join(ROOT, "corpus_pipeline.py"), tmp_path)
        subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})


def test_library_works_without_llm(tmp_path):
    """Its tests, those that are soonest done, pass in a copy without the folders."""
    shutil.copytree(ROOT, tmp_path / "repo", ignore=shutil.ignore_patterns("llm", "__pycache__", ".git", "corpus_pipeline.py"))
    ran = subprocess.run([sys.executable, "-m", "pytest", "-q", "-x", "tests/test_library.py", "tests/test_oracle.py", "-k", "stemmer or access or vectors or paged_count or entry"], cwd=tmp_path / "repo", capture_output=True, text=True, env={**os.environ, "PYTHONPATH": str(tmp_path / "repo")})
    assert ran.returncode == 0, ran.stdout[-2000:]


def test_nothing_else_imports_llm():
    for folder, _, names in os.walk(os.path.join(ROOT, "folioscan")):
        if os.path.basename(folder) != "llm":
            for name in names:
                if name.endswith(".py"):
                    with open(os.path.join(folder, name)) as f:
                        assert "folioscan.llm" not in f.read(), name
