"""The entry points, with and without the operators that may be taken away."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_entry(spark, sf_dir):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


def test_core_stands_alone(tmp_path):
    for name in ("seqloom", "__spark_entry__.py", "corpus_pipeline.py"):
        if not (ROOT / name).exists():
            continue
        copy = shutil.copytree if (ROOT / name).is_dir() else shutil.copy
        copy(ROOT / name, tmp_path / name)
    shutil.rmtree(tmp_path / "seqloom" / "llm", ignore_errors=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'kmer_stats' in q and not [x for x in q if x.startswith('op') or x == 'pipeline']; assert set(e.oracle_sql()) <= set(q)"
    found = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin"}, capture_output=True, text=True)
    assert found.returncode == 0, found.stderr


def test_the_other_tests_stand_alone(tmp_path):
    """Without both folders of the operators and the pipeline all tests can be collected, and some run."""
    for name in ("seqloom", "tests", "__spark_entry__.py", "bench.py"):
        if (ROOT / name).is_dir():
            shutil.copytree(ROOT / name, tmp_path / name, ignore=shutil.ignore_patterns("__pycache__"))
        else:
            shutil.copy(ROOT / name, tmp_path / name)
    for name in ("seqloom/llm", "tests/llm"):
        shutil.rmtree(tmp_path / name, ignore_errors=True)
    run = lambda *more: subprocess.run([sys.executable, "-m", "pytest", "-q", "-p", "no:cacheprovider", *more], cwd=tmp_path, capture_output=True, text=True)
    collected = run("--collect-only", "tests")
    assert collected.returncode == 0, collected.stdout
    assert "tests/test_oracle.py::test_query[kmer_stats]" in collected.stdout
    found = run("tests/test_entry.py::test_entry", "tests/test_entry.py::test_nothing_else_imports_the_operators")
    assert found.returncode == 0, found.stdout


def test_errors_in_the_operators_are_not_swallowed(tmp_path):
    for name in ("seqloom", "__spark_entry__.py"):
        copy = shutil.copytree if (ROOT / name).is_dir() else shutil.copy
        copy(ROOT / name, tmp_path / name)
    (tmp_path / "seqloom" / "llm").mkdir(exist_ok=True)
    (tmp_path / "seqloom" / "llm" / "__init__.py").touch()
    (tmp_path / "seqloom" / "llm" / "queries.py").write_text("import a_module_that_is_missing")
    found = subprocess.run([sys.executable, "-c", "import __spark_entry__"], cwd=tmp_path, env={"PATH": "/usr/bin:/bin"}, capture_output=True, text=True)
    assert "a_module_that_is_missing" in found.stderr


def test_nothing_else_imports_the_operators():
    for path in (ROOT / "seqloom").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT / "seqloom").parts:
            assert "llm" not in path.read_text(), path
