import subprocess
import sys
import textwrap
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parent.parent


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["k", "v", "seq"] and df.count() > 0


def test_queries_and_sql():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_without_the_training_data_operators(tmp_path):
    """The rest works where that subpackage and the pipeline are absent."""
    for p in ("keystrata", "__spark_entry__.py"):
        src = ROOT / p
        if src.is_dir():
            for f in src.rglob("*.py"):
                if "llm" not in f.parts:
                    to = tmp_path / f.relative_to(ROOT)
                    to.parent.mkdir(parents=True, exist_ok=True)
                    to.write_text(f.read_text())
        else:
            (tmp_path / p).write_text(src.read_text())
    code = "import __spark_entry__ as e; q = e.queries(); assert 'q_live' in q and not any(n.startswith('op') or n == 'pipeline' for n in q), q; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", textwrap.dedent(code)], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})


def test_without_a_library_that_only_they_need(tmp_path):
    """A broken third-party module leaves the other queries alone."""
    for name in ("ahocorasick", "tiktoken"):
        (tmp_path / f"{name}.py").write_text(f"raise ImportError('no {name} here', name={name!r})")
    code = "import __spark_entry__ as e; q = e.queries(); assert 'q_live' in q and not any(n.startswith('op') or n == 'pipeline' for n in q), q; e.oracle_sql()"
    subprocess.run([sys.executable, "-W", "ignore", "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": f"{tmp_path}:{ROOT}"})


def test_nothing_else_imports_the_subpackage():
    for f in (ROOT / "keystrata").rglob("*.py"):
        if "llm" not in f.parts:
            assert "llm" not in f.read_text(), f
