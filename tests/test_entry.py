import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
COUNT = "import __spark_entry__ as e; q = e.queries(); o = e.oracle_sql(); assert set(o) <= set(q); print(len(q), any(n.startswith('op') or n == 'pipeline' for n in q))"


@pytest.mark.parametrize("gone", [("keyloom/llm",), ("keyloom/llm", "corpus_pipeline.py")])
def test_core_stands_alone(tmp_path, gone):
    from keyloom import queries

    shutil.copytree(ROOT / "keyloom", tmp_path / "keyloom", ignore=shutil.ignore_patterns("__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if (ROOT / name).exists():
            shutil.copy(ROOT / name, tmp_path)
    for name in gone:
        path = tmp_path / name
        shutil.rmtree(path) if path.is_dir() else path.unlink(missing_ok=True)
    out = subprocess.run([sys.executable, "-c", COUNT], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert out.stdout.split() == [str(len(queries.queries())), "False"], out.stderr
