import os
import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_the_rest_works_without_the_training_data_operators(tmp_path):
    shutil.copytree(ROOT / "seqloom", tmp_path / "seqloom", ignore=lambda d, names: ["llm"] if Path(d).name == "seqloom" else [])
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'unit_distance' in q and not any(n.startswith('op') for n in q); e.oracle_sql(); print('fine')"
    env = os.environ | {"PYTHONPATH": str(tmp_path)}
    assert "fine" in subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True).stdout
