"""The rest of the library stands without the training-data folders."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_imports_without_the_training_data_folders(tmp_path):
    for f in ("__spark_entry__.py", "bench.py"):
        shutil.copy(os.path.join(ROOT, f), tmp_path)
    shutil.copytree(os.path.join(ROOT, "barwright"), tmp_path / "barwright", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 150 and not [n for n in q if n.startswith('op') or n == 'pipeline'], len(q)"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, check=True, timeout=120)
