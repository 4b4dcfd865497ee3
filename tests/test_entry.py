import importlib
import os
import subprocess
import sys

import __spark_entry__ as entry
from tests.conftest import SF_SMALL


def test_entry_and_names(spark):
    assert entry.entry(spark).count() > 0
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries)
    assert len(queries) > 70


def test_without_the_training_data_subpackage(tmp_path):
    """The rest imports and registers its queries where the subpackage is not there."""
    root = os.path.dirname(os.path.abspath(entry.__file__))
    for name in ("__spark_entry__.py", "tidemark"):
        os.symlink(os.path.join(root, name), tmp_path / name) if name.endswith(".py") else None
    os.makedirs(tmp_path / "tidemark")
    for part in os.listdir(os.path.join(root, "tidemark")):
        if part != "llm" and part != "__pycache__":
            os.symlink(os.path.join(root, "tidemark", part), tmp_path / "tidemark" / part)
    code = "import sys; sys.path.insert(0, '.'); import __spark_entry__ as e; q = e.queries(); assert 'snapshot_read' in q and 'pipeline' not in q and not any(n.startswith('op') for n in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": ""})


def test_nothing_else_imports_the_subpackage():
    root = os.path.join(os.path.dirname(os.path.abspath(entry.__file__)), "tidemark")
    for folder, _, names in os.walk(root):
        if "llm" in os.path.relpath(folder, root).split(os.sep):
            continue
        for name in names:
            if name.endswith(".py"):
                assert "tidemark.llm" not in open(os.path.join(folder, name)).read(), name


def test_modules_import():
    for name in ("operators.mvcc", "operators.layout", "functions.sizing", "streaming.latest", "sources.changelog"):
        importlib.import_module(f"tidemark.{name}")
    assert os.path.isdir(SF_SMALL)
