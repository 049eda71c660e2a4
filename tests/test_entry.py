import subprocess
import sys
from pathlib import Path

import __spark_entry__

ROOT = Path(__file__).parents[1]


def test_entry_runs(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["node_id", "distance", "type", "name", "layer"] and df.count() > 0


def test_every_oracle_has_its_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_imports_without_the_training_data_part(tmp_path):
    """The entry module and the rest still import where corpus_pipeline.py and the llm folder are gone."""
    import shutil

    shutil.copytree(ROOT / "weft", tmp_path / "weft", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'c23_impact' in q and not any(n.startswith('op') for n in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)
