import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry


def test_entry_and_registry(spark):
    out = entry.entry(spark)
    assert out.count() > 0 and "strain_a" in out.columns
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 100


def test_without_the_training_data_operators(tmp_path):
    """The library must not need the subpackage that is removed for a check."""
    root = Path(entry.__file__).parent
    (tmp_path / "__spark_entry__.py").write_text((root / "__spark_entry__.py").read_text())
    for f in (root / "tessera").rglob("*.py"):
        if "llm" not in f.relative_to(root).parts:
            to = tmp_path / f.relative_to(root)
            to.parent.mkdir(parents=True, exist_ok=True)
            to.write_text(f.read_text())
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(k.startswith('op') or k == 'pipeline' for k in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)
