import subprocess
import sys
from pathlib import Path

import __spark_entry__

ROOT = Path(__file__).resolve().parent.parent


def test_entry_has_rows_and_a_schema(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["severity", "n"] and df.count() == 4


def test_sql_only_for_known_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_import_without_the_llm_parts(tmp_path):
    """A copy without the llm folder and the pipeline still imports and keeps the other queries."""
    code = "import __spark_entry__ as e; q = e.queries(); assert 'severity_rollup' in q and 'pipeline' not in q and not any(n.startswith('op') for n in q)"
    for path in [*ROOT.glob("quillsieve/**/*.py"), ROOT / "__spark_entry__.py"]:
        if "llm" not in path.parts:
            to = tmp_path / path.relative_to(ROOT)
            to.parent.mkdir(parents=True, exist_ok=True)
            to.write_text(path.read_text())
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
