import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__
from sparkloom.plans.queries import ORACLES, QUERIES
from tests.oracle import compare

FOLDER, ROOT = "/root/testdata/sf0.001", Path(__file__).parent.parent


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, FOLDER)
    if name in ORACLES:
        assert compare(df, ORACLES[name], FOLDER) == ""
    else:
        assert df.count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 4
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_without_the_llm_folders(tmp_path):
    import shutil

    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; q = e.queries(); print(len(q), any(k.startswith('op') or k == 'pipeline' for k in q if k[2:3].isdigit() or k == 'pipeline'))"], cwd=copy, capture_output=True, text=True, timeout=120)
    assert said.stdout.split() == [str(len(QUERIES)), "False"], said.stderr


def test_prefilter_reaches_the_plan_before_python(spark):
    from sparkloom.plans.queries import planted_blocks, rw

    plan = rw.rewrite_blocks(planted_blocks(spark, FOLDER))._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "RLIKE" in plan and "n_chars" not in plan
