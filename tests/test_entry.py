import os
import shutil
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_registry_names_and_sql():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert set(__spark_entry__.oracle_sql()) <= set(names) and all(callable(f) for f in names.values())


def test_works_without_the_llm_folders(tmp_path):
    shutil.copytree(REPO, tmp_path / "r", ignore=shutil.ignore_patterns("llm", "corpus_pipeline.py", ".git", "__pycache__", "spark-warehouse"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'w01_contribution_rank' in q and not any(k.startswith('op') for k in q) and 'pipeline' not in q; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", check=True, env=os.environ | {"PYTHONPATH": str(tmp_path / "r")})


def test_entry_gives_rows(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.count() > 0 and "contribution_rank" in df.columns
