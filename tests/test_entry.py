"""The driver's contract from a fresh process in another folder."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def fresh(code: str, folder) -> str:
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=folder, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    return done.stdout


def test_registry_imports_without_a_session(tmp_path):
    out = fresh(f"import sys; sys.path.insert(0, {ROOT!r}); import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))", tmp_path)
    queries, oracles = map(int, out.split())
    assert queries >= 85 and oracles >= 80


def test_registry_without_the_text_operators(tmp_path):
    out = fresh(
        f"""
import sys
sys.path.insert(0, {ROOT!r})
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name == "corpus_pipeline" or name.startswith("dayloom.llm"):
            raise ModuleNotFoundError(f"No module named {{name!r}}", name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
print(len(e.queries()), any(n.startswith("op") and n[2:3].isdigit() for n in e.queries()))
""",
        tmp_path,
    )
    assert out.split()[1] == "False" and int(out.split()[0]) >= 85


def test_tasks_need_no_installed_package(tmp_path):
    out = fresh(
        f"""
import sys
sys.path.insert(0, {ROOT!r})
import __spark_entry__ as e
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config(
    "spark.sql.warehouse.dir", {str(tmp_path)!r}).config("spark.sql.shuffle.partitions", "2").getOrCreate()
print(e.entry(spark).count(), e.queries()["app_switch_count"](spark, "/root/testdata/sf0.001").count())
""",
        tmp_path,
    )
    assert all(int(n) > 100 for n in out.split()[-2:])
