"""The entry module: what it registers, without a session and without llm."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

REPO = Path(__file__).resolve().parent.parent
LIST = "import __spark_entry__ as e; q = e.queries(); assert e.oracle_sql().keys() <= q.keys(); print(len(q))"


def listed(folder):
    done = subprocess.run([sys.executable, "-B", "-c", LIST], cwd=folder, env=os.environ | {"PYTHONPATH": str(folder)}, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    return int(done.stdout.split()[-1])


def test_lists_without_a_session():
    assert listed(REPO) >= 96


def test_works_without_the_optional_part(tmp_path):
    for name in ("waymark", "__spark_entry__.py"):
        source, target = REPO / name, tmp_path / name
        shutil.copytree(source, target, ignore=shutil.ignore_patterns("llm", "__pycache__")) if source.is_dir() else shutil.copy(source, target)
    assert listed(tmp_path) == 96


def test_nothing_else_imports_llm():
    for path in (REPO / "waymark").rglob("*.py"):
        if "llm" not in path.parts:
            assert "waymark.llm" not in path.read_text()


def test_entry(spark):
    out = entry.entry(spark)
    assert out.count() > 0 and "confidence" in out.columns


def test_plans(spark):
    """Columns and filters reach the scan; the top-k is limited before its sort."""
    sf = "/root/testdata/sf0.001"
    plan = entry.queries()["view_select"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in plan
    plan = entry.queries()["topk_20"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    plan = entry.queries()["manifest_todo_anti"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "LeftAnti" in plan


def test_a_missing_library_is_no_missing_part(tmp_path):
    for name in ("waymark", "__spark_entry__.py"):
        source, target = REPO / name, tmp_path / name
        shutil.copytree(source, target, ignore=shutil.ignore_patterns("__pycache__")) if source.is_dir() else shutil.copy(source, target)
    llm = tmp_path / "waymark" / "llm"
    if llm.is_dir():
        (llm / "queries.py").write_text("import a_library_that_is_not_there\n")
        done = subprocess.run([sys.executable, "-B", "-c", LIST], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, timeout=120)
        assert done.returncode != 0 and "a_library_that_is_not_there" in done.stderr
        shutil.rmtree(llm)
        (llm / "__pycache__").mkdir(parents=True)  # what a deletion may leave behind
    assert listed(tmp_path) == 96
