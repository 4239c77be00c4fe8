"""Intermediate tables: the folder they go to, and scopes of threads."""

from __future__ import annotations

import os
import subprocess
import sys
import threading
from pathlib import Path

import pytest

from tradelake.functions.tables import drop_materialized, materialize, scratch, shared_dir, stream_folder, write_table

ROOT = Path(__file__).resolve().parent.parent


def test_queries_at_once_keep_their_tables(spark):
    """A scope that ends in one thread leaves the tables of another thread's open scope."""
    written, ended, failures = threading.Event(), threading.Event(), []

    def first():
        try:
            with scratch(spark):
                table = materialize(spark.range(10))
                written.set()
                assert ended.wait(60)
                assert table.count() == 10
        except BaseException as e:
            failures.append(e)

    def second():
        assert written.wait(60)
        with scratch(spark):
            materialize(spark.range(5)).count()
        ended.set()

    threads = [threading.Thread(target=f) for f in (first, second)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failures


def test_kept_tables_go_with_the_outer_scope(spark):
    def there(path):
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)

    with scratch(spark):
        with pytest.raises(ValueError), scratch(spark):
            _, inner = write_table(spark.range(3))
            _, kept = write_table(spark.range(3), keep=True)
            raise ValueError
        assert not there(inner) and there(kept)
    assert not there(kept)


SCRIPT = """
from tradelake.session import local_session
from tradelake.functions.tables import drop_materialized, materialize, shared_dir
spark = local_session("2", 2, "1g")
assert spark.conf.get("spark.checkpoint.dir", None) is None
assert materialize(spark.range(7)).count() == 7
assert shared_dir(spark) == shared_dir(spark.newSession())
drop_materialized(spark)
"""


def test_without_the_setting(tmp_path):
    """A session whose defaults name no folder works, in local mode."""
    env = os.environ | {"SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": str(ROOT)}
    done = subprocess.run([sys.executable, "-c", SCRIPT], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-3000:]


def test_streams_go_with_the_tables(spark):
    folder = stream_folder(spark)
    spark.range(2).write.parquet(f"{folder}/x")
    drop_materialized(spark)
    assert folder.startswith(shared_dir(spark))
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(f"{folder}/x")
