"""Queries whose parts run in several processes: ``local[n]`` would hide what is kept in one."""

import os
import subprocess
import sys

from tests.conftest import ROOT, SF

RUN = """
import sys
from pyspark.sql import SparkSession
work, name, folder = sys.argv[1:]
spark = SparkSession.builder.config(map={"spark.master": "local-cluster[2,1,1024]", "spark.executor.memory": "600m", "spark.ui.enabled": "false", "spark.driver.host": "127.0.0.1", "spark.checkpoint.dir": "file://" + work}).getOrCreate()
import __spark_entry__
print(sorted(map(tuple, __spark_entry__.queries()[name](spark, folder).collect())))
spark.stop()
"""


def test_another_engine_is_read_from_every_executor(duck, tmp_path):
    from larkspur import plans

    plans.load()
    ran = subprocess.run([sys.executable, "-c", RUN, str(tmp_path), "join_cross_engine", SF], cwd=tmp_path, env=os.environ | {"PYTHONPATH": ROOT}, capture_output=True, text=True, timeout=300)
    assert ran.returncode == 0, ran.stderr[-2000:]
    assert ran.stdout.strip().splitlines()[-1] == str(sorted(duck.execute(plans.SQL["join_cross_engine"]).fetchall()))
