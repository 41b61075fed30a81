"""What the executors of a cluster hold between steps, on a cluster of one executor in a process of its own."""

import importlib.util
import os
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
RUN = r"""
import re, sys
from pathlib import Path
from pyspark.sql import SparkSession
from kerbline.session import ship
from kerbline.storage import scratch

def held():
    for p in Path("/proc").glob("[0-9]*"):
        try:
            said = (p / "cmdline").read_bytes()
            if b"CoarseGrainedExecutorBackend" in said and f"-Dkerbline={sys.argv[1]}".encode() in said.split(b"\0"):
                return int(re.search(r"Pss_Anon:\s+(\d+)", (p / "smaps_rollup").read_text())[1]) // 1024
        except OSError:
            pass

spark = (
    SparkSession.builder.master("local-cluster[1,1,1024]").config("spark.executor.memory", "1024m").config("spark.ui.enabled", "false")
    .config("spark.driver.host", "127.0.0.1").config("spark.checkpoint.dir", f"file://{sys.argv[1]}/shared")
    .config("spark.executor.extraJavaOptions", f"-XX:+UseG1GC -Dkerbline={sys.argv[1]}").getOrCreate()
)
ship(spark).sparkContext.setLogLevel("ERROR")
spark.range(0, 3_000_000, 1, 1).selectExpr("id", "uuid() AS u").sort("u").write.format("noop").mode("overwrite").save()
before = held()
with scratch(spark, **({} if sys.argv[2] == "native" else {"native": False})):
    pass
print("HELD", before, held())
spark.stop()
"""


@pytest.mark.parametrize("kind", ["native", "plain"])
def test_executors_return_memory(tmp_path, kind):
    home = tmp_path / "home"
    (home / "work").mkdir(parents=True)  # executors' logs go there
    for p in Path(importlib.util.find_spec("pyspark").origin).parent.iterdir():
        if p.name != "work":
            (home / p.name).symlink_to(p)
    env = os.environ | {"SPARK_HOME": str(home), "SPARK_SCALA_VERSION": "2.13", "SPARK_LOCAL_IP": "127.0.0.1", "PYSPARK_PYTHON": sys.executable, "PYTHONPATH": str(ROOT)}
    said = subprocess.run([sys.executable, "-c", RUN, str(tmp_path), kind], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=150)
    found = [x.split()[1:] for x in said.stdout.splitlines() if x.startswith("HELD ")]
    assert found, said.stderr[-2000:]
    before, after = map(int, found[0])
    assert after < before - 100, (before, after)
