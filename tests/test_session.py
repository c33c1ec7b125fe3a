"""The shared folder where nothing is configured, in a process of its own."""

import os
import subprocess
import sys
from pathlib import Path

CODE = """
from ledgerline.session import local_session, shared_folder, written
spark = local_session("2", 2)
assert not spark.sparkContext.getConf().get("spark.checkpoint.dir")
a, b = shared_folder(spark), shared_folder(spark)
assert a == b and a.startswith("file:///"), (a, b)
assert written(spark.range(7), "t").count() == 7
try:
    from ledgerline.llm import shared
except ImportError:
    shared = None
if shared:
    assert shared.Workspace(spark, "w").save(spark.range(3), "x").count() == 3
print("fine")
"""


def test_works_without_configuration(tmp_path):
    root = str(Path(__file__).resolve().parent.parent)
    env = {k: v for k, v in os.environ.items() if k != "PYSPARK_SUBMIT_ARGS"} | {"SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": root, "TMPDIR": str(tmp_path)}
    run = subprocess.run([sys.executable, "-c", CODE], env=env, capture_output=True, text=True, timeout=300)
    assert "fine" in run.stdout, run.stderr[-2000:]
