"""Tasks find the package when the session is started in another folder."""

import os
import subprocess
import sys

SCRIPT = """
import sys
sys.path.insert(0, {repo!r})
from staysignal.session import build_session
from staysignal.operators.neighbors_lsh import knn_lsh
spark = build_session("local[2]", 2)
df = spark.range(40).selectExpr("id", "array(cast(id as double), cast(id % 7 as double)) as v")
print("rows", knn_lsh(df, "id", "v", k=3, dim=2)[0].count())
"""


def test_from_another_folder(tmp_path):
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    got = subprocess.run([sys.executable, "-c", SCRIPT.format(repo=repo)], cwd=tmp_path, env=env, capture_output=True,
                         text=True, timeout=240)
    assert "rows 120" in got.stdout, got.stderr[-2000:]
