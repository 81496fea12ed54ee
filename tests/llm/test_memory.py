"""Memory of Python workers: what they keep between stages adds to that of the stages that follow."""

import subprocess
import sys
from pathlib import Path

SCRIPT = r"""
import re, sys
sys.path.insert(0, sys.argv[1])
from pathlib import Path
import pyarrow as pa
from pyspark.sql import SparkSession
from weftline.llm import hyperminhash, suffix_index
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.executorEnv.PYTHONPATH", sys.argv[1]).getOrCreate()
text = "concat_ws(' ', transform(sequence(1, 60), i -> sha2(concat(id, '-', i), 256))) AS text"
docs = spark.range(0, 8000, 1, 1).selectExpr("id AS row", "id AS doc_id", text)

def megabytes(batches):
    for _ in batches:
        pass
    kept = re.findall(r"\nPss_Anon:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text())
    yield pa.RecordBatch.from_pydict({"mb": pa.array([sum(map(int, kept)) // 1024])})

suffix_index.suffixes(docs).write.format("noop").mode("overwrite").save()
hyperminhash.sketches(docs).write.format("noop").mode("overwrite").save()
print("kept", spark.range(0, 1, 1, 1).mapInArrow(megabytes, "mb long").first()["mb"])
"""


def test_a_worker_keeps_no_free_memory(tmp_path):
    """After 31 MB of documents in one task a worker has little more than its modules (about 50 MB) and tables of powers."""
    script = tmp_path / "kept.py"
    script.write_text(SCRIPT)
    out = subprocess.run([sys.executable, str(script), str(Path(__file__).resolve().parents[2])], capture_output=True, text=True, timeout=300)
    assert out.returncode == 0, out.stderr[-2000:]
    assert int(out.stdout.split()[-1]) < 120
