import subprocess
import sys
from pathlib import Path

CODE = """
import sys
from pyspark.sql import SparkSession
from corpusmill.sources import shared
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", "file://" + sys.argv[1]).getOrCreate()
a = shared.materialize(spark.range(10), "a")
b = shared.materialize(a.selectExpr("id + 1 AS id"), "b")
shared.discard(a)
assert b.count() == 10
from pathlib import Path
assert [p.name[:2] for p in Path(sys.argv[1]).iterdir() if p.name[1] == "-"] == ["b-"]
"""


def test_tables_go_when_nothing_reads_them_or_the_application_ends(tmp_path):
    subprocess.run([sys.executable, "-c", CODE, str(tmp_path)], check=True, cwd=str(Path(__file__).parents[1]), capture_output=True, timeout=300)
    assert [p.name for p in tmp_path.iterdir() if p.name[1] == "-"] == []  # Spark's own folder stays
