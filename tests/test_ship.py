import os
import subprocess
import sys
from types import SimpleNamespace

import pyarrow as pa
import pyarrow.parquet as pq

from tracewell.session import ship

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_workers_import_the_package_from_anywhere(tmp_path):
    pq.write_table(pa.table({"illus_id": range(2000)}), tmp_path / "illustrations.parquet")  # as many scenes as there are rows
    code = f"import sys; sys.path.insert(0, {ROOT!r}); import __spark_entry__ as e; from tracewell.session import local_session; print('ROWS', e.queries()['gen_scenes'](local_session(2, 2), {str(tmp_path)!r}).count())"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    said = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "ROWS 2000" in said.stdout, said.stderr[-2000:]


def test_a_cluster_gets_the_package_as_a_zip():
    import zipfile

    sent = []
    sc = SimpleNamespace(environment={"PYTHONPATH": "/elsewhere"}, master="spark://host:7077", addPyFile=sent.append)
    ship(SimpleNamespace(sparkContext=sc))
    ship(SimpleNamespace(sparkContext=sc))
    assert len(sent) == 1 and "tracewell/session.py" in zipfile.ZipFile(sent[0]).namelist()
    assert sc.environment["PYTHONPATH"] == os.pathsep.join([ROOT, "/elsewhere"])
