import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    scratch = tempfile.mkdtemp(prefix="stintwise-test-")
    s = (SparkSession.builder.master("local[*]")
         .appName("stintwise-tests")
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.shuffle.partitions", "8")
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.warehouse.dir", os.path.join(scratch, "warehouse"))
         .getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    from stintwise.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(s)   # the configured shared folder; a scratch one only if unset
    yield s
    s.stop()


@pytest.fixture(scope="module", autouse=True)
def views_end_with_their_module():
    """Temp views are seen in every database, so a module's do not outlive it."""
    yield
    from pyspark.sql import SparkSession

    s = SparkSession.getActiveSession()
    for t in (s.catalog.listTables() if s else []):
        if t.isTemporary:
            s.catalog.dropTempView(t.name)


SF_SMALL = "/root/testdata/sf0.001"
