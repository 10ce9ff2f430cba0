import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry
import check_oracle

SMALL = "/root/testdata/sf0.001"
FAST = ["parsed_lines", "log_features", "overview", "response_time_stats", "suspicious_clients",
        "bottlenecks", "hourly_rollup", "anomaly_votes", "ip_profile", "dbscan_labels_two_features"]


def test_names_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_registry_needs_no_session():
    code = "import __spark_entry__ as e; assert len(e.queries()) >= len(e.oracle_sql()) > 50"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(entry.__file__).parent)


def test_entry(spark):
    assert entry.entry(spark).count() == 1


def test_queries_match_their_sql(spark):
    assert check_oracle.compare(spark, SMALL, FAST) == []
