"""Registered queries against their SQL on the smallest tables.

``python tests/compare.py 0.01`` runs all of them; here a quick selection runs with
the other tests.
"""

from pathlib import Path

import pytest

FOLDER = "/root/testdata/sf0.001"
QUICK = ["url_parts", "trust_tier", "page_parse", "target_links", "spam_verdict", "relevance", "status_resolution", "redirect_chains",
         "robots_verdict", "host_pacing", "gate_rows", "score_rows", "run_diff", "network_members", "master_lookup", "metric_queue",
         "domain_history", "disavow_diff", "input_dedup", "audit_verdicts"]


@pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables here")
@pytest.mark.parametrize("name", QUICK)
def test_query_matches_sql(spark, name):
    pytest.importorskip("duckdb")
    import __spark_entry__ as entry
    from compare import compare

    ok, note, _ = compare(spark, FOLDER, name, entry.queries(), entry.oracle_sql())
    assert ok, note


def test_registry_is_consistent():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) >= 100
