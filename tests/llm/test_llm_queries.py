"""The registered queries: all there, in the promised columns, equal to their SQL."""

from pathlib import Path

import pytest

FOLDER = "/root/testdata/sf0.001"
COLUMNS = {
    1: ["doc_id", "held_out", "score", "predicted"], 2: ["doc_id", "size", "source_size", "target", "taken"],
    4: ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
    5: ["doc_id", "held_out", "lang_pred", "score"], 9: ["doc_id", "n_bytes", "n_tokens", "over_limit"],
    11: ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"],
    12: ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
    13: ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]}


def test_all_are_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 14)) and "pipeline" in names


@pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables here")
@pytest.mark.parametrize("number", sorted(COLUMNS))
def test_promised_columns_come_first(spark, number):
    import __spark_entry__ as entry

    name = next(n for n in entry.queries() if n.startswith(f"op{number}_"))
    got = entry.queries()[name](spark, FOLDER)
    assert got.columns[:len(COLUMNS[number])] == COLUMNS[number]
    assert got.count() == spark.read.parquet(f"{FOLDER}/documents.parquet").count()


@pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables here")
@pytest.mark.parametrize("name", ["op6_warc_derivatives", "op8_preference_pairs", "op11_fill_middle"])
def test_query_matches_sql(spark, name):
    pytest.importorskip("duckdb")
    import __spark_entry__ as entry
    from compare import compare

    ok, note, _ = compare(spark, FOLDER, name, entry.queries(), entry.oracle_sql())
    assert ok, note
