"""Physical-plan properties the scale design relies on (final AQE plans)."""
import pytest

import __spark_entry__ as E

from log_tables import SF_SMALL, final_part


def _final_plan(df):
    df.collect()
    return final_part(df._jdf.queryExecution().executedPlan().toString())


def test_log_is_scanned_and_parsed_once(spark):
    final = _final_plan(E.queries()["template_confidence"](spark, SF_SMALL))
    assert final.count("FileScan parquet") == 1
    assert final.count("Generate explode") == 2  # repeated lines of the rendered log, and the parse
    assert "SinglePartition" not in _wide(final)


def _wide(final):
    """Plan lines of single-task exchanges that take more than a partial sum, or the first row of each block."""
    lines = final.splitlines()
    below = lambda i: " ".join(lines[i + 1:i + 5])
    return "\n".join(x for i, x in enumerate(lines) if "SinglePartition" in x and "partial_" not in below(i) and "Filter" not in below(i))


@pytest.mark.parametrize("name,exchanges", [("case_pairs", 3), ("entity_traces", 1), ("record_groups", 1), ("order_priority_pairs", 3)])
def test_keyed_work_deals_written_rows_once(spark, name, exchanges):
    """By a key: the parsed rows are written once, then one exchange brings a key together (two more count pairs)."""
    final = _final_plan(E.queries()[name](spark, SF_SMALL))
    assert final.count("FileScan parquet") == 1 and "Generate explode" not in final
    made = final.count("Exchange hashpartitioning") - final.count("ReusedExchange")
    assert made == exchanges and "SinglePartition" not in final


@pytest.mark.parametrize("name", ["consecutive_pairs", "pair_confidence", "valid_templates", "template_confidence"])
def test_totals_are_one_row_a_task(spark, name):
    final = _final_plan(E.queries()[name](spark, SF_SMALL))
    assert "windowspecdefinition(specifiedwindowframe" not in final  # no window without a key and an order over counts
    assert not _wide(final).strip()


@pytest.mark.parametrize("name", ["pair_confidence", "template_confidence", "case_pairs"])
def test_totals_are_summed_before_they_are_shuffled(spark, name):
    """No window by template over the pairs, and the totals read the exchange that the pairs come from."""
    final = _final_plan(E.queries()[name](spark, SF_SMALL))
    assert "windowspecdefinition(normalized_query" not in final
    assert "partial_sum(count" in final and "ReusedExchange" in final


def test_events_scan_prunes_columns(spark):
    df = E.queries()["template_counts"](spark, SF_SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,user_id:bigint,event_type:string>" in plan


def test_no_python_udf_in_queries(spark):
    for name in ("template_confidence", "entity_traces", "statement_catalogue"):
        plan = E.queries()[name](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
        assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan
