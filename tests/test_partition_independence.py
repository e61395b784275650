"""Results must not depend on the number of shuffle partitions or input splits
(SURVEY section 5, invariant 4)."""

import pytest

import __spark_entry__ as E
from scripts.check_oracle import rows_of
from tests.conftest import SF_SMALL

NAMES = ["sft_pairs", "assistant_spans", "pref_filter", "countdown_solve", "countdown_simplified",
         "epoch_batches", "sft_labels", "loo_advantage", "log_rollup_pref", "seeded_sample", "verified_responses"]


@pytest.mark.parametrize("name", NAMES)
def test_same_result_for_1_and_7_partitions(spark, name):
    q = E.queries()[name]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    out = []
    try:
        for n in ("1", "7"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            df = q(spark, SF_SMALL)
            out.append(rows_of(df.columns, [tuple(r) for r in df.collect()]))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert out[0] == out[1]
