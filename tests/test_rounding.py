"""Ratios as text equal SQL's, also where the double lies on a tie."""

import duckdb
import pytest
from pyspark.sql import functions as F

from vocalmill.operators import qc


@pytest.mark.parametrize("digits", [3, 4])
def test_every_tie_equals_sql(spark, digits):
    parts = 2 * 10**digits
    want = duckdb.execute(f"SELECT k, printf('%.{digits}f', round_even(k::double / {parts}::double, {digits})) FROM range(0, {parts} * 2) t(k) ORDER BY k").fetchall()
    got = spark.range(parts * 2).select("id", qc.ratio_text(F.col("id") / F.lit(parts), digits).alias("s")).orderBy("id").collect()
    assert list(map(tuple, got)) == want


def test_the_report_rounds_as_sql(spark):
    # 1003 of 2000 ms: 0.5015 is 501.49999999999994 thousandths as a double; 61 of 20000 ms: 30.500000000000004 ten-thousandths
    rows = spark.createDataFrame([(1, 20000, 1, 1, 0, 0, 0, 0, 0, 61, 0, 1003, 2000)], "interview_id int, duration_ms bigint, turn_count bigint, speaker_count bigint, long_turns bigint, empty_turns bigint, timestamp_regressions bigint, unknown_speakers bigint, missing_human_labels bigint, last_ms bigint, max_gap_ms bigint, top_ms bigint, total_ms bigint")
    shown = qc.text_view(qc.assess(rows)).first()
    want = duckdb.execute("SELECT printf('%.3f', round_even(1003::double / 2000::double, 3)), printf('%.4f', round_even(61::double / 20000::double, 4))").fetchone()
    assert (shown.speaker_time_ratio_max, shown.coverage_ratio) == want == ("0.501", "0.0031")
