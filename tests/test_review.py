"""Goldens of tie-out, findings, summaries and memos."""

import pytest

from quillrow.operators import review
from quillrow.sources import packages

# package: forms, sources, checks, passed, critical, warning, info, score, percent
EXPECTED = {
    "demo_1040_w2_schedule_c": (3, 2, 3, 1, 1, 1, 0, 0.80333334, 80),
    "demo_1120_c_corp": (1, 1, 2, 0, 1, 0, 1, 0.72, 72),
    "demo_1065_partnership": (3, 1, 2, 0, 1, 1, 0, 0.72, 72),
    "demo_1120s_s_corp": (2, 1, 2, 1, 0, 1, 0, 0.845, 84),
    "demo_k1_partner": (1, 1, 2, 1, 0, 1, 0, 0.845, 84),
    "demo_1099_bundle": (2, 3, 2, 1, 1, 0, 0, 0.845, 84),
}


def test_listing_and_summary(spark):
    listed = {r.package_id: r for r in review.listing(spark).collect()}
    sums = {r.package_id: r for r in review.summaries(packages.table(spark, "line_items"), packages.table(spark, "advisories")).collect()}
    assert set(listed) == set(EXPECTED) == set(sums)
    for k, (forms, sources, checks, passed, critical, warning, info, score, _) in EXPECTED.items():
        assert (listed[k].form_count, listed[k].source_doc_count, listed[k].check_count) == (forms, sources, checks)
        assert listed[k].expected_findings == critical + warning + info
        s = sums[k]
        assert (s.checks_passed, s.critical, s.warning, s.info) == (passed, critical, warning, info)
        assert s.confidence_score == pytest.approx(score, abs=1e-7)


def test_compare(spark):
    rows = [("a", "r", "s", 84732, 87432, None), ("b", "r", "s", 5, 5, -3), ("c", "r", "s", 10, 8, 2), ("d", "r", "s", 10, 8, 1)]
    out = {r.label: r for r in review.compare(spark.createDataFrame(rows, "label string, return_reference string, source_reference string, return_amount long, source_amount long, tolerance long")).collect()}
    assert (out["a"].difference, out["a"].status, out["a"].severity) == (-2700, "flag", "critical")
    assert out["a"].message == "a differs by -2700: return 84732 at r vs source 87432 at s."
    assert (out["b"].tolerance, out["b"].status, out["b"].severity) == (0, "pass", "info")
    assert out["b"].message == "b ties within tolerance: return 5 vs source 5."
    assert (out["c"].status, out["d"].status, out["d"].severity) == ("pass", "flag", "warning")


def test_memos(spark):
    memo = {r.package_id: r.memo for r in review.memos(spark).collect()}
    for k, e in EXPECTED.items():
        assert f"- Confidence score: {e[8]}%\n" in memo[k]
    text = memo["demo_1040_w2_schedule_c"]
    assert text.startswith("# Tax Review Memo - 1040 with W-2, Schedule C, and interest income (Form 1040, TY 2025)\n\n## Summary\n- Findings: 2 (1 critical, 1 warning, 0 info)\n- Checks passed: 1 of 3\n")
    assert "### F-001 - Critical: W-2 wages does not tie\n" in text
    assert "### F-002 - Warning: Schedule C net profit dropped materially\n" in text
    assert text.index("- Source: W-2 Box 1 - ABC Dental\n") < text.index("### F-002")


def test_lookup_hides_input(spark):
    row = review.looked_up(spark, spark.createDataFrame([("secret-id",)], "package_id string")).first()
    assert row.error == "unknown demo package" and "secret" not in row.error
