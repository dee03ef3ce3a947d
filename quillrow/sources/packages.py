"""The six built-in review packages, as four tables keyed by package."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# They have to equal those of the contract, in this order.
PACKAGES = [
    ("demo_1040_w2_schedule_c", "1040 with W-2, Schedule C, and interest income", "Form 1040", 2025),
    ("demo_1120_c_corp", "C corporation return with depreciation tie-out", "Form 1120", 2025),
    ("demo_1065_partnership", "Partnership return with K-1 allocation checks", "Form 1065", 2025),
    ("demo_1120s_s_corp", "S corporation return with shareholder K-1 checks", "Form 1120-S", 2025),
    ("demo_k1_partner", "Recipient-side K-1 review", "Schedule K-1 recipient package", 2025),
    ("demo_1099_bundle", "1099 bundle tie-out", "1040 source document bundle", 2025),
]

# Package, role (form or source), id, form type, label.
DOCUMENTS = [
    ("demo_1040_w2_schedule_c", "form", "return-1040", "form1040", "Form 1040"),
    ("demo_1040_w2_schedule_c", "form", "schedule-c", "schedule_c", "Schedule C"),
    ("demo_1040_w2_schedule_c", "form", "schedule-b", "form1040", "Schedule B"),
    ("demo_1040_w2_schedule_c", "source", "w2-abc", "w2", "W-2 - ABC Dental"),
    ("demo_1040_w2_schedule_c", "source", "1099-int-bank", "form1099_int", "1099-INT - First Bank"),
    ("demo_1120_c_corp", "form", "return-1120", "form1120", "Form 1120"),
    ("demo_1120_c_corp", "source", "fixed-asset-rollforward", "form1120", "Fixed asset rollforward"),
    ("demo_1065_partnership", "form", "return-1065", "form1065", "Form 1065"),
    ("demo_1065_partnership", "form", "partner-k1-a", "k1_1065", "Partner A K-1"),
    ("demo_1065_partnership", "form", "partner-k1-b", "k1_1065", "Partner B K-1"),
    ("demo_1065_partnership", "source", "allocations-workpaper", "form1065", "Partner allocation workpaper"),
    ("demo_1120s_s_corp", "form", "return-1120s", "form1120_s", "Form 1120-S"),
    ("demo_1120s_s_corp", "form", "shareholder-k1", "k1_1120_s", "Shareholder K-1"),
    ("demo_1120s_s_corp", "source", "shareholder-ledger", "form1120_s", "Shareholder ownership ledger"),
    ("demo_k1_partner", "form", "k1-1065", "k1_1065", "Schedule K-1"),
    ("demo_k1_partner", "source", "client-organizer", "unknown", "Client organizer notes"),
    ("demo_1099_bundle", "form", "schedule-b", "form1040", "Schedule B"),
    ("demo_1099_bundle", "form", "schedule-c", "schedule_c", "Schedule C"),
    ("demo_1099_bundle", "source", "1099-int", "form1099_int", "1099-INT - First Bank"),
    ("demo_1099_bundle", "source", "1099-div", "form1099_div", "1099-DIV - Brokerage"),
    ("demo_1099_bundle", "source", "1099-nec", "form1099_nec", "1099-NEC - ClientCo"),
]

# Package, position, id, label, category, return reference, source reference, return amount, source
# amount, tolerance, recommended action.
LINE_ITEMS = [
    ("demo_1040_w2_schedule_c", 1, "wages-line-1a", "W-2 wages", "Source Document Mismatch", "Form 1040 line 1a", "W-2 Box 1 - ABC Dental", 84732, 87432, 0, "Verify W-2 Box 1 and correct Form 1040 line 1a before filing."),
    ("demo_1040_w2_schedule_c", 2, "interest-schedule-b", "Interest income", "Source Document Tie-Out", "Schedule B line 2", "1099-INT Box 1 - First Bank", 412, 412, 0, "No action needed; retain source tie-out in review file."),
    ("demo_1120_c_corp", 1, "depreciation", "Depreciation expense", "Return To Workpaper Tie-Out", "Form 1120 line 20", "Fixed asset rollforward current depreciation", 18400, 21900, 0, "Tie Form 1120 depreciation to Form 4562 and the asset rollforward."),
    ("demo_1065_partnership", 1, "ordinary-income-k1-total", "Ordinary business income allocated to K-1s", "K-1 Allocation Tie-Out", "Form 1065 Schedule K line 1", "Sum of Partner K-1 Box 1 amounts", 125000, 122500, 0, "Reconcile Schedule K ordinary income to partner K-1 Box 1 totals."),
    ("demo_1120s_s_corp", 1, "k1-ordinary-income", "Shareholder ordinary income allocation", "Shareholder Allocation Tie-Out", "Form 1120-S Schedule K line 1", "Sum of shareholder K-1 Box 1 amounts", 94200, 94200, 0, "No action needed; retain allocation tie-out."),
    ("demo_k1_partner", 1, "k1-income", "K-1 ordinary income", "K-1 Recipient Tie-Out", "Schedule E page 2", "Schedule K-1 Box 1", 36700, 36700, 0, "No action needed; retain K-1 tie-out."),
    ("demo_1099_bundle", 1, "interest-total", "Interest total", "Source Document Tie-Out", "Schedule B line 2", "Sum of 1099-INT Box 1", 1240, 1240, 0, "No action needed; retain tie-out."),
    ("demo_1099_bundle", 2, "nonemployee-comp", "Nonemployee compensation", "Source Document Mismatch", "Schedule C gross receipts", "1099-NEC Box 1", 48000, 52000, 0, "Confirm whether the missing $4,000 is included elsewhere or omitted."),
]

# Package, position, severity, category, title, detail, return reference, recommended action.
ADVISORIES = [
    ("demo_1040_w2_schedule_c", 1, "warning", "Reasonableness", "Schedule C net profit dropped materially", "Schedule C net profit is down 72% from the prior-year demo baseline.", "Schedule C line 31", "Ask preparer to document the business change or verify missing gross receipts."),
    ("demo_1120_c_corp", 1, "info", "Completeness", "Officer compensation review point", "Officer compensation is present; reviewer should confirm W-2 support and reasonableness.", "Form 1120 line 12", "Confirm wages tie to payroll records and related-party documentation."),
    ("demo_1065_partnership", 1, "warning", "Basis", "Partner basis support not attached", "The package includes K-1 allocations but no partner basis rollforward in the demo manifest.", "Partner K-1 package", "Request basis schedules before approving loss allocations or distributions."),
    ("demo_1120s_s_corp", 1, "warning", "Reasonable Compensation", "Officer wage/distribution pattern needs review", "S corporation distributions exceed officer wages in the demo data.", "Form 1120-S Schedule K and W-2 support", "Ask reviewer to confirm reasonable-compensation documentation."),
    ("demo_k1_partner", 1, "warning", "Passive Activity", "Passive/nonpassive classification requires support", "K-1 income is carried to Schedule E, but the demo package lacks participation support.", "Schedule E page 2", "Confirm material participation or passive classification with the reviewer."),
]

# Lines that every memo ends with.
SKIPPED_CHECKS = [
    "Source PDF parsing is represented by synthetic structured values in this demo.",
    "Prior-year comparison is package-specific until approved synthetic fixtures are available.",
]
NEXT_STEPS = [
    "Validate the same checks against privacy-safe, redistributable fixtures.",
    "Replace synthetic line items with parsed values from identify_tax_form + region extraction.",
    "Capture reviewer dispositions for confirmed / false positive / follow-up.",
]

COLUMNS = {
    "packages": (PACKAGES, "package_id string, title string, return_type string, tax_year int"),
    "documents": (DOCUMENTS, "package_id string, role string, document_id string, form_type string, label string"),
    "line_items": (LINE_ITEMS, "package_id string, position int, item_id string, label string, category string, return_reference string, source_reference string, return_amount long, source_amount long, tolerance long, recommended_action string"),
    "advisories": (ADVISORIES, "package_id string, position int, severity string, category string, title string, detail string, return_reference string, recommended_action string"),
}


def table(spark: SparkSession, name: str) -> DataFrame:
    """One of packages, documents, line_items, advisories."""
    rows, schema = COLUMNS[name]
    return spark.createDataFrame(rows, schema)
