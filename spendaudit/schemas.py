"""Schemas of the canonical tables, as DDL text."""

WORKS = (
    "work_id string, parliament_house string, mp_name string, state string, constituency string, "
    "elected_nominated string, work_category string, work_description string, recommended_amount double, "
    "recommended_date date, sanctioned_amount double, sanction_date date, completion_amount double, "
    "completion_date date, work_status_raw string, has_recommended boolean, has_sanctioned boolean, "
    "has_expenditure boolean, has_completed boolean, is_unmatched_work boolean, lifecycle_status string, "
    "row_order long"
)
LEDGER = (
    "expenditure_id string, work_id string, parliament_house string, expenditure_date date, "
    "vendor_name string, payment_status string, amount double"
)
ALLOCATION = (
    "mp_id string, parliament_house string, mp_name string, state string, constituency string, "
    "elected_nominated string, allocated_amount double"
)
CALAMITY = (
    "calamity_id string, parliament_house string, mp_name string, calamity_type string, "
    "calamity_name string, consent_date date, consent_amount double"
)
