"""Schemas, as Spark DDL."""

ISSUE = "issue_id string, wcag_criterion string, element_id string, issue string, impact string, confidence double, suggested_fix string, fix_type string, hallucinated boolean"
REVIEWS = f"map<string,array<struct<{ISSUE.replace(' ', ':').replace(',:', ', ')}>>>"
#: Every key a reviewer may use for an issue; all as text or flags, read permissively.
RAW_ISSUE = (
    "issue_id string, wcag_criterion string, criterion string, element_id string, elementId string, id string, issue string, description string, impact string, "
    "confidence string, suggested_fix string, fix string, fix_type string, requires_human_review string, requires_long_desc string, hallucinated string"
)
PATCH = (
    "struct<element_id string, operation string, target_attribute string, new_value string, wrapper_tag string, wrapper_attributes map<string,string>, "
    "new_element string, position string, wcag_criterion string, confidence double, llm_safe boolean, reasoning string>"
)
PATCHES = f"array<{PATCH}>"
APPLIED = (
    "struct<html string, ok boolean, error string, log array<struct<index int, element_id string, operation string, new_value string, status string, detail string, error string>>>"
)
MODEL_ANSWER = "struct<new_value string, safe boolean, confidence double, reasoning string>"
SCORED = "struct<rules array<struct<id string, impact string, nodes int>>, passes int>"
STAGES = ("uploading", "extracting", "alt_text", "html", "axe_baseline", "round1", "round2", "round3", "done")
