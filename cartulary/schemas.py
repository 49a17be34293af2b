"""Canonical schemas of the data model, as Spark DDL."""

from __future__ import annotations

UNITS = "id STRING, kind STRING, code STRING, name STRING, file_path STRING, line_start INT, line_end INT, column_start INT, is_external BOOLEAN, is_synthetic BOOLEAN, metadata STRING"
EDGES = "src STRING, dst STRING, kind STRING, level STRING, callsite_id STRING, callsite_code STRING, callsite_line INT, dispatch_type STRING, metadata STRING"
UNIT_FACTS = "fact_id STRING, unit_id STRING, fact_class STRING, name STRING, summary STRING, details STRING"
RELATION_FACTS = "fact_id STRING, fact_class STRING, src STRING, dst STRING, operation STRING, kind STRING, metadata STRING, seq BIGINT"
FLOWS = "arrival BIGINT, sink_file STRING, sink_line STRING, sink_name STRING, sink_code STRING, source_file STRING, source_line STRING, source_code STRING, recovery_kind STRING"
FINDINGS = (
    "case_id STRING, arm STRING, k INT, finding_index INT, file_path STRING, line_start INT, line_end INT, rule_id STRING, message STRING, "
    "code_snippet STRING, surrounding_context STRING, sink_api STRING, structural_evidence STRING, metadata STRING"
)
TRIAGE = "case_id STRING, k INT, finding_index INT, verdict STRING, confidence DOUBLE, reasoning STRING, suggestion STRING, source_expr STRING, sink_expr STRING"
TRIAGE_ROW = (
    "STRUCT<file: STRING, line: INT, rule_id: STRING, sink_api: STRING, verdict: STRING, confidence: DOUBLE, reasoning: STRING, suggestion: STRING, source_expr: STRING, "
    "sink_expr: STRING, source_in_snippet: BOOLEAN, sink_in_snippet: BOOLEAN, downgrade_reason: STRING, recovery_kind: STRING, recovery_kinds_seen: STRING>"
)
USAGE = "STRUCT<prompt_tokens: BIGINT, completion_tokens: BIGINT, total_tokens: BIGINT, call_count: BIGINT>"
METRICS = (
    "STRUCT<findings_hash: STRING, joern_catalog_grew: BOOLEAN, llm_tokens_triage: BIGINT, llm_tokens_refinement: BIGINT, llm_triage_s: DOUBLE, llm_refinement_s: DOUBLE, "
    "scan_s: DOUBLE, cpg_build_s: DOUBLE, rules_hash_pre: STRING, rules_hash_post: STRING, rules_yaml_bytes_pre: INT, rules_yaml_bytes_post: INT, rules_yaml_changed: BOOLEAN, "
    f"llm_usage: {USAGE}, n_findings_by_recovery: STRUCT<raw: MAP<STRING, INT>, post_dedup: MAP<STRING, INT>>>"
)
RESULTS = (
    "cve_id STRING, repo_url STRING, loc INT, cvss_score DOUBLE, skipped STRING, error STRING, per_cve_timeout_s DOUBLE, "
    "arms MAP<STRING, STRUCT<tp: INT, fp: INT, fn: INT, fn_by_llm: INT, fp_by_hallucinated_source: INT, labels: ARRAY<STRING>, n_candidates: INT, "
    f"n_findings_on_patched: INT, arm_error_type: STRING, metrics: {METRICS}, triage_verdicts: ARRAY<{TRIAGE_ROW}>, "
    "refinement_actions: ARRAY<STRUCT<action: STRING, target_rule_id: STRING, apply_status: STRING, classifications: MAP<STRING, STRING>>>>>"
)
GROUND_TRUTH = "cve_id STRING, vulnerable_file STRING, vulnerable_lines ARRAY<INT>"
CATALOG = "role STRING, pos INT, pattern STRING"
CVE_RECORD = (
    "cve_id STRING, ghsa_id STRING, package STRING, repo_url STRING, vulnerable_commit STRING, patch_commit STRING, patch_diff_path STRING, vulnerable_file STRING, "
    "vulnerable_lines ARRAY<INT>, sink_api STRING, loc INT, cvss_score DOUBLE, cvss_severity STRING, source_db STRING, taint_hops INT, notes STRING, manual_review_status STRING"
)
DIFFS = "case_id STRING, diff STRING"

#: Unit kinds; their fetches are filters on ``kind``.
UNIT_KINDS = ("Repository", "File", "Module", "Class", "Function", "Statement", "Expression", "LocalVariable", "GlobalVariable", "Parameter", "Comment")
RELATION_KINDS = ("Calls", "Contains", "ContainedIn", "AnnotatedBy")
