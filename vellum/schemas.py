"""Record schemas, as DDL."""

from __future__ import annotations

SPAN = "struct<start:int,end:int,repl:string>"
LEAK = "struct<type:string,matches:array<string>>"
VALIDATION = f"struct<passed:boolean,leaks_found:array<{LEAK}>,confidence_score:double>"
CONTACTS = ("emails", "phones", "linkedin", "linkedin_handles", "github", "urls", "urls_no_proto", "addresses")
VAULT = (
    "candidate_id string, original_name string, original_filename string, "
    f"contact_info struct<{','.join(f'{c}:array<string>' for c in CONTACTS)}>, publications array<string>, "
    f"pii_categories_found map<string,int>, anonymization_level_used string, techniques_applied array<string>, validation_score {VALIDATION}"
)
ROLE = "struct<title:string,duration_months:int,period:string,description:string>"
EDUCATION = "struct<level:string,field:string,institution:string,period:string>"
SECTIONS = (
    f"struct<summary:string,skills:map<string,array<string>>,experience:array<{ROLE}>,total_experience_months:int,"
    f"education:array<{EDUCATION}>,certifications:array<string>,languages:array<string>>"
)
PARSED = f"candidate_id string, parsed_at timestamp, quality_score double, parse_warnings array<string>, sections {SECTIONS}"
RANKING = (
    "candidate_id string, final_score double, semantic_score double, keyword_score double, quality_score double, "
    "matched_skills array<string>, missing_skills array<string>, jd_skill_count int, rank int"
)
EVENT = (
    "event_id string, timestamp string, stage string, event_type string, candidate_id string, description string, "
    "legal_basis string, severity string, extra string"
)
RUNS = (
    "run_id string, jd_file string, jd_text string, status string, started_at string, finished_at string, exit_code int, "
    "total_cvs int, error_message string"
)
CANDIDATES = (
    "run_id string, candidate_id string, original_file string, anonymized_at string, pii_count int, validation_passed int, "
    "validation_confidence double, quality_score double, total_exp_months int, skills_json string, education_json string, vault_json string"
)
RANKING_RESULTS = (
    "run_id string, candidate_id string, rank int, final_score double, semantic_score double, keyword_score double, quality_score double, "
    "verdict string, matched_skills string, missing_skills string, recommendation string, ranked_at string"
)
AUDIT_EVENTS = (
    "run_id string, event_id string, event_type string, stage string, candidate_id string, severity string, description string, "
    "extra_json string, timestamp string"
)
BIAS_CHECKS = "run_id string, check_id string, label string, flagged int, status string, note string, detail_json string, checked_at string"
