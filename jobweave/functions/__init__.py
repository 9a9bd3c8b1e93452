"""Column expressions; every function takes Columns and returns one Column."""
from jobweave.functions.company import board_source, company_domain, company_from_url, resolve_company
from jobweave.functions.dates import lenient_date, parse_role_date
from jobweave.functions.experience import (
    experience_bucket, experience_mismatch, extract_requirement, parse_years, role_months, too_senior,
)
from jobweave.functions.output import call_outcome, clean_output, draft_check, draft_body, is_json
from jobweave.functions.text import (
    confidence_label, confidence_tier, extract_company, extract_team, extract_emails, extract_phones,
    main_content, py_strip, py_title, redact, referrer_name, skill_overlap, token_text, truncate, with_protocol,
    word_count,
)

__all__ = [n for n in dir() if not n.startswith("_")]
