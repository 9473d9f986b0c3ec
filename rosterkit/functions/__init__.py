"""Column functions: pure ``Column -> Column`` expressions, evaluated in the JVM."""

from rosterkit.functions.dates import compact_date, display_date, parse_date
from rosterkit.functions.files import extension, file_kind, file_name, output_folder, report_name, safe_name
from rosterkit.functions.names import clean_name, complete_name, full_name, normalize_sex
from rosterkit.functions.text import (
    company_key, contains_text, has_digit, is_bare_number, is_blank, mask_middle, match_key, strip,
)

__all__ = [
    "clean_name", "company_key", "compact_date", "complete_name", "contains_text", "display_date", "extension",
    "file_kind", "file_name", "full_name", "has_digit", "is_bare_number", "is_blank", "mask_middle", "match_key",
    "normalize_sex", "output_folder", "parse_date", "report_name", "safe_name", "strip",
]
