"""Cleaning and checking of field names (all JVM-side column expressions)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docmerge.functions.text import SPACE, apply_sql, as_col, bind, pattern, trim, trim_sql

# Section labels that may precede a field name, each followed by "-".
SECTION_LABELS = (
    "全血细胞计数",
    "补充报告",
    "检验结果",
    "检验信息",
    "检验项目",
    "检验方法",
    "检测方法",
    "患者信息",
    "病理信息",
    "病理报告",
    "标本信息",
    "就诊信息",
    "诊断意见",
    "镜下诊断",
    "基本信息",
    "血常规",
    "患者",
    "诊断",
    "常规",
)
# Section labels that may carry a running number.
NUMBERED_LABELS = ("检验结果", "检验")
# Single letters that are field names, and names a model invents for structure.
SINGLE_LETTER_KEYS = ("T", "N", "M")
STRUCTURE_KEYS = ("system_prompt", "instructions", "task", "_meta", "merged", "entries", "conflicts")

# Every alternative ends at its first dash, so one greedy repetition strips all prefixes.
_PREFIXES = (
    rf"^(?:(?:{'|'.join(NUMBERED_LABELS)})?[0-9]+[-—–]"
    rf"|(?:{'|'.join(SECTION_LABELS)})-)+"
)
_TAIL = rf"[{{:'\",}}{SPACE}]+$"
# ASCII and CJK ideographs are their own NFKC form; only other text calls the normaliser.
_BLANKS = rf"[{SPACE}\u200B-\u200D]+"
_PLAIN = r"^[\x00-\x7F\u4E00-\u9FFF]*$"


# Letters and ideographs only: nothing to clean, and always a valid name.
_SETTLED = r"^[A-Za-z\u4E00-\u9FFF]{2,}$"


def nfkc_sql(x: str) -> str:
    icu = f"java_method('com.ibm.icu.text.Normalizer', 'compose', coalesce({x}, ''), true)"
    return f"CASE WHEN {x} IS NULL OR {x} RLIKE {pattern(_PLAIN)} THEN {x} ELSE {icu} END"


def nfkc(c: Column | str) -> Column:
    """Unicode NFKC, by the ICU library that Spark itself ships."""
    return apply_sql(c, nfkc_sql)


def clean_key_suffix(c: Column | str) -> Column:
    """Drop trailing braces, quotes, colons and commas left over from JSON text."""
    return trim(F.regexp_replace(as_col(c), _TAIL, ""))


def normalize_key_sql(x: str) -> str:
    def cleaned(t: str) -> str:
        packed = f"regexp_replace({nfkc_sql(t)}, {pattern(_BLANKS)}, '')"
        bare = trim_sql(f"regexp_replace(regexp_replace({packed}, {pattern(_PREFIXES)}, ''), {pattern(_TAIL)}, '')")
        return bind(bare, "bare", f"CASE WHEN bare = '' THEN {t} ELSE bare END")

    return f"CASE WHEN {x} RLIKE {pattern(_SETTLED)} THEN {x} ELSE {bind(trim_sql(x), 'trimmed', cleaned('trimmed'))} END"


def normalize_key(c: Column | str) -> Column:
    """Canonical field name: NFKC, no white space, no section or number prefix, no JSON debris."""
    return apply_sql(c, normalize_key_sql)


def strip_leading_punct(c: Column | str) -> Column:
    return trim(F.regexp_replace(as_col(c), rf"^[{SPACE}:;|，、\-]+", ""))


# Patterns of strings that are measurements, dates, ids or symbols, not names.
INVALID_KEY_PATTERNS = (
    r"^[)*+,\\.><↑→↓\-—]$",
    rf"^(?![{''.join(SINGLE_LETTER_KEYS)}]$)[A-Za-z]$",
    r"^[0-9]+$",
    r"^[0-9]{4}[-/][0-9]{1,2}[-/][0-9]{1,2}",
    r"^[0-9]{1,2}:[0-9]{2}",
    r"^[0-9]+\.[0-9]+(?s:.*)[a-zA-Z]",
    r"^(?=[0-9]+\.?[0-9]*[a-zA-Z])(?s:.*)[({]",
    r"^[0-9]+\.?[0-9]*%",
    r"^[0-9]+\.[0-9]+$",
    r"^[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}$",
)


def is_valid_key_sql(x: str) -> str:
    checks = " AND ".join(f"NOT {x} RLIKE {pattern(p)}" for p in INVALID_KEY_PATTERNS)
    return f"coalesce({x} RLIKE {pattern(_SETTLED)} OR ({x} <> '' AND {checks}), false)"


def is_valid_key(c: Column | str) -> Column:
    """False for empty names and for values that a model has put in place of a name."""
    return apply_sql(c, is_valid_key_sql)


def is_joined_header_key(c: Column | str, max_parts: int = 5) -> Column:
    """More dash-separated parts than a field name has: a whole table header in one key."""
    return F.size(F.split(as_col(c), "-", -1)) > max_parts


def is_structure_key(c: Column | str) -> Column:
    return as_col(c).rlike(rf"(?i)^({'|'.join(STRUCTURE_KEYS)})$")


def is_hidden_key(c: Column | str) -> Column:
    return as_col(c).startswith("_")
