"""JSON objects as ordered key/value arrays.

``json_pairs`` turns JSON object text into ``array<struct<key, kind, text>>`` in
document order.  ``kind`` is one of string, number, boolean, null, object, array;
``text`` is the decoded string, the number as it prints, or compact JSON text.
``loose_pairs`` is the cheaper form for merging: it reports strings, whole numbers
and booleans of a flat object alike as "plain".
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docmerge.functions.text import apply_sql, as_col, bind, pattern

_OBJECT = "'map<string,variant>'"
_TEXT_OBJECT = "'map<string,string>'"
_STRING = r'"[^"\\]*+"'
_WHOLE = r"-?(?:0|[1-9][0-9]{0,14})(?![0-9.eE])"


def _flat(value: str, key: str = _STRING) -> str:
    """Pattern of a flat JSON object without escapes whose values match ``value``."""
    return rf"^\{{[ \n]*+(?:{key}[ \n]*+:[ \n]*+(?:{value})[ \n]*+(?:,[ \n]*+(?=\")|(?=\}}$)))*+\}}$"


FLAT_STRINGS = _flat(f"{_STRING}|null")
_PLAIN_VALUE = rf"{_STRING}|(?!-0){_WHOLE}|true|false|null"
_FLAT_PLAIN = _flat(_PLAIN_VALUE)
# Flat, plain, and with keys of letters and ideographs only: keys and values are clean as they are.
SETTLED_OBJECT = _flat(_PLAIN_VALUE, r'"[A-Za-z\u4E00-\u9FFF]{2,}+"')
_STRINGS = r'"(?:[^"\\]++|\\.)*+"'
_WHOLE_NUMBERS = r'("[^"\\]*+(?:\\.[^"\\]*+)*+")|(-?\d+)\.0+(?![\d.eE])'


def number_text_sql(x: str) -> str:
    exponent = f"try_cast(regexp_extract(t, {pattern(r'E(-?[0-9]+)$')}, 1) AS int)"
    mantissa = rf"regexp_replace(regexp_extract(t, {pattern(r'^(-?[0-9.]+)E')}, 1), {pattern(r'[.]0$')}, '')"
    plain = f"""CASE WHEN NOT contains(t, 'E') THEN t
        WHEN {exponent} BETWEEN -6 AND -1 THEN CAST(try_cast(t AS decimal(38,24)) AS string)
        WHEN {exponent} BETWEEN 0 AND 20 THEN CAST(try_cast(t AS decimal(38,12)) AS string) END"""
    shortest = f"regexp_replace({plain}, {pattern(r'[.]?0+$|([.][0-9]*?)0+$')}, '$1')"
    scientific = f"concat({mantissa}, if({exponent} > 0, 'e+', 'e'), {exponent})"
    body = f"coalesce({shortest}, {scientific})"
    return f"""CASE WHEN {x} RLIKE {pattern("^-?[1-9][0-9]{0,14}$")} THEN {x} WHEN CAST({x} AS double) = 0 THEN '0'
        ELSE {bind(f"CAST(CAST({x} AS double) AS string)", "t", body)} END"""


def number_text(c: Column | str) -> Column:
    """A JSON number the way it prints as text: 100.0 -> 100, 1e3 -> 1000, 1e-7 -> 1e-7."""
    return apply_sql(c, number_text_sql)


def _compact_sql(x: str) -> str:
    return f"if(contains({x}, '.0'), regexp_replace({x}, {pattern(_WHOLE_NUMBERS)}, '$1$2'), {x})"


def compact_json(c: Column | str) -> Column:
    """Nested JSON text with whole numbers printed without a fraction."""
    return apply_sql(c, _compact_sql)


def _kind_sql(value: str) -> str:
    return bind(
        f"schema_of_variant({value})",
        "sv",
        """CASE WHEN sv IS NULL OR sv = 'VOID' THEN 'null' WHEN sv = 'STRING' THEN 'string'
        WHEN sv = 'BOOLEAN' THEN 'boolean' WHEN startswith(sv, 'OBJECT') THEN 'object'
        WHEN startswith(sv, 'ARRAY') THEN 'array' ELSE 'number' END""",
    )


def _typed_sql(value: str, key: str | None, nested: str) -> str:
    """Struct (key, kind, text) of one variant; ``nested`` gives its text if it is nested."""
    text = f"""CASE kd WHEN 'string' THEN CAST({value} AS string)
        WHEN 'number' THEN {bind(f"CAST({value} AS string)", "nm", number_text_sql("nm"))}
        WHEN 'null' THEN 'null' WHEN 'boolean' THEN CAST({value} AS string)
        ELSE {bind(nested, "nt", _compact_sql("nt"))} END"""
    head = f"'key', {key}, " if key else ""
    return bind(_kind_sql(value), "kd", f"named_struct({head}'kind', kd, 'text', {text})")


def _keep_last_sql(pairs: str) -> str:
    last = "transform(array_distinct(ps.key), k -> element_at(filter(ps, q -> q.key = k), -1))"
    return bind(pairs, "ps", f"if(size(array_distinct(ps.key)) = size(ps), ps, {last})")


def pairs_sql(x: str, loose: bool = False) -> str:
    flat, kind = (_FLAT_PLAIN, "plain") if loose else (FLAT_STRINGS, "string")
    plain = f"""transform(map_entries(from_json({x}, {_TEXT_OBJECT})), e -> named_struct('key', e.key,
        'kind', if(e.value IS NULL, 'null', '{kind}'), 'text', coalesce(e.value, 'null')))"""
    # The text form, parsed in the same order, keeps the order of nested keys.
    each = f"transform(map_entries(from_json({x}, {_OBJECT})), (e, ei) -> {_typed_sql('e.value', 'e.key', 'get(tv, ei)')})"
    # Variants refuse objects with a key twice, at any depth; then kinds are read off the texts.
    guessed = f"""CASE WHEN e.value IS NULL THEN 'null' WHEN startswith(e.value, '{{') AND endswith(e.value, '}}') THEN 'object'
        WHEN startswith(e.value, '[') AND endswith(e.value, ']') THEN 'array' WHEN e.value IN ('true', 'false') THEN 'boolean'
        WHEN e.value RLIKE {pattern("^-?(0|[1-9][0-9]*)([.][0-9]+)?$")} THEN 'number' ELSE 'string' END"""
    plainer = f"transform(map_entries(from_json({x}, {_TEXT_OBJECT})), e -> named_struct('key', e.key, 'kind', {guessed}, 'text', coalesce(e.value, 'null')))"
    typed = f"coalesce({bind(f'map_values(from_json({x}, {_TEXT_OBJECT}))', 'tv', each)}, {plainer})"
    return _keep_last_sql(f"CASE WHEN {x} RLIKE {pattern(flat)} THEN {plain} ELSE {typed} END")


def flat_map_sql(x: str, settled: str = "false") -> str:
    """Map of a flat object of plain values, whose texts are those of its loose pairs; null for any other. A key may be there twice.

    Where ``settled`` is true the text is known to be such an object."""
    return f"CASE WHEN {settled} OR {x} RLIKE {pattern(_FLAT_PLAIN)} THEN from_json({x}, {_TEXT_OBJECT}) END"


def items_sql(x: str) -> str:
    each = f"transform(from_json({x}, 'array<variant>'), (v, vi) -> {_typed_sql('v', None, 'get(ti, vi)')})"
    return bind(f"from_json({x}, 'array<string>')", "ti", each)


def depth_sql(x: str) -> str:
    """How deep the arrays of a JSON text are nested, read off its brackets outside of strings."""
    bare = f"regexp_replace(regexp_replace({x}, {pattern(_STRINGS)}, ''), {pattern(r'[^\[\]]++')}, '')"
    step = "named_struct('now', s.now + if(c = '[', 1, -1), 'most', greatest(s.most, s.now + if(c = '[', 1, 0)))"
    return f"aggregate(split({bare}, ''), named_struct('now', 0, 'most', 0), (s, c) -> {step}, s -> s.most)"


def is_json_object(c: Column | str) -> Column:
    return F.from_json(as_col(c), "map<string,variant>").isNotNull()


def json_pairs(c: Column | str) -> Column:
    """Ordered pairs of a JSON object; a repeated key keeps its first place and last value."""
    return apply_sql(c, pairs_sql)


def loose_pairs(c: Column | str) -> Column:
    """As ``json_pairs``, with kind "plain" for the scalars of a flat object."""
    return apply_sql(c, lambda x: pairs_sql(x, loose=True))


def json_items(c: Column | str) -> Column:
    """Elements of a JSON array as ``array<struct<kind, text>>`` in order."""
    return apply_sql(c, items_sql)


def quote_json(c: Column) -> Column:
    """A string as a JSON string literal."""
    return F.regexp_replace(F.to_json(F.array(c)), r"^\[|\]$", "")


def token(pair: Column) -> Column:
    """JSON text of one pair's value."""
    return F.when(pair["kind"] == "string", quote_json(pair["text"])).otherwise(pair["text"])


def pairs_to_json(pairs: Column) -> Column:
    members = F.transform(pairs, lambda p: F.concat(quote_json(p["key"]), F.lit(":"), token(p)))
    return F.concat(F.lit("{"), F.array_join(members, ","), F.lit("}"))


def given_sql(pair: str) -> str:
    """Neither null nor the empty string."""
    return f"({pair}.kind <> 'null' AND NOT ({pair}.kind IN ('string', 'plain') AND {pair}.text = ''))"
