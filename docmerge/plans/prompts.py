"""Prompts for a model, built as columns beside the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmerge.schemas import Template, TemplateColumn

# What an answer must look like follows from the checks in operators/validate.py: each rule below names one of them.
GENERIC_SYSTEM = """You turn one document into one JSON object and write nothing else.

The answer is used only if it passes these checks:
1. It has two fields or more. (too_few_fields)
2. Its values are text, numbers, true, false or null. Put what belongs under a heading into the key, with "-" between heading and name; put lists into one text, with "; " between the items.
3. No key is made of more than five pieces joined by "-": a row of column titles is not a key. (joined_header_keys)
4. A key names something. Amounts, dates, clock times, percentages and lone signs are values.
5. Every value stands in the document. What is not there gets no key."""

GUIDED_RULES = """You fill a fixed form from one document and write one JSON object and nothing else.

The answer is used only if it passes these checks:
1. There is a list called "entries" with at least one object in it, even an empty one. (no_entries)
2. Something in the form is filled. (all_null)
3. Keys are exactly the names of the form: names given once at the top, names given per item inside "entries".
4. What the document does not say is null."""

TEXT_PREFIX = "Text of the document:\n\n"
NO_TEXT_REQUEST = "The document is the attached image."
DEFAULT_DOCUMENT_TYPE = "not stated"


def _column_line(c: TemplateColumn) -> str:
    return f"- {c.key}" + (f": {c.description}" if c.description else "") + (f" (example: {c.example})" if c.example else "")


def _section(title: str, columns: Template, none: str) -> str:
    return title + ":\n" + "\n".join(map(_column_line, columns)) if columns else none


def system_prompt(template: Template | None = None, instructions: str = "", doc_type: str = "") -> str:
    """Guided by the template if there is one; user instructions are always an addition."""
    extra = f"\n\nWishes of the user, as far as the checks allow:\n{instructions.strip()}" if instructions.strip() else ""
    if not template:
        return GENERIC_SYSTEM + extra
    single = _section("Once per document", [c for c in template if not c.repeating], "Once per document: none")
    multi = _section("Per item", [c for c in template if c.repeating], "Per item: none")
    return f"{GUIDED_RULES}\n\nKind of document: {doc_type or DEFAULT_DOCUMENT_TYPE}\n\n{single}\n\n{multi}{extra}"


def extraction_prompts(
    files: DataFrame, template: Template | None = None, instructions: str = "", doc_type: str = ""
) -> DataFrame:
    """Add ``system_prompt`` and ``user_prompt`` to files that have ``text`` (and maybe ``data_url``)."""
    text = F.coalesce("text", F.lit(""))
    return files.withColumns(
        {
            "system_prompt": F.lit(system_prompt(template, instructions, doc_type)),
            "user_prompt": F.when(text == "", NO_TEXT_REQUEST).otherwise(F.concat(F.lit(TEXT_PREFIX), text)),
        }
    )


_ANSWER_FORM = """{"entries": [{"key": "value"}], "conflicts": [{"field": "key", "values": ["source: value"]}]}"""

TEMPLATE_SYSTEM = """A list of field names with sample values follows. Propose a table for them: one JSON object in this form and nothing else:
{"columns": [{"key": "name", "type": "string, number or boolean", "description": "what it holds", "example": "a value", "repeating": false}]}
A column without a key, of another type or without a description is dropped; of equal keys the first is kept. Columns of line items are repeating."""


def template_prompt(samples: DataFrame) -> DataFrame:
    """One prompt for a template from the samples of each key (``field_samples``); as long as there are keys."""
    line = F.concat(F.lit("- "), F.col("key"), F.lit(": "), F.array_join("samples", " | "))
    lines = samples.agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("lines"))
    return lines.select(F.lit(TEMPLATE_SYSTEM).alias("system_prompt"), F.concat(F.lit("Fields:\n"), F.col("lines")).alias("user_prompt"))


MERGE_SYSTEM = f"""A list of objects follows; each has a file name and the fields read from that file. Some may be results of an earlier merge, in the form below.
Write one JSON object in this form and nothing else:
{_ANSWER_FORM}
One entry per subject and occasion. Every key of the input appears in some entry; keys that are lost are reported as missing. Where files disagree, list every value with its file under "conflicts", and keep conflicts of earlier merges."""

ALIGN_SYSTEM = f"""Records and a list of columns follow. Write one JSON object in this form and nothing else:
{_ANSWER_FORM}
Every entry has all columns and no other key; an answer with further or missing keys is sent back. A column without a matching field is null."""

LONG_FORM_NOTE = "\n\nThe columns describe single items: write an entry for every item of a record."
MIXED_RECORDS_NOTE = "\n\nThe records have different fields."

# Columns that mark a template with one lab item per row.
LONG_FORM_COLUMNS = ("检验项目", "检验结果")
