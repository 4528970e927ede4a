"""Column layouts of the tables that the operators exchange."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

FILES = (
    "session_id string, file_id string, file_name string, file_seq bigint, size bigint, "
    "mime string, text string, content binary"
)
RESULTS = (
    "session_id string, group_id string, file_id string, file_name string, file_seq bigint, "
    "success boolean, data_json string, header_json string, entries_json array<string>, "
    "error string, attempt int, result_seq bigint"
)
ENTRIES = "file_id string, entry_idx bigint, entry_json string"
GROUP_MEMBERS = "group_id string, group_key string, file_id string, file_seq bigint"
TEMPLATE = "pos int, key string, type string, description string, example string, repeating boolean"
EVENTS = "event string, data string"


@dataclass(frozen=True)
class TemplateColumn:
    """One declared output column."""

    key: str
    type: str = "string"
    description: str = ""
    example: str = ""
    repeating: bool = False


@dataclass(frozen=True)
class PivotPreset:
    """What becomes a column name in the wide form, and which values go under it."""

    pivot_key: str
    prefix: str | None = None
    values: tuple[str, ...] = field(default_factory=tuple)


Template = list[TemplateColumn]


def template_df(spark: SparkSession, template: Template) -> DataFrame:
    rows = [(i, c.key, c.type, c.description, c.example, c.repeating) for i, c in enumerate(template)]
    return spark.createDataFrame(rows, TEMPLATE)
