"""Documents to extraction results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmerge.functions.salvage import parse_json_response
from docmerge.operators.grouping import with_group
from docmerge.operators.identity import ID, join_on
from docmerge.operators.state import inherit_group, pending_files
from docmerge.operators.validate import clean_result_keys, validate_flat, validate_schema_guided
from docmerge.plans.prompts import TEXT_PREFIX, extraction_prompts, system_prompt
from docmerge.plans.rounds import Model, Prompt, ask, run_rounds
from docmerge.schemas import Template
from docmerge.session import checkpointed

KEYS = list(ID)
#: What goes through the model calls with a file, so that nothing has to be joined to its result.
CARRY = ("group_id", "file_name", "file_seq")
RESULT_COLUMNS = (
    "session_id", "group_id", "file_id", "file_name", "file_seq", "success", "data_json", "header_json",
    "entries_json", "error", "attempt",
)


def parsed(answers: DataFrame) -> DataFrame:
    """Add ``json`` and ``parse_error`` to answers."""
    return (
        answers.withColumn("__s", parse_json_response("response"))
        .withColumns({"json": F.col("__s.json"), "parse_error": F.col("__s.error")})
        .drop("__s")
    )


def judge(template: Template | None):
    """Flat or template checks of answers."""

    def check(answers: DataFrame) -> DataFrame:
        rows = parsed(answers)
        if template:
            checked = validate_schema_guided(rows, template).withColumn("data_json", F.lit(None).cast("string"))
        else:
            checked = validate_flat(rows).withColumns(
                {"header_json": F.lit(None).cast("string"), "entries_json": F.lit(None).cast("array<string>")}
            )
        return checked.withColumn("reject_reason", F.coalesce("call_error", "parse_error", "reject_reason")).drop("json", "parse_error")

    return check


def fallback_to_flat(
    prompts: DataFrame, refused: DataFrame, model: Model, instructions: str = "", concurrency: int | None = None, carry: Sequence[str] = ()
) -> DataFrame:
    """One unguided attempt for files that the template mode could not read."""
    last = refused.select(*KEYS, F.col("reject_reason").alias("__last"), F.col("attempt").alias("__attempt"))
    plain = join_on(prompts.drop("feedback"), last, KEYS).withColumn("system_prompt", F.lit(system_prompt(None, instructions)))
    rows = checkpointed(parsed(ask(plain, model, KEYS, concurrency, [*carry, "__last", "__attempt"])))
    found = F.coalesce(F.size(F.json_object_keys("json")) > 0, F.lit(False))
    return rows.select(
        *KEYS,
        *carry,
        found.alias("success"),
        F.when(found, clean_result_keys("json")).alias("data_json"),
        F.lit(None).cast("string").alias("header_json"),
        F.lit(None).cast("array<string>").alias("entries_json"),
        F.when(~found, F.col("__last")).alias("error"),
        (F.col("__attempt") + 1).cast("int").alias("attempt"),
    )


def extract_documents(
    files: DataFrame,
    model: Model,
    template: Template | None = None,
    earlier: DataFrame | None = None,
    force: bool = False,
    instructions: str = "",
    doc_type: str = "",
    max_attempts: int = 3,
    concurrency: int | None = None,
) -> DataFrame:
    """One result per file of a session, null sessions being one: skip what is done, ask the model, check, ask again, fall back."""
    todo = with_group(files)
    if "session_id" not in todo.columns:
        todo = todo.withColumn("session_id", F.lit(None).cast("string"))
    if earlier is not None:
        todo = inherit_group(pending_files(todo, earlier, force), earlier)
    prompts = extraction_prompts(todo, template, instructions, doc_type)
    good, bad = run_rounds(prompts, model, judge(template), KEYS, max_attempts, concurrency, CARRY)
    outcome = good.select(
        *KEYS, *CARRY, F.lit(True).alias("success"), "data_json", "header_json", "entries_json",
        F.lit(None).cast("string").alias("error"), "attempt",
    )
    if template:
        rest = fallback_to_flat(prompts, bad, model, instructions, concurrency, CARRY)
    else:
        rest = bad.select(
            *KEYS, *CARRY, F.lit(False).alias("success"), F.lit(None).cast("string").alias("data_json"), "header_json", "entries_json",
            F.col("reject_reason").alias("error"), "attempt",
        )
    return outcome.unionByName(rest).select(*RESULT_COLUMNS)


def rule_extractor(prompts: list[Prompt]) -> list[str]:
    """A deterministic stand-in for a model: echoes JSON or "key: value" text of the document."""
    return [p.user.removeprefix(TEXT_PREFIX) for p in prompts]


def facts_extractor(prompts: list[Prompt]) -> list[str]:
    """A deterministic stand-in for a model: size facts of the document text."""
    texts = [p.user.removeprefix(TEXT_PREFIX) for p in prompts]
    return [f'{{"chars": {len(t)}, "lines": {t.count(chr(10)) + 1}}}' for t in texts]
