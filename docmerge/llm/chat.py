"""Chat formatting with Spark expressions only.

Format: every run of adjacent turns of one role is a block ``<turn ROLE>TEXT</turn>`` and a line feed; the texts of
merged turns are kept apart by ``<next>``. In roles and texts ``\\`` is written ``\\b``, ``<`` is ``\\l`` and ``>`` is
``\\g``, so control strings cannot occur inside of them and both can be read back.

Nulls: a null text or role is empty, a null turn number comes first, rows with a null conversation id are one
conversation. Ties and repeated rows: equal turn numbers go by role, then text; repeated rows are turns of their own. An empty
table gives no conversation. Columns other than the four named ones are ignored, whatever their names.
A conversation becomes one text, so it has to fit in a row (2 GB; to read its loss, half a billion code points); groups are not split. Time grows with the length of a
conversation, also where it has many turns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docmerge.llm.common import let, text_of

OPEN, CLOSE, NEXT = "<turn ", "</turn>\n", "<next>"


def escape(text: Column) -> Column:
    for plain, code in (("\\", "\\b"), ("<", "\\l"), (">", "\\g")):
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    for plain, code in ((">", "\\g"), ("<", "\\l"), ("\\", "\\b")):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def _piece(turn: Column, previous: Column) -> Column:
    """What a turn adds to the text: ``lead`` (marks before it) and ``body``."""
    same = F.coalesce(previous["role"] == turn["role"], F.lit(False))
    opening = F.concat(F.when(previous.isNull(), "").otherwise(CLOSE), F.lit(OPEN), escape(turn["role"]), F.lit(">"))
    return F.struct(
        F.when(same, NEXT).otherwise(opening).alias("lead"),
        escape(turn["text"]).alias("body"),
        turn["role"].alias("role"),
    )


def format_conversations(turns: DataFrame, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per conversation: ``conv_id``, ``formatted``, and ``loss_spans`` (code points, end exclusive)."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), text_of().alias("text"))
    grouped = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    nothing = F.lit(None).cast(grouped.schema["turns"].dataType)
    before = F.concat(F.array(nothing[0]), F.slice("turns", 1, F.size("turns") - 1))
    # Where a body begins is a running sum over the pieces; the rows stay in the partition of their conversation.
    pieces = grouped.select("conv_id", F.posexplode(F.zip_with("turns", before, _piece)).alias("at", "piece"))
    upto = F.sum(F.length("piece.lead") + F.length("piece.body")).over(Window.partitionBy("conv_id").orderBy("at"))
    placed = pieces.select("conv_id", F.struct("at", F.concat("piece.lead", "piece.body").alias("text"), upto.alias("end"), F.length("piece.body").alias("length"), F.col("piece.role").isin(*loss_roles).alias("loss")).alias("p"))
    pieces = placed.groupBy("conv_id").agg(F.array_sort(F.collect_list("p")).alias("pieces"))
    spans = F.transform(F.filter("pieces", lambda p: p["loss"]), lambda p: F.struct((p["end"] - p["length"]).alias("start"), p["end"].alias("end")))
    return pieces.select("conv_id", F.concat(F.array_join("pieces.text", ""), F.lit(CLOSE)).alias("formatted"), spans.alias("loss_spans"))


def read_turns(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation."""

    def turns(block: Column) -> Column:
        mark = F.instr(block, ">")
        role = unescape(F.substring(block, F.lit(len(OPEN) + 1), mark - len(OPEN) - 1))
        bodies = F.split(F.substring(block, mark + 1, F.length(block)), NEXT)
        return F.transform(bodies, lambda body: F.struct(role.alias("role"), unescape(body).alias("text")))

    blocks = F.split(formatted, CLOSE)
    return F.flatten(F.transform(F.slice(blocks, 1, F.size(blocks) - 1), turns))


def read_loss(formatted: Column, spans: Column) -> Column:
    """The unescaped text under the loss mask, cut out of a form with four bytes to a code point."""
    piece = lambda code, s: F.decode(F.substring(code, (s["start"] * 4 + 1).cast("int"), ((s["end"] - s["start"]) * 4).cast("int")), "UTF-32")
    return let(F.encode(formatted, "UTF-32"), lambda code: F.array_join(F.transform(spans, lambda s: unescape(piece(code, s))), ""))
