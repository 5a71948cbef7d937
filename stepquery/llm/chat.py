"""Multi-party perspective rotation, in DataFrame functions only.

For every participant of a dialogue the whole dialogue is rendered once with that speaker as the assistant, the other
speakers as named users, and a training mask over the assistant's own words. The result has one row per perspective and
turn: the rendered message, its character span in the dialogue, and the span that the mask covers. The messages of a
perspective in order of `pos`, put together, are the dialogue; no dialogue is ever gathered into one row or task, so one
that holds a third of all turns costs no more than as many small ones: offsets are running sums in three steps, within a
cell (rows of one turn and speaker whose texts begin alike), over the cells of BLOCK turn numbers, and over those runs.
Full rows meet only within their cell, so a dialogue of null or equal turns is split as well; the sums over cells see one
slim row a cell. The join of turns with participants can be split anywhere.

Defined results: turns are in order of turn, speaker, text (null turns first); equal rows each take a place of their own;
a null text is empty; a null role is the speaker `unknown`; null conversation ids form one dialogue; the system's turns
belong to every perspective, but it has none itself, so a dialogue of system turns only gives no rows; markers inside a
text are broken by a space, so no text can end its own message; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SYSTEM = "system"
BLOCK = 1024
#: Characters of a text that, behind turn and speaker, tell the cells of a dialogue apart; any number keeps the order.
PREFIX = 8
START, END = "<|im_start|>", "<|im_end|>"


def _before(sums: DataFrame, of: F.Column, order: str) -> DataFrame:
    """`sums` with _at and _pos, the lengths and rows of all that come earlier."""
    earlier = Window.partitionBy(of).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return sums.withColumns({"_at": F.coalesce(F.sum("_len").over(earlier), F.lit(0)), "_pos": F.coalesce(F.sum("_rows").over(earlier), F.lit(0))})


def rotate(turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", speaker: str = "role", text: str = "text", block: int = BLOCK) -> DataFrame:
    """conv_id, perspective, pos, turn, role, name, message, char_start, char_end, mask_start, mask_end."""
    clean = F.replace(F.replace(F.coalesce(F.col(text), F.lit("")), F.lit(START), F.lit("< |im_start|>")), F.lit(END), F.lit("< |im_end|>"))
    said = turns.select(F.col(conversation).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(speaker), F.lit("unknown")).alias("speaker"), clean.alias("body"))
    people = said.where(F.col("speaker") != SYSTEM).groupBy(F.col("conv_id").alias("_c"), F.col("speaker").alias("perspective")).agg(F.count("*").alias("_n")).drop("_n")
    cell = F.struct("conv_id", "perspective", "turn", "speaker", F.substring("body", 1, PREFIX).alias("begin"))
    seen = said.join(people, F.col("conv_id").eqNullSafe(F.col("_c"))).select(cell.alias("_cell"), "body")
    # all else follows from these two columns, so nothing else is shuffled
    who, by = F.col("_cell.perspective"), F.col("_cell.speaker")
    role = F.when(by == who, "assistant").when(by == SYSTEM, SYSTEM).otherwise("user")
    name = F.when(role == "user", F.translate(by, "\n<>|", "____"))
    head = F.concat(F.lit(START), role, F.coalesce(F.concat(F.lit(" name="), name), F.lit("")), F.lit("\n"))
    length = F.length(head) + F.length("body") + len(f"{END}\n")
    cells = seen.groupBy("_cell").agg(F.sum(length).alias("_len"), F.count("*").alias("_rows"))
    cells = cells.withColumn("_run", F.struct("_cell.conv_id", "_cell.perspective", F.floor(F.col("_cell.turn") / block).alias("run")))
    runs = cells.groupBy("_run").agg(F.sum("_len").alias("_len"), F.sum("_rows").alias("_rows"))
    runs = _before(runs, F.struct("_run.conv_id", "_run.perspective"), "_run").select("_run", F.col("_at").alias("_run_at"), F.col("_pos").alias("_run_pos"))
    base = _before(cells, F.col("_run"), "_cell").join(runs, "_run")
    placed = seen.join(base.select("_cell", F.expr("_at + _run_at").alias("_at"), F.expr("_pos + _run_pos").alias("_pos")), "_cell")
    inside = Window.partitionBy("_cell").orderBy("body")
    end = F.col("_at") + F.sum(length).over(inside.rowsBetween(Window.unboundedPreceding, 0))
    placed = placed.withColumns({"pos": F.col("_pos") + F.row_number().over(inside) - 1, "char_end": end})
    start, masked = F.col("char_end") - length, role == "assistant"
    return placed.select(
        "_cell.conv_id",
        "_cell.perspective",
        "pos",
        "_cell.turn",
        role.alias("role"),
        name.alias("name"),
        F.concat(head, F.col("body"), F.lit(f"{END}\n")).alias("message"),
        start.alias("char_start"),
        "char_end",
        F.when(masked, start + F.length(head)).alias("mask_start"),
        F.when(masked, F.col("char_end") - 1).alias("mask_end"),
    )


ORACLE = f"""
WITH said AS (
  SELECT conv_id, turn, COALESCE(role, 'unknown') AS speaker,
    REPLACE(REPLACE(COALESCE(text, ''), '{START}', '< |im_start|>'), '{END}', '< |im_end|>') AS body FROM conversations),
people AS (SELECT DISTINCT conv_id, speaker AS perspective FROM said WHERE speaker <> '{SYSTEM}'),
seen AS (
  SELECT s.conv_id, p.perspective, s.turn, s.speaker, s.body,
    CASE WHEN s.speaker = p.perspective THEN 'assistant' WHEN s.speaker = '{SYSTEM}' THEN '{SYSTEM}' ELSE 'user' END AS role
  FROM said s JOIN people p ON s.conv_id IS NOT DISTINCT FROM p.conv_id),
headed AS (
  SELECT *, CASE WHEN role = 'user' THEN TRANSLATE(speaker, chr(10) || '<>|', '____') END AS name,
    CASE WHEN role = 'user' THEN '{START}user name=' || TRANSLATE(speaker, chr(10) || '<>|', '____') || chr(10) ELSE '{START}' || role || chr(10) END AS head FROM seen),
made AS (SELECT *, head || body || '{END}' || chr(10) AS message FROM headed),
placed AS (
  SELECT *, ROW_NUMBER() OVER w - 1 AS pos, CAST(SUM(LENGTH(message)) OVER (w ROWS UNBOUNDED PRECEDING) AS BIGINT) AS char_end FROM made
  WINDOW w AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, body))
SELECT conv_id, perspective, pos, turn, role, name, message, char_end - LENGTH(message) AS char_start, char_end,
  CASE WHEN role = 'assistant' THEN char_end - LENGTH(message) + LENGTH(head) END AS mask_start,
  CASE WHEN role = 'assistant' THEN char_end - 1 END AS mask_end FROM placed
"""
