"""Chat formatting in budgeted windows, in DataFrame operations alone.

Turns are marked ``<|im_start|>role``, newline, text, ``<|im_end|>``, newline. Inside roles and texts the backslash and the
start of a marker are escaped, so no text can forge a turn, and reading back is exact. Prefix sums of turn tokens choose the
windows: the conversation is laid out in strides of what the budget leaves beside the system turn and the history; turns that
lie within a stride are a window, and a turn that lies across the end of one is a window of its own, so no window's own turns
exceed a stride but a single longer turn. Each window retains the conversation's opening system turn, repeats those turns of
the window before it that start within its last ``history`` tokens, and masks what is repeated: the loss covers the assistant
texts of a window's own turns, so each text has loss once.

A conversation is the unit of the digests, so its turns meet in one place; they are put in order by sorting that can spill.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
SYSTEM, HISTORY, TARGET = 0, 1, 2


def escaped(sql: str) -> str:
    """SQL that escapes the string ``sql``: a backslash, the start of a marker and a newline (roles only) each get a code of their own."""
    return rf"replace(replace({sql}, '\\', '\\s'), '<|', '\\l')"


def unescaped(sql: str) -> str:
    return rf"replace(replace({sql}, '\\l', '<|'), '\\s', '\\')"


def windows(turns: DataFrame, budget: int = 1024, history: int = 128, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv, window, formatted, n_context, loss``: loss spans are (start, end) in code points, end exclusive; the first ``n_context`` turns are repeated ones.

    Null texts and roles count as empty. Turns are ordered by turn, then role, then text, nulls first; repeated rows are turns
    of their own. A null conversation id is a conversation. System turn, history and own turns keep the budget together; a turn
    longer than what is left for it is alone in its window, with the system turn and without history, and only such a window
    can exceed the budget.
    """
    rows = turns.select(F.col(f"`{conv}`").alias("conv"), F.col(f"`{turn}`").alias("turn"), F.coalesce(F.col(f"`{role}`").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    order = Window.partitionBy("conv").orderBy("turn", "role", "text")
    rows = rows.withColumn("body", F.expr(escaped("text"))).withColumn("name", F.expr(rf"replace({escaped('role')}, '\n', '\\n')"))
    rows = rows.withColumn("tokens", F.expr("(char_length(body) + 3) div 4 + 4"))
    rows = rows.withColumn("rn", F.row_number().over(order)).withColumn("before", F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.withColumn("before", F.coalesce("before", F.lit(0)).cast("long"))
    opening = F.first(F.struct("role", "name", "body", "tokens")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("opening", opening)
    rows = rows.withColumn("stride", F.greatest(F.lit(1), F.lit(budget - history) - F.when(F.col("opening.role") == "system", F.col("opening.tokens")).otherwise(0)).cast("long"))
    rows = rows.withColumn("window", F.expr("2 * (before div stride) + if((before + tokens - 1) div stride > before div stride, 1, 0)")).withColumn("long", F.col("tokens") > F.col("stride"))
    rows = rows.withColumn("opens", F.coalesce(F.lag("window").over(order) != F.col("window"), F.lit(False)))
    later = Window.partitionBy("conv").orderBy(F.desc("window")).rangeBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("next", F.min(F.struct("window", "before", "long")).over(later))
    is_system = F.expr("rn = 1 and role = 'system'")
    again = F.col("next").isNotNull() & (F.col("before") >= F.col("next.before") - history) & ~F.col("next.long") & ~is_system
    own = F.struct(F.col("window").alias("w"), F.lit(TARGET).alias("kind"), F.col("role"), F.col("name"), F.col("body"))
    repeated = F.struct(F.col("next.window").alias("w"), F.lit(HISTORY).alias("kind"), F.col("role"), F.col("name"), F.col("body"))
    system = F.struct(F.col("window").alias("w"), F.lit(SYSTEM).alias("kind"), F.col("opening.role"), F.col("opening.name"), F.col("opening.body"))
    parts = F.concat(F.array(own), F.when(again, F.array(repeated)).otherwise(F.array()), F.when(F.col("opens") & (F.col("opening.role") == "system"), F.array(system)).otherwise(F.array()))
    placed = rows.select("conv", "rn", F.explode(parts).alias("p")).select("conv", F.col("p.w").alias("window"), F.col("p.kind").alias("kind"), "rn", F.col("p.role").alias("role"), F.expr(f"concat('{START}', p.name, '\\n', p.body, '{END}\\n')").alias("marked"), F.expr("char_length(p.name)").alias("n_name"), F.expr("char_length(p.body)").alias("n_body"))
    inside = Window.partitionBy("conv", "window").orderBy("kind", "rn").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("at", F.coalesce(F.sum(F.char_length("marked")).over(inside), F.lit(0)))
    start = F.col("at") + len(START) + F.col("n_name") + 1
    span = F.when((F.col("kind") == TARGET) & (F.col("role") == "assistant"), F.struct(start.alias("start"), (start + F.col("n_body")).alias("end")))
    grouped = placed.groupBy("conv", "window").agg(F.array_sort(F.collect_list(F.struct("kind", "rn", "marked"))).alias("turns"), F.array_sort(F.collect_list(span)).alias("loss"), F.sum((F.col("kind") != TARGET).cast("int")).alias("n_context"))
    return grouped.select("conv", "window", F.expr("array_join(transform(turns, x -> x.marked), '')").alias("formatted"), "n_context", "loss")


def read_back(formatted: DataFrame) -> DataFrame:
    """``conv, window, turns, loss_texts`` of each window, from its string and loss spans alone: its own turns as ``role, newline, text, newline``."""
    marked = rf"slice(split(formatted, '<\\|im_end\\|>\\n', -1), n_context + 1, size(split(formatted, '<\\|im_end\\|>\\n', -1)) - n_context - 1)"
    name = f"substring(x, {len(START) + 1}, locate('\\n', x) - {len(START) + 1})"
    body = "substring(x, locate('\\n', x) + 1)"
    role = unescaped(rf"replace({name}, '\\n', '\n')")
    turns = rf"transform({marked}, x -> concat({role}, '\n', {unescaped(body)}, '\n'))"
    text = unescaped("substring(formatted, cast(x.start + 1 as int), cast(x.end - x.start as int))")
    return formatted.select("conv", "window", F.expr(turns).alias("turns"), F.expr(f"transform(loss, x -> {text})").alias("loss_texts"), F.char_length("formatted").alias("n_chars"))


def digests(formatted: DataFrame) -> DataFrame:
    """``conv, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars`` of each conversation, read back from its windows."""
    w = read_back(formatted).select("conv", "n_chars", F.struct("window", F.size("turns").alias("n"), F.array_join("turns", "").alias("turns"), F.array_join("loss_texts", "").alias("loss")).alias("w"))
    whole = w.groupBy("conv").agg(F.array_sort(F.collect_list("w")).alias("ws"), F.sum("n_chars").alias("formatted_chars"))
    whole = whole.select("conv", "formatted_chars", F.expr("aggregate(ws, 0L, (a, x) -> a + x.n)").alias("n_turns"), F.expr("array_join(transform(ws, x -> x.turns), '')").alias("turns"), F.expr("array_join(transform(ws, x -> x.loss), '')").alias("loss"))
    return whole.select("conv", "n_turns", F.sha2("turns", 256).alias("turns_sha256"), F.char_length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.col("formatted_chars").cast("long").alias("formatted_chars"))
