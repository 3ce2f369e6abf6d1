"""Operator 9: chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are context and only its
text is trainable. A conversation that doesn't end with an assistant turn gets a last example
without a target, so that the output holds every turn.

A turn is ``<|turn|>role<|text|>text<|end|>``. Inside roles and texts backslashes are doubled and a
backslash follows the first character of anything that reads like a control string; removing one
backslash of each escape gives the text back.

Defined results: turns sort by (turn, role, text), nulls first; null roles and texts are empty;
repeated rows are turns of their own; an empty table gives no rows. Turns whose conversation id is
null form one conversation. Output is quadratic in the turns of one conversation, as the expansion
is; conversations are independent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import quoted

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: Control strings of this template and of common others.
CONTROL = (TURN, TEXT, END, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>")


def _pattern() -> str:
    special = str.maketrans({c: "\\" + c for c in "|[]"})
    return "|".join(f"{s[0].translate(special)}(?={s[1:].translate(special)})" for s in CONTROL)


def escaped(text: Column) -> Column:
    doubled = F.regexp_replace(text, r"\\", r"\\\\")
    return F.regexp_replace(doubled, f"({_pattern()})", r"$1\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def examples(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, example (0, 1, ...), n_turns (in it), formatted, loss_start, loss_length (code points of formatted)."""
    plain = lambda c: F.coalesce(F.col(quoted(c)).cast("string"), F.lit(""))
    row = F.struct(F.col(quoted(turn)).alias("turn"), plain(role).alias("role"), plain(text).alias("text"))
    rows = df.select(F.col(quoted(conv)).alias("conv_id"), row.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    # sorted as they are given, escaped afterwards
    turns = rows.select("conv_id", F.transform("turns", lambda t: F.struct(escaped(t["role"]).alias("role"), escaped(t["text"]).alias("text"))).alias("turns"))
    last = F.size("turns") - 1
    chosen = F.filter(F.sequence(F.lit(0), last), lambda i: (F.get("turns", i)["role"] == "assistant") | (i == last))
    each = turns.select("conv_id", "turns", F.posexplode(chosen).alias("example", "at"))
    shown = F.transform(F.slice("turns", F.lit(1), F.col("at") + 1), lambda t: F.concat(F.lit(TURN), t["role"], F.lit(TEXT), t["text"], F.lit(END)))
    target = F.get("turns", F.col("at"))
    size = F.when(target["role"] == "assistant", F.char_length(target["text"])).otherwise(0)
    full = each.select("conv_id", "example", (F.col("at") + 1).cast("long").alias("n_turns"), F.array_join(shown, "").alias("formatted"), size.cast("long").alias("loss_length"))
    return full.withColumn("loss_start", F.char_length("formatted") - len(END) - F.col("loss_length")).select("conv_id", "example", "n_turns", "formatted", "loss_start", "loss_length")


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation, from the formatted text alone: its turns and digests, and the text under the loss mask."""
    loss = unescaped(F.substring("formatted", F.col("loss_start").cast("int") + 1, F.col("loss_length").cast("int")))
    grouped = formatted.groupBy("conv_id").agg(
        F.max_by("formatted", "example").alias("all"),
        F.sort_array(F.collect_list(F.struct("example", loss.alias("loss")))).alias("losses"),
        F.sum(F.char_length("formatted")).cast("long").alias("formatted_chars"),
    )
    marked = F.slice(F.split("all", r"<\|turn\|>"), 2, 1 << 30)
    inside = F.transform(marked, lambda x: F.split(F.regexp_replace(x, r"<\|end\|>$", ""), r"<\|text\|>"))
    turns = F.transform(inside, lambda x: F.concat(unescaped(F.get(x, F.lit(0))), F.lit("\n"), unescaped(F.get(x, F.lit(1))), F.lit("\n")))
    trained = F.array_join(F.transform("losses", lambda x: x["loss"]), "")
    read = grouped.select("conv_id", F.size(marked).cast("long").alias("n_turns"), F.array_join(turns, "").alias("turns"), trained.alias("trained"), "formatted_chars")
    return read.select("conv_id", "n_turns", F.sha2(F.col("turns").cast("binary"), 256).alias("turns_sha256"), F.char_length("trained").cast("long").alias("loss_chars"), F.sha2(F.col("trained").cast("binary"), 256).alias("loss_sha256"), "formatted_chars")
