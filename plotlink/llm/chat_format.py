"""Chat formatting by prefix-target expansion, in DataFrame functions alone.

Every assistant turn becomes an example of its own: all turns before it as context and only its
reply trainable. A turn is written as ``<s>role\\ntext</s>``. Control strings inside texts and
roles are escaped reversibly, so that an example can be read back exactly.

Defined cases: a null text or role is empty; turns are ordered by turn (null first), then role,
then text, so repeated turns keep a fixed order; rows without conv_id form one conversation; a
conversation that does not end in a reply gets one more example with nothing trainable, so that no
turn is lost; an empty table gives no rows. The text grows with the square of a conversation's
turns, as the method has it; a conversation is one string, so it must fit in one row."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<s>", "</s>"
#: What can't stand unescaped inside a text: turn marks and the marks of a common older template.
_CONTROL = "</?s>|\\[/?INST\\]"


def escaped(text: Column) -> Column:
    """Only control strings change: their first character, and an ampersand that looks like an escape."""
    text = F.regexp_replace(text, "&(?=amp;|lt;|#91;|#10;)", "&amp;")
    text = F.regexp_replace(text, "<(?=/?s>)", "&lt;")
    return F.regexp_replace(text, "\\[(?=/?INST\\])", "&#91;")


def escaped_role(role: Column) -> Column:
    return F.replace(escaped(role), F.lit("\n"), F.lit("&#10;"))


def unescaped(text: Column) -> Column:
    for code, char in (("&lt;", "<"), ("&#91;", "["), ("&#10;", "\n"), ("&amp;", "&")):
        text = F.replace(text, F.lit(code), F.lit(char))
    return text


def examples(conversations: DataFrame, conv="conv_id", turn="turn", role="role", text="text") -> DataFrame:
    """conv_id, example (0, 1, ...), text, loss_start and loss_end (code points; end exclusive)."""
    t = conversations.select(
        F.col(conv).alias("conv_id"),
        F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")).alias("t"),
    )
    whole = t.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    parts = whole.select("conv_id", F.transform("ts", lambda x: F.struct(
        x["role"].alias("role"), F.concat(F.lit(OPEN), escaped_role(x["role"]), F.lit("\n")).alias("head"), escaped(x["text"]).alias("body"))).alias("p"))
    at = parts.select("conv_id", "p", F.explode(F.filter(
        F.sequence(F.lit(1), F.size("p")), lambda i: (F.element_at("p", i)["role"] == "assistant") | (i == F.size("p")))).alias("n"))
    of = at.select("conv_id", "n", F.element_at("p", F.col("n")).alias("last"), F.array_join(F.transform(
        F.slice("p", F.lit(1), F.col("n") - 1), lambda x: F.concat(x["head"], x["body"], F.lit(CLOSE))), "").alias("before"))
    start = (F.char_length("before") + F.char_length("last.head")).cast("long")
    trained = F.when(F.col("last.role") == "assistant", F.char_length("last.body")).otherwise(0)
    return of.select("conv_id", (F.col("n") - 1).alias("turn_index"), F.concat("before", "last.head", "last.body", F.lit(CLOSE)).alias("text"),
                     start.alias("loss_start"), (start + trained).alias("loss_end"))


def turns_of(example_text: Column) -> Column:
    """The turns of an example, read back: array of (role, text)."""
    marked = F.filter(F.split(example_text, CLOSE, -1), lambda x: x != "")
    body = F.transform(marked, lambda x: F.substring(x, F.lit(len(OPEN) + 1), F.char_length(x)))
    cut = lambda x: F.instr(x, "\n")
    return F.transform(body, lambda x: F.struct(
        unescaped(F.substring(x, F.lit(1), cut(x) - 1)).alias("role"),
        unescaped(F.substring(x, cut(x) + 1, F.char_length(x))).alias("text")))


def digests(formatted: DataFrame) -> DataFrame:
    """Per conversation, read back from its examples alone: turns, loss text and sizes."""
    ex = formatted.select("conv_id", "turn_index", "text", F.char_length("text").cast("long").alias("n"), F.substring(
        "text", F.col("loss_start").cast("int") + 1, (F.col("loss_end") - F.col("loss_start")).cast("int")).alias("target"))
    per = ex.groupBy("conv_id").agg(F.sum("n").alias("formatted_chars"), F.max(F.struct("turn_index", "text")).alias("whole"),
                                    F.sort_array(F.collect_list(F.struct("turn_index", "target"))).alias("targets"))
    read = per.select("conv_id", "formatted_chars", turns_of(F.col("whole.text")).alias("turns"),
                      F.array_join(F.transform("targets", lambda x: unescaped(x["target"])), "").alias("loss"))
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")
