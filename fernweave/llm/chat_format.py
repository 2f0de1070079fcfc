"""Chat formatting with a grammar round trip, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, CLOSE = "<|im_start|>", "<|im_end|>"
STOP = CLOSE + "\n"
#: What the reader takes back: one backslash out of each `<\...|` in texts, `%XX` in roles.
_ESCAPED = r"<\\(\\*)\|"


def escape_text(text: Column) -> Column:
    """`<|` becomes `<\\|`, and what already looks so gains one backslash: no control string is left."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape_text(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, r"<$1|")


def escape_role(role: Column) -> Column:
    for plain, coded in (("%", "%25"), ("\n", "%0A"), ("<", "%3C")):
        role = F.replace(role, F.lit(plain), F.lit(coded))
    return role


def unescape_role(role: Column) -> Column:
    for plain, coded in (("<", "%3C"), ("\n", "%0A"), ("%", "%25")):
        role = F.replace(role, F.lit(coded), F.lit(plain))
    return role


def render(role: Column, text: Column) -> Column:
    return F.concat(F.lit(START), role, F.lit("\n"), text, F.lit(STOP))


def parse(formatted: Column) -> Column:
    """The grammar's one reading of a formatted text: array of struct(role, text), escapes undone.

    text = (START role "\\n" content CLOSE "\\n")*. A piece that does not end so, or holds CLOSE earlier, has no
    reading and comes back as a struct of nulls.
    """

    def turn(piece: Column) -> Column:
        content = F.substring_index(piece, CLOSE, 1)
        whole = F.concat(content, F.lit(STOP)) == piece
        role = F.substring_index(content, "\n", 1)
        text = F.substr(content, F.length(role) + F.lit(2))
        return F.struct(F.when(whole & F.contains(content, F.lit("\n")), unescape_role(role)).alias("role"), F.when(whole & F.contains(content, F.lit("\n")), unescape_text(text)).alias("text"))

    pieces = F.split(formatted, r"<\|im_start\|>", -1)
    return F.transform(F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0))), turn)


def format_chats(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", learn: str = "assistant") -> DataFrame:
    """One row for each conversation: conv_id, formatted, loss_spans, n_turns, n_escaped, round_trip.

    Each turn is rendered as it is and read back; one that does not come back identical is rendered escaped.
    round_trip is the reading of the whole text against the source turns: true, or the row raises, for escaping that
    failed once would fail again. loss_spans: array<struct<start, length>> in code points of formatted (from 0) that hold the
    texts of role `learn`.

    Null texts and roles are empty. Rows are ordered by turn (null first), ties by role, then text; repeated rows
    are repeated turns. Rows with a null conversation id form one conversation. Other columns are not read; an
    empty table gives an empty result. A conversation is one output row and so one group; nothing larger is gathered.
    """
    rows = turns.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    plain = parse(render(F.col("role"), F.col("text")))
    rows = rows.withColumn("same", F.coalesce((F.size(plain) == 1) & (plain[0]["role"] == F.col("role")) & (plain[0]["text"] == F.col("text")), F.lit(False)))
    rows = rows.withColumn("role_e", F.when(F.col("same"), F.col("role")).otherwise(escape_role(F.col("role")))).withColumn("text_e", F.when(F.col("same"), F.col("text")).otherwise(escape_text(F.col("text"))))
    rows = rows.withColumn("part", render(F.col("role_e"), F.col("text_e")))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    before = F.sum(F.length("part").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("at", F.coalesce(before, F.lit(0)) + F.lit(len(START) + 1) + F.length("role_e")).withColumn("seq", F.row_number().over(order))
    gathered = rows.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("seq", "part", "role", "text", "at", F.length("text_e").cast("long").alias("n")))).alias("t"),
        F.count_if(~F.col("same")).alias("n_escaped"),
    )
    formatted = gathered.select(
        "conv_id",
        F.array_join(F.transform("t", lambda x: x["part"]), "").alias("formatted"),
        F.transform(F.filter("t", lambda x: x["role"] == learn), lambda x: F.struct(x["at"].alias("start"), x["n"].alias("length"))).alias("loss_spans"),
        F.size("t").cast("long").alias("n_turns"),
        "n_escaped",
        F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("source"),
    )
    return formatted.select("conv_id", "formatted", "loss_spans", "n_turns", "n_escaped", F.when(parse(F.col("formatted")) == F.col("source"), True).otherwise(F.raise_error(F.concat(F.lit("no round trip of conversation "), F.coalesce(F.col("conv_id").cast("string"), F.lit("null")))).cast("boolean")).alias("round_trip"))


def loss_text(formatted: Column, loss_spans: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(loss_spans, lambda s: unescape_text(F.substr(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
