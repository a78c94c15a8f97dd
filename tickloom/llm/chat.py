"""Chat formatting with a proven round trip.

A turn is rendered as ``### Role: text</turn>`` and a line feed. The parser is
deterministic: a turn ends at the next ``</turn>`` and line feed, its role ends at the first
colon and space, and a backslash makes the next character literal. Every turn is
rendered as it is, parsed again and compared; where the recovered turn differs,
its conflicting strings are escaped, and the result must then be identical.

Defined results: a null text is empty, a null role is the empty role; turns are
ordered by turn (null first), then role, then text; a null conversation id is a
conversation of its own. Without rows there are no conversations. Other columns
are ignored. A conversation becomes one string, so it is limited to 2 GB.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The template's control strings.
HEAD = "### "
COLON = ": "
END = "</turn>"
LOSS_ROLE = "assistant"


def escape(text: Column) -> Column:
    """Break every control string with a backslash inside it; backslashes are doubled first."""
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    text = F.replace(text, F.lit(END), F.lit("<\\/turn>"))
    return F.replace(text, F.lit(HEAD), F.lit("##\\# "))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit(COLON), F.lit(":\\ "))


def unescape(text: Column) -> Column:
    # The line feed may follow a backslash, too.
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def title(role: Column) -> Column:
    """The usual roles are shown capitalised; any other is kept as it is, marked by an equals sign."""
    return F.when(role.isin("user", "assistant", "system", "tool"), F.initcap(role)).otherwise(F.concat(F.lit("="), role))


def untitle(shown: Column) -> Column:
    return F.when(shown.startswith("="), F.expr("substring(shown, 2)")).otherwise(F.lower(shown))


def parse_turn(rendered: Column) -> tuple[Column, Column, Column]:
    """(shown role, raw text, whether the grammar accepts it) of one rendered turn without its end mark."""
    colon = F.locate(COLON, rendered)
    good = rendered.startswith(HEAD) & (colon > 0)
    shown = F.substring(rendered, F.lit(len(HEAD) + 1), colon - len(HEAD) - 1)
    raw = F.substring(rendered, colon + len(COLON), F.char_length(rendered))
    # Control strings inside what was recovered would have ended or begun a turn.
    clean = (F.locate(END, raw) == 0) & (F.locate(HEAD, raw) == 0)
    return unescape(shown), raw, good & clean


def render_turns(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per turn: ``conv_id, turn, role, text, rendered`` (without end mark), escaped only where the round trip needs it."""
    rows = turns.select(
        F.col(conv_id).alias("conv_id"),
        F.col(turn).alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
    )

    def whole(r: Column, t: Column) -> Column:
        return F.concat(F.lit(HEAD), r, F.lit(COLON), t)

    shown = title(F.col("role"))
    plain = rows.withColumn("plain", whole(shown, F.col("text")))
    plain = _recovered(plain, "plain")
    rendered = F.when(F.col("same"), F.col("plain")).otherwise(whole(escape_role(shown), escape(F.col("text"))))
    out = _recovered(plain.withColumn("rendered", rendered).drop("same"), "rendered")
    proven = F.when(F.col("same"), F.col("rendered")).otherwise(F.raise_error(F.lit("a turn does not survive the round trip")).cast("string"))
    return out.select("conv_id", "turn", "role", "text", proven.alias("rendered"))


def _recovered(rows: DataFrame, rendered: str) -> DataFrame:
    shown, raw, good = parse_turn(F.col(rendered))
    read = rows.withColumns({"shown": shown, "raw": raw, "good": good})
    same = F.col("good") & (untitle(F.col("shown")) == F.col("role")) & (unescape(F.col("raw")) == F.col("text"))
    return read.withColumn("same", F.coalesce(same, F.lit(False))).drop("shown", "raw", "good")


def format_conversations(turns: DataFrame, **columns: str) -> DataFrame:
    """One row per conversation: ``conv_id, formatted, loss``; ``loss`` lists the spans
    (start, length, in code points of ``formatted``) of the assistant's texts as rendered."""
    rows = render_turns(turns, **columns)
    end = END + "\n"
    head = F.locate(COLON, F.col("rendered")) + len(COLON) - 1
    rows = rows.select(
        "conv_id", "turn", "role", "text", F.concat("rendered", F.lit(end)).alias("rendered"), head.cast("long").alias("head")
    ).withColumn("size", F.char_length("rendered").cast("long"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("start", F.sum("size").over(order) - F.col("size"))
    turn = F.struct("start", "rendered", (F.col("role") == LOSS_ROLE).alias("is_loss"), "head", "size")
    grouped = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    return grouped.select(
        "conv_id",
        F.array_join(F.transform("turns", lambda t: t["rendered"]), "").alias("formatted"),
        F.transform(
            F.filter("turns", lambda t: t["is_loss"]),
            lambda t: F.struct((t["start"] + t["head"]).alias("start"), (t["size"] - t["head"] - len(end)).alias("length")),
        ).alias("loss"),
    )


def read_conversations(formatted: DataFrame) -> DataFrame:
    """Parse formatted conversations: ``conv_id, formatted, turns, loss_texts``; ``turns`` is an array of (role, text).

    ``loss_texts`` are cut out of ``formatted`` by the stored spans of ``loss``, then unescaped.
    """
    # Every end mark is real: inside texts it is always escaped.
    pieces = F.split("formatted", r"\Q" + END + r"\E\n")
    # The last piece is what follows the last end mark: nothing.
    pieces = F.slice(pieces, F.lit(1), F.size(pieces) - 1)

    def turn(piece: Column) -> Column:
        colon = F.locate(COLON, piece)
        shown = unescape(F.substring(piece, F.lit(len(HEAD) + 1), colon - len(HEAD) - 1))
        role = F.when(shown.startswith("="), F.substring(shown, F.lit(2), F.char_length(shown))).otherwise(F.lower(shown))
        text = unescape(F.substring(piece, colon + len(COLON), F.char_length(piece)))
        return F.struct(role.alias("role"), text.alias("text"))

    cut = lambda span: unescape(F.substring(F.col("formatted"), span["start"].cast("int") + 1, span["length"].cast("int")))
    return formatted.select("conv_id", "formatted", F.transform(pieces, turn).alias("turns"), F.transform("loss", cut).alias("loss_texts"))
