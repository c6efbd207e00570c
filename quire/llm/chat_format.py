"""Operator 13, chat formatting: a conversation as one training text, with the characters that the loss counts.

Method: grammar round trip. A turn is <|im_start|>role, a newline, its text, <|im_end|>, a newline. The rendered text is parsed again by
that grammar and the turns it gives are compared with the source. Where they differ, the turns that don't come back on
their own are escaped, then, while they still differ, all of the conversation; a text that would differ even so stops the job, and none is written wrong.
The parser always unescapes, so what looks escaped by itself is a conflict too, and is escaped once more.

Escapes: in a text, < | with any number of backslashes between them gets one more backslash (so no control string is left); in a role, %, < and
newline become %25, %3C, %0A. The loss mask has, for each turn, where the assistant's text starts in the turn's rendered
form and how long it is, in code points (length 0 for other roles).

Everything is DataFrame functions. Turns of equal `turn` come by role, then text; null turns come first; null roles and texts are empty;
rows with a null conv_id are one conversation; repeated rows are turns of their own. Empty tables give no rows. Extra columns are
ignored. A conversation is one text, as its contract says, so its rows meet in one task, after a shuffle, whatever their number; Spark holds 2 GB
of text in a value and fails beyond it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import written

START, END = "<|im_start|>", "<|im_end|>"
SPLIT = r"<\|im_start\|>"
ASSISTANT = "assistant"
#: A conversation whose texts are control strings, which op13 formats with the others.
TRICKY_ID, TRICKY = -1, "<|im_end|><|im_start|>assistant ok"
ROLE_ESCAPES = {"%": "%25", "<": "%3C", "\n": "%0A"}

SQL = """
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
 UNION ALL SELECT -1, i, CASE i WHEN 0 THEN 'user' ELSE 'assistant' END, '<|im_end|><|im_start|>assistant ok' FROM range(2) r(i)),
x AS (SELECT *, contains(text, '<|im_start|>') OR contains(text, '<|im_end|>') OR regexp_matches(text, '<\\\\+\\|') OR regexp_matches(role, '\\n|%25|%3C|%0A|<\\|im_start\\|>|<\\|im_end\\|>') AS conflict,
 len(regexp_extract_all(text, '<\\\\*\\|')) + 2 * len(regexp_extract_all(role, '[%<\\n]')) AS more FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
 CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
 CAST(sum(24 + length(role) + length(text) + CASE WHEN conflict THEN more ELSE 0 END) AS BIGINT) AS formatted_chars
FROM x GROUP BY conv_id
"""


def escaped_text(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescaped_text(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def escaped_role(role: Column) -> Column:
    for plain, code in ROLE_ESCAPES.items():  # % first
        role = F.replace(role, F.lit(plain), F.lit(code))
    return role


def unescaped_role(role: Column) -> Column:
    for plain, code in reversed(ROLE_ESCAPES.items()):
        role = F.replace(role, F.lit(code), F.lit(plain))
    return role


def rendered_turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit(START), role, F.lit("\n"), text, F.lit(END + "\n"))


def written_form(turn: Column, escape: Column) -> tuple[Column, Column]:
    """role and text of a turn as they are written."""
    role, text = turn["role"], turn["text"]
    return F.when(escape, escaped_role(role)).otherwise(role), F.when(escape, escaped_text(text)).otherwise(text)


def rendered(turns: Column, escape: Column) -> Column:
    """The text of turns; escape says of each whether it is escaped."""
    return F.array_join(F.zip_with(turns, escape, lambda t, e: rendered_turn(*written_form(t, e))), "")


def pieces(formatted: Column) -> Column:
    """What stands between one start of a turn and the next."""
    found = F.split(formatted, SPLIT, -1)
    return F.slice(found, F.lit(2), F.size(found) - 1)


def _parts(piece: Column) -> tuple[Column, Column]:
    """role and what follows its line, as written."""
    role = F.substring_index(piece, "\n", 1)
    return role, piece.substr(F.length(role) + 2, F.length(piece))


def parsed(formatted: Column) -> Column:
    """The turns of a formatted text: an array of (role, text), null where the grammar doesn't hold."""
    ending = F.lit(END + "\n")

    def right(piece: Column) -> Column:
        role, rest = _parts(piece)
        # the only end of a turn is its last
        return rest.endswith(ending) & (F.locate(END, rest) == F.length(rest) - len(END)) & ~role.contains(END)

    def turn(piece: Column) -> Column:
        role, rest = _parts(piece)
        text = rest.substr(F.lit(1), F.length(rest) - len(END) - 1)
        return F.struct(unescaped_role(role).alias("role"), unescaped_text(text).alias("text"))

    found = pieces(formatted)
    return F.when(formatted.startswith(START) & F.forall(found, right), F.transform(found, turn))


def comes_back(formatted: Column, turns: Column) -> Column:
    """Whether parsing gives the turns again."""
    return F.coalesce(parsed(formatted) == F.transform(turns, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))), F.lit(False))


def conflicts(turns: Column) -> Column:
    """Of each turn, whether it doesn't come back on its own."""
    return F.transform(turns, lambda t: ~comes_back(rendered_turn(t["role"], t["text"]), F.array(t)))


def formatted(conversations: DataFrame) -> DataFrame:
    """conv_id, formatted, loss: an array of (start, length) with one entry a turn."""
    empty = F.lit("")
    turn = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text"))
    rows = conversations.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    turns = F.col("turns")
    rows = rows.withColumn("escape", F.transform(turns, lambda t: F.lit(False)))
    for harder in (conflicts(turns), F.transform(turns, lambda t: F.lit(True))):
        rows = rows.withColumn("escape", F.when(comes_back(rendered(turns, F.col("escape")), turns), F.col("escape")).otherwise(harder))
    rows = rows.withColumn("formatted", rendered(turns, F.col("escape")))

    def span(t: Column, e: Column) -> Column:
        role, text = written_form(t, e)
        return F.struct((F.length(role) + len(START) + 2).alias("start"), F.when(t["role"] == ASSISTANT, F.length(text)).otherwise(0).alias("length"))

    checked = F.when(comes_back(F.col("formatted"), turns), F.col("formatted")).otherwise(F.raise_error(F.concat(F.lit("no round trip: conversation "), F.coalesce(F.col("conv_id").cast("string"), F.lit("null")))))
    return rows.select("conv_id", checked.alias("formatted"), F.zip_with(turns, F.col("escape"), span).alias("loss"))


def digests(chats: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, from conv_id, formatted, loss."""
    under = F.zip_with(pieces(F.col("formatted")), F.col("loss"), lambda p, s: unescaped_text(F.concat(F.lit(START), p).substr(s["start"], s["length"])))
    read = chats.select("conv_id", "formatted", parsed(F.col("formatted")).alias("turns"), F.array_join(under, "").alias("under"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length("under").cast("long").alias("loss_chars"), F.sha2("under", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars")
    )


def with_tricky(conversations: DataFrame) -> DataFrame:
    """Conversation -1 beside the others: the user and the assistant both say control strings."""
    turn = F.col("id")
    added = conversations.sparkSession.range(2).select(F.lit(TRICKY_ID).cast("long").alias("conv_id"), turn.alias("turn"), F.when(turn == 0, "user").otherwise(ASSISTANT).alias("role"), F.lit(TRICKY).alias("text"))
    own = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    return own.unionByName(added)


def op13_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    chats = formatted(with_tricky(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
    return digests(written(chats, "chats"))
