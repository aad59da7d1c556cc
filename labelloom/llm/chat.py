"""Chat formatting by prefix-target expansion, in DataFrame functions only.

Template: ``[INST]`` text ``[/INST]`` for a user, text ``</s>`` for an
assistant, ``[ROLE name]`` text ``[/ROLE]`` for any other role (its name is
URL-encoded).  Inside a text every backslash is doubled, and a backslash is put
after the first character of each control string, so a formatted text holds no
control string of its own and can be read back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelloom.llm.common import text_of

CONTROL = r"([<\[])(/?(?:s>|INST\]|ROLE))"
# A turn: the first two forms have an opening, an assistant's has only an end.
TURN = r"(?s)\[INST\].*?\[/INST\]|\[ROLE [^\]]*\].*?\[/ROLE\]|.*?</s>"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), CONTROL, r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_turn(role: Column, text: Column) -> Column:
    body = escape(text)
    return (F.when(role == "assistant", F.concat(body, F.lit("</s>")))
            .when(role == "user", F.concat(F.lit("[INST]"), body, F.lit("[/INST]")))
            .otherwise(F.concat(F.lit("[ROLE "), F.url_encode(role), F.lit("]"), body, F.lit("[/ROLE]"))))


def parse_turns(formatted: Column) -> Column:
    """An array of (role, text) from a formatted text."""
    def parsed(turn: Column) -> Column:
        head = F.regexp_extract(turn, r"(?s)^(\[INST\]|\[ROLE [^\]]*\])?", 1)
        body = unescape(F.regexp_extract(turn, r"(?s)^(?:\[INST\]|\[ROLE [^\]]*\])?(.*)(?:\[/INST\]|\[/ROLE\]|</s>)$", 1))
        role = (F.when(head == "", "assistant").when(head == "[INST]", "user")
                .otherwise(F.url_decode(F.regexp_extract(head, r"^\[ROLE ([^\]]*)\]$", 1))))
        return F.struct(role.alias("role"), body.alias("text"))
    return F.transform(F.regexp_extract_all(formatted, F.lit(TURN), F.lit(0)), parsed)


def expand(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
           text_col: str = "text") -> DataFrame:
    """One example for each assistant turn, with all earlier turns as its context.

    Returns (conv_id, example, n_turns, formatted, loss_start, loss_end, last):
    the loss covers the code points [loss_start, loss_end) of ``formatted``,
    which are the reply alone.  Turns after the last reply (or all, if there is
    none) are the context of one more example without loss, so nothing is lost.

    Rows are ordered by turn, then role and text; a null turn comes first, and
    repeated rows are turns of their own.  Null roles and texts count as empty.
    Rows of a null id form one conversation.  Other columns are ignored; an
    empty table gives no example.  An example holds its whole context, so a
    conversation has to fit into a task's memory.
    """
    turn = F.struct(F.col(turn_col).alias("turn"), text_of(role_col).alias("role"), text_of(text_col).alias("text"))
    talks = turns.groupBy(F.col(conv_col).alias("conv_id")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    talks = talks.select(
        "conv_id", F.size("turns").alias("n_turns"),
        F.transform("turns", lambda t: t["role"] == "assistant").alias("replies"),
        F.transform("turns", lambda t: format_turn(t["role"], t["text"])).alias("pieces"))
    places = F.sequence(F.lit(1), F.col("n_turns"))
    chosen = F.filter(places, lambda i: F.get("replies", i - 1) | (i == F.col("n_turns")))
    examples = talks.select("*", F.posexplode(chosen).alias("example", "end"))
    context = F.array_join(F.slice("pieces", 1, F.col("end") - 1), "")
    examples = examples.select(
        "conv_id", "example", "n_turns", (F.col("end") == F.col("n_turns")).alias("last"),
        F.get("replies", F.col("end") - 1).alias("is_reply"), context.alias("context"),
        F.get("pieces", F.col("end") - 1).alias("piece"))
    begin = F.length("context")
    stop = begin + F.length("piece") - len("</s>")
    return examples.select(
        "conv_id", "example", F.col("n_turns").cast("long").alias("n_turns"),
        F.concat("context", "piece").alias("formatted"),
        F.when(F.col("is_reply"), begin).otherwise(0).alias("loss_start"),
        F.when(F.col("is_reply"), stop).otherwise(0).alias("loss_end"), "last")


def read_back(examples: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars).

    Everything is parsed from the formatted texts and their loss spans: the
    turns from each conversation's last example, the replies from all of them.
    ``formatted_chars`` counts the code points of all its examples.
    """
    spoken = F.transform(parse_turns(F.col("formatted")),
                         lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    size = F.col("loss_end") - F.col("loss_start")
    reply = unescape(F.substring("formatted", F.col("loss_start") + 1, size))
    read = examples.select(
        "conv_id", F.struct("example", reply.alias("reply")).alias("reply"), F.length("formatted").alias("chars"),
        F.when(F.col("last"), F.size(parse_turns(F.col("formatted")))).alias("n_turns"),
        F.when(F.col("last"), F.sha2(F.array_join(spoken, ""), 256)).alias("turns_sha256"))
    talks = read.groupBy("conv_id").agg(
        F.max("n_turns").cast("long").alias("n_turns"), F.max("turns_sha256").alias("turns_sha256"),
        F.array_join(F.transform(F.sort_array(F.collect_list("reply")), lambda r: r["reply"]), "").alias("replies"),
        F.sum("chars").alias("formatted_chars"))
    return talks.select("conv_id", "n_turns", "turns_sha256", F.length("replies").cast("long").alias("loss_chars"),
                        F.sha2("replies", 256).alias("loss_sha256"), "formatted_chars")
