"""Chat formatting by grammar round trip, in DataFrame functions only.

A conversation is rendered as its turns, each

    ### <role>: <text>\\n</turn>\\n

The parser is deterministic: a turn starts with an unescaped `### `, its role ends at the first `: `, its text
ends at the first line that is an unescaped `</turn>`; inside, one backslash before each (possibly already
backslashed) control string is dropped. A rendered conversation is parsed and the turns compared with the
source; while they differ, every control string in the conflicting conversation's contents gets one more
backslash and the text is rendered and compared again. One round of escaping always suffices (the unescape
drops exactly the added backslash; roles are always escaped), and a conversation that still differed would stop the
job.

Defined cases: null role or text is the empty string; rows are ordered by turn (null first), ties by role and
text; repeated rows are repeated turns; a null conv_id is a conversation of its own; an empty table gives an
empty result; extra columns are ignored; long texts and long conversations take time in proportion to their length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.llm.winnowing import let

#: The control strings of the template.
TURN, END = "###", "</turn>"
_CONTROL = r"(\\*)(###|</turn>)"
_ESCAPED = r"\\(\\*)(###|</turn>)"
#: A turn: role up to the first ": " on its line, text up to the first closing line.
_GRAMMAR = r"(?s)### ([^\n]*?): (.*?)\n</turn>\n"
ASSISTANT = "assistant"


def escape(content: Column) -> Column:
    return F.regexp_replace(content, _CONTROL, r"\\$1$2")


def unescape(content: Column) -> Column:
    return F.regexp_replace(content, _ESCAPED, "$1$2")


def escape_role(role: Column) -> Column:
    """A role is one line without ": "; backslash, line feed and colon are written as \\\\, \\n and \\c."""
    for a, b in (("\\", "\\\\"), ("\n", "\\n"), (":", "\\c"), ("###", "\\h")):
        role = F.replace(role, F.lit(a), F.lit(b))
    return role


def unescape_role(role: Column) -> Column:
    """One pass from left to right: what lies between double backslashes holds no other escaped backslash."""

    def plain(part: Column) -> Column:
        for a, b in (("\\n", "\n"), ("\\c", ":"), ("\\h", "###")):
            part = F.replace(part, F.lit(a), F.lit(b))
        return part

    return F.array_join(F.transform(F.split(role, r"\\\\"), plain), "\\")


def render(turns: Column, with_escape: bool) -> Column:
    def one(t: Column) -> Column:
        text = escape(t["text"]) if with_escape else t["text"]
        return F.concat(F.lit("### "), escape_role(t["role"]), F.lit(": "), text, F.lit("\n</turn>\n"))

    return F.array_join(F.transform(turns, one), "")


def parse(formatted: Column) -> Column:
    """The turns (role, raw: as it stands in the text, text) of a rendered conversation."""
    roles = F.regexp_extract_all(formatted, F.lit(_GRAMMAR), F.lit(1))
    raws = F.regexp_extract_all(formatted, F.lit(_GRAMMAR), F.lit(2))
    return F.transform(F.arrays_zip(roles.alias("role"), raws.alias("raw")), lambda t: F.struct(unescape_role(t["role"]).alias("role"), t["raw"].alias("raw"), unescape(t["raw"]).alias("text"), F.char_length(t["role"]).alias("role_chars")))


def _same(parsed: Column, turns: Column) -> Column:
    return F.transform(parsed, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))) == F.transform(turns, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))


def format_chats(conversations: DataFrame, loss_role: str = ASSISTANT) -> DataFrame:
    """conv_id, formatted, escaped (whether a round of escaping was needed), turns (role, text; parsed back),
    loss_spans (start, end: code points of `formatted` whose tokens bear loss) and loss_texts (what stands at the spans,
    unescaped)."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    chats = conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("source"))  # gathered on the map side first
    chats = chats.withColumn("plain", render(F.col("source"), False)).withColumn("plain_turns", parse(F.col("plain")))
    chats = chats.withColumn("escaped", ~_same(F.col("plain_turns"), F.col("source")))
    chats = chats.withColumn("formatted", F.when(F.col("escaped"), render(F.col("source"), True)).otherwise(F.col("plain")))
    chats = chats.withColumn("parsed", F.when(F.col("escaped"), parse(F.col("formatted"))).otherwise(F.col("plain_turns")))
    chats = chats.withColumn("parsed", F.when(_same(F.col("parsed"), F.col("source")), F.col("parsed")).otherwise(F.raise_error(F.lit("a conversation does not survive the round trip")).cast("array<struct<role:string,raw:string,text:string,role_chars:int>>")))
    # "### " role ": " raw "\n</turn>\n"
    chats = chats.withColumn("sizes", F.transform("parsed", lambda t: F.lit(6) + t["role_chars"] + F.char_length(t["raw"]) + F.lit(9)))
    starts = F.zip_with("parsed", sums_before(F.col("sizes")), lambda t, s: F.struct(t["role"].alias("role"), t["text"].alias("text"), (s + F.lit(6) + t["role_chars"]).alias("start"), F.char_length(t["raw"]).alias("n")))
    lossy = F.filter(starts, lambda t: t["role"] == loss_role)
    return chats.select(
        "conv_id", "formatted", "escaped",
        F.transform("parsed", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"),
        F.transform(lossy, lambda t: F.struct(t["start"].alias("start"), (t["start"] + t["n"]).alias("end"))).alias("loss_spans"),
        F.transform(lossy, lambda t: t["text"]).alias("loss_texts"),
    )


def sums_before(sizes: Column, block: int = 128) -> Column:
    """For each element the sum of those before it. Sums run within blocks, so the work for an element is bounded by
    the block and the number of blocks and not by the length of the array."""

    def running(of: Column, first: Column) -> Column:  # first, first + of[0], ...: one more than there are elements
        return F.aggregate(of, F.array(first), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))

    zero = F.lit(0).cast("int")
    parts = lambda s: F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size(s) / block).cast("int") - 1, zero)), lambda b: F.slice(s, b * block + 1, F.lit(block)))
    befores = lambda ps: running(F.transform(ps, lambda p: F.aggregate(p, zero, lambda a, x: a + x)), zero)
    within = lambda ps, before: F.flatten(F.zip_with(ps, F.slice(before, F.lit(1), F.size(ps)), lambda p, b: F.slice(running(p, b), F.lit(1), F.size(p))))
    # bound once: inside the lambda of an element they would be made anew for each element
    return let(sizes, lambda s: let(parts(s), lambda ps: let(befores(ps), lambda before: within(ps, before))))


def digest(formatted: DataFrame) -> DataFrame:
    loss = F.array_join("loss_texts", "")  # as the parser read them at the spans
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    out = formatted.withColumn("__loss", loss)
    return out.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.char_length("__loss").cast("long").alias("loss_chars"), F.sha2(F.col("__loss"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"), "escaped",
    )
