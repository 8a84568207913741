"""Chat formatting by a grammar round trip, in DataFrame functions alone.

The template writes a turn between the two marks of its role, and a turn of any
other role with the role's name:

    [INST]user text[/INST]   <s>assistant text</s>   <<SYS>>system text<</SYS>>
    [ROLE]name[=]text[/ROLE]

The grammar is regular: a turn is an opening mark, content without any mark, and
the closing mark of the same kind; a conversation is a row of turns. Content is
read with the entities ``&amp;`` ``&lt;`` ``&#91;`` turned back into what they
stand for.

Every turn is rendered as it is and parsed again. Where that does not give back
role and text, the conflicting content (marks and entities) is escaped and the
turn parsed again; where even that differs, every ``&``, ``<`` and ``[`` is
escaped, after which no mark can be left. No mark can arise between two turns,
since each ends with a whole mark. ``level`` tells which of the three it took.
The conversation joins its turns in order and is parsed as a whole once more
when read back.

The loss mask covers the text of assistant turns. ``mask`` has one span a turn,
as places in that turn's part of the output (``length`` code points long).

Turns are gathered by conversation in two steps, ranges of turn numbers first,
so a long conversation is sorted and joined by several tasks; what is left is
one row a conversation, which its digest needs. Turns go by number, nulls first,
then by role and text; repeated rows are turns of their own. Null texts and
roles are empty ones. Rows without a conv_id make one conversation. An empty
table gives no rows. Long texts are handled whole. Columns beyond ``conv_id``,
``turn``, ``role`` and ``text`` are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import pick

#: The marks around each role's text; any other role is named.
ROLE_MARKS = {"user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>"), "system": ("<<SYS>>", "<</SYS>>")}
NAMED, NAME_END, NAMED_END = "[ROLE]", "[=]", "[/ROLE]"
MARKS = [*(m for pair in ROLE_MARKS.values() for m in pair), NAMED, NAME_END, NAMED_END]
#: What each special character is written as. The last is read back last.
ENTITIES = {"<": "&lt;", "[": "&#91;", "&": "&amp;"}
TRAINED = "assistant"
#: Turn numbers that are gathered together first.
RANGE = 64

_MARK = "|".join(re.escape(m) for m in MARKS)
#: Runs of characters that begin no mark (possessive, so that nothing recurses).
_CONTENT = rf"(?:[^\[<]++|(?!{_MARK})[\[<])*+"
#: One turn of the grammar.
TURN = "|".join(
    [re.escape(a) + _CONTENT + re.escape(b) for a, b in ROLE_MARKS.values()]
    + [re.escape(NAMED) + _CONTENT + re.escape(NAME_END) + _CONTENT + re.escape(NAMED_END)]
)


def escaped(text: Column, everything: bool = False) -> Column:
    """Entities for the first characters of marks and of entities; or for all
    special characters."""
    for character, entity in reversed(ENTITIES.items()):
        if everything:
            text = F.replace(text, F.lit(character), F.lit(entity))
            continue
        rest = [m[1:] for m in (ENTITIES.values() if character == "&" else MARKS) if m[0] == character]
        ahead = "|".join(re.escape(r) for r in rest)
        text = F.regexp_replace(text, rf"{re.escape(character)}(?={ahead})", entity)
    return text


def unescaped(content: Column) -> Column:
    for character, entity in ENTITIES.items():
        content = F.replace(content, F.lit(entity), F.lit(character))
    return content


def rendered(role: Column, text: Column) -> Column:
    """One turn, of escaped role and text."""
    turn = F.concat(F.lit(NAMED), role, F.lit(NAME_END), text, F.lit(NAMED_END))
    for name, (start, end) in ROLE_MARKS.items():
        turn = F.when(role == name, F.concat(F.lit(start), text, F.lit(end))).otherwise(turn)
    return turn


def _inside(turn: Column, start: str, end: str) -> Column:
    return F.substring(turn, F.lit(len(start) + 1), F.char_length(turn) - len(start) - len(end))


def parsed_role(turn: Column) -> Column:
    """The role of a turn of the grammar."""
    name = unescaped(F.substring_index(_inside(turn, NAMED, ""), NAME_END, 1))
    for role, (start, _) in ROLE_MARKS.items():
        name = F.when(F.startswith(turn, F.lit(start)), F.lit(role)).otherwise(name)
    return name


def parsed_text(turn: Column) -> Column:
    """The text of a turn of the grammar."""
    text = F.substring_index(_inside(turn, "", NAMED_END), NAME_END, -1)
    for role, (start, end) in ROLE_MARKS.items():
        text = F.when(F.startswith(turn, F.lit(start)), _inside(turn, start, end)).otherwise(text)
    return unescaped(text)


def _reads_back(turn: Column, role: Column, text: Column) -> Column:
    whole = F.regexp_like(turn, F.lit(f"^(?:{TURN})\\z"))
    return F.when(whole, (parsed_role(turn) == role) & (parsed_text(turn) == text)).otherwise(False)


def format_turns(conversations: DataFrame) -> DataFrame:
    """Per turn: conv_id, turn, role, text, level, formatted, and where its text
    under the loss mask starts and how long it is (0 for other roles)."""
    rows = pick(conversations, "conv_id", "turn", "role", "text").select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    role, text = F.col("role"), F.col("text")
    tried = [(role, text), (escaped(role), escaped(text)), (escaped(role, True), escaped(text, True))]
    said = F.array(*[F.struct(r.alias("role"), t.alias("text")) for r, t in tried])
    forms = F.transform(
        said, lambda x, level: F.struct(level.alias("level"), rendered(x["role"], x["text"]).alias("formatted"))
    )
    first = F.filter(forms, lambda x: _reads_back(x["formatted"], role, text))[0]
    start, end = ROLE_MARKS[TRAINED]
    trained = F.when(role == TRAINED, F.char_length("formatted") - len(start) - len(end)).otherwise(0)
    found = rows.withColumn("first", first).select("conv_id", "turn", "role", "text", "first.level", "first.formatted")
    return found.withColumns({"loss_start": F.lit(len(start)), "loss_length": trained})


def format_conversations(conversations: DataFrame) -> DataFrame:
    """Per conversation: conv_id, formatted, and mask (an array of length,
    loss_start, loss_length by turn)."""
    turns = format_turns(conversations)
    order = ["turn", "role", "text"]
    span = F.struct(F.char_length("formatted").alias("length"), "loss_start", "loss_length").alias("span")
    held = turns.withColumn("range", F.floor(F.col("turn") / RANGE)).withColumn("t", F.struct(*order, "formatted", span))
    ranges = held.groupBy("conv_id", "range").agg(F.sort_array(F.collect_list("t")).alias("t"))
    joined = ranges.select(
        "conv_id",
        F.struct(
            "range",
            F.array_join(F.col("t.formatted"), "").alias("formatted"),
            F.col("t.span").alias("mask"),
        ).alias("r"),
    )
    whole = joined.groupBy("conv_id").agg(F.sort_array(F.collect_list("r")).alias("r"))
    return whole.select(
        "conv_id", F.array_join(F.col("r.formatted"), "").alias("formatted"), F.flatten(F.col("r.mask")).alias("mask")
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation: conv_id, n_turns, turns (``role\\ntext\\n`` of each),
    loss (all text under the mask), formatted_chars; from the output alone."""
    turn = F.regexp_extract_all("formatted", F.lit(TURN), F.lit(0))
    parsed = formatted.select("conv_id", "formatted", "mask", turn.alias("turn"))
    whole = F.array_join("turn", "") == F.col("formatted")
    said = F.transform("turn", lambda t: F.concat(parsed_role(t), F.lit("\n"), parsed_text(t), F.lit("\n")))
    masked = F.transform(
        F.arrays_zip("turn", "mask"),
        lambda x: unescaped(F.substring(x["turn"], x["mask"]["loss_start"] + 1, x["mask"]["loss_length"])),
    )
    return parsed.select(
        "conv_id",
        F.when(whole, F.size("turn")).otherwise(F.raise_error(F.lit("not of the grammar"))).cast("long").alias("n_turns"),
        F.array_join(said, "").alias("turns"),
        F.array_join(masked, "").alias("loss"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
