"""Chat formatting from a declarative template.

A finite-state machine over roles checks the order of turns. A conversation becomes a
list of text segments with a loss flag each, and their concatenation. Control strings
inside texts are escaped, so the formatted text can be parsed back without loss.
Everything is plain column expressions.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilgauge.llm.common import columns_or_raise

START = "start"


@dataclass(frozen=True)
class Template:
    """Marks around turns, the role transitions allowed, and the roles whose text is learnt.

    Every mark has to begin with `control`, which never occurs in an escaped text.
    """

    open: str = "<|im_start|>"
    close: str = "<|im_end|>"
    control: str = "<|"
    after: dict[str, tuple[str, ...]] = field(default_factory=lambda: {
        START: ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})
    last: tuple[str, ...] = ("assistant",)
    learnt: tuple[str, ...] = ("assistant",)

    def __post_init__(self) -> None:
        if len(self.control) < 2 or "\\" in self.control or not (
                self.open.startswith(self.control) and self.close.startswith(self.control)) or self.open == self.close:
            raise ValueError("marks differ and begin with a control string of two or more characters")


CHATML = Template()


def escape(text: Column, template: Template = CHATML) -> Column:
    """Double each backslash, then part every control string with a single one."""
    first, rest = template.control[0], template.control[1:]
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.replace(doubled, F.lit(template.control), F.lit(first + "\\" + rest))


def unescape(text: Column, template: Template = CHATML) -> Column:
    first, rest = template.control[0], template.control[1:]
    parts = F.transform(F.split(text, "\\\\\\\\"), lambda x: F.replace(
        F.replace(x, F.lit("\\n"), F.lit("\n")), F.lit(first + "\\" + rest), F.lit(template.control)))
    return F.array_join(parts, "\\")


def _role_text(role: Column, template: Template) -> Column:
    return F.replace(escape(role, template), F.lit("\n"), F.lit("\\n"))


def format_chats(turns: DataFrame, template: Template = CHATML) -> DataFrame:
    """One row per conversation: `segments` (text, loss), `formatted`, `valid`, `first_error`.

    `turns` has conv_id, turn, role and text; further columns are ignored. Turns are
    taken in the order of turn, role, text, nulls first, and repeated rows stay. Null
    text and null role count as empty. Invalid conversations are formatted as well;
    `first_error` is the position of the first turn that the machine does not accept,
    the number of turns if only the end is wrong, or null. Rows without conv_id form
    one conversation.
    """
    columns_or_raise(turns, "conv_id", "turn", "role", "text")
    gathered = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    clean = gathered.select("conv_id", F.transform("turns", lambda t: F.struct(
        F.coalesce(t["role"], F.lit("")).alias("role"), F.coalesce(t["text"], F.lit("")).alias("text"))).alias("turns"))
    moves = F.create_map(*[x for state, roles in template.after.items()
                           for x in (F.lit(state), F.array(*[F.lit(r) for r in roles]))])

    def step(state: Column, turn: Column) -> Column:
        allowed = F.coalesce(F.array_contains(F.element_at(moves, state["role"]), turn["role"]), F.lit(False))
        error = F.when(state["error"].isNull() & ~allowed, state["n"]).otherwise(state["error"])
        return F.struct(turn["role"].alias("role"), (state["n"] + 1).alias("n"), error.alias("error"))

    first = F.struct(F.lit(START).alias("role"), F.lit(0).alias("n"), F.lit(None).cast("int").alias("error"))
    machine = F.aggregate("turns", first, step, lambda s: F.when(
        s["error"].isNull() & ~s["role"].isin(*template.last), s["n"]).otherwise(s["error"]))
    segment = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    segments = F.flatten(F.transform("turns", lambda t: F.array(
        segment(F.concat(F.lit(template.open), _role_text(t["role"], template), F.lit("\n")), F.lit(False)),
        segment(escape(t["text"], template), t["role"].isin(*template.learnt)),
        segment(F.lit(template.close + "\n"), F.lit(False)))))
    formatted = clean.select("conv_id", segments.alias("segments"), machine.alias("first_error"))
    return formatted.select("conv_id", "segments", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
                            F.col("first_error").isNull().alias("valid"), "first_error")


def parsed(formatted: Column, template: Template = CHATML) -> Column:
    """The turns (role, text) of a formatted conversation."""
    tail = len(template.close) + 1
    bodies = F.filter(F.split(formatted, "\\Q" + template.open + "\\E"), lambda x: x != "")

    def turn(body: Column) -> Column:
        at = F.instr(body, F.lit("\n"))
        return F.struct(unescape(body.substr(F.lit(1), at - 1), template).alias("role"),
                        unescape(body.substr(at + 1, F.length(body) - at - tail), template).alias("text"))

    return F.transform(bodies, turn)


def learnt_text(segments: Column, template: Template = CHATML) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"], template)), "")
