"""Chat formatting: a finite-state machine over roles checks the order of turns, and a declarative template turns
conversations into text segments that each carry a loss flag. Built from DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """How a turn is written: opening + role + after_role + text + closing. The escapes map every character that a
    control string starts with (and the escape character) to a two-character code, so no text can hold a control
    string and the codes can be undone. `trained` roles carry the loss, on their text alone."""

    opening: str = "### "
    after_role: str = ": "
    closing: str = "</turn>\n"
    escape: str = "\\"
    codes: tuple[tuple[str, str], ...] = (("\\", "b"), ("#", "h"), ("<", "l"), (":", "c"))
    trained: tuple[str, ...] = ("assistant",)
    #: state -> {role: next state}; `*` stands for any other role. "start" is the first state.
    machine: dict[str, dict[str, str]] = field(
        default_factory=lambda: {
            "start": {"system": "instructed", "user": "asked"},
            "instructed": {"user": "asked"},
            "asked": {"assistant": "answered", "tool": "asked"},
            "answered": {"user": "asked", "tool": "asked"},
        }
    )
    accepting: tuple[str, ...] = ("answered",)

    def escaped(self, text: Column) -> Column:
        for char, code in self.codes:  # the escape character comes first
            text = F.replace(text, F.lit(char), F.lit(self.escape + code))
        return text

    def unescaped(self, text: Column) -> Column:
        for char, code in reversed(self.codes):  # and last
            text = F.replace(text, F.lit(self.escape + code), F.lit(char))
        return text


def _machine(template: Template, roles: Column) -> Column:
    """Runs the machine: struct(state, violations). After a role that the state doesn't allow, the
    machine goes on from where that role leads in any state, so one fault counts once."""
    anywhere = {role: to for moves in template.machine.values() for role, to in moves.items()}

    def step(acc: Column, x: Column) -> Column:
        to = F.lit(None).cast("string")
        for state, moves in template.machine.items():
            for role, target in moves.items():
                to = F.when((acc["state"] == state) & (x["role"] == role), F.lit(target)).otherwise(to)
        lenient = acc["state"]
        for role, target in anywhere.items():
            lenient = F.when(x["role"] == role, F.lit(target)).otherwise(lenient)
        return F.struct(
            F.coalesce(to, lenient).alias("state"),
            (acc["violations"] + F.when(to.isNull(), 1).otherwise(0)).alias("violations"),
        )

    return F.aggregate(roles, F.struct(F.lit("start").alias("state"), F.lit(0).alias("violations")), step)


def format_conversations(turns: DataFrame, template: Template | None = None) -> DataFrame:
    """conversations(conv_id, turn, role, text) -> one row per conv_id: conv_id, segments array<struct<text, loss>>
    (in order, joined they are the formatted text), formatted, valid, n_violations.

    Rows are ordered by turn, ties by role and text; a null turn comes first, a null role or text is empty, null
    conv_ids form one conversation, repeated rows stay, an empty table gives none. A conversation becomes one row, so its length is bounded by
    what a row may hold; that is what the output asks for.
    """
    t = template or Template()
    rows = turns.select(
        "conv_id",
        F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("x"),
    )
    grouped = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("x")).alias("x"))
    segments = F.flatten(
        F.transform(
            "x",
            lambda x: F.array(
                F.struct(F.concat(F.lit(t.opening), t.escaped(x["role"]), F.lit(t.after_role)).alias("text"), F.lit(False).alias("loss")),
                F.struct(t.escaped(x["text"]).alias("text"), x["role"].isin(*t.trained).alias("loss")),
                F.struct(F.lit(t.closing).alias("text"), F.lit(False).alias("loss")),
            ),
        )
    )
    run = grouped.withColumn("run", _machine(t, F.col("x"))).withColumn("segments", segments)
    return run.select(
        "conv_id",
        "segments",
        F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
        (F.col("run.state").isin(*t.accepting) & (F.col("run.violations") == 0)).alias("valid"),
        F.col("run.violations").cast("long").alias("n_violations"),
    )


def parse_conversations(formatted: DataFrame, template: Template | None = None) -> DataFrame:
    """Reads formatted text back: adds turns array<struct<role, text>>, unescaped, in order."""
    t = template or Template()
    parts = F.filter(F.split("formatted", _quoted(t.closing)), lambda p: p != "")
    turn = lambda p: F.struct(
        t.unescaped(F.substring_index(F.substr(p, F.lit(len(t.opening) + 1)), t.after_role, 1)).alias("role"),
        t.unescaped(F.substr(p, F.lit(len(t.opening) + 1) + F.length(F.substring_index(F.substr(p, F.lit(len(t.opening) + 1)), t.after_role, 1)) + F.lit(len(t.after_role)))).alias("text"),
    )
    return formatted.withColumn("turns", F.transform(parts, turn))


def _quoted(text: str) -> str:
    return "".join("\\" + c if not c.isalnum() and not c.isspace() else c for c in text)


def conversation_digests(turns: DataFrame, template: Template | None = None) -> DataFrame:
    """Formats, reads back, and digests what was read: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256,
    formatted_chars, valid, n_violations. Odd rows are treated as format_conversations says; an empty table gives no rows."""
    t = template or Template()
    read = parse_conversations(format_conversations(turns, t), t)
    trained = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: t.unescaped(s["text"])), "")
    return read.withColumn("loss_text", trained).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
        "n_violations",
    )
