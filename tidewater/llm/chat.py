"""Chat formatting in budgeted windows, as DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.llm.shared import let

#: A turn is OPEN, a kind, "|", the role, ">", the text and CLOSE. Kinds: n new, h repeated history, s the repeated system turn.
OPEN, CLOSE = "<turn|", "</turn>"


def escaped(text: Column) -> Column:
    r"""No < or > is left: \ becomes \b, < becomes \l and > becomes \g."""
    for mark, letter in (("\\", "b"), ("<", "l"), (">", "g")):
        text = F.replace(text, F.lit(mark), F.lit("\\" + letter))
    return text


def unescaped(text: Column) -> Column:
    r"""The inverse of escaped(): every \ it sees has a letter after it, so the order \g, \l, \b is safe."""
    for mark, letter in ((">", "g"), ("<", "l"), ("\\", "b")):
        text = F.replace(text, F.lit("\\" + letter), F.lit(mark))
    return text


def token_estimate(role: Column, text: Column) -> Column:
    """Tokens of a formatted turn: a quarter of the UTF-8 bytes of its escaped role and text and its marks, rounded up."""
    return F.ceil((F.octet_length(escaped(role)) + F.octet_length(escaped(text)) + len(OPEN) + len("n|>") + len(CLOSE)) / 4)


#: Prefix sums are taken in blocks of so many turn numbers, and then over blocks.
_BLOCK_TURNS = 1024


def format_windows(turns: DataFrame, *, budget: int = 512, history: int = 128, tokens_col: str | None = None, stretch_budgets: int = 64) -> DataFrame:
    """Formats conversations (conv_id, turn, role, text) as windows of whole turns:
    (conv_id, window, text, loss array<struct<start, length>>, n_tokens).

    Prefix sums of the turns' tokens choose the spans: a window takes
    turns while its own tokens stay within `budget` less `history` and the system
    turn; a turn over that has a window of its own. Later windows repeat the
    system turn (the first turn, if its role is system) and as many turns
    before their own as fit into `history`. Only assistant turns in their first
    window are under the loss mask, whose spans are code points of the window's
    text; repeated ones are masked. Texts and roles are escaped, reversibly. Tokens are
    those of the formatted turn, marks and escapes included: a column `tokens_col`, at least 1, or an estimate by bytes.
    `window` is the number of the conversation's tokens before the window's own turns.

    One task never needs a whole conversation: prefix sums are taken in blocks of turn numbers, and a new window begins
    wherever they pass a multiple of `stretch_budgets` budgets. A row, while windows are made, is one such stretch, with the
    system turn and what its first windows may repeat of the stretch before.

    Turns are ordered by (turn, role, text), nulls first; null texts and roles are empty; repeated
    rows are turns of their own; a null conv_id is a conversation. Very long turns are windows of their own.
    Extra columns are not read. An empty table gives an empty one.
    """
    stretch = stretch_budgets * budget
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    tokens = F.greatest(F.col(tokens_col), F.lit(1)) if tokens_col else token_estimate(role, text)
    block = F.coalesce(F.floor(F.col("turn") / _BLOCK_TURNS), F.lit(-(1 << 62))).cast("long")
    clean = turns.select("conv_id", "turn", block.alias("block"), role.alias("role"), text.alias("text"), tokens.cast("long").alias("tokens"))
    of_conv, of_block = Window.partitionBy("conv"), Window.partitionBy("conv_id", "block")
    sums = clean.groupBy(F.col("conv_id").alias("conv"), F.col("block").alias("in_block")).agg(F.sum("tokens").alias("sum"))
    offsets = sums.select("conv", "in_block", (F.sum("sum").over(of_conv.orderBy("in_block")) - F.col("sum")).alias("offset"), F.sum("sum").over(of_conv).alias("all"))
    placed = clean.join(offsets, F.col("conv_id").eqNullSafe(F.col("conv")) & (F.col("block") == F.col("in_block"))).drop("conv", "in_block")
    through = F.col("offset") + F.sum("tokens").over(of_block.orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, 0))
    placed = placed.withColumn("before", through - F.col("tokens"))

    own = F.floor(F.col("before") / stretch)
    last = F.floor((F.col("all") - 1) / stretch)
    again = F.when((F.col("before") == 0) & (F.col("role") == "system") & (last > 0), F.sequence(F.lit(1).cast("long"), last)).when(
        (own < last) & ((own + 1) * stretch - F.col("before") <= history), F.array(own + 1)
    )
    one = F.struct("before", "role", "text", "tokens")
    rows = placed.select("conv_id", F.explode(F.concat(F.array(own), F.coalesce(again, F.array().cast("array<bigint>")))).alias("part"), one.alias("t"))
    grouped = rows.groupBy("conv_id", "part").agg(F.sort_array(F.collect_list("t")).alias("turns"))

    def spans(ts: Column, room: Column, start: Column) -> Column:
        """Which of the numbered turns each window has of its own, from the first that lies in the stretch on."""
        zero = F.struct(start.alias("from"), F.element_at(ts, start)["before"].alias("before"), F.array().cast("array<struct<from:int,to:int>>").alias("done"))

        def step(a: Column, t: Column) -> Column:
            full = (t["before"] + t["tokens"] - a["before"] > room) & (t["k"] > a["from"])
            closed = F.struct(a["from"].alias("from"), (t["k"] - 1).alias("to"))
            return F.when(full, F.struct(t["k"].alias("from"), t["before"].alias("before"), F.array_append(a["done"], closed).alias("done"))).otherwise(a)

        return F.aggregate(F.slice(ts, start, F.size(ts)), zero, step, lambda a: F.array_append(a["done"], F.struct(a["from"].alias("from"), F.size(ts).alias("to"))))

    def window(ts: Column, has_system: Column, span: Column) -> Column:
        first = span["from"]
        own = F.element_at(ts, first)
        system = F.when(has_system & (first > 1), F.slice(ts, 1, 1)).otherwise(F.slice(ts, 1, 0))
        # a turn has a token at least
        low = F.greatest(F.when(has_system, 2).otherwise(1), first - history)
        recent = F.filter(F.slice(ts, low, F.greatest(first - low, F.lit(0))), lambda t: own["before"] - t["before"] <= history)

        def part(kind: str):
            return lambda t: F.struct(
                F.concat(F.lit(f"{OPEN}{kind}|"), escaped(t["role"]), F.lit(">")).alias("head"),
                escaped(t["text"]).alias("body"),
                (t["role"] == "assistant").alias("loss") if kind == "n" else F.lit(False).alias("loss"),
                t["tokens"].alias("tokens"),
            )

        def placed(ps: Column) -> Column:
            zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("loss"), F.lit(0).cast("long").alias("tokens"))

            def step(a: Column, p: Column) -> Column:
                start, size = a["at"] + F.length(p["head"]), F.length(p["body"]).cast("long")
                spot = F.struct(start.alias("start"), size.alias("length"))
                return F.struct(
                    (start + size + len(CLOSE)).alias("at"),
                    F.when(p["loss"], F.array_append(a["loss"], spot)).otherwise(a["loss"]).alias("loss"),
                    (a["tokens"] + p["tokens"]).alias("tokens"),
                )

            text = F.array_join(F.transform(ps, lambda p: F.concat(p["head"], p["body"], F.lit(CLOSE))), "")
            return let(F.aggregate(ps, zero, step), lambda a: F.struct(own["before"].alias("window"), text.alias("text"), a["loss"].alias("loss"), a["tokens"].alias("n_tokens")))

        new = F.slice(ts, first, span["to"] - first + 1)
        return let(F.concat(F.transform(system, part("s")), F.transform(recent, part("h")), F.transform(new, part("n"))), placed)

    def windows(sorted_turns: Column, number: Column) -> Column:
        numbered = F.transform(sorted_turns, lambda t, i: F.struct(t["before"].alias("before"), t["role"].alias("role"), t["text"].alias("text"), t["tokens"].alias("tokens"), (i + 1).alias("k")))

        def of(ts: Column) -> Column:
            has_system = (F.element_at(ts, 1)["before"] == 0) & (F.element_at(ts, 1)["role"] == "system")
            room = F.greatest(F.lit(1), F.lit(budget - history) - F.when(has_system, F.element_at(ts, 1)["tokens"]).otherwise(0))
            start = F.size(F.filter(ts, lambda t: t["before"] < number * stretch)) + 1
            made = let(F.struct(spans(ts, room, start).alias("s"), has_system.alias("h")), lambda x: F.transform(x["s"], lambda span: window(ts, x["h"], span)))
            # a stretch inside one long turn has no turn of its own
            return F.when(start <= F.size(ts), made)

        return let(numbered, of)

    return grouped.select("conv_id", F.explode(windows(F.col("turns"), F.col("part"))).alias("w")).select("conv_id", "w.*")


def read_back(windows: DataFrame) -> DataFrame:
    """What format_windows() wrote, from its text and loss spans alone:
    (conv_id, window, turns array<struct<role, text>> without repeated ones, loss_text, formatted_chars)."""
    pieces = F.filter(F.split("text", r"<turn\|"), lambda x: x != "")

    def turn(x: Column) -> Column:
        end = F.position(F.lit(">"), x)
        body = F.substring(x, end + 1, F.length(x) - end - len(CLOSE))
        return F.struct(unescaped(F.substring(x, F.lit(3), end - 3)).alias("role"), unescaped(body).alias("text"))

    new = F.transform(F.filter(pieces, lambda x: x.startswith("n")), turn)
    learned = F.transform("loss", lambda s: unescaped(F.substring(F.col("text"), (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    return windows.select("conv_id", "window", new.alias("turns"), F.array_join(learned, "").alias("loss_text"), F.length("text").cast("long").alias("formatted_chars"))
