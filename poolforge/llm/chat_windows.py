r"""Chat formatting in budgeted, turn-aligned windows, with reversible escaping and a loss mask.

A turn is written as ``<|im_start|>role\ntext<|im_end|>\n``. Inside roles and texts a backslash, the two characters
``<|`` and (in roles) a line feed are escaped with a backslash, so no text can close or open a turn, and
reading back is exact. Turns are packed by prefix sums of their tokens: a window opens at a turn and takes every
following turn that still fits the budget. Each later window repeats the system turn and as many of the last turns
as the history limits allow. The loss mask of a window lists the spans (code points) of its new assistant texts only, so
over all windows each assistant text is a target exactly once.

DataFrame operations only: one grouping by conversation, then array functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CLASS, bind, only

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
BUDGET, HISTORY_TURNS, HISTORY_TOKENS, TURN_TOKENS = 256, 2, 64, 4


def escaped(text: Column, header: bool = False) -> Column:
    out = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))
    return F.replace(out, F.lit("\n"), F.lit("\\\n")) if header else out


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _tokens(text: Column) -> Column:
    """A turn's tokens: its words, and a few for the marks around it."""
    return (F.regexp_count(text, F.lit(SPACE_CLASS.replace("[", "[^") + "+")) + TURN_TOKENS).cast("long")


def _windows(turns: Column, budget: int, history_turns: int, history_tokens: int) -> Column:
    n = F.size(turns)
    zero = F.lit(0).cast("long")

    def with_sums(sums: Column) -> Column:
        """sums: tokens before each turn, and of all turns at the end."""
        system = F.when((n > 0) & (turns[0]["role"] == "system"), 1).otherwise(0)

        def history(i: Column) -> Column:
            """How many turns before turn i are repeated."""
            fits = F.filter(F.sequence(F.lit(0), F.lit(history_turns)), lambda k: (i - k >= system) & (sums[i] - sums[F.greatest(i - k, F.lit(0))] <= history_tokens))
            return F.coalesce(F.array_max(fits), F.lit(0))

        def step(acc: Column, i: Column) -> Column:
            fits = (i == 0) | (sums[i + 1] - acc["base"] <= budget)
            # A window that opens at turn i has room for what its repeated turns leave of the budget.
            base = sums[i - history(i)] - sums[system]
            return F.when(fits, acc).otherwise(F.struct(F.concat(acc["starts"], F.array(i)).alias("starts"), base.alias("base")))

        order = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
        first = F.struct(F.when(n > 0, F.array(F.lit(0))).otherwise(F.array().cast("array<int>")).alias("starts"), zero.alias("base"))
        starts = F.aggregate(order, first, step, lambda acc: acc["starts"])

        def one(all_starts: Column, start: Column, w: Column) -> Column:
            end = F.coalesce(F.get(all_starts, w + 1), n)
            back = F.when(w == 0, 0).otherwise(history(start))
            keeps = F.when((w > 0) & (system == 1), F.slice(turns, 1, 1)).otherwise(F.slice(turns, 1, 0))
            context = F.concat(keeps, F.slice(turns, start - back + 1, back))
            own = F.slice(turns, start + 1, end - start)
            head = lambda t: F.concat(F.lit(OPEN), escaped(t["role"], header=True), F.lit("\n"))
            whole = lambda t: F.concat(head(t), escaped(t["text"]), F.lit(CLOSE))
            context_text = F.array_join(F.transform(context, whole), "")

            def spans(begin: Column) -> Column:
                start_at = F.struct(begin.cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"))

                def add(acc: Column, t: Column) -> Column:
                    a = acc["at"] + F.length(head(t))
                    b = a + F.length(escaped(t["text"]))
                    found = F.when(t["role"] == "assistant", F.array(F.struct(a.cast("long").alias("start"), b.cast("long").alias("end")))).otherwise(F.slice(acc["spans"], 1, 0))
                    return F.struct((b + len(CLOSE)).cast("long").alias("at"), F.concat(acc["spans"], found).alias("spans"))

                return F.aggregate(own, start_at, add, lambda acc: acc["spans"])

            return bind(
                context_text,
                lambda c: F.struct(
                    F.concat(c, F.array_join(F.transform(own, whole), "")).alias("formatted"),
                    F.size(context).alias("n_context"),
                    F.size(own).alias("n_new"),
                    bind(F.length(c), spans).alias("loss"),
                ),
            )

        return bind(starts, lambda s: F.transform(s, lambda start, w: one(s, start, w)))

    running = F.aggregate(turns, F.array(zero), lambda acc, t: F.concat(acc, F.array(F.element_at(acc, -1) + t["tokens"])))
    return bind(running, with_sums)


def format_conversations(
    conversations: DataFrame, budget: int = BUDGET, history_turns: int = HISTORY_TURNS, history_tokens: int = HISTORY_TOKENS
) -> DataFrame:
    """One row for each conv_id: conv_id and windows, an array of (formatted, n_context, n_new, loss spans).

    conversations: conv_id, turn, role, text; further columns are ignored. Null roles and texts count as empty. Turns
    are ordered by turn (null first), ties by role and text; repeated rows are turns of their own. Rows without a conv_id
    form one conversation. A turn over the budget has a window of its own beside what is repeated. An empty table gives
    an empty one. A conversation is one row of the result, so its turns meet in one task.
    """
    rows = only(conversations, "conv_id", "turn", "role", "text").select("conv_id", "turn", *[F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text")])
    turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text", _tokens(F.col("text")).alias("tokens")))).alias("turns"))
    return turns.select("conv_id", bind(F.col("turns"), lambda t: _windows(t, budget, history_turns, history_tokens)).alias("windows"))


def window_rows(formatted: DataFrame) -> DataFrame:
    """One row for each window of format_conversations()."""
    return formatted.select("conv_id", F.posexplode("windows").alias("window", "w")).select("conv_id", "window", "w.*")


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, turns (array of role and text) and loss_text, read from the windows alone."""

    def turns_of(w: Column) -> Column:
        parts = F.slice(F.split(w["formatted"], r"<\|im_start\|>"), w["n_context"] + 2, w["n_new"])

        def turn(part: Column) -> Column:
            role = F.regexp_extract(part, r"(?s)^((?:[^\\\n]|\\.)*+)\n", 1)
            text = F.substring(part, F.length(role) + 2, F.length(part) - F.length(role) - 1 - len(CLOSE))
            return F.struct(unescaped(role).alias("role"), unescaped(text).alias("text"))

        return F.transform(parts, turn)

    def loss_of(w: Column) -> Column:
        return F.array_join(F.transform(w["loss"], lambda s: unescaped(F.substring(w["formatted"], (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")

    return formatted.select(
        "conv_id",
        F.flatten(F.transform("windows", turns_of)).alias("turns"),
        F.array_join(F.transform("windows", loss_of), "").alias("loss_text"),
        F.aggregate("windows", F.lit(0).cast("long"), lambda acc, w: acc + F.length(w["formatted"])).alias("formatted_chars"),
    )


def turn_digests(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256 and formatted_chars, all from the formatted output."""
    back = read_back(formatted)
    joined = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(joined, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        "formatted_chars",
    )
