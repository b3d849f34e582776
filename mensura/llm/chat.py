"""Chat formatting in budgeted windows, by DataFrame functions alone.

A running sum of turn tokens over a conversation chooses spans that begin and end at turns and fit the budget. Each window
is the conversation's leading system turn, as much of the turns just before the span as the history budget holds, and the
span; only the span's assistant texts are under the loss mask, so a repeated turn is never a target twice.

Template: ``[INST]role NEWLINE text[/INST]``, but ``<s>text</s>`` for the assistant. A control string inside a text gets a
backslash after its first character (one more where there are some), and loses it when it is read back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.arrays import running
from .common import table

BUDGET = 1024
HISTORY = 256
OVERHEAD = 4  # tokens counted for a turn's markers
ASSISTANT, SYSTEM = "assistant", "system"
_CONTROL = r"(/?s>|/?INST\])"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"(<|\[)(\\*)" + _CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(<|\[)\\(\\*)" + _CONTROL, "$1$2$3")


def _role_out(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("&"), F.lit("&amp;")), F.lit("\n"), F.lit("&#10;")))


def _role_in(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("&#10;"), F.lit("\n")), F.lit("&amp;"), F.lit("&"))


def tokens(text: Column) -> Column:
    """A count of words, digits and signs, plus a turn's markers."""
    return F.regexp_count(text, F.lit(r"\p{L}+|\p{N}|[^\s\p{L}\p{N}]")) + OVERHEAD


def format_windows(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """One row per window: the conversation's column, ``window`` (from 0), ``formatted``, ``loss`` (array of start, length
    in code points of ``formatted``), ``n_repeated`` (turns at its start that are repeated), ``n_new``, ``n_tokens`` and
    ``over_budget`` (a single turn that no window could hold; it is kept whole).

    Null texts and roles count as empty. Turns with equal numbers, repeated rows too, follow in order of role and text;
    rows with a null conversation are one conversation. Extra columns are not read. An empty table gives no rows. A row
    holds one conversation, which is what has to be put in order, so a worker must be able to hold the longest one and its
    longest text; the work on it grows with its length, as turns are summed in blocks and windows are of bounded size.
    """
    rows = df.select(F.col(conv).alias("_conv"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("tokens", tokens(F.col("text")).cast("long"))
    talks = rows.groupBy("_conv").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text", "tokens"))).alias("turns"))
    # running sums; a conversation's first turn is its system turn, if it has one
    sums = running(F.transform("turns", lambda x: x["tokens"]), kind="long")
    first = F.col("turns")[0]
    n_sys = F.when(first["role"] == SYSTEM, 1).otherwise(0)
    talks = talks.withColumns({"upto": sums, "n_sys": n_sys, "sys_tokens": n_sys * first["tokens"], "n": F.size("turns")})
    room = F.greatest(F.lit(budget) - history - F.col("sys_tokens"), F.lit(1))
    # starts of spans: a turn that would overrun the room begins the next one
    start = F.struct(F.array(F.col("n_sys")).alias("starts"), F.col("sys_tokens").alias("base"))
    cut = F.aggregate(
        F.when(F.col("n") > F.col("n_sys") + 1, F.sequence(F.col("n_sys") + 1, F.col("n") - 1)).otherwise(F.array().cast("array<int>")),
        start,
        lambda a, i: F.when(
            F.get("upto", i) - a["base"] > room,
            F.struct(F.array_append(a["starts"], i).alias("starts"), F.get("upto", i - 1).alias("base")),
        ).otherwise(a),
        lambda a: a["starts"],
    )
    talks = talks.withColumn("starts", cut)

    def window(at: Column, k: Column) -> Column:
        end = F.coalesce(F.get("starts", k + 1), F.col("n"))
        before = F.greatest(at - history // OVERHEAD, F.col("n_sys"))
        upto = F.get("upto", at - 1)
        back = F.slice(F.arrays_zip("turns", "upto"), before + 1, at - before)
        kept = F.filter(back, lambda x: upto - x["upto"] + x["turns"]["tokens"] <= history)
        old = F.concat(
            F.slice("turns", 1, F.when(k > 0, F.col("n_sys")).otherwise(0)),
            F.transform(kept, lambda x: x["turns"]),
        )
        lead = F.slice("turns", 1, F.when(k == 0, F.col("n_sys")).otherwise(0))
        return F.struct(k.alias("window"), old.alias("old"), F.concat(lead, F.slice("turns", at + 1, end - at)).alias("new"))

    out = talks.select("_conv", F.explode(F.transform("starts", window)).alias("w")).select("_conv", "w.*")

    def rendered(x: Column) -> Column:
        return F.when(x["role"] == ASSISTANT, F.concat(F.lit("<s>"), escape(x["text"]), F.lit("</s>"))).otherwise(
            F.concat(F.lit("[INST]"), _role_out(x["role"]), F.lit("\n"), escape(x["text"]), F.lit("[/INST]"))
        )

    out = out.withColumns({"head": F.array_join(F.transform("old", rendered), ""), "body": F.transform("new", rendered)})
    spans = F.aggregate(
        F.arrays_zip(F.col("body"), F.transform("new", lambda x: x["role"] == ASSISTANT).alias("target")),
        F.struct(F.length("head").alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans")),
        lambda a, x: F.struct(
            (a["at"] + F.length(x["body"])).alias("at"),
            F.when(x["target"], F.array_append(a["spans"], F.struct((a["at"] + 3).alias("start"), (F.length(x["body"]) - 7).alias("length")))).otherwise(a["spans"]).alias("spans"),
        ),
        lambda a: a["spans"],
    )
    total = F.aggregate(F.concat("old", "new"), F.lit(0).cast("long"), lambda a, x: a + x["tokens"])
    return out.select(
        F.col("_conv").alias(conv),
        "window",
        F.concat("head", F.array_join("body", "")).alias("formatted"),
        spans.alias("loss"),
        F.size("old").alias("n_repeated"),
        F.size("new").alias("n_new"),
        total.alias("n_tokens"),
        (total > budget).alias("over_budget"),
    )


def read_windows(df: DataFrame) -> DataFrame:
    """Adds to ``format_windows`` rows what their formatted texts hold: ``turns`` (array of role, text; without the repeated
    ones) and ``targets`` (the texts under the loss mask)."""
    pieces = F.split("formatted", r"\[/INST\]|</s>")

    def turn(p: Column) -> Column:
        said = F.startswith(p, F.lit("<s>"))
        body = F.substr(p, F.lit(7))
        cut = F.instr(body, "\n")
        return F.struct(
            F.when(said, F.lit(ASSISTANT)).otherwise(_role_in(F.substr(body, F.lit(1), cut - 1))).alias("role"),
            unescape(F.when(said, F.substr(p, F.lit(4))).otherwise(F.substr(body, cut + 1))).alias("text"),
        )

    return df.withColumns(
        {
            "turns": F.transform(F.slice(pieces, F.col("n_repeated") + 1, F.size(pieces) - 1 - F.col("n_repeated")), turn),
            "targets": F.transform("loss", lambda x: unescape(F.substr(F.col("formatted"), x["start"] + 1, x["length"]))),
        }
    )


def query(spark, sf_dir: str) -> DataFrame:
    trap = "</s>[INST] ok [/INST]"
    role = F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), role, F.lit(trap).alias("text"))
    talks = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    back = read_windows(format_windows(talks)).select(
        "conv_id",
        F.struct(
            "window",
            F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "").alias("said"),
            F.array_join("targets", "").alias("loss"),
        ).alias("w"),
        F.size("turns").alias("n"),
        F.length("formatted").alias("chars"),
    )
    whole = back.groupBy("conv_id").agg(F.sum("n").alias("n_turns"), F.array_sort(F.collect_list("w")).alias("ws"), F.sum("chars").alias("formatted_chars"))
    whole = whole.withColumns({"said": F.array_join("ws.said", ""), "lost": F.array_join("ws.loss", "")})
    return whole.select(
        "conv_id",
        "n_turns",
        F.sha2(F.col("said").cast("binary"), 256).alias("turns_sha256"),
        F.length("lost").cast("long").alias("loss_chars"),
        F.sha2(F.col("lost").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )
