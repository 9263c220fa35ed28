"""Chat formatting in budgeted windows (DataFrame functions only).

A turn is written ``<s>[INST] role [/INST]text</s>``.  Control strings inside
roles and texts get a backslash after their first character and backslashes are
doubled, which can be undone.  Prefix sums of the turns' tokens lay a
conversation over a grid of cells as wide as a window's room for new turns: the
turns inside one cell form a span, and a turn that crosses a cell's edge is a
span of its own.  So spans are turn-aligned, and no span of more than one turn
is over budget.  A window is the conversation's system turn, then as many turns
before the span as fit the history budget, then the span.  Only assistant texts
of the span itself are under the loss mask; what a window repeats is masked out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The template's control strings (fixed values).
BEGIN, HEAD, BODY, END = "<s>", "[INST]", "[/INST]", "</s>"
CONTROLS = (BEGIN, HEAD, BODY, END)


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in CONTROLS:
        out = F.replace(out, F.lit(c), F.lit(c[0] + "\\" + c[1:]))
    return out


def unescape(text: Column) -> Column:
    out = text
    for c in CONTROLS:
        out = F.replace(out, F.lit(c[0] + "\\" + c[1:]), F.lit(c))
    return F.replace(out, F.lit("\\\\"), F.lit("\\"))


def tokens(formatted: Column, chars_per_token: int = 4) -> Column:
    """Tokens of a formatted turn by length; at least one."""
    return F.ceil(F.length(formatted) / F.lit(chars_per_token)).cast("long")


def windows(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", budget: int = 1024, history: int = 256, system: int = 256) -> DataFrame:
    """One row per window: conv, window, text, n_repeated, n_turns, losses, n_tokens.

    ``losses`` holds (start, length) in characters of ``text`` of what is under the loss mask, and the first
    ``n_repeated`` of the window's ``n_turns`` turns were in earlier windows (or are the repeated system turn).
    ``budget`` covers a window, of which ``history`` and ``system`` are set aside; a single longer turn makes
    a longer window, and a longer system turn is repeated whole.  Null roles and texts count as empty; a null
    conversation is one conversation; turns with equal numbers are ordered by role, then text; repeated rows
    are turns like others.  An empty table gives an empty result; other columns of any name are ignored.
    """
    room = budget - history - system
    if room < 1:
        raise ValueError("budget must exceed history and system")
    rows = turns.select(F.col(f"`{conv}`").alias("conv"), F.col(f"`{turn}`").alias("turn"), F.coalesce(F.col(f"`{role}`"), F.lit("")).alias("role"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    head = F.concat(F.lit(f"{BEGIN}{HEAD} "), escape(F.col("role")), F.lit(f" {BODY}"))
    rows = rows.withColumn("head", head).withColumn("body", escape(F.col("text"))).withColumn("out", F.concat("head", "body", F.lit(END))).withColumn("tokens", tokens(F.col("out")))
    order = Window.partitionBy("conv").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    rows = rows.withColumn("place", F.row_number().over(order)).drop("text", "turn")
    so_far = Window.partitionBy("conv").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("end", F.sum("tokens").over(so_far)).withColumn("start", F.col("end") - F.col("tokens"))
    cell = F.floor(F.col("start") / room)
    # cells and the turns across their edges alternate: 2 * cell, 2 * cell + 1
    rows = rows.withColumn("span", 2 * cell + F.when(F.floor((F.col("end") - 1) / room) > cell, 1).otherwise(0))
    by_place = Window.partitionBy("conv").orderBy("place")
    rows = rows.withColumn("opens", (F.lag("span").over(by_place).isNull()) | (F.lag("span").over(by_place) != F.col("span")))
    # the spans that begin within the next `history` tokens repeat this turn
    after = Window.partitionBy("conv").orderBy("start").rangeBetween(1, history)
    rows = rows.withColumn("later", F.collect_list(F.when(F.col("opens") & (F.col("start") > 0), F.col("span"))).over(after))
    first = Window.partitionBy("conv").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    piece = F.struct("place", "out", F.length("head").alias("skip"), F.length("body").alias("body"), "role", "tokens")
    lead = F.when(F.first("role").over(first) == "system", F.first(piece).over(first))
    rows = rows.withColumn("lead", F.when(F.col("opens") & (F.col("place") > 1), lead)).withColumn("piece", piece)
    is_lead = (F.col("place") == 1) & (F.col("role") == "system")
    uses = F.concat(
        F.array(F.struct(F.col("span").alias("window"), F.lit(False).alias("again"), F.col("piece").alias("piece"))),
        F.when(is_lead, F.array().cast("array<struct<window:bigint,again:boolean,piece:struct<place:int,out:string,skip:int,body:int,role:string,tokens:bigint>>>")).otherwise(F.transform("later", lambda s: F.struct(s.alias("window"), F.lit(True).alias("again"), F.col("piece").alias("piece")))),
        F.when(F.col("lead").isNotNull(), F.array(F.struct(F.col("span").alias("window"), F.lit(True).alias("again"), F.col("lead").alias("piece")))).otherwise(F.array().cast("array<struct<window:bigint,again:boolean,piece:struct<place:int,out:string,skip:int,body:int,role:string,tokens:bigint>>>")),
    )
    # a window's pieces are bounded by the budget, so the group is
    made = rows.select("conv", F.explode(uses).alias("u")).groupBy("conv", F.col("u.window").alias("window")).agg(F.array_sort(F.collect_list(F.struct(F.col("u.piece.place").alias("place"), F.col("u.again").alias("again"), F.col("u.piece.out").alias("out"), F.col("u.piece.skip").alias("skip"), F.col("u.piece.body").alias("body"), F.col("u.piece.role").alias("role"), F.col("u.piece.tokens").alias("tokens")))).alias("parts"))
    nothing = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("losses"))
    walked = F.aggregate("parts", nothing, lambda acc, p: F.struct((acc.at + F.length(p.out)).cast("int").alias("at"), F.when((p.role == "assistant") & ~p.again, F.concat(acc.losses, F.array(F.struct((acc.at + p.skip).cast("int").alias("start"), p.body.alias("length"))))).otherwise(acc.losses).alias("losses")))
    return made.select(F.col("conv").alias(conv), "window", F.concat_ws("", F.transform("parts", lambda p: p.out)).alias("text"), F.size(F.filter("parts", lambda p: p.again)).alias("n_repeated"), F.size("parts").alias("n_turns"), walked.losses.alias("losses"), F.aggregate("parts", F.lit(0).cast("long"), lambda a, p: a + p.tokens).alias("n_tokens"))


def read_back(made: DataFrame, conv: str = "conv_id") -> DataFrame:
    """From the windows alone, one row per conversation: its turns and its trained text, with digests.

    Turns are parsed at the control strings, repeated ones are skipped, and roles and texts are unescaped; the
    trained text is what lies under the loss mask, unescaped.
    """
    turns = F.slice(F.split("text", F.lit(END)), F.col("n_repeated") + 1, F.col("n_turns") - F.col("n_repeated"))
    lead = len(f"{BEGIN}{HEAD} ")
    cut = F.lit(f" {BODY}")

    def turn(t: Column) -> Column:
        at = F.locate(f" {BODY}", t) if isinstance(t, str) else F.call_function("locate", cut, t)
        return F.concat(unescape(F.substring(t, F.lit(lead + 1), at - lead - 1)), F.lit("\n"), unescape(F.substring(t, at + len(f" {BODY}"), F.length(t))), F.lit("\n"))

    parsed = made.select(conv, "window", F.concat_ws("", F.transform(turns, turn)).alias("turns"), (F.col("n_turns") - F.col("n_repeated")).alias("n"), F.concat_ws("", F.transform("losses", lambda x: unescape(F.substring(F.col("text"), x.start + 1, x.length)))).alias("loss"), F.length("text").alias("chars"))
    whole = parsed.groupBy(conv).agg(F.array_sort(F.collect_list(F.struct("window", "turns", "loss"))).alias("w"), F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"))
    joined = whole.select(conv, "n_turns", "formatted_chars", F.concat_ws("", F.transform("w", lambda x: x.turns)).alias("turns"), F.concat_ws("", F.transform("w", lambda x: x.loss)).alias("loss"))
    return joined.select(conv, F.col("n_turns").cast("long"), F.sha2(F.col("turns").cast("binary"), 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), F.col("formatted_chars").cast("long"))
