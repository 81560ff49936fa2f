"""Chat formatting from an event log, in DataFrame expressions only.

An event is (conversation, sequence number, message, kind, role, text). Kinds: `message` begins a message or a new
version of it, `delta` appends streamed text, `edit` replaces the text, `regenerate` replaces it and drops every message
that began between this one and the event. The events are folded into final messages, first within messages and then
along each conversation, and the messages are rendered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

START, END = "<|im_start|>", "<|im_end|>"
RESETS = ("message", "edit", "regenerate")


def escape(text: Column) -> Column:
    """Reversible; the result holds no `<|`, so no control string."""
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<|"), F.lit("&lt;|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&lt;|"), F.lit("<|")), F.lit("&amp;"), F.lit("&"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("&nl;"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("&nl;"), F.lit("\n")))


def fold(events: DataFrame) -> DataFrame:
    """(conv, at, msg, role, text): the final messages of events(conv, seq, msg, kind, role, text).

    A message's text is its last reset's text and what was streamed after it; its place is its first event's. Texts that
    are null count as empty. Events of one conversation that have equal numbers are taken in the order of message, kind
    and text; an event that is repeated whole counts once. Unknown kinds append like deltas. Deltas without a message begin
    one.
    """
    events = events.select("conv", "seq", "msg", F.coalesce("kind", F.lit("delta")).alias("kind"), "role", F.coalesce("text", F.lit("")).alias("text"))
    reset = F.col("kind").isin(*RESETS)
    within = Window.partitionBy("conv", "msg")
    events = events.withColumn("_reset", F.max(F.when(reset, F.struct("seq", "kind", "text"))).over(within))
    live = ~reset & (F.col("_reset").isNull() | (F.col("seq") >= F.col("_reset.seq")))
    parts = F.array_sort(F.collect_set(F.when(live, F.struct("seq", "kind", "text"))))
    messages = events.groupBy("conv", "msg").agg(
        F.min("seq").alias("at"),
        F.min_by("role", F.when(F.col("role").isNotNull(), F.struct("seq", "kind", "text"))).alias("role"),
        F.max(F.when(F.col("kind") == "regenerate", F.col("seq"))).alias("_again"),
        F.first("_reset.text").alias("_base"),
        parts.alias("_parts"),
    )
    earlier = Window.partitionBy("conv").orderBy("at", "msg").rowsBetween(Window.unboundedPreceding, -1)
    messages = messages.withColumn("_cut", F.max("_again").over(earlier))
    kept = messages.where(F.col("_cut").isNull() | (F.col("_cut") < F.col("at")))
    return kept.select("conv", "at", "msg", F.coalesce("role", F.lit("")).alias("role"), F.concat_ws("", "_base", F.transform("_parts", lambda p: p["text"])).alias("text"))


def render(messages: DataFrame, trained: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """(conv, formatted string, loss_spans array of UTF-8 byte ranges, n_turns long) of messages(conv, at, msg, role, text).

    Each turn is START role newline text END newline. The loss mask covers the escaped texts of the trained roles, not
    the markers. A conversation without messages has no row.
    """
    head = F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"))
    body = escape(F.col("text"))
    turns = messages.select("conv", "at", "msg", F.col("role").isin(*trained).alias("loss"), head.alias("head"), body.alias("body"))
    turns = turns.withColumn("size", F.octet_length("head") + F.octet_length("body") + F.lit(len(END) + 1))
    along = Window.partitionBy("conv").orderBy("at", "msg").rowsBetween(Window.unboundedPreceding, -1)
    turns = turns.withColumn("first", F.coalesce(F.sum("size").over(along), F.lit(0).cast("long")) + F.octet_length("head"))
    turn = F.struct("at", "msg", F.concat("head", "body", F.lit(END + "\n")).alias("shown"), "loss", "first", (F.col("first") + F.octet_length("body")).alias("last"))
    whole = turns.groupBy("conv").agg(F.array_sort(F.collect_list(turn)).alias("_turns"), F.count(F.lit(1)).alias("n_turns"))
    spans = F.transform(F.filter("_turns", lambda t: t["loss"]), lambda t: F.struct(t["first"].alias("start"), t["last"].alias("end")))
    return whole.select("conv", F.concat_ws("", F.transform("_turns", lambda t: t["shown"])).alias("formatted"), spans.alias("loss_spans"), "n_turns")


def parse(formatted: Column) -> Column:
    """Reads back the turns: array of (role, text), unescaped."""
    pieces = F.slice(F.split(formatted, r"<\|im_start\|>"), 2, 1 << 30)

    def turn(p: Column) -> Column:
        line = F.instr(p, "\n")
        text = F.substring(p, line + 1, F.length(p) - line - F.lit(len(END) + 1))
        return F.struct(unescape_role(F.substring(p, F.lit(1), line - 1)).alias("role"), unescape(text).alias("text"))

    return F.transform(pieces, turn)


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the mask, unescaped, nothing between."""
    raw = F.encode(formatted, "utf-8")
    cut = F.transform(spans, lambda s: F.decode(F.substring(raw, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")), "utf-8"))
    return F.concat_ws("", F.transform(cut, unescape))


def streamed(events: DataFrame) -> DataFrame:
    """The log of `message` events as it would have come in: assistant turns begin with a draft, are regenerated and stream
    in two deltas; the others are sent with a slip and edited. Folding it gives the same messages."""
    half = F.floor(F.length("text") / 2).cast("int")
    first, second = F.substring("text", F.lit(1), half), F.substring("text", half + 1, F.length("text") - half)

    def event(nth: int, kind: str, text: Column) -> Column:
        return F.struct((F.col("seq") * 4 + nth).alias("seq"), F.lit(kind).alias("kind"), text.alias("text"))

    draft = F.concat(F.lit("draft: "), second)
    answer = F.array(event(0, "message", draft), event(1, "regenerate", F.lit("")), event(2, "delta", first), event(3, "delta", second))
    asked = F.array(event(0, "message", first), event(1, "delta", draft), event(2, "edit", F.col("text")))
    own = events.withColumn("text", F.coalesce("text", F.lit("")))
    each = own.select("conv", "msg", "role", F.explode(F.when(F.col("role") == "assistant", answer).otherwise(asked)).alias("e"))
    return each.select("conv", "e.seq", "msg", "e.kind", "role", "e.text")


def turn_events(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The event log of a table of whole turns: one `message` event each.

    Rows of a conversation with equal turn numbers follow in the order of role and text; repeated rows are turns of
    their own. A null turn comes first.
    """
    own = rows.select(F.col(f"`{conv}`").alias("conv"), F.col(f"`{turn}`").alias("turn"), F.col(f"`{role}`").alias("role"), F.col(f"`{text}`").alias("text"))
    number = F.row_number().over(Window.partitionBy("conv").orderBy("turn", "role", "text")).cast("long")
    return own.select("conv", number.alias("seq"), number.alias("msg"), F.lit("message").alias("kind"), "role", "text")
