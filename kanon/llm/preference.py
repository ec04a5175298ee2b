"""Chat formatting of preference pairs (operator 3), DataFrame functions only.

Input: turns ``(pair_id, side, turn, role, text)`` with side ``chosen`` or ``rejected``. Per pair the longest
common prefix of turns (same role and text, position by position) is rendered once as the prompt; what
follows on either side is rendered as that side's completion. A mask of code-point ranges per completion
marks what is trained on: the text and end marker of assistant turns, never other roles or headers.

Turns are rendered as ``<|im_start|>role\\ntext<|im_end|>\\n``; ``<|`` inside role or text becomes ``< |`` so that
content cannot forge a marker.

Defined cases: rows with a null pair or side belong to no pair and are left out; null role or text is
empty; turns are ordered by (turn, role, text), null turns first, repeated rows are turns of their own;
a missing side has no turns, an empty completion and an empty mask; equal sides have everything in the
prompt; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The markers of the chat template.
START, END = "<|im_start|>", "<|im_end|>"


def _safe(c: Column) -> Column:
    return F.replace(F.coalesce(c, F.lit("")), F.lit("<|"), F.lit("< |"))


def rendered(t: Column) -> Column:
    return F.concat(F.lit(START), _safe(t["role"]), F.lit("\n"), _safe(t["text"]), F.lit(END + "\n"))


def _mask(turns: Column) -> Column:
    """Code-point ranges [start, end) of assistant text with its end marker."""
    head = lambda t: F.length(_safe(t["role"])) + len(START) + 1
    body = lambda t: F.length(_safe(t["text"])) + len(END)
    empty = F.expr("cast(array() as array<struct<start:int,end:int>>)")
    start = F.struct(F.lit(0).alias("at"), empty.alias("spans"))

    def step(acc: Column, t: Column) -> Column:
        a = acc["at"] + head(t)
        span = F.struct(a.cast("int").alias("start"), (a + body(t)).cast("int").alias("end"))
        spans = F.when(t["role"] == "assistant", F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"])
        return F.struct((a + body(t) + 1).cast("int").alias("at"), spans.alias("spans"))

    return F.aggregate(turns, start, step, lambda acc: acc["spans"])


def format_pairs(turns: DataFrame) -> DataFrame:
    """One row per pair: prompt, chosen, rejected, their masks and turn counts."""
    side = lambda s: F.sort_array(
        F.collect_list(F.when(F.col("side") == s, F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))))
    )
    pairs = turns.where(F.col("pair_id").isNotNull() & F.col("side").isin("chosen", "rejected")).groupBy("pair_id").agg(side("chosen").alias("_c"), side("rejected").alias("_r"))
    both = F.zip_with("_c", "_r", lambda c, r: F.coalesce((c["role"] == r["role"]) & (c["text"] == r["text"]), F.lit(False)))
    first = F.array_position(both, False)  # 1-based place of the first difference, 0 if none
    pairs = pairs.select("*", F.when(first > 0, first - 1).otherwise(F.least(F.size("_c"), F.size("_r"))).cast("int").alias("n_prompt_turns"))
    rest = lambda c: F.slice(c, F.col("n_prompt_turns") + 1, F.size(c))
    text = lambda c: F.array_join(F.transform(c, rendered), "")
    pairs = pairs.select("*", rest("_c").alias("_cc"), rest("_r").alias("_rr"))
    return pairs.select(
        "pair_id", "n_prompt_turns", text(F.slice("_c", 1, F.col("n_prompt_turns"))).alias("prompt"),
        text(F.col("_cc")).alias("chosen"), text(F.col("_rr")).alias("rejected"),
        _mask(F.col("_cc")).alias("chosen_mask"), _mask(F.col("_rr")).alias("rejected_mask"),
    )


def swapped_reply_pairs(conversations: DataFrame) -> DataFrame:
    """Preference turns from plain conversations: chosen is the conversation, rejected is the same with its last
    assistant turn (and what follows) replaced by the last assistant turn of the neighbour ``conv_id XOR 1``.

    Every conversation is a pair. Without an assistant turn nothing is replaced; without a neighbour's reply
    the rejected side ends before the reply. Rows with a null conversation id are left out.
    """
    turns = conversations.where("conv_id is not null").select("conv_id", "turn", "role", "text")
    reply = F.max(F.when(F.col("role") == "assistant", F.struct("turn", F.coalesce("text", F.lit("")).alias("text"))))
    last = turns.groupBy("conv_id").agg(reply.alias("reply"))
    # one row per conversation; ids are unique here, so no key of this join is hot
    donor = last.where("reply is not null").select((F.col("conv_id").bitwiseXOR(1)).alias("conv_id"), F.col("reply.text").alias("donated"))
    ends = last.join(donor, "conv_id", "left").select("conv_id", F.col("reply.turn").alias("_last"), F.col("reply").isNotNull().alias("_replied"), "donated")
    chosen = turns.select(F.col("conv_id").alias("pair_id"), F.lit("chosen").alias("side"), "turn", "role", "text")
    head = turns.join(ends, "conv_id").where("not _replied or turn < _last or (turn is null and _last is not null)")
    rejected = head.select(F.col("conv_id").alias("pair_id"), F.lit("rejected").alias("side"), "turn", "role", "text")
    swap = ends.where("_replied and donated is not null").select(F.col("conv_id").alias("pair_id"), F.lit("rejected").alias("side"), F.col("_last").alias("turn"), F.lit("assistant").alias("role"), F.col("donated").alias("text"))
    return chosen.unionByName(rejected).unionByName(swap)
