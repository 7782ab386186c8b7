"""Repairs the turn structure of conversations with the cheapest edits, in one fold.

Windows flag the faults of each turn (blank, repeated, cut off) and its place. The
turns of a conversation, as small structs in order, then pass one ``aggregate()``
whose accumulator has a (cost, audit) struct for each of four states of the wanted
grammar ``(s?(ua)+)?`` over role initials: nothing written yet, after the system
turn, after a user turn, after an assistant turn. ``least`` over structs picks the
cheaper edit and, of equal costs, the audit that comes first in ASCII order. Two
audits of equal cost at one turn are never prefixes of each other (a longer one has
further inserts, which cost), so this order holds under any further edits and one
audit a state is enough.

Edits: K keeps a turn, R gives it the role that the grammar wants, D deletes it, I
inserts an empty turn. All of it is DataFrame functions, and the rows are shuffled
once, by conversation. A conversation is one row in the end, as its repaired text and
audit are, so one conversation's turns are together in one task; the fold itself
holds flags only, and texts are read again for the repaired turns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from drift_atlas.llm import common

#: Fixed values of the contract: costs of edits, of an undeleted truncated turn, and the endings of a whole sentence.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
ENDINGS = [".", "!", "?"]
LEGAL_PAIRS = ["su", "ua", "au"]
_OUT_OF_REACH = 1 << 40
_NOT_SPACE = r"[^\x20\x09-\x0D]"


def damage(rows: DataFrame) -> DataFrame:
    """Faults by crc32 of ``conv_id:turn`` modulo 20: 0 drops a row, 1 empties its text, 2 removes its sentence endings, 3 repeats it, 4 makes it a user's.

    Null ids and turns count as one space in the key, null roles and texts become one
    space. Rows that are dropped stay, with ``dropped`` true, so that a conversation
    that loses all its rows is still known. Further columns are left out. Returns
    conv_id, turn, role, text, copy, dropped.
    """
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    kind = F.crc32(key.cast("binary")) % 20
    text = F.coalesce(F.col("text"), space)
    hurt = rows.select(
        "conv_id", "turn",
        F.when(kind == 4, "user").otherwise(F.coalesce(F.col("role"), space)).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(kind == 3, 2).otherwise(1).alias("copies"), (kind == 0).alias("dropped"),
    )
    return hurt.select("conv_id", "turn", "role", "text", F.explode(F.sequence(F.lit(1), "copies")).alias("copy"), "dropped")


def flag_faults(turns: DataFrame) -> DataFrame:
    """Each turn's place and first fault (``blank``, ``duplicate``, ``truncated`` or null), and whether it follows the turn before it lawfully.

    Takes conv_id, turn, role, text, and if present copy and dropped. The order within
    a conversation is turn (nulls first), role, text, copy, so ties have an order.
    """
    for name, default in (("copy", F.lit(1)), ("dropped", F.lit(False))):
        turns = turns if name in turns.columns else turns.withColumn(name, default)
    rows = turns.repartition("conv_id").withColumn("initial", F.substring("role", 1, 1))
    in_order = Window.partitionBy("conv_id", "dropped").orderBy(F.col("turn").asc_nulls_first(), "role", "text", "copy")
    rows = rows.withColumn("place", F.row_number().over(in_order)).withColumn("pair", F.concat(F.lag("initial").over(in_order), "initial"))
    seen = F.row_number().over(Window.partitionBy("conv_id", "dropped", "role", "text").orderBy("place")) > 1
    last = F.substring(F.rtrim(F.col("text"), F.lit(common.SPACE_CHARS)), -1, 1)
    fault = F.when(~F.col("text").rlike(_NOT_SPACE), "blank").when(seen, "duplicate").when(~last.isin(ENDINGS), "truncated")
    return rows.withColumn("fault", fault).withColumn("illegal", F.coalesce(~F.col("pair").isin(LEGAL_PAIRS), F.lit(False)))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _way(cost: Column | int, audit: Column | str) -> Column:
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(as_column(cost).cast("long").alias("cost"), as_column(audit).alias("audit"))


def _edit(way: Column, cost: Column | int, letter: str) -> Column:
    return _way(way["cost"] + cost, F.concat(way["audit"], F.lit(letter)))


def _states(none: Column, system: Column, user: Column, assistant: Column) -> Column:
    return F.struct(none.alias("none"), system.alias("system"), user.alias("user"), assistant.alias("assistant"))


def _inserts(acc: Column) -> Column:
    """The states after any useful inserts: a user turn from any state but a user's, then an assistant's."""
    user = F.least(acc["user"], *(_edit(acc[k], INSERT, "I") for k in ("none", "system", "assistant")))
    return _let(_states(acc["none"], acc["system"], user, acc["assistant"]), lambda s: _states(s["none"], s["system"], s["user"], F.least(s["assistant"], _edit(s["user"], INSERT, "I"))))


def _takes(acc: Column, turn: Column) -> Column:
    """The states after one turn was kept, given another role or deleted."""
    stays = ~turn["must_go"]
    extra = turn["cut"].cast("long") * TRUNCATED
    unreachable = _way(_OUT_OF_REACH, "")
    deleted = {k: _edit(acc[k], DELETE, "D") for k in ("none", "system", "user", "assistant")}

    def emitted(source: Column, initial: str) -> Column:
        return F.when(stays & (turn["initial"] == initial), _edit(source, extra, "K")).when(stays, _edit(source, extra + REROLE, "R")).otherwise(unreachable)

    system = F.when(stays & (turn["initial"] == "s"), _edit(acc["none"], extra, "K")).otherwise(unreachable)
    before_user = F.least(acc["none"], acc["system"], acc["assistant"])
    return _states(deleted["none"], F.least(deleted["system"], system), F.least(deleted["user"], emitted(before_user, "u")), F.least(deleted["assistant"], emitted(acc["user"], "a")))


def cheapest_edits(turns: Column) -> Column:
    """(cost, audit) of an array of (initial, must_go, cut) structs in order."""
    start = _states(_way(0, ""), *[_way(_OUT_OF_REACH, "")] * 3)
    return F.aggregate(turns, start, lambda acc, turn: _let(_inserts(acc), lambda open_: _takes(open_, turn)), lambda acc: _let(_inserts(acc), lambda s: F.least(s["none"], s["assistant"])))


def _repaired(turns: Column, audit: Column) -> Column:
    """The array of (role, text) that an audit makes of the turns.

    The n-th letter works on the turn after those that letters before it used up
    (all but I), and writes the turn after those that letters before it wrote (all
    but D). What is written alternates from a user's turn on; only a kept system turn
    may come before, and it is the first written.
    """
    letters = F.filter(F.split(audit, ""), lambda c: c != "")
    def without(letter: str, n: Column) -> Column:
        return n - F.length(F.regexp_replace(F.substring(audit, 1, n), f"[^{letter}]", ""))

    def row(k: Column) -> Column:
        return F.get(turns, without("I", k) - 1)

    first = F.length(F.regexp_extract(audit, "^D*", 0)) + 1
    has_system = ((F.substring(audit, first, F.lit(1)) == "K") & (F.get(turns, first - 1)["initial"] == "s")).cast("int")
    role = lambda k: F.when((without("D", k) - has_system) % 2 == 1, "user").otherwise("assistant")
    made = lambda c, n: F.struct(
        F.when(c == "K", row(n + 1)["role"]).when(c != "D", role(n + 1)).alias("role"),
        F.when(c == "I", "").otherwise(row(n + 1)["text"]).alias("text"),
    )
    return F.filter(F.transform(letters, made), lambda t: t["role"].isNotNull())


def repair_conversations(turns: DataFrame) -> DataFrame:
    """Faults, cheapest edits and repaired turns of every conversation.

    Takes conv_id (of any type), turn, role, text, and if present copy (the order of
    equal rows) and dropped (rows that only name their conversation); further columns
    are left out. Nulls: a null id is a conversation of its own, null turns come first,
    null roles and texts count as empty (an empty text is blank, an empty role can only
    be replaced). Returns conv_id, gaps, blank, duplicate, truncated, illegal, cost,
    audit, repaired (array of role, text). Without rows: zeros, empty audit and array.
    """
    rows = turns.withColumns({c: F.coalesce(F.col(c), F.lit("")) for c in ("role", "text")})
    rows = flag_faults(rows)
    there = ~F.col("dropped")
    turn = F.struct("place", "turn", "role", "text", "initial", F.coalesce(F.col("fault").isin("blank", "duplicate"), F.lit(False)).alias("must_go"), F.coalesce(F.col("fault") == "truncated", F.lit(False)).alias("cut"))
    counts = [F.count_if(there & (F.col("fault") == k)).alias(k) for k in ("blank", "duplicate", "truncated")]
    whole = rows.groupBy("conv_id").agg(*counts, F.count_if(there & F.col("illegal")).alias("illegal"), F.array_sort(F.collect_list(F.when(there, turn))).alias("turns"))
    numbers = F.filter("turns.turn", lambda t: t.isNotNull())
    gaps = F.coalesce(F.array_max(numbers) - F.array_min(numbers) + 1 - F.size(F.array_distinct(numbers)), F.lit(0)).cast("long")
    flags = F.transform("turns", lambda t: F.struct(t["initial"].alias("initial"), t["must_go"].alias("must_go"), t["cut"].alias("cut")))
    best = whole.select("conv_id", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", "turns", cheapest_edits(flags).alias("best"))
    return best.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "best.cost", "best.audit", _repaired(F.col("turns"), F.col("best.audit")).alias("repaired"))
