"""Conversation structure repair: the cheapest edits that make every conversation well formed (DataFrame functions only).

A conversation's rows are read in order of turn (nulls first, then role and text). Each row's first fault counts: blank (no character
but the six ASCII blanks), duplicate (role and text stood earlier in the conversation), truncated (its last other character is not
one of .!?). A conversation is well formed if the first letters of its roles spell `(s?(ua)+)?`. Edits: Keep (0), Rerole to user or
assistant (3), Delete (4; the only choice for blank and duplicate rows), Insert an empty user or assistant row anywhere (3); a truncated row
that stays costs 3 more. Of the cheapest sequences, the one whose initials are least in ASCII is taken.

Windows derive the faults; each conversation's rows are then collected, sorted, and folded by aggregate(), which carries four
(cost, audit) structs, one for each state: nothing yet, after the system row, after a user row, after an assistant row. Native least()
picks the predecessor, since structs compare by cost, then audit. In a state, the role that may be inserted or given is fixed, so
audits of equal cost differ first in the kind of an edit. To keep the fold linear, audits are carried within blocks of BLOCK rows: at a
block's end the four audits (all end in a row's own letter, so none starts another) are ranked, the ranks stand for them in the
next block, and the audit is read back over the blocks.

Cost and memory: one shuffle by conversation. A conversation must fit in a row, since its repaired text is one value; nothing else grows with
it. Conversations are never joined with one another, so a hot one costs its own length.

Defined cases: nulls in role and text count as one space (a role that has to be changed, a blank text); null turns come first and
count for no gap; rows with a null conv_id are one conversation; equal rows in the same turn stand side by side; a conversation without
rows gives zeros and empty texts; gaps beyond 64 bits saturate; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import let

#: Costs of the edits.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Rows for which the fold carries audits as text.
BLOCK = 64

_MUST_GO = ("blank", "duplicate")
# Letters of edits in their order: Delete, Insert user, insert assistant, Keep, Rerole to user, rerole to assistant.
_D, _IU, _IA, _K, _RU, _RA = "DIJKRS"
_PATH = "struct<cost:bigint,rank:int,audit:string>"


def damage(rows: DataFrame) -> DataFrame:
    """Test damage by crc32(`conv_id:turn`) % 20: 0 drops the row (alive is false), 1 empties its text, 2 removes .!? from it, 3 repeats
    the row, 4 makes its role user. Nulls count as one space."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20
    once = rows.select("conv_id", "turn", said("role").alias("role"), said("text").alias("text"), kind.alias("kind"))
    return once.select(
        "conv_id", "turn",
        F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        (F.col("kind") != 0).alias("alive"),
        F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")


def faults(rows: DataFrame) -> DataFrame:
    """rows (conv_id, turn, role, text, alive) with at (place within the conversation), fault, initial, new_turn and illegal."""
    # Both windows and the aggregate after them use this one shuffle.
    own = rows.repartition("conv_id")
    order = Window.partitionBy("conv_id", "alive").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    initial = F.substring("role", 1, 1)
    placed = own.select(
        "*", F.row_number().over(order).alias("at"), initial.alias("initial"),
        F.coalesce(F.col("turn") != F.lag("turn").over(order), F.col("turn").isNotNull()).alias("new_turn"),
        F.coalesce(~F.concat(F.lag(initial).over(order), initial).isin("su", "ua", "au"), F.lit(False)).alias("illegal"),
    )
    again = F.row_number().over(Window.partitionBy("conv_id", "alive", "role", "text").orderBy("at")) > 1
    core = F.rtrim(F.col("text"), F.lit(" \t\n\x0b\x0c\r"))
    fault = (
        F.when(core == "", "blank").when(F.col("again"), "duplicate")
        .when(~F.substring(core, -1, 1).isin(".", "!", "?"), "truncated")
    )
    return placed.withColumn("again", again).withColumn("fault", fault).drop("again")


def _paths(s0: Column, s1: Column, s2: Column, s3: Column) -> Column:
    return F.struct(s0.alias("s0"), s1.alias("s1"), s2.alias("s2"), s3.alias("s3"))


def _edit(path: Column, cost: Column | int, letter: str) -> Column:
    """path with one more edit; null stays null."""
    more = F.struct((path["cost"] + cost).alias("cost"), path["rank"].alias("rank"), F.concat(path["audit"], F.lit(letter)).alias("audit"))
    return F.when(path.isNotNull(), more)


def _with_inserts(s: Column, then: Callable[[Column], Column]) -> Column:
    """then(paths) of the four states with the rows that may be inserted next."""
    return let(
        F.least(s["s2"], _edit(F.least(s["s0"], s["s1"], s["s3"]), INSERT, _IU)),
        lambda user: let(_paths(s["s0"], s["s1"], user, F.least(s["s3"], _edit(user, INSERT, _IA))), then),
    )


def _step(s: Column, row: Column) -> Column:
    """The four states after a row."""
    stays, more = ~F.coalesce(row["fault"].isin(*_MUST_GO), F.lit(False)), F.when(row["fault"] == "truncated", TRUNCATED).otherwise(0).cast("long")

    def after(p: Column) -> Column:
        def taken(path: Column, initial: str, reroled: str) -> list[Column]:
            own = [F.when(stays & (row["initial"] == initial), _edit(path, more, _K))]
            return own + ([F.when(stays, _edit(path, more + REROLE, reroled))] if reroled else [])

        gone = [_edit(p[f"s{i}"], DELETE, _D) for i in range(4)]
        return let(
            F.least(p["s0"], p["s1"], p["s3"]),  # a user row may follow any of these
            lambda before: _paths(
                gone[0],
                F.least(gone[1], *taken(p["s0"], "s", "")),
                F.least(gone[2], *taken(before, "u", _RU)),
                F.least(gone[3], *taken(p["s2"], "a", _RA)),
            ),
        )

    return _with_inserts(s, after)


def _end_block(s: Column, trail: Column) -> Column:
    """The states with audits replaced by their ranks, and the trail with this block's (rank, earlier rank, audit) of each."""
    every = [s[f"s{i}"] for i in range(4)]
    said = [F.struct(p["rank"], p["audit"]) for p in every]
    ranks = [sum((F.when(q.isNotNull() & (b < a), 1).otherwise(0) for q, b in zip(every, said, strict=True)), F.lit(0)) for a in said]
    state = [F.when(p.isNotNull(), F.struct(p["cost"].alias("cost"), r.alias("rank"), F.lit("").alias("audit"))) for p, r in zip(every, ranks, strict=True)]
    kept = [F.when(p.isNotNull(), F.struct(r.alias("rank"), p["rank"].alias("before"), p["audit"].alias("audit"))) for p, r in zip(every, ranks, strict=True)]
    return F.struct(_paths(*state).alias("state"), F.concat(trail, F.array(F.array(*kept))).alias("trail"))


def cheapest(rows: Column) -> Column:
    """struct(cost, audit) of the cheapest edits of an array of rows (with fields initial and fault), audit in the inner letters."""
    none = F.lit(None).cast(_PATH)
    first = F.struct(F.lit(0).cast("long").alias("cost"), F.lit(0).alias("rank"), F.lit("").alias("audit"))
    empty = F.array().cast("array<array<struct<rank:int,before:int,audit:string>>>")
    blocks = F.when(F.size(rows) > 0, F.transform(F.sequence(F.lit(0), F.floor((F.size(rows) - 1) / BLOCK).cast("int")), lambda b: F.slice(rows, b * BLOCK + 1, BLOCK)))
    blocks = F.coalesce(blocks, F.slice(F.array(rows), 1, 0))
    folded = F.aggregate(
        blocks,
        F.struct(_paths(first, none, none, none).alias("state"), empty.alias("trail")),
        lambda acc, block: let(F.aggregate(block, acc["state"], _step), lambda s: _end_block(s, acc["trail"])),
    )

    def read_back(end: Column, trail: Column) -> Column:
        back = F.aggregate(
            F.reverse(trail),
            F.struct(end["rank"].alias("rank"), F.array(end["audit"]).alias("parts")),
            lambda acc, block: let(
                F.filter(block, lambda p: p["rank"] == acc["rank"])[0],
                lambda p: F.struct(p["before"].alias("rank"), F.concat(acc["parts"], F.array(p["audit"])).alias("parts")),
            ),
        )
        return F.struct(end["cost"].alias("cost"), F.array_join(F.reverse(back["parts"]), "").alias("audit"))

    return let(folded, lambda f: _with_inserts(f["state"], lambda p: let(F.least(p["s0"], p["s3"]), lambda end: read_back(end, f["trail"]))))


def repaired_text(rows: Column, audit: Column) -> Column:
    """`role:text` lines of the rows (with fields role and text) after the edits of an audit in the inner letters."""
    inserted = lambda piece: F.replace(F.replace(F.rtrim(piece, F.lit("DKRS")), F.lit(_IU), F.lit("user:\n")), F.lit(_IA), F.lit("assistant:\n"))
    edit = lambda piece: F.substring(piece, -1, 1)
    role = lambda piece, row: F.when(edit(piece) == _K, row["role"]).when(edit(piece) == _RU, "user").when(edit(piece) == _RA, "assistant")
    own = lambda piece, row: F.coalesce(F.concat(role(piece, row), F.lit(":"), row["text"], F.lit("\n")), F.lit(""))
    pieces = F.regexp_extract_all(audit, F.lit(f"[{_IU}{_IA}]*[{_D}{_K}{_RU}{_RA}]"), F.lit(0))
    lines = F.zip_with(pieces, rows, lambda piece, row: F.concat(inserted(piece), own(piece, row)))
    last = inserted(F.regexp_extract(audit, f"[{_IU}{_IA}]*$", 0))
    return let(F.concat(F.array_join(lines, ""), last), lambda s: F.substring(s, F.lit(1), F.greatest(F.lit(0), F.length(s) - 1)))


def repair(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", alive: Column | None = None) -> DataFrame:
    """One row a conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and the repaired text.

    Rows where alive isn't true only say that their conversation exists.
    """
    said = lambda c: F.coalesce(F.col(c), F.lit(" "))
    here = F.lit(True) if alive is None else F.coalesce(alive, F.lit(False))
    own = rows.select(F.col(conv).alias("conv_id"), F.col(turn).cast("long").alias("turn"), said(role).alias("role"), said(text).alias("text"), here.alias("alive"))
    count = lambda c: F.count_if(F.col("alive") & c)
    at = lambda f: f(F.when(F.col("alive"), F.col("turn"))).cast("decimal(20,0)")
    row = F.struct("at", "initial", "fault", "role", "text")
    whole = faults(own).groupBy("conv_id").agg(
        F.least(F.coalesce(at(F.max) - at(F.min) + 1 - count(F.col("new_turn")), F.lit(0)), F.lit((1 << 63) - 1)).cast("long").alias("gaps"),
        *(count(F.col("fault") == k).alias(k) for k in ("blank", "duplicate", "truncated")),
        count(F.col("illegal")).alias("illegal"),
        F.sort_array(F.collect_list(F.when(F.col("alive"), row))).alias("_rows"),
    )
    found = whole.withColumn("_best", cheapest(F.col("_rows")))
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal")
    return found.select(
        "conv_id", *counts, F.col("_best.cost").alias("cost"),
        F.translate("_best.audit", _IA + _RA, _IU + _RU).alias("audit"),
        repaired_text(F.col("_rows"), F.col("_best.audit")).alias("repaired"),
    )
