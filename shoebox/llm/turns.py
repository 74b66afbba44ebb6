"""Repair of conversation structure by the cheapest edits.

A sound conversation is ``(s?(ua)+)?`` in role initials: nothing, or pairs of user and assistant
after at most one system turn.  Rows are flagged by windows, each conversation's narrow structs are
collected in order, and ``aggregate()`` folds them while carrying the cheapest ``(cost, audit)`` for
each of the four states of that pattern: ``e`` nothing yet, ``s`` after a system turn, ``u`` after a
user, ``a`` after an assistant.  All of it is DataFrame and SQL functions.

Edits: K keeps a row (0), R gives it the role user or assistant (1), D deletes it (2, the only edit
for blank and duplicate rows), I inserts an empty user or assistant turn anywhere (5).  A truncated
row that is not deleted costs 5 more.  Of edits that cost the same the ASCII-least letters win.  That
choice may be made at each step: of two letter runs for the same rows, one can only begin with the
other by having fewer inserts, and then it costs less.

One exchange, by conversation, feeds the windows and the collection.  A conversation's turns meet in
one row, as its audit and the hash of its repaired text are single values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: ASCII white space, and the characters that end a whole sentence.
SPACE, STOPS = " \t\n\x0b\x0c\r", ".!?"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: More than any conversation costs: its rows could all be deleted.
NEVER = 1 << 60


def damage(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``(conv_id, turn, role, text, gone)``: rows harmed by the CRC-32 of ``conv_id:turn`` modulo 20.

    0 drops the row (it stays as a ``gone`` marker without role and text, so that its conversation is
    still known), 1 empties its text, 2 removes its sentence ends, 3 repeats it, 4 makes it a user
    turn.  Nulls are read as one space: in the key, the role and the text.
    """
    fill = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    case = F.crc32(F.concat_ws(":", fill(conv_col), fill(turn_col)).cast("binary")) % 20
    text = F.when(case == 1, "").when(case == 2, F.translate(fill(text_col), STOPS, "")).otherwise(fill(text_col))
    return rows.select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"),
        F.when(case != 0, F.when(case == 4, "user").otherwise(fill(role_col))).alias("role"), F.when(case != 0, text).alias("text"),
        (case == 0).alias("gone"), F.explode(F.when(case == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy"),
    ).drop("copy")


def flagged(rows: DataFrame) -> DataFrame:
    """Adds ``pos`` (from 1, by turn, nulls first; ties by role, then text), ``initial``, ``fault`` and ``illegal``.

    ``fault`` is the first that fits of blank (no character but ASCII white space), duplicate (role
    and text seen earlier in the conversation), truncated (the last such character ends no sentence),
    else null.  ``illegal`` marks a row whose role initial may not follow its predecessor's.
    """
    order = [F.asc_nulls_first("turn"), F.asc("role"), F.asc("text")]
    by_conv = Window.partitionBy("conv_id", "gone").orderBy(*order)
    alike = Window.partitionBy("conv_id", "gone", F.xxhash64("role", "text"), "role", "text").orderBy(F.asc_nulls_first("turn"))
    seen = rows.repartition("conv_id").withColumn("seen", F.row_number().over(alike) > 1)
    bare = F.btrim("text", F.lit(SPACE))
    initial = F.substring("role", 1, 1)
    return seen.select(
        "conv_id", "turn", "role", "text", "gone", initial.alias("initial"), F.row_number().over(by_conv).alias("pos"),
        F.when(bare == "", "blank").when(F.col("seen"), "duplicate").when(~F.right(bare, F.lit(1)).isin(*STOPS), "truncated").alias("fault"),
        (~F.concat(F.lag(initial).over(by_conv), initial).isin("su", "ua", "au")).alias("illegal"),
    )


def _edit(state: Column, cost: int, letters: str) -> Column:
    return F.struct((state["cost"] + F.lit(cost).cast("long")).alias("cost"), F.concat(state["audit"], F.lit(letters)).alias("audit"))


def _start(cost: int, letters: str) -> Column:
    return F.struct(F.lit(cost).cast("long").alias("cost"), F.lit(letters).alias("audit"))


def _inserted(e: Column, s: Column, u: Column, a: Column) -> Column:
    """The four states after the cheapest inserts, if any, behind the row just edited."""
    return F.struct(
        e.alias("e"), s.alias("s"),
        F.least(u, _edit(F.least(e, s, a), INSERT, "I")).alias("u"),
        F.least(a, _edit(u, INSERT, "I"), _edit(F.least(e, s), 2 * INSERT, "II")).alias("a"),
    )


def _step(at: Column, row: Column) -> Column:
    """The four states after one more row."""
    whole = ~F.coalesce(row["fault"].isin("blank", "duplicate"), F.lit(False))
    lame = F.coalesce(row["fault"] == "truncated", F.lit(False))
    kept = lambda state: F.when(lame, _edit(state, KEEP + TRUNCATED, "K")).otherwise(_edit(state, KEEP, "K"))
    named = lambda state: F.when(lame, _edit(state, REROLE + TRUNCATED, "R")).otherwise(_edit(state, REROLE, "R"))
    before_user = F.least(at["e"], at["s"], at["a"])
    none = _start(NEVER, "")
    # a row that already has the role is never cheaper with a new one
    to_user = F.when(~whole, none).when(row["initial"] == "u", kept(before_user)).otherwise(named(before_user))
    to_assistant = F.when(~whole, none).when(row["initial"] == "a", kept(at["u"])).otherwise(named(at["u"]))
    to_system = F.when(whole & (row["initial"] == "s"), kept(at["e"])).otherwise(none)
    gone = lambda name: _edit(at[name], DELETE, "D")
    return F.struct(gone("e").alias("e"), F.least(gone("s"), to_system).alias("s"), F.least(gone("u"), to_user).alias("u"), F.least(gone("a"), to_assistant).alias("a"))


def cheapest_edits(turns: Column) -> Column:
    """``(cost, audit)`` of an ordered array of structs with ``initial`` and ``fault``."""
    none = _start(NEVER, "")
    begin = F.struct(_start(0, "").alias("e"), none.alias("s"), _start(INSERT, "I").alias("u"), _start(2 * INSERT, "II").alias("a"))

    def merge(at: Column, row: Column) -> Column:
        # the step is bound once, as the element of an array, so that it isn't worked out for each use
        return F.transform(F.array(_step(at, row)), lambda x: _inserted(x["e"], x["s"], x["u"], x["a"]))[0]

    return F.aggregate(turns, begin, merge, lambda at: F.least(at["e"], at["a"]))


#: The other role of a pair, as a SQL text; the first turn of a pair is the user's.
_NEXT = "if({0} = 'u', 'a', 'u')"


def repaired_text(turns: str, audit: str) -> Column:
    """The repaired ``role:text`` lines of an ordered array of structs, joined by newlines.

    The letters are cut into one run a row (at most two inserts, then its own letter) and a last run of
    inserts; a fold notes the initial that stands before each run, and the lines follow from both.
    """
    # the initial before each run, '-' where there is none yet: inserts alternate, so an even number changes nothing behind a first one
    walk = f"""aggregate(zip_with({turns}, regexp_extract_all({audit}, '(I*[KRD])', 1), (t, run) -> struct(t.initial as initial, run as run)),
        struct('-' as last, '' as befores),
        (acc, x) -> struct(
            transform(array(struct(x.initial as initial, x.run as run, case length(x.run) when 1 then acc.last when 2 then {_NEXT.format('acc.last')} else if(acc.last = 'u', 'u', 'a') end as at)),
                y -> case right(y.run, 1) when 'D' then y.at when 'K' then y.initial else {_NEXT.format('y.at')} end)[0] as last,
            concat(acc.befores, acc.last) as befores))"""
    lines = f"""transform(array({walk}), w -> concat(
        flatten(transform(zip_with({turns}, regexp_extract_all({audit}, '(I*[KRD])', 1), (t, run) -> struct(t.role as role, t.text as text, run as run)), (x, i) ->
            concat(
                case length(x.run) when 1 then cast(array() as array<string>) when 2 then array(if(substring(w.befores, i + 1, 1) = 'u', 'assistant:', 'user:')) else if(substring(w.befores, i + 1, 1) = 'u', array('assistant:', 'user:'), array('user:', 'assistant:')) end,
                case right(x.run, 1) when 'D' then cast(array() as array<string>) when 'K' then array(concat(x.role, ':', x.text))
                    else array(concat(if((length(x.run) = 2) = (substring(w.befores, i + 1, 1) != 'u'), 'assistant:', 'user:'), x.text)) end))),
        case length(regexp_extract({audit}, '(I*)$', 1)) when 0 then cast(array() as array<string>) when 1 then array(if(w.last = 'u', 'assistant:', 'user:')) else if(w.last = 'u', array('assistant:', 'user:'), array('user:', 'assistant:')) end))[0]"""
    return F.array_join(F.expr(lines), "\n")


def repair_turns(rows: DataFrame) -> DataFrame:
    """One row a conversation of ``rows(conv_id, turn, role, text, gone)``, as :func:`damage` gives them.

    ``gaps`` (turns missing between the first and the last; nulls ignored), ``blank``, ``duplicate``,
    ``truncated``, ``illegal`` (counts of rows), ``cost``, ``audit``, ``repaired`` (the lines), all over
    the rows that are not ``gone``.  Without any: zeros and empty strings.  Null ids are one
    conversation.  Roles other than system, user and assistant count by their first character, which
    fits no place, nor does an empty role, so such rows get a new role or go.  An empty table gives an
    empty result.
    """
    here = ~F.col("gone")
    count = lambda test: F.count_if(here & F.coalesce(test, F.lit(False)))
    wide = lambda c: c.cast("decimal(37,0)")
    distinct = F.collect_set(F.when(here, F.col("turn")))
    found = flagged(rows).groupBy("conv_id").agg(
        (wide(F.max(F.when(here, F.col("turn")))) - wide(F.min(F.when(here, F.col("turn")))) + 1 - F.size(distinct)).alias("gaps"),
        *[count(F.col("fault") == kind).alias(kind) for kind in ("blank", "duplicate", "truncated")],
        count(F.col("illegal")).alias("illegal"),
        F.sort_array(F.collect_list(F.when(here, F.struct("pos", "initial", "fault", "role", "text")))).alias("turns"),
    )
    edited = found.withColumn("edits", cheapest_edits(F.col("turns")))
    lined = edited.withColumn("repaired", repaired_text("turns", "edits.audit"))
    return lined.select(
        "conv_id", F.coalesce(F.col("gaps").try_cast("long"), F.lit(0).cast("long")).alias("gaps"), "blank", "duplicate", "truncated", "illegal",
        F.col("edits.cost").alias("cost"), F.col("edits.audit").alias("audit"), "repaired",
    )
