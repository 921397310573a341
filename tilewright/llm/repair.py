"""Conversation structure repair: the cheapest edits that make a conversation's roles alternate.

The rows of a conversation, in order, may be kept, given another role or deleted, and
empty turns inserted, until the roles read as an optional system turn and then pairs
of user and assistant, or nothing at all. Blank and repeated rows have to go,
truncated ones cost more when they stay.

A dynamic programme over the retained rows finds the edits: a row that stays, with the
role it then has, follows an earlier one that stays, or the start. What lies between
them costs its deletions, the difference of two prefix sums, and the insertions that the
pair of roles needs; so for each role a running minimum of cost less prefix sum is all
that the next row has to look at. Of equal costs the least audit (the edits' initials in
order) wins. Audits are never compared as strings: those of different roles, seen up to
the same row, differ before their ends, so the order of the audits so far and the edits at
this row decide. A byte for each row and role leads back through the choices.

The facts of a row (its fault and its place) are windows over the conversation; the programme
reads these alone, without texts, and its edits are joined to the texts by row, so a large
conversation is sorted and streamed, not collected: only its choices (four bytes a row) and its
audit, which is one value by definition, are in memory at once. Repaired turns are a table;
digests run over it in order.

Defined cases: a null conversation id is one conversation; null turns come first; rows of the
same turn go by role, then text; equal rows are duplicates but for one; a null role or text is
one space (so a null text is blank); roles that begin with none of s, u and a can only be given
another role or go; a very long text is a row like others; extra columns are ignored, whatever
their names; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from .common import arrow_batches, materialise, read_table

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Faults of a row, in the order in which the first one counts.
SOUND, BLANK, DUPLICATE, CUT = 0, 1, 2, 3
SPACES = " \t\n\x0b\x0c\r"

#: Roles by number: nothing yet, system, user, assistant; how many turns a pair of them needs in between, and each before the end.
START, SYSTEM, USER, ASSISTANT = range(4)
INITIAL = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
BETWEEN = {(START, SYSTEM): 0, (START, USER): 0, (START, ASSISTANT): 1, (SYSTEM, USER): 0, (SYSTEM, ASSISTANT): 1, (USER, USER): 1, (USER, ASSISTANT): 0, (ASSISTANT, USER): 0, (ASSISTANT, ASSISTANT): 1}
BEFORE_END = (0, 2, 1, 0)
LEGAL = ("su", "ua", "au")
#: What happens at a row, in the order of these strings: insertions come right before the row that stays.
AT_ROW = ("D", "IK", "IR", "K", "R")


def last_character(text: Column) -> Column:
    """The last character that is no space; empty if there is none."""
    return F.substring(F.rtrim(text, F.lit(SPACES)), -1, 1)


def place_rows(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turn, role, text, fault, at): each row's first fault and its number in its conversation.

    Dealt by conversation once; both windows sort within that.
    """
    one = F.lit(" ")
    src = rows.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role).cast("string"), one).alias("role"), F.coalesce(F.col(text).cast("string"), one).alias("text"))
    last = last_character(F.col("text"))
    facts = src.select("*", F.sha2(F.col("text").cast("binary"), 256).alias("key"), last.alias("last")).repartition("conv_id")
    same = Window.partitionBy("conv_id", "role", "key").orderBy(F.asc_nulls_first("turn"))
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text", "nth")
    fault = F.when(F.col("last") == "", BLANK).when(F.col("nth") > 1, DUPLICATE).when(~F.col("last").isin(".", "!", "?"), CUT).otherwise(SOUND)
    return facts.withColumn("nth", F.row_number().over(same)).select("conv_id", "turn", "role", "text", fault.alias("fault"), F.row_number().over(order).alias("at"))


class Programme:
    """The edits of one conversation, row by row."""

    def __init__(self) -> None:
        self.deleted = 0  # prefix sum of the deletion costs
        self.cost: list[float] = [0, *[float("inf")] * 3]  # of the best choice that has the role last, less the deletions up to there
        self.rank = [0, 0, 0, 0]  # of the audits so far among the roles
        self.trace = bytearray()

    def add(self, role: str, fault: int) -> None:
        before = self.deleted
        self.deleted += DELETE
        best = [(c, self.rank[p], 0, p) for p, c in enumerate(self.cost)]
        if fault not in (BLANK, DUPLICATE):
            own = INITIAL.get(role[:1])
            extra = TRUNCATED if fault == CUT else 0
            for (p, r), k in BETWEEN.items():
                if r == own:
                    price, name = extra, 1 if k else 3
                elif r == SYSTEM:
                    continue
                else:
                    price, name = extra + REROLE, 2 if k else 4
                best[r] = min(best[r], (self.cost[p] + before + k * INSERT + price - self.deleted, self.rank[p], name, p))
        order = sorted(range(4), key=lambda r: best[r][1:3])
        for n, r in enumerate(order):
            self.cost[r], self.rank[r] = best[r][0], n
        self.trace += bytes(name << 2 | p for _, _, name, p in best)

    def result(self) -> tuple[int, str, str]:
        """Cost, audit and the initials of the repaired roles."""
        cost, _, r = min((c + self.deleted + BEFORE_END[p] * INSERT, self.rank[p], p) for p, c in enumerate(self.cost))
        edits, roles = ["I" * BEFORE_END[r]], ["", "ua", "a", ""][r]
        kept = []
        for i in range(len(self.trace) - 4, -1, -4):
            choice = self.trace[i + r]
            edit = AT_ROW[choice >> 2]
            edits.append(edit)
            if edit != "D":
                kept.append("sua"[r - 1])
                if edit[0] == "I":
                    kept.append("u" if r == ASSISTANT else "a")
            r = choice & 3
        return int(cost), "".join(reversed(edits)), "".join(reversed(kept)) + roles


def plan_edits(placed: DataFrame) -> DataFrame:
    """Per conversation its gaps, faults, illegal neighbours, cost, audit and repaired role initials, from rows of ``place_rows``."""
    src = placed.select("conv_id", "turn", F.substring("role", 1, 1).alias("initial"), "fault", "at")
    out = T.StructType([T.StructField("conv_id", src.schema["conv_id"].dataType)])
    for name in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost"):
        out.add(name, "long")
    out.add("audit", "string").add("roles", "string")
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: tuple = ()
        done: list[list] = []

        def close() -> None:
            if now:
                gaps = min(turns[1] - turns[0] + 1 - turns[2], (1 << 63) - 1) if turns[2] else 0
                done.append([now[0], gaps, *counts[1:], illegal, *programme.result()])

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), arrow, strict=True)], schema=arrow)
            done.clear()
            return batch

        for batch in batches:
            for conv, turn, initial, fault in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if (conv,) != now:
                    close()
                    now, programme, counts, illegal, last, turns = (conv,), Programme(), [0] * 4, 0, None, [0, 0, 0]
                programme.add(initial, fault)
                counts[fault] += 1
                illegal += last is not None and last + initial not in LEGAL
                last = initial
                if turn is not None and (not turns[2] or turn != turns[1]):
                    turns = [turns[0] if turns[2] else turn, turn, turns[2] + 1]
            if done:
                yield flush()
        close()
        if done:
            yield flush()

    return src.repartition("conv_id").sortWithinPartitions("conv_id", "at").mapInArrow(run, out)


def repaired_turns(placed: DataFrame, plan: DataFrame) -> DataFrame:
    """(conv_id, place, edit, role, text) of the turns of each repaired conversation, in order of ``place``.

    An audit is cut into one piece for each row of the conversation, with the insertions before it.
    """
    role_of = F.create_map(*(F.lit(x) for x in ("s", "system", "u", "user", "a", "assistant")))
    pieces = plan.select("conv_id", "roles", F.posexplode(F.regexp_extract_all("audit", F.lit("(I*[DKR]|I+$)"), F.lit(1))).alias("i", "piece"))
    turns = Window.partitionBy("conv_id").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.withColumn("edits", F.rtrim("piece", F.lit("D"))).withColumn("before", F.coalesce(F.sum(F.length("edits")).over(turns), F.lit(0)))
    each = pieces.where("edits != ''").select("conv_id", (F.col("i") + 1).alias("at"), "before", "roles", F.posexplode(F.expr("transform(sequence(1, length(edits)), i -> substring(edits, i, 1))")).alias("k", "edit"))
    each = each.select("conv_id", "at", "edit", (F.col("before") + F.col("k") + 1).alias("place"), role_of[F.expr("substring(roles, cast(before + k + 1 as int), 1)")].alias("new_role"))
    texts = placed.select(F.col("conv_id").alias("conv"), F.col("at").alias("row"), "role", "text")
    stayed = each.where("edit != 'I'").join(texts, F.col("conv_id").eqNullSafe(F.col("conv")) & (F.col("at") == F.col("row")))
    stayed = stayed.select("conv_id", "place", "edit", F.when(F.col("edit") == "K", F.col("role")).otherwise(F.col("new_role")).alias("role"), "text")
    return stayed.union(each.where("edit = 'I'").select("conv_id", "place", "edit", F.col("new_role").alias("role"), F.lit("").alias("text")))


def digest_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of ``role:text`` lines in order; a digest runs in order, so a conversation is one task."""
    out = T.StructType([turns.schema["conv_id"]]).add("repaired_sha256", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: tuple = ()
        for batch in batches:
            convs, found = [], []
            for conv, role, text in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
                if (conv,) != now:
                    if now:
                        convs.append(now[0])
                        found.append(digest.hexdigest())
                    now, digest = (conv,), hashlib.sha256()
                else:
                    digest.update(b"\n")
                digest.update(f"{role}:{text}".encode())
            yield pa.RecordBatch.from_arrays([pa.array(convs, batch.column(0).type), pa.array(found, pa.string())], ["conv_id", "repaired_sha256"])
        if now:
            yield pa.RecordBatch.from_arrays([pa.array([now[0]], batch.column(0).type), pa.array([digest.hexdigest()])], ["conv_id", "repaired_sha256"])

    lines = turns.select("conv_id", "place", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "place")
    return arrow_batches(lines).mapInArrow(run, out)


def repair(rows: DataFrame, **columns: str) -> tuple[DataFrame, DataFrame]:
    """The plan of each conversation and its repaired turns."""
    placed = materialise(place_rows(rows, **columns), "repair-rows")
    plan = materialise(plan_edits(placed), "repair-plan")
    return plan, repaired_turns(placed, plan)


def damage(rows: DataFrame) -> DataFrame:
    """Conversations with faults planted by crc32 of ``conv_id:turn``; nulls become one space, in the key too."""
    one = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), one), F.lit(":"), F.coalesce(F.col("turn").cast("string"), one))
    src = rows.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), one).alias("role"), F.coalesce(F.col("text").cast("string"), one).alias("text"), (F.crc32(key) % 20).alias("kind"))
    text = F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role"))
    copies = F.explode(F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1)))
    return src.where("kind != 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations damaged, audited and repaired."""
    rows = read_table(spark, sf_dir, "conversations")
    plan, turns = repair(damage(rows))
    ids = rows.select(F.col("conv_id").alias("id")).distinct()
    found = plan.drop("roles").withColumnRenamed("conv_id", "c")
    digests = digest_turns(turns).withColumnRenamed("conv_id", "d")
    both = ids.join(found, F.col("id").eqNullSafe(F.col("c")), "left").join(digests, F.col("id").eqNullSafe(F.col("d")), "left")
    counts = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    nothing = hashlib.sha256().hexdigest()
    return both.select(F.col("id").alias("conv_id"), *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"))


def _twin() -> str:
    """Another way to the same result: a state machine over the rows' lists that carries audits and texts as strings and sorts its choices."""
    roles = {"s": "system", "u": "user", "a": "assistant"}
    nxt = {"n": "u", "s": "u", "u": "a", "a": "u"}

    def insert(state: str) -> str:  # state after an inserted turn
        return f"struct_pack(c := {state}.c + 3, a := {state}.a || 'I', o := {state}.o || chr(10) || '{roles[nxt[state[-1]]]}:')"

    def grow(state: str, row_cost: str, letter: str, line: str) -> str:
        return f"struct_pack(c := {state}.c + {row_cost}, a := {state}.a || '{letter}', o := {state}.o || chr(10) || {line})"

    def choices(r: str) -> str:
        lines = [f"struct_pack(c := acc.{r}.c + 4, a := acc.{r}.a || 'D', o := acc.{r}.o)"]
        if r != "n":
            froms = ["n"] if r == "s" else [p for p in "nsua" if nxt[p] == r]
            ways = [f"acc.{p}" for p in froms] + ([] if r == "s" else [insert(f"acc.{p}") for p in "nsua" if nxt[nxt[p]] == r])
            for way in ways:
                stay = "case when x.fault in (1, 2) then 1000000000 when x.fault = 3 then 3 else 0 end"
                lines.append(grow(f"({way})", f"{stay} + case when x.role[1] = '{r}' then 0 else 1000000000 end", "K", "x.role || ':' || x.text"))
                if r != "s":
                    lines.append(grow(f"({way})", f"{stay} + 3", "R", f"'{roles[r]}:' || x.text"))
        return f"list_sort([{', '.join(lines)}])[1]"

    empty = lambda c: f"struct_pack(c := {c}::bigint, a := '', o := '')"
    first = f"struct_pack(n := {empty(0)}, s := {empty(1000000000)}, u := {empty(1000000000)}, a := {empty(1000000000)})"
    step = f"struct_pack(n := {choices('n')}, s := {choices('s')}, u := {choices('u')}, a := {choices('a')})"
    more = lambda s, c, i, o: f"struct_pack(c := d.{s}.c + {c}, a := d.{s}.a || '{i}', o := d.{s}.o || {o})"
    ends = ", ".join(("d.n", "d.a", more("u", 3, "I", "chr(10) || 'assistant:'"), more("s", 6, "II", "chr(10) || 'user:' || chr(10) || 'assistant:'")))
    return rf"""
with src as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
         list_transform(string_split(coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' '), ''), lambda ch: ascii(ch)::bigint) as bytes
  from conversations),
keyed as (
  select *, xor(list_reduce(bytes, lambda c, b: list_reduce(range(8), lambda v, i: case when v & 1 = 1 then xor(v >> 1, 3988292384) else v >> 1 end, xor(c, b)), 4294967295::bigint), 4294967295) % 20 as kind from src),
hurt as (
  select conv_id, turn, case when kind = 4 then 'user' else role end as role,
         case when kind = 1 then '' when kind = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
         unnest(range(case when kind = 3 then 2 else 1 end)) as copy
  from keyed where kind <> 0),
placed as (
  select *, row_number() over (partition by conv_id order by turn nulls first, role, text, copy) as place,
         row_number() over (partition by conv_id, role, text order by turn nulls first, copy) as nth,
         regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) as last from hurt),
faults as (
  select *, case when last = '' then 1 when nth > 1 then 2 when last not in ('.', '!', '?') then 3 else 0 end as fault,
         lag(role[1]) over (partition by conv_id order by place) as prior from placed),
conv as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (where fault = 1) as blank, count(*) filter (where fault = 2) as duplicate,
         count(*) filter (where fault = 3) as truncated, count(*) filter (where prior is not null and prior || role[1] not in ('su', 'ua', 'au')) as illegal,
         list(struct_pack(role := role, text := text, fault := fault) order by place) as rows
  from faults group by conv_id),
states as (select * exclude (rows), list_reduce(rows, lambda acc, x: {step}, {first}) as d from conv),
best as (select * exclude (d), list_sort([{ends}])[1] as e from states)
select i.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal,
       coalesce(e.c, 0) as cost, coalesce(e.a, '') as audit, sha256(coalesce(substr(e.o, 2), '')) as repaired_sha256
from (select distinct conv_id from conversations) i left join best b on i.conv_id is not distinct from b.conv_id
"""


OP12_SQL = _twin()
