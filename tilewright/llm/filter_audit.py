"""Filter interaction audit: what each filter of a chain removes, in any order of the chain.

Every document gets one flag a filter. A part's joint-failure counts, one for each
set of filters, are sums of products of its documents' flags; everything else
follows from them: inclusion-exclusion (a Moebius inversion over the sets) gives the
survivors of any set of filters, and with these what a step removes, what fails
there but was gone before, and what fails one filter alone. The signed joint counts
are also the Harsanyi dividends of the game "documents removed by a set of filters",
so a filter's Shapley value is the sum of its sets' dividends, each shared equally.

The last filter is a table-wide one, "same text under a smaller id". It needs no
join of a text's copies: of each text only the rows with the least id pass it, so the
products with its flag are the products without it less those of these rows.
Copies are added up before each shuffle, and only ids, digests and flags are shuffled.

Defined cases: a null text is the empty text, a null part the part ``""``, merged
with rows that have that name; repeated rows count each, and of a text whose
smallest id is repeated, all rows with that id pass; a row with a null id fails no
copy filter, makes no other row fail and has no label; a document is good or toxic if
any of its label rows is, labels of unknown documents and null labels count for
nothing; very long texts are one row like others; an empty table has no parts and
gives no rows; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE_WORD, materialise, read_table

#: The filter on copies, last in bit order.
COPIES = "E"
MEASURES = ("n", "good", "toxic")


def text_failures(text: Column) -> dict[str, Column]:
    """The failure condition of each filter on the text alone."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    # a lambda's argument is computed once, however often it is used
    counts = F.transform(F.array(words), lambda w: F.struct(F.size(w).alias("all"), F.size(F.array_distinct(w)).alias("distinct")))[0]
    return {
        "A": F.regexp_count(text, F.lit(SPACE_WORD)) < 100,
        "B": counts["distinct"] * 100 < counts["all"] * 80,
        "C": F.regexp_count(text, F.lit("[A-Z]")) * 100 > F.length(text) * 10,
        "D": text.rlike("[#$%&*|]"),
    }


def flagged(docs: DataFrame, conditions: dict[str, Column], part: Column, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, part, key, failed, n): rows counted by id, part and text; ``failed`` has a bit for each condition."""
    bits = [F.when(F.coalesce(c, F.lit(False)), 1 << i).otherwise(0) for i, c in enumerate(conditions.values())]
    mask = sum(bits[1:], bits[0]) if bits else F.lit(0)
    rows = docs.select(F.col(doc_id).alias("doc_id"), part.alias("part"), F.unhex(F.sha2(F.col(text).cast("binary"), 256)).alias("key"), mask.alias("failed"))
    return rows.groupBy("doc_id", "part", "key", "failed").agg(F.count(F.lit(1)).alias("n"))


def labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """``rows`` with the numbers of good and toxic ones among their ``n``.

    Rows without an id match no label; they are dealt by their text's digest instead.
    """
    any_of = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)).cast("int"))
    marks = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(any_of("quality").alias("good"), any_of("toxic").alias("toxic"))
    marks = marks.where("good = 1 or toxic = 1").withColumn("salt", F.lit(0).cast("long"))
    salted = rows.withColumn("salt", F.when(F.col("doc_id").isNull(), F.xxhash64("key", "part")).otherwise(F.lit(0).cast("long")))
    count = lambda c: (F.coalesce(c, F.lit(0)) * F.col("n")).alias(c)
    return salted.join(marks, ["doc_id", "salt"], "left").select("doc_id", "part", "key", "failed", "n", count("good"), count("toxic"))


def joint_failures(rows: DataFrame, names: list[str]) -> DataFrame:
    """(part, joint): ``joint[m]`` holds, for each measure, the rows that fail all filters of the bit set m.

    ``rows`` are (doc_id, part, key, failed, n, good, toxic), ``failed`` without the filter
    on copies, which is the highest bit of m.
    """
    names = list(names)
    k = len(names) - 1
    # rows that have the least id of their text, by part: added up by text and part first, then the text's parts compared
    of_part = rows.where(F.col("doc_id").isNotNull()).groupBy("key", "part", "failed").agg(F.min("doc_id").alias("doc_id"), F.min_by(F.struct(*MEASURES), "doc_id").alias("first"))
    least = of_part.groupBy("key").agg(F.min("doc_id").alias("doc_id"))
    first = of_part.join(least, ["key", "doc_id"]).select("part", "failed", *(F.col("first")[m].alias(m) for m in MEASURES))
    # rows with a null id pass the filter on copies too
    first = first.union(rows.where(F.col("doc_id").isNull()).select("part", "failed", *MEASURES))
    both = rows.select("part", "failed", *MEASURES, F.lit(0).alias("passes")).union(first.select("*", F.lit(1).alias("passes")))
    both = both.groupBy("part", "failed", "passes").agg(*(F.sum(m).alias(m) for m in MEASURES))

    flag = [F.col("failed").bitwiseAND(1 << i).cast("boolean").cast("int") for i in range(k)]
    sums = []
    for s in range(1 << k):
        product = F.lit(1)
        for i in range(k):
            if s >> i & 1:
                product = product * flag[i]
        for m in MEASURES:
            sums.append(F.sum((1 - F.col("passes")) * product * F.col(m)).alias(f"all_{s}_{m}"))
            sums.append(F.sum(F.col("passes") * product * F.col(m)).alias(f"pass_{s}_{m}"))
    wide = both.groupBy("part").agg(*sums)
    of = lambda s, f: F.struct(*(f(s, m).cast("long").alias(m) for m in MEASURES))
    plain = [of(s, lambda s, m: F.col(f"all_{s}_{m}")) for s in range(1 << k)]
    copies = [of(s, lambda s, m: F.col(f"all_{s}_{m}") - F.col(f"pass_{s}_{m}")) for s in range(1 << k)]
    return wide.select("part", F.array(*plain, *copies).alias("joint"))


def signed_sum(joint: Column, inside: int, fixed: int, measure: str) -> Column:
    """Rows that fail all of ``fixed`` and none of ``inside``: the sum over all subsets s of ``inside`` of (-1)^|s| joint[s + fixed]."""
    total, s = F.lit(0).cast("long"), inside
    while True:
        term = joint[s | fixed][measure]
        total = total - term if bin(s).count("1") % 2 else total + term
        if s == 0:
            return total
        s = (s - 1) & inside


def interactions(joint: DataFrame, names: list[str]) -> DataFrame:
    """One row per part, filter order and step, from the joint counts of each part."""
    k = len(names)
    every = (1 << k) - 1
    shares = factorial(k)
    # the values that orders share: survivors of each set, lone failures and Shapley values of each filter
    kept = [F.struct(*(signed_sum(F.col("joint"), s, 0, m).alias(m) for m in MEASURES)) for s in range(1 << k)]
    lone = [signed_sum(F.col("joint"), every & ~(1 << i), 1 << i, "n") for i in range(k)]

    def shapley(i: int) -> Column:
        total = F.lit(0).cast("long")
        for s in range(1, 1 << k):
            if s >> i & 1:
                size = bin(s).count("1")
                dividend = F.col("joint")[s]["n"] * (1 if size % 2 else -1)
                total = total + dividend * (shares // size)
        return total

    parts = joint.select("part", F.transform("joint", lambda j: j["n"]).alias("fails"), F.array(*kept).alias("kept"), F.array(*lone).alias("lone"), F.array(*(shapley(i) for i in range(k))).alias("shapley"))
    steps = []
    for order in permutations(range(k)):
        before = 0
        for at, i in enumerate(order):
            steps.append(("".join(names[j] for j in order), at + 1, i, before, before | 1 << i))
            before |= 1 << i
    listed = F.array(*(F.struct(F.lit(o).alias("filter_order"), F.lit(at).alias("step"), F.lit(i).alias("i"), F.lit(before).alias("before"), F.lit(after).alias("after")) for o, at, i, before, after in steps))
    each = parts.select("*", F.explode(listed).alias("s")).select("*", F.col("kept")[F.col("s.before")].alias("had"), F.col("kept")[F.col("s.after")].alias("has"))
    i = F.col("s.i")
    removed = F.col("had.n") - F.col("has.n")
    fails = F.col("fails")[F.col("s.after") - F.col("s.before")]
    return each.select(
        "part", "s.filter_order", "s.step", F.col("has.n").alias("kept"), removed.alias("removed"), (fails - removed).alias("redundant"), F.col("lone")[i].alias("unique_fails"),
        (F.col("had.good") - F.col("has.good")).alias("good_lost"), (F.col("had.toxic") - F.col("has.toxic")).alias("toxic_lost"), F.col("shapley")[i].alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, conditions: dict[str, Column] | None = None, part: str = "lang", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The audit of filters with these failure conditions, on columns of ``docs`` whose null texts are
    empty, and of the filter on copies behind them. Filters have one letter each; eight are enough for 40,320 orders."""
    plain = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    conditions = text_failures(F.col("text")) if conditions is None else conditions
    marks = labels.select(*(F.col(c).alias(c) for c in ("doc_id", "quality", "toxic")))
    names = [*conditions, COPIES]
    rows = materialise(labelled(flagged(plain, conditions, F.col("part")), marks), "audit-rows")
    return interactions(joint_failures(rows, names), names)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five filters on all documents, in all 120 orders, by language."""
    return audit(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


OP11_SQL = r"""
with recursive doc as (
  select doc_id, coalesce(lang, '') as part, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents),
least as (select text, min(doc_id) as first from doc group by text),
mark as (select doc_id, coalesce(bool_or(quality = 1), false) as good, coalesce(bool_or(toxic = 1), false) as toxic from labels group by doc_id),
flag as (
  select d.part, coalesce(m.good, false) as good, coalesce(m.toxic, false) as toxic,
         case when len(d.words) < 100 then 'A' else '' end
         || case when 100 * len(list_distinct(d.words)) < 80 * len(d.words) then 'B' else '' end
         || case when 100 * len(regexp_replace(d.text, '[^A-Z]', '', 'g')) > 10 * len(d.text) then 'C' else '' end
         || case when regexp_matches(d.text, '[#$%&*|]') then 'D' else '' end
         || case when d.doc_id > l.first then 'E' else '' end as failed
  from doc d join least l on l.text = d.text left join mark m on m.doc_id = d.doc_id),
cell as (select part, failed, count(*) as n, count(*) filter (where good) as g, count(*) filter (where toxic) as t from flag group by part, failed),
perm as (
  select f as o from (values ('A'), ('B'), ('C'), ('D'), ('E')) v(f)
  union all select o || f from perm, (values ('A'), ('B'), ('C'), ('D'), ('E')) v(f) where length(o) < 5 and not contains(o, f)),
step as (select o as filter_order, s as step, substr(o, s, 1) as f, substr(o, 1, s - 1) as before from perm, range(1, 6) r(s) where length(o) = 5),
hit as (
  select c.part, s.filter_order, s.step, s.f, c.n, c.g, c.t, c.failed,
         contains(c.failed, s.f) as fails, regexp_matches(c.failed, '[' || s.before || '-]') and s.before <> '' as gone
  from cell c, step s),
found as (
  select part, filter_order, step, f,
         cast(coalesce(sum(n) filter (where not fails and not gone), 0) as bigint) as kept,
         cast(coalesce(sum(n) filter (where fails and not gone), 0) as bigint) as removed,
         cast(coalesce(sum(n) filter (where fails and gone), 0) as bigint) as redundant,
         cast(coalesce(sum(n) filter (where failed = f), 0) as bigint) as unique_fails,
         cast(coalesce(sum(g) filter (where fails and not gone), 0) as bigint) as good_lost,
         cast(coalesce(sum(t) filter (where fails and not gone), 0) as bigint) as toxic_lost
  from hit group by part, filter_order, step, f)
select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, cast(sum(removed) over (partition by part, f) as bigint) as shapley
from found
"""
