"""Operator 1: interleave sources to target weights with Pfair windows and earliest deadline first."""

from __future__ import annotations

import math
from collections.abc import Mapping
from dataclasses import dataclass
from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .ordinals import running_totals, shuffled_key

#: Characters in a block, the unit that is scheduled.
BLOCK_CHARS = 65_536
#: Parts into which the default weights divide the whole.
PARTS = 10_000
#: Slots that one row of the schedule's table unfolds to, and slots of a table that may be broadcast.
SEGMENT, BROADCAST_SLOTS = 256, 200_000


@dataclass(frozen=True)
class Rates:
    """Whole weights q (in lowest terms), their sum n, and the blocks to place, by source; the first have weight."""

    names: list[str]
    q: list[int]
    blocks: list[int]

    @property
    def n(self) -> int:
        return sum(self.q)

    @property
    def weighted(self) -> int:
        """The number of sources that have a weight; the others follow them."""
        return sum(x > 0 for x in self.q)

    @property
    def repeats(self) -> bool:
        """Whether the schedule's period, n slots, is shorter than the blocks to place."""
        return self.n <= sum(b for b, x in zip(self.blocks, self.q, strict=True) if x)

    @property
    def steps(self) -> int:
        return self.n if self.repeats else sum(b for b, x in zip(self.blocks, self.q, strict=True) if x)

    @property
    def end(self) -> int:
        """The slot after the last deadline."""
        return max([-(-b * self.n // x) for b, x in zip(self.blocks, self.q, strict=True) if x], default=0)


def default_weights(sizes: Mapping[str, int]) -> dict[str, int]:
    """Ten-thousandths of the whole (at least one) in proportion to the square roots of the sources' sizes."""
    total = sum(math.sqrt(s) for s in sizes.values())
    return {k: max(1, math.floor(PARTS * math.sqrt(s) / total + 0.5)) if total else 1 for k, s in sizes.items()}


def rates(sizes: Mapping[str, int], weights: Mapping[str, float] | None = None, block_chars: int = BLOCK_CHARS) -> Rates:
    """The exact rates of the sources in ``sizes``: a weight counts as the decimal number that it is written as."""
    given = default_weights(sizes) if weights is None else weights
    if any(not math.isfinite(w) or w < 0 for w in given.values()):
        raise ValueError("weights must be finite and not negative")
    exact = {k: Fraction(str(given.get(k, 0))) for k in sizes}
    names = sorted(exact, key=lambda k: (exact[k] == 0, k))
    scale = math.lcm(*[w.denominator for w in exact.values()]) if exact else 1
    whole = [int(exact[k] * scale) for k in names]
    common = math.gcd(*whole) or 1
    made = Rates(names, [w // common for w in whole], [sizes[k] // block_chars + 1 for k in names])  # the last block may hold no row
    if max(made.n, made.end) >= 1 << 62:
        raise ValueError("slots exceed 64 bits: give weights fewer digits")
    return made


def _let(name: str, value: str, body: str) -> str:
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def schedule(spark: SparkSession, r: Rates) -> DataFrame:
    """(source, k, slot0) of the blocks k of every source with weight: of one period, or of all blocks if that is shorter.

    In each step the block with the earliest deadline (ceil((k + 1) n / q)) of those released (floor(k n / q) <=
    slot) takes the slot; without one, slots up to the next release stay empty. A fold over the steps keeps
    what every source has done at each `SEGMENT`-th slot; the segments are unfolded in parallel from there. A step
    looks at every source, so the fold takes (sources x steps), in one task; the steps are at most n.
    """
    q, limit = r.q[: r.weighted], (r.q if r.repeats else r.blocks)[: r.weighted]
    kind = "bigint" if (max(limit, default=0) + 1) * r.n < 1 << 62 else "decimal(38,0)"

    def numbers(x: list[int]) -> str:
        return f"array({', '.join(f'cast({v} as {kind})' for v in x)})"

    n, one = f"cast({r.n} as {kind})", f"cast(1 as {kind})"
    windows = (f"transform(a.c, (x, i) -> if(x < {numbers(limit)}[i], named_struct('r', x * {n} div {numbers(q)}[i], "
               f"'d', ((x + {one}) * {n} + {numbers(q)}[i] - {one}) div {numbers(q)}[i], 'i', cast(i as int)), null))")
    pick = "array_min(transform(w, y -> if(y.r <= now, named_struct('d', y.d, 'i', y.i), null))).i"
    done = f"named_struct('c', transform(a.c, (x, j) -> if(j = p, cast(x + {one} as {kind}), x)), 't', now + 1L)"
    state = f"struct<c: array<{kind}>, t: bigint>"
    sources = f"transform({numbers(q)}, x -> cast(0 as {kind}))"

    def step(body: str) -> str:
        """``body`` sees the state a, the slot now and the source p (null at the end)."""
        return _let("w", windows, _let("now", "greatest(a.t, array_min(transform(w, y -> y.r)))", _let("p", pick, body)))

    if not q:
        return spark.createDataFrame([], "source string, k bigint, slot0 bigint")
    last = -(-r.steps // SEGMENT) - 1
    fold = (f"aggregate(sequence(0, {last}), named_struct('a', cast(named_struct('c', {sources}, 't', id) as {state}), 's', cast(array() as array<{state}>)), "
            f"(z, s) -> named_struct('a', aggregate(sequence(1, {SEGMENT}), z.a, (a, u) -> {step(f'if(p is null, a, {done})')}), 's', concat(z.s, array(z.a))), z -> z.s)")
    chosen = "named_struct('i', p, 'k', cast(a.c[p] as bigint), 'slot0', now)"
    out = "struct<i: int, k: bigint, slot0: bigint>"
    one_more = step(f"if(p is null, z, named_struct('a', {done}, 'o', concat(z.o, array({chosen}))))")
    unfold = (f"aggregate(sequence(1, {SEGMENT}), named_struct('a', a, 'o', cast(array() as array<{out}>)), "
              f"(z, u) -> {_let('a', 'z.a', one_more)}, z -> z.o)")
    segments = spark.range(1).select(F.explode(F.expr(fold)).alias("a"))
    slots = segments.repartition(min(last + 1, 256)).select(F.explode(F.expr(unfold)).alias("x"))
    names = F.array(*[F.lit(x) for x in r.names[: r.weighted]])
    return slots.select(F.get(names, F.col("x.i")).alias("source"), "x.k", "x.slot0")


def mix(docs: DataFrame, weights: Mapping[str, float] | None = None, block_chars: int = BLOCK_CHARS,
        id: str = "doc_id", source: str = "source", size: Column | None = None) -> DataFrame:
    """Every row of ``docs`` once, with its place in the weighted interleaving.

    Adds ``n_chars`` (code points), ``block`` (of its source, from 0), ``slot`` (global, from 0), ``release``
    and ``deadline``, which replace columns of those names. Block k of a source with the part w of all weights
    runs in a slot in [floor(k / w), ceil((k + 1) / w)), so at every slot a source's blocks differ from its
    weight's claim by less than one, until a source runs out. Weights are exact: decimal numbers as they are
    written; without weights, `default_weights` of the sources' sizes. The schedule repeats after as many slots as
    the weights have whole parts; if those are more than the blocks, it is made for the blocks alone.
    Sources without a weight, or of weight 0, follow all others in equal parts.

    ``size`` counts a row's characters (default: those of ``text``). A block holds a source's documents whose
    running total of characters, in a fixed hash order of id and size, starts in the same ``block_chars``. A null
    source counts as the source "", null text as empty; rows of one id and size are interchangeable; an empty
    table gives an empty table. A row per source reaches the driver: name, size and weight.
    """
    rows = docs.withColumn(source, F.coalesce(F.col(source).cast("string"), F.lit(""))).withColumn("__size", F.coalesce(F.char_length("text") if size is None else size, F.lit(0)).cast("long"))
    rows = rows.drop("n_chars", "block", "slot", "release", "deadline")
    sizes = {r[source]: r["w"] for r in rows.groupBy(source).agg(F.sum("__size").alias("w")).collect()}
    r = rates(sizes, weights, block_chars)
    last = r.weighted
    placed = running_totals(rows, source, id, "__size", "__before").withColumn("block", F.floor(F.col("__before") / block_chars).cast("long")).drop("__before")
    # a source's whole weight, the blocks after which its slots repeat, and its number among those without weight
    facts = {k: F.struct(F.lit(x).cast("long").alias("q"), F.lit(x if r.repeats and x else b).cast("long").alias("turn"), F.lit(i - last).cast("long").alias("after"))
             for i, (k, x, b) in enumerate(zip(r.names, r.q, r.blocks, strict=True))}
    fact = F.create_map(*[y for k, v in facts.items() for y in (F.lit(k), v)])[F.col(source)] if facts else F.lit(None).cast("struct<q: bigint, turn: bigint, after: bigint>")
    placed = placed.withColumn("__f", fact).withColumn("__k", F.col("block") % F.col("__f.turn"))
    slots = schedule(docs.sparkSession, r).select(F.col("source").alias(source), F.col("k").alias("__k"), "slot0")
    slots = F.broadcast(slots) if r.steps <= BROADCAST_SLOTS else slots
    n, others = r.n, len(r.names) - last
    wide = "decimal(38,0)" if (max(r.blocks, default=0) + 1) * n >= 1 << 62 else "bigint"
    # sources without weight have no row among the slots: they take turns after the end
    follow = f"{r.end}L + block * {others}L"
    return (
        placed.join(slots, [source, "__k"], "left")
        .withColumns({
            "slot": F.expr(f"if(__f.q > 0, (block div __f.turn) * {n}L + slot0, {follow} + __f.after)"),
            "release": F.expr(f"if(__f.q > 0, cast(block as {wide}) * {n}L div __f.q, {follow})"),
            "deadline": F.expr(f"if(__f.q > 0, (cast(block + 1L as {wide}) * {n}L + __f.q - 1L) div __f.q, {follow} + {others}L)"),
        })
        .withColumnRenamed("__size", "n_chars").drop("__k", "__f", "slot0")
    )


def in_mix_order(docs: DataFrame, weights: Mapping[str, float] | None = None, id: str = "doc_id") -> DataFrame:
    """The columns of ``docs``, rows laid out in the order of the mix: ranges of slots, sorted inside."""
    columns = docs.columns
    placed = mix(docs.withColumn("__kept_source", F.col("source")).withColumn("__kept_n", F.col("n_chars")), weights, id=id)
    placed = placed.withColumn("source", F.col("__kept_source")).withColumn("n_chars", F.col("__kept_n"))
    return placed.withColumn("__h", shuffled_key(id)).repartitionByRange("slot", "__h").sortWithinPartitions("slot", "__h").select(columns)
