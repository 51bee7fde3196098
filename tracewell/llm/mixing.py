"""Mixing sources to target weights by Pfair scheduling.

A source's documents, in the order of a hash of their ids and texts, are laid end to end and cut into blocks of block_chars
characters; a document belongs to the block it starts in. With weight w, block k of a source is released at
slot floor(k / w) and due by ceil((k + 1) / w). In every slot the released block that is due first goes out
(earliest deadline first). As weights add up to one, every block meets its window, so after any
number of slots a source is less than one block away from its share.

Weights are exact: whole numbers q, in lowest terms, out of their sum P, and windows are worked out in integers. All lags are zero after P
slots, so the schedule repeats there, and the driver works out P slots or those of the phase, whichever are fewer. When a source runs out, the
weights of the others are scaled up and a new phase begins, whose slots count from its first; every document is scheduled exactly once.
A schedule of few slots is broadcast, a longer one is a table of blocks that is joined.

Documents find their place in a source by counts per (source, hash bucket) and a running sum in each bucket: no
task ever holds a source, only a bucket of about sqrt(rows) documents.
"""

from __future__ import annotations

import heapq
from array import array
from fractions import Fraction
from math import gcd, lcm

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, VariantType

from tracewell.llm.common import fresh, materialize

BLOCK_CHARS = 1 << 16
#: Weights that are not given are whole numbers up to so much: the target of a source is defined in these units, at least one.
UNITS = 1024
#: Slots that the driver works out, some 3 microseconds and 40 bytes each; blocks are doubled until a schedule needs no more.
MAX_SLOTS = 1 << 20
#: Slots up to which a schedule is broadcast (24 bytes and the source's name each).
BROADCAST_SLOTS = 100_000
SEED = 20_260


def in_integers(weights: dict[str, float | int | Fraction]) -> dict[str, int]:
    """The weights as whole numbers in lowest terms. A float is the decimal that it prints as: 0.1 is a tenth."""
    exact = {s: w if isinstance(w, (int, Fraction)) else Fraction(repr(float(w))) for s, w in weights.items()}
    scale = lcm(*(Fraction(w).denominator for w in exact.values()))
    whole = {s: int(w * scale) for s, w in exact.items()}
    least = gcd(*whole.values())
    return {s: n // least for s, n in whole.items()}


def earliest_deadline_first(q: dict[str, int], left: dict[str, int] | None = None) -> dict[str, array]:
    """The slots that each source's blocks get in the first period, up to the slot in which a source has sent what it has left.

    q: weights in whole numbers; the period is their sum.
    """
    period = sum(q.values())
    slots = {s: array("q") for s in q}
    waiting = [(0, s, 0) for s in sorted(q)]  # (release, source, block)
    ready: list[tuple[int, str, int]] = []
    for t in range(period):
        while waiting and waiting[0][0] <= t:
            _, s, k = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(k + 1) * period // q[s]), s, k))
        due, s, k = heapq.heappop(ready)
        if due <= t:
            raise AssertionError("a deadline was missed")
        slots[s].append(t)
        if left and len(slots[s]) == left[s]:
            break
        if k + 1 < q[s]:
            heapq.heappush(waiting, ((k + 1) * period // q[s], s, k + 1))
    return slots


def schedule(blocks: dict[str, int], weights: dict[str, float | int | Fraction], idle: bool = True) -> tuple[list[tuple], list[tuple[int, str, array]]]:
    """Phases (source, phase, first block, block after the last, first slot, q, period) and pattern (phase, source, slots in the period).

    idle: with phases in which a source sends no block.
    """
    left, done, base, phases, pattern = dict(blocks), dict.fromkeys(blocks, 0), 0, [], []
    phase = 0
    while left:
        q = in_integers({s: weights[s] for s in left})
        period = sum(q.values())
        slots = earliest_deadline_first(q, left)
        ended = next((s for s, n in left.items() if len(slots[s]) == n), None)
        length = slots[ended][-1] + 1 if ended is not None else min((n - 1) // q[s] * period + slots[s][(n - 1) % q[s]] + 1 for s, n in left.items())
        for s in sorted(left):
            taken = length // period * q[s] + sum(t < length % period for t in slots[s])
            if taken or idle:
                phases.append((s, phase, done[s], done[s] + taken, base, q[s], period))
            done[s] += taken
            left[s] -= taken
        pattern += [(phase, s, slots[s]) for s in sorted(left) if len(slots[s])]
        left = {s: n for s, n in left.items() if n > 0}
        base += length
        phase += 1
    return phases, pattern


def _slots(blocks: dict[str, int], weights: dict) -> int:
    """An upper bound of the slots that schedule() works out: each phase has one period at most, all together every block once."""
    return min(sum(blocks.values()), len(blocks) * sum(in_integers(weights).values()))


def targets(chars: dict[str, int], weights: dict[str, float] | None, power: float) -> dict[str, Fraction]:
    """Of each source its weight: as given, or else its characters to the given power, in UNITS of the largest, at least one.

    Sources without a given weight get theirs in the unit in which the given ones would add up to their own characters' shares.
    """
    size = {s: max(1.0, float(n)) ** power for s, n in chars.items()}
    top = max(size.values())
    plan = {s: Fraction(max(1, round(UNITS * x / top))) for s, x in size.items()}
    given = {s: Fraction(repr(float(w))) for s, w in (weights or {}).items() if s in plan}
    if any(w <= 0 for w in given.values()):
        raise ValueError("weights must be positive")
    unit = sum(given.values()) / sum(plan[s] for s in given) if given else Fraction(1)
    return {s: given.get(s, p * unit) for s, p in plan.items()}


def mix(docs: DataFrame, weights: dict[str, float] | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block_chars: int = BLOCK_CHARS, power: float = 0.5, slot: str = "slot", block: str = "block", order: str = "order") -> DataFrame:
    """docs, all rows and columns, with the block of each document in its source, the slot of that block in the mix, and its order in the block.

    If docs has a column of one of these names, the new one gets underscores in front.

    weights: of each source, in any unit, taken exactly; those without one, and all if weights is None, get their number of characters to the given power
    (see targets). A null source is a source of its own, '' is another. Null texts have no characters. Rows that
    repeat an id are documents of their own. Ties of the order are broken by a hash of the whole row, so that only rows that agree in
    everything could change places. An empty table gives an empty result. Blocks are doubled while the schedule would have over MAX_SLOTS slots.
    """
    slot, block, order = (fresh(docs, c) for c in (slot, block, order))
    made = ("source", "chars", "hash", "tie", "cell", "before", "start", "own", "ps", "phase", "k0", "k1", "base", "q", "period", "last", "pphase", "psource", "pj", "pt")
    name = {c: fresh(docs, f"mix_{c}") for c in made}
    col = {c: F.col(n) for c, n in name.items()}
    # null and '' are different sources
    key = F.when(F.col(source_col).isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), F.col(source_col).cast("string")))
    text = F.col(text_col).cast("string")
    whole = [F.col(f"`{f.name}`") for f in docs.schema.fields if not isinstance(f.dataType, (MapType, VariantType))]
    rows = docs.withColumns({name["source"]: key, name["chars"]: F.coalesce(F.char_length(text), F.lit(0)).cast("long"), name["hash"]: F.shiftrightunsigned(F.xxhash64(F.col(id_col), text, F.lit(SEED)), 1), name["tie"]: F.xxhash64(*whole)})
    sizes = rows.groupBy(name["source"]).agg(F.count(F.lit(1)).alias("rows"), F.sum(name["chars"]).alias("chars")).collect()
    if not sizes:
        return rows.select(*docs.columns, F.lit(0).cast("long").alias(block), F.lit(0).cast("long").alias(slot), col["hash"].alias(order))
    chars = {r[name["source"]]: r["chars"] for r in sizes}
    plan = targets(chars, {f"={s}": w for s, w in (weights or {}).items()}, power)
    blocks = {s: max(1, -(-n // block_chars)) for s, n in chars.items()}
    while _slots(blocks, plan) > max(MAX_SLOTS, len(blocks)):
        block_chars *= 2
        blocks = {s: max(1, -(-n // block_chars)) for s, n in chars.items()}
    few = _slots(blocks, plan) + len(plan) ** 2 <= BROADCAST_SLOTS
    phases, pattern = schedule(blocks, plan, idle=few)

    most = max(r["rows"] for r in sizes)
    cells = max(1, most // max(200, int(most**0.5)))
    rows = rows.withColumn(name["cell"], F.floor(col["hash"] / F.lit(2**63 / cells)).cast("long"))
    sums = rows.groupBy(name["source"], name["cell"]).agg(F.sum(name["chars"]).alias(name["before"]))
    ahead = Window.partitionBy(name["source"]).orderBy(name["cell"]).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(name["source"], name["cell"], F.coalesce(F.sum(name["before"]).over(ahead), F.lit(0)).alias(name["before"]))
    within = Window.partitionBy(name["source"], name["cell"]).orderBy(name["hash"], name["tie"]).rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.join(sums, [name["source"], name["cell"]]).withColumn(name["start"], col["before"] + F.coalesce(F.sum(name["chars"]).over(within), F.lit(0)))

    spark = docs.sparkSession
    last = spark.createDataFrame(list(blocks.items()), f"{name['ps']} string, {name['last']} long")
    phase_rows = spark.createDataFrame(phases, ", ".join(f"{name[c]} {'string' if c == 'ps' else 'long'}" for c in ("ps", "phase", "k0", "k1", "base", "q", "period")))
    turns = pa.table({
        name["pphase"]: pa.array([p for p, _, a in pattern for _ in range(len(a))], pa.int64()), name["psource"]: pa.array([s for _, s, a in pattern for _ in range(len(a))], pa.string()),
        name["pj"]: pa.array([j for *_, a in pattern for j in range(len(a))], pa.int64()), name["pt"]: pa.array([t for *_, a in pattern for t in a], pa.int64()),
    })
    turns = spark.createDataFrame(turns)
    k = col["own"] - col["k0"]
    of_turn = (col["phase"] == col["pphase"]) & (col["ps"] == col["psource"]) & (F.pmod(k, col["q"]) == col["pj"])
    at = col["base"] + F.floor(k / col["q"]).cast("long") * col["period"] + col["pt"]
    last_of = last.select(col["ps"].alias(name["source"]), name["last"])
    placed = placed.join(F.broadcast(last_of), name["source"]).withColumn(name["own"], F.least(F.floor(col["start"] / block_chars).cast("long"), col["last"] - 1))
    if few:
        out = placed.join(F.broadcast(phase_rows), (col["source"] == col["ps"]) & (col["own"] >= col["k0"]) & (col["own"] < col["k1"])).join(F.broadcast(turns), of_turn)
    else:
        # a row per block of a source, its slot worked out: documents meet it by source and block, so no source is in one task
        each = phase_rows.where(col["k1"] > col["k0"]).withColumn(name["own"], F.explode(F.sequence(col["k0"], col["k1"] - 1)))
        each = each.join(turns, of_turn).select(col["ps"].alias(name["source"]), name["own"], at.alias(name["pt"]))
        out, at = placed.join(materialize(each, "turns"), [name["source"], name["own"]]), col["pt"]
    return out.select(*docs.columns, col["own"].alias(block), at.alias(slot), col["hash"].alias(order))


def in_mix_order(docs: DataFrame, weights: dict[str, float] | None = None, **options) -> DataFrame:
    """docs, the same rows and columns, sorted as mixed: over all partitions, and so over the files they are written to."""
    names = {k: fresh(docs, f"mixed_{k}") for k in ("slot", "block", "order")}
    mixed = mix(docs, weights, **names, **options)
    return mixed.repartitionByRange(names["slot"], names["order"]).sortWithinPartitions(names["slot"], names["order"]).select(*docs.columns)
