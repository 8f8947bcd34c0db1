"""Operator 7: mixing sources to target weights by Pfair scheduling."""

from __future__ import annotations

import bisect
import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import fresh


def shares(weights: dict, period: int) -> dict:
    """Whole shares of a period of slots by largest remainder, one at least for each positive weight."""
    positive = {k: v for k, v in weights.items() if v > 0}
    total = sum(positive.values())
    period = max(period, len(positive))
    exact = {k: v / total * period for k, v in positive.items()}
    out = {k: max(1, int(x)) for k, x in exact.items()}
    order = sorted(exact, key=lambda k: (-(exact[k] - int(exact[k])), str(k)))
    left = period - sum(out.values())
    for i in range(max(0, left)):
        out[order[i % len(order)]] += 1
    while left < 0:
        largest = max(out, key=lambda k: (out[k], str(k)))
        out[largest] -= 1
        left += 1
    return out


def pfair(share: dict, held: dict | None = None) -> dict:
    """Slots of each source in one period, earliest deadline first among what is released.

    held: blocks that each source has; the slots end where one without any left is due to be served.

    Block j (from 0) of a source with a of P slots is released at floor(j P / a) and due by
    ceil((j + 1) P / a).  The shares fill the period, so every block meets its deadline and after each
    slot every source is less than one block from its share.
    """
    period = sum(share.values())
    names = sorted(share, key=str)
    out = {k: [] for k in names}
    waiting = [(0, i) for i in range(len(names))]  # by release
    heapq.heapify(waiting)
    ready: list = []  # by deadline
    for slot in range(period):
        while waiting and waiting[0][0] <= slot:
            _, i = heapq.heappop(waiting)
            a, j = share[names[i]], len(out[names[i]])
            heapq.heappush(ready, (-(-(j + 1) * period // a), i))
        due, i = heapq.heappop(ready)
        if due <= slot:
            raise AssertionError("a block missed its deadline")
        if held is not None and len(out[names[i]]) == held[names[i]]:
            break
        a = share[names[i]]
        out[names[i]].append(slot)
        if len(out[names[i]]) < a:
            heapq.heappush(waiting, (len(out[names[i]]) * period // a, i))
    return out


def stretches(target: dict, blocks: dict, period: int) -> list[dict]:
    """The schedule of all blocks: stretches of slots, in each of which the same sources take turns.

    A stretch has its first slot, its share of a period for each source, the slots of a source in the
    first period, and the block that each source begins with.  It ends where a source is due that has
    no block left; the sources that have some are shared out anew by their target weights.  The slots
    listed are never more than the blocks.
    """
    done, first, out = dict.fromkeys(target, 0), 0, []
    active = dict(target)
    while active:
        share = shares(active, period)
        left = {k: blocks[k] - done[k] for k in share}
        turns = pfair(share, left)
        length = sum(share.values())
        listed = sum(map(len, turns.values()))
        if listed == length:  # whole periods, up to the slot that the first source can't fill
            end = min(left[k] // share[k] * length + turns[k][left[k] % share[k]] for k in share)
        else:
            end = listed
        out.append({"first": first, "period": length, "share": share, "turns": turns, "begin": {k: done[k] for k in share}})
        for k in share:
            done[k] += end // length * share[k] + bisect.bisect_left(turns[k], end % length)
        first += end
        active = {k: w for k, w in active.items() if done[k] < blocks[k]}
    return out


def mix(docs: DataFrame, weights: dict | None = None, tempered: float = 0.7, block_chars: int = 65_536, period: int = 1000, most_broadcast: int = 50_000) -> DataFrame:
    """docs with source_block, last_block, slot, release, deadline (long) and mixed (boolean); names taken get a trailing ``_``.

    weights: target weight for each source (None: the null source); sources that it lacks or that have
    no positive weight are never mixed.  Without weights, a source's share follows its text to the power
    tempered.  Weights are rounded to whole slots of a period.  The documents of a source follow each
    other by a hash of doc_id and text, and this line of text is cut into blocks of block_chars
    characters; block k has the slot that Pfair scheduling gives it.  A document goes where its first
    character is, from source_block to last_block: at each slot the text so far of a source is that of
    its blocks so far, and beyond them at most the rest of one document.

    Where a source runs out of blocks the others go on, with its share dealt to them by their weights,
    until all are used: mixed is true for every document of a source with a weight, and from
    one such place to the next each source stays within one block of its weight.  All rows are returned.
    Null texts have no characters.  An empty table gives an empty result.

    Running totals are summed by stretches of the hash in each source first, then scanned in each
    stretch by itself; only equal doc_ids with equal texts must share one.

    The driver holds a row for each source and, each time that one runs out, one period at most; they
    are broadcast up to most_broadcast sources and joined by a shuffle beyond that.
    """
    spark = docs.sparkSession
    key = F.when(F.col("source").isNotNull(), F.concat(F.lit("s"), F.col("source").cast("string"))).otherwise("n")
    stock = {r["k"]: (r["chars"], r["docs"]) for r in docs.groupBy(key.alias("k")).agg(F.sum(F.length(F.coalesce("text", F.lit("")))).alias("chars"), F.count("*").alias("docs")).collect()}
    mark, bucket, size, before, base = fresh(docs, "mix_mark", "mix_bucket", "mix_chars", "mix_before", "mix_base")
    named, many, plan, part, block, last, slot, release, deadline, mixed = fresh(docs, "mix_source", "mix_blocks", "mix_plan", "mix_part", "source_block", "last_block", "slot", "release", "deadline", "mixed")
    if weights is None:
        target = {k: max(1, chars) ** tempered for k, (chars, _) in stock.items()}
    else:
        target = {("n" if k is None else f"s{k}"): float(v) for k, v in weights.items()}
    target = {k: v for k, v in target.items() if k in stock and v > 0}
    blocks = {k: max(1, -(-stock[k][0] // block_chars)) for k in stock}
    plans: dict = {k: [] for k in stock}
    for x in stretches(target, blocks, period):
        for k, a in x["share"].items():
            if x["turns"][k]:
                plans[k].append((x["begin"][k], x["first"], x["period"], a, x["turns"][k]))
    kind = "array<struct<begin:bigint,first:bigint,period:bigint,share:bigint,turns:array<bigint>>>"
    about = spark.createDataFrame([(k, int(blocks[k]), plans[k]) for k in stock] or [("", 1, [])], f"{named} string, {many} long, {plan} {kind}")
    bits = min(16, max(1, (sum(n for _, n in stock.values()) // 64).bit_length()))  # about 64 documents in a bucket, up to 65,536 buckets
    line = docs.withColumn(named, key).withColumn(mark, F.xxhash64(F.col("doc_id").cast("string"), "text"))
    line = line.withColumn(bucket, F.shiftright(mark, 64 - bits)).withColumn(size, F.length(F.coalesce("text", F.lit(""))).cast("long"))
    earlier = Window.partitionBy(named).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    sums = line.groupBy(named, bucket).agg(F.sum(size).alias(base)).withColumn(base, F.coalesce(F.sum(base).over(earlier), F.lit(0)))
    inside = Window.partitionBy(named, bucket).orderBy(mark, "doc_id", size).rowsBetween(Window.unboundedPreceding, -1)
    out = line.withColumn(before, F.coalesce(F.sum(size).over(inside), F.lit(0))).join(sums, [named, bucket]).withColumn(before, F.col(before) + F.col(base))
    out = out.join(F.broadcast(about) if len(stock) <= most_broadcast else about, named)
    out = out.withColumn(block, F.least(F.floor(F.col(before) / block_chars), F.col(many) - 1))  # texts without characters may follow the last block
    out = out.withColumn(last, F.greatest(F.col(block), F.floor((F.col(before) + F.col(size) - 1) / block_chars)))
    stretch = F.size(F.filter(F.col(plan)["begin"], lambda x: x <= F.col(block))) - 1
    out = out.withColumn(part, F.when(F.size(plan) > 0, F.get(plan, stretch)))
    x = F.col(part)
    nth = F.col(block) - x["begin"]
    out = (
        out.withColumn(slot, x["first"] + F.floor(nth / x["share"]) * x["period"] + F.get(x["turns"], (nth % x["share"]).cast("int")))
        .withColumn(release, x["first"] + F.floor(nth * x["period"] / x["share"]))
        .withColumn(deadline, x["first"] + F.ceil((nth + 1) * x["period"] / x["share"]))
        .withColumn(mixed, F.col(slot).isNotNull())
    )
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], block, last, slot, release, deadline, mixed)
