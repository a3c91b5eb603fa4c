"""CIGAR strings and SA tags as columns of built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Operations that advance along the read, and along the reference.
CONSUMES_QUERY = ("M", "I", "S", "=", "X")
CONSUMES_REFERENCE = ("M", "D", "N", "=", "X")


def operations(cigar: Column) -> Column:
    """ARRAY<STRUCT<op, len>> of a CIGAR string."""
    ops, lens = (F.regexp_extract_all(cigar, F.lit(p), F.lit(1)) for p in (r"[0-9]+([MIDNSHP=X])", r"([0-9]+)[MIDNSHP=X]"))
    return F.arrays_zip(ops, lens.cast("array<int>")).cast("array<struct<op:string,len:int>>")


def total(ops: Column, which: tuple[str, ...] | None = None) -> Column:
    return F.aggregate(ops, F.lit(0).cast("long"), lambda s, o: s + (o["len"] if which is None else F.when(o["op"].isin(*which), o["len"]).otherwise(0)))


def consumed_query(ops: Column) -> Column:
    return total(ops, CONSUMES_QUERY)


def consumed_reference(ops: Column) -> Column:
    return total(ops, CONSUMES_REFERENCE)


def without_soft_clips(ops: Column) -> Column:
    return F.filter(ops, lambda o: o["op"] != "S")


def clipping(ops: Column, reverse: Column) -> tuple[Column, Column]:
    """(left, right) soft clips in the read's own direction."""
    at = lambda i: F.when(F.try_element_at(ops, F.lit(i))["op"] == "S", F.try_element_at(ops, F.lit(i))["len"]).otherwise(0)
    return F.when(reverse, at(-1)).otherwise(at(1)), F.when(reverse, at(1)).otherwise(at(-1))


def chimeric_regions(sa: Column) -> Column:
    """ARRAY<STRUCT> of an SA tag ``chrom,pos,strand,CIGAR,mapQ,NM;...``; clips count in the read's direction."""

    def one(region: Column) -> Column:
        f = F.split(region, ",")
        strand, forward = f[2], operations(f[3])
        ops = F.when(strand == "-", F.reverse(forward)).otherwise(forward)
        left, right = clipping(ops, F.lit(False))
        return F.struct(
            f[0].alias("chrom"), f[1].cast("long").alias("pos"), strand.alias("strand"), f[4].cast("int").alias("mapq"), f[5].cast("int").alias("nm"),
            left.cast("long").alias("left_softclip"), right.cast("long").alias("right_softclip"),
            consumed_query(without_soft_clips(ops)).alias("consumed_query"), consumed_reference(ops).alias("consumed_reference"),
        )

    return F.transform(F.filter(F.split(sa, ";"), lambda x: x != ""), one)


def reverse_complement(seq: Column) -> Column:
    return F.translate(F.reverse(seq), "ACGTNacgtn", "TGCANtgcan")


def cursors(ops: Column, longer: Column | None = None) -> Column:
    """Each operation (of more than ``longer`` bases) with the read and reference offsets at which it begins."""
    start = F.struct(F.lit(0).cast("long").alias("q"), F.lit(0).cast("long").alias("r"), F.array().cast("array<struct<op:string,len:int,q:bigint,r:bigint>>").alias("out"))

    def step(s: Column, o: Column) -> Column:
        here = F.struct(o["op"].alias("op"), o["len"].alias("len"), s["q"].alias("q"), s["r"].alias("r"))
        more = F.concat(s["out"], F.array(here))
        return F.struct(
            (s["q"] + F.when(o["op"].isin(*CONSUMES_QUERY), o["len"]).otherwise(0)).alias("q"),
            (s["r"] + F.when(o["op"].isin(*CONSUMES_REFERENCE), o["len"]).otherwise(0)).alias("r"),
            (more if longer is None else F.when(o["len"] > longer, more).otherwise(s["out"])).alias("out"),
        )

    return F.aggregate(ops, start, step, lambda s: s["out"])


def events_of(ops: Column, shortest: Column) -> Column:
    """Insertions and merged deletions longer than ``shortest``: ARRAY<STRUCT<kind, q, r, len>>, offsets from the read's start.

    Consecutive long deletions are one event until an insertion that is long enough, or another long operation, stands between.
    """
    kind = "array<struct<kind:string,q:bigint,r:bigint,len:bigint>>"
    start = F.struct(F.array().cast(kind).alias("out"), F.lit(None).cast("bigint").alias("from"), F.lit(None).cast("bigint").alias("to"))

    def event(name: str, q: Column, r: Column, length: Column) -> Column:
        return F.array(F.struct(F.lit(name).alias("kind"), q.cast("long").alias("q"), r.cast("long").alias("r"), length.cast("long").alias("len")))

    def step(s: Column, o: Column) -> Column:
        pending = F.when(s["from"].isNotNull(), event("DEL", F.lit(None), s["from"], s["to"] - s["from"])).otherwise(F.array().cast(kind))
        deletion = o["op"] == "D"  # all that come here are long
        out = F.when(deletion, s["out"]).when(o["op"] == "I", F.concat(s["out"], pending, event("INS", o["q"], o["r"], o["len"]))).otherwise(F.concat(s["out"], pending))
        begin = F.when(deletion, F.coalesce(s["from"], o["r"]))
        to = F.when(deletion, o["r"] + o["len"])
        return F.struct(out.alias("out"), begin.alias("from"), to.alias("to"))

    def end(s: Column) -> Column:
        return F.when(s["from"].isNotNull(), F.concat(s["out"], event("DEL", F.lit(None), s["from"], s["to"] - s["from"]))).otherwise(s["out"])

    none = ~F.exists(ops, lambda o: (o["len"] > shortest) & o["op"].isin("I", "D"))
    return F.when(none, F.array().cast(kind)).otherwise(F.aggregate(cursors(ops, shortest), start, step, end))
