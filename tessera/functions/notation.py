"""How breakpoints are written: ALT alleles, BEDPE lines, read-support rows and FASTA records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def alt_alleles(notation: Column, start_chr: Column, start: Column, end_chr: Column, end: Column, start_base: Column, end_base: Column) -> Column:
    """ARRAY of one ALT (insertion, single breakend) or two (start edge, end edge)."""
    s, e = F.concat(start_chr, F.lit(":"), start.cast("string")), F.concat(end_chr, F.lit(":"), end.cast("string"))
    c = lambda *x: F.concat(*[F.lit(v) if isinstance(v, str) else v for v in x])
    pair = lambda a, b: F.array(a, b)
    return (
        F.when(notation == "+-", pair(c(start_base, "[", e, "["), c("]", s, "]", end_base)))
        .when(notation == "++", pair(c(start_base, "]", e, "]"), c(end_base, "]", s, "]")))
        .when(notation == "-+", pair(c("]", e, "]", start_base), c(end_base, "[", s, "[")))
        .when(notation == "--", pair(c("[", e, "[", start_base), c("[", s, "[", end_base)))
        .when(notation == "<INS>", F.array(F.lit("<INS>")))
        .otherwise(F.array(c(".", start_base)))
    )


def bedpe_line(start_chr: Column, start: Column, end_chr: Column, end: Column, number: Column, length: Column, tumour: Column, normal: Column, notation: Column) -> Column:
    text = lambda x: x.cast("string")
    name = F.concat_ws("|", F.concat(F.lit("ID_"), text(number)), F.concat(text(length), F.lit("bp")), F.concat(F.lit("TUMOUR_"), text(tumour), F.lit("/NORMAL_"), text(normal)), notation)
    last = F.when((start_chr == end_chr) & (start == end), end + 1).otherwise(end)
    return F.concat_ws("\t", start_chr, text(start), text(start), end_chr, text(last), text(last), name)


def read_support_line(number: Column, tumour_reads: Column, normal_reads: Column) -> Column:
    """ID, tumour reads, normal reads; names are quoted where any holds a comma."""
    comma = F.exists(F.concat(tumour_reads, normal_reads), lambda r: r.contains(","))
    joined = lambda reads: F.when(comma, F.array_join(F.transform(reads, lambda r: F.concat(F.lit('"'), r, F.lit('"'))), ",")).otherwise(F.array_join(reads, ","))
    return F.concat_ws("\t", F.concat(F.lit("ID_"), number.cast("string")), joined(tumour_reads), joined(normal_reads))


def insertion_fasta(number: Column, notation: Column, sequences: Column) -> Column:
    """ARRAY of FASTA records of inserted sequences, 80 letters a line."""

    def record(seq: Column, i: Column) -> Column:
        head = F.concat(F.lit(">ID_"), number.cast("string"), F.lit("-INSSEQ_"), F.lpad((i + 1).cast("string"), 5, "0"), F.lit(" | "), notation, F.lit(" | "), (i + 1).cast("string"), F.lit("/"), F.size(sequences).cast("string"), F.lit(" | "), F.length(seq).cast("string"), F.lit("bp\n"))
        return F.concat(head, F.regexp_replace(seq, "(.{80})(?=.)", "$1\n"))

    return F.transform(sequences, record)


def mate_of_alt(alt: Column) -> tuple[Column, Column]:
    """(chromosome, position) of the mate that a bracketed ALT names."""
    pattern = r"[\[\]](.+):(\d+)[\[\]]"
    return F.regexp_extract(alt, pattern, 1), F.regexp_extract(alt, pattern, 2).try_cast("long")
