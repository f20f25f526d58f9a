"""Functions on DNA text, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def reverse_complement(s: Column) -> Column:
    return F.reverse(F.translate(s, "ACGTacgt", "TGCAtgca"))


def pack(s: Column) -> Column:
    """Two bits a base, A 0, C 1, G 2, T 3, anything else 0; up to 31 bases."""
    return F.conv(F.translate(F.regexp_replace(F.upper(s), "[^ACGT]", "A"), "ACGT", "0123"), 4, 10).cast("long")


def gc(s: Column) -> Column:
    return F.length(F.regexp_replace(s, "[^GCgc]", "")) / F.length(s)


def tiles(s: Column, k: int, size: int = 128) -> Column:
    """The text in pieces of ``size`` bases, each with the first k - 1 of the next: every window of k begins in one of them."""
    size = max(size, 2 * k)
    cut = F.regexp_extract_all(s, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))
    # the array of one binds the pieces, so that they are cut once
    return F.transform(F.array(cut), lambda c: F.transform(c, lambda t, i: F.concat(t, F.substring(F.coalesce(F.get(c, i + 1), F.lit("")), 1, k - 1))))[0]


def kmers(s: Column, k: int) -> Column:
    """All windows of k bases, in order. Cut from short pieces, as a substring is found by counting from a text's start."""
    own = lambda t: F.transform(F.sequence(F.lit(1), F.length(t) - k + 1), lambda i: F.substring(t, i, F.lit(k)))
    return F.flatten(F.transform(F.filter(tiles(s, k), lambda t: F.length(t) >= k), own))


def valid(s: Column) -> Column:
    return s.rlike("^[ACGTacgt]*$")


#: Unified nearest-neighbour enthalpies (kcal/mol) and entropies (cal/mol K) of stacked base pairs.
STACKS = {
    "AA": (-7.6, -21.3), "AT": (-7.2, -20.4), "TA": (-7.2, -20.4), "CA": (-8.5, -22.7), "GT": (-8.4, -22.4),
    "CT": (-7.8, -21.0), "GA": (-8.2, -22.2), "CG": (-10.6, -27.2), "GC": (-9.8, -24.4), "GG": (-8.0, -19.0),
}
_PAIRS = STACKS | {"".join({"A": "T", "C": "G", "G": "C", "T": "A"}[c] for c in reversed(k)): v for k, v in STACKS.items()}


def melting_temperature(s: Column, sodium: float = 0.39, strand: float = 1e-9) -> Column:
    """Nearest-neighbour melting temperature (degrees C) of a duplex with the given sodium (M) and effective strand (M) concentrations:
    entropy corrected by 0.368 (n - 1) ln[Na]; initiation 0.2 kcal/mol, -5.7 cal/mol K; a terminal AT pair adds 2.2 and 6.9."""
    upper = F.upper(s)
    pairs = F.transform(F.sequence(F.lit(1), F.length(s) - 1), lambda i: F.substring(upper, i, F.lit(2)))
    add = lambda k: F.aggregate(F.transform(pairs, lambda p: F.coalesce(F.element_at(F.create_map(*[x for q, v in _PAIRS.items() for x in (F.lit(q), F.lit(v[k]))]), p), F.lit(0.0))), F.lit(0.0), lambda a, x: a + x)
    ends = F.length(F.regexp_replace(F.concat(F.substring(upper, 1, 1), F.substring(upper, -1, 1)), "[^AT]", ""))
    h = add(0) + 0.2 + 2.2 * ends
    t = add(1) - 5.7 + 6.9 * ends + 0.368 * (F.length(s) - 1) * F.log(F.lit(sodium))
    return F.when(F.length(s) >= 2, 1000 * h / (t + 1.987 * F.log(F.lit(strand))) - 273.15)


def assembled(primer5: Column, readouts5: list[Column], target: Column, readouts3: list[Column], primer3: Column) -> Column:
    """A probe from its parts; see ``parsed``."""
    return F.concat(primer5, *readouts5, target, *readouts3, primer3)


def parsed(probe: Column, primer: int = 20, readout: int = 20, before: int = 1, after: int = 2) -> Column:
    """The parts of an assembled probe, by their lengths: primer5, readouts5, target, readouts3, primer3."""
    n = F.length(probe)
    cut = lambda start, length: F.substring(probe, start, length)
    lit = F.lit
    five = F.array(*[cut(lit(1 + primer + k * readout), lit(readout)) for k in range(before)])
    three = F.array(*[cut(n - primer - (after - k) * readout + 1, lit(readout)) for k in range(after)])
    target = cut(lit(1 + primer + before * readout), n - 2 * primer - (before + after) * readout)
    return F.struct(cut(lit(1), lit(primer)).alias("primer5"), five.alias("readouts5"), target.alias("target"), three.alias("readouts3"), cut(n - primer + 1, lit(primer)).alias("primer3"))


def readout_ok(s: Column, gc_low: float = 0.4, gc_high: float = 0.6, c_low: float = 0.22, c_high: float = 0.28) -> Column:
    """Gates of a readout: GC and C shares inside open ranges, no base four times running, no six bases twice, and no six
    of the first twelve with four C."""
    c = F.length(F.regexp_replace(s, "[^C]", "")) / F.length(s)
    windows = F.transform(F.sequence(F.lit(1), F.lit(7)), lambda i: F.length(F.regexp_replace(F.substring(s, i, F.lit(6)), "[^C]", "")))
    six = kmers(s, 6)
    return (gc(s) > gc_low) & (gc(s) < gc_high) & (c > c_low) & (c < c_high) & ~s.rlike("AAAA|CCCC|GGGG|TTTT") & (F.size(F.array_distinct(six)) == F.size(six)) & ~F.exists(windows, lambda x: x >= 4)


def swapped(probe: Column, start: int, part: Column) -> Column:
    """The probe with ``part`` in place of as many bases from ``start`` (1-based; negative counts from the end)."""
    at = F.lit(start) if start > 0 else F.length(probe) + start + 1
    return F.concat(F.substring(probe, F.lit(1), at - 1), part, F.substring(probe, at + F.length(part), F.length(probe)))


def base5(s: Column, reverse: bool = False) -> Column:
    """The first 27 bases as digits of base 5, the first lowest: anything else 0, A 1, C 2, G 3, T 4; ``reverse``: of the complement, backwards, where
    anything else is 4."""
    code = F.translate(F.regexp_replace(F.upper(s), "[^ACGT]", "N"), "NACGT", "01234")
    digits = F.split(F.reverse(F.translate(code, "01234", "43210")) if reverse else code, "")
    whole = F.filter(digits, lambda x: x != "")
    return F.aggregate(F.reverse(whole), F.lit(0).cast("long"), lambda a, x: a * 5 + x.cast("long"))


def lower_runs(s: Column) -> Column:
    """The runs of lower-case bases, such as targets between upper-case handles."""
    return F.regexp_extract_all(s, F.lit("[a-z]+"), F.lit(0))


def masked(s: Column, mask: str = "N") -> Column:
    """Soft-masked (lower-case) bases as ``mask``."""
    return F.regexp_replace(s, "[acgtn]", mask)


def unmasked_parts(s: Column) -> Column:
    """The stretches between masked bases (n or N)."""
    return F.filter(F.split(s, "[nN]+"), lambda x: x != "")


def padded(s: Column, length: Column, pad: str, left: int = 5) -> Column:
    """Fill up to ``length`` from ``pad``: up to ``left`` of its first bases in front, the others of its last bases behind, in the other case than
    the end that they touch."""
    missing = F.greatest(length - F.length(s), F.lit(0))
    front = F.least(F.lit(left), missing)
    back = missing - front
    case = lambda part, end: F.when(end == F.lower(end), F.upper(part)).otherwise(F.lower(part))
    head, tail = F.substring(F.lit(pad), F.lit(1), front), F.substring(F.lit(pad), F.lit(len(pad) + 1) - back, back)
    return F.concat(F.when(front > 0, case(head, F.substring(s, 1, 1))).otherwise(""), s, F.when(back > 0, case(tail, F.substring(s, -1, 1))).otherwise(""))


def up_down(s: Column, n: int) -> Column:
    """The first and the last n bases."""
    return F.struct(F.substring(s, 1, n).alias("up"), F.substring(s, -n, n).alias("down"))


def probe_name(region: Column, gene: Column, number: Column, start: Column) -> Column:
    return F.concat(F.lit("reg_"), region, F.lit("_gene_"), gene, F.lit("_pb_"), number.cast("string"), F.lit("_pos_"), start.cast("string"))


def parsed_name(name: Column) -> Column:
    """The parts of a ``probe_name``; null numbers where a part is missing."""
    part = lambda p: F.regexp_extract(name, p, 1)
    return F.struct(
        part("^reg_(.*?)_gene_").alias("region"), part("_gene_(.*?)_pb_").alias("gene"), part(r"_pb_(\d+)").try_cast("int").alias("number"), part(r"_pos_(\d+)").try_cast("long").alias("start")
    )
