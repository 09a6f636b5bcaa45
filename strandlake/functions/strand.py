"""Rules on nucleotide strings: primers, runs, overlaps, distances.  Built-in expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .convert import indexes

# Dinucleotide pairs whose runs are rejected, and the two primers in use before.
DIMERS = ("AT", "TA", "GC", "CG", "AG", "GA", "CA", "AC", "TG", "GT", "CT", "TC")
EARLIER_PRIMERS = ("CAGGTACGCAGTTAGCACTC", "CGTGGCAATATGACTACGGA")
# Nearest-neighbour enthalpies (kcal/mol) and entropies (cal/mol K), SantaLucia 1998.
NEIGHBOURS = {"AA": (-7.9, -22.2), "AT": (-7.2, -20.4), "TA": (-7.2, -21.3), "CA": (-8.5, -22.7), "GT": (-8.4, -22.4), "CT": (-7.8, -21.0), "GA": (-8.2, -22.2), "CG": (-10.6, -27.2), "GC": (-9.8, -24.4), "GG": (-8.0, -19.9)}


def reverse_complement(s: Column) -> Column:
    return F.reverse(F.translate(s, "ACGT", "TGCA"))


def anti_sequence(s: Column) -> Column:
    return F.translate(s, "ACGT", "CTAG")


def clean_read(s: Column) -> Column:
    """RNA letters to DNA, unknown ones to A."""
    return F.translate(s, "UN", "TA")


def at(s: Column, i: Column) -> Column:
    """The letter at 0-based place i."""
    return F.substr(s, i + 1, F.lit(1))


def mismatches(a: Column, b: Column) -> Column:
    """0-based places where two strings differ, up to the length of the shorter."""
    return F.filter(indexes(F.least(F.length(a), F.length(b))), lambda i: at(a, i) != at(b, i))


def hamming(a: Column, b: Column) -> Column:
    """Mismatches of two strings of one length; null for different lengths."""
    return F.when(F.length(a) == F.length(b), F.size(mismatches(a, b)))


def substitutions(a: Column, b: Column) -> Column:
    return F.concat_ws(",", F.transform(mismatches(a, b), lambda i: F.concat(at(a, i), F.lit("->"), at(b, i))))


def suffix_overlap(a: Column, b: Column) -> Column:
    """Length of the longest end of ``a`` (or all of ``b`` inside it) that begins ``b``; the leftmost place counts."""
    la, lb = F.length(a), F.length(b)
    places = F.filter(indexes(la), lambda i: F.substr(a, i + 1, F.least(lb, la - i)) == F.substr(b, F.lit(1), F.least(lb, la - i)))
    return F.when(F.size(places) > 0, F.least(lb, la - F.try_element_at(places, F.lit(1)))).otherwise(0)


def overlap_distance(a: Column, b: Column) -> Column:
    return F.greatest(suffix_overlap(a, b), suffix_overlap(b, a))


def repetition_score(s: Column, k: int = 5) -> Column:
    """Share of k-mers with a base next to its like."""
    n = F.length(s) - (k - 1)
    return F.when(n > 0, F.size(F.filter(indexes(n), lambda i: F.substr(s, i + 1, F.lit(k)).rlike(r"(.)\1"))) / n)


def self_dimer(s: Column, n: int) -> Column:
    """Some n-mer at i of the reverse complement stands in the strand behind i."""
    r = reverse_complement(s)
    last = F.length(s) - (n - 1)
    return F.exists(indexes(last), lambda i: F.instr(F.substr(s, i + 2, F.length(s)), F.substr(r, i + 1, F.lit(n))) > 0)


def has_run(s: Column, n: int) -> Column:
    return s.rlike("|".join(b * n for b in "ACGT"))


def has_dimer_run(s: Column, times: int) -> Column:
    return s.rlike("|".join(d * times for d in DIMERS))


def gc_percent(s: Column) -> Column:
    return F.when(F.length(s) > 0, 100.0 * F.length(F.translate(s, "AT", "")) / F.length(s))


def melting_temperature(s: Column, strand_nm: float = 25.0, salt_mm: float = 50.0) -> Column:
    """Nearest-neighbour melting temperature in Celsius, salt correction on the entropy."""
    rc = {"A": "T", "C": "G", "G": "C", "T": "A"}
    both = {k: v for d, v in NEIGHBOURS.items() for k in (d, rc[d[1]] + rc[d[0]])}
    h = F.create_map(*[x for d, (a, _) in both.items() for x in (F.lit(d), F.lit(a))])
    e = F.create_map(*[x for d, (_, b) in both.items() for x in (F.lit(d), F.lit(b))])
    pairs = F.transform(indexes(F.length(s) - 1), lambda i: F.substr(s, i + 1, F.lit(2)))
    at_ends = F.when(F.substring(s, 1, 1).isin("A", "T"), 1).otherwise(0) + F.when(F.substr(s, F.length(s), F.lit(1)).isin("A", "T"), 1).otherwise(0)
    dh = F.aggregate(pairs, F.lit(0.0), lambda acc, d: acc + F.try_element_at(h, d)) + 2.3 * at_ends + 0.1 * (2 - at_ends)
    ds = F.aggregate(pairs, F.lit(0.0), lambda acc, d: acc + F.try_element_at(e, d)) + 4.1 * at_ends - 2.8 * (2 - at_ends)
    ds = ds + 0.368 * (F.length(s) - 1) * F.log(F.lit(salt_mm * 1e-3))
    return 1000.0 * dh / (ds + 1.987 * F.log(F.lit(strand_nm * 1e-9 / 2))) - 273.15


def nearest_window(strand: Column, pattern: Column, first: int, last: Column) -> Column:
    """(distance, place) of the window in [first, last] with the least edit distance to ``pattern``; the leftmost of equals."""
    n = F.length(pattern)
    places = F.filter(indexes(last + 1), lambda i: i >= first)
    return F.array_min(F.transform(places, lambda i: F.struct(F.levenshtein(F.substr(strand, i + 1, n), pattern).alias("distance"), i.alias("place"))))


def strip_front(strand: Column, primer: str, search: int = 10, tolerance: int = 5) -> Column:
    """What follows the primer: found exactly anywhere, else the nearest window near the front; null if none is near."""
    p, n = F.lit(primer), len(primer)
    exact = F.instr(strand, primer)
    near = nearest_window(strand, p, 0, F.least(F.lit(search), F.length(strand) - n))
    return F.when(exact > 0, F.substr(strand, exact + n, F.length(strand))).when(near["distance"] <= tolerance, F.substr(strand, near["place"] + n + 1, F.length(strand)))


def strip_back(strand: Column, primer: str, search: int = 10, tolerance: int = 5) -> Column:
    """What precedes the primer, as ``strip_front`` mirrored; of equal windows the rightmost."""
    return F.reverse(strip_front(F.reverse(strand), primer[::-1], search, tolerance))


def insert_middle(strand: Column, site: str) -> Column:
    half = F.floor(F.length(strand) / 2).cast("int")
    return F.concat(F.substr(strand, F.lit(1), half), F.lit(site), F.substr(strand, half + 1, F.length(strand)))


def remove_middle(strand: Column, site: str) -> Column:
    """Without the site: exact anywhere, else the nearest window before the middle within a third of its length."""
    n, exact = len(site), F.instr(strand, site)
    half = F.floor(F.length(strand) / 2).cast("int")
    near = F.array_min(F.transform(F.filter(indexes(half), lambda i: i >= half - n), lambda i: F.struct(F.levenshtein(F.substr(strand, i + 1, F.lit(n)), F.lit(site)).alias("distance"), i.alias("place"))))
    cut = F.when(exact > 0, exact - 1).when(near["distance"] < n / 3, near["place"])
    return F.when(cut.isNull(), strand).otherwise(F.concat(F.substr(strand, F.lit(1), cut), F.substr(strand, cut + n + 1, F.length(strand))))


def transcribe_t7(strand: Column, promoter: str = "TAATACGACTCACTATAG") -> Column:
    found = F.instr(strand, promoter)
    return F.when(found > 0, F.substr(strand, found + len(promoter), F.length(strand))).otherwise(strand)
