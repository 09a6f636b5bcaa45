"""Edit scripts of reads with known edits, and the figures that follow from them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import channel as N
from ..operators import edits as E
from ..functions.strand import at
from .base import STRANDS, Family, big, strands, table
from .channel import LIMIT, _sql_mutate

family = Family()
add = family.add

#: One edit a strand at a place that follows from its id: a substitution, a deletion or an insertion.  In a run of like
#: letters a deletion or insertion is at the run's start, r letters before.
EDITED = f"""WITH {STRANDS}, p AS (SELECT id, dna, length(dna) AS n, (5 + id % 20)::INT AS k, substr(dna, (6 + id % 20)::INT, 1) AS c FROM strands),
q AS (SELECT *, substr(dna, 1, k) AS head, translate(c, 'ACGT', 'GTAC') AS x FROM p),
e AS (SELECT id, n, CASE id % 3 WHEN 0 THEN k WHEN 1 THEN length(rtrim(head, c)) ELSE length(rtrim(head, x)) END AS pos, CASE id % 3 WHEN 0 THEN 'R' WHEN 1 THEN 'D' ELSE 'I' END AS op FROM q),
v AS (SELECT *, repeat('M', pos) || op || repeat('M', n - pos - CASE op WHEN 'I' THEN 0 ELSE 1 END) AS visual FROM e)"""


def edited(spark, sf):
    k = (F.lit(5) + F.col("id") % 20).cast("int")
    c = at(F.col("dna"), k)
    new = F.when(F.col("id") % 3 == 0, F.translate(c, "ACGT", "CGTA")).when(F.col("id") % 3 == 1, "").otherwise(F.concat(F.translate(c, "ACGT", "GTAC"), c))
    s = strands(spark, sf).select("id", "dna")
    return s.withColumn("seen", F.concat(F.substr("dna", F.lit(1), k), new, F.substr("dna", k + 2, F.length("dna"))))


def scripts(spark, sf):
    return E.edit_scripts(edited(spark, sf), "dna", "seen")


@add("edit_script", f"{EDITED} SELECT id, visual, op, pos::BIGINT AS src FROM v")
def edit_script(spark, sf):
    return scripts(spark, sf).select("id", "visual", F.explode("script").alias("e")).select("id", "visual", "e.op", big(F.col("e.src"), "src"))


@add("edit_summary", f"{EDITED} SELECT id, 1::BIGINT AS edits, (op = 'I')::BIGINT AS insertions, (op = 'D')::BIGINT AS deletions, (op = 'R')::BIGINT AS substitutions, 1::BIGINT AS densest, op AS patterns FROM v")
def edit_summary(spark, sf):
    c = E.edit_counts(F.col("visual"))
    return scripts(spark, sf).select("id", *[big(c[x], x) for x in ("edits", "insertions", "deletions", "substitutions")], big(E.densest_window(F.col("visual"), 10), "densest"), F.array_join(E.patterns(F.col("visual")), ",").alias("patterns"))


@add("edit_positions", f"{EDITED} SELECT pos::BIGINT AS pos, op, count(*)::BIGINT AS n FROM v GROUP BY ALL")
def edit_positions(spark, sf):
    return E.error_positions(scripts(spark, sf)).select(big(F.col("pos"), "pos"), "op", "n")


@add("pattern_hist", f"WITH {STRANDS}, b AS (SELECT id % 4 + 1 AS n FROM strands) SELECT repeat('D', n::INT) AS pattern, count(*)::BIGINT AS n FROM b GROUP BY 1")
def pattern_hist(spark, sf):
    """Strands that lose a burst of one to four letters at their very end, after a letter of another kind."""
    marked = strands(spark, sf).select("id", F.concat("dna", F.lit("N")).alias("kept"), F.repeat(F.lit("A"), (F.col("id") % 4 + 1).cast("int")).alias("lost"))
    return E.pattern_histogram(E.edit_scripts(marked.select("id", F.concat("kept", "lost").alias("dna"), F.col("kept").alias("seen")), "dna", "seen"))


@add("dna_error_probe", f"WITH {STRANDS}, m AS (SELECT id, dna, {_sql_mutate(str(LIMIT), 15)} AS seen FROM strands) SELECT id, levenshtein(dna, seen)::BIGINT AS edits, (length(seen) - length(dna))::BIGINT AS gained, dna = seen AS intact FROM m")
def dna_error_probe(spark, sf):
    s = strands(spark, sf).select("id", "dna").withColumn("seen", N.mutate(F.col("dna"), LIMIT, 15, F.col("id")))
    c = E.edit_counts(F.col("visual"))
    return E.edit_scripts(s, "dna", "seen").select("id", big(c["edits"], "edits"), big(c["insertions"] - c["deletions"], "gained"), (c["edits"] == 0).alias("intact"))


@add("base_error_rate", f"WITH {STRANDS}, m AS (SELECT id, dna, {_sql_mutate(str(LIMIT), 16)} AS seen FROM strands) SELECT length(dna)::BIGINT AS length, count(*)::BIGINT AS strands, sum((dna = seen)::INT)::BIGINT AS intact, sum(levenshtein(dna, seen))::BIGINT AS edits, round(sum(levenshtein(dna, seen)) / sum(length(dna))::DOUBLE, 9) AS rate FROM m GROUP BY 1")
def base_error_rate(spark, sf):
    s = strands(spark, sf).select("id", "dna").withColumn("seen", N.mutate(F.col("dna"), LIMIT, 16, F.col("id")))
    out = E.error_rates(E.edit_scripts(s, "dna", "seen"), "dna")
    return out.select(big(F.col("length"), "length"), "strands", "intact", "edits", F.round("rate", 9).alias("rate"))


@add("position_error_curve", f"{EDITED}, s AS (SELECT unnest(range(0, n)) AS pos FROM v), t AS (SELECT pos, count(*) AS strands FROM s GROUP BY pos), c AS (SELECT pos, count(*) AS n FROM v GROUP BY pos) SELECT t.pos::BIGINT AS pos, round(coalesce(c.n, 0) / t.strands::DOUBLE, 9) AS rate FROM t LEFT JOIN c ON t.pos = c.pos")
def position_error_curve(spark, sf):
    return E.position_rates(scripts(spark, sf), "dna").select(big(F.col("pos"), "pos"), F.round("rate", 9).alias("rate"))


@add("edit_bursts", f"WITH {STRANDS}, b AS (SELECT (id % 4 + 1)::BIGINT AS length FROM strands) SELECT length, count(*)::BIGINT AS n FROM b GROUP BY 1")
def edit_bursts(spark, sf):
    """Bursts of one to four letters inserted at the end, where nothing but the burst can be."""
    s = strands(spark, sf).select("id", "dna", F.concat("dna", F.lit("N")).alias("kept"))
    pairs = s.select("id", "kept", F.concat("kept", F.repeat(F.lit("C"), (F.col("id") % 4 + 1).cast("int"))).alias("seen"))
    lengths = E.edit_scripts(pairs, "kept", "seen").select(F.explode(E.bursts(F.col("visual"), "I")).alias("length"))
    return lengths.groupBy(big(F.col("length"), "length")).agg(F.count(F.lit(1)).alias("n"))


@add("codeword_error_probe", "SELECT p_partkey AS id, (p_partkey % 5)::BIGINT AS first, (p_partkey % 2 + 1)::BIGINT AS wrong FROM part")
def codeword_error_probe(spark, sf):
    """Codewords of part names, one at place id % 5 changed and for odd ids one at place 7 lost."""
    cw = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: (F.col("p_partkey") * 7 + i * 31) % 256)
    rows = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), cw.alias("cw"))
    worn = F.transform("cw", lambda x, i: F.when(i == F.col("id") % 5, (x + 1) % 256).when((i == 7) & (F.col("id") % 2 == 1), F.lit(None)).otherwise(x))
    seen = rows.select("id", "cw", worn.alias("got"))
    wrong = F.size(F.filter(F.arrays_zip("cw", "got"), lambda p: ~p["cw"].eqNullSafe(p["got"])))
    return seen.select("id", big(E.first_error(F.col("cw"), F.col("got")), "first"), big(wrong, "wrong"))
