"""Ids, scores and statuses as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def node_id(kind: Column, qualified_name: Column) -> Column:
    return F.substring(F.sha2(F.concat(kind, F.lit(":"), qualified_name), 256), 1, 16)


def edge_id(kind: Column, source: Column, target: Column) -> Column:
    return F.substring(F.sha2(F.concat(kind, F.lit(":"), source, F.lit("->"), target), 256), 1, 16)


def _penalty(value: Column, free: float, rate: float, most: float) -> Column:
    """Grows by ``rate`` for each unit above ``free``, up to ``most``."""
    return F.when(value > free, F.least(F.lit(most), (value - free) * rate)).otherwise(F.lit(0).cast("int" if isinstance(most, int) else "double"))


def health_score(cyclomatic: Column, cognitive: Column, depth: Column, difficulty: Column, maintainability: Column, instability: Column | None = None, afferent: Column | None = None) -> Column:
    """From 0 to 1; null metrics count as their defaults (maintainability 100, others 0).

    What counts (complexities, depth) cost is summed in whole thousandths, as SQL
    sums decimals, so that a score next to a band's bound rounds as it does there.
    """
    known = lambda c, d=0.0: F.coalesce(c.cast("double"), F.lit(d))
    count = lambda c: F.coalesce(c.cast("long"), F.lit(0))
    lost = _penalty(count(cyclomatic), 5, 20, 600) + _penalty(count(cognitive), 8, 15, 300) + _penalty(count(depth), 3, 40, 400)
    if instability is not None and afferent is not None:
        lost = lost + F.when((known(instability) > 0.8) & (known(afferent) > 5), 150).otherwise(0)
    eased = F.greatest(F.lit(0.0), F.least(F.lit(100.0), known(maintainability, 100.0))) / 100 * 0.3
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (1000 - lost) / 1000.0 - _penalty(known(difficulty), 15, 0.005, 0.2) + eased - 0.15))


def score_band(score: Column) -> Column:
    return F.when(score >= 0.8, "healthy").when(score >= 0.6, "stressed").when(score >= 0.3, "inflamed").otherwise("cancerous")


def is_hidden(name: Column, qualified_name: Column) -> Column:
    """Private, or nested in a function; dunder names never are."""
    dunder = name.startswith("__") & name.endswith("__")
    return ~dunder & (name.startswith("_") | qualified_name.contains(".<locals>."))


def health_status(kind: Column, name: Column, qualified_name: Column, callers: Column, refers_to_itself: Column, score: Column) -> Column:
    """Uncalled hidden code first, then self-reference, then the score's band."""
    dead = kind.isin("function", "method") & (F.coalesce(callers, F.lit(0)) == 0) & is_hidden(name, qualified_name)
    return F.when(dead, "necrotic").when(F.coalesce(refers_to_itself, F.lit(False)), "inflamed").otherwise(score_band(score))


def health_notes(status: Column, refers_to_itself: Column, score: Column) -> Column:
    text = F.format_string("%.2f", score)
    note = (
        F.when(status == "necrotic", "Uncalled private/nested code")
        .when(F.coalesce(refers_to_itself, F.lit(False)), "Self-referential - circular dependency")
        .when(status == "stressed", F.concat(F.lit("Moderate complexity (score: "), text, F.lit(")")))
        .when(status == "inflamed", F.concat(F.lit("High complexity (score: "), text, F.lit(")")))
        .when(status == "cancerous", F.concat(F.lit("Critical complexity (score: "), text, F.lit(")")))
    )
    return F.when(note.isNotNull(), F.array(note)).otherwise(F.array().cast("array<string>"))


def maintainability(volume: Column, cyclomatic: Column, loc: Column) -> Column:
    raw = (171 - 5.2 * F.log(F.greatest(volume.cast("double"), F.lit(1.0))) - 0.23 * cyclomatic - 16.2 * F.log(loc.cast("double"))) * 100 / 171
    return F.when(loc == 0, 100.0).otherwise(F.round(F.greatest(F.lit(0.0), raw), 2))


def halstead(n1: Column, n2: Column, total1: Column, total2: Column) -> dict[str, Column]:
    """Derived measures of distinct and total operators (1) and operands (2); zeros without operands."""
    some = (n2 > 0) & (n1 + n2 > 0)
    volume = F.when(some, (total1 + total2) * F.log2((n1 + n2).cast("double"))).otherwise(0.0)
    difficulty = F.when(some, n1 / 2 * (total2 / n2)).otherwise(0.0)
    return {
        "vocabulary": n1 + n2,
        "length": total1 + total2,
        "volume": volume,
        "difficulty": difficulty,
        "effort": difficulty * volume,
        "bugs": volume / 3000,
    }


def cohesion(internal: Column, members: Column) -> Column:
    """Links inside a group over those possible."""
    possible = F.when(members >= 2, members * (members - 1) / 2).otherwise(1.0)
    return F.least(F.lit(1.0), internal / possible)


def malware_risk(weighted: Column) -> Column:
    """From the sum of severity weight times confidence."""
    return F.least(F.lit(1.0), weighted / 3.0)


def looked_up(key: Column, table: dict, default) -> Column:
    """The value of a fixed table, as a column (tuples become arrays)."""
    literal = lambda v: F.array(*[F.lit(x) for x in v]) if isinstance(v, tuple) else F.lit(v)
    pairs = [x for k, v in table.items() for x in (F.lit(k), literal(v))]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), literal(default))


def directory_size(n: Column, files: bool = False) -> Column:
    """Visual size of a directory of n nodes (or of a file)."""
    return (1.5 if files else 2.0) + F.log10(F.greatest(n, F.lit(1)).cast("double")) * (0.5 if files else 0.8)


def cluster_size(n: Column) -> Column:
    return 1 + F.log10(F.greatest(n, F.lit(1)).cast("double")) * 0.5


def modularity_gain(k_in: Column, k_out: Column, degree: Column, to_total: Column, from_total: Column, m: Column, resolution: float) -> Column:
    return (k_in - k_out) / m - resolution * degree * (to_total - from_total) / (2 * m * m)
