"""Column functions over residue sequences and their notation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Monoisotopic residue masses in Da.
RESIDUE_MASS = {
    "A": 71.037114, "R": 156.101111, "N": 114.042927, "D": 115.026943, "C": 103.009185,
    "E": 129.042593, "Q": 128.058578, "G": 57.021464, "H": 137.058912, "I": 113.084064,
    "L": 113.084064, "K": 128.094963, "M": 131.040485, "F": 147.068414, "P": 97.052764,
    "S": 87.032028, "T": 101.047679, "W": 186.079313, "Y": 163.063329, "V": 99.068414,
}
#: Atoms of C, H, N, O and S in a residue.
RESIDUE_ATOMS = {
    "A": (3, 5, 1, 1, 0), "R": (6, 12, 4, 1, 0), "N": (4, 6, 2, 2, 0), "D": (4, 5, 1, 3, 0), "C": (3, 5, 1, 1, 1),
    "E": (5, 7, 1, 3, 0), "Q": (5, 8, 2, 2, 0), "G": (2, 3, 1, 1, 0), "H": (6, 7, 3, 1, 0), "I": (6, 11, 1, 1, 0),
    "L": (6, 11, 1, 1, 0), "K": (6, 12, 2, 1, 0), "M": (5, 9, 1, 1, 1), "F": (9, 9, 1, 1, 0), "P": (5, 7, 1, 1, 0),
    "S": (3, 5, 1, 2, 0), "T": (4, 7, 1, 2, 0), "W": (11, 10, 2, 1, 0), "Y": (9, 9, 1, 2, 0), "V": (5, 9, 1, 1, 0),
}
#: Masses in Da.
PROTON, WATER = 1.007276, 18.010565
#: Masses of neutral losses in Da, by name.
NEUTRAL_LOSS = {"H2O": 18.010565, "NH3": 17.026549, "H3PO4": 97.976896}
#: Names of losses that formats use.
LOSS_NAMES = {"WATER": "H2O", "AMMONIA": "NH3", "PHOSPHO": "H3PO4"}
#: Masses of common modifications in Da, by UniMod id.
UNIMOD_MASS = {1: 42.010565, 4: 57.021464, 7: 0.984016, 21: 79.966331, 35: 15.994915, 121: 114.042927}


def _lookup(table: dict) -> Column:
    return F.create_map(*[F.lit(x) for k, v in table.items() for x in (k, v)])


def strip_flanks(s: Column) -> Column:
    """``K.PEPTIDE.R`` to ``PEPTIDE``; dots inside brackets don't count."""
    return F.regexp_replace(s, r"^[A-Za-z_-]\.(.+)\.[A-Za-z_-]$", "$1")


def strip_modifications(s: Column) -> Column:
    """The bare sequence: brackets and parentheses with what they hold, and underscores, go."""
    return F.regexp_replace(s, r"\[[^\]]*\]|\([^)]*\)|_", "")


def unimod_ids(s: Column) -> Column:
    return F.transform(F.regexp_extract_all(s, F.lit(r"(?i)unimod:(\d+)"), F.lit(1)), lambda x: x.cast("int"))


def mass_notation(s: Column) -> Column:
    """UniMod ids of UNIMOD_MASS as bracketed masses; others stay."""
    for number, mass in UNIMOD_MASS.items():
        s = F.regexp_replace(s, rf"(?i)[\[(]unimod:{number}[\])]", f"[+{mass:.4f}]")
    return s


def split_list(s: Column) -> Column:
    """Parts between ``;`` or ``,``, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(s, "[;,]"), lambda x: F.trim(x)), lambda x: x != "")


def reversed_inner(s: Column, keep: str = "last") -> Column:
    """The sequence backwards, its last (or first) residue in place; one residue stays as it is."""
    n = F.length(s)
    if keep == "last":
        return F.when(n < 2, s).otherwise(F.concat(F.reverse(F.substring(s, F.lit(1), n - 1)), F.substring(s, n, F.lit(1))))
    return F.when(n < 2, s).otherwise(F.concat(F.substring(s, 1, 1), F.reverse(F.substring(s, F.lit(2), n - 1))))


def rotated_inner(s: Column, by: int) -> Column:
    """All but the last residue turned by ``by`` places."""
    n = F.length(s)
    inner, k = F.substring(s, F.lit(1), n - 1), F.lit(by) % F.greatest(n - 1, F.lit(1))
    return F.when(n < 2, s).otherwise(F.concat(F.substring(inner, k + 1, n), F.substring(inner, F.lit(1), k), F.substring(s, n, F.lit(1))))


def residues(s: Column) -> Column:
    return F.filter(F.split(s, ""), lambda x: x != "")


def mass(s: Column) -> Column:
    """Neutral mass; null with an unknown letter."""
    table = _lookup(RESIDUE_MASS)
    return F.aggregate(residues(s), F.lit(WATER), lambda a, x: a + F.try_element_at(table, x))


def precursor_mz(s: Column, charge: Column) -> Column:
    return (mass(s) + charge * PROTON) / charge


def composition(s: Column) -> Column:
    """(c, h, n, o, s) with one water; null with an unknown letter."""
    known = F.size(F.filter(residues(s), lambda x: ~x.isin(list(RESIDUE_ATOMS)))) == 0

    def total(table: Column, extra: int) -> Column:
        return F.aggregate(residues(s), F.lit(extra), lambda a, x: a + F.try_element_at(table, x))

    counts = [total(_lookup({k: v[i] for k, v in RESIDUE_ATOMS.items()}), extra).alias("chnos"[i]) for i, extra in enumerate((0, 2, 0, 1, 0))]
    return F.when(known, F.struct(*counts))


def fragment_mz(s: Column, kind: str, ordinal: Column, charge: Column, loss: Column | None = None) -> Column:
    """Place of the b or y fragment with ``ordinal`` residues."""
    if kind not in ("b", "y"):
        raise ValueError(f"kind is b or y, not {kind!r}")
    part = F.substring(s, F.lit(1), ordinal) if kind == "b" else F.substring(s, F.length(s) - ordinal + 1, ordinal)
    neutral = mass(part) - (WATER if kind == "b" else 0.0)
    neutral = neutral if loss is None else neutral - loss
    return (neutral + charge * PROTON) / charge


def ion_type(code: Column) -> Column:
    """One of b, y, a, c, x, z, precursor, unknown."""
    low = F.lower(F.trim(code))
    return F.when(low.isin("b", "y", "a", "c", "x", "z"), low).when(low.isin("p", "precursor", "m"), "precursor").otherwise("unknown")


def neutral_loss(name: Column) -> Column:
    """Mass of a loss by its formula or name in any case, or the number itself; null for none and for what isn't known."""
    known = F.upper(F.trim(name))
    formula = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in LOSS_NAMES.items() for x in pair]), known), known)
    return F.coalesce(F.try_element_at(_lookup(NEUTRAL_LOSS), formula), known.try_cast("double"))


def bracketed_masses(noted: Column) -> Column:
    """(position from 0, mass) of each number in brackets or parentheses after a residue, its sign as it stands; those before the first are at 0."""
    tokens = F.regexp_extract_all(noted, F.lit(r"[A-Za-z]|\[[^\]]*\]|\([^)]*\)"), F.lit(0))
    residues = lambda t, i: F.size(F.filter(F.slice(t, 1, i), lambda x: x.rlike("^[A-Za-z]$")))
    number = lambda x: F.regexp_replace(F.regexp_replace(x, r"[\[\]()]", ""), r"^\++", "")
    mass = lambda x: F.when(number(x).rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), number(x).cast("double"))
    each = F.transform(tokens, lambda x, i: F.struct(F.greatest(residues(tokens, i) - 1, F.lit(0)).alias("position"), mass(x).alias("mass")))
    return F.filter(each, lambda m: m.mass.isNotNull())
