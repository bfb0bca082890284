"""Molecular graphs from SMILES, and the masses of their fragments.

A documented part of the grammar: atoms of the organic subset, also aromatic,
and in brackets (isotope, symbol, chirality, hydrogens, charge, class); bonds
- = # : / \\ ~; branches, ring closures of one or two digits, and dots.  What
lies beyond it, rings and branches left open, unknown elements, and atoms with
more bonds than they can have, give null.  Hydrogens that are not written
follow from the lowest normal valence that the bonds leave room in.

A graph is a row of arrays, atoms and bonds; a parser reads each string once.
Put graph() into a column before other functions name it: what it gives goes
into lambdas, where Spark takes columns alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .mass import ATOMIC_MASS
from .text import SMILES_TOKEN

# Normal valences of the atoms that may be written without brackets, and the orders of bonds.
VALENCES = {"B": (3,), "C": (4,), "N": (3, 5), "O": (2,), "P": (3, 5), "S": (2, 4, 6), "F": (1,), "Cl": (1,), "Br": (1,), "I": (1,)}
ORDERS = {"-": 1.0, "=": 2.0, "#": 3.0, ":": 1.5, "/": 1.0, "\\": 1.0, "~": 1.0}
BRACKET = re.compile(r"\[(?P<isotope>\d*)(?P<symbol>[A-Z][a-z]?|[bcnops]|se|\*)(?P<chiral>@{0,2})(?:H(?P<hydrogens>\d*))?(?P<charge>[+-]\d+|\++|-+)?(?::\d+)?\]")
TOKENS = re.compile(SMILES_TOKEN)
MASSES = ATOMIC_MASS | {"Se": 79.9165213}
_ATOM = T.StructType([T.StructField("symbol", T.StringType()), T.StructField("hydrogens", T.IntegerType()), T.StructField("charge", T.IntegerType()), T.StructField("isotope", T.IntegerType()), T.StructField("aromatic", T.BooleanType())])
_BOND = T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.IntegerType()), T.StructField("order", T.DoubleType())])
GRAPH = T.StructType([T.StructField("atoms", T.ArrayType(_ATOM)), T.StructField("bonds", T.ArrayType(_BOND))])


def _atom(token: str) -> tuple[str, int | None, int, int, bool] | None:
    """symbol, written hydrogens (None: by valence), charge, isotope, aromatic."""
    if token == "*":
        return "*", 0, 0, 0, False
    if not token.startswith("["):
        symbol = token.capitalize()
        return (symbol, None, 0, 0, token.islower()) if symbol in VALENCES and (not token.islower() or token in "bcnops") else None
    m = BRACKET.fullmatch(token)
    if not m or m["symbol"].capitalize() not in MASSES and m["symbol"] != "*":
        return None
    sign = m["charge"] or ""
    charge = 0 if not sign else int(sign) if len(sign) > 1 and sign[1].isdigit() else (1 if sign[0] == "+" else -1) * len(sign)
    hydrogens = 0 if m["hydrogens"] is None else int(m["hydrogens"] or 1)
    return m["symbol"].capitalize(), hydrogens, charge, int(m["isotope"] or 0), m["symbol"].islower()


def parsed(smiles: str) -> tuple[list[list], list[tuple[int, int, float]]] | None:
    """Atoms as [symbol, hydrogens, charge, isotope, aromatic] and bonds as (a, b, order); None beyond the grammar."""
    atoms: list[list] = []
    bonds: list[tuple[int, int, float]] = []
    rings: dict[str, tuple[int, str | None]] = {}
    branches: list[int] = []
    last, bond = -1, None

    def joined(a: int, b: int, mark: str | None) -> None:
        both = atoms[a][4] and atoms[b][4]
        bonds.append((a, b, ORDERS[mark] if mark else 1.5 if both else 1.0))

    tokens = TOKENS.findall(smiles)
    for before, token in zip(["", *tokens], tokens):
        if token in ORDERS:
            if bond or last < 0:
                return None
            bond = token
        elif token == "(":
            if last < 0 or bond:
                return None
            branches.append(last)
        elif token == ")":
            if not branches or bond or before == "(":
                return None
            last = branches.pop()
        elif token == ".":
            if bond or branches or last < 0:
                return None
            last = -1
        elif token.isdigit() or token.startswith("%"):
            if last < 0:
                return None
            if token in rings:
                other, mark = rings.pop(token)
                if other == last or (mark and bond and mark != bond) or any({other, last} == {a, b} for a, b, _ in bonds):
                    return None
                joined(other, last, mark or bond)
            else:
                rings[token] = last, bond
            bond = None
        else:
            atom = _atom(token)
            if atom is None:
                return None
            atoms.append(list(atom))
            if last >= 0:
                joined(last, len(atoms) - 1, bond)
            last, bond = len(atoms) - 1, None
    if rings or branches or bond or last < 0:
        return None
    used = [0.0] * len(atoms)
    for a, b, order in bonds:
        for end in (a, b):
            used[end] += 1.0 if order == 1.5 else order
    for atom, n in zip(atoms, used, strict=True):
        symbol, hydrogens, _, _, aromatic = atom
        if hydrogens is None:
            normal = VALENCES[symbol]
            if aromatic:  # one more place goes to the ring's electrons, where there is one
                atom[1] = max(0, int(normal[0] - n - 1))
            elif n > normal[-1]:
                return None
            else:
                atom[1] = int(next(v for v in normal if v >= n) - n)
    return atoms, bonds


@F.arrow_udf(GRAPH)
def _graphs(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    atom = pa.struct([("symbol", pa.string()), ("hydrogens", pa.int32()), ("charge", pa.int32()), ("isotope", pa.int32()), ("aromatic", pa.bool_())])
    bond = pa.struct([("a", pa.int32()), ("b", pa.int32()), ("order", pa.float64())])
    kind = pa.struct([("atoms", pa.list_(atom)), ("bonds", pa.list_(bond))])
    names, ends = [f.name for f in atom], [f.name for f in bond]
    for batch in batches:
        rows = []
        for s in batch.to_pylist():
            found = parsed(s) if s else None
            rows.append(found and {"atoms": [dict(zip(names, a, strict=True)) for a in found[0]], "bonds": [dict(zip(ends, b, strict=True)) for b in found[1]]})
        yield pa.array(rows, kind)


def graph(smiles: Column) -> Column:
    """Struct (atoms, bonds); null for null, empty and what the grammar doesn't have."""
    return _graphs(smiles)


def atom_mass(atom: Column) -> Column:
    """An atom's with its hydrogens'; null for an element without a listed mass."""
    table = F.create_map(*[F.lit(x) for kv in MASSES.items() for x in kv])
    return F.try_element_at(table, atom["symbol"]) + atom["hydrogens"] * ATOMIC_MASS["H"]


# Masses of isotopes that structures name.
ISOTOPE_MASS = {
    "2H": 2.01410177812, "3H": 3.0160492779, "13C": 13.00335483507, "14C": 14.0032419884, "15N": 15.00010889888, "17O": 16.9991317565, "18O": 17.99915961286, "33S": 32.9714589098, "34S": 33.967867004,
    "37Cl": 36.965902602, "81Br": 80.9162897, "125I": 124.9046294,
}


def token_mass(token: Column) -> Column:
    """The mass of a SMILES token's atom without its hydrogens, 0 for other tokens and unknown elements; a named isotope counts with its own mass, or its number where that isn't listed.  Summed it bounds a neutral structure's mass from below."""
    inner = r"^\[([0-9]*)([A-Z][a-z]?|[bcnops]|se)"
    bracket = token.startswith("[")
    element = F.initcap(F.when(bracket, F.regexp_extract(token, inner, 2)).when(token.rlike("^(Br|Cl|Si|Se|se|[BCNOPSFI]|[bcnops])$"), token))
    number = F.when(bracket, F.regexp_extract(token, inner, 1)).otherwise("")
    table = lambda values: F.create_map(*[F.lit(x) for kv in values.items() for x in kv])
    plain = F.try_element_at(table(MASSES), element)
    isotope = F.coalesce(F.try_element_at(table(ISOTOPE_MASS), F.concat(number, element)), number.try_cast("double"))
    return F.coalesce(F.when(plain.isNotNull() & (number != ""), isotope).otherwise(plain), F.lit(0.0))


def composition(g: Column) -> Column:
    """Struct (formula, mass, charge, parts, carbons, generic, isotopes) of a graph: the Hill formula, the neutral atoms' mass less the charge's electrons, the sum of charges, how many parts dots separate, carbon atoms, whether any atom is a wildcard, whether any isotope is named.  Null for a null graph."""
    from .mass import ELECTRON

    atoms = g["atoms"]
    count = lambda f: F.aggregate(atoms, F.lit(0), lambda s, a: s + f(a))
    mass = F.aggregate(atoms, F.lit(0.0), lambda s, a: s + atom_mass(a))
    charge = count(lambda a: a["charge"])
    of = lambda symbol: count(lambda a: (a["symbol"] == symbol).cast("int"))
    hydrogens = count(lambda a: a["hydrogens"]) + of("H")
    text = lambda name, n: F.when(n > 1, F.concat(F.lit(name), n.cast("string"))).when(n == 1, F.lit(name)).otherwise("")
    others = F.array_sort(F.array_distinct(F.transform(atoms, lambda a: a["symbol"])))
    listed = lambda skip: F.array_join(F.transform(F.filter(others, lambda s: ~s.isin(*skip)), lambda s: text_of(s)), "")

    def text_of(s: Column) -> Column:
        n = F.aggregate(atoms, F.lit(0), lambda k, a: k + (a["symbol"] == s).cast("int"))
        return F.when(n > 1, F.concat(s, n.cast("string"))).otherwise(s)

    # after carbon and hydrogen, all by name; without carbon, hydrogen is one of them
    plain = F.array_join(F.transform(F.array_sort(F.array_distinct(F.concat(others, F.when(hydrogens > 0, F.array(F.lit("H"))).otherwise(F.array().cast("array<string>"))))), lambda s: F.when(s == "H", text("H", hydrogens)).otherwise(text_of(s))), "")
    formula = F.when(of("C") > 0, F.concat(text("C", of("C")), text("H", hydrogens), listed(("C", "H")))).otherwise(plain)
    return F.when(
        g.isNotNull(),
        F.struct(
            formula.alias("formula"), (mass - charge * ELECTRON).alias("mass"), charge.alias("charge"), parts(g).alias("parts"), of("C").alias("carbons"), F.exists(atoms, lambda a: a["symbol"] == "*").alias("generic"),
            F.exists(atoms, lambda a: a["isotope"] > 0).alias("isotopes"),
        ),
    )


def parts(g: Column) -> Column:
    """How many connected parts a graph has: atoms less the bonds that join two parts, found one bond after the other."""
    labels = F.transform(g["atoms"], lambda a, i: i)
    merged = lambda own, bond: F.transform(own, lambda x: F.when(x == F.get(own, F.greatest(bond["a"], bond["b"])), F.get(own, F.least(bond["a"], bond["b"]))).otherwise(x))
    return F.size(F.array_distinct(F.aggregate(g["bonds"], labels, merged)))


def cut_sets(n: int, bonds: list[tuple[int, int]], breaks: int = 2) -> set[int]:
    """The atom sets (as bits) of the parts that a graph falls into when up to ``breaks`` (1 or 2) of its bonds go.

    A spanning forest gives each bond that is not in it a bit of its own, and
    each bond in it the bits of those that go around it.  A bond without bits
    is a bridge; two bonds cut the graph together, neither being a bridge,
    exactly if their bits are the same.  The sides are subtrees, or what two
    subtrees differ in.
    """
    near: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    for k, (a, b) in enumerate(bonds):
        near[a].append((b, k))
        near[b].append((a, k))
    root, up, order, tree = [-1] * n, [-1] * n, [], set()
    for start in range(n):
        if root[start] < 0:
            root[start] = start
            stack = [start]
            while stack:
                u = stack.pop()
                order.append(u)
                for v, k in near[u]:
                    if root[v] < 0:
                        root[v], up[v] = start, k
                        tree.add(k)
                        stack.append(v)
    below = [1 << v for v in range(n)]  # the subtree of each atom
    around = [0] * n  # bits of the other bonds at each atom's subtree
    label = [0] * len(bonds)
    for k, (a, b) in enumerate(bonds):
        if k not in tree:
            label[k] = 1 << k
            around[a] ^= 1 << k
            around[b] ^= 1 << k
    whole: dict[int, int] = {}
    side = [0] * len(bonds)
    for v in reversed(order):
        if up[v] >= 0:
            k = up[v]
            label[k], side[k] = around[v], below[v]
            u = bonds[k][0] + bonds[k][1] - v
            below[u] |= below[v]
            around[u] ^= around[v]
        else:
            whole[v] = below[v]
    out = set(whole.values())
    part = [whole[root[a]] for a, _ in bonds]
    bridges = [k for k in range(len(bonds)) if not label[k]]
    for k in bridges:
        out |= {side[k], part[k] ^ side[k]}
    if breaks >= 2:
        for x, i in enumerate(bridges):
            for j in bridges[:x]:
                if part[i] == part[j]:
                    a, b = side[i], side[j]
                    out.add(a ^ b if a & b else part[i] ^ a ^ b)  # the middle: between nested sides, or beside two
        same: dict[int, list[int]] = {}
        for k in range(len(bonds)):
            if label[k]:
                same.setdefault(label[k], []).append(k)
        for group in same.values():
            for x, i in enumerate(group):
                for j in group[:x]:
                    inner = side[i] ^ side[j]  # a bond outside the forest has no side of its own
                    out |= {inner, part[i] ^ inner}
    return out


def masses_of(weights: list[float], bonds: list[tuple[int, int]], breaks: int = 2, most: int = 34) -> list[float]:
    """The distinct masses (to 1e-9) of the parts, rising; of the whole alone without bonds or with more than ``most``."""
    if not bonds or len(bonds) > most:
        return [round(sum(weights), 9)]
    masses = {round(sum(w for i, w in enumerate(weights) if s >> i & 1), 9) for s in cut_sets(len(weights), bonds, breaks)}
    return sorted(masses | {round(sum(weights), 9)})


def fragment_masses(g: Column, breaks: int = 2, most: int = 34) -> Column:
    """The masses of the fragments that up to ``breaks`` broken bonds give, for graphs of up to ``most`` bonds (else the whole's): an array, empty for a null graph and for elements without a listed mass."""
    if breaks not in (1, 2):
        raise ValueError("one or two breaks")

    @F.arrow_udf("array<double>")
    def fragments(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for weights, a, b in batches:
            rows = zip(weights.to_pylist(), a.to_pylist(), b.to_pylist(), strict=True)
            yield pa.array([masses_of(w, list(zip(x, y, strict=True)), breaks, most) if w and None not in w else [] for w, x, y in rows], pa.list_(pa.float64()))

    return fragments(F.transform(g["atoms"], atom_mass), F.transform(g["bonds"], lambda x: x["a"]), F.transform(g["bonds"], lambda x: x["b"]))
