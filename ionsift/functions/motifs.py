"""Motifs in molecular graphs: how often a small pattern occurs in a structure.

A documented part of the pattern grammar.  Atoms are element symbols (lower
case: aromatic) or brackets, in which ``;`` joins conditions that all hold,
``,`` alternatives, and a condition is an element, ``H`` and a number of
hydrogens, ``R`` (in a ring) or a charge, several in a row all holding.  Bonds
are - = # : ~, and one that is not written is single or aromatic; branches and
rings of one digit.  Other patterns raise.  Structures come in aromatic form,
as graphs.graph() reads them.

Occurrences are distinct sets of atoms, all of them, so the automorphisms of a
pattern count once.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .graphs import ORDERS

_TOKEN = re.compile(r"\[[^\]]*\]|Cl|Br|Si|Se|[A-Za-z*]|[-=#:~]|[()]|\d|.")
_CONDITION = re.compile(r"(?P<element>Cl|Br|Si|Se|[BCNOPSFI]|[bcnops])|H(?P<hydrogens>\d?)|(?P<ring>R)|(?P<charge>[+-]\d?)")
#: An atom's conditions: all clauses hold, of each one alternative, of that all (name, value).
Clauses = tuple[tuple[tuple[tuple[str, object], ...], ...], ...]


@dataclass
class Motif:
    """Atoms' conditions, and for each atom its bonds to earlier ones as (earlier atom, order; None: single or aromatic; 0: any)."""

    atoms: list[Clauses] = field(default_factory=list)
    bonds: list[list[tuple[int, float | None]]] = field(default_factory=list)


def _conditions(text: str) -> tuple[tuple[str, object], ...]:
    out, at = [], 0
    while at < len(text):
        m = _CONDITION.match(text, at)
        if not m:
            raise ValueError(f"a condition that motifs don't have: {text!r}")
        at = m.end()
        if m["element"]:
            out += [("symbol", m["element"].capitalize()), ("aromatic", m["element"].islower())]
        elif m["ring"]:
            out.append(("ring", True))
        elif m["charge"]:
            out.append(("charge", int(m["charge"] if len(m["charge"]) > 1 else m["charge"] + "1")))
        else:
            out.append(("hydrogens", int(m["hydrogens"] or 1)))
    if not out:
        raise ValueError("an atom without conditions")
    return tuple(out)


def motif(pattern: str) -> Motif:
    """The pattern read; ValueError beyond the grammar."""
    out, rings, branches, last, bond = Motif(), {}, [], -1, ""
    for token in _TOKEN.findall(pattern):
        if token in "-=#:~":
            bond = token
        elif token == "(":
            branches.append(last)
        elif token == ")" and branches:
            last = branches.pop()
        elif token.isdigit() and last >= 0:
            if token in rings:
                other, mark = rings.pop(token)
                out.bonds[last].append((other, _order(mark or bond)))
            else:
                rings[token] = last, bond
            bond = ""
        elif token[0] == "[" or token.isalpha():
            inner = token[1:-1] if token[0] == "[" else token
            out.atoms.append(tuple(tuple(_conditions(a) for a in clause.split(",")) for clause in inner.split(";")))
            out.bonds.append([(last, _order(bond))] if last >= 0 else [])
            last, bond = len(out.atoms) - 1, ""
        else:
            raise ValueError(f"{token!r} in {pattern!r}")
    if rings or branches or bond or not out.atoms:
        raise ValueError(f"{pattern!r} is left open")
    return out


def _order(mark: str) -> float | None:
    return None if not mark else 0.0 if mark == "~" else ORDERS[mark]


def in_rings(n: int, bonds: list[tuple[int, int]]) -> set[int]:
    """The atoms that lie on a ring: those of the bonds outside a spanning forest, and of the ways in it between their ends."""
    near: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    for k, (a, b) in enumerate(bonds):
        near[a].append((b, k))
        near[b].append((a, k))
    above, depth, tree = [-1] * n, [-1] * n, set()
    for start in range(n):
        if depth[start] < 0:
            depth[start], stack = 0, [start]
            while stack:
                u = stack.pop()
                for v, k in near[u]:
                    if depth[v] < 0:
                        depth[v], above[v] = depth[u] + 1, u
                        tree.add(k)
                        stack.append(v)
    found: set[int] = set()
    for k, (a, b) in enumerate(bonds):
        if k not in tree:
            found |= {a, b}
            while a != b:
                a, b = (above[a], b) if depth[a] >= depth[b] else (a, above[b])
                found |= {a, b}
    return found


class Structure:
    """What motifs ask of a graph: its atoms' properties and each one's neighbours with the bonds' orders."""

    def __init__(self, atoms: list[dict], bonds: list[dict]):
        self.near: list[dict[int, float]] = [{} for _ in atoms]
        for x in bonds:
            self.near[x["a"]][x["b"]] = self.near[x["b"]][x["a"]] = x["order"]
        rings = in_rings(len(atoms), [(x["a"], x["b"]) for x in bonds])
        own = lambda i: sum(atoms[j]["symbol"] == "H" for j in self.near[i])  # noqa: E731  hydrogens written as atoms
        self.atoms = [{**a, "hydrogens": a["hydrogens"] + own(i), "ring": i in rings} for i, a in enumerate(atoms)]
        self._fine: dict[Clauses, set[int]] = {}

    def fits(self, clauses: Clauses, i: int) -> bool:
        atom = self.atoms[i]
        return all(any(all(atom[name] == value for name, value in one) for one in clause) for clause in clauses)

    def occurrences(self, m: Motif) -> set[frozenset[int]]:
        """The sets of atoms that the motif lies on."""
        fine: list[set[int]] = []
        for clauses in m.atoms:  # motifs share conditions, and most fail at their first rare atom
            if clauses not in self._fine:
                self._fine[clauses] = {i for i in range(len(self.atoms)) if self.fits(clauses, i)}
            if not self._fine[clauses]:
                return set()
            fine.append(self._fine[clauses])
        found: set[frozenset[int]] = set()
        partial = [(i,) for i in fine[0]]
        while partial:  # depth first, so as many are held as the motif has atoms times an atom's neighbours
            chosen = partial.pop()
            if len(chosen) == len(m.atoms):
                found.add(frozenset(chosen))
                continue
            k = len(chosen)
            partial += [(*chosen, v) for v in self.near[chosen[m.bonds[k][0][0]]] if v in fine[k] and v not in chosen and all(self._bonded(chosen[u], v, order) for u, order in m.bonds[k])]
        return found

    def sides(self, hydrogens: bool = False) -> set[tuple[tuple[str, int], ...]]:
        """The compositions of both sides of every single bond that lies on no ring, as rising (element, count); empty for a structure of several parts.  Without hydrogens unless asked for, which stay where they were."""
        n, found = len(self.atoms), set()
        if len(self._reached(0)) < n:
            return found
        for a in range(n):
            for b, order in self.near[a].items():
                if order == 1.0:
                    side = self._reached(a, b)  # each bond is met from both of its ends
                    if b not in side:
                        found.add(self._composition(side, hydrogens))
        return found

    def _reached(self, start: int, without: int = -1) -> set[int]:
        """The atoms that bonds lead to from one, but for its own bond to ``without``."""
        seen, todo = {start}, [start]
        while todo:
            u = todo.pop()
            more = [v for v in self.near[u] if v not in seen and not (u == start and v == without)]
            seen.update(more)
            todo += more
        return seen

    def _composition(self, atoms: set[int], hydrogens: bool) -> tuple[tuple[str, int], ...]:
        n = Counter(self.atoms[i]["symbol"] for i in atoms)
        written = n.pop("H", 0)
        if hydrogens:  # an atom's number counts those that are written as atoms too
            n["H"] = sum(self.atoms[i]["hydrogens"] for i in atoms if self.atoms[i]["symbol"] != "H") + (written if not n else 0)
        return tuple(sorted((e, k) for e, k in n.items() if k))

    def _bonded(self, u: int, v: int, order: float | None) -> bool:
        has = self.near[u].get(v)
        return has is not None and (order == 0 or has == order or order is None and has in (1.0, 1.5))


def counts(g: Column, patterns: list[str]) -> Column:
    """How often each pattern occurs in a graph of graphs.graph(): an array in the patterns' order, null for a null graph."""
    motifs = {p: motif(p) for p in patterns}  # each once, however often it is asked for

    @F.arrow_udf("array<int>")
    def counted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            rows = []
            for x in batch:
                g = x.as_py()
                own = Structure(g["atoms"], g["bonds"]) if g else None
                found = {p: len(own.occurrences(m)) for p, m in motifs.items()} if own else {}
                rows.append([found[p] for p in patterns] if own else None)
            yield pa.array(rows, pa.list_(pa.int32()))

    return counted(g)


def connected(g: Column, formulas: list[str | None], hydrogens: bool = False) -> Column:
    """Whether each formula is what a structure's graph has on one side of a single bond outside rings, by atoms other than hydrogen unless those are asked for: an array in the formulas' order, null for a null graph, false for structures of several parts; no formula (None) asks for nothing and is true."""
    kinds = [f and tuple(sorted((e, int(n or 1)) for e, n in re.findall("([A-Z][a-z]?)([0-9]*)", f) if hydrogens or e != "H")) for f in formulas]

    @F.arrow_udf("array<boolean>")
    def has(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            rows = []
            for x in batch:
                g = x.as_py()
                own = Structure(g["atoms"], g["bonds"]).sides(hydrogens) if g else None
                rows.append(None if own is None else [k is None or k in own for k in kinds])
            yield pa.array(rows, pa.list_(pa.bool_()))

    return has(g)
