"""Whether a formula of clauses has a model: a small helper for feature models, for conditions given as literals.

Literals are numbers as in DIMACS: k says that variable k is true, -k that it is false.
"""

from __future__ import annotations

from collections.abc import Iterable


def dimacs(text: str) -> list[list[int]]:
    """The clauses of a DIMACS formula."""
    numbers = [int(x) for line in text.splitlines() if line.strip() and line.lstrip()[0] not in "cp%" for x in line.split()]
    out, own = [], []
    for x in numbers:
        if x:
            own.append(x)
        else:
            out.append(own)
            own = []
    return out + [own] * bool(own)


class Formula:
    """Clauses, and which of them each literal is in."""

    def __init__(self, clauses: Iterable[Iterable[int]]):
        self.clauses = [sorted(set(c)) for c in clauses]
        self.clauses = [c for c in self.clauses if not any(-x in c for x in c)]
        self.holders: dict[int, list[int]] = {}
        for i, c in enumerate(self.clauses):
            for x in c:
                self.holders.setdefault(x, []).append(i)

    def follows(self, held: set[int], new: list[int]) -> list[int] | None:
        """Adds to ``held`` the literals ``new`` and what single open literals of clauses force, and returns what was added; None, with ``held`` as before, on a contradiction."""
        added, todo = [], list(new)
        while todo:
            x = todo.pop()
            if x in held:
                continue
            if -x in held:
                held.difference_update(added)
                return None
            held.add(x)
            added.append(x)
            for i in self.holders.get(-x, ()):
                left = [y for y in self.clauses[i] if -y not in held]
                if not left:
                    held.difference_update(added)
                    return None
                if len(left) == 1:
                    todo.append(left[0])
        return added

    def satisfiable(self, literals: Iterable[int] = ()) -> bool:
        """Whether some model of all clauses has these literals."""
        held: set[int] = set()
        if any(not c for c in self.clauses) or self.follows(held, [*literals, *(c[0] for c in self.clauses if len(c) == 1)]) is None:
            return False
        # Decisions so far: what each added, and the other choice if it is still open.
        trail: list[tuple[list[int], int | None]] = []
        at = 0
        while True:
            while at < len(self.clauses) and any(x in held for x in self.clauses[at]):
                at += 1
            if at == len(self.clauses):
                return True
            choice: int | None = next(x for x in self.clauses[at] if -x not in held)
            added, other = self.follows(held, [choice]), -choice
            while added is None:
                if other is not None:
                    added, other = self.follows(held, [other]), None
                    continue
                if not trail:
                    return False
                gone, other = trail.pop()
                held.difference_update(gone)
                at = 0
            trail.append((added, other))
