"""Electrons on qubits: sums of ladder operators as sums of Pauli strings, by linear encodings of the occupations."""

from __future__ import annotations

import numpy as np

from loamwork.operators.kernels import hamiltonian

#: Products of two Pauli letters: (letter, phase).
_TIMES = {
    ("X", "Y"): ("Z", 1j), ("Y", "Z"): ("X", 1j), ("Z", "X"): ("Y", 1j),
    ("Y", "X"): ("Z", -1j), ("Z", "Y"): ("X", -1j), ("X", "Z"): ("Y", -1j),
}

Sum = dict[str, complex]


def product(a: Sum, b: Sum) -> Sum:
    out: Sum = {}
    for s, x in a.items():
        for t, y in b.items():
            phase, letters = x * y, []
            for p, q in zip(s, t, strict=True):
                if p == "I" or q == "I":
                    letters.append(q if p == "I" else p)
                elif p == q:
                    letters.append("I")
                else:
                    letter, f = _TIMES[p, q]
                    letters.append(letter)
                    phase *= f
            key = "".join(letters)
            out[key] = out.get(key, 0) + phase
    return out


def encoding(n: int, kind: str) -> np.ndarray:
    """The binary matrix from occupations to qubits: each its own (`jordan_wigner`), running parities (`parity`), or
    parities of the blocks of a binary tree (`bravyi_kitaev`)."""
    if kind == "jordan_wigner":
        return np.eye(n, dtype=int)
    if kind == "parity":
        return np.tril(np.ones((n, n), int))
    if kind != "bravyi_kitaev":
        raise ValueError("[encoding] kind is jordan_wigner, parity or bravyi_kitaev")
    out = np.zeros((n, n), int)
    for j in range(n):
        # qubit j holds the parity of the occupations from after its lowest set bit of j + 1 is taken away
        low = (j + 1) & -(j + 1)
        out[j, j + 1 - low : j + 1] = 1
    return out


def _inverse(m: np.ndarray) -> np.ndarray:
    n = len(m)
    a = np.concatenate([m % 2, np.eye(n, dtype=int)], axis=1)
    for i in range(n):
        pivot = i + int(np.argmax(a[i:, i]))
        a[[i, pivot]] = a[[pivot, i]]
        for r in range(n):
            if r != i and a[r, i]:
                a[r] ^= a[i]
    return a[:, n:]


def ladder(n: int, p: int, kind: str, create: bool) -> Sum:
    """The operator that fills (or empties) orbital p: it flips the qubits whose parities have p in them, with the sign of
    the occupations before p, and is zero where p is full (or empty) already."""
    code = encoding(n, kind)
    back = _inverse(code)
    string = lambda zs, xs=(): "".join("X" if i in xs else "Z" if i in zs else "I" for i in range(n))
    flips = set(np.flatnonzero(code[:, p]).tolist())
    before = set(np.flatnonzero(back[:p].sum(axis=0) % 2).tolist())  # their parity's sign
    occupied = set(np.flatnonzero(back[p] % 2).tolist())
    # flips * sign * (1 +- occupation's sign) / 2; for filling, the occupation must be 0 first
    first = product({string((), flips): 1.0}, {string(before): 1.0})
    check = {string(()): 0.5}
    check[string(occupied)] = check.get(string(occupied), 0) + (0.5 if create else -0.5)
    return product(first, check)


def qubit_terms(one: np.ndarray, two: np.ndarray | None = None, constant: float = 0.0, kind: str = "jordan_wigner") -> dict[str, float]:
    """Pauli terms of sum one[p,q] p+ q  +  1/2 sum two[p,q,r,s] p+ q+ r s  +  constant."""
    n = len(one)
    up, down = [ladder(n, p, kind, True) for p in range(n)], [ladder(n, p, kind, False) for p in range(n)]
    total: Sum = {"I" * n: complex(constant)}

    def add(terms: Sum, c: float) -> None:
        for s, x in terms.items():
            total[s] = total.get(s, 0) + c * x

    for p in range(n):
        for q in range(n):
            if abs(one[p, q]) > 1e-12:
                add(product(up[p], down[q]), one[p, q])
    if two is not None:
        for p, q, r, s in zip(*np.nonzero(np.abs(two) > 1e-12), strict=True):
            add(product(product(up[p], up[q]), product(down[r], down[s])), 0.5 * two[p, q, r, s])
    return {s: float(x.real) for s, x in sorted(total.items()) if abs(x) > 1e-12} or {"I" * n: 0.0}


def spectrum(terms: dict[str, float]) -> np.ndarray:
    return np.linalg.eigvalsh(hamiltonian(terms))
