"""Labelled exemplars of template residue, filler, error pages and script notices, and of sentences that show residue on purpose.

They are data: ``exemplars.tsv`` lists them by kind, and the same normalisation
that cuts documents into windows cuts them into terms.
"""

from __future__ import annotations

import os
import re
from dataclasses import dataclass
from itertools import product

FILE = os.path.join(os.path.dirname(__file__), "exemplars.tsv")


@dataclass(frozen=True)
class Kind:
    """``coverage``: least share of a window's weight that the kind's vocabulary must cover; ``least_terms``: least number of its terms met; ``residue`` is false for what excuses a placeholder."""

    coverage: float
    least_terms: int = 1
    residue: bool = True


KINDS = {
    "slot": Kind(0.5), "blank": Kind(0.6), "error": Kind(0.75), "notice": Kind(0.75), "stub": Kind(0.75), "sample": Kind(0.75),
    "latin": Kind(0.7, 3), "repeat": Kind(0.6), "mention": Kind(0.0, residue=False),
}


def expanded(text: str) -> list[str]:
    """All texts that the alternatives in round brackets form; ``$(`` and ``%(`` open none."""
    parts = re.split(r"(?<![$%])\(([^()]*\|[^()]*)\)", text)
    return ["".join(x) for x in product(*[p.split("|") if k % 2 else [p] for k, p in enumerate(parts)])]


def exemplars(path: str = FILE) -> list[tuple[str, bool, str]]:
    """kind, whether it is an exemplar (else covered words of the kind), and text, once each in file order."""
    out: dict[tuple[str, bool, str], None] = {}
    with open(path, encoding="utf-8") as f:
        for line in f:
            if line.strip() and not line.startswith("#"):
                kind, text = line.rstrip("\n").split("\t", 1)
                out |= {(kind.rstrip("~"), not kind.endswith("~"), " ".join(t.split())): None for t in expanded(text)}
    if unknown := {k for k, *_ in out} - KINDS.keys():
        raise ValueError(f"kinds without a rule: {sorted(unknown)}")
    return list(out)
