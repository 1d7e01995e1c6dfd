"""Rule packs: rules and scoring as data. A pack of one's own is a module or dict of the same shape."""

from __future__ import annotations

import importlib
import re
from dataclasses import dataclass, field
from typing import Any

from penstrata.packs.prose import PROSE

PROFILES = ("academic", "essay", "general", "news", "official", "personal", "review")
WEIGHT = {"high": 3.0, "medium": 2.0, "low": 1.0}
#: Rules whose short plain patterns also count as the lexicon of conn_density.
LEXICON_IDS = ("L-CONN", "O-STK")
_META = re.compile(r"[\[\](){}*+?.|\\]")


@dataclass(frozen=True)
class Rule:
    id: str
    name: str
    scope: str
    severity: str = "medium"
    patterns: tuple[str, ...] = ()
    metric: str | None = None
    compare: str | None = None
    threshold: float | None = None
    tiers: tuple[tuple[int | None, float], ...] = ()
    min_sentences: int = 8
    taste: str = ""
    why: str = ""
    advice: str = ""
    example: str = ""
    better: str = ""

    @property
    def weight(self) -> float:
        return WEIGHT[self.severity]


@dataclass(frozen=True)
class Pack:
    name: str
    rules: tuple[Rule, ...]
    scoring: dict[str, Any] | None = field(default=None, hash=False)

    def of_scope(self, scope: str) -> list[Rule]:
        return [r for r in self.rules if r.scope == scope]

    @property
    def lexicon(self) -> list[str]:
        """Words of conn_density, in order and once each."""
        words = [p for r in self.rules if r.id.startswith(LEXICON_IDS) for p in r.patterns]
        return list(dict.fromkeys(w for w in words if len(w) <= 8 and not _META.search(w)))


def pack(name: str, rules: list[dict], scoring: dict | None = None) -> Pack:
    """A pack from plain data; unknown fields, scopes and severities are refused."""
    made = []
    for r in rules:
        r = dict(r, patterns=tuple(r.get("patterns", ())), tiers=tuple(map(tuple, r.get("tiers", ()))))
        rule = Rule(**r)
        if rule.scope not in ("sentence", "shape", "doc", "lexicon") or rule.severity not in WEIGHT:
            raise ValueError(f"{name}: rule {rule.id} has scope {rule.scope} and severity {rule.severity}")
        if rule.scope == "doc" and (rule.metric is None or rule.compare not in ("above", "below") or rule.threshold is None):
            raise ValueError(f"{name}: document rule {rule.id} needs a metric, a comparison and a threshold")
        made.append(rule)
    return Pack(name, tuple(made), scoring)


def load(profile: str) -> Pack:
    """One of PROFILES."""
    if profile not in PROFILES:
        raise ValueError(f"unknown profile {profile}; there are {', '.join(PROFILES)}")
    m = importlib.import_module(f"{__name__}.{profile}")
    told = [r | dict(zip(("why", "advice", "example", "better"), PROSE[r["id"]], strict=True)) for r in m.RULES]
    return pack(profile, told, m.SCORING)
