"""What a run declares, checked and lowered to a plan that says which tables and steps it needs."""

from __future__ import annotations

import json
import os
from dataclasses import asdict, dataclass, field, replace
from string import Template

KINDS = ("event", "snapshot")
SCHEDULES = ("decoupled", "coupled", "model_recurrent")
#: Names of the models and how each reads and keeps state.
MODELS = {
    "tgn": ("event", "memory+mailbox", "decoupled"),
    "tgat": ("event", "none", "decoupled"),
    "jodie": ("event", "memory", "decoupled"),
    "apan": ("event", "mailbox", "decoupled"),
    "tgcn": ("snapshot", "recurrent", "decoupled"),
    "mpnn_lstm": ("snapshot", "recurrent", "decoupled"),
    "gconv_gru": ("snapshot", "recurrent", "coupled"),
    "dcrnn": ("snapshot", "recurrent", "coupled"),
    "evolve_gcn": ("snapshot", "none", "model_recurrent"),
}


@dataclass(frozen=True)
class Sampling:
    policy: str = "recent"
    fanouts: tuple[int, ...] = (20,)
    keep: float = 0.1


@dataclass(frozen=True)
class Freshness:
    """``exact``, ``max_age`` (a bound on versions) or ``max_skips`` (a bound on suppressed refreshes, not on age)."""

    mode: str = "exact"
    k: int = 0


@dataclass(frozen=True)
class Declared:
    model: str
    ratios: tuple[float, float, float] = (0.7, 0.15, 0.15)
    batch: int = 600
    windows: int = 10
    parts: int = 4
    hot_ratio: float = 0.0
    horizon: int = 1
    sampling: Sampling = field(default_factory=Sampling)
    freshness: Freshness = field(default_factory=Freshness)

    def checked(self) -> Declared:
        from ..operators.neighbors import POLICIES

        if self.model not in MODELS:
            raise ValueError(f"unknown model {self.model}")
        if abs(sum(self.ratios) - 1) > 1e-9 or min(self.ratios) < 0:
            raise ValueError("ratios must add up to 1")
        if min(self.batch, self.windows, self.parts, self.horizon) < 1 or not 0 <= self.hot_ratio <= 1:
            raise ValueError("batch, windows, parts and horizon must be positive, and hot_ratio a share")
        if self.sampling.policy not in POLICIES or min(self.sampling.fanouts, default=1) < 1 or not 0 <= self.sampling.keep <= 1:
            raise ValueError("unknown sampling policy, or fanouts or keep out of range")
        if self.freshness.mode not in ("exact", "max_age", "max_skips") or self.freshness.k < 0:
            raise ValueError("unknown freshness")
        if MODELS[self.model][0] == "snapshot" and len(self.sampling.fanouts) > 1:
            raise ValueError("snapshots are sampled in one layer only")
        return self


@dataclass(frozen=True)
class Step:
    """``what`` is awaited, ``when``, with which freshness, from whose table, by which operator."""

    what: str
    when: str
    freshness: str
    source: str
    operator: str


@dataclass(frozen=True)
class Plan:
    declared: Declared
    kind: str
    state: str
    schedule: str
    views: tuple[str, ...]
    steps: tuple[Step, ...]

    def explain(self) -> str:
        lines = [f"{self.declared.model}: {self.kind}, state {self.state}, {self.schedule}", "views: " + ", ".join(self.views)]
        return "\n".join([*lines, *(f"  {s.when}: {s.what} ({s.freshness}) of {s.source} by {s.operator}" for s in self.steps)])

    def as_dict(self) -> dict:
        return asdict(self)


def compiled(declared: Declared) -> Plan:
    """The plan of a declaration: only the views and steps that its model needs."""
    kind, state, schedule = MODELS[declared.checked().model]
    fresh = declared.freshness.mode if declared.freshness.mode == "exact" else f"{declared.freshness.mode}={declared.freshness.k}"
    views = ("edges", "splits", "targets", "adjacency") if kind == "event" else ("edges", "snapshots", "gcn_norm" if declared.model != "dcrnn" else "diffusion_norm", "targets")
    steps = [Step("targets", "window", "exact", "edges", "targets.target_rows"), Step("neighbors", "window", "exact", views[-1] if kind == "event" else "snapshots", f"neighbors.{declared.sampling.policy}")]
    if "memory" in state or state == "recurrent":
        steps.append(Step("state", "window", fresh, "state", "state.history_asof"))
    if "mailbox" in state:
        steps.append(Step("mails", "window", fresh, "mailbox", "state.mailbox"))
    if schedule == "model_recurrent":
        steps.append(Step("context", "snapshot", "exact", "snapshots", "graph.snapshot_context"))
    if state != "none":
        steps.append(Step("commit", "after window", "exact", "state", "state.commit"))
    if declared.parts > 1:
        steps.append(Step("routes", "prepare", "exact", "edges", "partition.exchange_route"))
    return Plan(declared, kind, state, schedule, views, tuple(steps))


def from_json(path_or_text: str) -> Declared:
    """A declaration from JSON; ``$NAME`` is taken from the environment; unknown names raise."""
    text = path_or_text
    if not text.lstrip().startswith("{"):
        with open(path_or_text, encoding="utf-8") as f:
            text = f.read()
    raw = json.loads(Template(text).safe_substitute(os.environ))
    known = set(Declared.__dataclass_fields__)
    if extra := set(raw) - known:
        raise ValueError(f"unknown settings: {sorted(extra)}")
    out = Declared(**{k: tuple(v) if isinstance(v, list) else v for k, v in raw.items() if k not in ("sampling", "freshness")})
    sampling = raw.get("sampling", {})
    sampling = {k: tuple(v) if isinstance(v, list) else v for k, v in sampling.items()}
    return replace(out, sampling=Sampling(**sampling), freshness=Freshness(**raw.get("freshness", {}))).checked()
