"""Operators as plugins: manifests, an order that keeps their wishes, hooks that survive a failing plugin."""

from __future__ import annotations

import heapq
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

#: Kinds of plugins, and the hooks of a run in their order. Fixed values.
KINDS = ("parser", "framework_adapter", "static_analyzer", "demand_analyzer", "evidence_producer", "exporter", "dynamic_analyzer", "tracer")
HOOKS = ("on_graph_built", "on_traces_collected", "on_evidence", "on_export")


@dataclass(frozen=True)
class Manifest:
    id: str
    kind: str
    hooks: tuple[str, ...] = ()
    order: int = 100
    after: tuple[str, ...] = ()
    before: tuple[str, ...] = ()
    requires: tuple[str, ...] = ()
    produces: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        if self.kind not in KINDS:
            raise ValueError(f"unknown kind {self.kind}")


@dataclass(frozen=True)
class Plugin:
    """A manifest and what runs at each of its hooks: a function of keyword arguments, which are DataFrames in most cases."""

    manifest: Manifest
    run: Callable[..., Any]


@dataclass
class Outcome:
    plugin: str
    hook: str
    value: Any = None
    error: str | None = None


def ordered(plugins: list[Plugin]) -> list[Plugin]:
    """Smallest ``order`` and id first, but none before what it wants to follow; by order and id alone where wishes form a circle."""
    known = {p.manifest.id: p for p in plugins}
    follows: dict[str, set[str]] = {i: set() for i in known}
    for i, p in known.items():
        follows[i] |= {a for a in (*p.manifest.after, *p.manifest.requires) if a in known and a != i}
        for b in p.manifest.before:
            if b in known and b != i:
                follows[b].add(i)
    rank = lambda i: (known[i].manifest.order, i)
    ready, out, left = [rank(i) for i in known if not follows[i]], [], {i: set(f) for i, f in follows.items()}
    heapq.heapify(ready)
    while ready:
        done = heapq.heappop(ready)[1]
        out.append(done)
        for i, f in left.items():
            if done in f:
                f.discard(done)
                if not f:
                    heapq.heappush(ready, rank(i))
    return [known[i] for i in (out if len(out) == len(known) else sorted(known, key=rank))]


@dataclass
class Registry:
    plugins: dict[str, Plugin] = field(default_factory=dict)

    def register(self, manifest: Manifest, run: Callable[..., Any]) -> None:
        if manifest.id in self.plugins:
            raise ValueError(f"{manifest.id} is registered already")
        self.plugins[manifest.id] = Plugin(manifest, run)

    def of_kind(self, kind: str) -> list[Plugin]:
        return ordered([p for p in self.plugins.values() if p.manifest.kind == kind])

    def run_one(self, plugin: str, **arguments) -> Any:
        return self.plugins[plugin].run(**arguments)

    def fire(self, hook: str, kind: str | None = None, **arguments) -> list[Outcome]:
        """Runs all plugins of a hook in order; one that fails is told of and does not stop the others."""
        out = []
        for p in ordered([p for p in self.plugins.values() if hook in p.manifest.hooks and kind in (None, p.manifest.kind)]):
            try:
                out.append(Outcome(p.manifest.id, hook, p.run(hook=hook, **arguments)))
            except Exception as e:  # noqa: BLE001  a plugin's own failure
                out.append(Outcome(p.manifest.id, hook, error=f"{type(e).__name__}: {e}"[:500]))
        return out

    def sequence(self, skip: tuple[str, ...] = (), **arguments) -> list[Outcome]:
        """All hooks of a run."""
        return [o for hook in HOOKS if hook not in skip for o in self.fire(hook, **arguments)]


def summary(outcomes: list[Outcome]) -> dict[str, Any]:
    """What ran, what failed, and the error that a failed run reports, cut at 500 characters."""
    failed = [o for o in outcomes if o.error]
    return {"status": "failed" if failed else "ok", "ran": len(outcomes), "failed": [o.plugin for o in failed], "error": failed[0].error if failed else None}
