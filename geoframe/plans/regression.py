"""Comparison of two runs of the bench."""

from __future__ import annotations

#: Shares of slowing down that warn and that fail (fixed values).
WARN, FAIL = 0.10, 0.25


def compare(before: dict[str, float], now: dict[str, float]) -> dict[str, tuple[str, float]]:
    """(ok, warning, failure or improved, change as a share) of each query in both."""
    out = {}
    for name in sorted(before.keys() & now.keys()):
        change = (now[name] - before[name]) / before[name] if before[name] else 0.0
        out[name] = ("failure" if change > FAIL else "warning" if change > WARN else "improved" if change < -WARN else "ok", change)
    return out


def report(found: dict[str, tuple[str, float]]) -> str:
    return "\n".join(f"{name:40} {change:+7.1%}  {kind}" for name, (kind, change) in found.items())
