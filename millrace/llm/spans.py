"""Spans found in texts, and how the queries write them."""

from __future__ import annotations

import hashlib

Span = tuple[str, int, int]  # kind, start, end: code points, end exclusive


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def digest(spans: list[Span]) -> str:
    return hashlib.sha256(joined(spans).encode()).hexdigest()


def apart(found: list[Span], taken: list[Span]) -> list[Span]:
    """Those of ``found`` that overlap no span in ``taken`` and none of the earlier ones; both may come in any order."""
    out: list[Span] = []
    edges = sorted((s, e) for _, s, e in taken)
    starts = [s for s, _ in edges]
    from bisect import bisect_left

    reach: list[int] = []
    for _, e in edges:
        reach.append(max(e, reach[-1]) if reach else e)
    end = -1
    for kind, s, e in sorted(found, key=lambda x: (x[1], -x[2], x[0])):
        at = bisect_left(starts, e)
        if s >= end and (not at or reach[at - 1] <= s):
            out.append((kind, s, e))
            end = e
    return out
