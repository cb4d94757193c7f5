"""Reports as nested dicts: keys, printed numbers, gates."""

from __future__ import annotations


def look_up(report, key: str):
    """The value under a dotted key; keys that hold dots themselves are tried from the longest, numbers index lists."""
    if not key:
        return report
    if isinstance(report, list):
        head, _, rest = key.partition(".")
        return look_up(report[int(head)], rest)
    parts = key.split(".")
    for n in range(len(parts), 0, -1):
        if (name := ".".join(parts[:n])) in report:
            return look_up(report[name], ".".join(parts[n:]))
    raise KeyError(key)


def parse(printed: str) -> tuple[float, int]:
    """Value and decimals of a printed number with separators of thousands and a typographic minus."""
    plain = printed.replace(",", "").replace("−", "-").lstrip("+")
    return float(plain), len(plain.partition(".")[2])


def agrees(printed: str, value: float) -> bool:
    want, decimals = parse(printed)
    return round(float(value), decimals) == want


#: Limits of the gates.
GATES = {"max_alignment_failure": 0.15, "min_anchor_coverage": 0.60, "hard_fraction": (0.40, 0.85), "min_headline": 30_000}


def gates(report: dict, custom: bool = False) -> list[str]:
    """What fails; for a custom corpus the bounds that fit one corpus only are left out."""
    out = []
    if report["alignment_failure"] > GATES["max_alignment_failure"]:
        out.append("too many contexts fail alignment")
    if report["anchor_coverage"] < GATES["min_anchor_coverage"]:
        out.append("too few contexts have an anchor")
    if not custom:
        lo, hi = GATES["hard_fraction"]
        if not lo <= report["hard_fraction"] <= hi:
            out.append("the share of hard contexts is out of its band")
        if report["headline"] < GATES["min_headline"]:
            out.append("too few headline pools")
    if report.get("leakage", 1) != 0:
        out.append("training papers are held out, or leakage wasn't evaluated")
    return out


def on_edge(best: float, grid: list[float]) -> bool:
    """Whether the best setting is at an end of its grid, so a better one may lie outside."""
    return best in (min(grid), max(grid))
