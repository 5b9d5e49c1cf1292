"""Row-at-a-time Python statements of what the column expressions must compute.

Only for tests and for the benchmark's comparison; the library itself never runs Python per row.
"""

from __future__ import annotations

import re

_EXPONENT = re.compile(r"[+-]?[0-9]+(\.[0-9]+)?[eE][+-]?[0-9]+")
_NUMERAL = re.compile(r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?")


def _to_float(text: str) -> float | None:
    try:
        return float(text)
    except ValueError:
        return None


def amount(text: str | None) -> float | None:
    if text is None:
        return None
    if _EXPONENT.fullmatch(text.strip()):
        return float(text)
    kept = "".join(ch for ch in text if ch in "0123456789,.-")
    head, comma, tail = kept.rpartition(",")
    if not comma:
        return _to_float(kept)
    if "," in head:
        return None
    return _to_float(head.replace(".", "") + "." + tail.replace(".", ""))


def bare_id(text: str | None) -> str | None:
    digits = "".join(ch for ch in text or "" if ch in "0123456789")
    return digits if len(digits) == 11 else None


def id_is_valid(text: str | None) -> bool:
    bare = bare_id(text)
    if bare is None or len(set(bare)) == 1:
        return False
    numbers = [int(ch) for ch in bare]
    expected = []
    for upto in (9, 10):
        rest = sum(n * w for n, w in zip(numbers, range(upto + 1, 1, -1), strict=False)) % 11
        expected.append(0 if rest < 2 else 11 - rest)
    return numbers[9:] == expected


def email_is_valid(text: str | None) -> bool:
    inner = (text or "").strip()
    if inner.count("@") != 1 or any(ch.isspace() for ch in inner):
        return False
    local, domain = inner.split("@")
    return bool(local) and any(ch == "." for ch in domain[1:-1])


def score(text: str | None, words: dict[str, float]) -> float | None:
    inner = (text or "").strip()
    found = {k.upper(): v for k, v in words.items()}.get(inner.upper())
    if _NUMERAL.fullmatch(inner) or re.fullmatch(r"[+-]?(inf(inity)?|nan)", inner, re.I):
        found = float(inner)
    if found is None:
        return None
    return 1.0 if found != found else min(max(found, 0.0), 1.0)
