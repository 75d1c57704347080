"""The reliability classifier on one text; ``text.verdict`` runs it on Arrow batches.

Regular expressions here are Python's, over whole texts.  A pattern is tried only on
texts that hold, in whatever case, a word of each list of ``needles(pattern)``.
"""

from __future__ import annotations

import re

import pyarrow as pa

from . import text as T

FIELDS = "is_flagged boolean, confidence double, severity string, patterns array<string>, categories array<string>"


def needles(pattern: str) -> list[list[str]]:
    """Lists of strings of which a match of the pattern holds one each, whatever their case: a cheap test before the pattern itself."""
    import re._parser as sre

    def of(tokens) -> list[list[str]]:
        out, run = [], ""
        for op, arg in [*tokens, (None, None)]:
            if op is sre.LITERAL:
                run += chr(arg).lower()
                continue
            if len(run) > 1 or run == "<":
                out.append([run])
            run = ""
            if op is sre.SUBPATTERN:
                out += of(arg[3])
            elif op is sre.BRANCH:
                each = [max(of(b), key=lambda x: min(map(len, x)), default=None) for b in arg[1]]
                if all(each):
                    out.append(sorted({w for ws in each for w in ws}))
            elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[0] > 0:
                out += of(arg[2])
        return out

    # the fewest tests first: most texts fail them
    return sorted(of(sre.parse(pattern)), key=lambda ws: (len(ws), -min(map(len, ws))))


#: Patterns, compiled, with what they need; a worker fills its own.
TESTS: dict[tuple[str, int], tuple[re.Pattern, list[list[str]]]] = {}


def _found(text: str, low: str, pattern: str, flags: int = 0) -> bool:
    if (pattern, flags) not in TESTS:
        TESTS[pattern, flags] = re.compile(pattern, flags), needles(pattern)
    compiled, words = TESTS[pattern, flags]
    return all(any(w in low for w in ws) for ws in words) and compiled.search(text) is not None


def _hits(text: str, low: str, categories) -> list[tuple[str, str]]:
    return [(c, p) for c in categories for p in T.PATTERNS[c] if _found(text, low, p, re.I)]


def _folded(text: str) -> str:
    """In lower case, and so that a needle is found wherever a pattern that ignores case may match."""
    return text.lower() if text.isascii() else text.casefold().replace("i\u0307", "i").replace("\u0131", "i")


def is_session(text: str) -> bool:
    return re.search(T.SESSION, text[:200]) is not None or re.search(T.SESSION_KEY, text[:500]) is not None


def assistant_lines(text: str) -> str:
    """The assistant's lines of a session log, stripped, non-empty, joined by line ends."""
    out, inside = [], False
    for raw in text.split("\n"):
        line = raw.strip()
        if line.startswith(("assistant:", "A:")):
            inside, line = True, line.split(":", 1)[1].strip()
        elif inside:
            inside = re.match(T.NOT_ASSISTANT, line) is None
        if inside and line:
            out.append(line)
    return "\n".join(out)


def _grade(patterns: int, categories: int) -> tuple[float, str]:
    base = min(0.9, 0.25 * patterns + 0.25 * categories)
    for sure, top, more, severity in ((categories >= 3 or patterns >= 5, 0.95, 0.2, "critical"), (categories >= 2 or patterns >= 3, 0.85, 0.15, "high"), (patterns >= 2, 0.7, 0.1, "medium")):
        if sure:
            return round(min(top, base + more), 3), severity
    return round(min(0.55, base + 0.2), 3), "low"


def judge(text: str | None) -> tuple[float, str | None, list[tuple[str, str]]]:
    """(confidence that a text is unfit, severity, its (category, pattern) hits).

    Null and empty texts are fit.  Of a session log only the assistant's lines are
    judged, but for terminal artefacts.
    """
    if not text:
        return 0.0, None, []
    low = _folded(text)
    hits = _hits(text, low, [T.TERMINAL])
    if hits and any(_found(text, low, p) for p in (T.SYSINFO, T.FETCH, T.ECHO)):
        return 0.85, "high", hits
    if is_session(text):
        text = assistant_lines(text)
        low = _folded(text)
    if hits := _hits(text, low, [T.TAGS]):
        return 0.95, "critical", hits
    hits = _hits(text, low, [c for c in T.PATTERNS if c != T.TAGS])
    return (*_grade(len(hits), len({c for c, _ in hits})), hits) if hits else (0.0, None, [])


def judge_batch(texts: pa.Array) -> pa.Array:
    rows = [judge(t.as_py()) for t in texts]  # one text is Python's at a time
    kinds = {"is_flagged": pa.bool_(), "confidence": pa.float64(), "severity": pa.string(), "patterns": pa.list_(pa.string()), "categories": pa.list_(pa.string())}
    columns = ([r[0] >= 0.5 for r in rows], [r[0] for r in rows], [r[1] for r in rows], [[p for _, p in r[2]] for r in rows], [list(dict.fromkeys(c for c, _ in r[2])) for r in rows])
    return pa.StructArray.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds.values())], list(kinds))


def assistant_batch(texts: pa.Array) -> pa.Array:
    return pa.array([None if t is None else assistant_lines(t) for t in texts.to_pylist()], pa.string())
