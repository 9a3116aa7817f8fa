"""Label patterns: shell-like globs as regular expressions."""

from __future__ import annotations

import re


def glob_to_regex(pattern: str) -> str:
    """An anchored regular expression for a glob: *, ?, [set] and [^set]."""
    out, at = [], 0
    while at < len(pattern):
        c = pattern[at]
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[" and (end := pattern.find("]", at + 2 + pattern.startswith("^", at + 1))) > 0:
            inner = pattern[at + 1 : end]
            mark = "^" if inner.startswith("^") else ""
            out.append("[" + mark + inner[len(mark) :].replace("\\", "\\\\").replace("[", "\\[").replace("&", "\\&") + "]")
            at = end
        else:
            out.append(re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", c))
        at += 1
    return "(?s)^" + "".join(out) + "$"


def label_glob(pattern: str) -> str:
    """The glob that a query's pattern stands for: . is any character, * and % any text, found anywhere in a label."""
    return "*" + pattern.replace(".", "?").replace("%", "*") + "*"
