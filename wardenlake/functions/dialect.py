"""Patterns and replacements in Python's writing, for the JVM's engine."""

from __future__ import annotations

import re

#: Python flags and their inline form; ignoring case means Unicode case, as in Python.
FLAGS = {re.IGNORECASE: "iu", re.MULTILINE: "m", re.DOTALL: "s", re.VERBOSE: "x"}
#: What Python has and the JVM hasn't, or means otherwise.
UNSUPPORTED = {r"\(\?P>": "recursion", r"\(\?\(": "conditional groups", r"\\Z": r"\Z (write \z)"}


def java_pattern(pattern: str, flags: int = 0) -> str:
    """The pattern for the JVM; a bad or unsupported one raises here, when it is registered, not in a task."""
    re.compile(pattern, flags)
    for rx, what in UNSUPPORTED.items():
        if re.search(rx, pattern):
            raise ValueError(f"not supported in a pattern: {what}")
    out = re.sub(r"\(\?P<(\w+)>", lambda m: f"(?<{m[1].replace('_', '')}>", pattern)
    out = re.sub(r"\(\?P=(\w+)\)", lambda m: rf"\\k<{m[1].replace('_', '')}>", out)
    inline = "".join(v for k, v in FLAGS.items() if flags & k)
    if not flags & re.ASCII and re.search(r"\\[dDwWsSbB]", pattern):
        inline += "U"
    return f"(?{inline}){out}" if inline else out


def java_replacement(replacement: str) -> str:
    r"""The replacement for the JVM: literal dollars and backslashes are escaped, \1 and \g<1> become $1 and ${name}."""
    out, i = [], 0
    while i < len(replacement):
        m = re.match(r"\\g<(\w+)>|\\(\d)", replacement[i:])
        if m:
            group = m[1] or m[2]
            out.append(f"${group}" if group.isdigit() else f"${{{group.replace('_', '')}}}")
            i += m.end()
        else:
            out.append("\\" + replacement[i] if replacement[i] in "\\$" else replacement[i])
            i += 1
    return "".join(out)
