"""Text expressions shared by all operators; JVM-side columns only.

Word characters are letters, numbers and the underscore in the Unicode sense.
Java's own ``\\w``/``\\b`` differ from that (ASCII by default, marks included
with ``(?U)``), so edges are written out as look-arounds on an explicit class.
"""

import operator
import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"\p{L}\p{N}_"
EDGE = rf"(?:(?<=[{WORD}])(?![{WORD}])|(?<![{WORD}])(?=[{WORD}]))"
# Unicode white space plus the four ASCII separators, as a class body.
SPACE = r"\t\n\x0b\f\r\x1c-\x1f \x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
NEWLINE = r"\r\n|[\n\r\x0b\f\x1c-\x1e\x85\x{2028}\x{2029}]"


def trim_ws(col: Column) -> Column:
    """Strip Unicode white space from both ends (``trim`` only knows spaces)."""
    return F.regexp_replace(col, rf"\A[{SPACE}]+|[{SPACE}]+\z", "")


def is_blank(col: Column) -> Column:
    return ~col.rlike(rf"[^{SPACE}]")


def tokens(lowered: Column) -> Column:
    return F.regexp_extract_all(lowered, F.lit(f"[{WORD}]+"), F.lit(0))


def explode_trigrams(toks: str) -> Column:
    """One struct ``(a, b, c)`` per token trigram of the array column ``toks``.

    The outer form (one null below three tokens) keeps the optimizer from adding
    a size filter, which would be pushed below the projection and tokenise every
    text twice.
    """
    n = F.size(toks) - 2
    shifted = [F.slice(toks, i, n).alias(name) for i, name in enumerate("abc", start=1)]
    return F.explode_outer(F.when(n >= 1, F.arrays_zip(*shifted)))


def trigram_text(gram: str) -> Column:
    """The trigram as one string; tokens hold no space, so nothing is lost."""
    return F.concat_ws(" ", f"{gram}.a", f"{gram}.b", f"{gram}.c")


# Python's classes in Java's terms, outside and inside of brackets.
_CLASSES = {
    "d": (r"\p{Nd}", r"\p{Nd}"), "D": (r"\P{Nd}", r"\P{Nd}"), "w": (f"[{WORD}]", WORD), "W": (f"[^{WORD}]", f"[^{WORD}]"),
    "s": (f"[{SPACE}]", SPACE), "S": (f"[^{SPACE}]", f"[^{SPACE}]"),
}


def java_regex(pattern: str) -> str:
    """A Python pattern in Java's syntax with Python's meaning of ``\\b \\d \\w \\s \\Z . $`` and named groups."""
    out, i, in_class = [], 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            e = pattern[i + 1:i + 2]
            if e in _CLASSES:
                out.append(_CLASSES[e][in_class])
            elif e == "b" and not in_class:
                out.append(EDGE)
            elif e == "Z":
                out.append(r"\z")
            else:
                out.append(c + e)
            i += 2
            continue
        if in_class:
            in_class = c != "]"
            # Java gives a meaning to these inside brackets, Python does not.
            out.append("\\" + c if c in "[&" else c)
        elif c == "[":
            in_class = True
            opening = re.match(r"\[\^?\]?", pattern[i:])[0]
            out.append(opening.replace("]", r"\]"))
            i += len(opening) - 1
        elif c == "$":
            out.append(r"(?=\n?\z)")
        elif c == ".":
            out.append(r"[^\n]")
        elif pattern.startswith("(?P<", i):
            out.append("(?<")
            i += 3
        elif named := re.match(r"\(\?P=(\w+)\)", pattern[i:]):
            out.append(rf"\k<{named[1]}>")
            i += len(named[0]) - 1
        else:
            out.append(c)
        i += 1
    return "".join(out)


def _alternatives(pattern: str) -> list[str]:
    """The parts between the bars that stand outside of every group and class."""
    parts, depth, in_class, start, i = [], 0, False, 0, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            i += 1
        elif in_class:
            in_class = c != "]" or pattern[i - 1] == "["
        elif c == "[":
            in_class = True
        elif c == "|" and not depth:
            parts.append(pattern[start:i])
            start = i + 1
        else:
            depth += (c == "(") - (c == ")")
        i += 1
    return [*parts, pattern[start:]]


_LITERAL_HEAD = re.compile(r"[a-z0-9](?![?*+{])")
_GROUP_HEAD = re.compile(r"\(\?:([^()\[\]\\]*)\)(?![?*{])")


def _heads(rest: str) -> set[str] | None:
    """The letters that a match of ``rest`` can open with, where its first part shows them."""
    if _LITERAL_HEAD.match(rest):
        return {rest[0]}
    group = _GROUP_HEAD.match(rest)
    options = group[1].split("|") if group else [""]
    return {o[0] for o in options} if all(_LITERAL_HEAD.match(o) for o in options) else None


def bank_regex(patterns: list[str]) -> str:
    """One alternation per bank; every pattern means what it means alone.

    Patterns of the form ``\\b`` and a visible first letter share one look-behind
    and, in front of it, one class of those letters, so most positions of a text
    are dismissed by a table lookup; literal first letters are written once for
    all patterns that share them.  Any other pattern stands as a group of its own.
    """
    guarded, letters, by_letter, general = [], set(), {}, []
    for p in patterns:
        heads = _heads(p[2:]) if p.startswith(r"\b") and len(_alternatives(p)) == 1 else None
        if heads is None:
            general.append(f"(?:{java_regex(p)})")
            continue
        letters |= heads
        rest = p[2:]
        if _LITERAL_HEAD.match(rest):
            by_letter.setdefault(rest[0], []).append(java_regex(rest[1:]))
        else:
            guarded.append(java_regex(rest))
    guarded += [f"{k}(?:{'|'.join(rests)})" for k, rests in by_letter.items()]
    if guarded:
        general.insert(0, f"(?=[{''.join(sorted(letters))}])(?<![{WORD}])(?:{'|'.join(guarded)})")
    return "|".join(general)


def matches_bank(lowered: Column, patterns: list[str]) -> Column:
    """Whether any pattern occurs.  Patterns that refer back to their own groups are tried by themselves."""
    alone = [p for p in patterns if re.search(r"\\[1-9]|\(\?P", p)]
    together = [p for p in patterns if p not in alone]
    tests = ([bank_regex(together)] if together else []) + [java_regex(p) for p in alone]
    return reduce(operator.or_, (lowered.rlike(t) for t in tests), F.when(lowered.isNotNull(), F.lit(False)))


def matches_whole(lowered: Column, phrases: list[str]) -> Column:
    """The whole trimmed utterance is one of ``phrases``, trailing ``.!,`` allowed."""
    body = "|".join(phrases)
    return lowered.rlike(rf"\A[{SPACE}]*(?:{body})[.!,]*[{SPACE}]*\z")


CODES = rf"#[A-Z0-9]{{5,}}|[A-Z0-9]{{6,}}|(?=\p{{Nd}})(?<![{WORD}])\p{{Nd}}{{7,}}(?![{WORD}])"
EMAIL = rf"(?:\G|(?<![^{SPACE}]))[^{SPACE}][^{SPACE}@]*+@[^{SPACE}]+\.[^{SPACE}]+"


def identifier_count(content: Column) -> Column:
    """Non-overlapping order numbers, codes and e-mail addresses, case kept.

    No identifier crosses white space, so only the words holding an ``@`` meet
    the e-mail branch.  That branch opens at the start of a word or where the
    previous match ended, the only places where it can match, which keeps long
    unspaced texts linear.
    """
    words = F.split(content, f"[{SPACE}]+")
    mail = F.array_join(F.filter(words, lambda w: F.contains(w, F.lit("@"))), " ")
    rest = F.array_join(F.filter(words, lambda w: ~F.contains(w, F.lit("@"))), " ")
    return F.when(
        F.contains(content, F.lit("@")),
        F.regexp_count(mail, F.lit(f"{CODES}|{EMAIL}")) + F.regexp_count(rest, F.lit(CODES)),
    ).otherwise(F.regexp_count(content, F.lit(CODES)))


def fixed(col: Column, digits: int) -> Column:
    """``digits`` decimals of the double's exact binary value, ties to even.

    ``format_string`` rounds the shortest decimal form half up instead, which
    turns 61/80 (just below 0.7625) into 0.763.  Here ``n`` counts whole units of
    the last digit and ``t`` is the double nearest to the midpoint above; only
    when the value *is* that double does the midpoint's own rounding matter, and
    splitting the value in two halves makes that last comparison exact.
    """
    unit = 10**digits
    x = F.abs(col.cast("double"))
    n = F.floor(x * unit)
    odd = (n * 2 + 1).cast("double")
    t = odd / float(2 * unit)
    high = x * 134217729.0 - (x * 134217729.0 - x)
    low_part, rest = (x - high) * float(2 * unit), odd - high * float(2 * unit)
    up = (x > t) | ((x == t) & ((low_part > rest) | ((low_part == rest) & (n % 2 == 1))))
    whole = n + up.cast("long")
    sign = F.when(col < 0, "-").otherwise("")
    return F.concat(sign, F.format_string(f"%d.%0{digits}d", F.floor(whole / unit), whole % unit))


def indent(col: Column, prefix: str = "\t") -> Column:
    """Prefix every non-blank line."""
    line_start = rf"(\A|{NEWLINE})(?=[^\n\r]*[^{SPACE}])"
    return F.regexp_replace(col, line_start, "$1" + prefix)
