"""Turning Perl-style Unicode patterns into patterns for Spark's Java regex.

Java's ``\\w``, ``\\d``, ``\\s`` and ``\\b`` are ASCII by default, and its
``(?U)`` mode differs on combining marks, superscripts and a few control
characters.  Spelling the classes out gives the same matches for every
character: word = letter, number or underscore.
"""

from __future__ import annotations

import re

WORD_CHARS = r"\w\p{L}\p{N}"
SPACE_CHARS = r"\t\n\x0b\f\r\x1c\x1d\x1e\x1f\x85\p{Z}"
WORD = f"[{WORD_CHARS}]"
SPACE = f"[{SPACE_CHARS}]"
NO_SPACE = f"[^{SPACE_CHARS}]"

_OUTSIDE_CLASS = {
    "w": WORD,
    "W": f"[^{WORD_CHARS}]",
    "d": r"\p{Nd}",
    "D": r"\P{Nd}",
    "s": SPACE,
    "S": f"[^{SPACE_CHARS}]",
    "b": f"(?:(?<!{WORD})(?={WORD})|(?<={WORD})(?!{WORD}))",
    "B": f"(?:(?<!{WORD})(?!{WORD})|(?<={WORD})(?={WORD}))",
}
_INSIDE_CLASS = {
    "w": WORD_CHARS,
    "W": f"[^{WORD_CHARS}]",
    "d": r"\p{Nd}",
    "D": r"\P{Nd}",
    "s": SPACE_CHARS,
    "S": NO_SPACE,
}
_PIECES = re.compile(r"\\.|\[\^?\]?|\]|.", re.DOTALL)


# a pattern that begins with a boundary and one character that must be there,
# or with a boundary and a plain group of words
_WORDS = re.compile(r"\\b\((?:\?:)?((?:\\.|[\w ])+(?:\|(?:\\.|[\w ])+)*)\)(?![*?{])")
_LEAD = re.compile(r"\\b(\[\^?(?:\\.|[^\]\\])+\]|\\[dwS]|[^\W])(?![*?]|\{0)")
# a boundary next to what can only be a word character has one side left to look at
_WORD_LEAD = re.compile(r"\\b(?=(?:\\[dw]|\[(?:[A-Z]-[A-Z]|[a-z]-[a-z]|[0-9]-[0-9]|[A-Za-z0-9])+\]|[A-Za-z0-9])(?![*?]|\{0))")
_WORD_TAIL = re.compile(r"(?<!\\)(\\[dw](?:\+|\{[1-9][0-9]*(?:,[0-9]*)?\})?)\\b$")


def portable_regex(pattern: str) -> str:
    """``pattern`` with its escapes spelled out for Java's regex engine.

    A leading boundary costs several character tests at every position of a
    text, so the first character is looked at before it where that is possible.
    """
    outside_groups = re.sub(r"\\.|\[[^\]]*\]|\([^()]*\)", "", pattern)
    if "|" in outside_groups:
        return _spell_out(pattern)
    lead, words = _LEAD.match(pattern), _WORDS.match(pattern)
    first = _spell_out(lead.group(1)) if lead else ""
    if words and all(re.match(r"\w", w) for w in words.group(1).split("|")):
        first = "[" + "".join(sorted({w[0] for w in words.group(1).split("|")})) + "]"
    before, after = "", ""
    if _WORD_LEAD.match(pattern):
        pattern, before = pattern[2:], f"(?<!{WORD})"
    if _WORD_TAIL.search(pattern):
        pattern, after = pattern[:-2], f"(?!{WORD})"
    return (f"(?={first})" if first else "") + before + _spell_out(pattern) + after


def _spell_out(pattern: str) -> str:
    out, in_class = [], False
    for piece in _PIECES.findall(pattern):
        if piece[0] == "\\":
            table = _INSIDE_CLASS if in_class else _OUTSIDE_CLASS
            out.append(table.get(piece[1], piece))
        elif piece[0] == "[" and not in_class:
            in_class = True
            out.append(piece.replace("]", r"\]"))
        elif piece[0] == "[":
            out.append(piece.replace("[", r"\["))
            in_class = not piece.endswith("]")
        elif piece == "]":
            in_class = False
            out.append(piece)
        elif piece == "&" and in_class:
            out.append(r"\&")
        else:
            out.append(piece)
    return "".join(out)


def quote_literal(text: str) -> str:
    """``text`` as a pattern that matches exactly itself."""
    return re.sub(r"([^\w\s]|_)", r"\\\1", text)


def quote_replacement(text: str) -> str:
    """``text`` as a replacement without group references."""
    return re.sub(r"([\\$])", r"\\\1", text)


def whole_words(body: str) -> str:
    """``body`` bounded so that it does not start or end inside a word."""
    return f"(?<!{WORD})(?:{body})(?!{WORD})"


def whole_terms(terms: list[str]) -> str:
    """Literal terms, longest first, bounded as whole words.

    The look at the first character is only there to reject most positions
    of a text cheaply.
    """
    terms = sorted(set(terms), key=lambda t: (-len(t), t))
    first = "".join(quote_literal(c) for c in sorted({t[0] for t in terms}))
    return f"(?=[{first}])" + whole_words("|".join(quote_literal(t) for t in terms))
