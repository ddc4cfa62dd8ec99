"""Cutting texts where a byte-level tokenizer always cuts, so that equal parts are encoded once.

The public pattern ends a piece before every space or newline that a non-space follows, and after
such a newline. Cutting there changes no piece: no piece crosses the place, no look-ahead does
either. A text is thus a sequence of units; a unit's ids depend on the unit alone.
"""

from __future__ import annotations

import re

#: White space as the pattern sees it.
SPACES = "\t\n\x0b\x0c\r \x85\xa0  -     　"
#: Anything but words separated by single spaces and newlines takes the slow cut.
IRREGULAR = re.compile(rf"[^\S \n]|[{SPACES}]{{2}}|\A[ \n]|[ \n]\Z")
CUT = re.compile(rf"(?=[ \n][^{SPACES}])|(?<=\n)(?=[^{SPACES}])")


#: White space other than space and newline.
OTHER_ASCII = [c for c in map(chr, range(128)) if c.isspace() and c not in " \n"]
OTHER_WIDE = [c for c in map(chr, range(128, 0x3001)) if c.isspace()]
DOUBLE = [a + b for a in " \n" for b in " \n"]


def regular(text: str) -> bool:
    """The text is words separated by single spaces and newlines; what IRREGULAR finds, by substring searches."""
    return not (text[:1] in (" ", "\n") or text[-1:] in (" ", "\n") or any(d in text for d in DOUBLE) or any(c in text for c in OTHER_ASCII)
                or (not text.isascii() and any(c in text for c in OTHER_WIDE)))


def units(text: str) -> list[str]:
    """The units of a text in order; joined they give the text."""
    if not text:
        return []
    if IRREGULAR.search(text) or "\0" in text:
        return [u for u in CUT.split(text) if u]
    return text.replace("\n", "\0\n\0").replace(" ", "\0 ").split("\0")
