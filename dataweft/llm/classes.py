"""Splitting patterns whose letters, digits and white space are those of a tokenizer's own library.

Unicode tables differ by version. The driver asks the library for each property's characters once; where they differ from those here, texts
that hold such a character are split by a pattern with the library's sets, all others by the plain one.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

import regex

#: Every character that UTF-8 can hold.
ALL = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
PROPERTIES = (r"\p{L}", r"\p{N}", r"\s")


def ranges(chars: Iterable[str]) -> str:
    """The inside of a set of characters."""
    out: list[list[int]] = []
    for c in sorted(map(ord, chars)):
        if out and out[-1][1] == c - 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "".join(rf"\U{a:08x}-\U{b:08x}" for a, b in out)


def differences(found: Callable[[str], str]) -> dict[str, tuple[str, str]]:
    """For each property that differs: what the library adds and what it leaves out. ``found`` returns the characters that match a property."""
    out = {}
    for p in PROPERTIES:
        own, theirs = set(regex.findall(p, ALL)), set(found(p))
        if own != theirs:
            out[p] = (ranges(theirs - own), ranges(own - theirs))
    return out


def tiktoken_characters(p: str) -> str:
    import tiktoken
    each = tiktoken.Encoding("characters", pat_str=p, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
    return each.decode_bytes(each.encode_ordinary(ALL)).decode()


def tokenizers_characters(p: str) -> str:
    from tokenizers import Regex
    from tokenizers.pre_tokenizers import Split
    return "".join(x for x, _ in Split(Regex(p), "removed", invert=True).pre_tokenize_str(ALL))


class Splitter:
    """Finds all matches of a pattern as the library whose ``differences`` are given would."""

    def __init__(self, pattern: str, different: dict[str, tuple[str, str]]):
        self.plain = regex.compile(pattern).findall
        self.special = self.lead = self.odd = None
        if different:
            changed = pattern
            for p, (more, less) in different.items():
                own = f"[{p}{more}]"
                changed = changed.replace(p, f"[{own}--[{less}]]" if less else own)
            self.special = regex.compile("(?V1)(?-f)" + changed).findall
            odd = "".join(more + less for more, less in different.values())
            self.odd = regex.compile(f"[{odd}]").search
            first = min(int(x, 16) for x in re.findall(r"\\U([0-9a-f]{8})", odd))
            # Most texts hold no byte that such a character could begin with.
            lead = chr(first).encode()[0]
            self.lead = re.compile(b"[" + re.escape(bytes([lead])) + b"-\xf4]").search

    def __call__(self, text: str) -> list[str]:
        if self.special is None or text.isascii() or not self.lead(text.encode()) or not self.odd(text):
            return self.plain(text)
        return self.special(text)
