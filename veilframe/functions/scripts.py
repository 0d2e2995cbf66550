"""Which writing systems a text uses, and where."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .spans import spans

#: Code points of each writing system, by the blocks of the Unicode standard.
RANGES = {
    "latin": ((0x41, 0x5A), (0x61, 0x7A), (0xC0, 0x24F), (0xFF21, 0xFF3A), (0xFF41, 0xFF5A)),
    "cyrillic": ((0x400, 0x4FF),),
    "arabic": ((0x600, 0x6FF),),
    "kana": ((0x3040, 0x309F), (0x30A0, 0x30FF), (0x31F0, 0x31FF), (0xFF66, 0xFF9D)),
    "han": ((0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x2A6DF)),
    "hangul": ((0x1100, 0x11FF), (0xA960, 0xA97F), (0xAC00, 0xD7AF)),
}
#: Fixed value: characters that end a sentence, or part it from what it quotes.
BOUNDARIES = "\n\r  。．.!?！？；;：:\"'`{}[]()（）「」『』"


def _ranges(scripts: tuple[str, ...]) -> str:
    return "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for s in scripts for a, b in RANGES[s])


def class_of(*scripts: str) -> str:
    """A pattern for one character of any of the scripts; unknown names are errors."""
    return f"[{_ranges(scripts)}]"


def _edges() -> str:
    return "".join(rf"\x{{{ord(c):X}}}" for c in BOUNDARIES)


def scripts_in(text: Column, first: int | None = None) -> Column:
    """Names of the scripts a text holds, in alphabetical order; ``first`` looks at so many characters only."""
    seen = text if first is None else F.substring(text, 1, first)
    return F.filter(F.array(*(F.when(seen.rlike(class_of(s)), s) for s in sorted(RANGES))), lambda s: s.isNotNull())


def regions(text: Column, *scripts: str) -> Column:
    """array<struct<start, end, value>> of the sentences that hold any of the scripts, in order and disjoint.

    A sentence speaks for itself and for none beside it.  Each sentence is read once, whatever its length: a match
    goes on where the last one ended, over sentences without the scripts, and runs of ASCII are told by one class.
    """
    e, b = _edges(), _ranges(scripts)
    plain = [c for c in range(0x80) if chr(c) not in BOUNDARIES]
    others = [c for c in plain if not any(lo <= c <= hi for s in scripts for lo, hi in RANGES[s])]
    run = lambda ascii_, but: rf"(?:[{''.join(rf'\x{{{c:X}}}' for c in ascii_)}]++|[^{but}\x00-\x7F])*+"
    without = run(others, e + b)
    return spans(text, rf"\G((?:{without}[{e}])*+)({without}[{b}]{run(plain, e)})", grouped=True)


def sentences_sql(*scripts: str) -> str:
    """The same for one that knows no look-around: a pattern whose matches are the sentences."""
    e, b = _edges(), _ranges(scripts)
    return rf"[^{e}]*[{b}][^{e}]*"


def everywhere(found: Column, text: Column) -> Column:
    """Whether regions are all of a text, but for the two characters that may stand around each."""
    return (F.size(found) > 0) & (F.aggregate(found, F.lit(0), lambda n, x: n + x["end"] - x["start"]) >= F.length(text) - 2 * F.size(found))
