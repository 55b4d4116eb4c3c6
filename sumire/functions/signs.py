"""The sets of signs that the character rules look for, in one place: written once for the engine and once for built-in functions."""

from __future__ import annotations

# fixed values: ranges of code points
SETS = {
    "kanji": [(0x3005, 0x3005), (0x3007, 0x3007), (0x303B, 0x303B), (0x3400, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x2FFFF)],
    "exclamation": [(0x21, 0x21), (0x3F, 0x3F), (0xFF01, 0xFF01), (0xFF1F, 0xFF1F)],
    "zero-width": [(0x200B, 0x200B)],
    "control": [(0x0, 0x8), (0xB, 0xC), (0xE, 0x1F), (0x7F, 0x9F)],
    "combining": [(0x3099, 0x309C)],
    "half-width": [(0xFF61, 0xFF9F)],
}


def python_set(name: str) -> str:
    """A set's signs for a character class of Python's re, without brackets."""
    return "".join(f"\\U{a:08x}" if a == b else f"\\U{a:08x}-\\U{b:08x}" for a, b in SETS[name])


def java_set(name: str) -> str:
    """A set's signs for a character class of Java's regular expressions, without brackets."""
    return "".join(f"\\x{{{a:X}}}" if a == b else f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in SETS[name])
