"""Request parameters: a table of rules for each answer and one checker for all.

A parameter is free text, one of some words, or a whole number in a span.  Text
is used without surrounding blanks and counts as absent when nothing is left.
All problems of a request are reported together.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

LONGEST_TEXT = 255


class ParameterError(ValueError):
    """Says, for each refused parameter, what it may be."""

    def __init__(self, problems: Mapping[str, str]):
        self.problems = dict(problems)
        super().__init__("; ".join(f"{name}: {why}" for name, why in self.problems.items()))


@dataclass(frozen=True)
class Rule:
    default: str | int | None = None
    words: tuple[str, ...] = ()
    span: tuple[int, int] | None = None
    any_case: bool = False
    required: bool = False

    def expected(self) -> str:
        if self.span:
            return f"a whole number from {self.span[0]} to {self.span[1]}"
        if self.words:
            return "one of " + ", ".join(self.words)
        return f"text of at most {LONGEST_TEXT} characters without NUL" + (", which this answer needs" if self.required else "")

    def read(self, value):
        """(value to use, whether it is allowed)."""
        if isinstance(value, str):
            value = value.strip() or None
        if value is None:
            return self.default, not (self.required and self.default is None)
        if self.span:
            try:
                number = int(value)
            except (TypeError, ValueError):
                return None, False
            return number, self.span[0] <= number <= self.span[1]
        text = str(value).lower() if self.any_case else str(value)
        if self.words:
            return text, text in self.words
        return text, len(text) <= LONGEST_TEXT and "\x00" not in text


def checked(rules: Mapping[str, Rule], **given) -> list:
    """The values of ``rules``' parameters, in their order; raises ``ParameterError`` if any is refused."""
    values, problems = [], {}
    for name, rule in rules.items():
        value, allowed = rule.read(given.get(name))
        values.append(value)
        if not allowed:
            problems[name] = f"expected {rule.expected()}"
    if problems:
        raise ParameterError(problems)
    return values
