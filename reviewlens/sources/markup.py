"""Finds a few elements in a piece of HTML; the per-row helper of the page readers."""

from __future__ import annotations

import re
from html import unescape

# A closing or opening tag with quoted attributes, a comment, or a stretch of text. Possessive, so
# that a tag that never ends costs no backtracking.
PIECES = re.compile(
    r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<!--.*?-->|([^<]++|<)""",
    re.DOTALL,
)
_ATTRIBUTES = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")

# Elements that have no closing tag.
VOID_TAGS = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)


class Element:
    """An open element; its attributes are read when first asked for."""

    __slots__ = ("tag", "tail", "read")

    def __init__(self, tag: str, tail: str):
        self.tag, self.tail, self.read = tag, tail, None

    def attribute(self, name: str) -> str | None:
        if self.read is None:
            self.read = {
                key.lower(): unescape(double or single or bare)
                for key, double, single, bare in reversed(_ATTRIBUTES.findall(self.tail))
            }
        return self.read.get(name)


def matches(step: tuple, element: Element) -> bool:
    """Whether an element fits one step of a selector."""
    wanted_tag, conditions = step
    if wanted_tag is not None and element.tag != wanted_tag:
        return False
    if conditions and not element.tail:
        return False
    for name, wanted in conditions.items():
        value = element.attribute(name.rstrip("*"))
        if value is None:
            return False
        if name == "class":
            if not set(wanted.split()) <= set(value.split()):
                return False
        elif wanted not in value if name.endswith("*") else value != wanted:
            return False
    return True


def _selected(steps: list, path: list[Element]) -> bool:
    """Whether the last element of a path fits the last step and its ancestors the others."""
    if not steps:
        return len(path) == 1
    if not matches(steps[-1], path[-1]):
        return False
    remaining = list(steps[:-1])
    for element in reversed(path[:-1]):
        if remaining and matches(remaining[-1], element):
            remaining.pop()
    return not remaining


class Fields:
    """What to look up in a piece of HTML: per name what to take, and a selector.

    ``text`` strips each stretch of text and joins them; ``words`` joins all words by one space;
    any other name is an attribute. An empty selector is the first element.
    """

    def __init__(self, fields: dict[str, tuple[str, list]]):
        self.fields = fields
        # The names that an element of a tag can settle.
        tags = {steps[-1][0] for _, steps in fields.values() if steps} - {None}
        self.any_tag = self._names(None)
        self.by_tag = {tag: self._names(tag) for tag in tags}

    def _names(self, tag: str | None) -> list[str]:
        return [n for n, (_, s) in self.fields.items() if not s or s[-1][0] in (None, tag)]

    def first_values(self, html: str | None, one_root: bool = True) -> dict:
        """Per name the value of the first matching element; None when there is none.

        With ``one_root`` nothing after the end of the first element counts.
        """
        values = dict.fromkeys(self.fields)
        missing = set(self.fields)
        collecting: dict[str, tuple[int, list[str]]] = {}
        path: list[Element] = []

        def close() -> None:
            path.pop()
            for name in [n for n, (depth, _) in collecting.items() if depth > len(path)]:
                values[name] = self._joined(name, collecting.pop(name)[1])

        for closing, tag, tail, text in PIECES.findall(html or ""):
            if text:
                for _, parts in collecting.values():
                    parts.append(text)
                continue
            tag = tag.lower()
            if closing:
                if any(element.tag == tag for element in path):
                    while path[-1].tag != tag:
                        close()
                    close()
                if one_root and not path:
                    break
            elif tag:
                path.append(Element(tag, tail))
                for name in self.by_tag.get(tag, self.any_tag):
                    what, steps = self.fields[name]
                    if name in missing and _selected(steps, path):
                        missing.remove(name)
                        if what in ("text", "words"):
                            collecting[name] = (len(path), [])
                        else:
                            values[name] = path[-1].attribute(what)
                if tag in VOID_TAGS or tail.endswith("/"):
                    close()
                if not missing and not collecting:
                    break
        while path:
            close()
        return values

    def _joined(self, name: str, parts: list[str]) -> str:
        plain = [unescape(part) for part in parts]
        if self.fields[name][0] == "words":
            return " ".join(" ".join(plain).split())
        return "".join(part.strip() for part in plain)
