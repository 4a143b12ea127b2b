"""Plain Python versions of the operators, for small tables."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def components(nodes, links) -> dict:
    up = {n: n for n in nodes}

    def root(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def shingles(text, size) -> set:
    words = SPACED.findall(lower(text or ""))
    if not words:
        return set()
    if len(words) < size:
        return {tuple(words)}
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


def near_duplicates(docs: dict, size: int, percent: int) -> dict:
    sets = {d: shingles(t, size) for d, t in docs.items()}
    ids = sorted(docs)
    links = [
        (a, b)
        for k, a in enumerate(ids)
        for b in ids[k + 1 :]
        if sets[a] and sets[b]
        and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])
    ]
    part = components(ids, links)
    return {d: (len(sets[d]), part[d], part[d] == d) for d in ids}


def remove_repeats(docs: dict, size: int) -> dict:
    words = {d: SPACED.findall(t or "") for d, t in docs.items()}
    least: dict = {}
    for d in sorted(docs):
        for i in range(len(words[d]) - size + 1):
            least.setdefault(tuple(words[d][i : i + size]), d)
    out = {}
    for d, own in words.items():
        gone = set()
        for i in range(len(own) - size + 1):
            if least[tuple(own[i : i + size])] < d:
                gone.update(range(i, i + size))
        out[d] = (len(own), len(gone), " ".join(w for i, w in enumerate(own) if i not in gone))
    return out


def drop_lines(docs: dict, min_docs: int) -> dict:
    def key(line):
        return lower(line.strip("\x20\t\n\x0b\x0c\r"))

    seen = defaultdict(set)
    for d, t in docs.items():
        for line in (t or "").split("\n"):
            seen[key(line)].add(d)
    out = {}
    for d, t in docs.items():
        lines = (t or "").split("\n")
        kept = [x for x in lines if not key(x) or len(seen[key(x)]) < min_docs]
        out[d] = ("\n".join(kept), len(lines), len(lines) - len(kept))
    return out


def passages(docs: dict, items: dict, size: int) -> dict:
    windows = defaultdict(set)
    for item, text in items.items():
        words = ALNUM.findall(lower(text or ""))
        n = min(size, len(words))
        for i in range(len(words) - n + 1 if words else 0):
            windows[tuple(words[i : i + n])].add(str(item))
    sizes = {len(w) for w in windows}
    out = {}
    for d, text in docs.items():
        words = ALNUM.findall(lower(text or ""))
        hit, found = set(), set()
        for n in sizes:
            for i in range(len(words) - n + 1):
                own = windows.get(tuple(words[i : i + n]))
                if own:
                    hit.update(range(i, i + n))
                    found |= own
        out[d] = (len(words), len(hit), sorted(found))
    return out


SECRET = re.compile(
    r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]"""
    r"""|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["']?[ ]*[:=][ ]*["']?([A-Za-z0-9+/_.=-]+)"""
)


def base_secrets(text) -> list[tuple[str, int, int]]:
    text = text or ""
    found = [(m.start(), 0, m.end(), "assign") for m in SECRET.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return [(kind, start, stop) for start, _, stop, kind in sorted(found)]


PHRASES = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]


def phrase_places(text):
    words = ALNUM.findall(lower(text or ""))
    places, labels = [], set()
    for phrase, label in PHRASES:
        own = phrase.split()
        for i in range(len(words) - len(own) + 1):
            if words[i : i + len(own)] == own:
                places.append(i)
                labels.add(label)
    return len(words), places, sorted(labels)
