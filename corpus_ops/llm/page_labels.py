"""Labels for the lines of sample pages: what the labeller of p4_pages learns from.

The rules read a whole page at once and are written for flat page text: sentences, steps and headings between the title
and the last sentence are the main body; everything else is not. They label a bounded sample only; pages are judged by
the model.
"""

from __future__ import annotations

import re

#: Beginnings and wholes of lines that sites put round their content.
FURNITURE = re.compile(
    r"(?ix)^\W*(?: (?:skip\ to\ content|back\ to\ top|all\ rights\ reserved|most\ read|latest\ posts|recommended\ for\ you|you\ may\ also\ like|related\ (?:articles|posts)|more\ from\b.*|advertisement|tell\ a\ friend|print\ this\ article|read\ more|load\ more|sign\ in|log\ ?in|register)\W*$"
    r"| \(c\)\s*\d{4}|©|copyright\s+(?:\(c\)\s*)?\d{4}|powered\ by|hosted\ by|made\ with\ |you\ are\ here|tags?\s*:|categor(?:y|ies)\s*:|filed\ under|share\ (?:this|on)|like\s+\d+\s+share|save\ for\ later|read\ also\s*:|see\ also\s*:|previous\s*:|next\s*:|sponsored\s*:|advert|\[?image\b|\[photo|photo\s*:|picture\s*:"
    r"| \d+\ comments?\W*$|no\ comments|log\ in\ to\ |leave\ a\ (?:comment|reply)|post\ a\ comment|subscribe\b|sign\ up\b|join\ [\d,.]+\ readers|get\ the\ best\ of|enter\ your\ e-?mail|newsletter\b|follow\ us"
    r"| this\ site\ (?:stores|uses)|we\ use\ cookies|cookies\ help|cookie\ settings|your\ privacy\ matters|by\ clicking\ accept|by\ (?:staying|continuing)|accept\ all|content\ under|no\ part\ of\ this\ site|terms\ of\ use|privacy\ policy|legal\ notice|impressum|imprint|datenschutz )"
)
STEP = re.compile(r"^\s*\d{1,3}[.)]\s+\S")
TRAILING = re.compile(r"(?i)(?:[-–—]\s*[\d,.]+\s+views|[\[(]\d+\s+min[\])])\W*$")
TRAIL = re.compile(r"(?i)^\s*home\s*(?:>|/|»|›|\||·)")
PARTS = re.compile(r"\s+(?:[|/>·»›–—-])\s+")
CALLS = ("Most read", "Recommended for you")


def _words(line: str) -> list[str]:
    return re.findall(r"[^\W_]+", line)


def _furniture(line: str) -> bool:
    return bool(FURNITURE.match(line) or TRAILING.search(line) or TRAIL.match(line))


def _menu(line: str) -> bool:
    """Links in a row, parted by signs or only by blanks."""
    parts = PARTS.split(line.strip())
    if len(parts) >= 3 and all(len(_words(x)) <= 3 for x in parts):
        return True
    w = line.split()
    return len(w) >= 3 and not re.search(r"[.!?:,;”\"]", line) and sum(x[:1].isupper() for x in w) >= 0.55 * len(w) and not line.isupper()


def _sentence(line: str) -> bool:
    w = _words(line)
    return len(w) >= 6 and bool(re.search(r"[.!?…:][”\"»’')\]]*\s*$", line)) and not _furniture(line) and not _menu(line)


def label_lines(lines: list[str]) -> list[bool]:
    """Whether each line of a page is main body; blank lines are not."""
    solid = [k for k, x in enumerate(lines) if x.strip()]
    out = [False] * len(lines)
    said = [k for k in solid if _sentence(lines[k])]
    if not said:
        return out
    for k in said:
        out[k] = True
    order = {k: i for i, k in enumerate(solid)}

    def plain(k: int) -> bool:
        return not _furniture(lines[k]) and not _menu(lines[k]) and not STEP.match(lines[k])

    # steps: numbered lines in a row
    for k in solid:
        if STEP.match(lines[k]) and said[0] < k:
            out[k] = True
    # the title: the nearest plain line of three words or more above the first sentence
    before = [k for k in solid if k < said[0]]
    for k in reversed(before):
        if plain(k):
            if len(_words(lines[k])) >= 3:
                out[k] = True
            break
    # headings: a short plain line right before a sentence
    for k in said[1:]:
        i = order[k] - 1
        if i > 0 and not out[solid[i]] and plain(solid[i]) and len(_words(lines[solid[i]])) <= 6 and solid[i] > said[0]:
            above = solid[i - 1]
            # a short line below menus or teasers heads these
            if out[above] or _furniture(lines[above]):
                out[solid[i]] = True
    return out
