"""Lines of scanned pages: page furniture and words broken over lines, for :mod:`siktverk.llm.scans`.

Two boosted line-pair classifiers are trained on pages made here: prose of the corpus is wrapped, broken and furnished
with headers and page numbers, so that every line and every break has a known label.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np

from siktverk.llm.boost import Boosted, matrix

# Signs that break a word at the end of a line; words after which or before which a hyphen stays.
BREAKS = "-¬\xad‐‑"
SUSPENDED = frozenset("och eller samt og eller and or und oder bis till til to".split())
_NUMBER = r"\d{1,4}"
_PAGE = rf"(?:\[\s*{_NUMBER}\s*\]|[-–—]\s*{_NUMBER}\s*[-–—]|(?:sidan?|sid|side|s|page|p|seite)\.?\s*{_NUMBER}(?:\s*(?:av|of|von|/)\s*{_NUMBER})?|{_NUMBER}\s*/\s*{_NUMBER}|{_NUMBER}\s*\({_NUMBER}\)|{_NUMBER})"
PAGE = re.compile(rf"\s*{_PAGE}\s*", re.I)
TRAILING = re.compile(rf"(.*?\S)(?:\s{{2,}}|\t\s*)({_PAGE})\s*", re.I)
_SENTENCE = re.compile("[.!?…][\"'”’»)\\]]*$")
_BROKEN = re.compile(f"[^\\W\\d_][{BREAKS}]$")
_DIGITS = re.compile(r"\d+")

_PAIRS = (("rn", "m"), ("cl", "d"), ("ii", "u"), ("li", "h"))
_FOLD = str.maketrans("01l!|596cfäåöü", "oiiiisgbetaaou")


def fold(line: str) -> str:
    """Comparison form of a header: misread letters do not count, nor do numbers at its end."""
    s = line.lower()
    for a, b in _PAIRS:
        s = s.replace(a, b)
    return re.sub(r"[\W_]+", " ", s.translate(_FOLD)).strip()


@dataclass
class Page:
    """The lines of a text with what the classifiers look at."""

    raw: list[str]
    text: list[str] = field(default_factory=list)
    kept: list[int] = field(default_factory=list)
    features: list[list[float]] = field(default_factory=list)
    candidates: list[int] = field(default_factory=list)

    @staticmethod
    def of(text: str) -> Page:
        page = Page(text.replace("\r\n", "\n").replace("\r", "\n").replace("\f", "\n\f\n").split("\n"))
        page.text = [s.strip(" \t\xa0") for s in page.raw]
        page.kept = [k for k, s in enumerate(page.text) if s and s != "\f"]
        if len(page.kept) > 1:
            page._measure()
        return page

    def _measure(self) -> None:
        lines = [self.text[k] for k in self.kept]
        n = len(lines)
        sizes = sorted(map(len, lines))
        usual = max(20, sizes[n * 3 // 4])
        whole = [bool(PAGE.fullmatch(s)) for s in lines]
        trailing = [None if whole[k] else TRAILING.fullmatch(s) for k, s in enumerate(lines)]
        keys = ["" if whole[k] else fold((trailing[k][1] if trailing[k] else s) if len(s) <= 90 else "") for k, s in enumerate(lines)]
        section = [s.startswith("§") for s in lines]
        count = Counter(keys)
        free = Counter(key for k, key in enumerate(keys) if not (k and section[k - 1]) and not section[k])
        ended = [bool(_SENTENCE.search(s)) for s in lines]
        gap = [k == 0 or self.kept[k] - self.kept[k - 1] > 1 for k in range(n)] + [True]
        feed = [k == 0 or "\f" in self.text[self.kept[k - 1] : self.kept[k]] for k in range(n)] + [True]
        short = [whole[k] or trailing[k] is not None or len(s) <= 60 and not ended[k] for k, s in enumerate(lines)]
        numbers = sum(whole) + sum(t is not None for t in trailing)
        values = [int(_DIGITS.search(s if whole[k] else trailing[k][2])[0]) if whole[k] or trailing[k] else None for k, s in enumerate(lines)]
        counted = [x for x in values if x is not None]
        rising = sum(b - a == 1 for a, b in zip(counted, counted[1:]))
        last = None
        for k, s in enumerate(lines):
            if not short[k]:
                continue
            value = values[k]
            step = 0.0 if value is None or last is None else float(value - last)
            last = value if value is not None else last
            before = next((j for j in range(k - 1, max(-1, k - 6), -1) if not short[j] or len(lines[j]) > 0.6 * usual and free[keys[j]] < 2), None)
            after = next((j for j in range(k + 1, min(n, k + 6)) if not short[j] or len(lines[j]) > 0.6 * usual and free[keys[j]] < 2), None)
            opened = before is not None and not ended[before]
            goes_on = after is not None and lines[after][:1].islower()
            near = k and whole[k - 1] or k + 1 < n and whole[k + 1]
            letters = sum(map(str.isalpha, s))
            self.candidates.append(k)
            self.features.append([
                whole[k], trailing[k] is not None, min(count[keys[k]], 5) if keys[k] else 0, min(free[keys[k]], 5) if keys[k] else 0, len(s), len(s) / usual, ended[k], opened, goes_on,
                k > 0 and section[k - 1], section[k] or s.endswith(":"), gap[k], gap[k + 1], k == 0, k == n - 1, letters / len(s), near, min(numbers, 8), step, sum(map(str.isupper, s)) / len(s), n,
                feed[k], feed[k + 1], sum(short) / n, s[:1].islower(), before is None, after is None, min(count[keys[k]], 5) / max(1, min(numbers, 20)), min(rising, 6), rising / max(1, numbers - 1),
                k > 0 and lines[k - 1].endswith(":"), -1 if value is None else value,
            ])

    def furniture(self, probabilities: np.ndarray, least: float = 0.5) -> tuple[set[int], set[str]]:
        """Line numbers (into ``text``) of furniture, and the kinds seen: ``header``, ``page_number``."""
        gone, kinds = set(), set()
        for k, p in zip(self.candidates, probabilities):
            if p >= least:
                at = self.kept[k]
                gone.add(at)
                s = self.text[at]
                if PAGE.fullmatch(s):
                    kinds.add("page_number")
                else:
                    kinds |= {"header", "page_number"} if TRAILING.fullmatch(s) else {"header"}
        return gone, kinds


def break_features(before: str, after: str, blank: bool, between: bool, breaks: int) -> list[float]:
    """What tells whether the hyphen-like sign at the end of a line splits a word."""
    stem = re.split(r"\s", before)[-1][:-1]
    head = re.match(r"[^\W_]*", after)[0]
    return [before[-1] == "-", after[:1].islower(), head.lower() in SUSPENDED, len(stem), len(head), stem[-1:].isalpha(), any(c.isdigit() for c in stem), blank, between, min(breaks, 10), stem[:1].isupper(), after[:1].isupper()]


def body(page: Page, gone: set[int]) -> list[tuple[int, str]]:
    """The other lines, each with its number in ``page.text``."""
    return [(k, page.text[k]) for k in page.kept if k not in gone]


def break_candidates(lines: list[tuple[int, str]]) -> list[int]:
    """Positions in ``lines`` of line ends that may split a word."""
    return [i for i in range(len(lines) - 1) if _BROKEN.search(lines[i][1]) and lines[i + 1][1][:1].isalpha()]


def breaks_of(page: Page, gone: set[int]) -> tuple[list[tuple[int, str]], list[int], list[list[float]]]:
    lines = body(page, gone)
    at = break_candidates(lines)
    rows = []
    for i in at:
        (a, s), (b, t) = lines[i], lines[i + 1]
        rows.append(break_features(s, t, b - a > 1, any(x in gone for x in range(a + 1, b)), len(at)))
    return lines, at, rows


def paragraphs(page: Page, lines: list[tuple[int, str]], joined: set[int]) -> str:
    """Continuous text: split words in one piece, lines of a paragraph in one line, blank lines between paragraphs.

    A blank line inside a sentence is taken for a page break. Short lines that do not end a sentence (headings, lists) stay
    lines of their own.
    """
    usual = sorted(len(s) for _, s in lines)[len(lines) * 3 // 4] if lines else 0
    out: list[str] = []
    for i, (k, s) in enumerate(lines):
        out.append(s[:-1] if i in joined else s)
        if i + 1 == len(lines):
            break
        after = lines[i + 1][1]
        blank = any(not t or t == "\f" for t in page.text[k + 1 : lines[i + 1][0]])
        if i in joined:
            continue
        ended = bool(_SENTENCE.search(s))
        if blank and (ended or not after[:1].islower()):
            out.append("\n\n")
        elif not ended and len(s) < 0.6 * usual and after[:1].isupper() or s.startswith("§") or len(s) > 200:
            out.append("\n")
        else:
            out.append(" ")
    return "".join(out)


_FORMS = ("{}", "[{}]", "— {} —", "- {} -", "Sida {} av {n}", "s. {}", "sid {}", "{}/{n}", "{} ({n})", "Page {} of {n}", "Seite {} von {n}")


def _made(words: list[str], r: random.Random) -> list[str]:
    """Headers of one document: one form, or two that take turns."""
    capital = [w for w in words if w[:1].isupper() and len(w) > 5 and w.isalpha()] or ["Rapporten"]
    pick = lambda: r.choice(capital)
    one = r.choice([f"{pick()} {r.randint(1990, 2025)}", f"{pick()} {r.randint(1990, 2025)}".upper(), f"Dnr {r.randint(1, 999)}-{r.randint(1, 99)} {pick()} {pick()}", f"{pick()} | {pick()}", f"{pick()} – {pick()}", f"Der {pick()} {r.randint(1990, 2025)}", f"{pick()} {pick().lower()}"])
    return [one] if r.random() < 0.7 else [one, f"{pick()} – {pick()}"]


def make(text: str, r: random.Random) -> tuple[str, set[int], set[int]]:
    """A furnished and broken version of a text; the numbers of its furniture lines and of its lines that end in a split word."""
    width = r.randint(38, 90)
    lines: list[str] = []
    split: set[int] = set()
    sign, often = r.choice(BREAKS[:4] + "-"), r.choice([0.0, 0.4, 0.9])
    for part in text.split("\n"):
        if len(part) <= width:
            lines.append(part)
            continue
        line = ""
        for w in part.split(" "):
            if len(line) + len(w) + 1 <= width or not line:
                line = f"{line} {w}" if line else w
                continue
            room = width - len(line) - 2
            if w.isalpha() and len(w) > 5 and 2 <= room < len(w) - 1 and r.random() < often:
                split.add(len(lines))
                lines.append(f"{line} {w[:room]}{sign}")
                line = w[room:]
            else:
                if r.random() < 0.02 and w.isalpha():  # a suspended compound at the end of the line
                    lines.append(f"{line} {w}-")
                    line = f"{r.choice(sorted(SUSPENDED))} {w}"
                    continue
                lines.append(line)
                line = w
        lines.append(line)
    for _ in range(r.choice([0, 0, 1, 2])):  # a caption with a value, which is no furniture
        k = r.randint(0, len(lines))
        captions = [w for w in text.split() if w[:1].isupper() and w.isalpha()] or ["Antal"]
        block = ["", f"{r.choice(captions)}{r.choice([':', ':', ''])}", str(r.randint(1, 1999)), ""]
        lines[k:k] = block
        split = {i + len(block) if i >= k else i for i in split if i + 1 != k}
    header, number = r.random() < 0.5, r.random() < 0.5
    if not (header or number):
        return "\n".join(lines), set(), split
    size, form, top = r.randint(6, 30), r.choice(_FORMS), r.random() < 0.6
    headers = _made(text.split(), r)
    pages = [list(range(k, min(k + size, len(lines)))) for k in range(0, len(lines), size)]
    start = r.choice([1, 1, 1, r.randint(2, 90)])
    same = header and number and r.random() < 0.3
    out, gone, kept = [], set(), set()
    for p, rows in enumerate(pages):
        page_no = form.format(start + p, n=start + len(pages) + r.randint(0, 3))
        h = headers[p % len(headers)] if header else None
        extra = [f"{h}   {page_no}"] if same else [x for x in (h, page_no if number else None) if x]
        above = extra if top else extra[:1] if len(extra) > 1 else []
        below = [x for x in extra if x not in above]
        if p and r.random() < 0.5:
            out.append(r.choice(["", "\f"]))
        for x in above:
            gone.add(len(out))
            out.append(x)
        for k in rows:
            if k in split:
                kept.add(len(out))
            out.append(lines[k])
        for x in below:
            gone.add(len(out))
            out.append(x)
    return "\n".join(out), gone, kept


@dataclass
class Readers:
    """The two trained classifiers."""

    lines: Boosted
    breaks: Boosted


def train(texts: list[str], seed: int = 11) -> Readers:
    """Classifiers from a sample of prose. Texts that seem to hold furniture already are used for breaks only if unbroken."""
    r = random.Random(seed)
    x: list[list[float]] = []
    y: list[int] = []
    bx: list[list[float]] = []
    by: list[int] = []
    for text in texts:
        own = Page.of(text)
        if any(f[0] or f[1] or f[3] > 1 for f in own.features) or _BROKEN.search(text.replace("\n", " \n")) or re.search(f"[{BREAKS}] *\n", text):
            continue
        if own.features:
            x += own.features
            y += [0] * len(own.features)
        for _ in range(2):
            made, gone, split = make(text, r)
            page = Page(made.split("\n"))
            page.text = [s.strip(" \t\xa0") for s in page.raw]
            page.kept = [k for k, s in enumerate(page.text) if s and s != "\f"]
            if len(page.kept) > 1:
                page._measure()
            x += page.features
            y += [int(page.kept[k] in gone) for k in page.candidates]
            lines, at, rows = breaks_of(page, gone)
            bx += rows
            by += [int(lines[i][0] in split) for i in at]
    return Readers(
        Boosted(rounds=60).fit(matrix(x), np.array(y, dtype=float)),
        Boosted(rounds=30).fit(matrix(bx), np.array(by, dtype=float)),
    )
