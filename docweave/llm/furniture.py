"""Page furniture of scanned texts: headers, footers and page numbers among the lines.

Every line that could be furniture is scored by a perceptron with page-position features: where it
stands (known page edge, edge of the text, within it), what its signs look like, whether it comes
again in the document, whether its number goes on with the page before or after, whether a sentence
runs on over it, and how many pages the document is said to have. A second perceptron sees the
decisions of the first about the lines around and decides.

Labels come from the corpus: in texts parted by form feeds, what stands at the same edge of several
pages is furniture, and lines far from the edges are not. The same texts with their form feeds
taken out, and single pages of them, teach what furniture looks like where pages are not parted.
"""

import re
from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict

from docweave.llm.perceptron import Perceptron, yes_no

MARKS = "-‐­¬"
ENDS = (".", "?", "!", ":", ";")
#: Lines at a page's edge that teach what furniture is; scoring knows no such depth.
ZONE = 3

#: Signs that scanning takes for each other, made one, to compare lines.
_PAIRS = (("rn", "m"), ("cl", "d"), ("i'", "r"), ("ii", "u"), ("vv", "w"), ("li", "h"), ("ri", "n"))
_SINGLE = str.maketrans("c0156yqf(|l", "eoisbvgteii")
_FIGURE = str.maketrans("lI|OoS", "111005")
_ROMANS = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100}


def fold(line: str) -> str:
    """A line without capitals, spacing and usual misreadings; numbers become one sign."""
    s = re.sub(r"\s+", " ", line.strip().rstrip("'")).lower()
    s = re.sub(r"\b[\dlo|]*\d[\dlo|]*\b", "#", s)
    for seen, true in _PAIRS:
        s = s.replace(seen, true)
    return s.translate(_SINGLE)


def roman(token: str) -> int | None:
    values = [_ROMANS.get(c) for c in token.lower().replace("1", "i").replace("|", "i")]
    if not values or None in values:
        return None
    total = sum(-v if any(w > v for w in values[k + 1 : k + 2]) else v for k, v in enumerate(values))
    return total if 0 < total < 400 else None


def figure(token: str) -> int | None:
    """The number a token stands for, with letters read for digits taken as these."""
    token = token.strip("-–—[](){}.,'").translate(_FIGURE)
    return int(token) if token.isdigit() and len(token) <= 6 else None


def sign(token: str) -> str:
    """The kind of a token by its signs: number, date, reference, word of some case, mark."""
    bare = token.strip("-–—[](){}.,:'\"")
    if not bare:
        return token[:1]
    digits = sum(c.isdigit() for c in bare)
    if digits and bare.translate(_FIGURE).isdigit():
        return "9"
    if digits and any(c in "./" for c in bare) and re.sub(r"[./]", "", bare).translate(_FIGURE).isdigit():
        return "9" + ("/" if "/" in bare else ".") * sum(c in "./" for c in bare) + "9"
    if digits and "-" in bare and bare[:1].isalpha():
        return "C"
    if len(bare) <= 6 and roman(bare):
        return "i"
    if bare.isupper():
        return "U"
    return "A" if bare[:1].isupper() else "a" if bare[:1].islower() else "m"


def shape(text: str) -> str:
    """Token kinds of a line, runs of one kind told once; wide gaps and bars are kept."""
    out: list[str] = []
    for part in re.split(r"(\s{3,}|\s)", text):
        if not part:
            continue
        s = ("_" if len(part) > 2 else "") if part.isspace() else sign(part)
        if s and not (out and out[-1] == s):
            out.append(s)
    return " ".join(out[:10])


class Lines:
    """The non-blank lines of a text: line number, text, whether a page begins or ends there, blank lines around."""

    def __init__(self, content: str, pages: int | None = None):
        self.numbers: list[int] = []
        self.raw: list[str] = []
        self.top: list[bool] = []
        self.bottom: list[bool] = []
        self.before: list[bool] = []
        self.after: list[bool] = []
        self.parted = "\f" in content
        self.pages = pages
        fresh, blank = True, False
        for number, line in enumerate(content.split("\n"), 1):
            for k, part in enumerate(line.split("\f")):
                if k:
                    if self.raw:
                        self.bottom[-1] = True
                    fresh = True
                if part.strip():
                    self.numbers.append(number)
                    self.raw.append(part.rstrip("\r"))
                    self.top.append(fresh)
                    self.bottom.append(False)
                    self.before.append(blank)
                    self.after.append(False)
                    fresh = blank = False
                elif k == 0 and "\f" not in line:
                    blank = True
                    if self.after:
                        self.after[-1] = True
        if self.raw:
            self.bottom[-1] = True
        self.texts = [r.strip() for r in self.raw]
        sizes = sorted(map(len, self.raw))
        self.width = max(sizes[len(sizes) * 9 // 10], 20) if sizes else 20

    def spoken(self, k: int) -> bool:
        """Whether a line begins, ends or goes on a sentence."""
        t = self.texts[k]
        if len(t) > 85 or t[-1] in ".?!;," or t[-1] in MARKS and t[-2:-1].isalpha() or len(t) > 14 and t[0].islower():
            return True
        return len(t) > 0.75 * self.width and "   " not in t and sum(w[0].islower() and len(w) > 1 for w in t.split()) > 3

    def candidates(self) -> list[int]:
        """Lines that may be furniture: all that are no part of a sentence."""
        return [k for k in range(len(self.texts)) if not self.spoken(k)]


def unfinished(text: str) -> bool:
    return not text.endswith(ENDS) or text[-1] in MARKS


def page_values(text: str) -> set[int]:
    """The numbers that may be the page's: alone, first or last in its line."""
    tokens = re.split(r"[\s/|]+", text.strip(" -–—[](){}'"))
    found = [(at, v) for at, v in enumerate(map(figure, tokens)) if v is not None]
    out = {v for at, v in found[:1] if at in (0, len(tokens) - 1) or len(tokens) <= 5} | {v for at, v in found[1:] if at == len(tokens) - 1 and len(tokens) > 5}
    if len(tokens) == 1 and (r := roman(tokens[0])):
        out.add(r)
    return out


class Scene:
    """The candidates of a text with what their features need."""

    def __init__(self, lines: Lines, heads: frozenset[str] = frozenset()):
        self.lines, self.at, self.heads = lines, lines.candidates(), heads
        self.key = {k: fold(lines.texts[k]) for k in self.at}
        self.shape = {k: shape(lines.texts[k]) for k in self.at}
        self.values = {k: v for k in self.at if (v := page_values(lines.texts[k]))}
        self.count = Counter(self.key.values())
        places = defaultdict(list)
        for k, some in self.values.items():
            for v in some:
                places[v].append(k)
        n = len(lines.texts)

        def near(v: int, low: int, high: int) -> bool:
            p = places.get(v, [])
            return bisect_left(p, low) < bisect_right(p, high)

        self.chain = {k: max(near(v - 1, 0, k - 3) + near(v + 1, k + 3, n) for v in some) for k, some in self.values.items()}
        same: dict[str, int] = {}
        gaps: dict[int, int] = {}
        for k in self.at:
            if (j := same.get(self.key[k])) is not None:
                gaps[j], gaps[k] = min(gaps.get(j, n), k - j), k - j
            same[self.key[k]] = k
        self.gap = gaps
        inner = [a for a, b in zip(lines.after, lines.bottom) if not b]
        self.paragraphs = sum(inner) * 12 >= len(inner) > 0 and any(inner)

    def place(self, k: int) -> str:
        n, lines = len(self.lines.texts), self.lines
        if n == 1:
            return "only"
        if k == 0:
            return "first"
        if k == n - 1:
            return "last"
        if lines.top[k] or lines.bottom[k]:
            return "top" if lines.top[k] else "bottom"
        return "head" if k < 3 else "tail" if k >= n - 2 else "inner"

    def close(self, k: int) -> str:
        """How far the next line of the same wording is: what comes again within a few lines is a column or list."""
        gap = self.gap.get(k)
        return "none" if gap is None else "next" if gap == 1 else "near" if gap < 5 else "far"

    def features(self, k: int) -> list[str]:
        lines, text, s = self.lines, self.lines.texts[k], self.shape[k]
        said = "?" if lines.pages is None or lines.pages < 1 else "1" if lines.pages == 1 else "+"
        where = f"{self.place(k)}{'f' if lines.parted else ''}"
        again = min(self.count[self.key[k]] - 1, 2)
        chain = self.chain.get(k, -1)
        before = lines.texts[k - 1] if k else ""
        after = lines.texts[k + 1] if k + 1 < len(lines.texts) else ""
        runs_on = f"{bool(before) and unfinished(before)}{after[:1].islower()}"
        column = f"{self.shape.get(k - 1) == s}{self.shape.get(k + 1) == s}"
        gap = self.close(k)
        f = [
            f"{s}", f"{where} {s}", f"{where} {said}", f"{where} {said} {s}", f"chain{chain} {s}", f"chain{chain} {where}", f"again{again} {where}",
            f"again{again} {s}", f"runs{runs_on} {where}", f"runs{runs_on} {s}", f"column{column} {s}", f"{where} {s} chain{chain} again{again}",
            f"known{self.key[k] in self.heads} {where}", f"known{self.key[k] in self.heads} {s}", f"gap{gap} {where}", f"gap{gap} {s}", f"gap{gap} chain{chain}", f"{where} blank{lines.before[k]}{lines.after[k]}", f"long{len(text) * 4 // lines.width} {where}", f"indent{min((len(lines.raw[k]) - len(lines.raw[k].lstrip())) // 8, 2)} {s}",
            f"spoken{text[-1:] in '.?!;:,'}{text[:1].islower()} {where}", f"beside {self.shape.get(k - 1)} {self.shape.get(k + 1)} {s}",
        ]
        if len(text) <= 60 and s not in ("9", "i"):
            f.append(f"says {self.key[k]}")
        return f

    def context(self, k: int, taken: set[int]) -> list[str]:
        """Features of the lines around that the first perceptron took."""
        lines, s, n = self.lines, self.shape[k], len(self.lines.texts)
        first = k
        while first - 1 in taken:
            first -= 1
        last = k
        while last + 1 in taken:
            last += 1
        before = lines.texts[first - 1] if first else ""
        after = lines.texts[last + 1] if last + 1 < n else ""
        runs_on = f"{bool(before) and unfinished(before)}{after[:1].islower()}"
        place = "head" if first == 0 else "foot" if last == n - 1 else "edge" if any(lines.top[x] or lines.bottom[x] for x in range(first, last + 1)) else "inner"
        around = f"{k - 1 in taken}{k + 1 in taken}"
        key = self.key[k]
        self_taken = k in taken
        f = [
            f"took{self_taken} {place}", f"took{self_taken} {s}", f"around{around} {place} {s}", f"around{around} {place}", f"run {place} {runs_on} {s}",
            f"run {place} {runs_on} took{self_taken}", f"seams {self.seams_said(taken)} {place} {s}", f"same{min(self.taken_keys(taken)[key] - self_taken, 2)} {place} {s}",
        ]
        if place == "head":
            twice = self.key.get(k + 1) == key or self.key.get(k - 1) == key
            later = [x for x in self.at if x > 3 and self.key[x] == key]
            heads = Counter(lines.after[x] for x in later).most_common(1)
            cue = f"{heads[0][0] == lines.after[k] if heads else None}{self.paragraphs == lines.after[k]}"
            f += [f"first {k} twice{twice}{self.key.get(k - 1) == key} {s}", f"first {k} later{bool(later)} cue{cue} {s}", f"first {k} later{bool(later)} twice{twice} cue{cue}"]
        return f

    def seams_said(self, taken: set[int]) -> str:
        """Pages that the taken lines part, against the pages that the document is said to have."""
        if getattr(self, "_seams", None) is None:
            n = len(self.lines.texts)
            seams = sum(1 for k in taken if k and k - 1 not in taken and not self._reaches(k, taken, n))
            said = self.lines.pages
            self._seams = "?" if not said or said < 1 else "less" if seams + 1 < said else "same" if seams + 1 == said else "more"
        return self._seams

    @staticmethod
    def _reaches(k: int, taken: set[int], n: int) -> bool:
        while k in taken:
            k += 1
        return k == n

    def taken_keys(self, taken: set[int]) -> Counter:
        if getattr(self, "_keys", None) is None:
            self._keys = Counter(self.key[k] for k in taken)
        return self._keys


class Furniture:
    """The two perceptrons, and the wordings that are heads or feet of several documents."""

    def __init__(self, near: Perceptron, around: Perceptron, heads: frozenset[str]):
        self.near, self.around, self.heads = near, around, heads

    def first_taken(self, scene: Scene, features: dict[int, list[str]]) -> set[int]:
        return {k for k in scene.at if self.near.score(["furniture", *features[k]]) > 0}

    def lines_of(self, lines: Lines) -> set[int]:
        """Indexes (into the non-blank lines) of the furniture lines; the only line of a text is none."""
        if len(lines.texts) < 2:
            return set()
        scene = Scene(lines, self.heads)
        features = {k: scene.features(k) for k in scene.at}
        taken = self.first_taken(scene, features)
        return {k for k in scene.at if self.around.score(["furniture", *features[k], *scene.context(k, taken)]) > 0}


class Known:
    """What repeated lines tell of others: wordings, and shapes by where they stand."""

    def __init__(self) -> None:
        self.heads: frozenset[str] = frozenset()
        self.first: Counter = Counter()
        self.first_alone: Counter = Counter()
        self.later: Counter = Counter()


def labels(lines: Lines, scene: Scene, known: Known) -> dict[int, bool]:
    """Lines of a text whose kind its pages show: what comes at the same edge of several pages is furniture.

    So is what stands alone at a later page's edge and looks as repeated lines of other documents
    do. Lines far from the edges aren't, nor what comes again within a few lines, nor the first
    line of a text of one page unless several documents repeat its wording.
    """
    starts = [k for k, t in enumerate(lines.top) if t]
    out: dict[int, bool] = {}
    if len(starts) < 2:
        n = len(lines.texts)
        for k in scene.at:
            key, s = scene.key[k], scene.shape[k]
            if scene.count[key] > 2 and scene.close(k) in ("next", "near"):
                out[k] = False
            elif key in known.heads or known.first[s] > known.first_alone[s]:
                continue
            elif lines.pages == 1 and (ZONE <= k < n - ZONE or k == 0 and scene.close(k) == "none"):
                out[k] = False
            elif 0 < k < n - 1 and scene.chain.get(k) == 0 and key == "#":
                out[k] = False
        return out
    zones: dict[int, tuple[int, str]] = {}
    for p, (a, b) in enumerate(zip(starts, [*starts[1:], len(lines.texts)])):
        depth = min(ZONE, (b - a + 1) // 2)
        zones |= {k: (p, "top") for k in range(a, a + depth)}
        zones |= {k: (p, "bottom") for k in range(max(a + depth, b - depth), b)}
    keys: dict[tuple, set] = defaultdict(set)
    steps: dict[int, set] = defaultdict(set)
    for k in scene.at:
        if k in zones:
            p, edge = zones[k]
            keys[scene.key[k], edge].add(p)
            for v in scene.values.get(k, ()):
                steps[v - p].add(p)
    for k in scene.at:
        if k not in zones:
            out[k] = False
            continue
        p, edge = zones[k]
        key, s = scene.key[k], scene.shape[k]
        bare = all(c in "9i-[]./ " for c in s)
        stepped = any(len(steps[v - p]) > 1 for v in scene.values.get(k, ()))
        repeated = len(keys[key, edge]) > 1 and not bare
        if p == 0 and edge == "top" and repeated and not stepped:
            same = [x for x in range(0, min(ZONE + 1, len(lines.texts))) if scene.key.get(x) == key]
            if len(same) > 1:
                out[k] = k == same[0]
            elif key in known.heads or known.first[s] > known.first_alone[s]:
                out[k] = True
            else:  # either the head or the title: the blank line behind it may tell
                later = Counter(lines.after[x] for x in scene.at if x in zones and zones[x][0] and scene.key[x] == key)
                head, title = later.most_common(1)[0][0] == lines.after[k], scene.paragraphs == lines.after[k]
                if head != title:
                    out[k] = head
        elif stepped or repeated or key in known.heads:
            out[k] = True
        elif p and edge == "top" and known.later[s] > 1:
            out[k] = True
        elif p == 0 and edge == "top" and known.first[s] <= known.first_alone[s]:
            out[k] = False
    return out


def told(lines: Lines, scene: Scene) -> list[tuple[str, str]]:
    """What a text tells of others: the wordings that it repeats on several pages, and shapes of lines by where they stand."""
    starts = [k for k, t in enumerate(lines.top) if t]
    if len(starts) < 2:
        return []
    sure = {k for k, v in labels(lines, scene, Known()).items() if v}
    out = [("heads", key) for key in {scene.key[k] for k in sure if k not in scene.values and "#" not in scene.key[k]}]
    for k in scene.at:
        if k in sure:
            out.append(("later" if k >= starts[1] else "first", scene.shape[k]))
        elif k < min(ZONE, starts[1]):
            out.append(("first_alone", scene.shape[k]))
    return out


def learn(counts: dict[tuple[str, str], int]) -> Known:
    """Wordings that stand on several pages of two or more documents, and shapes of repeated lines, by how often they were told."""
    out = Known()
    out.heads = frozenset(name for (kind, name), n in counts.items() if kind == "heads" and n > 1)
    for (kind, name), n in counts.items():
        if kind != "heads":
            getattr(out, kind)[name] = n
    return out


def _views(content: str, whole: Lines, known: dict[int, bool]) -> list[tuple[Lines, dict[int, bool]]]:
    """A text with its labels: as it is, without form feeds, and its first pages alone."""
    out = [(whole, known)]
    if whole.parted and known:
        bare = Lines(re.sub(r"\n?\f\n?(?=\S)", "\n", content).replace("\f", ""), sum(whole.top))
        if len(bare.texts) == len(whole.texts):
            out += [(bare, known), (_without_pages(bare), known)]
        starts = [*[k for k, t in enumerate(whole.top) if t], len(whole.texts)]
        filled = [x for x in content.split("\f") if x.strip()]
        for p in range(min(2, len(filled))):
            alone = Lines(filled[p].strip("\n"), 1)
            if len(alone.texts) == starts[p + 1] - starts[p]:
                out.append((alone, {k - starts[p]: v for k, v in known.items() if starts[p] <= k < starts[p + 1]}))
    return out


def _without_pages(lines: Lines) -> Lines:
    twin = Lines("")
    twin.__dict__.update(lines.__dict__)
    twin.pages = None
    return twin


def fit(texts: list[tuple[str, int | None]], known: Known | None = None) -> Furniture:
    """Fit on (content, said pages); `known` is what these and other texts tell, by default these.

    All texts parted by form feeds count as much as all others.
    """
    whole = [Lines(content, pages) for content, pages in texts]
    scenes = [Scene(lines) for lines in whole]
    known = known or learn(Counter(x for lines, scene in zip(whole, scenes) for x in told(lines, scene)))
    parted = sum(lines.parted for lines in whole)
    weight = {True: min(1.0, (len(whole) - parted) / max(1, parted) or 1.0), False: min(1.0, parted / max(1, len(whole) - parted) or 1.0)}
    seen, pool = [], {}

    def kept(features: list[str]) -> list[str]:
        """The features, each held once."""
        return [pool.setdefault(f, f) for f in features]

    for (content, _), text, scene in zip(texts, whole, scenes):
        for lines, kinds in _views(content, text, labels(text, scene, known)):
            if kinds:
                view = Scene(lines, known.heads)
                seen.append((view, {k: kept(view.features(k)) for k in view.at}, kinds, weight[text.parted]))
    examples = [(yes_no(["furniture", *f[k]]), int(v)) for view, f, kinds, _ in seen for k, v in kinds.items() if k in f]
    steps = [w for _, f, kinds, w in seen for k in kinds if k in f]
    model = Furniture(Perceptron.fit(examples, epochs=4, steps=steps), Perceptron(), known.heads)
    examples = []
    for view, f, kinds, _ in seen:
        taken = model.first_taken(view, f)
        examples += [(yes_no(["furniture", *f[k], *kept(view.context(k, taken))]), int(v)) for k, v in kinds.items() if k in f]
    return Furniture(model.near, Perceptron.fit(examples, epochs=4, steps=steps), known.heads)
