"""A character editor for misread words, and the joining of words split at a line's end.

An averaged perceptron predicts for each character of a word whether to keep, replace or delete it
or to insert one after it, from the characters around; readings must be words of the corpus, whose
counts are features too. Which replacements, deletions and insertions there are is learned: rare
words of the corpus that differ in one place from a frequent word are aligned with it, and what
many of them have in common is a misreading. A second perceptron predicts, with the same counts,
whether a word at a line's end is joined with its rest.
"""

import math
import random
from collections import Counter, defaultdict

from docweave.llm.furniture import MARKS
from docweave.llm.perceptron import Perceptron

#: A misreading: what is seen, and what it should be.
Unit = tuple[str, str]


def plain(word: str) -> bool:
    """A word of letters, with marks only inside."""
    return word[:1].isalpha() and word[-1:].isalpha() and all(c.isalpha() or c in "'’-" for c in word)


def _middles(word: str, longest: int):
    """(part before, part after) -> middle, for all middles of up to `longest` characters."""
    for i in range(len(word) + 1):
        for size in range(min(longest, len(word) - i) + 1):
            yield word[:i], word[i + size :], word[i : i + size]


def learn_units(counts: dict[str, int], least: float = 0.004, longest: int = 2, much: int = 20) -> dict[Unit, float]:
    """Misreadings that words of the corpus show, with how often: `least` is their least share of all.

    A rare word and a word at least `much` times as frequent that differ in one middle of up to
    `longest` characters are an example. Of several such frequent words each has its part.
    """
    frequent = [w for w, n in counts.items() if n >= much and len(w) >= 4 and plain(w)]
    index: dict[tuple[str, str], list[tuple[str, str]]] = defaultdict(list)
    for w in frequent:
        for before, after, middle in _middles(w, longest):
            if len(before) + len(after) >= 4:
                index[before, after].append((middle, w))
    found: dict[Unit, float] = defaultdict(float)
    places: dict[Unit, set] = defaultdict(set)
    top = max(counts.values(), default=0)
    for token, n in counts.items():
        if n * much > top or len(token) < 4:
            continue
        ways: dict[str, tuple[str, str, bool]] = {}
        for before, after, middle in _middles(token, longest):
            for true, w in index.get((before, after), ()):
                if true == middle or counts[w] < n * much or (true and middle and (true[0] == middle[0] or true[-1] == middle[-1])):
                    continue
                if len(middle) + len(true) < 4 and w not in ways:
                    ways[w] = (middle, true, bool(before and after))
        if len({u[:2] for u in ways.values()}) > 3:
            continue
        for w, (seen, true, _) in ways.items():
            found[seen, true] += 1 / len(ways)
            places[seen, true].add(w)
    found = {u: n for u, n in found.items() if u[0] and u[1] and len(places[u]) > 1}
    return lasting(found, sum(found.values()), least)


def lasting(found: dict[Unit, float], total: float, least: float = 0.004) -> dict[Unit, float]:
    """The misreadings that explain three words and `least` of all `total`, the most frequent first."""
    # what is seen of a longer misreading with the same outcome, with a sign lost, is none of its own
    part = {u for u in found for v in found if v[1] == u[1] and u[0] in v[0] and u[0] != v[0] and found[v] > found[u]}
    return {u: n for u, n in sorted(found.items(), key=lambda x: (-x[1], x[0])) if u not in part and n >= max(3, least * total)}


def strokes(units: dict[Unit, float]) -> dict[str, str]:
    """Character -> what stands for it in a word's key, so that a word and its misreadings have one key.

    Characters that replace each other become one; a character taken for two becomes those two.
    """
    chars = sorted({c for u in units for side in u for c in side})
    parent = {c: c for c in chars}

    def root(c: str) -> str:
        while parent[c] != c:
            c = parent[c]
        return c

    for a, b in units:
        if len(a) == len(b) == 1:
            parent[max(root(a), root(b))] = min(root(a), root(b))
    wide: dict[str, str] = {}
    for a, b in units:
        one, two = (a, b) if len(a) < len(b) else (b, a)
        if len(one) == 1 and len(two) == 2 and root(one) not in (root(two[0]), root(two[1])):
            wide.setdefault(root(one), root(two[0]) + root(two[1]))

    def spelled(c: str, above: tuple[str, ...] = ()) -> str:
        r = root(c) if c in parent else c
        if r in above or r not in wide:
            return r
        return "".join(spelled(x, (*above, r)) for x in wide[r])

    # a pair that is read as one of several characters makes these one
    keys = {c: spelled(c) for c in chars}
    return {c: k for c, k in keys.items() if k != c}


def key_of(word: str, atoms: dict[str, str]) -> str:
    return "".join(atoms.get(c, c) for c in word)


def align(token: str, word: str, units: dict[Unit, float], most: int = 4) -> list[tuple[int, str, str]] | None:
    """The fewest misreadings that turn `word` into `token`, as (place in token, seen, true); None if there are no such."""
    layer: dict[tuple[int, int], list] = {(0, 0): []}
    by_seen: dict[str, list[Unit]] = defaultdict(list)
    for u in units:
        by_seen[u[0][0]].append(u)
    for used in range(most + 1):
        following: dict[tuple[int, int], list] = {}
        done = None
        for (i, j), edits in layer.items():
            while True:
                for seen, true in by_seen.get(token[i : i + 1], ()):
                    if token.startswith(seen, i) and word.startswith(true, j):
                        following.setdefault((i + len(seen), j + len(true)), [*edits, (i, seen, true)])
                if i < len(token) and j < len(word) and token[i] == word[j]:
                    i, j = i + 1, j + 1
                else:
                    break
            if i == len(token) and j == len(word) and done is None:
                done = edits
        if done is not None:
            return done if used else None
        layer = following
    return None


def bucket(n: float) -> int:
    return 0 if n <= 0 else min(1 + int(math.log2(n)), 20)


def operations(token: str, edits: list[tuple[int, str, str]]) -> list[tuple[int, str]]:
    """The operation at each edited character: replace, delete, or insert after."""
    out = []
    for at, seen, true in edits:
        for k in range(max(len(seen), len(true))):
            if k >= len(seen):
                out.append((at + len(seen) - 1, f"insert {true[k]}"))
            elif k >= len(true):
                out.append((at + k, f"delete {seen[k]}"))
            else:
                out.append((at + k, f"replace {seen[k]} {true[k]}" if seen[k] != true[k] else f"keep {seen[k]}"))
    return out


class Editor:
    """Predicts the characters of a word; readings are words of the corpus."""

    def __init__(self, units: dict[Unit, float], perceptron: Perceptron):
        self.units, self.perceptron = units, perceptron
        self.atoms = strokes(units)

    @staticmethod
    def features(token: str, count: int, word: str, word_count: int, edits: list[tuple[int, str, str]]) -> list[str]:
        """Features of reading `token` as `word`: of each edited character, and of the words' counts."""
        if not edits:
            odd = sum(not c.isalpha() for c in token[:-1])
            return ["keep", f"keep count {bucket(count)}", f"keep size {min(len(token), 6)}", f"keep odd {min(odd, 2)}", f"keep odd {min(odd, 2)} count {bucket(count)}"]
        share = word_count * 0.01 * len(edits) / max(count, 0.5)
        out = [f"edits {len(edits)}", f"word {bucket(word_count)}", f"token {bucket(count)}", f"share {bucket(share * 8)}", f"size {min(len(token), 6)} edits {len(edits)}"]
        for at, op in operations(token, edits):
            place = "first" if at == 0 else "last" if at == len(token) - 1 else "inner"
            out += [op, f"{op} {place}", f"{op} after {token[max(0, at - 1) : at]}", f"{op} before {token[at + 1 : at + 2]}"]
        return out + [f"read {seen}>{true}" for _, seen, true in edits]

    def gain(self, token: str, count: int, word: str, word_count: int) -> float | None:
        """How much better `word` is than the token itself; None if no misreadings lead from it."""
        edits = align(token, word, self.units)
        if not edits:
            return None
        score = self.perceptron.score
        return score(self.features(token, count, word, word_count, edits)) - score(self.features(token, count, token, count, []))

    def lessons(self, token: str, count: int, right: str | None, ways: list[tuple[str, int]], much: int = 20) -> list[tuple[list[list[str]], int]]:
        """Examples that a word teaches, with the (word, count) of its key.

        Where `right` is not known, a word that misreadings lead to from one at least `much` times as
        frequent is taken for it, one without any even half as much more frequent is right as it is,
        others teach nothing.
        """
        read = [(w, n, edits) for w, n in ways if w != token and (edits := align(token, w, self.units))]
        if not read:
            return []
        times = 1
        if right is None:
            n, best = max((n, w) for w, n, _ in read)
            if much * count / 2 <= n < much * count:
                return []
            right, times = (best, 1) if n >= much * count else (token, 3)
        names = [token, *(w for w, _, _ in read)]
        if right not in names:
            return []
        choices = [self.features(token, count, token, count, []), *(self.features(token, count, w, n, e) for w, n, e in read)]
        return [(choices, names.index(right))] * times

    @classmethod
    def fit(cls, counts: dict[str, int], much: int = 20) -> "Editor":
        """Fit on words of the corpus: what they teach themselves, and the frequent ones also spoilt by what was learned."""
        editor = cls(learn_units(counts, much=much), Perceptron())
        spoiler = Spoiler(editor.units)
        near: dict[str, list[tuple[str, int]]] = defaultdict(list)
        for w, n in sorted(counts.items()):
            if n >= 3 and plain(w):
                near[key_of(w, editor.atoms)].append((w, n))
        taught = [(w, n, None) for w, n in sorted(counts.items()) if len(w) >= 3 and not w.endswith("-")]
        for w, n in sorted(counts.items()):
            if n >= 8 and len(w) >= 3 and plain(w):
                taught += [(token, counts.get(token) or guess, w) for token, guess in spoiler.spoilt(w, n) if counts.get(token, 0) * much <= n]
        editor.perceptron = Perceptron.fit([x for token, n, right in taught for x in editor.lessons(token, n, right, near.get(key_of(token, editor.atoms), []), much)])
        return editor


class Spoiler:
    """Puts misreadings into words; what it draws for a word depends on the word only."""

    def __init__(self, units: dict[Unit, float], seed: int = 5):
        self.units, self.weights, self.seed = list(units), list(units.values()), seed
        self.by_true: dict[str, list[int]] = defaultdict(list)
        for k, (_, true) in enumerate(self.units):
            self.by_true[true].append(k)

    def ways(self, word: str) -> list[tuple[int, int]]:
        return [(at, k) for at in range(len(word)) for size in (1, 2) for k in self.by_true.get(word[at : at + size], ()) if len(word) - at >= size]

    def put(self, word: str, at: int, k: int) -> str:
        seen, true = self.units[k]
        return word[:at] + seen + word[at + len(true) :]

    def often(self, word: str, rng: random.Random) -> str | None:
        """The word with a misreading, by how often each is seen."""
        ways = self.ways(word)
        return self.put(word, *rng.choices(ways, [self.weights[k] for _, k in ways])[0]) if ways else None

    def spoilt(self, word: str, n: int) -> list[tuple[str, int]]:
        """Two spoilt forms of a word, each with how many texts may hold it where none does."""
        rng, out = random.Random(f"{self.seed} {word}"), []
        for _ in range(2):
            token = self.often(word, rng)
            if token and rng.random() < 0.15:
                token = self.often(token, rng) or token
            if token and token != word:
                out.append((token, max(1, int(n * 0.004 * rng.random()))))
        return out

    def splits(self, word: str, repeats: int) -> list[tuple[str, str, str, bool, int]]:
        """(part, mark, rest, whether the text has other marks, whether they are joined) to learn from.

        A word is split at any place, a compound `repeats` times at its hyphen, and elsewhere. Some
        parts are misread.
        """
        rng, out = random.Random(f"{self.seed} {word}"), []

        def misread(part: str) -> str:
            ways = self.ways(part)
            return self.put(part, *rng.choice(ways)) if ways else part

        def example(a: str, mark: str, b: str, other: bool, right: int) -> None:
            spoil = rng.random()
            if spoil < 0.1:
                a, b = (misread(a), b) if spoil < 0.05 else (a, misread(b))
            out.append((a, mark, b, other, right))

        if "-" not in word:
            cut = rng.randrange(2, len(word) - 1)
            mark = rng.choice(MARKS)
            example(word[:cut], mark, word[cut:], mark != "-", 1)
            example(word[:cut], "-", word[cut:], False, 1)
            return out
        a, _, b = word.rpartition("-")
        for _ in range(repeats):
            example(a, "-", b, rng.random() < 0.5, 0)
            if len(b) > 4:  # a compound may also be split elsewhere
                cut = rng.randrange(2, len(b) - 1)
                example(f"{a}-{b[:cut]}", rng.choice(MARKS), b[cut:], rng.random() < 0.5, 1)
        return out


def join_features(joined: int, hyphened: int, a: int, b: int, head: int, mark: str, other_mark: bool) -> list[str]:
    """Features of joining a word with its rest in the next line."""
    more = "joined" if joined > hyphened else "hyphened" if hyphened > joined else "same"
    return [
        f"mark {mark}", f"mark {mark} other {other_mark}", f"more {more}", f"joined {bucket(joined)}", f"hyphened {bucket(hyphened)}",
        f"parts {min(bucket(a), 6)} {min(bucket(b), 6)} {more}", f"head {min(bucket(head), 8)} {more}", f"{more} {mark}",
        f"head {head > 0} rest {b > 2} {more} {mark}",
    ]
