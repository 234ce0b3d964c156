"""String distances and symmetric-delete dictionaries shared by the llm operators."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable

#: Neighbours on a keyboard (fixed values).
_ROWS = ("qwertyuiop", "asdfghjkl", "zxcvbnm")
NEAR = {(a, b) for row in _ROWS for x, y in zip(row, row[1:], strict=False) for a, b in ((x, y), (y, x))}
NEAR |= {(a, b) for up, down, shift in ((_ROWS[0], _ROWS[1], 0), (_ROWS[1], _ROWS[2], 0)) for i, x in enumerate(down) for y in up[i + shift : i + shift + 2] for a, b in ((x, y), (y, x))}


def weighted_distance(a: str, b: str, limit: float) -> float:
    """Damerau-Levenshtein with cheaper typing slips; more than limit once it exceeds that.

    A swap or a neighbouring key costs 0.8, a doubled or halved letter 0.7, any other edit 1. Letters that are swapped may have
    others between them, at the price of these ("overcast", "oversct").
    """
    if a == b:
        return 0.0
    n, m = len(a), len(b)
    if abs(n - m) * 0.7 > limit:
        return limit + 1
    gain = [0.0] * (m + 1)  # cost of typing b[j - 1]
    for j in range(1, m + 1):
        gain[j] = 0.7 if j > 1 and b[j - 1] == b[j - 2] else 1.0
    prev = [0.0] * (m + 1)
    for j in range(1, m + 1):
        prev[j] = prev[j - 1] + gain[j]
    rows = [prev]
    seen: dict[str, int] = {}  # last row of each letter of a
    for i in range(1, n + 1):
        ca = a[i - 1]
        loss = 0.7 if i > 1 and ca == a[i - 2] else 1.0
        row = [prev[0] + loss] + [0.0] * m
        low, last = row[0], 0  # last: last column of this row whose letters agree
        for j in range(1, m + 1):
            cb = b[j - 1]
            best = prev[j - 1] + (0.0 if ca == cb else 0.8 if (ca, cb) in NEAR else 1.0)
            if (d := prev[j] + loss) < best:
                best = d
            if (d := row[j - 1] + gain[j]) < best:
                best = d
            if last and (k := seen.get(cb, 0)) and (d := rows[k - 1][last - 1] + (i - k - 1) + 0.8 + (j - last - 1)) < best:
                best = d
            if ca == cb:
                last = j
            row[j] = best
            if best < low:
                low = best
        if low > limit + 1 and min(prev) > limit + 1:
            return limit + 1
        seen[ca] = i
        rows.append(row)
        prev = row
    return prev[m]


def deletes(word: str, most: int) -> set[str]:
    """The word and all strings left after removing up to `most` of its characters."""
    out, edge = {word}, {word}
    for _ in range(most):
        edge = {w[:i] + w[i + 1 :] for w in edge for i in range(len(w))}
        out |= edge
    return out


#: Words above this length meet by segments instead of deletes, whose number grows with the square of the length.
LONG = 40


def meeting_forms(word: str, most: int) -> set[str]:
    """Strings of which two words have one in common if at most `most` edits (0 to 2) lie between them.

    Short words: what is left after deletes. Long words: of most + 1 segments one stays as it is and moves by `most` at most, so
    the segments of the word, cut as for each length that the other word may have, meet the other word's own.
    """
    if len(word) <= LONG:
        return deletes(word, most)
    out = set()
    for n in range(len(word) - most, len(word) + most + 1):
        edges = [n * k // (most + 1) for k in range(most + 2)]
        for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
            for shift in range(-most, most + 1):
                if 0 <= a + shift and b + shift <= len(word):
                    out.add(f"{n}:{k}:{word[a + shift : b + shift]}")
    return out


def allowed(length: int) -> int:
    """Edits that a word of some length may carry: none up to two characters, one up to four, two beyond."""
    return 0 if length <= 2 else 1 if length <= 4 else 2


class DeleteIndex:
    """Symmetric-delete dictionary: entries and lookups meet in strings with up to `allowed` characters removed."""

    def __init__(self, words: Iterable[str]):
        self.words = sorted(set(words))
        self.longest = max(map(len, self.words), default=0)
        self.at: dict[str, list[int]] = defaultdict(list)
        for i, w in enumerate(self.words):
            for d in deletes(w, allowed(len(w))):
                self.at[d].append(i)

    def near(self, word: str) -> list[tuple[str, float]]:
        """(entry, weighted distance) of every entry within the edits its own length allows."""
        seen: set[int] = set()
        if len(word) > self.longest + 2:
            return []  # further from every entry than any edits allowed
        for d in deletes(word, min(2, allowed(len(word) + 1))):
            seen.update(self.at.get(d, ()))
        out = []
        for i in seen:
            w = self.words[i]
            most = float(allowed(len(w)))
            if (d := weighted_distance(word, w, most)) <= most:
                out.append((w, d))
        return out
