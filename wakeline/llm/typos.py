"""Edit distances and the symmetric-delete index shared by the operators on typed names."""

from __future__ import annotations

import unicodedata
from collections import defaultdict
from collections.abc import Iterable

#: Letters that do not decompose into a base letter and an accent.
LETTERS = str.maketrans({"Ø": "O", "Æ": "AE", "Å": "A", "ß": "SS", "Ł": "L", "Đ": "D", "Þ": "TH", "Œ": "OE"})


def plain(text: str) -> str:
    """Upper case without accents."""
    text = unicodedata.normalize("NFKD", text.upper().translate(LETTERS))
    return "".join(c for c in text if not unicodedata.combining(c))


def distance(a: str, b: str, most: int) -> int:
    """Edits (insert, delete, replace, swap of neighbours) between two words, ``most + 1`` if more."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    two, one = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            cost = min(one[j] + 1, row[j - 1] + 1, one[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                cost = min(cost, two[j - 2] + 1)
            row.append(cost)
        if min(row) > most:
            return most + 1
        two, one = one, row
    return min(one[-1], most + 1)


def deletes(word: str, depth: int) -> set[str]:
    """The word and all that remains of it after up to ``depth`` letters are left out."""
    out, last = {word}, {word}
    for _ in range(depth):
        last = {w[:i] + w[i + 1 :] for w in last for i in range(len(w))}
        out |= last
    return out


class DeleteIndex:
    """Words by their deletes: all words within an edit distance in a few look-ups."""

    def __init__(self, words: Iterable[str], depth: int = 2):
        self.depth, self.held = depth, defaultdict(list)
        for w in words:
            for d in deletes(w, self._depth(w)):
                self.held[d].append(w)

    def _depth(self, word: str) -> int:
        return self.depth if len(word) >= 6 else min(1, self.depth)

    def near(self, word: str, most: int = 2) -> dict[str, int]:
        """Indexed words within ``most`` edits, with their distance."""
        out: dict[str, int] = {}
        for d in deletes(word, min(most, self.depth)):
            for w in self.held.get(d, ()):
                if w not in out:
                    k = distance(word, w, most)
                    if k <= most:
                        out[w] = k
        return out
