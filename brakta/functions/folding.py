"""Text without case and diacritics, with the way back: where each place of the folded text was."""

from __future__ import annotations

import unicodedata


class Folds(dict):
    """What a character folds to: compatibility forms taken apart, marks dropped, full case folding ('ß' is 'ss'), applied until nothing changes."""

    def __missing__(self, ch: str) -> str:
        was, now = "", ch
        while now != was:
            was, now = now, "".join(c for c in unicodedata.normalize("NFKD", now.casefold()) if not unicodedata.combining(c))
        if len(self) < 1 << 17:
            self[ch] = now
        return now


_FOLDS = Folds()


def folded(text: str) -> tuple[str, list[int] | None]:
    """(folded text, place of each of its characters and of its end in ``text``); None for the places where they have not moved."""
    if text.isascii():
        return text.lower(), None
    out = "".join(map(_FOLDS.__getitem__, text))
    if all(len(_FOLDS[c]) == 1 for c in set(text)):
        return out, None
    places = [i for i, c in enumerate(text) for _ in _FOLDS[c]]
    return out, [*places, len(text)]


def span_in(places: list[int] | None, text: str, start: int, end: int) -> tuple[int, int]:
    """A span of the folded text as one of the text: whole characters, with the marks that follow the last."""
    if places is None:
        return start, end
    first, last = places[start], places[end - 1] + 1
    while last < len(text) and not _FOLDS[text[last]]:
        last += 1
    return first, last
