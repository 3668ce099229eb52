"""Words of a text with their offsets: what all text operators agree on as a word."""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right

#: UTF-8 read as Windows-1252 or Latin-1: a lead character and what follows it.
_MOJIBAKE = re.compile(r"[Â-ß][\u0080-¿ŒœŠšŸŽžƒˆ˜–-…‰‹›€™]|â[\u0080-¿Œ-™]{2}")
_SKIP = r"</?[A-Za-z!][^<>]*>|&#?\w{1,10};|https?://\S+"
_WORD = re.compile(rf"(?P<skip>{_SKIP})|[^\W_]+")
_ASCII = re.compile(r"[\x00-\x7f]*\Z")


def _repair(m: re.Match) -> str:
    for encoding in ("cp1252", "latin-1"):
        try:
            return m[0].encode(encoding).decode("utf-8")
        except UnicodeError:
            continue
    return m[0]


def fold_word(w: str) -> str:
    if w.isascii():
        return w.lower()
    t = unicodedata.normalize("NFKD", w.casefold().replace("ß", "ss").replace("ø", "o").replace("æ", "ae").replace("œ", "oe"))
    return "".join(c for c in t if not unicodedata.combining(c))


def words_with_offsets(text: str) -> tuple[list[str], list[int], list[int]]:
    """Folded words (markup skipped, broken encoding mended), and where each starts and ends in the text as given."""
    stages: list[list[tuple[int, int]]] = []  # per change of the text: (position from which on so many characters are missing)
    if not _ASCII.match(text):
        gone, shift = 0, []

        def mend(m: re.Match) -> str:
            nonlocal gone
            new = _repair(m)
            if len(new) < len(m[0]):
                at = m.end() - gone - (len(m[0]) - len(new))
                gone += len(m[0]) - len(new)
                shift.append((at, gone))
            return new

        text = _MOJIBAKE.sub(mend, text)
        stages.append(shift)
        if not unicodedata.is_normalized("NFC", text):
            # combining marks would be kept apart by the pattern for words
            out, marks, dropped = [], [], 0
            for i, c in enumerate(text):
                if unicodedata.combining(c):
                    dropped += 1
                    marks.append((i + 1 - dropped, dropped))
                else:
                    out.append(c)
            text = "".join(out)
            stages.append(marks)
    words, starts, ends = [], [], []
    for m in _WORD.finditer(text):
        if m.lastgroup == "skip":
            continue
        words.append(fold_word(m[0]))
        starts.append(m.start())
        ends.append(m.end())
    for shift in reversed(stages):
        if shift:
            places = [p for p, _ in shift]

            def original(x: int, places: list[int] = places, shift: list[tuple[int, int]] = shift) -> int:
                k = bisect_right(places, x)
                return x + (shift[k - 1][1] if k else 0)

            starts, ends = [original(x) for x in starts], [original(x) for x in ends]
    return words, starts, ends


_PLAIN_WORD = re.compile(r"[^\W_]+")
#: Letters with marks of the corpus's languages and punctuation outside of ASCII, as fold_word and the pattern for words treat them.
_FOLD = {ord(c): unicodedata.normalize("NFKD", c.lower())[0] for c in "ÀÁÄÅÃÇÈÉÊËÌÍÎÏÑÒÓÔÖÕÙÚÛÜÝàáäåãçèéêëìíîïñòóôöõùúûüýÿ"} | {ord("ß"): "ss", ord("ø"): "o", ord("Ø"): "o", ord("æ"): "ae", ord("Æ"): "ae", ord("œ"): "oe", ord("Œ"): "oe"} | {ord(c): " " for c in "’‘“”„«»–—…¿¡·•\u00a0\u2009\u202f"}


def words_of(text: str) -> list[str]:
    """The words of words_with_offsets alone; in one pass where neither markup nor broken encoding can be present."""
    if "<" not in text and "&" not in text and "://" not in text:
        if text.isascii():
            return _PLAIN_WORD.findall(text.lower())
        if not _MOJIBAKE.search(text):
            plain = text.translate(_FOLD)
            if plain.isascii():
                return _PLAIN_WORD.findall(plain.lower())
    return words_with_offsets(text)[0]


_SENTENCE_END = re.compile(r"(?<=[.!?…])[\"'”’)\]]*\s+|\s*(?:\r?\n[ \t]*){2,}|(?<=[.!?])(?=[A-ZÀ-Þ¿¡])|\s*[\r\n]+\s*(?=[-*•#>|]\s)")


#: The same where a text has no line break, without its end marks: fast, since it starts with a mark.
_MARK = re.compile(r"[.!?…](?:[\"'”’)\]]*\s+|(?=[A-ZÀ-Þ¿¡]))")


def sentences(text: str) -> list[str]:
    """Sentences by their end marks, blank lines and list items; a single line break inside a sentence is a space. An end mark may be missing."""
    pattern = _SENTENCE_END if "\n" in text or "\r" in text else _MARK
    return [s for s in (p.strip() for p in pattern.split(text) if p) if s]


def sentence_words(text: str, long: int = 40, piece: int = 12) -> list[list[str]]:
    """Folded words without numbers of each sentence; where end marks are lost, pieces of `piece` words stand for sentences of more than `long`."""
    out = []
    for s in sentences(text):
        w = [x for x in words_of(s) if not x.isdigit()]
        if len(w) > long:
            out.extend(w[i : i + piece] for i in range(0, len(w), piece))
        elif w:
            out.append(w)
    return out
