"""Brute-force helpers of the tests."""

import re
import zlib

BLANK = "[^\x20\x09-\x0d]+"


def words(text):
    """The words of a text, A-Z lower-cased."""
    return re.findall(BLANK, (text or "").translate({i: i + 32 for i in range(65, 91)}))


def shingles(text):
    w = words(text)
    if len(w) >= 5:
        return frozenset(tuple(w[k:k + 5]) for k in range(len(w) - 4))
    return frozenset([tuple(w)] if w else [])


def crc(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode())


def shingles_lower(text):
    w = [x for x in re.split(r"[ \t\n\x0b\f\r]+", (text or "").lower()) if x]
    if len(w) >= 5:
        return frozenset(tuple(w[k:k + 5]) for k in range(len(w) - 4))
    return frozenset([tuple(w)] if w else [])
