"""Portuguese stems by ordered suffix rules (the public Snowball rules, on folded words: accents are gone before stemming).

Regions as usual: R1 follows the first consonant after a vowel, R2 is R1 of R1, RV follows the next vowel if the second
letter is a consonant, the next consonant if the word begins with two vowels, else the third letter.
"""

from __future__ import annotations

import functools
import re

# fixed values: the suffix lists of the rules, without those that hold an accent
_STANDARD = "amentos imentos amento imento adoras adores idades ismos istas adora antes idade ezas icos icas ismo ista osos osas ador ante ivas ivos eza ico ica oso osa iva ivo".split()
_VERBS = "aremos eremos iremos ariam eriam iriam assem essem issem arias erias irias ardes erdes irdes asses esses isses astes estes istes areis ereis ireis armos ermos irmos aria eria iria asse esse isse aste este iste arei erei irei aram eram iram avam arem erem irem ando endo indo adas idas aras eras avas ares eres ires ados idos amos emos imos iras ada ida ara era ava iam ado ido ias ais eis ira ia ei am em ar er ir as es is eu iu ou".split()
_RESIDUAL = ("os", "a", "i", "o")

_AFTER = re.compile("[aeiou][^aeiou]")


def _region(word: str, start: int) -> int:
    m = _AFTER.search(word, start)
    return m.end() if m else len(word)


def _verb_region(word: str) -> int:
    if len(word) < 3:
        return len(word)
    vowel = [c in "aeiou" for c in word]
    if vowel[1] and not vowel[0]:
        return 3
    sought = not vowel[1]  # after a consonant a vowel, after two vowels a consonant
    return next((i + 1 for i in range(2, len(word)) if vowel[i] == sought), len(word))


def _standard(word: str, r1: int, r2: int, rv: int) -> str | None:
    """The longest standard suffix, where it lies in its region; None where none was taken."""
    ends = lambda s, region: word.endswith(s) and len(word) - len(s) >= region

    def less(stem: str, *more: str) -> str:
        """The stem without the first of further suffixes that lies in R2."""
        return next((stem[: -len(s)] for s in more if stem.endswith(s) and len(stem) - len(s) >= r2), stem)

    found = max((s for s in (*_STANDARD, "logia", "logias", "amente", "mente", "ira", "iras") if word.endswith(s)), key=len, default=None)
    if found is None:
        return None
    stem = word[: -len(found)]
    if found == "amente":
        if not ends(found, r1):
            return None
        short = less(stem, "iv")
        return less(short, "at") if short != stem else less(stem, "os", "ic", "ad")
    if found in ("ira", "iras"):
        return stem + "ir" if ends(found, rv) and stem.endswith("e") else None
    if not ends(found, r2):
        return None
    if found in ("logia", "logias"):
        return stem + "log"
    if found == "mente":
        return less(stem, "ante", "avel", "ivel")
    if found in ("idade", "idades"):
        return less(stem, "abil", "ic", "iv")
    if found in ("iva", "ivo", "ivas", "ivos"):
        return less(stem, "at")
    return stem


@functools.lru_cache(1 << 18)
def portuguese_stem(word: str) -> str:
    """The stem of a folded word; other words than of a-z are their own stem."""
    if not (word.isascii() and word.isalpha()):
        return word
    r1 = _region(word, 0)
    r2, rv = _region(word, r1), _verb_region(word)
    stem = _standard(word, r1, r2, rv)
    if stem is None:
        verb = max((s for s in _VERBS if word.endswith(s) and len(word) - len(s) >= rv), key=len, default="")
        stem = word[: len(word) - len(verb)]
    if stem != word:
        if stem.endswith("ci") and len(stem) - 1 >= rv:
            stem = stem[:-1]
    else:
        residual = next((s for s in _RESIDUAL if stem.endswith(s) and len(stem) - len(s) >= rv), "")
        stem = stem[: len(stem) - len(residual)]
    if stem.endswith("e") and len(stem) - 1 >= rv:
        stem = stem[:-1]
        if stem.endswith(("gu", "ci")) and len(stem) - 1 >= rv:
            stem = stem[:-1]
    return stem
