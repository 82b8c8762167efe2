"""The English stemmer of M. F. Porter, "An algorithm for suffix stripping" (Program 14, 1980).

Written from the paper's rules: a word is taken as [C](VC)^m[V] of consonant and vowel runs, and
suffixes go or change in five steps, of each step the longest suffix that fits and only if what is
left meets its condition. Words of one or two letters and words of other letters than a-z stay.
"""

from __future__ import annotations

from functools import lru_cache

#: Suffix and replacement, the stem before it having m > 0 (step 2, step 3) or m > 1 (step 4); fixed values of the paper.
_STEP2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"),
    ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
)
_STEP3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
_STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _vowels(word: str) -> list[bool]:
    """y is a vowel after a consonant."""
    out: list[bool] = []
    for ch in word:
        out.append(ch in "aeiou" or (ch == "y" and bool(out) and not out[-1]))
    return out


def _measure(stem: str) -> int:
    """How often a consonant follows a vowel."""
    v = _vowels(stem)
    return sum(a and not b for a, b in zip(v, v[1:], strict=False))


def _double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and not _vowels(word)[-1]


def _short(word: str) -> bool:
    """Ends consonant, vowel, consonant, the last not w, x or y."""
    return len(word) > 2 and _vowels(word)[-3:] == [False, True, False] and word[-1] not in "wxy"


def _longest(word: str, suffixes) -> str | None:
    return max((s for s in suffixes if word.endswith(s)), key=len, default=None)


@lru_cache(maxsize=1 << 16)
def stem(word: str) -> str:
    if len(word) < 3 or not (word.isascii() and word.isalpha() and word.islower()):
        return word
    # 1a: plurals
    if word.endswith("sses") or word.endswith("ies"):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    # 1b: past and present participles
    if word.endswith("eed"):
        if _measure(word[:-3]):
            word = word[:-1]
    elif (end := _longest(word, ("ed", "ing"))) and any(_vowels(word[: -len(end)])):
        word = word[: -len(end)]
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif _double(word) and word[-1] not in "lsz":
            word = word[:-1]
        elif _measure(word) == 1 and _short(word):
            word += "e"
    # 1c
    if word.endswith("y") and any(_vowels(word[:-1])):
        word = word[:-1] + "i"
    # 2 and 3: long suffixes to short ones
    for rules in (dict(_STEP2), dict(_STEP3)):
        end = _longest(word, rules)
        if end and _measure(word[: -len(end)]):
            word = word[: -len(end)] + rules[end]
    # 4: suffixes off
    if (end := _longest(word, _STEP4)) and _measure(word[: -len(end)]) > 1 and (end != "ion" or word[: -len(end)].endswith(("s", "t"))):
        word = word[: -len(end)]
    # 5: a last e, and one l of two
    if word.endswith("e") and (_measure(word[:-1]) > 1 or (_measure(word[:-1]) == 1 and not _short(word[:-1]))):
        word = word[:-1]
    if _measure(word) > 1 and _double(word) and word[-1] == "l":
        word = word[:-1]
    return word
