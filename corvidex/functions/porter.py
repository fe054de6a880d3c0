"""Porter's stemmer as Column expressions.

A word's y is first marked by what it stands for: Y is a consonant, y a vowel. Then "measure above nought" and the other
conditions of the published algorithm are patterns of vowels and consonants. Words of less than three or more than 64
letters stay as they are. Of the algorithm's two published forms this is the later one, with bli and logi.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The endings of steps 2, 3 and 4, with what takes their place.
STEP2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log"}
STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")

VOWEL = "[aeiouy]"
#: A measure of one or more, of two or more, and a word of consonants, one vowel and one consonant other than w, x or y.
SOME = "^[^aeiouy]*[aeiouy]+[^aeiouy]"
MORE = "^[^aeiouy]*[aeiouy]+[^aeiouy]+[aeiouy]+[^aeiouy]"
SHORT = "^[^aeiouy]+[aeiouy][^aeiouywxY]$"


def _without(x: Column, k: int) -> Column:
    return F.left(x, F.length(x) - k)


def _ends(x: Column, *endings: str) -> Column:
    """Asked before a pattern is tried: most words have none of a step's endings."""
    return reduce(lambda a, b: a | b, [F.endswith(x, F.lit(e)) for e in endings])


def _marked(x: Column) -> Column:
    return F.when(F.contains(x, F.lit("y")), F.regexp_replace(F.regexp_replace(x, "(^|[aeiou])y", "$1Y"), "yy", "yY")).otherwise(x)


def _plural(x: Column) -> Column:
    return F.when(_ends(x, "s"), F.regexp_replace(x, "((?<=ss)es|(?<=i)es|(?<=[^s])s)$", "")).otherwise(x)


def _participle(x: Column) -> Column:
    """agreed gives agree, hopping hop|ed: a vertical bar marks what is still to be mended."""
    cut = lambda k: F.when(_without(x, k).rlike(VOWEL), F.concat(_without(x, k), F.lit("|"))).otherwise(x)
    return F.when(_ends(x, "eed"), F.when(_without(x, 3).rlike(SOME), _without(x, 1)).otherwise(x)).when(_ends(x, "ed"), cut(2)).when(_ends(x, "ing"), cut(3)).otherwise(x)


def _mended(x: Column) -> Column:
    bare = _without(x, 1)
    again = F.when(bare.rlike("(at|bl|iz)$") | bare.rlike(SHORT), F.concat(bare, F.lit("e"))).when(bare.rlike("(([^aeiouylsz])\\2|yY)$"), _without(bare, 1)).otherwise(bare)
    return F.when(F.endswith(x, F.lit("|")), again).otherwise(x)


def _last_y(x: Column) -> Column:
    return F.when(_ends(x, "y", "Y"), F.regexp_replace(x, "([aeiouy].*)[yY]$", "$1i")).otherwise(x)


def _ending(table: dict[str, str], least: str):
    """Change the longest ending of a table if what stands before it is long enough."""
    by_letter = {c: [e for e in sorted(table, key=len, reverse=True) if e[-1] == c] for c in sorted({e[-1] for e in table})}

    def cut(x: Column, end: str) -> Column:
        stem = _without(x, len(end))
        return F.when(stem.rlike(least), F.concat(stem, F.lit(table[end]))).otherwise(x)

    def step(x: Column) -> Column:
        out = None
        for letter, ends in by_letter.items():
            longest = reduce(lambda rest, e: F.when(_ends(x, e), cut(x, e)).otherwise(rest), reversed(ends), x)
            out = F.when(_ends(x, letter), longest) if out is None else out.when(_ends(x, letter), longest)
        return out.otherwise(x)

    return step


def _last_e(x: Column) -> Column:
    bare = _without(x, 1)
    return F.when(F.endswith(x, F.lit("e")) & (bare.rlike(MORE) | (bare.rlike(SOME) & ~bare.rlike(SHORT))), bare).otherwise(x)


def _last_l(x: Column) -> Column:
    return F.when(F.endswith(x, F.lit("ll")) & x.rlike(MORE), _without(x, 1)).otherwise(x)


def stems(words: Column) -> Column:
    """The stems of an array of lower-case words. A step at a time over all words, so that no expression is repeated."""
    fourth = _ending(dict.fromkeys(STEP4, ""), MORE)
    no_ion = lambda x: F.when(_ends(x, "ion") & x.rlike("[^st]ion$"), x).otherwise(fourth(x))
    fits = lambda w: F.length(w).between(3, 64)
    out = F.transform(words, lambda w: F.when(fits(w), _marked(w)).otherwise(F.concat(F.lit("="), w)))
    kept = lambda step: lambda x: F.when(F.startswith(x, F.lit("=")), x).otherwise(step(x))
    for step in (_plural, _participle, _mended, _last_y, _ending(STEP2, SOME), _ending(STEP3, SOME), no_ion, _last_e, _last_l):
        out = F.transform(out, kept(step))
    return F.transform(out, lambda x: F.lower(F.when(F.startswith(x, F.lit("=")), F.substr(x, F.lit(2))).otherwise(x)))


def stem(word: Column) -> Column:
    return F.element_at(stems(F.array(word)), 1)
