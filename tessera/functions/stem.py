"""English stems: suffixes are stripped in steps where they lie in a word's regions, by the published second Porter algorithm.

R1 is what follows the first consonant after a vowel, R2 the same within R1. Words are stemmed once each: stems()
takes the distinct words of a table.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame

# The English words that aren't searched for.
STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves "
    "what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and but if or because as until while "
    "of at by for with about against between into through during before after above below to from up down in out on off over under again further then once here there "
    "when where why how all any both each few more most other some such no nor not only own same so than too very s t can will just don should now"
).split()

# Fixed values of the algorithm: irregular words, words that stay as step 1a leaves them, beginnings that are a whole R1.
IRREGULAR = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli",
    "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
STAY = "inning outing canning herring earring proceed exceed succeed".split()
BEGINNINGS = "gener commun arsen".split()
# Fixed values of the algorithm: suffixes of the steps 2 and 3 (in R1) and 4 (in R2), and what stands in their place.
STEP2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate",
    "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble",
    "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
STEP3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
STEP4 = "al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize ion".split()

REGION = re.compile(r"[^aeiouy]*[aeiouy]+[^aeiouy]")
SHORT = re.compile(r"(?:[^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$")
VOWEL = re.compile(r"[aeiouy]")
DOUBLE = re.compile(r"(bb|dd|ff|gg|mm|nn|pp|rr|tt)$")


def _suffix(word: str, suffixes) -> str:
    """The longest of the suffixes that word ends in."""
    return max((s for s in suffixes if word.endswith(s)), key=len, default="")


def _plural(word: str) -> str:
    if word.endswith("sses"):
        return word[:-2]
    if word.endswith(("ied", "ies")):
        return word[:-2] if len(word) > 4 else word[:-1]
    if word.endswith("s") and not word.endswith(("us", "ss")) and VOWEL.search(word[:-2]):
        return word[:-1]
    return word


def _participle(word: str, r1: int) -> str:
    suffix = _suffix(word, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    base = word[: len(word) - len(suffix)]
    if suffix.startswith("eed"):
        return base + "ee" if len(base) >= r1 else word
    if not suffix or not VOWEL.search(base):
        return word
    if base.endswith(("at", "bl", "iz")):
        return base + "e"
    if DOUBLE.search(base):
        return base[:-1]
    return base + "e" if SHORT.search(base) and r1 >= len(base) else base


def stem(word: str) -> str:
    """The stem of a lower-case word; words of up to two letters stay."""
    if len(word) <= 2:
        return word
    word = word.removeprefix("'")
    if word in IRREGULAR:
        return IRREGULAR[word]
    word = re.sub(r"([aeiouy])y", r"\1Y", re.sub(r"^y", "Y", word))
    begun = next((b for b in BEGINNINGS if word.startswith(b)), None)
    first = len(begun) if begun else (m.end() if (m := REGION.match(word)) else len(word))
    second = m.end() if (m := REGION.match(word, first)) else len(word)
    word = _plural(word[: len(word) - len(_suffix(word, ("'", "'s", "'s'")))])
    if word in STAY:
        return word
    word = _participle(word, first)
    if len(word) > 2 and word[-1] in "yY" and not VOWEL.match(word[-2]):
        word = word[:-1] + "i"
    base = word[: len(word) - len(suffix := _suffix(word, STEP2))]
    if suffix and len(base) >= first and (suffix != "ogi" or base.endswith("l")) and (suffix != "li" or base[-1:] in tuple("cdeghkmnrt")):
        word = base + STEP2[suffix]
    base = word[: len(word) - len(suffix := _suffix(word, STEP3))]
    if suffix and len(base) >= (second if suffix == "ative" else first):
        word = base + STEP3[suffix]
    base = word[: len(word) - len(suffix := _suffix(word, STEP4))]
    if suffix and len(base) >= second and (suffix != "ion" or base.endswith(("s", "t"))):
        word = base
    base = word[:-1]
    if word.endswith("e") and (len(base) >= second or len(base) >= first and not SHORT.search(base)) or word.endswith("ll") and len(base) >= second:
        word = base
    return word.lower()


def stems(words: DataFrame, col: str = "lexeme") -> DataFrame:
    """(col, stem) for each distinct word of a column; null has none."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([stem(w) for w in batch.column(0).to_pylist()], pa.string())], names=[col, "stem"])

    return words.select(col).filter(f"{col} is not null").distinct().mapInArrow(run, f"{col} string, stem string")
