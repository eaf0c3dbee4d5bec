"""English full text: words, stop words, and the Porter2 stemmer, as expressions over arrays of words.

Each step of the stemmer is one transform of the array, so that a step's result is named once and used as often as its
rules ask; a word travels as (w, r1, r2, before): its letters, where its two regions begin, and what it was before verbs' endings went.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The stop words of English full-text search.
STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves "
    "what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and but if or because as until while of at by for with "
    "about against between into through during before after above below to from up down in out on off over under again further then once here there when where why how all any both each "
    "few more most other some such no nor not only own same so than too very s t can will just don should now"
).split()

# Fixed values of the Porter2 algorithm: words with stems of their own, words that stay, beginnings that are the first region's end.
EXCEPTIONS = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
STAY_AFTER_PLURALS = ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed")
BEGINNINGS = ("gener", "commun", "arsen")
# Suffixes of the second and third step with what they become, and those of the fourth, which go.
STEP_2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate",
    "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble",
    "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
STEP_3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion")
LI_ENDINGS, DOUBLES = "cdeghkmnrt", "bb|dd|ff|gg|mm|nn|pp|rr|tt"
#: A short syllable at the end: a vowel between two consonants, the last none of w, x, Y; or a vowel that begins the word and a consonant.
SHORT = "(?:[^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$"


def words(text: Column) -> Column:
    """Runs of letters, digits and inner apostrophes, in lower case; null for null."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+(?:'[\p{L}\p{N}]+)*"), F.lit(0))


def tokens(text: Column) -> Column:
    """Stems of a text's words without stop words, in order, repetitions included; empty for null."""
    kept = F.filter(words(text), lambda w: ~w.isin(*STOP_WORDS))
    return F.coalesce(F.filter(stems(kept), lambda s: s != ""), F.array().cast("array<string>"))


def stems(each: Column) -> Column:
    """Porter2 stems of an array of lower-case words."""
    begun = F.transform(each, lambda w: F.regexp_replace(F.regexp_replace(w, "^'", ""), "(^|[aeiouy])y", "$1Y"))
    first = F.transform(begun, lambda w: F.struct(w.alias("w"), _first_region(w).alias("r1")))
    located = F.transform(first, lambda s: F.struct(s["w"].alias("w"), s["r1"].alias("r1"), (s["r1"] + _region(F.substr(s["w"], s["r1"] + 1))).alias("r2"), _plurals(s["w"]).alias("before")))
    verbs = _each(located, lambda s: F.when(s["before"].isin(*STAY_AFTER_PLURALS), s["before"]).otherwise(_verbs(s)))
    stem = _each(verbs, _tidied)
    for step in (lambda s: F.regexp_replace(s["w"], "(?<=.[^aeiouy])[yY]$", "i"), _step_2, _step_3, _step_4, _step_5):
        stem = _each(stem, step)
    table = F.create_map(*(F.lit(x) for kv in EXCEPTIONS.items() for x in kv))
    stays = lambda s: F.when(s["before"].isin(*STAY_AFTER_PLURALS), s["before"])
    return F.zip_with(each, stem, lambda w, s: F.when(F.length(w) <= 2, w).otherwise(F.coalesce(F.try_element_at(table, w), stays(s), F.translate(s["w"], "Y", "y"))))


def _each(states: Column, step) -> Column:
    return F.transform(states, lambda s: F.struct(step(s).alias("w"), s["r1"].alias("r1"), s["r2"].alias("r2"), s["before"].alias("before")))


def _region(w: Column) -> Column:
    """Letters up to and with the first consonant after a vowel; all, if there is none."""
    found = F.length(F.regexp_extract(w, "^.*?[aeiouy][^aeiouy]", 0))
    return F.when(found > 0, found).otherwise(F.length(w))


def _first_region(w: Column) -> Column:
    told = F.length(F.regexp_extract(w, f"^(?:{'|'.join(BEGINNINGS)})", 0))
    return F.when(told > 0, told).otherwise(_region(w))


def _suffix(w: Column, suffixes) -> Column:
    """The longest of the suffixes that the word ends with, or nothing: a pattern's first match begins furthest left."""
    return F.regexp_extract(w, f"(?:{'|'.join(suffixes)})$", 0)


def _cut(w: Column, n: Column) -> Column:
    return F.substr(w, F.lit(1), F.length(w) - n)


def _plurals(w: Column) -> Column:
    """Steps 0 and 1a: possessives and plurals."""
    w = F.regexp_replace(w, "(?:'s'|'s|')$", "")
    return (
        F.when(F.endswith(w, F.lit("sses")), _cut(w, F.lit(2)))
        .when(w.rlike("^.{2,}ie[ds]$"), _cut(w, F.lit(2)))
        .when(w.rlike("ie[ds]$"), _cut(w, F.lit(1)))
        .when(w.rlike("(?:us|ss)$"), w)
        .when(w.rlike("[aeiouy].+s$"), _cut(w, F.lit(1)))
        .otherwise(w)
    )


def _verbs(s: Column) -> Column:
    """Step 1b without its second half: eed, ed, ing and their adverbs."""
    w, end = s["before"], _suffix(s["before"], ("eedly", "ingly", "edly", "eed", "ing", "ed"))
    inside = F.length(w) - F.length(end) >= s["r1"]
    return (
        F.when(end.isin("eed", "eedly"), F.when(inside, F.concat(_cut(w, F.length(end)), F.lit("ee"))).otherwise(w))
        .when((end != "") & _cut(w, F.length(end)).rlike("[aeiouy]"), _cut(w, F.length(end)))
        .otherwise(w)
    )


def _tidied(s: Column) -> Column:
    """The second half of step 1b, for words from which ed or ing has gone: an e that was lost, a letter that was doubled."""
    w, before = s["w"], s["before"]
    gone = (w != before) & ~before.rlike("eed(?:ly)?$")
    short = (F.length(w) <= s["r1"]) & w.rlike(SHORT)
    return F.when(~gone, w).when(w.rlike("(?:at|bl|iz)$"), F.concat(w, F.lit("e"))).when(w.rlike(f"(?:{DOUBLES})$"), _cut(w, F.lit(1))).when(short, F.concat(w, F.lit("e"))).otherwise(w)


def _replaced(s: Column, table: dict[str, str], allowed) -> Column:
    end = _suffix(s["w"], table)
    ends = F.create_map(*(F.lit(x) for kv in table.items() for x in kv))
    stem = _cut(s["w"], F.length(end))
    inside = F.length(stem) >= s["r1"]
    return F.when((end != "") & inside & allowed(end, stem), F.concat(stem, F.try_element_at(ends, end))).otherwise(s["w"])


def _step_2(s: Column) -> Column:
    return _replaced(s, STEP_2, lambda end, stem: F.when(end == "ogi", F.endswith(stem, F.lit("l"))).when(end == "li", stem.rlike(f"[{LI_ENDINGS}]$")).otherwise(F.lit(True)))


def _step_3(s: Column) -> Column:
    return _replaced(s, STEP_3, lambda end, stem: (end != "ative") | (F.length(stem) >= s["r2"]))


def _step_4(s: Column) -> Column:
    end = _suffix(s["w"], STEP_4)
    stem = _cut(s["w"], F.length(end))
    goes = (end != "") & (F.length(stem) >= s["r2"]) & ((end != "ion") | stem.rlike("[st]$"))
    return F.when(goes, stem).otherwise(s["w"])


def _step_5(s: Column) -> Column:
    stem = _cut(s["w"], F.lit(1))
    second, first = F.length(stem) >= s["r2"], F.length(stem) >= s["r1"]
    e = F.endswith(s["w"], F.lit("e")) & (second | (first & ~stem.rlike(SHORT)))
    double = F.endswith(s["w"], F.lit("ll")) & second
    return F.when(e | double, stem).otherwise(s["w"])
