"""An English suffix stemmer as columns: the published Snowball English ("Porter 2") rules.

A word is cut by the longest suffix of each step that it ends with, if the suffix stands in the region
that the step asks for. r1 and r2 are the places behind the first and the second vowel group with a
consonant after it; they are found once per word. y is a consonant, written Y, at the start of a word
and after a vowel. Every step is a projection of its own, so nothing is evaluated twice, and all of it
is built-in string functions. It costs some microseconds a word, so it is meant for distinct words.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VOWELS = "aeiouy"

# Words with stems of their own, words that stay as they are, word beginnings that set r1.
IRREGULAR = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl",
    "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
}
UNCHANGED = "sky news howe atlas cosmos bias andes".split()
UNCHANGED_AFTER_PLURAL = "inning outing canning herring earring proceed exceed succeed".split()
BEGINNINGS = "gener commun arsen".split()


@dataclass(frozen=True)
class Rule:
    """suffix becomes ending if it starts at region or later and what precedes it matches before."""

    suffix: str
    ending: str = ""
    region: str = "r1"
    before: str | None = None


# The suffixes of steps 2 to 4 with their endings and conditions.
DERIVED = [
    Rule("tional", "tion"), Rule("enci", "ence"), Rule("anci", "ance"), Rule("abli", "able"),
    Rule("entli", "ent"), Rule("izer", "ize"), Rule("ization", "ize"), Rule("ational", "ate"),
    Rule("ation", "ate"), Rule("ator", "ate"), Rule("alism", "al"), Rule("aliti", "al"),
    Rule("alli", "al"), Rule("fulness", "ful"), Rule("ousli", "ous"), Rule("ousness", "ous"),
    Rule("iveness", "ive"), Rule("iviti", "ive"), Rule("biliti", "ble"), Rule("bli", "ble"),
    Rule("ogi", "og", before="l$"), Rule("fulli", "ful"), Rule("lessli", "less"),
    Rule("li", "", before="[cdeghkmnrt]$"),
]
RELATED = [
    Rule("tional", "tion"), Rule("ational", "ate"), Rule("alize", "al"), Rule("icate", "ic"),
    Rule("iciti", "ic"), Rule("ical", "ic"), Rule("ful"), Rule("ness"), Rule("ative", region="r2"),
]
PLAIN = [
    *[Rule(s, region="r2") for s in
      "al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize".split()],
    Rule("ion", region="r2", before="[st]$"),
]

VOWEL, OTHER = f"[{VOWELS}]", f"[^{VOWELS}]"
SHORT_END = f"({OTHER}{VOWEL}[^{VOWELS}wxY]|^{VOWEL}{OTHER})$"
DOUBLE_END = "(bb|dd|ff|gg|mm|nn|pp|rr|tt)$"


def _ends(word: Column, suffixes: str) -> Column:
    """The longest of the suffixes (separated by |) that the word ends with, or an empty text."""
    found = F.when(word.isNotNull(), "")
    for suffix in sorted(suffixes.split("|"), key=len):
        found = F.when(word.endswith(suffix), suffix).otherwise(found)
    return found


def _cut(word: Column, n: Column | int) -> Column:
    return F.substr(word, F.lit(1), F.length(word) - n)


def _step(words: DataFrame, rules: list[Rule]) -> DataFrame:
    """The rule of the longest suffix, or none."""
    found = words.withColumn("end", _ends(F.col("w"), "|".join(r.suffix for r in rules)))
    stem = _cut(F.col("w"), F.length("end"))
    changed = F.col("w")
    for rule in rules:
        fits = (F.col("end") == rule.suffix) & (F.length(stem) >= F.col(rule.region))
        if rule.before:
            fits &= stem.rlike(rule.before)
        changed = F.when(fits, F.concat(stem, F.lit(rule.ending))).otherwise(changed)
    return found.withColumn("w", changed)


def _regions(words: DataFrame) -> DataFrame:
    group = f"^{OTHER}*{VOWEL}+{OTHER}"
    first = F.length(F.regexp_extract("w", f"^(?:{'|'.join(BEGINNINGS)})", 0))
    behind = F.when(first > 0, first).otherwise(F.length(F.regexp_extract("w", group, 0)))
    size = F.length("w")
    words = words.withColumn("r1", F.when(behind > 0, behind).otherwise(size))
    rest = F.length(F.regexp_extract(F.substr("w", F.col("r1") + 1), group, 0))
    return words.withColumn("r2", F.when(rest > 0, F.col("r1") + rest).otherwise(size))


def _plurals(words: DataFrame) -> DataFrame:
    w = F.col("w")
    words = words.withColumn("end", _ends(w, "sses|ied|ies|us|ss|s"))
    end = F.col("end")
    ie = F.when(F.length("w") > 4, _cut(w, 2)).otherwise(_cut(w, 1))
    return words.withColumn(
        "w",
        F.when(end == "sses", _cut(w, 2))
        .when(end.isin("ied", "ies"), ie)
        .when((end == "s") & w.rlike(f"{VOWEL}.+s$"), _cut(w, 1))
        .otherwise(w),
    )


def _participles(words: DataFrame) -> DataFrame:
    w, end = F.col("w"), F.col("end")
    kept = F.when(w.isin(UNCHANGED_AFTER_PLURAL), w)
    words = words.withColumn("own", F.coalesce("own", kept)).withColumn("end", _ends(w, "eedly|eed|edly|ed|ingly|ing"))
    stem = _cut(w, F.length("end"))
    gone = (end != "") & ~end.isin("eed", "eedly") & stem.rlike(VOWEL)
    words = words.withColumn("gone", gone).withColumn(
        "w",
        F.when(F.col("gone"), stem)
        .when(end.isin("eed", "eedly") & (F.length(stem) >= F.col("r1")), F.concat(stem, F.lit("ee")))
        .otherwise(w),
    )
    short = (F.col("r1") >= F.length("w")) & w.rlike(SHORT_END)
    return words.withColumn(
        "w",
        F.when(~F.col("gone"), w)
        .when(w.rlike("(at|bl|iz)$"), F.concat(w, F.lit("e")))
        .when(w.rlike(DOUBLE_END), _cut(w, 1))
        .when(short, F.concat(w, F.lit("e")))
        .otherwise(w),
    )


def _last_letters(words: DataFrame) -> DataFrame:
    """A final e or l goes if enough of the word stands before it."""
    w = F.col("w")
    stem = _cut(w, 1)
    enough = (F.length(stem) >= F.col("r2")) | (F.length(stem) >= F.col("r1")) & ~stem.rlike(SHORT_END)
    return words.withColumn(
        "w",
        F.when(w.endswith("e") & enough, stem)
        .when(w.endswith("ll") & (F.length(stem) >= F.col("r2")), stem)
        .otherwise(w),
    )


def stems(words: DataFrame, column: str = "term", keep: tuple[str, ...] = ()) -> DataFrame:
    """(term, stem) of each row of words, and the columns to keep: lower-case words; null gives null, rows are kept.

    Words of up to two letters, and the listed ones, keep their own stem.
    """
    raw = F.col(f"`{column}`")
    listed = F.create_map(*[F.lit(x) for pair in IRREGULAR.items() for x in pair])
    own = F.when((F.length(raw) <= 2) | raw.isin(UNCHANGED), raw).otherwise(F.element_at(listed, raw))
    marked = F.regexp_replace(raw, f"(^|{VOWEL})y", "$1Y")
    rows = words.select(*keep, raw.alias("term"), own.alias("own"), marked.alias("w"))
    rows = _participles(_plurals(_regions(rows)))
    # A final y behind a consonant that is not the first letter.
    rows = rows.withColumn("w", F.regexp_replace("w", f"(.{OTHER})[yY]$", "$1i"))
    for rules in (DERIVED, RELATED, PLAIN):
        rows = _step(rows, rules)
    found = F.replace(F.col("w"), F.lit("Y"), F.lit("y"))
    return _last_letters(rows).select(*keep, "term", F.coalesce("own", found).alias("stem"))


# ---- the same rules for a single word ------------------------------------------------------

_GROUP, _SHORT, _VOWEL = re.compile(f"{OTHER}*{VOWEL}+{OTHER}"), re.compile(SHORT_END), re.compile(VOWEL)
_PLURAL, _BEGINNING = re.compile(f"{VOWEL}.+s$"), re.compile("|".join(BEGINNINGS))
_PARTICIPLES = ("eedly", "ingly", "edly", "eed", "ing", "ed")
_STEPS = [sorted(rules, key=lambda r: -len(r.suffix)) for rules in (DERIVED, RELATED, PLAIN)]
_SUFFIXES = [tuple(r.suffix for r in rules) for rules in _STEPS]
# A word with another last letter is its own stem.
_LAST = {s[-1] for s in ("s", "y", "e", "l", *_PARTICIPLES, *(s for found in _SUFFIXES for s in found), "ied")}


def _participle(w: str, r1: int) -> str:
    end = next(s for s in _PARTICIPLES if w.endswith(s))
    rest = w[: -len(end)]
    if end.startswith("eed"):
        return rest + "ee" if len(rest) >= r1 else w
    if not _VOWEL.search(rest):
        return w
    if rest.endswith(("at", "bl", "iz")):
        return rest + "e"
    if re.search(DOUBLE_END, rest):
        return rest[:-1]
    return rest + "e" if r1 >= len(rest) and _SHORT.search(rest) else rest


def stem(word: str) -> str:
    """The stem of one lower-case word, as stems() gives it; for tasks that hold words outside the JVM."""
    if len(word) <= 2 or word[-1] not in _LAST or word in UNCHANGED:
        return word
    if word in IRREGULAR:
        return IRREGULAR[word]
    w = re.sub(f"(^|{VOWEL})y", r"\1Y", word) if "y" in word else word
    behind = _BEGINNING.match(w) or _GROUP.match(w)
    r1 = behind.end() if behind else len(w)
    behind = _GROUP.match(w, r1)
    r2 = behind.end() if behind else len(w)
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and _PLURAL.search(w):
        w = w[:-1]
    if w in UNCHANGED_AFTER_PLURAL:
        return w
    if w.endswith(_PARTICIPLES):
        w = _participle(w, r1)
    if w.endswith(("y", "Y")):
        w = re.sub(f"(.{OTHER})[yY]$", r"\1i", w)
    for rules, suffixes in zip(_STEPS, _SUFFIXES, strict=True):
        if w.endswith(suffixes):
            rule = next(r for r in rules if w.endswith(r.suffix))
            rest = w[: -len(rule.suffix)]
            if len(rest) >= (r1 if rule.region == "r1" else r2) and (not rule.before or re.search(rule.before, rest)):
                w = rest + rule.ending
    rest = w[:-1]
    if w.endswith("e"):
        w = rest if len(rest) >= r2 or len(rest) >= r1 and not _SHORT.search(rest) else w
    elif w.endswith("ll") and len(rest) >= r2:
        w = rest
    return w.replace("Y", "y")
