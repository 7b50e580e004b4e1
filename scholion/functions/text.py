"""Text columns: whitespace, tokens, lexemes, hashes. All stay inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The Unicode whitespace set, as the body of a regex character class.
WS = (
    r"\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
)
WS_CHARS = "".join(
    map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
              0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
)
# What lies between words; printable ASCII is ruled out first, by two comparisons.
GAP = f"(?![!-~])[{WS}]+"
LEXEME = r"[a-zA-Z0-9\p{L}\p{N}]+"  # ASCII is named too, as that is found in a table of bits
BETWEEN = r"[^a-zA-Z0-9\p{L}\p{N}]+"  # what is no part of a lexeme

# The stop words dropped from keyword search.
STOP_WORDS = """
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her
hers herself it its itself they them their theirs themselves what which who whom this that these
those am is are was were be been being have has had having do does did doing a an the and but if or
because as until while of at by for with about against between into through during before after
above below to from up down in out on off over under again further then once here there when where
why how all any both each few more most other some such no nor not only own same so than too very s
t can will just don should now
""".split()


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate value once and hand it to body, also inside higher-order functions."""
    return F.transform(F.array(value), body)[0]


def strip(c) -> Column:
    """Remove leading and trailing whitespace of every kind, not only blanks."""
    return F.btrim(c, F.lit(WS_CHARS))


def lines(c) -> Column:
    return F.split(c, "\n", -1)


def words(c) -> Column:
    """What lies between white space. Splitting a text takes a fraction of matching each of its words."""
    return F.array_remove(F.split(c, GAP, -1), "")


def word_count(c) -> Column:
    return F.size(words(c))


def squeeze(c) -> Column:
    """Whitespace runs become one blank."""
    return F.array_join(words(c), " ")


def capitalize(c: Column) -> Column:
    """First letter upper, all others lower (initcap would raise every word)."""
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substr(c, F.lit(2))))


def content_hash(c) -> Column:
    return F.sha2(c, 256)


def stable_id(*parts) -> Column:
    """An id that a retried task computes again to the same value."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def nullif_empty(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def quote_regex(c: Column) -> Column:
    """Escape every regex metacharacter of a column used as a pattern."""
    return F.regexp_replace(c, r"([.*+?^${}()|\[\]\\])", r"\\$1")


def singular(term: Column) -> Column:
    """The S-stemmer: plural -ies becomes -y, any other plural s is dropped.

    Plain string comparisons only, so the expression is cheap inside generated code.
    """
    n = F.length(term)
    stem = F.substr(term, F.lit(1), n - 1)
    return (
        F.when(~term.endswith("s"), term)
        .when(
            term.endswith("ies") & (n >= 4) & ~F.substr(term, F.lit(-4), F.lit(1)).isin("e", "a"),
            F.concat(F.substr(term, F.lit(1), n - 3), F.lit("y")),
        )
        .when((n >= 2) & ~F.substr(term, F.lit(-2), F.lit(1)).isin("u", "s"), stem)
        .otherwise(term)
    )


def singular_word(term: str) -> str:
    """singular() of one word, for tasks that hold words outside the JVM."""
    if not term.endswith("s"):
        return term
    if term.endswith("ies") and len(term) >= 4 and term[-4] not in "ea":
        return term[:-3] + "y"
    return term[:-1] if len(term) >= 2 and term[-2] not in "us" else term


def fold(term: Column, conf: str) -> Column:
    """What a configuration does to a single kept token."""
    return singular(term) if conf == "english" else term


def kept_tokens(c, conf: str = "english") -> Column:
    """Lower-cased word tokens without the stop words of the configuration, not yet folded."""
    if conf not in ("simple", "stop", "english", "stem"):
        raise ValueError(f"unknown text configuration {conf!r}")
    tokens = F.regexp_extract_all(F.lower(c), F.lit(LEXEME), F.lit(0))
    return tokens if conf == "simple" else F.filter(tokens, lambda t: ~t.isin(STOP_WORDS))


def lexemes(c, conf: str = "english") -> Column:
    """Lower-cased word tokens; 'stop' drops stop words, 'english' also folds plurals.

    'stem' needs a table of words (operators.vocabulary), so it cannot be had from a single column.
    """
    if conf == "stem":
        raise ValueError("stems are joined, see operators.vocabulary")
    kept = kept_tokens(c, conf)
    return F.transform(kept, lambda t: fold(t, conf)) if conf == "english" else kept


def trigrams(c) -> Column:
    """Distinct character trigrams of each word, padded with two blanks before and one after."""

    def of_word(w: Column) -> Column:
        padded = F.concat(F.lit("  "), w, F.lit(" "))
        return F.transform(
            F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substr(padded, i, F.lit(3))
        )

    return F.array_distinct(
        F.flatten(F.transform(lexemes(c, "simple"), of_word))
    )
