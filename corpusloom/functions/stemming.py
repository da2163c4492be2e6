"""English stemming (the published Porter2 / Snowball algorithm) as Spark columns.

Every step of the algorithm is "find the longest listed ending, then apply its
rule if its guard holds". A step is therefore one table of endings turned into
one CASE expression. Steps are chained by binding each result to a lambda
variable, so the expression stays linear in size wherever Catalyst copies it,
and the whole stemmer runs in the JVM.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# Fixed values of the published algorithm.
VOWELS = "aeiouy"
IRREGULAR = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie",
    "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli",
    "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas",
    "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
SETTLED = ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed")
REGION_HEADS = ("gener", "commun", "arsen")
STEP_2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent",
    "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate",
    "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous",
    "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble",
    "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
STEP_3 = {
    "tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic",
    "ical": "ic", "ful": "", "ness": "", "ative": "",
}
STEP_4 = (
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent",
    "ism", "ate", "iti", "ous", "ive", "ize", "ion",
)
LI_ENDING = "[cdeghkmnrt]li$"
SHORT_SYLLABLE = f"(?:^[{VOWELS}][^{VOWELS}]|[^{VOWELS}][{VOWELS}][^{VOWELS}wxY])$"


def _bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once, whatever number of times it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _region(text: Column, pattern: str) -> Column:
    """Length of the part of ``text`` up to the end of ``pattern``, or all of it."""
    found = F.length(F.regexp_extract(text, pattern, 0))
    return F.when(found > 0, found).otherwise(F.length(text))


class _Word:
    """The word as far as the steps have come, with the starts of its regions 1 and 2."""

    def __init__(self, text: Column, r1: Column, r2: Column):
        self.text, self.r1, self.r2 = text, r1, r2

    def cut(self, n: int) -> Column:
        return F.substring(self.text, F.lit(1), F.length(self.text) - n)

    def within(self, region: Column, ending: str) -> Column:
        return F.length(self.text) - len(ending) >= region

    def when(self, guard: Column, replacement: Column) -> Column:
        return F.when(guard, replacement).otherwise(self.text)

    def step(self, rules: dict[str, Column]) -> Column:
        """The longest ending of ``rules`` the word has decides; its column is the new word."""
        word = self.text
        for ending in sorted(rules, key=len):
            word = F.when(self.text.endswith(ending), rules[ending]).otherwise(word)
        return word


def _possessive(w: _Word) -> Column:
    return F.regexp_replace(w.text, "('s'|'s|')$", "")


def _plural(w: _Word) -> Column:
    from_y = F.when(F.length(w.text) > 4, w.cut(2)).otherwise(w.cut(1))
    return w.step({
        "sses": w.cut(2), "ied": from_y, "ies": from_y, "us": w.text, "ss": w.text,
        "s": w.when(w.text.rlike(f"[{VOWELS}].+s$"), w.cut(1)),
    })


def _mended(rest: Column, r1: Column) -> Column:
    """What an -ed or -ing left behind may need an e back or lose a doubled letter."""
    return (
        F.when(rest.rlike("(at|bl|iz)$"), F.concat(rest, F.lit("e")))
        .when(rest.rlike("(bb|dd|ff|gg|mm|nn|pp|rr|tt)$"), F.substring(rest, F.lit(1), F.length(rest) - 1))
        .when(rest.rlike(SHORT_SYLLABLE) & (F.length(rest) <= r1), F.concat(rest, F.lit("e")))
        .otherwise(rest)
    )


def _past(w: _Word) -> Column:
    def drop(ending: str) -> Column:
        return w.when(
            w.text.rlike(f"[{VOWELS}].*{ending}$"),
            _bind(w.cut(len(ending)), lambda rest: _mended(rest, w.r1)),
        )

    return w.step({
        "eed": w.when(w.within(w.r1, "eed"), w.cut(1)),
        "eedly": w.when(w.within(w.r1, "eedly"), w.cut(3)),
        **{ending: drop(ending) for ending in ("ed", "edly", "ing", "ingly")},
    })


def _final_y(w: _Word) -> Column:
    return F.regexp_replace(w.text, f"(.[^{VOWELS}])[yY]$", "$1i")


def _derived(w: _Word) -> Column:
    rules = {
        ending: w.when(w.within(w.r1, ending), F.concat(w.cut(len(ending)), F.lit(repl)))
        for ending, repl in STEP_2.items()
    }
    rules["ogi"] = w.when(w.within(w.r1, "ogi") & w.text.endswith("logi"), w.cut(1))
    rules["li"] = w.when(w.within(w.r1, "li") & w.text.rlike(LI_ENDING), w.cut(2))
    return w.step(rules)


def _derived_again(w: _Word) -> Column:
    rules = {
        ending: w.when(w.within(w.r1, ending), F.concat(w.cut(len(ending)), F.lit(repl)))
        for ending, repl in STEP_3.items()
    }
    rules["ative"] = w.when(w.within(w.r2, "ative"), w.cut(5))
    return w.step(rules)


def _residual(w: _Word) -> Column:
    rules = {ending: w.when(w.within(w.r2, ending), w.cut(len(ending))) for ending in STEP_4}
    rules["ion"] = w.when(w.within(w.r2, "ion") & w.text.rlike("[st]ion$"), w.cut(3))
    return w.step(rules)


def _final_e_or_l(w: _Word) -> Column:
    short = w.cut(1).rlike(SHORT_SYLLABLE)
    return w.step({
        "e": w.when(w.within(w.r2, "e") | (w.within(w.r1, "e") & ~short), w.cut(1)),
        "l": w.when(w.within(w.r2, "l") & w.text.endswith("ll"), w.cut(1)),
    })


def _steps(text: Column, r1: Column, r2: Column, steps: list[Callable[[_Word], Column]]) -> Column:
    if not steps:
        return text
    first, *rest = steps
    return _bind(first(_Word(text, r1, r2)), lambda t: _steps(t, r1, r2, rest))


def stem(column: str) -> Column:
    """Stem of the words in a column; words of one or two letters are their own stem."""
    return _stem(column, SparkSession.active().sparkContext.applicationId)


@lru_cache(maxsize=32)
def _stem(column: str, application: str) -> Column:
    """Building the expression takes a few thousand calls into the JVM, so it is kept for the
    life of the application."""
    word = F.col(column)
    heads = "|".join(REGION_HEADS)
    syllable = f".*?[{VOWELS}][^{VOWELS}]"
    irregular = F.create_map(*[F.lit(x) for pair in IRREGULAR.items() for x in pair])

    def from_regions(text: Column, r1: Column, r2: Column) -> Column:
        singular = _steps(text, r1, r2, [_possessive, _plural])
        full = [_past, _final_y, _derived, _derived_again, _residual, _final_e_or_l]
        return _bind(singular, lambda s: F.when(s.isin(*SETTLED), s).otherwise(_steps(s, r1, r2, full)))

    def from_text(text: Column) -> Column:
        r1 = _region(text, f"^(?:{heads}|{syllable})")
        return _bind(r1, lambda r1: _bind(
            r1 + _region(F.substring(text, r1 + 1, F.length(text)), f"^{syllable}"),
            lambda r2: from_regions(text, r1, r2),
        ))

    marked = F.regexp_replace(F.regexp_replace(word, "^'", ""), f"(^|[{VOWELS}])y", "$1Y")
    return (
        F.when(F.length(word) <= 2, word)
        .when(F.map_contains_key(irregular, word), irregular[word])
        .otherwise(F.translate(_bind(marked, from_text), "Y", "y"))
    )
