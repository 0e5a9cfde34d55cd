"""Blocking keys of names and addresses, as column expressions over cleaned text (tokens with single blanks between)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kinlink.functions.text import LEGAL, STOP, tokens

#: Sound rewrites in their order, and words that a sound key leaves out.
SOUNDS = (
    ("ksh", "ks"), ("x", "ks"), ("sch", "s"), ("sh", "s"), ("ph", "f"), ("ck", "k"), ("q", "k"), ("z", "j"), ("w", "v"),
    ("th", "t"), ("dh", "d"), ("bh", "b"), ("kh", "k"), ("gh", "g"), ("ch", "c"), ("ee", "i"), ("oo", "u"),
)
SOUND_STOP = "private pvt limited ltd llp llc inc and the co company".split()
#: French legal forms, words that introduce a unit, words that split an alias off, postal patterns.
FORMS = "sarl sas sasu eurl sci snc sa ei scop selarl".split()
UNIT = r"\b(?:unit|suite|ste|apt|fl|floor|flat|bldg|office)\s+(\w+)"
ALIAS = r"\b(?:dba|fka|aka|formerly)\b"
POSTAL = {"us": r"(?<!\d)\d{5}(?:-\d{4})?(?!\d)", "india": r"(?<!\d)[1-9]\d{5}(?!\d)", "france": r"(?<!\d)\d{5}(?!\d)"}


def _set(c: Column) -> Column:
    return F.array_sort(F.array_distinct(c))


def _plain(number: Column) -> Column:
    """Without zeros in front; zeros alone give one."""
    return F.regexp_replace(number, "^0+(?=[0-9])", "")


def number_tokens(c: Column) -> Column:
    return F.transform(F.filter(tokens(c), lambda w: w.rlike("^[0-9]+$")), _plain)


def is_word(w: Column, least: int = 3) -> Column:
    return (F.length(w) >= least) & ~w.rlike("[0-9]")


def anchors(c: Column) -> Column:
    """number|word for each number of a token and the nearest word within two tokens on either side, sorted; the
    word has three characters or more and no digit. Null gives null, no number or no word an empty array."""
    t = tokens(c)

    def nearest(i, step):
        return F.filter(F.transform(F.array(F.lit(step), F.lit(2 * step)), lambda k: F.when(i + k >= 0, F.get(t, i + k))), lambda w: w.isNotNull() & is_word(w))

    def of(w, i):
        words = F.concat(F.slice(nearest(i, -1), 1, 1), F.slice(nearest(i, 1), 1, 1))
        found = F.transform(F.regexp_extract_all(w, F.lit("[0-9]+"), F.lit(0)), _plain)
        return F.flatten(F.transform(found, lambda n: F.transform(words, lambda x: F.concat(n, F.lit("|"), x))))

    return _set(F.flatten(F.transform(t, of)))


def address_key(c: Column, words: int = 6) -> Column:
    """First number and the first sorted words of more than two characters; without a number the words alone."""
    return F.concat_ws("|", F.get(number_tokens(c), F.lit(0)), F.array_join(F.slice(_set(F.filter(tokens(c), lambda w: is_word(w))), 1, words), " "))


def squash(c: Column) -> Column:
    return F.array_join(F.filter(tokens(c), lambda w: ~w.isin(*STOP, "com", "www")), "")


def drop_legal(c: Column) -> Column:
    return F.array_join(F.filter(tokens(c), lambda w: ~w.isin(*LEGAL)), " ")


def unit_of(c: Column) -> Column:
    return F.regexp_extract(c, UNIT, 1)


def legal_forms(c: Column) -> Column:
    """French forms in a name; dots within are joined first."""
    return _set(F.array_intersect(tokens(F.regexp_replace(F.replace(F.lower(c), F.lit("."), F.lit("")), "[^a-z0-9]+", " ")), F.array(*map(F.lit, FORMS))))


def alias_parts(c: Column) -> Column:
    """The name before and after the first alias word; one part where there is none."""
    return F.transform(F.split(c, ALIAS, 2), lambda x: F.trim(x))


def postal_codes(c: Column, country: Column) -> Column:
    """Numbers of the country's postal shape, sorted; an empty array for other countries."""
    where, out = F.lower(F.trim(country)), F.array().cast("array<string>")
    for name, pattern in POSTAL.items():
        out = F.when(where == name, _set(F.regexp_extract_all(c, F.lit(pattern), F.lit(0)))).otherwise(out)
    return out


def folder_of(country: Column) -> Column:
    """A name for a partition folder: letters and digits, and eight digits of SHA-1 that keep names apart."""
    slug = F.regexp_replace(F.regexp_replace(country, "[^A-Za-z0-9]+", "_"), "^_+|_+$", "")
    return F.concat(F.when(slug == "", "x").otherwise(slug), F.lit("_"), F.substring(F.sha1(country), 1, 8))


def has_indic(c: Column) -> Column:
    return c.rlike("[ऀ-෿]")


def non_ascii_share(c: Column) -> Column:
    return F.when(F.length(c) == 0, 0.0).otherwise(F.length(F.regexp_replace(c, "[\\x00-\\x7F]", "")) / F.length(c))


def sound(w: Column) -> Column:
    """The sound skeleton of one Latin word: consonants after rewriting, a vowel in front as a."""
    for a, b in SOUNDS:
        w = F.replace(w, F.lit(a), F.lit(b))
    w = F.regexp_replace(F.regexp_replace(w, "c(?=[eiy])", "s"), "g(?=[ei])", "j")
    w = F.regexp_replace(F.replace(w, F.lit("c"), F.lit("k")), "^y(?=[aeiou])", "")
    w = F.regexp_replace(F.regexp_replace(w, "^[aeiou]", "a"), "(?<=.)[aeiouyh]", "")
    return F.regexp_replace(w, "(.)\\1+", "$1")


def sounds(c: Column) -> Column:
    return F.transform(F.filter(tokens(c), lambda w: ~w.isin(*SOUND_STOP) & ~w.rlike("^[0-9]+$")), sound)


def plain_grams(c: Column, low: int, high: int) -> Column:
    """Character n-grams across words; a text shorter than n has none."""

    def of(n):
        at = F.when(F.length(c) >= n, F.sequence(F.lit(1), F.length(c) - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.substring(c, i, F.lit(n)))

    return F.flatten(F.array(*map(of, range(low, high + 1))))


def number_prefix(a: Column, b: Column) -> Column:
    """1 if some number of a equals, begins or continues one of b, else 0; -1 where a side has none. a, b: arrays of strings."""
    meet = F.exists(a, lambda x: F.exists(b, lambda y: x.startswith(y) | y.startswith(x)))
    return F.when((F.size(a) < 1) | (F.size(b) < 1), -1.0).otherwise(meet.cast("double"))


#: The syllables that invented words are tiled from.
MORPHEMES = "arc aria avi belo brix calo cira delta dova drex ecto evo faye flux gild halo iri jax kelo kor lum lyra mira nex novi nyla onyx orbi pyra quo riza sol syn tavo umbra vantage veo vera vio wex xylo yuma zeta zeph".split()


def tiled(c: Column) -> Column:
    """Whether the letters of a one-word name are syllables throughout."""
    return F.regexp_replace(F.lower(c), "[^a-z]", "").rlike("^(" + "|".join(MORPHEMES) + ")+$")


def house(c: Column) -> Column:
    """The first number without leading zeros, with bis, ter or a letter behind it."""
    pattern = r"(?<![\d/])0*(\d+)(?:\s*(bis|ter|[a-h](?![a-z])))?"
    tail = F.regexp_extract(c, pattern, 2)
    return F.concat(F.regexp_extract(c, pattern, 1), F.when(tail == "b", "bis").when(tail == "t", "ter").otherwise(tail))
