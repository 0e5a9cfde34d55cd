"""Text keys and similarities as column expressions; only Unicode normalization needs Python."""

from __future__ import annotations

import unicodedata

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

#: Legal suffixes of a name; legal and generic words that core names leave out; words without weight in a name key;
#: words that say nothing about a street.
SUFFIXES = "ltd limited pvt private llc llp inc incorporated corp corporation co company plc gmbh sarl sas sasu eurl sa enterprises enterprise group holdings holding industries international intl".split()
LEGAL = "private pvt limited ltd llc inc incorporated corp corporation co company the and llp plc sarl sas sa eurl enterprises enterprise services service".split()
STOP = "inc llc ltd pvt private limited co corp corporation company lp llp pllc plc sa sarl sas sasu eurl sci snc ei scop selarl cie the and of".split()
GENERIC = "street st road rd avenue ave av drive dr lane ln boulevard blvd bd rue route rte chemin impasse imp allee place pl court ct way unit suite ste apt floor fl flat bldg building office no north south east west the of and de la le des du bis ter near opp behind".split()


def _each(f):
    return F.pandas_udf(lambda x: x.map(lambda s: None if s is None else f(s)), StringType(), F.PandasUDFType.SCALAR)


def strip_accents(col: Column) -> Column:
    """NFKD without any combining mark."""
    return _each(lambda s: "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c)))(col)


_LATIN_MARKS = regex.compile(r"(?<=\p{Latin})\p{M}+")
_DROPPED = regex.compile(r"[^\p{L}\p{N}\p{M}\u200c\u200d]+")


def _normalize(s: str, fold: bool) -> str:
    text = unicodedata.normalize("NFKC", s).casefold()
    if fold:
        text = unicodedata.normalize("NFC", _LATIN_MARKS.sub("", unicodedata.normalize("NFD", text)))
    return _DROPPED.sub(" ", text.replace("&", " and ")).strip()


def normalize(col: Column, fold: bool = False) -> Column:
    """NFKC and casefold; letters, marks, digits and joiners stay; with fold, marks on Latin letters go."""
    return _each(lambda s: _normalize(s, fold))(col)


def clean_ascii(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.replace(c, F.lit("&"), F.lit(" and "))), "[^a-z0-9]+", " "))


def basic_clean(c: Column) -> Column:
    """Lower case without accents; apostrophes go, other marks become blanks. Only texts beyond ASCII meet Python."""
    plain = F.when(c.rlike("^[\\x00-\\x7f]*$"), F.lower(c)).otherwise(F.lower(strip_accents(F.lower(c))))
    return F.trim(F.regexp_replace(F.regexp_replace(plain, "['\u2019]", ""), r"(?U)[^\w]+", " "))


def tokens(c: Column) -> Column:
    return F.filter(F.split(c, " "), lambda w: w != "")


def core_tokens(c: Column) -> Column:
    return F.filter(tokens(c), lambda w: ~w.isin(*SUFFIXES) & (F.length(w) > 1))


def name_key(c: Column) -> Column:
    return F.array_join(F.array_sort(F.array_except(F.array_distinct(tokens(c)), F.array(*map(F.lit, STOP)))), " ")


def numbers(c: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(c, F.lit("[0-9]+"), F.lit(0))))


def grams(c: Column, low: int, high: int) -> Column:
    """Character n-grams of each word with a blank on both sides; a word shorter than n gives itself once."""

    def of(w, n):
        p = F.concat(F.lit(" "), w, F.lit(" "))
        return F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(p) - n + 1)), lambda i: F.substring(p, i, F.lit(n)))

    def all_words(n):
        return F.flatten(F.transform(tokens(c), lambda w: of(w, n)))

    return F.flatten(F.array(*map(all_words, range(low, high + 1))))


def number_shift(a: Column, b: Column, near: int = 21) -> Column:
    """How number b differs from a, both as digits: same, digit_drop (one begins or ends with the other), up_k, down_small, far."""
    up = b.cast("long") - a.cast("long")
    part = F.startswith(a, b) | F.startswith(b, a) | F.endswith(a, b) | F.endswith(b, a)
    return F.when(a == b, "same").when((F.length(a) != F.length(b)) & part, "digit_drop").when(up.between(1, near), F.concat(F.lit("up_"), up.cast("string"))).when(up.between(-near, -1), "down_small").otherwise("far")


def _jaro_winkler(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    taken, mine = [False] * len(b), []
    for i, ch in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == ch:
                taken[j] = True
                mine.append(ch)
                break
    if not mine:
        return 0.0
    m = len(mine)
    swapped = sum(x != y for x, y in zip(mine, (c for c, t in zip(b, taken, strict=True) if t), strict=True)) // 2
    jaro = (m / len(a) + m / len(b) + (m - swapped) / m) / 3
    same = next((i for i, (x, y) in enumerate(zip(a[:4], b[:4], strict=False)) if x != y), min(4, len(a), len(b)))
    return jaro + 0.1 * same * (1 - jaro) if jaro > 0.7 else jaro


def jaro_winkler(a: str, b: str) -> Column:
    return F.pandas_udf(lambda x, y: pd.Series([None if u is None or v is None else _jaro_winkler(u, v) for u, v in zip(x, y, strict=True)], dtype=float), DoubleType(), F.PandasUDFType.SCALAR)(a, b)


def name_relation(a: Column, b: Column) -> Column:
    """How the normalized name b differs from a, by the words that matter: the first case that holds."""
    words = lambda c: F.array_except(F.array_distinct(tokens(c)), F.array(*map(F.lit, STOP)))
    x, y = words(a), words(b)
    both = F.size(F.array_intersect(x, y))
    nx, ny = F.size(x), F.size(y)
    return (
        F.when(a == b, "exact").when((nx > 0) & (both == nx) & (nx == ny), "same_core").when(ny == 0, "only_legal").when((both == 0) & (ny == 1), "invented1").when(both == 0, "none_multi")
        .when((both == ny) & (ny < nx), "dropped_word").when((both == nx) & (nx < ny), "added_word").when((nx == ny) & (nx - both == 1), "swapped_word").otherwise("partial")
    )


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays without repeats; two empty ones give 0."""
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / both)


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda u, v: u.cast("double") * v.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def leet_key(c: Column) -> Column:
    return F.regexp_replace(F.translate(F.lower(c), "0134568@$", "oleasgbas"), "[^a-z]", "")


def _lcs(a: str, b: str) -> int:
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | 1 << i
    row, full = (1 << len(a)) - 1, (1 << len(a)) - 1
    for ch in b:
        u = row & where.get(ch, 0)
        row = ((row + u) | (row - u)) & full
    return len(a) - row.bit_count()


def indel_ratio(a: str, b: str) -> float:
    return 1.0 if not a and not b else 2.0 * _lcs(a, b) / (len(a) + len(b))


def token_set_ratio(a: str, b: str) -> float:
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, left, right = " ".join(sorted(x & y)), " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if both and (not left or not right):
        return 1.0
    one, two = f"{both} {left}".strip(), f"{both} {right}".strip()
    return max(indel_ratio(one, two), *([indel_ratio(both, one), indel_ratio(both, two)] if both else []))


def partial_ratio(a: str, b: str) -> float:
    short, long = sorted((a, b), key=len)
    if not short:
        return 0.0
    n = len(short)
    return max(indel_ratio(short, long[max(0, i) : i + n]) for i in range(1 - n, len(long)))


def pair(f, a, b) -> Column:
    """A similarity of two strings, -1 where a side is empty or null; run it over distinct pairs."""
    run = F.pandas_udf(lambda a, b: pd.Series([-1.0 if not x or not y else f(x, y) for x, y in zip(a, b, strict=True)]), DoubleType(), F.PandasUDFType.SCALAR)
    return run(a, b)


def ratio(a, b) -> Column:
    return pair(indel_ratio, a, b)


def token_set(a, b) -> Column:
    return pair(token_set_ratio, a, b)


def partial(a, b) -> Column:
    return pair(partial_ratio, a, b)


def token_sort(a, b) -> Column:
    return pair(lambda x, y: indel_ratio(" ".join(sorted(x.split())), " ".join(sorted(y.split()))), a, b)
