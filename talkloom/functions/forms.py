"""Unicode forms, word classes and aggregates that need Python's tables: Arrow batches, never row by row."""

from __future__ import annotations

import functools
import unicodedata

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from talkloom.functions import text as X

# fixed values: word endings of spoken and standard Czech that count as the same
REGISTER = [("ý", "ej"), ("í", "ej"), ("ého", "ýho"), ("ému", "ýmu"), ("ými", "ýma"), ("ími", "ejma"), ("ají", "aj"), ("ejí", "ej"), ("ít", "ejt"), ("é", "ý")]
# fixed values: Czech function words
FUNCTION_WORDS = ["a", "ale", "i", "to", "tu", "ten", "ta", "te", "se", "si", "je", "no", "jo", "že", "jak", "tak", "jako", "by", "v", "u", "na", "o", "s", "z", "já", "ty", "on", "ono", "vono", "co", "když", "už", "ještě", "tam", "teď", "tady", "ok"]


def _each(f):
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else f(x))

    return F.pandas_udf(run, "string")


def nfc(text) -> Column:
    """Composed form."""
    return _each(lambda x: unicodedata.normalize("NFC", x))(text)


def unmarked(x: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", x) if not unicodedata.combining(c))


def bare(text) -> Column:
    """Decomposed, without combining marks."""
    return _each(unmarked)(text)


def ascii_only(text) -> Column:
    """Compatibility form, reduced to ASCII."""
    return _each(lambda x: unicodedata.normalize("NFKD", x).encode("ascii", "ignore").decode("ascii"))(text)


def slug(text) -> Column:
    """File-name form of any text."""
    return X.slug(ascii_only(text))


def equivalence(a: Column, b: Column) -> Column:
    """identical, diacritic (but for marks), register (an ending of REGISTER swapped, two letters of stem), function (both
    function words), inflection (five letters in common, ratio 0.8) or different; null if a word is."""
    swap = F.lit(False)
    for x, y in REGISTER:
        for p, q in ((x, y), (y, x)):
            stem = F.length(a) - len(p)
            swap = swap | (a.endswith(p) & b.endswith(q) & (stem >= 2) & (F.substr(a, F.lit(1), stem) == F.substr(b, F.lit(1), F.length(b) - len(q))))
    close = (F.least(F.length(a), F.length(b)) >= 5) & (F.substring(a, 1, 5) == F.substring(b, 1, 5)) & (X.similarity(a, b) >= 0.8)
    kind = F.when(a == b, "identical").when(bare(a) == bare(b), "diacritic").when(swap, "register").when(a.isin(FUNCTION_WORDS) & b.isin(FUNCTION_WORDS), "function")
    return F.when(a.isNotNull() & b.isNotNull(), kind.when(close, "inflection").otherwise("different"))


@functools.lru_cache(100_000)
def same_word(a: str, b: str) -> bool:
    """equivalence(a, b) is not different, for two words."""
    ends = any(len(a) - len(p) >= 2 and a.endswith(p) and b.endswith(q) and a[: -len(p)] == b[: -len(q)] for pair in REGISTER for p, q in (pair, pair[::-1]))
    alike = min(len(a), len(b)) >= 5 and a[:5] == b[:5] and X.ratio(a, b) >= 0.8
    return ends or alike or {a, b} <= set(FUNCTION_WORDS) or unmarked(a) == unmarked(b)


def _same(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else x == y or same_word(x, y) for x, y in zip(a, b, strict=True)], dtype="object")


def same(a: Column, b: Column) -> Column:
    """Whether two readings count as one word; null if a word is."""
    return F.pandas_udf(_same, "boolean")(a, b)


def substantive(a: Column, b: Column) -> Column:
    """Whether two readings of a word differ by more than filler or spelling."""
    filler = (a.isin(FUNCTION_WORDS) & b.isin(FUNCTION_WORDS)) | ((F.length(a) < 4) & (F.length(b) < 4))
    return ~filler & (X.similarity(a, b) < 0.7)


def _upper(x: pd.Series) -> float:
    return float(x.sort_values().iloc[len(x) // 2])


def upper_median(x) -> Column:
    """Grouped aggregate: of an even number of values, the higher middle one."""
    return F.pandas_udf(_upper, "double")(x)


class LoopGrams:
    """Table function: the n-grams of a text at stride n, for n of 1 to 5: (n, gram, copies)."""

    def eval(self, text: str):
        words = (text or "").split()
        for n in range(1, 6):
            grams: dict[str, int] = {}
            for i in range(0, len(words) - n + 1, n):
                g = " ".join(words[i : i + n])
                grams[g] = grams.get(g, 0) + 1
            for g, c in grams.items():
                if c > 1:
                    yield n, g, c


def register(spark: SparkSession) -> None:
    """Makes similarity_ratio, upper_median and the table function loop_grams known to SQL."""
    spark.udf.register("similarity_ratio", F.pandas_udf(X._ratios, "double"))
    spark.udf.register("upper_median", F.pandas_udf(_upper, "double"))
    spark.udtf.register("loop_grams", F.udtf(LoopGrams, returnType="n int, gram string, copies int"))
