"""Text as Column expressions: normalisation, n-grams, tokens, formats."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: What str.strip and str.split take for white space (fixed values).
SPACES = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
#: Longest token sequence that order-aware models read.
MAX_TOKENS = 40


def clean(c: Column) -> Column:
    """Stripped and lower-cased."""
    return F.lower(F.btrim(c, F.lit(SPACES)))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, also where lambdas in the body use it again and again."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _runs(items: Column, n: int, joiner: str) -> Column:
    """All runs of 1 to n items of an array, joined."""

    def of(k: int) -> Column:
        if k == 1:
            return items
        return F.when(F.size(items) >= k, F.transform(F.sequence(F.lit(1), F.size(items) - (k - 1)), lambda i: F.concat_ws(joiner, *[F.get(items, i + (j - 1)) for j in range(k)]))).otherwise(F.array().cast("array<string>"))

    return F.flatten(F.array(*[of(k) for k in range(1, n + 1)]))


def char_ngrams(c: Column, n: int = 2) -> Column:
    """The set of all substrings of 1 to n characters; the empty string has none."""
    return F.when(c == "", F.array().cast("array<string>")).otherwise(let(F.split(c, ""), lambda chars: F.array_distinct(_runs(chars, n, ""))))


def words(c: Column) -> Column:
    """Runs of other characters than white space, lower-cased, in order."""
    return F.filter(F.split(F.lower(c), f"[{SPACES}]+"), lambda w: w != "")


def hybrid_tokens(c: Column, n: int = 2, tokenizer: Callable[[Column], Column] = words) -> Column:
    """Tokens of a place: 1- to n-grams of its first two comma-separated fields, and the tokenizer's words of every field."""
    fields = F.split(F.lower(c), ",")
    both = F.array_union(char_ngrams(F.trim(F.get(fields, F.lit(0))), n), F.coalesce(char_ngrams(F.trim(F.get(fields, F.lit(1))), n), F.array().cast("array<string>")))
    return F.array_union(both, F.array_distinct(F.flatten(F.transform(fields, tokenizer))))


def query_tokens(c: Column, n: int = 2, tokenizer: Callable[[Column], Column] = words) -> Column:
    """Tokens of a query: 1- to n-grams of the whole text and the tokenizer's words."""
    return F.array_union(char_ngrams(clean(c), n), F.array_distinct(tokenizer(c)))


def truncated(tokens: Column, most: int = MAX_TOKENS) -> Column:
    return F.slice(tokens, 1, most)


def regex_tokens(c: Column) -> Column:
    """Runs of letters, digits and marks, or single other visible characters."""
    return F.regexp_extract_all(c, F.lit(r"[\p{L}\p{N}\p{M}]+|[^\p{Z}\p{C}]"), F.lit(0))


def word_ngrams(tokens: Column, n: int, lower: bool = True) -> Column:
    """All runs of 1 to n tokens, joined by a space."""
    return let(F.transform(tokens, F.lower) if lower else tokens, lambda t: _runs(t, n, " "))


def token_offsets(c: Column) -> Column:
    """(token, start, end) of the regex tokens, in characters from 0; in one pass over each text, in Arrow batches."""

    @F.pandas_udf("array<struct<token:string,start:int,end:int>>")
    def of(texts: pd.Series) -> pd.Series:
        import regex

        found = regex.compile(r"[\p{L}\p{N}\p{M}]+|[^\p{Z}\p{C}]")
        return texts.map(lambda t: None if t is None else [{"token": m[0], "start": m.start(), "end": m.end()} for m in found.finditer(t)])

    return of(c)


def entity_groups(tagged: Column, outside: str = "O") -> Column:
    """Runs of equal tags other than `outside` in an array of (token, tag): (text, tag).

    A run begins where the tag differs from the one before; each begin takes the tokens up to the next change."""
    n = F.size(tagged)
    at = F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)))
    tag = lambda i: F.get(tagged, i)["tag"]
    changes = F.filter(at, lambda i: (n > 0) & ((i == 0) | ~F.equal_null(tag(i), tag(i - 1))))
    ends = F.concat(F.slice(changes, F.lit(2), F.greatest(F.size(changes) - 1, F.lit(0))), F.array(n))
    runs = F.filter(F.transform(changes, lambda a, i: F.struct(a.alias("a"), F.get(ends, i).alias("b"))), lambda r: tag(r["a"]) != outside)
    return F.transform(runs, lambda r: F.struct(F.array_join(F.transform(F.slice(tagged, r["a"] + 1, r["b"] - r["a"]), lambda t: t["token"]), " ").alias("text"), tag(r["a"]).alias("tag")))


def normal_document(c: Column) -> Column:
    """New lines to spaces, curly apostrophes to straight ones, one pair of enclosing quotes dropped."""
    c = F.replace(F.replace(c, F.lit("\n"), F.lit(" ")), F.lit("’"), F.lit("'"))
    c = F.when(c.startswith('"'), F.substring(c, F.lit(2), F.length(c))).otherwise(c)
    return F.when(c.endswith('"'), F.substring(c, F.lit(1), F.length(c) - 1)).otherwise(c)


def normal_question(c: Column) -> Column:
    return F.replace(c, F.lit("’"), F.lit("'"))


def truth_list(c: Column) -> Column:
    """Comma-separated ids; null or empty: none."""
    return F.when(F.coalesce(F.trim(c), F.lit("")) == "", F.array().cast("array<long>")).otherwise(F.transform(F.split(c, ","), lambda t: F.trim(t).cast("long")))


def duration(seconds: Column) -> Column:
    """As 1h02m03.45s."""
    return F.format_string("%dh%02dm%05.2fs", F.floor(seconds / 3600), F.floor(F.pmod(seconds, F.lit(3600)) / 60), F.pmod(seconds, F.lit(60)))
