"""Scalar text functions as column expressions. Python is used only where no built-in exists (NFKC, case folding, difflib)."""

from __future__ import annotations

import difflib
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

#: White space as the data's producers define it, spelt so that Java and RE2 agree.
WS = r"[\t-\r\x1c-\x1f\x{85}\p{Z}]"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{WS}+|{WS}+$", "")


def blank_as_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def first_text(*columns: Column) -> Column:
    """The first that is neither null nor empty; '' if there is none."""
    return F.coalesce(*map(blank_as_null, columns), F.lit(""))


@F.pandas_udf(StringType())
def nfkc(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for part in parts:
        yield part.map(lambda s: s if s.isascii() else unicodedata.normalize("NFKC", s), na_action="ignore")


@F.pandas_udf(StringType())
def casefold(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for part in parts:
        yield part.map(str.casefold, na_action="ignore")


def clean_text(text: Column, version: str = "v0.7", compatibility: bool = True) -> Column:
    """Cleaned text. v0.7 deletes carriage returns and keeps tabs; v0.6 turns both into single spaces.

    Null counts as empty. Without ``compatibility`` the NFKC step is left out and the expression stays in the JVM.
    """
    out = F.coalesce(text, F.lit(""))
    out = F.replace(nfkc(out) if compatibility else out, F.lit("\x00"), F.lit(" "))
    if version == "v0.7":
        return strip(F.regexp_replace(F.regexp_replace(out, r"[\r\f\x0b]+", ""), r"\n{4,}", "\n\n\n"))
    if version == "v0.6":
        return strip(F.regexp_replace(F.regexp_replace(F.regexp_replace(out, r"[\t\r\f\x0b]+", " "), r"\n{3,}", "\n\n"), r" {2,}", " "))
    return strip(out)


def one_line(text: Column, compatibility: bool = True) -> Column:
    """The text on one line with single spaces."""
    out = F.coalesce(text, F.lit(""))
    out = F.translate(nfkc(out) if compatibility else out, "\x00\r\f\x0b", " ")  # the first becomes a blank, the others go
    return F.trim(F.regexp_replace(out, rf"{WS}+", " "))


def utf8_prefix(text: Column, n: Column | int) -> Column:
    """The longest prefix of whole characters within n bytes of UTF-8."""
    cut = F.make_valid_utf8(F.substring(F.encode(text, "utf-8"), F.lit(1), n if isinstance(n, Column) else F.lit(n)).cast("string"))
    return F.when(F.octet_length(text) <= n, text).otherwise(F.regexp_replace(cut, "\ufffd+$", ""))


def content_digest(text: Column, prefix: int | None = None) -> Column:
    """Digest by which equal texts are told: of the whole text or of so many first characters."""
    return F.md5((F.substring(text, 1, prefix) if prefix else text).cast("binary"))


def coder_document(source: Column, instruction: Column, code: Column, default: str = "Explain, complete, test, or improve the following code.") -> Column:
    instruction = F.coalesce(blank_as_null(instruction), F.lit(default))
    return F.concat(F.lit("<source>"), source, F.lit("</source>\n<instruction>"), instruction, F.lit("</instruction>\n<code>\n"), code, F.lit("\n</code>"))


def strip_wrapped(text: Column, left: str, right: str) -> Column:
    """The text without both wrappers, if it has both."""
    inner = F.substring(text, F.lit(len(left) + 1), F.length(text) - len(left) - len(right))
    return F.when(text.startswith(left) & text.endswith(right) & (F.length(text) >= len(left) + len(right)), strip(inner)).otherwise(text)


#: Letters that words are made of when answers are compared with their sources.
WORD_LETTERS = "0-9A-Za-zÇĞİÖŞÜçğıöşü"


def normalized_words(text: Column) -> Column:
    lower = F.lower(F.coalesce(text, F.lit("")))
    return F.trim(F.regexp_replace(F.regexp_replace(lower, rf"[^{WORD_LETTERS}]+", " "), " +", " "))


@F.pandas_udf(DoubleType())
def copy_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp ratio of two normalised texts; 0 if one is empty."""
    ratio = lambda x, y: difflib.SequenceMatcher(None, x, y).ratio() if x and y else 0.0
    return pd.Series([ratio(x, y) for x, y in zip(a, b)])


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, also where the body uses it inside another function."""
    return F.transform(F.array(value), body)[0]


def shingles(words: Column, n: int) -> Column:
    """Distinct runs of n words of a text of words set apart by single spaces; none if it is shorter."""

    def of(w: Column) -> Column:
        last = F.size(w) - n + 1
        return F.when(last >= 1, F.transform(F.sequence(F.lit(1), last), lambda i: F.concat_ws(" ", F.slice(w, i, n)))).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(let(F.filter(F.split(words, " "), lambda x: x != ""), of))


def has_verbatim_overlap(a: Column, b: Column, n: int = 9) -> Column:
    return F.arrays_overlap(shingles(normalized_words(a), n), shingles(normalized_words(b), n))


def is_copy(source: Column, answer: Column, n: int = 9, most: float = 0.88) -> Column:
    """The answer repeats its source: a shared run of n words or a high similarity. Short answers are exempt."""
    x, y = normalized_words(source), normalized_words(answer)
    return (F.length(y) >= 18) & (has_verbatim_overlap(source, answer, n) | (copy_similarity(x, y) >= most))


def letter_ratio(text: Column) -> Column:
    """Share of letters and digits among the characters that are no white space; 0 for none."""
    ink = F.regexp_count(text, F.lit(rf"[^\t-\r\x1c-\x1f\x{{85}}\p{{Z}}]"))
    return F.when(ink == 0, 0.0).otherwise(F.regexp_count(text, F.lit(r"[\p{L}\p{N}]")) / ink)


def punctuation_ratio(text: Column) -> Column:
    ink = F.regexp_count(text, F.lit(rf"[^\t-\r\x1c-\x1f\x{{85}}\p{{Z}}]"))
    return F.when(ink == 0, 1.0).otherwise(1 - F.regexp_count(text, F.lit(r"[\p{L}\p{N}]")) / ink)


def natural_text(text: Column, min_chars: int = 20) -> Column:
    """Long enough, mostly letters, no control characters but line ends and tabs, at least four words of two letters and
    more, and not a few words over and over."""
    t = strip(F.coalesce(text, F.lit("")))
    words = F.regexp_extract_all(t, F.lit(r"([A-Za-zÇĞİÖŞÜçğıöşü]{2,})"), 1)
    low = F.transform(words, lambda w: F.lower(w))
    varied = (F.size(low) < 12) | (F.size(F.array_distinct(low)) / F.size(low) >= 0.30)
    plain = ~t.rlike(r"[\x00-\x08\x0b-\x1f\x{fffd}]")
    return (F.length(t) >= min_chars) & (F.regexp_count(t, F.lit(r"\p{L}")) / F.greatest(F.length(t), F.lit(1)) > 0.45) & plain & (F.size(low) >= 4) & varied


def lexical_diversity(text: Column) -> Column:
    return F.size(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}_]{2,})"), 1)))


def repeated_token_ratio(text: Column) -> Column:
    """Share of the most frequent token among all words and signs; 0 for fewer than four."""
    tokens = F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}_]+|[^\p{L}\p{N}_\t-\r\x1c-\x1f\x{85}\p{Z}])"), 1)

    def share(t: Column) -> Column:
        # Runs of the sorted tokens: the longest is the most frequent token's.
        start = F.struct(F.lit("").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("best"))

        def step(a: Column, x: Column) -> Column:
            run = F.when(a["last"] == x, a["run"] + 1).otherwise(1)
            return F.struct(x.alias("last"), run.alias("run"), F.greatest(a["best"], run).alias("best"))

        return F.when(F.size(t) < 4, 0.0).otherwise(F.aggregate(F.array_sort(t), start, step, lambda a: a["best"]) / F.size(t))

    return let(tokens, share)


#: Parts of words that tell Turkish, beside its own letters.
TURKISH_PARTS = (" mı", " mi", " mu", " mü", " bir ", "hesapla", "kodu", "kodunu", "analiz", "sıcakkanlı", "kaydet", "dosya", "nedir", "kaç", "işlemi", "memeli", "bilgisayar", "hayvan", "araç", "sen ", "kimsin", "kendini tanıt", "kendini tanit", "nesin")


def is_turkish(text: Column) -> Column:
    """A letter or a part of a word that only Turkish has. İ counts as a letter of its own, I as i."""
    low = F.lower(F.replace(text, F.lit("İ"), F.lit("i̇")))
    return low.rlike("[çğıöşü]|" + "|".join(TURKISH_PARTS))


def turkish_ablative(word: Column) -> Column:
    """The word with its ablative ending after an apostrophe: by how the last digit is read, else by the last vowel."""
    last = F.substring(word, -1, 1)
    vowel = F.regexp_extract(F.lower(F.replace(word, F.lit("İ"), F.lit("i̇"))), "([aeıioöuü])[^aeıioöuü]*$", 1)
    digit = F.when(last.isin("0", "6", "9"), "dan").when(last.isin("1", "2", "7", "8"), "den").when(last.isin("3", "4", "5"), "ten")
    return F.concat(word, F.lit("'"), F.coalesce(digit, F.when(vowel.isin("a", "ı", "o", "u"), "dan").otherwise("den")))


def symbol(term: Column, aliases: Column | None = None) -> Column:
    """Identifier of a name: its alias if it has one, else its words joined by underscores; null if nothing is left.

    Letters are the Latin ones with those of Turkish. Aliases are found without regard to case; the term is expected
    in composed form (see ``clean_text``).
    """
    t = F.regexp_replace(F.regexp_replace(strip(term), rf"{WS}+", " "), r"^[ .?!]+|[ .?!]+$", "")
    ident = F.regexp_replace(F.regexp_replace(t, r"[^0-9A-Za-zÇĞİÖŞÜçğıöşü_]+", "_"), "^_+|_+$", "")
    ident = F.when(ident.rlike("^[0-9]"), F.concat(F.lit("N_"), ident)).otherwise(F.nullif(ident, F.lit("")))
    return F.coalesce(F.try_element_at(aliases, F.lower(F.replace(t, F.lit("İ"), F.lit("i̇")))), ident) if aliases is not None else ident


def display_label(identifier: Column, label: Column) -> Column:
    return F.coalesce(label, F.replace(identifier, F.lit("_"), F.lit(" ")))


def alpaca_prompt(instruction: Column, context: Column, answer: Column) -> Column:
    """Instruction with its context in a block of its own, if it has one; null without an instruction or an answer."""
    i, c, a = (clean_text(x, compatibility=False) for x in (instruction, context, answer))
    return F.when((i != "") & (a != ""), F.when(c == "", i).otherwise(F.concat(i, F.lit("\n\nBağlam:\n"), c)))


def image_digest(content: Column) -> Column:
    """First 16 hexadecimal digits of the SHA-1 of a content, by which images are named."""
    return F.substring(F.sha1(content), 1, 16)


def provenance(text: Column) -> Column:
    """SHA-256 of a raw text; '' if there is none."""
    return F.when(F.coalesce(text, F.lit("")) == "", "").otherwise(F.sha2(text, 256))


#: Phrases that ask for a text word for word.
VERBATIM = ("aynen yaz", "aynen kopyala", "birebir", "alıntıla", "alintila", "verbatim", "exact quote", "quote exactly", "copy exactly")


def asks_verbatim(prompt: Column) -> Column:
    """The prompt asks for a text word for word."""
    return F.lower(F.coalesce(prompt, F.lit(""))).rlike("|".join(VERBATIM))


def compact_json(*fields: tuple[str, Column]) -> Column:
    """JSON object of the fields in order of their names, nulls kept, without spaces."""
    return F.to_json(F.struct(*(c.alias(n) for n, c in sorted(fields))), {"ignoreNullFields": "false"})
