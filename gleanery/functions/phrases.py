"""Articles and plurals: ``a`` / ``an`` by sound, word forms by count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VOWELS = "aeiou"


def sound_word(text: Column) -> Column:
    """The part of a phrase that decides its article: first word, cleaned."""
    first = F.regexp_extract(F.trim(text), r"^(.[^ ]*)", 1)
    bare = F.regexp_replace(first, "^[$(`\"']+", "")
    bare = F.lower(F.regexp_replace(bare, "[).!?:;\\-`\"']+$", ""))
    bare = F.regexp_replace(bare, r"^(.[^.]*)\..*$", "$1")
    return F.regexp_replace(bare, r"^(.[^-]*)-.*$", "$1")


def _number_sounds_vowel(word: Column) -> Column:
    digits = F.replace(word, F.lit(","), F.lit(""))
    size = F.length(digits)
    number = F.regexp_like(digits, F.lit(r"^[1-9][0-9]*(?:_[0-9]+)*(?:e\+?[0-9]+)?j?$"))
    eleven = F.substring(digits, 1, 2).isin("11", "18") & ((size % 3 == 2) | (size == 4))
    return number & (digits.startswith("8") | eleven)


def sounds_vowel(word: Column, is_exception: Column) -> Column:
    """Vowel sound of a cleaned word; an exception sounds unlike its first letter."""
    first = F.substring(word, 1, 1)
    return (
        F.when(word == "", F.lit(None).cast("boolean"))
        .when(first.isin(*VOWELS), ~is_exception)
        .when(first.between("a", "z"), is_exception)
        .otherwise(_number_sounds_vowel(word))
    )


def article(text: Column, exceptions: list[str] = ()) -> Column:
    """``a`` or ``an`` for a phrase, with a short literal list of exceptions."""
    word = sound_word(text)
    odd = word.isin(*exceptions) if exceptions else F.lit(False)
    return F.when(sounds_vowel(word, odd), F.lit("an")).otherwise(F.lit("a"))


def with_articles(df: DataFrame, text: str, exceptions: DataFrame, name: str) -> DataFrame:
    """Phrase with its article, exceptions coming from a table of words.

    Phrases are many and words few: the join runs once per distinct word, so one
    frequent word cannot skew it, and comes back on that word.
    """
    words = df.withColumn("_word", sound_word(F.col(text)))
    distinct = words.select("_word").distinct()
    known = exceptions.select(F.col("word").alias("_word"), F.lit(True).alias("_odd")).distinct()
    sounds = distinct.join(known, "_word", "left").select(
        "_word",
        sounds_vowel(F.col("_word"), F.coalesce("_odd", F.lit(False))).alias("_vowel"),
    )
    chosen = F.when(F.col("_vowel"), F.lit("an ")).otherwise(F.lit("a "))
    return (
        words.join(sounds, "_word", "left")
        .withColumn(name, F.concat(chosen, F.col(text)))
        .drop("_word", "_vowel")
    )


def exception_words(pronunciations: DataFrame) -> DataFrame:
    """Words whose first sound and first letter disagree.

    Input is ``word, pronunciations array<array<string>>``; the first phoneme of
    the first pronunciation is a vowel when it ends in a digit.
    """
    phoneme = F.get(F.get("pronunciations", F.lit(0)), F.lit(0))
    first = F.substring("word", 1, 1)
    vowel_letter, vowel_sound = first.isin(*VOWELS), F.regexp_like(phoneme, F.lit(r"\d$"))
    letter = first.between("a", "z")
    kind = F.when(vowel_letter & ~vowel_sound, F.lit("consonant_sounding_vowel_led")).when(
        ~vowel_letter & letter & vowel_sound, F.lit("vowel_sounding_consonant_led")
    )
    return pronunciations.withColumn("kind", kind).filter("kind is not null")


def word_forms(forms: str) -> tuple[str, str]:
    """Singular and plural of ``base/singular suffix/plural suffix``."""
    base, *ends = forms.split("/")
    if not ends:
        return base, base
    return base + "/".join(ends[:-1]), base + ends[-1]


def parse_phrases(spec: str) -> dict:
    """``'0=no $things;n=$n $things'`` to number -> template."""
    out: dict = {}
    for part in spec.split(";"):
        if part.count("=") != 1:
            raise ValueError(f"invalid phrase template {part!r}")
        key, template = part.split("=")
        out["n" if key == "n" else float(key)] = template
    return out


def count_phrase(number: Column, forms: str | None = None, *specs: str,
                 exceptions: list[str] = ()) -> Column:
    """Phrase for a count; each spec adds templates for particular numbers."""
    templates = {1.0: "$n $thing", "n": "$n $things"}
    for spec in specs:
        templates.update(parse_phrases(spec))
    out = None
    for key, template in templates.items():
        if key != "n":
            test, text = number == key, _render(template, number, forms, exceptions)
            out = F.when(test, text) if out is None else out.when(test, text)
    return out.otherwise(_render(templates["n"], number, forms, exceptions))


def _render(template: str, number: Column, forms: str | None, exceptions) -> Column:
    text = F.lit(template)
    # A missing number leaves its token in place.
    values = {"n": F.coalesce(number.cast("string"), F.lit("$n"))}
    if forms is not None:
        values["thing"], values["things"] = (F.lit(w) for w in word_forms(forms))
    for token, value in values.items():
        pattern = F.lit(rf"\$(?:{token}(?![_a-zA-Z0-9])|\{{{token}\}})")
        quoted = F.regexp_replace(value, r"([\\$])", r"\\$1")
        text = F.regexp_replace(text, pattern, quoted)
    text = F.replace(text, F.lit("$$"), F.lit("$"))
    if "$a " not in template:
        return text
    words = F.split(text, " ")
    return F.array_join(
        F.transform(
            words,
            lambda w, i: F.when(w == "$a", article(F.get(words, i + 1), exceptions)).otherwise(w),
        ),
        " ",
    )
