"""Text analysis as Column functions: fold, tokenise, normalise, stop-words, single letters.

All of it is code-point based and stays in built-in expressions. A null text gives a null result.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The two alphabets that are folded, and the folding of Ё and ё.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ" + "АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ" + "Ёё"
LOWER = "abcdefghijklmnopqrstuvwxyz" + "абвгдежзийклмнопрстуфхцчшщъыьэюя" + "ее"
DELIMITERS = r"[\s\p{P}\p{S}]+"
SEPARATORS = "[^а-яa-z0-9]+"
NOT_NORMAL = "[^а-яa-z0-9-]+"

# The effective Russian stop-words.
STOPWORDS = tuple(
    """
    а без более больше будет будто бы был была были было быть в вам вас ведь во вот впрочем все всегда всего всех всю вы
    где да даже два для до другой его ее ей ему если есть еще ж же за зачем здесь и из или им иногда их к как какая какой
    когда конечно кто куда ли лучше между меня мне много может можно мой моя мы на над надо наконец нас не него нее ней
    нельзя ни нибудь никогда ним них ничего но ну о об один он она они опять от перед по под после потом потому почти при
    про раз разве с сам свою себе себя сейчас со совсем так такой там тебя тем теперь то тогда того тоже только том тот
    три тут ты у уж уже хорошо хоть чего чем через что чтоб чтобы чуть эти этого этой этом этот эту я
    """.split()
)

#: Distinct terms of a document that are indexed.
MAX_TERMS = 1000


def fold(text: Column) -> Column:
    """Lower case for the Latin and Russian alphabets alone; ё becomes е."""
    return F.translate(text, UPPER, LOWER)


def tokenize(text: Column) -> Column:
    """The maximal runs of anything but white space, punctuation and symbols, as an array."""
    return F.array_remove(F.split(text, DELIMITERS), "")


def normalize(text: Column) -> Column:
    """Folded text in which each run of other characters than letters, digits and `-` is one space, none at the ends."""
    return F.trim(F.regexp_replace(fold(text), NOT_NORMAL, " "))


def tokens(text: Column) -> Column:
    """Tokenise and normalise in one split: the folded runs of letters and digits, as an array."""
    return F.array_remove(F.split(fold(text), SEPARATORS), "")


def is_stopword(word: Column) -> Column:
    return word.isin(*STOPWORDS)


def without_stopwords(tokens: Column) -> Column:
    """The tokens that aren't stop-words, in order."""
    return F.filter(tokens, lambda t: ~is_stopword(t))  # a hash set in the plan


def without_single_letters(tokens: Column) -> Column:
    """The tokens of two characters or more, and single digits."""
    return F.filter(tokens, lambda t: (F.length(t) > 1) | t.rlike("^[0-9]$"))


def is_russian(word: Column) -> Column:
    return word.rlike("^[а-я]+$")


def index_terms(tokens: Column, most: int | None = MAX_TERMS) -> Column:
    """The distinct tokens in order of first sight, the first `most` of them."""
    found = F.array_distinct(tokens)
    return found if most is None else F.slice(found, 1, most)


def token_chars(tokens: Column) -> Column:
    """The characters of all tokens together."""
    return F.length(F.array_join(tokens, "")).cast("long")
