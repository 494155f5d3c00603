"""A tokenizer for short messages, as a chain of native regular expressions.

Things that must stay whole (addresses, numbers, faces, tags, ...) are marked off
by a control character, the rest is split on blanks, punctuation on the edge of a
word comes off, and English contractions become two tokens.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_MARKS = r"""['"“”‘’«»{}()\[\]*!?…]+"""
_WORD_EDGE = r"[\p{L}\p{N}]"
_TLD = r"(?:com|org|net|edu|gov|info|biz|mil|int|name|mobi|tv|io|co|us|uk|de|fr|es|it|nl|jp|cn|ru|br|in|au|ca|ly|me)"

#: name -> pattern; where two begin at one place the former counts.
PROTECTED: dict[str, str] = {
    "heart": r"(?:<+/?3+)+",
    "link": rf"(?:(?:https?://|www\.)[^\s<>\"]*[^\s<>\".,;:!?')\]]|\b(?:[\p{{L}}\p{{N}}-]+\.)+{_TLD}\b(?:/[^\s<>\"]*[^\s<>\".,;:!?')\]])?(?!@))",
    "mail": r"[\p{L}\p{N}._%+-]+@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)+",
    "clock": r"(?<!\d)\d{1,2}(?::\d{2}){1,2}(?!\d)",
    "grouped_number": r"(?<!\d)\d{1,3}(?:,\d{3})+(?:\.\d+)?(?![\d,])",
    "amount": r"\p{Sc}?\d+(?:\.\d+)+%?|\p{Sc}\d+|\d+%",
    "face": r"(?:(?<![\p{L}\p{N}])[>]?[:;=8xX][-'^o]?(?:[)\](\[}{]+|[DPpOo3/\\|@*](?![\p{L}\p{N}]))|[)\](\[]+[-'^o]?[:;=8](?![\p{L}\p{N}]))",
    "wide_face": r"(?:\([-^oO.;*~T] ?[_.-]* ?[-^oO.;*~T]\)|(?<![\p{L}\p{N}])(?:\^[_.-]*\^|[-=][_.]+[-=]|[oO][_.]+[oO]|T[_.]+T)(?![\p{L}\p{N}]))",
    "arrow": r"<?[-=]{2,}>|<[-=]{2,}|<-+>?|-+>|[←-⇿]+",
    "entity": r"&(?:amp|lt|gt|quot|apos|nbsp|#\d+);",
    "marks": r"""[?!¿¡]+|\.{2,}|…+|["“”«»]+""",
    "short": r"\b(?:\p{L}\.){2,}|\b(?:Mr|Mrs|Ms|Dr|Sr|Jr|Rep|Sen|St|vs|etc)\.(?=\s|$)",
    "rule": r"--+|―|—|~|=+",
    "ornament": r"[♫♪★☆♥❤♡]+",
    "inner_quote": r"[\p{L}\p{N}][\p{L}\p{N}-]*['’′][\p{L}\p{N}]+",
    "tag": r"#[\p{L}\p{N}_]+",
    "mention": r"[@＠][\p{L}\p{N}_]+",
}
_KEEP = "|".join(f"(?:{p})" for p in PROTECTED.values())
_CONTRACTION = r"(?i)^(.+?)(n['’′]t|['’′](?:ve|ll|d|re|s|m))$"


def squeeze(text: Column | str) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def tokenize(text: Column | str) -> Column:
    """Tokens of a message; null for null."""
    t = squeeze(text)
    # marks come off the edges of words, to the left and to the right
    t = F.regexp_replace(t, rf"(^|[\s:;.,])({_MARKS})(?={_WORD_EDGE})", "$1$2 ")
    t = F.regexp_replace(t, rf"(?<={_WORD_EDGE})({_MARKS})(?=$|[\s:;.,])", " $1")
    t = F.regexp_replace(t, _KEEP, "\u0001$0\u0002")
    parts = F.split(t, "[\u0001]")

    def cut(part: Column) -> Column:
        whole = F.contains(part, F.lit("\u0002"))
        kept = F.substring_index(part, "\u0002", 1)
        rest = F.when(whole, F.substring_index(part, "\u0002", -1)).otherwise(part)
        bare = F.split(F.regexp_replace(rest, r"([,.;:]+)(?=\s|$)", " $1"), " ")
        return F.when(whole, F.concat(F.array(kept), bare)).otherwise(bare)

    words = F.filter(F.flatten(F.transform(parts, cut)), lambda w: F.trim(w) != "")
    # the part before a contraction is kept whole
    two = lambda w: F.when(w.rlike(_CONTRACTION), F.array(F.regexp_extract(w, _CONTRACTION, 1), F.regexp_extract(w, _CONTRACTION, 2))).otherwise(F.array(w))
    return F.flatten(F.transform(words, two))
