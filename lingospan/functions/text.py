"""Column expressions for text cleaning, token rules and script detection.

Python's ``re`` treats ``\\s``, ``\\d`` and ``\\w`` as Unicode classes and ``.`` as
"not newline"; Java does not, so every class is spelled out here.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that sentence segmentation deletes.
SPECIAL_SYMBOLS = (
    "＂<>:《》+-=#$%&()*@＃＄％＆＇()[]{}（）＊＋－／： ＜＝＞＠［＼］＾＿｀｛｜｝～｟｠｢｣､、〃》"
    "「」『』【】〔〕〖〗〘〙〚〛〜〝〞〟〰〾〿–—‘’‛“”„‟…‧﹏・━┿│┷┯．−"
)
# Marks that end a sentence.
SENTENCE_ENDS = ";；！!？?。"
# Fixed value: stands for a sentence in which the tokeniser found nothing.
EMPTY_SENTENCE_WORD = "there_is_no_word"

# Characters Python counts as white space.
UNICODE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
# Patterns of the token and tag formats.
HTML_TAG = r"<[^\n]*?>"
TAGGED_WORD = r"(.*)#"
TAGGER_LINE = r"(?s)(.+)\t(.+),"
ACCEPTED_POS = ("NOUN", "PROPN", "ADJ", "ADV", "VERB")
LETTER_RUN = r"\p{L}+"
WORD_OF_TWO = r"[\p{L}\p{N}_]{2,}"
NON_ASCII = r"[^\x00-\x7F]"
HAN = r"[\x{4e00}-\x{9fff}]"


def char_class(chars: str) -> str:
    """Regex class body matching exactly ``chars`` in both Java and RE2 syntax.

    Single characters below U+0100 share one bit set in Java, so they stay apart; higher
    ones are joined to ranges.
    """
    points = sorted({ord(c) for c in chars})
    parts = [rf"\x{{{p:x}}}" for p in points if p < 256]
    high = [p for p in points if p >= 256]
    while high:
        n = 1
        while n < len(high) and high[n] == high[0] + n:
            n += 1
        parts.append(rf"\x{{{high[0]:x}}}" + (rf"-\x{{{high[n - 1]:x}}}" if n > 1 else ""))
        high = high[n:]
    return "".join(parts)


def delete_chars(text: Column, chars: str, extra_class: str = "") -> Column:
    """Remove ``chars`` and members of ``extra_class``, which names no character below U+0100.

    One pass looks at the bit set only. The other tests the range first, so that Latin text
    never walks through the list of high characters.
    """
    low = "".join(c for c in chars if ord(c) < 256)
    high = "".join(c for c in chars if ord(c) >= 256)
    text = F.regexp_replace(text, f"[{char_class(low)}]+", "")
    return F.regexp_replace(text, rf"[\x{{100}}-\x{{10ffff}}&&[{char_class(high)}{extra_class}]]+", "")


def strip_html(text: Column) -> Column:
    return F.regexp_replace(text, HTML_TAG, "")


def normalise_script(text: Column, matching: str, replacement: str) -> Column:
    """Map characters one to one, e.g. traditional to simplified, by a caller's table."""
    return F.translate(text, matching, replacement)


def segment_sentences(
    text: Column,
    *,
    comma_regex: str = r"\n",
    period_regex: str = r"(\n){2,}",
    keep_digits: bool = True,
    remove_html: bool = True,
    script_map: tuple[str, str] | None = None,
) -> Column:
    """Array of sentences: breaks become marks, symbols and blanks go, marks split."""
    if remove_html:
        text = strip_html(text)
    text = F.regexp_replace(text, period_regex, "。")
    text = F.regexp_replace(text, comma_regex, "，")
    if keep_digits:
        text = delete_chars(text, SPECIAL_SYMBOLS + UNICODE_SPACE)
    else:
        text = delete_chars(text, SPECIAL_SYMBOLS + UNICODE_SPACE + "0123456789", r"\p{Nd}")
    if script_map is not None:
        text = normalise_script(text, *script_map)
    parts = F.split(text, f"[{char_class(SENTENCE_ENDS)}]")
    return F.filter(parts, lambda s: s != "")


def letter_tokens(text: Column) -> Column:
    """Lower-cased runs of letters, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(LETTER_RUN), F.lit(0))


def count_vectorizer_tokens(text: Column) -> Column:
    """Lower-cased tokens of two or more word characters."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD_OF_TWO), F.lit(0))


def empty_sentence_placeholder(tokens: Column) -> Column:
    return F.when(F.size(tokens) == 0, F.array(F.lit(EMPTY_SENTENCE_WORD))).otherwise(tokens)


def token_accepted(
    token: Column,
    *,
    want_stop: bool = False,
    want_alpha: bool = True,
    accept_pos: Sequence[str] = ACCEPTED_POS,
    use_entity: bool = True,
) -> Column:
    """Keep rule for one token struct; an entity mark in ``shape`` overrides the others."""
    keep = token["upos"].isin(list(accept_pos))
    if not want_stop:
        keep = keep & ~token["is_stop"]
    if want_alpha:
        keep = keep & token["is_alpha"]
    if use_entity:
        keep = keep | token["shape"].contains("_")
    return keep


def project_tokens(tokens: Column, *, want_lemma: bool = True, **rules) -> Column:
    """Array of lemmas (or texts) of the accepted token structs."""
    output = "lemma" if want_lemma else "text"
    kept = F.filter(tokens, lambda t: token_accepted(t, **rules))
    return F.transform(kept, lambda t: t[output])


def is_ascii(word: Column) -> Column:
    return ~word.rlike(NON_ASCII)


def pos_filter_tagged(tagged: Column, tags: Sequence[str] = ("#N", "#V")) -> Column:
    """From ``word#POS`` strings: accepted tags, at least two characters, not pure ASCII."""

    def accepted(item: Column) -> Column:
        hit = F.lit(False)
        for tag in tags:
            hit = hit | item.contains(tag)
        return hit

    words = F.transform(F.filter(tagged, accepted), lambda t: F.regexp_extract(t, TAGGED_WORD, 1))
    return F.filter(words, lambda w: (F.char_length(w) >= 2) & ~is_ascii(w))


def parse_tagger_line(line: Column) -> tuple[Column, Column]:
    """``word TAB features,`` to ``(word, word#POS)``; NULL where the shape differs."""
    matched = line.rlike(TAGGER_LINE)
    word = F.when(matched, F.regexp_extract(line, TAGGER_LINE, 1))
    pos = F.substring_index(F.regexp_extract(line, TAGGER_LINE, 2), ",", 1)
    return word, F.when(matched, F.concat(word, F.lit("#"), pos))


def word_script(word: Column) -> Column:
    """``en`` for ASCII, ``cn`` when a Han character occurs, NULL (dropped) otherwise."""
    return F.when(is_ascii(word), "en").when(word.rlike(HAN), "cn")


def word_script_binary(word: Column, source: str = "source", target: str = "target") -> Column:
    return F.when(is_ascii(word), F.lit(source)).otherwise(F.lit(target))
