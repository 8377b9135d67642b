"""Text scalars: tokenisers, counts, label parsing. Pure column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from pairflow import domain
from pairflow.functions.lookup import any_of, lookup
from pairflow.functions.ordering import digest_number

WORD = r"[\p{L}\p{N}_]"
# Anything but white space, counting the Unicode blanks too.
VISIBLE = r"[^\s\x0b\p{Z}\x1c-\x1f\x85]"


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def word_tokens(text: Column | str) -> Column:
    """Runs of letters, digits and underscores of the lower-cased text."""
    return F.regexp_extract_all(F.lower(_c(text)), F.lit(f"({WORD}+)"), F.lit(1))


# Rules of the full tokeniser, by step; every step rewrites the whole lower-cased text, and blanks then separate tokens.
# The conventions of the Penn Treebank (quotes as `` and '', clitics split off, brackets and marks alone).
# A period ends a sentence before a blank, but not behind an initial or one of ABBREVIATIONS; KEPT stands for it there.
ABBREVIATIONS = ["mr", "mrs", "ms", "dr", "prof", "st", "vs", "jr", "sr", "inc", "ltd", "co", "corp", "e.g", "i.e", "u.s", "u.k", "no"]
KEPT = "\x01"
_ABBREVIATED = "|".join(["[a-z]", *(a.replace(".", r"\.") for a in ABBREVIATIONS)])
FULL_STEPS: dict[str, list[tuple[str, str]]] = {
    "abbreviations": [(rf"(^|[\s(])({_ABBREVIATED})\.(\s+\S)", "$1$2" + KEPT + "$3")] * 2,
    "opening quotes": [
        (r"([«“‘„]|`+)", r" $1 "), (r'^"', "``"), ("(``)", r" $1 "), (r"([ (\[{<])(\"|\'\')", r"$1 `` "),
        (r"\'([0-9_a-ce-lo-ru-z]|[^\x00-\x7f])([^\p{L}\p{N}_]|$)", r"' $1$2")],
    "sentence ends": [(r"([^.\s])(\.)([\])}>\"\'»”’]*)(\s+)", r"$1 $2 $3 ")],
    "marks": [
        (r"([^.])(\.)([\])}>\"\'»”’ ]*)\s*$", r"$1 $2 $3 "), (r"([:,])([^0-9])", r" $1 $2"), (r"([:,])$", r" $1 "),
        (r"(\.\.+)", r" $1 "), (r"([;@#$%&])", r" $1 "), (r"([?!])", r" $1 "), (r"([^\'])\' ", r"$1 ' "), (r"([*])", r" $1 ")],
    "brackets": [(r"([\]\[(){}<>])", r" $1 ")],
    "dashes": [("--", " -- ")],
    "room": [("^", " "), ("$", " ")],
    "closing quotes": [(r"([»”’])", r" $1 "), (r"(\'\')", r" $1 "), (r'"', r" '' "), (r"\s+", " ")],
    "clitics": [(r"([^\' ])(\'[smd]|\') ", r"$1 $2 "), (r"([^\' ])(\'ll|\'re|\'ve|n\'t) ", r"$1 $2 ")],
    "contractions": [
        (r"(^|[^\p{L}\p{N}_])(can)(not)([^\p{L}\p{N}_]|$)", r"$1$2 $3$4"), (r"(^|[^\p{L}\p{N}_])(d)(\'ye)([^\p{L}\p{N}_]|$)", r"$1$2 $3$4"),
        (r"(^|[^\p{L}\p{N}_])(gim|lem)(me)([^\p{L}\p{N}_]|$)", r"$1$2 $3$4"), (r"(^|[^\p{L}\p{N}_])(gon|wan)(na)([^\p{L}\p{N}_]|$)", r"$1$2 $3$4"),
        (r"(^|[^\p{L}\p{N}_])(got)(ta)([^\p{L}\p{N}_]|$)", r"$1$2 $3$4"), (r"(^|[^\p{L}\p{N}_])(more)(\'n)([^\p{L}\p{N}_]|$)", r"$1$2 $3$4"),
        (r" (\'t)(is|was)([^\p{L}\p{N}_]|$)", r" $1 $2$3")],
    "kept periods": [(KEPT, ".")],
}


# Most texts hold no quote, apostrophe, period, dash pair or KEPT; the rules that look for one can't match there.
_RARE = r"[.`'\"«»“”‘’„\x01]|--"
_RARE_PARTS = (r"\.", "`", r"\'", '"', "»", "--", KEPT)
PLAIN_RULES = [r for rules in FULL_STEPS.values() for r in rules if not any(p in r[0] for p in _RARE_PARTS)]
_CONTRACTED = ("cannot", "gimme", "lemme", "gonna", "wanna", "gotta")
# Without those words too, PLAIN_RULES come to this: the single marks are different characters, and runs of white space
# make no tokens.
_MARKED = r"[:,;@#$%&?!*\]\[(){}<>]"
MARK_RULES = [(r"([:,])([^0-9]|$)", " $1 $2"), (r"([;@#$%&?!*\]\[(){}<>])", " $1 ")]


def _rewritten(text: Column, rules: list[tuple[str, str]]) -> Column:
    for pattern, replacement in rules:
        text = F.regexp_replace(text, pattern, replacement)
    return text


def full_tokens(text: Column | str) -> Column:
    """Second tokeniser, by the conventions of the Penn Treebank: punctuation as tokens, clitics split off, quotes by
    their side. A text meets the rules that can match in it."""
    lowered = F.lower(_c(text))
    spaced = (F.when(lowered.rlike(_RARE), _rewritten(lowered, [r for rules in FULL_STEPS.values() for r in rules]))
              .when(reduce(Column.__or__, [lowered.contains(w) for w in _CONTRACTED]), _rewritten(lowered, PLAIN_RULES))
              .when(lowered.rlike(_MARKED), _rewritten(lowered, MARK_RULES)).otherwise(lowered))
    return F.regexp_extract_all(spaced, F.lit(r"(\S+)"), F.lit(1))


def tokens(text: Column | str, mode: str = "simple") -> Column:
    if mode == "simple":
        return word_tokens(text)
    if mode == "full":
        return full_tokens(text)
    raise ValueError(f"unknown tokeniser mode: {mode}")


def drop_stopwords(token_set: Column | str, stopwords: list[str] | None = None) -> Column:
    # A list of constants is hashed once; array_except would hash it again for every row.
    words = list(stopwords or domain.STOPWORDS)
    return F.filter(F.array_distinct(_c(token_set)), lambda w: ~F.coalesce(w.isin(words), F.lit(False)))


def negation_count(token_set: Column | str) -> Column:
    """Number of distinct negation words present."""
    return F.size(F.array_intersect(_c(token_set), any_of(domain.NEGATIONS)))


def has_text(col: Column | str) -> Column:
    """Neither null nor blank (any white space counts as blank)."""
    return F.coalesce(_c(col).rlike(VISIBLE), F.lit(False))


def blank_word_count(text: Column | str) -> Column:
    """Number of words separated by white space."""
    return F.size(F.regexp_extract_all(_c(text), F.lit(f"({VISIBLE}+)"), F.lit(1)))


def approx_tokens(text: Column | str) -> Column:
    """One token per four characters, plus one."""
    return F.floor(F.length(_c(text)) / 4).cast("long") + 1


def truncate(text: Column | str, limit: int) -> Column:
    t = _c(text)
    return F.when(F.length(t) > limit, F.concat(F.substring(t, 1, limit), F.lit("..."))).otherwise(t)


def normalise_label(col: Column | str, strip: bool = True) -> Column:
    lowered = F.lower(_c(col).cast("string"))
    return F.regexp_replace(lowered, r"^\s+|\s+$", "") if strip else lowered


def null_if_text_null(col: Column | str) -> Column:
    """Turn the texts that CSV round trips leave for a missing label back into null."""
    return F.when(normalise_label(col).isin("nan", "none", ""), F.lit(None)).otherwise(_c(col))


def parse_label(text: Column | str, mode: str = "priority") -> Column:
    """Label named by a response, or null.

    "priority": the first label of PARSE_ORDER found anywhere, then the stems.
    "last_mention": the label mentioned last, then the stems.
    """
    # No label begins or ends with a blank, so the text needs no trimming to be searched.
    t = normalise_label(text, strip=False)
    labels = domain.PARSE_ORDER
    if mode == "priority":
        out = F.when(t.contains(labels[0]), F.lit(labels[0]))
        for label in labels[1:]:
            out = out.when(t.contains(label), F.lit(label))
    elif mode == "last_mention":
        mentions = F.regexp_extract_all(t, F.lit("(" + "|".join(labels) + ")"), F.lit(1))
        named = reduce(Column.__or__, [t.contains(label) for label in labels])
        out = F.when(named, F.try_element_at(mentions, F.lit(-1)))
    else:
        raise ValueError(f"unknown parse mode: {mode}")
    for stem, label in domain.PARSE_STEMS.items():
        out = out.when(t.contains(stem), F.lit(label))
    return out


def decode_label(label_id: Column | str) -> Column:
    return lookup(_c(label_id).cast("int"), domain.LABEL_BY_ID, domain.UNKNOWN_LABEL)


def label_from_scores(scores: Column | str, by_id: dict[int, str] | None = None) -> Column:
    """Label at the position of the largest score (the first one on ties)."""
    s = _c(scores)
    position = (F.array_position(s, F.array_max(s)) - 1).cast("int")
    return lookup(position, by_id or domain.ENCODER_LABEL_BY_ID)


def canonical_strategy(name: Column | str) -> Column:
    cleaned = F.replace(F.lower(_c(name)), F.lit("_"), F.lit("-"))
    return F.coalesce(lookup(cleaned, domain.STRATEGY_ALIASES), cleaned)


def checked_strategy(name: Column | str, allowed: list[str] | None = None) -> Column:
    """canonical_strategy, raising at run time on a name that is not allowed."""
    canonical = canonical_strategy(name)
    return F.when(canonical.isin(allowed or domain.STRATEGIES), canonical).otherwise(
        F.raise_error(F.concat(F.lit("Unknown strategy: "), F.coalesce(_c(name), F.lit("null")))))


def confusion_key(true_col: Column | str, pred_col: Column | str) -> Column:
    return F.concat_ws(" → ", _c(true_col), _c(pred_col))


def plausible_label(premise: Column | str, hypothesis: Column | str, coin: Column | str = "pairID") -> Column:
    """Label guessed from content-word overlap and negation mismatch.

    Undecided rows are settled by the digest of the coin column, so reruns agree.
    """
    p, h = F.lower(_c(premise)), F.lower(_c(hypothesis))
    stop = any_of(domain.LABELER_STOPWORDS)
    p_words = F.array_except(word_tokens(p), stop)
    h_words = F.array_except(word_tokens(h), stop)
    n_words = F.size(h_words)
    overlap = F.size(F.array_intersect(p_words, h_words)) / F.greatest(n_words, F.lit(1))
    toss = digest_number(_c(coin).cast("string"))

    def negated(text: Column) -> Column:
        return text.rlike("|".join(domain.LABELER_NEGATION_SUBSTRINGS))

    return (
        F.when(n_words == 0, F.element_at(any_of(domain.LABELS), (toss % 3 + 1).cast("int")))
        .when((negated(p) != negated(h)) & (overlap > 0.3), F.lit("contradiction"))
        .when(overlap > 0.5, F.lit("entailment"))
        .when(overlap > 0.2, F.when(toss % 2 == 0, F.lit("entailment")).otherwise(F.lit("neutral")))
        .otherwise(F.lit("neutral"))
    )
