"""Title and text column functions (SCL6, SCL7, SCL17-SCL19, FLT3 helpers).

All are native expressions (regexp_replace / split / filter), so they stay in
the JVM and inside whole-stage code generation where Spark allows it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values
# ---------------------------------------------------------------------------
# Text a CSV reader of the analyses treats as missing (the default NA tokens
# of the pandas CSV parser, matched on the whole field).
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

# Boilerplate removed from lower-cased titles, in this order; the first two are
# anchored at the start of the (already shortened) title.
TITLE_BOILERPLATE = [
    r"^ask hn[:\-]?",
    r"^show hn[:\-]?",
    r"is hiring",
    r"launch hn",
    r"pdf",
    r"video",
]

# English stop words of the keyword ranking (the 318-word list of the common
# scikit-learn vectoriser), alphabetical.
ENGLISH_STOP_WORDS = """
a about above across after afterwards again against all almost alone along already also although always am
among amongst amoungst amount an and another any anyhow anyone anything anyway anywhere are around as at back
be became because become becomes becoming been before beforehand behind being below beside besides between
beyond bill both bottom but by call can cannot cant co con could couldnt cry de describe detail do done down
due during each eg eight either eleven else elsewhere empty enough etc even ever every everyone everything
everywhere except few fifteen fifty fill find fire first five for former formerly forty found four from front
full further get give go had has hasnt have he hence her here hereafter hereby herein hereupon hers herself him
himself his how however hundred i ie if in inc indeed interest into is it its itself keep last latter latterly
least less ltd made many may me meanwhile might mill mine more moreover most mostly move much must my myself
name namely neither never nevertheless next nine no nobody none noone nor not nothing now nowhere of off often
on once one only onto or other others otherwise our ours ourselves out over own part per perhaps please put
rather re same see seem seemed seeming seems serious several she should show side since sincere six sixty so
some somehow someone something sometime sometimes somewhere still such system take ten than that the their them
themselves then thence there thereafter thereby therefore therein thereupon these they thick thin third this
those though three through throughout thru thus to together too top toward towards twelve twenty two un under
until up upon us very via was we well were what whatever when whence whenever where whereafter whereas whereby
wherein whereupon wherever whether which while whither who whoever whole whom whose why will with within without
would yet you your yours yourself yourselves
""".split()

# Characters a Python ``str.split()`` treats as whitespace.
PY_WHITESPACE_CLASS = r"[\t\n\x0B\f\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def na_to_null(c: Column) -> Column:
    """Empty text or an NA token -> null (how the analyses' CSV reader sees it)."""
    return F.when(c.isin(NA_TOKENS), F.lit(None).cast("string")).otherwise(c)


def clean_title(title: Column) -> Column:
    """SCL6: lower, strip the boilerplate patterns in order, keep [a-z0-9] and
    whitespace, collapse whitespace runs, trim.

    ``pdf`` and ``video`` are removed inside words as well (``videos`` -> ``s``),
    exactly as the pattern list says.
    """
    t = F.lower(title)
    for pat in TITLE_BOILERPLATE:
        if pat.startswith("^"):
            t = F.regexp_replace(t, pat, "")
        else:  # plain words: a literal replace, no regex engine per text
            t = F.replace(t, F.lit(pat), F.lit(""))
    # "non-[a-z0-9\s] -> space, then collapse whitespace runs" in one pass:
    # every run of characters outside [a-z0-9] becomes a single space
    t = F.regexp_replace(t, r"[^a-z0-9]+", " ")
    return F.trim(t)


def title_tokens(clean: Column, stop_words: list[str] | None = None) -> Column:
    """SCL7: word tokens of >= 2 word characters, stop words removed.

    On a cleaned title (only ``[a-z0-9 ]`` left) the word pattern ``\\b\\w\\w+\\b``
    equals splitting on spaces and keeping tokens of length >= 2.
    """
    stop = ENGLISH_STOP_WORDS if stop_words is None else stop_words
    toks = F.regexp_extract_all(clean, F.lit(r"\b\w\w+\b"), 0)
    if not stop:
        return toks
    words = sorted(set(stop))
    # ``isin`` over a literal list becomes a hash-set lookup (InSet) in the optimizer.
    return F.filter(toks, lambda t: ~t.isin(words))


def text_or_empty(c: Column) -> Column:
    """SCL17: null -> ``''`` before embedding."""
    return F.coalesce(c.cast("string"), F.lit(""))


def first_words(text: Column, n: int = 4) -> Column:
    """SCL19: first ``n`` whitespace-separated words (Python ``split`` rules)."""
    words = F.split(F.regexp_replace(text, rf"^{PY_WHITESPACE_CLASS}+|{PY_WHITESPACE_CLASS}+$", ""),
                    rf"{PY_WHITESPACE_CLASS}+")
    words = F.filter(words, lambda w: w != "")
    return F.array_join(F.slice(words, 1, n), " ")


def cleanup_name(name: Column) -> Column:
    """SCL18: drop ``"`` and ``*``, newlines -> space, collapse whitespace, trim."""
    t = F.translate(F.regexp_replace(name, "\n", " "), '"*', "")
    words = F.filter(F.split(t, rf"{PY_WHITESPACE_CLASS}+"), lambda w: w != "")
    return F.array_join(words, " ")
