"""Title keyword ranking by summed, L2-normalised TF-IDF (SCL6, SCL7, AGG4-AGG7, WIN2).

Order of operations (it matters for parity):
clean -> tokenise -> drop stop words -> cap vocabulary by corpus frequency ->
smoothed idf over *all* kept documents (token-less ones included) ->
per-document L2 norm over in-vocabulary terms -> sum per term -> top-k.

Plan shape: term counts per document are computed inside the row (sorted
tokens, run lengths), so the first shuffle is the per-term statistics with map-side partial
aggregation.  The idf table is bounded by ``max_features`` and broadcast.  The
per-document norm is a window partitioned by document id over rows that were dealt out by id before
they were exploded (one shuffle of per-document rows), then a final partially-aggregated sum per term.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.functions.text import clean_title, title_tokens
from linkloom.operators.common import sized_broadcast
from linkloom.operators.profiles import drop_missing
from linkloom.session import materialize

MAX_FEATURES = 50_000
TOP_K = 50


def keyword_docs(posts: DataFrame, id_col: str = "id", title_col: str = "title") -> DataFrame:
    """FLT3 + SCL6: (id, clean_title) for posts with a title."""
    return (drop_missing(posts.select(id_col, title_col), [title_col])
            .select(F.col(id_col).alias("id"), clean_title(F.col(title_col)).alias("clean_title")))


def doc_tokens(docs: DataFrame, stop_words: list[str] | None = None) -> DataFrame:
    """SCL7 long form: (id, token_pos, token), positions 1-based."""
    return docs.select("id", F.posexplode(title_tokens(F.col("clean_title"), stop_words))
                       .alias("token_pos", "token")).withColumn("token_pos", F.col("token_pos") + 1)


def _term_runs(docs: DataFrame, stop_words: list[str] | None):
    """(frame, runs) -- ``runs`` is the ARRAY<STRUCT<term, tf>> column of the frame.

    The document's tokens are sorted; each run of equal tokens is one term and
    its length is the term frequency -- O(L log L) per document of L tokens.
    """
    d = docs.select("id", F.array_sort(title_tokens(F.col("clean_title"), stop_words)).alias("s"))
    s, n = F.col("s"), F.size("s")
    # 1-based positions where a new run of equal tokens starts
    starts = F.when(n > 0, F.filter(F.sequence(F.lit(1), n), lambda i: (i == 1) | (
        F.element_at(s, i) != F.element_at(s, F.greatest(i - 1, F.lit(1)))))).otherwise(
        F.array().cast("array<int>"))
    d = d.select("id", "s", n.alias("n"), starts.alias("starts"))
    runs = F.transform("starts", lambda st, j: F.struct(
        F.element_at(s, st).alias("term"),
        (F.coalesce(F.try_element_at("starts", (j + 2).cast("int")), F.col("n") + 1) - st).cast("long")
        .alias("tf")))
    return d, runs


def doc_term_arrays(docs: DataFrame, stop_words: list[str] | None = None) -> DataFrame:
    """AGG4 part 1, one row per document: (id, terms ARRAY<STRUCT<term, tf>>),
    computed inside the row (no shuffle); token-less documents keep an empty array."""
    d, runs = _term_runs(docs, stop_words)
    return d.select("id", runs.alias("terms"))


def explode_terms(per_doc: DataFrame) -> DataFrame:
    """(id, terms) -> long form (id, term, tf)."""
    return per_doc.select("id", F.explode("terms").alias("e")).select("id", "e.term", "e.tf")


def doc_term_counts(docs: DataFrame, stop_words: list[str] | None = None) -> DataFrame:
    """AGG4 part 1: (id, term, tf) computed inside each document row (no shuffle)."""
    d, runs = _term_runs(docs, stop_words)
    return d.select("id", F.explode(runs).alias("e")).select("id", "e.term", "e.tf")


def term_stats(doc_terms: DataFrame) -> DataFrame:
    """AGG4 part 2: (term, df, tf) -- document frequency and corpus frequency."""
    return doc_terms.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").cast("long").alias("tf"))


def cap_vocabulary(stats: DataFrame, max_features: int = MAX_FEATURES) -> DataFrame:
    """AGG5: keep the ``max_features`` terms of highest corpus frequency (ties by term).

    No global sort of the vocabulary: the cut-off frequency is found on the
    (small) histogram of frequencies; only the tie group at the cut-off is
    ordered by term, limited to the number of places left.
    """
    # Histogram of corpus frequencies: one row per distinct frequency value,
    # which is tiny next to the vocabulary; it is all the driver sees.
    hist = sorted(((int(r["tf"]), int(r["n"])) for r in
                   stats.groupBy("tf").agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
    above = 0
    for tf, n in hist:
        if above + n >= max_features:
            break
        above += n
    else:
        return stats  # vocabulary fits under the cap
    if above + n == max_features:
        return stats.filter(F.col("tf") >= tf)
    # Tie group at the cut-off frequency: keep its first (cap - above) terms.
    last = (stats.filter(F.col("tf") == tf).select("term").orderBy("term")
            .limit(max_features - above).agg(F.max("term")).first()[0])
    return stats.filter((F.col("tf") > tf) | ((F.col("tf") == tf) & (F.col("term") <= last)))


def idf_table(vocab: DataFrame, n_docs: int) -> DataFrame:
    """AGG6: smoothed idf ``ln((1+n)/(1+df)) + 1``."""
    return vocab.select("term", (F.log((F.lit(1.0) + F.lit(n_docs)) / (F.lit(1.0) + F.col("df"))) + 1.0)
                        .alias("idf"))


def keyword_scores(posts: DataFrame, max_features: int = MAX_FEATURES,
                   stop_words: list[str] | None = None, id_col: str = "id",
                   title_col: str = "title") -> DataFrame:
    """AGG7: (term, tfidf) = sum over documents of the L2-normalised tf*idf."""
    # three actions (count, vocabulary, scores) reuse the per-document term
    # counts: write those -- distinct non-stop terms, far smaller than the texts
    # -- so the regex cleaning runs once and no copy of the corpus is kept
    per_doc = materialize(doc_term_arrays(keyword_docs(posts, id_col, title_col), stop_words), "term-counts")
    n_docs = per_doc.count()
    dt = explode_terms(per_doc)
    stats = materialize(term_stats(dt), "term-stats")
    vocab = cap_vocabulary(stats, max_features)
    idf = idf_table(vocab, n_docs)
    # a document's weights meet once more, as one row: its norm scales them there, and what is summed are terms
    w = dt.join(sized_broadcast(idf), "term", "inner").select("id", "term", (F.col("tf") * F.col("idf")).alias("w"))
    rows = w.groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"), F.collect_list(F.struct("term", "w")).alias("ws"))
    return (rows.select("norm", F.explode("ws").alias("e")).groupBy(F.col("e.term").alias("term"))
            .agg(F.sum(F.col("e.w") / F.col("norm")).alias("tfidf")))


def keyword_ranking(posts: DataFrame, k: int = TOP_K, max_features: int = MAX_FEATURES,
                    stop_words: list[str] | None = None, id_col: str = "id",
                    title_col: str = "title") -> DataFrame:
    """WIN2: top-k terms by TF-IDF mass, ties by term."""
    s = keyword_scores(posts, max_features, stop_words, id_col, title_col)
    return s.orderBy(F.col("tfidf").desc(), F.col("term").asc()).limit(k)
