"""The registered queries of the operators and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.llm import byte_cnn, cross_polytope, decontaminate, html_text, licenses, merkle, mixing, phrases, pseudo_likelihood, quality_rules, records, simhash, suffix_dedup
from linkloom.sources.tables import read_table


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, sf_dir, name)


def op1_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudo_likelihood.pseudo_likelihood(_table(spark, sf_dir, "documents"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.removed_spans(_table(spark, sf_dir, "documents")).drop("removed")


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(_table(spark, sf_dir, "documents")).drop("spans")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.drop("spans")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def tokenizer_path() -> str:
    """The production tokenizer's file; every operator takes a path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op6_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.encode_and_read(_table(spark, sf_dir, "documents"), tokenizer_path())


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_table(spark, sf_dir, "pages"))


def op8_byte_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_cnn.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules.quality_rules(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", *quality_rules.STATS, "base_failed", "kept")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(_table(spark, sf_dir, "documents"))


def op12_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_polytope.search(_table(spark, sf_dir, "embeddings"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(_table(spark, sf_dir, "documents")).drop("lang", "tampered")


QUERIES = {
    "op1_pseudo_likelihood": op1_pseudo_likelihood,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_licenses": op3_licenses,
    "op4_decontaminate": op4_decontaminate,
    "op5_mixing": op5_mixing,
    "op6_records": op6_records,
    "op7_html_text": op7_html_text,
    "op8_byte_cnn": op8_byte_cnn,
    "op9_quality_rules": op9_quality_rules,
    "op10_simhash": op10_simhash,
    "op11_phrases": op11_phrases,
    "op12_cross_polytope": op12_cross_polytope,
    "op13_merkle": op13_merkle,
}

_NONSPACE = r"[^\x20\x09-\x0D]+"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_MERKLE_FIELD = "coalesce(octet_length(encode(CAST({x} AS VARCHAR))) || ':' || CAST({x} AS VARCHAR), '-')"
_MERKLE_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_FIELDS = " || ".join(_MERKLE_FIELD.format(x=c) for c in merkle.LEAF_COLUMNS[:-1])
#: One level up: the digest in its slot among the run's others, and those others behind the siblings so far.
_MERKLE_UP = """sha256(array_to_string(kids[1:pos % 8] || [digest] || kids[pos % 8 + 2:], '')), beside || array_to_string(kids[1:pos % 8] || kids[pos % 8 + 2:], '')"""

ORACLE = {
    "op2_suffix_dedup": """
WITH doc AS (
  SELECT row_number() OVER () AS k, doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents
), win AS (
  SELECT k, doc_id, i, substr(h, 2 * i + 1, 100) AS w FROM doc, unnest(range(0, n - 49)) AS t(i) WHERE doc_id IS NOT NULL
), first AS (
  SELECT w, min(doc_id) AS least_id FROM win GROUP BY w
), hit AS (
  SELECT k, i, coalesce(i > lag(i) OVER (PARTITION BY k ORDER BY i) + 50, true) AS opens FROM win JOIN first USING (w) WHERE least_id < doc_id
), island AS (
  SELECT k, i, sum(CAST(opens AS INTEGER)) OVER (PARTITION BY k ORDER BY i) AS g FROM hit
), span AS (
  SELECT k, min(i) AS a, max(i) + 50 AS b FROM island GROUP BY k, g
), piece AS (
  SELECT k, a AS place, coalesce(lag(b) OVER (PARTITION BY k ORDER BY a), 0) AS lo, a AS hi FROM span
  UNION ALL SELECT k, n, coalesce((SELECT max(b) FROM span WHERE span.k = doc.k), 0), n FROM doc
), kept AS (
  SELECT k, string_agg(substr(h, 2 * lo + 1, 2 * (hi - lo)), '' ORDER BY place) AS h FROM piece JOIN doc USING (k) GROUP BY k
), removed AS (
  SELECT k, CAST(sum(b - a) AS BIGINT) AS n_removed, count(*) AS n_spans FROM span GROUP BY k
)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(kept.h)) AS kept_sha256
FROM doc JOIN kept USING (k) LEFT JOIN removed USING (k)
""",
    "op4_decontaminate": rf"""
WITH item AS (
  SELECT item_id, regexp_extract_all({_LOWER}, '{_ALNUM}') AS w FROM (SELECT DISTINCT item_id, text FROM benchmark)
), item_window AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS win
  FROM item, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS t(i) WHERE len(w) > 0
), doc AS (
  SELECT row_number() OVER () AS k, doc_id, regexp_extract_all({_LOWER}, '{_ALNUM}') AS w FROM documents
), doc_window AS (
  SELECT k, i, n, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM doc, (SELECT DISTINCT n FROM item_window), unnest(range(1, len(w) - n + 2)) AS t(i)
), hit AS (
  SELECT k, i, item_window.n, item_id FROM doc_window JOIN item_window USING (n, win)
), hit_words AS (
  SELECT k, count(DISTINCT p) AS n_hit FROM hit, unnest(range(i, i + n)) AS t(p) GROUP BY k
), hit_items AS (
  SELECT k, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT k, CAST(item_id AS VARCHAR) AS id FROM hit WHERE item_id IS NOT NULL) GROUP BY k
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc LEFT JOIN hit_words USING (k) LEFT JOIN hit_items USING (k)
""",
    "op5_mixing": rf"""
WITH doc AS (
  SELECT row_number() OVER () AS k, doc_id, source, text, CAST(len(regexp_extract_all(coalesce(text, ''), '{_NONSPACE}')) AS BIGINT) AS size,
         CAST('0x' || substr(md5('{mixing.SEED}-' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS place
  FROM documents
), by_source AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1 AS rank FROM doc GROUP BY source
), weighted AS (
  SELECT *, CASE rank % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, {mixing.MAX_EPOCHS} * source_size AS cap FROM by_source
), level AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighted
), goal AS (
  SELECT source, rank, source_size,
         CASE WHEN cap / weight < first_free.free_ratio OR first_free.level IS NULL THEN CAST(cap AS DOUBLE) ELSE least(CAST(cap AS DOUBLE), first_free.level * weight) END AS target
  FROM level LEFT JOIN (SELECT cap / weight AS free_ratio, level FROM level WHERE cap >= level * weight ORDER BY cap / weight, rank LIMIT 1) AS first_free ON true
), queued AS (
  SELECT k, doc_id, text, place, size, rank, source_size, target,
         sum(size) OVER (PARTITION BY rank ORDER BY place, doc_id, text ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS sent
  FROM doc JOIN goal ON doc.source IS NOT DISTINCT FROM goal.source
), times AS (
  SELECT *, CAST(epoch * source_size + sent AS DOUBLE) / target AS finish FROM queued, unnest(range(0, {mixing.MAX_EPOCHS})) AS t(epoch) WHERE target > 0
), ordered AS (
  SELECT *, sum(size) OVER (ORDER BY finish, rank, place, doc_id, text, epoch, k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM times
), sent AS (
  SELECT k, count(*) AS n FROM ordered WHERE run <= (SELECT sum(size) FROM doc) GROUP BY k
)
SELECT doc_id, size, source_size, target, CAST(coalesce(n, 0) * size AS BIGINT) AS taken FROM queued LEFT JOIN sent USING (k)
""",
    "op9_quality_rules": rf"""
WITH doc AS (
  SELECT row_number() OVER () AS k, doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_NONSPACE}') AS w
  FROM documents
), win AS (
  SELECT k, i, array_to_string(w[i:i + 7], ' ') AS win FROM doc, unnest(range(1, len(w) - 6)) AS t(i)
), twice AS (
  SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, win) AS c FROM win) WHERE c > 1
), repeats AS (
  SELECT k, count(DISTINCT p) AS n_repeat_words FROM twice, unnest(range(i, i + 8)) AS t(p) GROUP BY k
), line AS (
  SELECT k, source, raw, regexp_extract_all({_LOWER.replace("coalesce(text, '')", "raw")}, '{_NONSPACE}') AS w
  FROM (SELECT k, source, unnest(string_split(text, chr(10))) AS raw FROM doc)
), filled AS (
  SELECT k, source, raw, array_to_string(w, ' ') AS line, len(w) AS n FROM line WHERE len(w) > 0
), dup AS (
  SELECT k, count(*) - count(DISTINCT raw) AS n_dup_lines FROM filled GROUP BY k
), host AS (
  SELECT source, count(DISTINCT text) AS host_docs FROM doc GROUP BY source
), often AS (
  SELECT filled.source, line FROM filled JOIN doc USING (k) JOIN host ON filled.source IS NOT DISTINCT FROM host.source
  GROUP BY filled.source, line, host_docs
  HAVING count(DISTINCT doc.text) >= {quality_rules.LINE_MIN_DOCS} AND count(DISTINCT doc.text) >= {quality_rules.LINE_SHARE} * host_docs
), removed AS (
  SELECT k, sum(n) AS gone FROM filled JOIN often ON filled.line = often.line AND filled.source IS NOT DISTINCT FROM often.source GROUP BY k
), counted AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, gone
  FROM doc LEFT JOIN repeats USING (k) LEFT JOIN dup USING (k) LEFT JOIN removed USING (k)
), judged AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM counted
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT (gone IS NOT NULL AND (n_words - gone < {quality_rules.MIN_WORDS} OR n_words - gone < {quality_rules.MIN_LEFT} * n_words)) AS kept
FROM judged
""",
    "op11_phrases": rf"""
WITH doc AS (
  SELECT coalesce(lang, '{phrases.NO_LANG}') AS lang, unnest(string_split_regex({_LOWER}, '[.,;:!?\x0A-\x0D]')) AS p FROM documents
), piece AS (
  SELECT row_number() OVER () AS k, lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM doc
), token AS (
  SELECT k, lang, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM piece
), suffix AS (
  SELECT lang, x AS a1, lead(x, 1) OVER place AS a2, lead(x, 2) OVER place AS a3, lead(x, 3) OVER place AS a4 FROM token WINDOW place AS (PARTITION BY k ORDER BY i)
), often AS (
  SELECT lang, 1 AS size, a1, NULL AS a2, NULL AS a3, NULL AS a4, count(*) AS f, a1 AS g FROM suffix GROUP BY lang, a1
  UNION ALL SELECT lang, 2, a1, a2, NULL, NULL, count(*), a1 || ' ' || a2 FROM suffix WHERE a2 IS NOT NULL GROUP BY lang, a1, a2 HAVING count(*) >= {phrases.MIN_COUNT}
  UNION ALL SELECT lang, 3, a1, a2, a3, NULL, count(*), a1 || ' ' || a2 || ' ' || a3 FROM suffix WHERE a3 IS NOT NULL GROUP BY lang, a1, a2, a3 HAVING count(*) >= {phrases.MIN_COUNT}
  UNION ALL SELECT lang, 4, a1, a2, a3, a4, count(*), a1 || ' ' || a2 || ' ' || a3 || ' ' || a4 FROM suffix WHERE a4 IS NOT NULL GROUP BY lang, a1, a2, a3, a4 HAVING count(*) >= {phrases.MIN_COUNT}
), total AS (
  SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM often WHERE size = 1 GROUP BY lang
), around AS (
  SELECT lang, g, max(f) AS around FROM (
    SELECT lang, f, unnest([a1 || ' ' || a2, a2 || ' ' || a3]) AS g FROM often WHERE size = 3
    UNION ALL SELECT lang, f, unnest([a1 || ' ' || a2, a2 || ' ' || a3, a3 || ' ' || a4, a1 || ' ' || a2 || ' ' || a3, a2 || ' ' || a3 || ' ' || a4]) FROM often WHERE size = 4
  ) GROUP BY lang, g
), own AS (
  SELECT often.* FROM often LEFT JOIN around USING (lang, g)
  WHERE size > 1 AND (around IS NULL OR 100::HUGEINT * around < {phrases.INSIDE_PERCENT}::HUGEINT * f)
), cut AS (
  SELECT lang, g, f, 1 AS k, a1 AS head, concat_ws(' ', a2, a3, a4) AS rest FROM own
  UNION ALL SELECT lang, g, f, 2, a1 || ' ' || a2, concat_ws(' ', a3, a4) FROM own WHERE size > 2
  UNION ALL SELECT lang, g, f, 3, a1 || ' ' || a2 || ' ' || a3, a4 FROM own WHERE size = 4
), scored AS (
  SELECT cut.lang, cut.g, cut.f AS a, k, x.f AS l, y.f AS r, CAST(({phrases.SCALE}::HUGEINT * cut.f) // (x.f + y.f) AS BIGINT) AS score
  FROM cut JOIN often AS x ON x.lang = cut.lang AND x.g = cut.head JOIN often AS y ON y.lang = cut.lang AND y.g = cut.rest
), best AS (
  SELECT *, row_number() OVER (PARTITION BY lang, g ORDER BY score, k) AS place FROM scored
), ranked AS (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(g)) AS rank, g AS phrase, a, l, r, score FROM best WHERE place = 1
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN total USING (lang) WHERE rank <= {phrases.KEEP}
""",
    "op13_merkle": rf"""
WITH RECURSIVE doc AS (
  SELECT row_number() OVER () AS k, doc_id, lang, source, n_chars, text, CAST(doc_id AS VARCHAR) AS id,
         dense_rank() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS tree FROM documents
), field AS (
  SELECT k, doc_id, tree, id, {_FIELDS} AS before, {_MERKLE_FIELD.format(x="text")} AS plain, {_MERKLE_FIELD.format(x=_MERKLE_LOWER)} AS lowered FROM doc
), crc AS (
  SELECT k, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(1, length(id) + 1), lambda i: CAST(ascii(substr(id, i, 1)) AS BIGINT))),
    lambda c, byte: list_reduce(list_prepend(xor(c, byte), CAST(range(0, 8) AS BIGINT[])), lambda r, i: xor(r >> 1, CASE WHEN r & 1 = 1 THEN 3988292384 ELSE 0 END)))) AS crc
  FROM doc WHERE id IS NOT NULL
), leaf AS (
  SELECT k, doc_id, tree, sha256(before || plain) AS leaf, CASE WHEN crc % 3 = 0 THEN sha256(before || lowered) ELSE sha256(before || plain) END AS changed
  FROM field LEFT JOIN crc USING (k)
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf, k) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM leaf
), node AS (
  SELECT tree, 0 AS level, pos, n, leaf AS digest FROM placed
  UNION ALL
  SELECT tree, level + 1, pos // 8, (n + 7) // 8, sha256(string_agg(digest, '' ORDER BY pos)) FROM node WHERE n > 1 GROUP BY tree, level, pos // 8, n
), subroot AS (
  SELECT tree, digest FROM node WHERE n = 1
), top AS (
  SELECT 0 AS level, tree AS pos, (SELECT count(*) FROM subroot) AS n, digest FROM subroot
  UNION ALL
  SELECT level + 1, pos // 8, (n + 7) // 8, sha256(string_agg(digest, '' ORDER BY pos)) FROM top WHERE n > 1 GROUP BY level, pos // 8, n
), run AS (
  SELECT tree, level, pos // 8 AS up, list(digest ORDER BY pos) AS kids FROM node WHERE n > 1 GROUP BY ALL
  UNION ALL SELECT -1, level, pos // 8, list(digest ORDER BY pos) FROM top WHERE n > 1 GROUP BY ALL
), fold AS (
  SELECT k, tree, 0 AS level, pos, n, changed AS digest, '' AS beside FROM placed
  UNION ALL
  SELECT k, tree, level + 1, pos // 8, (n + 7) // 8, {_MERKLE_UP}
  FROM fold JOIN run USING (tree, level) WHERE n > 1 AND up = pos // 8
), fold_top AS (
  SELECT k, -1 AS tree, 0 AS level, tree AS pos, (SELECT count(*) FROM subroot) AS n, digest, beside FROM fold WHERE n = 1
  UNION ALL
  SELECT k, tree, level + 1, pos // 8, (n + 7) // 8, {_MERKLE_UP}
  FROM fold_top JOIN run USING (tree, level) WHERE n > 1 AND up = pos // 8
)
SELECT doc_id, leaf, subroot.digest AS subroot, root.digest AS root, sha256(beside) AS proof_sha256, fold_top.digest AS folded_root, fold_top.digest = root.digest AS verified
FROM placed JOIN subroot USING (tree) JOIN fold_top USING (k), (SELECT digest FROM top WHERE n = 1) AS root WHERE fold_top.n = 1
""",
}
