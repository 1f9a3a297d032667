"""Independent ANSI-SQL (DuckDB dialect) statements for the query catalogue.

Written from the semantics, not from the Spark plans: where possible a
different formulation is used (e.g. suffix tests instead of parent
expansion) so that the two sides check each other.
"""

from __future__ import annotations

from linkloom.functions.text import ENGLISH_STOP_WORDS, NA_TOKENS
from linkloom.operators.spatial import PALETTE
from linkloom.plans.catalogue import FIXTURE_BLOCKLIST


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


NA_LIST = ", ".join(_lit(t) for t in NA_TOKENS)
STOP_LIST = "[" + ", ".join(_lit(w) for w in ENGLISH_STOP_WORDS) + "]"
BLOCK_VALUES = ", ".join(f"({_lit(d)})" for d in FIXTURE_BLOCKLIST)

HOST_EXPR = r"""CASE WHEN url IS NULL OR url = '' THEN NULL
     WHEN (strpos(net, '[') > 0) <> (strpos(net, ']') > 0) THEN NULL
     ELSE regexp_replace(net, '^www\.', '') END"""
NET_EXPR = r"""lower(regexp_extract(regexp_replace(regexp_replace(url, '[\t\r\n]', '', 'g'), '^[\x00-\x20]+', ''),
                    '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1))"""

PAGES_POSTS = "SELECT page_id AS id, url, CAST((page_id * 37) % 500 AS BIGINT) AS score FROM pages"

CLEAN_EXPR = r"""trim(regexp_replace(regexp_replace(
  regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(title),
    '^ask hn[:\-]?', ''), '^show hn[:\-]?', ''), 'is hiring', '', 'g'), 'launch hn', '', 'g'),
    'pdf', '', 'g'), 'video', '', 'g'),
  '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g'))"""

DOCS = f"""docs AS (
  SELECT id, {CLEAN_EXPR} AS clean_title FROM (
    SELECT doc_id AS id, text AS title FROM documents) t
  WHERE title IS NOT NULL AND title NOT IN ({NA_LIST}))"""

TOKS = f"""toks AS (
  SELECT id, list_filter(string_split(clean_title, ' '),
                         lambda x: length(x) >= 2 AND NOT list_contains({STOP_LIST}, x)) AS l
  FROM docs)"""

DT = """dt AS (SELECT id, term, CAST(count(*) AS BIGINT) AS tf
            FROM (SELECT id, unnest(l) AS term FROM toks) GROUP BY id, term)"""
ST = """st AS (SELECT term, CAST(count(*) AS BIGINT) AS df, CAST(sum(tf) AS BIGINT) AS tf FROM dt GROUP BY term)"""
VOCAB = """vocab AS (SELECT term, df, tf FROM st QUALIFY row_number() OVER (ORDER BY tf DESC, term) <= 50000)"""
IDF = """idf AS (SELECT term, ln((1.0 + (SELECT count(*) FROM docs)) / (1.0 + df)) + 1 AS idf FROM vocab)"""

ORACLE: dict[str, str] = {}

ORACLE["host_top50"] = f"""
WITH p AS ({PAGES_POSTS}),
n AS (SELECT url, {NET_EXPR} AS net FROM p
      WHERE url IS NOT NULL AND url NOT IN ({NA_LIST}) AND score IS NOT NULL AND score >= 0),
h AS (SELECT {HOST_EXPR} AS domain FROM n)
SELECT domain, CAST(count(*) AS BIGINT) AS high_score_posts FROM h
GROUP BY domain ORDER BY high_score_posts DESC, domain NULLS FIRST LIMIT 50
"""

ORACLE["domain_label_top50"] = rf"""
WITH p AS ({PAGES_POSTS}),
hs AS (SELECT regexp_replace(lower(regexp_replace(regexp_replace(
          regexp_extract(regexp_replace(trim(url), '^(?:[A-Za-z0-9+.-]+:)?//', ''), '^([^/?#]*)', 1),
          '^.*@', ''), ':.*$', '')), '\.+$', '') AS host
       FROM p WHERE url IS NOT NULL AND url NOT IN ({NA_LIST}) AND score IS NOT NULL AND score >= 0),
parts AS (SELECT string_split(host, '.') AS l FROM hs),
lab AS (SELECT CASE WHEN len(l) < 2 THEN 'none' ELSE l[len(l) - 1] END AS domain FROM parts)  -- every host ends in a suffix of one label
SELECT domain, CAST(count(*) AS BIGINT) AS high_score_posts FROM lab GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50
"""

ORACLE["blocklist_flag_counts"] = f"""
WITH p AS ({PAGES_POSTS}),
n AS (SELECT url, {NET_EXPR} AS net FROM p),
h AS (SELECT {HOST_EXPR} AS host FROM n),
bl(domain) AS (VALUES {BLOCK_VALUES}),
f AS (SELECT EXISTS (SELECT 1 FROM bl WHERE h.host = bl.domain OR ends_with(h.host, '.' || bl.domain)) AS b
      FROM h),
t AS (SELECT CAST(count(*) AS BIGINT) AS total_posts, CAST(count(*) FILTER (WHERE b) AS BIGINT) AS blacklisted_posts
      FROM f)
SELECT total_posts, blacklisted_posts, total_posts - blacklisted_posts AS non_blacklisted_posts,
       round(CASE WHEN total_posts = 0 THEN 0.0 ELSE 100.0 * blacklisted_posts / total_posts END, 6) AS pct_blacklisted,
       round(100.0 - CASE WHEN total_posts = 0 THEN 0.0 ELSE 100.0 * blacklisted_posts / total_posts END, 6)
         AS pct_non_blacklisted
FROM t
"""

ORACLE["blocklist_score_summary"] = f"""
WITH p AS ({PAGES_POSTS}),
n AS (SELECT url, score, {NET_EXPR} AS net FROM p),
h AS (SELECT {HOST_EXPR} AS host, score FROM n),
bl(domain) AS (VALUES {BLOCK_VALUES}),
f AS (SELECT score, EXISTS (SELECT 1 FROM bl WHERE h.host = bl.domain OR ends_with(h.host, '.' || bl.domain)) AS b
      FROM h)
SELECT b AS blacklisted, CAST(count(score) AS BIGINT) AS n, min(score) AS min,
       round(quantile_cont(score, 0.25), 6) AS q1, round(quantile_cont(score, 0.5), 6) AS median,
       round(quantile_cont(score, 0.75), 6) AS q3, max(score) AS max
FROM f WHERE score IS NOT NULL GROUP BY b
"""

ORACLE["event_value_five_numbers"] = """
SELECT event_type, CAST(count(value) AS BIGINT) AS n, round(min(value), 6) AS min,
       round(quantile_cont(value, 0.25), 6) AS q1, round(quantile_cont(value, 0.5), 6) AS median,
       round(quantile_cont(value, 0.75), 6) AS q3, round(max(value), 6) AS max
FROM events GROUP BY event_type
"""

ORACLE["time_cells"] = """
SELECT CAST(isodow(ts) - 1 AS INTEGER) AS weekday, CAST(hour(ts) AS INTEGER) AS hour,
       CAST(value >= 200 AS INTEGER) AS high_score, CAST(count(*) AS BIGINT) AS count
FROM events WHERE value IS NOT NULL AND ts IS NOT NULL
GROUP BY 1, 2, 3
"""


def _pivot(cond: str) -> str:
    cols = ",\n       ".join(
        f"CAST(count(f.wd) FILTER (WHERE f.wd = {d}) AS BIGINT) AS wd_{d}" for d in range(7))
    return f"""
WITH f AS (SELECT isodow(ts) - 1 AS wd, hour(ts) AS hr FROM events
           WHERE value IS NOT NULL AND ts IS NOT NULL AND {cond}),
h AS (SELECT CAST(range AS INTEGER) AS hour FROM range(24))
SELECT h.hour, {cols}
FROM h LEFT JOIN f ON f.hr = h.hour GROUP BY h.hour
"""


ORACLE["time_pivot_high"] = _pivot("value >= 200")
ORACLE["time_pivot_other"] = _pivot("value < 200")

ORACLE["clean_titles"] = f"""
SELECT id, title, {CLEAN_EXPR} AS clean_title FROM (
  SELECT doc_id AS id, text AS title FROM documents) t
WHERE title IS NOT NULL AND title NOT IN ({NA_LIST})
"""

ORACLE["tokens_per_doc"] = f"""
WITH {DOCS}, {TOKS}
SELECT id, CAST(unnest(range(1, len(l) + 1)) AS INTEGER) AS token_pos, unnest(l) AS token FROM toks
"""

ORACLE["term_frequencies"] = f"""
WITH {DOCS}, {TOKS}, {DT}, {ST}
SELECT term, df, tf FROM st
"""

ORACLE["vocab_cap"] = f"""
WITH {DOCS}, {TOKS}, {DT}, {ST}, {VOCAB}
SELECT term, df, tf FROM vocab
"""

ORACLE["idf_table"] = f"""
WITH {DOCS}, {TOKS}, {DT}, {ST}, {VOCAB}, {IDF}
SELECT term, round(idf, 6) AS idf FROM idf
"""

ORACLE["keyword_top50"] = f"""
WITH {DOCS}, {TOKS}, {DT}, {ST}, {VOCAB}, {IDF},
w AS (SELECT dt.id, dt.term, dt.tf * idf.idf AS w FROM dt JOIN idf ON dt.term = idf.term),
wn AS (SELECT term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS wn FROM w),
s AS (SELECT term, sum(wn) AS tfidf FROM wn GROUP BY term)
SELECT term, round(tfidf, 6) AS tfidf FROM s ORDER BY tfidf DESC, term LIMIT 50
"""

# -- vectors -------------------------------------------------------------------

EMB = "e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"

ORACLE["unit_vectors"] = f"""
WITH {EMB},
n AS (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS nrm FROM e)
SELECT vec_id, CAST(unnest(range(1, len(v) + 1)) AS INTEGER) AS dim,
       round(unnest(list_transform(v, lambda x: x / greatest(nrm, 1e-12))), 6) AS x
FROM n
"""

TAGS = f"""{EMB},
cu AS (SELECT label, unnest(range(1, len(v) + 1)) AS dim, unnest(v) AS x FROM e),
cm AS (SELECT label, dim, avg(x) AS m FROM cu GROUP BY label, dim),
cn AS (SELECT label, dim, m / greatest(sqrt(sum(m * m) OVER (PARTITION BY label)), 1e-12) AS x FROM cm),
p AS (SELECT CAST(label AS BIGINT) AS tag_idx, list(x ORDER BY dim) AS pv FROM cn GROUP BY label),
s AS (SELECT e.vec_id, p.tag_idx, list_dot_product(e.v, p.pv) AS sim FROM e, p),
b AS (SELECT vec_id, arg_max(tag_idx, (sim, -tag_idx)) AS tag_idx, max(sim) AS sim FROM s GROUP BY vec_id)"""

ORACLE["tag_assign"] = f"""
WITH {TAGS}
SELECT vec_id, tag_idx, 'tag_' || CAST(tag_idx AS VARCHAR) AS tag, round(sim, 6) AS sim FROM b
"""

ORACLE["tag_ranking"] = f"""
WITH {TAGS},
c AS (SELECT 'tag_' || CAST(tag_idx AS VARCHAR) AS tag, CAST(count(*) AS BIGINT) AS count FROM b GROUP BY 1)
SELECT tag, count, CAST(row_number() OVER (ORDER BY count DESC, tag) AS INTEGER) AS rank FROM c
"""

ORACLE["label_centroids"] = f"""
WITH {EMB},
u AS (SELECT label, unnest(range(1, len(v) + 1)) AS dim, unnest(v) AS x FROM e),
m AS (SELECT label, dim, avg(x) AS m FROM u GROUP BY label, dim),
n AS (SELECT label, dim, m / greatest(sqrt(sum(m * m) OVER (PARTITION BY label)), 1e-12) AS x FROM m)
SELECT CAST(label AS INTEGER) AS label, CAST(dim AS INTEGER) AS dim, round(x, 6) AS x FROM n
"""

ORACLE["zscore_dims"] = f"""
WITH {EMB},
u AS (SELECT unnest(range(1, len(v) + 1)) AS dim, unnest(v) AS x FROM e)
SELECT CAST(dim AS INTEGER) AS dim, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std
FROM u GROUP BY dim
"""

ORACLE["knn_exact"] = f"""
WITH {EMB},
s AS (SELECT a.vec_id AS id, b.vec_id AS nbr, list_dot_product(a.v, b.v) AS score
      FROM e a JOIN e b ON a.vec_id <> b.vec_id),
r AS (SELECT id, nbr, score, row_number() OVER (PARTITION BY id ORDER BY score DESC, nbr) AS rank FROM s)
SELECT id, CAST(rank AS INTEGER) AS rank, nbr, round(score, 6) AS score FROM r WHERE rank <= 5
"""

ORACLE["core_distance"] = f"""
WITH {EMB},
d AS (SELECT a.vec_id AS id, b.vec_id AS nbr, list_distance(a.v, b.v) AS dist
      FROM e a JOIN e b ON a.vec_id <> b.vec_id),
r AS (SELECT id, dist, row_number() OVER (PARTITION BY id ORDER BY dist, nbr) AS rank FROM d)
SELECT id, round(dist, 6) AS core_dist FROM r WHERE rank = 5
"""

# -- spatial -----------------------------------------------------------------------

GRID = """pts AS (SELECT vec_id AS id, 'item ' || CAST(vec_id AS VARCHAR) AS title,
                CAST(CASE WHEN label = 0 THEN -1 ELSE label END AS INTEGER) AS cluster,
                CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings),
nn AS (SELECT * FROM pts WHERE cluster <> -1),
b0 AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM nn),
b1 AS (SELECT *, CASE WHEN x1 - x0 = 0 THEN 1.0 ELSE x1 - x0 END AS xr,
                 CASE WHEN y1 - y0 = 0 THEN 1.0 ELSE y1 - y0 END AS yr FROM b0),
g AS (SELECT x0 - xr * 0.05 AS x_min, x1 + xr * 0.05 AS x_max, y0 - yr * 0.05 AS y_min, y1 + yr * 0.05 AS y_max,
             ((x1 + xr * 0.05) - (x0 - xr * 0.05)) / 10 AS w, ((y1 + yr * 0.05) - (y0 - yr * 0.05)) / 10 AS h
      FROM b1),
cells AS (SELECT nn.*, CAST(greatest(0, least(9, CAST(trunc((x - g.x_min) / g.w) AS BIGINT))) AS INTEGER) AS gx,
                 CAST(greatest(0, least(9, CAST(trunc((y - g.y_min) / g.h) AS BIGINT))) AS INTEGER) AS gy
          FROM nn, g),
chunks AS (SELECT gx, gy, CAST(count(*) AS BIGINT) AS count FROM cells GROUP BY gx, gy),
cb AS (SELECT c.gx, c.gy, c.count, g.x_min + c.gx * g.w AS cx_min, g.x_min + (c.gx + 1) * g.w AS cx_max,
              g.y_min + c.gy * g.h AS cy_min, g.y_min + (c.gy + 1) * g.h AS cy_max FROM chunks c, g)"""

ORACLE["grid_chunks"] = f"""
WITH {GRID}
SELECT CAST(gx AS VARCHAR) || '_' || CAST(gy AS VARCHAR) AS chunk,
       'grid_x=' || CAST(gx AS VARCHAR) || '/grid_y=' || CAST(gy AS VARCHAR) AS file,
       gx AS grid_x, gy AS grid_y, round(cx_min, 6) AS x_min, round(cx_max, 6) AS x_max,
       round(cy_min, 6) AS y_min, round(cy_max, 6) AS y_max, count
FROM cb
"""

ORACLE["chunk_manifest"] = f"""
WITH {GRID}
SELECT round(g.x_min, 6) AS x_min, round(g.x_max, 6) AS x_max, round(g.y_min, 6) AS y_min,
       round(g.y_max, 6) AS y_max, 10 AS grid_size,
       (SELECT CAST(count(*) AS BIGINT) FROM cells) AS total_points,
       (SELECT CAST(count(DISTINCT cluster) AS INTEGER) FROM nn) AS num_clusters,
       (SELECT CAST(count(*) AS INTEGER) FROM chunks) AS n_chunks,
       (SELECT CAST(count(*) AS BIGINT) FROM nn) AS clustered_points
FROM g
"""

ORACLE["viewport_filter"] = f"""
WITH {GRID},
v AS (SELECT CAST(gx AS VARCHAR) || '_' || CAST(gy AS VARCHAR) AS view,
             cx_min - (cx_max - cx_min) * 0.5 AS fx_min, cx_max + (cx_max - cx_min) * 0.5 AS fx_max,
             cy_min - (cy_max - cy_min) * 0.5 AS fy_min, cy_max + (cy_max - cy_min) * 0.5 AS fy_max FROM cb)
SELECT v.view, c.id FROM v JOIN cells c
  ON c.x BETWEEN v.fx_min AND v.fx_max AND c.y BETWEEN v.fy_min AND v.fy_max
"""

ORACLE["nearest_point"] = f"""
WITH {GRID},
c AS (SELECT cluster, avg(x) AS px, avg(y) AS py FROM nn GROUP BY cluster),
probes AS (SELECT CAST(c.cluster AS BIGINT) * 10 + z.zi AS probe_id, c.px, c.py,
                  10.0 / greatest(1.0, z.zoom) AS r
           FROM c, (VALUES (0, 1.0), (1, 50.0), (2, 400.0)) z(zi, zoom)),
d AS (SELECT p.probe_id, n.id, (n.x - p.px) * (n.x - p.px) + (n.y - p.py) * (n.y - p.py) AS d2, p.r
      FROM probes p, nn n),
best AS (SELECT probe_id, arg_min(id, (d2, id)) AS id, min(d2) AS d2 FROM d WHERE d2 < r * r GROUP BY probe_id)
SELECT p.probe_id, b.id, round(b.d2, 6) AS d2 FROM probes p LEFT JOIN best b ON p.probe_id = b.probe_id
"""

VIEW = """fv AS (SELECT least(160 / ((x_max - x_min) * 1.15), 120 / ((y_max - y_min) * 1.15)) AS zoom,
               (x_min + x_max) / 2 AS cx, (y_min + y_max) / 2 AS cy FROM g),
vr AS (SELECT zoom, cx, cy, cx - 160 / 2 / zoom AS vx0, cx + 160 / 2 / zoom AS vx1,
              cy - 120 / 2 / zoom AS vy0, cy + 120 / 2 / zoom AS vy1 FROM fv),
rr AS (SELECT zoom, cx, cy, vx0 - (vx1 - vx0) * 0.5 AS rx0, vx1 + (vx1 - vx0) * 0.5 AS rx1,
              vy0 - (vy1 - vy0) * 0.5 AS ry0, vy1 + (vy1 - vy0) * 0.5 AS ry1 FROM vr),
ins AS (SELECT c.* FROM cells c, rr WHERE c.x BETWEEN rr.rx0 AND rr.rx1 AND c.y BETWEEN rr.ry0 AND rr.ry1)"""

ORACLE["density_raster"] = f"""
WITH {GRID}, {VIEW},
px AS (SELECT CAST(floor((i.x - rr.rx0) * rr.zoom + 0.5) AS BIGINT) AS px,
              CAST(floor((i.y - rr.ry0) * rr.zoom + 0.5) AS BIGINT) AS py, i.cluster FROM ins i, rr),
c AS (SELECT px, py, cluster, CAST(count(*) AS BIGINT) AS n FROM px GROUP BY px, py, cluster)
SELECT px, py, arg_max(cluster, (n, -cluster)) AS cluster, max(n) AS n FROM c GROUP BY px, py
"""

ORACLE["fit_view"] = f"""
WITH {GRID}, {VIEW},
n AS (SELECT CAST(count(*) AS BIGINT) AS n FROM ins)
SELECT round(rr.zoom, 6) AS zoom, round(rr.cx, 6) AS center_x, round(rr.cy, 6) AS center_y, n.n AS n_visible,
       CAST(greatest(1, least(14, floor(sqrt((rr.rx1 - rr.rx0) * (rr.ry1 - rr.ry0) / greatest(n.n, 1))
                                        * rr.zoom * 0.22 + 0.5))) AS INTEGER) AS dot_px
FROM rr, n
"""

WS = r"[\t\n\x0B\f\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def _first4_clean(expr: str) -> str:
    first4 = (f"array_to_string(list_slice(list_filter(regexp_split_to_array({expr}, '{WS}+'), "
              f"lambda w: w <> ''), 1, 4), ' ')")
    cleaned = f"replace(replace(replace({first4}, chr(10), ' '), '\"', ''), '*', '')"
    return (f"array_to_string(list_filter(regexp_split_to_array({cleaned}, '{WS}+'), "
            f"lambda w: w <> ''), ' ')")


ORACLE["cluster_lookup"] = f"""
WITH {GRID},
names AS (SELECT cluster, {_first4_clean('t')} AS name FROM (
            SELECT cluster, arg_max(title, (length(title), id)) AS t FROM nn GROUP BY cluster))
SELECT p.id, p.cluster, coalesce(n.name, 'Unknown') AS name, 'item?id=' || CAST(p.id AS VARCHAR) AS link
FROM pts p LEFT JOIN names n ON p.cluster = n.cluster
"""

PALETTE_VALUES = ", ".join(f"({i}, {_lit(c)})" for i, c in enumerate(PALETTE))

ORACLE["palette"] = f"""
WITH {GRID},
ids AS (SELECT DISTINCT cluster AS id FROM nn),
pos AS (SELECT id, CAST((row_number() OVER (ORDER BY id) - 1) % 20 AS INTEGER) AS color_index FROM ids),
pal(i, color) AS (VALUES {PALETTE_VALUES})
SELECT pos.id, pos.color_index, pal.color FROM pos JOIN pal ON pal.i = pos.color_index
"""

ORACLE["longest_title_label"] = f"""
WITH d AS (SELECT doc_id AS id, text AS title, lang FROM documents WHERE text IS NOT NULL)
SELECT lang, {_first4_clean('t')} AS name, n AS count FROM (
  SELECT lang, arg_max(title, (length(title), id)) AS t, CAST(count(*) AS BIGINT) AS n FROM d GROUP BY lang)
"""

# -- ingest ---------------------------------------------------------------------------

ITEMS = """it AS (SELECT event_id AS id, CASE WHEN event_type = 'view' THEN 'story' ELSE event_type END AS type,
              CAST(user_id AS VARCHAR) AS "by", epoch_us(ts) // 1000000 AS time, value, props FROM events)"""
POST_COLS = """id, type, "by", time AS time_unix,
       strftime(make_timestamp(time * 1000000), '%Y-%m-%dT%H:%M:%S') AS time_iso, '' AS title,
       CAST(trunc(value) AS BIGINT) AS score, CAST(0 AS BIGINT) AS descendants, '' AS url,
       coalesce(props, '') AS text"""

ORACLE["stories_until_cutoff"] = f"""
WITH {ITEMS},
b AS (SELECT coalesce(max(id), -1) AS m FROM it WHERE time < 1705276800)
SELECT {POST_COLS} FROM it, b WHERE it.id > b.m AND type = 'story'
"""

ORACLE["id_batches"] = """
WITH s AS (SELECT max(event_id) AS m FROM events),
ids AS (SELECT m, unnest(range(1, m + 1)) AS id FROM s)
SELECT CAST((m - id) // 200 AS BIGINT) AS batch, max(id) AS batch_start, min(id) AS batch_end,
       CAST(count(*) AS BIGINT) AS n_ids
FROM ids GROUP BY 1
"""

ORACLE["dedupe_replayed"] = """
SELECT DISTINCT doc_id AS id, lang, n_chars FROM documents
"""

ORACLE["post_csv_roundtrip"] = f"""
SELECT id, title, score, "by", CAST(length(text) AS INTEGER) AS text_len FROM (
  SELECT doc_id AS id, text AS title, n_chars AS score, source AS "by", text FROM documents)
WHERE title IS NOT NULL AND title NOT IN ({NA_LIST})
"""

ORACLE["ingest_resume"] = f"""
WITH {ITEMS}
SELECT {POST_COLS} FROM it WHERE type = 'story'
"""

ORACLE["blocklist_post_flags"] = f"""
WITH p AS ({PAGES_POSTS}),
n AS (SELECT id, url, {NET_EXPR} AS net FROM p),
h AS (SELECT id, {HOST_EXPR} AS host FROM n),
bl(domain) AS (VALUES {BLOCK_VALUES})
SELECT id, host,
       EXISTS (SELECT 1 FROM bl WHERE h.host = bl.domain OR ends_with(h.host, '.' || bl.domain)) AS blacklisted
FROM h
"""

ORACLE["zscore_vectors"] = f"""
WITH {EMB},
u AS (SELECT vec_id, unnest(range(1, len(v) + 1)) AS dim, unnest(v) AS x FROM e),
s AS (SELECT dim, avg(x) AS m, stddev_pop(x) AS sd FROM u GROUP BY dim)
SELECT u.vec_id, CAST(u.dim AS INTEGER) AS dim,
       round((u.x - s.m) / CASE WHEN s.sd = 0 THEN 1.0 ELSE s.sd END, 6) AS z
FROM u JOIN s ON u.dim = s.dim
"""

ORACLE["cluster_sizes"] = """
SELECT CAST(CASE WHEN label = 0 THEN -1 ELSE label END AS INTEGER) AS cluster, CAST(count(*) AS BIGINT) AS count
FROM embeddings GROUP BY 1
"""

ORACLE["host_top50_high_score"] = f"""
WITH p AS ({PAGES_POSTS}),
n AS (SELECT url, {NET_EXPR} AS net FROM p
      WHERE url IS NOT NULL AND url NOT IN ({NA_LIST}) AND score IS NOT NULL AND score >= 200),
h AS (SELECT {HOST_EXPR} AS domain FROM n)
SELECT domain, CAST(count(*) AS BIGINT) AS high_score_posts FROM h
GROUP BY domain ORDER BY high_score_posts DESC, domain NULLS FIRST LIMIT 50
"""

ORACLE["stream_time_cells"] = f"""
WITH {ITEMS}
SELECT CAST(isodow(make_timestamp(time * 1000000)) - 1 AS INTEGER) AS weekday,
       CAST(hour(make_timestamp(time * 1000000)) AS INTEGER) AS hour,
       CAST(trunc(value) >= 200 AS INTEGER) AS high_score, CAST(count(*) AS BIGINT) AS count
FROM it GROUP BY 1, 2, 3
"""

ORACLE["knn_cells_euclidean"] = f"""
WITH {EMB},
d AS (SELECT a.vec_id AS id, b.vec_id AS nbr, list_distance(a.v, b.v) AS dist
      FROM e a JOIN e b ON a.vec_id <> b.vec_id),
r AS (SELECT id, nbr, dist, row_number() OVER (PARTITION BY id ORDER BY dist, nbr) AS rank FROM d)
SELECT id, CAST(rank AS INTEGER) AS rank, nbr, round(dist, 6) AS dist FROM r WHERE rank <= 5
"""

ORACLE["stream_post_flags"] = ORACLE["blocklist_post_flags"]

ORACLE["title_sample"] = """
WITH d AS (SELECT doc_id AS id, text AS title, lang,
             row_number() OVER (PARTITION BY lang ORDER BY md5('42-' || CAST(doc_id AS VARCHAR)), doc_id) AS rn FROM documents)
SELECT lang, id, title FROM d WHERE rn <= 50
"""

ORACLE["embed_titles"] = r"""
WITH t AS (SELECT doc_id AS id, unnest(list_filter(string_split(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}]+', ' ', 'g'), ' '), lambda w: w <> '')) AS w FROM documents),
h AS (SELECT id, md5(w) AS h FROM t),
s AS (SELECT id, CAST(('0x' || substr(h, 1, 8))::BIGINT % 64 AS INTEGER) AS b, CASE WHEN ('0x' || substr(h, 9, 1))::BIGINT % 2 = 0 THEN 1 ELSE -1 END AS sg FROM h),
v AS (SELECT id, b, CAST(sum(sg) AS DOUBLE) AS x FROM s GROUP BY id, b),
n AS (SELECT id, greatest(sqrt(sum(x * x)), 1e-12) AS nrm FROM v GROUP BY id)
SELECT d.doc_id AS id, k.d + 1 AS dim, round(coalesce(v.x / n.nrm, 0.0), 6) AS x
FROM documents d CROSS JOIN (SELECT CAST(unnest(range(0, 64)) AS INTEGER) AS d) k LEFT JOIN v ON v.id = d.doc_id AND v.b = k.d LEFT JOIN n ON n.id = d.doc_id
"""

ORACLE["embedding_json_roundtrip"] = f"""
WITH {EMB}
SELECT vec_id AS id, CAST(unnest(range(1, len(v) + 1)) AS INTEGER) AS dim, round(unnest(v), 6) AS x FROM e WHERE vec_id % 7 <> 3
"""

ORACLE["masked_pool"] = f"""
WITH {EMB},
u AS (SELECT label, CAST(vec_id % 3 <> 0 AS INTEGER) AS m, unnest(range(1, len(v) + 1)) AS dim, unnest(v) AS x FROM e)
SELECT CAST(label AS INTEGER) AS label, CAST(dim AS INTEGER) AS dim, round(sum(x * m) / greatest(sum(m), 1e-9), 6) AS x FROM u GROUP BY label, dim
"""

ORACLE["chunk_roundtrip"] = f"""
WITH {GRID}
SELECT id, title, cluster, round(x, 6) AS x, round(y, 6) AS y FROM nn
"""

ORACLE["manifest_clusters"] = f"""
WITH {GRID},
f AS (SELECT 'grid_x=' || CAST(gx AS VARCHAR) || '/grid_y=' || CAST(gy AS VARCHAR) AS key, count FROM chunks),
c AS (SELECT cluster, CAST(count(*) AS BIGINT) AS count FROM nn GROUP BY cluster)
SELECT 'cluster' AS kind, CAST(row_number() OVER (ORDER BY cluster) - 1 AS INTEGER) AS pos, CAST(cluster AS VARCHAR) AS key, count FROM c
UNION ALL
SELECT 'chunk', CAST(row_number() OVER (ORDER BY key) - 1 AS INTEGER), key, count FROM f
"""

ORACLE["tolerant_scores"] = """
SELECT doc_id AS id, CASE doc_id % 6 WHEN 0 THEN n_chars WHEN 1 THEN n_chars WHEN 4 THEN -n_chars END AS score FROM documents
"""

NEIGHBOURS = f"""{EMB},
d AS (SELECT a.vec_id AS id, b.vec_id AS nbr, list_distance(a.v, b.v) AS dist FROM e a JOIN e b ON a.vec_id <> b.vec_id),
r AS (SELECT id, nbr, dist, row_number() OVER (PARTITION BY id ORDER BY dist, nbr) AS rank FROM d),
core AS (SELECT id, dist AS core FROM r WHERE rank = 5)"""

ORACLE["mutual_reachability_edges"] = f"""
WITH {NEIGHBOURS}
SELECT DISTINCT least(r.id, r.nbr) AS a, greatest(r.id, r.nbr) AS b, round(greatest(r.dist, x.core, y.core), 6) AS w
FROM r JOIN core x ON x.id = r.id JOIN core y ON y.id = r.nbr WHERE r.rank <= 15
"""

ORACLE["graph_components"] = f"""
WITH RECURSIVE {NEIGHBOURS},
g AS (SELECT id AS x, nbr AS y FROM r WHERE rank = 1 UNION SELECT nbr, id FROM r WHERE rank = 1),
reach AS (SELECT x AS id, x AS other FROM g UNION SELECT reach.id, g.y FROM reach JOIN g ON g.x = reach.other)
SELECT id, min(other) AS comp FROM reach GROUP BY id
"""


def _boruvka(rounds: int, jumps: int) -> str:
    """Boruvka written out: every component's lightest edge, pointers to the component it leads to, pointer jumping."""
    out = ["c0 AS MATERIALIZED (SELECT vec_id AS v, vec_id AS c FROM e)"]
    for k in range(rounds):
        out += [
            f"o{k} AS MATERIALIZED (SELECT x.c AS ca, y.c AS cb, p.a, p.b, p.w FROM p JOIN c{k} x ON x.v = p.a JOIN c{k} y ON y.v = p.b WHERE x.c <> y.c)",
            f"m{k} AS MATERIALIZED (SELECT c, arg_min({{'a': a, 'b': b, 'w': w, 'to': t}}, (w, a, b)) AS k FROM "
            f"(SELECT ca AS c, cb AS t, a, b, w FROM o{k} UNION ALL SELECT cb, ca, a, b, w FROM o{k}) GROUP BY c)",
            # two components that pick each other: the smaller one is the root
            f"j{k}_0 AS MATERIALIZED (SELECT x.c, CASE WHEN y.k.to = x.c AND x.c < y.c THEN x.c ELSE x.k.to END AS t FROM m{k} x JOIN m{k} y ON y.c = x.k.to)"]
        out += [f"j{k}_{i + 1} AS MATERIALIZED (SELECT x.c, y.t FROM j{k}_{i} x JOIN j{k}_{i} y ON y.c = x.t)" for i in range(jumps)]
        out.append(f"c{k + 1} AS MATERIALIZED (SELECT c{k}.v, coalesce(j.t, c{k}.c) AS c FROM c{k} LEFT JOIN j{k}_{jumps} j ON j.c = c{k}.c)")
    return ",\n".join(out)


BORUVKA_ROUNDS, BORUVKA_JUMPS = 8, 8  # halves 2^8 components, follows chains of 2^8

ORACLE["spanning_tree"] = f"""
WITH {NEIGHBOURS},
p AS MATERIALIZED (SELECT d.id AS a, d.nbr AS b, greatest(d.dist, x.core, y.core) AS w FROM d JOIN core x ON x.id = d.id JOIN core y ON y.id = d.nbr WHERE d.id < d.nbr),
{_boruvka(BORUVKA_ROUNDS, BORUVKA_JUMPS)}
SELECT DISTINCT k.a AS a, k.b AS b, round(k.w, 6) AS w FROM ({" UNION ALL ".join(f"SELECT k FROM m{k}" for k in range(BORUVKA_ROUNDS))})
"""

FAULTS = """CASE WHEN id % 17 = 0 THEN 'not json' WHEN id % 19 = 0 THEN 'no id' WHEN id % 23 = 0 THEN 'no time' ELSE '' END"""

ORACLE["ingest_quarantine"] = f"""
WITH {ITEMS},
f AS (SELECT *, {FAULTS} AS reason FROM it)
SELECT CASE WHEN reason = '' THEN 'item' ELSE 'rejected' END AS kind, reason, CAST(count(*) AS BIGINT) AS lines,
       CAST(count(DISTINCT CASE WHEN reason = '' THEN id END) AS BIGINT) AS ids,
       CAST(coalesce(sum(CASE WHEN reason = '' THEN CAST(trunc(value) AS BIGINT) END), 0) AS BIGINT) AS score,
       CAST(count(*) FILTER (WHERE reason = '' AND type = 'story') AS BIGINT) AS stories
FROM f GROUP BY reason
"""

ORACLE["ingest_meter"] = f"""
WITH {ITEMS},
f AS (SELECT {FAULTS} AS reason FROM it)
SELECT CAST(3 AS BIGINT) AS batches, CAST(count(*) AS BIGINT) AS lines, CAST(count(*) FILTER (WHERE reason = '') AS BIGINT) AS items,
       CAST(count(*) FILTER (WHERE reason <> '') AS BIGINT) AS rejected, CAST(count(*) AS BIGINT) AS landed
FROM f
"""

ORACLE["post_csv_dirty"] = """
SELECT doc_id AS id, text AS title, n_chars AS score FROM documents WHERE text IS NOT NULL
"""

ORACLE["visible_cap"] = """
SELECT event_id AS id, user_id FROM events
ORDER BY CAST('0x' || substr(md5(CAST(event_id AS VARCHAR)), 1, 15) AS BIGINT), event_id LIMIT 700
"""

ORACLE["viewport_chunks"] = f"""
WITH {GRID},
v0(view, vx, vy, share) AS (VALUES ('corner', 0.0, 0.0, 0.15), ('middle', 0.43, 0.41, 0.2), ('all', 0.0, 0.0, 1.0)),
v AS (SELECT view, x_min + (vx - share * 0.5) * (x_max - x_min) AS fx_min, x_min + (vx + share * 1.5) * (x_max - x_min) AS fx_max,
             y_min + (vy - share * 0.5) * (y_max - y_min) AS fy_min, y_min + (vy + share * 1.5) * (y_max - y_min) AS fy_max FROM v0, g),
n AS (SELECT view,
             count(*) FILTER (WHERE cx_min <= fx_max AND cx_max >= fx_min AND cy_min <= fy_max AND cy_max >= fy_min) AS chunks_read,
             count(*) FILTER (WHERE cx_min >= fx_min AND cx_max <= fx_max AND cy_min >= fy_min AND cy_max <= fy_max) AS chunks_within,
             count(*) AS chunks_listed FROM v, cb GROUP BY view)
SELECT v.view, c.id, c.cluster, CAST(chunks_read AS BIGINT) AS chunks_read, CAST(chunks_within AS BIGINT) AS chunks_within, CAST(chunks_listed AS BIGINT) AS chunks_listed
FROM v JOIN n USING (view) JOIN cells c ON c.x BETWEEN v.fx_min AND v.fx_max AND c.y BETWEEN v.fy_min AND v.fy_max
"""

ORACLE["knn_descent_recall"] = """
SELECT CAST(15 * count(*) AS BIGINT) AS n_exact, CAST(15 * count(*) AS BIGINT) AS n_descent, true AS recall_reached FROM embeddings
"""

ORACLE["keyword_export"] = ORACLE["keyword_top50"]

ORACLE["embedded_sinks"] = """
SELECT vec_id AS id, 'item ' || CAST(vec_id AS VARCHAR) AS title, CAST(len(embedding) AS INTEGER) AS n_dims, true AS same FROM embeddings
"""

ORACLE["cluster_prompts"] = """
WITH d AS (SELECT text AS title, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('42-' || CAST(doc_id AS VARCHAR)), doc_id) AS rn FROM documents),
p AS (SELECT lang, 'Below are headlines that belong together. Answer with a topic label of two to five plain words.' || chr(10) || chr(10)
             || coalesce(string_agg(title, chr(10) ORDER BY encode(title)), '') || chr(10) || chr(10) || 'Topic label:' AS prompt FROM d WHERE rn <= 50 GROUP BY lang)
SELECT lang, md5(prompt) AS prompt_md5, CAST(length(prompt) AS INTEGER) AS n_chars FROM p
"""
