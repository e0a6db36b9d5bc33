"""SQL of the relations and ranking operators, for the oracles: text that DuckDB runs on the driver's tables."""

from __future__ import annotations

CATALOG = """cat AS (SELECT CAST(p_partkey AS VARCHAR) AS track_id, [p_name] AS track_name, [p_brand] AS artist_name, [p_type] AS album_name,
  list_append(string_split(p_name, ' '), lower(p_type)) AS tag_list, p_retailprice AS popularity,
  CAST(CASE WHEN p_partkey % 5 = 0 THEN 0 WHEN p_partkey % 5 = 1 THEN p_size * 10 ELSE p_size * 10000 END AS DOUBLE) AS duration,
  p_partkey AS ord, p_name, p_brand, p_type, p_size, p_retailprice FROM part)"""

MESSAGES = """talk AS (SELECT * FROM conversations WHERE role IN ('user', 'assistant')),
msgs AS (SELECT conv_id AS session_id, turn * 2 AS pos, turn // 2 + 1 AS turn_number, role, text AS content FROM talk
  UNION ALL SELECT conv_id, turn * 2 + 1, turn // 2 + 1, 'music', CAST((conv_id * 31 + turn * 7) % (SELECT count(*) FROM part) AS VARCHAR) FROM talk WHERE role = 'assistant')"""

SESSIONS = """sess AS (SELECT conv_id AS session_id, arg_min(CASE WHEN role = 'user' THEN text END, CASE WHEN role = 'user' THEN turn END) AS listener_goal,
  CASE WHEN conv_id % 7 <> 0 THEN ['HH', 'HL', 'LH', 'LL'][conv_id % 4 + 1] END AS specificity,
  CASE WHEN conv_id % 3 <> 0 THEN concat('culture ', conv_id % 5) END AS culture, conv_id AS ord FROM conversations GROUP BY conv_id)"""

VECTORS = """q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings WHERE vec_id % 50 = 0),
it AS (SELECT vec_id AS item_id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings WHERE vec_id % 50 <> 0),
kinds AS (SELECT query_id, ['HH', 'HL', 'LH', 'LL'][(query_id // 50) % 4 + 1] AS specificity FROM q),
gold AS (SELECT query_id, min(item_id) AS item_id FROM q JOIN it USING (label) GROUP BY query_id),
sizes AS (SELECT (SELECT count(*) FROM it) AS catalog_size, (SELECT count(*) FROM q) AS turns)"""


def dense(k: int, first: int | None = None, cosine: bool = True) -> str:
    cut = f"[1:{first}]" if first else ""
    f = "list_cosine_similarity" if cosine else "list_inner_product"
    return f"""SELECT query_id, rank, item_id, score FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS INT) AS rank
  FROM (SELECT query_id, item_id, round({f}(q.v{cut}, it.v{cut}), 6) AS score FROM q, it)) WHERE rank <= {k}"""


def ranked(inner: str, order: str, keys: str = "query_id", top: str | None = None, extra: str = "") -> str:
    cut = f" WHERE rank <= {top}" if top else ""
    return f"SELECT {keys}, rank, item_id{extra} FROM (SELECT *, CAST(row_number() OVER (PARTITION BY {keys} ORDER BY {order}) AS INT) AS rank FROM ({inner})){cut}"


def rrf(a: str, b: str, weight: str = "0.25", k: int = 60, top: int = 20, keys: str = "query_id", join: str = "") -> str:
    inner = f"""SELECT {keys}, item_id, r1, r2, round(coalesce(1e0 / ({k} + r1), 0) + coalesce({weight} / ({k} + r2), 0), 9) AS score
  FROM (SELECT {keys}, item_id, min(r1) AS r1, min(r2) AS r2 FROM (SELECT {keys}, item_id, rank AS r1, NULL::INT AS r2 FROM {a} UNION ALL SELECT {keys}, item_id, NULL, rank FROM {b}) GROUP BY ALL) {join}"""
    return ranked(inner, "score DESC, r1 NULLS LAST, r2 NULLS LAST, item_id", keys, str(top), ", score")


def exact(base: str, weight: str, keys: str = "query_id", join: str = "") -> str:
    inner = f"""SELECT {keys}, item_id, rank AS was, round((n - rank + 1) / n + {weight} * coalesce(exact, 0), 9) AS score
  FROM (SELECT *, count(*) OVER (PARTITION BY {keys}) AS n FROM {base}) LEFT JOIN exacts USING (query_id, item_id) {join}"""
    return ranked(inner, "score DESC, was", keys, None, ", score")


NOVELTY = "CASE WHEN turns <= 0 THEN 0 ELSE ln((turns + 1.0) / (coalesce(times, 0) + 1.0)) / ln(turns + 1.0) END"


def diversity(base: str, times: str, p: str, w: str, keys: str = "query_id") -> str:
    inner = f"""SELECT *, CASE WHEN tail > 0 THEN round((m - tail + 1) / m + {w} * novelty, 9) END AS score, was AS before
  FROM (SELECT b.* EXCLUDE (rank), rank AS was, rank - {p} AS tail, count(*) OVER (PARTITION BY {keys}) - {p} AS m, {NOVELTY} AS novelty FROM {base} b LEFT JOIN {times} USING (item_id), sizes)"""
    return ranked(inner, f"CASE WHEN tail > 0 THEN {p} + 1 ELSE before END, score DESC, before", keys)


def _merged(base: str, reservoir: str, keys: str, cfg: str) -> str:
    return f"""SELECT {keys}, item_id, min(r1) AS r1, min(r2) AS r2{cfg} FROM (SELECT {keys}, item_id, rank AS r1, NULL::INT AS r2{cfg} FROM {base} UNION ALL SELECT {keys}, item_id, NULL, rank{cfg} FROM {reservoir}) GROUP BY ALL"""


def expansion(base: str, reservoir: str, times: str, p: str, r: str, w: str, start: str = "21", end: str = "100", keys: str = "query_id", cfg: str = "") -> str:
    inner = f"""SELECT *, CASE WHEN r1 IS NULL THEN row_number() OVER (PARTITION BY {keys}, r1 IS NULL ORDER BY score DESC, r2, item_id) END AS place
  FROM (SELECT *, greatest(0, least({r}, n - least({p}, n))) AS swapped, CASE WHEN r1 IS NULL THEN round(21.0 / greatest(r2, 21) + {w} * novelty, 9) END AS score
    FROM (SELECT m.*, count(r1) OVER (PARTITION BY {keys}) AS n, {NOVELTY} AS novelty FROM ({_merged(base, reservoir, keys, cfg)}) m LEFT JOIN {times} USING (item_id), sizes)
    WHERE r1 IS NOT NULL OR r2 BETWEEN {start} AND {end})"""
    inner = f"SELECT * FROM ({inner}) WHERE r1 IS NOT NULL OR place <= swapped"
    return ranked(inner, "CASE WHEN r1 <= n - swapped THEN 0 WHEN r1 IS NULL THEN 1 ELSE 2 END, coalesce(r1, place)", keys, "n")


def selective(base: str, reservoir: str, times: str, p: str = "12", w: str = "1.35", bonus: str = "0.14", start: str = "11", end: str = "100", keys: str = "query_id", cfg: str = "") -> str:
    inner = f"""SELECT *, row_number() OVER (PARTITION BY {keys}, fixed ORDER BY score DESC, own DESC, found, was, item_id) AS place
  FROM (SELECT *, round(1.0 / log2(found + 1.0) + {w} * novelty + CASE WHEN own = 1 THEN {bonus} ELSE 0 END, 9) AS score
    FROM (SELECT m.*, coalesce(r1 <= {p}, false) AS fixed, CAST(r1 IS NOT NULL AS INT) AS own, CASE WHEN r1 IS NOT NULL THEN coalesce(r2, r1) ELSE r2 END AS found, coalesce(r1, 1000000000) AS was,
      count(r1) OVER (PARTITION BY {keys}) AS n, {NOVELTY} AS novelty FROM ({_merged(base, reservoir, keys, cfg)}) m LEFT JOIN {times} USING (item_id), sizes)
    WHERE own = 1 OR r2 BETWEEN {start} AND {end})"""
    inner = f"SELECT * FROM ({inner}) WHERE fixed OR place <= n - least({p}, n)"
    return ranked(inner, "CASE WHEN fixed THEN r1 ELSE 1000000000 END, found, was, item_id", keys)


def times(base: str) -> str:
    return f"SELECT item_id, count(*) AS times FROM {base} GROUP BY item_id"


def score_configs(rows: str) -> str:
    return f"""SELECT config_id, round(ndcg, 6) AS ndcg_20, round(div, 6) AS catalog_diversity, round(0.8 * ndcg + 0.2 * div, 6) AS final_score
  FROM (SELECT config_id, sum(CASE WHEN r.item_id = g.item_id THEN 1.0 / log2(rank + 1.0) ELSE 0 END) / any_value(turns) AS ndcg, count(DISTINCT r.item_id) / any_value(catalog_size) AS div
    FROM {rows} r JOIN gold g USING (query_id), sizes WHERE rank <= 20 GROUP BY config_id)"""


def plain(x: str) -> str:
    return f"trim(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'))"


def overlap(query: str, value: str) -> str:
    words = lambda x: f"list_distinct(list_filter(string_split({x}, ' '), lambda w: w <> ''))"
    return f"CASE WHEN len({words(value)}) > 0 THEN len(list_intersect({words(value)}, {words(query)})) / len({words(value)}) ELSE 0.0 END"


def phrase(query: str, value: str) -> str:
    return f"({value} <> '' AND contains({query}, {value}))"


def exact_score(query: str, title: str, artist: str, album: str) -> str:
    graded = lambda v, a, b, c: f"CASE WHEN {phrase(query, v)} THEN {a} WHEN {overlap(query, v)} = 1 THEN {b} WHEN {overlap(query, v)} >= 0.5 THEN {c} * {overlap(query, v)} ELSE 0 END"
    return f"round(({graded(title, 6, 3, 1.5)}) + ({graded(artist, 4, 2, 1)}) + CASE WHEN {phrase(query, album)} THEN 1 ELSE 0 END + CASE WHEN {phrase(query, title)} AND {phrase(query, artist)} THEN 5 ELSE 0 END, 9)"


#: The two branches, the reservoir, requests and exact scores of the chain.
CHAIN = f"""{VECTORS},
a50 AS ({dense(50)}), b50 AS ({dense(50, 32, False)}), a100 AS ({dense(100)}), b100 AS ({dense(100, 32, False)}),
adaptive AS ({rrf("a50", "b50")}), goal_branch AS ({rrf("b50", "a50", "0.5")}), reservoir AS ({rrf("a100", "b100", top=100)}),
fw AS (SELECT query_id, CASE specificity WHEN 'HH' THEN 0.2 WHEN 'HL' THEN 0.4 WHEN 'LH' THEN 0.6 ELSE 0.8 END AS weight FROM kinds),
ew AS (SELECT query_id, CASE specificity WHEN 'HH' THEN 0.05 WHEN 'HL' THEN 0.1 WHEN 'LH' THEN 0.15 ELSE 0.0 END AS weight FROM kinds),
tracks AS (SELECT p_partkey AS item_id, {plain("p_name")} AS title, {plain("p_brand")} AS artist, {plain("p_type")} AS album FROM part),
requests AS (SELECT query_id, {plain("concat('play ', p_name, ' by ', p_brand)")} AS request FROM q JOIN part ON p_partkey = query_id % (SELECT count(*) FROM part)),
fused AS ({rrf("adaptive", "goal_branch", "weight", join="JOIN fw USING (query_id)")}),
exacts AS (SELECT query_id, item_id, {exact_score("request", "title", "artist", "album")} AS exact FROM fused JOIN tracks USING (item_id) JOIN requests USING (query_id)),
matched AS ({exact("fused", "weight", join="JOIN ew USING (query_id)")}), matched_times AS ({times("reservoir")}),
diverse AS ({diversity("(SELECT * EXCLUDE (score) FROM matched)", "matched_times", "5", "1.0")}), diverse_times AS ({times("diverse")})"""
