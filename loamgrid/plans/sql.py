"""Fragments of the SQL that checks the queries."""

from .shared import cell_sql, placed_sql

WORDS = r"string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{M}]+')"


def grams(source: str, keys: str) -> str:
    return f"SELECT {keys}, gram, CAST(count(*) AS DOUBLE) AS cnt FROM (SELECT {keys}, unnest({WORDS}) AS gram FROM {source}) WHERE gram <> '' GROUP BY ALL"


def docs(degrees: int) -> str:
    return f"""
dp AS (SELECT *, {placed_sql("doc_id")} FROM documents),
dr AS (SELECT *, {cell_sql(degrees)} FROM dp),
d AS (SELECT *, concat("row", ',', col) AS cell FROM dr),
ip AS (SELECT *, item_id AS doc, {placed_sql("item_id")} FROM benchmark),
ir AS (SELECT *, {cell_sql(degrees)} FROM ip),
items AS (SELECT *, concat("row", ',', col) AS cell FROM ir)"""


def corpus(degrees: int, m: float) -> str:
    return f"""{docs(degrees)},
dg AS ({grams("d", "doc_id, cell")}),
gs AS (SELECT gram, sum(cnt) AS cnt, count(*) AS df FROM dg GROUP BY gram),
gg AS (SELECT gram, cnt, df, cnt / (SELECT sum(cnt) FROM gs) AS g FROM gs),
cg AS (SELECT cell, gram, sum(cnt) AS ck FROM dg GROUP BY ALL),
ct AS (SELECT cell, sum(ck) AS nk, 1 - sum(ck) / (sum(ck) + {m}) AS uk FROM cg GROUP BY cell),
cells AS (SELECT cell, count(*) AS n_docs, avg(lat) AS clat, avg(lon) AS clon, sum(n_chars) AS salience FROM d GROUP BY cell),
t AS ({grams("items", "doc")}),
td AS (SELECT doc, sum(cnt) AS nd, 1 - sum(cnt) / (sum(cnt) + {m}) AS ud FROM t GROUP BY doc)"""


KM = "6376.774 * acos(greatest(-1, least(1, sin(radians({0})) * sin(radians({2})) + cos(radians({0})) * cos(radians({2})) * cos(radians({3}) - radians({1})))))"


def km(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    return KM.format(lat1, lon1, lat2, lon2)


def naive_bayes(degrees: int) -> str:
    return f"""{corpus(degrees, 1000)},
kn AS (SELECT doc, t.gram, t.cnt AS c, g FROM t JOIN gg USING (gram)),
pairs AS (SELECT doc, cell, sum(c * ln(coalesce(ck, 0) * (1 - uk) / nk + uk * g)) AS s
  FROM kn CROSS JOIN ct LEFT JOIN cg USING (cell, gram) GROUP BY ALL),
scored AS (SELECT doc, cell, 0.5 * s + 0.5 * ln(1.0 / (SELECT count(*) FROM ct)) AS score FROM pairs),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY round(score, 6) DESC, cell) AS rank FROM scored),
res AS (
  SELECT i.doc, r.cell AS pred_cell, i.cell AS correct_cell, coalesce(k.rank, 1000000000) AS correct_rank, i.lat, i.lon,
    {km("i.lat", "i.lon", "p.clat", "p.clon")} AS error_km,
    CASE WHEN o.cell IS NOT NULL THEN {km("i.lat", "i.lon", "o.clat", "o.clon")} END AS oracle_km
  FROM items i JOIN ranked r ON i.doc = r.doc AND r.rank = 1 JOIN cells p ON p.cell = r.cell
  LEFT JOIN ranked k ON k.doc = i.doc AND k.cell = i.cell LEFT JOIN cells o ON o.cell = i.cell)"""


NAIVE_BAYES = naive_bayes(30)


def kd_leaves(source: str, key: str, bucket: int, cutoff: int, levels: int = 24) -> str:
    """Leaf and coarse leaf of each point of a K-d tree split at medians, one step of the recursion a level."""
    steps = f"""
WITH RECURSIVE p AS (SELECT {key}, lat, lon FROM (SELECT {key}, {placed_sql(key)} FROM {source})),
t AS (
  SELECT {key}, lat, lon, '' AS path, true AS live, '' AS coarse, true AS whole, 0 AS level FROM p
  UNION ALL
  SELECT {key}, lat, lon, CASE WHEN big THEN path || side ELSE path END, big, CASE WHEN whole AND big AND n > {cutoff} THEN coarse || side ELSE coarse END,
    whole AND big AND n > {cutoff}, level + 1
  FROM (
    SELECT *, CASE WHEN v <= CASE WHEN middle < hi THEN middle ELSE lo END THEN 'L' ELSE 'R' END AS side, n > {bucket} AND lo < hi AS big
    FROM (SELECT *, min(v) OVER (PARTITION BY path) AS lo, max(v) OVER (PARTITION BY path) AS hi, quantile_cont(v, 0.5) OVER (PARTITION BY path) AS middle
      FROM (SELECT *, CASE WHEN wide > high THEN lon ELSE lat END AS v
        FROM (SELECT *, count(*) OVER (PARTITION BY path) AS n, max(lon) OVER (PARTITION BY path) - min(lon) OVER (PARTITION BY path) AS wide,
          max(lat) OVER (PARTITION BY path) - min(lat) OVER (PARTITION BY path) AS high FROM t WHERE live AND level < {levels}))))
  )"""
    return f"{steps}\nSELECT {key}, path AS leaf, coarse FROM t WHERE NOT live"
