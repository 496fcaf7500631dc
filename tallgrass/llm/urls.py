"""URL filter by a path-template tree, with DataFrame functions only.

Per host, path segments form a tree. Segments of variable shape (numbers, hex runs, other segments with digits, very
long ones) become typed wildcards at once; a literal segment with many siblings and a small share of its parent's
pages becomes ``*``. The labelled pages of each template, host and of all hosts are counted; a template whose
share of bad pages does not differ from its host's (a z test on proportions) takes the host's statistics, and a host
likewise those of all pages. Left out: path prefixes between host and template are not counted or merged, and siblings
are found under the typed prefix, not under one whose wildcards are already set.
A template is rejected where its purity (share of good pages, smoothed towards the parent's) is below a limit.

Explicit rules ``(verdict, host, path)`` come first: a rule fits its host and all subdomains if the path starts with
the rule's; the longest wins.

Scale: pages meet only as counts (map-side partial sums) of ``(host, typed path)`` and as labelled counts of
``(host, template)``; the joins back are on keys that are unique on one side, which AQE can split for a hot host.

Defined cases: a null url or one without ``://`` has empty host and path, fits no rule and gets the verdict of its
(empty) template; an id without label, or a label of nulls only, counts as unlabelled; with several labels of an id
one bad label makes it bad; empty tables give no rows; no other column of ``pages`` is used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
#: A literal segment becomes a wildcard if its parent has more than so many children and it has less than 1/SHARE of the parent's pages.
CHILDREN, SHARE = 20, 50
#: Two-sided 5 % limit of the z test, strength of the prior (in pages), and the least purity that is kept.
Z, PRIOR, PURITY = 1.96, 10.0, 0.5


def _double(x: float) -> str:
    """A literal that both dialects read as DOUBLE, not DECIMAL."""
    return f"{x:.6e}"


def sql(pages: str, labels: str, split: str, transform: str, position: str, concat_list: str) -> str:
    """The whole query as SQL text; the arguments name the tables and what the dialects spell differently."""
    fits = " ".join(
        f"WHEN (host = '{h}' OR host LIKE '%.{h}') AND path LIKE '{p}%' THEN '{v} {h}{p}'"
        for v, h, p in sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    )
    typed = (
        "CASE WHEN s = '' THEN '' WHEN regexp_extract(s, '^[0-9]+([.][A-Za-z]+)?$', 0) <> '' THEN concat('{n}', regexp_extract(s, '^[0-9]+([.][A-Za-z]+)?$', 1)) "
        "WHEN regexp_extract(s, '^[0-9a-fA-F-]+$', 0) <> '' AND length(s) >= 8 THEN '{h}' WHEN regexp_extract(s, '[0-9]', 0) <> '' THEN '{x}' WHEN length(s) > 40 THEN '{l}' ELSE s END"
    )
    return f"""
WITH cut AS (
  SELECT page_id, CASE WHEN url LIKE '%://%' THEN substring(url, {position} + 3) ELSE '' END AS rest FROM {pages}
), parsed AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut
), shaped AS (
  SELECT page_id, host, path, CASE {fits} END AS fit, {transform.format(split.format("trim(TRAILING '/' FROM path)") if "{" in split else split, typed)} AS segs FROM parsed
), typed AS (
  SELECT page_id, host, path, fit, {concat_list.format("segs")} AS tpath FROM shaped
), paths AS (
  SELECT host, tpath, count(*) AS n FROM typed GROUP BY host, tpath
), steps AS (
  SELECT host, tpath, n, depth, {concat_list.format("up")} AS parent, seg FROM ({{steps}}) AS s
), kids AS (
  SELECT host, parent, depth, seg, sum(n) AS n FROM steps GROUP BY host, parent, depth, seg
), parents AS (
  SELECT host, parent, depth, count(*) AS children, sum(n) AS n FROM kids GROUP BY host, parent, depth
), wild AS (
  SELECT k.host, k.parent, k.depth, k.seg FROM kids AS k JOIN parents AS p ON k.host = p.host AND k.parent = p.parent AND k.depth = p.depth
  WHERE p.children > {CHILDREN} AND k.n * {SHARE} < p.n AND k.seg NOT LIKE '{{{{%'
), named AS (
  SELECT s.host, s.tpath, s.depth, CASE WHEN w.seg IS NULL THEN s.seg ELSE '*' END AS seg
  FROM steps AS s LEFT JOIN wild AS w ON s.host = w.host AND s.parent = w.parent AND s.depth = w.depth AND s.seg = w.seg
), templates AS (
  SELECT host, tpath, {{gather}} AS template FROM named GROUP BY host, tpath
), marks AS (
  SELECT doc_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM {labels}
  WHERE doc_id IS NOT NULL AND (quality IS NOT NULL OR toxic IS NOT NULL) GROUP BY doc_id
), placed AS (
  SELECT t.page_id, t.host, t.path, t.fit, m.template FROM typed AS t JOIN templates AS m ON t.host = m.host AND t.tpath = m.tpath
), leaf AS (
  SELECT p.host, p.template, count(k.bad) AS n, coalesce(sum(k.bad), 0) AS bad FROM placed AS p LEFT JOIN marks AS k ON p.page_id = k.doc_id GROUP BY p.host, p.template
), hosts AS (
  SELECT host, sum(n) AS n, sum(bad) AS bad FROM leaf GROUP BY host
), total AS (
  SELECT coalesce(sum(n), 0) AS n, coalesce(sum(bad), 0) AS bad, (coalesce(sum(n), 0) - coalesce(sum(bad), 0) + {_double(PRIOR / 2)}) / (coalesce(sum(n), 0) + {_double(PRIOR)}) AS purity FROM hosts
), host_rates AS (
  SELECT h.host, h.n, h.bad, g.purity AS above,
         CASE WHEN h.n = 0 OR abs((h.n - h.bad) / CAST(CASE WHEN h.n = 0 THEN 1 ELSE h.n END AS DOUBLE) - g.purity) <= {_double(Z)} * sqrt(g.purity * (1 - g.purity) / CASE WHEN h.n = 0 THEN 1 ELSE h.n END)
              THEN g.purity ELSE (h.n - h.bad + {_double(PRIOR)} * g.purity) / (h.n + {_double(PRIOR)}) END AS purity
  FROM hosts AS h CROSS JOIN total AS g
), rates AS (
  SELECT l.host, l.template,
         CASE WHEN l.n = 0 OR abs((l.n - l.bad) / CAST(CASE WHEN l.n = 0 THEN 1 ELSE l.n END AS DOUBLE) - h.purity) <= {_double(Z)} * sqrt(h.purity * (1 - h.purity) / CASE WHEN l.n = 0 THEN 1 ELSE l.n END)
              THEN h.purity ELSE (l.n - l.bad + {_double(PRIOR)} * h.purity) / (l.n + {_double(PRIOR)}) END AS purity
  FROM leaf AS l JOIN host_rates AS h ON l.host = h.host
)
SELECT p.page_id, p.host, p.path, substring(p.fit, 7) AS rule,
       CASE WHEN p.fit IS NOT NULL THEN substring(p.fit, 1, 5) WHEN r.purity < {_double(PURITY)} THEN 'block' ELSE 'allow' END AS verdict,
       p.template, round(r.purity, 6) AS purity
FROM placed AS p JOIN rates AS r ON p.host = r.host AND p.template = r.template
"""


def spark_sql() -> str:
    text = sql("{pages}", "{labels}", "split({0}, '/')", "transform({0}, s -> {1})", "instr(url, '://')", "array_join({0}, '/')")
    steps = "SELECT host, tpath, n, pos + 1 AS depth, slice(split(tpath, '/'), 1, pos) AS up, seg FROM paths LATERAL VIEW posexplode(split(tpath, '/')) AS pos, seg"
    gather = "array_join(transform(array_sort(collect_list(struct(depth, seg))), x -> x.seg), '/')"
    return text.replace("{steps}", steps).replace("{gather}", gather).replace("{{%", "{%")


def duckdb_sql() -> str:
    text = sql("pages", "labels", "string_split({0}, '/')", "list_transform({0}, lambda s: {1})", "instr(url, '://')", "array_to_string({0}, '/')")
    steps = "SELECT host, tpath, n, pos AS depth, list_slice(string_split(tpath, '/'), 1, pos - 1) AS up, string_split(tpath, '/')[pos] AS seg FROM paths, LATERAL (SELECT unnest(range(1, len(string_split(tpath, '/')) + 1)) AS pos) AS q"
    gather = "array_to_string(list(seg ORDER BY depth), '/')"
    return text.replace("{steps}", steps).replace("{gather}", gather).replace("{{%", "{%")


def filter_urls(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """``page_id, host, path, rule, verdict, template, purity`` of every row of ``pages``."""
    spark = pages.sparkSession
    pages, labels = pages.select(F.col("page_id").cast("long").alias("page_id"), "url"), labels.select("doc_id", "quality", "toxic")
    text = spark_sql()
    # only the two table names are to be filled in; other braces are literal
    marked = text.replace("{pages}", "\x00p").replace("{labels}", "\x00l").replace("{", "{{").replace("}", "}}").replace("\x00p", "{pages}").replace("\x00l", "{labels}")
    return spark.sql(marked, pages=pages, labels=labels)
