"""op7: secrets in all documents, with their ownership across sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import secrets as S
from .common import table


def op7_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = S.counted(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("spans", lambda x: x["rank"] == S.KINDS.index(k))).cast("long").alias(f"n_{k}")
    base = F.filter("spans", lambda x: x["rank"] < len(S.BASE))
    return found.select("doc_id", *map(count, S.BASE), F.sha2(S.listed(base), 256).alias("base_sha256"), S.listed(F.col("spans")).alias("spans"), "n_live", "n_shared")


#: The wider kinds as RE2 spells them: it has no look around, so a token takes an escape before it along, which is cut off again,
#: and one that follows a dash is dropped; a key without its END line is its header alone (tests compare such keys in Python).
_WIDER = S.WIDER | {
    "pem": (r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:[^-]*(?:-{1,4}[^-]+)*-----END [A-Z ]*PRIVATE KEY-----)?", "-----"),
    "jwt": (r"(?:\\[nrt]|\b)eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", "eyJ"),
}
_FRAME = r"""-----(?:BEGIN|END) [A-Z ]*-*|[ \t-\r"'>#*,|]|\\[nr]"""


def _sql() -> str:
    q = lambda p: p.replace("'", "''")
    parts = []
    for rank, (kind, (p, group, least)) in enumerate(S.BASE.items()):
        value = f"regexp_extract(m[k], '{q(p)}', {group})"
        parts.append(f"SELECT rid, own, repo, {rank} AS rank, '{kind}' AS kind, s, e, v FROM (SELECT rid, own, repo, st AS s, en AS e, v FROM (SELECT *, {value} AS v FROM ({_spans(q(p))})) WHERE length(v) >= {least})")
    w = q("|".join(p for p, _ in _WIDER.values()))
    for k, (kind, (_, start)) in enumerate(_WIDER.items()):
        cut = f"coalesce(nullif(regexp_replace(x, '{q(_FRAME)}', '', 'g'), ''), x)" if kind == "pem" else "x"
        rows = f"SELECT *, regexp_replace(m[k], '^\\\\[nrt]', '') AS x FROM ({_spans(w)})"
        parts.append(f"SELECT rid, own, repo, {len(S.BASE) + k} AS rank, '{kind}' AS kind, en - length(x) AS s, en AS e, {cut} AS v FROM ({rows}) WHERE starts_with(x, '{start}')" + (" AND (p[k] = '' OR p[k][-1] <> '-' OR m[k] <> x)" if kind == "jwt" else ""))
    return f"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, coalesce(source, '') AS own, concat_ws('/', source, lang) AS repo FROM documents),
a AS ({" UNION ALL ".join(parts)}),
o AS (SELECT v, count(DISTINCT own) AS n_owners FROM a GROUP BY v),
j AS (SELECT a.*, n_owners >= 3 AS shared,
             kind = 'pem' OR NOT regexp_matches(CASE kind WHEN 'login' THEN regexp_extract(v, '^://[^:]*:(.*)@$', 1) ELSE v END, '{q(S.PLACEHOLDER)}') AS live FROM a JOIN o USING (v)),
g AS (SELECT rid, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
             string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank, e) FILTER (rank < {len(S.BASE)}) AS base,
             string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank, e) AS spans,
             count(*) FILTER (live AND NOT shared) AS n_live, count(*) FILTER (shared) AS n_shared FROM j GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0)::BIGINT AS n_live, coalesce(n_shared, 0)::BIGINT AS n_shared
FROM t LEFT JOIN g USING (rid)
"""


def _spans(pattern: str) -> str:
    return f"""SELECT *, en - length(m[k]) AS st FROM (SELECT *, (list_sum(list_transform(p[1:k], lambda x: length(x))) + list_sum(list_transform(m[1:k], lambda x: length(x))))::BIGINT AS en
        FROM (SELECT rid, own, repo, m, p, unnest(range(1, len(m) + 1)) AS k FROM (SELECT rid, own, repo, regexp_extract_all(t, '{pattern}') AS m, regexp_split_to_array(t, '{pattern}') AS p FROM t)))"""


QUERIES = {"op7_secret_scans": op7_secret_scans}
SQLS = {"op7_secret_scans": _sql()}
