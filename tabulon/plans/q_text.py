"""Text jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import text as N
from . import query, rnd

c = F.col


@query("n1_luhn")
def _(t):
    return N.luhn(t.documents, "doc_id", "text")


@query("n1_sumbasic")
def _(t):
    return N.sumbasic(t.documents, "doc_id", "text", 2)


@query("n1_kl_sum")
def _(t):
    return N.kl_sum(t.documents, "doc_id", "text", 2)


@query("n2_lexrank")
def _(t):
    return N.rank_summary(t.documents, "doc_id", "text", 2, "lexrank")


@query("n2_textrank")
def _(t):
    return N.rank_summary(t.documents, "doc_id", "text", 2, "textrank")


_WORDS = "SELECT doc_id, unnest(regexp_extract_all(lower(text), '\\p{L}+')) AS w FROM documents"


_COSINE = f"""WITH tf AS (SELECT doc_id, w, count(*) AS tf FROM ({_WORDS}) GROUP BY ALL), n AS (SELECT count(DISTINCT doc_id) AS n FROM documents),
idf AS (SELECT w, ln((1.0 + any_value(n)) / (1.0 + count(*))) + 1 AS idf FROM tf, n GROUP BY w),
x AS (SELECT doc_id, w, tf * idf AS x FROM tf JOIN idf USING (w)), nx AS (SELECT doc_id, sqrt(sum(x * x)) AS nx FROM x GROUP BY 1),
z AS (SELECT label, w, count(*) * coalesce(any_value(idf), 1) AS z FROM (SELECT CAST(item_id AS VARCHAR) AS label, unnest(regexp_extract_all(lower(text), '\\p{{L}}+')) AS w FROM benchmark) LEFT JOIN idf USING (w) GROUP BY ALL),
nz AS (SELECT label, sqrt(sum(z * z)) AS nz FROM z GROUP BY 1),
s AS (SELECT doc_id, label, round(any_value(d) / any_value(nx) / any_value(nz), 9) AS score FROM (SELECT doc_id, label, sum(x * z) AS d FROM x JOIN z USING (w) GROUP BY ALL) JOIN nx USING (doc_id) JOIN nz USING (label) GROUP BY ALL),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, label) = 1)
SELECT doc_id, label AS v_class, round(score, 6) AS v_score FROM documents LEFT JOIN b USING (doc_id)"""


@query("n3_classify", _COSINE)
def _(t):
    labels = t.benchmark.select(c("item_id").cast("string").alias("label"), c("text").alias("description"))
    return N.classify(t.documents, "doc_id", "text", labels).withColumn("v_score", rnd("v_score", 6))


@query("n4_sentiment", f"WITH w AS ({_WORDS}), s AS (SELECT doc_id, avg(CASE w WHEN 'the' THEN 1.0 WHEN 'that' THEN 0.5 WHEN 'of' THEN -1.0 END) AS score FROM w WHERE w IN ('the', 'that', 'of') GROUP BY 1) SELECT doc_id, CASE WHEN round(coalesce(score, 0), 9) > 0.05 THEN 'positive' WHEN round(coalesce(score, 0), 9) < -0.05 THEN 'negative' ELSE 'neutral' END AS label, round(coalesce(score, 0), 6) AS score FROM documents LEFT JOIN s USING (doc_id)")
def _(t):
    lexicon = t.spark.range(1).select(F.inline(F.array(*(F.struct(F.lit(w).alias("word"), F.lit(s).alias("score")) for w, s in (("the", 1.0), ("that", 0.5), ("of", -1.0))))))
    return N.sentiment(t.documents, "doc_id", "text", lexicon).withColumn("score", rnd("score", 6))


@query("n5_entities", f"WITH w AS (SELECT doc_id, i, ws[i] AS a, ws[i] || ' ' || ws[i + 1] AS b FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(lower(text), '\\p{{L}}+') AS ws FROM documents))), h AS (SELECT doc_id, i, 1 AS n, 'the/WORD' AS e FROM w WHERE a = 'the' UNION ALL SELECT doc_id, i, 2, 'of the/PAIR' FROM w WHERE b = 'of the'), g AS (SELECT doc_id, string_agg(e, ', ' ORDER BY i, n) AS entities, count(*) AS n FROM h GROUP BY 1) SELECT doc_id, coalesce(entities, '') AS entities, coalesce(n, 0) AS n FROM documents LEFT JOIN g USING (doc_id)")
def _(t):
    names = t.spark.range(1).select(F.inline(F.array(*(F.struct(F.lit(p).alias("phrase"), F.lit(g).alias("group")) for p, g in (("the", "WORD"), ("of the", "PAIR"))))))
    return N.entities(t.documents, "doc_id", "text", names, 2)


@query("n6_embed")
def _(t):
    return N.embed(t.documents, "doc_id", "text", dims=8, features=256)
