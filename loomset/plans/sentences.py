"""The sentence model's queries, and their SQL: counts, ratios, decisions and the cut texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomset.functions import text
from loomset.operators import sentences as s
from loomset.plans.catalog import query, t
from loomset.plans.endtoend import nested_sql

CLOSING, OPENING = s.CLOSING.replace("'", "''"), s.OPENING.replace("'", "''")


def core(w: str) -> str:
    return f"ltrim(rtrim({w}, '{CLOSING}'), '{OPENING}')"


def typed(w: str) -> str:
    base = f"rtrim({core(w)}, '.,;:!?')"
    return f"CASE WHEN regexp_matches({base}, '^[-+]?[0-9][0-9.,]*$') THEN '#' ELSE lower({base}) END"


def stop(w: str) -> str:
    return f"CASE WHEN {core(w)} LIKE '%..' THEN 'dots' WHEN {core(w)} LIKE '%.' THEN 'dot' WHEN right({core(w)}, 1) IN ('!', '?') THEN 'mark' ELSE '' END"


def capital(w: str) -> str:
    return f"left({core(w)}, 1) <> lower(left({core(w)}, 1))"


def logs(k: str, n: str, p: str) -> str:
    return f"(CASE WHEN {k} > 0 THEN {k} * ln({p}) ELSE 0 END + CASE WHEN {n} > {k} THEN ({n} - {k}) * ln(1 - {p}) ELSE 0 END)"


def ratio(a: str, b: str, ab: str, n: str) -> str:
    a, b, ab, n = (f"CAST({x} AS DOUBLE)" for x in (a, b, ab, n))
    return f"2 * ({logs(ab, a, f'({ab} / {a})')} + {logs(f'({b} - {ab})', f'({n} - {a})', f'(({b} - {ab}) / ({n} - {a}))')} - {logs(ab, a, f'({b} / {n})')} - {logs(f'({b} - {ab})', f'({n} - {a})', f'({b} / {n})')})"


SPECIAL = "(abbreviation OR typ = '#' OR regexp_matches(typ, '^\\p{L}$'))"
K, N, LETTERS = "CAST(dotted AS DOUBLE)", "CAST(n AS DOUBLE)", "CAST(length(replace(typ, '.', '')) AS DOUBLE)"
ENDS = ", ".join(f"'{c}'" for c in ".!?:" + s.CLOSING).replace("''',", "'''',")
MODEL = f"""
w AS (SELECT doc_id, lang, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS i FROM (SELECT doc_id, lang, list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents)),
c AS (SELECT *, lead(word) OVER v AS next, lag(word) OVER v AS prev FROM w WINDOW v AS (PARTITION BY doc_id ORDER BY i)),
d AS (SELECT doc_id, i, lang, word, next, {typed("word")} AS typ, {stop("word")} AS stop, {capital("word")} AS capital, coalesce(prev IS NOT NULL AND right(prev, 1) NOT IN ({ENDS}), false) AS inside FROM c),
q AS (SELECT lang, typ, count(*) AS n, count(*) FILTER (stop = 'dot') AS dotted, bool_or(NOT capital) AS low, bool_or(capital AND inside) AS "inner" FROM d GROUP BY 1, 2),
tot AS (SELECT lang, sum(n) AS a, sum(dotted) AS p FROM q GROUP BY 1),
sc AS (SELECT q.*, a, CASE WHEN regexp_matches(typ, '^\\p{{L}}') AND dotted > 0 AND p < a THEN 2 * ({logs(K, N, "CAST(0.99 AS DOUBLE)")} - {logs(K, N, "(CAST(p AS DOUBLE) / a)")}) * exp(-{LETTERS}) * (length(typ) - {LETTERS} + 1) * pow({LETTERS}, {K} - {N}) END AS score FROM q JOIN tot USING (lang)),
ab AS (SELECT *, coalesce(score >= 0.3, false) AS abbreviation FROM sc),
af AS (SELECT lang, typ, {typed("next")} AS nt, count(*) AS ab FROM d WHERE stop = 'dot' AND next IS NOT NULL GROUP BY 1, 2, 3),
ag AS (SELECT af.*, ab.dotted, {SPECIAL.replace("typ", "ab.typ")} AS special FROM af JOIN ab USING (lang, typ)),
ol AS (SELECT lang, sum(ab) AS breaks FROM ag WHERE NOT special GROUP BY 1),
fi AS (SELECT lang, nt, sum(ab) AS ab FROM ag WHERE NOT special GROUP BY 1, 2),
st AS (SELECT fi.lang, nt AS typ FROM fi JOIN ol USING (lang) JOIN ab ON ab.lang = fi.lang AND ab.typ = fi.nt WHERE regexp_matches(nt, '^\\p{{L}}+$') AND {ratio("breaks", "ab.n", "fi.ab", "ab.a")} >= 30 AND CAST(fi.ab AS DOUBLE) / breaks > CAST(ab.n AS DOUBLE) / ab.a),
pr AS (SELECT ag.lang, ag.typ, ag.nt FROM ag JOIN ab ON ab.lang = ag.lang AND ab.typ = ag.nt WHERE special AND {ratio("ag.dotted", "ab.n", "ag.ab", "ab.a")} >= 7.88 AND CAST(ag.ab AS DOUBLE) / ag.dotted > CAST(ab.n AS DOUBLE) / ab.a),
ty AS (SELECT ab.lang, ab.typ, n, dotted, score, abbreviation, low, "inner", st.typ IS NOT NULL AS starter FROM ab LEFT JOIN st ON st.lang = ab.lang AND st.typ = ab.typ)"""
DECIDED = f"""
k AS (SELECT d.doc_id, d.i, CASE WHEN next IS NULL THEN false WHEN stop = 'mark' THEN true WHEN stop = 'dots' THEN {capital("next")} WHEN stop = 'dot' AND {SPECIAL.replace("typ", "a.typ").replace("abbreviation", "a.abbreviation")}
  THEN {capital("next")} AND (b.starter OR b.low AND NOT b."inner") AND pr.typ IS NULL ELSE stop = 'dot' END AS ends
  FROM d JOIN ty a ON a.lang = d.lang AND a.typ = d.typ LEFT JOIN ty b ON b.lang = d.lang AND b.typ = {typed("d.next")} LEFT JOIN pr ON pr.lang = d.lang AND pr.typ = d.typ AND pr.nt = {typed("d.next")}),
x AS (SELECT doc_id, unnest(p) AS piece, generate_subscripts(p, 1) - 1 AS i FROM (SELECT doc_id, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+[\\x20\\x09-\\x0D]*') AS p FROM documents)),
y AS (SELECT doc_id, piece, i, ends, coalesce(sum(ends::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS j FROM x JOIN k USING (doc_id, i))"""


def model(spark: SparkSession, sf: str) -> tuple[DataFrame, s.Model]:
    docs = t(spark, sf, "documents").select("doc_id", "lang", "text")
    return docs, s.trained(docs)


@query("str2_sentence_model", f"WITH {MODEL} SELECT lang, typ, n, dotted, round(score, 6) AS score, abbreviation, low, \"inner\", starter FROM ty")
def _(spark, sf):
    types = model(spark, sf)[1].types
    return types.withColumn("score", F.round("score", 6))


@query("str2_collocations", f"WITH {MODEL} SELECT lang, typ, nt AS next FROM pr")
def _(spark, sf):
    return model(spark, sf)[1].pairs


#: Texts with a word. A condition on what was cut would be worked out beside the cut: the text would be cut twice.
WORDY = r"text rlike r'[^\x20\x09-\x0D]'"


@query("str2_sentences", f"WITH {MODEL}, {DECIDED}, z AS (SELECT doc_id, j, string_agg(piece, '' ORDER BY i) AS sentence FROM y GROUP BY 1, 2) SELECT doc_id, count(*) AS n, md5(string_agg(rtrim(sentence, E' \\t\\n\\x0b\\x0c\\r'), '|' ORDER BY j)) AS sentences FROM z GROUP BY 1")
def _(spark, sf):
    docs, learned = model(spark, sf)
    found = s.sentences(docs.where(WORDY), learned)
    return found.select("doc_id", F.size("sentences").cast("long").alias("n"), F.md5(F.array_join("sentences.word", "|")).alias("sentences"))


CUT = nested_sql("marked", [(p, text.replacement(g, "\\")) for p, g in text.TREEBANK])


@query(
    "str2_words_of_sentences",
    f"""WITH {MODEL}, {DECIDED}, z AS (SELECT doc_id, string_agg(CASE WHEN ends OR last THEN rtrim(piece, E' \\t\\n\\x0b\\x0c\\r') || '{text.END}' || substr(piece, length(rtrim(piece, E' \\t\\n\\x0b\\x0c\\r')) + 1) ELSE piece END, '' ORDER BY i) AS marked
    FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i DESC) = 1 AS last FROM y) GROUP BY 1)
    SELECT doc_id, md5(array_to_string(list_filter(regexp_split_to_array({CUT}, '[\\s{text.CUT}{text.END}]+'), lambda x: x <> ''), '|')) AS words FROM z""",
)
def _(spark, sf):
    docs, learned = model(spark, sf)
    found = s.words_of_sentences(docs.where(WORDY), learned)
    return found.select("doc_id", F.md5(F.array_join("words.word", "|")).alias("words"))
