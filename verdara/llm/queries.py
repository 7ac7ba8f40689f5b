"""The corpus operators bound to the given tables, with production parameters, over all rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F  # noqa: F401

from verdara.llm import byte_bpe, fertility, fingerprint, html_text, licenses, packing, periodic_runs, personal, piece_bpe, pitman_yor, sharding, simhash, token_align
from verdara.llm.common import ASCII_UPPER, table
from verdara.sources.scratch import stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_fertility_rules(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    measured = stored(fertility.measure(docs).drop("text"))
    judged = fertility.judge(measured, fertility.fit_bands(measured))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines",
                         "n_repeat_words", "base_failed", "kept", "n_tokens", "chars_per_token",
                         "byte_share", "entropy")


@query
def op2_best_fit_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op3_dom_tree_model(spark, sf_dir):
    return html_text.extract(table(spark, sf_dir, "pages")).drop("html")


@query
def op4_multiset_fingerprint(spark, sf_dir):
    return fingerprint.edited_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op5_jump_shards(spark, sf_dir):
    return sharding.assign(table(spark, sf_dir, "documents").select("doc_id", "text"), shards=8)


@query
def op6_byte_bpe(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return byte_bpe.encode_documents(docs).drop("text")


@query
def op9_license_join(spark, sf_dir):
    return licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op7_skip_chain_field(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return personal.find(docs).drop("text")


@query
def op8_gray_simhash(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return simhash.near_duplicates(docs).select(
        "doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"),
        F.col("component").alias("component_id"))


@query
def op10_pitman_yor(spark, sf_dir):
    return pitman_yor.score(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op11_piece_bpe(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return piece_bpe.encode_documents(docs).drop("text")


@query
def op12_periodic_runs(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", periodic_runs.with_periodic_tails().alias("text"))
    return periodic_runs.find_runs(docs).drop("text")


@query
def op13_token_align(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    aligned = stored(token_align.align(docs).drop("text"))
    counts = token_align.count_links(aligned, token_align.vocabulary_size()).toPandas()
    return token_align.judge(aligned, counts)


def _words_sql(text: str) -> str:
    lower = f"translate({text}, '{ASCII_UPPER}', '{ASCII_UPPER.lower()}')"
    return f"list_filter(regexp_split_to_array({lower}, '{licenses.SEPARATORS}'), lambda w: w <> '')"


def _license_sql(threshold: float = 0.8) -> str:
    """All pairs of blocks and templates, without filters."""
    def quoted(x: str) -> str:
        return "'" + x.replace("'", "''") + "'"

    templates = ", ".join(f"({i}, {quoted(label)}, {quoted(t)})" for i, (label, t) in enumerate(licenses.TEMPLATES))
    places = ", ".join(
        f"list_transform(list_filter(range(1, len(ws) + 1), lambda i: "
        + " AND ".join(f"ws[i + {k}] = '{w}'" for k, w in enumerate(phrase))
        + f"), lambda i: {{'pos': i - 1, 'label': '{label}'}})" for label, phrase in licenses.BASE.items())
    blank = r"\n[\x20\t\r]*\n"
    return f"""WITH docs AS (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS text FROM documents),
tok AS (SELECT id, doc_id, text, {_words_sql('text')} AS ws FROM docs),
base AS (SELECT id, doc_id, len(ws) AS n_words, flatten([{places}]) AS pl FROM tok),
tpl AS (SELECT no, label, list_distinct(aw) AS tw, len(aw) AS length
  FROM (SELECT no, label, {_words_sql('t')} AS aw FROM (VALUES {templates}) v(no, label, t))),
line AS (
  SELECT id, k, bw, CAST(sum(len(bw)) OVER (PARTITION BY id ORDER BY k) AS BIGINT) AS upto,
    upto - len(bw) AS before
  FROM (SELECT id, k, {_words_sql('b')} AS bw FROM (
    SELECT id, unnest(string_split(text, chr(10))) AS b, generate_subscripts(string_split(text, chr(10)), 1) AS k
    FROM docs))),
tplword AS (SELECT no, label, len(tw) AS n, length, unnest(tw) AS w FROM tpl),
occ AS (
  SELECT id, k, upto, before, no, label, n, length, w
  FROM (SELECT id, k, upto, before, unnest(list_distinct(bw)) AS w FROM line) JOIN tplword USING (w)),
run AS (
  SELECT s.id, s.k, s.no, s.label, s.n, count(DISTINCT o.w) / s.n AS c
  FROM (SELECT DISTINCT id, k, upto, no, label, n, length FROM occ) s JOIN occ o
    ON s.id = o.id AND s.no = o.no AND (o.k = s.k OR o.k > s.k AND o.before - s.upto < s.length)
  GROUP BY s.id, s.k, s.no, s.label, s.n HAVING count(DISTINCT o.w) >= ceil({threshold} * s.n - 1e-9)),
block AS (
  SELECT id, unnest(string_split(text, chr(10))) AS b, generate_subscripts(string_split(text, chr(10)), 1) AS k
  FROM docs
  UNION ALL SELECT id, b, -k FROM (
    SELECT id, unnest(p) AS b, generate_subscripts(p, 1) AS k FROM (
      SELECT id, regexp_split_to_array(text, '{blank}[\\x20\\t\\n\\f\\r]*') AS p
      FROM docs WHERE regexp_matches(text, '{blank}'))) WHERE contains(b, chr(10))),
hit AS (
  SELECT id, k, label, len(tw) AS n, len(list_intersect(bw, tw)) / len(tw) AS c
  FROM (SELECT id, k, list_distinct({_words_sql('b')}) AS bw FROM block), tpl
  WHERE len(list_intersect(bw, tw)) >= ceil({threshold} * len(tw) - 1e-9)),
best AS (SELECT id, max({{'c': c, 'n': n, 'label': label}}) AS m FROM hit GROUP BY id, k
  UNION ALL SELECT id, max({{'c': c, 'n': n, 'label': label}}) FROM run GROUP BY id, k),
found AS (SELECT id, list(m.label) AS labels, max(m.c) AS c FROM best GROUP BY id)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(len(pl) AS BIGINT) AS n_base,
  list_min(list_transform(pl, lambda x: x.pos)) AS first_word, list_max(list_transform(pl, lambda x: x.pos)) AS last_word,
  array_to_string(list_sort(list_distinct(list_transform(pl, lambda x: x.label))), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(list_transform(pl, lambda x: x.label),
    coalesce(labels, [])))), ',') AS labels,
  CASE WHEN len(pl) > 0 THEN 1.0::DOUBLE ELSE coalesce(c, 0.0::DOUBLE) END AS score
FROM base LEFT JOIN found USING (id)"""


SQL["op9_license_join"] = _license_sql()
