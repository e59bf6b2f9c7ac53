"""The check queries of the operators, and their SQL where SQL can express them."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import decontaminate, fill_in_middle, host_rules, license_scan, line_dedup, lm_score, ngram_join, packing, reply_trees
from . import secret_scan, token_counts, url_filter, vector_codes
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
VOCABULARY = "byte_bpe_50k.json"


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


@query("op1_token_counts")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(VOCABULARY)
    counted = token_counts.count_tokens(table(spark, sf_dir, "documents"), path)
    return counted.withColumn("over_limit", F.col("n_tokens") > 512)


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _license_sql() -> str:
    """Marks, known sentences and rules as the operator has them: of the sentences that begin behind a mark and end before
    one, the longest of each place, from the left, without overlap."""
    book = ", ".join(f"({_quoted(v)}, {_quoted(k)})" for k, v in license_scan.SENTENCES.items())
    single = ", ".join(f"({_quoted(k)}, {_quoted(v)})" for k, v in license_scan.SINGLE.items())
    hard, soft = license_scan._HARD, license_scan._SOFT
    marked = f"translate(coalesce(text, ''), '{license_scan._UPPER}{hard}{soft}', '{license_scan._LOWER}  ')"
    for pattern, new in [
        (license_scan.HARD_END, hard), (license_scan.SOFT_END, soft)]:
        marked = f"regexp_replace({marked}, '{pattern}', '{new}', 'g')"
    marked = f"'{hard}' || {marked} || '{hard}'"
    for pattern, new in [
        (f"[^a-z0-9{hard}{soft}]+", " "), (f"[ {soft}]*{hard}[ {hard}{soft}]*", hard), (f" *{soft}[ {soft}]*", soft),
        *license_scan.VARIANTS]:
        marked = f"regexp_replace({marked}, '{pattern}', '{new}', 'g')"
    longest = max(map(len, license_scan.SENTENCES.values()))
    steps, last = [], "ids"
    for i, (licence, wanted) in enumerate(license_scan.RULES):
        key = _quoted("".join(f"<{w}>" for w in wanted))
        n = f"((length(rest) - length(replace(rest, {key}, ''))) // length({key}))"
        steps.append(
            f"r{i} AS (SELECT rid, replace(rest, {key}, '|') AS rest, "
            f"list_concat(hits, list_transform(range({n}), lambda k: {_quoted(licence)})) AS hits FROM {last})")
        last = f"r{i}"
    return rf"""
WITH RECURSIVE book(sentence, id) AS (VALUES {book}), single(id, licence) AS (VALUES {single}),
d AS (SELECT row_number() OVER () AS rid, * FROM documents),
m AS (SELECT rid, {marked} AS m FROM d WHERE regexp_matches(coalesce(text, ''), '{license_scan.HINT}')),
places AS (
  SELECT rid, m, p FROM (SELECT rid, m, unnest(range(1, length(m))) AS p FROM m) WHERE substr(m, p, 1) IN ('{hard}', '{soft}')),
starts AS (SELECT rid, p, substr(m, p + 1, {longest + 1}) AS raw FROM places),
known AS (
  SELECT rid, p, max_by(id, length(sentence)) AS id, max(length(sentence)) AS n
  FROM starts JOIN book ON starts_with(translate(raw, '{soft}', ' '), sentence)
  WHERE substr(raw, length(sentence) + 1, 1) IN ('{hard}', '{soft}') GROUP BY rid, p),
taken AS (
  SELECT * FROM (SELECT rid, min(p) AS p, arg_min(id, p) AS id, arg_min(n, p) AS n FROM known GROUP BY rid)
  UNION ALL
  SELECT * FROM (
    SELECT t.rid, min(k.p) AS p, arg_min(k.id, k.p) AS id, arg_min(k.n, k.p) AS n
    FROM taken t JOIN known k ON k.rid = t.rid AND k.p >= t.p + t.n + 1 GROUP BY t.rid)),
ids AS (
  SELECT rid, coalesce(string_agg('<' || id || '>', '' ORDER BY p), '') AS rest, []::VARCHAR[] AS hits
  FROM d LEFT JOIN taken USING (rid) GROUP BY rid),
{", ".join(steps)},
loose AS (
  SELECT rid, i, id, licence
  FROM (SELECT rid, generate_subscripts(x, 1) AS i, unnest(x) AS id
        FROM (SELECT rid, list_filter(string_split_regex(rest, '[<>|]+'), lambda x: x <> '') AS x FROM {last}))
  LEFT JOIN single USING (id)),
told AS (
  SELECT rid, list(licence) FILTER (licence IS NOT NULL) AS alone,
    string_agg(id, ',' ORDER BY i) FILTER (licence IS NULL) AS unmatched FROM loose GROUP BY rid)
SELECT d.doc_id, (length(ids.rest) - length(replace(ids.rest, '<', '')))::INT AS n_sentences,
  array_to_string(list_sort(list_concat(r.hits, coalesce(alone, []))), ',') AS licences, coalesce(unmatched, '') AS unmatched
FROM d JOIN {last} r USING (rid) JOIN ids USING (rid) LEFT JOIN told USING (rid)
"""


@query("op2_license_scan", _license_sql())
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_columns(license_scan.scan(table(spark, sf_dir, "documents")))


def license_columns(found: DataFrame) -> DataFrame:
    return found.select(
        "doc_id",
        F.size("sentence_ids").alias("n_sentences"),
        F.array_join("licences", ",").alias("licences"),
        F.array_join("unmatched", ",").alias("unmatched"),
    )


OP3_SQL = r"""
WITH lines AS (
  SELECT doc_id, generate_subscripts(l, 1) - 1 AS i, unnest(l) AS line
  FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL)),
facts AS (
  SELECT *, ('0x' || substr(md5(line), 1, 7))::BIGINT AS h,
    len(list_filter(string_split_regex(line, '[\x20\x09-\x0D]+'), lambda w: w <> '')) AS n
  FROM lines),
ends AS (
  SELECT *, (h + 31 * coalesce(lag(h) OVER w, 0)) % 4 = 0 AS rolled FROM facts
  WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
starts AS (
  SELECT *, (i = 0 OR n >= 50 OR lag(n) OVER w >= 50 OR lag(rolled) OVER w)::INT AS s FROM ends
  WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
numbered AS (
  SELECT *, sum(s) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS chunk FROM starts),
chunks AS (
  SELECT doc_id, chunk, min(i) AS start, string_agg(line, chr(10) ORDER BY i) AS body,
    count(*) FILTER (n > 0) AS worded, sum(n) AS n
  FROM numbered GROUP BY doc_id, chunk HAVING count(*) FILTER (n > 0) > 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY body ORDER BY doc_id, start) AS place FROM chunks),
judged AS (
  SELECT *, place > 1 AS copy, place > 1 AND (worded >= 2 OR n >= 50) AS gone FROM ranked),
whole AS (SELECT doc_id, bool_and(copy) AND bool_or(gone) AS emptied FROM judged GROUP BY doc_id),
marked AS (
  SELECT l.*, coalesce(j.gone OR (w.emptied AND j.copy), false) AS removed
  FROM numbered l LEFT JOIN judged j USING (doc_id, chunk) LEFT JOIN whole w USING (doc_id)),
texts AS (
  SELECT doc_id, count(*) FILTER (removed) AS n_removed,
    string_agg(line, chr(10) ORDER BY i) FILTER (NOT removed) AS text
  FROM marked GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_removed, 0)::INT AS n_removed, coalesce(emptied, false) AS emptied,
  CASE WHEN d.text IS NULL THEN NULL WHEN emptied THEN '' ELSE coalesce(t.text, '') END AS text
FROM documents d LEFT JOIN texts t USING (doc_id) LEFT JOIN whole USING (doc_id)
"""


@query("op3_line_dedup", OP3_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = line_dedup.deduplicate(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", F.size("removed_lines").alias("n_removed"), "emptied", "text")


@query("op4_decontaminate")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op5_lm_score")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 == 2
    return lm_score.score(table(spark, sf_dir, "documents"), held_out, sweeps=3, samples=2)


def conversation_nodes(rows: DataFrame) -> DataFrame:
    """Turns as a reply tree: each answers the one before; ties between equal turn numbers by role and text."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    numbered = rows.withColumn("node", F.row_number().over(order))
    return numbered.select(
        F.col("conv_id").alias("tree"), "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"),
        "role", "text", F.lit(0.0).alias("score"))


def read_back(formatted: DataFrame) -> DataFrame:
    """The digest columns of op6, from the formatted conversations and their loss spans alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, spans in zip(batch.column("formatted").to_pylist(), batch.column("loss_spans").to_pylist()):
                turns = reply_trees.read_turns(text)
                told = "".join(f"{role}\n{body}\n" for role, body in turns)
                learned = reply_trees.read_loss(text, [(s["start"], s["end"]) for s in spans])
                rows.append((len(turns), hashlib.sha256(told.encode()).hexdigest(), len(learned),
                             hashlib.sha256(learned.encode()).hexdigest(), len(text)))
            columns = list(zip(*rows)) if rows else [()] * 5
            names = ["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), *[pa.array(c, t) for c, t in zip(columns, types)]], ["conv_id", *names])

    kind = formatted.schema["tree"].dataType.simpleString()
    return formatted.select(F.col("tree").alias("conv_id"), "formatted", "loss_spans").mapInArrow(
        run, f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, "
        "formatted_chars bigint")


@query("op6_reply_trees")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], rows.schema)
    return read_back(reply_trees.conversations(conversation_nodes(rows.unionByName(extra))))


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS t,
    list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
    list_filter(string_split(coalesce(text, ''), chr(10)),
      lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
tri AS (
  SELECT doc_id, i, ws[i] || chr(10) || ws[i + 1] || chr(10) || ws[i + 2] AS w
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM d)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w) AS n FROM tri) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id),
m AS (
  SELECT d.doc_id, coalesce(source, chr(0)) AS host, len(ws)::BIGINT AS n_words,
    length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, len(lines) AS n_lines,
    coalesce(rep.n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN rep USING (doc_id)),
r AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS r1, 100 * n_symbols > 10 * n_words AS r2,
    100 * n_dup_lines > 30 * n_lines AS r3, word_chars < 2 * n_words OR word_chars > 12 * n_words AS r4
  FROM m),
votes AS (
  SELECT host, rule, count(*)::DOUBLE AS n, sum(f::INT)::DOUBLE AS f
  FROM (SELECT host, unnest(['r1', 'r2', 'r3', 'r4']) AS rule, unnest([r1, r2, r3, r4]) AS f FROM r) GROUP BY ALL),
total AS (
  SELECT rule, sum(f) / sum(n) AS mean, sum(f * f / n) / sum(n) AS square, count(*) / sum(n) AS noise
  FROM votes GROUP BY rule),
prior AS (
  SELECT rule, mean, CASE WHEN mean * (1 - mean) > 0 THEN
    1 / least(greatest(CASE WHEN noise < 1 THEN
      ((square - mean * mean) / (mean * (1 - mean)) - noise) / (1 - noise) ELSE 0 END, 1e-4), 0.999) - 1
    ELSE 0 END AS strength
  FROM total),
verdict AS (
  SELECT host, max((f + mean * strength) / (n + strength)) <= 0.5 AS host_kept
  FROM votes JOIN prior USING (rule) GROUP BY host)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, r1 AS base_failed,
  NOT r1 AND host_kept AS kept
FROM r JOIN verdict USING (host)
"""


@query("op7_host_rules", OP7_SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_rules.judge(table(spark, sf_dir, "documents")).drop("host_rate")


OP8_SQL = r"""
WITH w AS (
  SELECT doc_id, text, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
t AS (SELECT text, any_value(ws) AS ws, min(doc_id) AS least, count(*) AS n FROM w WHERE len(ws) > 0 GROUP BY text),
s AS (
  SELECT DISTINCT least, array_to_string(ws[i:i + 4], ' ') AS g
  FROM (SELECT least, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM t)),
size AS (SELECT least, count(*) AS n FROM s GROUP BY least),
pairs AS (
  SELECT a.least AS a, b.least AS b, count(*) AS n FROM s a JOIN s b USING (g) WHERE a.least <> b.least GROUP BY ALL),
links AS (
  SELECT a, b FROM pairs JOIN size x ON a = x.least JOIN size y ON b = y.least
  WHERE pairs.n * 10 >= 8 * (x.n + y.n - pairs.n)),
reach AS (
  WITH RECURSIVE r(a, b) AS (
    SELECT least, least FROM t UNION SELECT r.a, links.b FROM r JOIN links ON r.b = links.a)
  SELECT a, min(b) AS class_id FROM r GROUP BY a),
linked AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT w.doc_id, coalesce(class_id, w.doc_id) AS class_id, coalesce(linked.n, 0) AS n_links, coalesce(t.n, 1) AS n_copies
FROM w LEFT JOIN t ON w.text = t.text LEFT JOIN reach ON reach.a = t.least LEFT JOIN linked ON linked.a = t.least
"""


@query("op8_ngram_join", OP8_SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents")).drop("is_first")


@query("op9_packing")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


@query("op10_secret_scan")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    ratios = secret_scan.train(secret_scan.labelled_samples(docs))
    found = secret_scan.scan(docs, ratios)

    def n(kind: int):
        return F.size(F.filter("known", lambda s: s["kind"] == kind)).cast("bigint")

    return found.select(
        "doc_id",
        *[n(k).alias(f"n_{name}") for k, name in enumerate(secret_scan.KINDS[:-1])],
        F.sha2(secret_scan.listed(F.col("known")), 256).alias("base_sha256"),
        secret_scan.listed(F.concat("known", "found")).alias("spans"),
    )


OP11_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
    sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS s
  FROM documents),
h AS (
  SELECT *, len(u)::BIGINT AS n, ('0x' || substr(s, 1, 8))::BIGINT AS h1, ('0x' || substr(s, 9, 8))::BIGINT AS h2,
    ('0x' || substr(s, 17, 8))::BIGINT AS h3, ('0x' || substr(s, 25, 8))::BIGINT AS h4
  FROM d),
c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
      WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM h),
p AS (
  SELECT doc_id, t, n, form, coalesce(array_to_string(u[1:a], ''), '') AS p, coalesce(array_to_string(u[a + 1:b], ''), '') AS m,
    coalesce(array_to_string(u[b + 1:n], ''), '') AS q
  FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END::BIGINT AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(m) END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'spm' THEN '<S>' || q || '<P>' || p || '<M>' || m
    ELSE '<P>' || p || '<S>' || q || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p
"""


@query("op11_fill_in_middle", OP11_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    formed = fill_in_middle.restored(fill_in_middle.transform(table(spark, sf_dir, "documents")))
    return formed.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


@query("op12_vector_codes")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = vector_codes.compress(table(spark, sf_dir, "embeddings"))
    return vector_codes.with_label_error(codes.rows).select(
        "vec_id", "code", "error", "label_error",
        F.lit(vector_codes.books_digest(codes.books)).alias("codebooks_sha256"))


#: What is known of hosts and paths, with the verdict.
URL_RULES = [
    ("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"),
    ("block", "net/fr/"),
]


@query("op13_url_filter")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    model = url_filter.train(url_filter.labelled_by_rules(pages, URL_RULES))
    return url_filter.judge(pages, model, URL_RULES).drop("score")
