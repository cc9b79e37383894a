"""Registered queries of the corpus operators, and the SQL of those that SQL can express."""

import public_tokenizers
from pyspark.sql import functions as F

from tabcast.llm import (
    ann, decontaminate, language_id, license_scan, line_dedup, line_quality, lm_score, packing, simhash, spelling, substring_dedup,
    token_counts, vector_clusters, words,
)
from tabcast.plans.registry import table

QUERIES = {}
SQL = {}

WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def _query(name, sql=None):
    def register(fn):
        def run(spark, folder):
            words.ship(spark)
            return fn(spark, folder)

        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def _documents(spark, folder):
    return table(spark, folder, "documents")


@_query("op1_decontamination")
def op1(spark, folder):
    """Documents that overlap a benchmark item, with the best overlap for each item."""
    return decontaminate.contamination(_documents(spark, folder), table(spark, folder, "benchmark"))


def _template_regex(markup: str) -> str:
    """A template as a regular expression over words that each have a space behind them."""
    out = []
    for mark in license_scan.MARK.finditer(markup):
        text, least, most, kind = mark.group(0, 1, 2, 3)
        if text == "<<opt>>":
            out.append("(?:")
        elif text == "<</opt>>":
            out.append(")?")
        elif least:
            out.append(f"(?:(?:{kind or '[^ ]+'}) ){{{least},{most}}}")
        else:
            out.append(f"{text} ")
    return " " + "".join(out)


def _license_sql() -> str:
    places = [
        f"list_filter(range(len(ws)), lambda i: ws[i + 1] = '{a}' AND ws[i + 2] = '{b}'" + (f" AND ws[i + 3] = '{c[0]}')" if c else ")")
        for a, b, *c in (phrase.split() for phrase in license_scan.PHRASES)
    ]
    base = ", ".join(f"CASE WHEN len({p}) > 0 THEN '{label}' END" for p, label in zip(places, license_scan.PHRASES.values()))
    full = ", ".join(f"CASE WHEN regexp_matches(joined, '{_template_regex(t)}') THEN '{label}' END" for label, t in license_scan.markups(license_scan.TEMPLATES))

    def labels(found):
        return f"coalesce(array_to_string(list_sort(list_distinct(list_filter({found}, lambda x: x IS NOT NULL))), ','), '')"

    return f"""
WITH cut AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS ws FROM documents),
joined AS (SELECT *, ' ' || array_to_string(ws, ' ') || ' ' AS joined FROM cut),
met AS (SELECT *, flatten([{', '.join(places)}]) AS starts, [{base}] AS base, [{full}] AS full_ FROM joined)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(starts) AS BIGINT) AS n_base,
  CAST(list_min(starts) AS BIGINT) AS first_word, CAST(list_max(starts) AS BIGINT) AS last_word,
  {labels('base')} AS base_labels, {labels('list_concat(base, full_)')} AS labels,
  CASE WHEN len(list_filter(full_, lambda x: x IS NOT NULL)) > 0 THEN {license_scan.FULL}::DOUBLE WHEN len(starts) > 0 THEN {license_scan.PART}::DOUBLE ELSE 0::DOUBLE END AS score
FROM met
"""


@_query("op2_license_scan", _license_sql())
def op2(spark, folder):
    return license_scan.license_digest(license_scan.license_scan(_documents(spark, folder)))


@_query("op3_simhash_dedup")
def op3(spark, folder):
    groups = simhash.simhash_groups(_documents(spark, folder))
    return groups.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@_query("op4_lm_score")
def op4(spark, folder):
    """Target: documents labelled as of good quality. Background: all documents."""
    good = table(spark, folder, "labels").where("quality = 1").select("doc_id")
    return lm_score.cross_entropy_difference(_documents(spark, folder), good)


def held_out(doc_id):
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


@_query("op5_language_id")
def op5(spark, folder):
    docs = _documents(spark, folder)
    # A null id has no checksum: neither held out nor learnt from.
    learnt = docs.where(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull())
    contents = language_id.train(learnt)
    found = language_id.identify(docs, contents)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


LINE_SQL = f"""
WITH raw AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents),
every_line AS (SELECT doc_id, unnest(lines) AS text, unnest(range(len(lines))) AS line FROM raw),
trimmed AS (SELECT doc_id, line, text, trim(text, chr(32) || chr(9) || chr(11) || chr(12) || chr(13)) AS own FROM every_line),
sequence AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line) AS pos FROM trimmed WHERE own <> ''),
windows AS (
  SELECT doc_id, line, own, lead(own) OVER w AS next, lead(line) OVER w AS last
  FROM sequence WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
runs AS (
  SELECT doc_id, line, last, own, next FROM windows WHERE next IS NOT NULL
  UNION ALL SELECT doc_id, line, line, own, NULL FROM sequence WHERE len(regexp_extract_all(own, '[^ \\t\\v\\f\\r]+')) >= {line_dedup.MIN_WORDS}),
copies AS (
  SELECT doc_id, line, max(last) AS last FROM (
    SELECT *, row_number() OVER (PARTITION BY own, next ORDER BY doc_id, line) AS place FROM runs)
  WHERE place > 1 GROUP BY doc_id, line),
marks AS (
  SELECT e.doc_id, e.line, e.text, c.doc_id IS NOT NULL AS gone
  FROM every_line e LEFT JOIN (SELECT DISTINCT doc_id, unnest(range(line, last + 1)) AS line FROM copies) c
  ON e.doc_id = c.doc_id AND e.line = c.line)
SELECT doc_id, count(*) AS n_lines, CAST(count_if(gone) AS BIGINT) AS n_removed,
  sha256(coalesce(string_agg(text, chr(10) ORDER BY line) FILTER (NOT gone), '')) AS kept_sha256
FROM marks GROUP BY doc_id
"""


@_query("op6_line_dedup", LINE_SQL)
def op6(spark, folder):
    docs = _documents(spark, folder).select("doc_id", "text")
    kept = line_dedup.deduplicated(docs, name="kept")
    # A wholly deleted text is empty, and so has no line.
    lines = F.size(F.split("text", "\n"))
    left = F.when((F.col("kept") == "") & (F.col("text") != ""), 0).otherwise(F.size(F.split("kept", "\n")))
    return kept.select(
        "doc_id", lines.cast("long").alias("n_lines"), (lines - left).cast("long").alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"),
    )


@_query("op7_token_counts")
def op7(spark, folder):
    return token_counts.token_counts(_documents(spark, folder), PIECES)


@_query("op8_best_fit_packing")
def op8(spark, folder):
    return packing.pack(_documents(spark, folder), WORD_TOKENIZER)


@_query("op9_substring_dedup")
def op9(spark, folder):
    return substring_dedup.deduplicated(_documents(spark, folder), digest=True)


@_query("op10_nearest_neighbours")
def op10(spark, folder):
    return ann.nearest(table(spark, folder, "embeddings"))


def _quality_sql() -> str:
    """The rules of the lines and the document; patterns and phrases are those of the operator."""
    def quoted(pattern):
        return "'" + pattern.replace("'", "''") + "'"

    a_word = "'[^\\\x20\\\x09-\\\x0D]+'"
    symbols = quoted(f"[{line_quality.SYMBOLS}]")
    chars = "length(regexp_replace({}, '[\\\x20\\\x09-\\\x0D]', '', 'g'))"
    return f"""
WITH cut AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), {a_word}) AS ws FROM documents),
windows AS (
  SELECT doc_id, unnest(list_transform(range(1, len(ws) - 6), lambda i: array_to_string(ws[i:i + 7], ' '))) AS win, unnest(range(0, len(ws) - 7)) AS pos
  FROM cut WHERE len(ws) >= 8),
twice AS (SELECT doc_id, pos FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, win) AS n FROM windows) WHERE n > 1),
repeated AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(pos, pos + 8)) AS p FROM twice) GROUP BY doc_id),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM cut),
told AS (
  SELECT doc_id, line, i, regexp_extract_all(line, {a_word}) AS own, {chars.format('line')} AS size,
    row_number() OVER (PARTITION BY doc_id, line ORDER BY i) > 1 AS again,
    regexp_replace(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^0-9a-z\\x{{80}}-\\x{{10FFFF}}]', ' ', 'g') AS plain
  FROM lines),
rules AS (
  SELECT *,
    10 * len(regexp_extract_all(line, {symbols})) > size OR NOT regexp_matches(line, {quoted(line_quality.SENTENCE_END)}) AS unpunctuated,
    (len(own) <= {line_quality.SHORT} AND regexp_matches(plain, {quoted(line_quality.phrase_pattern(line_quality.NAVIGATION))}))
      OR 4 * len(list_filter(own, lambda w: regexp_full_match(w, {quoted(line_quality.SEPARATORS)}))) >= len(own) AS menu,
    again OR regexp_matches(plain, {quoted(line_quality.phrase_pattern(line_quality.BOILERPLATE))}) AS stock
  FROM told WHERE len(own) > 0),
judged AS (SELECT *, unpunctuated OR menu OR stock AS failed FROM rules),
marked AS (SELECT l.doc_id, l.line, l.i, coalesce(j.failed, false) AS failed, j.* EXCLUDE (doc_id, line, i, failed) FROM lines l LEFT JOIN judged j ON l.doc_id = j.doc_id AND l.i = j.i),
per_text AS (
  SELECT doc_id, CAST(count_if(again) AS BIGINT) AS n_dup_lines, CAST(count_if(failed) AS BIGINT) AS n_failed_lines,
    CAST(coalesce(sum(size) FILTER (failed), 0) AS BIGINT) AS lost_chars,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT failed), '')) AS clean_sha256
  FROM marked GROUP BY doc_id),
facts AS (
  SELECT c.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST({chars.format('text')} AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(text, {symbols})) AS BIGINT) AS n_symbols, n_dup_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words,
    n_failed_lines, lost_chars, clean_sha256
  FROM cut c JOIN per_text p ON c.doc_id = p.doc_id LEFT JOIN repeated r ON c.doc_id = r.doc_id)
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND 100 * lost_chars <= {line_quality.MAX_LOST_PERCENT} * word_chars AS kept
FROM facts
"""


@_query("op11_quality_rules", _quality_sql())
def op11(spark, folder):
    facts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_failed_lines", "lost_chars")
    found = line_quality.assess(_documents(spark, folder))
    return found.select("row.doc_id", *[f"found.{f}" for f in facts], F.sha2("found.clean", 256).alias("clean_sha256"))


def _clusters_sql() -> str:
    """Every round compares all vectors with all centroids."""
    gap = "list_sum(list_transform(range(1, 65), lambda i: (x.v[i] - k.v[i]) * (x.v[i] - k.v[i])))"
    steps = []
    for n in range(1, vector_clusters.ROUNDS + 2):
        steps.append(f"""
near{n} AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY place ORDER BY d, c) AS best
    FROM (SELECT x.*, k.c, CAST({gap} AS BIGINT) AS d FROM whole x CROSS JOIN centroids{n - 1} k))
  WHERE best = 1)""")
        if n <= vector_clusters.ROUNDS:
            steps.append(f"""
centroids{n} AS (
  SELECT k.c, coalesce(m.v, k.v) AS v FROM centroids{n - 1} k LEFT JOIN (
    SELECT c, list(mean ORDER BY i) AS v FROM (
      SELECT c, i, CAST(floor(sum(x) / count(*)) AS BIGINT) AS mean
      FROM (SELECT c, unnest(v) AS x, unnest(range(64)) AS i FROM near{n}) GROUP BY c, i)
    GROUP BY c) m ON k.c = m.c)""")
    last = vector_clusters.ROUNDS
    return f"""
WITH whole AS (
  SELECT vec_id, row_number() OVER () AS place, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64 AND len(embedding) = 64),
centroids0 AS (
  SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v FROM (SELECT sha256('1:' || vec_id) AS h, v FROM whole ORDER BY h, v LIMIT 16)),
{','.join(steps)}
SELECT vec_id, CAST(n.c AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY n.c) AS BIGINT) AS cluster_inertia,
  CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(k.v, ',')) AS centroid_sha256
FROM near{last + 1} n JOIN centroids{last} k ON n.c = k.c
"""


@_query("op12_centroid_clusters", _clusters_sql())
def op12(spark, folder):
    return vector_clusters.cluster(table(spark, folder, "embeddings"))


SPELLING_SQL = f"""
WITH RECURSIVE runs AS (
  SELECT doc_id, run, count(*) AS n FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')) AS run
    FROM documents)
  GROUP BY doc_id, run),
coded AS (
  SELECT *, flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run, ''), lambda c:
    CASE WHEN unicode(c) < 128 THEN [CAST(unicode(c) AS BIGINT)] ELSE [CAST(192 + (unicode(c) >> 6) AS BIGINT), CAST(128 + (unicode(c) & 63) AS BIGINT)] END)) AS bytes
  FROM runs),
hashed AS (
  SELECT run, n, xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda h, b:
    list_reduce([xor(h, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda d, z: xor(d >> 1, 3988292384 * (d & 1))))) AS h
  FROM coded),
damaged AS (
  SELECT CASE WHEN h % {spelling.DAMAGE} = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed),
vocabulary AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM damaged WHERE length(word) >= {spelling.LEAST_CHARS} GROUP BY word HAVING sum(n) >= {spelling.LEAST_COUNT}),
rests AS (
  SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM vocabulary)),
pairs AS (
  SELECT a.word, b.word AS near, b.n FROM rests a JOIN rests b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT r.word, v.word, v.n FROM rests r JOIN vocabulary v ON r.rest = v.word
  UNION SELECT v.word, r.word, r.n FROM rests r JOIN vocabulary v ON r.rest = v.word),
best AS (
  SELECT *, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY n DESC, near) AS place FROM pairs),
formed AS (
  SELECT v.word, v.n, coalesce(b.n_near, 0) AS n_near,
    CASE WHEN b.n >= {spelling.RATIO} * v.n THEN b.near END AS form, CASE WHEN b.n >= {spelling.RATIO} * v.n THEN b.n END AS form_n
  FROM vocabulary v LEFT JOIN best b ON v.word = b.word AND b.place = 1),
chain AS (
  SELECT word, word AS root, 0 AS steps FROM formed
  UNION ALL SELECT c.word, f.form, steps + 1 FROM chain c JOIN formed f ON c.root = f.word WHERE f.form IS NOT NULL)
SELECT f.word, f.form, c.root, f.n, CAST(f.n_near AS BIGINT) AS n_near, f.form_n
FROM formed f JOIN (SELECT word, arg_max(root, steps) AS root FROM chain GROUP BY word) c ON f.word = c.word
"""


@_query("op13_spelling_variants", SPELLING_SQL)
def op13(spark, folder):
    return spelling.variants(_documents(spark, folder))
