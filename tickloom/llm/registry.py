"""The registered queries of the operators, and SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tickloom.llm import importance, license_scan, lines, mixing, packing, spelling, target_sampling, url_filters
from tickloom.llm.checksum_sql import TABLE_SQL, crc32_sql
from tickloom.llm.decontaminate import matches
from tickloom.llm.quality_rules import judge
from tickloom.llm.secrets import KINDS, find_secrets
from tickloom.llm.simhash import near_duplicates
from tickloom.llm.substrings import dedup_substrings


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark, sf_dir):
    return judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_source_mixing(spark, sf_dir):
    rated = mixing.rates(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return rated.drop("text_hash")


# The rules that the query applies.
URL_RULES = (
    "allow com/",
    "block example.com/en/",
    "allow www.example.com/en/",
    "block net/es/",
    "block net/fr/",
)


def op3_url_filter(spark, sf_dir):
    return url_filters.judge(_table(spark, sf_dir, "pages"), [url_filters.Rule.read(r) for r in URL_RULES])


def op4_license_scan(spark, sf_dir):
    return license_scan.scan(_table(spark, sf_dir, "documents"))


def op5_simhash_near_dedup(spark, sf_dir):
    found = near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def _joined(spans: str):
    """``kind:start:end`` of every span, comma-joined."""
    text = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"]))
    return F.array_join(text, ",")


def op6_secret_scan(spark, sf_dir):
    found = find_secrets(_table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind))
    counts = [count(kind).cast("bigint").alias(f"n_{kind}") for kind in KINDS]
    return found.select(
        "doc_id", *counts, F.sha2(_joined("base"), 256).alias("base_sha256"), _joined("spans").alias("spans")
    )


def op7_substring_dedup(spark, sf_dir):
    return dedup_substrings(_table(spark, sf_dir, "documents"))


def op8_line_dedup(spark, sf_dir):
    return lines.judge(_table(spark, sf_dir, "documents"))


def op9_quality_classifier(spark, sf_dir):
    """The sampled documents; every row here is kept."""
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    return importance.sample(docs, importance.fit(docs, labels)).withColumn("kept", F.lit(True))


def op10_decontamination(spark, sf_dir):
    """Every document and benchmark item that it contains."""
    return matches(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op11_best_fit_packing(spark, sf_dir):
    """Every piece and its place, with the checksum of its ids."""
    files = map(packing.vocabulary_path, ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken"))
    settings = packing.Settings(*files)
    made = packing.pieces(_table(spark, sf_dir, "documents"), settings)
    digest = made.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return packing.placed(digest, settings.capacity, F.xxhash64("doc_id", "piece", "ids_crc32"))


def op12_target_resampling(spark, sf_dir):
    found = target_sampling.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


def op13_spelling_variants(spark, sf_dir):
    return spelling.variants(_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_source_mixing": op2_source_mixing,
    "op3_url_filter": op3_url_filter,
    "op4_license_scan": op4_license_scan,
    "op5_simhash_near_dedup": op5_simhash_near_dedup,
    "op6_secret_scan": op6_secret_scan,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_line_dedup": op8_line_dedup,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_decontamination": op10_decontamination,
    "op11_best_fit_packing": op11_best_fit_packing,
    "op12_target_resampling": op12_target_resampling,
    "op13_spelling_variants": op13_spelling_variants,
}

def _rule_sql(value: str) -> str:
    rules = sorted((url_filters.Rule.read(r) for r in URL_RULES), key=lambda r: -len(r.host) - len(r.path))
    cases = " ".join(
        f"WHEN (host = '{r.host}' OR host LIKE '%.{r.host}') AND starts_with(path, '{r.path}') "
        f"THEN '{r.action if value == 'action' else r.host + r.path}'"
        for r in rules
    )
    return f"CASE {cases} END"


_REST = "CASE WHEN strpos({0}, '://') > 0 THEN substr({0}, strpos({0}, '://') + 3) ELSE '' END"


def _host_sql(url: str) -> str:
    return f"coalesce(translate(regexp_extract({_REST.format(url)}, '^[^/?#]*'), '{url_filters.UPPER}', '{url_filters.LOWER}'), '')"


def _path_sql(url: str) -> str:
    return f"coalesce(regexp_extract({_REST.format(url)}, '^[^/?#]*([^?#]*)', 1), '')"


def _form_sql(url: str) -> str:
    query = f"regexp_replace(regexp_replace(regexp_extract({_REST.format(url)}, '^[^?#]*\\?([^#]*)', 1), '{url_filters.TRACKING}', '', 'g'), '^&+', '')"
    return (
        f"CASE WHEN strpos({url}, '://') > 0 THEN 'https://' || {_host_sql(url)} || "
        f"regexp_replace({_path_sql(url)}, '/+$', '') || CASE WHEN {query} != '' THEN '?' || {query} ELSE '' END END"
    )


def _stated_sql(outer: str, inner: str) -> str:
    quoted = [p.replace("'", "''") for p in (outer, inner)]
    target = f"regexp_extract(regexp_extract(html, '{quoted[0]}'), '{quoted[1]}', 1)"
    scheme = "substr(url, 1, strpos(url, '://') - 1)"
    return (
        f"SELECT url, CASE WHEN {target} LIKE '%://%' THEN {target} WHEN {target} LIKE '//%' THEN {scheme} || ':' || {target} "
        f"WHEN {target} LIKE '/%' THEN {scheme} || '://' || {_host_sql('url')} || {target} END AS target "
        "FROM pages WHERE strpos(url, '://') > 0"
    )


URL_SQL = f"""
WITH RECURSIVE stated AS (
  {_stated_sql(url_filters.CANONICAL, url_filters.HREF)} UNION ALL {_stated_sql(url_filters.REFRESH, url_filters.TARGET)}),
edges AS (
  SELECT url AS a, {_form_sql('url')} AS b FROM pages WHERE strpos(url, '://') > 0
  UNION SELECT url, target FROM stated WHERE target IS NOT NULL
  UNION SELECT target, {_form_sql('target')} FROM stated WHERE strpos(target, '://') > 0),
both_ways AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
reach AS (
  SELECT a, a AS b FROM both_ways
  UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a),
acted AS (
  SELECT a, {_rule_sql('action')} AS action
  FROM (SELECT a, {_host_sql('b')} AS host, {_path_sql('b')} AS path FROM reach)),
blocked AS (
  SELECT a FROM acted GROUP BY a HAVING bool_or(action = 'block') AND NOT bool_or(coalesce(action, '') = 'allow')),
judged AS (
  SELECT page_id, url, host, path, {_rule_sql('rule')} AS rule, {_rule_sql('action')} AS action
  FROM (SELECT page_id, url, {_host_sql('url')} AS host, {_path_sql('url')} AS path FROM pages))
SELECT page_id, host, path, rule, a IS NOT NULL AS alias_blocked,
       coalesce(action, CASE WHEN a IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM judged LEFT JOIN blocked ON url = a"""

def _list_sql(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _phrase_sql(phrase: str, label: str) -> str:
    hits = " AND ".join(f"w[i + {k}] = '{word}'" for k, word in enumerate(phrase.split()))
    return f"list_transform(list_filter(range(1, len(w) + 1), lambda i: {hits}), lambda i: {{'start': i - 1, 'label': '{label}'}})"


_PLACES_SQL = " || ".join(_phrase_sql(*p) for p in license_scan.PHRASES)
_TEMPLATES_SQL = ", ".join(f"('{label}', {_list_sql(sorted(set(text.split())))})" for label, text in license_scan.TEMPLATES)
_WORDS_SQL = "regexp_extract_all({}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

LICENSE_SQL = f"""
WITH texts AS (
  SELECT doc_id, translate(coalesce(text, ''), '{url_filters.UPPER}', '{url_filters.LOWER}') AS t FROM documents),
templates(label, own) AS (VALUES {_TEMPLATES_SQL}),
base AS (
  SELECT doc_id, len(w) AS n_words, {_PLACES_SQL} AS places
  FROM (SELECT doc_id, {_WORDS_SQL.format('t')} AS w FROM texts)),
lines AS (
  SELECT doc_id, {_WORDS_SQL.format('line')} AS w
  FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM texts)),
alike AS (
  SELECT doc_id, label, max(len(list_intersect(w, own)) / len(own)) AS score
  FROM lines, templates WHERE len(list_intersect(w, own)) / len(own) >= {license_scan.Settings().threshold}
  GROUP BY ALL),
best AS (SELECT doc_id, list(label) AS found, max(score) AS score FROM alike GROUP BY doc_id)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(len(places) AS BIGINT) AS n_base,
       list_min(list_transform(places, lambda p: p.start)) AS first_word,
       list_max(list_transform(places, lambda p: p.start)) AS last_word,
       array_to_string(list_sort(list_distinct(list_transform(places, lambda p: p.label))), ',') AS base_labels,
       array_to_string(list_sort(list_distinct(list_transform(places, lambda p: p.label) || coalesce(found, []))), ',') AS labels,
       coalesce(score, 0.0) AS score
FROM base LEFT JOIN best USING (doc_id)"""


def _features_sql(words: str) -> str:
    return f"{words} || list_transform(range(1, len({words})), lambda i: {words}[i] || ' ' || {words}[i + 1])"


def _lowered_words_sql(text: str) -> str:
    return _WORDS_SQL.format(f"translate(coalesce({text}, ''), '{url_filters.UPPER}', '{url_filters.LOWER}')")


TARGET_SQL = f"""
WITH steps AS ({TABLE_SQL}),
texts AS (SELECT row_number() OVER () AS row, doc_id, {_lowered_words_sql('text')} AS w FROM documents),
raw AS (SELECT row, unnest({_features_sql('w')}) AS f FROM texts),
goal AS (SELECT unnest({_features_sql('w')}) AS f FROM (SELECT {_lowered_words_sql('text')} AS w FROM benchmark)),
places AS (
  SELECT f, {crc32_sql('f')} % 10000 AS b FROM (SELECT f FROM raw UNION SELECT f FROM goal), steps),
counts AS (
  SELECT b, sum(s) AS s, sum(t) AS t FROM (
    SELECT f, count(*) AS s, 0 AS t FROM raw GROUP BY f UNION ALL SELECT f, 0, count(*) FROM goal GROUP BY f)
  JOIN places USING (f) GROUP BY b),
sums AS (SELECT sum(s) AS s_all, sum(t) AS t_all FROM counts),
gains AS (
  SELECT b, floor(1000 * ln((t + 1)::DOUBLE * (s_all + 10000)::DOUBLE / ((s + 1)::DOUBLE * (t_all + 10000)::DOUBLE))) AS g
  FROM counts, sums),
weights AS (
  SELECT row, count(*) AS n, floor(sum(g) / count(*)) AS weight
  FROM raw JOIN places USING (f) JOIN gains USING (b) GROUP BY row),
draws AS (
  SELECT row, doc_id, len(w) AS words, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
         list_reduce(list_transform(range(1, 9), lambda i: strpos('0123456789abcdef', substr(sha256('7:' || coalesce(doc_id::VARCHAR, '')), i, 1)) - 1),
                     lambda a, d: 16 * a + d) AS h
  FROM texts LEFT JOIN weights USING (row)),
scores AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS score FROM draws),
ranks AS (
  SELECT row, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS place, 25 * count(*) OVER () // 100 AS k
  FROM scores WHERE words >= 20)
SELECT doc_id, n_features::BIGINT AS n_features, weight::BIGINT AS weight, score::BIGINT AS score,
       CASE WHEN place <= k THEN place END::BIGINT AS rank
FROM scores LEFT JOIN ranks USING (row)"""

SPELLING_SQL = f"""
WITH RECURSIVE steps AS ({TABLE_SQL}),
runs AS (
  SELECT doc_id, run, count(*) AS n FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, '{url_filters.UPPER}', '{url_filters.LOWER}'), '[a-z\\x{{C0}}-\\x{{FF}}]+')) AS run
    FROM documents) GROUP BY ALL),
drawn AS (SELECT run, n, {crc32_sql("(coalesce(doc_id::VARCHAR, '') || ':' || run)")} AS h FROM runs, steps),
words AS (
  SELECT word, sum(n) AS n FROM (
    SELECT n, CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word
    FROM drawn)
  GROUP BY word HAVING length(word) >= 5 AND sum(n) >= 3),
cut AS (
  SELECT word, substr(word, 1, i - 1) AS head, substr(word, i + 1) AS tail
  FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words)),
longer AS (SELECT DISTINCT c.word AS a, w.word AS b FROM cut c JOIN words w ON c.head || c.tail = w.word),
near AS (
  SELECT x.word AS a, y.word AS b FROM cut x JOIN cut y ON x.head || '*' || x.tail = y.head || '*' || y.tail AND x.word != y.word
  UNION SELECT a, b FROM longer UNION SELECT b, a FROM longer),
best AS (
  SELECT a, count(*) AS n_near, first(b ORDER BY n DESC, b) AS b, max(n) AS n FROM near JOIN words ON b = word GROUP BY a),
forms AS (
  SELECT word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN best.n >= 2 * w.n THEN b END AS form,
         CASE WHEN best.n >= 2 * w.n THEN best.n END AS form_n
  FROM words w LEFT JOIN best ON word = a),
ways AS (
  SELECT word, word AS root FROM forms
  UNION ALL SELECT ways.word, forms.form FROM ways JOIN forms ON ways.root = forms.word WHERE forms.form IS NOT NULL),
ends AS (SELECT ways.word, ways.root FROM ways JOIN forms ON ways.root = forms.word WHERE forms.form IS NULL)
SELECT word, n::BIGINT AS n, n_near::BIGINT AS n_near, form, form_n::BIGINT AS form_n, root
FROM forms JOIN ends USING (word)"""

SUBSTRING_SQL = """
WITH texts AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
words AS (SELECT row, doc_id, len(w) AS n, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM texts),
windows AS (
  SELECT row, doc_id, i, seq FROM (
    SELECT row, doc_id, n, i, string_agg(word, ' ') OVER (
      PARTITION BY row ORDER BY i ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING) AS seq FROM words)
  WHERE i <= n - 49),
firsts AS (SELECT seq, min(doc_id) AS first_id FROM windows GROUP BY seq),
hits AS (SELECT row, i, true AS hit FROM windows JOIN firsts USING (seq) WHERE doc_id > first_id),
marked AS (
  SELECT row, i, word, coalesce(bool_or(hit) OVER (
    PARTITION BY row ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), false) AS gone
  FROM words LEFT JOIN hits USING (row, i)),
left_over AS (
  SELECT row, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept
  FROM marked GROUP BY row)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM texts LEFT JOIN left_over USING (row)"""

ORACLES: dict[str, str] = {
    "op3_url_filter": URL_SQL,
    "op4_license_scan": LICENSE_SQL,
    "op7_substring_dedup": SUBSTRING_SQL,
    "op12_target_resampling": TARGET_SQL,
    "op13_spelling_variants": SPELLING_SQL,
}
