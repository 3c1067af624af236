"""Feature extraction, filters and text functions over whole source tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgrain.functions import text as T
from loomgrain.operators import features as X
from loomgrain.plans.registry import query
from loomgrain.tables import latest_by_key, latest_texts, read_table

FILES = "files AS (SELECT DISTINCT ON (file_id) * FROM source_files WHERE file_id IS NOT NULL ORDER BY file_id, ingested_at DESC)"
FUNCTIONS = "functions AS (SELECT DISTINCT ON (fn_id) * FROM fingerprints WHERE fn_id IS NOT NULL ORDER BY fn_id, ingested_at DESC)"


def files(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    latest = latest_texts if "content" in columns else latest_by_key
    return latest(read_table(spark, d, "source_files"), "file_id", "ingested_at", list(columns))


def functions(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return latest_by_key(read_table(spark, d, "fingerprints"), "fn_id", "ingested_at", list(columns))


def _any(c: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({c}, '{w}')".replace("\n", "' || chr(10) || '") for w in words) + ")"


def _in(words: list[str]) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


_FAMILY = "CASE " + " ".join(f"WHEN t IN {_in(w)} THEN '{n}'" for n, w in T.TOKEN_FAMILIES.items()) + " ELSE t END"


@query(f"""
WITH {FILES}, toks AS (
  SELECT file_id, list_filter(string_split_regex(coalesce(content, ''), '[ \\t\\n\\r]+'), lambda t: t <> '' AND NOT starts_with(t, '//')) AS toks FROM files),
norm AS (SELECT file_id, toks, list_transform(toks, lambda t: {_FAMILY}) AS n FROM toks),
win AS (SELECT file_id, unnest(range(1, len(n) - 3)) AS i, n FROM norm WHERE len(n) >= 5),
hashed AS (SELECT file_id, ('0x' || substr(md5(array_to_string(n[i:i+4], ' ')), 1, 15))::BIGINT AS h,
  md5(array_to_string(n[i:i+4], ' ') || ' ' || ((i - 1) * 1024 // greatest(len(n) - 5, 1))::VARCHAR) AS p FROM win),
counted AS (SELECT file_id, count(DISTINCT h) AS ngrams, count(DISTINCT p) AS positional_ngrams, min(h) AS least_hash FROM hashed GROUP BY 1)
SELECT norm.file_id, len(toks)::BIGINT AS tokens,
  {", ".join(f"len(list_filter(n, lambda t: t = '{k}'))::BIGINT AS {k}_tokens" for k in T.TOKEN_FAMILIES)},
  coalesce(ngrams, 0)::BIGINT AS ngrams, coalesce(positional_ngrams, 0)::BIGINT AS positional_ngrams, coalesce(least_hash, -1)::BIGINT AS least_hash
FROM norm LEFT JOIN counted USING (file_id)""")
def file_token_ngrams(spark: SparkSession, d: str) -> DataFrame:
    return X.token_features(files(spark, d, "content"))


@query(f"""
WITH {FUNCTIONS}
SELECT fn_id, array_to_string(list_filter(string_split(regexp_replace(coalesce(function_name, ''), '([A-Z])', '_\\1', 'g'), '_'), lambda p: p <> ''), '|') AS segments FROM functions""")
def name_segments(spark: SparkSession, d: str) -> DataFrame:
    return functions(spark, d, "function_name").select("fn_id", F.array_join(T.name_segments(F.col("function_name")), "|").alias("segments"))


_P, _C = "lower(coalesce(file_path, ''))", "lower(coalesce(content, ''))"


@query(f"""
WITH {FILES}
SELECT file_id,
  CASE WHEN {_any(_P, X.TEST_PATHS)} OR {_any(_C, X.TEST_TEXTS)} THEN 'test' WHEN {_any(_P, X.MOCK_PATHS)} THEN 'mock' WHEN {_any(_P, X.CONFIG_PATHS)} THEN 'config'
    WHEN {_any(_P, X.ROUTE_PATHS)} OR {_any(_C, X.ROUTE_TEXTS)} THEN 'route_handler' WHEN {_any(_P, X.UTILITY_PATHS)} THEN 'utility' ELSE 'unknown' END AS environment,
  CASE {" ".join(f"WHEN {_any(_C, w)} THEN '{k}'" for k, w in X.SENSITIVE.items())} ELSE 'unknown' END AS sensitivity,
  concat_ws('|', CASE WHEN contains({_C}, 'express') OR (contains({_C}, 'req') AND contains({_C}, 'res')) THEN 'Express' END,
    CASE WHEN contains({_C}, 'react') OR contains({_C}, 'jsx') THEN 'React' END, CASE WHEN contains({_C}, 'gin') OR contains({_C}, 'echo') THEN 'GoWeb' END,
    CASE WHEN {_any(_C, ['actix', 'rocket', 'axum'])} THEN 'RustWeb' END, CASE WHEN contains({_C}, 'spring') OR contains({_C}, 'controller') THEN 'Spring' END) AS frameworks
FROM files""")
def context_classify(spark: SparkSession, d: str) -> DataFrame:
    rows = files(spark, d, "file_path", "content")
    path, content = F.col("file_path"), F.col("content")
    return rows.select("file_id", X.environment(path, content).alias("environment"), X.sensitivity(content).alias("sensitivity"), F.array_join(X.frameworks(content), "|").alias("frameworks"))


_FOLDERS = "string_split(file_path, '/')[1:len(string_split(file_path, '/')) - 1]"
_NAME = "string_split(file_path, '/')[-1]"
_STEM = f"regexp_replace({_NAME}, '\\.[^.]*$', '')"


@query(f"""
WITH {FILES}
SELECT file_id, CASE lower(regexp_extract(coalesce(file_path, ''), '\\.([A-Za-z0-9]+)$', 1)) {" ".join(f"WHEN '{e}' THEN '{v}'" for e, v in X.EXTENSION_LANGUAGE.items())} ELSE 'unknown' END AS path_language,
  (len(list_filter({_FOLDERS}, lambda f: f IN {_in(X.SKIPPED_FOLDERS)} OR starts_with(f, '.'))) = 0 AND NOT ({" OR ".join(f"ends_with(file_path, '{s}')" for s in X.SKIPPED_SUFFIXES)})
    AND octet_length(encode(coalesce(content, ''))) <= {X.MOST_BYTES}) AS scanned,
  (({" OR ".join(f"ends_with({_NAME}, '{s}')" for s in X.TEST_SUFFIXES)}) OR {_any("file_path", X.TEST_FOLDERS)} OR starts_with({_STEM}, 'mock') OR ends_with(lower({_STEM}), '.mock')) AS test_file,
  array_to_string({_FOLDERS}[greatest(len({_FOLDERS}) - 2, 1):], '/') AS directory
FROM files""")
def scan_filters(spark: SparkSession, d: str) -> DataFrame:
    path = F.col("file_path")
    size = F.octet_length(F.coalesce("content", F.lit("")))
    rows = files(spark, d, "file_path", "content")
    return rows.select("file_id", X.language_of(path).alias("path_language"), X.scanned(path, size).alias("scanned"), X.is_test_file(path).alias("test_file"), T.directory_prefix(path).alias("directory"))


_COMMENT = r"(//[^\n]*|/\*(?:[^*]|\*+[^*/])*\*+/)"


@query(f"""
WITH {FILES}, calls AS (
  SELECT file_id, list_sort(list_distinct(regexp_extract_all(coalesce(content, ''), '([A-Za-z_$][A-Za-z0-9_$.:]*)\\(', 1))) AS calls,
  list_distinct(list_concat(regexp_extract_all(coalesce(content, ''), 'from\\s+[''"]([^''"]+)[''"]', 1), regexp_extract_all(coalesce(content, ''), 'require\\(\\s*[''"]([^''"]+)[''"]\\s*\\)', 1))) AS packages,
  list_distinct(list_filter(regexp_extract_all(coalesce(content, ''), '([A-Za-z_]+)', 1), lambda w: w IN {_in(T.KEYWORDS_PRESENT)})) AS keywords,
  length(array_to_string(regexp_extract_all(coalesce(content, ''), '{_COMMENT}', 1), '')) AS comment_chars, length(content) AS chars FROM files)
SELECT file_id, len(calls)::BIGINT AS calls, coalesce(calls[1], '') AS first_call, array_to_string(list_sort(packages), '|') AS packages, array_to_string(list_sort(keywords), '|') AS keywords,
  round(CASE WHEN coalesce(chars, 0) = 0 THEN 0.0 ELSE comment_chars / chars END, 6) AS comment_density FROM calls""")
def call_targets(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("content")
    rows = files(spark, d, "content").select("file_id", T.call_targets(c).alias("calls"), T.import_packages(c).alias("packages"), T.keywords_present(c).alias("keywords"), F.round(T.comment_density(c), 6).alias("comment_density"))
    return rows.select("file_id", F.size("calls").cast("long").alias("calls"), F.coalesce(F.try_element_at("calls", F.lit(1)), F.lit("")).alias("first_call"), F.array_join("packages", "|").alias("packages"), F.array_join("keywords", "|").alias("keywords"), "comment_density")


@query(f"""
WITH {FILES}
SELECT file_id, length(regexp_replace(coalesce(content, ''), '("(?:[^"\\\\\\n]|\\\\.)*"|''(?:[^''\\\\\\n]|\\\\.)*'')|//[^\\n]*|/\\*(?:[^*]|\\*+[^*/])*\\*+/', '', 'g'))::BIGINT AS code_chars FROM files""")
def strip_comments(spark: SparkSession, d: str) -> DataFrame:
    return files(spark, d, "content").select("file_id", F.length(T.strip_comments_and_strings(F.coalesce("content", F.lit("")))).cast("long").alias("code_chars"))


@query(f"""
WITH {FUNCTIONS}, chars AS (SELECT fn_id, unnest(string_split(function_name, '')) AS ch, length(function_name) AS n FROM functions WHERE function_name <> ''),
per AS (SELECT fn_id, count(*) / n AS p FROM chars GROUP BY fn_id, n, ch), ent AS (SELECT fn_id, sum(-p * log2(p)) AS e FROM per GROUP BY 1)
SELECT f.fn_id, round(coalesce(e, 0.0), 6) AS entropy, coalesce(regexp_matches(lower(function_name), '{"|".join(T.SECRET_PARTS)}'), false) AS secret_name,
  coalesce(lower(function_name) IN {_in(T.PERSONAL_NAMES)}, false) AS personal_name, coalesce(regexp_matches(lower(function_name), '{T.VALIDATOR}'), false) AS validator_name
FROM functions f LEFT JOIN ent USING (fn_id)""")
def secret_pii_entropy(spark: SparkSession, d: str) -> DataFrame:
    name, no = F.col("function_name"), F.lit(False)
    return functions(spark, d, "function_name").select(
        "fn_id", F.round(T.shannon_entropy(name), 6).alias("entropy"), F.coalesce(T.names_a_secret(name), no).alias("secret_name"),
        F.coalesce(T.is_personal_name(name), no).alias("personal_name"), F.coalesce(T.names_a_validator(name), no).alias("validator_name"),
    )


@query("""
SELECT pattern_id, CASE WHEN coalesce(string_split(pattern_id, '_')[2], '') = '' THEN 'unknown' ELSE string_split(pattern_id, '_')[2] END AS category,
  regexp_extract(function_name, '([^.:]*)$', 1) AS short_name, regexp_replace(pattern_id, '[^A-Za-z0-9_-]', '_', 'g') AS file_stem, example_id FROM corpus_examples""")
def example_names(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("pattern_id")
    return read_table(spark, d, "corpus_examples").select("pattern_id", T.category_of(p).alias("category"), T.last_segment(F.col("function_name")).alias("short_name"), T.file_safe(p).alias("file_stem"), "example_id")


@query(f"""
WITH {FILES}, lines AS (SELECT file_id, string_split(content, chr(10)) AS l FROM files WHERE content IS NOT NULL),
mark AS (SELECT file_id, (len(l) // 2 + 1) AS line, l FROM lines)
SELECT file_id, line::BIGINT AS line, array_to_string(list_transform(range(greatest(line - 5, 1), least(line + 5, len(l)) + 1), lambda i: (CASE WHEN i = line THEN '> ' ELSE '  ' END) || i::VARCHAR || ': ' || l[i]), chr(10)) AS snippet FROM mark""")
def middle_snippets(spark: SparkSession, d: str) -> DataFrame:
    rows = files(spark, d, "content").where("content is not null")
    marks = rows.select("file_id", (F.floor(F.size(F.split("content", "\n")) / 2) + 1).alias("line"))
    return X.snippets(rows, marks)


@query(f"""
WITH {FILES}, lines AS (SELECT file_id, unnest(string_split(content, chr(10))) AS t, unnest(range(1, len(string_split(content, chr(10))) + 1)) AS line FROM files WHERE content IS NOT NULL),
marks AS (SELECT file_id, line FROM lines WHERE contains(t, 'TODO('))
SELECT DISTINCT l.file_id, l.line::BIGINT AS line FROM lines l JOIN marks m ON l.file_id = m.file_id AND m.line BETWEEN l.line - 2 AND l.line""")
def marked_lines(spark: SparkSession, d: str) -> DataFrame:
    return X.suppressed_lines(files(spark, d, "content"), "TODO(")
