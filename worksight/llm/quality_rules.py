"""Line-first quality cleaning.

Rules look at one line at a time and fail it for navigation (separators among few words), symbols, shouting, boilerplate phrases or a
long stretch without any punctuation. Failed lines are removed; a document that loses more than half of its characters in lines
with words is rejected, as is one with too few words or too many words in repeated windows.

Nulls and empty texts have no words and are rejected. Other columns pass through. Only DataFrame operations are used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GAP = r"[\x20\x09-\x0D]+"
#: Phrases of notices in the corpus' four languages; letters with accents stand in both cases, as engines differ on them.
BOILERPLATE = "(?i)(" + "|".join((
    "all rights reserved", "privacy policy", "terms of (use|service)", "cookie policy", "accept cookies", "enable javascript", "lorem ipsum", "click here", "sign up now", "subscribe to our",
    "alle rechte vorbehalten", "datenschutzerkl[äÄ]rung", "nutzungsbedingungen", "cookies akzeptieren", "hier klicken", "newsletter abonnieren",
    "tous droits r[éÉ]serv[éÉ]s", "politique de confidentialit[éÉ]", "conditions d.utilisation", "accepter les cookies", "cliquez ici",
    "todos los derechos reservados", "pol[íÍ]tica de privacidad", "t[éÉ]rminos de uso", "aceptar (las )?cookies", "haga clic aqu[íÍ]",
)) + ")"
SYMBOLS, SEPARATORS = "#*$%&|<>", "|»›•·"
#: A repeat window's words, least words, and the shares in hundredths that reject.
WINDOW, MIN_WORDS, MAX_REPEAT, MAX_LOST = 8, 20, 30, 50


def _line_fails(line: str, words: str) -> str:
    """SQL for a line with words; words: SQL for their number."""
    n_of = lambda chars: f"(length({line}) - length(translate({line}, '{chars}', '')))"
    return f"""(
      ({n_of(SEPARATORS)} >= 3 AND 5 * {n_of(SEPARATORS)} >= {words})
      OR ({n_of(SYMBOLS)} >= 3 AND 3 * {n_of(SYMBOLS)} >= {words})
      OR ({words} >= 3 AND {n_of('!')} >= {words})
      OR regexp_like({line}, '{BOILERPLATE}')
      OR ({words} >= 40 AND NOT regexp_like({line}, '[.,!?:;…]')))"""


def _fails_cheap_first(line: str, words: str) -> str:
    """The same verdict; words, which costs a split, is reached only by lines that the cheaper tests leave open."""
    n_of = lambda chars: f"(length({line}) - length(translate({line}, '{chars}', '')))"
    return f"""(
      ({n_of(SEPARATORS)} >= 3 AND 5 * {n_of(SEPARATORS)} >= {words})
      OR ({n_of(SYMBOLS)} >= 3 AND 3 * {n_of(SYMBOLS)} >= {words})
      OR ({n_of('!')} >= 3 AND {words} >= 3 AND {n_of('!')} >= {words})
      OR regexp_like({line}, '{BOILERPLATE}')
      OR (length({line}) >= 79 AND NOT regexp_like({line}, '[.,!?:;…]') AND {words} >= 40))"""


def _word_count(text: str) -> str:
    """Words of a line: gaps that follow a word, and one for a word at the end."""
    return f"size(filter(split({text}, r'{GAP}', -1), w -> w <> ''))"


def quality_rules(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept and clean_text."""
    t, w = "__text", WINDOW
    out = docs.withColumn(t, F.coalesce(F.col(text_column), F.lit("")))
    out = out.withColumn("__words", F.expr(f"filter(split({t}, r'{GAP}', -1), w -> w <> '')")).withColumn("__lines", F.expr(f"split({t}, '\n', -1)"))
    out = out.withColumns({
        "n_words": F.size("__words").cast("long"),
        "word_chars": F.length(F.translate(t, " \t\n\x0b\x0c\r", "")).cast("long"),
        "n_symbols": (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long"),
        # one pass over the lines; every verdict below reads it
        "__judged": F.expr(f"transform(__lines, l -> CASE WHEN l rlike r'[^\\x20\\x09-\\x0D]' THEN struct(l AS l, true AS full, {_fails_cheap_first('l', _word_count('l'))} AS fails) ELSE struct(l AS l, false AS full, false AS fails) END)"),
        "__windows": F.expr(f"CASE WHEN size(__words) >= {w} THEN transform(sequence(1, size(__words) - {w - 1}), i -> xxhash64(slice(__words, i, {w}))) ELSE array() END"),
    })
    out = out.withColumn("__full", F.expr("transform(filter(__judged, x -> x.full), x -> x.l)"))
    out = out.withColumns({
        "n_dup_lines": (F.size("__full") - F.size(F.array_distinct("__full"))).cast("long"),
        "__sorted": F.expr("CASE WHEN size(array_distinct(__windows)) < size(__windows) THEN array_sort(transform(__windows, (h, i) -> struct(h AS h, i AS i))) END"),
    }).drop("__words", "__windows")
    # places of windows found twice or more, in order
    out = out.withColumn("__places", F.expr("""CASE WHEN __sorted IS NOT NULL THEN array_sort(transform(
        filter(sequence(0, size(__sorted) - 1), j -> (j > 0 AND __sorted[greatest(j - 1, 0)].h = __sorted[j].h) OR (j + 1 < size(__sorted) AND __sorted[least(j + 1, size(__sorted) - 1)].h = __sorted[j].h)),
        j -> __sorted[j].i)) END"""))  # fmt: skip
    covered = f"aggregate(sequence(0, size(__places) - 2), {w}, (a, j) -> a + least({w}, __places[j + 1] - __places[j]))"
    out = out.withColumn("n_repeat_words", F.expr(f"CAST(CASE WHEN __places IS NULL THEN 0 ELSE {covered} END AS BIGINT)"))
    out = out.withColumn("base_failed", F.expr(f"n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT} * n_words"))
    out = out.withColumns({
        "__all": F.expr("aggregate(__judged, 0L, (a, x) -> a + CASE WHEN x.full THEN length(x.l) ELSE 0 END)"),
        "__lost": F.expr("aggregate(__judged, 0L, (a, x) -> a + CASE WHEN x.fails THEN length(x.l) ELSE 0 END)"),
    })
    clean = F.expr("CASE WHEN __lost = 0 THEN __text ELSE array_join(transform(filter(__judged, x -> NOT x.fails), x -> x.l), '\n') END")
    # The optimizer moves a filter below deterministic columns and repeats what it tests inside every lambda; the partition's number,
    # which changes nothing here, keeps filters on the verdict above.
    verdict = F.expr(f"NOT base_failed AND 100 * __lost <= {MAX_LOST} * __all") & (F.spark_partition_id() >= 0)
    out = out.withColumns({"kept": verdict, "clean_text": F.when(F.col(text_column).isNotNull(), clean)})
    return out.drop(t, "__lines", "__full", "__judged", "__sorted", "__places", "__all", "__lost")


def op4_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return quality_rules(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.sha2(F.coalesce("clean_text", F.lit("")), 256).alias("clean_sha256"))


def _sql_fails(line: str, words: str) -> str:
    return _line_fails(line, words).replace("regexp_like(", "regexp_matches(")


OP4_SQL = rf"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
words AS (SELECT doc_id, t, list_filter(string_split_regex(t, '{GAP}'), lambda x: x <> '') AS ws FROM texts),
windows AS (
  SELECT doc_id, unnest(list_transform(range(1, len(ws) - {WINDOW - 2}), lambda i: md5(array_to_string(ws[i:i + {WINDOW - 1}], ' ')))) AS w, unnest(range(1, len(ws) - {WINDOW - 2})) AS i FROM words WHERE len(ws) >= {WINDOW}),
repeats AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w) AS n FROM windows) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM repeats, range({WINDOW}) AS r(k) GROUP BY doc_id),
lines AS (
  SELECT doc_id, i, line, regexp_matches(line, '[^\x20\x09-\x0D]') AS has, len(list_filter(string_split_regex(line, '{GAP}'), lambda x: x <> '')) AS n FROM (
    SELECT doc_id, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS i FROM texts)),
judged AS (SELECT *, has AND {_sql_fails('line', 'n')} AS fails FROM lines),
per_doc AS (
  SELECT doc_id, count(*) FILTER (has) - count(DISTINCT line) FILTER (has) AS dup, coalesce(sum(length(line)) FILTER (has), 0) AS total, coalesce(sum(length(line)) FILTER (fails), 0) AS lost,
    coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT fails), '') AS clean FROM judged GROUP BY doc_id),
base AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(translate(t, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), ''))::BIGINT AS word_chars,
  (length(t) - length(translate(t, '{SYMBOLS}', '')))::BIGINT AS n_symbols, coalesce(n, 0)::BIGINT AS n_repeat_words FROM words w LEFT JOIN covered c ON w.doc_id = c.doc_id)
SELECT b.doc_id, n_words, word_chars, n_symbols, dup::BIGINT AS n_dup_lines, n_repeat_words, (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT} * n_words) AS base_failed,
  NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT} * n_words) AND 100 * lost <= {MAX_LOST} * total AS kept, sha256(clean) AS clean_sha256
FROM base b JOIN per_doc p ON b.doc_id = p.doc_id
"""
