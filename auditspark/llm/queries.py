"""The operators applied to whole tables, one query each, and SQL for those that SQL can express."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditspark.llm import chat, decontaminate, linefreq, lines, neighbours, phrases, pieces, quality, shards, simhash, spelling, toxicity, urls
from auditspark.llm.common import label_fold

TOXIC_FOLDS, TOXIC_HELD = 4, 2
QUALITY_FOLDS, QUALITY_HELD = 3, 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _classified(scored: DataFrame, folds: int, held: int, threshold: float) -> DataFrame:
    return scored.select(
        "doc_id",
        (label_fold("doc_id", folds) == held).alias("held_out"),
        "score",
        F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"),
        *(name for name in scored.columns if name not in ("doc_id", "score")),
    )


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, with the sentences that cause it."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.learned(docs, labels, label_fold("doc_id", TOXIC_FOLDS) != TOXIC_HELD)
    return _classified(toxicity.scores(docs, model), TOXIC_FOLDS, TOXIC_HELD, 0.3)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), words=4, radius=4)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines that every document loses to an equal or similar line elsewhere."""
    return lines.line_report(table(spark, sf_dir, "documents"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sampled segmentation of every document, decoded again."""
    return pieces.round_trip(table(spark, sf_dir, "documents"), seed=1)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlap of every document with the benchmark."""
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of every vector whose number is divisible by 50."""
    return neighbours.nearest_neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, nearest=5)


def quality_model(spark: SparkSession, sf_dir: str) -> quality.Model:
    """The model of the labelled documents outside the held-out part."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return quality.learned(docs, labels, label_fold("doc_id", QUALITY_FOLDS) != QUALITY_HELD)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document."""
    model = quality_model(spark, sf_dir)
    return _classified(quality.scores(table(spark, sf_dir, "documents"), model), QUALITY_FOLDS, QUALITY_HELD, 0.5)


RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of the rules on every page; a page that no list holds is allowed."""
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return urls.judge(table(spark, sf_dir, "pages"), rules, default="allow")


PROBE = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all conversations, rebuilt from events, formatted and read back."""
    rows = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text"
    )
    probe = spark.createDataFrame(PROBE, "conv_id long, turn long, role string, text string")
    events = chat.events_of_rows(rows.unionByName(probe))
    return chat.read_back(chat.formatted(chat.fold(events)))


def op10_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token sequences of all documents in training order, as fixed-size records."""
    return shards.training_order(table(spark, sf_dir, "documents"))


def op11_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word rules and cross-document line frequency of every document."""
    return linefreq.judged(table(spark, sf_dir, "documents"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The phrases of each language that stand together most strikingly."""
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of all texts with their spelling variants."""
    return spelling.variants(table(spark, sf_dir, "documents")).select("word", "form", "root", "n", "n_near", "form_n")


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        query.__name__: query
        for query in (
            op1_toxicity,
            op2_simhash,
            op3_line_dedup,
            op4_sentencepiece,
            op5_decontamination,
            op6_neighbours,
            op7_quality,
            op8_url_filter,
            op9_chat,
            op10_training_order,
            op11_line_frequency,
            op12_collocations,
            op13_spelling,
        )
    }


OP5_SQL = r"""
WITH doc AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM documents
), item AS (
  SELECT item_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM benchmark WHERE item_id IS NOT NULL
), item_window AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS size, array_to_string(w[p:p + least(13, len(w)) - 1], ' ') AS words
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS p FROM item WHERE len(w) > 0)
), doc_window AS (
  SELECT doc_id, p, size, array_to_string(w[p:p + size - 1], ' ') AS words
  FROM (
    SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS p
    FROM doc, (SELECT DISTINCT size FROM item_window) WHERE len(w) >= size
  )
), hit AS (SELECT doc_id, p, size, item_id FROM doc_window JOIN item_window USING (size, words)
), hit_word AS (
  SELECT doc_id, count(DISTINCT word_no) AS n_hit
  FROM (SELECT doc_id, unnest(range(p, p + size)) AS word_no FROM (SELECT DISTINCT doc_id, p, size FROM hit)) GROUP BY doc_id
), hit_item AS (
  SELECT doc_id, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS names
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS name FROM hit) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc LEFT JOIN hit_word USING (doc_id) LEFT JOIN hit_item USING (doc_id)
"""


OP8_SQL = r"""
WITH page AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(url, '://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages
), rules(h, p, v) AS (
  VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
), fit AS (
  SELECT page_id, host, path, h || p AS rule, v,
    row_number() OVER (PARTITION BY page_id ORDER BY length(h || p) DESC) AS place
  FROM page LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM fit WHERE place = 1
"""

OP9_SQL = r"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
), sized AS (
  SELECT *, length(text) + len(regexp_extract_all(text, '<<SYS>>|<</SYS>>|\[INST\]|\[/INST\]|<s>|</s>|<role>|</role>|\\'))
    + CASE role WHEN 'user' THEN 13 WHEN 'assistant' THEN 7 WHEN 'system' THEN 15 ELSE 14 + length(role) END AS chars
  FROM said
)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""

OP11_SQL = r"""
WITH doc AS (
  SELECT row_number() OVER () AS place, doc_id, source, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), line AS (
  SELECT place, source, line, trim(regexp_replace(regexp_replace(
    translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9]', '0', 'g'), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS plain
  FROM (SELECT place, source, unnest(string_split(text, chr(10))) AS line FROM doc)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), frequent AS (
  SELECT source, plain FROM line GROUP BY source, plain HAVING count(DISTINCT place) > 20
), removed AS (
  SELECT place, sum(len(string_split(plain, ' '))) AS n
  FROM line JOIN frequent f USING (plain) WHERE f.source IS NOT DISTINCT FROM line.source GROUP BY place
), dup AS (SELECT place, count(*) - count(DISTINCT line) AS n FROM line GROUP BY place
), win AS (
  SELECT place, p, w[p] || ' ' || w[p + 1] || ' ' || w[p + 2] AS words
  FROM (SELECT place, w, unnest(range(1, len(w) - 1)) AS p FROM doc WHERE len(w) > 2)
), again AS (SELECT place, p FROM win QUALIFY count(*) OVER (PARTITION BY place, words) > 1
), rep AS (SELECT place, count(DISTINCT q) AS n FROM (SELECT place, unnest([p, p + 1, p + 2]) AS q FROM again) GROUP BY place
), counted AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
    CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
    CAST(coalesce(removed.n, 0) AS BIGINT) AS n_removed_words
  FROM doc LEFT JOIN dup USING (place) LEFT JOIN rep USING (place) LEFT JOIN removed USING (place)
)
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * (n_words - n_removed_words) >= 30 * n_words AS kept
FROM counted
"""

OP12_SQL = r"""
WITH piece AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), said AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM piece
), total AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM said GROUP BY lang
), gram AS (
  SELECT lang, size, array_to_string(w[p:p + size - 1], ' ') AS phrase, count(*) AS f
  FROM (SELECT lang, w, size, unnest(range(1, len(w) - size + 2)) AS p
    FROM said, (SELECT unnest(range(1, 6)) AS size) WHERE len(w) >= size)
  GROUP BY ALL HAVING count(*) >= 100
), part AS (
  SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS w, unnest(range(1, size)) AS k FROM gram WHERE size > 1
), cut AS (
  SELECT part.*, one.f AS l, two.f AS r, total.n,
    CAST((1000::HUGEINT * a * n) // (one.f::HUGEINT * two.f) AS BIGINT) AS score
  FROM part JOIN gram one ON one.lang = part.lang AND one.phrase = array_to_string(part.w[:k], ' ')
    JOIN gram two ON two.lang = part.lang AND two.phrase = array_to_string(part.w[k + 1:], ' ')
    JOIN total ON total.lang = part.lang
), lowest AS (
  SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), free AS (
  SELECT * FROM lowest WHERE NOT EXISTS (
    SELECT 1 FROM gram longer WHERE longer.lang = lowest.lang AND longer.size > lowest.size
      AND 100 * longer.f >= 100 * lowest.a AND contains(' ' || longer.phrase || ' ', ' ' || lowest.phrase || ' '))
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM free QUALIFY rank <= 2000
"""


def all_oracles() -> dict[str, str]:
    return {
        "op5_decontamination": OP5_SQL,
        "op8_url_filter": OP8_SQL,
        "op9_chat": OP9_SQL,
        "op11_line_frequency": OP11_SQL,
        "op12_collocations": OP12_SQL,
    }
