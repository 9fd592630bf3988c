"""The queries of these operators over the driver's tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import align_tokens, bpe, chat, exact_dedup, hard_negatives, kn_quality, line_dedup, lm_trie, mixing, ngram_jaccard, quality_rules, toxicity, url_filter
from .common import table


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard.classes(table(spark, sf_dir, "documents"))


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages")).drop("score")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = mixing.drawn(table(spark, sf_dir, "documents"))
    return drawn.select(F.col("row.doc_id").alias("doc_id"), "source", "epoch", "weight")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), bpe.vocabulary(), with_ids=False)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.report(table(spark, sf_dir, "documents"))


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(table(spark, sf_dir, "conversations"))


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_trie.apply(table(spark, sf_dir, "documents"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kn_quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.label(table(spark, sf_dir, "documents"))


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.label(table(spark, sf_dir, "documents"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_tokens.label(table(spark, sf_dir, "documents"), align_tokens.vocabularies())


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    changed = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives.mine(changed, F.col("vec_id") % 100 == 0)


def queries() -> dict:
    return {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


_FITS = [(h, p, v, f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')") for h, p, v in sorted(url_filter.RULES, key=lambda r: -len(r[0] + r[1]))]
_RUNS = range(1, url_filter.ORDER + 1)


def _smoothed(m: str) -> str:
    """Columns m1 … of the running probability of one class."""
    out, last = [], f"1.0::DOUBLE / {url_filter.ALPHABET}"
    for k in _RUNS:
        out.append(f"CASE WHEN i >= {k} THEN ({m}c{k} + {url_filter.PRIOR} * ({last})) / ({m}x{k} + {url_filter.PRIOR}) ELSE {last} END AS {m}{k}")
        last = f"{m}{k}"
    return ", ".join(out)


SQL = {
    "op2_url_filters": f"""
        WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
        h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                     regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
        r AS (SELECT *, CASE {" ".join(f"WHEN {c} THEN '{h}{p}'" for h, p, _, c in _FITS)} END AS rule,
                     CASE {" ".join(f"WHEN {c} THEN '{v}'" for _, _, v, c in _FITS)} END AS ruled, lower(host || path) || chr(10) AS s FROM h),
        d AS (SELECT DISTINCT s FROM r),
        g AS (SELECT s, i, k, substr(s, i - k + 1, k) AS run
              FROM (SELECT s, i, unnest(range(1, least({url_filter.ORDER}, i) + 1)) AS k FROM (SELECT s, unnest(range(1, length(s) + 1)) AS i FROM d))),
        t AS (SELECT ruled, s FROM r WHERE ruled IS NOT NULL AND CAST('0x' || substr(md5(s || 'fold'), 1, 8) AS BIGINT) % {url_filter.HELD_OUT} <> 0),
        total AS (SELECT coalesce(sum(length(s)) FILTER (WHERE ruled = 'allow'), 0) AS a, coalesce(sum(length(s)) FILTER (WHERE ruled = 'block'), 0) AS b FROM t),
        c AS (SELECT run, count(*) FILTER (WHERE ruled = 'allow') AS a, count(*) FILTER (WHERE ruled = 'block') AS b FROM t JOIN g USING (s) GROUP BY run),
        n AS (SELECT g.s, g.i, g.k, coalesce(c.a, 0) AS a, coalesce(c.b, 0) AS b FROM g LEFT JOIN c USING (run)),
        w AS (SELECT s, i, {", ".join(f"max({m}) FILTER (WHERE k = {k}) AS {m}c{k}" for m in "ab" for k in _RUNS)} FROM n GROUP BY s, i),
        x AS (SELECT w.*, (SELECT a FROM total) AS ax1, (SELECT b FROM total) AS bx1, {", ".join(f"v.{m}c{k - 1} AS {m}x{k}" for m in "ab" for k in _RUNS if k > 1)} FROM w LEFT JOIN w v ON v.s = w.s AND v.i = w.i - 1),
        y AS (SELECT s, i, {_smoothed("a")}, {_smoothed("b")} FROM x),
        z AS (SELECT s, sum(CAST(round({url_filter.UNIT} * (ln(a{url_filter.ORDER}) - ln(b{url_filter.ORDER}))) AS BIGINT)) / length(s) AS score FROM y GROUP BY s),
        low AS (SELECT coalesce(quantile_disc(round(score), {url_filter.MISSED}), 0) / {url_filter.UNIT} AS low FROM r JOIN z USING (s)
                WHERE ruled = 'allow' AND CAST('0x' || substr(md5(s || 'fold'), 1, 8) AS BIGINT) % {url_filter.HELD_OUT} = 0)
        SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN score / {url_filter.UNIT} >= (SELECT low FROM low) THEN 'allow' ELSE 'block' END) AS verdict
        FROM r JOIN z USING (s)""",
    "op11_line_dedup": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
        l AS (SELECT doc_id, t, i, lines[i] AS line,
                     translate(regexp_replace(lines[i], '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS line_key
              FROM (SELECT doc_id, t, lines, unnest(range(1, len(lines) + 1)) AS i FROM d)),
        gone AS (SELECT line_key FROM l WHERE length(line_key) >= 1 GROUP BY line_key HAVING count(DISTINCT (doc_id, t)) >= 10)
        SELECT doc_id, count(*) AS n_lines, count(gone.line_key) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE gone.line_key IS NULL), '')) AS kept_sha256
        FROM l LEFT JOIN gone USING (line_key) GROUP BY doc_id, t""",
    "op13_hard_negatives": """
        WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                          list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS q
                   FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
                   AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT a.vec_id AS anchor_id, r.vec_id AS id, a.label = r.label AS alike, CAST(list_inner_product(a.q, r.q) AS BIGINT) AS score
              FROM v a JOIN v r ON a.vec_id <> r.vec_id WHERE a.vec_id % 100 = 0),
        p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE alike
              QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
        SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, id AS negative_id, positive_score, score AS negative_score
        FROM p JOIN s USING (anchor_id) WHERE NOT alike AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
        WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) QUALIFY row_number() OVER w <= 10""",
    "op10_exact_dedup": """
        WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, text_sha256
        FROM d WINDOW w AS (PARTITION BY text_sha256)""",
    "op7_chat_formatting": """
        WITH c AS (
          SELECT conv_id, count(*) AS n_turns,
                 string_agg('<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10), '' ORDER BY turn, role, text) AS rendered,
                 list(struct_pack(r := coalesce(role, ''), t := coalesce(text, '')) ORDER BY turn, role, text) AS turns
          FROM conversations GROUP BY conv_id),
        d AS (
          SELECT conv_id, n_turns, rendered,
                 list_reduce(list_prepend('', list_transform(turns, lambda x: concat(length(x.r), '|', x.r, '|', x.t))),
                             lambda a, x: md5(a || '|' || x)) AS digest, turns
          FROM c),
        p AS (SELECT DISTINCT conv_id, unnest(range(1, n_turns)) AS k FROM d),
        q AS (
          SELECT DISTINCT list_reduce(list_prepend('', list_transform(turns[1:k], lambda x: concat(length(x.r), '|', x.r, '|', x.t))),
                                      lambda a, x: md5(a || '|' || x)) AS digest
          FROM p JOIN d USING (conv_id))
        SELECT min(conv_id) AS conv_id, min(n_turns) AS n_turns, count(*) AS n_copies, digest, min(rendered) AS rendered
        FROM d WHERE digest NOT IN (SELECT digest FROM q) GROUP BY digest""",
    "op6_quality_rules": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
        w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words,
                     list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
        g AS (SELECT doc_id, i, array_to_string(words[i:i + 7], ' ') AS gram
              FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM w)),
        r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM g) WHERE n > 1),
        m AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM r) GROUP BY doc_id),
        f AS (SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words,
                     CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
                     CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
                     CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
                     CAST(len(ls) AS BIGINT) AS n_lines,
                     CAST(len(regexp_extract_all(t, '[A-ZÀ-ÖØ-Þ]')) AS BIGINT) AS n_capitals,
                     CAST(len(list_filter(range(2, len(words) + 1), lambda i: words[i] = words[i - 1])) AS BIGINT) AS n_echo_words,
                     CAST(coalesce(m.n, 0) AS BIGINT) AS n_repeat_words
              FROM w LEFT JOIN m ON m.doc_id = w.doc_id),
        b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM f)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT (base_failed OR 100 * n_symbols > 30 * n_words OR word_chars > 15 * n_words OR word_chars < 2 * n_words
                       OR n_dup_lines >= 3 AND 100 * n_dup_lines > 30 * n_lines OR 100 * n_echo_words > 30 * n_words OR 100 * n_capitals > 30 * word_chars) AS kept FROM b""",
}
