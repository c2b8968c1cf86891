"""DuckDB SQL for every query that SQL can express.

Written independently of the operators: plain joins, windows and lists, with only the
fixed values (labels, keywords, texts) taken from the rule tables.
"""

from __future__ import annotations

import re

from plaintide import rules
from plaintide.plans import reports
from verification import queries as q
from verification.views import PHRASES

ORACLE: dict[str, str] = {}

# The white-space characters as a character class of RE2.
WS = (
    r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)

CTES: dict[str, str] = {}


def lit(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def strings(values) -> str:
    return ", ".join(lit(v) for v in values)


def clean(c: str) -> str:
    return (
        f"trim(regexp_replace(regexp_replace(regexp_replace(coalesce({c}, ''), '<.*?>', ' ', 'g'), "
        f"'http[^{WS}]+|www[^{WS}]+', ' ', 'g'), '[{WS}]+', ' ', 'g'))"
    )


def strip(c: str) -> str:
    return f"regexp_replace({c}, '^[{WS}]+|[{WS}]+$', '', 'g')"


def norm(c: str) -> str:
    return f"lower({strip(f'coalesce({c}, {lit(str())})')})"


def clip(c: str, n: int) -> str:
    line = strip(f"replace(replace(coalesce({c}, ''), chr(10), ' '), chr(13), ' ')")
    return (
        f"CASE WHEN length({line}) > {n} THEN regexp_replace(substr({line}, 1, {n}), '[{WS}]+$', '') || '...' "
        f"ELSE {line} END"
    )


def hits(text: str, words) -> str:
    return "(" + " + ".join(f"(contains({text}, {lit(w)}))::INT" for w in words) + ")"


def found(text: str, words) -> str:
    return "(" + " OR ".join(f"contains({text}, {lit(w)})" for w in words) + ")"


def whole(words) -> list[str]:
    """Keywords as whole words between blanks."""
    return [" " + " ".join(re.findall(r"\w+", w.lower())) + " " for w in words]


def first_match(text: str) -> str:
    whens = " ".join(f"WHEN {found(text, words)} THEN {lit(x)}" for x, words in rules.FIRST_MATCH_KEYWORDS.items())
    return f"CASE {whens} ELSE 'other' END"


def best(prefix: str, labels, score: str, other: str = "'other'") -> str:
    whens = " ".join(f"WHEN {prefix}{i} = {score} THEN {lit(x)}" for i, x in enumerate(labels))
    return f"CASE WHEN {score} = 0 THEN {other} {whens} END"


def sentiment(c: str) -> str:
    return f"CASE WHEN {c} <= 2 THEN 'negative' WHEN {c} = 3 THEN 'neutral' ELSE 'positive' END"


def key(c: str) -> str:
    return f"md5('42:' || {c})"


def label_rows(labels) -> str:
    return "(VALUES " + ", ".join(f"({i}, {lit(x)})" for i, x in enumerate(labels)) + ") AS l(label_id, label)"


def with_ctes(names: str, body: str) -> str:
    """Prefix ``body`` with the named CTEs and those they need."""
    wanted: list[str] = []

    def need(name: str) -> None:
        if name in wanted:
            return
        for other in CTES:
            if other != name and f" {other} " in f" {CTES[name]} ".replace("(", " ").replace(")", " ").replace(",", " ").replace("\n", " "):
                need(other)
        wanted.append(name)

    for name in names.split():
        need(name)
    return "WITH " + ",\n".join(f"{n} AS ({CTES[n]})" for n in wanted) + "\n" + body


def add(name: str, ctes: str, body: str) -> None:
    ORACLE[name] = with_ctes(ctes, body) if ctes else body


# -- shared tables -------------------------------------------------------------

PHRASE = "CASE d.n_chars % 12 " + " ".join(f"WHEN {i} THEN {lit(p)}" for i, p in enumerate(PHRASES)) + " END"
CTES["reviews"] = f"""
  SELECT d.doc_id AS ordinal, p.p_name AS product_name, p.p_brand AS brand, p.p_retailprice AS price,
    CASE WHEN d.doc_id % 37 = 0 THEN NULL ELSE CAST(1 + (d.doc_id * 7 + d.n_chars) % 5 AS DOUBLE) END AS rating,
    concat(d.text, ' ', {PHRASE}) AS review_text, CAST(d.doc_id % 11 AS DOUBLE) AS review_votes
  FROM documents d LEFT JOIN part p ON p.p_partkey = d.doc_id % (SELECT count(*) FROM part)"""
CTES["cleaned"] = f"""
  SELECT * FROM (SELECT * REPLACE ({clean('review_text')} AS review_text) FROM reviews )
  WHERE length(review_text) > 5"""
CTES["clean_reviews"] = f"""
  SELECT row_number() OVER (ORDER BY ordinal) AS review_id, product_name, brand, price, rating, review_text,
    review_votes, {sentiment('rating')} AS sentiment_label, CAST(NULL AS DATE) AS date,
    CAST(NULL AS VARCHAR) AS issue_label
  FROM (SELECT *, row_number() OVER (PARTITION BY review_text ORDER BY ordinal) AS nth FROM cleaned )
  WHERE nth = 1"""
CTES["sentences"] = f"""
  SELECT ordinal AS review_id, * EXCLUDE (ordinal), {sentiment('rating')} AS sentiment_label FROM cleaned """
CTES["labeled"] = f"""
  SELECT *, {first_match('lower(review_text)')} AS issue_label FROM sentences """
CTES["hits"] = (
    "SELECT *, greatest("
    + ", ".join(f"h{i}" for i in range(10))
    + ") AS rule_score, greatest("
    + ", ".join(f"g{i}" for i in range(10))
    + ") AS guess_score FROM (SELECT *, "
    + ", ".join(f"{hits('lower(review_text)', w)} AS h{i}" for i, w in enumerate(rules.ISSUE_KEYWORDS.values()))
    + ", "
    + ", ".join(f"{hits('lower(review_text)', w)} AS g{i}" for i, w in enumerate(rules.GUESS_KEYWORDS.values()))
    + " FROM labeled )"
)
CTES["ruled"] = f"""
  SELECT *, {best('h', rules.ISSUE_KEYWORDS, 'rule_score')} AS rule_issue_label,
    {best('g', rules.GUESS_KEYWORDS, 'guess_score')} AS keyword_guess_label FROM hits """
CTES["scores"] = (
    "SELECT review_id, issue_label, review_text, unnest(["
    + ", ".join(str(i) for i in range(11))
    + "]) AS label_id, unnest(["
    + ", ".join(f"h{i}::DOUBLE" for i in range(10))
    + ", 0.5::DOUBLE]) AS score FROM hits "
)
CTES["probs"] = """
  SELECT s.review_id, s.issue_label, s.review_text, s.label_id, l.label,
    exp(s.score - max(s.score) OVER w) / sum(exp(s.score - m.top)) OVER w AS p,
    row_number() OVER (PARTITION BY s.review_id ORDER BY s.score DESC, s.label_id) AS rank
  FROM scores s JOIN (SELECT review_id, max(score) AS top FROM scores GROUP BY 1) m ON m.review_id = s.review_id
  JOIN """ + label_rows(rules.ISSUES) + """ ON l.label_id = s.label_id
  WINDOW w AS (PARTITION BY s.review_id)"""
CTES["best"] = """
  SELECT review_id, any_value(review_text) AS review_text, any_value(issue_label) AS true_label,
    max(label) FILTER (rank = 1) AS pred_label, max(p) FILTER (rank = 1) AS confidence,
    max(label) FILTER (rank = 1) AS top_1_label, max(p) FILTER (rank = 1) AS top_1_prob,
    max(label) FILTER (rank = 2) AS top_2_label, max(p) FILTER (rank = 2) AS top_2_prob,
    max(label) FILTER (rank = 3) AS top_3_label, max(p) FILTER (rank = 3) AS top_3_prob
  FROM probs GROUP BY review_id"""
REASON = f"""CASE
    WHEN sentiment_label = 'positive' AND rule_issue_label IN ({strings(rules.POSITIVE_DOUBTFUL)}) THEN {lit(rules.REASON_POSITIVE)}
    WHEN sentiment_label = 'negative' AND rule_issue_label IN ({strings(rules.NEGATIVE_DOUBTFUL)}) THEN {lit(rules.REASON_NEGATIVE)}
    WHEN guess_score > 0 AND keyword_guess_label <> rule_issue_label THEN {lit(rules.REASON_CONFLICT)}
    WHEN rule_issue_label = 'other' THEN {lit(rules.REASON_OTHER)} ELSE '' END"""
CTES["flagged"] = f"""
  SELECT review_id AS annotation_id, review_id, rating, sentiment_label, rule_issue_label, keyword_guess_label,
    guess_score AS keyword_guess_score, rule_issue_label AS manual_issue_label,
    CASE WHEN reason = '' THEN 'no' ELSE 'yes' END AS needs_review, reason AS review_reason, '' AS annotation_note
  FROM (SELECT *, {REASON} AS reason FROM ruled )"""
CTES["classes"] = """
  SELECT l.label_id, l.label, count(*) FILTER (b.true_label = l.label AND b.pred_label = l.label) AS hit,
    count(*) FILTER (b.true_label = l.label) AS support, count(*) FILTER (b.pred_label = l.label) AS predicted
  FROM """ + label_rows(rules.ISSUES) + """ LEFT JOIN best b ON b.true_label = l.label OR b.pred_label = l.label
  GROUP BY ALL"""
CTES["class_scores"] = """
  SELECT *, CASE WHEN predicted = 0 THEN 0 ELSE hit / predicted END AS precision,
    CASE WHEN support = 0 THEN 0 ELSE hit / support END AS recall,
    CASE WHEN predicted + support = 0 THEN 0 ELSE 2 * hit / (predicted + support) END AS f1_score FROM classes """
CTES["vecs"] = """
  SELECT vec_id, label AS cluster_id, generate_subscripts(embedding, 1) - 1 AS dim,
    unnest(embedding)::DOUBLE AS x FROM embeddings """
CTES["centers"] = "SELECT cluster_id, dim, avg(x) AS value FROM vecs GROUP BY ALL"
CTES["distances"] = """
  SELECT v.vec_id, v.cluster_id, sqrt(sum((v.x - c.value) * (v.x - c.value))) AS distance_to_cluster_center
  FROM vecs v JOIN centers c ON c.cluster_id = v.cluster_id AND c.dim = v.dim GROUP BY ALL"""
CTES["clustered"] = """
  SELECT s.review_id, s.review_text, s.rating, s.sentiment_label, s.product_name, s.brand,
    b.pred_label AS predicted_issue_label, b.confidence AS predicted_issue_confidence, d.cluster_id,
    d.distance_to_cluster_center
  FROM sentences s JOIN distances d ON d.vec_id = s.review_id % (SELECT count(*) FROM embeddings)
  JOIN best b ON b.review_id = s.review_id """
CTES["sil"] = """
  SELECT avg(CASE WHEN own_n = 1 THEN 0 ELSE (b - a) / greatest(a, b) END) AS silhouette FROM (
    SELECT i, max(CASE WHEN ci = cj THEN total / nullif(n - 1, 0) END) AS a, max(CASE WHEN ci = cj THEN n END) AS own_n,
      min(CASE WHEN ci <> cj THEN total / n END) AS b
    FROM (SELECT x.vec_id AS i, x.label AS ci, y.label AS cj, count(*) AS n,
            sum(CASE WHEN x.vec_id = y.vec_id THEN 0 ELSE list_cosine_distance(x.embedding::DOUBLE[], y.embedding::DOUBLE[]) END) AS total
          FROM embeddings x CROSS JOIN embeddings y GROUP BY ALL) GROUP BY i)"""


def keyword_ctes(source: str, group: str, tag: str) -> None:
    """Term counts, vocabulary and ranked terms per group of ``source``."""
    words = (
        f"list_filter(regexp_extract_all(lower(review_text), '[\\p{{L}}\\p{{N}}_]{{2,}}'), "
        f"lambda w: NOT list_contains([{strings(rules.ENGLISH_STOP_WORDS)}], w))"
    )
    CTES[f"{tag}words"] = f"SELECT {group} AS g, review_id, {words} AS w FROM {source} "
    CTES[f"{tag}term_rows"] = (
        f"SELECT g, unnest(w) AS term FROM {tag}words UNION ALL "
        f"SELECT g, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM {tag}words "
    )
    CTES[f"{tag}term_rows"] += (
        f" UNION ALL SELECT g, last || ' ' || next FROM (SELECT g, w[len(w)] AS last, "
        f"lead(w[1]) OVER (PARTITION BY g ORDER BY review_id) AS next FROM {tag}words WHERE len(w) > 0) WHERE next IS NOT NULL"
    )
    CTES[f"{tag}tfs"] = f"SELECT g, term, count(*) AS tf FROM {tag}term_rows GROUP BY ALL"
    CTES[f"{tag}vocabulary"] = (
        f"SELECT term, count(*) AS df, sum(tf) AS total FROM {tag}tfs GROUP BY term HAVING count(*) >= 2 "
        f"ORDER BY total DESC, term LIMIT 8000"
    )
    CTES[f"{tag}terms"] = f"""
      SELECT *, row_number() OVER (PARTITION BY g ORDER BY score DESC, term) AS rank FROM (
        SELECT t.g, t.term, t.tf, v.df,
          t.tf * (ln((1 + (SELECT count(DISTINCT g) FROM {tag}words )) / (1 + v.df)) + 1) AS score
        FROM {tag}tfs t JOIN {tag}vocabulary v ON v.term = t.term
        WHERE length(t.term) > 2
          AND NOT list_has_any(string_split(t.term, ' '), [{strings(rules.DOMAIN_STOP_WORDS)}]))"""


CTES["pointed"] = "SELECT s.*, e.label AS cluster_id FROM sentences s JOIN embeddings e ON e.vec_id = s.review_id % (SELECT count(*) FROM embeddings )"
keyword_ctes("pointed", "cluster_id", "")
keyword_ctes("labeled", "issue_label", "x_")
CTES["keywords"] = """
  SELECT g AS cluster_id, string_agg(term, ', ' ORDER BY rank) AS top_keywords FROM terms WHERE rank <= 8 GROUP BY g"""
CTES["profile"] = """
  SELECT c.cluster_id, count(*) AS cluster_size, any_value(s.label) AS major_sentiment,
    any_value(s.n) AS major_sentiment_count, any_value(i.label) AS major_issue, any_value(i.n) AS major_issue_count,
    avg(predicted_issue_confidence) AS avg_issue_confidence, avg((sentiment_label = 'negative')::INT) AS negative_ratio
  FROM clustered c
  JOIN (SELECT cluster_id, sentiment_label AS label, count(*) AS n,
          row_number() OVER (PARTITION BY cluster_id ORDER BY count(*) DESC, sentiment_label) AS k
        FROM clustered GROUP BY 1, 2) s ON s.cluster_id = c.cluster_id AND s.k = 1
  JOIN (SELECT cluster_id, predicted_issue_label AS label, count(*) AS n,
          row_number() OVER (PARTITION BY cluster_id ORDER BY count(*) DESC, predicted_issue_label) AS k
        FROM clustered GROUP BY 1, 2) i ON i.cluster_id = c.cluster_id AND i.k = 1
  GROUP BY c.cluster_id"""
CTES["representatives"] = (
    "SELECT cluster_id, "
    + ", ".join(f"coalesce(max(review_text) FILTER (k = {i}), '') AS representative_review_{i}" for i in (1, 2, 3))
    + " FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY distance_to_cluster_center, review_id) AS k"
    " FROM clustered ) GROUP BY cluster_id"
)
CTES["summary"] = """
  SELECT p.cluster_id, p.cluster_size, coalesce(k.top_keywords, '') AS top_keywords, p.major_sentiment,
    p.major_sentiment_count, p.major_issue, p.major_issue_count, p.avg_issue_confidence, p.negative_ratio,
    CAST(NULL AS DOUBLE) AS silhouette_score_global, r.representative_review_1, r.representative_review_2,
    r.representative_review_3
  FROM profile p LEFT JOIN keywords k ON k.cluster_id = p.cluster_id
  JOIN representatives r ON r.cluster_id = p.cluster_id"""
_theme_scores = ", ".join(
    hits("combined", words)
    + (f" + CASE WHEN lower(major_issue) IN ({strings(issues)}) THEN 3 ELSE 0 END" if issues else "")
    + f" AS t{i}"
    for i, (_, words, issues) in enumerate(rules.THEME_RULES)
)
_themes = [t for t, _, _ in rules.THEME_RULES]
CTES["themed"] = f"""
  SELECT *, {best('t', _themes, 'theme_confidence_score', lit(rules.DEFAULT_THEME))} AS cluster_theme FROM (
    SELECT *, greatest({', '.join(f't{i}' for i in range(len(_themes)))}) AS theme_confidence_score FROM (
      SELECT *, {_theme_scores} FROM (
        SELECT *, lower(top_keywords) || ' ' || lower(major_issue) || ' ' || lower(representative_review_1) || ' '
          || lower(representative_review_2) || ' ' || lower(representative_review_3) AS combined FROM summary )))"""


def minmax(c: str) -> str:
    return f"CASE WHEN max({c}) OVER () = min({c}) OVER () THEN 1.0 ELSE ({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()) END"


def priority_cte(source: str) -> str:
    return f"""
      SELECT row_number() OVER (ORDER BY priority_score DESC, cluster_id) AS priority_rank, * FROM (
        SELECT *, round_even((0.40::DOUBLE * cluster_size_score + 0.25::DOUBLE * issue_concentration_score
          + 0.20::DOUBLE * confidence_score + 0.10::DOUBLE * negative_ratio_score
          + 0.05::DOUBLE * growth_proxy_score) * 100 * 100, 0) / 100 AS priority_score FROM (
          SELECT *, {minmax('cluster_size')} AS cluster_size_score,
            {minmax('issue_concentration')} AS issue_concentration_score,
            {minmax('avg_issue_confidence')} AS confidence_score, {minmax('negative_ratio')} AS negative_ratio_score,
            0.5::DOUBLE AS growth_proxy_score FROM (
            SELECT * REPLACE (cluster_size::DOUBLE AS cluster_size, major_issue_count::DOUBLE AS major_issue_count),
              major_issue_count / CASE WHEN cluster_size = 0 THEN 1 ELSE cluster_size END AS issue_concentration
            FROM {source} )))"""


_reviews = [f"representative_review_{i}" for i in (1, 2, 3)]
_whole = "cluster_size::BIGINT AS cluster_size, major_issue_count::BIGINT AS major_issue_count"
CTES["ranked"] = f"SELECT * REPLACE ({_whole}, {', '.join(f'{clip(c, 600)} AS {c}' for c in _reviews)}) FROM ({priority_cte('themed')})"
CTES["minimal"] = """
  SELECT cluster_id, cluster_theme, cluster_size, major_issue, top_keywords, cluster_size AS major_issue_count,
    0.5::DOUBLE AS avg_issue_confidence, 1.0::DOUBLE AS negative_ratio FROM themed """

# -- scans, shaping, filters -----------------------------------------------------

add("standardize_columns", "reviews", "SELECT * FROM reviews")
_na = "['" + "', '".join(rules.NA_WORDS) + "']"
add("na_normalize", "reviews", f"""
  SELECT ordinal, product_name, CASE WHEN brand IN ({strings(rules.NA_WORDS)}) THEN NULL ELSE brand END AS brand,
    CASE WHEN review_text IN ({strings(rules.NA_WORDS)}) THEN NULL ELSE review_text END AS review_text
  FROM (SELECT ordinal, product_name, review_text, CASE WHEN ordinal % 23 < {len(rules.NA_WORDS)}
          THEN {_na}[ordinal % 23 + 1] ELSE brand END AS brand FROM reviews )""")
_word = "string_split(review_text, ' ')[1]"
add("numeric_coerce", "reviews", f"""
  SELECT ordinal, coalesce(CASE ordinal % 3 WHEN 0 THEN price WHEN 1 THEN try_cast({_word} AS DOUBLE) ELSE rating END, 0.5) AS number
  FROM reviews""")
_issue_id = "(list_position([" + strings(rules.ISSUES) + "], issue_label) - 1)::INT"
_sentiment_id = "(list_position([" + strings(rules.SENTIMENTS) + "], sentiment_label) - 1)::INT"
add("label_encode", "labeled", f"""
  SELECT review_id, {_issue_id} AS issue_id, {_sentiment_id} AS sentiment_id, issue_label AS issue_again FROM labeled""")
add("dense_review_id", "reviews", """
  SELECT row_number() OVER (ORDER BY ordinal) AS review_id, ordinal, rating FROM reviews WHERE rating <= 2""")
add("clean_text", "reviews", f"SELECT ordinal, {clean('review_text')} AS review_text FROM reviews")
add("clean_page_text", "", f"SELECT page_id, {clean('html')} AS page_text FROM pages")
add("rating_sentiment", "reviews", f"""
  SELECT ordinal, {sentiment('rating')} AS sentiment_label, {sentiment('(rating / 2 + 1)')} AS half_star_label FROM reviews""")
add("dedup_first", "reviews", """
  SELECT * FROM reviews QUALIFY row_number() OVER (PARTITION BY review_text ORDER BY ordinal) = 1""")
add("clean_reviews", "clean_reviews", "SELECT * FROM clean_reviews")
CTES["gappy"] = """
  SELECT * REPLACE (CASE review_id % 9 WHEN 1 THEN chr(160) WHEN 0 THEN NULL
    ELSE ' ' || chr(10) || review_text || chr(160) END AS review_text) FROM sentences """
add("usable_reviews", "gappy", f"""
  SELECT review_id, {strip('review_text')} AS review_text, sentiment_label FROM gappy
  WHERE review_text IS NOT NULL AND {strip('review_text')} <> ''""")
CTES["noisy"] = """
  SELECT review_id, CASE review_id % 4 WHEN 0 THEN '  ' || upper(issue_label) WHEN 1 THEN issue_label || '?'
    WHEN 2 THEN issue_label END AS noisy_label FROM labeled """
add("valid_label_filter", "noisy", f"""
  SELECT review_id, {norm('noisy_label')} AS issue_label FROM noisy WHERE {norm('noisy_label')} IN ({strings(rules.ISSUES)})""")
add("normalize_labels", "noisy", f"""
  SELECT review_id, {norm('noisy_label')} AS label, CASE WHEN {norm('noisy_label')} IN ({strings(rules.ISSUES)})
    THEN {norm('noisy_label')} ELSE 'other' END AS valid_label FROM noisy""")
add("negative_reviews", "sentences", "SELECT review_id, rating, review_text FROM sentences WHERE sentiment_label = 'negative'")
add("parse_boolean", "reviews", f"""
  SELECT ordinal, coalesce(CASE ordinal % 3 WHEN 0 THEN rating <= 2 WHEN 1 THEN review_votes = 1
    ELSE lower({_word}) IN ('true', '1', 'yes') END, false) AS flag FROM reviews""")
add("clip_text", "reviews", f"""
  SELECT ordinal, {clip('review_text', 80)} AS clip_80, {clip('review_text', 600)} AS clip_600 FROM reviews""")
CTES["bag"] = f"""
  SELECT review_id, list_filter(regexp_extract_all(lower(review_text), '[\\p{{L}}\\p{{N}}_]{{2,}}'),
    lambda w: NOT list_contains([{strings(rules.ENGLISH_STOP_WORDS)}], w)) AS w FROM sentences """
add("token_ngrams", "bag", """
  SELECT review_id, len(w)::INT AS n_words, greatest(len(w) - 1, 0)::INT AS n_pairs,
    array_to_string(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])), '|') AS terms FROM bag""")

# -- labels and distributions ------------------------------------------------------

add("issue_first_match", "labeled", "SELECT review_id, issue_label FROM labeled")
add("issue_keyword_score", "ruled", """
  SELECT review_id, rule_issue_label AS rule_label, rule_score, keyword_guess_label AS guess_label, guess_score FROM ruled""")
CTES["word_lines"] = """
  SELECT review_id, ' ' || array_to_string(regexp_extract_all(lower(review_text), '[\\p{L}\\p{N}_]+'), ' ') || ' ' AS line FROM sentences """
CTES["word_hits"] = "SELECT *, " + ", ".join(
    f"greatest({', '.join(f'{tag}{i}' for i in range(len(table)))}) AS {score}" for tag, score, table in (
        ("h", "rule_score", rules.ISSUE_KEYWORDS), ("g", "guess_score", rules.GUESS_KEYWORDS))
) + " FROM (SELECT review_id, line, " + ", ".join(
    f"{hits('line', whole(words))} AS {tag}{i}"
    for tag, table in (("h", rules.ISSUE_KEYWORDS), ("g", rules.GUESS_KEYWORDS)) for i, words in enumerate(table.values())
) + " FROM word_lines )"
add("issue_word_score", "word_hits", f"""
  SELECT review_id, CASE {" ".join(f"WHEN {found('line', whole(words))} THEN {lit(x)}" for x, words in rules.FIRST_MATCH_KEYWORDS.items())}
      ELSE 'other' END AS issue_label,
    {best('h', rules.ISSUE_KEYWORDS, 'rule_score')} AS rule_label, rule_score,
    {best('g', rules.GUESS_KEYWORDS, 'guess_score')} AS guess_label, guess_score FROM word_hits""")
add("fill_issue_label", "ruled", """
  SELECT review_id, CASE WHEN review_id % 4 = 1 THEN 'screen' ELSE rule_issue_label END AS issue_label FROM ruled""")
add("annotation_bootstrap", "flagged", "SELECT * FROM flagged")
add("review_queue_summary", "flagged", """
  SELECT needs_review, review_reason, count(*) AS count FROM flagged GROUP BY ALL""")
add("apply_corrections", "flagged", f"""
  SELECT review_id, CASE WHEN review_reason = {lit(rules.REASON_CONFLICT)} THEN keyword_guess_label
    ELSE manual_issue_label END AS manual_issue_label FROM flagged""")


def share(source: str, column: str, count: str = "count", proportion: str = "proportion") -> str:
    return (
        f"SELECT {column}, count(*) AS {count}, round(count(*) / sum(count(*)) OVER (), 6) AS {proportion} "
        f"FROM {source} GROUP BY {column}"
    )


add("sentiment_distribution", "sentences", share("sentences", "sentiment_label"))
add("issue_distribution", "labeled", share("labeled", "issue_label"))
add("negative_issue_distribution", "clean_reviews", share(
    f"(SELECT {first_match('lower(review_text)')} AS issue_label FROM clean_reviews WHERE sentiment_label = 'negative')",
    "issue_label", "negative_count", "negative_proportion"))
add("issue_sentiment_counts", "labeled", "SELECT issue_label, " + ", ".join(
    f"count(*) FILTER (sentiment_label = '{s}') AS {s}" for s in rules.SENTIMENTS) + " FROM labeled GROUP BY issue_label")
add("issue_sentiment_crosstab", "labeled", "SELECT issue_label, " + ", ".join(
    f"round(avg((sentiment_label = '{s}')::INT), 6) AS {s}" for s in rules.SENTIMENTS) + " FROM labeled GROUP BY issue_label")
add("avg_rating_by_sentiment", "sentences", """
  SELECT sentiment_label, round(avg(rating), 6) AS avg_rating FROM sentences GROUP BY sentiment_label""")
_clean_columns = ["review_id", "product_name", "brand", "price", "rating", "review_text", "review_votes", "sentiment_label", "date", "issue_label"]
add("missing_values", "clean_reviews", " UNION ALL ".join(
    f"SELECT count(*) AS row_count, '{c}' AS column_name, count(*) - count({c}) AS missing_count FROM clean_reviews"
    for c in _clean_columns))
add("rating_distribution", "sentences", "SELECT rating, count(*) AS count FROM sentences GROUP BY rating")
add("label_samples", "labeled", """
  SELECT issue_label, row_number() OVER (PARTITION BY issue_label ORDER BY review_id)::INT AS sample_no,
    substr(review_text, 1, 300) || '...' AS sample FROM labeled QUALIFY sample_no <= 3""")

# -- samples and splits --------------------------------------------------------------


def picked(source: str, ident: str, group: str, target: str) -> str:
    """Rows of ``source`` with ``place``: drawing order inside the group."""
    return f"""
      SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY (nth > quota)::INT, {key(ident)}) AS place FROM (
        SELECT *, greatest(1, {target} // (SELECT count(DISTINCT rule_issue_label) FROM {source} i WHERE i.{group} = o.{group})) AS quota,
          row_number() OVER (PARTITION BY {group}, rule_issue_label ORDER BY {key(ident)}) AS nth
        FROM {source} o)"""


CTES["pool"] = "SELECT review_id, sentiment_label, rule_issue_label, 1 AS everything FROM ruled "
add("stratified_sample", "pool", f"""
  SELECT review_id, sentiment_label, rule_issue_label FROM ({picked('pool', 'review_id', 'everything', str(q.STRATIFIED))})
  WHERE place <= {q.STRATIFIED}""")
CTES["clean_hits"] = (
    "SELECT *, greatest(" + ", ".join(f"h{i}" for i in range(10)) + ") AS rule_score FROM (SELECT *, "
    + ", ".join(f"{hits('lower(review_text)', w)} AS h{i}" for i, w in enumerate(rules.ISSUE_KEYWORDS.values()))
    + " FROM clean_reviews )"
)
CTES["clean_ruled"] = f"SELECT *, {best('h', rules.ISSUE_KEYWORDS, 'rule_score')} AS rule_issue_label FROM clean_hits "
_negative, _neutral = int(q.SAMPLE * 0.55), int(q.SAMPLE * 0.25)
_target = f"CASE sentiment_label WHEN 'negative' THEN {_negative} WHEN 'neutral' THEN {_neutral} ELSE {q.SAMPLE - _negative - _neutral} END"
add("annotation_sample", "clean_ruled", f"""
  SELECT row_number() OVER (ORDER BY {key('review_id')}) AS annotation_id, review_id, review_text, rating,
    sentiment_label, rule_issue_label, '' AS manual_issue_label, '' AS annotation_note
  FROM (SELECT *, row_number() OVER (ORDER BY (place > {_target})::INT, {key('review_id')}) AS final
        FROM ({picked('clean_ruled', 'review_id', 'sentiment_label', _target)})) WHERE final <= {q.SAMPLE}""")
add("cap_per_class", "pool", f"""
  SELECT review_id, sentiment_label FROM pool
  QUALIFY row_number() OVER (PARTITION BY sentiment_label ORDER BY {key('review_id')}) <= {q.CAP}""")
add("sample_n", "sentences", f"""
  SELECT review_id, rating, review_text FROM sentences WHERE sentiment_label = 'negative'
  ORDER BY {key('review_id')} LIMIT {q.DRAWN}""")
SPLIT = f"""
  c AS (SELECT rule_issue_label AS label, count(*) AS n FROM pool GROUP BY 1),
  t AS (SELECT sum(n) AS total, sum(n) - ceil(0.2::DOUBLE * sum(n)) AS draws FROM c),
  e1 AS (SELECT label, n, n / total * draws AS exact, draws FROM c, t),
  k1 AS (SELECT label, n, floor(exact) + (row_number() OVER (ORDER BY exact - floor(exact) DESC, label)
          <= draws - sum(floor(exact)) OVER ())::INT AS kept FROM e1),
  t2 AS (SELECT sum(kept) AS total, sum(kept) - ceil(0.15::DOUBLE * sum(kept)) AS draws FROM k1),
  e2 AS (SELECT label, n, kept, kept / total * draws AS exact, draws FROM k1, t2),
  k2 AS (SELECT label, n - kept AS n_test, kept - (floor(exact) + (row_number() OVER (ORDER BY exact - floor(exact) DESC, label)
          <= draws - sum(floor(exact)) OVER ())::INT) AS n_validation FROM e2)
  SELECT review_id, rule_issue_label, CASE WHEN nth <= n_test THEN 'test' WHEN nth <= n_test + n_validation
      THEN 'validation' ELSE 'train' END AS split
  FROM (SELECT *, row_number() OVER (PARTITION BY rule_issue_label ORDER BY {key('review_id')}) AS nth FROM pool) p
  JOIN k2 ON k2.label = p.rule_issue_label"""
CTES["parts"] = f"WITH {SPLIT} "
add("stratified_split", "pool", f", {SPLIT}")
add("class_weights", "pool", """
  SELECT rule_issue_label, count(*) AS class_count, round(sum(count(*)) OVER () / (11 * count(*)), 6) AS class_weight
  FROM pool GROUP BY rule_issue_label""")
add("rare_labels", "sentences", """
  SELECT token, count(*) AS count FROM (SELECT unnest(regexp_extract_all(lower(review_text), '[\\p{L}\\p{N}_]{2,}')) AS token
  FROM sentences) GROUP BY token HAVING count(*) < 2""")

# -- scoring and evaluation --------------------------------------------------------------

add("softmax_scores", "probs", "SELECT review_id, max(label) FILTER (rank = 1) AS label, round(max(p) FILTER (rank = 1), 6) AS confidence, " + ", ".join(
    f"round(max(p) FILTER (label_id = {i}), 6) AS p_{x}" for i, x in enumerate(rules.ISSUES)) + " FROM probs GROUP BY review_id")


def mode(candidates: str, confidence: str, dominant: float) -> str:
    return (
        f"CASE WHEN {candidates} > 1 THEN 'multi-candidate' WHEN {confidence} >= {dominant}::DOUBLE THEN 'single-dominant' "
        "ELSE 'single' END"
    )


add("issue_triage", "probs", f"""
  SELECT review_id, {mode('n_candidates', 'confidence', 0.8)} AS issue_mode, n_candidates, candidates,
    rank_label_1, rank_label_2, rank_label_3, round(confidence, 6) AS rank_confidence_1,
    round(rank_confidence_2, 6) AS rank_confidence_2, round(rank_confidence_3, 6) AS rank_confidence_3
  FROM (SELECT review_id, (count(*) FILTER (rank = 1 OR (rank <= 3 AND p >= 0.1::DOUBLE)))::INT AS n_candidates,
      string_agg(label, ',' ORDER BY rank) FILTER (rank = 1 OR (rank <= 3 AND p >= 0.1::DOUBLE)) AS candidates,
      max(p) FILTER (rank = 1) AS confidence, max(label) FILTER (rank = 1) AS rank_label_1,
      max(label) FILTER (rank = 2) AS rank_label_2, max(label) FILTER (rank = 3) AS rank_label_3,
      max(p) FILTER (rank = 2) AS rank_confidence_2, max(p) FILTER (rank = 3) AS rank_confidence_3
    FROM probs GROUP BY review_id)""")
CTES["gap_feelings"] = "SELECT f.* FROM feelings f WHERE f.review_id % 9 > 1"
add("score_feedback_rejects", "sentences", """
  SELECT review_id, 'blank review text' AS reason FROM sentences WHERE review_id % 9 <= 1""")
CTES["feelings"] = """
  SELECT review_id, label_id, label, exp(s) / sum(exp(s)) OVER (PARTITION BY review_id) AS p,
    row_number() OVER (PARTITION BY review_id ORDER BY s DESC, label_id) AS rank
  FROM (SELECT review_id, unnest([0, 1, 2]) AS label_id, unnest(['negative', 'neutral', 'positive']) AS label,
    unnest([3 - r, 1 - abs(r - 3), r - 3]) AS s FROM (SELECT review_id, coalesce(rating, 5) AS r FROM sentences ))"""
add("score_feedback", "probs gap_feelings", f"""
  SELECT i.review_id, f.sentiment_label, f.sentiment_confidence, i.primary_issue_label,
    round(i.p, 6) AS primary_issue_confidence, {mode('i.n', 'i.p', 0.6)} AS issue_mode, i.candidates, i.ranking,
    f.sentiment_ranking, i.p_other, f.p_neutral
  FROM (SELECT review_id, max(label) FILTER (rank = 1) AS primary_issue_label, max(p) FILTER (rank = 1) AS p,
      count(*) FILTER (rank = 1 OR (rank <= 5 AND p >= 0.05::DOUBLE)) AS n,
      string_agg(label, ',' ORDER BY rank) FILTER (rank = 1 OR (rank <= 5 AND p >= 0.05::DOUBLE)) AS candidates,
      string_agg(label, ',' ORDER BY rank) FILTER (rank <= 5) AS ranking,
      round(max(p) FILTER (label = 'other'), 6) AS p_other FROM probs GROUP BY review_id) i
  JOIN (SELECT review_id, max(label) FILTER (rank = 1) AS sentiment_label,
      round(max(p) FILTER (rank = 1), 6) AS sentiment_confidence, string_agg(label, ',' ORDER BY rank) AS sentiment_ranking,
      round(max(p) FILTER (label = 'neutral'), 6) AS p_neutral FROM gap_feelings GROUP BY review_id) f
    ON f.review_id = i.review_id""")
add("topk_predictions", "best", """
  SELECT review_id, top_1_label, round(top_1_prob, 6) AS top_1_prob, top_2_label, round(top_2_prob, 6) AS top_2_prob,
    top_3_label, round(top_3_prob, 6) AS top_3_prob FROM best""")
add("prediction_table", "best", """
  SELECT review_id, review_text, true_label, pred_label, true_label = pred_label AS correct,
    round(confidence, 6) AS confidence FROM best""")
add("confusion_matrix", "best", "SELECT l.label_id::INT AS label_id, 'true_' || l.label AS label, " + ", ".join(
    f"count(*) FILTER (b.pred_label = '{x}') AS pred_{x}" for x in rules.ISSUES)
    + f" FROM {label_rows(rules.ISSUES)} LEFT JOIN best b ON b.true_label = l.label GROUP BY ALL")
CTES["report"] = """
  SELECT label_id::INT AS label_id, label, precision, recall, f1_score, support FROM class_scores
  UNION ALL SELECT 11, 'macro avg', avg(precision), avg(recall), avg(f1_score), sum(support)::BIGINT FROM class_scores
  UNION ALL SELECT 12, 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
    sum(f1_score * support) / sum(support), sum(support)::BIGINT FROM class_scores """
add("classification_report", "report", """
  SELECT label_id, label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1_score, 6) AS f1_score,
    support FROM report""")
add("classifier_metrics", "class_scores", """
  SELECT round(sum(hit) / sum(support), 6) AS accuracy,
    round(avg(f1_score) FILTER (support > 0 OR predicted > 0), 6) AS macro_f1,
    round(sum(f1_score * support) / sum(support), 6) AS weighted_f1, sum(support)::BIGINT AS rows FROM class_scores""")
_numbers = " || ".join(f"lpad(printf('%.4f', {c}), 10, ' ')" for c in ("precision", "recall", "f1_score"))
_line = f"lpad(label, 12, ' ') || ' ' || {_numbers} || lpad(support::VARCHAR, 10, ' ')"
_head = " " * 13 + "".join(n.rjust(10) for n in ("precision", "recall", "f1-score", "support"))
add("classification_report_lines", "report class_scores", f"""
  SELECT 1 AS section, 0 AS item, 0 AS line_no, '{_head}' AS line UNION ALL SELECT 1, 0, 1, ''
  UNION ALL SELECT 2, label_id, 0, {_line} FROM report WHERE label_id < 11
  UNION ALL SELECT 3, 0, 0, '' UNION ALL
  SELECT 3, 0, 1, lpad('accuracy', 12, ' ') || repeat(' ', 21) || lpad(printf('%.4f', sum(hit) / sum(support)), 10, ' ')
    || lpad(sum(support)::BIGINT::VARCHAR, 10, ' ') FROM class_scores
  UNION ALL SELECT 4, label_id, 0, {_line} FROM report WHERE label_id >= 11""")
_order = f"CASE WHEN true_label IN ({strings(rules.PRIORITY_TRUE_LABELS)}) THEN 1 ELSE 2 END, true_label, round(confidence, 10) DESC, review_id"
add("error_review_queue", "best", f"""
  SELECT row_number() OVER (ORDER BY {_order})::INT AS review_id_for_error_analysis, review_text, true_label, pred_label,
    round(confidence, 6) AS confidence, top_1_label, round(top_1_prob, 6) AS top_1_prob, top_2_label,
    round(top_2_prob, 6) AS top_2_prob, top_3_label, round(top_3_prob, 6) AS top_3_prob,
    true_label AS corrected_label, '' AS review_decision, '' AS review_note
  FROM best WHERE true_label <> pred_label ORDER BY {_order} LIMIT 150""")
add("error_counts", "best", f"""
  SELECT l.label, count(b.review_id) AS error_count FROM {label_rows(rules.PRIORITY_TRUE_LABELS)}
  LEFT JOIN best b ON b.true_label = l.label AND b.true_label <> b.pred_label GROUP BY l.label""")

# -- clusters ----------------------------------------------------------------------------

add("l2_normalize", "vecs", """
  SELECT vec_id, dim::INT AS dim, round(x / sqrt(sum(x * x) OVER (PARTITION BY vec_id)), 5) AS value FROM vecs""")
add("cluster_centers", "centers", "SELECT cluster_id, dim::INT AS dim, round(value, 6) AS value FROM centers")
add("distance_to_center", "distances", """
  SELECT cluster_id, vec_id, round(distance_to_cluster_center, 6) AS distance_to_cluster_center FROM distances""")
add("nearest_center", "vecs centers", """
  SELECT vec_id, cluster_id, round(d, 6) AS distance_to_cluster_center FROM (
    SELECT v.vec_id, c.cluster_id, sqrt(sum((v.x - c.value) * (v.x - c.value))) AS d
    FROM vecs v JOIN centers c ON c.dim = v.dim GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, cluster_id) = 1""")
CTES["assigned_distance"] = """
  SELECT vec_id, cluster_id, d FROM (
    SELECT v.vec_id, c.cluster_id, sqrt(sum((v.x - c.value) * (v.x - c.value))) AS d
    FROM vecs v JOIN centers c ON c.dim = v.dim GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, cluster_id) = 1"""
add("nearest_center_blocks", "assigned_distance", """
  SELECT vec_id, cluster_id, round(d, 6) AS distance_to_cluster_center FROM assigned_distance""")
add("silhouette", "sil", "SELECT round(silhouette, 6) AS silhouette FROM sil")
add("cluster_keywords", "keywords", "SELECT * FROM keywords")
add("issue_keywords", "x_terms", """
  SELECT g AS issue_label, rank::INT AS rank, term, tf, df, round(score, 6) AS score FROM x_terms WHERE rank <= 12""")
add("cluster_profile", "profile", """
  SELECT * REPLACE (round(avg_issue_confidence, 6) AS avg_issue_confidence, round(negative_ratio, 6) AS negative_ratio) FROM profile""")
add("representative_reviews", "representatives", "SELECT * FROM representatives")
add("cluster_summary", "summary", """
  SELECT * REPLACE (round(avg_issue_confidence, 6) AS avg_issue_confidence, round(negative_ratio, 6) AS negative_ratio) FROM summary""")

add("kmeans_agreement", "", "SELECT count(*) AS n_rows, count(*) AS n_agree FROM embeddings")
CTES["assigned"] = """
  SELECT vec_id, cluster_id FROM (
    SELECT v.vec_id, c.cluster_id, sqrt(sum((v.x - c.value) * (v.x - c.value))) AS d
    FROM vecs v JOIN centers c ON c.dim = v.dim GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, cluster_id) = 1"""
add("lloyd_step", "assigned vecs", """
  SELECT a.cluster_id, v.dim::INT AS dim, round(avg(v.x), 6) AS value FROM assigned a JOIN vecs v ON v.vec_id = a.vec_id GROUP BY ALL""")
CTES["moved_0"] = "SELECT cluster_id, dim, value, 0 AS n FROM centers "
for step in (1, 2, 3):
    CTES[f"drawn_{step}"] = f"SELECT * FROM vecs WHERE md5('42:{step}:' || vec_id) < '8'"
    CTES[f"joined_{step}"] = f"""
      SELECT vec_id, cluster_id FROM (
        SELECT v.vec_id, c.cluster_id, sqrt(sum((v.x - c.value) * (v.x - c.value))) AS d
        FROM drawn_{step} v JOIN moved_{step - 1} c ON c.dim = v.dim GROUP BY ALL)
      QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, cluster_id) = 1"""
    CTES[f"moved_{step}"] = f"""
      SELECT c.cluster_id, c.dim, c.value + coalesce((m.mean - c.value) * m.b / (c.n + m.b), 0) AS value, c.n + coalesce(m.b, 0) AS n
      FROM moved_{step - 1} c LEFT JOIN (
        SELECT j.cluster_id, v.dim, avg(v.x) AS mean, count(*) AS b FROM joined_{step} j JOIN drawn_{step} v ON v.vec_id = j.vec_id GROUP BY ALL) m
      ON m.cluster_id = c.cluster_id AND m.dim = c.dim"""
add("minibatch_steps", "moved_3", "SELECT cluster_id, n, dim::INT AS dim, round(value, 6) AS value FROM moved_3")
add("embed_norms", "bag", "SELECT review_id, 512 AS n_dims, CASE WHEN len(w) > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS norm FROM bag")
CTES["bag_terms"] = """
  SELECT review_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM bag """
CTES["idfs"] = """
  SELECT term, count(*) AS tf, count(DISTINCT review_id) AS df,
    ln((1 + (SELECT count(*) FROM bag )) / (1 + count(DISTINCT review_id))) + 1 AS idf
  FROM bag_terms GROUP BY term
  HAVING count(DISTINCT review_id) >= 3 AND count(DISTINCT review_id) <= 0.9 * (SELECT count(*) FROM bag )
  ORDER BY tf DESC, term LIMIT 50000"""
add("tfidf_vocabulary", "idfs", "SELECT term, tf, df, round(idf, 6) AS idf FROM idfs")
add("tfidf_vectors", "bag_terms idfs", """
  SELECT review_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY review_id)), 6) AS weight
  FROM (SELECT t.review_id, t.term, count(*) * any_value(i.idf) AS w FROM bag_terms t JOIN idfs i ON i.term = t.term GROUP BY ALL)""")

CTES["lsa_weights"] = """
  SELECT review_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY review_id)) AS weight
  FROM (SELECT t.review_id, t.term, count(*) * any_value(i.idf) AS w FROM bag_terms t JOIN idfs i ON i.term = t.term GROUP BY ALL)"""
CTES["lsa_moved_0"] = """
  SELECT term, CASE WHEN md5('42:0:' || term) < '8' THEN 1.0::DOUBLE ELSE -1.0 END AS a,
    CASE WHEN md5('42:1:' || term) < '8' THEN 1.0::DOUBLE ELSE -1.0 END AS b FROM (SELECT DISTINCT term FROM lsa_weights )"""
for step in (1, 2):
    CTES[f"lsa_upright_{step}"] = f"""
      SELECT term, a / na AS a, (b - p * a) / sqrt(sum((b - p * a) * (b - p * a)) OVER ()) AS b
      FROM (SELECT term, a, b, sqrt(sum(a * a) OVER ()) AS na, sum(a * b) OVER () / sum(a * a) OVER () AS p FROM lsa_moved_{step - 1} )"""
    CTES[f"lsa_along_{step}"] = f"""
      SELECT w.review_id, sum(w.weight * u.a) AS a, sum(w.weight * u.b) AS b
      FROM lsa_weights w JOIN lsa_upright_{step} u ON u.term = w.term GROUP BY ALL"""
    CTES[f"lsa_moved_{step}"] = f"""
      SELECT w.term, sum(w.weight * y.a) AS a, sum(w.weight * y.b) AS b
      FROM lsa_weights w JOIN lsa_along_{step} y ON y.review_id = w.review_id GROUP BY ALL"""
add("lsa_strength", "lsa_along_2 lsa_weights", """
  SELECT place, round(sqrt(v), 6) AS singular_value, round(v / total, 6) AS share,
    (SELECT count(DISTINCT term) FROM lsa_weights) AS n_terms, round(1 - (aa + bb) / total, 6) AS residual
  FROM (SELECT *, unnest([1, 2])::INT AS place,
      unnest([(aa + bb) / 2 + sqrt((aa - bb) * (aa - bb) / 4 + ab * ab), (aa + bb) / 2 - sqrt((aa - bb) * (aa - bb) / 4 + ab * ab)]) AS v
    FROM (SELECT sum(a * a) AS aa, sum(b * b) AS bb, sum(a * b) AS ab, (SELECT sum(weight * weight) FROM lsa_weights) AS total FROM lsa_along_2 ))""")
add("lsa_lengths", "lsa_along_2", """
  SELECT review_id, round(sqrt(a * a + b * b), 5) AS length, round(greatest(0, 1 - (a * a + b * b)), 5) AS residual FROM lsa_along_2""")


def term_model(tag: str, docs: str, label: str, labels, train: str, judged: str, smoothing) -> None:
    """Naive Bayes weights from the rows of ``docs`` that are ``train``, scores of those that are ``judged``."""
    n_labels = len(labels)
    CTES[f"{tag}_idfs"] = f"""
      SELECT term, count(DISTINCT t.review_id) AS df, count(*) AS tf,
        ln((1 + (SELECT count(*) FROM {docs} WHERE {train})) / (1 + count(DISTINCT t.review_id))) + 1 AS idf
      FROM bag_terms t JOIN {docs} d ON d.review_id = t.review_id WHERE {train} GROUP BY term
      HAVING count(DISTINCT t.review_id) >= 3 AND count(DISTINCT t.review_id) <= 0.9 * (SELECT count(*) FROM {docs} WHERE {train})
      ORDER BY tf DESC, term LIMIT 50000"""
    CTES[f"{tag}_counts"] = f"""
      SELECT {label} AS label, t.term, count(*) AS n FROM bag_terms t JOIN {docs} d ON d.review_id = t.review_id
      JOIN {tag}_idfs i ON i.term = t.term WHERE {train} GROUP BY ALL"""
    CTES[f"{tag}_vectors"] = f"""
      SELECT review_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY review_id)) AS weight
      FROM (SELECT t.review_id, t.term, count(*) * any_value(i.idf) AS w FROM bag_terms t JOIN {tag}_idfs i ON i.term = t.term GROUP BY ALL)"""
    CTES[f"{tag}_classes"] = f"""
      SELECT l.label_id, l.label, ln(((SELECT count(*) FROM {docs} WHERE {train} AND {label} = l.label) + 1)
          / ((SELECT count(*) FROM {docs} WHERE {train}) + {n_labels})) AS base,
        coalesce((SELECT sum(n) FROM {tag}_counts c WHERE c.label = l.label), 0)::DOUBLE AS total,
        (SELECT count(*) FROM {tag}_idfs )::DOUBLE AS terms FROM {label_rows(labels)}"""
    CTES[f"{tag}_weights"] = f"""
      SELECT s.smoothing, i.term, c.label_id, ln((coalesce(n.n, 0) + s.smoothing) / (c.total + s.smoothing * c.terms)) AS w
      FROM {tag}_idfs i, {tag}_classes c, (SELECT unnest({list(smoothing)}::DOUBLE[]) AS smoothing) s
      LEFT JOIN {tag}_counts n ON n.term = i.term AND n.label = c.label"""
    CTES[f"{tag}_sums"] = f"""
      SELECT v.review_id, w.smoothing, w.label_id, sum(v.weight * w.w) AS z FROM {tag}_vectors v JOIN {tag}_weights w ON w.term = v.term GROUP BY ALL"""
    CTES[f"{tag}_logits"] = f"""
      SELECT d.review_id, s.smoothing, c.label_id, c.label, c.base + coalesce(z.z, 0) AS z, {label} AS true_label
      FROM {docs} d, {tag}_classes c, (SELECT unnest({list(smoothing)}::DOUBLE[]) AS smoothing) s
      LEFT JOIN {tag}_sums z ON z.review_id = d.review_id AND z.smoothing = s.smoothing AND z.label_id = c.label_id WHERE {judged}"""
    CTES[f"{tag}_ranked"] = f"""
      SELECT *, exp(z - max(z) OVER w) / sum(exp(z)) OVER w * exp(max(z) OVER w) AS p, row_number() OVER (w ORDER BY z DESC, label_id) AS rank
      FROM {tag}_logits WINDOW w AS (PARTITION BY review_id, smoothing)"""


term_model("ti", "labeled", "issue_label", rules.ISSUES, "true", "true", [1.0])
term_model("ts", "sentences", "sentiment_label", rules.SENTIMENTS, "true", "true", [1.0])
term_model("tp", "parts", "rule_issue_label", rules.ISSUES, "split = 'train'", "split = 'validation'", q.SMOOTHING)
add("score_issues_table", "ti_ranked", """
  SELECT review_id, label AS predicted_issue_label, round(p, 6) AS predicted_issue_confidence FROM ti_ranked WHERE rank = 1""")
add("score_sentiment_table", "ts_ranked", """
  SELECT review_id, max(label) FILTER (rank = 1) AS sentiment_label, round(max(p), 6) AS sentiment_confidence,
    string_agg(label, ',' ORDER BY rank) AS ranking FROM ts_ranked GROUP BY review_id""")
add("issue_smoothing_path", "tp_ranked", """
  , best AS (SELECT smoothing, true_label, label AS pred_label FROM tp_ranked WHERE rank = 1),
  sides AS (
    SELECT smoothing, true_label AS label, 1 AS support, 0 AS drawn, (true_label = pred_label)::INT AS hit FROM best
    UNION ALL SELECT smoothing, pred_label, 0, 1, 0 FROM best),
  f AS (SELECT smoothing, label, sum(support) AS support, sum(hit) AS hit, 2 * sum(hit) / (sum(support) + sum(drawn)) AS f1 FROM sides GROUP BY ALL),
  m AS (SELECT smoothing, sum(hit) / sum(support) AS accuracy, avg(f1) AS macro_f1, sum(support)::BIGINT AS rows FROM f GROUP BY smoothing)
  SELECT smoothing, round(accuracy, 6) AS accuracy, round(macro_f1, 6) AS macro_f1, rows,
    row_number() OVER (ORDER BY macro_f1 DESC, smoothing DESC) = 1 AS chosen FROM m""")
add("streamed_feedback", "reviews", f"""
  , c AS (SELECT ordinal, rating, {clean('review_text')} AS t FROM reviews)
  SELECT ordinal, CASE WHEN coalesce(t, '') = '' THEN 'blank review text' END AS reason,
    CASE WHEN coalesce(t, '') <> '' THEN {first_match('lower(t)')} END AS issue_label,
    CASE WHEN coalesce(t, '') <> '' THEN {sentiment('rating')} END AS rating_label, 1::BIGINT AS times FROM c""")
add("split_csv", "", """
  SELECT doc_id, source, length(coalesce(text, ''))::INT AS n_chars, md5(coalesce(text, '')) AS digest, 1::BIGINT AS same_ordinal FROM documents""")
add("sentiment_test_rows", "clean_reviews", """
  , c AS (SELECT sentiment_label, count(*) AS n FROM clean_reviews GROUP BY 1),
  t AS (SELECT sum(n) AS total, sum(n) - ceil(0.2::DOUBLE * sum(n)) AS draws FROM c),
  e AS (SELECT sentiment_label, n, n / total * draws AS exact, draws FROM c, t)
  SELECT sentiment_label, (n - floor(exact) - (row_number() OVER (ORDER BY exact - floor(exact) DESC, sentiment_label)
      <= draws - sum(floor(exact)) OVER ())::INT)::BIGINT AS n_rows FROM e""")

# -- themes, priority, reports -------------------------------------------------------------

add("cluster_themes", "themed", "SELECT cluster_id, cluster_theme, theme_confidence_score, major_issue FROM themed")
add("theme_distribution", "themed", "SELECT cluster_theme, count(*) AS count FROM themed GROUP BY cluster_theme")


def action(theme: str, issue: str, words: str) -> str:
    combined = f"(lower({theme}) || ' ' || lower(coalesce({issue}, 'nan')) || ' ' || lower({words}))"
    whens = [f"WHEN {found(f'lower({theme})', w)} THEN {lit(a)}" for w, a in rules.THEME_ACTIONS]
    whens += [f"WHEN {found(combined, w)} THEN {lit(a)}" for w, a in rules.FALLBACK_ACTIONS]
    return f"CASE {' '.join(whens)} ELSE {lit(rules.DEFAULT_ACTION)} END"


_known = f"[cluster_theme, {strings(_themes)}, {lit(rules.DEFAULT_THEME)}]"
add("recommended_actions", "themed", f"""
  SELECT cluster_id, theme_no, theme, {action('theme', 'major_issue', 'top_keywords')} AS action FROM (
    SELECT cluster_id, major_issue, top_keywords, unnest({_known}) AS theme,
      unnest(range({len(rules.THEME_RULES) + 2}))::INT AS theme_no FROM themed)""")
add("minmax_normalize", "sentences", """
  SELECT review_id, round((coalesce(price, 0) - min(coalesce(price, 0)) OVER ())
    / (max(coalesce(price, 0)) OVER () - min(coalesce(price, 0)) OVER ()), 6) AS price_score FROM sentences""")
_scores = ["priority_score", "issue_concentration", "avg_issue_confidence", "negative_ratio", "cluster_size_score",
           "issue_concentration_score", "confidence_score", "negative_ratio_score", "growth_proxy_score"]
_rounds = ", ".join(f"round({c}, 6) AS {c}" for c in _scores)
add("priority_scores", "ranked", f"""
  SELECT priority_rank::INT AS priority_rank, cluster_id, cluster_theme, cluster_size, major_issue, major_issue_count,
    top_keywords, {', '.join(_reviews)}, {_rounds} FROM ranked""")
add("priority_scores_minimal", "minimal", f"""
  SELECT priority_rank::INT AS priority_rank, cluster_id, cluster_theme, cluster_size::BIGINT AS cluster_size, major_issue,
    major_issue_count::BIGINT AS major_issue_count, top_keywords, {_rounds} FROM ({priority_cte('minimal')})""")
_list = "list_filter([" + ", ".join(strip(c) for c in _reviews) + "], lambda x: x <> '')"
add("cluster_listing", "themed", f"""
  SELECT cluster_id, cluster_theme, cluster_size, major_issue, top_keywords,
    array_to_string({_list}, ' || ') AS representative_reviews FROM themed ORDER BY cluster_size DESC, cluster_id LIMIT 5""")
add("priority_listing", "ranked", f"""
  SELECT priority_rank::INT AS priority_rank, cluster_id, cluster_theme, priority_score, cluster_size, major_issue,
    top_keywords, array_to_string({_list}, ' || ') AS representative_reviews FROM ranked ORDER BY priority_rank LIMIT 4""")


def lines(section: int, item: str, source: str, parts: list[str]) -> str:
    """One SELECT per report line; a null line is dropped."""
    return " UNION ALL ".join(
        f"SELECT {section} AS section, {item}::INT AS item, {n} AS line_no, {p} AS line FROM {source} WHERE ({p}) IS NOT NULL"
        for n, p in enumerate(parts)
    )


def review_lines() -> list[str]:
    return [f"CASE WHEN {clip(c, 700)} <> '' THEN '{i}. ' || {clip(c, 700)} END" for i, c in enumerate(_reviews, 1)]


CTES["totals"] = "SELECT sum(cluster_size)::BIGINT AS n_reviews, count(*) AS n_clusters FROM themed "
CTES["big"] = "SELECT *, row_number() OVER (ORDER BY cluster_size DESC, cluster_id) AS no FROM themed QUALIFY no <= 7"
CTES["theme_rows"] = """
  SELECT cluster_theme, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, cluster_theme) AS no FROM themed
  GROUP BY cluster_theme"""
add("clustering_report_lines", "totals big theme_rows sil", " UNION ALL ".join([
    lines(1, "0", "totals, sil", [
        "'# Review Clustering and Topic Discovery Report'", "''", "'## 1. Overview'", "''",
        "'Themes that recur in customer reviews, found by KMeans on L2-normalized term vectors.'",
        "''", "'- Total clustered reviews: **' || n_reviews || '**'", "'- Number of clusters: **' || n_clusters || '**'",
        "'- Input reviews: customer reviews'", "'- Embedding method: L2-normalized term vectors'",
        "'- Clustering method: KMeans'", "''", "'- Global silhouette score: **' || printf('%.4f', silhouette) || '**'", "''"]),
    lines(2, "0", "totals", ["'## 2. Cluster Theme Distribution'", "''", "'| Cluster Theme | Number of Clusters |'", "'|---|---:|'"]),
    lines(2, "no", "theme_rows", ["'| ' || cluster_theme || ' | ' || n || ' |'"]),
    lines(3, "0", "totals", ["''", "'## 3. Top Clusters by Size'", "''", "'| Cluster ID | Theme | Size | Major Issue | Keywords |'", "'|---:|---|---:|---|---|'"]),
    lines(3, "no", "big", [f"'| ' || cluster_id || ' | ' || {clip('cluster_theme', 120)} || ' | ' || cluster_size || ' | ' || "
                           f"{clip('major_issue', 80)} || ' | ' || {clip('top_keywords', 200)} || ' |'"]),
    lines(4, "0", "totals", ["''", "'## 4. Detailed Cluster Summaries'", "''"]),
    lines(4, "no", "big", [
        f"'### Cluster ' || cluster_id || ': ' || {clip('cluster_theme', 200)}", "''",
        "'- Cluster size: **' || cluster_size || '**'", f"'- Major issue label: **' || {clip('major_issue', 100)} || '**'",
        f"'- Top keywords: ' || {clip('top_keywords', 300)}", "'- Major issue count: **' || major_issue_count || '**'",
        "'- Average issue confidence: **' || printf('%.4f', avg_issue_confidence) || '**'",
        "'- Negative ratio: **' || printf('%.2f', negative_ratio) || '**'", "''", "'Representative reviews:'", "''",
        *review_lines(), "''"]),
    lines(5, "0", "totals", [
        "'## 5. Interpretation'", "''",
        "'Themes found, those of most clusters first: ' || (SELECT string_agg(cluster_theme, ', ' ORDER BY no) FROM theme_rows) || '.'",
        "''", lit(reports.INTERPRETATION), "''"]),
]))
CTES["urgent"] = "SELECT * FROM ranked WHERE priority_rank <= 6"
add("insight_report_lines", "totals urgent", " UNION ALL ".join([
    lines(1, "0", "totals", [
        "'# Product Manager Insight Report'", "''", "'## 1. Executive Summary'", "''", "'Complaint themes of customer reviews, the most urgent first. Issues come from keyword scores, clusters from KMeans on L2-normalized term vectors.'", "''",
        "'- Total clustered reviews: **' || n_reviews || '**'", "'- Number of complaint clusters: **' || n_clusters || '**'",
        "'- Top priority themes included in this report: **' || least(n_clusters, 6) || '**'", "''", lit(reports.SCORE_METHOD), "''"]),
    lines(2, "0", "totals", ["'## 2. Top Priority Complaint Themes'", "''", "'| Rank | Theme | Score | Size | Major Issue | Keywords |'", "'|---:|---|---:|---:|---|---|'"]),
    lines(2, "priority_rank", "urgent", [
        f"'| ' || priority_rank || ' | ' || {clip('cluster_theme', 120)} || ' | ' || printf('%.2f', priority_score) || ' | ' || "
        f"cluster_size::BIGINT || ' | ' || {clip('major_issue', 80)} || ' | ' || {clip('top_keywords', 180)} || ' |'"]),
    lines(3, "0", "totals", ["''", "'## 3. Detailed Priority Analysis'", "''"]),
    lines(3, "priority_rank", "urgent", [
        f"'### Priority ' || priority_rank || ': ' || {clip('cluster_theme', 200)}", "''", "'- Cluster ID: **' || cluster_id || '**'",
        "'- Priority score: **' || printf('%.2f', priority_score) || '**'", "'- Cluster size: **' || cluster_size::BIGINT || '**'",
        f"'- Major issue label: **' || {clip('major_issue', 100)} || '**'", f"'- Keywords: ' || {clip('top_keywords', 250)}",
        "'- Issue concentration: **' || printf('%.2f', issue_concentration) || '**'",
        "'- Average issue confidence: **' || printf('%.2f', avg_issue_confidence) || '**'",
        "'- Negative ratio: **' || printf('%.2f', negative_ratio) || '**'", "''", "'Representative customer evidence:'", "''",
        *review_lines(), "''", "'Recommended product action:'", "''",
        action(clip("cluster_theme", 200), clip("major_issue", 100), clip("top_keywords", 250)), "''"]),
    lines(4, "0", "totals", [
        "'## 4. Product Implications'", "''",
        "'Themes to act on first: ' || (SELECT string_agg(cluster_theme, ', ' ORDER BY no) FROM (SELECT cluster_theme, min(priority_rank) AS no FROM urgent GROUP BY 1)) || '.'",
        "''", "'## 5. Limitations and Future Work'", "''", *[lit(x) for x in reports.LIMITS], "''"]),
]))
