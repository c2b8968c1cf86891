"""Markdown reports as tables of lines.

A line has the key (section, item, line_no); writers sort by it.  The tables hold
clusters, never reviews, and at most ``top_n`` of them reach the detail sections.
Fixed values: headings, table heads and the labels that begin the lines.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from plaintide.functions.text import clip, fixed
from plaintide.operators.ids import small_rank
from plaintide.operators.themes import recommended_action, theme_distribution
from plaintide.schema import require_columns

KEY = ["section", "item", "line_no"]

CLUSTERING, EMBEDDING, ISSUES = "KMeans", "L2-normalized term vectors", "keyword scores"
INTERPRETATION = (
    "Clusters are found without labels. The issue of a cluster is the label that most of its reviews were given, "
    "and its theme follows from keywords, issue and representative reviews."
)
SCORE_METHOD = (
    "The score weighs the size of a cluster, the share of its main issue, the confidence of the issue labels and the "
    "share of negative reviews. Reviews carry no dates, so growth counts as neutral."
)
LIMITS = [
    "- Each review is given one issue; lower ranks are candidates, not further labels.",
    "- One review can complain of several things, so a cluster can mix themes.",
    "- Without dates no trend can be measured.",
]


def scope(sentiment: str) -> str:
    """The reviews a report is about."""
    return "customer reviews" if sentiment.lower() == "all" else f"{sentiment} customer reviews"


def _theme_line(df: DataFrame, before: str, *order: Column) -> DataFrame:
    """One row with the distinct themes of a small table, in ``order`` and then by name."""
    ranked = df.groupBy("cluster_theme").agg(*[o.alias(f"_o{i}") for i, o in enumerate(order)])
    keys = F.sort_array(F.collect_list(F.struct(*[f"_o{i}" for i in range(len(order))], "cluster_theme")))
    return ranked.agg(F.concat(F.lit(before), F.array_join(F.transform(keys, lambda x: x["cluster_theme"]), ", "), F.lit(".")).alias("_themes"))


def _lines(df: DataFrame, section: int, item: Column, lines: Sequence[Column | str | None]) -> DataFrame:
    """Each row of ``df`` gives the listed lines; a null line is left out."""
    texts = F.array(*[F.lit(x) if isinstance(x, str) else x for x in lines])
    return (
        df.select(F.lit(section).alias("section"), item.cast("int").alias("item"), F.posexplode(texts))
        .filter(F.col("col").isNotNull())
        .select("section", "item", F.col("pos").alias("line_no"), F.col("col").alias("line"))
    )


def _joined(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _whole(c: str) -> Column:
    return F.col(c).cast("bigint")


def _optional(df: DataFrame, column: str, before: str, value: Column, after: str = "**") -> Column:
    """A line for a column that may be absent."""
    if column not in df.columns:
        return F.lit(None).cast("string")
    return _joined(before, value, after)


def _reviews(df: DataFrame) -> list[Column]:
    result = []
    for i in (1, 2, 3):
        name = f"representative_review_{i}"
        if name in df.columns:
            review = clip(F.col(name), 700)
            result.append(F.when(review != "", _joined(f"{i}. ", review)))
    return result


def clustering_report(
    df: DataFrame,
    top_n: int = 20,
    embedding_method: str = EMBEDDING,
    clustering_method: str = CLUSTERING,
    sentiment: str = "negative",
) -> DataFrame:
    """Report on labelled clusters, the largest first."""
    require_columns(df, ["cluster_id", "cluster_theme", "cluster_size", "top_keywords", "major_issue"])
    silhouette = F.lit(None).cast("double")
    if "silhouette_score_global" in df.columns:
        silhouette = F.max("silhouette_score_global")
    totals = df.agg(
        F.sum(_whole("cluster_size")).alias("_reviews"),
        F.count(F.lit(1)).alias("_clusters"),
        silhouette.alias("_silhouette"),
    )
    scored = F.col("_silhouette").isNotNull()
    overview = _lines(
        totals,
        1,
        F.lit(0),
        [
            "# Review Clustering and Topic Discovery Report",
            "",
            "## 1. Overview",
            "",
            f"Themes that recur in {scope(sentiment)}, found by {clustering_method} on {embedding_method}.",
            "",
            _joined("- Total clustered reviews: **", F.col("_reviews"), "**"),
            _joined("- Number of clusters: **", F.col("_clusters"), "**"),
            f"- Input reviews: {scope(sentiment)}",
            f"- Embedding method: {embedding_method}",
            f"- Clustering method: {clustering_method}",
            "",
            F.when(scored, _joined("- Global silhouette score: **", fixed(F.col("_silhouette"), 4), "**")),
            F.when(scored, F.lit("")),
        ],
    )
    themes = small_rank(theme_distribution(df), "_no", F.desc("count"), "cluster_theme")
    found = _theme_line(df, "Themes found, those of most clusters first: ", -F.count(F.lit(1)))
    ranked = df.orderBy(F.desc(_whole("cluster_size")), "cluster_id").limit(top_n)
    top = small_rank(ranked, "_no", F.desc(_whole("cluster_size")), "cluster_id")
    detail = [
        _joined("### Cluster ", F.col("cluster_id"), ": ", clip(F.col("cluster_theme"), 200)),
        "",
        _joined("- Cluster size: **", _whole("cluster_size"), "**"),
        _joined("- Major issue label: **", clip(F.col("major_issue"), 100), "**"),
        _joined("- Top keywords: ", clip(F.col("top_keywords"), 300)),
        _optional(df, "major_issue_count", "- Major issue count: **", _whole("major_issue_count")),
        _optional(df, "avg_issue_confidence", "- Average issue confidence: **", fixed(F.col("avg_issue_confidence"), 4)),
        _optional(df, "negative_ratio", "- Negative ratio: **", fixed(F.col("negative_ratio"), 2)),
        "",
        "Representative reviews:",
        "",
        *_reviews(df),
        "",
    ]
    parts = [
        overview,
        _lines(
            totals, 2, F.lit(0),
            ["## 2. Cluster Theme Distribution", "", "| Cluster Theme | Number of Clusters |", "|---|---:|"],
        ),
        _lines(themes, 2, F.col("_no"), [_joined("| ", F.col("cluster_theme"), " | ", F.col("count"), " |")]),
        _lines(
            totals, 3, F.lit(0),
            ["", "## 3. Top Clusters by Size", "", "| Cluster ID | Theme | Size | Major Issue | Keywords |", "|---:|---|---:|---|---|"],
        ),
        _lines(
            top, 3, F.col("_no"),
            [
                _joined(
                    "| ", F.col("cluster_id"), " | ", clip(F.col("cluster_theme"), 120), " | ",
                    _whole("cluster_size"), " | ", clip(F.col("major_issue"), 80), " | ",
                    clip(F.col("top_keywords"), 200), " |",
                )
            ],
        ),
        _lines(totals, 4, F.lit(0), ["", "## 4. Detailed Cluster Summaries", ""]),
        _lines(top, 4, F.col("_no"), detail),
        _lines(found, 5, F.lit(0), ["## 5. Interpretation", "", F.col("_themes"), "", INTERPRETATION, ""]),
    ]
    return _union(parts)


def insight_report(
    df: DataFrame,
    top_n: int = 10,
    sentiment: str = "negative",
    issue_method: str = ISSUES,
    cluster_method: str = f"{CLUSTERING} on {EMBEDDING}",
) -> DataFrame:
    """Report on ranked clusters, the most urgent first."""
    require_columns(
        df,
        ["priority_rank", "cluster_id", "cluster_theme", "priority_score", "cluster_size", "major_issue", "top_keywords"],
    )
    top = df.orderBy("priority_rank").limit(top_n)
    totals = df.agg(F.sum(_whole("cluster_size")).alias("_reviews"), F.count(F.lit(1)).alias("_clusters"))
    urgent = _theme_line(top, "Themes to act on first: ", F.min("priority_rank"))
    rank = _whole("priority_rank")
    theme, issue, keywords = (clip(F.col(c), n) for c, n in [("cluster_theme", 200), ("major_issue", 100), ("top_keywords", 250)])
    overview = [
        "# Product Manager Insight Report",
        "",
        "## 1. Executive Summary",
        "",
        f"Complaint themes of {scope(sentiment)}, the most urgent first. Issues come from {issue_method}, clusters from {cluster_method}.",
        "",
        _joined(f"- Total clustered {scope(sentiment).replace('customer ', '')}: **", F.col("_reviews"), "**"),
        _joined("- Number of complaint clusters: **", F.col("_clusters"), "**"),
        _joined(
            "- Top priority themes included in this report: **", F.least(F.col("_clusters"), F.lit(top_n)), "**"
        ),
        "",
        SCORE_METHOD,
        "",
    ]
    table_row = _joined(
        "| ", rank, " | ", clip(F.col("cluster_theme"), 120), " | ", fixed(F.col("priority_score"), 2), " | ",
        _whole("cluster_size"), " | ", clip(F.col("major_issue"), 80), " | ", clip(F.col("top_keywords"), 180), " |",
    )
    detail = [
        _joined("### Priority ", rank, ": ", theme),
        "",
        _joined("- Cluster ID: **", _whole("cluster_id"), "**"),
        _joined("- Priority score: **", fixed(F.col("priority_score"), 2), "**"),
        _joined("- Cluster size: **", _whole("cluster_size"), "**"),
        _joined("- Major issue label: **", issue, "**"),
        _joined("- Keywords: ", keywords),
        _optional(df, "issue_concentration", "- Issue concentration: **", fixed(F.col("issue_concentration"), 2)),
        _optional(df, "avg_issue_confidence", "- Average issue confidence: **", fixed(F.col("avg_issue_confidence"), 2)),
        _optional(df, "negative_ratio", "- Negative ratio: **", fixed(F.col("negative_ratio"), 2)),
        "",
        "Representative customer evidence:",
        "",
        *_reviews(df),
        "",
        "Recommended product action:",
        "",
        recommended_action(theme, issue, keywords),
        "",
    ]
    parts = [
        _lines(totals, 1, F.lit(0), overview),
        _lines(
            totals, 2, F.lit(0),
            ["## 2. Top Priority Complaint Themes", "", "| Rank | Theme | Score | Size | Major Issue | Keywords |", "|---:|---|---:|---:|---|---|"],
        ),
        _lines(top, 2, rank, [table_row]),
        _lines(totals, 3, F.lit(0), ["", "## 3. Detailed Priority Analysis", ""]),
        _lines(top, 3, rank, detail),
        _lines(
            urgent, 4, F.lit(0),
            ["## 4. Product Implications", "", F.col("_themes"), "", "## 5. Limitations and Future Work", "", *LIMITS, ""],
        ),
    ]
    return _union(parts)


def classification_report_text(
    report: DataFrame, accuracy: Column, digits: int = 4, title: str | None = None
) -> DataFrame:
    """Fixed-width lines of a classification report, under a title with the accuracy."""
    width = 12
    names = ["precision", "recall", "f1_score"]
    numbers = [F.lpad(fixed(F.col(n), digits), 10, " ") for n in names]
    row = F.concat(F.lpad("label", width, " "), F.lit(" "), *numbers, F.lpad(F.col("support").cast("string"), 10, " "))
    head = " " * width + " " + "".join(n.rjust(10) for n in ("precision", "recall", "f1-score", "support"))
    total = F.lpad(F.max("support").cast("string"), 10, " ")
    means = F.col("label").endswith(" avg")
    body = _lines(report.filter(~means), 2, F.col("label_id"), [row])
    tail = _lines(report.filter(means), 4, F.col("label_id"), [row])
    middle = report.filter(means).agg(
        F.concat(F.lpad(F.lit("accuracy"), width, " "), F.lit(" " * 21), F.lpad(fixed(accuracy, digits), 10, " "), total).alias("_a")
    )
    heading = []
    if title:
        shown = _joined("Accuracy: ", fixed(accuracy, digits))
        heading = [_lines(middle, 0, F.lit(0), [title, "=" * len(title), "", shown, ""])]
    return _union(
        [
            *heading,
            _lines(middle, 1, F.lit(0), [head, ""]),
            body,
            _lines(middle, 3, F.lit(0), ["", F.col("_a")]),
            tail,
        ]
    )


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result
