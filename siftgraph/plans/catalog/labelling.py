"""Terms and labels of clustered documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions.text import assemble_text
from ...operators import labels, terms
from ...operators.graph import cluster_sizes
from ...operators.vectors import centroid, hashed_encoder
from ...session import cut
from ..label_clusters import label_clusters
from .base import clustered, embeddings, papers, query

STOPWORDS = ["the", "of", "and", "la", "de"]


def _text():
    return assemble_text(F.col("title"), F.col("summary"), ". ")


@query("document_frequency", "SELECT term, df FROM vocabulary", "terms")
def document_frequency(spark, sf):
    return terms.vocabulary(papers(spark, sf), _text(), clustered(spark, sf).count(), (1, 2), 6, 0.6, STOPWORDS)


def _weights(spark, sf):
    return terms.tfidf(clustered(spark, sf), _text(), (1, 2), 6, 0.6, STOPWORDS)


@query("tfidf", "SELECT id, term, tf, df, round(weight, 6) AS weight FROM weights", "weights")
def tfidf(spark, sf):
    return _weights(spark, sf).select("id", "term", "tf", "df", F.round("weight", 6).alias("weight"))


def _cluster_terms(spark, sf):
    return terms.cluster_tfidf(clustered(spark, sf), _text(), (1, 2), 6, 0.6, STOPWORDS)


@query("cluster_terms", "SELECT cid, term, round(weight, 6) AS weight FROM cluster_terms", "weights")
def cluster_terms(spark, sf):
    return _cluster_terms(spark, sf).select("cid", "term", F.round("weight", 6).alias("weight"))


def _round(n: int, before: str) -> str:
    clash = " ".join(
        f"AND NOT (contains(term, t{i}) OR contains(t{i}, term))" for i in range(n)
    )
    taken = "".join(f"t{i}, " for i in range(n))
    return f"""chosen{n} AS (
  SELECT cid, {taken}term AS t{n}, weight AS w{n} FROM cluster_terms {before} WHERE true {clash}
  QUALIFY row_number() OVER (PARTITION BY cid ORDER BY round(weight, 9) DESC, term) = 1)"""


def _all_rounds(k: int) -> str:
    steps = [_round(0, "")] + [
        _round(n, f"JOIN (SELECT * FROM chosen{n - 1}) USING (cid)") for n in range(1, k)
    ]
    picked = " UNION ALL ".join(
        f"SELECT cid, {n} AS pos, t{n} AS term, round(w{n}, 6) AS weight FROM chosen{n}"
        for n in range(k)
    )
    return ", " + ", ".join(steps) + " " + picked


@query("diverse_terms", _all_rounds(3), "weights")
def diverse_terms(spark, sf):
    rows = terms.diverse_terms(_cluster_terms(spark, sf), 3)
    return rows.select("cid", "pos", "term", F.round("weight", 6).alias("weight"))


@query(
    "candidate_phrases",
    "SELECT DISTINCT CASE WHEN df > 200 THEN 'language models' ELSE term END AS phrase FROM vocabulary WHERE df <= 200",
    "terms",
)
def candidate_phrases(spark, sf):
    named = document_frequency(spark, sf).select(
        F.when(F.col("df") > 200, "language models").otherwise(F.col("term")).alias("term")
    )
    # Words are those of the terms, so that a term of other letters than a to z stays.
    found = labels.candidate_phrases(named, ["AI models", "agents"], terms.TOKEN)
    return found.where("phrase <> 'AI models'")


def _ranked(spark, sf):
    """Vectors ranked against the clusters' centroids, as phrases would be."""
    emb = embeddings(spark, sf)
    phrases = emb.select(F.col("paper_id").alias("phrase"), "vector")
    return labels.rank_against_centroids(phrases, cut(centroid(emb, ["cid"]), "centroids"), 4)


@query("phrase_ranking", "SELECT cid, phrase, round(sim, 6) AS sim, rank FROM phrases", "phrases")
def phrase_ranking(spark, sf):
    return _ranked(spark, sf).select("cid", "phrase", F.round("sim", 6).alias("sim"), "rank")


@query(
    "top_phrases",
    """SELECT cid, string_agg(CAST(phrase AS VARCHAR), ',' ORDER BY rank) AS terms, round(max(sim), 6) AS confidence
    FROM phrases GROUP BY cid""",
    "phrases",
)
def top_phrases(spark, sf):
    rows = labels.top_phrases(_ranked(spark, sf))
    joined = F.array_join(F.col("terms").cast("array<string>"), ",")
    return rows.select("cid", joined.alias("terms"), F.round("confidence", 6).alias("confidence"))


def _representatives(spark, sf):
    emb = embeddings(spark, sf)
    members = clustered(spark, sf).select("id", "title", "cid").join(
        emb.select(F.col("paper_id").alias("id"), "vector"), "id"
    )
    return labels.representative(members, cut(centroid(emb, ["cid"]), "centroids"))


@query(
    "representative",
    r"""SELECT cid, regexp_replace(regexp_replace(full_title, ':[^\n]*$', ''), '^\s+|\s+$', '', 'g') AS title,
      round(confidence, 6) AS confidence FROM reps""",
    "reps",
)
def representative(spark, sf):
    return _representatives(spark, sf).select(
        "cid", "title", F.round("confidence", 6).alias("confidence")
    )


# Many clusters want few phrases: nations as clusters, shared ranked part types as phrases.
_WALK = """sizes AS (SELECT p_size AS cid, count(*) AS size FROM part GROUP BY 1),
wishes AS (SELECT cid, phrase, row_number() OVER (PARTITION BY cid ORDER BY n DESC, phrase) AS rank
  FROM (SELECT p_size AS cid, p_type || ' ' || (p_size // 10) AS phrase, count(*) AS n FROM part GROUP BY ALL)),
queue AS (SELECT cid, row_number() OVER (ORDER BY size DESC, cid) AS turn FROM sizes),
lists AS (SELECT turn, cid, list(phrase ORDER BY rank) AS l FROM queue JOIN wishes USING (cid) GROUP BY ALL),
walk AS (
  SELECT turn, cid, l[1] AS phrase, [l[1]] AS used FROM lists WHERE turn = 1
  UNION ALL
  SELECT n.turn, n.cid, list_filter(n.l, lambda p: NOT list_contains(w.used, p))[1],
    list_concat(w.used, list_filter(n.l, lambda p: NOT list_contains(w.used, p))[1:1])
  FROM walk w JOIN lists n ON n.turn = w.turn + 1)
SELECT cid, phrase FROM walk WHERE phrase IS NOT NULL"""


@query("unique_terms", "WITH RECURSIVE " + _WALK)
def unique_terms(spark, sf):
    from pyspark.sql import Window

    from .base import table

    part = table(spark, sf, "part")
    sizes = part.groupBy(F.col("p_size").alias("cid")).agg(F.count(F.lit(1)).alias("size"))
    decade = F.floor(F.col("p_size") / 10).cast("string")
    wishes = part.groupBy(
        F.col("p_size").alias("cid"), F.concat("p_type", F.lit(" "), decade).alias("phrase")
    ).agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("cid").orderBy(F.col("n").desc(), "phrase")
    return labels.unique_terms(wishes.withColumn("rank", F.row_number().over(order)), sizes)


@query(
    "assign_labels",
    r"""SELECT cid, regexp_replace(regexp_replace(full_title, ':[^\n]*$', ''), '^\s+|\s+$', '', 'g') AS label,
      round(confidence, 6) AS confidence FROM reps
    WHERE cid NOT IN (SELECT cid FROM phrases WHERE rank = 1 AND sim >= 0.45)
    UNION ALL
    SELECT cid, CAST(phrase AS VARCHAR), round(sim, 6) FROM phrases WHERE rank = 1 AND sim >= 0.45""",
    "reps phrases",
)
def assign_labels(spark, sf):
    """No phrase is wanted twice here, so each cluster gets its first or its title."""
    ranked = _ranked(spark, sf).withColumn("phrase", F.col("phrase").cast("string"))
    rows = labels.assign_labels(
        ranked, _representatives(spark, sf), cluster_sizes(clustered(spark, sf)), 0.45, unique=False
    )
    return rows.select("cid", "label", F.round("confidence", 6).alias("confidence"))


@query("label_clusters")
def label_all(spark, sf):
    encoder = hashed_encoder(64)
    rows = label_clusters(
        clustered(spark, sf), embeddings(spark, sf), encoder, ngram_range=(1, 2), cosine_floor=0.1
    )
    return rows.withColumn("terms", F.array_join("terms", "|"))
