"""Vector algebra, second-stage filters and clusterings over the embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions.vectors import cosine, l2_normalize
from ...operators import clustering, linkage, lloyd, neighbours, ordering, semantic, spanning
from ...operators import vectors as vec
from ...session import cut
from ...sources.tables import update_by_key
from .base import MST, embeddings, papers, query, seeds, table

TAU = 0.1


@query(
    "l2_normalize",
    "SELECT id, generate_subscripts(u, 1) - 1 AS pos, round(unnest(u), 6) + 0.0 AS x FROM unit",
    "unit",
)
def unit_vectors(spark, sf):
    unit = embeddings(spark, sf).select(
        F.col("paper_id").alias("id"), F.posexplode(l2_normalize(F.col("vector"))).alias("pos", "x")
    )
    return unit.select("id", F.col("pos").cast("long").alias("pos"), F.round("x", 6).alias("x"))


@query(
    "vectors_for",
    "SELECT id, round(list_sum(u), 6) + 0.0 AS total FROM unit WHERE id IN (SELECT id FROM seeds)",
    "unit seeds",
)
def vectors_for(spark, sf):
    rows = vec.vectors_for(seeds(spark, sf), embeddings(spark, sf))
    total = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x)
    return rows.select(F.col("paper_id").alias("id"), F.round(total, 6).alias("total"))


@query(
    "for_model",
    "SELECT vec_id AS paper_id, CASE WHEN label < 5 THEN 'a' ELSE 'b' END AS model FROM embeddings WHERE label < 5",
)
def for_model(spark, sf):
    named = embeddings(spark, sf).withColumn("model", F.when(F.col("cid") < 5, "a").otherwise("b"))
    return vec.for_model(named, "a").select("paper_id", "model")


@query(
    "missing_embeddings",
    "SELECT doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)",
)
def missing_embeddings(spark, sf):
    return vec.missing_embeddings(papers(spark, sf), embeddings(spark, sf)).select("id")


@query(
    "vector_or_null",
    "SELECT p.id, u.id IS NOT NULL AS has_vector FROM papers p LEFT JOIN unit u USING (id)",
    "papers unit",
)
def vector_or_null(spark, sf):
    rows = vec.vector_or_null(papers(spark, sf), embeddings(spark, sf))
    return rows.select("id", F.col("vector").isNotNull().alias("has_vector"))


@query(
    "seed_vectors",
    "SELECT id FROM unit WHERE id IN (SELECT id FROM seeds)",
    "unit seeds",
)
def seed_vectors(spark, sf):
    rows = vec.seed_vectors(seeds(spark, sf), embeddings(spark, sf))
    return rows.select(F.col("paper_id").alias("id"))


@query(
    "seed_centroid",
    "SELECT generate_subscripts(c, 1) - 1 AS pos, round(unnest(c), 6) + 0.0 AS x FROM center",
    "center",
)
def seed_centroid(spark, sf):
    center = vec.centroid(vec.seed_vectors(seeds(spark, sf), embeddings(spark, sf)))
    rows = center.select(F.posexplode("centroid").alias("pos", "x"))
    return rows.select(F.col("pos").cast("long").alias("pos"), F.round("x", 6).alias("x"))


@query(
    "cluster_centroids",
    "SELECT cid, generate_subscripts(c, 1) - 1 AS pos, round(unnest(c), 6) + 0.0 AS x FROM centroids",
    "centroids",
)
def cluster_centroids(spark, sf):
    rows = vec.centroid(embeddings(spark, sf), ["cid"]).select(
        "cid", F.posexplode("centroid").alias("pos", "x")
    )
    return rows.select("cid", F.col("pos").cast("long").alias("pos"), F.round("x", 6).alias("x"))


@query(
    "cosine",
    "SELECT unit.id, round(list_dot_product(u, c), 6) + 0.0 AS sim FROM unit JOIN centroids USING (cid)",
    "centroids",
)
def cosine_to_own_centroid(spark, sf):
    emb = embeddings(spark, sf)
    rows = emb.join(vec.centroid(emb, ["cid"]), "cid")
    sim = cosine(F.col("vector"), F.col("centroid"))
    return rows.select(F.col("paper_id").alias("id"), F.round(sim, 6).alias("sim"))


def _filtered(spark, sf):
    return semantic.centroid_filter(
        papers(spark, sf), embeddings(spark, sf), seeds(spark, sf), TAU
    )


@query(
    "centroid_filter",
    """SELECT id, round(sim, 6) + 0.0 AS sim, CAST(sim >= 0.1 AS INTEGER) AS keep,
      CASE WHEN sim IS NULL THEN 'missing-embedding' ELSE 'centroid tau=0.1' END AS reason FROM scored""",
    "scored",
)
def centroid_filter(spark, sf):
    return _filtered(spark, sf).select(
        "id",
        F.round("ai_sem_sim", 6).alias("sim"),
        F.col("ai_stage2_keep").alias("keep"),
        F.col("ai_stage2_reason").alias("reason"),
    )


@query(
    "similarity_stats",
    """SELECT round(min(sim), 6) AS min, round(quantile_cont(sim, 0.1), 6) AS p10,
      round(quantile_cont(sim, 0.5), 6) AS median, round(quantile_cont(sim, 0.9), 6) AS p90,
      round(max(sim), 6) AS max FROM scored""",
    "scored",
)
def similarity_stats(spark, sf):
    stats = semantic.similarity_stats(_filtered(spark, sf))
    return stats.select(*[F.round(c, 6).alias(c) for c in stats.columns])


@query(
    "stage_counts",
    """SELECT count(*) AS scanned, count(*) FILTER (WHERE sim >= 0.1) AS kept,
      count(*) FILTER (WHERE sim < 0.1) AS rejected, count(*) FILTER (WHERE sim IS NULL) AS undecided FROM scored""",
    "scored",
)
def stage_counts(spark, sf):
    return semantic.stage_counts(_filtered(spark, sf))


@query(
    "update_by_key",
    """SELECT p.id, published, CAST(round(s.sim, 6) + 0.0 AS DOUBLE) AS score
    FROM papers p LEFT JOIN scored s ON s.id = p.id AND s.sim >= 0.1""",
    "scored",
)
def write_scores(spark, sf):
    target = papers(spark, sf).withColumn("score", F.lit(None).cast("double"))
    scores = _filtered(spark, sf).where("ai_stage2_keep = 1").select(
        "id", F.col("ai_sem_sim").alias("score")
    )
    rows = update_by_key(target, scores, ["id"], ["score"])
    return rows.select("id", "published", F.round("score", 6).alias("score"))


@query("classifier_filter")
def classifier_filter(spark, sf):
    labels = table(spark, sf, "labels").select(
        F.col("doc_id").alias("id"), F.col("quality").alias("label")
    )
    rows = semantic.classifier_filter(papers(spark, sf), embeddings(spark, sf), labels, 0.5)
    return rows.select("id", "ai_sem_sim", "ai_stage2_keep", "ai_stage2_reason")


@query("knn_global", "SELECT src, dst, round(sim, 6) AS sim FROM knn", "knn")
def knn_global(spark, sf):
    rows = neighbours.knn_join(embeddings(spark, sf), 5, 0.30)
    return rows.select("src", "dst", F.round("sim", 6).alias("sim"))


@query(
    "knn_in_cluster",
    """SELECT src, dst, round(sim, 6) AS sim FROM pairs WHERE cid = other AND sim >= 0.10
    QUALIFY row_number() OVER (PARTITION BY src ORDER BY round(sim, 9) DESC, dst) <= 5""",
    "pairs",
)
def knn_in_cluster(spark, sf):
    rows = neighbours.knn_join(embeddings(spark, sf), 5, 0.10, within="cid")
    return rows.select("src", "dst", F.round("sim", 6).alias("sim"))


@query(
    "knn_split",
    """SELECT src, dst, round(sim, 6) AS sim FROM pairs WHERE sim >= 0.20
    QUALIFY row_number() OVER (PARTITION BY src ORDER BY round(sim, 9) DESC, dst) <= 3""",
    "pairs",
)
def knn_split(spark, sf):
    """The same join forced through several cells and blocks, as a large table would go."""
    rows = neighbours.knn_join(embeddings(spark, sf), 3, 0.20, block_rows=128)
    return rows.select("src", "dst", F.round("sim", 6).alias("sim"))


@query("knn_approx")
def knn_approx(spark, sf):
    return neighbours.knn_approx(embeddings(spark, sf), 5, 0.30, bits=2, tables=8)


@query(
    "top_k_per_group",
    """SELECT cid, id, round(s, 6) AS s FROM (SELECT cid, id, u[1] AS s FROM unit)
    QUALIFY row_number() OVER (PARTITION BY cid ORDER BY round(s, 9) DESC, id) <= 3""",
    "unit",
)
def top_k_per_group(spark, sf):
    rows = embeddings(spark, sf).select(
        "cid", F.col("paper_id").alias("id"), l2_normalize(F.col("vector"))[0].alias("s")
    )
    best = ordering.top_k_per_group(rows, ["cid"], [F.round("s", 9).desc(), F.col("id")], 3)
    return best.select("cid", "id", F.round("s", 6).alias("s"))


@query("cluster_mst", ", " + MST + "SELECT src, dst, round(sim, 6) AS sim FROM grow WHERE src IS NOT NULL", "pairs")
def cluster_mst(spark, sf):
    rows = spanning.cluster_mst(embeddings(spark, sf), "cid")
    return rows.select("src", "dst", F.round("sim", 6).alias("sim"))


@query("cluster_mst_split", ", " + MST + "SELECT src, dst, round(sim, 6) AS sim FROM grow WHERE src IS NOT NULL", "pairs")
def cluster_mst_split(spark, sf):
    """Clusters cut into blocks, block trees merged by rounds of joins."""
    rows = spanning.cluster_mst(embeddings(spark, sf), "cid", block_rows=32)
    return rows.select("src", "dst", F.round("sim", 6).alias("sim"))


@query("kmeans")
def kmeans(spark, sf):
    return clustering.kmeans(clustering.prepared(embeddings(spark, sf)), 8)


@query("kmeans_reduced")
def kmeans_reduced(spark, sf):
    return clustering.kmeans(clustering.prepared(embeddings(spark, sf), 16), 8)


def _moved(n: int) -> str:
    """Centres after one more pass, from those of pass ``n``."""
    return f""", near{n} AS (
  SELECT unit.id, any_value(u) AS u, arg_min(c.cid, (round(list_distance(u, c) * list_distance(u, c), 12), c.cid)) AS cid
  FROM unit, pass{n} c GROUP BY unit.id),
pass{n + 1} AS (
  SELECT cid, list(m ORDER BY pos) AS c FROM (
    SELECT cid, pos, avg(x) AS m FROM (
      SELECT cid, unnest(u) AS x, generate_subscripts(u, 1) AS pos FROM near{n}) GROUP BY cid, pos)
  GROUP BY cid)"""


@query(
    "lloyd",
    ", pass0 AS (SELECT * FROM centroids)" + "".join(map(_moved, range(4)))
    + " SELECT cid, generate_subscripts(c, 1) - 1 AS pos, round(unnest(c), 6) + 0.0 AS x FROM pass4",
    "centroids",
)
def lloyd_passes(spark, sf):
    """Four passes from the centroids of the ten labels."""
    import numpy as np

    emb = embeddings(spark, sf)
    rows = vec.centroid(emb, ["cid"]).orderBy("cid").collect()
    unit = emb.select(l2_normalize(F.col("vector")).alias("vector"))
    _, moved = lloyd.lloyd(unit, [np.array([r["centroid"] for r in rows])], max_iter=4, tol=0.0)[0]
    out = [(r["cid"], p, round(float(x), 6) + 0.0) for r, c in zip(rows, moved, strict=True) for p, x in enumerate(c)]
    return spark.createDataFrame(out, "cid int, pos long, x double")


@query(
    "assign_nearest",
    """SELECT unit.id, arg_min(c.cid, (round(list_distance(u, c), 9), c.cid)) AS cluster
    FROM unit, centroids c GROUP BY unit.id""",
    "centroids",
)
def assign_nearest(spark, sf):
    import numpy as np

    emb = embeddings(spark, sf)
    # Ten rows, one per label.
    rows = vec.centroid(emb, ["cid"]).orderBy("cid").collect()
    centers = np.array([r["centroid"] for r in rows])
    unit = emb.select("paper_id", l2_normalize(F.col("vector")).alias("vector"))
    found = clustering.assign_nearest(unit, centers)
    return found.select(F.col("paper_id").alias("id"), "cluster")


@query("ward")
def ward(spark, sf):
    return clustering.ward(clustering.prepared(embeddings(spark, sf)), 8)


@query("density_cluster")
def density_cluster(spark, sf):
    return clustering.density_cluster(embeddings(spark, sf))


# Mutual reachability, its spanning tree by growing one, and all components at each of its distances.
_LEVELS = """, core AS (
  SELECT src, sqrt(greatest(0.0, 2 - 2 * min(s))) AS core FROM (
    SELECT src, round(sim, 12) AS s, row_number() OVER (PARTITION BY src ORDER BY round(sim, 9) DESC, dst) AS k FROM pairs)
  WHERE k <= 3 GROUP BY src),
ids AS (SELECT id, row_number() OVER (ORDER BY id) AS i FROM unit),
reach AS (
  SELECT a.i, list(coalesce(greatest(x.core, y.core, sqrt(greatest(0.0, 2 - 2 * round(p.sim, 12)))), CAST('inf' AS DOUBLE)) ORDER BY b.i) AS row
  FROM ids a CROSS JOIN ids b LEFT JOIN pairs p ON p.src = a.id AND p.dst = b.id
  LEFT JOIN core x ON x.src = a.id LEFT JOIN core y ON y.src = b.id GROUP BY a.i),
prim AS (
  SELECT 0 AS step, CAST(1 AS BIGINT) AS last, list_transform(row, lambda x: CAST('inf' AS DOUBLE)) AS best,
    list_transform(row, lambda x: CAST(0 AS BIGINT)) AS frm, CAST(NULL AS DOUBLE) AS d, CAST(NULL AS BIGINT) AS u
  FROM reach WHERE i = 1
  UNION ALL
  SELECT step + 1, nxt, nb, nf, nb[nxt], nf[nxt] FROM (
    SELECT step, nb, nf, CAST(list_position(nb, list_min(nb)) AS BIGINT) AS nxt FROM (
      SELECT step, list_transform(row, lambda x, j: CASE WHEN best[j] IS NULL OR j = last THEN NULL ELSE least(x, best[j]) END) AS nb,
        list_transform(row, lambda x, j: CASE WHEN x < best[j] THEN last ELSE frm[j] END) AS nf
      FROM prim JOIN reach r ON r.i = prim.last)
    WHERE list_min(nb) IS NOT NULL)),
tree AS (SELECT u, last AS v, d, row_number() OVER (ORDER BY d, step) AS k FROM prim WHERE step > 0),
steps AS (
  SELECT CAST(0 AS BIGINT) AS k, (SELECT list(i ORDER BY i) FROM ids) AS labels
  UNION ALL
  SELECT t.k, list_transform(labels, lambda x: CASE WHEN x = labels[t.u] OR x = labels[t.v] THEN least(labels[t.u], labels[t.v]) ELSE x END)
  FROM steps s JOIN tree t ON t.k = s.k + 1),
comps AS (
  SELECT DISTINCT l.d, labels[t.u] AS c, len(list_filter(labels, lambda x: x = labels[t.u])) AS n, l.k
  FROM tree t JOIN (SELECT d, max(k) AS k FROM tree GROUP BY d) l ON t.d = l.d JOIN steps s ON s.k = l.k)
"""


@query(
    "linkage_levels",
    _LEVELS
    + """SELECT round(a.d, 6) AS dist, least.id AS least, a.n, round(min(b.d), 6) AS up_dist
    FROM comps a JOIN ids least ON least.i = a.c
    LEFT JOIN (SELECT comps.*, labels FROM comps JOIN steps USING (k)) b ON b.d > a.d AND b.labels[a.c] = b.c
    GROUP BY a.d, least.id, a.n""",
    "pairs",
)
def linkage_levels(spark, sf):
    """Components of the mutual reachability graph, each from and to the distance where it ends."""
    points = cut(neighbours.points_of(embeddings(spark, sf), "paper_id", "vector", None), "points")
    tops, _ = linkage.linkage_levels(linkage.single_linkage(clustering.reachability_tree(points)))
    return tops.select(F.round("dist", 6).alias("dist"), "least", "n", F.round("up_dist", 6).alias("up_dist"))


@query("pca_coords")
def pca_coords(spark, sf):
    rows = clustering.pca_coords(embeddings(spark, sf))
    return rows.select("paper_id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


# Sums are made unit vectors in double precision from single precision ones, as in the library.
_HASHED = r""", words AS (
  SELECT id, unnest(regexp_extract_all(lower(title || '[SEP]' || summary), '[\p{L}\p{N}_]{2,}')) AS w
  FROM papers WHERE id NOT IN (SELECT vec_id FROM embeddings)),
cells AS (
  SELECT id, h % 64 AS pos, CAST(sum(CASE WHEN h >= 2147483648 THEN 1 ELSE -1 END * ln(1.0 + n)) AS FLOAT) AS x
  FROM (SELECT id, count(*) AS n, CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) AS h FROM words GROUP BY id, w)
  GROUP BY id, h % 64),
norms AS (SELECT id, sqrt(sum(CAST(x AS DOUBLE) * x)) AS norm FROM cells GROUP BY id)
SELECT p.id AS paper_id, 'specter2' AS model, 64 AS dim, i.pos,
  round(CAST(CAST(coalesce(x / (norm + 1e-12), 0.0) AS FLOAT) AS DOUBLE), 5) + 0.0 AS x
FROM papers p, (SELECT unnest(range(64)) AS pos) i
LEFT JOIN norms n ON n.id = p.id LEFT JOIN cells c ON c.id = p.id AND c.pos = i.pos
WHERE p.id NOT IN (SELECT vec_id FROM embeddings)"""


@query("embed_missing", _HASHED, "papers")
def embed_missing(spark, sf):
    rows = vec.embed_missing(papers(spark, sf), embeddings(spark, sf), vec.hashed_encoder(64))
    cells = rows.select("paper_id", "model", "dim", F.posexplode("vector").alias("pos", "x"))
    x = F.round(F.col("x").cast("double"), 5) + 0.0
    return cells.withColumns({"pos": F.col("pos").cast("long"), "x": x})
