"""All stages over one folder of tables; each stage can be run again alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.fixed import VECTOR_MODEL
from ..operators import clustering
from ..operators.export import summary_rows, summary_scope
from ..operators.gates import STAGE1_COLUMNS, kept, stage1
from ..operators.labels import LABEL_COLUMNS, label_rows
from ..operators.semantic import DEFAULT_TAU, centroid_filter, classifier_filter, similarity_stats, stage_counts
from ..operators.vectors import EMBEDDING_COLUMNS, Encoder, embed_missing, hashed_encoder, vectors_for
from ..session import cut
from ..sources.sinks import export_graph, export_summaries
from ..sources.tables import CLUSTER_META, EMBEDDINGS, PAPERS, PAPERS_RAW, BucketTable, SnapshotTable
from ..streaming.ingest import harvest
from .build_graph import build_graph
from .label_clusters import label_clusters

DECISION = ["ai_sem_sim", "ai_stage2_keep", "ai_stage2_reason"]
CLUSTER_COLUMNS = ["kmeans_cluster", "agg_cluster", "hdbscan_cluster"]


class CorpusStages:
    """harvest, stage1, embed, filter, cluster, label, export over tables under ``root``."""

    def __init__(
        self, spark: SparkSession, root: str, encoder: Encoder | None = None, model: str = VECTOR_MODEL
    ):
        self.spark, self.root, self.model = spark, root.rstrip("/"), model
        self.encoder = encoder or hashed_encoder()
        # What the last run of a stage has counted.
        self.counts: dict[str, dict] = {}
        self.raw = BucketTable(spark, f"{self.root}/papers_raw", PAPERS_RAW, ["id"])
        self.papers = SnapshotTable(spark, f"{self.root}/papers", PAPERS)
        self.embeddings = SnapshotTable(spark, f"{self.root}/embeddings", EMBEDDINGS)
        self.labels = SnapshotTable(spark, f"{self.root}/cluster_meta", CLUSTER_META)

    def harvest(self, landing: str, from_date: str | None = None, until_date: str | None = None):
        """Take new pages; returns the run's window and counts."""
        state = harvest(
            self.spark, landing, self.raw.path, f"{self.root}/_harvest", from_date, until_date
        )
        self.counts["harvest"] = state.first().asDict()
        return state

    def stage1(self, keep_all: bool = False, prune: bool = False, **rules) -> DataFrame:
        """Copy candidates into the papers; ``counts["stage1"]`` says how many of how many."""
        scanned, copied = Observation(), Observation()
        raw = self.raw.read().observe(scanned, F.count(F.lit(1)).alias("n"))
        found = stage1(raw, keep_all, **rules).observe(copied, F.count(F.lit(1)).alias("n"))
        found = cut(found, "stage1")
        self.counts["stage1"] = {"scanned": scanned.get.get("n", 0), "copied": copied.get.get("n", 0)}
        return self.papers.upsert(found, ["id"], update_cols=STAGE1_COLUMNS[:], prune=prune)

    def embed(self) -> DataFrame:
        new = embed_missing(self.papers.read(), self.embeddings.read(), self.encoder, self.model)
        return self.embeddings.upsert(new, ["paper_id"], update_cols=EMBEDDING_COLUMNS)

    def filter(
        self,
        seeds: DataFrame | None = None,
        labels: DataFrame | None = None,
        method: str = "centroid",
        tau: float = DEFAULT_TAU,
    ) -> DataFrame:
        """Decide which papers stay; returns the stage's counts and the scores' statistics."""
        papers, emb = self.papers.read(), self.embeddings.read()
        if method == "centroid":
            if seeds is None:
                raise ValueError("the centroid method needs seeds")
            decided = centroid_filter(papers, emb, seeds, tau, self.model)
        elif method == "logreg":
            if labels is None:
                raise ValueError("the logreg method needs labels")
            decided = classifier_filter(papers, emb, labels, tau, self.model)
        else:
            raise ValueError(f"unknown method {method!r}")
        written = self.papers.replace(decided)
        # Statistics of what was scored now; a paper without a vector keeps an older score.
        scored = written.where("ai_stage2_keep is not null")
        stats = similarity_stats(scored).first().asDict()
        counts = stage_counts(written).withColumns({k: F.lit(v).cast("double") for k, v in stats.items()})
        self.counts["filter"] = counts.first().asDict()
        return counts

    def cluster(
        self, kmeans: int = 8, agg: int = 8, density_min: int = 5, reduce_dim: int | None = None
    ) -> DataFrame:
        self.embed()
        rows = kept(self.papers.read()).select("id")
        vectors = vectors_for(rows, self.embeddings.read(), self.model)
        ready = cut(clustering.prepared(vectors, reduce_dim), "prepared")
        found = (
            clustering.kmeans(ready, kmeans)
            .join(clustering.ward(ready, agg), "paper_id")
            .join(clustering.density_cluster(ready, density_min), "paper_id")
            .withColumnRenamed("paper_id", "id")
        )
        return self.papers.update_by_key(found, ["id"], CLUSTER_COLUMNS)

    def label(self, **options) -> DataFrame:
        named = label_clusters(
            self.papers.read(), self.embeddings.read(), self.encoder, model=self.model, **options
        )
        return self.labels.upsert(
            label_rows(named), ["method", "cluster_id"], update_cols=LABEL_COLUMNS
        )

    def export_graph(self, path: str, gzip: bool = False, document: bool = False, **options) -> str:
        graph = build_graph(
            self.papers.read(), self.embeddings.read(), self.labels.read(), model=self.model, **options
        )
        return export_graph(
            graph.nodes, graph.links, graph.clusters, graph.meta, path, gzip, document
        )

    def export_summaries(
        self,
        path: str,
        ids: DataFrame | None = None,
        only_ids: bool = False,
        only_clustered: bool = False,
        gzip: bool = False,
        document: bool = False,
        **fields,
    ) -> str:
        rows = summary_scope(self.papers.read(), ids, only_ids, only_clustered)
        return export_summaries(summary_rows(rows, **fields), path, gzip, document)

    def run(
        self, landing: str, seeds: DataFrame, out: str, tau: float = DEFAULT_TAU, **options
    ) -> DataFrame:
        """All stages in order; returns the labels."""
        self.harvest(landing)
        self.stage1(options.pop("keep_all", False))
        self.embed()
        self.filter(seeds, tau=tau)
        self.cluster(**{k: options.pop(k) for k in ("kmeans", "agg", "density_min") if k in options})
        self.label(**options.pop("labelling", {}))
        self.export_graph(f"{out}/graph", **options.pop("graph", {}))
        self.export_summaries(f"{out}/summaries")
        return self.labels.read()
